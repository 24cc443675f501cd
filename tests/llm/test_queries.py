"""The registered corpus queries on the smallest tables, against plain Python."""

import hashlib
import html as html_lib
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import pytest
from test_jaccard import brute as near_groups
from test_tokens import one_by_one
from tokenizers import Tokenizer

import corpus_pipeline
from assetloom.llm import queries, toxicity
from assetloom.llm.common import table, utf8

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return pd.read_parquet(f"{SF_DIR}/documents.parquet")


def remainder(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def pieces_of(documents):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = []
    for doc_id, text in documents:
        ids = library.encode(text or "", add_special_tokens=False).ids + [queries.END_ID]
        for k, at in enumerate(range(0, len(ids), queries.SEQUENCE_TOKENS)):
            part = ids[at : at + queries.SEQUENCE_TOKENS]
            out.append((doc_id, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return sorted(out)


def check_packing(rows, expected):
    assert sorted(tuple(r[:5]) for r in rows) == expected
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1]] and sum(n for _, n in own) <= queries.SEQUENCE_TOKENS
    assert len(sequences) == len(one_by_one([p[3] for p in expected], queries.SEQUENCE_TOKENS))


def test_names():
    assert {int(re.match(r"op(\d+)_", name)[1]) for name in queries.QUERIES} == set(range(1, 14))
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["language_id", "clean", "exact_copies", "near_copies", "packed"]


def test_bpe(spark, documents):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: tuple(r) for r in queries.op2_bpe(spark, SF_DIR).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for doc_id, text in zip(documents.doc_id, documents.text):
        ids = library.encode(text, add_special_tokens=False).ids
        assert got[doc_id] == (doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_packing(spark, documents):
    check_packing(queries.op3_packing(spark, SF_DIR).collect(), pieces_of(zip(documents.doc_id, documents.text)))


def test_language(spark, documents):
    got = {r.doc_id: r for r in queries.op4_language(spark, SF_DIR).collect()}
    assert len(got) == len(documents) and all(r.held_out == (remainder(i, 4) == 2) for i, r in got.items())
    right = [got[i].lang_pred == lang for i, lang in zip(documents.doc_id, documents.lang) if got[i].held_out]
    assert np.mean(right) > 0.9


def test_toxicity(spark, documents):
    got = {r.doc_id: r for r in queries.op9_toxicity(spark, SF_DIR).collect()}
    assert len(got) == len(documents)
    assert all(r.held_out == (remainder(i, 5) == 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for i, r in got.items())


def test_pages(spark):
    got = {r.page_id: r for r in queries.op5_html(spark, SF_DIR).collect()}
    for page_id, url, html in pd.read_parquet(f"{SF_DIR}/pages.parquet").itertuples(index=False):
        assert got[page_id].url == url and got[page_id].n_chars == len(got[page_id].text)
        if "<article>" in html:
            body = html[html.index("<article>") : html.index("</article>")]
            body = re.sub(r"</?b>", "", body)
            assert got[page_id].text == " ".join(html_lib.unescape(re.sub(r"<[^>]*>", " ", body)).split())


def test_neighbours(spark):
    vectors = pd.read_parquet(f"{SF_DIR}/embeddings.parquet")
    matrix, ids = np.array(vectors.embedding.tolist(), float), vectors.vec_id.to_numpy()
    hits = total = 0
    for query, own in queries.op6_ann(spark, SF_DIR).toPandas().groupby("query_id"):
        score = matrix @ matrix[ids == query][0]
        score[ids == query] = -np.inf
        best = ids[np.lexsort((ids, -score))[:20]]
        assert own.sort_values("rank")["rank"].tolist() == list(range(1, 21)) and np.allclose(own.score, [score[ids == i][0] for i in own.vec_id])
        hits, total = hits + len(set(best) & set(own.vec_id)), total + 20
    assert total == 20 * (ids % 20 == 0).sum() and hits / total > 0.9


def test_pipeline(spark, documents):
    model = queries.language_model(table(spark, SF_DIR, "documents"))
    share = model.shares(documents.text.tolist()).max(1)
    kept = documents[share >= corpus_pipeline.LEAST_SHARE]
    frame = spark.createDataFrame(kept)
    labelled = queries.toxicity_model(frame, table(spark, SF_DIR, "labels"))
    rows = []
    for doc_id, text in zip(kept.doc_id, kept.text):
        data, offsets = utf8(pa.array([text]))
        if labelled.mark(toxicity.tokenise(data, offsets), 1)[1][0] < corpus_pipeline.TOXIC:
            rows.append((doc_id, text))
    first = {}
    for doc_id, text in sorted(rows):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text), (doc_id, text))
    rows = list(first.values())
    groups = near_groups(rows, corpus_pipeline.NGRAM_WORDS, corpus_pipeline.SIMILAR)
    rows = [r for r, (doc_id, _, component) in zip(rows, groups) if doc_id == component]
    check_packing(corpus_pipeline.run(spark, SF_DIR).collect(), pieces_of(rows))


def test_stages_keep_columns(spark):
    docs = table(spark, SF_DIR, "documents")
    odd = docs.unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(None, None, None, None, None)], docs.schema))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, odd, SF_DIR)
        assert kept.schema.names == docs.schema.names and stage(spark, odd.limit(0), SF_DIR).count() == 0
