import hashlib
import random
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import sentencepiece
from edges import ROWS, same, table
from tokenizers import Tokenizer

from assetloom.llm import alignment, queries
from assetloom.llm.bpe import byte_characters

SF_DIR = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(rows):
    """Every row as a tuple of the query's columns, and the links of every pair with the documents that hold it."""
    one, two = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    byte = {c: b for b, c in enumerate(byte_characters())}
    parts, counts, holders = [], Counter(), Counter()
    for doc_id, text in rows:
        spaced = (" " + (text or "")).encode()
        ids_a = one.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        ids_b = two.encode(text) if text else []
        size_a = [bytes(byte[c] for c in one.id_to_token(i)) for i in ids_a]
        size_b = [bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [two.id_to_piece(i)]]
        if not text or b"".join(size_a) != spaced or b"".join(size_b) != spaced:
            ids_a = ids_b = []
        ends_a, ends_b = ([sum(map(len, s[: k + 1])) for k in range(len(i))] for s, i in ((size_a, ids_a), (size_b, ids_b)))
        links, groups, lo_a, lo_b = [], [], 0, 0
        where_b = {e: k for k, e in enumerate(ends_b)}
        for k, e in enumerate(ends_a):
            if e in where_b:
                j = where_b[e]
                links.append((ids_a[k], ids_b[j]))
                groups.append(",".join(map(str, ids_a[lo_a : k + 1])) + "|" + ",".join(map(str, ids_b[lo_b : j + 1])))
                lo_a, lo_b = k + 1, j + 1
        counts.update(links)
        holders.update(set(links))
        parts.append((doc_id, len(ids_a), len(ids_b), links, ";".join(groups)))
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = [
        (i, n_a, n_b, len(links), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links),
         hashlib.sha256(g.encode()).hexdigest() if g else "", g)
        for i, n_a, n_b, links, g in parts
    ]
    return out, {x: (holders[x], n, n == most[x[1]]) for x, n in counts.items()}


def compare(spark, rows, docs):
    expected, pairs = brute(rows)
    got = alignment.align_documents(docs, A, B, keep_groups=True)
    assert same([tuple(r) for r in got.documents.collect()], expected)
    assert {(r.a, r.b): (r.n_docs, r.n_links, r.best) for r in got.pairs.collect()} == pairs


def odd_rows():
    pick = random.Random(8)
    some = ["the", "The cat", "naïve", "日本語", "🙂", "▁", "<|endoftext|>", "<0x41>", "<s>", "\t", "\n\n", "  ", "a", "1234", "ﬁ", "\x00", "İ", "'s", "...", "x" * 50]
    return [(k, pick.choice(("", " ")).join(pick.choices(some, k=pick.choice((1, 3, 10, 60))))) for k in range(200)]


def test_edges_and_odd_texts(spark):
    rows = [r[:2] if r[1] is None or len(r[1]) < 10_000 else (r[0], r[1][:5_000]) for r in ROWS] + odd_rows()
    compare(spark, rows, table(spark, [(*r, None, 1) for r in rows]))
    empty = alignment.align_documents(table(spark).limit(0), A, B)
    assert empty.documents.count() == 0 and empty.pairs.count() == 0


def test_many_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK_LINKS", 40)
    rows = odd_rows() * 2
    compare(spark, rows, spark.createDataFrame(rows, "doc_id long, text string").coalesce(2))


def test_bitmaps():
    chance = np.random.default_rng(3)
    for docs, links in ((1, 5), (10, 400), (3000, 20_000), (60_000, 90_000)):
        pair, doc = chance.integers(0, 4, links) ** 3, chance.integers(0, docs, links)
        names, found = alignment.planes(pair, doc, docs)
        assert names.tolist() == sorted(set(pair.tolist()))
        for name, own in zip(names.tolist(), found):
            times = Counter(doc[pair == name].tolist())
            assert sum(alignment.popcount(m) << k for k, m in enumerate(own)) == sum(times.values())
            assert alignment.members(alignment.union(own)).tolist() == sorted(times)
            assert alignment.popcount(alignment.union(own)) == len(times)
            back = Counter()
            for k, m in enumerate(own):
                for d in alignment.members(m).tolist():
                    back[d] += 1 << k
            assert back == times


def test_query(spark):
    documents = pd.read_parquet(f"{SF_DIR}/documents.parquet")
    expected, _ = brute(list(zip(documents.doc_id.tolist(), documents.text)))
    got = queries.op13_alignment(spark, SF_DIR)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert same([tuple(r) for r in got.collect()], [r[:-1] for r in expected])
