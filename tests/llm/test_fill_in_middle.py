import hashlib
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from edges import ROWS, same, table

from assetloom.llm import fill_in_middle, queries

SF_DIR = "/root/testdata/sf0.001"


def plain_version(doc_id, text, plain_percent=10, spm_percent=20):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100 - plain_percent:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < spm_percent:
        return doc_id, n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return doc_id, n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def odd_rows():
    pick = random.Random(4)
    letters = ["a", "b", " ", "\n", "é", "ß", "語", "🙂", "<", ">", "<P", "S>", "<M>", "́", "\U0010ffff"]
    return [(i, "".join(pick.choices(letters, k=pick.choice((1, 2, 5, 30, 300))))) for i in range(400)]


def test_edges(spark):
    rows = [r[:2] for r in ROWS] + [(10, "<"), (11, "x<P>y"), (12, "🙂" * 50_000), (-1, "é")]
    docs = table(spark, [(*r, None, 1) for r in rows])
    got = fill_in_middle.restore(fill_in_middle.transform(docs))
    assert same([tuple(r)[:6] for r in got.collect()], [plain_version(*r) for r in rows])
    assert same([(r.doc_id, r.text) for r in got.collect()], [(i, t or "") for i, t in rows])
    assert fill_in_middle.transform(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("plain", "spm"), [(10, 20), (0, 100), (0, 0), (50, 50)])
def test_random_texts(spark, plain, spm):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = fill_in_middle.restore(fill_in_middle.transform(docs, 1, plain, spm)).collect()
    assert same([tuple(r)[:6] for r in got], [plain_version(*r, plain, spm) for r in rows])
    assert same([(r.doc_id, r.text) for r in got], rows)


def test_conversions():
    rows = ["", "abc", "éa語b🙂", "", "🙂🙂", "plain ascii"]
    data = np.frombuffer("".join(rows).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(r.encode()) for r in rows])])
    held = fill_in_middle.Exceptions(data, offsets)
    assert held.lengths().tolist() == [len(r) for r in rows]
    whole = "".join(rows)
    places = np.arange(len(whole) + 1)
    assert held.bytes(places).tolist() == [len(whole[:k].encode()) for k in places]
    assert held.points(held.bytes(places)).tolist() == places.tolist()


def test_marks_across_rows():
    texts = pa.array(["ab<", "P>cd", "<S", ">", "<M>"])
    h = [np.full(5, v, np.int64) for v in (1, 2, 0, 50)]
    assert fill_in_middle.cut_and_move(texts, h, 10, 20)[1].tolist() == [1, 1, 1, 1, 0]


def test_query(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = []
    for doc_id, text in pd.read_parquet(f"{SF_DIR}/documents.parquet")[["doc_id", "text"]].itertuples(index=False):
        row = plain_version(doc_id, text)
        expected.append((*row[:5], sha(row[5]), sha(text or "")))
    got = queries.op12_fill_in_middle(spark, SF_DIR)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert same([tuple(r) for r in got.collect()], expected)
