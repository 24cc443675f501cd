import hashlib
import re

from edges import ROWS, same, table

from assetloom.llm.exact_dedup import drop_copies, exact_groups


def groups(rows):
    found = {}
    for r in rows:
        found.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""), []).append(r[0])
    return found


def test_against_brute_force(spark):
    got = exact_groups(table(spark)).collect()
    assert len(got) == len(ROWS)
    for norm, ids in groups(ROWS).items():
        own = [r for r in got if r.text_sha256 == hashlib.sha256(norm.encode()).hexdigest()]
        known = [i for i in ids if i is not None]
        assert len(own) == len(ids) and {r.group_size for r in own} == {len(ids)}
        assert {r.keep_id for r in own} == {min(known) if known else None}
        assert sum(r.kept for r in own) == 1


def test_drop_copies(spark):
    docs = table(spark)
    got = drop_copies(docs)
    assert got.schema.names == docs.schema.names and len(got.collect()) == len(groups(ROWS))
    expected = [min((i for i in ids if i is not None), default=None) for ids in groups(ROWS).values()]
    assert same([(r.doc_id,) for r in got.collect()], [(i,) for i in expected])
    assert drop_copies(docs.limit(0)).count() == exact_groups(docs.limit(0)).count() == 0


def test_hot_group(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'same  text' ELSE concat('t', id) END AS text")
    got = exact_groups(docs).where("group_size > 1").collect()
    assert len(got) == 1000 and {r.keep_id for r in got} == {0} and sum(r.kept for r in got) == 1
