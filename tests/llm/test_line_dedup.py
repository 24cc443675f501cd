import random
import re

from edges import ROWS, same, table

from assetloom.llm import line_dedup
from assetloom.llm.line_dedup import drop_similar_lines
from assetloom.session import cut


def tokens(line):
    return frozenset(re.findall(r"[^\x20\x09-\x0D]+", line.lower()))


def brute(rows):
    """The text of every row without lines that an earlier place matches."""
    lines = [((i is None, i or 0, k), tokens(x)) for i, t in rows if t is not None for k, x in enumerate(t.split("\n"))]
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, 0, 0, None))
            continue
        kept = []
        for k, x in enumerate(t.split("\n")):
            own = tokens(x)
            gone = own and any(p < (i is None, i or 0, k) and 100 * len(s & own) >= 80 * len(s | own) for p, s in lines if s)
            if not gone:
                kept.append(x)
        n = t.count("\n") + 1
        out.append((i, n, n - len(kept), "\n".join(kept)))
    return out


def test_against_brute_force(spark):
    pick = random.Random(1)
    vocabulary = [f"w{i}" for i in range(40)]
    bases = [[pick.choice(vocabulary) for _ in range(pick.choice((1, 2, 5, 6, 12, 25)))] for _ in range(30)]
    rows = []
    for doc in range(60):
        lines = []
        for _ in range(pick.randint(1, 6)):
            words = list(pick.choice(bases))
            for _ in range(pick.choice((0, 0, 1, 2))):
                words[pick.randrange(len(words))] = pick.choice(vocabulary).upper()
            lines.append(" ".join(words) if pick.random() > 0.1 else "")
        rows.append((doc, "\n".join(lines)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert same([tuple(r) for r in drop_similar_lines(docs).collect()], brute(rows))


def test_edges(spark):
    rows = [r[:2] for r in ROWS]
    assert same([tuple(r) for r in drop_similar_lines(table(spark)).collect()], brute(rows))
    assert drop_similar_lines(table(spark).limit(0)).count() == 0


def test_lines_that_only_share_rare_words_are_not_read_again(spark, monkeypatch):
    rows, common = [], [f"common{i}" for i in range(56)]
    for pair in range(30):
        rare = [f"rare{pair}x{i}" for i in range(12)]
        rows += [(2 * pair, " ".join(rare + common[:28])), (2 * pair + 1, " ".join(rare + common[28:]))]
    rows += [(100, rows[0][1] + " more")]
    stored = {}

    def counting(df, label="step"):
        step = cut(df, label)
        stored[label] = step.count()
        return step

    monkeypatch.setattr(line_dedup, "cut", counting)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert same([tuple(r) for r in drop_similar_lines(docs).collect()], brute(rows))
    assert stored["whole"] == 2
