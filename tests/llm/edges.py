"""Small tables with the odd cases every corpus operator must take."""

from pyspark.sql import types as T

LONG = "word " * 30_000 + "end"
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank.", "en", 7),
    (2, "the quick  brown fox jumps over the lazy dog near the river bank.", "en", 7),
    (2, "the quick  brown fox jumps over the lazy dog near the river bank.", "en", 7),
    (3, None, None, None),
    (4, "", "en", 0),
    (None, "A text without an id.\nAnd a second line here.", "en", 1),
    (None, None, None, None),
    (5, LONG, "en", 1),
    (6, "\t \n", "de", 1),
    (7, "Été déjà vu, naïve façade — 日本語 🙂 <|endoftext|> it's fine", "fr", 1),
    (8, "A text without an id.\nAnd a second line here.", "en", 1),
    (9, "1234 !!! ---", "en", 1),
]
#: ``doc_id, text, lang`` and columns whose names an operator might use itself.
CLASHES = ["salt", "n", "key", "score", "piece", "set_id", "kept", "label", "row", "norm"]


def table(spark, rows=ROWS):
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())]
    schema = T.StructType(fields + [T.StructField(c, T.LongType()) for c in CLASHES])
    return spark.createDataFrame([r[:3] + (r[3],) * len(CLASHES) for r in rows], schema)


def texts(rows=ROWS):
    return [(r[0], r[1] or "") for r in rows]


def same(a, b):
    """Whether two lists of tuples hold the same rows in any order."""
    order = lambda rows: sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x) for x in r))
    return order(a) == order(b)
