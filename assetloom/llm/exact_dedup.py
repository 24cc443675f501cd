"""Exact duplicate texts, combined in three steps so that no group of copies meets in one task.

1. Rows of one salt group and text are combined where they are read (Spark's
   partial aggregation), so a task sends each distinct text once.
2. The salt groups are combined: ``(digest, salt, text)``.
3. The salt winners are combined globally: ``(digest, text)``.

Every step groups by the full normalised text next to its digests, so two texts
are equal only if their characters are. A row then finds its group by SHA-256,
length and a second hash, spread over the salts that the group has rows in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Parts that a group of copies is spread over; they are kept as bits of one long.
SALTS = 63
KEY = ["text_sha256", "text_length", "text_hash"]


def normalised(text: F.Column) -> F.Column:
    """Every run of ASCII white space as one space; null as the empty text."""
    runs = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"  # a single space stays as it is
    return F.regexp_replace(F.coalesce(text, F.lit("")), runs, " ")


def _digests() -> list[F.Column]:
    """Never null, so that the joins on them need no filter that would compute them once more."""
    sha, length = F.coalesce(F.sha2("norm", 256), F.lit("")), F.coalesce(F.length("norm"), F.lit(0))
    return [sha.alias("text_sha256"), length.alias("text_length"), F.xxhash64("norm").alias("text_hash")]


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: its group of equal texts and whether it stays.

    Reads ``doc_id`` and ``text`` only, whatever other columns there are. Returns
    ``doc_id``, ``keep_id`` (smallest id of the group), ``group_size`` (rows),
    ``kept``, ``text_sha256``, ``text_length`` and ``text_hash``. Null text
    counts as empty. A null id counts as larger than any id. Of rows that repeat
    both id and text one stays. An empty table gives no rows.
    """
    salt = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"), F.lit(0))
    rows = docs.select("doc_id", normalised(F.col("text")).alias("norm")).select("doc_id", "norm", *_digests(), salt.alias("salt"))
    salted = rows.groupBy(*KEY, "salt", "norm").agg(F.min("doc_id").alias("m"), F.count("*").alias("n"))
    whole = salted.groupBy(*KEY, "norm").agg(
        F.min("m").alias("keep_id"), F.sum("n").alias("group_size"), F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts")
    )
    present = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda s: F.getbit("salts", s) == 1)
    spread = whole.select(*KEY, "keep_id", "group_size", F.explode(present).alias("salt"))
    repeats = Window.partitionBy("doc_id", *KEY).orderBy("doc_id")
    return (
        rows.drop("norm")
        .join(spread, [*KEY, "salt"])
        .select(
            "doc_id", "keep_id", "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.row_number().over(repeats) == 1)).alias("kept"), *KEY,
        )
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of every group of equal texts, all columns kept.

    The row with the smallest ``doc_id`` stays; rules for odd rows as in ``exact_groups``.
    """
    zero = F.lit(0).cast(docs.schema["doc_id"].dataType)
    known = [F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id"), zero).alias("id")]
    spot = ["no_id", "id", *KEY]
    whole = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", normalised(F.col("text")).alias("norm"))
    winners = exact_groups(docs).where("kept").select(*known, *KEY)
    # The window has the join's own partitions, so whole rows are shuffled once.
    repeats = Window.partitionBy(*spot).orderBy("id")
    kept = whole.select("row", *known, *_digests()).join(winners, spot, "left_semi").withColumn("place", F.row_number().over(repeats))
    return kept.where("place = 1").select("row.*")
