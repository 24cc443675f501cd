"""A stored table that grows by new rows without being shuffled.

The table is bucketed by a digest of its rows, which is a column of it. New rows are made
distinct and dealt to the same buckets, so the stored side is read where it lies. Most new
rows are told apart by the digests alone, one number a row; whole rows are compared only where a digest is
already there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


DIGEST = "_row_digest"
BUCKETS = 64


def _digested(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with the digest of its rows; a null is told from every value by its place."""
    places = [F.when(F.col(f"`{c}`").isNull(), F.lit(k)).otherwise(F.lit(-1)) for k, c in enumerate(columns)]
    return df.select(*[F.col(f"`{c}`") for c in columns], F.xxhash64(*[F.col(f"`{c}`") for c in columns], *places).alias(DIGEST))


def _same_row(one: DataFrame, other: DataFrame, columns: list[str]) -> Column:
    equal = [one[f"`{c}`"].eqNullSafe(other[f"`{c}`"]) for c in columns]
    # The digest alone is the join's key, as it is the buckets'; the columns are one condition on it.
    return (one[DIGEST] == other[DIGEST]) & F.forall(F.array(*equal), lambda same: same)


def create_stored(df: DataFrame, name: str, path: str, buckets: int = BUCKETS) -> DataFrame:
    """Write the distinct rows of ``df`` as the stored table ``name`` at ``path``."""
    rows = _digested(df, df.columns).dropDuplicates([DIGEST, *df.columns])
    rows.repartition(buckets, DIGEST).write.mode("overwrite").bucketBy(buckets, DIGEST).option("path", path).format("parquet").saveAsTable(name)
    return read_stored(df.sparkSession, name)


def read_stored(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name).drop(DIGEST)


def unseen_rows(new: DataFrame, stored: DataFrame) -> DataFrame:
    """The distinct rows of ``new`` that the stored table does not hold, with their digest. Columns are matched by name; ``new`` may lack some (null), not add any."""
    columns = [c for c in stored.columns if c != DIGEST]
    unknown = sorted(set(new.columns) - set(columns))
    if unknown:
        raise ValueError(f"the stored table has no columns {unknown}")
    kinds = {f.name: f.dataType for f in stored.schema.fields}
    named = new.select(*[(F.col(f"`{c}`") if c in new.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in columns])
    rows = _digested(named, columns).dropDuplicates([DIGEST, *columns])
    digests = stored.select(DIGEST)
    fresh = rows.join(digests, DIGEST, "left_anti")
    again = rows.join(digests, DIGEST, "left_semi")
    return fresh.unionByName(again.join(stored, _same_row(again, stored, columns), "left_anti"))


def append_stored(new: DataFrame, name: str) -> DataFrame:
    """Append the rows of ``new`` that the stored table ``name`` lacks, and return the whole table.

    The result equals the union of both without fully equal rows.
    """
    spark = new.sparkSession
    stored = spark.table(name)
    buckets = int(spark.sql(f"DESCRIBE EXTENDED {name}").where("col_name = 'Num Buckets'").first().data_type)
    rows = unseen_rows(new, stored)
    rows.repartition(buckets, DIGEST).write.mode("append").bucketBy(buckets, DIGEST).format("parquet").saveAsTable(name)
    spark.catalog.refreshTable(name)
    return read_stored(spark, name)
