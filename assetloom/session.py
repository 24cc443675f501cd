"""Session settings and the lineage cut shared by the iterative operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

_fallback_dirs: dict[str, str] = {}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the SQL settings every plan relies on (all are run-time settings)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session that
    leaves it unset, as in tests, gets a folder of its own until the process ends; a
    cluster session must set it, because executors cannot share a machine-local folder.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _fallback_dirs:
        _fallback_dirs[app] = tempfile.mkdtemp(prefix="assetloom-")
        atexit.register(shutil.rmtree, _fallback_dirs[app], ignore_errors=True)
    return _fallback_dirs[app]


def cut(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` once to the shared folder and return a frame that reads it back.

    The copy survives the loss of an executor, ends the lineage, and (unlike
    ``checkpoint()``) computes the input only once.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    copy = spark.read.schema(df.schema).parquet(path)
    copy._step_path = path
    return copy


def discard(step: DataFrame) -> None:
    """Delete the table behind a frame that ``cut`` returned, once no later plan reads it."""
    session = step.sparkSession
    path = session._jvm.org.apache.hadoop.fs.Path(step._step_path)
    path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)
