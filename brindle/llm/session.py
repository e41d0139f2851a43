"""Session helpers: inputs and shared storage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_left: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_arrow(spark: SparkSession, limit: int = 4 << 20) -> None:
    """Arrow batches sent to Python stay about `limit` bytes however long the texts are.

    Spark reads this setting when a plan runs, so it stays set in the session."""
    spark.conf.set(_ARROW_BYTES, str(limit))


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; a temporary one only where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="brindle-")
        shared_dir.own = found
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def _clean() -> None:
    for spark, path in _left:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone
            return


atexit.register(_clean)


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write to the shared folder and read back: lineage is cut and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/brindle-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _left.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out
