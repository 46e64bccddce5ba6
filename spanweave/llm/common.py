"""What the operators of this subpackage share: tables, durable intermediate results, Arrow limits."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import ship

#: Word separators of every word rule here: ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
NON_SPACE = r"[^\x20\x09-\x0D]"

_made: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one only where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    found = "file://" + tempfile.mkdtemp(prefix="spanweave-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cut lineage that survives lost executors.

    Unlike ``checkpoint()`` the copy is columnar, so later reads prune columns and the optimizer knows its size.
    The files go when the driver process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append((spark, path))
    return spark.read.parquet(path)


def renamed(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns named _own_0 and so on, and the new name of each: what an operator adds can't clash with them."""
    own = {c: f"_own_{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*own.values()), own


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """A written table, to be broadcast where it has ``rows`` rows at most; a larger one is joined by a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def drop_written() -> None:
    """Delete what :func:`written` made in this process; results that were not yet computed lose their input."""
    while _made:
        spark, path = _made.pop()
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session is gone already
            return


atexit.register(drop_written)


def small_batches(spark: SparkSession, rows: int = 512, megabytes: int = 8) -> None:
    """Bound what an Arrow batch holds, so that long texts don't fill a Python worker; and see that workers have this code.

    Spark reads the bounds when a plan runs, so all operators use the same ones.
    """
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))
