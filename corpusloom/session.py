"""Session defaults and shared-folder tables."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []


def local_session(app: str = "corpusloom", cores: str = "8", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where that is unset and the session is local."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return path or f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"


def durable(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back.

    This cuts the lineage, survives lost executors, and computes df once for
    several readers. The files go when the driver's Python ends.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def durable_parts(parts: Iterator[DataFrame], spark: SparkSession, schema: str, name: str) -> DataFrame:
    """As durable, of several DataFrames of one schema, each computed when its turn comes."""
    path = shared_path(spark, name)
    spark.createDataFrame([], schema).write.parquet(path)
    for part in parts:
        part.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is there goes when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    return path


def sent(df: DataFrame, most: int = 200_000) -> DataFrame:
    """df, a table that durable() wrote, to be broadcast if it has at most so many rows; its rows must be short."""
    return F.broadcast(df) if df.count() <= most else df


def _clean() -> None:
    for spark, path in _made:
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session has ended before us
            return


#: Tables of long rows, whose work a task shares.
LONG = ("documents", "pages")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where it has fewer partitions than those, as a file of one row group has; else df itself."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in LONG else df
