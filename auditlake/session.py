"""Session helpers: settings for tests and benches, tables, checkpoints, input spreading."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own settings."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("auditlake")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: the one that ``spark.checkpoint.dir`` names; a temporary one only in a local session that has none."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = sc.getConf().get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "auditlake-checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` into the shared folder; Spark removes it with the frame where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: smaller than a checkpoint, and read by column; removed when the session's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, for CPU-heavy steps.

    The files of its tables tell how many splits a scan has, so nothing is planned or run: a large table has enough and is left alone,
    one in few files is redistributed.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    most, opening = (_bytes(spark.conf.get(f"spark.sql.files.{k}")) for k in ("maxPartitionBytes", "openCostInBytes"))
    total = _input_bytes(df) + len(df.inputFiles()) * opening
    splits = total / min(most, max(opening, total / cores))
    return df if splits > cores - 0.5 else df.repartition(cores)


def _bytes(text: str) -> int:
    m = re.fullmatch(r"(\d+)\s*([kmgt]?)b?", text.strip().lower())
    return int(m.group(1)) * 1024 ** " kmgt".index(m.group(2) or " ")


def _input_bytes(df: DataFrame) -> int:
    """The size of the plan's leaves, by the optimizer's statistics of its files."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves().iterator()
    total = 0
    while leaves.hasNext():
        total += int(str(leaves.next().stats().sizeInBytes()))
    return total


def empty(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    """No rows of ``schema``."""
    return spark.createDataFrame([], schema)
