"""Session defaults and the shared scratch area."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
_FOLDERS: list[str] = []


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    session = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("thresher")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@functools.cache
def _local_root() -> tempfile.TemporaryDirectory:
    """Removed when the process ends."""
    return tempfile.TemporaryDirectory(prefix="thresher-", ignore_cleanup_errors=True)


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below the cluster's shared checkpoint folder.

    A machine-local folder is used only on a local master without that setting;
    on a cluster the setting is required, because other executors must be able
    to read the tables written here.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder all executors share")
        root = _local_root().name
    folder = f"{root.rstrip('/')}/thresher-{uuid.uuid4().hex}"
    _FOLDERS.append(folder)
    return folder


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete one scratch table that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def clear_scratch(spark: SparkSession) -> None:
    """Close a run: delete all scratch folders of this driver.

    Results that were not written elsewhere read those folders and are lost with them.
    """
    while _FOLDERS:
        drop_table(spark, _FOLDERS.pop())


def materialize(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as a shared parquet table and read it back.

    The table survives the loss of executors, and the next stage reads only the
    columns it needs.
    """
    spark = df.sparkSession
    path = f"{folder or scratch_dir(spark)}/{name}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, columns: list, limit: int) -> bool:
    """True when the measured text of ``columns`` stays below ``limit`` bytes.

    The check behind every broadcast of a table that can grow.
    """
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in columns), F.lit(64))
    return (df.agg(F.sum(size)).first()[0] or 0) <= limit


def spread(df: DataFrame, at_most: int | None = None) -> DataFrame:
    """Use all cores for an input of few splits (a small file has one row group).

    A large input has more splits than the cluster has cores and stays as it is.
    For scans only: asking any other plan for its partitions would run it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    cores = min(cores, at_most or cores)
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
