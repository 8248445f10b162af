"""Session settings, shared scratch space and the two ways to cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

#: What every query relies on; a session the cluster made keeps its own values for the rest.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def local_session(app: str = "lodework", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and single-machine benches."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in REQUIRED.items():
        builder = builder.config(k, v)
    return (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset a local session gets a folder of its own;
    on a cluster it is an error, as every executor would write to its own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodework-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_STORED: list[str] = []


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone when the interpreter ends
        pass


def release(spark: SparkSession) -> None:
    """Deletes the tables that `stored` wrote: once the results of the queries built on them have been read or written."""
    while _STORED:
        _delete(spark, _STORED.pop())


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: a stage boundary that survives the loss of executors.

    Used where an expensive stage (Python, many scans) feeds several consumers. The files go with `release`, at the latest
    when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodework/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _STORED:
        atexit.register(release, spark)
    _STORED.append(path)
    return spark.read.parquet(path)


def kept(df: DataFrame) -> DataFrame:
    """df for reuse within one query; recomputed from its lineage when an executor is lost."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)
