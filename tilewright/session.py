"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
# for planning: rows of few distinct words are many times their shuffled bytes in a task that sorts or groups them
SMALL_READS = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m"}
# call sites per column expression cost more time than small queries do
QUIET = "spark.python.sql.dataFrameDebugging.enabled"


def configure(spark: SparkSession, more: dict[str, str] | None = None) -> SparkSession:
    """Apply the run-time settings the operators rely on (all dates are UTC dates)."""
    for key, value in {**SETTINGS, QUIET: "false", **(more or {})}.items():
        if spark.conf.isModifiable(key):
            spark.conf.set(key, value)
    return spark


def local_session(cpus: int = 8, memory: str = "12g", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    builder = (SparkSession.builder.master(f"local[{cpus}]").appName("tilewright")
               .config("spark.driver.memory", memory)
               .config("spark.ui.enabled", "false")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions)))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.config(QUIET, "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's `spark.checkpoint.dir`; where that is unset, a local one in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tilewright-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_stage(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage through a Parquet table in the shared folder, so that a lost executor costs one stage."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
