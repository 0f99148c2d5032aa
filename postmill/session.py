"""Session settings the library is written for."""

from __future__ import annotations

import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, app: str = "postmill", **conf: str) -> SparkSession:
    """A session with UTC timestamps and adaptive execution; ``conf`` uses '__' for '.'."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share; where it is unset, one in the warehouse."""
    key = "spark.checkpoint.dir"
    folder = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)
    return (folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared").rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage and survives lost executors.

    With ``release`` the shuffle files of making it go with the end of the write, else when the driver collects its garbage.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    before = spark.conf.get(RELEASE, None)
    if release:
        spark.conf.set(RELEASE, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if release and before is None:
            spark.conf.unset(RELEASE)
        elif release:
            spark.conf.set(RELEASE, before)
    return spark.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so lost executors cost no recomputation."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows of a scan over all cores, where its files make fewer tasks than there are cores; a larger scan stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def ship(module: str) -> None:
    """Send functions of ``module`` to the executors by value, so workers need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
