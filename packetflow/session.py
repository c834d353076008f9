"""Spark session settings the engine is meant to run with."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Settings that matter for flow metering at scale.  They are all runtime
#: settings, so they can also be put on a session somebody else created.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def get_session(cores: str | int = "*", app: str = "packetflow", **conf) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("PACKETFLOW_DRIVER_MEMORY", "8g"))
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply_runtime_conf(spark: SparkSession) -> SparkSession:
    """Put the runtime settings on an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names for intermediate tables.

    Only a local session, whose executors share this machine, gets a folder of its
    own when none is named.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return tempfile.gettempdir()


_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder name nobody else uses, inside the shared folder (or the scratch folder that is open)."""
    return f"{_scratch.get() or shared_dir(spark)}/packetflow-{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables made inside go to one folder, which is deleted at the end: write results before that."""
    folder = new_folder(spark, "scratch")
    token = _scratch.set(folder)
    try:
        yield folder
    finally:
        _scratch.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a result that is used several times to a table in the shared folder and read it back.

    The table outlives lost executors, and later reads prune its columns.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
