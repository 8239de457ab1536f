"""Session construction and table access."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def build_session(name: str = "lodestone", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC time; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def ensure_worker_path(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package; on a cluster it is installed or shipped with the job."""
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if ROOT not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, known) if x)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables: spark.checkpoint.dir. Only a local master, as in tests, has a default."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "/tmp/lodestone-checkpoints"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")
