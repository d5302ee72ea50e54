"""Session helpers.

Library functions never change session settings; only ``build_session`` (used by
tests, the bench and the entry smoke check) does.  ``shared_dir`` resolves the
cluster's shared checkpoint folder from ``spark.checkpoint.dir`` and only falls
back to a fresh scratch folder when the session has none (local tests).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "taskweave") -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus)
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession, *parts: str) -> str:
    """Folder under the cluster's shared checkpoint location.

    Reads ``spark.checkpoint.dir`` (or the context's checkpoint dir).  Only when
    neither is set and the master is local -- tests -- a fresh scratch folder is created and
    registered as the checkpoint dir so later calls agree; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not base:
        base = tempfile.mkdtemp(prefix="taskweave-ckpt-")
        try:
            spark.conf.set("spark.checkpoint.dir", base)
        except Exception:  # noqa: BLE001  (some sessions refuse core settings at runtime)
            pass
        spark.sparkContext.setCheckpointDir(base)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    if not parts:
        return base
    return "/".join([base.rstrip("/"), *parts])


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new, unique sub-folder of the shared folder for one job's files."""
    return shared_dir(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(table_path(sf_dir, name))
