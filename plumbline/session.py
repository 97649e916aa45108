"""Session defaults for tests and local runs, and the durable folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def local_session(cores: str | int = "*", app_name: str = "plumbline") -> SparkSession:
    """A session for one machine.  On a cluster, use the session given there."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def durable_folder(spark: SparkSession, purpose: str) -> str:
    """A new sub-folder of the shared folder that survives executor loss.

    ``spark.checkpoint.dir`` names the shared folder; where it is unset, the
    context's checkpoint folder or else the warehouse is taken, which are shared
    as well.
    """
    root = (
        spark.conf.get("spark.checkpoint.dir", None)
        or spark.sparkContext.getCheckpointDir()
        or spark.conf.get("spark.sql.warehouse.dir")
    )
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
