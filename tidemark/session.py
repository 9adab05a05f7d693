"""Session defaults shared by tests, the benchmark and scripts.

On a cluster the session comes from the deployment; only the settings that results depend on
are then applied, by :func:`apply_semantics`.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def local_session(app: str = "tidemark", cpus: str | int = "*", shuffle_partitions: int = 8,
                  **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = apply_semantics(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply_semantics(spark: SparkSession) -> SparkSession:
    """Timestamps without zone are formatted and compared as written, so the session is UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for reliable checkpoints: what the cluster names in ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of its own: on a cluster a machine-local folder
    would be lost with its executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
    sc.setCheckpointDir(configured)
    return configured
