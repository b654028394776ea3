"""Session helpers: a local session for tests/bench and the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "hourwise") -> SparkSession:
    """A local session configured like the tests and the bench (UI off, AQE on)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    Taken from the session (``spark.checkpoint.dir``, which on a cluster names shared
    storage).  Only when the session has none (local tests) a private temporary folder
    is set, once.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and sc.master != "local" and not sc.master.startswith("local["):  # not local-cluster[...]
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="hourwise-ckpt-"))
    return sc.getCheckpointDir()


def cluster_conf(executors: int, cores_per_executor: int = 4) -> dict[str, str]:
    """Settings for a large run (e.g. 100 TB on ~1000 executors), to pass to the builder.

    * scan splits of 512 MB (Parquet row groups permitting);
    * initial shuffle partitions from the slots: aggregates here shuffle a row per group and task, so
      partitions need not follow the raw input, and map x reduce blocks stay few;
    * AQE coalescing, skew-join handling and local shuffle reads on.
    """
    partitions = 4 * executors * cores_per_executor
    return {
        "spark.sql.files.maxPartitionBytes": str(512 << 20),
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 << 20),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.localShuffleReader.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
