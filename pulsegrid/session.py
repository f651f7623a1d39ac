"""Spark session settings and the shared scratch location.

The engine never writes to a machine-local folder on its own: intermediate
tables go below ``spark.checkpoint.dir``, which a cluster points at shared
storage. Only on a local master without the setting (unit tests, a laptop) is a
temporary folder chosen and recorded in the session; elsewhere that is an error.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on: UTC calendar columns (date/hour are UTC in the
# source system), AQE for runtime coalescing / skew splitting / join re-plan.
ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # JSON writers drop null fields, so an absent vital stays an absent key.
    "spark.sql.jsonGenerator.ignoreNullFields": "true",
}


def build_session(master: str | None = None, app: str = "pulsegrid",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the engine settings applied."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(ENGINE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    apply_engine_conf(spark)
    return spark


def apply_engine_conf(spark: SparkSession) -> None:
    """Apply the runtime-settable engine settings to an existing session."""
    for k, v in ENGINE_CONF.items():
        try:
            spark.conf.set(k, v)
        except Exception:  # static conf on a running session: leave as is
            pass


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``.

    Read from the session; set our own only when unset (tests, local runs).
    Works on a classic session and on a Connect session (no SparkContext).
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: configuration only
        sc = None
    d = sc.getCheckpointDir() if sc is not None else None
    if not d:
        d = spark.conf.get("spark.checkpoint.dir", None)
        if not d and sc is not None:
            d = sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        master = sc.master if sc is not None else spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="pulsegrid-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
        d = sc.getCheckpointDir() or d
    return d.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique location below the shared checkpoint folder."""
    base = checkpoint_dir(spark)
    if base.startswith("file:"):
        base = base[len("file:"):]
    path = f"{base}/pulsegrid/{name}-{uuid.uuid4().hex[:12]}"
    if "://" not in path:
        os.makedirs(os.path.dirname(path), exist_ok=True)
    return path


def scale_conf(input_bytes: int, total_cores: int,
               target_partition_bytes: int = 256 * 1024 ** 2) -> dict:
    """Settings sized for a cluster run over ``input_bytes`` of input.

    Shuffle partitions start at roughly one per target size of input (at
    least two waves of the cluster's cores); AQE then coalesces them to the
    advisory size and splits skewed ones. Scan splits use the same target so
    a task's input fits comfortably in executor memory.
    """
    parts = max(2 * total_cores, -(-input_bytes // target_partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes":
            str(4 * target_partition_bytes),
        "spark.sql.adaptive.rebalancePartitionsSmallPartitionFactor": "0.2",
    }
