"""Spark session helpers.

The library never creates a session implicitly inside an operator; callers
pass one in. ``build_session`` is for scripts, tests and the benchmark.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings that matter for correctness / parity with the SQL oracle.
CORE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Broadcast only on a measured size: no plan-time broadcast from estimated
    # sizes; AQE converts a join to broadcast when a side's shuffle output,
    # measured at run time, is under the bound, and keeps the sort-merge join
    # (with skew splitting) otherwise.
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    # remove RDD checkpoint files (e.g. tree node ids) once unreferenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # a generated method beyond this is not compiled by the JVM but interpreted: the views
    # project 30 columns at once, which is then several times slower than small methods
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None, app: str = "cohort_risk"):
    """Create (or reuse) a session with the settings the library relies on. A
    master and a number of shuffle partitions are set only when given."""
    builder = SparkSession.builder.appName(app)
    if master:  # without one, spark-submit or the environment decides
        builder = builder.master(master).config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
    for k, v in CORE_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if os.environ.get("BENCH_EVENT_LOG"):
        # stage / task metrics for offline inspection (no UI server)
        builder = builder.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", os.environ["BENCH_EVENT_LOG"])
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def cluster_conf(input_bytes: int, total_cores: int, partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Sizing for a cluster run over ``input_bytes`` of Parquet: splits of about
    ``partition_bytes``, and two to eight shuffle partitions per core: what is
    shuffled after partial aggregation does not follow the input's size, and
    the number of map x reduce blocks must stay small. AQE coalesces towards
    the advisory size and splits partitions five times the median. Apply with
    ``builder.config`` or ``spark.conf.set`` before the job."""
    parts = min(max(2 * total_cores, int(input_bytes // partition_bytes) + 1), 8 * total_cores)
    return {
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        # on a shared cluster coalesce towards the advisory size, not towards
        # the default parallelism
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(partition_bytes),
    }


def compiled_projections(spark: SparkSession) -> None:
    """The core setting for wide projections, in a session that the caller made and that
    says nothing about it."""
    key = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, CORE_CONF[key])


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    The folder named by ``spark.checkpoint.dir`` is used as is. Only when the
    session has none and runs in one process (local tests) a fresh private
    folder is created; executors elsewhere could not see it.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="cohort-risk-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():  # each call would add a folder
        spark.sparkContext.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"
