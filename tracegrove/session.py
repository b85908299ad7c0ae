"""Session settings and the folder shared by all executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job here relies on. Only runtime-settable keys, so they also apply to a
# session somebody else created.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split hot join partitions even when an aggregate on the same key follows.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Keep only the top n of a group per map task before ranking, also for large n.
    "spark.sql.optimizer.windowGroupLimitThreshold": "1000000",
    # Folders listed by one task each cost more than the listing; many to a task.
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "64",
    "spark.sql.session.timeZone": "UTC",
    # The JVM never compiles longer methods; several times slower than expressions one by one.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to ``spark`` and return it."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Local session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(master)
        .appName("tracegrove")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        # Recording the call site of every Column costs more than building the plan.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder for intermediate tables under the one named in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own, as in tests.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="shared-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
