"""Session set-up shared by every entry point.

Only runtime SQL settings are touched on a session that already exists, so
the library can run inside a session the cluster has configured.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot case must be split even where that costs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

#: Pieces and size of what one task reads of an event table, where the session names none itself.
FINE_PARTITIONS, FINE_BYTES = 400, "16m"


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on (UTC, AQE, skew joins)."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Small session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tracemill")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder; on a cluster an
    unset folder is an error, because a machine-local path would be lost with
    its machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    named = tempfile.mkdtemp(prefix="tracemill-")
    spark.sparkContext.setCheckpointDir(named)
    return named


@contextmanager
def fine_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffles of the jobs run inside are cut into many pieces, which AQE joins up to a small size.

    So what one task reads follows that size and not the number of shuffle partitions of the session.
    A value the session has set itself stays.
    """
    pieces = max(FINE_PARTITIONS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    wanted = {
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(pieces),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": FINE_BYTES,
    }
    ours = [key for key in wanted if spark.conf.get(key, None) is None]
    for key in ours:
        spark.conf.set(key, wanted[key])
    try:
        yield
    finally:
        for key in ours:
            spark.conf.unset(key)


def settle(df: DataFrame, *folders: str) -> DataFrame:
    """Write an intermediate table once and read it back, in folders by the last columns if any are named.

    Used where a plan reads the same derived table several times. The written
    table survives executor loss, is columnar (pruning still works) and gives
    the planner a real size to choose joins by.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/tracemill/{uuid.uuid4().hex}"
    df.write.partitionBy(*folders).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
