"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every job here relies on. AQE splits hot join keys, also where the split costs
# one more exchange, and merges small shuffle partitions. Arrow batches are bounded by size, as one row may
# hold a long text. JSON objects may repeat a key; the last one counts.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 * 1024 * 1024),
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that already exists."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def size_shuffles(spark: SparkSession, input_bytes: int, partition_bytes: int = 128 * 1024 * 1024) -> int:
    """Raise the number of shuffle partitions so that one holds about ``partition_bytes`` of the input.

    AQE merges partitions that turn out small, but never adds any.
    """
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes // partition_bytes))
    spark.conf.set("spark.sql.shuffle.partitions", str(wanted))
    return wanted


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("rolescope")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("WARN")
    return configure(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder; on a cluster a machine-local
    folder would be lost with its machine.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        checkpoint_dir = spark.sparkContext.getCheckpointDir()
        if checkpoint_dir is not None:
            return checkpoint_dir
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        path = tempfile.mkdtemp(prefix="rolescope-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def new_work_dir(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder; nothing is created or removed here."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


_blocks: list[list[str]] = []


@contextmanager
def work_tables(spark: SparkSession) -> Iterator[None]:
    """Remove the work tables made inside when the block ends, also by an error. Results that read them must be written or
    collected inside."""
    made: list[str] = []
    _blocks.append(made)
    try:
        yield
    finally:
        _blocks.remove(made)
        for path in made:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a result to a work table and read it back.

    It is computed once and survives lost executors, later readers prune its columns, and the planner
    knows its true size: a small table is broadcast, a large one is not. Inside ``work_tables`` it is removed at the end.
    """
    path = new_work_dir(df.sparkSession, label)
    for made in _blocks[-1:]:
        made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
