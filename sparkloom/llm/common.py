"""What the operators of this subpackage share: the shared folder, tables written to cut lineage, and batches.

Executors may be lost at any time and share only the folder named by ``spark.checkpoint.dir``, so every
intermediate that is read twice is a Parquet table written there by Spark's own commit protocol.
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker turns into arrays at a time.
CHUNK_BYTES = 1 << 20


#: Workers live on from task to task: what they free goes back to the system instead of being kept for later.
WORKERS = {"MALLOC_MMAP_THRESHOLD_": str(1 << 22), "MALLOC_TRIM_THRESHOLD_": str(1 << 22), "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package when the driver was started from another folder, and keep little memory."""
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    environment.update({k: v for k, v in WORKERS.items() if k not in environment})
    known = environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only a local session without one gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="sparkloom-")
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def freed(spark: SparkSession) -> None:
    """Let Spark's cleaner find out which exchanges nothing needs any more, and free their disk."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame, name: str, bulky: bool = False, codec: str = "snappy") -> DataFrame:
    """``df`` as a table in the shared folder: computed once, lineage cut, columns still pruned when read.

    Spark frees the disk of exchanges when the driver's garbage is collected; after one about as large as the input
    (``bulky``) that isn't left to chance.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    if bulky:
        freed(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._loom_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._loom_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(work, schema)


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most about ``most`` bytes of ``column``, a longer text alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        array = batch.column(batch.schema.get_field_index(column))
        ends = pa.compute.cumulative_sum(pa.compute.fill_null(pa.compute.cast(pa.compute.binary_length(array), pa.int64()), 0)).to_numpy()
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            end = max(at + 1, int(ends.searchsorted(before + most, side="right")))
            yield batch.slice(at, end - at)
            at = end


def with_text(documents: DataFrame, *columns: str) -> DataFrame:
    """doc_id and text, null text as empty, and ``columns``; columns with clashing names stay behind."""
    return documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *columns)
