"""Plumbing shared by the training-data operators: tables, scratch storage, Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_local_scratch: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one only where none is set and the master is local."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        path = tempfile.mkdtemp(prefix="onomast-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _local_scratch[app] = f"file://{path}"
    return _local_scratch[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/onomast/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """Within it, a finished SQL execution gives its shuffle files back; its frames aren't run again."""
    before = spark.conf.get(_CLEANUP, None)
    with contextlib.suppress(Exception):
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with contextlib.suppress(Exception):
            spark.conf.set(_CLEANUP, before if before is not None else "false")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write df into the shared folder and read it from there, so that a lost
    executor costs only the tasks that it ran."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*written: DataFrame) -> None:
    """Delete what materialize() wrote, once nothing that is still to run reads it."""
    for df in written:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def cut_batches(batches: Iterable[pa.RecordBatch], rows: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most `rows` rows, and of most_bytes unless a single row is longer."""
    for b in batches:
        size = np.zeros(b.num_rows, np.int64)
        for c in b.columns:
            if pa.types.is_string(c.type) or pa.types.is_binary(c.type):
                size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
        total = np.concatenate([[0], np.cumsum(size)])
        at = 0
        while at < b.num_rows:
            end = int(np.searchsorted(total, total[at] + most_bytes, side="right")) - 1
            end = min(max(end, at + 1), at + rows, b.num_rows)
            yield b.slice(at, end - at)
            at = end


def give_back() -> None:
    """Return what a finished task's batches took: the worker lives on, and so would its free memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


def bounded_batches(spark: SparkSession) -> None:
    """Batches to Python are bounded by bytes, not by rows alone, unless the session says how."""
    if spark.conf.get(_BATCH_BYTES, None) is None:
        with contextlib.suppress(Exception):  # versions that don't have it
            spark.conf.set(_BATCH_BYTES, str(2 << 20))


def in_batches(
    df: DataFrame,
    fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: str,
    rows: int = 1000,
    most_bytes: int = 1 << 20,
) -> DataFrame:
    """mapInArrow that hands fn small batches, however large Spark's are, so that memory is bounded by
    most_bytes or the longest row."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(cut_batches(batches, rows, most_bytes))
        give_back()

    return df.mapInArrow(run, schema)


def arrow_rows(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def bitmap(slots: DataFrame, size: int) -> np.ndarray:
    """The bits of the column `slot` (0 to size - 1): size / 8 bytes, whatever the rows."""
    # Spark's bitmaps start at bucket 1; value v > 0 has bucket (v - 1) / 32768 + 1 and bit (v - 1) % 32768.
    at = F.col("slot") + 1
    with shuffles_dropped(slots.sparkSession):
        rows = slots.groupBy(F.bitmap_bucket_number(at).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    table = np.zeros(-(-size // 32768) * 4096, np.uint8)
    for r in rows:
        start = (r["b"] - 1) * 4096
        table[start : start + 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return table


def slot_of(column: str, size: int):
    return F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(size))


def slots_of(ids: DataFrame, column: str, size: int) -> DataFrame:
    """The distinct slots of a column, at most `size` numbers, to be broadcast."""
    return F.broadcast(ids.select(slot_of(column, size).alias("__slot")).distinct())


def narrowed(rows: DataFrame, column: str, wanted: DataFrame, size: int = 1 << 21) -> DataFrame:
    """The rows whose column is among the wanted ones, and few others, without moving any row."""
    return rows.withColumn("__slot", slot_of(column, size)).join(slots_of(wanted, column, size), "__slot", "left_semi").drop("__slot")


def in_bitmap(table: np.ndarray, slot: int) -> bool:
    return bool(table[slot >> 3] >> (slot & 7) & 1)


def text_or_empty(col: str):
    return F.coalesce(F.col(col), F.lit(""))


def ratio_up(n: int, per: int, least: int = 1) -> int:
    """How many shards of about `per` rows n rows make."""
    return max(least, -(-n // per))
