"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cairn.deploy import ship

#: White space as `[\x20\x09-\x0D]`, which is also what bytes.split() splits on.
ASCII_SPACE = " \t\n\x0b\x0c\r"


#: Bytes of an Arrow batch at most, or one longer row: a task holds a batch on the JVM's side, while its buffers double, and in the worker.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's limit on Arrow batches to BATCH_BYTES; a lower one stays. Plans read it when they run, so it isn't put back."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, fn: Callable[[Iterator[dict]], Iterator[dict]], schema: T.StructType | str) -> DataFrame:
    """mapInArrow with columns as Python lists or numpy arrays: fn gets an iterator of {name: pa.Array} and yields {name: values}.

    Batches end at BATCH_BYTES, so long texts don't pile up in a worker.
    """
    spark_schema = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    arrow = to_arrow_schema(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ({name: b.column(i) for i, name in enumerate(b.schema.names)} for b in batches)
        for out in fn(columns):
            arrays = [out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], type=f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)
        give_back()

    ship(df.sparkSession)
    bound_batches(df.sparkSession)
    return df.mapInArrow(run, spark_schema)


def with_row(df: DataFrame, passed: list[str] | None, **columns: str) -> DataFrame:
    """df's named columns under the names given; and those to be passed on, if any, in one struct `__row`, whatever their names."""
    own = [F.col(f"`{c}`").alias(name) for name, c in columns.items()]
    return df.select(*own, F.struct(*(F.col(f"`{c}`") for c in passed)).alias("__row")) if passed else df.select(*own)


def row_type(df: DataFrame, passed: list[str] | None) -> str:
    """The schema of `__row`, with a comma behind it; nothing if no columns are passed."""
    return f"__row {df.select(*(F.col(f'`{c}`') for c in passed)).schema.simpleString()}, " if passed else ""


def row_of(batch: dict) -> dict:
    return {"__row": batch["__row"]} if "__row" in batch else {}


def utf8(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.binary()).to_pylist()


def cut(column: pa.Array, most: int) -> Iterator[list[bytes]]:
    """The UTF-8 bytes of a string column, null as empty, in runs of about `most` bytes at most; a longer text is alone.

    Only one run at a time is turned into Python objects, so a large batch of long texts takes no more than a small one.
    """
    raw = column.cast(pa.binary())
    size = pc.fill_null(pc.binary_length(raw), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    low = 0
    while low < len(raw):
        high = max(low + 1, int(np.searchsorted(ends, ends[low] - size[low] + most, "right")))
        yield [x or b"" for x in raw.slice(low, high - low).to_pylist()]
        low = high


def each(column: pa.Array) -> Iterator[bytes | None]:
    """The UTF-8 bytes of a string column, one by one."""
    for x in column.cast(pa.binary()):
        yield x.as_py()


_CACHE: dict = {}


def worker_cache(key: tuple, make: Callable):
    """What a Python worker keeps from task to task: tables that only save work, never results. An operator's table replaces another's."""
    if key not in _CACHE:
        _CACHE.clear()
        give_back()
        _CACHE[key] = make()
    return _CACHE[key]


def give_back() -> None:
    """Hand freed memory back to the system: workers live on between tasks, and several share an executor's memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


#: Bits of the fixed-size filter that membership() makes: 2 MB, whatever the input, in bitmaps of ROW bits.
FILTER_BITS, ROW = 24, 1 << 15


def _place(key: Column) -> Column:
    return key.bitwiseAND(F.lit((1 << FILTER_BITS) - 1).cast("long"))


def membership(keys: DataFrame, key: str) -> DataFrame:
    """One row with an array of bitmaps, 2^FILTER_BITS bits together, in which those of the keys (hashes) are set.

    Few keys leave most bits clear, so rows without a partner can skip a shuffle; with very many all pass, and nothing is lost.
    """
    place = _place(F.col(key))
    row = F.shiftright(place, 15).cast("int").alias("row")
    rows = keys.where(F.col(key).isNotNull()).groupBy(row).agg(F.bitmap_construct_agg(F.pmod(place, F.lit(ROW))).alias("bits"))
    cells = F.array(F.map_from_entries(F.collect_list(F.struct("row", "bits"))))  # 2^FILTER_BITS / ROW of them at most
    laid = F.transform(cells, lambda m: F.transform(F.sequence(F.lit(0), F.lit((1 << FILTER_BITS) // ROW - 1)), lambda i: F.try_element_at(m, i)))
    return materialise(rows.agg(laid[0].alias("bits")))


def may_hold(key: Column, bits: DataFrame) -> Column:
    """Whether a key may be among those of membership(); never false for one that is. A scalar subquery, so no row carries the bits."""
    place = _place(key)
    row = F.get(bits.scalar(), F.shiftright(place, 15).cast("int"))
    byte = F.substring(row, F.shiftright(F.pmod(place, F.lit(ROW)), 3).cast("int") + 1, F.lit(1))
    return F.coalesce(F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), F.pmod(place, F.lit(8)).cast("int")) == 1, F.lit(False))


def shared_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share: the checkpoint folder.

    spark.checkpoint.dir is read from the session. Where neither it nor a checkpoint folder is set, a temporary folder is used in
    local mode, as in tests; on a cluster that would be a folder of one machine, so RuntimeError is raised.
    """
    from cairn.operators.common import checkpoint_dir

    return checkpoint_dir(spark)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder, which survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of steps that are done and dropped, rather than at the driver's next full collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
