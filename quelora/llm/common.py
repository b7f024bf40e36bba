"""What the training-data operators share: tables, the shared folder, text blocks and words."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one Python task holds at a time; a single longer row still goes through whole.
BLOCK_BYTES = 8 << 20
#: Rows of a batch on its way to Python while a table is written, at most; its buffers are off the heap.
BATCH_ROWS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not found:
        found = _own_dir(spark)
    return found.rstrip("/")


_OWN: dict[str, str] = {}


def _own_dir(spark: SparkSession) -> str:
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="quelora-")
    return _OWN[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def drop() -> None:
        with contextlib.suppress(Exception):  # the gateway may be closed already
            _delete(spark, path)

    atexit.register(drop)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """While it lasts, batches to Python hold BATCH_ROWS rows at most; then the session's own setting is back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if 0 < int(before) <= BATCH_ROWS:
        yield
        return
    spark.conf.set(key, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with small_batches(spark):
        df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables that materialize() wrote, once nothing reads them any more."""
    for t in tables:
        _delete(t.sparkSession, t.scratch_path)


@functools.cache
def _c_library():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library keeps what it has
        return None


def trim() -> None:
    """Hands back to the system what a Python worker has freed; workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if (library := _c_library()) is not None and hasattr(library, "malloc_trim"):
        library.malloc_trim(0)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow whose tasks end with trim()."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return df.mapInArrow(whole, schema)


#: Bits of the filter that spares rows of no use a shuffle; a full filter spares none and loses none.
FILTER_BITS = 1 << 23


def key_filter(keys: DataFrame, column: str) -> bytes:
    """A bit for each residue of the keys (longs); of fixed size, whatever the keys."""
    at = F.pmod(F.col(column), F.lit(FILTER_BITS)) + 1
    parts = keys.select(at.alias("k")).groupBy(F.bitmap_bucket_number("k").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("k")).alias("bits"))
    bits = np.zeros(FILTER_BITS, dtype=bool)
    for r in parts.collect():  # FILTER_BITS / 32,768 rows at most, parts counted from 1
        found = np.unpackbits(np.frombuffer(bytes(r.bits), np.uint8), bitorder="little")
        bits[(r.part - 1) * len(found) + np.flatnonzero(found)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def in_filter(bits: bytes, keys: np.ndarray) -> np.ndarray:
    """Whether the filter may hold each of the keys."""
    at = keys % FILTER_BITS
    return (np.frombuffer(bits, np.uint8)[at >> 3] >> (at & 7) & 1).astype(bool)


def identity(id_col: str, text_col: str) -> tuple[Column, Column]:
    """128 bits of a row's id and text, as two longs."""
    key, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    return F.xxhash64(key, text), F.xxhash64(text, F.lit(1), key)


def packed(docs: DataFrame, **columns: Column) -> DataFrame:
    """docs as one column ``row`` beside others, so that no name of theirs can clash with the columns of docs."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *(c.alias(n) for n, c in columns.items()))


def unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of packed()'s ``row``."""
    return rows.select(*(F.col("row").getField(c).alias(c) for c in columns))


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that each holds at most ``limit`` bytes of ``column``, or a single row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def merged(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Like blocks(), but also joins small neighbouring batches up to the limit."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in blocks(batches, column, limit):
        n = int(pa.compute.sum(pa.compute.binary_length(batch.column(column))).as_py() or 0)
        if held and size + n > limit:
            yield _one(held)
            held, size = [], 0
        held.append(batch)
        size += n
    if held:
        yield _one(held)


def _one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(held) == 1:
        return held[0]
    return pa.Table.from_batches(held).combine_chunks().to_batches()[0]


#: ASCII white space that separates words in most contracts: \x20 and \x09-\x0D, which bytes.split() uses as well.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def space_words(text: str | None, lower: bool = False) -> list[bytes]:
    """UTF-8 words between \\x20 and \\x09-\\x0D; with lower, A-Z are lower-cased first."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    return raw.translate(_LOWER).split() if lower else raw.split()


#: Keeps 0-9, a-z and all non-ASCII bytes; A-Z become a-z and the rest becomes a space.
_ALNUM = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def alnum_words(text: str | None) -> list[bytes]:
    """UTF-8 words of 0-9, a-z (A-Z lower-cased) and characters from U+0080 on."""
    return text.encode("utf-8", "surrogatepass").translate(_ALNUM).split() if text else []
