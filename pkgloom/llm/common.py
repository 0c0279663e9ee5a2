"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """``df`` itself. Long texts make default Arrow batches large, so the session's Python workers get theirs in smaller ones."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of our own only where the session names none."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = tempfile.mkdtemp(prefix="pkgloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def cut(df: DataFrame, name: str, **options: object) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The plan above it then starts from replicated files, so a lost executor
    costs a reread and never a recomputation of the whole lineage. ``options``
    are those of the writer.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pkgloom-{name}-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(key: Column) -> Column:
    """crc32(key as text) mod 5; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5


def string_type(arr: pa.Array) -> pa.Array:
    """A plain int32-offset string array without nulls (null becomes empty)."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    return arr.cast(pa.string()).fill_null("")


def text_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the len+1 offsets into them, without a copy."""
    arr = string_type(arr)
    _, offs, data = arr.buffers()
    n = len(arr)
    offsets = np.frombuffer(offs, np.int32)[arr.offset : arr.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def lean() -> None:
    """Let a reused Python worker give freed memory back: large arrays are mapped on their own, the rest is trimmed."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD, which would otherwise grow
        libc.malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def slices(batches, column: str, limit: int = 4 << 20):
    """Split record batches by rows, so that each piece holds about ``limit`` text bytes (one row at least)."""
    lean()
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        total, begin = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if total and total + size > limit:
                yield batch.slice(begin, i - begin)
                total, begin = 0, i
            total += size
        yield batch.slice(begin)
    lean()


def field_ddl(df: DataFrame, *names: str) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


CLEAN = np.full(256, 32, np.uint8)
CLEAN[48:58] = np.arange(48, 58)
CLEAN[97:123] = np.arange(97, 123)
CLEAN[65:91] = np.arange(97, 123)
CLEAN[128:] = np.arange(128, 256)


def words_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-case words (letters, digits, non-ASCII) of all texts and the index of each word's text."""
    buf, offs = text_bytes(pc.utf8_lower(column))
    clean = pa.StringArray.from_buffers(len(offs) - 1, pa.py_buffer((offs - offs[0]).astype(np.int32)), pa.py_buffer(CLEAN[buf[offs[0] : offs[-1]]]))
    parts = pc.split_pattern(clean, " ")
    words, owner = parts.flatten(), pc.list_parent_indices(parts)
    real = pc.not_equal(words, "")
    return words.filter(real), owner.filter(real).to_numpy()


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of every word, the same in every process."""
    buf, offs = text_bytes(words)
    size = np.diff(offs)
    if not len(size):
        return np.zeros(0, np.uint64)
    powers = np.cumprod(np.full(int(size.max()) + 1, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
    place = np.arange(offs[-1] - offs[0]) - np.repeat(offs[:-1] - offs[0], size)
    terms = (buf[offs[0] : offs[-1]].astype(np.uint64) + np.uint64(1)) * powers[place]
    total = np.zeros(len(size), np.uint64)
    real = size > 0
    total[real] = np.add.reduceat(terms, (offs[:-1] - offs[0])[real]) if real.any() else 0
    return mixed(total + size.astype(np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every input bit over the whole word."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))
