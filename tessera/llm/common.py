"""Arrow and numpy helpers shared by the training-data operators.

Every Python stage in this subpackage works on Arrow record batches, cut into
slices of bounded text volume, so memory depends on the slice and on the longest
single text but never on the table.
"""

from __future__ import annotations

import ctypes
import pickle
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one slice holds at most (a longer single text is a slice of its own).
SLICE_BYTES = 1 << 20
#: Bytes of an Arrow batch between the JVM and Python.
BATCH_BYTES = 8 << 20

MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches by bytes, so that long texts do not add up to a huge batch."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


class Shared:
    """A value of a proven size that every task reads: broadcast with its code, so executors need no copy of this package."""

    def __init__(self, spark: SparkSession, value) -> None:
        self._held = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def __getstate__(self) -> dict:
        return {"_held": self._held}

    @property
    def value(self):
        if "_value" not in self.__dict__:
            self._value = pickle.loads(self._held.value)
        return self._value

    def destroy(self) -> None:
        self._held.destroy()


def give_back() -> None:
    """Return freed memory to the system: reused workers would hold every stage's peak."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def sliced(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows whose ``column`` holds at most ``limit`` bytes together."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < n:
            base = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
        give_back()


def map_slices(
    df: DataFrame,
    fn: Callable[[pa.RecordBatch], pa.RecordBatch],
    schema: str,
    column: str = "text",
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """``mapInArrow`` over bounded slices."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, column, limit):
            yield fn(part)

    return df.mapInArrow(run, schema)


def kept_schema(df: DataFrame, keep: tuple[str, ...]) -> str:
    """The part of a schema string for columns that pass through."""
    return "".join(f", `{c}` {df.schema[c].dataType.simpleString()}" for c in keep)


def filled(column: pa.Array) -> pa.Array:
    """Null texts as empty ones, in the 32-bit string layout."""
    return pc.fill_null(column.cast(pa.string()), "")


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array without nulls, and the offsets into them (from 0)."""
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def byte_table(separators: Iterable[int]) -> np.ndarray:
    """A byte map that lower-cases A-Z and turns separators into spaces."""
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    out[list(separators)] = 32
    return out


#: Words are runs without space and ASCII white space.
SPACED = byte_table([0x20, *range(0x09, 0x0E)])
#: Words are runs of ASCII letters, digits and everything beyond ASCII.
ALNUM = byte_table([b for b in range(128) if not chr(b).isalnum()])
#: Words are runs of ASCII letters and everything beyond ASCII.
ALPHA = byte_table([b for b in range(128) if not chr(b).isalpha()])


def split_words(texts: pa.Array, mapping: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of every text: their bytes without gaps, word offsets, and words per row.

    Words never reach from one row into the next.
    """
    data, offsets = raw(texts)
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(n, np.int64)
    mapped = mapping[data]
    inside = mapped != 32
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    begins[heads] = inside[heads]
    at = np.flatnonzero(begins)
    bounds = np.searchsorted(at, offsets)
    letters = mapped[inside]
    before = np.cumsum(inside, dtype=np.int64)
    word_offsets = np.append(before[at] - 1, len(letters)) if len(at) else np.zeros(1, np.int64)
    return letters, word_offsets, np.diff(bounds)


def word_array(letters: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The words as an Arrow binary array over the same bytes."""
    return pa.Array.from_buffers(
        pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(letters))]
    )


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    h = (h ^ (h >> np.uint64(30))) * MIX_A
    h = (h ^ (h >> np.uint64(27))) * MIX_B
    return h ^ (h >> np.uint64(31))


_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of an odd constant modulo 2**64."""
    global _POWERS
    if len(_POWERS) < n:
        size = max(64, 2 * n)
        _POWERS = np.append(np.uint64(1), np.cumprod(np.full(size, GOLDEN, np.uint64)))
    return _POWERS[:n]


def hash_words(letters: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    if len(offsets) < 2:
        return np.zeros(0, np.uint64)
    lengths = np.diff(offsets)
    place = np.arange(len(letters), dtype=np.int64) - np.repeat(offsets[:-1], lengths)
    terms = (letters.astype(np.uint64) + np.uint64(1)) * powers(int(lengths.max()))[place]
    return mixed(np.add.reduceat(terms, offsets[:-1]) + lengths.astype(np.uint64) * MIX_B)
