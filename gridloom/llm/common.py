"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.components import checkpoint_dir, settle, store  # noqa: F401

#: Bytes of text that one slice of a batch holds at most, unless a single text is longer; arrays over it take some 100 times as much.
BLOCK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, parts: int) -> Column:
    """crc32 of the id's decimal text, modulo ``parts``; a null id falls in fold 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(parts), F.lit(0))


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


class Spread:
    """Rows ready to be joined by ``key`` with tables of few rows for each key, where one key may hold any share of them.

    A key is hot that holds over half of a task's mean rows, so there are at most twice as many hot keys as tasks. Its
    rows are dealt by a hash of the row over as many tasks as they would fill, and what is joined to it goes to each of
    these: twice as many copies as tasks in all, and one for each hot key. Rows without a key are dealt over all tasks.
    """

    def __init__(self, rows: DataFrame, key: str):
        self.key, tasks = key, partitions(rows.sparkSession)
        sizes = settle(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1"))
        share = max(1.0, rows.count() / (2 * tasks))
        self.hot = settle(sizes.where(F.col("_n") > share).select(F.col(key).alias("_hot"), F.ceil(F.col("_n") / share).cast("int").alias("_salts")))
        plain = [c for c, t in rows.dtypes if not t.startswith("map")]
        drawn = F.xxhash64(*(F.col(f"`{c}`") for c in plain))
        marked = rows.join(F.broadcast(self.hot), F.col(key) == F.col("_hot"), "left")
        salts = F.coalesce("_salts", F.when(F.col(key).isNull(), tasks).otherwise(1))
        self.rows = marked.withColumn("_salt", F.pmod(drawn, salts).cast("int")).drop("_hot", "_salts")

    def join(self, facts: DataFrame, how: str = "inner") -> DataFrame:
        copied = facts.join(F.broadcast(self.hot), F.col(self.key) == F.col("_hot"), "left")
        copied = copied.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_hot", "_salts")
        return self.rows.join(copied, [self.key, "_salt"], how).drop("_salt")


def spread_join(rows: DataFrame, facts: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``facts`` by ``key``, hot keys dealt over all tasks (see ``Spread``)."""
    return Spread(rows, key).join(facts, how)


#: Bits of a sieve (8 MB).
SIEVE_BITS = 1 << 26


def sieve(values: DataFrame, column: str):
    """A broadcast bitmap of fixed size in which the bit of every value of ``column`` (long) is set; see ``sifted``.

    Where it is full it lets more through, but it never holds a value of its own back.
    """
    bit = F.pmod(F.col(column), F.lit(SIEVE_BITS))
    words = values.select(bit.alias("_bit")).groupBy(F.floor(F.col("_bit") / 64).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(_bit % 64 AS INT))")).alias("bits")).toArrow()  # SIEVE_BITS / 64 rows at most
    held = np.zeros(SIEVE_BITS // 64, np.uint64)
    held[np.asarray(words["at"])] = np.asarray(words["bits"]).view(np.uint64)
    return values.sparkSession.sparkContext.broadcast(held)


def sifted(held: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether the sieve lets each of the 64-bit values through."""
    at = np.mod(values.view(np.int64), np.int64(SIEVE_BITS))
    return ((held[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)) == 1


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Data and offsets of a string or binary Arrow array; nulls count as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[ends[0] : ends[-1]] if len(ends) else whole, ends - ends[0] if len(ends) else np.zeros(1, np.int64)


def trim() -> None:
    """Gives this worker's free memory back to the system: Spark keeps idle workers for the stages to come."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def trimmed(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A function over batches that trims the worker when it has ended."""

    @functools.wraps(function)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        trim()

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """Scatters 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWER = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_POWER), -1, 1 << 64))
_cache: dict[str, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    have = _cache.get(str(base))
    if have is None or len(have) < n:
        have = np.empty(max(n, 1 << 16), np.uint64)
        have[0] = 1
        have[1:] = base
        have = _cache[str(base)] = np.multiply.accumulate(have)
    return have[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span data[start:end], by one rolling sum over ``data``."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_POWER, len(data)), out=sums[1:])
    back = _powers(_INVERSE, len(data) + 1)
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run values[start:end] of 64-bit values, by one rolling sum over all of them."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(_POWER, len(values)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _powers(_INVERSE, len(values) + 1)[starts] + (ends - starts).astype(np.uint64))


def is_space(data: np.ndarray) -> np.ndarray:
    """Bytes 0x20 and 0x09 to 0x0D."""
    return (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))


def word_spans(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``data``; a word ends at white space and at the text ends in ``breaks``."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~is_space(data)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = breaks[(breaks > 0) & (breaks < len(data))]
    first[edges] |= inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edges - 1] |= inside[edges - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def slices(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES):
    """Cuts a batch into runs of rows with about ``limit`` bytes of ``column``; a longer row stands alone."""
    values = batch.column(batch.schema.get_field_index(column))
    sizes = np.diff(as_bytes(values)[1])
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > limit:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += int(n)
    if begin < len(sizes):
        yield batch.slice(begin)
