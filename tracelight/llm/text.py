"""Words, hashes and batches that several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelight.session import cut_lineage

#: Stands for a null id inside the operators; it sorts before every id that is given.
NO_ID = -(2**63)
#: Texts handled together inside a task, in bytes; a longer text is handled alone.
SLICE_BYTES = 1 << 20

# The bytes that are no part of a word.
SPACE = np.ones(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_RANDOM = np.random.default_rng(20240229)
MIX = _RANDOM.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE, STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
INVERSE = {b: pow(b, -1, 2**64) for b in (BASE, STEP)}


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def keyed_texts(docs: DataFrame, *others: str) -> DataFrame:
    """``doc_id`` (null as ``NO_ID``), ``text`` (null as empty) and the named columns; the rest is left out."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *others
    )


#: Keys of rows whose id is null, repeated or not above this lie below it.
LOWEST_ID = -(2**62)
#: Repeated ids that may be sent to every task; more are joined by a shuffle.
SENT_IDS = 200_000


def separated(docs: DataFrame, *others: Column | str) -> tuple[DataFrame, bool]:
    """(``doc_id``, ``text``, ``given_id`` and ``others``) with a key for each document, and whether all keys are the given ids.

    A row keeps its id as key if no other row has it. Rows with a null or repeated id are
    told apart by their text: the key is a hash of both, below all others. So only rows
    with the same id and the same text are one document.
    """
    given, text = F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))
    seen = docs.select(given.alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("rows"))
    again = cut_lineage(seen.filter((F.col("rows") > 1) | F.col("id").isNull() | (F.col("id") <= LOWEST_ID)).select("id"))
    count = again.count()
    rows = docs.select(given.alias("given_id"), text.alias("text"), *others)
    if not count:
        return rows.select(F.col("given_id").alias("doc_id"), *rows.columns), True
    repeated = again.filter("id is not null").select(F.col("id").alias("again"))
    rows = rows.join(F.broadcast(repeated) if count <= SENT_IDS else repeated, F.col("given_id") == F.col("again"), "left")
    alone = F.col("given_id").isNotNull() & F.col("again").isNull()
    own = F.lit(LOWEST_ID) - F.shiftrightunsigned(F.xxhash64("given_id", "text"), 2)
    return rows.withColumn("doc_id", F.when(alone, F.col("given_id")).otherwise(own)).drop("again"), False


def given_id(name: str = "doc_id") -> Column:
    """The id as it was given, null again where ``NO_ID`` stands."""
    return F.when(F.col(name) != NO_ID, F.col(name)).alias(name)


def tuned(spark: SparkSession) -> SparkSession:
    """Size of an Arrow batch in bytes: whole documents are large, so few of them go together."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    return spark


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0, base**1 ... modulo 2**64, at least ``n`` of them."""
    if base not in _POWERS or len(_POWERS[base]) < n:
        row = np.full(max(n, SLICE_BYTES // 8), np.uint64(base))
        row[0] = 1
        _POWERS[base] = np.cumprod(row)
    return _POWERS[base]


def range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[start:end] for every pair, whatever its place, from one running sum."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values))[: len(values)], out=total[1:])
    return mixed((total[ends] - total[starts]) * powers(INVERSE[base], len(values) + 1)[starts])


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of texts of about ``size`` bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        last = min(last, len(texts))
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every run of ``kept`` bytes inside a text."""
    inside = kept[data]
    starts, stops = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    starts[edges[edges < len(data)]] = inside[edges[edges < len(data)]]
    stops[edges[edges > 0] - 1] = inside[edges[edges > 0] - 1]
    begin = np.flatnonzero(starts)
    return begin, np.flatnonzero(stops) + 1, np.searchsorted(offsets, begin, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return range_hash(MIX[data], starts, ends, BASE)


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` neighbours of ``hashes``."""
    size = len(hashes) - n + 1
    total = np.zeros(max(0, size), np.uint64)
    if size > 0:
        for k in range(n):
            total += hashes[k : k + size] * powers(STEP, n)[k]
    return mixed(total)


def worker_state() -> dict:
    """What a Python worker keeps between its tasks (functions arrive by value, so their globals do not stay)."""
    import sys

    if not hasattr(sys, "_corpus_worker_state"):
        sys._corpus_worker_state = {}
    return sys._corpus_worker_state


def forget(but: str | None = None) -> None:
    """Give back what other operators' tasks have kept in this worker, such as the ids of words (all but what stands under ``but``)."""
    import ctypes
    import gc

    state = worker_state()
    others = [name for name in state if name != but]
    for name in others:
        del state[name]
    if others:
        gc.collect()
    # Workers wait while other stages run, so what is free goes back to the system.
    pa.default_memory_pool().release_unused()
    if hasattr(library := ctypes.CDLL(None), "malloc_trim"):
        library.malloc_trim(0)


def lean(run: Callable, keep: str | None = None) -> Callable:
    """``run`` (batches to batches) in a worker that holds before and after it no more than what is kept under ``keep``."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(keep)
        yield from run(batches)
        forget(keep)

    return whole
