"""Best-fit packing by a grouping genetic algorithm on islands.

Texts become token pieces; full pieces are sequences by themselves, the others are
the items to pack. Items are dealt at random into blocks of about ``BLOCK`` items,
each block a packing problem of its own. On every block ``islands`` populations
evolve in different tasks. A chromosome is a grouping: the list of its bins.
Crossover takes whole well-filled bins of one parent into the other, removes the
bins that now hold an item twice, and best-fits the displaced items again. After
each epoch the elite of every island moves to the next island of its block.

The best grouping of a block keeps its full bins; the items of its other bins meet
those of other blocks in the next round, in fewer blocks, until one block is left
or a round brings nothing. The items of a bin sum to at most the capacity.

Null text is empty (the end id alone). Rows that repeat an id are pieces of their
own; rows are told apart by their place in the table of pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.llm import text as T
from tracelight.llm import tokens
from tracelight.session import cut_lineage

BLOCK = 4096
ISLANDS = 2
EPOCHS = 2
#: Groupings on an island and generations in an epoch.
POPULATION, GENERATIONS = 8, 30
#: Items that best fit takes in order of size at once, and the error of that order.
TOGETHER, ERROR = 64, 0.1
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str | None = None, end: int = 2, capacity: int = 1024) -> DataFrame:
    """Token pieces of whole texts; of a text longer than ``capacity`` only the first piece may be shorter."""
    path = path or tokens.default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for first, flat, offsets in tokens.encoded(path, batch.column(1), end):
                size = np.diff(offsets)
                n = -(-size // capacity)
                row = np.repeat(np.arange(len(size)), n)
                piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                head = (size - (n - 1) * capacity)[row]
                start = np.where(piece > 0, head + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, head)
                raw = flat.astype("<u4")
                at = offsets[row] + start
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[first + row]), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    T.tuned(docs.sparkSession)
    return T.keyed_texts(docs).mapInArrow(T.lean(run, "encoders"), PIECES)


class Grouping:
    """Bins of items, by bin number; ``room`` is the capacity each has left."""

    def __init__(self, sizes: np.ndarray, capacity: int, of: np.ndarray | None = None):
        self.sizes, self.capacity = sizes, capacity
        self.of = np.full(len(sizes), -1, np.int64) if of is None else of

    def fit(self, items: np.ndarray, together: int | None = None) -> None:
        """Best fit: every item into the bin that it leaves fullest, large ones first among each ``together`` items."""
        parts = [items] if together is None else np.array_split(items, max(1, len(items) // together))
        items = np.concatenate([part[np.argsort(-self.sizes[part], kind="stable")] for part in parts])
        used = int(self.of.max(initial=-1)) + 1
        placed = self.of >= 0
        load = np.bincount(self.of[placed], self.sizes[placed], used).astype(np.int64).tolist()
        # Bins by the room they have left.
        by_room: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        has = 0  # bit r: a bin has room r
        for b, x in enumerate(load):
            by_room[self.capacity - x].append(b)
            has |= 1 << (self.capacity - x)
        for i, size in zip(items.tolist(), self.sizes[items].tolist(), strict=True):
            fits = has >> size
            if fits:
                room = size + (fits & -fits).bit_length() - 1
                b = by_room[room].pop()
                if not by_room[room]:
                    has &= ~(1 << room)
            else:
                b, room = used, self.capacity
                used += 1
            self.of[i] = b
            by_room[room - size].append(b)
            has |= 1 << (room - size)

    def bins(self) -> int:
        return len(np.unique(self.of))

    def loads(self) -> np.ndarray:
        return np.bincount(self.of, self.sizes, int(self.of.max(initial=-1)) + 1)

    def worth(self) -> float:
        """Mean square of the fill: at equal counts, full and empty bins beat even ones."""
        load = self.loads()
        load = load[load > 0] / self.capacity
        return float((load**2).mean())

    def crossed(self, other: Grouping, rng: np.random.Generator) -> Grouping:
        """Whole well-filled bins of ``other`` come in; bins that share an item with them are dissolved and refitted.

        So are most ill-filled bins and a few others; displaced items go large ones first, but not in strict order.
        """
        load = other.loads()
        share = rng.uniform(0.2, 0.6)
        good = (load >= self.capacity * 0.998) & (rng.random(len(load)) < share)
        injected = good[other.of]
        broken = np.zeros(int(self.of.max(initial=-1)) + 1, bool)
        broken[self.of[injected]] = True
        own = self.loads()
        broken |= rng.random(len(own)) < np.where(own < self.capacity * 0.998, 0.8, 0.02)
        displaced = broken[self.of] & ~injected
        of = np.where(injected, other.of + len(broken), self.of)
        of[displaced] = -1
        _, dense = np.unique(of, return_inverse=True)
        dense = dense - int(displaced.any())
        child = Grouping(self.sizes, self.capacity, dense)
        items = np.flatnonzero(displaced)
        items = items[np.argsort(-self.sizes[items] * (1 + ERROR * rng.standard_normal(len(items))), kind="stable")]
        child.fit(items, TOGETHER)
        return child


def _evolve(sizes: np.ndarray, capacity: int, elite: list[np.ndarray], seed: int) -> tuple[np.ndarray, float]:
    """Best grouping after an epoch of one island; ends early at the least number of bins there can be."""
    rng = np.random.default_rng(seed)
    least = -(-int(sizes.sum()) // capacity)
    people = [Grouping(sizes, capacity, of.copy()) for of in elite]
    while len(people) < POPULATION:
        new = Grouping(sizes, capacity)
        if people:  # part of the items is placed first, in random order
            new.fit(rng.permutation(len(sizes))[: len(sizes) // 4], TOGETHER)
        new.fit(np.flatnonzero(new.of < 0))
        people.append(new)
        if new.bins() <= least:
            return new.of, new.worth()
    score = [(-p.bins(), p.worth()) for p in people]
    for _ in range(GENERATIONS):
        i, j = rng.choice(POPULATION, 2, replace=False)
        child = people[i].crossed(people[j], rng)
        got = (-child.bins(), child.worth())
        worst = min(range(POPULATION), key=score.__getitem__)
        if got > score[worst]:
            people[worst], score[worst] = child, got
        if -got[0] <= least:
            break
    best = max(range(POPULATION), key=score.__getitem__)
    return people[best].of, score[best][1]


def _pack_blocks(items: DataFrame, capacity: int, islands: int, epochs: int) -> DataFrame:
    """(row, length, block, bin) of ``items`` (row, length, block): every block packed on its own."""
    spark = items.sparkSession
    whole = items.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("length", "row"))).alias("items"))  # about BLOCK rows each
    state = whole.select("block", "items", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.array().cast("array<array<int>>").alias("elite"))
    kind = "block long, island int, items array<struct<length:long,row:long>>, best array<int>, bins int, worth double"

    def epoch(turn: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    one = batch.slice(k, 1)
                    sizes = one.column("items").flatten().field("length").to_numpy().astype(np.int64)
                    elite = [np.array(e, np.int64) for e in one.column("elite")[0].as_py()]
                    block, island = one.column("block")[0].as_py(), one.column("island")[0].as_py()
                    of, worth = _evolve(sizes, capacity, elite, (block * 64 + island) * 64 + turn)
                    best = pa.ListArray.from_arrays(np.array([0, len(of)], np.int32), pa.array(of.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays(
                        [one.column("block"), one.column("island"), one.column("items"), best, pa.array([len(np.unique(of))], pa.int32()), pa.array([worth])],
                        names=["block", "island", "items", "best", "bins", "worth"],
                    )

        return run

    for turn in range(epochs):
        dealt = state.repartition(T.partitions(spark), "block", "island")
        done = cut_lineage(dealt.mapInArrow(T.lean(epoch(turn)), kind))
        # Elites move on: island i gets its own best and that of island i - 1.
        best = done.select("block", F.col("island").alias("from"), "best")
        to = best.select("block", F.explode(F.array("from", (F.col("from") + 1) % islands)).alias("island"), "best")
        moved = to.groupBy("block", "island").agg(F.array_distinct(F.collect_list("best")).alias("elite"))
        state = done.select("block", "island", "items").join(moved, ["block", "island"])
    order = F.struct(-F.col("bins"), "worth", "island")
    won = done.groupBy("block").agg(F.max_by(F.struct("items", "best"), order).alias("w"))
    each = won.select("block", F.explode(F.arrays_zip(F.col("w.items").alias("item"), F.col("w.best").alias("bin"))).alias("x"))
    return cut_lineage(each.select(F.col("x.item.row").alias("row"), F.col("x.item.length").alias("length"), "block", F.col("x.bin").alias("bin")))


def packed(cut: DataFrame, capacity: int = 1024, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """``cut`` (any columns, with length) with sequence_id and offset; sequences are gapless."""
    spark = cut.sparkSession
    cut = cut_lineage(cut.withColumn("row", F.monotonically_increasing_id()))
    items = cut.filter(F.col("length") < capacity).select("row", "length")
    placed, turn, before = [], 0, None
    while True:
        count = items.count()
        if not count:
            break
        blocks = max(1, round(count / BLOCK))
        dealt = items.withColumn("block", F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(blocks)))
        bins = _pack_blocks(dealt, capacity, islands, epochs)
        load = bins.groupBy("block", "bin").agg(F.sum("length").alias("load"))
        # Another round only for bins that leave room, and only while rounds bring fewer of them.
        open_ = load.filter(F.col("load") < capacity)
        rest = cut_lineage(bins.join(open_, ["block", "bin"], "left_semi").select("row", "length"))
        left = rest.count()
        last = blocks == 1 or left == count or (before is not None and left > 0.9 * before)
        mine = bins if last else bins.join(open_, ["block", "bin"], "left_anti")
        place = (F.col("block") * (1 << 20) + F.col("bin")) * 64 + turn
        placed.append(mine.select("row", "length", (place * 2).alias("sequence_id")))
        if last:
            break
        items, before, turn = rest, count, turn + 1
    full = cut.filter(F.col("length") >= capacity).select("row", (F.col("row") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    for one in placed:
        lists = one.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("row", "length"))).alias("l"))  # at most ``capacity`` rows
        at = lists.select("sequence_id", F.posexplode("l").alias("i", "x"), "l")
        before_ = F.aggregate(F.slice("l", 1, F.col("i")), F.lit(0).cast("long"), lambda a, x: a + x["length"])
        full = full.unionByName(at.select(F.col("x.row").alias("row"), "sequence_id", before_.alias("offset")))
    return cut.join(full, "row").drop("row")


def pack(docs: DataFrame, path: str | None = None, end: int = 2, capacity: int = 1024) -> DataFrame:
    """Whole texts as token pieces in sequences of at most ``capacity`` tokens."""
    out = packed(pieces(docs, path, end, capacity), capacity)
    return out.select(T.given_id(), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def pack_sizes(sizes: pd.Series, capacity: int) -> np.ndarray:
    """Bins of a few sizes at once, on the caller's side; for tests and small tables."""
    return _evolve(sizes.to_numpy(np.int64), capacity, [], 0)[0]
