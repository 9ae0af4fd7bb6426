"""Vector codes by parts, with metric trees from an anchors hierarchy.

A vector is cut into equal consecutive parts; each part gets the index of its nearest
codebook entry, and the codebooks are fitted by rounds of assignment and means, all
in whole numbers (a component x is floor(256 * x)), so every result is exact.

Vectors are kept in blocks. For each part of a block a metric tree is built middle-out:
about sqrt(n) anchors are spread (each new one at the point farthest from its anchor,
taking the points that are nearer to it; points too near to their own anchor are not
looked at), each anchor's points are treated alike until balls are small, and the balls
are merged in pairs upwards, the pair that makes the smallest ball first. A ball caches
the sum and count of its points. The trees are written once and read by every round.

An assignment goes down from the root. A ball inherits the entries that may be nearest
to some point of its parent and drops those farther than the best one by more than the
ball's diameter; a ball that one entry owns adds its cached sum without a look at its
points; what is left at the leaves is compared point by point, with the entries still
on the list. Ties go to the lower index, so an entry that may tie is never dropped.

Tasks send 64 sums for each part, whatever they read. Vectors that are null or hold
null or non-finite components are left out. Vectors shorter than the longest, or whose
length is no multiple of the parts, count as filled up with zeros; components beyond
2**18 in size are held there. Rows of one id are vectors of their own; a codebook starts
from the smallest ids (ties: the smaller vector; null ids last), from fewer entries if
there are fewer vectors. Equal labels share their error, nulls together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.llm import text as T
from tracelight.operators.joins import with_group_stats
from tracelight.session import cut_lineage

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE, LARGEST = 256, 2**26
#: Vectors in a block and points in a leaf.
BLOCK, LEAF = 2048, 16


@dataclass
class Ball:
    """A node under construction: its points, or the two balls it was merged from."""

    points: np.ndarray | None
    below: tuple[Ball, Ball] | None
    centre: np.ndarray
    radius: float
    count: int


def _far(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    gap = x - y
    return np.sqrt(np.einsum("...i,...i->...", gap, gap))


def _anchors(x: np.ndarray, most: int) -> np.ndarray:
    """Owner of every point among at most ``most`` anchors; each point belongs to its nearest."""
    pivots = [0]
    near, owner = _far(x, x[0]), np.zeros(len(x), np.int64)
    radius = np.array([near.max()])
    while len(pivots) < most:
        widest = int(radius.argmax())
        if radius[widest] == 0:
            break
        mine = np.flatnonzero(owner == widest)
        new = int(mine[near[mine].argmax()])
        gap = _far(x[pivots], x[new])
        # A point nearer to its anchor than half the way to the new one cannot change.
        some = np.flatnonzero(near > gap[owner] / 2)
        to = _far(x[some], x[new])
        taken = to < near[some]
        near[some[taken]], owner[some[taken]] = to[taken], len(pivots)
        pivots.append(new)
        radius = np.zeros(len(pivots))
        np.maximum.at(radius, owner, near)
    return owner


def _leaf(x: np.ndarray, points: np.ndarray) -> Ball:
    centre = x[points].mean(axis=0)
    return Ball(points, None, centre, float(_far(x[points], centre).max()), len(points))


def _merged(balls: list[Ball]) -> Ball:
    """One ball of several: the pair that makes the smallest ball is joined first."""
    n = len(balls)
    centre = np.array([b.centre for b in balls])
    radius, count = np.array([b.radius for b in balls]), np.array([b.count for b in balls], float)

    def joint(i: int | np.ndarray, j: np.ndarray) -> np.ndarray:
        """Radius around the joint centre that holds both balls."""
        gap, share = _far(centre[i], centre[j]), count[j] / (count[i] + count[j])
        return np.maximum(gap * share + radius[i], gap * (1 - share) + radius[j])

    every = np.arange(n)
    cost = np.array([joint(i, every) for i in range(n)])
    np.fill_diagonal(cost, np.inf)
    for _ in range(n - 1):
        i, j = sorted(divmod(int(cost.argmin()), n))
        share = count[j] / (count[i] + count[j])
        size = float(cost[i, j])
        centre[i] += (centre[j] - centre[i]) * share
        radius[i], count[i] = size, count[i] + count[j]
        balls[i] = Ball(None, (balls[i], balls[j]), centre[i].copy(), size, int(count[i]))
        cost[j], cost[:, j] = np.inf, np.inf
        live = np.isfinite(cost[i]) | (every == i)
        cost[i, live] = joint(i, every[live])
        cost[live, i] = cost[i, live]
        cost[i, i] = np.inf
    return balls[i] if n > 1 else balls[0]


def _grown(x: np.ndarray, points: np.ndarray, leaf: int) -> Ball:
    """Middle-out: anchors first, then what lies below each and what lies above them all."""
    if len(points) <= leaf:
        return _leaf(x, points)
    owner = _anchors(x[points], int(np.ceil(np.sqrt(len(points)))))
    groups = [points[owner == a] for a in range(owner.max() + 1)]
    if len(groups) == 1:  # equal points
        return _leaf(x, points)
    return _merged([_grown(x, g, leaf) for g in groups])


def node_type(size: int) -> np.dtype:
    return np.dtype([("left", "<i4"), ("right", "<i4"), ("start", "<i4"), ("end", "<i4"), ("radius", "<f8"), ("sum", "<i8", (size,))])


@dataclass
class Tree:
    """Balls from the root on (left is -1 at a leaf); a ball's points lie together in ``points``."""

    order: np.ndarray
    points: np.ndarray
    nodes: np.ndarray

    @classmethod
    def build(cls, x: np.ndarray, leaf: int = LEAF) -> Tree:
        """``x``: whole numbers, one row for each point."""
        root = _grown(x.astype(float), np.arange(len(x)), leaf)
        nodes, order, at = [], [], 0
        open_ = [(root, -1, 0)]
        while open_:
            ball, parent, side = open_.pop()
            here = len(nodes)
            nodes.append([-1, -1, at, at])
            if parent >= 0:
                nodes[parent][side] = here
            if ball.points is None:
                open_ += [(ball.below[1], here, 1), (ball.below[0], here, 0)]
            else:
                order.append(ball.points)
                at += len(ball.points)
        order = np.concatenate(order)
        points = x[order]
        out = np.zeros(len(nodes), node_type(x.shape[1]))
        total = np.zeros((len(x) + 1, x.shape[1]), np.int64)
        np.cumsum(points, axis=0, out=total[1:])
        ends = [n[2] for n in nodes[1:]] + [len(x)]
        for i in range(len(nodes) - 1, -1, -1):  # children come after their parent
            left, right, start, _ = nodes[i]
            end = ends[i] if left < 0 else nodes[right][3]
            nodes[i][3] = end
            summed = total[end] - total[start]
            radius = _far(points[start:end].astype(float), summed / (end - start)).max()
            out[i] = (left, right, start, end, radius, summed)
        return cls(order.astype(np.int32), points, out)

    def assign(self, entries: np.ndarray, labels: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """(sums, counts) by entry, and on demand the entry of every point in ``points``."""
        many, size = entries.shape
        sums, counts = np.zeros((many, size), np.int64), np.zeros(many, np.int64)
        label = np.zeros(len(self.points), np.int64) if labels else None

        def own(entry: np.ndarray, total: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
            np.add.at(sums, entry, total)
            np.add.at(counts, entry, end - start)
            if label is not None:
                label[_ranges(start, end)] = np.repeat(entry, end - start)

        front, listed = np.array([0]), np.ones((1, many), bool)
        while len(front):
            balls = self.nodes[front]
            start, end, radius = balls["start"].astype(np.int64), balls["end"].astype(np.int64), balls["radius"]
            centre = balls["sum"] / (end - start)[:, None]
            # Distances of the entries on each ball's list.
            ball, entry = np.nonzero(listed)
            gap = np.full(listed.shape, np.inf)
            gap[ball, entry] = _far(centre[ball], entries[entry].astype(float))
            best = gap.min(axis=1)
            listed = gap <= (best + 2 * radius + 1e-9 * (1 + best + radius))[:, None]
            single = listed.sum(axis=1) == 1
            own(listed[single].argmax(axis=1), balls["sum"][single], start[single], end[single])
            leaf = ~single & (balls["left"] < 0)
            if leaf.any():
                rows = _ranges(start[leaf], end[leaf])
                which = np.repeat(np.flatnonzero(leaf), (end - start)[leaf])
                nearest = _nearest(self.points[rows], entries, listed[which])
                own(nearest, self.points[rows], rows, rows + 1)
            inner = ~single & (balls["left"] >= 0)
            front = np.concatenate([balls["left"][inner], balls["right"][inner]])
            listed = np.concatenate([listed[inner], listed[inner]])
        return sums, counts, label


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    n = end - start
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _nearest(points: np.ndarray, entries: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """Exact nearest listed entry of each point, the lowest of equals."""
    row, entry = np.nonzero(listed)
    gap = points[row] - entries[entry]
    square = np.einsum("ij,ij->i", gap, gap)
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    least = np.minimum.reduceat(square, first)
    hit = np.flatnonzero(square == least[row])
    return entry[hit[np.concatenate([[True], row[hit][1:] != row[hit][:-1]])]]


def whole_numbers(vectors: pa.Array, width: int) -> np.ndarray:
    """Vectors without nulls as rows of ``width`` whole numbers."""
    size = np.diff(vectors.offsets.to_numpy()).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
    out = np.zeros((len(size), width), np.int64)
    step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(np.arange(len(size)), size), step] = np.clip(np.floor(flat * SCALE), -LARGEST, LARGEST)
    return out


def _planted(width: int, parts: int):
    """Blocks of vectors with one tree for each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK):
                block = batch.slice(first, BLOCK)
                x = whole_numbers(block.column("vector"), width).reshape(block.num_rows, parts, -1)
                trees = [Tree.build(x[:, p]) for p in range(parts)]
                one = lambda c: pa.ListArray.from_arrays(np.array([0, len(c)], np.int32), c)
                packed = [one(pa.array([getattr(t, n).tobytes() for t in trees], pa.binary())) for n in ("order", "points", "nodes")]
                yield pa.RecordBatch.from_arrays(
                    [one(pa.concat_arrays([block.column(c)])) for c in ("vec_id", "label")] + packed, names=["vec_id", "label", "order", "points", "nodes"]
                )

    return run


def _trees(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, list[Tree]]]:
    for row in range(batch.num_rows):
        order, points, nodes = (batch.column(c)[row].as_py() for c in ("order", "points", "nodes"))
        yield row, [
            Tree(np.frombuffer(o, np.int32), np.frombuffer(p, np.int64).reshape(-1, size), np.frombuffer(n, node_type(size)))
            for o, p, n in zip(order, points, nodes, strict=True)
        ]


def _summed(books: np.ndarray):
    """(part, entry, n, total): sums and counts of a task's points by their nearest entry."""
    parts, entries, size = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for _, trees in _trees(batch, size):
                for p, tree in enumerate(trees):
                    s, n, _ = tree.assign(books[p])
                    sums[p] += s
                    counts[p] += n
        part, entry = np.nonzero(counts)
        total = sums[part, entry]
        lists = pa.ListArray.from_arrays(np.arange(0, total.size + 1, size, dtype=np.int32), pa.array(total.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(counts[part, entry]), lists], names=["part", "entry", "n", "total"])

    return run


def _coded(books: np.ndarray, kind: pa.DataType):
    parts, _, size = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, trees in _trees(batch, size):
                n = len(trees[0].order)
                code, error = np.zeros((n, parts), np.uint8), np.zeros(n, np.int64)
                for p, tree in enumerate(trees):
                    label = tree.assign(books[p], labels=True)[2]
                    gap = tree.points - books[p][label]
                    code[tree.order, p] = label
                    error[tree.order] += np.einsum("ij,ij->i", gap, gap)
                spelled = code.tobytes().hex()
                codes = [spelled[i : i + 2 * parts] for i in range(0, len(spelled), 2 * parts)]
                ids, labels = (batch.column(c)[row].values for c in ("vec_id", "label"))
                yield pa.RecordBatch.from_arrays([ids, labels.cast(kind), pa.array(codes), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def usable(vectors: DataFrame, column: str) -> DataFrame:
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter(F.col(column).isNotNull()).filter(~bad)


def compress(
    vectors: DataFrame, column: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error), codebooks[part, entry, position]) of ``vectors`` (vec_id, label and a numeric list).

    ``code`` has two hexadecimal digits for each part; ``error`` is the sum of the parts' squared distances.
    """
    spark = T.tuned(vectors.sparkSession)
    kept = usable(vectors, column).select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col(column).cast("array<double>").alias("vector"))
    longest = kept.agg(F.max(F.size("vector"))).first()[0]
    width = max(1, -(-(longest or 0) // parts)) * parts
    starts = kept.select("vec_id", "vector").orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).collect()
    books = whole_numbers(pa.array([r.vector for r in starts], pa.list_(pa.float64())), width).reshape(len(starts), parts, width // parts).transpose(1, 0, 2)
    size = width // parts
    kind = kept.schema["label"].dataType.simpleString()
    blocks = kept.mapInArrow(_planted(width, parts), f"vec_id array<long>, label array<{kind}>, order array<binary>, points array<binary>, nodes array<binary>")
    blocks = cut_lineage(blocks)
    for _ in range(rounds if len(starts) else 0):
        sums = blocks.mapInArrow(_summed(books), "part long, entry long, n long, total array<long>").groupBy("part", "entry")
        # At most parts * entries rows come to the driver.
        means = sums.agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(size)]).alias("total")).collect()
        books = books.copy()
        for r in means:
            books[r.part, r.entry] = np.array(r.total) // r.n
    from pyspark.sql.pandas.types import to_arrow_type

    out = blocks.mapInArrow(_coded(books, to_arrow_type(kept.schema["label"].dataType)), f"vec_id long, label {kind}, code string, error long")
    return out, books


def spelled(books: np.ndarray) -> str:
    """All entries' components in decimal, by part, entry and position."""
    return ",".join(map(str, books.ravel().tolist()))


def codes(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Per vector: vec_id, code, error, label_error (the error of all vectors of its label), codebooks_sha256."""
    coded, books = compress(vectors, column)
    coded = with_group_stats(cut_lineage(coded), ["label"], {"label_error": F.sum("error")})
    digest = hashlib.sha256(spelled(books).encode()).hexdigest()
    return coded.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
