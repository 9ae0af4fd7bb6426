"""Approximate nearest neighbours by adaptive dimension scan.

Vectors are dealt into lists by their nearest centroid (k-means on a bounded
sample); a query probes the lists whose centroids are nearest. In a list the
vectors are rotated at random and laid out in blocks of columns. After each block
a hypothesis test compares the partial distance, scaled to all dimensions, with
the distance of the worst neighbour held so far; candidates that exceed it beyond
doubt are abandoned, the others go on to the next block. What survives is scored
exactly on the original vectors.

Nearness is the inner product. One more dimension, sqrt(M**2 - |x|**2) with M the
largest norm, makes it a distance: |q - x|**2 = |q|**2 + M**2 - 2 q.x.

Equal vectors are one class, searched once, whatever its size; of a class only the
``k + 1`` smallest ids can be among the nearest ``k``. Lists are cut into blocks of at
most ``BLOCK`` vectors, and the queries of a list into parts of as many, so no task
holds more than one block of each.

How many lists a query probes is measured: on the sample, the fewest nearest lists
that hold ``RECALL`` of the true neighbours of some sampled vectors.

Vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part, as queries or as candidates. Rows that repeat
an id count as one if their vectors are equal; with different vectors, that of the
smallest hash counts. Null ids take no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelight.llm import text as T
from tracelight.session import cut_lineage

#: Vectors that k-means is fitted on, at most.
FITTED = 20_000
#: Lists for n distinct vectors: the square root of n, at most this many.
LISTS = 4096
#: Recall that the probed lists must reach on the sample, the sampled queries for it, and the fewest lists probed.
RECALL, ASKED, LEAST_PROBED = 0.96, 256, 12
BLOCK = 2048
#: Columns in a block; standard errors beyond which a partial distance is abandoned.
COLUMNS, DOUBT = 16, 2.1
SALTS = 32


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v double[]) that take part."""
    v = F.col("v")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.filter(v.isNotNull() & F.col("vec_id").isNotNull()).filter(F.forall("v", fine) & F.exists("v", lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (size.n if size else 0))


def _rotation(n: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(3).standard_normal((n, n)))[0]


def _centroids(sample: np.ndarray, lists: int) -> np.ndarray:
    """Lloyd's k-means on the sample."""
    rng = np.random.default_rng(5)
    centre = sample[rng.choice(len(sample), lists, replace=False)]
    for _ in range(12):
        near = (sample @ centre.T - (centre**2).sum(1) / 2).argmax(1)
        total = np.zeros_like(centre)
        np.add.at(total, near, sample)
        n = np.bincount(near, minlength=lists)
        centre = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centre)
    return centre


def _lifted(x: np.ndarray, norm: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(0.0, norm**2 - (x**2).sum(1)))])


def _probes(sample: np.ndarray, queries: np.ndarray, centre: np.ndarray, k: int) -> int:
    """Lists to probe so that ``queries`` (unlifted) find ``RECALL`` of their ``k`` nearest in the (lifted) sample."""
    if not len(queries):
        queries = sample[:: max(1, len(sample) // ASKED), :-1]
    asked = np.column_stack([queries, np.zeros(len(queries))])
    half = (centre**2).sum(1) / 2
    own = np.concatenate([(sample[a : a + 4096] @ centre.T - half).argmax(1) for a in range(0, len(sample), 4096)])
    score = asked @ sample.T
    k = min(k + 1, len(sample))  # a query's own copy in the sample counts too
    near = np.argpartition(-score, k - 1, axis=1)[:, :k]
    place = np.argsort(np.argsort(half - asked @ centre.T, axis=1), axis=1)  # of each list, from the nearest on
    needed = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(RECALL * len(needed))))]) + 1


def scan(x: np.ndarray, ids: np.ndarray, q: np.ndarray, norm: float, k: int, rotation: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, candidate id, inner product) of the ``k`` nearest found for each query among one block of vectors."""
    n = x.shape[1] + 1
    xr, qr = _lifted(x, norm) @ rotation, np.column_stack([q, np.zeros(len(q))]) @ rotation
    cuts = [*range(0, n, COLUMNS), n] if n % COLUMNS else [*range(0, n + 1, COLUMNS)]
    blocks = [np.ascontiguousarray(xr[:, a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    b = cuts[1]
    opening = (blocks[0] ** 2).sum(1) + (qr[:, :b] ** 2).sum(1)[:, None] - 2 * qr[:, :b] @ blocks[0].T
    out_q, out_id, out_s = [], [], []
    for i in range(len(q)):
        part = opening[i]
        seed = np.argpartition(part, k - 1)[:k] if len(part) > k else np.arange(len(part))
        worst = ((xr[seed] - qr[i]) ** 2).sum(1).max()
        alive = np.arange(len(x))
        for block, (a, b) in zip(blocks, zip(cuts[:-1], cuts[1:], strict=True), strict=True):
            if a:
                part = part[keep] + ((block[alive] - qr[i, a:b]) ** 2).sum(1)  # noqa: F821
            keep = part * (n / b) <= worst * (1 + DOUBT / np.sqrt(b)) ** 2 + 1e-9 if b < n else part <= worst + 1e-9
            alive = alive[keep]
        alive = np.union1d(alive, seed)
        score = x[alive] @ q[i]
        best = np.lexsort((ids[alive], -score))[:k]
        out_q.append(np.full(len(best), i))
        out_id.append(ids[alive][best])
        out_s.append(score[best])
    return np.concatenate(out_q), np.concatenate(out_id), np.concatenate(out_s)


def nearest(vectors: DataFrame, is_query, k: int = 20, probed: float | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that the column ``is_query`` (on vec_id) selects, its ``k`` nearest found.

    ``probed`` is the share of lists to probe; None measures it.
    """
    spark = T.tuned(vectors.sparkSession)
    hashed = usable(vectors).select("vec_id", "v", F.xxhash64("v").alias("a"), F.xxhash64(F.lit(1), "v").alias("b"))
    rows = cut_lineage(hashed.groupBy("vec_id").agg(F.min(F.struct("a", "b", "v")).alias("x")).select("vec_id", "x.*"))

    # The k + 1 smallest ids of each class of equal vectors, in two steps so that a large class is spread.
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))
    some = rows.select("a", "b", "vec_id", salt.alias("salt"))
    for keys in (["a", "b", "salt"], ["a", "b"]):
        some = some.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("vec_id"))).filter(F.col("n") <= k + 1)
    classes = some.groupBy("a", "b").agg(F.sort_array(F.collect_list("vec_id")).alias("members"))
    classes = cut_lineage(classes.withColumn("rep", F.element_at("members", 1)))
    reps = cut_lineage(classes.select(F.col("rep").alias("vec_id")).join(rows.select("vec_id", "v"), "vec_id").withColumnRenamed("vec_id", "rep"))

    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x))
    count, top = reps.agg(F.count("*"), F.max(norm)).first()
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = reps.orderBy(F.xxhash64("rep"), "rep").limit(FITTED).select("v").toPandas()
    sample = _lifted(np.stack(sample["v"].to_numpy()), top)
    lists = int(max(1, min(LISTS, count**0.5, len(sample))))
    centre = _centroids(sample, lists)
    rotation = _rotation(centre.shape[1])
    wanted = _probes(sample, sample[:0, :-1], centre, k) if probed is None else int(np.ceil(lists * probed))
    probes = min(lists, max(LEAST_PROBED, wanted))

    def assign(n: int, lifted: bool):
        def run(frames):
            for frame in frames:
                if len(frame):
                    x = np.stack(frame["v"].to_numpy())
                    x = _lifted(x, top) if lifted else np.column_stack([x, np.zeros(len(x))])
                    near = x @ centre.T - (centre**2).sum(1) / 2
                    order = np.argpartition(-near, n - 1, axis=1)[:, :n] if n < lists else np.tile(np.arange(lists), (len(x), 1))
                    yield pd.DataFrame({"rep": frame["rep"], "lists": list(order.astype(np.int64))})

        return run

    own = cut_lineage(reps.mapInPandas(assign(1, True), "rep long, lists array<long>").select("rep", F.col("lists")[0].alias("list")).join(reps, "rep"))
    asked = rows.filter(is_query).select("a", "b").distinct().join(classes.select("a", "b", "rep"), ["a", "b"]).join(reps, "rep")
    probe = asked.mapInPandas(assign(probes, False), "rep long, lists array<long>").select("rep", F.explode("lists").alias("list"))
    probe = cut_lineage(probe)

    blocks = own.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    parts = probe.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    cells = cut_lineage(blocks.join(parts, "list"))  # one row for each list
    of = lambda n: F.pmod(F.xxhash64("rep"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = own.join(cells, "list").select("list", of("blocks").cast("long").alias("block"), each("parts").alias("part"), "rep", "v")
    right = probe.join(cells, "list").join(reps, "rep").select("list", each("blocks").alias("block"), of("parts").cast("long").alias("part"), "rep", "v")
    cell = ["list", "block", "part"]

    def search(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(q):
            return pd.DataFrame({"query": [], "rep": [], "score": []}).astype({"query": "int64", "rep": "int64", "score": "float64"})
        i, found, score = scan(np.stack(x["v"].to_numpy()), x["rep"].to_numpy(), np.stack(q["v"].to_numpy()), top, k + 1, rotation)
        return pd.DataFrame({"query": q["rep"].to_numpy()[i], "rep": found, "score": score})

    found = left.groupBy(cell).cogroup(right.groupBy(cell)).applyInPandas(search, "query long, rep long, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    best = found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1)
    members = best.join(classes.select("rep", "members"), "rep").select("query", "score", F.explode("members").alias("vec_id"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    members = members.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1)
    answer = members.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("near"))

    asking = rows.filter(is_query).select(F.col("vec_id").alias("query_id"), "a", "b")
    asking = asking.join(classes.select("a", "b", F.col("rep").alias("query")), ["a", "b"]).join(answer, "query")
    others = asking.select("query_id", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("near"))
    ranked = others.select("query_id", F.posexplode("near").alias("at", "x"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
