"""MinHash near-duplicates with tensored banding.

Two small collections of bands are hashed, each band from a few minhashes. A
table's key joins one band of the first collection with one of the second, so
``bands**2`` tables of ``2 * rows`` minhashes each cost only ``2 * bands * rows``
minhashes. Texts that share a key are candidates; a link counts only when the
whole shingle sets reach the threshold.

Exact copies (equal sets) become one class before anything is compared. First
each text is compared with the smallest text it shares a bucket with, which
settles nearly all of a group of copies. A bucket is settled when its texts are in
one component. Of the others, small ones are compared pair by pair. The texts of
large ones are joined exactly, by prefix filter: shingles in order of rarity, two sets
that reach the threshold share one of the first few of each. Texts under one such
shingle are compared across components only, each text outside the largest
component with the rest (a few first, whose links join most of the others; of very many,
some a round), and only where what follows the shingle in both sets is enough for the
threshold and the bit marks of the sets differ by no more than it allows. So no pair of a
bucket is left out unless a component already joins it or it cannot be a link.

Nulls and texts without words have an empty set and link with nothing. Ids are
numbers. Rows with a null or repeated id are told apart by their text; rows with the
same id and text are one document. A component is named by its smallest id, null first,
and one document of it is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelight.llm import text as T
from tracelight.session import cut_lineage

#: Bands in each of the two collections, minhashes in a band.
BANDS, ROWS = 12, 3
#: A bucket that is not settled is compared pair by pair up to this size.
SMALL = 16
#: Under one shingle, texts outside the largest component that meet the others in the first round and in a later one.
FEW, OUTSIDE = 8, 1024
#: 64-bit words of the bit mark of a set.
MARK = 32
BLOCK = 256


def _sets(data, offsets, size, lower):
    """(row, sorted distinct shingles) of each text of a slice; rows without words are left out."""
    data = T.LOWER[data] if lower else data
    starts, ends, rows = T.words(data, offsets, T.SPACE)
    hashes = T.word_hashes(data, starts, ends)
    edges = np.searchsorted(rows, np.arange(len(offsets)))
    every = T.shingles(hashes, size)
    for row in range(len(offsets) - 1):
        a, b = edges[row], edges[row + 1]
        if b - a >= size:
            yield row, np.unique(every[a : b - size + 1])
        elif b > a:
            yield row, T.mixed(T.range_hash(hashes[a:b], np.array([0]), np.array([b - a]), T.STEP))


def _minima(shingle: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Minhash for every seed: the smallest of the re-mixed shingles."""
    least = np.full(seeds.shape[1], np.uint64(2**64 - 1))
    for a in range(0, len(shingle), BLOCK):
        x = (shingle[a : a + BLOCK, None] ^ seeds[0]) * seeds[1]
        np.minimum(least, (x ^ (x >> np.uint64(31))).min(axis=0), out=least)
    return least


def _signatures(size: int, lower: bool, bands: int, rows: int):
    """Row for each text: id, set size, two hashes of the set, band hashes of both collections."""
    rng = np.random.default_rng(7)
    n = 2 * bands * rows
    seeds = np.stack([rng.integers(0, 2**63, n, dtype=np.uint64), rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            count = np.zeros(len(ids), np.int64)
            class_a, class_b = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            signature = np.zeros((len(ids), 2 * bands), np.int64)
            for first, data, offsets in T.slices(batch.column(1)):
                for row, shingle in _sets(data, offsets, size, lower):
                    at = first + row
                    count[at] = len(shingle)
                    class_a[at] = np.add.reduce(T.mixed(shingle)).astype(np.int64)
                    class_b[at] = np.bitwise_xor.reduce(T.mixed(shingle + np.uint64(99))).astype(np.int64)
                    least = _minima(shingle, seeds).reshape(2 * bands, rows)
                    band = np.zeros(2 * bands, np.uint64)
                    for k in range(rows):
                        band = T.mixed(band * np.uint64(31) + least[:, k])
                    signature[at] = (band + np.arange(2 * bands, dtype=np.uint64)).astype(np.int64)
            lists = pa.ListArray.from_arrays(np.arange(0, 2 * bands * len(ids) + 1, 2 * bands, dtype=np.int32), signature.ravel())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count), pa.array(class_a), pa.array(class_b), lists],
                names=["doc_id", "n_shingles", "set_a", "set_b", "bands"],
            )

    return run


def _keys(bands: int):
    """All tensored keys of a text, as (key, rep); the low byte of a key names its table."""
    table = np.arange(bands * bands, dtype=np.uint64).reshape(1, bands, bands)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps = batch.column(0).to_numpy()
            both = batch.column(1).flatten().to_numpy().astype(np.uint64).reshape(len(reps), 2 * bands)
            for a in range(0, len(reps), 2048):
                part = both[a : a + 2048]
                key = T.mixed(part[:, :bands, None] * np.uint64(3) ^ T.mixed(part[:, None, bands:]))
                key = (key & ~np.uint64(255)) | table
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.ravel().astype(np.int64)), pa.array(np.repeat(reps[a : a + 2048], bands * bands))], names=["key", "rep"]
                )

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key: those whose key occurs more than once."""
    held = None
    for batch in batches:
        k, r = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(k):
            continue
        if held is not None:
            k, r = np.concatenate([held[0], k]), np.concatenate([held[1], r])
        again = k[1:] == k[:-1]
        same = np.zeros(len(k), bool)
        same[1:] |= again
        same[:-1] |= again
        # The last row waits for its successor; one that is known to be shared waits as a pair.
        out = same.copy()
        waits = 2 if len(k) > 1 and again[-1] else 1
        held = k[-waits:], r[-waits:]
        out[-waits:] = False
        if waits == 2 and len(k) > 2:
            out[-2] = False
        yield pa.RecordBatch.from_arrays([pa.array(k[out]), pa.array(r[out])], names=["key", "rep"])
    if held is not None and len(held[0]) == 2 and held[0][0] == held[0][1]:
        yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], names=["key", "rep"])


def _packed_sets(size: int, lower: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [b""] * batch.num_rows
            for first, data, offsets in T.slices(batch.column(1)):
                for row, shingle in _sets(data, offsets, size, lower):
                    sets[first + row] = shingle.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["rep", "shingles"])

    return run


def _confirm(threshold: int):
    """Links among candidates: 100 * intersection >= threshold * union, on whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("left"), batch.column("right")
            linked = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = np.frombuffer(left[i].as_py(), np.uint64), np.frombuffer(right[i].as_py(), np.uint64)
                if 100 * min(len(x), len(y)) >= threshold * max(len(x), len(y)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    linked[i] = 100 * both >= threshold * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked)], names=["a", "b", "linked"])

    return run


def components(links: DataFrame) -> DataFrame:
    """Smallest reachable node of every node of ``links`` (a, b): labels spread over links and jump along labels."""
    both = cut_lineage(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label"))
    while True:
        labels = cut_lineage(labels)
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.least("label", "near").alias("next"), F.col("label").alias("was"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        step = cut_lineage(step.join(jump, "next").select("node", F.least("next", "far").alias("label"), (F.col("was") > F.least("next", "far")).alias("moved")))
        labels = step.select("node", "label")
        if not step.filter("moved").limit(1).count():
            return labels


def _unsettled(placed: DataFrame) -> DataFrame:
    """Rows of ``placed`` (key, rep, comp) whose key holds several components, with the key's size ``n``."""
    sizes = placed.groupBy("key").agg(F.count("*").alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high")
    return placed.join(sizes.select("key", "n"), "key")


def _pairwise(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) across components in buckets of at most ``SMALL`` texts."""
    lists = rows.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rep", "comp"))).alias("all"))
    inner = lists.select(F.posexplode("all").alias("i", "x"), "all").select("x", F.explode(F.expr("slice(all, i + 2, size(all))")).alias("y"))
    return inner.filter("x.comp <> y.comp").select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, mark): bits, each the parity of the set's shingles that fall on it; two sets differ in no fewer shingles than bits."""
    for batch in batches:
        marks = np.zeros((batch.num_rows, MARK), np.uint64)
        for i, packed in enumerate(batch.column(1)):
            at = T.mixed(np.frombuffer(packed.as_py(), np.uint64) ^ np.uint64(T.STEP)) % np.uint64(64 * MARK)
            np.bitwise_xor.at(marks[i], at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
        lists = pa.ListArray.from_arrays(np.arange(0, MARK * batch.num_rows + 1, MARK, dtype=np.int32), marks.view(np.int64).ravel())
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["rep", "mark"])


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, rep, size): the shingles of each set."""
    for batch in batches:
        for rep, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            shingle = np.frombuffer(packed.as_py(), np.int64)
            n = len(shingle)
            yield pa.RecordBatch.from_arrays([pa.array(shingle), pa.array(np.full(n, rep)), pa.array(np.full(n, n))], names=["key", "rep", "size"])


def _prefixes(sets: DataFrame, threshold: int) -> DataFrame:
    """(key, rep, size, after): of each set the rarest shingles that a set it is linked with must share one of.

    ``after`` counts the set's shingles from this one on, in the order of rarity.
    """
    rows = cut_lineage(sets.mapInArrow(_spelled, "key long, rep long, size long"))
    often = rows.groupBy("key").agg(F.count("*").alias("df")).filter("df > 1")
    of = Window.partitionBy("rep")
    shared = rows.join(often, "key").withColumn("rank", F.row_number().over(of.orderBy("df", "key"))).withColumn("shared", F.count("*").over(of))
    # Shingles that only one set has come first and meet nothing.
    after = shared.select("key", "rep", "size", (F.col("shared") - F.col("rank") + 1).alias("after"))
    return after.filter(100 * F.col("after") >= threshold * F.col("size"))


def _across(placed: DataFrame, marks: DataFrame, threshold: int, asking: int) -> tuple[DataFrame, DataFrame]:
    """(pairs, rows to go on with) under the shingles of ``placed`` (key, rep, size, after, comp); ``asking`` texts of each meet the others."""
    rows = _unsettled(placed)
    sizes = rows.groupBy("key", "comp").agg(F.count("*").alias("c"))
    most = sizes.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("m"), F.sum("c").alias("all")).select("key", F.col("m.comp").alias("main"), (F.col("all") - F.col("m.c")).alias("outside"))
    rows = cut_lineage(rows.join(most, "key"))
    first = F.row_number().over(Window.partitionBy("key").orderBy("rep"))
    other = cut_lineage(rows.filter("comp <> main").withColumn("turn", first))
    x = other.filter(F.col("turn") <= asking).join(marks, "rep").select(
        "key", F.col("rep").alias("x"), F.col("comp").alias("cx"), F.col("size").alias("sx"), F.col("after").alias("ax"), F.col("mark").alias("mx"))
    y = rows.join(marks, "rep").select("key", "rep", "comp", "size", "after", "mark")
    # At the first shingle a pair shares, all that it shares comes from there on.
    enough = (100 + threshold) * F.least("ax", "after") >= threshold * (F.col("sx") + F.col("size"))
    differ = reduce(add, [F.bit_count(F.col("mx")[i].bitwiseXOR(F.col("mark")[i])) for i in range(MARK)])
    near = (100 + threshold) * differ <= (100 - threshold) * (F.col("sx") + F.col("size"))
    met = x.join(y, "key").filter((F.col("cx") != F.col("comp")) & enough & near)
    pairs = met.select(F.least("x", "rep").alias("a"), F.greatest("x", "rep").alias("b")).distinct()
    asked = other.filter(F.col("turn") <= asking).select("key", "rep")
    later = rows.filter(F.col("outside") > asking).join(asked, ["key", "rep"], "left_anti").select("key", "rep", "size", "after")
    return pairs, later


def near_duplicates(
    docs: DataFrame, size: int = 5, threshold: int = 80, lower: bool = True, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest id reachable over links), kept.

    ``threshold`` is the least Jaccard similarity in hundredths, ``size`` the words
    of a shingle; a text of fewer words has its whole sequence as one.
    """
    spark = T.tuned(docs.sparkSession)
    texts, plain = T.separated(docs)
    if not plain:  # read again below, with the keys as they are now
        texts = cut_lineage(texts)
    kinds = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"
    signed = cut_lineage(texts.select("doc_id", "text").mapInArrow(T.lean(_signatures(size, lower, bands, rows)), kinds))
    ident = signed.groupBy("doc_id").agg(F.min(F.struct("n_shingles", "set_a", "set_b", "bands")).alias("s")).select("doc_id", "s.*")
    classes = cut_lineage(ident.filter("n_shingles > 0").groupBy("set_a", "set_b", "n_shingles").agg(
        F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands")))
    keys = classes.select("rep", "bands").mapInArrow(_keys(bands), "key long, rep long")
    n = T.partitions(spark)
    left = cut_lineage(keys.repartition(n, "key").sortWithinPartitions("key", "rep").mapInArrow(_shared, "key long, rep long"))

    members = left.select(F.col("rep").alias("doc_id")).distinct()
    sets = cut_lineage(texts.select("doc_id", "text").join(members, "doc_id").mapInArrow(T.lean(_packed_sets(size, lower)), "rep long, shingles binary")
                       .groupBy("rep").agg(F.max("shingles").alias("shingles")))

    def compare(pairs: DataFrame) -> DataFrame:
        wide = pairs.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("left")), "a")
        wide = wide.join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("right")), "b")
        return cut_lineage(wide.select("a", "b", "left", "right").mapInArrow(T.lean(_confirm(threshold)), "a long, b long, linked boolean"))

    def placed(rows: DataFrame, links: DataFrame) -> DataFrame:
        labels = components(links.filter("linked"))
        known = labels.select(F.col("node").alias("rep"), F.col("label").alias("comp"))
        return rows.join(known, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))

    heads = left.groupBy("key").agg(F.min("rep").alias("a"))
    first = left.join(heads, "key").filter("rep > a").groupBy(F.col("rep").alias("b")).agg(F.min("a").alias("a"))
    compared = compare(first.select("a", "b"))
    rows = cut_lineage(_unsettled(placed(left, compared)))
    fresh = lambda pairs: pairs.join(compared.select("a", "b"), ["a", "b"], "left_anti")
    compared = compared.union(compare(fresh(_pairwise(rows.filter(F.col("n") <= SMALL)))))
    large = sets.join(rows.filter(F.col("n") > SMALL).select("rep").distinct(), "rep")
    marks = cut_lineage(large.mapInArrow(_marked, "rep long, mark array<long>"))
    later, asking = cut_lineage(_prefixes(large, threshold)), FEW
    while later.limit(1).count():
        pairs, later = _across(cut_lineage(placed(later, compared)), marks, threshold, asking)
        pairs, later, asking = cut_lineage(fresh(pairs)), cut_lineage(later), OUTSIDE
        compared = compared.union(compare(pairs))
    labels = components(compared.filter("linked"))
    reps = classes.select("set_a", "set_b", "n_shingles", "rep")
    reps = reps.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("label", "rep"))
    found = ident.drop("bands").join(reps.drop("rep", "label"), ["set_a", "set_b", "n_shingles"], "left")
    component = F.coalesce("component", "doc_id").alias("component_id")
    found = found.select("doc_id", "n_shingles", component)
    if plain:
        return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    ids = texts.select("doc_id", "given_id").distinct()
    found = cut_lineage(found.join(ids, "doc_id"))
    smallest = F.min(F.struct(F.coalesce("given_id", F.lit(T.NO_ID)).alias("id"), "doc_id")).alias("first")
    named = found.join(found.groupBy("component_id").agg(smallest), "component_id")
    name, kept = T.given_id("first.id").alias("component_id"), (F.col("doc_id") == F.col("first.doc_id")).alias("kept")
    return named.select(F.col("given_id").alias("doc_id"), "n_shingles", name, kept)
