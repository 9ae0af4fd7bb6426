"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line without white space at both ends, A-Z in lower case; two
64-bit hashes stand for it. ``LineRuns`` counts the documents of each key batch by
batch. Its runs are bucketed tables, sorted by hash: all runs have the same buckets,
so they are merged and joined in place, without another shuffle.

* A new batch is reduced to one row for each of its keys, merge-anti-joined with the
  run of keys that are already frequent, and the rest is added as a run of level 0.
* ``FANOUT`` runs of one level are compacted into one of the next: counts are added,
  keys that reach the threshold move to the frequent run and need no counting any more.

Counts only grow, so a key found frequent stays so, however batches are cut. At the
end all levels are merged, and ``without_lines`` takes the frequent lines out of
every document.

Every row is a document of its own, also where ids are null or repeated. Null and
empty texts are one empty line; a line without any character but white space is
never dropped. Rows are counted map-side first, so a line of a third of all documents
is one row a task. Only DataFrame functions are used.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelight.llm import text as T
from tracelight.operators.joins import spread_join
from tracelight.session import cut_lineage, shared_path

#: Documents that must hold a line.
LEAST = 10
#: Runs of one level that are compacted into one.
FANOUT = 2
#: Frequent keys that may be sent to every task (16 bytes each); more are joined by a shuffle.
SENT_KEYS = 200_000

# White space that is stripped, upper and lower case letters.
STRIPPED = " \t\n\x0b\x0c\r"
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["a", "b"]


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def key(line: Column) -> Column:
    # lower() may change letters beyond A-Z, so only plain ASCII lines take it.
    plain = F.octet_length(line) == F.char_length(line)
    return F.btrim(F.when(plain, F.lower(line)).otherwise(F.translate(line, UPPER, SMALL)), F.lit(STRIPPED))


def hashes(value: Column) -> list[Column]:
    """Two 64-bit hashes of a value, under the names of ``KEY``."""
    return [F.xxhash64(value).alias("a"), F.xxhash64(F.lit(77), value).alias("b")]


class LineRuns:
    """Documents of each line, in levelled sorted runs under the session's shared folder.

    ``add`` takes the batches in any order; ``frequent`` may be asked at any time.
    """

    def __init__(self, spark: SparkSession, least: int = LEAST, fanout: int = FANOUT):
        self.spark, self.least, self.fanout = spark, least, fanout
        self.buckets = T.partitions(spark)
        self.levels: list[list[DataFrame]] = []
        self.known: DataFrame | None = None
        self.compactions = 0

    def _run(self, counts: DataFrame) -> DataFrame:
        """``counts`` (a, b, docs) as a run: one sorted file for each bucket."""
        name = f"line_run_{uuid.uuid4().hex}"
        writer = counts.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", shared_path(self.spark, "run"))
        writer.format("parquet").saveAsTable(name)
        run = self.spark.table(name)
        run.schema  # resolved here, so the name can go and the files stay
        self.spark.sql(f"DROP TABLE {name}")
        return run

    def _unknown(self, counts: DataFrame) -> DataFrame:
        """``counts`` without the keys known to be frequent."""
        return counts if self.known is None else counts.join(self.known.select(*KEY).hint("merge"), KEY, "left_anti")

    def add(self, docs: DataFrame) -> None:
        """Count the lines of a new batch: each key once a document."""
        own = docs.select(F.explode(F.array_distinct(F.transform(lines(F.col("text")), key))).alias("key")).filter("key <> ''")
        counts = own.select(*hashes(F.col("key"))).groupBy(*KEY).agg(F.count("*").alias("docs"))
        self._push(0, self._run(self._unknown(counts)))

    def _push(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged = self._merged(self.levels[level])
            self.levels[level] = []
            self._push(level + 1, merged)

    def _two(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """Two runs as one: a merge join of sorted buckets, counts added."""
        both = left.join(right.withColumnRenamed("docs", "more").hint("merge"), KEY, "full_outer")
        return self._run(both.select(*KEY, (F.coalesce("docs", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("docs")))

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        """One run of ``runs``, of what is not frequent yet; the keys that now are go to the frequent run."""
        self.compactions += 1
        runs = [self._unknown(run) for run in runs]
        while len(runs) > 1:
            runs = [self._two(*runs[i : i + 2]) if i + 1 < len(runs) else runs[i] for i in range(0, len(runs), 2)]
        reached = runs[0].filter(F.col("docs") >= self.least)
        # A key is in one of these two only.
        self.known = self._two(self.known, reached) if self.known is not None else self._run(reached)
        return runs[0].filter(F.col("docs") < self.least)

    def frequent(self) -> DataFrame:
        """(a, b, docs) of the lines that ``least`` documents hold; docs is what was counted until a key was known to be frequent."""
        left = [run for level in self.levels for run in level]
        if left:
            self.levels = [[] for _ in self.levels]
            self.levels.append([self._merged(left)])
        if self.known is None:
            return self.spark.createDataFrame([], "a long, b long, docs long")
        return self.known


def batches_of(table: DataFrame, most: int = 4) -> list[DataFrame]:
    """A table read from files as at most ``most`` batches of whole files."""
    files = sorted(table.inputFiles())
    if len(files) < 2:
        return [table]
    groups = [files[i::most] for i in range(min(most, len(files)))]
    return [table.sparkSession.read.schema(table.schema).parquet(*group) for group in groups]


def frequent_lines(batches: list[DataFrame], least: int = LEAST, fanout: int = FANOUT) -> DataFrame:
    """(a, b, docs) of the lines that at least ``least`` rows of all ``batches`` (text) hold."""
    runs = LineRuns(batches[0].sparkSession, least, fanout)
    for batch in batches:
        runs.add(batch)
    return runs.frequent()


def _hits(docs: DataFrame, frequent: DataFrame) -> DataFrame:
    """(ta, tb, gone): by hash of the text, the places of its frequent lines. Equal texts share a row."""
    of_text = [h.alias(f"t{h_}") for h, h_ in zip(hashes(F.coalesce("text", F.lit(""))), KEY, strict=True)]
    each = docs.select(*of_text, F.posexplode(lines(F.col("text"))).alias("place", "line"))
    each = each.select("ta", "tb", "place", key(F.col("line")).alias("key")).filter("key <> ''").select("ta", "tb", "place", *hashes(F.col("key")))
    if frequent.count() <= SENT_KEYS:
        met = each.join(F.broadcast(frequent.select(*KEY)), KEY)
    else:
        met = spread_join(each, frequent, KEY, "inner", rows="docs")
    return cut_lineage(met.groupBy("ta", "tb").agg(F.collect_set("place").alias("gone")))


def without_lines(docs: DataFrame, frequent: DataFrame) -> DataFrame:
    """Rows of ``docs`` as a struct ``given``, with n_lines, n_dropped, kept_text and kept_sha256.

    ``kept_text`` has the other lines in their order, joined by line breaks; null text counts as empty.
    """
    hits = _hits(docs, frequent)
    of_text = [h.alias(f"t{h_}") for h, h_ in zip(hashes(F.coalesce("text", F.lit(""))), KEY, strict=True)]
    # The text travels inside ``given`` alone. A group of copies shares one key; adaptive execution splits it.
    rows = docs.select(F.struct("*").alias("given"), *of_text).join(hits, ["ta", "tb"], "left")
    rows = rows.select("given", "gone", F.coalesce(F.col("given.text"), F.lit("")).alias("whole"))
    split = F.split("whole", "\n")
    places = F.array_except(F.sequence(F.lit(0), F.size("split") - 1), "gone")
    left = F.array_join(F.transform(places, lambda i: F.element_at(F.col("split"), i + 1)), "\n")
    rows = rows.withColumn("split", split).withColumn("kept_text", F.when(F.col("gone").isNull(), F.col("whole")).otherwise(left))
    return rows.select(
        "given", F.size("split").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        "kept_text", F.sha2("kept_text", 256).alias("kept_sha256"),
    )
