"""URL rules by a sort-merge range join.

Canonical keys make a prefix an interval: the host's labels in reverse order, each
closed by a separator, so that a host and all its subdomains lie in one interval
of the sorted hosts; paths, under the host of their rule, likewise. Intervals of
prefixes are nested or apart. One sorted sweep over the interval ends and the keys
keeps a stack of the active intervals: the depth of the stack is the running sum
of +1 and -1, and the top of the stack at depth d is the last interval that opened
at depth d. Rows are dealt by range of key, so a hot host is cut; each range
learns its depth and its open intervals from sums over the ranges before it.

A first sweep finds the innermost host that has rules, a second one the longest
path rule at each of its enclosing hosts. The rule of most characters (host and
path) wins, then the longer host; of equal rules, block wins over allow.

Host: what lies between the first ``://`` and the next ``/``, ``?``, ``#`` or the end,
A-Z in lower case; path: from there up to ``?``, ``#`` or the end. A url that is null or
has no ``://`` has an empty host and path and no rule. No rule gives the verdict
``default`` (allow). Rules that are null in host, path or verdict are left out. Rows
that repeat an id are judged one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelight.llm import text as T
from tracelight.llm.decontaminate import SMALL, UPPER
from tracelight.session import cut_lineage

# An opening sorts before the keys that equal it, a closing after all keys with its prefix.
CLOSE, OPEN, POINT = 0, 1, 2


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    host = F.translate(F.substring_index(F.substring_index(F.substring_index(rest, "/", 1), "?", 1), "#", 1), UPPER, SMALL)
    host = F.coalesce(host, F.lit(""))
    tail = F.substr(rest, F.length(host) + F.lit(1))
    path = F.substring_index(F.substring_index(tail, "?", 1), "#", 1)
    return host, F.coalesce(path, F.lit(""))


def host_key(host: Column) -> Column:
    """Labels from the last to the first, each closed by a separator that no label holds."""
    host = F.translate(host, "\x01\x02", "\x03\x03")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "\x01"), F.lit("\x01"))


def innermost(points: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``points`` (key, ...) with ``top``: the longest of ``prefixes`` (key, distinct) that starts the key, or null."""
    spark = points.sparkSession
    raw = F.col("key").cast("binary")
    carried = [c for c in points.columns if c != "key"]
    empty = [F.lit(None).cast(points.schema[c].dataType).alias(c) for c in carried]
    opens = prefixes.select(raw.alias("at"), F.lit(OPEN).alias("kind"), F.lit(1).alias("step"), "key", *empty)
    # No byte of a text is as large as 0xFF.
    closes = prefixes.select(F.concat(raw, F.lit(b"\xff")).alias("at"), F.lit(CLOSE).alias("kind"), F.lit(-1).alias("step"), "key", *empty)
    asks = points.select(raw.alias("at"), F.lit(POINT).alias("kind"), F.lit(0).alias("step"), "key", *carried)
    events = opens.unionByName(closes).unionByName(asks).withColumn("tie", F.xxhash64("key", *carried))
    # Equal keys may be many: the tie spreads them over ranges too.
    dealt = events.repartitionByRange(T.partitions(spark), "at", "kind", "tie").withColumn("chunk", F.spark_partition_id())
    swept = cut_lineage(dealt)

    sums = swept.groupBy("chunk").agg(F.sum("step").alias("sum"))  # one row for each range
    before = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("chunk", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))
    along = Window.partitionBy("chunk").orderBy("at", "kind", "tie")
    level = swept.join(F.broadcast(base), "chunk").withColumn("depth", F.col("base") + F.sum("step").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    # The stack: at each depth the last interval that opened there.
    opened = F.when(F.col("kind") == OPEN, F.col("key"))
    stack = Window.partitionBy("chunk", "depth").orderBy("at", "kind", "tie").rowsBetween(Window.unboundedPreceding, 0)
    placed = level.withColumn("own", F.last(opened, ignorenulls=True).over(stack)).filter(F.col("kind") == POINT)

    # Of earlier ranges, what each left open at a depth: few rows, by ranges and depths.
    left = level.filter(F.col("kind") == OPEN).groupBy("chunk", "depth").agg(F.max_by("key", "at").alias("last"))
    asked = placed.filter("own is null and depth > 0").select("chunk", "depth").distinct()
    both = left.select("chunk", "depth", "last", F.lit(1).alias("late")).unionByName(asked.select("chunk", "depth", F.lit(None).cast("string").alias("last"), F.lit(0).alias("late")))
    carry = Window.partitionBy("depth").orderBy("chunk", "late").rowsBetween(Window.unboundedPreceding, 0)
    before = both.withColumn("before", F.last("last", ignorenulls=True).over(carry)).filter("late = 0").select("chunk", "depth", "before")
    found = placed.join(before, ["chunk", "depth"], "left")
    top = F.when(F.col("depth") > 0, F.coalesce("own", "before"))
    return found.select("key", *carried, top.alias("top"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Per page: page_id, host, path, rule (its text) and verdict. ``rules``: (host, path, verdict)."""
    rules = rules.select(F.translate(F.col("host"), UPPER, SMALL).alias("host"), "path", "verdict").dropna()
    rules = cut_lineage(rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).withColumn("node", host_key(F.col("host"))))
    nodes = rules.select("node").distinct()
    # Every host that has rules with those of its enclosing hosts that have some: at most one for each label.
    labels = F.split(F.expr("substr(node, 1, length(node) - 1)"), "\x01")
    above = nodes.select("node", labels.alias("l")).select("node", F.explode(F.sequence(F.lit(1), F.size("l"))).alias("n"), "l")
    above = above.select("node", F.concat(F.array_join(F.slice("l", 1, F.col("n")), "\x01"), F.lit("\x01")).alias("outer"))
    chains = above.join(nodes.select(F.col("node").alias("outer")), "outer").select(F.col("node").alias("top"), "outer")

    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    split = cut_lineage(split.withColumn("row", F.monotonically_increasing_id()))
    placed = innermost(split.select(host_key(F.col("host")).alias("key"), "row", "path"), nodes.select(F.col("node").alias("key")))
    # Nodes are few beside pages; equal tops are many, so the join may split them.
    asks = placed.filter("top is not null").join(chains, "top")
    asks = asks.select(F.concat("outer", F.lit("\x02"), "path").alias("key"), "row")
    named = rules.select(F.concat("node", F.lit("\x02"), "path").alias("top"), F.concat("host", "path").alias("rule"), "verdict", F.length("host").alias("long"))
    best = innermost(asks, named.select(F.col("top").alias("key"))).filter("top is not null").join(named, "top")
    order = F.struct(F.length("rule").alias("a"), F.col("long").alias("b"), F.col("rule").alias("rule"), F.col("verdict").alias("verdict"))
    won = best.groupBy("row").agg(F.max(order).alias("won")).select("row", "won.rule", "won.verdict")
    return split.join(won, "row", "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
