"""Benchmark decontamination over a distributed positional inverted index.

The index holds postings (term, document, position) of training tokens. Each
window of a benchmark item is a phrase of ``size`` words (a shorter item is one
window). Its rarest two terms, by their counts over the whole corpus, open the
search: their posting lists, shifted by the term's place in the phrase, are
intersected on (document, start). What is left names the documents whose other
postings are fetched; every remaining term must then stand at its own shifted
place. Only terms of the benchmark have postings, since no other can meet a list.

Everything is DataFrame work. Words are counted before anything is joined, lists
are joined on (document, start), and candidates come from the rarest term, so a
frequent word or a passage in a third of the documents meets no list as a whole.

Nulls have no words and are never hit; benchmark items that repeat a phrase share
its search. Rows with a null or repeated id are told apart by their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelight.llm import text as T
from tracelight.session import cut_lineage

#: Benchmark terms that may be sent to every executor; more are joined by a shuffle.
BROADCAST_TERMS = 200_000

# What separates words, upper and lower case letters.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(text: Column) -> Column:
    """Words of a text with A-Z in lower case (other letters stay as they are), and an empty part where a separator opens or closes it."""
    text = F.coalesce(text, F.lit(""))
    # lower() may change letters beyond A-Z, so only plain ASCII texts take it.
    return F.split(F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, SMALL)).otherwise(F.lower(text)), SEPARATOR)


def words(text: Column) -> Column:
    return F.filter(parts(text), lambda x: x != "")


def phrases(items: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(phrase, words) of all distinct windows, and (phrase, item_id) of the items that hold them."""
    listed = items.select(F.col("item_id"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    each = listed.select("item_id", "w", F.explode(starts).alias("s")).select("item_id", F.slice("w", F.col("s"), size).alias("words"))
    each = cut_lineage(each.select("item_id", F.concat_ws(" ", "words").alias("phrase"), "words").distinct())
    return each.select("phrase", "words").distinct(), each.select("phrase", "item_id")


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, doc_id, pos) of the corpus for the given terms, kept while they stream past.

    Positions of a text that opens with a separator start at 1, for all its terms alike.
    """
    held = terms.select("term")
    if held.count() <= BROADCAST_TERMS:
        held = F.broadcast(held)
    every = docs.select("doc_id", F.posexplode(parts(F.col("text"))).alias("pos", "term"))
    return every.join(held, "term").select("term", "doc_id", "pos")


def hits(docs: DataFrame, items: DataFrame, size: int = 10) -> tuple[DataFrame, DataFrame]:
    """Exact phrase matches: (doc_id, start, phrase), and the phrases' items.

    ``docs`` has doc_id and text without nulls.
    """
    spans, owners = phrases(items, size)
    spans = cut_lineage(spans)
    places = cut_lineage(spans.select("phrase", F.posexplode("words").alias("offset", "term")))
    terms = cut_lineage(places.select("term").distinct())

    # Only the names of the terms meet the corpus here; every task sends one count for each.
    found = docs.select(F.explode(parts(F.col("text"))).alias("term"))
    held = F.broadcast(terms) if terms.count() <= BROADCAST_TERMS else terms
    counts = found.join(held, "term").groupBy("term").agg(F.count("*").alias("n"))
    counted = places.join(cut_lineage(counts), "term", "left").fillna(0, ["n"])
    # A phrase with a term that the corpus lacks occurs nowhere.
    order = Window.partitionBy("phrase").orderBy("n", "term", "offset")
    ranked = cut_lineage(counted.withColumn("rank", F.row_number().over(order)).withColumn("least", F.min("n").over(Window.partitionBy("phrase"))))
    ranked = ranked.filter("least > 0")
    rare = cut_lineage(ranked.filter("rank <= 2").select("phrase", "offset", "term", "rank"))
    second = rare.groupBy("phrase").agg(F.max("rank").alias("lists"))

    index = cut_lineage(postings(docs, rare.select("term").distinct()))
    shifted = index.join(rare.join(second, "phrase"), "term").select(
        "doc_id", (F.col("pos") - F.col("offset")).alias("start"), "phrase", "rank", "lists").filter("start >= 0")
    open_ = shifted.groupBy("doc_id", "start", "phrase").agg(F.countDistinct("rank").alias("met"), F.first("lists").alias("lists"))
    open_ = cut_lineage(open_.filter("met = lists").select("doc_id", "start", "phrase"))

    rest = ranked.filter("rank > 2").select("phrase", "offset", "term")
    sought = open_.join(rest, "phrase").select("doc_id", (F.col("start") + F.col("offset")).alias("pos"), "term", "start", "phrase")
    wanted = open_.select("doc_id").distinct()
    other = postings(docs.join(wanted, "doc_id", "left_semi"), rest.select("term").distinct())
    met = sought.join(other, ["doc_id", "pos", "term"]).groupBy("doc_id", "start", "phrase").agg(F.countDistinct("pos").alias("met"))
    length = spans.select("phrase", F.size("words").alias("length"))
    full = open_.join(met, ["doc_id", "start", "phrase"], "left").join(length, "phrase")
    full = full.filter(F.coalesce("met", F.lit(0)) + F.least(F.lit(2), "length") == F.col("length"))
    return cut_lineage(full.select("doc_id", "start", "phrase", "length")), owners


def near_matches(docs: DataFrame, items: DataFrame, terms: int = 3, within: int = 10) -> DataFrame:
    """Proximity matches: (doc_id, item_id, start) where an item's rarest ``terms`` words all stand within ``within`` words.

    The window starts at a posting of the rarest of them and looks both ways; items
    of fewer distinct words use all they have.
    """
    docs = T.keyed_texts(docs)
    words_ = items.select("item_id", F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
    index = postings(docs, words_.select("term").distinct())
    counts = index.groupBy("term").agg(F.count("*").alias("n"))
    order = Window.partitionBy("item_id").orderBy(F.coalesce("n", F.lit(0)), "term")
    rare = cut_lineage(words_.join(counts, "term", "left").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= terms))
    lists = rare.groupBy("item_id").agg(F.count("*").alias("lists"))
    met = index.join(rare, "term").select("doc_id", "item_id", "rank", "pos")
    first = met.filter("rank = 1").select("doc_id", "item_id", F.col("pos").alias("start"))
    # Each posting looks only at the cells of ``within`` words around it.
    cells = first.withColumn("cell", F.explode(F.array(*[F.floor(F.col("start") / within) + k for k in (-1, 0, 1)])))
    other = met.withColumn("cell", F.floor(F.col("pos") / within))
    near = cells.join(other, ["doc_id", "item_id", "cell"]).filter(F.abs(F.col("pos") - F.col("start")) < within)
    full = near.groupBy("doc_id", "item_id", "start").agg(F.countDistinct("rank").alias("met")).join(lists, "item_id").filter("met = lists")
    return full.select(T.given_id(), "item_id", "start")


def contamination(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the hit word ranges (start, stop)."""
    texts = T.separated(docs)[0]
    found, owners = hits(texts.select("doc_id", "text"), items, size)
    # Hit words: the union of [start, start + length) by document, from starts in order.
    spans = found.groupBy("doc_id", "start").agg(F.max("length").alias("length"))
    order = Window.partitionBy("doc_id").orderBy("start")
    stop = F.max(F.col("start") + F.col("length")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("start") + F.col("length") - F.greatest("start", F.coalesce(stop, F.lit(0))))
    hit = spans.withColumn("fresh", fresh).groupBy("doc_id").agg(
        F.sum("fresh").alias("n_hit"), F.sort_array(F.collect_list(F.struct("start", (F.col("start") + F.col("length")).alias("stop")))).alias("ranges"))
    listed = found.select("doc_id", "phrase").join(owners, "phrase").select("doc_id", F.col("item_id").cast("string").alias("item")).distinct()
    listed = listed.groupBy("doc_id").agg(F.sort_array(F.collect_list("item")).alias("items"))
    marked = cut_lineage(hit.join(listed, "doc_id", "left"))
    counted = texts.select("doc_id", "given_id", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    return counted.join(marked, "doc_id", "left").select(
        F.col("given_id").alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items_).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items_), 256).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"), "ranges",
    )
