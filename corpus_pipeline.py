"""From raw documents to packed sequences: stages that each write a table and read it back.

Every stage works on all rows its predecessor kept and returns the columns of
``documents``; the last returns token pieces in sequences. Every row is a document
of its own, also where ids are null or repeated (rows with the same id and text are
told apart by the near-duplicate stage, which keeps one); null text counts as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelight.llm import decontaminate, lempel_ziv, near_dup, ordinal, packing
from tracelight.llm import text as T
from tracelight.session import cut_lineage

#: Least probability of the highest grade (sound and clean) that keeps a document.
CLEAN = 0.5
#: Words in a repeated passage that goes, and in a benchmark passage that makes a document go.
PASSAGE, PHRASE = 50, 10


def _numbered(docs: DataFrame) -> DataFrame:
    """Rows as a written table: ``row``, a number of its own, and ``given``."""
    return cut_lineage(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("given")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier puts in the highest grade; poor and toxic ones go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = ordinal.fit(docs, ordinal.quality_grades(labels))
    return ordinal.graded(docs, model).filter(F.element_at("tails", -1) >= CLEAN).select("given.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that of the smallest id: five words, similarity 0.8."""
    rows = _numbered(docs)
    found = near_dup.near_duplicates(rows.select(F.col("row").alias("doc_id"), "given.text"), size=5, threshold=80)
    ids = rows.select("row", F.coalesce(F.col("given.doc_id").cast("long"), F.lit(T.NO_ID)).alias("id"))
    found = found.select(F.col("doc_id").alias("row"), "component_id").join(ids, "row")
    first = found.groupBy("component_id").agg(F.min(F.struct("id", "row")).alias("first")).select("first.row")
    return rows.join(first, "row", "left_semi").select("given.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur earlier; what is left empty goes."""
    found = lempel_ziv.without_copies(docs, PASSAGE).filter("n_removed < n_words or n_removed = 0")
    text = F.coalesce("kept_text", F.col("given.text"))
    new = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.length(text).cast("long")).otherwise(F.col("given.n_chars"))}
    return found.select(*[new.get(c, F.col("given").getField(c)).alias(c) for c in docs.columns])


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = _numbered(docs)
    texts = T.keyed_texts(rows.select(F.col("row").alias("doc_id"), "given.text"))
    hit = decontaminate.hits(texts, items, PHRASE)[0].select(F.col("doc_id").alias("row")).distinct()
    return rows.join(hit, "row", "left_anti").select("given.*")


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the kept documents in sequences of at most 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("sequences", sequences),
]

#: SQL has no form for the classifier, the minhash components or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = T.documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
