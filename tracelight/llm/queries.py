"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelight.llm import alignment, decontaminate, dimension_scan, lattice, lempel_ziv, licenses, line_runs, metric_codes, near_dup, ordinal, packing, tokens, url_rules
from tracelight.llm import text as T
from tracelight.llm.twins import TWINS

__all__ = ["QUERIES", "TWINS"]

# The rules of the url query.
RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lattice_scores(spark: SparkSession, folder: str) -> DataFrame:
    return lattice.score_documents(T.documents(spark, folder))


def lempel_ziv_spans(spark: SparkSession, folder: str) -> DataFrame:
    docs = T.documents(spark, folder).select("doc_id", "text")
    return lempel_ziv.without_copies(docs, 20).select("given.doc_id", "n_words", "n_removed", "kept_sha256")


def packed_sequences(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(T.documents(spark, folder))


def nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return dimension_scan.nearest(_table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def token_files(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_files(T.documents(spark, folder))


def page_licences(spark: SparkSession, folder: str) -> DataFrame:
    known = spark.createDataFrame(licenses.TEMPLATES, "licence string, text string")
    return licenses.scan(licenses.page_files(_table(spark, folder, "pages")), known).withColumnRenamed("id", "page_id")


def quality_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = T.documents(spark, folder).select("doc_id", "text")
    model = ordinal.fit(docs, ordinal.quality_grades(_table(spark, folder, "labels")))
    tail = F.col("tails")
    return ordinal.graded(docs, model).select(
        "given.doc_id", "score", "expected_grade", tail[0].alias("p_harmless"), tail[1].alias("p_clean"), (tail[1] >= 0.5).alias("kept")
    )


def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_dup.near_duplicates(T.documents(spark, folder), size=4, threshold=80)


def url_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_rules.judge(_table(spark, folder, "pages"), rules)


def benchmark_hits(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(T.documents(spark, folder), _table(spark, folder, "benchmark"), 10).drop("ranges")


def common_lines(spark: SparkSession, folder: str) -> DataFrame:
    docs = T.documents(spark, folder).select("doc_id", "text")
    frequent = line_runs.frequent_lines(line_runs.batches_of(docs), least=10)
    return line_runs.without_lines(docs, frequent).select("given.doc_id", "n_lines", "n_dropped", "kept_sha256")


def aligned_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.alignment(T.documents(spark, folder))


def vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return metric_codes.codes(_table(spark, folder, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_subword_lattice": lattice_scores,
    "op2_lempel_ziv_dedup": lempel_ziv_spans,
    "op3_genetic_packing": packed_sequences,
    "op4_dimension_scan": nearest_vectors,
    "op5_token_files": token_files,
    "op6_licence_scan": page_licences,
    "op7_ordinal_quality": quality_scores,
    "op8_tensored_minhash": near_duplicates,
    "op9_url_rules": url_verdicts,
    "op10_positional_index": benchmark_hits,
    "op11_line_runs": common_lines,
    "op12_token_alignment": aligned_tokens,
    "op13_metric_codes": vector_codes,
}
