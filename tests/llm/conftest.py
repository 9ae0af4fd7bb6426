import pytest
from pyspark.sql import functions as F

# Hand-made rows: nulls, empty and blank texts, ties, repeated rows, one very long text, copies, odd white space.
BASE = "the quick brown fox jumps over the lazy dog while nine small birds sing above every old stone wall near our quiet river bank"
PASSAGE = " ".join(f"p{i}" for i in range(60))


def corpus():
    long = " ".join(f"w{i % 997} x{i % 13}" for i in range(40_000))
    return [
        (1, BASE), (2, BASE), (3, BASE + " today"), (4, None), (5, ""), (6, " \t\n "), (7, "one"), (8, "One"), (9, "a b c"),
        (10, f"start {PASSAGE} end"), (11, f"other words {PASSAGE} and more of them"), (12, long), (13, "é É ß ünï  日本語\u00a0x\n\nlast "),
        (None, BASE + " nobody"), (15, "same same same same " * 12), (16, "MIXED Case TEXT, with! signs? 42 times"), (17, BASE.upper()), (7, "one"),
    ]


@pytest.fixture(scope="session")
def docs(spark):
    """``documents`` with columns that clash with names the operators use."""
    frame = spark.createDataFrame(corpus(), "doc_id long, text string")
    return frame.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.length("text").cast("long"),
                              "row": F.lit(1), "kept": F.lit("x"), "spans": F.lit(2), "score": F.lit("y"), "term": F.lit("z"), "given": F.lit(0)})


@pytest.fixture(scope="session")
def empty(docs):
    return docs.filter("doc_id = -1")
