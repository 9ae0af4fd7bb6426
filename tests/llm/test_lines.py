"""Line dedup against brute force: every case of batches, levels and rows."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracelight.llm import line_runs

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least):
    split = [(text or "").split("\n") for _, text in rows]
    keys = [[line.strip(" \t\n\x0b\x0c\r").translate(SMALL) for line in lines] for lines in split]
    held = Counter(k for one in keys for k in set(one))
    out = []
    for (doc, _), lines, own in zip(rows, split, keys, strict=True):
        left = [line for line, k in zip(lines, own, strict=True) if not k or held[k] < least]
        out.append((doc, len(lines), len(lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(out, key=repr)


def made(n=240):
    rng = random.Random(5)
    names = [f"Line {i} É" for i in range(60)] + ["", " ", "\t", "ÀB", "àb", "İ x", "K y"]
    rows = [(None, None), (7, ""), (7, "\n"), (None, "a\n\nA \n\ta"), (1, "x" * 70_000 + "\n" + "\n".join(f"u{i}" for i in range(20_000)))]
    for i in range(n):
        lines = [rng.choice(names[: 3 + i % 64]) for _ in range(rng.randint(0, 9))]
        lines = [rng.choice(["", " ", "\t\x0b", "\r"]) + rng.choice([x, x.upper(), x.lower()]) + rng.choice(["", "  ", "\x0c"]) for x in lines]
        rows.append((rng.choice([i, i, None, 7]), "\n".join([*lines, *(["common line"] if i % 3 == 0 else [])])))
    return rows


def got(frame, frequent):
    return sorted(((r[0], r[1], r[2], r[3]) for r in line_runs.without_lines(frame, frequent).select("given.doc_id", "n_lines", "n_dropped", "kept_sha256").collect()), key=repr)


@pytest.mark.parametrize("cuts,fanout,least", [(1, 2, 10), (5, 2, 10), (7, 3, 3), (3, 8, 1)])
def test_any_batches_give_the_lines_of_brute_force(spark, cuts, fanout, least):
    rows = made()
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"a": F.lit(1), "key": F.lit("k"), "given": F.lit(2), "gone": F.lit(3), "docs": F.lit(4)})
    batches = [spark.createDataFrame(rows[i::cuts], "doc_id long, text string") for i in range(cuts)]
    frequent = line_runs.frequent_lines(batches, least, fanout)
    assert got(frame, frequent) == brute(rows, least)


def test_levels_are_compacted_and_frequent_keys_are_counted_no_more(spark):
    batch = spark.createDataFrame([(i, f"same\nown {i}") for i in range(6)], "doc_id long, text string")
    other = spark.createDataFrame([(i, f"same\nnew {i}\nown 0") for i in range(6)], "doc_id long, text string")
    runs = line_runs.LineRuns(spark, least=5, fanout=2)
    runs.add(batch)
    assert [len(x) for x in runs.levels] == [1] and runs.known is None
    runs.add(other)
    assert [len(x) for x in runs.levels] == [0, 1] and runs.compactions == 1
    assert sorted(r.docs for r in runs.known.collect()) == [7, 12]
    for _ in range(2):
        runs.add(batch)
    # "same" and "own 0" meet the frequent run and are in no other one.
    known = {r.a for r in runs.known.collect()}
    assert not known & {r.a for level in runs.levels for run in level for r in run.collect()}
    assert [len(x) for x in runs.levels] == [0, 0, 1]
    assert runs.frequent().count() == 2


def test_beyond_the_keys_that_are_sent(spark, monkeypatch):
    monkeypatch.setattr(line_runs, "SENT_KEYS", 0)
    rows = made(100)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(frame, line_runs.frequent_lines([frame])) == brute(rows, 10)


def test_empty_table_and_blank_lines(spark, docs, empty):
    assert line_runs.without_lines(empty, line_runs.frequent_lines([empty])).count() == 0
    blank = spark.createDataFrame([(i, " \n\t") for i in range(30)], "doc_id long, text string")
    out = line_runs.without_lines(blank, line_runs.frequent_lines([blank])).collect()
    assert all(r.n_lines == 2 and r.n_dropped == 0 and r.kept_text == " \n\t" for r in out)
    assert line_runs.without_lines(docs, line_runs.frequent_lines([docs], 3)).count() == docs.count()
