"""Metric trees and codes against brute force."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelight.llm import metric_codes


def brute(rows, parts=16, entries=64, rounds=2):
    """(vec_id, code, error, label_error, digest) by plain loops over all entries."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    longest = max(len(r[1]) for r in kept)
    width = max(1, -(-longest // parts)) * parts
    x = np.zeros((len(kept), width), np.int64)
    for i, r in enumerate(kept):
        x[i, : len(r[1])] = [max(-(2**26), min(2**26, math.floor(256 * v))) for v in r[1]]
    x = x.reshape(len(kept), parts, -1)
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))
    books = [x[order[:entries], p].copy() for p in range(parts)]
    near = lambda p: ((x[:, p, None, :] - books[p][None]) ** 2).sum(axis=2)
    for _ in range(rounds):
        for p in range(parts):
            label = near(p).argmin(axis=1)
            for e in range(len(books[p])):
                if (label == e).any():
                    books[p][e] = x[label == e, p].sum(axis=0) // int((label == e).sum())
    gaps = [near(p) for p in range(parts)]
    codes = ["".join(f"{g[i].argmin():02x}" for g in gaps) for i in range(len(kept))]
    errors = [int(sum(g[i].min() for g in gaps)) for i in range(len(kept))]
    whole = {}
    for r, e in zip(kept, errors, strict=True):
        whole[r[2]] = whole.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel()).encode()).hexdigest()
    return sorted(((r[0], c, e, whole[r[2]], digest) for r, c, e in zip(kept, codes, errors, strict=True)), key=repr)


def vectors(n, size, seed=0, labels=5):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 1, (7, size))
    rows = []
    for i in range(n):
        v = (middle[rng.integers(7)] + rng.normal(0, 0.05, size)).round(3).tolist()
        label = int(rng.integers(labels))
        rows.append((i * 3, v, None if label == 0 else label))
    return rows


@pytest.mark.parametrize("size", [16, 64, 20])
def test_codes_are_those_of_brute_force(spark, size):
    rows = vectors(700, size, size)
    rows += [(-1, None, 1), (-2, [None] * size, 1), (-3, [float("nan")] * size, 1), (-4, [float("inf")] + [0.0] * (size - 1), 2)]
    rows += [(9, rows[3][1], 1), (9, rows[3][1], 1), (None, rows[5][1], None), (5000, [1e30, -1e30] * (size // 2), 3)] + [(6000 + i, rows[0][1], 4) for i in range(300)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"vector": F.lit(1), "code": F.lit("c"), "error": F.lit(2), "part": F.lit(0)})
    got = sorted((tuple(r) for r in metric_codes.codes(frame.repartition(3)).collect()), key=repr)
    assert got == brute(rows)


def test_few_equal_and_no_vectors(spark):
    kind = "vec_id long, embedding array<float>, label string"
    few = [(i, [float(i % 3)] * 32, "x") for i in range(5)]
    same = [(i, [0.25] * 16, None) for i in range(3000)]
    mixed = [(1, [], "a"), (2, [0.5], "a"), (3, [0.5] * 17, "b")]
    for rows in (few, same, mixed):
        got = sorted((tuple(r) for r in metric_codes.codes(spark.createDataFrame(rows, kind)).collect()), key=repr)
        assert got == brute(rows)
    assert metric_codes.codes(spark.createDataFrame([], kind)).count() == 0
    assert metric_codes.codes(spark.createDataFrame([(1, None, "a")], kind)).count() == 0


def test_balls_hold_their_points_and_sums():
    rng = np.random.default_rng(3)
    x = rng.integers(-400, 400, (900, 4))
    x[100:300] = x[50]
    tree = metric_codes.Tree.build(x)
    assert np.array_equal(np.sort(tree.order), np.arange(900)) and np.array_equal(tree.points, x[tree.order])
    for node in tree.nodes:
        own = tree.points[node["start"] : node["end"]]
        assert np.array_equal(own.sum(axis=0), node["sum"])
        assert np.sqrt(((own - own.mean(axis=0)) ** 2).sum(axis=1)).max() <= node["radius"] + 1e-9
        if node["left"] >= 0:
            left, right = tree.nodes[node["left"]], tree.nodes[node["right"]]
            assert (left["start"], right["end"], left["end"]) == (node["start"], node["end"], right["start"])


def test_balls_are_owned_and_lists_shrink(monkeypatch):
    """Well parted groups are settled above the leaves: few points are compared one by one."""
    rng = np.random.default_rng(4)
    middle = rng.integers(-20000, 20000, (64, 4))
    x = middle[rng.integers(64, size=2000)] + rng.integers(-9, 10, (2000, 4))
    looked = []
    nearest = metric_codes._nearest
    monkeypatch.setattr(metric_codes, "_nearest", lambda p, e, listed: looked.append(listed.sum()) or nearest(p, e, listed))
    sums, counts, label = metric_codes.Tree.build(x).assign(middle, labels=True)
    expected = ((x[:, None] - middle[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert np.array_equal(counts, np.bincount(expected, minlength=64)) and sum(looked) < 2000 * 64 // 50
    assert np.array_equal(sums, np.array([x[expected == e].sum(axis=0) for e in range(64)]))


def test_ties_go_to_the_lower_entry():
    x = np.array([[0, 0], [2, 0], [1, 0], [1, 0]] * 20)
    entries = np.array([[2, 0], [0, 0], [0, 0], [2, 0]])
    tree = metric_codes.Tree.build(x, leaf=2)
    label = tree.assign(entries, labels=True)[2]
    out = np.zeros(len(x), int)
    out[tree.order] = label
    assert out.tolist() == [1, 0, 0, 0] * 20
