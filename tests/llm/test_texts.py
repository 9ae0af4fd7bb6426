"""Substring dedup, near duplicates, decontamination and quality against brute force on hand-made rows."""

import hashlib
import re

import numpy as np
import pytest

from tests.llm.conftest import PASSAGE, corpus
from tracelight.llm import decontaminate, lempel_ziv, near_dup, ordinal
from tracelight.llm import text as T

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def by_id(rows):
    """The rows of a table as documents in order of id, null first, each id once."""
    seen = {}
    for i, t in rows:
        seen.setdefault(i, t)
    return sorted(seen.items(), key=lambda x: (x[0] is not None, x[0] or 0))


def cut_copies(rows, window):
    first, out = {}, {}
    for i, t in by_id(rows):
        w = SPACE.findall((t or "").encode())
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first.setdefault(tuple(w[k : k + window]), (i, k)) != (i, k):
                gone[k : k + window] = [True] * window
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("window", [20, 50])
def test_copies_are_cut_as_by_brute_force(docs, window):
    found = lempel_ziv.without_copies(docs, window).select("given.doc_id", "n_words", "n_removed", "kept_sha256", "given.score", "kept_text").collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found} == cut_copies(corpus(), window)
    assert len(found) == len(corpus()) and {r.score for r in found} == {"y"}
    assert next(r for r in found if r.doc_id == 11).kept_text == "other words and more of them"


def test_hot_anchors_go_by_window(spark, docs, monkeypatch):
    rows = [(i, f"{i} head {PASSAGE} tail {i} {i}") for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    found = lempel_ziv.without_copies(frame, 20).select("given.doc_id", "n_removed").collect()
    assert {r.doc_id: r.n_removed for r in found} == {i: 0 if i == 0 else 62 for i in range(3000)}


def test_windows_that_agree_on_half_a_hash_are_no_copies(spark):
    rng = np.random.default_rng(4)
    names = [f"v{i}" for i in range(500)]
    data = np.frombuffer(" ".join(names).encode(), np.uint8)
    starts, ends, _ = T.words(data, np.array([0, len(data)]), T.SPACE)
    hashes = T.word_hashes(data, starts, ends)
    # An anchor that is nearly always the smallest, then many windows that begin with it.
    heads = rng.integers(0, 500, (20_000, lempel_ziv.ANCHOR))
    powers = T.powers(T.STEP, 20)[:20]
    head = heads[np.argmin(T.mixed((hashes[heads] * powers[: lempel_ziv.ANCHOR]).sum(axis=1)))]
    rows = np.concatenate([np.tile(head, (300_000, 1)), rng.integers(0, 500, (300_000, 20 - len(head)))], axis=1)
    whole = T.mixed(sum(hashes[rows[:, k]] * powers[k] for k in range(20)))
    low = whole & np.uint64(2**32 - 1)
    order = np.argsort(low)
    at = np.flatnonzero((low[order][1:] == low[order][:-1]) & (whole[order][1:] != whole[order][:-1]))
    pairs = [(order[i], order[i + 1]) for i in at]
    pairs = [p for p in pairs if all(lempel_ziv._anchors(hashes[rows[x]], 20)[1][0] == 0 for x in p)]
    assert pairs
    texts = [" ".join(names[i] for i in rows[x]) for x in pairs[0]]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.n_removed for r in lempel_ziv.without_copies(frame, 20).collect()] == [0, 0]


def brute_groups(rows, size, threshold=80):
    sets = {}
    for i, t in by_id(rows):
        w = SPACE.findall((t or "").encode().translate(LOWER))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = list(sets)
    for n, x in enumerate(keys):
        for y in keys[:n]:
            both = len(sets[x] & sets[y])
            if both and 100 * both >= threshold * (len(sets[x]) + len(sets[y]) - both):
                a, b = sorted((find(x), find(y)), key=keys.index)
                root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("size", [4, 5])
def test_groups_are_those_of_brute_force(docs, size):
    found = near_dup.near_duplicates(docs, size).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_groups(corpus(), size)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found) and len(found) == len(by_id(corpus()))


def test_large_buckets_of_chained_texts_lose_no_link(spark):
    rng = np.random.default_rng(0)
    words = [f"v{i}" for i in range(400)]
    base = list(rng.choice(words, 120))
    rows = []
    for i in range(60):  # near copies of which neighbours alone are alike
        if i % 3 == 0:
            base[int(rng.integers(120))] = f"n{i}"
        text = list(base)
        text[int(rng.integers(120))] = f"o{i}"
        rows.append((i, " ".join(text)))
    found = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_groups(rows, 4)


def test_large_buckets_without_links_make_few_pairs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    words = [f"v{i}" for i in range(400)]
    base, rows = list(rng.choice(words, 200)), []

    def changed(text, n, mark):
        text = list(text)
        for at in rng.choice(len(text), n, replace=False):
            text[at] = f"{mark}x{at}"
        return text

    for i in range(60):  # all alike, but below the threshold; every third has one text that it is linked with
        text = changed(base, 5, f"a{i}")
        rows.append((i, " ".join(text)))
        if i % 3 == 0:
            rows.append((100 + i, " ".join(changed(text, 3, f"b{i}"))))
    asked, across = [], near_dup._across

    def counted(*args):
        pairs, later = across(*args)
        asked.append(pairs.count())
        return pairs, later

    monkeypatch.setattr(near_dup, "_across", counted)
    found = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_groups(rows, 4)
    assert asked and sum(asked) < len(rows)  # of 80 * 79 / 2


def brute_hits(rows, items, size):
    windows = {}
    for i, t in items:
        w = ALNUM.findall((t or "").encode().translate(LOWER))
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(i)
    out = {}
    for i, t in by_id(rows):
        w = ALNUM.findall((t or "").encode().translate(LOWER))
        hit, met = [False] * len(w), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit[k : k + n] = [True] * n
                    met |= windows[tuple(w[k : k + n])]
        out[i] = (len(w), sum(hit), len(met), hashlib.sha256(",".join(sorted(map(str, met))).encode()).hexdigest())
    return out


ITEMS = [(1, PASSAGE), (2, "ONE"), (20, "a, b; c!"), (3, None), (4, ""), (5, "quick brown fox jumps over the lazy dog while nine small birds"),
         (6, "same same same same same same same same same same same"), (7, "x1 w14 x2 w15 x3 w16 x4 w17 x5 w18"), (8, "never seen words at all"), (1, PASSAGE)]


def test_phrases_are_hit_as_by_brute_force(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontaminate.contamination(docs, items, 10).collect()
    want = brute_hits(corpus(), ITEMS, 10)
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in found} == want
    assert all(r.contaminated == (r.n_hit > 0) for r in found)


def test_proximity_needs_all_rare_words_close(spark):
    rows = spark.createDataFrame([(1, "alpha x beta y gamma"), (2, "alpha " + "x " * 30 + "beta gamma"), (3, "gamma beta alpha")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "alpha beta gamma")], "item_id long, text string")
    assert sorted({r.doc_id for r in decontaminate.near_matches(rows, items, 3, 10).collect()}) == [1, 3]


def test_quality_orders_held_out_rows(spark):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(1200):
        grade = int(rng.integers(3))
        words = [f"c{k}" for k in rng.integers(0, 300, 60)]
        if grade == 0:
            words = [w + "%%%" for w in words]
        if grade == 1:
            words[5] = "vile" + "abcdefgh"[int(rng.integers(8))]
        rows.append((i, " ".join(words)))
        labels.append((i, grade))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels[:900] + [(1, None), (None, 1), (99999, 0)], "doc_id long, grade int")
    out = ordinal.graded(frame, ordinal.fit(frame, known)).select("given.doc_id", "tails", "expected_grade").collect()
    right = [(r.tails[1] >= 0.5) == (labels[r.doc_id][1] == 2) for r in out if r.doc_id >= 900]
    assert np.mean(right) > 0.9 and all(r.tails[0] >= r.tails[1] for r in out)


def test_empty_tables(spark, docs, empty):
    items = spark.createDataFrame([], "item_id long, text string")
    assert near_dup.near_duplicates(empty).count() == 0
    assert lempel_ziv.without_copies(empty).count() == 0
    assert decontaminate.contamination(empty, items).count() == 0
    assert not decontaminate.contamination(docs, items).filter("contaminated").count()
    model = ordinal.fit(docs, spark.createDataFrame([], "doc_id long, grade int"))
    assert ordinal.graded(docs, model).filter("tails[1] > 0.5").count() == len(corpus())
    assert ordinal.graded(empty, model).count() == 0


def test_quality_fit_ends_at_the_optimum():
    """Against a dense search from another start: no feature can be moved to a smaller loss, and the rest stays at zero."""
    rng = np.random.default_rng(5)
    grade = rng.integers(0, 3, 300)
    rows = [np.unique(np.append(rng.integers(0, 40, 12), 60 + g)) for g in grade]
    start = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    model = ordinal.fit_rows(np.concatenate(rows).astype(np.int32), start, grade, 2)
    assert model.flat <= ordinal.FLAT
    x = np.zeros((300, 64))
    for i, r in enumerate(rows):
        x[i, r] = 1

    def total(weights, cuts):
        edge = np.concatenate([[-np.inf], cuts, [np.inf]])
        s = x @ weights
        p = 1 / (1 + np.exp(s - edge[grade + 1])) - 1 / (1 + np.exp(s - edge[grade]))
        return -np.log(p).mean() + ordinal.PENALTY * np.abs(weights).sum()

    weights = model.dense()[:64].astype(float)
    least = total(weights, model.thresholds)
    assert all(total(weights + e, model.thresholds) >= least - 1e-6 for j in range(64) for e in (0.02 * np.eye(64)[j], -0.02 * np.eye(64)[j]))
    assert weights[62] > 0 > weights[60] and np.diff(model.thresholds)[0] > 0


def test_rows_of_one_id_do_not_touch_each_other(spark):
    words = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    table = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    a, b, c = words("a", 40), words("b", 40), words("c", 40)
    # Each passage stays once, whatever rows share an id.
    for rows in ([(1, a), (5, a), (5, c), (6, c)], [(None, a), (None, a + " x"), (None, c), (None, b), (6, c)], [(5, a), (5, b), (5, a + " " + b)], [(5, a), (5, a), (6, a)]):
        out = lempel_ziv.without_copies(table(rows), 20).collect()
        kept = " ".join((r.kept_text if r.n_removed else r.given.text) for r in out).split()
        assert len(out) == len(rows) and {w for _, t in rows for w in t.split()} == set(kept)
        assert all(kept.count(w) == 1 or rows == [(5, a), (5, a), (6, a)] for w in kept)
    for seed in range(3):
        rows = [(1, a), (1, b + f" {seed}"), (2, b), (3, c), (None, c + " y"), (None, a + " y")]
        found = near_dup.near_duplicates(table(rows), 4, 80).collect()
        assert len(found) == 6 and sum(r.kept for r in found) == 3
        assert sorted((r.doc_id or 0, r.component_id or 0) for r in found) == sorted([(1, 0), (0, 0), (1, 1), (2, 1), (3, 0), (0, 0)])
    phrase = words("p", 10).split()
    items = spark.createDataFrame([(9, " ".join(phrase))], "item_id long, text string")
    rows = [(1, " ".join(phrase[:5])), (1, "q q q q q " + " ".join(phrase[5:])), (None, " ".join(phrase)), (None, "none"), (2, "x " + " ".join(phrase)), (2, " ".join(phrase[::-1]))]
    got = sorted(((r.doc_id or 0, r.n_words, r.n_hit) for r in decontaminate.contamination(table(rows), items, 10).collect()))
    assert got == [(0, 1, 0), (0, 10, 10), (1, 5, 0), (1, 10, 0), (2, 10, 0), (2, 11, 10)]
