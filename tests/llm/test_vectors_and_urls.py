"""Vector search, URL rules and licences against brute force on hand-made rows."""

import numpy as np
from pyspark.sql import functions as F

from tracelight.llm import dimension_scan, licenses, url_rules


def brute_nearest(rows, k):
    fine = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and None not in v and len(v) == 8 and np.isfinite(v).all() and np.any(v)}
    ids = np.array(sorted(fine))
    x = np.stack([fine[i] for i in ids])
    out = {}
    for i in ids[ids % 20 == 0]:
        score = x @ fine[i]
        order = [n for n in np.lexsort((ids, -score)) if ids[n] != i][:k]
        out[int(i)] = [(int(ids[n]), score[n]) for n in order]
    return out


def vectors(n):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(8).astype(np.float32).tolist()) for i in range(n)]
    for i in range(100, 180):  # one vector many times
        rows[i] = (i, rows[100][1])
    odd = [(None, rows[0][1]), (n, None), (n + 1, [0.0] * 8), (n + 2, [1.0] * 7), (n + 3, [float("nan")] + [1.0] * 7), (n + 4, [None] + [1.0] * 7),
           (n + 5, [float("inf")] + [1.0] * 7), (20, rows[20][1])]
    return rows + odd


def test_nearest_by_inner_product(spark):
    rows = vectors(1000)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"label": F.lit(1), "rep": F.lit("x"), "score": F.lit(None).cast("int")})
    want = brute_nearest(rows, 20)
    # All lists probed: only the dimension tests may lose a neighbour.
    got = {}
    for r in dimension_scan.nearest(frame, F.col("vec_id") % 20 == 0, 20, probed=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(want)
    hit = [len({v for _, v, _ in got[q]} & {v for v, _ in want[q]}) / 20 for q in want]
    assert np.mean(hit) > 0.97 and all([n for n, _, _ in got[q]] == list(range(1, 21)) for q in got)
    for q in (100, 120, 160):  # ties: the smallest ids
        assert [v for _, v, _ in got[q]] == [v for v, _ in want[q]]
    assert all(np.isclose(s, dict(want[q])[v]) for q in got for _, v, s in got[q] if v in dict(want[q]))


def test_measured_probes_reach_the_recall(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((2500, 24))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in dimension_scan.nearest(frame, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = []
    for q in range(0, 2500, 20):
        score = x @ x[q]
        score[q] = -np.inf
        hit.append(len(got[q] & set(np.argsort(-score)[:20].tolist())) / 20)
    assert np.mean(hit) >= 0.9


def test_few_vectors_and_none(spark):
    kind = "vec_id long, embedding array<float>"
    few = dimension_scan.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 1.0]), (2, [0.5, 0.5])], kind), F.col("vec_id") % 20 == 0)
    assert [(r.rank, r.vec_id, r.score) for r in few.orderBy("rank").collect()] == [(1, 1, 2.0), (2, 2, 0.5)]
    assert dimension_scan.nearest(spark.createDataFrame([], kind), F.col("vec_id") % 20 == 0).count() == 0


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"),
         ("b.com", "/", "allow"), ("b.com", "/de/x", "block"), ("b.com", "/de/x", "allow"), (None, "/", "block"), ("x.net", "", "block")]
URLS = ["http://a.example.org/es/1", "https://EXAMPLE.org/en/12?x=1#y", "http://example.org/en/2", "http://notexample.org/es/", "http://a.b.com/de/x1", "http://b.com/fr/",
        "http://com/de/", "http://zcom/de/", "https://m.c.com/fr", "x.net/a", "http://x.net", "http://x.net?q://r", None, "", "://", "http://", "http://a.x.net/\uffff",
        "ftp://org", "http://org/", "a://b.com/de/x"] * 2


def verdict(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:n].lower(), rest[n:]
    path = tail.split("?")[0].split("#")[0]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in RULES if h is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_rules_by_the_sweep(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumns({"host": F.lit(1), "rule": F.lit(2), "key": F.lit("k"), "row": F.lit(0)})
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(pages, rules).collect()}
    assert got == {i: verdict(u) for i, u in enumerate(URLS)}
    assert url_rules.judge(pages.filter("page_id < 0"), rules).count() == 0
    assert {r.verdict for r in url_rules.judge(pages, rules.filter("host = 'none'"), "block").collect()} == {"block"}


def test_innermost_prefix_on_many_nested_keys(spark):
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("ab"), int(n))) for n in rng.integers(1, 9, 300)]
    prefixes = sorted(set(words))
    points = ["".join(rng.choice(list("abc"), int(n))) for n in rng.integers(0, 12, 2000)]
    frame = spark.createDataFrame([(p, i) for i, p in enumerate(points)], "key string, n long")
    got = {r.n: r.top for r in url_rules.innermost(frame, spark.createDataFrame([(p,) for p in prefixes], "key string")).collect()}
    assert got == {i: max((q for q in prefixes if p.startswith(q)), key=len, default=None) for i, p in enumerate(points)}


def test_licences_and_their_directories(spark):
    prose = "once upon a time there was a river and a bridge under which nobody was"
    rows = [
        (1, "h/a/LICENSE", f"Released under the MIT License.\n{prose}", 1), (2, "h/a/b/x", prose, 1), (3, "h/a/b/y", f"{prose}\nLicensed under the Apache License, Version 2.0.", 0),
        (4, "h/c/z", prose, 1), (5, None, "Licensed under CC BY-NC 4.0.", 0), (6, "h/d/", None, 1), (7, "h/a/b/c/", "", 1), (8, "noslash", prose, 1), (2, "h/a/b/x", prose, 1),
        (9, "h/a/b/c/COPYING", "This work is licensed under the GNU General Public License, version 3.", 1), (10, "h/a/b/c/d/e", prose, 1),
    ]
    files = spark.createDataFrame(rows, "id long, path string, text string, header_blocks int").withColumn("licence", F.lit("clash"))
    known = spark.createDataFrame(licenses.TEMPLATES, "licence string, text string")
    got = {r.id: (r.own_licence, r.licence, r.origin, r.origin_dir) for r in licenses.scan(files, known).collect()}
    mit = (None, "MIT", "inherited", "h/a/")
    gpl = (None, "GPL-3.0", "inherited", "h/a/b/c/")
    none = (None, None, None, None)
    assert got == {1: ("MIT", "MIT", "own", None), 2: mit, 3: ("Apache-2.0", "Apache-2.0", "own", None), 4: none, 5: ("CC-BY-NC-4.0", "CC-BY-NC-4.0", "own", None),
                   6: none, 7: gpl, 8: none, 9: ("GPL-3.0", "GPL-3.0", "own", None), 10: gpl}
    assert licenses.scan(files.filter("id < 0"), known).count() == 0


def test_pages_state_and_inherit_licences(spark):
    from tracelight.llm.queries import QUERIES

    prose = "<p>once upon a time there was a <b>river</b> and a bridge</p>"
    rows = [
        (1, "http://a.org/x/1", f"<title>t</title>{prose}<p>Licensed\nunder <a href='u'>CC BY 4.0</a>.</p><footer>&copy; a.org</footer>"), (2, "http://a.org/x/2", prose),
        (3, "http://b.org/x/1", f"<!-- Released under the MIT License. -->{prose}"), (4, "http://b.org/x/y/2", prose),
        (5, "http://c.org/1", f"<script>/*\n * Some code\n *\n * Licensed under the Apache License,\n * Version 2.0.\n */ f()</script>{prose}"), (6, "http://c.org/2", prose),
        (7, "http://d.org/1", f"{prose}<p>Licensed under CC BY-NC 4.0.</p>{prose}"), (8, "http://d.org/2", prose), (9, "http://e.org/1", None),
        (10, "http://f.org/1", f"{prose}<footer>all that was ever told of this river by <a>Licensed under CC BY-SA 4.0.</a> and others</footer>"), (11, "http://f.org/2", ""),
    ]
    known = spark.createDataFrame(licenses.TEMPLATES, "licence string, text string")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.id: (r.licence, r.origin) for r in licenses.scan(licenses.page_files(pages), known).collect()}
    assert got == {1: ("CC-BY-4.0", "own"), 2: ("CC-BY-4.0", "inherited"), 3: ("MIT", "own"), 4: ("MIT", "inherited"), 5: ("Apache-2.0", "own"), 6: ("Apache-2.0", "inherited"),
                   7: ("CC-BY-NC-4.0", "own"), 8: (None, None), 9: (None, None), 10: ("CC-BY-SA-4.0", "own"), 11: ("CC-BY-SA-4.0", "inherited")}
    given = QUERIES["op6_licence_scan"](spark, "/root/testdata/sf0.1").groupBy("origin").count().collect()
    print({r.origin: r["count"] for r in given})
    assert all({r.origin: r["count"] for r in given}.get(o) for o in ("own", "inherited"))


def test_scores_are_the_brute_force_cosines(spark):
    import math
    import re
    from collections import Counter, defaultdict

    whole = defaultdict(list)
    for name, text in licenses.TEMPLATES:
        whole[name].append(text)
    texts = ["\n\n".join(parts) for parts in whole.values()]
    texts += ["once upon a time\nthe software is a license of the terms", "", "This program is free software under the GNU license, version 3 or any later version.", texts[0].upper()]
    spelled = lambda t: [x for x in re.split(r"[^\w.]+|_+|\.(?!\d)", t.lower()) if x]
    blocks = [(i, j, spelled(b)) for i, t in enumerate(texts) for j, b in enumerate(re.split(r"\n\s*", t))]
    known = {t for _, text in licenses.TEMPLATES for t in spelled(text)}
    df = Counter(t for i in range(len(texts)) for t in {x for k, _, b in blocks if k == i for x in b} & known)
    idf = lambda t: math.log((len(texts) + 1) / (df[t] + 0.5)) if t in known else math.log((len(texts) + 1) / 0.5)
    vector = lambda b: {t: n * idf(t) for t, n in Counter(b).items()}
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))
    expected = {}
    for i, j, b in blocks:
        v = vector(b)
        for name, text in licenses.TEMPLATES:
            w = vector(spelled(text))
            if v and (score := round(sum(x * w.get(t, 0) for t, x in v.items()) / (size(v) * size(w)), 9)) >= licenses.ALIKE:
                expected[i, j] = min(expected.get((i, j), (0, "")), (-score, name))
    files = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row long, text string").select("row", licenses.block_terms(F.col("text")).alias("blocks"))
    found = licenses.matches(files, spark.createDataFrame(licenses.TEMPLATES, "licence string, text string")).collect()
    got = {(r.row, r.block): (r.score, r.licence) for r in found}
    assert got.keys() == expected.keys() and len(got) >= len(licenses.TEMPLATES)
    assert all(abs(got[k][0] + expected[k][0]) < 1e-8 and got[k][1] == expected[k][1] for k in got)


def test_pages_that_repeat_one_sign_end_soon(spark):
    import time

    many = 1_000_000
    rows = ["<script>" + "// aa\n" * 100_000 + "</script>", "\n" * many, "<title" * many, "<script " * many, "<!--" * many, "<script>/*" * many, "<a " * many, "<footer" * many, "<" * many,
            "<style>" * many, " \n" * many, "<script>" + "/* */" * 200_000, "</script " * many, "<script>\n" + "*" * many + "</script>", "<b>x" * 200_000]
    pages = spark.createDataFrame([(i, f"http://a.org/d{i}/x", h) for i, h in enumerate(rows)], "page_id long, url string, html string")
    known = spark.createDataFrame(licenses.TEMPLATES, "licence string, text string")
    start = time.time()
    assert licenses.scan(licenses.page_files(pages), known).count() == len(rows)
    assert time.time() - start < 120
    assert licenses.scan(licenses.page_files(pages.filter("page_id < 0")), known).count() == 0
