import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelight.operators import describe, grid, groups, intervals, joins, prep, quantiles, reshape
from tracelight.session import cut_lineage, materialise, remove_table


def tuples(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.fixture(scope="module")
def hot(spark):
    """One room holds two thirds of the rows, one key is null, one day is missing."""
    rng = random.Random(3)
    rows = [(i, "hot" if i % 3 else f"r{i % 30}", rng.randrange(5)) for i in range(600)]
    rows += [(1000, None, 4), (1001, None, 2), (1002, "gap", None), (1003, "gap", 1)]
    return spark.createDataFrame(rows, "id int, room string, day int").cache()


def test_first_samples_keep_ties_and_slices_change_nothing(hot):
    rows = [tuple(r) for r in hot.collect()]
    first = {}
    for _, room, day in rows:
        if day is not None:
            first[room] = min(first.get(room, day), day)
    expected = sorted(i for i, room, day in rows if day is not None and day == first[room])
    for slice_rows in (None, 5_000_000, 25):
        kept = groups.first_samples(hot, ["room"], "day", slice_rows=slice_rows)
        assert sorted(r.id for r in kept.collect()) == expected
    strict = groups.first_samples(hot, ["room"], "day", strict_na=True)
    assert sorted(r.id for r in strict.collect()) == [i for i in expected if i not in (1002, 1003)]


def test_spread_join_matches_plain_join(spark, hot):
    lookup = spark.createDataFrame([("hot", 1), ("r0", 2), (None, 3), ("absent", 4)], "room string, v int")
    plain = tuples(joins.keyed_join(hot, lookup, ["room"]), "id", "room", "v")
    assert tuples(joins.spread_join(hot, lookup, ["room"], slice_rows=20), "id", "room", "v") == plain
    assert (1000, None, 3) in plain and len(plain) == 604


def test_heavy_keys_are_cut_into_slices(hot):
    counts = hot.groupBy("room").agg(F.count("*").alias("rows"), F.max("day").alias("top"))
    joined = joins.spread_join(hot, counts, ["room"], rows="rows", slice_rows=50)
    assert joined.count() == hot.count()
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" in plan and "xxhash64" in plan


def test_offsets_and_missing_days(hot):
    moved = groups.offset_from_start(hot, ["room"], "day", "offset").where("room = 'gap'")
    assert tuples(moved, "id", "offset") == [(1002, None), (1003, 0)]


def test_ranks_equal_a_sorted_group(spark):
    rng = np.random.default_rng(5)
    values = rng.permutation(300).astype(float)
    data = [("hot" if i % 3 else f"g{i % 7}", float(v)) for i, v in enumerate(values)]
    ranked = groups.range_ranks(spark.createDataFrame(data, "g string, x double"), ["g"], "x")
    got = {(r.g, r.x): (r["_rank"], r["_n"]) for r in ranked.collect()}
    for name in {g for g, _ in data}:
        ordered = sorted(x for g, x in data if g == name)
        for position, x in enumerate(ordered, start=1):
            assert got[name, x] == (position, len(ordered))


def test_copies_of_one_value_are_ranked_apart(spark):
    rows = [(i, 5.0 if i % 3 else float(i)) for i in range(400)]
    ranked = groups.range_ranks(spark.createDataFrame(rows, "id int, x double"), [], "x", ["id"]).collect()
    assert sorted(r["_rank"] for r in ranked) == list(range(1, 401))
    ordered = [i for i, _ in sorted(rows, key=lambda r: (r[1], r[0]))]
    assert [r.id for r in sorted(ranked, key=lambda r: r["_rank"])] == ordered


def test_dense_ids(spark):
    ids = groups.dense_ids(spark.createDataFrame([("b",), ("a",), ("b",), (None,), ("c",)], "k string"), F.col("k"))
    assert tuples(ids, "key", "id") == [("a", 1), ("b", 2), ("c", 3)]


def test_standard_score_round_trip(spark):
    rows = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 6.0)], "id int, x double")
    scored = groups.standard_score(rows, "x", "z")
    z = [r.z for r in scored.orderBy("id").collect()]
    assert np.allclose(z, (np.array([1, 2, 6]) - 3) / np.std([1, 2, 6], ddof=1))
    back = groups.undo_standard_score(scored.select("id", "z"), "z", rows, "x", "x")
    assert np.allclose([r.x for r in back.orderBy("id").collect()], [1, 2, 6])


@pytest.mark.parametrize("seed", [0, 1])
def test_chunked_quantiles_equal_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    data = [("hot", float(x)) for x in rng.lognormal(size=4000)] + [("ties", float(x)) for x in rng.integers(0, 3, 900)]
    data += [("pair", 1.0), ("pair", 2.0), ("single", 7.0), (None, 5.0), ("hot", None), ("hot", float("nan")), ("empty", None)]
    df = spark.createDataFrame(data, "g string, x double")
    wanted = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    results = [
        {r.g: [r[c] for c in wanted] for r in quantiles.exact_quantiles(df, ["g"], "x", wanted, buffered_rows=n).collect()}
        for n in (1_000_000, 10)
    ]
    assert "empty" not in results[0] and set(results[0]) == set(results[1])
    for name in results[0]:
        values = [x for g, x in data if g == name and x is not None and x == x]
        for result in results:
            assert np.allclose(result[name], np.quantile(values, list(wanted.values())))


def test_shortest_interval_against_brute_force(spark):
    rng = np.random.default_rng(2)
    data = {"a": rng.gamma(2.0, size=200), "b": rng.normal(size=41)}
    df = spark.createDataFrame([(g, float(x)) for g, xs in data.items() for x in xs], "g string, epred double")
    got = {r.g: r for r in intervals.shortest_interval(df, ["g"]).collect()}
    for name, xs in data.items():
        ordered, k = np.sort(xs), int(np.ceil(round(0.95 * len(xs), 9)))
        widths = ordered[k - 1:] - ordered[: len(xs) - k + 1]
        i = int(np.argmin(widths))
        assert np.isclose(got[name].lower, ordered[i]) and np.isclose(got[name].upper, ordered[i + k - 1])
        assert np.isclose(got[name].epred, np.median(xs))
        # 200 is a multiple of 40, so the equal-tail interval holds 95 % as well.
        if name == "a":
            low, high = np.quantile(xs, [0.025, 0.975])
            assert got[name].upper - got[name].lower <= high - low + 1e-9


# Location, height, contact, surfaces sampled, detected, printed share.
PRINTED = [
    ("floor_exit1", "Low", 167, 141, "84.4%"),
    ("floor_near2", "Low", 168, 132, "78.6%"),
    ("mouse", "High", 167, 70, "41.9%"),
    ("keyboard", "High", 166, 61, "36.7%"),
    ("bed_rail", "High", 169, 59, "34.9%"),
    ("doorknob_inner", "High", 162, 39, "24.1%"),
    ("wall_exit", "Low", 167, 11, "6.6%"),
    ("wall_near", "Low", 168, 5, "3.0%"),
]


def test_printed_surface_table(spark):
    rows = []
    for code, (site, touch, total, found, _) in enumerate(PRINTED):
        for i in range(total):
            quantity = 10.0 ** (2.0 + (i % 3) * 0.4) if i < found else None
            rows.append((f"decon_{i:03d}", i, "M1", f"S{code}", site, touch, float(i), 0, 0, 0, 0, 0, quantity))
    names = ("subject_room_id string, redcap_id bigint, unit string, swab_site string, site_descriptor string, touch string, "
             "distance double, subject_room_day int, subject_study_day int, subject_hosp_day int, subject_covid_day int, "
             "total_study_day int, copies_max double")
    swabs = spark.createDataFrame(rows, names)
    table = prep.analysis_table(swabs, "longitudinal_days")
    assert table.count() == 1334
    summary = describe.surface_table(table, swabs, compat_q75=True)
    printed = describe.printed_surface_table(summary).collect()
    assert [r["Detected"] for r in printed] == [p[4] for p in PRINTED]
    assert [r["Surfaces Sampled"] for r in printed] == [p[2] for p in PRINTED]
    assert printed[0]["Location"] == "Floor Exit" and printed[0]["Height"] == "Floor"
    assert printed[2]["Contact"] == "High Touch" and printed[5]["Location"] == "Doorknob Inner"
    assert printed[0]["Median (IQR) log10 Copies"] == "2.4 (2 - 2.4)"
    right = {r.site_descriptor: r.copies_summary for r in describe.surface_table(table, swabs).collect()}
    assert right["Floor Exit"] == "2.4 (2 - 2.8)"


def test_distinct_count_counts_missing_once(spark):
    rows = spark.createDataFrame([("a",), (None,), (None,), ("b",)], "x string")
    assert rows.agg(describe.count_distinct_with_null("x")).first()[0] == 3


def test_flag_summary_and_order(spark):
    rows = spark.createDataFrame([(True, False), (True, True), (False, None)], "steroid boolean, hiv boolean")
    long = reshape.flag_summary(describe.flag_totals(rows, ["steroid", "hiv"]))
    got = [tuple(r) for r in describe.sort_desc(long, ["proportion"], ["name"]).collect()]
    assert got[0][0] == "steroid" and got[0][1] == 2.0 and got[1] == ("hiv", None, None)


def test_missing_sorts_last_both_ways(spark):
    rows = spark.createDataFrame([(2,), (None,), (1,)], "x int")
    assert [r.x for r in describe.sort_desc(rows, ["x"]).collect()] == [2, 1, None]
    assert [r.x for r in describe.sort_asc(rows, ["x"]).collect()] == [1, 2, None]


def test_cohort_counters(spark):
    rows = spark.createDataFrame([("a", 1, 0), ("a", 1, 1), ("b", 1, 0), ("c", 2, 0)], "subject_room_id string, redcap_id int, subject_room_day int")
    assert tuple(describe.cohort_counters(rows).first()) == (4, 3, 2, 1)
    assert tuple(describe.sampling_events(rows).first()) == (1.3, 0.58)


def test_lookup_with_two_descriptors_fans_out(spark):
    sites = spark.createDataFrame([("S1", "wall"), ("S1", "door"), ("S2", "floor")], "swab_site string, site_descriptor string")
    rows = spark.createDataFrame([(1, "S1"), (2, "S2"), (3, None)], "id int, swab_site string")
    assert joins.distinct_lookup(rows, sites, ["swab_site"], ["site_descriptor"]).count() == 4
    assert joins.one_per_key(sites, ["swab_site"], ["site_descriptor"]).count() == 2


def test_grid_has_no_cartesian_join_and_drops_the_impossible_cell(spark):
    frame = spark.createDataFrame(
        [("r1", 0.0, "Floor", False), ("r2", 2.0, "Elevated", True), ("r2", 1.0, "Elevated", False)],
        "room string, distance double, site_category string, high_touch boolean")
    plain = grid.prediction_grid(frame, {"distance": 3}, ["site_category", "high_touch"])
    assert plain.count() == 9
    assert grid.prediction_grid(frame, {"distance": 3}, ["site_category", "high_touch"], drop_impossible=False).count() == 12
    rooms = grid.prediction_grid(frame, {"distance": 3}, ["site_category", "high_touch"], entity="room")
    assert rooms.count() == 18 and "Cartesian" not in rooms._jdf.queryExecution().toString()
    assert {r.distance for r in prep.nearest_to(plain, "distance", 0.9).collect()} == {1.0}
    assert {r.distance for r in prep.at_minimum(plain, "distance").collect()} == {0.0}


def test_written_tables_can_be_removed(spark):
    table, path = materialise(spark.range(5))
    assert table.count() == 5 and cut_lineage(table).count() == 5
    remove_table(spark, path)
    with pytest.raises(Exception):
        spark.read.parquet(path).count()
