import math

import pytest
from pyspark.sql import functions as F

from tracelight import functions as C
from tracelight.operators import prep
from tracelight.schemas import SEVERITY_LEVELS


def one(spark, data, schema, column):
    return [r[0] for r in spark.createDataFrame(data, schema).select(column).collect()]


def test_missing_site_is_kept_and_elevated(spark):
    rows = spark.createDataFrame(
        [(1, None), (2, "bathroom_sink"), (3, "floor_near1"), (4, "wall_near")], "id int, site_descriptor string"
    )
    assert sorted(r.id for r in prep.comparable_sites(rows).collect()) == [1, 3, 4]
    kinds = {r.id: r.c for r in rows.select("id", C.site_category(F.col("site_descriptor")).alias("c")).collect()}
    assert kinds == {1: "Elevated", 2: "Elevated", 3: "Floor", 4: "Elevated"}


def test_nan_is_not_detected(spark):
    assert one(spark, [(None,), (float("nan"),), (0.0,), (3.0,)], "x double", C.is_detected(F.col("x"))) == [
        False, False, True, True]


def test_null_to_zero_covers_nan(spark):
    assert one(spark, [(None,), (float("nan"),), (2.5,)], "x double", C.null_to_zero(F.col("x"))) == [0.0, 0.0, 2.5]


def test_contact_label_keeps_null(spark):
    assert one(spark, [(True,), (False,), (None,)], "x boolean", C.contact_label(F.col("x"))) == [
        "High Touch", "Low Touch", None]


@pytest.mark.parametrize(
    "flags, expected",
    [
        ((False, False, False, False), SEVERITY_LEVELS[0]),
        ((False, False, False, True), SEVERITY_LEVELS[1]),
        ((True, None, None, None), SEVERITY_LEVELS[2]),
        ((None, False, False, True), None),
        ((False, False, False, None), None),
        ((None, True, False, False), SEVERITY_LEVELS[2]),
    ],
)
def test_severity_with_unknown_flags(spark, flags, expected):
    column = C.severity_class(*[F.col(c) for c in "abcd"])
    assert one(spark, [flags], "a boolean, b boolean, c boolean, d boolean", column) == [expected]


def test_significant_digits(spark):
    values = [(0.0,), (123456.0,), (0.00123456,), (-98.76,), (None,)]
    got = one(spark, values, "x double", C.significant(F.col("x"), 3))
    assert got[0] == 0.0 and got[4] is None
    assert [round(v, 8) for v in got[1:4]] == [123000.0, 0.00123, -98.8]


def test_half_even_and_tidy_text(spark):
    got = one(spark, [(2.25,), (2.35,), (2.0,)], "x double", C.tidy_number(C.round_half_even(F.col("x"), 1)))
    assert got == ["2.2", "2.4", "2"]


def test_extract_without_match_is_null(spark):
    assert one(spark, [("a_count",), ("other",)], "x string", C.extract_word(F.col("x"), "count|proportion")) == ["count", None]


def test_keys(spark):
    assert one(spark, [(7.0,), (None,)], "x double", C.subject_key(F.col("x"))) == ["decon_subject_7", None]
    assert one(spark, [(7,), (12345,)], "x int", C.room_key(F.col("x"))) == ["decon_007", "decon_12345"]


def test_even_grid(spark):
    grid = one(spark, [(1.0, 3.0)], "lo double, hi double", C.even_grid(F.col("lo"), F.col("hi"), 5))[0]
    assert grid == [1.0, 1.5, 2.0, 2.5, 3.0]
    assert one(spark, [(1.0, 3.0)], "lo double, hi double", C.even_grid(F.col("lo"), F.col("hi"), 1))[0] == [1.0]


def test_inverse_normal(spark):
    points = [(0.001,), (0.025,), (0.5,), (0.8413447460685429,), (0.999,)]
    got = one(spark, points, "p double", C.inverse_normal(F.col("p")))
    for value, expected in zip(got, [-3.090232306, -1.959963985, 0.0, 1.0, 3.090232306]):
        assert math.isclose(value, expected, abs_tol=1e-7)


def test_repeated_columns_and_patterns(spark):
    rows = spark.createDataFrame([(1, 2.0, 3)], "a int, room_day double, b int")
    assert prep.select_once(rows, ["a", "b", "a", "a"]).columns == ["a", "b"]
    assert prep.drop_matching(rows, "_day").columns == ["a", "b"]
    assert prep.keep_first(rows, "day").columns == ["room_day", "a", "b"]
    assert prep.map_numeric(rows, F.exp, "exp").columns == ["a", "room_day", "b", "a_exp", "room_day_exp", "b_exp"]
