import duckdb
import pytest

import __spark_entry__ as entry
from tools.compare import TABLES, canonical
from tracelight.operators import describe, prep
from tracelight.schemas import SEVERITY_LEVELS, SUBJECTS
from tracelight.sources.files import read_csv

FOLDER = "/root/testdata/sf0.001"


def test_names_and_twins():
    queries, twins = entry.queries(), entry.oracle_sql()
    assert set(twins) <= set(queries) and len(queries) > 120
    queries = {n: q for n, q in queries.items() if n not in entry.CORPUS}
    without = {n.split("_")[0] for n in set(queries) - set(twins) if not n.startswith("p3_ribbon_")}
    assert without <= {"g7", "g8", "g9", "p5", "p6", "p10", "p11", "p12"}


@pytest.mark.parametrize(
    "name", ["a2_surface_table", "w1_first_samples", "a4_quantiles", "g4_mvbinom_time_fix_category_touch", "p3_ribbon", "j1_subject_attributes"]
)
def test_queries_match_their_twins(spark, name):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    frame = entry.queries()[name](spark, FOLDER)
    result = connection.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(frame.columns)
    assert canonical([tuple(r) for r in frame.collect()], frame.columns) == canonical(result.fetchall(), columns)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_subject_counts(spark, tmp_path):
    """Severity classes and flag totals of a hand-made subject file, counted by hand."""
    flags = [f.name for f in SUBJECTS.fields if f.name != "redcap_id"]
    on = [  # flags set by subject: 2 without oxygen, 3 with a mask only, 2 with more
        [], ["steroid"], ["supp_oxy_ever"], ["supp_oxy_ever", "steroid", "remdesivir"], ["supp_oxy_ever", "female_sex"],
        ["mech_vent_ever"], ["high_flow_nc_ever", "supp_oxy_ever"],
    ]
    lines = [",".join(["redcap_id", *flags])]
    lines += [",".join([f"decon_subject_{i}", *[str(f in names).upper() for f in flags]]) for i, names in enumerate(on)]
    (tmp_path / "subjects.csv").write_text("\n".join(lines) + "\n")
    subjects = read_csv(spark, str(tmp_path / "subjects.csv"), SUBJECTS)
    counts = {r.covid_severity: r["count"] for r in describe.counts_by(prep.with_severity(subjects), ["covid_severity"]).collect()}
    assert [counts[level] for level in SEVERITY_LEVELS] == [2, 3, 2]
    totals = describe.flag_totals(subjects).first()
    assert {f: int(totals[f"{f}_count"]) for f in ("supp_oxy_ever", "steroid", "remdesivir", "female_sex", "hiv")} == {
        "supp_oxy_ever": 4, "steroid": 2, "remdesivir": 1, "female_sex": 1, "hiv": 0}
    cross = describe.counts_by(subjects, ["mech_vent_ever", "supp_oxy_ever", "steroid"]).collect()
    assert len(cross) == 5 and sum(r["count"] for r in cross) == 7
