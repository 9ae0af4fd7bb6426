"""The stages on hand-made and given rows."""

import corpus_pipeline as pipeline

FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_the_columns(spark, docs):
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, plain, FOLDER)
        assert out.columns == plain.columns, name
        assert out.count() <= plain.count()
        assert stage(spark, plain.filter("doc_id < 0"), FOLDER).count() == 0, name


def test_one_of_each_group_stays(spark, docs):
    out = [r.doc_id for r in pipeline.near_duplicates(spark, docs, FOLDER).collect()]
    assert len(out) == len(set(out)) and 2 not in out and 7 in out and 4 in out


def test_run_packs_what_is_kept(spark):
    out = pipeline.run(spark, FOLDER)
    load = out.groupBy("sequence_id").sum("length").collect()
    assert load and all(r["sum(length)"] <= 1024 for r in load)


def test_rows_of_one_id_are_documents_of_their_own(spark):
    words = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    table = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "cast(null as string) as lang", "'s' as source", "cast(length(text) as long) as n_chars")
    texts = lambda out: sorted((r.doc_id or -1, r.text or "") for r in out.collect())
    kept = [(None, words("a", 80)), (None, words("b", 80)), (5, words("c", 80)), (5, words("d", 80)), (None, "")]
    out = pipeline.near_duplicates(spark, table([*kept, (7, words("a", 80)), (5, words("d", 80)), (8, words("b", 80) + " x")]), FOLDER)
    assert texts(out) == sorted((i or -1, t) for i, t in kept)

    shared, first, second = words("s", 60), words("f", 40), words("g", 75)
    rows = [(None, f"{shared} {second}"), (None, f"{first} {shared} {first}"), (None, words("h", 150)), (9, f"{first} x {shared} y")]
    out = dict.fromkeys(t for _, t in texts(pipeline.repeated_passages(spark, table(rows), FOLDER)))
    assert len(out) == 4 and words("h", 150) in out and f"{first} x y" in out
    assert len({f"{shared} {second}", f"{first} {shared} {first}"} & set(out)) == 1
    assert len({second, f"{first} {first}"} & set(out)) == 1

    item = next(r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect() if len((r.text or "").split()) > 20)
    rows = [(None, f"see {item}"), (None, words("k", 30)), (4, f"{item} end"), (4, words("m", 30))]
    assert texts(pipeline.benchmark_passages(spark, table(rows), FOLDER)) == [(-1, words("k", 30)), (4, words("m", 30))]
