"""The model store: all of a write or nothing of it."""

import pytest

from tracelight.schemas import DRAWS
from tracelight.sources import model_store


def draws(spark, value, *names, count=6):
    rows = [(n, d % 2, d // 2, d, p, float(value)) for n in names for d in range(count) for p in ("b_Intercept", "sigma")]
    return spark.createDataFrame(rows, DRAWS)


def held(spark, path):
    return {r.model_name: r.v for r in model_store.read_draws(spark, path).groupBy("model_name").agg({"value": "max"}).withColumnRenamed("max(value)", "v").collect()}


def test_models_are_added_replaced_and_taken_out(spark, tmp_path):
    path = str(tmp_path / "store")
    assert model_store.read_draws(spark, path).count() == 0 and model_store.read_models(spark, path).count() == 0
    model_store.write_draws(draws(spark, 1, "a", "b c/d=%"), path, about=[model_store.ModelInfo("a", "bernoulli", "y ~ x", 40.0, True)])
    model_store.write_draws(draws(spark, 2, "b c/d=%", "e", count=4), path)
    assert held(spark, path) == {"a": 1.0, "b c/d=%": 2.0, "e": 2.0}
    assert model_store.read_draws(spark, path, "b c/d=%").count() == 8 and model_store.read_draws(spark, path, "none").count() == 0
    about = {r.model_name: (r.family, r.formula, r.fitted_rows, r.converged, r.draws) for r in model_store.read_models(spark, path).collect()}
    assert about == {"a": ("bernoulli", "y ~ x", 40.0, True, 6), "b c/d=%": (None, None, None, None, 4), "e": (None, None, None, None, 4)}
    model_store.drop_model(spark, path, "e")
    assert set(held(spark, path)) == {"a", "b c/d=%"}


def test_a_write_that_fails_leaves_the_old_draws(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    model_store.write_draws(draws(spark, 1, "a", "b"), path)
    broken = draws(spark, 2, "a").selectExpr(*[c for c in DRAWS.fieldNames() if c != "value"], "IF(draw = 5, raise_error('lost'), value) AS value")
    with pytest.raises(Exception, match="lost"):
        model_store.write_draws(broken, path)
    assert held(spark, path) == {"a": 1.0, "b": 1.0}
    # The draws are all written, but what publishes them fails.
    publish = model_store._Files.publish
    monkeypatch.setattr(model_store._Files, "publish", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        model_store.write_draws(draws(spark, 3, "a"), path)
    monkeypatch.setattr(model_store._Files, "publish", publish)
    assert held(spark, path) == {"a": 1.0, "b": 1.0}
    model_store.write_draws(draws(spark, 4, "a"), path)
    assert held(spark, path) == {"a": 4.0, "b": 1.0}


def test_a_reader_keeps_its_version_and_a_late_writer_takes_the_next_number(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    model_store.write_draws(draws(spark, 1, "a"), path)
    before = model_store.read_draws(spark, path)
    manifest, met = model_store._manifest, []

    def late(files, at):
        found = manifest(files, at)
        if not met:  # another writer publishes between the look at the manifest and the rename
            met.append(1)
            model_store.write_draws(draws(spark, 2, "b"), path)
        return found

    monkeypatch.setattr(model_store, "_manifest", late)
    model_store.write_draws(draws(spark, 3, "c"), path)
    monkeypatch.setattr(model_store, "_manifest", manifest)
    assert held(spark, path) == {"a": 1.0, "b": 2.0, "c": 3.0}
    model_store.write_draws(draws(spark, 5, "a"), path)
    assert {r.value for r in before.collect()} == {1.0}
    assert len(model_store.remove_unused(spark, path)) == 1 and held(spark, path) == {"a": 5.0, "b": 2.0, "c": 3.0}
