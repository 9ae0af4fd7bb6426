"""Draws of fitted models as Parquet, replaced as a whole or not at all.

A store is a folder of written versions and a list of manifests:

    data/<version>/model_name=<name>/...   draws, as one write left them
    manifest/<number>.json                 which version holds each model, and what the model is

A write first puts its draws into a version of their own, then publishes a manifest that
names them, by renaming a finished file to the next free number. Readers take the highest
number, so they see all of a write or nothing of it: a write that fails leaves the old
draws in place, and of two writers the second sees that its number is taken and builds its
manifest anew. Versions that no manifest in use names are removed on demand.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelight.schemas import DRAWS

MODELS = "model_name string, version string, family string, formula string, fitted_rows double, converged boolean, draws long"
TRIES = 20


@dataclass(frozen=True)
class ModelInfo:
    """What a store says of a model beside its draws."""

    model_name: str
    family: str | None = None
    formula: str | None = None
    fitted_rows: float | None = None
    converged: bool | None = None


class _Files:
    """The file system a path lies on."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.system = self.path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return [s.getPath().getName() for s in self.system.listStatus(at)] if self.system.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.system.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, text: str, name: str) -> bool:
        """Write ``text`` aside and rename it to ``name``; False if that exists."""
        aside = self.path(f"{name}.{uuid.uuid4().hex}.tmp")
        stream = self.system.create(aside, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self.system.exists(self.path(name)) and self.system.rename(aside, self.path(name)):
            return True
        self.system.delete(aside, False)
        return False


def _manifest(files: _Files, path: str) -> tuple[int, dict[str, dict]]:
    """Number and models (by name) of the manifest in force; 0 and none for a new store."""
    numbers = [int(n.removesuffix(".json")) for n in files.names(f"{path}/manifest") if n.endswith(".json")]
    if not numbers:
        return 0, {}
    return max(numbers), json.loads(files.read(f"{path}/manifest/{max(numbers):012d}.json"))


def _publish(files: _Files, path: str, change: dict[str, dict | None]) -> None:
    """Manifest in force with ``change`` (None takes a model out), tried anew if another writer was first."""
    for _ in range(TRIES):
        number, models = _manifest(files, path)
        models = {k: v for k, v in (models | change).items() if v is not None}
        if files.publish(json.dumps(models, sort_keys=True), f"{path}/manifest/{number + 1:012d}.json"):
            return
    raise RuntimeError(f"other writers keep publishing to {path}")


def write_draws(draws: DataFrame, path: str, compression: str = "zstd", about: Sequence[ModelInfo] = ()) -> None:
    """Add or replace the models present in ``draws``; other models are kept.

    Rows are spread by model and parameter and rebalanced by size, so neither the many
    parameters of a room-level model nor a very long parameter land in one file writer.
    """
    spark, version = draws.sparkSession, uuid.uuid4().hex
    folder = f"{path}/data/{version}"
    (
        draws.select(*DRAWS.fieldNames())
        .hint("rebalance", "model_name", "param")
        .sortWithinPartitions("param", "draw")
        .write.option("compression", compression)
        .partitionBy("model_name")
        .parquet(folder)
    )
    counts = spark.read.schema(DRAWS).parquet(folder).groupBy("model_name").agg(F.count_distinct("draw").alias("draws")).collect()  # one row a model
    known = {m.model_name: m for m in about}
    change = {r.model_name: asdict(known.get(r.model_name, ModelInfo(r.model_name))) | {"version": version, "draws": r.draws} for r in counts}
    _publish(_Files(spark, path), path, change)


def drop_model(spark: SparkSession, path: str, model_name: str) -> None:
    """Take a model out of the store; its files stay until ``remove_unused``."""
    _publish(_Files(spark, path), path, {model_name: None})


def read_models(spark: SparkSession, path: str) -> DataFrame:
    """One row for each model in the store: version, family, formula, rows it was fitted to, converged, draws."""
    rows = [tuple(m.get(c.split()[0]) for c in MODELS.split(", ")) for m in _manifest(_Files(spark, path), path)[1].values()]
    return spark.createDataFrame(rows, MODELS)


def read_draws(spark: SparkSession, path: str, model_name: str | None = None) -> DataFrame:
    """All draws of one manifest, or only the folder of one model (partition pruning)."""
    models = _manifest(_Files(spark, path), path)[1]
    held: dict[str, list[str]] = {}
    for name, model in models.items():
        if model_name is None or name == model_name:
            held.setdefault(model["version"], []).append(name)
    parts = [
        spark.read.schema(DRAWS).parquet(f"{path}/data/{version}").where(F.col("model_name").isin(names) if len(names) > 1 else F.col("model_name") == names[0])
        for version, names in sorted(held.items())
    ]
    if not parts:
        return spark.createDataFrame([], DRAWS)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    return whole


def remove_unused(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Delete the versions that none of the last ``keep`` manifests names; returns them. Run it while nobody writes."""
    files = _Files(spark, path)
    numbers = sorted(n for n in files.names(f"{path}/manifest") if n.endswith(".json"))
    used = {m["version"] for n in numbers[-keep:] for m in json.loads(files.read(f"{path}/manifest/{n}")).values()}
    unused = [v for v in files.names(f"{path}/data") if v not in used]
    for version in unused:
        files.system.delete(files.path(f"{path}/data/{version}"), True)
    return unused
