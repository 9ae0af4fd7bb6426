"""Ordinal quality classifier: a cumulative link on hashed text.

Graded ratings 0 < 1 < ... < g share one weight vector over hashed features;
ordered thresholds cut its score: P(grade <= j) = logistic(t_j - s). The expected
grade and the tail probability P(grade >= j) select documents.

Features are the presence of words, of their first three, four and five bytes, of
each word's closing signs, of spelling in capitals, and how often a word
follows itself; each hashes to one of ``2**BITS`` weights. The model is fitted on at
most ``FITTED`` labelled rows (smallest hashes of the id), in one task, until the
gradient of the penalised likelihood is small; everything is scored.

Null text is empty: only the thresholds speak. Ratings that are null are left out; of
several for one id the lowest counts. Labels without a document are ignored, as are
documents without a label. Without any label every document has the highest grade.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from tracelight.llm import text as T

BITS = 22
FITTED = 12_000
#: Features that fewer fitted rows hold carry no weight.
SEEN = 8
#: Absolute penalty on the weights beside the mean loss. The fit ends when no derivative is larger than ``FLAT``, or after ``STEPS``.
PENALTY, FLAT, STEPS = 3e-4, 3e-5, 1000
#: Features that the fit takes at once.
CELLS = 1 << 19
#: Pairs of steps that the search remembers.
MEMORY = 12
REPEATS = (0.02, 0.1, 0.3)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, row), sorted by row and distinct in it."""
    small = T.LOWER[data]
    starts, ends, rows = T.words(small, offsets, T.ALNUM)
    groups = [(T.word_hashes(small, starts, ends), rows)]
    for n, salt in ((3, 11), (4, 12), (5, 13)):
        long = ends - starts > n
        groups.append((T.word_hashes(small, starts[long], starts[long] + n) + np.uint64(salt), rows[long]))
    # Whole words with their signs and capitals.
    starts, ends, rows = T.words(data, offsets, T.SPACE)
    if len(starts):
        last, before = data[ends - 1], data[np.maximum(ends - 2, starts)]
        signs = ~T.ALNUM[T.LOWER[last]]
        closing = last.astype(np.uint64) * np.uint64(256) + np.where(~T.ALNUM[T.LOWER[before]], before, 0).astype(np.uint64)
        groups.append((T.mixed(closing[signs] + np.uint64(1 << 40)), rows[signs]))
        capital = (data[starts] >= 0x41) & (data[starts] <= 0x5A) & (before >= 0x41) & (before <= 0x5A) & (ends - starts > 2)
        groups.append((T.mixed(np.full(capital.sum(), 1 << 41, np.uint64)), rows[capital]))
        hashes = T.word_hashes(data, starts, ends)
        again = np.zeros(len(starts), bool)
        again[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
        n = len(offsets) - 1
        share = np.bincount(rows[again], minlength=n) / np.maximum(1, np.bincount(rows, minlength=n))
        for k, least in enumerate(REPEATS):
            some = np.flatnonzero(share > least)
            groups.append((T.mixed(np.full(len(some), (1 << 42) + k, np.uint64)), some))
    value = np.concatenate([g for g, _ in groups]) >> np.uint64(64 - BITS)
    row = np.concatenate([r for _, r in groups]).astype(np.int64)
    both = np.unique(row << BITS | value.astype(np.int64))
    return both & ((1 << BITS) - 1), both >> BITS


@dataclass
class Ordinal:
    """Shared weights, those that are not zero by feature, and ordered thresholds."""

    names: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    flat: float = 0.0

    def dense(self) -> np.ndarray:
        whole = np.zeros(1 << BITS, np.float32)
        whole[self.names] = self.weights
        return whole

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1 .. g, by column."""
        return 1.0 / (1.0 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))


def _descend(loss, x: np.ndarray, penalty: np.ndarray) -> tuple[np.ndarray, float]:
    """Limited-memory quasi-Newton descent of ``loss`` (value, gradient) and an absolute ``penalty`` from ``x``.

    Steps stay in the orthant they start in, so weights stop at zero. Returns the largest derivative at the end too.
    """

    def downhill(x: np.ndarray, slope: np.ndarray) -> np.ndarray:
        """Gradient with the penalty; at zero the side that falls, if any."""
        right, left = slope + penalty, slope - penalty
        at_zero = np.where(right < 0, right, np.where(left > 0, left, 0.0))
        return np.where(x > 0, right, np.where(x < 0, left, at_zero))

    value, slope = loss(x)
    value += penalty @ np.abs(x)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(STEPS):
        steep = downhill(x, slope)
        if np.abs(steep).max() <= FLAT:
            break
        step, kept = -steep, []
        for s, y, r in reversed(pairs):
            a = r * (s @ step)
            step = step - a * y
            kept.append(a)
        if pairs:
            s, y, _ = pairs[-1]
            step = step * ((s @ y) / (y @ y))
        for (s, y, r), a in zip(pairs, reversed(kept), strict=True):
            step = step + (a - r * (y @ step)) * s
        step = np.where(step * steep < 0, step, 0.0)
        side = np.where(x != 0, np.sign(x), -np.sign(steep))
        side[penalty == 0] = 0
        length = 1.0 if pairs else 1.0 / max(1.0, np.linalg.norm(steep))
        while length > 1e-12:
            new = x + length * step
            new[new * side < 0] = 0
            now, at = loss(new)
            now += penalty @ np.abs(new)
            if now <= value + 1e-4 * (steep @ (new - x)):
                break
            length /= 2
        else:
            if not pairs:
                break  # flat to rounding
            pairs = []
            continue
        s, y = new - x, at - slope
        if s @ y > 1e-12 * (y @ y):
            pairs = [*pairs[-MEMORY + 1 :], (s, y, 1 / (s @ y))]
        x, value, slope = new, now, at
    return x, float(np.abs(downhill(x, slope)).max())


def fit_rows(feature: np.ndarray, start: np.ndarray, grade: np.ndarray, grades: int) -> Ordinal:
    """Penalised maximum likelihood; row i has feature[start[i] : start[i + 1]]."""
    n, parts = len(grade), []
    # Some rows at a time: nothing but the features themselves is as long as they are.
    cuts = np.unique(np.append(np.searchsorted(start, np.arange(0, start[-1], CELLS)), n))
    cuts = np.unique(np.append(0, cuts))
    seen = np.zeros(1 << BITS, np.int32)
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        np.add.at(seen, feature[start[i] : start[j]], 1)
    used = seen >= min(SEEN, max(1, n // 50))
    names, number = np.flatnonzero(used), (np.cumsum(used) - 1).astype(np.int32)
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        some = feature[start[i] : start[j]]
        kept = used[some]
        parts.append((i, j, np.repeat(np.arange(j - i, dtype=np.int32), np.diff(start[i : j + 1]))[kept], number[some[kept]]))
    del feature, seen, used, number
    many = len(names)
    share = np.array([(grade < j).mean() for j in range(1, grades + 1)]).clip(0.01, 0.99)
    base = np.log(share / (1 - share))
    # Thresholds stay ordered: a first one and positive steps.
    first = np.append(base[0], np.log(np.maximum(0.05, np.diff(base))))

    def thresholds(step: np.ndarray) -> np.ndarray:
        return np.append(step[0], step[0] + np.cumsum(np.exp(step[1:])))

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        weights, step = x[:many], x[many:]
        s = np.concatenate([np.bincount(owner, weights[column], j - i) for i, j, owner, column in parts])
        edge = np.concatenate([[-np.inf], thresholds(step), [np.inf]])
        low, high = (1 / (1 + np.exp(-np.clip(edge[grade + k] - s, -35, 35))) for k in (0, 1))
        p = np.maximum(high - low, 1e-15)
        dlow, dhigh = low * (1 - low) / p, high * (1 - high) / p
        slope = np.empty_like(x)
        down = dhigh - dlow
        slope[:many] = sum(np.bincount(column, down[i:j][owner], many) for i, j, owner, column in parts) / n
        dcut = np.array([(dlow * (grade == j + 1) - dhigh * (grade == j)).sum() for j in range(grades)]) / n
        slope[many:] = np.append(dcut.sum(), [dcut[j:].sum() * np.exp(step[j]) for j in range(1, grades)]) + 1e-3 * (step - first) / n
        return (-np.log(p).sum() + 0.5e-3 * ((step - first) ** 2).sum()) / n, slope

    best, flat = _descend(loss, np.append(np.zeros(many), first), np.append(np.full(many, PENALTY), np.zeros(grades)))
    return Ordinal(names, best[:many].astype(np.float32), thresholds(best[many:]), flat)


def fit(docs: DataFrame, labels: DataFrame, grades: int = 2, fitted: int = FITTED) -> Ordinal:
    """``labels``: (doc_id, grade 0 .. ``grades``). At most ``fitted`` labelled documents are used."""
    T.tuned(docs.sparkSession)
    rated = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("grade").cast("int").alias("grade")).dropna()
    rated = rated.groupBy("doc_id").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fitted)
    rows = T.keyed_texts(docs).join(F.broadcast(rated), "doc_id").select("grade", "text")  # at most ``fitted`` ids are sent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in T.slices(batch.column(1)):
                n = len(offsets) - 1
                feature, row = features(data, offsets)
                at = np.searchsorted(row, np.arange(n + 1))
                packed = [feature[a:b].astype("<i4").tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(packed, pa.binary())], names=["grade", "features"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grade, lists = [], []
        for batch in batches:
            grade += batch.column(0).to_pylist()
            lists += batch.column(1).to_pylist()
        order = sorted(range(len(grade)), key=lambda i: (lists[i], grade[i]))
        start = np.concatenate([[0], np.cumsum([len(lists[i]) // 4 for i in order])]).astype(np.int64)
        flat, grade = np.frombuffer(b"".join(lists[i] for i in order), "<i4"), [grade[i] for i in order]
        del lists
        if not order:
            found = Ordinal(np.zeros(0, np.int64), np.zeros(0, np.float32), np.full(grades, -30.0))
        else:
            found = fit_rows(flat, start, np.clip(np.array(grade, np.int64), 0, grades), grades)
        some = found.weights != 0
        parts = [x.tobytes() for x in (found.names[some].astype("<i4"), found.weights[some].astype("<f4"), found.thresholds.astype("<f8"))]
        yield pa.RecordBatch.from_arrays([*[pa.array([x], pa.binary()) for x in parts], pa.array([found.flat])], names=["names", "weights", "thresholds", "flat"])

    # One task holds the features of at most 2 * ``fitted`` rows; one row with the weights in use comes back.
    some = rows.mapInArrow(T.lean(run), "grade int, features binary").orderBy(F.xxhash64("features"), "grade").limit(2 * fitted)
    got = some.repartition(1).mapInArrow(T.lean(solve), "names binary, weights binary, thresholds binary, flat double").first()
    if got.flat > FLAT:
        warnings.warn(f"the classifier's gradient is {got.flat:.2g} after its last step: not converged", stacklevel=2)
    return Ordinal(np.frombuffer(got.names, "<i4"), np.frombuffer(got.weights, "<f4"), np.frombuffer(got.thresholds, "<f8"), got.flat)


def graded(docs: DataFrame, model: Ordinal) -> DataFrame:
    """Rows of ``docs`` as a struct ``given``, with score, expected_grade and tails (P(grade >= j) for j = 1 ..)."""
    T.tuned(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.dense()
        for batch in batches:
            parts = []
            for _, data, offsets in T.slices(batch.column(1)):
                feature, row = features(data, offsets)
                parts.append(np.bincount(row, weights[feature], len(offsets) - 1))
            score = np.concatenate(parts) if parts else np.zeros(0)
            tails = model.tails(score)
            lists = pa.ListArray.from_arrays(np.arange(0, tails.size + 1, tails.shape[1], dtype=np.int32), pa.array(tails.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array(tails.sum(axis=1)), lists], names=["given", "score", "expected_grade", "tails"]
            )

    rows = docs.select(F.struct("*").alias("given"), F.coalesce("text", F.lit("")).alias("text"))
    schema = StructType([rows.schema["given"]]).add("score", "double").add("expected_grade", "double").add("tails", ArrayType(DoubleType()))
    return rows.mapInArrow(T.lean(run), schema)


def quality_grades(labels: DataFrame) -> DataFrame:
    """Grades of the labels table: 0 toxic, 1 harmless but poor, 2 sound and clean.

    Toxic is the lowest: the more toxic words, the lower the score, without an end.
    """
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade"))
