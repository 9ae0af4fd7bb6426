"""Random effects of many groups (rooms) by their marginal likelihood, on Spark.

The model is ``eta = b + x'u_room`` with ``u_room = L z_room``, ``z ~ N(0, I)``, ``b ~ N(0, 1)``
and half-normal(0, 1) standard deviations, the lengths of the rows of ``L``. Each room's
effect is integrated out where the room lies (``room_likelihood``); one aggregate adds up
values and gradients, and the driver takes Newton and quasi-Newton steps on the few parameters.

A room with at most ``held`` covariate patterns is one row that lists them. A larger room
is never gathered: it is reduced to its derivatives up to the third at a centre, by
partial sums, and the centre follows the room's mode until nothing moves.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import combinations_with_replacement, permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracelight.functions import is_detected
from tracelight.functions.normal import inverse_normal_array, primes
from tracelight.operators.joins import keyed_join, spread_join
from tracelight.plans import room_likelihood as likelihood
from tracelight.plans.design import Design, bernoulli_patterns, design_columns
from tracelight.plans.fits import _triangle, score_sums, with_score
from tracelight.session import cut_lineage

ROOMS_PER_BATCH = 64
#: Variances below this are as good as none: they move by no more than a share of it.
NO_SPREAD = 1e-3
#: Patterns of a room that are listed in one row.
HELD = 2000
#: Numbers that an array of an evaluation may hold at once (rooms x sets x nodes x patterns).
CELLS = 200_000
#: The same by Laplace's method, whose arrays do best where a core's cache holds them, and sets it takes at once.
FITTING, TOGETHER = 64_000, 48
#: Rooms whose scores are smoothed at once.
SCORED = 256
#: Times the centres of large rooms are moved before the first search, before a later one, and searches at most.
FIRST_MOVES, LATER_MOVES, SEARCHES = 8, 2, 12


@dataclass
class RoomFit:
    """``effects`` has one row per room: key, ``u<i>``, covariance ``v<i>_<j>`` and ``b<i>``.

    ``v`` holds at the fitted intercept; ``b`` is how ``u`` moves with the intercept. ``theta`` is
    (intercept, lower triangle of L, and log sigma for normal rows); ``objective`` evaluates the
    log posterior of many such parameter sets in one pass (values and gradients); ``tables`` and
    ``terms`` are what it adds up: the rooms, and a room's log integrals under many parameter sets.
    """

    design: Design
    group: str
    family: str
    intercept: float
    intercept_sd: float
    spread: np.ndarray
    effects: DataFrame
    sigma: float | None = None
    hurdle: float | None = None
    rows: float = 0.0
    history: list[float] = field(default_factory=list)
    converged: bool = True
    passes: int = 0
    theta: np.ndarray | None = None
    objective: Callable | None = field(default=None, repr=False)
    tables: Callable | None = field(default=None, repr=False)
    terms: Callable | None = field(default=None, repr=False)


def _matrices(batch: pd.DataFrame, name: str, p: int) -> np.ndarray:
    out = np.zeros((len(batch), p, p))
    for i, j in _triangle(p):
        out[:, i, j] = out[:, j, i] = batch[f"{name}{i}_{j}"].to_numpy(float)
    return out


def _vectors(batch: pd.DataFrame, name: str, p: int) -> np.ndarray:
    return batch[[f"{name}{i}" for i in range(p)]].to_numpy(float)


def _effect_schema(group: str, kind: str, p: int) -> str:
    columns = [f"{group} {kind}"] + [f"{n}{i} double" for n in "ub" for i in range(p)]
    return ", ".join(columns + [f"v{i}_{j} double" for i, j in _triangle(p)])


def _effect_rows(group: str, u: np.ndarray, b: np.ndarray, v: np.ndarray) -> dict:
    data: dict = {group: None}
    p = u.shape[1]
    data |= {f"u{i}": u[:, i] for i in range(p)} | {f"b{i}": b[:, i] for i in range(p)}
    data |= {f"v{i}_{j}": v[:, i, j] for i, j in _triangle(p)}
    return data


def _lower(theta: np.ndarray, p: int) -> np.ndarray:
    return likelihood.unpacked(theta[..., 1 : 1 + p * (p + 1) // 2], p)


def _moved(p: int) -> Callable:
    """How far one parameter set is from another: the intercept and other numbers as they are, the spread by its size."""

    def run(old: np.ndarray, new: np.ndarray) -> float:
        first, second = (x @ x.T for x in (_lower(old, p), _lower(new, p)))
        change = np.max(np.abs(second - first)) / max(np.max(np.abs(second)), NO_SPREAD)
        other = np.append(new[0] - old[0], new[1 + p * (p + 1) // 2 :] - old[1 + p * (p + 1) // 2 :])
        return float(max(change, np.max(np.abs(other))))

    return run


def _objective(tables: Callable, terms: Callable, p: int) -> Callable:
    """Log posterior of many parameter sets: ``terms(rooms, thetas, gradient)`` summed over all rooms, and the prior.

    ``tables()`` gives pairs (table, reader of a batch's rooms, many at once). Every task yields its sums only.
    """

    def evaluate(thetas: np.ndarray, gradient: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
        sets, d = thetas.shape

        def sums(read: Callable) -> Callable:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total = np.zeros((sets, 1 + d))
                for batch in batches:
                    for _, rooms in read(batch):
                        for _, some, value, slope in terms(rooms, thetas, gradient):
                            total[some, 0] += value.sum(axis=0)
                            if gradient:
                                total[some, 1:] += slope.sum(axis=0)
                cells = total.ravel() if gradient else total[:, 0].copy()
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], names=["cell", "value"])

            return run

        parts = [table.mapInArrow(sums(read), "cell long, value double") for table, read in tables()]
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.union(part)
        # One number for each set and parameter comes to the driver, whatever the number of rooms. The tasks' sums are
        # added in order of size: in the order they come in, the last bits, and with them the search, would change from run to run.
        total = F.aggregate(F.array_sort(F.collect_list("value")), F.lit(0.0), lambda a, b: a + b)
        found = whole.groupBy("cell").agg(total.alias("value")).toPandas().sort_values("cell")["value"].to_numpy()
        prior, slope = likelihood.log_prior(thetas, p)
        if not gradient:
            return found + prior, None
        total = found.reshape(sets, 1 + d)
        return total[:, 0] + prior, total[:, 1:] + slope

    return evaluate


def _dealt(rooms: DataFrame, group: str) -> DataFrame:
    """A row for each room, dealt to all tasks, in an order of its own.

    A repartition by the room itself is one the rows already have where both have as many parts, so it is left out and
    the parts, small as they are, are put together: passes would then run in one task.
    """
    return rooms.repartition(rooms.sparkSession.sparkContext.defaultParallelism, F.xxhash64(group)).sortWithinPartitions(group)


def _parts(many: int, sets: int, size: int) -> Iterator[tuple[slice, slice]]:
    """Rooms and sets, cut so that ``size`` numbers for each pair of them stay within ``CELLS``."""
    columns = max(1, min(sets, CELLS // size))
    rows = max(1, CELLS // (size * columns))
    for i in range(0, many, rows):
        for j in range(0, sets, columns):
            yield slice(i, i + rows), slice(j, j + columns)


def _listed(batch: pa.RecordBatch, p: int) -> Iterator[tuple[np.ndarray, likelihood.Rows]]:
    """The rooms of a batch whose patterns stand in one row, with their places: rooms of about one size together."""
    lists = batch.column("patterns")
    cells = lists.flatten()
    x = np.stack([cells.field(f"x{i}").to_numpy(zero_copy_only=False) for i in range(p)], axis=1)
    n, k = (cells.field(c).to_numpy(zero_copy_only=False) for c in "nk")
    sizes = np.diff(lists.offsets.to_numpy())
    first, order = np.concatenate([[0], np.cumsum(sizes)])[:-1], np.argsort(sizes, kind="stable")
    start = 0
    while start < len(order):
        end = int(np.searchsorted(sizes[order], sizes[order[start]] * 1.25 + 2, side="right"))
        end = min(end, start + max(1, CELLS // max(int(sizes[order[start]]) * p * p, 1)))
        rooms = order[start:end]
        place = np.arange(sizes[rooms].max())
        there = place < sizes[rooms, None]
        at = np.where(there, first[rooms, None] + place, first[rooms, None])
        yield rooms, likelihood.Rows(np.where(there[..., None], x[at], 0.0), np.where(there, n[at], 0.0), np.where(there, k[at], 0.0))
        start = end


def _expanded(batch: pa.RecordBatch, p: int) -> Iterator[tuple[np.ndarray, likelihood.Expansion]]:
    """The large rooms of a batch, by their derivatives, with their places."""
    get = lambda name: batch.column(name).to_numpy(zero_copy_only=False)
    n = batch.num_rows
    if not n:
        return
    centre, g = (np.stack([get(f"{c}{i}") for i in range(p)], axis=1) for c in "cg")
    h, t = np.zeros((n, p, p)), np.zeros((n, p, p, p))
    for i, j in _triangle(p):
        h[:, i, j] = h[:, j, i] = get(f"h{i}_{j}")
    for where in combinations_with_replacement(range(p), 3):
        for i, j, k in set(permutations(where)):
            t[:, i, j, k] = get("t" + "_".join(map(str, where)))
    yield np.arange(n), likelihood.Expansion(centre, np.array(get("loglik"), float), g, h, t)


def _bernoulli_terms(p: int, nodes: int | None) -> Callable:
    """Rooms' log integrals and gradients, in parts: (rooms, sets, values, gradients)."""

    def run(rooms, thetas: np.ndarray, gradient: bool = True) -> Iterator[tuple]:
        listed = isinstance(rooms, likelihood.Rows)  # a large room needs no nodes
        many, size = (rooms.n.shape[0], rooms.n.shape[1] * (nodes**p if nodes else 1)) if listed else (len(rooms.base), 1)
        if listed and nodes is None:
            middle, rows = np.median(thetas, axis=0), max(1, FITTING // (size * min(TOGETHER, len(thetas))))
            for i in range(0, many, rows):
                some = slice(i, i + rows)
                near = likelihood.Laplace(rooms[some], middle[0], _lower(middle, p))
                columns = max(1, FITTING // (size * len(near.x)))
                for j in range(0, len(thetas), columns):
                    sets = slice(j, j + columns)
                    yield some, sets, *near.terms(thetas[sets, 0], _lower(thetas[sets], p), gradient)[:2]
            return
        for some, sets in _parts(many, len(thetas), max(size, p**3)):
            found = likelihood.room_terms(rooms[some], thetas[sets, 0], _lower(thetas[sets], p), nodes if listed else None, gradient)
            yield some, sets, *found[:2]

    return run


def _expansions(patterns: DataFrame, centres: DataFrame, group: str, p: int) -> DataFrame:
    """Derivatives of the large rooms' log likelihood at their centres (key, ``c<i>``), a row for each room."""
    rows = spread_join(patterns, centres, [group], rows="patterns")
    eta = " + ".join(f"x{i} * c{i}" for i in range(p))
    rows = with_score(rows.withColumn("_eta", F.expr(eta)))
    third = [
        F.expr(f"sum(_w * (1 - 2 / (1 + exp(-_eta))) * x{i} * x{j} * x{k}) AS t{i}_{j}_{k}")
        for i, j, k in combinations_with_replacement(range(p), 3)
    ]
    kept = [F.expr(f"first(c{i}) AS c{i}") for i in range(p)]
    return cut_lineage(rows.groupBy(group).agg(*score_sums(p), *third, *kept, F.count(F.lit(1)).alias("patterns")))


def _followed(far: DataFrame, theta: np.ndarray, group: str, kind: str, p: int) -> DataFrame:
    """The large rooms' modes under ``theta``, as new centres."""
    lower = _lower(theta, p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = [likelihood.modes(rooms, theta[:1], lower[None])[:, 0] for _, rooms in _expanded(batch, p)]
            beta = np.concatenate([np.zeros((0, p)), *z]) @ lower.T
            beta[:, 0] += theta[0]
            yield pa.RecordBatch.from_arrays(
                [batch.column(group), batch.column("patterns"), *[pa.array(beta[:, i].copy()) for i in range(p)]],
                names=[group, "patterns", *[f"c{i}" for i in range(p)]],
            )

    columns = ", ".join([f"{group} {kind}", "patterns bigint", *[f"c{i} double" for i in range(p)]])
    return cut_lineage(far.mapInArrow(run, columns))


def _effects(table: DataFrame, read: Callable, theta: np.ndarray, group: str, kind: str, p: int) -> DataFrame:
    """Effects of all rooms of a table under ``theta``, with ``schur``, what a room says of the intercept once its effect is taken out."""
    lower = _lower(theta, p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            u, b, v, schur = np.zeros((n, p)), np.zeros((n, p)), np.zeros((n, p, p)), np.zeros(n)
            for at, rooms in read(batch):
                u[at] = likelihood.modes(rooms, theta[:1], lower[None])[:, 0] @ lower.T
                beta = u[at] + np.eye(p)[0] * theta[0]
                h = rooms.at(beta[:, None])[2][:, 0]
                v[at] = lower @ np.linalg.inv(np.eye(p) + lower.T @ h @ lower) @ lower.T
                b[at] = -(v[at] @ h[:, :, :1])[:, :, 0]
                schur[at] = h[:, 0, 0] + (h[:, 0] * b[at]).sum(axis=1)
            found = _effect_rows(group, u, b, v) | {"schur": schur}
            yield pa.RecordBatch.from_arrays([batch.column(group), *[pa.array(x, pa.float64()) for c, x in found.items() if c != group]], names=list(found))

    return table.mapInArrow(run, _effect_schema(group, kind, p) + ", schur double")


def _unsettled(passes: int, change: float) -> None:
    warnings.warn(f"the room spread still moves by {change:.2g} of its size after {passes} passes: not converged", stacklevel=3)


def fit_rooms(
    frame: DataFrame,
    design: Design,
    group: str = "subject_room_id",
    outcome: str = "scv2_detected",
    rounds: int = 60,
    tolerance: float = 1e-4,
    start: float = 1.0,
    held: int = HELD,
    nodes: int | None = None,
) -> RoomFit:
    """Bernoulli outcome with room-level effects of every design column.

    A pass evaluates a few lengths of one Newton step over all rooms. The search
    ends when the next whole step would change the intercept, or the spread relative to
    its size, by less than ``tolerance``, at the latest after ``rounds`` passes; ``start``
    is the first variance. ``nodes`` in each direction integrate a room's effect (one or
    two effects; by default as many as ``NODES`` says); more effects go by Laplace's method.
    """
    p = len(design.parameters)
    nodes = nodes or likelihood.NODES.get(p)
    patterns = cut_lineage(bernoulli_patterns(frame, design, outcome, [group]))
    kind = patterns.schema[group].dataType.simpleString()
    sizes = patterns.groupBy(group).agg(F.count(F.lit(1)).alias("patterns"))
    largest, rows = sizes.agg(F.max("patterns")).first()[0] or 0, patterns.agg(F.sum("n")).first()[0] or 0.0
    large = largest > held
    few = keyed_join(patterns, sizes.where(F.col("patterns") <= held), [group], "left_semi") if large else patterns
    lists = F.sort_array(F.collect_list(F.struct(*[f"x{i}" for i in range(p)], "n", "k")))  # at most ``held`` a room
    small = cut_lineage(_dealt(few.groupBy(group).agg(lists.alias("patterns")), group))
    far = None
    tables = lambda: [(small, lambda batch: _listed(batch, p)), *([(far, lambda batch: _expanded(batch, p))] if large else [])]
    terms = _bernoulli_terms(p, nodes)
    evaluate = _objective(tables, terms, p)

    theta = np.concatenate([[0.0], likelihood.packed(np.sqrt(start) * np.eye(p))])
    history, passes, shift = [], 0, 0.0
    if large:
        some = keyed_join(patterns, sizes.where(F.col("patterns") > held), [group], "left_semi")
        centres = sizes.where(F.col("patterns") > held).selectExpr("*", *[f"0D AS c{i}" for i in range(p)])
    for search in range(SEARCHES):
        if large:
            for _ in range(LATER_MOVES if search else FIRST_MOVES):
                centres = _followed(_expansions(some, centres, group, p), theta, group, kind, p)
            far = _expansions(some, centres, group, p)
        best = likelihood.maximise(evaluate, theta, tolerance, rounds - passes, _moved(p))
        shift = _moved(p)(theta, best.theta)
        theta, passes, history = best.theta, passes + best.passes, history + best.history
        if not large or (search and shift < tolerance) or passes >= rounds:
            break
    converged = best.converged and (not large or shift < tolerance)
    if not converged:
        _unsettled(passes, best.change)
    found = [_effects(table, read, theta, group, kind, p) for table, read in tables()]
    effects = cut_lineage(found[0] if len(found) == 1 else found[0].union(found[1]))
    schur = effects.agg(F.sum("schur")).first()[0] or 0.0
    lower = _lower(theta, p)
    return RoomFit(
        design, group, "bernoulli", float(theta[0]), float(1.0 / np.sqrt(schur + 1.0)), lower @ lower.T, effects.drop("schur"), rows=rows,
        history=history, converged=converged, passes=passes, theta=theta, objective=evaluate, tables=tables, terms=terms,
    )


@dataclass
class Products:
    """Cross products of rooms' design rows and log quantities."""

    h: np.ndarray
    g: np.ndarray
    n: np.ndarray
    y: np.ndarray
    yy: np.ndarray

    def __getitem__(self, some) -> Products:
        return Products(self.h[some], self.g[some], self.n[some], self.y[some], self.yy[some])


def _products(batch: pa.RecordBatch, p: int) -> Iterator[tuple[np.ndarray, Products]]:
    frame = batch.to_pandas()
    yield np.arange(len(frame)), Products(_matrices(frame, "h", p), _vectors(frame, "g", p), *(frame[c].to_numpy(float) for c in ("n", "y", "yy")))


def fit_rooms_lognormal(
    frame: DataFrame,
    design: Design,
    group: str = "subject_room_id",
    quantity: str = "copies_max",
    rounds: int = 60,
    tolerance: float = 1e-4,
) -> RoomFit:
    """Hurdle lognormal with room-level effects; the marginal likelihood of the logarithms is exact.

    Undetected rows only feed the hurdle share. The cross products of a room are
    summed once; the passes then touch one row per room.
    """
    p = len(design.parameters)
    used = frame.dropna(subset=[*design.columns, group])
    detected = is_detected(F.col(quantity)) & (F.col(quantity) > 0)
    share = used.agg(F.avg((~detected).cast("double")), F.count(F.lit(1))).first()
    rows = design_columns(used.where(detected).withColumn("_y", F.log(quantity)), design, keep=[group, "_y"])
    sums = [f"sum(x{i} * x{j}) AS h{i}_{j}" for i, j in _triangle(p)]
    sums += [f"sum(x{i} * _y) AS g{i}" for i in range(p)]
    sums += ["sum(_y * _y) AS yy", "sum(_y) AS y", "count(1) AS n"]
    tasks = frame.sparkSession.sparkContext.defaultParallelism
    products = cut_lineage(rows.groupBy(group).agg(*[F.expr(t) for t in sums]).repartition(tasks, group))
    y, yy, total = (products.agg(F.sum("y"), F.sum("yy"), F.sum("n")).first()[i] or 0.0 for i in range(3))
    mean = y / max(total, 1)

    def terms(rooms: Products, thetas: np.ndarray, gradient: bool = True) -> Iterator[tuple]:
        for some, sets in _parts(len(rooms.n), len(thetas), p**3):
            r, t = rooms[some], thetas[sets]
            sigma = np.exp(np.clip(t[:, -1], -20, 20))
            yield some, sets, *likelihood.gaussian_terms(r.h, r.g, r.n, r.y, r.yy, t[:, 0], _lower(t, p), sigma)[:2]

    read = lambda batch: _products(batch, p)
    tables = lambda: [(products, read)]
    evaluate = _objective(tables, terms, p)
    theta = np.concatenate([[mean], likelihood.packed(np.eye(p)), [0.5 * np.log(max(yy / max(total, 1) - mean**2, 1e-6))]])
    best = likelihood.maximise(evaluate, theta, tolerance, rounds, _moved(p))
    if not best.converged:
        _unsettled(best.passes, best.change)
    theta, kind = best.theta, products.schema[group].dataType.simpleString()
    lower, sigma = _lower(theta, p), float(np.exp(theta[-1]))

    def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, r = next(read(batch))
            _, _, z, cover = likelihood.gaussian_terms(r.h, r.g, r.n, r.y, r.yy, theta[:1], lower[None], np.array([sigma]))
            u, v = z[:, 0] @ lower.T, lower @ cover[:, 0] @ lower.T
            b = -(v @ r.h[:, :, :1])[:, :, 0] / sigma**2
            found = _effect_rows(group, u, b, v) | {"schur": (r.n + (r.h[:, 0] * b).sum(axis=1)) / sigma**2}
            yield pa.RecordBatch.from_arrays([batch.column(group), *[pa.array(x, pa.float64()) for c, x in found.items() if c != group]], names=list(found))

    table = cut_lineage(products.mapInArrow(effects, _effect_schema(group, kind, p) + ", schur double"))
    schur = table.agg(F.sum("schur")).first()[0] or 0.0
    return RoomFit(
        design, group, "hurdle_lognormal", float(theta[0]), float(1.0 / np.sqrt(schur + 1.0)), lower @ lower.T, table.drop("schur"),
        sigma=sigma, hurdle=float(share[0] or 0.0), rows=float(share[1]), history=best.history, converged=best.converged, passes=best.passes,
        theta=theta, objective=evaluate, tables=tables, terms=terms,
    )


def parameter_names(fit: RoomFit) -> list[str]:
    """Intercept, standard deviations and correlations of the room effects, then sigma and hu where the model has them."""
    terms = [name.removeprefix("b_") for name in fit.design.parameters]
    names = ["b_Intercept", *[f"sd_{fit.group}__{t}" for t in terms]]
    names += [f"cor_{fit.group}__{terms[i]}__{terms[j]}" for j in range(len(terms)) for i in range(j)]
    return names + (["sigma", "hu"] if fit.sigma is not None else [])


def _theta_draws(fit: RoomFit, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(parameter sets, normal scores, weights): normal around the mode with the inverse information, weighted to the posterior."""
    theta, d = fit.theta, len(fit.theta)
    curved, axes = np.linalg.eigh(likelihood.information(fit.objective, theta))
    # A direction in which the posterior is flat or bends the wrong way is held to the prior's scale.
    curved = np.maximum(curved, 1.0)
    roots = np.sqrt(np.array(primes(d + 1), float))
    uniform = (np.arange(1, count + 1)[:, None] * roots[None, :]) % 1.0
    z = inverse_normal_array(np.clip(uniform, 1e-9, 1 - 1e-9))
    thetas = theta + (z[:, :d] / np.sqrt(curved)) @ axes.T
    logw = fit.objective(thetas, False)[0] + 0.5 * (z[:, :d] ** 2).sum(axis=1)
    weight = np.exp(logw - logw.max())
    return thetas, z, weight / weight.sum()


def parameter_draws(fit: RoomFit, count: int) -> tuple[DataFrame, DataFrame, float]:
    """Draws of the population parameters (``draw`` and ``parameter_names``), their weights (draw, weight), the effective sample size.

    Draws are normal around the mode with the inverse information, whose second
    derivatives come from one pass; the weight of a draw is its posterior (the sum over
    rooms of their log integrals, one more pass) over its normal density.
    """
    p, spark, d = len(fit.design.parameters), fit.effects.sparkSession, len(fit.theta)
    thetas, z, weight = _theta_draws(fit, count)
    lower = _lower(thetas, p)
    spread = lower @ lower.transpose(0, 2, 1)
    sd = np.sqrt(np.diagonal(spread, axis1=1, axis2=2))
    cor = spread / np.maximum(sd[:, :, None] * sd[:, None, :], 1e-300)
    columns = [thetas[:, 0], *sd.T, *[cor[:, i, j] for j in range(p) for i in range(j)]]
    if fit.sigma is not None:
        share = min(max(fit.hurdle, 0.5 / fit.rows), 1 - 0.5 / fit.rows)
        logit = np.log(share / (1 - share)) + z[:, d] / np.sqrt(fit.rows * share * (1 - share))
        columns += [np.exp(thetas[:, -1]), 1 / (1 + np.exp(-logit))]
    table = pd.DataFrame({"draw": np.arange(count), **dict(zip(parameter_names(fit), columns, strict=True))})
    size = float(1.0 / (weight**2).sum())
    if size < 0.5 * count:
        warnings.warn(f"effective sample size {size:.0f} of {count}: the approximation is poor", stacklevel=2)
    return spark.createDataFrame(table), spark.createDataFrame(pd.DataFrame({"draw": np.arange(count), "weight": weight})), size


def leave_room_out(fit: RoomFit, count: int = 1000) -> DataFrame:
    """Score of every room as if it were new: key, ``elpd`` and ``shape`` of the tail (large: not to be trusted).

    A new room's effect is integrated out, so a draw of the population parameters gives a
    room one number; the posterior without the room comes from reweighting these draws, with
    smoothed tails. Draws are resampled by their weights first. Rooms stay where they lie.
    For normal rows the score is that of the logarithms of detected quantities.
    """
    from tracelight.plans.checks import smoothed_scores

    thetas, _, weight = _theta_draws(fit, count)
    thetas = thetas[np.minimum(np.searchsorted(np.cumsum(weight), (np.arange(count) + 0.5) / count), count - 1)]
    group, kind, terms = fit.group, fit.effects.schema[fit.group].dataType.simpleString(), fit.terms

    def scored(read: Callable) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                elpd, shape = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
                for at, rooms in read(batch):
                    for i in range(0, len(at), SCORED):
                        some = at[i : i + SCORED]
                        each = np.zeros((len(some), count))
                        for part, sets, value, _ in terms(rooms[i : i + SCORED], thetas, False):
                            each[part, sets] = value
                        elpd[some], shape[some] = smoothed_scores(each)
                yield pa.RecordBatch.from_arrays([batch.column(group), pa.array(elpd, pa.float64()), pa.array(shape, pa.float64())], names=[group, "elpd", "shape"])

        return run

    parts = [table.mapInArrow(scored(read), f"{group} {kind}, elpd double, shape double") for table, read in fit.tables()]
    return parts[0] if len(parts) == 1 else parts[0].union(parts[1])


def _sampler(fit: RoomFit, count: int) -> Callable:
    """Draws of ``intercept + x'u`` for a table of rooms, as (room, draw, p)."""
    p = len(fit.design.parameters)
    intercept, intercept_sd = fit.intercept, fit.intercept_sd
    steps = np.arange(1, count + 1)[:, None] * np.sqrt(np.array(primes(p + 1), float))[None, :]
    common = intercept + intercept_sd * inverse_normal_array(np.clip(steps[:, p] % 1.0, 1e-9, 1 - 1e-9))

    def run(part: pd.DataFrame) -> np.ndarray:
        lower = np.linalg.cholesky(_matrices(part, "v", p) + 1e-12 * np.eye(p))
        uniform = (steps[None, :, :p] + _vectors(part, "s", p)[:, None, :]) % 1.0
        z = inverse_normal_array(np.clip(uniform, 1e-9, 1 - 1e-9))
        values = _vectors(part, "u", p)[:, None, :] + np.einsum("rij,rdj->rdi", lower, z)
        # A room moves with the intercept's draw, so the two keep their covariance.
        values += _vectors(part, "b", p)[:, None, :] * (common - intercept)[None, :, None]
        values[:, :, 0] += common[None, :]
        return values

    return run


def _shifted_effects(fit: RoomFit) -> DataFrame:
    """The rooms' effects with ``s<i>``, by which a room's low-discrepancy sequence is shifted: a hash of its key."""
    shifts = [
        (F.pmod(F.xxhash64(F.col(fit.group), F.lit(i)), F.lit(1 << 30)) / F.lit(float(1 << 30))).alias(f"s{i}")
        for i in range(len(fit.design.parameters))
    ]
    return fit.effects.select("*", *shifts)


def room_draws(fit: RoomFit, count: int) -> DataFrame:
    """Draws of ``intercept + x'u`` per room: key, ``draw``, ``b<i>`` (and ``sigma``, ``hu``).

    The low-discrepancy sequence of a room is shifted by a hash of its key; the
    intercept's sequence is shared by all rooms.
    """
    p = len(fit.design.parameters)
    group, kind = fit.group, fit.effects.schema[fit.group].dataType.simpleString()
    sigma, hurdle, draw = fit.sigma, fit.hurdle, _sampler(fit, count)

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), ROOMS_PER_BATCH):
                part = batch.iloc[start : start + ROOMS_PER_BATCH]
                values = draw(part)
                data = {
                    group: np.repeat(part[group].to_numpy(), count),
                    "draw": np.tile(np.arange(count, dtype="int64"), len(part)),
                }
                data |= {f"b{i}": values[:, :, i].ravel() for i in range(p)}
                if sigma is not None:
                    data |= {"sigma": sigma, "hu": hurdle}
                yield pd.DataFrame(data)

    names = [f"b{i}" for i in range(p)] + (["sigma", "hu"] if sigma is not None else [])
    schema = ", ".join([f"{group} {kind}", "draw bigint", *[f"{n} double" for n in names]])
    return _shifted_effects(fit).mapInPandas(sample, schema)


def _curves(fit: RoomFit, grid: DataFrame, count: int, columns: str, reduce: Callable) -> DataFrame:
    """Grid rows and what ``reduce`` makes of (place in the batch, expected outcomes by grid row and draw) of each of their rooms.

    A room's effects, not its draws, meet its grid rows: draws are made where these lie and are rows nowhere, so
    neither a join nor a broadcast grows with their number.
    """
    p, draw = len(fit.design.parameters), _sampler(fit, count)
    family, sigma, hurdle = fit.family, fit.sigma, fit.hurdle
    x = F.array(*[c.cast("double") for c in fit.design.expressions().values()])
    points = grid.select(fit.group, F.struct(*grid.columns).alias("point"), x.alias("x"))
    # A grid is exploded from few rows, which may lie in one task.
    points = points.repartition(grid.sparkSession.sparkContext.defaultParallelism, fit.group)
    effects = _shifted_effects(fit)
    numbers = [c for c in effects.columns if c != fit.group]
    group, joined = fit.group, keyed_join(points, effects, [fit.group], "inner")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rooms = batch.column(group).to_pandas()
            at = np.flatnonzero((rooms != rooms.shift()).to_numpy()) if len(rooms) else np.array([], int)
            design = np.array(batch.column("x").flatten().to_numpy(zero_copy_only=False), float).reshape(-1, p)
            parts = pa.table({c: batch.column(c).take(pa.array(at)) for c in numbers}).to_pandas()
            for i, (a, b) in enumerate(zip(at, [*at[1:], len(rooms)])):
                found = draw(parts.iloc[i : i + 1])[0]
                # Term by term: a matrix product would start threads of its own in every task.
                eta = sum(design[a:b, j, None] * found[:, j] for j in range(p))
                value = 1.0 / (1.0 + np.exp(-eta)) if family == "bernoulli" else (1.0 - hurdle) * np.exp(eta + sigma * sigma / 2.0)
                yield reduce(batch.column("point").slice(a, b - a), value)

    schema = StructType([points.schema["point"]])
    for field_ in StructType.fromDDL(columns):
        schema = schema.add(field_)
    names = [f.name for f in StructType.fromDDL(columns)]
    return joined.mapInArrow(run, schema).select("point.*", *names)


def room_curves(fit: RoomFit, grid: DataFrame, count: int) -> DataFrame:
    """Expected outcome of every room over its grid rows, one row per draw."""

    def rows(point: pa.Array, value: np.ndarray) -> pa.RecordBatch:
        many, draws = value.shape
        repeated = point.take(pa.array(np.repeat(np.arange(many), draws)))
        return pa.RecordBatch.from_arrays([repeated, pa.array(np.tile(np.arange(draws), many)), pa.array(value.ravel())], names=["point", "draw", "epred"])

    return _curves(fit, grid, count, "draw bigint, epred double", rows)


def room_medians(fit: RoomFit, grid: DataFrame, count: int) -> DataFrame:
    """Median over the draws of every room's expected outcome, at each of its grid rows."""

    def rows(point: pa.Array, value: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([point, pa.array(np.median(value, axis=1), from_pandas=True)], names=["point", "epred"])

    return _curves(fit, grid, count, "epred double", rows)
