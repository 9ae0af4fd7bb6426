"""Design columns, parameter listings and sufficient statistics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelight.schemas import SEVERITY_LEVELS

# Level order of the factors; the first level is the reference.
FACTOR_LEVELS: dict[str, list] = {
    "site_category": ["Elevated", "Floor"],
    "high_touch": [False, True],
    "covid_severity": SEVERITY_LEVELS,
}


@dataclass(frozen=True)
class Design:
    """Linear predictor: an intercept, single columns and column products.

    A term is a column name or a tuple of names for an interaction. Factors use
    treatment contrasts against their first level.
    """

    terms: tuple = ()
    intercept: bool = True
    levels: dict = field(default_factory=lambda: dict(FACTOR_LEVELS))

    @property
    def columns(self) -> list[str]:
        names: list[str] = []
        for term in self.terms:
            names += [term] if isinstance(term, str) else list(term)
        return list(dict.fromkeys(names))

    def _pieces(self, name: str) -> list[tuple[str, object]]:
        """(label, level) of a column; the level is None for a numeric column."""
        if name not in self.levels:
            return [(name, None)]
        others = self.levels[name][1:]
        labels = [str(v).upper() if isinstance(v, bool) else str(v).replace(" ", "") for v in others]
        return [(f"{name}{label}", level) for label, level in zip(labels, others)]

    def _parts(self) -> dict[str, list[tuple[str, object]]]:
        """Label of every design column and the (column, level) pairs it multiplies."""
        found: dict[str, list] = {"Intercept": []} if self.intercept else {}
        singles = [(t,) for t in self.terms if isinstance(t, str)]
        products = [t for t in self.terms if not isinstance(t, str)]
        for term in singles + products:
            choices = [[(label, name, level) for label, level in self._pieces(name)] for name in term]
            for combination in product(*choices):
                found[":".join(label for label, _, _ in combination)] = [(n, v) for _, n, v in combination]
        return found

    @property
    def parameters(self) -> list[str]:
        return [f"b_{label}" for label in self._parts()]

    def expressions(self) -> dict[str, Column]:
        """Label to design column; interactions come after the main terms."""

        def column(name: str, level: object) -> Column:
            return (F.col(name) if level is None else F.col(name) == F.lit(level)).cast("double")

        return {
            label: reduce(lambda a, b: a * b, [column(n, v) for n, v in pairs]) if pairs else F.lit(1.0)
            for label, pairs in self._parts().items()
        }


def design_columns(frame: DataFrame, design: Design, keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` columns plus one double column ``x<i>`` per parameter."""
    columns = [c.alias(f"x{i}") for i, c in enumerate(design.expressions().values())]
    return frame.select(*keep, *columns)


def bernoulli_patterns(
    frame: DataFrame, design: Design, outcome: str = "scv2_detected", keys: Sequence[str] = ()
) -> DataFrame:
    """Lossless statistics of a bernoulli fit: trials ``n`` and successes ``k`` per design row.

    Rows that miss the outcome or a used column are dropped, as a fit would.
    """
    used = list(dict.fromkeys([outcome, *design.columns, *keys]))
    rows = frame.select(*used).dropna()
    names = design.columns
    counts = rows.groupBy(*dict.fromkeys([*keys, *names])).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col(outcome).cast("double")).alias("k")
    )
    return design_columns(counts, design, keep=[*keys, "n", "k"])


def linear_predictor(values: Sequence[Column], design: Design) -> Column:
    """``sum(beta_i * x_i)`` with the design evaluated on the current row."""
    products = [value * x for value, x in zip(values, design.expressions().values())]
    return reduce(lambda a, b: a + b, products)


def parameter_listing(
    design: Design,
    family: str,
    group: str | None = None,
    group_terms: Sequence[str] = (),
    priors: dict[str, str] | None = None,
) -> list[tuple[str, str, str, str]]:
    """Rows (prior, class, coef, group) a model of this design has.

    Defaults are the usual weakly-informative ones; ``priors`` overrides by class.
    """
    default = {
        "Intercept": "student_t(3, 0, 2.5)", "b": "", "sd": "student_t(3, 0, 2.5)",
        "cor": "lkj(1)", "sigma": "student_t(3, 0, 2.5)", "hu": "beta(1, 1)",
    } | (priors or {})
    rows = []
    slopes = [p.removeprefix("b_") for p in design.parameters if p != "b_Intercept"]
    if slopes:
        rows.append((default["b"], "b", "", ""))
        rows += [(default["b"], "b", name, "") for name in slopes]
    if design.intercept:
        rows.append((default["Intercept"], "Intercept", "", ""))
    if group is not None:
        rows.append((default["sd"], "sd", "", ""))
        rows.append((default["sd"], "sd", "", group))
        rows += [(default["sd"], "sd", term, group) for term in group_terms]
        if len(group_terms) > 1:
            rows.append((default["cor"], "cor", "", ""))
            rows.append((default["cor"], "cor", "", group))
    if family in ("gaussian", "hurdle_lognormal"):
        rows.append((default["sigma"], "sigma", "", ""))
    if family == "hurdle_lognormal":
        rows.append((default["hu"], "hu", "", ""))
    return rows


def observed_parameters(frame: DataFrame, numeric: Sequence[str], factors: Sequence[str]) -> DataFrame:
    """Coefficient names implied by the levels that occur, as (class, coef) rows.

    One row per numeric column and per non-reference level; the lowest level in
    sort order is the reference.
    """
    sets = [F.sort_array(F.collect_set(F.col(c).cast("string"))).alias(c) for c in factors]
    found = frame.agg(*sets) if sets else frame.sparkSession.range(1)
    names = [F.array(F.lit("Intercept"), *[F.lit(n) for n in numeric])]
    for factor in factors:
        others = F.slice(F.col(factor), F.lit(2), F.greatest(F.size(factor) - 1, F.lit(0)))
        names.append(
            F.transform(others, lambda level: F.concat(F.lit(factor), F.regexp_replace(
                F.when(level == "true", "TRUE").when(level == "false", "FALSE").otherwise(level), " ", "")))
        )
    return found.select(F.explode(F.concat(*names)).alias("coef")).select(
        F.when(F.col("coef") == "Intercept", "Intercept").otherwise("b").alias("class"), "coef"
    )


# The priors a model has by default, by class.
DEFAULT_PRIORS = {
    "Intercept": "student_t(3, 0, 2.5)", "b": "", "sd": "student_t(3, 0, 2.5)", "cor": "lkj(1)", "sigma": "student_t(3, 0, 2.5)", "hu": "beta(1, 1)",
}


def prior_listing(
    frame: DataFrame, design: Design, family: str, group: str | None = None, priors: dict[str, str] | None = None
) -> DataFrame:
    """Parameters that a model of this design has on the rows of ``frame``, and their priors: prior, class, coef, group.

    Coefficients come from the levels that occur. With ``group`` every design column varies by
    it (standard deviations and correlations) and has no coefficient of its own. A class has one
    row without a coefficient, whose prior holds for all of them. ``priors`` overrides by class.
    """
    texts = DEFAULT_PRIORS | (priors or {})
    factors = [c for c in design.columns if c in design.levels]
    found = observed_parameters(frame.dropna(subset=design.columns), [c for c in design.columns if c not in design.levels], factors)
    slopes, every = found.where("class = 'b'"), found.select("coef")

    def rows(kind: str, source: DataFrame | None = None, of: str = "") -> DataFrame:
        source = frame.sparkSession.range(1).select(F.lit("").alias("coef")) if source is None else source
        return source.select(F.lit(texts[kind]).alias("prior"), F.lit(kind).alias("class"), "coef", F.lit(of).alias("group"))

    parts = [rows("Intercept")]
    if group is None:
        some = slopes.limit(1).select(F.lit("").alias("coef"))  # the class itself, where it has members
        parts += [rows("b", some), rows("b", slopes)]
    else:
        several = slopes.limit(1).select(F.lit("").alias("coef"))
        parts += [rows("sd"), rows("sd", None, group), rows("sd", every, group), rows("cor", several), rows("cor", several, group)]
    if family in ("gaussian", "hurdle_lognormal"):
        parts.append(rows("sigma"))
    if family == "hurdle_lognormal":
        parts.append(rows("hu"))
    return reduce(DataFrame.unionByName, parts)
