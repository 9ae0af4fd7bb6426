"""The models the analyses use, by name, and one call that fits any of them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.operators.groups import standard_score
from tracelight.operators.prep import analysis_table
from tracelight.plans.design import Design
from tracelight.plans.fits import Fit, fit_bernoulli, fit_hurdle, least_squares
from tracelight.plans.mixture import integrate
from tracelight.plans.pooling import Pooled
from tracelight.plans.rooms import RoomFit, fit_rooms, fit_rooms_lognormal
from tracelight.sources.model_store import ModelInfo

DISTANCE, TIME, WAVE = "distance", "subject_covid_day", "total_study_day"
SITE, TOUCH, SEVERITY = "site_category", "high_touch", "covid_severity"


@dataclass(frozen=True)
class Model:
    """One regression: family, analysis variant, linear predictor and its strata."""

    family: str
    variant: str
    terms: tuple
    strata: tuple[str, ...] = ()
    room_level: bool = False
    scaled: str | None = None

    @property
    def design(self) -> Design:
        return Design(self.terms)


def _pair(axis: str, variant: str, fixed_variant: str, room_variant: str, scaled: str | None) -> dict[str, Model]:
    """The ten models of one axis: three families by strata, then fixed and room-level terms."""
    name = "distance" if axis == DISTANCE else "time"
    models = {}
    for prefix, family, scale in (
        ("binom", "bernoulli", None), ("linear", "gaussian", scaled), ("hurdle", "hurdle_lognormal", scaled)
    ):
        models[f"{prefix}_{name}_mix_category"] = Model(family, variant, (axis,), (SITE,), scaled=scale)
        models[f"{prefix}_{name}_mix_category_touch"] = Model(family, variant, (axis,), (SITE, TOUCH), scaled=scale)
    full = (axis, SITE, TOUCH)
    models[f"mvbinom_{name}_fix_category_touch"] = Model("bernoulli", fixed_variant, full)
    models[f"mvhurdle_{name}_fix_category_touch"] = Model("hurdle_lognormal", variant, full, scaled=scaled)
    models[f"mvbinom_{name}_category_touch_mix_subject"] = Model("bernoulli", room_variant, full, room_level=True)
    models[f"mvhurdle_{name}_category_touch_mix_subject"] = Model(
        "hurdle_lognormal", "longitudinal", full, room_level=True
    )
    return models


MODELS: dict[str, Model] = {
    **_pair(DISTANCE, "spatial", "spatial_days", "longitudinal", None),
    **_pair(TIME, "longitudinal", "longitudinal_days", "longitudinal_days", TIME),
    "mvbinom_time_adjust_wave": Model(
        "bernoulli", "longitudinal_days", (TIME, SITE, WAVE, TOUCH, (SITE, WAVE))
    ),
    "mvbinom_time_adjust_wave_severity": Model(
        "bernoulli", "severity", (TIME, SITE, WAVE, TOUCH, SEVERITY, (SITE, WAVE))
    ),
    "mvbinom_time_adjust_wave_severity_site": Model(
        "bernoulli", "severity", (TIME, SITE, WAVE, TOUCH, SEVERITY, (SITE, WAVE), (SITE, SEVERITY))
    ),
}

COMPARISONS: list[Sequence[str]] = [
    ("mvbinom_distance_fix_category_touch", "binom_distance_mix_category_touch", "binom_distance_mix_category"),
    ("mvhurdle_distance_fix_category_touch", "hurdle_distance_mix_category_touch", "hurdle_distance_mix_category"),
    ("mvbinom_time_fix_category_touch", "binom_time_mix_category_touch", "binom_time_mix_category"),
    ("mvhurdle_time_fix_category_touch", "hurdle_time_mix_category_touch", "hurdle_time_mix_category"),
    ("mvbinom_time_adjust_wave_severity", "mvbinom_time_adjust_wave_severity_site"),
]


def formula(name: str) -> str:
    """The model as text: outcome, terms, and the groups they vary by."""
    model = MODELS[name]
    outcome = {"bernoulli": "scv2_detected", "gaussian": "log10(copies_max)"}.get(model.family, "copies_max")
    terms = " + ".join(["1", *[t if isinstance(t, str) else ":".join(t) for t in model.terms]])
    groups = ["subject_room_id"] if model.room_level else ["/".join(model.strata)] if model.strata else []
    return f"{outcome} ~ ({terms} | {groups[0]})" if groups else f"{outcome} ~ {terms}"


def model_info(name: str, fit: Fit | Pooled | RoomFit) -> ModelInfo:
    """What the store says of a fitted model."""
    rows = sum(f.rows for f in fit.fits.values()) if isinstance(fit, Pooled) else fit.rows
    return ModelInfo(name, MODELS[name].family, formula(name), float(rows), bool(fit.converged))


def model_table(name: str, swabs: DataFrame, subjects: DataFrame | None = None) -> DataFrame:
    """Analysis table of a model; a scaled covariate uses all rows before any is dropped."""
    model = MODELS[name]
    table = analysis_table(swabs, model.variant, subjects)
    return table if model.scaled is None else standard_score(table, model.scaled)


def fit_model(
    name: str, swabs: DataFrame, subjects: DataFrame | None = None, rounds: int | None = None
) -> Fit | Pooled | RoomFit:
    """Fit one model of the catalogue; ``rounds`` limits the rounds of a room-level model."""
    return fit_table(name, model_table(name, swabs, subjects), rounds)


def fit_table(name: str, table: DataFrame, rounds: int | None = None) -> Fit | Pooled | RoomFit:
    """Fit one model of the catalogue to its analysis table."""
    model = MODELS[name]
    if model.room_level:
        fit = fit_rooms if model.family == "bernoulli" else fit_rooms_lognormal
        return fit(table, model.design, **({} if rounds is None else {"rounds": rounds}))
    if model.family == "bernoulli":
        fits = fit_bernoulli(table, model.design, keys=model.strata)
    elif model.family == "gaussian":
        fits = least_squares(table, model.design, F.log10("copies_max"), model.strata)
    else:
        fits = fit_hurdle(table, model.design, keys=model.strata)
    if not model.strata:
        return fits[()]
    # Models with a population intercept shrink to their common mean, others to zero.
    centre = None if model.family == "hurdle_lognormal" else np.zeros(len(model.design.parameters))
    return integrate(fits, centre)
