"""Numeric column rules: bands, per-pipe rates, thresholds, verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rivermeld.functions.parsing import column
from rivermeld.settings import (
    ACCEPTABLE_MATCH_M, GOOD_MATCH_M, NITRATE_LIMIT, PHOSPHATE_LIMIT, STATUS_TO_LABEL,
)


def lookup(key: Column | str, table: dict[str, str], default: Column | None = None) -> Column:
    """Value of a small fixed dictionary for a key column."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    found = F.try_element_at(F.create_map(*pairs), column(key))
    return found if default is None else F.coalesce(found, default)


def three_class_label(status: Column | str) -> Column:
    """Five official statuses to three labels; null for any other text."""
    return lookup(status, STATUS_TO_LABEL)


def match_quality(distance: Column | str) -> Column:
    """good / acceptable / poor by distance; no match at all is poor."""
    d = column(distance)
    return (F.when(d <= GOOD_MATCH_M, "good").when(d <= ACCEPTABLE_MATCH_M, "acceptable").otherwise("poor"))


def per_pipe(total: Column | str, pipes: Column | str) -> Column:
    """Rate per monitored outlet, zero where there is none."""
    n = F.nullif(column(pipes).cast("double"), F.lit(0.0))
    return F.coalesce(column(total) / n, F.lit(0.0))


def per_pipe_live(total: Column | str, pipes: Column | str) -> Column:
    """Rate per outlet with at least one outlet assumed, as the live feed counts it."""
    return column(total) / F.greatest(column(pipes), F.lit(1)).cast("double")


def is_discharging(status: Column | str, compat: bool = False) -> Column:
    """Whether a monitor discharges; `compat` gives the looser test for the substring 'discharge'."""
    text = F.lower(column(status))
    hit = text.contains("discharge") if compat else F.trim(text) == "discharging"
    return F.coalesce(hit, F.lit(False))


def usable_position(x: Column | str, y: Column | str) -> Column:
    """Both coordinates present and not zero."""
    return F.coalesce((column(x) != 0) & (column(y) != 0), F.lit(False))


def threshold_rules(phosphate: Column | str = "phosphate_mid",
                    nitrate: Column | str = "nitrate_mid") -> dict[str, Column]:
    """The four regulatory rules as label columns; a missing reading never exceeds a limit."""
    over_p = F.coalesce(column(phosphate) > PHOSPHATE_LIMIT, F.lit(False))
    over_n = F.coalesce(column(nitrate) > NITRATE_LIMIT, F.lit(False))
    conditions = {
        f"Rule 1 - Phosphate only (PO4 > {PHOSPHATE_LIMIT})": over_p,
        f"Rule 2 - Nitrate only (NO3 > {NITRATE_LIMIT})": over_n,
        "Rule 3 - OR rule (PO4 > 0.1 OR NO3 > 2.0)": over_p | over_n,
        "Rule 4 - AND rule (PO4 > 0.1 AND NO3 > 2.0)": over_p & over_n,
    }
    return {name: F.when(cond, "Poor").otherwise("Moderate") for name, cond in conditions.items()}


def level_band(value: Column | str, p25: Column | str, p75: Column | str) -> Column:
    """Where a value lies against the quartiles of its feature; empty when the feature is unknown."""
    v = column(value)
    return (F.when(column(p25).isNull() | column(p75).isNull(), "")
            .when(v <= column(p25), "low compared to other places")
            .when(v >= column(p75), "high compared to other places")
            .otherwise("a typical level"))


def confidence_band(*probabilities: Column | str) -> Column:
    """Confidence by the larger class probability."""
    top = F.greatest(*[column(p) for p in probabilities])
    return F.when(top > 0.75, "fairly confident").when(top > 0.6, "reasonably confident").otherwise("borderline")


def kappa_strength(kappa: Column | str) -> Column:
    k = column(kappa)
    return (F.when(k < 0.20, "slight").when(k < 0.40, "fair").when(k < 0.60, "moderate")
            .when(k < 0.80, "substantial").otherwise("almost perfect"))


def correlation_strength(corr: Column | str) -> Column:
    c = column(corr)
    return F.when(c > 0.3, "strong").when(c > 0.1, "weak").otherwise("little or none")


def rank_stability(corr: Column | str) -> Column:
    return F.when(column(corr) > 0.7, "high").otherwise("moderate")


def f1_verdict(difference: Column | str, margin: float = 0.01) -> Column:
    d = column(difference)
    return F.when(d > margin, "better").when(d < -margin, "worse").otherwise("no meaningful difference")


def feature_verdict(f1_without: Column | str, f1_with: Column | str, margin: float = 0.001) -> Column:
    """Whether a feature can go: its absence costs no more than the margin."""
    return F.when(column(f1_without) >= column(f1_with) - margin, "remove").otherwise("keep")


def pull_direction(shap: Column | str) -> Column:
    return F.when(column(shap) > 0, "Polluted").otherwise("Healthy")
