"""Readable names: sites, land-cover factors, statuses, run marks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rivermeld.functions.parsing import column
from rivermeld.functions.rates import lookup
from rivermeld.settings import (
    CIRCLE_CONSTANT, FEATURE_LABELS, LAND_WORDS, OTHER_RUN_MARK, PLACEHOLDER_NAMES, RUN_MARKS,
    STATUS_MEANING,
)


def is_placeholder(name: Column | str) -> Column:
    return F.coalesce(F.lower(F.trim(column(name))).isin(PLACEHOLDER_NAMES), F.lit(False))


def _filled(county: Column) -> Column:
    return F.when(county != "", county)


def site_title(name: Column | str, county: Column | str) -> Column:
    """Readable site name; placeholders become 'Unnamed site' with the county when known."""
    place = _filled(column(county))
    return F.when(is_placeholder(name), F.concat_ws(", ", F.lit("Unnamed site"), place)).otherwise(column(name))


def display_name(name: Column | str, county: Column | str, uses: Column | str) -> Column:
    """Site title, with the county appended when the same name occurs more than once."""
    n, place = column(name), _filled(column(county))
    return (F.when(is_placeholder(n), site_title(n, county))
            .when(F.coalesce(column(uses), F.lit(0)) <= 1, n)
            .otherwise(F.when(n.isNotNull(), F.concat_ws(", ", n, place))))


def land_area_km2(feature: Column | str, percent: Column | str) -> Column:
    """Area a land-cover percentage stands for inside its circle."""
    radius_km = F.substring_index(column(feature), "_", -1)
    km = F.coalesce(F.regexp_extract(radius_km, r"^(1|5)km$", 1).try_cast("double"), F.lit(0.0))
    return column(percent) / 100 * (F.lit(CIRCLE_CONSTANT) * km * km)


def land_text(feature: Column | str, percent: Column | str) -> Column:
    """Words for one land-cover factor; below half a percent counts as none."""
    words = F.split(column(feature), "_")
    kind = lookup(words[1], LAND_WORDS, words[1])
    radius = F.substring_index(column(feature), "_", -1)
    area = F.format_string("%.1f", land_area_km2(feature, percent))
    return (F.when(column(percent) < 0.5, F.concat(F.lit("No "), kind, F.lit(" within "), radius))
            .otherwise(F.concat(area, F.lit(" km² of "), kind, F.lit(" within "), radius)))


def factor_text(feature: Column | str, value: Column | str) -> Column:
    """Words for any factor: land-cover text, a known label, or its own name."""
    f = column(feature)
    return F.when(f.startswith("lc_"), land_text(f, value)).otherwise(lookup(f, FEATURE_LABELS, f))


def factor_title(feature: Column | str) -> Column:
    """Short title for importance charts: 'Farmland (5km)' or a known label."""
    f = column(feature)
    words = F.split(f, "_")
    kind = F.initcap(F.replace(lookup(words[1], LAND_WORDS, words[1]), F.lit("-"), F.lit("- ")))
    kind = F.replace(kind, F.lit("- "), F.lit("-"))
    land = F.concat(kind, F.lit(" ("), F.substring_index(f, "_", -1), F.lit(")"))
    return F.when(f.startswith("lc_"), land).otherwise(lookup(f, FEATURE_LABELS, f))


def status_meaning(status: Column | str) -> Column:
    return lookup(status, STATUS_MEANING, F.lit(""))


def run_mark(status: Column | str) -> Column:
    return lookup(status, RUN_MARKS, F.lit(OTHER_RUN_MARK))
