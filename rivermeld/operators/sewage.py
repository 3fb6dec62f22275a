"""Storm-overflow aggregates per waterbody, from annual returns and from the live feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivermeld.functions.parsing import column, number_or_zero
from rivermeld.functions.rates import is_discharging, per_pipe, per_pipe_live
from rivermeld.operators.keyed import first_per_key

SEWAGE_TOTALS = ["spill_count", "spill_hrs", "avg_spills", "n_overflows", "edm_pct"]


def clean_returns(returns: DataFrame, hours: Column) -> DataFrame:
    """Raw annual returns with numbers for text; anything unreadable counts as zero."""
    return returns.select(
        "unique_id", "wb_id", "outlet_ngr", "data_year",
        number_or_zero("spill_count").alias("spill_count"),
        F.coalesce(hours, F.lit(0.0)).alias("spill_hrs"),
        number_or_zero("avg_spills").alias("avg_spills"),
        column("edm_pct").cast("string").try_cast("double").alias("edm_pct"),
    )


def combine_years(older: DataFrame, newer: DataFrame, order: list[str]) -> DataFrame:
    """All rows of the older year with the newer year's rows reduced to one per `unique_id`."""
    return older.unionByName(first_per_key(newer, ["unique_id"], order), allowMissingColumns=True)


def returns_per_waterbody(returns: DataFrame) -> DataFrame:
    """One row per waterbody. Only mergeable aggregates, so a waterbody with a third of all rows is
    combined before the shuffle. `n_overflows` counts yearly rows, `n_outlets` the distinct outlets."""
    per_outlet = returns.where(F.col("wb_id").isNotNull()).groupBy("wb_id", "outlet_ngr").agg(
        F.sum("spill_count").alias("spill_count"),
        F.sum("spill_hrs").alias("spill_hrs"),
        F.sum("avg_spills").alias("avg_sum"),
        F.count("avg_spills").alias("avg_n"),
        F.count("spill_count").alias("n_overflows"),
        F.sum("edm_pct").alias("pct_sum"),
        F.count("edm_pct").alias("pct_n"),
        F.collect_set("data_year").alias("years"),
    )
    return per_outlet.groupBy("wb_id").agg(
        F.sum("spill_count").alias("spill_count"),
        F.sum("spill_hrs").alias("spill_hrs"),
        F.try_divide(F.sum("avg_sum"), F.sum("avg_n")).alias("avg_spills"),
        F.sum("n_overflows").alias("n_overflows"),
        F.try_divide(F.sum("pct_sum"), F.sum("pct_n")).alias("edm_pct"),
        F.count("outlet_ngr").alias("n_outlets"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("years")))), ",").alias("years"),
    )


def attach_returns(readings: DataFrame, per_waterbody: DataFrame) -> DataFrame:
    """Left join on waterbody with zeros where nothing is monitored, and the two per-pipe rates."""
    totals = per_waterbody.select("wb_id", *SEWAGE_TOTALS)
    joined = readings.join(totals, "wb_id", "left").na.fill(0, SEWAGE_TOTALS)
    return joined.withColumns({
        "spills_per_pipe": per_pipe("spill_count", "n_overflows"),
        "hrs_per_pipe": per_pipe("spill_hrs", "n_overflows"),
    })


def live_per_waterbody(feed: DataFrame, compat: bool = False) -> DataFrame:
    """Discharging rows, distinct outlets and their ratio per waterbody; two-step distinct count."""
    per_outlet = feed.where(F.col("wb_id").isNotNull()).groupBy("wb_id", "outlet_ngr").agg(
        F.count_if(is_discharging("status", compat)).alias("spill_count"))
    counted = per_outlet.groupBy("wb_id").agg(
        F.sum("spill_count").alias("spill_count"), F.count("outlet_ngr").alias("n_overflows"))
    return counted.withColumn("spills_per_pipe", per_pipe_live("spill_count", "n_overflows"))


def live_totals(feed: DataFrame) -> DataFrame:
    """Hours and row count per waterbody of a slice of the feed."""
    return feed.groupBy("wb_id").agg(
        F.sum("duration_hrs").alias("spill_hrs"), F.count("*").alias("n_overflows"))


def overwrite_with_live(points: DataFrame, live: DataFrame) -> DataFrame:
    """Replace the sewage columns by live values; the old outlet count stays where there is none."""
    fresh = live.select("wb_id", F.col("n_overflows").alias("_n"), F.col("spills_per_pipe").alias("_rate"))
    joined = points.join(fresh, "wb_id", "left")
    replaced = {
        "n_overflows": F.coalesce(F.col("_n"), F.col("n_overflows")),
        "spills_per_pipe": F.coalesce(F.col("_rate"), F.lit(0.0)),
    }
    return joined.withColumns(replaced).select(*points.columns)
