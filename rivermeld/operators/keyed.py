"""Per-key operators that stay mergeable, so no key's rows have to sit in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivermeld.functions.parsing import column


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the smallest by `order`, then by all other columns."""
    ranked = order + [c for c in df.columns if c not in keys and c not in order]
    rows = df.groupBy(*keys).agg(F.min(F.struct(*ranked)).alias("_row"))
    return rows.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def latest_rows(df: DataFrame, key: str, at: str) -> DataFrame:
    """Rows at the latest time of their key; ties are all kept.

    The maximum is combined before the shuffle, and the semi join is keyed on (key, time), so a key with
    very many rows is spread over its times.
    """
    newest = df.groupBy(key).agg(F.max(at).alias(at))
    return df.join(newest, [key, at], "left_semi")


def latest_row(df: DataFrame, key: str, at: str) -> DataFrame:
    """Exactly one latest row per key; ties go to the smallest other columns."""
    others = [c for c in df.columns if c not in (key, at)]
    tied = latest_rows(df, key, at)
    return first_per_key(tied, [key], [at] + others).select(*df.columns)


def latest_preferring(df: DataFrame, key: str, at: str, preferred: Column) -> DataFrame:
    """Rows at the latest preferred time of their key, or at its latest time when none is preferred."""
    newest = df.groupBy(key).agg(F.coalesce(F.max(F.when(preferred, F.col(at))), F.max(at)).alias(at))
    return df.join(newest, [key, at], "left_semi")


def distinct_tuples(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns).distinct()


def with_uses(df: DataFrame, key: str, name: str = "uses") -> DataFrame:
    """How often the key's value occurs, on every row; AQE broadcasts the counts when they are small and
    splits the hot value otherwise."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(name))
    return df.join(counts, key, "left").select(*df.columns, name)


def with_previous(df: DataFrame, keys: list[str], order: list[str], values: list[str],
                  slice_by: Column) -> DataFrame:
    """Previous row's values within each key, as prev_<value>, and the row's place, as visit_no.

    `slice_by` must not decrease along `order`. It cuts a key's history into slices (months, say), each its
    own window group; a second window over one row per slice carries the last values and counts across.
    """
    sliced = df.withColumn("_slice", slice_by)
    within = Window.partitionBy(*keys, "_slice").orderBy(*order)
    packed = F.struct(*values)
    inner = sliced.withColumns({
        "_no": F.row_number().over(within),
        "_prev": F.lag(packed).over(within),
    })
    heads = sliced.groupBy(*keys, "_slice").agg(
        F.count("*").alias("_rows"),
        F.max(F.struct(*order, packed.alias("_values"))).alias("_last"),
    )
    across = Window.partitionBy(*keys).orderBy("_slice")
    carried = heads.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_slice").alias("_k_slice"),
        F.lag("_last._values").over(across).alias("_before"),
        (F.sum("_rows").over(across.rowsBetween(Window.unboundedPreceding, -1))).alias("_rows_before"),
    )
    matched = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    joined = inner.join(carried, matched + [F.col("_slice").eqNullSafe(F.col("_k_slice"))])
    previous = F.coalesce(F.col("_prev"), F.col("_before"))
    return joined.select(
        *df.columns,
        (F.col("_no") + F.coalesce(F.col("_rows_before"), F.lit(0))).cast("long").alias("visit_no"),
        *[previous[v].alias(f"prev_{v}") for v in values],
    )


def with_global_number(df: DataFrame, order: list[str], name: str = "row_no",
                       slice_rows: int = 500_000) -> DataFrame:
    """Row numbers 0, 1, 2, ... over the whole frame without one global sort task.

    Rows are spread over hashed slices of about `slice_rows`, numbered inside their slice, and shifted by
    the slices before.
    """
    slices = max(-(-df.count() // slice_rows), 1)
    sliced = df.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(slices)).cast("int"))
    sizes = sliced.groupBy("_slice").agg(F.count("*").alias("_n"))
    # One row per slice, so this window has a fixed number of rows.
    starts = sizes.select("_slice", F.coalesce(
        F.sum("_n").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    ).alias("_start"))
    inside = Window.partitionBy("_slice").orderBy(*order)
    numbered = sliced.withColumn("_no", F.row_number().over(inside))
    return numbered.join(F.broadcast(starts), "_slice").select(
        *df.columns, (F.col("_start") + F.col("_no") - 1).alias(name))


def top_per_group(df: DataFrame, groups: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; ranks are limited before the shuffle (a window group limit)."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))
    return ranked.where(F.col("_rank") <= k).drop("_rank")


def best_of(df: DataFrame, groups: list[str], pick: str, by: Column | str) -> DataFrame:
    """The value of `pick` with the largest `by` per group, and that maximum; ties go to the larger name."""
    best = F.max(F.struct(column(by).alias("score"), F.col(pick).alias("pick"))).alias("best")
    rows = df.groupBy(*groups).agg(best) if groups else df.agg(best)
    return rows.select(*groups, F.col("best.pick").alias(pick), F.col("best.score").alias("best_score"))
