"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Word separators of the contracts: space and the ASCII controls from tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query over a folder of tables, with the same result as SQL where SQL can state it."""

    def register(build: Query) -> Query:
        QUERIES[name] = build
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(column: str | Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def spaced(text: Column) -> Column:
    """The text with every separator as one space character, so that lengths and positions stay."""
    for mark in SPACES[1:]:
        text = F.replace(text, F.lit(mark), F.lit(" "))
    return text


def words_of(text: Column) -> Column:
    """Words between `SPACES`; an empty array for a text without words. Splits at a plain character, not a pattern."""
    return F.array_remove(F.split(spaced(text), " ", -1), "")


def free_name(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of `df` has it (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def settled(condition: Column) -> Column:
    """The condition, computed where it stands: Catalyst moves no filter below a row number.

    Moved down, a filter over array expressions would have them computed again inside their own lambdas.
    """
    return condition & (F.monotonically_increasing_id() >= 0)


def running_starts(counts: DataFrame, order: str, count: str, start: str, block: int = 1000) -> DataFrame:
    """Add to one row per shard the sum of `count` over the shards before it, in ascending `order` (0, 1, 2, ...).

    Summed in two levels, so that no task sees more than `block` shards or the totals of all blocks.
    """
    blocked = counts.withColumn("block_", F.floor(F.col(order) / block))
    totals = blocked.groupBy("block_").agg(F.sum(count).alias("total_"))
    before = Window.orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("block_", F.coalesce(F.sum("total_").over(before), F.lit(0)).alias("base_"))
    inside = Window.partitionBy("block_").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        blocked.withColumn("inside_", F.coalesce(F.sum(count).over(inside), F.lit(0)))
        .join(bases, "block_")
        .withColumn(start, (F.col("base_") + F.col("inside_")).cast("long"))
        .drop("block_", "inside_", "base_")
    )


def running_sums(values: Column) -> Column:
    """Per element the sum up to and including it, for an array without nulls.

    Each step adds the array moved by 1, 2, 4, ... places, so the work grows as n log n and nothing is appended to a growing array.
    """
    def step(sums: Column, k: Column) -> Column:
        moved = F.concat(F.array_repeat(F.lit(0).cast("long"), F.pow(F.lit(2), k).cast("int")), sums)
        return F.zip_with(sums, F.slice(moved, F.lit(1), F.size(sums)), lambda x, y: x + y)

    def summed(v: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.length(F.bin(F.size(v))) - 1), v, step)

    return bound(F.transform(values, lambda x: x.cast("long")), summed)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with `value` computed once a row however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
