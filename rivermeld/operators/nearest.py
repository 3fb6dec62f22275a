"""Nearest-place joins on planar coordinates (metres).

Space is cut into square query cells. For each cell the index lists every place that can be nearest to
some point of the cell; cells whose list is long are divided until the list is short, so a crowded
town costs deeper cells there, not longer lists. A point then meets exactly one cell, with one equi-join,
and picks the minimum inside that row: no pair rows, no shuffle per point when the index is broadcast.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivermeld.session import BROADCAST_ROWS, broadcast_if_small, spread, written

LIST_TARGET = 128
PARTS = 4
MAX_DEPTH = 5
SALTS = 16
POSITION_ROWS = 1_000_000
POINTS_PER_TASK = 4_000
SLACK_M2 = 1e-3
ANY_DISTANCE = 1e12


def _cell(value: Column, size: Column | float) -> Column:
    return F.floor(value / size).cast("long")


def _gap(value: Column, low: Column, high: Column) -> Column:
    """Distance from `value` to the interval [low, high]; zero inside."""
    return F.greatest(low - value, value - high, F.lit(0.0))


def _reach(value: Column, low: Column, high: Column) -> Column:
    """Distance from `value` to the far end of the interval."""
    return F.greatest(F.abs(value - low), F.abs(value - high))


def _steps(values: tuple[int, ...]) -> Column:
    """All (dx, dy) steps over `values` as an array to explode."""
    return F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in values for dy in values])


def _prune(pairs: DataFrame, size: float, limit: float) -> DataFrame:
    """Keep the (cell, place) pairs in which the place can be nearest to some point of the cell."""
    low_e, low_n = F.col("cx") * F.lit(size), F.col("cy") * F.lit(size)
    near_e = _gap(F.col("e"), low_e, low_e + size)
    near_n = _gap(F.col("n"), low_n, low_n + size)
    far_e = _reach(F.col("e"), low_e, low_e + size)
    far_n = _reach(F.col("n"), low_n, low_n + size)
    bounded = pairs.withColumns({
        "near2": near_e * near_e + near_n * near_n,
        "far2": far_e * far_e + far_n * far_n,
    })
    ceiling = bounded.groupBy("cx", "cy").agg(F.min("far2").alias("cell_far2"))
    # The slack keeps places that differ only by rounding.
    keep = (F.col("near2") <= F.col("cell_far2") + SLACK_M2) & (F.col("near2") <= F.lit(limit * limit + SLACK_M2))
    return bounded.join(ceiling, ["cx", "cy"]).where(keep).select("cx", "cy", "e", "n", "place")


def _divide(pairs: DataFrame, size: float, limit: float) -> DataFrame:
    """Pairs of the sixteen cells of a quarter of the side inside each cell; `size` is the new size."""
    finer = pairs.withColumn("q", F.explode(_steps((0, 1, 2, 3)))).select(
        (F.col("cx") * PARTS + F.col("q.dx")).alias("cx"), (F.col("cy") * PARTS + F.col("q.dy")).alias("cy"),
        "e", "n", "place")
    return _prune(finer, size, limit)


def _near_pairs(spots: DataFrame, reach: float) -> DataFrame:
    """Pairs for every cell of size `reach` that has a place in its 3 x 3 block."""
    around = spots.withColumn("shift", F.explode(_steps((-1, 0, 1)))).select(
        (_cell(F.col("e"), reach) + F.col("shift.dx")).alias("cx"),
        (_cell(F.col("n"), reach) + F.col("shift.dy")).alias("cy"), "e", "n", "place")
    return _prune(around, reach, reach)


def _far_pairs(spots: DataFrame, occupied: DataFrame, size: float, levels: int) -> DataFrame:
    """Pairs for the occupied cells with no bound on distance, by dividing one cell around everything."""
    pairs = spots.select(F.lit(0).cast("long").alias("cx"), F.lit(0).cast("long").alias("cy"), "e", "n", "place")
    for level in range(levels - 1, -1, -1):
        ancestors = occupied.select(F.expr(f"shiftright(cx, {2 * level})").alias("cx"),
                                    F.expr(f"shiftright(cy, {2 * level})").alias("cy")).distinct()
        pairs = _divide(pairs, size * PARTS ** level, ANY_DISTANCE).join(ancestors, ["cx", "cy"], "left_semi")
        pairs = written(pairs, "place-pairs")
    return pairs


def _candidate_lists(pairs: DataFrame, size: float, limit: float,
                     list_target: int) -> tuple[DataFrame, DataFrame | None, int]:
    """Divide crowded cells until their lists are short.

    Returns the lists (depth, cx, cy, es, ns, places) of the cells left whole, the cells that were divided
    (depth, cx, cy), and the greatest depth. Only crowded spots get deep cells.
    """
    whole: DataFrame | None = None
    split: DataFrame | None = None
    for depth in range(MAX_DEPTH + 1):
        pairs = written(pairs, "place-pairs")
        crowded = pairs.groupBy("cx", "cy").agg(F.count("*").alias("k")).where(
            F.col("k") > list_target).select("cx", "cy")
        last = depth == MAX_DEPTH or crowded.isEmpty()
        settled = pairs if last else pairs.join(crowded, ["cx", "cy"], "left_anti")
        level = (
            settled.groupBy("cx", "cy")
            .agg(F.array_sort(F.collect_list(F.struct("place", "e", "n"))).alias("items"))
            .select(F.lit(depth).alias("depth"), "cx", "cy", F.col("items.e").alias("es"),
                    F.col("items.n").alias("ns"), F.col("items.place").alias("places"))
        )
        whole = level if whole is None else whole.unionByName(level)
        if last:
            return written(whole, "place-lists"), None if split is None else written(split, "place-splits"), depth
        cut = crowded.select(F.lit(depth).alias("depth"), "cx", "cy")
        split = cut if split is None else split.unionByName(cut)
        pairs = _divide(pairs.join(crowded, ["cx", "cy"], "left_semi"), size / PARTS ** (depth + 1), limit)
    raise AssertionError("unreachable")


def _cell_at(depth: Column, size: float) -> dict[str, Column]:
    """The point's cell at a depth."""
    scaled = F.lit(size) / F.pow(F.lit(float(PARTS)), depth)
    return {"cx": _cell(F.col("px"), scaled), "cy": _cell(F.col("py"), scaled)}


def _few(df: DataFrame, rows: int) -> bool:
    return df.count() <= rows


def _look_up(points: DataFrame, lists: DataFrame, split: DataFrame | None, depth: int, size: float,
             reach: float, row_limit: int) -> DataFrame:
    """Set `best` on points that have none yet, from lists exact up to `reach`."""
    wanted = F.col("best").isNull() & F.col("usable")
    keyed = points.withColumn("depth", F.when(wanted, F.lit(0)))
    if split is not None:
        # Walk down from the top cell: one small join per depth, only for points whose cell was divided.
        cells = F.broadcast(split) if _few(split, BROADCAST_ROWS) else split
        cells = cells.withColumn("deeper", F.lit(1))
        for at in range(depth):
            keyed = keyed.withColumns(_cell_at(F.lit(at), size))
            keyed = keyed.join(cells.where(F.col("depth") == at), ["depth", "cx", "cy"], "left")
            keyed = keyed.withColumn("depth", F.col("depth") + F.coalesce("deeper", F.lit(0))).drop("deeper")
    keyed = keyed.withColumns(_cell_at(F.col("depth"), size))
    if _few(lists, row_limit):
        joined = keyed.join(F.broadcast(lists), ["depth", "cx", "cy"], "left")
    else:
        # A crowded cell may hold a third of all points: spread it over salted copies of its list. Points
        # that need no match get their own spread of keys instead of one null key. The size of the written
        # lists is a compressed one, so it must not talk Spark into a broadcast.
        keyed = keyed.withColumns({
            "salt": F.pmod(F.xxhash64("px", "py"), F.lit(SALTS)).cast("int"),
            "depth": F.coalesce("depth", -1 - F.pmod(F.xxhash64(points.columns[0], "py", "px"),
                                                     F.lit(1 << 20)).cast("int")),
        })
        salted = lists.withColumn("salt", F.explode(F.array(*[F.lit(s) for s in range(SALTS)]))).hint("merge")
        joined = keyed.join(salted, ["depth", "cx", "cy", "salt"], "left").drop("salt")

    # Plain arrays of doubles keep this inner loop free of row objects. Lists are ordered by place, so the
    # first position of the minimum is the smallest place among ties.
    def distance2(e: Column, n: Column) -> Column:
        de, dn = e - F.col("px"), n - F.col("py")
        return de * de + dn * dn

    measured = joined.withColumn("d2s", F.zip_with("es", "ns", distance2))
    measured = measured.withColumn("least", F.array_min("d2s"))
    place = F.get("places", F.array_position("d2s", F.col("least")).cast("int") - 1)
    found = F.when(F.col("least") <= reach * reach, F.struct(F.col("least").alias("d2"), place.alias("place")))
    return measured.withColumn("best", F.coalesce(F.col("best"), found)).drop(
        "d2s", "least", "es", "ns", "places", "depth", "cx", "cy")


@dataclass(frozen=True)
class PlaceIndex:
    """A written index of places, good for every batch of points; distances up to `reach` are exact."""

    spots: DataFrame
    lists: DataFrame
    split: DataFrame | None
    depth: int
    reach: float
    place_id: str
    carry: tuple[str, ...]
    origin: tuple[float, float]
    row_limit: int

    def attach(self, points: DataFrame, xy: tuple[str, str] = ("easting", "northing"),
               distance: str = "dist_m", repeated: bool = True) -> DataFrame:
        """Left-join points to their nearest place within reach.

        Sites and monitors report again and again, so with `repeated` each distinct position is looked up
        once. When the positions prove too many to broadcast back, every point is looked up in place.
        """
        if repeated:
            east, north = F.col(xy[0]).cast("double"), F.col(xy[1]).cast("double")
            spots = written(points.select(east.alias("_e"), north.alias("_n")).where(
                east.isNotNull() & north.isNotNull()).distinct(), "positions")
            if _few(spots, POSITION_ROWS):
                found = self.attach(spread(spots, POINTS_PER_TASK), ("_e", "_n"), distance, repeated=False)
                # Written once, so filters on the result are not pushed into the list scans.
                found = written(found, "found-places")
                return points.join(F.broadcast(found), (east == F.col("_e")) & (north == F.col("_n")),
                                   "left").drop("_e", "_n")
        work = _look_up(self._started(points, xy), self.lists, self.split, self.depth, self.reach,
                        self.reach, self.row_limit)
        return self._finished(work, points, distance)

    def _started(self, points: DataFrame, xy: tuple[str, str]) -> DataFrame:
        east, north = F.col(xy[0]).cast("double"), F.col(xy[1]).cast("double")
        place_type = self.spots.schema["place"].dataType.simpleString()
        return points.withColumns({
            "px": east - self.origin[0],
            "py": north - self.origin[1],
            "usable": east.isNotNull() & north.isNotNull() & ~F.isnan(east) & ~F.isnan(north),
            "best": F.lit(None).cast(f"struct<d2:double,place:{place_type}>"),
        })

    def _finished(self, work: DataFrame, points: DataFrame, distance: str) -> DataFrame:
        return work.select(
            *[F.col(c) for c in points.columns],
            F.col(f"best.place.{self.place_id}").alias(self.place_id),
            *[F.col(f"best.place.{c}").alias(c) for c in self.carry],
            F.sqrt("best.d2").alias(distance),
        )


def index_places(places: DataFrame, place_id: str, carry: list[str] | None = None, reach: float = 5000.0,
                 xy: tuple[str, str] = ("easting", "northing"), origin: tuple[float, float] = (0.0, 0.0),
                 list_target: int = LIST_TARGET, broadcast_rows: int = BROADCAST_ROWS) -> PlaceIndex:
    """Index places once; places at one position collapse to the smallest id."""
    carry = carry or []
    east, north = F.col(xy[0]).cast("double"), F.col(xy[1]).cast("double")
    spots = places.where(east.isNotNull() & north.isNotNull()).select(
        (east - origin[0]).alias("e"), (north - origin[1]).alias("n"), F.struct(place_id, *carry).alias("place"))
    spots = written(spots.groupBy("e", "n").agg(F.min("place").alias("place")), "places")
    lists, split, depth = _candidate_lists(_near_pairs(spots, reach), reach, reach, list_target)
    return PlaceIndex(spots, lists, split, depth, reach, place_id, tuple(carry), origin,
                      max(broadcast_rows // list_target, 1))


def nearest_join(
    points: DataFrame,
    places: DataFrame,
    *,
    place_id: str,
    carry: list[str] | None = None,
    max_dist: float | None = None,
    first_reach: float = 5000.0,
    xy: tuple[str, str] = ("easting", "northing"),
    distance: str = "dist_m",
    list_target: int = LIST_TARGET,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Left-join each point to its nearest place; ties go to the smallest `place_id`.

    With `max_dist` the join is bounded and others get nulls. Without it a second look-up serves the
    points that have no place within `first_reach`, at any distance.
    """
    if max_dist is not None:
        index = index_places(places, place_id, carry, float(max_dist), list_target=list_target,
                             broadcast_rows=broadcast_rows)
        return index.attach(points, xy, distance)
    # Coordinates are taken relative to a corner below both sides, so one cell can cover everything.
    sides = [df.select(F.col(x).cast("double").alias("e"), F.col(y).cast("double").alias("n"))
             for df, (x, y) in ((points, xy), (places, ("easting", "northing")))]
    box = sides[0].unionByName(sides[1]).where(~F.isnan("e") & ~F.isnan("n")).agg(
        F.min("e"), F.min("n"), F.max("e"), F.max("n")).first()
    origin, levels = (0.0, 0.0), 0
    if box[0] is not None:
        origin = (math.floor(box[0]), math.floor(box[1]))
        span = max(box[2] - origin[0], box[3] - origin[1]) + 1.0
        levels = max(math.ceil(math.log(span / first_reach, PARTS)), 0)
    index = index_places(places, place_id, carry, float(first_reach), origin=origin, list_target=list_target,
                         broadcast_rows=broadcast_rows)
    east, north = F.col(xy[0]).cast("double"), F.col(xy[1]).cast("double")
    spots = written(points.select(east.alias("_e"), north.alias("_n")).where(
        ~F.isnan("_e") & ~F.isnan("_n")).distinct(), "positions")
    close = index.attach(spread(spots, POINTS_PER_TASK), ("_e", "_n"), distance, repeated=False)
    close = written(close, "close-places")
    left_over = close.where(F.col(distance).isNull()).select("_e", "_n")
    moved = index._started(left_over, ("_e", "_n"))
    occupied = written(moved.select(_cell(F.col("px"), index.reach).alias("cx"),
                                    _cell(F.col("py"), index.reach).alias("cy")).distinct(), "cells")
    found = close
    if not occupied.isEmpty():
        far = _far_pairs(index.spots, occupied, index.reach, levels)
        lists, split, depth = _candidate_lists(far, index.reach, ANY_DISTANCE, list_target)
        looked = _look_up(moved, lists, split, depth, index.reach, ANY_DISTANCE, index.row_limit)
        found = close.where(F.col(distance).isNotNull()).unionByName(index._finished(looked, left_over, distance))
    found = broadcast_if_small(found, POSITION_ROWS)
    return points.join(found, (east == F.col("_e")) & (north == F.col("_n")), "left").drop("_e", "_n")


def nearest_by_degrees(points: DataFrame, lat: float, lon: float, key: str) -> DataFrame:
    """The point nearest to a clicked position by squared degrees; a partial top-1, no global sort."""
    off = (F.col("lat") - F.lit(lat)) ** 2 + (F.col("lon") - F.lit(lon)) ** 2
    return points.withColumn("deg2", off).orderBy("deg2", key).limit(1)
