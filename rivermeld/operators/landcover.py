"""Land-cover shares within circles around points.

Cells are pre-counted per square tile. A tile wholly inside a circle joins as one row of counts; only tiles
cut by a circle's edge are opened into cells. Points are reduced to distinct positions first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivermeld.session import spread, written
from rivermeld.settings import LAND, LAND_GROUPS, RADII

TILE_M = 250
SALTS = 16
POINTS_PER_TASK = 2_000


def land_code_groups(df: DataFrame, code: str = "code") -> dict[str, Column]:
    """Membership of a land code in each class group."""
    return {group: F.col(code).isin(codes) for group, codes in LAND_GROUPS.items()}


def _edge_state(radius: int, tile: int) -> tuple[Column, Column]:
    """Whether tile (tx, ty) touches the circle around (px, py), and whether it lies wholly inside."""
    low_e, low_n = F.col("tx") * tile, F.col("ty") * tile

    def near(v: Column, low: Column) -> Column:
        return F.greatest(low - v, v - (low + tile), F.lit(0.0))

    def far(v: Column, low: Column) -> Column:
        return F.greatest(F.abs(v - low), F.abs(v - (low + tile)))

    px, py = F.col("px"), F.col("py")
    near2 = near(px, low_e) ** 2 + near(py, low_n) ** 2
    far2 = far(px, low_e) ** 2 + far(py, low_n) ** 2
    return near2 <= radius * radius, far2 <= radius * radius


def _cut_tiles(points: DataFrame, radius: int, tile: int) -> DataFrame:
    """Tiles cut by each point's circle: per tile row, the ends left over beside the whole tiles.

    The span of a row is widened by a tile each way, and the exact test then decides.
    """
    px, py = F.col("px"), F.col("py")
    rows = points.withColumn("ty", F.explode(F.sequence(
        F.floor((py - radius) / tile), F.floor((py + radius) / tile))))
    low = F.col("ty") * tile
    gap = F.greatest(low - py, py - (low + tile), F.lit(0.0))
    reach = F.greatest(F.abs(py - low), F.abs(py - (low + tile)))

    def half(d: Column) -> Column:
        return F.sqrt(F.greatest(F.lit(float(radius * radius)) - d * d, F.lit(0.0)))

    rows = rows.withColumns({"outer": half(gap), "inner": half(reach)})
    first, last = F.floor((px - F.col("outer")) / tile), F.floor((px + F.col("outer")) / tile)
    inside_from, inside_to = F.ceil((px - F.col("inner")) / tile) + 1, F.floor((px + F.col("inner")) / tile) - 2
    rows = rows.withColumns({"a": first, "z": last, "b": inside_from, "y": inside_to})
    ends = F.when(F.col("b") <= F.col("y"), F.concat(
        F.sequence(F.col("a"), F.greatest(F.col("a"), F.col("b") - 1)),
        F.sequence(F.least(F.col("z"), F.col("y") + 1), F.col("z")),
    )).otherwise(F.sequence(F.col("a"), F.col("z")))
    listed = rows.select("px", "py", "ty", F.explode(F.array_distinct(ends)).alias("tx"))
    touches, covered = _edge_state(radius, tile)
    return listed.where(touches & ~covered)


def _names(radius: str) -> list[str]:
    return [f"{g}_{radius}" for g in [*LAND_GROUPS, "all"]]


def land_counts(points: DataFrame, cells: DataFrame, nodata: list[int] | None = None,
                tile: int = TILE_M) -> DataFrame:
    """Cell counts per class group and radius for distinct (px, py); points without cells are absent."""
    coarse = max(RADII.values())
    if coarse % tile:
        raise ValueError("the largest radius must be a whole number of tiles")
    valid = cells.where(F.col("code").isNotNull() & ~F.col("code").isin(nodata or [0]))
    member = land_code_groups(valid)
    tiled = valid.select(
        F.floor(F.col("easting") / tile).cast("long").alias("tx"),
        F.floor(F.col("northing") / tile).cast("long").alias("ty"),
        F.col("easting").alias("e"), F.col("northing").alias("n"),
        *[hit.cast("int").alias(f"in_{group}") for group, hit in member.items()],
        F.lit(1).alias("in_all"),
    )
    tiles = tiled.groupBy("tx", "ty").agg(*[F.sum(f"in_{g}").alias(f"in_{g}") for g in [*LAND_GROUPS, "all"]])

    # Whole tiles: each point goes to the coarse squares its largest circle touches, at most nine. A square
    # may hold a third of all points, so each point picks one of several copies of the square's tiles.
    def squares(v: str) -> Column:
        return F.sequence(F.floor((F.col(v) - coarse) / coarse), F.floor((F.col(v) + coarse) / coarse))

    points = written(points, "positions")
    visits = (
        points.withColumn("salt", F.pmod(F.xxhash64("px", "py"), F.lit(SALTS)).cast("int"))
        .withColumn("sx", F.explode(squares("px"))).withColumn("sy", F.explode(squares("py")))
    )
    visits = spread(visits, POINTS_PER_TASK, "sx", "sy", "salt")
    per_square = coarse // tile
    copies = tiles.withColumns({
        "sx": F.floor(F.col("tx") / per_square), "sy": F.floor(F.col("ty") / per_square),
        "salt": F.explode(F.array(*[F.lit(s) for s in range(SALTS)])),
    })
    inside_parts = []
    for label, radius in RADII.items():
        _, covered = _edge_state(radius, tile)
        inside_parts += [
            F.sum(F.when(covered, F.col(f"in_{g}"))).alias(f"{g}_{label}") for g in [*LAND_GROUPS, "all"]]
    _, largest_cover = _edge_state(coarse, tile)
    whole = (
        visits.join(copies, ["sx", "sy", "salt"]).where(largest_cover)
        .groupBy("px", "py").agg(*inside_parts)
    )

    # Cut tiles: listed from the point by arithmetic, then opened into their cells.
    some = spread(points, POINTS_PER_TASK)
    cut = None
    for label, radius in RADII.items():
        part = _cut_tiles(some, radius, tile).withColumn("radius", F.lit(radius))
        cut = part if cut is None else cut.unionByName(part)
    d2 = (F.col("e") - F.col("px")) ** 2 + (F.col("n") - F.col("py")) ** 2
    edge_parts = []
    for label, radius in RADII.items():
        edge_parts += [F.sum(F.when(F.col("radius") == radius, F.col(f"in_{g}"))).alias(f"{g}_{label}")
                       for g in [*LAND_GROUPS, "all"]]
    opened = (
        cut.join(tiled, ["tx", "ty"]).where(d2 <= F.col("radius") * F.col("radius"))
        .groupBy("px", "py").agg(*edge_parts)
    )

    names = [name for label in RADII for name in _names(label)]
    return whole.unionByName(opened).groupBy("px", "py").agg(
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])


def land_shares(points: DataFrame, cells: DataFrame, key: str = "fww_id", nodata: list[int] | None = None,
                tile: int = TILE_M) -> DataFrame:
    """Twelve percentages per point; null where a circle holds no valid cell."""
    spots = points.select(F.col("easting").cast("double").alias("px"),
                          F.col("northing").cast("double").alias("py"))
    known = spots.where(F.col("px").isNotNull() & F.col("py").isNotNull()).distinct()
    counts = land_counts(known, cells, nodata, tile)
    shares = [
        (F.lit(100.0) * F.col(f"{group}_{radius}") / F.nullif(F.col(f"all_{radius}"), F.lit(0)))
        .alias(f"lc_{group}_{radius}")
        for radius in RADII for group in LAND_GROUPS
    ]
    per_spot = counts.select("px", "py", *shares)
    keyed = points.select(key, F.col("easting").cast("double").alias("px"),
                          F.col("northing").cast("double").alias("py"))
    return keyed.join(per_spot, ["px", "py"], "left").select(key, *LAND)
