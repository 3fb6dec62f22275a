"""Oracle SQL fragments shared by several queries."""

from __future__ import annotations

from rivermeld.settings import LAND_GROUPS, RADII
from rivermeld.sources.driver_views import with_views

AS_OF = "2024-01-31 00:00:00"
AS_OF_SQL = f"TIMESTAMP '{AS_OF}'"

LABEL_CASE = """CASE status WHEN 'High' THEN 'Good' WHEN 'Good' THEN 'Good' WHEN 'Moderate' THEN 'Moderate'
    WHEN 'Poor' THEN 'Poor' WHEN 'Bad' THEN 'Poor' END"""

RIVERS = f"""rivers AS (
  SELECT wb_id, MIN(wb_name) AS wb_name, MIN(easting) AS easting, MIN(northing) AS northing,
         MIN({LABEL_CASE}) AS wfd_status
  FROM waterbodies
  WHERE cycle = 3 AND water_body_type = 'River' AND status IN ('High', 'Good', 'Moderate', 'Poor', 'Bad')
  GROUP BY wb_id)"""

# Nearest river of every reading position by brute force; match_q as in the matrix.
MATCHED = """spots AS (SELECT DISTINCT easting, northing FROM readings),
ranked AS (
  SELECT s.easting, s.northing, w.wb_id, w.wb_name, w.wfd_status,
         (w.easting - s.easting) * (w.easting - s.easting)
           + (w.northing - s.northing) * (w.northing - s.northing) AS d2,
         ROW_NUMBER() OVER (PARTITION BY s.easting, s.northing ORDER BY
           (w.easting - s.easting) * (w.easting - s.easting)
           + (w.northing - s.northing) * (w.northing - s.northing), w.wb_id) AS rn
  FROM spots s CROSS JOIN rivers w),
matched AS (
  SELECT r.*, k.wb_id, k.wb_name, k.wfd_status, SQRT(k.d2) AS wfd_dist_m,
         CASE WHEN SQRT(k.d2) <= 1000 THEN 'good' WHEN SQRT(k.d2) <= 5000 THEN 'acceptable'
              ELSE 'poor' END AS match_q
  FROM readings r JOIN ranked k ON r.easting = k.easting AND r.northing = k.northing AND k.rn = 1)"""

HOURS = """COALESCE((CAST(split_part(duration_text, ':', 1) AS DOUBLE) * 3600
    + CAST(split_part(duration_text, ':', 2) AS DOUBLE) * 60
    + CAST(split_part(duration_text, ':', 3) AS DOUBLE)) / 3600, 0)"""

# Cleaned annual returns: the newer year keeps one row per monitor (smallest by waterbody and the rest).
RETURNS = f"""cleaned AS (
  SELECT unique_id, wb_id, outlet_ngr, data_year,
         COALESCE(TRY_CAST(spill_count AS DOUBLE), 0) AS spill_count, {HOURS} AS spill_hrs, avg_spills, edm_pct,
         ROW_NUMBER() OVER (PARTITION BY unique_id, data_year
           ORDER BY wb_id, outlet_ngr, COALESCE(TRY_CAST(spill_count AS DOUBLE), 0), {HOURS}, avg_spills,
                    edm_pct) AS rn
  FROM edm_returns),
returns_kept AS (SELECT * FROM cleaned WHERE data_year = 2024 OR rn = 1),
edm AS (
  SELECT wb_id, SUM(spill_count) AS spill_count, SUM(spill_hrs) AS spill_hrs, AVG(avg_spills) AS avg_spills,
         COUNT(spill_count) AS n_overflows, AVG(edm_pct) AS edm_pct, COUNT(DISTINCT outlet_ngr) AS n_outlets,
         array_to_string(list_sort(list_distinct(list(data_year))), ',') AS years
  FROM returns_kept GROUP BY wb_id)"""


def land_sql(points: str = "spots") -> str:
    """CTE `land`: the twelve shares per position, by testing every cell against every circle."""
    parts = []
    for label, radius in RADII.items():
        r2 = radius * radius
        for group, codes in LAND_GROUPS.items():
            inside = f"d2 <= {r2}"
            listed = ", ".join(map(str, codes))
            parts.append(f"CAST(100 AS DOUBLE) * COUNT(*) FILTER ({inside} AND code IN ({listed})) / "
                         f"NULLIF(COUNT(*) FILTER ({inside}), 0) AS lc_{group}_{label}")
    listed = ",\n         ".join(parts)
    return f"""cell_pairs AS (
  SELECT p.easting, p.northing, c.code,
         (c.easting - p.easting) * (c.easting - p.easting)
           + (c.northing - p.northing) * (c.northing - p.northing) AS d2
  FROM {points} p JOIN lc_cells c
    ON c.easting BETWEEN p.easting - 5000 AND p.easting + 5000
   AND c.northing BETWEEN p.northing - 5000 AND p.northing + 5000),
land AS (
  SELECT easting, northing,
         {listed}
  FROM cell_pairs GROUP BY easting, northing)"""


def ctes(views: list[str], *more: str) -> str:
    return ",\n".join([with_views(*views), *more])
