"""Views that give the driver's tables the shapes of the river data sets (see FIXTURES.md).

Every view is one SELECT that Spark and DuckDB both read, so a query and its oracle start from the
same rows.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, tuple[str, str]] = {
    "readings": ("orders", """
        SELECT CAST(o_orderkey AS STRING) AS fww_id,
               CASE WHEN o_custkey % 23 = 0 THEN 'Other'
                    ELSE CONCAT('site-', CAST(o_custkey AS STRING)) END AS site_name,
               o_orderdate AS sample_date,
               CAST(400000 + (o_custkey * 7919) % 60000 AS DOUBLE) AS easting,
               CAST(200000 + (o_custkey * o_custkey * 193 + o_custkey * 104729) % 60000 AS DOUBLE) AS northing,
               CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE CAST(o_orderkey % 97 AS DOUBLE) / 10 END AS nitrate_mid,
               CASE WHEN o_orderkey % 43 = 0 THEN NULL ELSE CAST(o_orderkey % 53 AS DOUBLE) / 100 END AS phosphate_mid,
               CASE o_orderkey % 4 WHEN 0 THEN 'Good' WHEN 1 THEN 'Moderate' WHEN 2 THEN 'Poor'
                    ELSE 'No water available' END AS fww_rating,
               CASE WHEN o_custkey % 17 = 0 THEN NULL
                    ELSE CONCAT('county-', CAST(o_custkey % 12 AS STRING)) END AS county,
               CONCAT('rbd-', CAST(o_custkey % 7 AS STRING)) AS rbd,
               CASE WHEN o_orderkey % 10 = 0 THEN 'Wales' ELSE 'England' END AS country,
               o_orderdate AS received_at
        FROM orders"""),
    "waterbodies": ("supplier", """
        SELECT CONCAT('WB', CAST(s_suppkey AS STRING)) AS wb_id,
               s_name AS wb_name,
               CAST(400000 + (s_suppkey * 6151) % 60000 AS DOUBLE) AS easting,
               CAST(200000 + (s_suppkey * s_suppkey * 389 + s_suppkey * 40961) % 60000 AS DOUBLE) AS northing,
               CASE s_suppkey % 6 WHEN 0 THEN 'Moderate' WHEN 1 THEN 'Poor' WHEN 2 THEN 'Good'
                    WHEN 3 THEN 'High' WHEN 4 THEN 'Bad' ELSE 'Moderate' END AS status,
               CASE WHEN s_suppkey % 11 = 10 THEN 2 ELSE 3 END AS cycle,
               CASE WHEN s_suppkey % 13 = 12 THEN 'Lake' ELSE 'River' END AS water_body_type
        FROM supplier"""),
    "edm_returns": ("lineitem", """
        SELECT CONCAT(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS unique_id,
               CONCAT('WB', CAST(l_suppkey AS STRING)) AS wb_id,
               CONCAT('O', CAST(l_partkey % 500 AS STRING)) AS outlet_ngr,
               CAST(2024 + l_orderkey % 2 AS INT) AS data_year,
               CASE WHEN l_orderkey % 29 = 0 THEN 'n/a'
                    ELSE CAST(CAST(l_quantity AS BIGINT) AS STRING) END AS spill_count,
               CASE WHEN l_orderkey % 31 = 0 THEN NULL
                    ELSE CONCAT(LPAD(CAST(l_linenumber * 7 AS STRING), 2, '0'), ':',
                                LPAD(CAST(l_partkey % 60 AS STRING), 2, '0'), ':00') END AS duration_text,
               CAST(l_suppkey % 40 AS DOUBLE) AS avg_spills,
               CAST(100 - l_linenumber AS DOUBLE) AS edm_pct
        FROM lineitem"""),
    "edm_live": ("events", """
        SELECT CASE WHEN event_id % 13 = 0 THEN NULL
                    ELSE CONCAT('WB', CAST(user_id % 10 AS STRING)) END AS wb_id,
               CONCAT('O', CAST(event_id % 40 AS STRING)) AS outlet_ngr,
               CONCAT('company-', CAST(user_id % 3 AS STRING)) AS company,
               CASE event_type WHEN 'click' THEN 'Discharging' WHEN 'purchase' THEN 'DISCHARGING'
                    WHEN 'view' THEN 'Not Discharging' WHEN 'signup' THEN 'Recent Discharge'
                    ELSE 'Offline' END AS status,
               CAST(0 AS DOUBLE) AS duration_hrs,
               ts AS received_at
        FROM events"""),
    "monitors": ("events", """
        SELECT CONCAT('M', CAST(event_id AS STRING)) AS monitor_key,
               CONCAT('O', CAST(event_id % 40 AS STRING)) AS outlet_ngr,
               CONCAT('company-', CAST(user_id % 3 AS STRING)) AS company,
               CASE WHEN event_id % 19 = 0 THEN NULL WHEN event_id % 17 = 0 THEN 0.0
                    ELSE CAST(400000 + (event_id * 4801) % 60000 AS DOUBLE) END AS x,
               CASE WHEN event_id % 23 = 0 THEN 0.0
                    ELSE CAST(200000 + (event_id * 3571 + user_id * 977) % 60000 AS DOUBLE) END AS y,
               CASE event_type WHEN 'error' THEN NULL ELSE event_type END AS current_status,
               CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN ''
                    ELSE CONCAT('river-', CAST(user_id % 30 AS STRING)) END AS receiving_watercourse,
               ts AS received_at
        FROM events"""),
    "lc_cells": ("part", """
        SELECT CAST(400000 + (p_partkey * 12289) % 60000 AS DOUBLE) AS easting,
               CAST(200000 + (p_partkey * p_partkey * 97 + p_partkey * 24593) % 60000 AS DOUBLE) AS northing,
               CAST(1 + p_size % 21 AS INT) AS code
        FROM part"""),
    "predictions": ("events", """
        SELECT CAST(event_id % 250 AS STRING) AS fww_id,
               CASE WHEN value > 60 THEN 'Poor' ELSE 'Moderate' END AS predicted_status,
               CAST(event_id % 1001 AS DOUBLE) / 1000 AS prob_poor,
               CAST(1000 - event_id % 1001 AS DOUBLE) / 1000 AS prob_moderate,
               CASE WHEN event_id % 7 = 0 THEN 'live' ELSE 'historical' END AS data_source,
               ts AS predicted_at
        FROM events"""),
    "model_metrics": ("part", """
        SELECT p_brand AS model_type,
               CASE WHEN p_partkey % 2 = 0 THEN 'Traditional Rule-Based'
                    ELSE 'AI / Machine Learning' END AS approach,
               CONCAT('set-', CAST(p_partkey % 3 AS STRING)) AS feature_set,
               p_partkey % 5 AS fold_id,
               CAST(p_size AS DOUBLE) / 50 AS weighted_f1
        FROM part"""),
    "ingestion_log": ("events", """
        SELECT CASE event_type WHEN 'click' THEN 'live_inference' WHEN 'view' THEN 'feature_engineering'
                    WHEN 'signup' THEN 'edm_live' ELSE 'wfd' END AS source,
               event_id % 90 AS records_fetched,
               event_id % 3 AS records_new,
               CASE event_id % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'no_new_data' ELSE 'success' END AS status,
               ts AS run_at
        FROM events"""),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived view as a lazy DataFrame over the driver's Parquet."""
    base, select = VIEWS[name]
    return spark.sql(select.replace(f"FROM {base}", "FROM {base}"), base=table(spark, sf_dir, base))


def with_views(*names: str) -> str:
    """A WITH clause that defines the named views for the oracle; ends without a comma."""
    return "WITH " + ",\n".join(f"{name} AS ({VIEWS[name][1]})" for name in names)
