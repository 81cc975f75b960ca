"""Pricing summary of ``lineitem``: the contract's smoke query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import table

SHIPPED_BY = "2001-08-01"

PRICING_SUMMARY_SQL = f"""
SELECT l_returnflag, l_linestatus,
       round(sum(l_quantity), 2) AS sum_qty,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
       count(*) AS count_order
FROM lineitem
WHERE l_shipdate <= TIMESTAMP '{SHIPPED_BY} 00:00:00'
GROUP BY l_returnflag, l_linestatus
"""


def pricing_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Quantity, discounted price and number of lines by return flag and status.

    One grouped aggregation: the date filter reaches the scan, five columns are
    read, and only partial sums are shuffled.
    """
    lines = table(spark, folder, "lineitem")
    return (
        lines.filter(F.col("l_shipdate") <= F.lit(SHIPPED_BY).cast("timestamp_ntz"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
            F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"),
            F.count("*").alias("count_order"),
        )
    )
