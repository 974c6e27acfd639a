"""Queries of the general data-processing problems, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaspan.operators.skewed_groups import grouped_order_stats
from lexaspan.runtime import read_table


def p4_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spills, total and median length of each partition order."""
    s = grouped_order_stats(read_table(spark, sf_dir, "partition_spills"), "part_order", "part_len", "spill_id")
    return s.select("part_order", F.col("n_rows").alias("n_spills"), F.col("total").alias("total_len"), F.col("mid_value").alias("median_len"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spill in the middle of each partition order."""
    s = grouped_order_stats(read_table(spark, sf_dir, "partition_spills"), "part_order", "part_len", "spill_id")
    return s.filter("n_values > 0").select("part_order", F.col("mid_id").alias("spill_id"))


_P4 = """
WITH s AS (SELECT DISTINCT spill_id, part_order, part_len FROM partition_spills WHERE part_order IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY part_order ORDER BY part_len, spill_id) AS rn,
             count(*) OVER (PARTITION BY part_order) AS n
      FROM s WHERE part_len IS NOT NULL)
"""

QUERIES = {"p4_found": p4_found, "p4_stats": p4_stats}
SQL = {
    "p4_found": _P4 + "SELECT part_order, spill_id FROM r WHERE rn = (n + 1) // 2",
    "p4_stats": _P4
    + """SELECT s.part_order, count(*) AS n_spills, CAST(sum(s.part_len) AS BIGINT) AS total_len, max(m.part_len) AS median_len
         FROM s LEFT JOIN (SELECT part_order, part_len FROM r WHERE rn = (n + 1) // 2) m ON m.part_order = s.part_order
         GROUP BY s.part_order""",
}
