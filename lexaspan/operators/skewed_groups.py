"""Per-key order statistics that stay balanced when a few keys hold most rows.

Rows are range partitioned on the composite (key, value, id) with Spark's sampled
quantiles, so a heavy key is cut over as many partitions as it needs. Each
partition reduces to one partial state a key; the states of a key that crosses
boundaries are stitched in partition order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexaspan.runtime import materialise, shuffle_partitions


def grouped_order_stats(
    df: DataFrame,
    key: str,
    value: str,
    row_id: str,
    partitions: int | None = None,
    broadcast_keys: int = 500_000,
) -> DataFrame:
    """Rows, total and middle row of each key: ``(key, n_rows, n_values, total, mid_value, mid_id)``.

    The n non-null values of a key are put in order of value, then id; the middle
    is number floor((n + 1) / 2), counted from 1.

    Nulls: rows with a null key are left out. A null value counts in ``n_rows``
    only; a key with null values alone has null total and middle. Rows equal in
    (key, value, id) are one row; a null id is an id like any other and comes
    first among ties. An empty table gives an empty result. Other columns are
    ignored, whatever their names. ``total`` is a BIGINT.

    ``broadcast_keys``: with at most so many keys (counted, 16 bytes each) the
    middle positions are broadcast; beyond, they are joined by a shuffle.
    """
    spark = df.sparkSession
    n = partitions or shuffle_partitions(spark)
    rows = df.select(F.col(key).alias("k"), F.col(value).alias("v"), F.col(row_id).alias("i")).filter("k IS NOT NULL")
    # The aggregate needs no further exchange: equal triples share a range.
    placed = (
        rows.repartitionByRange(n, "k", "v", "i")
        .groupBy("k", "v", "i")
        .agg(F.lit(1).alias("one"))
        .sortWithinPartitions("k", "v", "i")
        .select("k", "v", "i", F.monotonically_increasing_id().alias("at"))
    )
    # A second run could sample other bounds; the written table pins them.
    table = materialise(placed, "ranges")
    states = (
        table.groupBy(F.shiftright("at", 33).alias("part"), "k")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count("v").alias("n_values"),
            F.sum("v").cast("bigint").alias("total"),
            F.min(F.when(F.col("v").isNotNull(), F.col("at"))).alias("first_at"),
        )
    )
    own = Window.partitionBy("k")
    upto = own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    stitched = (
        states.withColumn("before", F.coalesce(F.sum("n_values").over(upto), F.lit(0)))
        .withColumn("target", F.floor((F.sum("n_values").over(own) + 1) / 2))
        .withColumn(
            "mid_at",
            F.when(
                (F.col("before") < F.col("target")) & (F.col("target") <= F.col("before") + F.col("n_values")),
                F.col("first_at") + F.col("target") - F.col("before") - 1,
            ),
        )
        .groupBy("k")
        .agg(
            F.sum("n_rows").alias("n_rows"),
            F.sum("n_values").alias("n_values"),
            F.sum("total").alias("total"),
            F.max("mid_at").alias("mid_at"),
        )
    )
    stats = materialise(stitched, "stats")
    few = stats.count() <= broadcast_keys
    wanted = stats.filter("mid_at IS NOT NULL").select(F.col("mid_at").alias("at"))
    found = table.join(F.broadcast(wanted) if few else wanted, "at").select(
        F.col("at").alias("mid_at"), F.col("v").alias("mid_value"), F.col("i").alias("mid_id")
    )
    return (
        stats.join(F.broadcast(found) if few else found, "mid_at", "left")
        .select(F.col("k").alias(key), "n_rows", "n_values", "total", "mid_value", "mid_id")
    )
