"""Streams of queries against a stored index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexaspan.operators.index import SuffixIndex
from lexaspan.operators.search import count, locate


def answer_stream(queries: DataFrame, index: SuffixIndex, path: str, checkpoint: str, what: str = "count", trigger: dict | None = None) -> StreamingQuery:
    """Answer each micro-batch of ``(query_num, query)`` and append it to Parquet under ``path``.

    A batch that is run again after a failure replaces its own folder, so each
    query is answered once.
    """
    answer = {"count": count, "locate": locate}[what]

    def one(batch: DataFrame, number: int) -> None:
        answer(index, batch.select(F.col("query_num").cast("int").alias("query_num"), "query")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def count_windows(requests: DataFrame, time: str, late: str = "14 days", width: str = "1 day") -> DataFrame:
    """Requests for each query string in tumbling windows; rows later than ``late`` are left out."""
    return requests.withWatermark(time, late).groupBy(F.window(time, width), "query").agg(F.count(F.lit(1)).alias("n"))
