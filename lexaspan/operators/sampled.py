"""Searches through a sub-sample of an index: one row for each group of suffixes that share their first symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexaspan.operators.index import SuffixIndex
from lexaspan.operators.search import effective_queries, rows_of
from lexaspan.runtime import shuffle_partitions


class SampledIndex:
    """Ranks of all prefixes of up to ``max_query_len`` symbols, kept beside the index.

    The table is written once under the index's folder and named after the build it
    came from: an index that was built anew has another name, so that a stale table
    is never read. It holds (key, rank_start, rank_end) of each group, far fewer rows
    than suffixes, and answers counts and rank ranges alone; positions are read from
    the index by rank.
    """

    def __init__(self, index: SuffixIndex, max_query_len: int) -> None:
        if not 0 < max_query_len <= index.key_len:
            raise ValueError(f"max_query_len must be between 1 and {index.key_len}")
        self.index, self.most = index, max_query_len
        self.path = f"{index.path}/sampled-{max_query_len}-{index.metadata['build']}"

    def groups(self) -> DataFrame:
        """``(key, rank_start, rank_end)`` in order of the key, from the kept table; made where there is none."""
        spark = self.index.spark
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_SUCCESS")
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            self._write()
        return spark.read.parquet(self.path)

    def _write(self) -> None:
        first = self.index.subsample(self.most).select(F.substring("key", 1, self.most).alias("key"), F.col("rank").alias("rank_start"))
        n = shuffle_partitions(self.index.spark)
        placed = first.repartitionByRange(n, "rank_start").sortWithinPartitions("rank_start").withColumn("at_", F.monotonically_increasing_id()).withColumn("part_", F.shiftright("at_", 33))
        inside = F.lead("rank_start").over(Window.partitionBy("part_").orderBy("rank_start"))
        heads = placed.groupBy("part_").agg(F.min("rank_start").alias("head_"))
        after = F.lead("head_").over(Window.orderBy("part_"))  # a row for each partition
        over = heads.select("part_", F.coalesce(after, F.lit(self.index.len_suffixes)).alias("over_"))
        rows = placed.withColumn("next_", inside).join(F.broadcast(over), "part_")
        rows.select("key", "rank_start", F.coalesce("next_", "over_").alias("rank_end")).sortWithinPartitions("rank_start").write.mode("overwrite").option("compression", "zstd").parquet(self.path)

    def rank_ranges(self, queries: DataFrame) -> DataFrame:
        """``(query_num, query, rank_start, rank_end)``, half-open; null for a miss. Queries are cut to ``max_query_len``."""
        own = effective_queries(queries, self.index.options, self.most)
        groups, n = self.groups(), self.index.len_suffixes
        lengths = [r[0] for r in own.filter("q IS NOT NULL").select(F.length("q")).distinct().collect()]  # at most max_query_len + 1
        found = own.filter(F.length("q") == 0).select("query_num", F.lit(0).cast("bigint").alias("rank_start"), F.lit(n).cast("bigint").alias("rank_end")).filter(F.lit(n > 0))
        for length in sorted(x for x in lengths if x):
            same = groups.filter(F.length("key") >= length).groupBy(F.substring("key", 1, length).alias("q")).agg(F.min("rank_start").alias("rank_start"), F.max("rank_end").alias("rank_end"))
            found = found.unionByName(own.filter(F.length("q") == length).join(same, "q").select("query_num", "rank_start", "rank_end"))
        return queries.select("query_num", "query").join(found, "query_num", "left")

    def count(self, queries: DataFrame) -> DataFrame:
        """``(query_num, query, count)``."""
        n = F.coalesce(F.col("rank_end") - F.col("rank_start"), F.lit(0)).cast("bigint")
        return self.rank_ranges(queries).select("query_num", "query", n.alias("count"))

    def search(self, queries: DataFrame) -> DataFrame:
        """Hits as of ``search.search``, the positions read from the index by their ranks."""
        found = self.rank_ranges(queries).filter("rank_start IS NOT NULL")
        return rows_of(self.index, found).select("query_num", "query", "rank", "pos", "seq_id", "seq_pos")
