"""Duplicates hidden by formatting differences (problem 3): an incremental ledger.

The ledger is a folder of (key, copies, first id) in buckets of the key. A new batch
is reduced to its own counts and full-outer-joined with the buckets it touches;
counts are added, the earliest representative stays, and only those buckets are
written anew. A manifest says which generation of each bucket holds.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaspan.runtime import materialise, remove_tree, scratch_path, shuffle_partitions

SCHEMA = "key binary, n bigint, first_id bigint"


def canonical_key(content: str, name: str) -> F.Column:
    """SHA-256 over the ASCII letters of ``content`` (BINARY) and the sorted fields of ``name``.

    Letters and fields ignore case. Content without a letter, or null, gives null;
    a null name has no fields.
    """
    letters = F.upper(F.regexp_replace(F.decode(F.col(content), "ISO-8859-1"), "[^A-Za-z]", ""))
    fields = F.regexp_extract_all(F.coalesce(F.col(name), F.lit("")), F.lit("[A-Za-z0-9]+"), F.lit(0))
    fields = F.array_sort(F.transform(fields, lambda x: F.upper(x)))
    whole = F.concat_ws("\n", letters, F.concat_ws(" ", fields))
    return F.when(letters != "", F.unhex(F.sha2(whole.cast("binary"), 256)))


def canonical_records(rows: DataFrame, row_id: str, content: str, name: str, rounds: int, batch: str | None = None) -> DataFrame:
    """``(round, key, id)`` of each row that has a key. The round follows from the id,
    so that a record delivered again lies in the same one, or from ``batch``."""
    return rows.select(
        F.pmod(F.xxhash64(F.col(batch) if batch else F.col(row_id).cast("bigint")), F.lit(rounds)).cast("int").alias("round"),
        canonical_key(content, name).alias("key"),
        F.col(row_id).cast("bigint").alias("id"),
    ).filter("key IS NOT NULL AND id IS NOT NULL")


class Ledger:
    """Bucketed counts of canonical keys under ``path``; a ledger that is there already is opened.

    An interrupted ``add`` leaves the ledger as it was: the manifest is written last.
    One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None) -> None:
        self.spark, self.path = spark, path or scratch_path(spark, "ledger")
        self.state = self._manifest() or {"generation": 0, "buckets": buckets or shuffle_partitions(spark), "held": {}, "batches": []}

    def _manifest(self) -> dict | None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        disk = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not disk.exists(at):
            return None
        names = sorted(s.getPath().getName() for s in disk.listStatus(at) if disk.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))
        return json.loads(self.spark.read.text(f"{self.path}/manifest/{names[-1]}").first()[0]) if names else None

    def _places(self, buckets) -> list[str]:
        held = self.state["held"]
        return [f"{self.path}/generation={held[str(b)]}/bucket={b}" for b in buckets if str(b) in held]

    def _read(self, places: list[str]) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(*places) if places else self.spark.createDataFrame([], SCHEMA)

    def table(self) -> DataFrame:
        """``(key, n, first_id)`` of all buckets."""
        return self._read(self._places(range(self.state["buckets"])))

    def add(self, batch: DataFrame, name: str | None = None) -> int:
        """Add a batch of ``(key, id)`` and say how many buckets were written.

        An id that comes twice in a batch counts once; ids of different batches must
        differ. A batch whose ``name`` was added before is left out.
        """
        if name is not None and name in self.state["batches"]:
            return 0
        n = self.state["buckets"]
        bucket = F.pmod(F.hash("key"), F.lit(n))  # as a shuffle by the key into n partitions has it
        own = batch.groupBy("key", "id").agg(F.lit(1).alias("one")).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
        own = materialise(own, "batch")
        touched = sorted(r[0] for r in own.select(bucket).distinct().collect())  # a number for each bucket at most
        generation = self.state["generation"] + 1
        known = self._places(touched)
        merged = own.repartition(n, "key")
        if known:
            old = self._read(known).select("key", F.col("n").alias("old_n"), F.col("first_id").alias("old_id")).repartition(n, "key")
            merged = merged.join(old, "key", "full_outer").select(
                "key",
                (F.coalesce("n", F.lit(0)) + F.coalesce("old_n", F.lit(0))).alias("n"),
                F.least("first_id", "old_id").alias("first_id"),
            )
        merged.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").option("compression", "zstd").parquet(f"{self.path}/generation={generation}")
        held = self.state["held"] | {str(b): generation for b in touched}
        last = f"{self.path}/manifest/{generation - 1:010d}"
        self.state = {"generation": generation, "buckets": n, "held": held, "batches": [*self.state["batches"], *([name] if name is not None else [])]}
        self.spark.createDataFrame([(json.dumps(self.state),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest/{generation:010d}")
        for place in [*known, last]:  # what no manifest names any more
            remove_tree(self.spark, place)
        return len(touched)


def build_ledger(records: DataFrame, rounds: int, ledger: Ledger | None = None) -> Ledger:
    """The ledger after the rounds 0 .. ``rounds`` - 1 of ``(round, key, id)``, one batch each."""
    ledger = ledger or Ledger(records.sparkSession)
    for r in range(rounds):
        ledger.add(records.filter(F.col("round") == r).select("key", "id"))
    return ledger


def copy_pairs(records: DataFrame, ledger: DataFrame, heavy: int = 10_000) -> DataFrame:
    """``(keep_id, dup_id)``: each key's first id beside each of its other ids.

    Keys with more copies than ``heavy`` and than one in 2,000 records number at
    most 2,000; they are joined by broadcast, so that no task gets a hot key. All
    others are joined by a shuffle on the key.
    """
    repeated = ledger.filter("n > 1")
    most = max(heavy, (ledger.agg(F.sum("n")).first()[0] or 0) // 2000)
    ids = records.select("key", "id")
    hot = repeated.filter(F.col("n") > most).select("key", "first_id")
    rest = repeated.filter(F.col("n") <= most).select("key", "first_id")
    a = ids.join(F.broadcast(hot), "key")
    b = ids.join(F.broadcast(hot.select("key")), "key", "left_anti").join(rest, "key")
    pairs = a.unionByName(b).filter("id <> first_id")
    return pairs.select(F.col("first_id").alias("keep_id"), F.col("id").alias("dup_id")).distinct()


def hidden_duplicates(rows: DataFrame, row_id: str, content: str, name: str, batch: str | None = None, rounds: int = 4) -> tuple[DataFrame, DataFrame]:
    """Records that differ in layout only: ``(records, ledger)``.

    ``records`` is ``(round, key, id)``; ``ledger`` is ``(key, n, first_id)`` with
    the number of distinct ids of each key and the smallest. Rows without any
    letter in the content or with a null id don't count. An empty table gives an
    empty ledger. Rounds follow from the ids; with ``batch`` they follow from that
    column (a null batch is a batch), and an id that lies in two rounds is a
    ValueError, as it would count twice.
    """
    spark = rows.sparkSession
    path = scratch_path(spark, "canonical")
    canonical_records(rows, row_id, content, name, rounds, batch).write.partitionBy("round").option("compression", "zstd").parquet(path)
    records = spark.read.schema("key binary, id bigint, round int").parquet(path)
    if batch and not records.groupBy("id").agg(F.countDistinct("round").alias("n")).filter("n > 1").isEmpty():
        raise ValueError(f"an id lies in more than one {batch}")
    return records, build_ledger(records, rounds).table()
