"""The suffix index: a relation sorted by key, with ranks and common-prefix lengths, kept as Parquet."""

from __future__ import annotations

import json
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexaspan.functions.symbols import common_prefix
from lexaspan.operators.corpus import IN_PART, BuildOptions, suffix_rows, with_surroundings
from lexaspan.operators.full_sort import FIRST, full_order
from lexaspan.runtime import scratch_path, ship, shuffle_partitions

VERSION = 2
#: Corpora with a sequence longer than this have their pieces dealt out before they are enumerated.
LONG = 1 << 24
#: Row groups and pages of the stored suffixes are small, so that a key range reads little beyond itself.
LAYOUT = {"parquet.block.size": str(16 << 20), "parquet.page.size": str(128 << 10)}
#: Every so many rows of a partition the key is kept apart, as a fence.
FENCE = 1 << 14
#: Ranges that one scan is given; more are merged, nearest first.
RANGES = 64


def _with_lcp(rows: DataFrame, width: int) -> DataFrame:
    """Add ``lcp`` with the row before in the same partition (0 in its first row), vectorised over Arrow batches."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = b""
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("key")
            offsets = np.frombuffer(keys.buffers()[1], np.int32)[keys.offset : keys.offset + len(keys) + 1].astype(np.int64)
            data = np.frombuffer(keys.buffers()[2] or b"", np.uint8)
            lengths = np.concatenate([[len(last)], np.diff(offsets)])
            grid = np.zeros((len(keys) + 1, width), np.uint8)
            grid[0, : len(last)] = np.frombuffer(last, np.uint8)
            column = np.arange(width)
            inside = column < lengths[1:, None]
            grid[1:][inside] = data[(offsets[:-1, None] + column)[inside]]
            same = grid[1:] == grid[:-1]
            lcp = np.where(same.all(axis=1), width, same.argmin(axis=1))
            lcp = np.minimum(lcp, np.minimum(lengths[1:], lengths[:-1])).astype(np.int32)
            last = keys[-1].as_py()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lcp)], names=[*batch.schema.names, "lcp"])

    return rows.mapInArrow(run, "pos bigint, seq_id bigint, seq_pos bigint, key binary, lcp int")


class SuffixIndex:
    """A stored index: ``suffixes`` by (key, position descending), ``parts``, ``sequences`` and ``meta``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    @classmethod
    def build(cls, seqs: DataFrame, options: BuildOptions, path: str | None = None, name: str = "", partitions: int | None = None) -> SuffixIndex:
        """Sort all suffixes of ``seqs`` (see ``corpus.sequences``) and store the index.

        One range exchange on (key, position) orders the suffixes; ``parts`` keeps for
        each partition its rows and its first and last key and position, from which
        ranks and the prefix lengths across boundaries follow when the index is read.
        An index of whole suffixes goes through prefix doubling.
        """
        spark = seqs.sparkSession
        ship(spark)
        path = path or scratch_path(spark, "index")
        placed = with_surroundings(seqs, options)
        if options.reach:
            n = partitions or shuffle_partitions(spark)
            longest = placed.agg(F.max(F.length("own"))).first()[0] or 0
            rows = suffix_rows(placed, options, spread=n if longest > LONG else 0)
            rows = rows.repartitionByRange(n, F.col("key").asc(), F.col("pos").desc()).sortWithinPartitions(F.col("key").asc(), F.col("pos").desc())
            rows = _with_lcp(rows, options.mask.weight if options.mask else options.max_query_len)
        else:
            rows = full_order(placed, options)
        rows.withColumn("at", F.monotonically_increasing_id()).write.options(**LAYOUT).option("compression", "zstd").parquet(f"{path}/suffixes")
        stored = spark.read.parquet(f"{path}/suffixes")
        edge = F.struct("key", "pos")
        ends = stored.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min_by(edge, "at").alias("first"), F.max_by(edge, "at").alias("last"))
        by_part = Window.orderBy("part")  # a row for each partition of the range exchange
        width = options.mask.weight if options.mask else options.max_query_len
        before = F.lag("last").over(by_part)["key"]
        ends = ends.select(
            "part", "n",
            F.coalesce(F.sum("n").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("rank_before"),
            F.coalesce(common_prefix(before, F.col("first")["key"], width), F.lit(0)).alias("first_lcp") if width else F.lit(None).cast("int").alias("first_lcp"),
            F.col("first")["key"].alias("first_key"), F.col("last")["key"].alias("last_key"), F.col("first")["pos"].alias("first_pos"), F.col("last")["pos"].alias("last_pos"),
        )
        ends.coalesce(1).write.parquet(f"{path}/parts")
        fences = stored.filter(F.col("at") % FENCE == 0).select("at", "key")
        fences.repartitionByRange(shuffle_partitions(spark), "at").sortWithinPartitions("at").write.options(**LAYOUT).parquet(f"{path}/fences")
        placed.select("seq_id", "seq_name", "seq_start", "seq_len", "own").write.option("compression", "zstd").parquet(f"{path}/sequences")
        totals = spark.read.parquet(f"{path}/sequences").agg(F.sum(F.length("own")).alias("text_len"), F.count(F.lit(1)).alias("num_sequences")).first()
        meta = {
            "filename": name, "file_version": VERSION, "is_dna": options.is_dna, "allow_ambiguity": options.allow_ambiguity,
            "ignore_softmask": options.ignore_softmask, "text_len": totals.text_len or 0,
            "len_suffixes": spark.read.parquet(f"{path}/parts").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0],
            "max_query_len": options.max_query_len, "seed_mask": options.seed_mask, "num_sequences": totals.num_sequences,
            "delimiter": options.delimiter, "scope": options.scope, "build": uuid.uuid4().hex,
        }
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.text(f"{path}/meta")
        return cls(spark, path)

    @cached_property
    def metadata(self) -> dict:
        """The stored facts; an index of an unknown version is refused."""
        meta = json.loads(self.spark.read.text(f"{self.path}/meta").first()[0])
        if meta["file_version"] != VERSION:
            raise ValueError(f"unknown index version {meta['file_version']}")
        return meta

    @cached_property
    def options(self) -> BuildOptions:
        m = self.metadata
        return BuildOptions(m["is_dna"], m["allow_ambiguity"], m["ignore_softmask"], m["max_query_len"], m["seed_mask"], m["delimiter"], m["scope"])

    @property
    def key_len(self) -> int:
        """Symbols of a suffix that its key holds."""
        o = self.options
        return o.mask.weight if o.mask else o.max_query_len or FIRST

    @cached_property
    def parts(self) -> list[tuple[int, int, int, bytes]]:
        """(part, rank before it, rows, first key), a row for each stored partition."""
        return [(r.part, r.rank_before, r.n, bytes(r.first_key)) for r in self.spark.read.parquet(f"{self.path}/parts").orderBy("part").collect()]

    @property
    def text_len(self) -> int:
        return self.metadata["text_len"]

    @property
    def len_suffixes(self) -> int:
        return self.metadata["len_suffixes"]

    def size_and_time(self) -> tuple[int, int]:
        """Bytes of the stored index and when it was finished, in seconds since 1970."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        disk = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return disk.getContentSummary(at).getLength(), disk.getFileStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/meta")).getModificationTime() // 1000

    def sequences(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/sequences")

    def stored(self) -> DataFrame:
        """The suffix table as written: ``at`` is the partition (from bit 33) and the place in it."""
        return self.spark.read.parquet(f"{self.path}/suffixes")

    def suffixes(self, rows: DataFrame | None = None) -> DataFrame:
        """``(rank, pos, seq_id, seq_pos, lcp, key)`` of the stored rows, or of some of them; further columns stay."""
        parts = self.spark.read.parquet(f"{self.path}/parts").select("part", "rank_before", "first_lcp")
        rows = self.stored() if rows is None else rows
        own = ("pos", "seq_id", "seq_pos", "lcp", "key", "at")
        inside = F.col("at").bitwiseAND(F.lit(IN_PART))
        return rows.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(parts), "part").select(
            (F.col("rank_before") + inside).alias("rank"), "pos", "seq_id", "seq_pos",
            F.when((inside == 0) & F.col("first_lcp").isNotNull(), F.col("first_lcp")).otherwise(F.col("lcp")).alias("lcp"), "key",
            *[c for c in rows.columns if c not in own],
        )

    def rank_range(self, begin: int, end: int) -> DataFrame:
        """Ranks [begin, end); beyond the index a ValueError. The range is pushed to the scan."""
        if not 0 <= begin < end <= self.len_suffixes:
            raise ValueError(f"Invalid range: {begin}..{end}")
        return self.at_ranks([(begin, end)])

    def at_ranks(self, ranges: list[tuple[int, int]]) -> DataFrame:
        """The rows of some half-open ranges of ranks, each row once; only what lies near them is read.

        Up to ``RANGES`` ranges exactly; of more the nearest are joined, so that rows between come along.
        """
        near = [(self._at(a), self._at(b - 1) + 1) for a, b in merged(ranges, RANGES) if a < b]
        return self.suffixes(self.stored().filter(_between("at", near)))

    def _at(self, rank: int) -> int:
        """Where a rank is stored: places rise with ranks."""
        part, before, _, _ = self.parts[bisect_right(self.parts, rank, key=lambda p: p[1]) - 1]
        return (part << 33) + rank - before

    def at_rank(self, rank: int) -> DataFrame:
        """The row of one rank; none beyond the index."""
        return self.at_ranks([(rank, rank + 1)] if 0 <= rank < self.len_suffixes else [])

    def ranks_below(self, keys: list[bytes]) -> dict[bytes, int]:
        """For each of some keys how many suffixes have a lower one.

        The first keys of the partitions tell the partition, its fences the block of
        ``FENCE`` rows, and that block alone is read: two short scans for any number
        of keys.
        """
        first = [p[3] for p in self.parts]
        by_part: dict[int, list[bytes]] = {}
        for k in sorted(set(keys)):
            if (j := bisect_left(first, k) - 1) >= 0:
                by_part.setdefault(self.parts[j][0], []).append(k)
        before = {p: b for p, b, _, _ in self.parts}
        found = dict.fromkeys(keys, 0)
        if not by_part:
            return found
        ship(self.spark)
        parts = [((p << 33), (p + 1) << 33) for p in by_part]
        fences = self.spark.read.parquet(f"{self.path}/fences").filter(_between("at", parts))
        fence = {(p, by_part[p][i]): at for p, i, at in _places(fences, by_part, None)}
        blocks: dict[int, list[bytes]] = {}
        for (p, k), at in fence.items():
            blocks.setdefault(at, []).append(k)
        rows = self.stored().filter(_between("at", [(at, at + FENCE) for at in blocks]))
        last = {(at, blocks[at][i]): x for at, i, x in _places(rows, blocks, FENCE)}
        for (p, k), at in fence.items():
            found[k] = before[p] + (max(at, last[at, k]) & IN_PART) + 1
        return found

    def key_ranges(self, ranges: list[tuple[bytes, bytes | None]]) -> DataFrame:
        """Stored rows whose key may lie in one of some ranges [low, high), in order of a range (high None: no end).

        The condition reaches the scan: files, row groups and pages beyond the ranges
        aren't read. More than ``RANGES`` are merged, so further rows may come along.
        """
        keep = F.lit(False)
        joined: list[tuple[bytes, bytes | None]] = []
        for low, high in sorted(ranges, key=lambda r: r[0]):
            if joined and (joined[-1][1] is None or joined[-1][1] >= low):
                end = joined[-1][1]
                joined[-1] = (joined[-1][0], None if end is None or high is None else max(end, high))
            else:
                joined.append((low, high))
        each = -(-len(joined) // RANGES) or 1
        for k in range(0, len(joined), each):
            low, high = joined[k][0], joined[min(k + each, len(joined)) - 1][1]
            own = F.col("key") >= F.lit(low)
            keep = keep | (own if high is None else own & (F.col("key") < F.lit(high)))
        return self.stored().filter(keep)

    def subsample(self, max_query_len: int) -> DataFrame:
        """The first suffix of each group that shares its first symbols, with its rank in the whole."""
        return self.suffixes().filter(F.col("lcp") < max_query_len)


def _between(column: str, ranges: list[tuple[int, int]]):
    keep = F.lit(False)
    for a, b in merged(ranges, RANGES):
        keep = keep | ((F.col(column) >= a) & (F.col(column) < b))
    return keep


def _places(rows: DataFrame, asked: dict[int, list[bytes]], block: int | None) -> list[tuple[int, int, int]]:
    """(group, number, greatest ``at`` with a key below it) for the keys ``asked`` of each group of rows.

    A group is a stored partition, or, with ``block``, the rows from a fence on. Rows
    come in runs of rising ``at``. The answers are as many as the keys asked.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, keys, out = batch.column("at").to_numpy(), batch.column("key"), []
            group = at >> 33 << 33 if block is None else at - (at & IN_PART) % block
            cut = [0, *(np.flatnonzero((np.diff(at) < 0) | (np.diff(group) != 0)) + 1).tolist(), len(at)]
            for a, b in zip(cut, cut[1:]):
                g = int(group[a]) if a < b else None
                name = g if block or g is None else g >> 33
                some = keys.slice(a, b - a)
                for i, k in enumerate(asked.get(name, ())):
                    if n := bisect_left(range(len(some)), k, key=lambda j, some=some: some[j].as_py()):
                        out.append((name, i, int(at[a + n - 1])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["g", "i", "at"])

    found = rows.select("at", "key").mapInArrow(run, "g bigint, i bigint, at bigint")
    return [tuple(r) for r in found.groupBy("g", "i").agg(F.max("at")).collect()]


def merged(ranges: list[tuple[int, int]], most: int | None = None) -> list[tuple[int, int]]:
    """Half-open ranges in order, joined where they meet; beyond ``most`` of them the narrowest gaps are closed too."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    if most and len(out) > most:
        gaps = sorted(range(1, len(out)), key=lambda k: out[k][0] - out[k - 1][1], reverse=True)[: most - 1]
        cuts = [0, *sorted(gaps), len(out)]
        out = [[out[a][0], out[b - 1][1]] for a, b in zip(cuts, cuts[1:])]
    return [(a, b) for a, b in out]
