"""Substring queries over suffix relations: count, search, locate and extract."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexaspan.functions.symbols import DNA, common_prefix, context_bounds, successor
from lexaspan.operators.corpus import BuildOptions, suffix_rows, with_surroundings
from lexaspan.operators.index import SuffixIndex
from lexaspan.runtime import materialise, ship, spread

#: At most so many queries, and so many bytes of them, are sent to every task; more are joined by a shuffle on their prefix.
BROADCAST_QUERIES, BROADCAST_BYTES = 200_000, 32 << 20
#: Ranks that share a cell of the join between ranges of ranks and rows.
CELL = 12


def effective_queries(queries: DataFrame, options: BuildOptions, max_query_len: int | None = None) -> DataFrame:
    """``(query_num, query, q)``: what of each query is compared.

    The query is cut to the smaller of the two lengths the index was built with and
    is asked with (0 or none is no limit); with a seed mask it is projected first
    and the limit counts compared symbols. Null queries match nothing; the empty
    query matches every suffix.
    """
    limits = [x for x in (options.max_query_len, max_query_len) if x]
    most = min(limits, default=0)
    if options.mask:
        q = F.encode(F.col("query"), "UTF-8")
        parts, left = [], most or options.mask.weight
        for at, n in options.mask.runs():
            if left > 0:
                parts.append(F.substring(q, at + 1, min(n, left)))
                left -= n
        q = F.concat(*parts)
    else:
        q = F.encode(F.col("query"), "UTF-8")
        q = F.substring(q, 1, most) if most else q
    return queries.select("query_num", "query", q.alias("q"))


def _fits(own: DataFrame) -> bool:
    """Whether so many queries may be sent to every task."""
    n, size = own.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("query") + 16), F.lit(0))).first()
    return n <= BROADCAST_QUERIES and size <= BROADCAST_BYTES


def match(suffixes: DataFrame, queries: DataFrame, keep: list[str], with_empty: bool = True) -> DataFrame:
    """Suffixes whose ``key`` starts with ``q``: an equi-join for each class of query lengths.

    For more queries than can be sent to every task. Queries of 2^i to 2^(i+1) - 1
    symbols share their first 2^i as the join key, so a class costs one hash join and
    the full comparison is a filter behind it. Empty queries match every suffix;
    ``with_empty`` False leaves them out.
    """
    own = queries.filter("q IS NOT NULL").withColumn("n", F.length("q")).withColumn("class", F.when(F.col("n") > 0, F.floor(F.log2(F.col("n") + F.lit(0.0)))).otherwise(-1).cast("int"))
    out = None
    for (c,) in sorted(own.select("class").distinct().collect()):  # at most 32 rows
        some = own.filter(F.col("class") == c)
        if c < 0:
            if with_empty:
                part = _every(suffixes, some)
            else:
                continue
        else:
            head = 1 << c
            left = suffixes.filter(F.length("key") >= head).withColumn("h", F.substring("key", 1, head))
            part = left.join(some.withColumn("h", F.substring("q", 1, head)).drop("n", "class"), "h").filter(F.col("key").startswith(F.col("q")))
        part = part.select("query_num", "query", "q", *keep)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else suffixes.limit(0).select(F.lit(0).alias("query_num"), F.lit("").alias("query"), F.lit(b"").alias("q"), *keep)


def _every(suffixes: DataFrame, empty: DataFrame) -> DataFrame:
    """All suffixes for each empty query, as the result has it."""
    few = empty.select("query_num", "query", "q", F.length("q").alias("none_"))
    return suffixes.withColumn("none_", F.lit(0)).join(F.broadcast(few) if _fits(few) else few, "none_").drop("none_")


def counts(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """``(query_num, query, count)`` with a row for each query, 0 for a miss."""
    found = hits.groupBy("query_num").agg(F.count(F.lit(1)).alias("count"))
    return queries.select("query_num", "query").join(found, "query_num", "left").select("query_num", "query", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))


class _Patterns:
    """Queries as hashes of their first compared symbols, by length."""

    FIRST = 16

    def __init__(self, queries: list[bytes], places: list[int] | None) -> None:
        """``places`` are the compared offsets of a mask; none means all."""
        self.queries, self.places, top = queries, places, np.uint64(64 - 20)
        by_length: dict[int, dict[int, list[int]]] = {}
        for i, q in enumerate(queries):
            h = 0
            for c in q[: self.FIRST]:
                h = (h * 0x9E3779B97F4A7C15 + c + 1) % 2**64
            by_length.setdefault(min(len(q), self.FIRST), {}).setdefault(h, []).append(i)
        self.classes = []
        for n in sorted(by_length):
            hashes = np.array(sorted(by_length[n]), np.uint64)
            sieve = np.zeros(1 << 20, bool)
            sieve[(hashes >> top).astype(np.int64)] = True
            self.classes.append((n, hashes, sieve, [by_length[n][int(h)] for h in hashes]))

    def count(self, text: np.ndarray, ends: np.ndarray, firsts: np.ndarray, allowed: np.ndarray | None, found: np.ndarray) -> None:
        """Add to ``found`` how often each query begins in ``text``."""
        for i, at in self.hits(text, ends, firsts, allowed):
            found[i] += len(at)

    def hits(self, text: np.ndarray, ends: np.ndarray, firsts: np.ndarray, allowed: np.ndarray | None) -> Iterator[tuple[int, np.ndarray]]:
        """(query, places where it begins) in ``text``, many pieces side by side.

        A query begins before the ``firsts`` and ends by the ``ends`` of its piece.
        """
        step, h, done = np.uint64(0x9E3779B97F4A7C15), np.zeros(len(text), np.uint64), 0
        wide = text.astype(np.uint64) + np.uint64(1)
        place = (lambda j: j) if self.places is None else self.places.__getitem__
        for n, hashes, sieve, lists in self.classes:
            m = len(text) - place(n - 1)
            if m <= 0:
                return
            for j in range(done, n):
                h = h[:m] * step
                h += wide[place(j) : place(j) + m]
            h, done = h[:m], n
            at = np.flatnonzero(sieve[(h >> np.uint64(64 - 20)).view(np.int64)])
            k = np.minimum(np.searchsorted(hashes, h[at]), len(hashes) - 1)
            real = hashes[k] == h[at]
            if allowed is not None:
                real &= allowed[text[at]]
            at, k = at[real], k[real]
            piece = np.searchsorted(ends, at, side="right")
            inside = (at < firsts[piece]) & (at + place(n - 1) < ends[piece])
            at, k, end = at[inside], k[inside], ends[piece[inside]]
            order = np.argsort(k, kind="stable")
            at, k, end = at[order], k[order], end[order]
            cut = np.flatnonzero(np.diff(k, prepend=-1))
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(k)]):
                for i in lists[k[a]]:
                    q = np.frombuffer(self.queries[i], np.uint8)
                    offsets = np.arange(len(q)) if self.places is None else np.array(self.places[: len(q)])
                    own = at[a:b][at[a:b] + offsets[-1] < end[a:b]]
                    for c in range(0, len(own), 65_536):
                        some = own[c : c + 65_536]
                        yield i, some[(text[some[:, None] + offsets] == q).all(axis=1)]


def count_in(seqs: DataFrame, queries: DataFrame, options: BuildOptions, max_query_len: int | None = None, piece: int = 1 << 20) -> DataFrame:
    """Counts straight from the sequences: neither order nor rank is needed, so nothing is sorted.

    Queries up to the stated bound are sent to every task, which reads its sequences
    once for all of them and gives one number for each; more are joined with the
    suffixes by a shuffle.
    """
    own = effective_queries(queries, options, max_query_len)
    placed = with_surroundings(seqs, options)
    if not _fits(own):
        rows = suffix_rows(placed, options)
        out = counts(match(rows, own, [], with_empty=False), queries)
        empty = own.filter(F.length("q") == 0).select("query_num")
        if empty.isEmpty():
            return out
        every = rows.count()  # of the relation, not of its hits
        return out.join(empty.withColumn("e", F.lit(every)), "query_num", "left").select("query_num", "query", F.coalesce("e", "count").alias("count"))
    ship(seqs.sparkSession)
    asked = sorted(bytes(r.q) for r in own.filter("q IS NOT NULL").select("q").distinct().collect())
    some = [q for q in asked if q]
    reach = options.reach
    places = options.mask.positions if options.mask else None
    dna = options.is_dna and not options.allow_ambiguity

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns, found, total = _Patterns(some, places), np.zeros(len(some), np.int64), 0
        allowed = np.zeros(256, bool)
        allowed[list("".join(DNA).encode())] = True
        pieces: list[np.ndarray] = []
        firsts: list[int] = []

        def look() -> None:
            if pieces and some:
                ends = np.cumsum([len(x) for x in pieces])
                patterns.count(np.concatenate(pieces), ends, ends - [len(x) for x in pieces] + firsts, allowed if dna else None, found)
            pieces.clear()
            firsts.clear()

        for batch in batches:
            halos, size = batch.column(1), 0
            for k, x in enumerate(batch.column(0)):
                own_text = np.frombuffer(x.as_buffer() or b"", np.uint8)
                if not (n := len(own_text)):
                    continue
                halo = np.frombuffer(halos[k].as_buffer() or b"", np.uint8)
                total += int(allowed[own_text].sum()) if dna else n
                for a in range(0, n, piece):
                    looked = own_text[a : a + piece + reach]
                    if len(looked) < piece + reach and len(halo):
                        looked = np.concatenate([looked, halo[: max(0, a + piece + reach - n)]])
                    pieces.append(looked)
                    firsts.append(min(piece, n - a))
                    size += len(looked)
                    if size >= piece:
                        look()
                        size = 0
            look()
        hit = np.flatnonzero(found)
        rows = [(some[i], int(found[i])) for i in hit.tolist()] + [(b"", total)]
        yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in rows], pa.binary()), pa.array([n for _, n in rows], pa.int64())], names=["q", "n"])

    found = spread(placed.select("own", "halo")).mapInArrow(run, "q binary, n bigint").groupBy("q").agg(F.sum("n").alias("n"))
    return own.join(found, "q", "left").select("query_num", "query", F.coalesce("n", F.lit(0)).cast("bigint").alias("count"))


def missing(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Queries without a hit."""
    return queries.select("query_num", "query").join(hits.select("query_num").distinct(), "query_num", "left_anti")


def _heads(index: SuffixIndex, own: DataFrame) -> list[tuple[bytes, int, int]]:
    """(head, first rank, end rank) of the distinct heads of queries, as far as a key reaches. At most ``BROADCAST_QUERIES``."""
    head = F.substring("q", 1, index.key_len)
    heads = [bytes(r.h) for r in own.filter(F.length("q") > 0).select(head.alias("h")).distinct().collect()]
    ends = {h: successor(h) for h in heads}
    below = index.ranks_below([*heads, *[e for e in ends.values() if e is not None]])
    return [(h, below[h], index.len_suffixes if ends[h] is None else below[ends[h]]) for h in heads]


def _ranges(index: SuffixIndex, own: DataFrame) -> DataFrame:
    """``(query_num, query, q, rank_start, rank_end)`` of what has a head in the index; the empty query has all ranks."""
    n = index.len_suffixes
    rows = [r for r in [*_heads(index, own), (b"", 0, n)] if r[1] < r[2]]
    table = index.spark.createDataFrame(rows, "h binary, rank_start bigint, rank_end bigint")
    return own.withColumn("h", F.substring("q", 1, index.key_len)).join(F.broadcast(table), "h").drop("h")


def rows_of(index: SuffixIndex, ranges: DataFrame) -> DataFrame:
    """The suffixes of each range of ranks: an equi-join on cells of ranks."""
    bounds = [(r[0], r[1]) for r in ranges.select("rank_start", "rank_end").distinct().collect()]
    cells = ranges.select("*", F.explode(F.sequence(F.shiftright("rank_start", CELL), F.shiftright(F.col("rank_end") - 1, CELL))).alias("cell_"))
    few = sum((b - a >> CELL) + 2 for a, b in bounds) <= BROADCAST_QUERIES
    rows = index.at_ranks(bounds).withColumn("cell_", F.shiftright("rank", CELL))
    inside = (F.col("rank") >= F.col("rank_start")) & (F.col("rank") < F.col("rank_end"))
    return rows.join(F.broadcast(cells) if few else cells, "cell_").filter(inside)


def _verified(index: SuffixIndex, hits: DataFrame, keep: list[str]) -> DataFrame:
    """Hits of queries that are longer than the keys, held against the text behind the key."""
    n = index.key_len
    long = hits.filter(F.length("q") > n).withColumn("from_", F.col("pos") + n).withColumn("to_", F.least(F.col("pos") + F.length("q"), F.lit(index.text_len)))
    seen = text_ranges(index, long.select("query_num", "query", "q", *keep, "from_", "to_"), "from_", "to_", ["query_num", "rank"])
    same = F.encode("text", "ISO-8859-1") == F.substring(F.col("q"), n + 1, F.lit(1 << 30))
    return seen.filter(same).select("query_num", "query", *keep)


def search(index: SuffixIndex, queries: DataFrame, max_query_len: int | None = None) -> DataFrame:
    """Hits: ``(query_num, query, rank, pos, seq_id, seq_pos)``.

    Each query is looked up by its head, as many symbols as a key holds: the order of
    the index gives its ranks, and only their rows are read. What a query of a
    whole-suffix index has beyond its head is then held against the text.
    """
    own = effective_queries(queries, index.options, max_query_len)
    keep = ["rank", "pos", "seq_id", "seq_pos"]
    if _fits(own):
        hits = rows_of(index, _ranges(index, own))
    else:
        heads = own.select("query_num", F.struct("query", "q").alias("query"), F.substring("q", 1, index.key_len).alias("q"))
        hits = match(index.suffixes(), heads, keep).select("query_num", "query.query", "query.q", *keep)
    short = hits.filter(F.length("q") <= index.key_len).select("query_num", "query", *keep)
    if index.options.max_query_len or index.options.mask:
        return short
    return short.unionByName(_verified(index, hits, keep))


def rank_ranges_of(index: SuffixIndex, queries: DataFrame, max_query_len: int | None = None) -> DataFrame:
    """``(query_num, query, rank_start, rank_end)``, half-open; null for a miss. No hit is read but those of queries beyond the keys."""
    own = effective_queries(queries, index.options, max_query_len)
    if not _fits(own):
        return rank_ranges(search(index, queries, max_query_len), queries)
    found = _ranges(index, own)
    exact = found.filter(F.length("q") <= index.key_len).select("query_num", "rank_start", "rank_end")
    if not (index.options.max_query_len or index.options.mask):
        long = own.filter(F.length("q") > index.key_len).select("query_num", "query")
        deep = rank_ranges(search(index, long, max_query_len), long).drop("query").filter("rank_start IS NOT NULL")
        exact = exact.unionByName(deep)
    return queries.select("query_num", "query").join(exact, "query_num", "left")


def count(index: SuffixIndex, queries: DataFrame, max_query_len: int | None = None) -> DataFrame:
    """``(query_num, query, count)`` from the ranks of each query."""
    n = F.coalesce(F.col("rank_end") - F.col("rank_start"), F.lit(0)).cast("bigint")
    return rank_ranges_of(index, queries, max_query_len).select("query_num", "query", n.alias("count"))


def rank_ranges(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """``(query_num, query, rank_start, rank_end)``, half-open, of hits that were found; null for a miss."""
    found = hits.groupBy("query_num").agg(F.min("rank").alias("rank_start"), (F.max("rank") + 1).alias("rank_end"))
    return queries.select("query_num", "query").join(found, "query_num", "left")


def locate(index: SuffixIndex, queries: DataFrame, max_query_len: int | None = None) -> DataFrame:
    """``(query_num, query, rank, suffix, sequence_name, sequence_position)``; the final and
    the parting symbols belong to the sequence before them."""
    return located(index, search(index, queries, max_query_len))


def located(index: SuffixIndex, hits: DataFrame) -> DataFrame:
    """The same for hits that were found."""
    return hits.join(index.sequences().select("seq_id", "seq_name"), "seq_id").select(
        "query_num", "query", "rank", F.col("pos").alias("suffix"), F.col("seq_name").alias("sequence_name"), F.col("seq_pos").alias("sequence_position")
    )


def locate_arrays(located: DataFrame, queries: DataFrame) -> DataFrame:
    """A row for each query with its positions in rank order; empty for a miss."""
    found = located.groupBy("query_num").agg(F.array_sort(F.collect_list(F.struct("rank", "suffix", "sequence_name", "sequence_position"))).alias("positions"))
    empty = F.array().cast(found.schema["positions"].dataType)
    return queries.select("query_num", "query").join(found, "query_num", "left").withColumn("positions", F.coalesce("positions", empty))


def text_ranges(index: SuffixIndex, ranges: DataFrame, start: str, end: str, key: list[str] | None = None, piece: int = 4096) -> DataFrame:
    """Add ``text``, the joined text in [start, end), to rows of ``ranges``.

    The text is cut into pieces on a fixed grid; a range asks for the cells it
    touches, so the range join is an equi-join on cell numbers. ``key`` names columns
    that tell the rows apart; without it rows are numbered, and the numbers written
    before they are used.
    """
    own = ranges if key else materialise(ranges.withColumn("range_id_", F.monotonically_increasing_id()), "ranges")
    key = key or ["range_id_"]
    base = F.col("seq_start")
    n = F.length("own")
    cells = index.sequences().filter(n > 0).select("own", "seq_start", n.alias("n"), F.explode(F.sequence(F.floor(base / piece), F.floor((base + n - 1) / piece))).alias("cell"))
    begin = F.greatest(F.col("cell") * piece, base)
    stop = F.least((F.col("cell") + 1) * piece, base + F.col("n"))
    cells = cells.select("cell", begin.alias("b_"), F.substring("own", (begin - base).cast("int") + 1, (stop - begin).cast("int")).alias("part_"))
    touched = F.when(F.col(end) > F.col(start), F.sequence(F.floor(F.col(start) / piece), F.floor((F.col(end) - 1) / piece)))
    meets = (F.col("cell") == F.col("cell_")) & (F.col("b_") < F.col(end)) & (F.col("b_") + F.length("part_") > F.col(start))
    got = own.select("*", F.explode_outer(touched).alias("cell_")).join(cells, meets, "left").withColumn("from_c", F.greatest(F.col(start), F.col("b_"))).withColumn("to_c", F.least(F.col(end), F.col("b_") + F.length("part_")))
    slice_ = F.when(F.col("to_c") > F.col("from_c"), F.struct("from_c", F.substring("part_", (F.col("from_c") - F.col("b_")).cast("int") + 1, (F.col("to_c") - F.col("from_c")).cast("int")).alias("s")))
    others = [c for c in own.columns if c not in key]
    joined = got.groupBy(*key).agg(F.array_sort(F.collect_list(slice_)).alias("l_"), *[F.first(c).alias(c) for c in others])
    text = F.decode(F.aggregate("l_", F.lit(b""), lambda a, x: F.concat(a, x["s"])), "ISO-8859-1")
    return joined.select(*ranges.columns, text.alias("text"))


def extract(
    index: SuffixIndex,
    queries: DataFrame,
    prefix_len: int | None = None,
    suffix_len: int | None = None,
    mode: str = "compat",
    max_query_len: int | None = None,
    with_text: bool = True,
) -> DataFrame:
    """Hits with their context.

    ``(query_num, query, rank, suffix, sequence_name, sequence_start, range_start,
    range_end, suffix_offset[, text])``. ``mode`` 'compat' holds the end against the
    absolute end of the sequence, as the established format does, so contexts of
    later sequences may run on; 'clamped' ends with the sequence.
    """
    return extracted(index, search(index, queries, max_query_len), prefix_len, suffix_len, mode, with_text)


def extracted(index: SuffixIndex, hits: DataFrame, prefix_len: int | None = None, suffix_len: int | None = None, mode: str = "compat", with_text: bool = True) -> DataFrame:
    """The same for hits that were found."""
    if mode not in ("compat", "clamped"):
        raise ValueError(f"mode: {mode}")
    seqs = index.sequences().select("seq_id", "seq_name", "seq_start", "seq_len", F.length("own").cast("bigint").alias("own_len"))
    hits = hits.join(seqs, "seq_id")
    seq_end = F.col("seq_start") + F.col("own_len")
    start, end, offset = context_bounds(F.col("seq_pos"), F.col("own_len"), seq_end, prefix_len, suffix_len, mode == "clamped")
    out = hits.select(
        "query_num", "query", "rank", F.col("pos").alias("suffix"), F.col("seq_name").alias("sequence_name"), F.col("seq_start").alias("sequence_start"),
        start.cast("bigint").alias("range_start"), end.cast("bigint").alias("range_end"), offset.cast("bigint").alias("suffix_offset"),
    )
    if not with_text:
        return out
    absolute = out.withColumn("from_abs", F.col("sequence_start") + F.col("range_start")).withColumn("to_abs", F.col("sequence_start") + F.col("range_end"))
    return text_ranges(index, absolute, "from_abs", "to_abs", ["query_num", "rank"]).drop("from_abs", "to_abs")


def search_literal(index: SuffixIndex, query: str) -> DataFrame:
    """Suffix rows of one query without a mask: a key range that Parquet's statistics prune by."""
    if index.options.mask:
        raise ValueError("a masked index needs search()")
    q = query.encode()[: index.options.max_query_len or None]
    n = index.key_len
    rows = index.suffixes(index.key_ranges([(q[:n], successor(q[:n]))]) if q else None)
    if len(q) <= n:
        return rows
    hits = rows.select("*", F.lit(0).alias("query_num"), F.lit(query).alias("query"), F.lit(q).alias("q"))
    return _verified(index, hits, rows.columns).select(rows.columns)


def common_prefixes(index: SuffixIndex, pairs: DataFrame, most: int) -> DataFrame:
    """Add ``lcp`` to rows of ``(a, b)``: how many symbols the joined text has in common from two positions, up to ``most``.

    Positions beyond the text have nothing in common with any.
    """
    end = lambda c: F.least(F.col(c) + most, F.lit(index.text_len))
    own = pairs.withColumn("a_end_", end("a")).withColumn("b_end_", end("b"))
    first = text_ranges(index, own, "a", "a_end_").withColumnRenamed("text", "a_text_")
    both = text_ranges(index, first, "b", "b_end_")
    lcp = common_prefix(F.encode("a_text_", "ISO-8859-1"), F.encode("text", "ISO-8859-1"), most)
    return both.select(*pairs.columns, lcp.alias("lcp"))
