"""Long exact spans shared between records (problem 5).

Streaming every document past the automaton of every shard would be quadratic.
Documents are therefore routed to the shards that can match them: a stretch of
``span`` symbols always holds one sampled anchor (the least hashed k-mer of the
stretch), equal stretches hold equal anchors, so the reference shard of an anchor
needs the surroundings of that anchor alone. Anchors of one sequence only are
dropped first. Each shard builds a suffix automaton whose states know the first
and last sequence that holds their strings; its snippets are streamed past it for
matching statistics against strings of two or more sequences, and the stretches
of ``span`` or more symbols are kept and joined to maximal runs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexaspan.runtime import materialise, ship, spread

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_STEP = np.uint64(40503)  # odd: its multiples differ in their low bits


def sequence_bounds(length: int, starts: list[int | None] | None, ended: bool) -> list[tuple[int, int]]:
    """Begin and end of each sequence: up to the delimiter of the next, the last up to the final sentinel."""
    begins = [0] if starts is None else [length if s is None else s for s in starts]
    last = length - ended
    return [(b, (begins[j + 1] - 1) if j + 1 < len(begins) else last) for j, b in enumerate(begins)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _BASE
    return x ^ (x >> np.uint64(32))


def anchors(text: np.ndarray, bounds: list[tuple[int, int]], span: int, log_k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(seq_no, position, hash)`` of the least hashed k-mer of each stretch of ``span`` symbols, k = 2 ** log_k.

    Stretches lie within one of the ``bounds``, which must rise and not overlap.
    Among equal k-mers of a stretch the place is chosen by a permutation of the
    positions; they share their anchor, so any of them serves, and a run of one
    letter gives few places instead of all.
    """
    long = [(j, b, e) for j, (b, e) in enumerate(bounds) if e - b >= span]
    if not long:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    k = 1 << log_k
    h = text.astype(np.uint64) + np.uint64(1)
    power = int(_BASE)
    for i in range(log_k):
        half = 1 << i
        h = h[:-half] * np.uint64(power) + h[half:]
        power = power * power % 2**64
    h = _mixed(h)
    low = np.uint64(0xFFFF)
    order = (h & ~low) | (np.arange(len(h), dtype=np.uint64) * _STEP & low)
    w = span - k + 1
    least, reach = order, 1
    while reach < w:  # minima of windows twice as wide each time
        more = min(reach, w - reach)
        least = np.minimum(least[:-more], least[more:])
        reach += more
    number, begin, end = (np.array(x) for x in zip(*long))
    inside = np.zeros(len(least) + 1, np.int32)
    inside[begin] += 1
    inside[end - span + 1] -= 1
    # no two places of a window are equal, so its least place changes where its minimum does
    fresh = np.concatenate([[True], least[1:] != least[:-1]])
    fresh[begin] = True
    first = np.flatnonzero(fresh & (np.cumsum(inside[:-1]) > 0))
    at = np.unique(sliding_window_view(order, w)[first].argmin(axis=1) + first)
    owner = np.searchsorted(begin, at, side="right") - 1
    return number[owner], at - begin[owner], (h[at] & ~low).view(np.int64)


class SharedAutomaton:
    """Suffix automaton of snippets, each with the least and greatest record and sequence that hold it.

    ``who`` is (least record, greatest record, least sequence, greatest sequence); a
    string is shared if either pair differs.
    """

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        self.who: list[tuple | None] = [None]
        self.of_two: list[bool] = []

    def _state(self, length: int, link: int, nxt: dict) -> int:
        self.next.append(nxt)
        self.length.append(length)
        self.link.append(link)
        self.who.append(None)
        return len(self.length) - 1

    def _split(self, p: int, c, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = self._state(length[p] + 1, link[q], dict(nxt[q]))
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        link[q] = clone
        return clone

    def add(self, text, who: tuple) -> None:
        nxt, link, length = self.next, self.link, self.length
        v = 0
        for c in text:
            q = nxt[v].get(c)
            if q is not None:
                v = q if length[q] == length[v] + 1 else self._split(v, c, q)
            else:
                new = self._state(length[v] + 1, 0, {})
                p = v
                while p >= 0 and c not in nxt[p]:
                    nxt[p][c] = new
                    p = link[p]
                if p >= 0:
                    q = nxt[p][c]
                    link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
                v = new
            self._hold(v, who)

    def _hold(self, v: int, who: tuple) -> None:
        old = self.who[v]
        if old is None:
            self.who[v] = who
        elif old != who:
            self.who[v] = (min(old[0], who[0]), max(old[1], who[1]), min(old[2], who[2]), max(old[3], who[3]))

    def finish(self) -> None:
        """Tell each state what its longer states hold."""
        for v in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[v] > 0 and self.who[v] is not None:
                self._hold(self.link[v], self.who[v])
        self.of_two = [w is not None and (w[0] != w[1] or w[2] != w[3]) for w in self.who]

    def shared(self, text, span: int) -> list[tuple[int, int]]:
        """Maximal stretches of ``text`` covered by shared stretches of ``span`` symbols."""
        nxt, link, length, of_two = self.next, self.link, self.length, self.of_two
        out: list[tuple[int, int]] = []
        v = m = 0
        for i, c in enumerate(text):
            while v and ((q := nxt[v].get(c)) is None or not of_two[q]):
                v = link[v]
                m = length[v]
            q = nxt[v].get(c)
            if q is None or not of_two[q]:
                v = m = 0
                continue
            v, m = q, m + 1
            if m >= span:
                a, b = i + 1 - m, i + 1
                if out and a <= out[-1][1]:
                    out[-1] = (min(a, out[-1][0]), b)
                else:
                    out.append((a, b))
        return out


#: Places of a sequence whose stretches are looked at together; sequences are stored in pieces of so many.
PIECE = 1 << 16


def _pieces(texts: DataFrame, span: int, reach: int) -> DataFrame:
    """``(record, seq_no, left, begin, piece)``: each sequence of ``span`` symbols or more in pieces.

    The stretches that begin at ``begin`` and at the ``PIECE`` - 1 places behind it are
    the piece's own; ``piece`` begins at ``left`` and holds the surroundings of all their anchors.
    """
    schema = pa.schema([("record", pa.int64()), ("seq_no", pa.int64()), ("left", pa.int64()), ("begin", pa.int64()), ("piece", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                text, record = batch.column("text")[k].as_py(), batch.column("record")[k].as_py()
                for j, (b, e) in enumerate(sequence_bounds(len(text), batch.column("starts")[k].as_py(), text.endswith("$"))):
                    for s in range(0, e - b - span + 1, PIECE):
                        left = max(0, s - reach)
                        rows.append((record, j, left, s, text[b + left : min(e, b + s + PIECE + 2 * span)]))
                        size += len(rows[-1][-1])
                        if size > 1 << 22:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                            rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return texts.mapInArrow(run, "record bigint, seq_no bigint, left bigint, begin bigint, piece string")


def _anchor_rows(pieces: DataFrame, span: int, log_k: int) -> DataFrame:
    """``(anchor, record, seq_no, number, at)``: the anchors of all pieces, many pieces in one pass."""
    schema = pa.schema([(c, pa.int64()) for c in ("anchor", "record", "seq_no", "number", "at")])

    def look(rows: list[tuple]) -> pa.RecordBatch:
        flat = np.frombuffer("".join(r[5] for r in rows).encode("utf-32-le", "surrogatepass"), np.uint32)
        bounds, at = [], 0
        for _, _, _, left, begin, piece in rows:
            bounds.append((at + begin - left, at + min(len(piece), begin - left + PIECE + span - 1)))
            at += len(piece)
        which, place, h = anchors(flat, bounds, span, log_k)
        number, record, seq_no, begin = (np.array([r[c] for r in rows], np.int64)[which] for c in (0, 1, 2, 4))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (h, record, seq_no, number, begin + place)], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for row in zip(*(batch.column(c).to_pylist() for c in ("number", "record", "seq_no", "left", "begin", "piece"))):
                rows.append(row)
                size += len(row[5])
                if size > 1 << 21:
                    yield look(rows)
                    rows, size = [], 0
            if rows:
                yield look(rows)

    return pieces.mapInArrow(run, "anchor bigint, record bigint, seq_no bigint, number bigint, at bigint")


def _snippet_rows(placed: DataFrame, span: int, reach: int) -> DataFrame:
    """Surroundings of each place in ``places`` (at, anchor) of a piece."""
    schema = pa.schema([("anchor", pa.int64()), ("snippet", pa.string()), ("record", pa.int64()), ("seq_no", pa.int64()), ("begin", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for record, seq_no, left, piece, places in zip(*(batch.column(c).to_pylist() for c in ("record", "seq_no", "left", "piece", "places"))):
                for p in places:
                    s = max(0, p["at"] - reach)
                    rows.append((p["anchor"], piece[s - left : p["at"] + span - left], record, seq_no, s))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return placed.mapInArrow(run, "anchor bigint, snippet string, record bigint, seq_no bigint, begin bigint")


_WHO = ("r0", "r1", "s0", "s1")
_OF_TWO = "r0 <> r1 OR s0 <> s1"


def _who(of: DataFrame, stored: bool = False) -> list:
    """The least and greatest record and sequence of a group; they differ if it has two sequences."""
    return [f(c).alias(n) for f, c, n in zip((F.min, F.max, F.min, F.max), _WHO if stored else ("record", "record", "seq_no", "seq_no"), _WHO)]


def _shard_matches(distinct: DataFrame, span: int) -> DataFrame:
    """Shared stretches of each distinct snippet, one automaton an anchor.

    ``distinct``: anchor, snippet, its key and who holds it.
    """
    schema = pa.schema([("snippet_key", pa.binary()), ("a", pa.int64()), ("b", pa.int64())])

    def match(group: list[tuple]) -> list[tuple[bytes, int, int]]:
        if len(group) == 1:  # all states of one string hold what the string holds
            text, key, who = group[0]
            return [(key, 0, len(text))] if (who[0] != who[1] or who[2] != who[3]) and len(text) >= span else []
        machine = SharedAutomaton()
        for text, _, who in group:
            machine.add(text, who)
        machine.finish()
        return [(key, a, b) for text, key, _ in group for a, b in machine.shared(text, span)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, group, rows = None, [], []
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("anchor", "snippet", "snippet_key", *_WHO)]
            for h, text, key, *who in zip(*cols):
                if h != anchor:
                    rows += match(group) if group else []
                    anchor, group = h, []
                group.append((text, key, tuple(who)))
            if len(rows) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                rows = []
        rows += match(group) if group else []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return distinct.repartition("anchor").sortWithinPartitions("anchor").select("anchor", "snippet", "snippet_key", *_WHO).mapInArrow(run, "snippet_key binary, a bigint, b bigint")


def _window_matches(distinct: DataFrame, span: int, hot: int) -> DataFrame:
    """The same for anchors with too many distinct snippets for one automaton: all their
    stretches of ``span`` symbols, grouped as strings over the whole cluster."""
    windows = distinct.select(
        "snippet_key", "snippet", *_WHO,
        F.explode(F.sequence(F.lit(0).cast("bigint"), (F.char_length("snippet") - span).cast("bigint"))).alias("a"),
    ).select("snippet_key", *_WHO, "a", F.expr(f"substring(snippet, CAST(a AS INT) + 1, {span})").alias("window"))
    held = windows.groupBy("window").agg(*_who(windows, True), F.count(F.lit(1)).alias("n")).filter(_OF_TWO)
    held = materialise(held.select("window", "n"), "windows")
    most = max(hot, (held.agg(F.sum("n")).first()[0] or 0) // 2000)
    found = _hot_join(windows, held.select("window"), "window", held, most)
    return found.select("snippet_key", "a", (F.col("a") + span).alias("b"))


def _hot_join(rows: DataFrame, small: DataFrame, on: str, counts: DataFrame, most: int) -> DataFrame:
    """``rows`` joined with ``small`` on one column, keys of more than ``most`` rows by broadcast.

    ``counts`` is (on, n); at most total / most keys are hot.
    """
    hot = counts.filter(F.col("n") > most).select(on)
    few = small.join(F.broadcast(hot), on, "left_semi")
    a = rows.join(F.broadcast(few), on)
    b = rows.join(F.broadcast(hot), on, "left_anti").join(small, on)
    return a.unionByName(b)


def shared_spans(
    indexes: DataFrame,
    record: str = "index_id",
    text: str = "text",
    starts: str = "sequence_starts",
    span: int = 48,
    group_limit: int = 500,
    hot: int = 50_000,
) -> DataFrame:
    """Maximal runs of shared symbols: ``(record, seq_no, span_start, span_end)``.

    A symbol is shared if a stretch of ``span`` symbols around it also occurs in
    another sequence, that is another (record, seq_no). Rows that share ``record``
    are deliveries of one record. Null texts and null ids hold nothing; a null
    ``starts`` means one sequence at 0; sequences shorter than ``span`` share
    nothing; an empty table gives an empty result; other columns are ignored.

    ``group_limit``: anchors with more distinct snippets are matched window by
    window instead of in one automaton, with the same result. ``hot``: keys with
    more rows than this and than one in 2,000 are joined by broadcast (2,000 keys
    at most).
    """
    if span < 4:
        raise ValueError("span must be at least 4")
    ship(indexes.sparkSession)
    log_k = min(4, max(1, (span // 3).bit_length() - 1))
    reach = span - (1 << log_k)
    own = indexes.select(F.col(record).cast("bigint").alias("record"), F.col(text).alias("text"), F.col(starts).alias("starts")).filter("text IS NOT NULL AND record IS NOT NULL")
    cut = spread(own).transform(_pieces, span, reach).withColumn("number", F.monotonically_increasing_id())
    pieces = materialise(cut, "pieces")
    places = materialise(_anchor_rows(pieces, span, log_k), "anchors")
    by_anchor = materialise(places.groupBy("anchor").agg(*_who(places), F.count(F.lit(1)).alias("n")).filter(_OF_TWO).select("anchor", "n"), "shared")
    most = max(hot, (by_anchor.agg(F.sum("n")).first()[0] or 0) // 2000)
    kept = _hot_join(places, by_anchor.select("anchor"), "anchor", by_anchor, most)
    lists = kept.groupBy("number").agg(F.collect_list(F.struct("at", "anchor")).alias("places"))  # of one piece at most
    snippets = _snippet_rows(pieces.join(lists, "number"), span, reach)
    key = F.unhex(F.md5(F.concat_ws("|", F.col("anchor").cast("string"), "snippet").cast("binary")))
    snippets = materialise(snippets.filter(F.char_length("snippet") >= span).withColumn("snippet_key", key), "snippets")
    distinct = materialise(snippets.groupBy("anchor", "snippet_key", "snippet").agg(*_who(snippets), F.count(F.lit(1)).alias("n")), "distinct")
    wide = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter(F.col("kinds") > group_limit).select("anchor")
    wide = materialise(wide, "wide")
    matches = _shard_matches(distinct.join(wide, "anchor", "left_anti"), span)
    if not wide.isEmpty():
        matches = matches.unionByName(_window_matches(distinct.join(wide, "anchor", "left_semi"), span, hot))
    matches = materialise(matches, "matches")
    counts = distinct.select("snippet_key", "n")
    most = max(hot, (counts.agg(F.sum("n")).first()[0] or 0) // 2000)
    found = _hot_join(snippets.select("snippet_key", "record", "seq_no", "begin"), matches, "snippet_key", counts, most)
    found = found.select("record", "seq_no", (F.col("begin") + F.col("a")).alias("a"), (F.col("begin") + F.col("b")).alias("b"))
    # joined within cells of a sequence first, so that a long one isn't one group
    near = _joined(found.withColumn("cell", F.shiftright("a", 20)), ["record", "seq_no", "cell"])
    return _joined(near, ["record", "seq_no"]).select(F.col("record").alias(record), "seq_no", F.col("a").alias("span_start"), F.col("b").alias("span_end"))


def _joined(runs: DataFrame, group: list[str]) -> DataFrame:
    """Runs [a, b) of each group, joined where they meet."""
    seq = Window.partitionBy(*group).orderBy("a", "b")
    reached = F.max("b").over(seq.rowsBetween(Window.unboundedPreceding, -1))
    marked = runs.withColumn("new", F.when(reached >= F.col("a"), 0).otherwise(1)).withColumn("run", F.sum("new").over(seq))
    return marked.groupBy(*group, "run").agg(F.min("a").alias("a"), F.max("b").alias("b"))


def shared_shares(indexes: DataFrame, spans: DataFrame, record: str = "index_id", text: str = "text", starts: str = "sequence_starts", names: str = "sequence_names") -> DataFrame:
    """For each sequence its length, its spans and the share of it that they cover.

    Rows: ``(record, seq_no, sequence_name, symbols, n_spans, covered, share)``; an
    empty sequence has share 0.
    """
    own = indexes.filter(F.col(text).isNotNull() & F.col(record).isNotNull()).select(
        record,
        F.coalesce(F.col(starts), F.array(F.lit(0).cast("bigint"))).alias("b"),
        F.col(names).alias("names"),
        F.char_length(text).cast("bigint").alias("n"),
        F.when(F.col(text).endswith("$"), 1).otherwise(0).alias("ended"),
    ).dropDuplicates([record])
    each = own.select(record, "b", "n", "names", "ended", F.posexplode("b").alias("seq_no", "begin")).select(
        record,
        F.col("seq_no").cast("bigint").alias("seq_no"),
        F.get("names", F.col("seq_no")).alias("sequence_name"),
        (F.coalesce(F.get("b", F.col("seq_no") + 1) - 1, F.col("n") - F.col("ended")) - F.col("begin")).alias("symbols"),
    )
    total = spans.groupBy(record, "seq_no").agg(F.count(F.lit(1)).alias("n_spans"), F.sum(F.col("span_end") - F.col("span_start")).alias("covered"))
    out = each.join(total, [record, "seq_no"], "left").fillna(0, ["n_spans", "covered"])
    return out.withColumn("share", F.when(F.col("symbols") > 0, F.round(F.col("covered") / F.col("symbols"), 6)).otherwise(F.lit(0.0)))
