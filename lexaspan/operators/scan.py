"""Answers about the suffixes of a corpus straight from its text, where an index of it would take more disk than there is.

Every task reads its sequences once. What leaves it is one number a bound or one row a hit.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexaspan.functions.symbols import DNA, successor
from lexaspan.operators.corpus import BuildOptions, suffix_rows, with_surroundings
from lexaspan.operators.search import _fits, _Patterns, effective_queries, match
from lexaspan.runtime import ship, shuffle_partitions, spread

#: Symbols that are looked at together.
CHUNK = 1 << 22
#: Symbols of the keys that are sorted here: two words of eight.
WIDTH = 16
#: Sequences that tell the bounds of key ranges, keys of a chunk of them, and symbols of the corpus that a range stands for.
SAMPLE, SAMPLE_KEYS, RANGE = 2_000, 4_096, 20_000_000


class _Pieces:
    """Texts cut into pieces, side by side; ``firsts`` are the places of each where a suffix begins."""

    def __init__(self) -> None:
        self.texts: list[np.ndarray] = []
        self.firsts: list[int] = []
        self.owners: list[object] = []
        self.offsets: list[int] = []

    def coded(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The symbols plus one, with ``WIDTH`` times 0 behind each piece; where suffixes begin; where pieces begin."""
        lengths = np.array([len(t) + WIDTH for t in self.texts])
        starts = np.cumsum(lengths) - lengths
        codes, begins = np.zeros(int(lengths.sum()), np.uint8), np.zeros(int(lengths.sum()), bool)
        for t, a, n in zip(self.texts, starts.tolist(), self.firsts):
            if len(t) and t.max() == 255:
                raise ValueError("symbol 255 isn't ordered here")
            codes[a : a + len(t)] = t + 1
            begins[a : a + n] = True
        return codes, begins, starts


def _chunks(batches: Iterable[pa.RecordBatch], reach: int, most: int) -> Iterator[_Pieces]:
    """Pieces of about ``most`` symbols of batches of (own, halo[, owner]); each holds what its last suffixes look at."""
    now, size = _Pieces(), 0
    for batch in batches:
        own, halos = batch.column(0), batch.column(1)
        owners = batch.column(2).to_pylist() if batch.num_columns > 2 else None
        for k, x in enumerate(own):
            text = np.frombuffer(x.as_buffer() or b"", np.uint8)
            halo = np.frombuffer(halos[k].as_buffer() or b"", np.uint8)
            n = len(text)
            for a in range(0, n, most):
                looked = text[a : a + most + reach]
                if len(looked) < most + reach and len(halo):
                    looked = np.concatenate([looked, halo[: max(0, a + most + reach - n)]])
                now.texts.append(looked)
                now.firsts.append(min(most, n - a))
                now.owners.append(owners[k] if owners else None)
                now.offsets.append(a)
                size += len(looked)
                if size >= most:
                    yield now
                    now, size = _Pieces(), 0
    if now.texts:
        yield now


def _words(codes: np.ndarray) -> np.ndarray:
    """For each place the eight codes from it on as one number, which orders as they do."""
    w = codes.astype(np.uint64)
    for s in (1, 2, 4):
        w[:-s] = (w[:-s] << np.uint64(8 * s)) | w[s:]
        w[-s:] <<= np.uint64(8 * s)
    return w


def _dna_begins(codes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    allowed = np.zeros(256, bool)
    allowed[[ord(c) + 1 for c in DNA]] = True
    return begins & allowed[codes]


def _below(codes: np.ndarray, begins: np.ndarray, bounds: list[bytes]) -> np.ndarray:
    """For each of some bounds how many suffixes are lower."""
    coded = [np.frombuffer(b, np.uint8) + np.uint8(1) for b in bounds]
    heads = np.array([int.from_bytes(c[:8].tobytes().ljust(8, b"\0"), "big") for c in coded], np.uint64)
    places = np.flatnonzero(begins)
    words = _words(codes)[places]
    each = np.unique(heads)
    slot = np.searchsorted(each, words, side="left")
    lower = np.concatenate([[0], np.cumsum(np.bincount(slot, minlength=len(each) + 1))])
    out = np.empty(len(bounds), np.int64)
    for i, (c, h) in enumerate(zip(coded, heads)):
        at, rest = places[words == h], c[8:]
        out[i] = lower[np.searchsorted(each, h) + 1] - len(at)  # of equal heads those are lower whose rest is
        for a in range(0, len(at) if len(rest) else 0, 65_536):
            some = at[a : a + 65_536]
            undecided = np.ones(len(some), bool)
            for o, r in enumerate(rest.tolist()):
                x = codes[np.minimum(some + 8 + o, len(codes) - 1)]
                out[i] += int((undecided & (x < r)).sum())
                undecided &= x == r
    return out


def ranks_in(seqs: DataFrame, queries: DataFrame, options: BuildOptions, max_query_len: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """``(query_num, query, rank_start, rank_end)`` as ``search.rank_ranges_of`` gives them, without an index.

    The first rank of a query is how many suffixes are lower, so it is counted and
    nothing is sorted. For bounded indexes without a mask, and for as many queries as
    can be sent to every task.
    """
    if options.mask or not options.max_query_len:
        raise ValueError("ranks of masked or whole suffixes need an index")
    own = effective_queries(queries, options, max_query_len)
    if not _fits(own):
        raise ValueError("so many queries need an index")
    ship(seqs.sparkSession)
    placed = with_surroundings(seqs, options)
    asked = sorted(bytes(r.q) for r in own.filter("q IS NOT NULL").select("q").distinct().collect())
    ends = {q: successor(q) for q in asked}
    bounds = sorted({b for q in asked for b in (q, ends[q]) if b})
    if any(255 in b for b in bounds):
        raise ValueError("symbol 255 isn't ordered here")
    reach, dna = options.reach, options.is_dna and not options.allow_ambiguity

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(bounds) + 1, np.int64)
        for pieces in _chunks(batches, reach, chunk):
            codes, begins, _ = pieces.coded()
            if dna:
                begins = _dna_begins(codes, begins)
            found[-1] += int(begins.sum())
            found[:-1] += _below(codes, begins, bounds)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(found)), pa.int64()), pa.array(found)], names=["i", "n"])

    totals = spread(placed.select("own", "halo")).mapInArrow(run, "i bigint, n bigint").groupBy("i").agg(F.sum("n").alias("n")).collect()
    below = {r.i: r.n for r in totals}
    at = {b: below.get(i, 0) for i, b in enumerate(bounds)}
    every = below.get(len(bounds), 0)
    rows = [(q, at[q] if q else 0, every if ends[q] is None else at[ends[q]]) for q in asked]
    table = seqs.sparkSession.createDataFrame([r for r in rows if r[1] < r[2]], "q binary, rank_start bigint, rank_end bigint")
    return own.join(F.broadcast(table), "q", "left").select("query_num", "query", "rank_start", "rank_end")


def locate_in(seqs: DataFrame, queries: DataFrame, options: BuildOptions, max_query_len: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """``(query_num, query, seq_id, seq_pos)`` of every suffix that starts with a query, without an index and without its rank."""
    own = effective_queries(queries, options, max_query_len)
    placed = with_surroundings(seqs, options)
    if not _fits(own):
        return match(suffix_rows(placed, options), own, ["seq_id", "seq_pos"]).drop("q")
    ship(seqs.sparkSession)
    asked = sorted(bytes(r.q) for r in own.filter("q IS NOT NULL").select("q").distinct().collect())
    some = [q for q in asked if q]
    reach, places = options.reach, options.mask.positions if options.mask else None
    dna = options.is_dna and not options.allow_ambiguity
    kind = dict(placed.dtypes)["seq_id"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = _Patterns(some, places)
        allowed = np.zeros(256, bool)
        allowed[list("".join(DNA).encode())] = True
        owner_type = None

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal owner_type
            for batch in batches:
                owner_type = batch.schema.field(2).type
                yield batch

        for pieces in _chunks(typed(), reach, chunk):
            text = np.concatenate(pieces.texts)
            ends = np.cumsum([len(t) for t in pieces.texts])
            starts = ends - [len(t) for t in pieces.texts]
            firsts, owners, offsets = starts + pieces.firsts, pa.array(pieces.owners, owner_type), np.array(pieces.offsets)

            def rows(q: bytes, at: np.ndarray) -> pa.RecordBatch:
                piece = np.searchsorted(ends, at, side="right")
                columns = [pa.repeat(pa.scalar(q, pa.binary()), len(at)), owners.take(pa.array(piece)), pa.array((at - starts[piece] + offsets[piece]).astype(np.int64))]
                return pa.RecordBatch.from_arrays(columns, names=["q", "seq_id", "seq_pos"])

            if asked and not asked[0]:
                for a, b in zip(starts.tolist(), firsts.tolist()):
                    every = np.arange(a, b)
                    yield rows(b"", every[allowed[text[every]]] if dna else every)
            if some:
                for i, at in patterns.hits(text, ends, firsts, allowed if dna else None):
                    if len(at):
                        yield rows(some[i], at)

    hits = spread(placed.select("own", "halo", "seq_id")).mapInArrow(run, f"q binary, seq_id {kind}, seq_pos bigint")
    return hits.join(F.broadcast(own), "q").select("query_num", "query", "seq_id", "seq_pos")


def _firsts(k0: np.ndarray, k1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of two words without those that came before, in no order.

    Found by sorting hashes; equal hashes count for nothing unless the keys are equal.
    A key may stay twice where the hash of another lies between.
    """
    n = len(k0)
    bits = np.uint64(max(n - 1, 1).bit_length())
    low = np.uint64((1 << int(bits)) - 1)
    h = (k0 * np.uint64(0x9E3779B97F4A7C15)) ^ (k1 * np.uint64(0xC2B2AE3D27D4EB4F))
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h &= ~low
    h |= np.arange(n, dtype=np.uint64)
    h.sort()
    at = (h & low).astype(np.int64)
    h >>= bits
    same = np.flatnonzero(h[1:] == h[:-1]) + 1
    a, b = at[same], at[same - 1]
    keep = np.ones(n, bool)
    keep[same[(k0[a] == k0[b]) & (k1[a] == k1[b])]] = False
    return k0[at[keep]], k1[at[keep]]


def _ordered(some: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The keys of several lots in order, hardly any of them twice."""
    k0, k1 = _firsts(*map(np.concatenate, zip(*some)))
    order = np.lexsort((k1, k0))
    return k0[order], k1[order]


def _chunk_keys(codes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a chunk's suffixes, hardly any of them twice."""
    words, places = _words(codes), np.flatnonzero(begins)
    return _firsts(words[places], words[places + 8])


def _symbols(k0: np.ndarray, k1: np.ndarray) -> np.ndarray:
    """A row of codes for each place of the keys."""
    return np.stack([k0, k1], axis=1).astype(">u8").view(np.uint8).reshape(-1, WIDTH).T


def _packed(k0: np.ndarray, k1: np.ndarray) -> bytes:
    return pa.Codec("zstd", compression_level=1).compress(np.ascontiguousarray(_symbols(k0, k1)).tobytes(), asbytes=True)


def _unpacked(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(pa.Codec("zstd").decompress(data, WIDTH * n, asbytes=True), np.uint8).reshape(WIDTH, n)
    words = np.ascontiguousarray(planes.T).view(">u8").astype(np.uint64)
    return words[:, 0].copy(), words[:, 1].copy()


def _new_prefixes(k0: np.ndarray, k1: np.ndarray) -> np.ndarray:
    """For 1 to ``WIDTH`` symbols how many different beginnings of that many symbols some keys in order have."""
    out, changed = np.zeros(WIDTH, np.int64), np.zeros(len(k0), bool)
    changed[:1] = True
    for k, row in enumerate(_symbols(k0, k1)):
        changed[1:] |= row[1:] != row[:-1]
        out[k] = (changed & (row > 0)).sum()
    return out


def _cuts(k0: np.ndarray, k1: np.ndarray, bounds: list[tuple[int, int]]) -> list[int]:
    """Where some keys in order are cut by bounds; a key on a bound lies behind it."""
    cuts = [0]
    for b0, b1 in bounds:
        a, b = np.searchsorted(k0, np.uint64(b0), "left"), np.searchsorted(k0, np.uint64(b0), "right")
        cuts.append(int(a + np.searchsorted(k1[a:b], np.uint64(b1), "left")))
    return [*cuts, len(k0)]


def _key_bounds(placed: DataFrame, reach: int, dna: bool, chunk: int) -> tuple[list[tuple[int, int]], int]:
    """Keys that part the distinct keys about evenly, and into how many shuffle partitions they may go. Only the balance of the ranges hangs on it."""
    share = min(1.0, SAMPLE / max(placed.count(), 1))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pieces in _chunks(batches, reach, chunk):
            codes, begins, _ = pieces.coded()
            k0, k1 = _chunk_keys(codes, _dna_begins(codes, begins) if dna else begins)
            some = slice(None, None, -(-len(k0) // SAMPLE_KEYS) or 1)
            n = np.zeros(len(k0[some]), np.int64)
            n[:1] = len(codes)
            yield pa.RecordBatch.from_arrays([pa.array(x[some].view(np.int64)) for x in (k0, k1)] + [pa.array(n)], names=["k0", "k1", "n"])

    rows = (placed.sample(share, 0) if share < 1 else placed).select("own", "halo").mapInArrow(run, "k0 bigint, k1 bigint, n bigint").collect()
    partitions = max(shuffle_partitions(placed.sparkSession), int(sum(r.n for r in rows) / share / RANGE / 4))
    keys = sorted({(r.k0 % 2**64, r.k1 % 2**64) for r in rows})
    each = max(len(keys) // (4 * partitions), 1)
    return keys[each::each], partitions


def lcp_counts_in(seqs: DataFrame, options: BuildOptions, chunk: int = CHUNK) -> DataFrame:
    """``(lcp, suffixes)``: how many suffixes have how many symbols in common with the one before, without an index.

    A suffix has fewer than k symbols in common with the one before where it is shorter
    than k, or the first in order with its first k. Both follow from the distinct keys:
    each task gives those of its sequences, packed by ranges of keys, and those of a
    range are merged. For keys of up to ``WIDTH`` symbols without a mask.
    """
    width = options.max_query_len
    if options.mask or not 0 < width <= WIDTH:
        raise ValueError(f"keys of more than {WIDTH} symbols and masked ones need an index")
    spark = seqs.sparkSession
    ship(spark)
    placed = with_surroundings(seqs, options)
    reach, dna = options.reach, options.is_dna and not options.allow_ambiguity
    bounds, partitions = _key_bounds(placed, reach, dna, chunk)

    def keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size, short = [], 0, np.zeros(WIDTH + 1, np.int64)
        for pieces in _chunks(batches, reach, chunk):
            codes, begins, _ = pieces.coded()
            if dna:
                begins = _dna_begins(codes, begins)
            for k in range(WIDTH):
                short[k] += int((begins[: len(begins) - k] & (codes[k:] == 0)).sum())
            short[WIDTH] += int(begins.sum())
            kept.append(_chunk_keys(codes, begins))
            size += len(kept[-1][0])
            if size > chunk and len(kept) > 1:
                kept = [_firsts(*map(np.concatenate, zip(*kept)))]
                size = len(kept[0][0]) // 2  # again only when as many have come
        out = [(-1, 0, short.tobytes())]
        if kept:
            k0, k1 = _ordered(kept)
            cuts = _cuts(k0, k1, bounds)
            out += [(p, b - a, (a, b)) for p, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
        for p, n, data in out:
            data = data if isinstance(data, bytes) else _packed(k0[data[0] : data[1]], k1[data[0] : data[1]])
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([n], pa.int64()), pa.array([data], pa.binary())], names=["p", "n", "data"])

    def merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(p: int, blocks: list[tuple[int, bytes]]) -> pa.RecordBatch:
            if p < 0:
                first, last, numbers = b"", b"", sum(np.frombuffer(d, np.int64) for _, d in blocks)
            else:
                k0, k1 = _ordered([_unpacked(d, n) for n, d in blocks])
                first, last = (_symbols(k0[[i]], k1[[i]]).tobytes() for i in (0, -1))
                numbers = _new_prefixes(k0, k1)
            columns = [pa.array([p], pa.int32()), pa.array([first], pa.binary()), pa.array([last], pa.binary()), pa.array([numbers.tolist()], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, names=["p", "first", "last", "numbers"])

        now, blocks = None, []
        for batch in batches:
            for p, n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if blocks and p != now:
                    yield told(now, blocks)
                    blocks = []
                now = p
                blocks.append((n, data.as_py()))
        if blocks:
            yield told(now, blocks)

    packed = spread(placed.select("own", "halo")).mapInArrow(keys, "p int, n bigint, data binary")
    ranges = packed.repartition(partitions, "p").sortWithinPartitions("p").mapInArrow(merged, "p int, first binary, last binary, numbers array<bigint>")
    rows = sorted(ranges.collect(), key=lambda r: r.p)  # one of each range
    fewer, every, before = np.zeros(WIDTH, np.int64), 0, None
    for r in rows:
        numbers = np.array(r.numbers)
        fewer += numbers[:WIDTH]
        if r.p < 0:
            every = int(numbers[WIDTH])
            continue
        for k in range(WIDTH if before is not None else 0):  # beginnings that go on from the range before
            if r.first[k] == 0 or r.first[k] != before[k]:
                break
            fewer[k] -= 1
        before = r.last
    below = [0, *fewer[:width].tolist(), every]
    return spark.createDataFrame([(k, n) for k in range(width + 1) if (n := below[k + 1] - below[k])], "lcp int, suffixes bigint")
