"""An index of bounded keys in packed blocks that is stored, checked and dropped one slice of its order after another.

For corpora whose whole index would take more disk than there is: at no time more than
one slice is stored. Every slice reads the text once. Suffixes of equal key are ordered by
(sequence, place) falling, which is the order of their positions in the text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexaspan.operators.corpus import BuildOptions
from lexaspan.operators.scan import WIDTH, _chunks, _dna_begins, _symbols
from lexaspan.runtime import remove_tree, scratch_path, ship, shuffle_partitions, spread

#: Slices of the order; what is on disk at once falls with them, and the text is read once for each.
SLICES = 5
#: Symbols that are looked at together, suffixes that a task packs together, suffixes of a range and of a stored block.
CHUNK, LOT, RANGE, BLOCK = 1 << 19, 1 << 20, 1 << 21, 1 << 20
#: Sequences that tell the bounds of ranges, at least; one of how many; and one of how many of their suffixes does.
SAMPLE, SAMPLE_OF, THIN = 2_000, 1_000, 32
#: Blocks are packed already, and a few of them fill a row group.
STORED = {"compression": "none", "parquet.enable.dictionary": "false", "parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1", "parquet.block.size": str(16 << 20)}
#: A place in the order: two words of the key, sequence, place in it.
Bound = tuple[int, int, int, int]
#: Shuffle files of a slice go with its query, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def recoded(column: pa.Array, table: np.ndarray) -> pa.Array:
    """Texts byte by byte as ``table`` has it; bytes that it takes to 255 go."""
    column = column.cast(pa.binary())
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = table[np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]]
    ends = ends - ends[0]
    if (table == 255).any():
        keep = data != 255
        ends, data = np.append(0, np.cumsum(keep, dtype=np.int32))[ends].astype(np.int32), data[keep]
    return pa.Array.from_buffers(pa.binary(), len(column), [None, pa.py_buffer(np.ascontiguousarray(ends)), pa.py_buffer(data)])


def _planes(*columns: np.ndarray) -> bytes:
    """Unsigned columns packed: the bytes of one weight together, as many weights as the greatest value has."""
    raw = []
    for c in columns:
        parts = np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.dtype.itemsize)
        weights = (int(c.max()).bit_length() + 7) // 8 if len(c) else 0
        raw += [bytes([weights]), *(parts[:, i].tobytes() for i in range(weights))]
    data = b"".join(raw)
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(data, asbytes=True)


def _columns(data: bytes, *kinds: tuple[type, int]) -> list[np.ndarray]:
    """What ``_planes`` packed; a type and a length for each column."""
    raw = np.frombuffer(pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True), np.uint8)
    out, a = [], 0
    for t, n in kinds:
        out.append(np.zeros(n, t))
        parts, weights, a = out[-1].view(np.uint8).reshape(n, np.dtype(t).itemsize), int(raw[a]), a + 1
        for i in range(weights):
            parts[:, i] = raw[a : a + n]
            a += n
    return out


def _spread_out(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers begin, begin + 1, ... of each of some runs."""
    before = np.cumsum(counts) - counts
    return np.repeat(begins - before, counts) + np.arange(int(counts.sum()))


def _dense(k: np.ndarray) -> np.ndarray:
    """For each value how many different ones are lower."""
    order = np.argsort(k)
    s = k[order]
    changed = np.zeros(len(k), np.uint64)
    changed[1:] = s[1:] != s[:-1]
    out = np.empty(len(k), np.uint64)
    out[order] = np.cumsum(changed)
    return out


def _order(k0: np.ndarray, k1: np.ndarray) -> np.ndarray:
    """``np.lexsort((k1, k0))``, by plain sorts of numbers."""
    bits = len(k0).bit_length()
    if 3 * bits > 64:
        return np.lexsort((k1, k0))
    b = np.uint64(bits)
    c = (((_dense(k0) << b) | _dense(k1)) << b) | np.arange(len(k0), dtype=np.uint64)
    c.sort()
    return (c & np.uint64((1 << bits) - 1)).astype(np.int64)


class _Lot:
    """Suffixes in order: keys ``k0``, ``k1`` of groups (a key may have two), ``counts`` of the groups, and for each suffix ``doc`` (number in ``ids``) and ``at``."""

    def __init__(self, k0: np.ndarray, k1: np.ndarray, owner: np.ndarray, at: np.ndarray, owners: np.ndarray) -> None:
        """``owner`` is a number in ``owners``; ``at`` rises within an owner's suffixes."""
        self.ids, number = np.unique(owners, return_inverse=True)
        if (np.diff(number) < 0).any():
            order = np.argsort(number[owner], kind="stable")
            k0, k1, owner, at = k0[order], k1[order], owner[order], at[order]
        n = len(k0)
        low = np.uint64((1 << max(n - 1, 1).bit_length()) - 1)
        h = (k0 * np.uint64(0x9E3779B97F4A7C15)) ^ (k1 * np.uint64(0xC2B2AE3D27D4EB4F))
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h = (h & ~low) | np.arange(n, dtype=np.uint64)[::-1]  # of equal hashes the last suffix comes first
        h.sort()
        order = n - 1 - (h & low).astype(np.int64)
        k0, k1 = k0[order], k1[order]
        changed = np.ones(n, bool)
        changed[1:] = (k0[1:] != k0[:-1]) | (k1[1:] != k1[:-1])
        first = np.flatnonzero(changed)
        counts = np.diff(np.append(first, n))
        k0, k1 = k0[first], k1[first]
        sorted_ = _order(k0, k1)
        self.k0, self.k1, self.counts = k0[sorted_], k1[sorted_], counts[sorted_]
        order = order[_spread_out(first[sorted_], self.counts)]
        self.doc, self.at = number[owner[order]].astype(np.uint32), at[order].astype(np.uint32)
        self.ends = np.cumsum(self.counts)

    def place(self, bound: Bound) -> int:
        """How many suffixes come before a place in the order."""
        b0, b1, seq, at = bound
        a, b = np.searchsorted(self.k0, np.uint64(b0), "left"), np.searchsorted(self.k0, np.uint64(b0), "right")
        a, b = a + np.searchsorted(self.k1[a:b], np.uint64(b1), "left"), a + np.searchsorted(self.k1[a:b], np.uint64(b1), "right")
        x, y = (int(self.ends[i - 1]) if i else 0 for i in (a, b))
        if x == y:
            return x
        doc, same = np.searchsorted(self.ids, seq, "left"), np.searchsorted(self.ids, seq, "right")
        d = self.doc[x:y]
        return x + int(((d >= same) | ((d >= doc) & (d < same) & (self.at[x:y] > at))).sum())

    def packed(self, x: int, y: int) -> tuple[int, int, int, bytes]:
        """(groups, suffixes, sequences, data) of the suffixes from ``x`` to ``y``."""
        a, b = int(np.searchsorted(self.ends, x, "right")), int(np.searchsorted(self.ends, y, "left")) + 1
        counts = np.minimum(self.ends[a:b], y) - np.maximum(self.ends[a:b] - self.counts[a:b], x)
        doc = self.doc[x:y]
        here = np.zeros(len(self.ids), bool)
        here[doc] = True
        local = (np.cumsum(here) - 1).astype(np.uint32)[doc]
        ids = self.ids[here]
        return b - a, y - x, len(ids), _planes(self.k0[a:b], self.k1[a:b], counts.astype(np.uint32), local, self.at[x:y], ids.view(np.uint64))


def _lots(batches: Iterable[pa.RecordBatch], options: BuildOptions, table: np.ndarray | None, low: int, high: int, chunk: int, most: int, seen: list[int]) -> Iterator[_Lot]:
    """The suffixes whose first word lies in [low, high], in lots; all suffixes are counted in ``seen``."""
    width, dna = options.max_query_len, options.is_dna and not options.allow_ambiguity
    masks = [np.uint64((2**64 - 1) << 8 * (8 - min(max(w, 0), 8)) & (2**64 - 1)) for w in (width, width - 8)]
    kept: list[tuple[np.ndarray, ...]] = []
    owners: list[int] = []
    size = 0

    def texts() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0) if table is None else recoded(batch.column(0), table)
            yield pa.RecordBatch.from_arrays([own, pa.array([b""] * len(own), pa.binary()), batch.column(1)], names=["own", "halo", "seq_id"])

    for pieces in _chunks(texts(), width, chunk):
        codes, begins, starts = pieces.coded()
        if dna:
            begins = _dna_begins(codes, begins)
        seen[0] += int(begins.sum())
        if low or high < 2**64 - 1:  # most are told by two symbols
            two = codes.astype(np.uint16)
            two[:-1] <<= np.uint16(8)
            two[:-1] |= codes[1:]
            begins &= (two >= np.uint16(low >> 48 if width > 1 else low >> 56 << 8)) & (two <= np.uint16(high >> 48 | (0 if width > 1 else 255)))
        places = np.flatnonzero(begins)
        words = np.ndarray(len(codes) - 7, ">u8", codes, strides=(1,))
        first = words[places].astype(np.uint64) & masks[0]
        inside = (first >= np.uint64(low)) & (first <= np.uint64(high))
        if not inside.all():
            places, first = places[inside], first[inside]
        counts = np.diff(np.append(np.searchsorted(places, starts), len(places)))
        at = places - np.repeat(starts - np.array(pieces.offsets), counts)
        owner = np.repeat(np.arange(len(owners), len(owners) + len(starts), dtype=np.int32), counts)
        kept.append((first, words[places + 8].astype(np.uint64) & masks[1], owner, at.astype(np.int32)))
        owners += pieces.owners
        size += len(places)
        if size >= most:
            yield _Lot(*map(np.concatenate, zip(*kept)), np.array(owners, np.int64))
            kept, owners, size = [], [], 0
    if size:
        yield _Lot(*map(np.concatenate, zip(*kept)), np.array(owners, np.int64))


def _batch(rows: list[tuple], kind: str) -> pa.RecordBatch:
    types = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    named = [c.split() for c in kind.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(zip(*rows), named)], names=[n for n, _ in named])


def _bounds(seqs: DataFrame, options: BuildOptions, table: np.ndarray | None, slices: int, chunk: int) -> list[Bound]:
    """Places that part the order in even ranges, the same number in each slice. Only the balance hangs on the sample."""
    share = min(1.0, max(SAMPLE / max(seqs.count(), 1), 1 / SAMPLE_OF))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in _lots(batches, options, table, 0, 2**64 - 1, chunk, LOT, [0]):
            some = slice(None, None, THIN)
            columns = [np.repeat(lot.k0, lot.counts)[some], np.repeat(lot.k1, lot.counts)[some], lot.ids[lot.doc[some]].view(np.uint64), lot.at[some]]
            yield _batch([(len(lot.doc), len(columns[0]), _planes(*columns))], "n bigint, some bigint, data binary")

    rows = (seqs.sample(share, 0) if share < 1 else seqs).mapInArrow(run, "n bigint, some bigint, data binary").collect()
    if not rows:
        return []
    told = [_columns(bytes(r.data), (np.uint64, r.some), (np.uint64, r.some), (np.uint64, r.some), (np.uint32, r.some)) for r in rows]
    k0, k1, seq, at = map(np.concatenate, zip(*told))
    seq, at = seq.view(np.int64), at.astype(np.int64)
    order = np.lexsort((-at, ~seq, k1, k0))  # the last first of equal keys
    each = max(4 * shuffle_partitions(seqs.sparkSession), int(sum(r.n for r in rows) / share / RANGE / slices) + 1)
    picked = order[np.unique(np.arange(1, each * slices) * len(order) // (each * slices))]
    return list(zip(*(c[picked].tolist() for c in (k0, k1, seq, at))))


def _merged(blocks: list[tuple[int, int, int, bytes]]) -> tuple[np.ndarray, ...]:
    """Keys and counts of groups, each key once, and sequence and place of every suffix, in order."""
    parts = [_columns(data, (np.uint64, g), (np.uint64, g), (np.uint32, g), (np.uint32, n), (np.uint32, n), (np.uint64, d)) for g, n, d, data in blocks]
    k0, k1, counts = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = _order(k0, k1)
    k0, k1 = k0[order], k1[order]
    changed = np.ones(len(k0), bool)
    changed[1:] = (k0[1:] != k0[:-1]) | (k1[1:] != k1[:-1])
    group = np.empty(len(order), np.uint64)
    group[order] = (np.cumsum(changed) - 1).astype(np.uint64)
    k0, k1 = k0[changed], k1[changed]
    group = np.repeat(group, counts)
    own = [p[5].view(np.int64) for p in parts]
    ids = np.unique(np.concatenate(own))
    last = np.uint64(len(ids) - 1)
    doc = last - np.concatenate([np.searchsorted(ids, o).astype(np.uint64)[p[3]] for o, p in zip(own, parts)])
    at = np.concatenate([p[4] for p in parts]).astype(np.uint64)
    del parts
    most = at.max()
    at = most - at
    bits_at, bits_doc, bits_group = int(most).bit_length(), int(last).bit_length(), int(len(k0) - 1).bit_length()
    if bits_at + bits_doc + bits_group <= 64 and bits_at + bits_doc < 64:
        c = (((group << np.uint64(bits_doc)) | doc) << np.uint64(bits_at)) | at
        c.sort()
        at, c = c & np.uint64((1 << bits_at) - 1), c >> np.uint64(bits_at)
        doc, group = c & np.uint64((1 << bits_doc) - 1), c >> np.uint64(bits_doc)
    else:
        order = np.lexsort((at, doc, group))
        at, doc, group = at[order], doc[order], group[order]
    return k0, k1, np.bincount(group.astype(np.int64), minlength=len(k0)), ids[(last - doc).astype(np.int64)], (most - at).astype(np.int64)


def _shared(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> np.ndarray:
    """How many symbols two lots of keys have in common one by one."""
    out, on = np.zeros(len(a0), np.uint8), np.ones(len(a0), bool)
    for x, y in zip(_symbols(a0, a1), _symbols(b0, b1)):
        on &= (x == y) & (x > 0)
        out += on
    return out


BLOCKS = "p int, block int, groups bigint, n bigint, least bigint, data binary"
ENDS = "p int, block int, n bigint, bad bigint, f0 bigint, f1 bigint, first_seq bigint, first_at bigint, l0 bigint, l1 bigint, last_seq bigint, last_at bigint"


def _stored(p: int, blocks: list[tuple[int, int, int, bytes]]) -> Iterator[tuple]:
    """The suffixes of a range in order, packed in blocks: keys with their counts, and of each suffix its sequence, place and common prefix with the one before (0 where the range begins)."""
    k0, k1, counts, seq, at = _merged(blocks)
    blocks.clear()
    lcp = _shared(k0, k1, k0, k1)
    heads = np.cumsum(counts) - counts
    between = np.append(np.zeros(1, np.uint8), _shared(k0[1:], k1[1:], k0[:-1], k1[:-1]))
    lcp = np.repeat(lcp, counts)
    lcp[heads] = between
    ends = heads + counts
    for i, x in enumerate(range(0, len(seq), BLOCK)):
        y = min(x + BLOCK, len(seq))
        a, b = int(np.searchsorted(ends, x, "right")), int(np.searchsorted(ends, y, "left")) + 1
        some = np.minimum(ends[a:b], y) - np.maximum(heads[a:b], x)
        least = int(seq[x:y].min())
        data = _planes(k0[a:b], k1[a:b], some.astype(np.uint32), (seq[x:y] - least).view(np.uint64), at[x:y].astype(np.uint32), lcp[x:y])
        yield p, i, b - a, y - x, least, data


def block_rows(groups: int, n: int, least: int, data: bytes) -> tuple[np.ndarray, ...]:
    """The rows of a stored block: two words of the key, sequence, place, common prefix with the row before."""
    k0, k1, counts, seq, at, lcp = _columns(data, (np.uint64, groups), (np.uint64, groups), (np.uint32, groups), (np.uint64, n), (np.uint32, n), (np.uint8, n))
    return np.repeat(k0, counts), np.repeat(k1, counts), seq.view(np.int64) + least, at.astype(np.int64), lcp


def build_slice(seqs: DataFrame, options: BuildOptions, bounds: list[Bound], first: int, last: int, path: str, table: np.ndarray | None = None, chunk: int = CHUNK) -> int | None:
    """Store the suffixes from range ``first`` to before range ``last`` at ``path``; ``bounds`` part the ranges.

    A range is merged in one task. Gives how many suffixes the text has, of all ranges,
    where the slice is the first.
    """
    spark = seqs.sparkSession
    low, high = bounds[first - 1] if first else None, bounds[last - 1] if last <= len(bounds) else None
    inner = bounds[first : last - 1]
    edges = [low[0] if low else 0, high[0] if high else 2**64 - 1]
    kind = "p int, groups bigint, n bigint, docs bigint, data binary"

    def lots(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [0]
        for lot in _lots(batches, options, table, *edges, chunk, LOT, seen):
            cuts = [lot.place(low) if low else 0, *map(lot.place, inner), lot.place(high) if high else len(lot.doc)]
            for p, (x, y) in enumerate(zip(cuts, cuts[1:]), first):
                if x < y:
                    yield _batch([(p, *lot.packed(x, y))], kind)
        yield _batch([(-1, 0, seen[0], 0, b"")], kind)

    def merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks, total = None, [], 0
        for batch in batches:
            for p, g, n, d, data in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4)):
                if p < 0:
                    total += n
                    continue
                if blocks and p != now:
                    for row in _stored(now, blocks):
                        yield _batch([row], BLOCKS)
                    blocks = []
                now = p
                blocks.append((g, n, d, data.as_py()))
        if blocks:
            for row in _stored(now, blocks):
                yield _batch([row], BLOCKS)
        if total:
            yield _batch([(-1, 0, 0, total, 0, b"")], BLOCKS)

    packed = spread(seqs).mapInArrow(lots, kind)
    partitions = max(shuffle_partitions(spark), (last - first) // 4)
    packed.repartition(partitions, "p").sortWithinPartitions("p").mapInArrow(merged, BLOCKS).write.options(**STORED).parquet(path)
    return spark.read.parquet(path).filter("p < 0").agg(F.sum("n")).first()[0] if not first else None


def slice_ends(blocks: DataFrame) -> list:
    """A row for each stored block, in order: neighbours in it that are out of order or whose common prefix is wrong, and its first and last suffix."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, block, groups, n, least, data in zip(*(batch.column(i).to_pylist() for i in range(5)), batch.column(5)):
                k0, k1, seq, at, lcp = block_rows(groups, n, least, data.as_py())
                a0, a1, b0, b1 = k0[:-1], k1[:-1], k0[1:], k1[1:]
                same = (a0 == b0) & (a1 == b1)
                right = (a0 < b0) | ((a0 == b0) & (a1 < b1)) | (same & ((seq[:-1] > seq[1:]) | ((seq[:-1] == seq[1:]) & (at[:-1] > at[1:]))))
                common = np.full(n, WIDTH, np.uint8)[1:]  # equal keys have all symbols of the key in common
                some = np.flatnonzero(~same | (b1 & np.uint64(255) == 0))
                common[some] = _shared(a0[some], a1[some], b0[some], b1[some])
                right &= lcp[1:] == common
                ends = [int(c.view(np.int64)[i]) for i in (0, -1) for c in (k0, k1, seq, at)]
                yield _batch([(p, block, n, int((~right).sum()), *ends)], ENDS)

    rows = blocks.filter("p >= 0").mapInArrow(run, ENDS).collect()  # one of each block
    return sorted(rows, key=lambda r: (r.p, r.block))


def violations_between(ends: list, before: tuple | None) -> tuple[int, tuple | None]:
    """How many blocks don't come behind the block before them, and the last suffix of all."""
    bad = 0
    for r in ends:
        first = (r.f0 % 2**64, r.f1 % 2**64, -r.first_seq, -r.first_at)
        bad += before is not None and first <= before
        before = (r.l0 % 2**64, r.l1 % 2**64, -r.last_seq, -r.last_at)
    return bad, before


def violations(seqs: DataFrame, options: BuildOptions, table: np.ndarray | None = None, slices: int | None = None, chunk: int = CHUNK) -> int:
    """Store the index of ``(bytes, seq_id)`` slice by slice and count what is wrong in it: none in a sound index.

    Every stored suffix is held against the one before, across blocks, ranges and slices
    too: by key, then sequence and place, and within a range by their stored common prefix.
    Suffixes of the text that the slices lack, or have too many, count as well. Ids must be
    unique; ``table`` gives the symbol of each byte (see ``recoded``). For keys of up to
    ``WIDTH`` symbols in scope 'sequence' without a mask.
    """
    if options.mask or options.scope != "sequence" or not 0 < options.max_query_len <= WIDTH:
        raise ValueError(f"packed are keys of up to {WIDTH} symbols in scope 'sequence', without a mask")
    spark, slices = seqs.sparkSession, slices or SLICES
    ship(spark)
    own = seqs.select("bytes", F.coalesce("seq_id", F.lit(-(2**63))).alias("seq_id"))  # null ids come first
    bounds = _bounds(own, options, table, slices, chunk)
    ranges = len(bounds) + 1
    cuts = sorted({i * ranges // slices for i in range(slices + 1)})
    bad, rows, every, before = 0, 0, 0, None
    kept = spark.conf.get(CLEANUP, None)
    for first, last in zip(cuts, cuts[1:]):
        path = scratch_path(spark, "slice")
        try:
            spark.conf.set(CLEANUP, "true")
            total = build_slice(own, options, bounds, first, last, path, table, chunk)
            every = every if total is None else total
            ends = slice_ends(spark.read.parquet(path))
        finally:
            spark.conf.unset(CLEANUP) if kept is None else spark.conf.set(CLEANUP, kept)
            remove_tree(spark, path)
        across, before = violations_between(ends, before)
        bad += across + sum(r.bad for r in ends)
        rows += sum(r.n for r in ends)
    return bad + abs(every - rows)
