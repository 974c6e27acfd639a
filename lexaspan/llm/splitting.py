"""Splitting oversized sequences at natural boundaries (problem 2)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexaspan.runtime import ship

BREAKS = b"\n\r-"
DNA_GAPS = b"Nn"
PROTEIN_GAPS = b"Xx*"


def boundaries(seq: np.ndarray, is_dna: bool | None) -> tuple[np.ndarray, np.ndarray]:
    """Places right after each maximal run of break bytes, and the lengths of those runs."""
    table = np.zeros(256, bool)
    table[list(BREAKS + (DNA_GAPS if is_dna else PROTEIN_GAPS))] = True
    m = table[seq].astype(np.int8)
    edge = np.diff(m, prepend=0, append=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return end, end - begin


def pieces_last(length: int, ends: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Pieces as long as the limit allows, each cut at the last boundary inside it."""
    out, s = [], 0
    while length - s > limit:
        k = int(np.searchsorted(ends, s + limit, side="right")) - 1
        e = int(ends[k]) if k >= 0 and ends[k] > s + overlap else s + limit
        out.append((s, e))
        s = e - overlap
    out.append((s, length))
    return out


def pieces_balanced(length: int, ends: np.ndarray, runs: np.ndarray, limit: int, overlap: int, reach: float = 0.15) -> list[tuple[int, int]]:
    """Pieces of nearly equal length, each end snapped to the strongest boundary near its target; the fewest, or one more.

    After each cut the rest is shared out anew, so one boundary far from its target
    moves the targets behind it and nothing is planned twice. An end lies at most
    ``reach`` of a piece from its target, and never where the rest would need more
    pieces than planned. A boundary is stronger the longer its run; ties go to the one
    nearest the target, then the earlier. Where the fewest pieces leave ends without
    a boundary, one piece more is tried and kept if it leaves fewer of them.
    """
    room = limit - overlap
    slack, fewest = int(reach * room), max(1, -(-(length - overlap) // room))
    best, left = [(0, length)], None
    for total in (fewest, fewest + 1):
        if left is not None and (left == 0 or (length - overlap) // total <= slack):
            break
        out, s, hard = [], 0, 0
        for k in range(total - 1, 0, -1):
            target = s + overlap + (length - s - overlap) // (k + 1)
            low, high = max(s + overlap + 1, length - k * room, target - slack), min(s + limit, target + slack, length - 1)
            a, b = np.searchsorted(ends, [low, high + 1])
            if a < b:
                e = int(ends[min(range(a, b), key=lambda i: (-runs[i], abs(int(ends[i]) - target), ends[i]))])
            else:
                e, hard = max(target, low), hard + 1
            out.append((s, e))
            s = e - overlap
        out.append((s, length))
        if left is None or hard < left:
            best, left = out, hard
    return best


def split_sequences(
    files: DataFrame,
    limit: int = 1000,
    overlap: int = 60,
    placement: str = "last",
    with_bytes: bool = False,
) -> DataFrame:
    """Pieces of every sequence longer than ``limit`` bytes.

    ``files`` needs ``file_id, seq, start_positions, is_dna``; other columns are
    ignored. Rows: ``(file_id, seq_no, piece_no, piece_start, piece_end[, piece])``
    with offsets inside the sequence. ``placement``: 'balanced' plans equal
    pieces, the fewest or one more, and snaps their ends; 'last' fills each piece up to the last
    boundary within the limit.

    Null ``seq`` gives no piece. Null ``start_positions`` beside a sequence mean
    one sequence at 0, an empty list none; null elements and starts beyond the
    text give an empty sequence. Null ``is_dna`` counts as not DNA. A file given
    twice gives its pieces twice; callers that hold re-delivered files take
    distinct rows, which moves pieces, not sequences.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    if placement not in ("last", "balanced"):
        raise ValueError(f"placement: {placement}")
    ship(files.sparkSession)
    fields = [("file_id", pa.int64()), ("seq_no", pa.int64()), ("piece_no", pa.int64()), ("piece_start", pa.int64()), ("piece_end", pa.int64())]
    kind = "file_id bigint, seq_no bigint, piece_no bigint, piece_start bigint, piece_end bigint"
    if with_bytes:
        fields.append(("piece", pa.binary()))
        kind += ", piece binary"
    schema = pa.schema(fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            ids, dna, starts = (batch.column(c).to_pylist() for c in ("file_id", "is_dna", "start_positions"))
            texts = batch.column("seq")
            for k, file_id in enumerate(ids):
                if not texts[k].is_valid:
                    continue
                text = np.frombuffer(texts[k].as_buffer(), np.uint8)
                begins = [0] if starts[k] is None else [x if x is not None else len(text) for x in starts[k]]
                for j, b in enumerate(begins):
                    e = (begins[j + 1] if j + 1 < len(begins) else len(text)) - 1
                    if e - b <= limit:
                        continue
                    seq = text[b:e]
                    ends, runs = boundaries(seq, dna[k])
                    cut = pieces_last(len(seq), ends, limit, overlap) if placement == "last" else pieces_balanced(len(seq), ends, runs, limit, overlap)
                    rows += [(file_id, j, p, x, y, *([seq[x:y].tobytes()] if with_bytes else [])) for p, (x, y) in enumerate(cut)]
                if len(rows) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return files.filter(F.col("seq").isNotNull()).select("file_id", "is_dna", "start_positions", "seq").mapInArrow(run, kind)
