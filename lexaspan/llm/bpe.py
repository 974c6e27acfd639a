"""Encoding with a public byte-level BPE tokenizer (problem 6).

A task gathers the distinct pre-tokens its block of texts adds, lays their bytes
out as one linked list and keeps an index from each pair to all its positions.
Active ranks are applied in ascending order, each to all its positions at once;
a merge puts the pairs it makes into the index.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from lexaspan.runtime import ship, spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
# Fixed value: the public pre-tokenizer pattern, with white space as Unicode's property.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
CHUNKS = r" ?\P{White_Space}+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
SPACES = frozenset(filter(regex.compile(r"\p{White_Space}").match, map(chr, range(0x3001))))


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files, by a rule: printable bytes stand for themselves, the rest follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class PairIndexEncoder:
    """Byte-pair encoding of many words at once through a pair occurrence index."""

    def __init__(self, path: str = VOCABULARY) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        letters = byte_letters()
        self.byte_id = [0] * 256
        for ch, b in letters.items():
            self.byte_id[b] = vocab[ch]
        self.rank: dict[int, int] = {}
        self.merged: list[tuple[int, int, int]] = []
        for merge in model["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            left, right = vocab[a], vocab[b]
            self.rank[left << 32 | right] = len(self.merged)
            self.merged.append((left, right, vocab[a + b]))

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as int32 bytes."""
        byte_id, rank, merged = self.byte_id, self.rank, self.merged
        sym: list[int] = []
        for w in words:
            sym += [byte_id[b] for b in w]
            sym.append(-1)  # parts the words
        n = len(sym)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        at: dict[int, list[int]] = {}
        for p in range(n - 1):
            a, b = sym[p], sym[p + 1]
            if a >= 0 <= b and (r := rank.get(a << 32 | b)) is not None:
                if r in at:
                    at[r].append(p)
                else:
                    at[r] = [p]
        active = list(at)
        heapify(active)
        while active:
            r = heappop(active)
            left, right, new = merged[r]
            places = at.pop(r)
            places.sort()
            for p in places:
                if sym[p] != left:
                    continue
                q = nxt[p]
                if sym[q] != right:
                    continue
                sym[p], sym[q] = new, -2
                after = nxt[q]
                nxt[p], prv[after] = after, p
                b = sym[after]
                if b >= 0 and (x := rank.get(new << 32 | b)) is not None:
                    if x in at:
                        at[x].append(p)
                    else:
                        at[x] = [p]
                        heappush(active, x)
                before = prv[p]
                if before >= 0 and (a := sym[before]) >= 0 and (x := rank.get(a << 32 | new)) is not None:
                    if x in at:
                        at[x].append(before)
                    else:
                        at[x] = [before]
                        heappush(active, x)
        out, start = [], 0
        for w in words:
            end = start + len(w)
            out.append(array("i", [s for s in sym[start:end] if s >= 0]).tobytes())
            start = end + 1
        return out


class TextEncoder:
    """Texts to ids, with what is known of words and chunks kept between blocks.

    A chunk is what lies between two places where the pattern always parts: right
    before a blank that has no white space on either side.
    """

    def __init__(self, path: str = VOCABULARY, keep: int = 150_000) -> None:
        self.bpe, self.keep = PairIndexEncoder(path), keep
        self.words: dict[str, bytes] = {}
        self.after_blank: dict[str, bytes | None] = {}
        self.chunks: dict[str, bytes] = {}
        self.split, self.part = regex.compile(PATTERN).findall, regex.compile(CHUNKS).findall

    def _learn(self, blank: set[str], chunks: set[str]) -> None:
        todo = [(self.after_blank, p, " " + p) for p in blank] + [(self.chunks, c, c) for c in chunks]
        parted = [self.split(c) for _, _, c in todo]
        new = list({w for ws in parted for w in ws if w not in self.words})
        for a in range(0, len(new), 20_000):
            some = new[a : a + 20_000]
            self.words.update(zip(some, self.bpe.encode([w.encode("utf-8", "surrogatepass") for w in some])))
        words = self.words
        for (table, key, _), ws in zip(todo, parted):
            table[key] = b"".join([words[w] for w in ws])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        for table in (self.words, self.after_blank, self.chunks):
            if len(table) > self.keep:
                table.clear()
        plain: dict[int, list[str]] = {}
        odd: dict[int, list[str]] = {}
        blank: set[str] = set()
        chunks: set[str] = set()
        for k, t in enumerate(texts):
            if not t:
                continue
            if "  " not in t:
                plain[k] = t.split(" ")
                blank.update(plain[k])
            else:
                odd[k] = self.part(t)
                chunks.update(odd[k])
        for p in blank - self.after_blank.keys():  # pieces that white space touches have no ids of their own
            if not p or p[0] in SPACES or p[-1] in SPACES:
                self.after_blank[p] = None
        for k in [k for k, ps in plain.items() if any(self.after_blank.get(p, b"") is None for p in ps)]:
            odd[k] = self.part(texts[k])
            chunks.update(odd[k])
            del plain[k]
        chunks.update(ps[0] for ps in plain.values())
        self._learn(blank - self.after_blank.keys(), chunks - self.chunks.keys())
        get_blank, get_chunk, none = self.after_blank.__getitem__, self.chunks.__getitem__, b""
        return [
            get_chunk(plain[k][0]) + none.join(map(get_blank, plain[k][1:])) if k in plain else none.join(map(get_chunk, odd[k])) if k in odd else none
            for k in range(len(texts))
        ]


_CODERS: dict[str, TextEncoder] = {}


def _coder(path: str) -> TextEncoder:
    """The coder of a vocabulary, made once in each worker process; the file is the executor's own or the one that was sent."""
    if path not in _CODERS:
        _CODERS[path] = TextEncoder(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)))
    return _CODERS[path]


def encode_texts(df: DataFrame, row_id: str, text: str, path: str = VOCABULARY, block_chars: int = 2_000_000) -> DataFrame:
    """``(row_id, ids)`` of each row: ids of the text exactly as stored, no special tokens.

    Null and empty texts give the empty list. A null or repeated id is kept as it
    is; other columns are ignored. ``path`` names the vocabulary file, which is sent
    to the executors.
    """
    ship(df.sparkSession)
    context = df.sparkSession.sparkContext
    if os.path.exists(path) and os.path.basename(path) not in map(os.path.basename, context.listFiles):
        context.addFile(path)
    schema = pa.schema([(row_id, pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path)
        for batch in batches:
            a = 0
            while a < batch.num_rows:
                texts, chars, b = [], 0, a
                while b < batch.num_rows and (b == a or chars < block_chars) and b - a < 2000:
                    texts.append(batch.column(1)[b].as_py())
                    chars += len(texts[-1] or "")
                    b += 1
                got = coder.encode(texts)
                offsets = np.zeros(len(got) + 1, np.int64)
                np.cumsum([len(g) // 4 for g in got], out=offsets[1:])
                values = pa.array(np.frombuffer(b"".join(got), np.int32))
                ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), ids], schema=schema)
                a = b

    return spread(df.selectExpr(f"CAST(`{row_id}` AS BIGINT) AS `{row_id}`", f"`{text}`")).mapInArrow(run, f"`{row_id}` bigint, ids array<int>")
