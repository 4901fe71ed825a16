"""Byte-level BPE by monoid tree reduction.

The elements are token sequences of byte strings, the operation joins the
sequences of two neighbours, the empty sequence is neutral. A byte string is
encoded by halving it down to short leaves and joining the halves.

Why a join is exact: call two tokens *stable* if merging their joined bytes alone
gives these two tokens again. A sequence is the encoding of its bytes if and only
if all neighbours in it are stable. (Run the merges over all bytes; until the
first merge that crosses a token's edge, what happens inside two neighbours is
what happens when they are merged alone, since the lowest rank of all pairs, the
leftmost on a tie, is the lowest of theirs too. A crossing merge would therefore
also occur in the pair alone, against its being stable. The converse is the same
argument read backwards.) So a join only has to look at its seam: it re-encodes a
window of boundary tokens and grows it on each side until the pair at that edge of
the window is stable; tokens outside can't change any more. Where the window grows to
the right only (a run of one character, whose remainder moves to the end), the tokens
it has made and whose pairs are stable are settled and left behind, so that a long
match costs its length times the depth of the tree, not its square.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes up to which a string is a leaf of the tree; entries at which the cache of matches, and those of their parts, start anew.
LEAF_BYTES, CACHE, PARTS = 8, 300_000, 100_000
#: Bytes up to which merging looks through all pairs each time; longer strings take a heap.
SHORT_BYTES = 48


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf_bytes: int = LEAF_BYTES):
        import regex

        self.ranks, self.leaf_bytes = ranks, max(1, leaf_bytes)
        self.find = regex.compile(pattern).findall
        self.token = {i: b for b, i in ranks.items()}
        self.text_of = {i: str(i) for i in self.token}
        self._stable: dict[tuple[bytes, bytes], bool] = {}
        self._merged: dict[bytes, list[bytes]] = {}
        self._windows: dict[bytes, list[bytes]] = {}
        self._pieces = _Pieces(self)

    @classmethod
    def from_file(cls, path: str, pattern: str, leaf_bytes: int = LEAF_BYTES) -> Bpe:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, f)))}
        return cls(ranks, pattern, leaf_bytes)

    def merge(self, data: bytes) -> list[bytes]:
        """Merges the pair of the lowest rank, leftmost first, until none has a rank."""
        if len(data) > SHORT_BYTES:
            return self._merge_long(data)
        parts = [data[i : i + 1] for i in range(len(data))]
        get = self.ranks.get
        pairs = [get(a + b, 1 << 60) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs:
            low = min(pairs)
            if low == 1 << 60:
                break
            i = pairs.index(low)
            parts[i] += parts.pop(i + 1)
            pairs.pop(i)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], 1 << 60)
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], 1 << 60)
        return parts

    def _merge_long(self, data: bytes) -> list[bytes]:
        """The same with a heap of pairs (by rank, then place) and ends of parts, for many bytes."""
        get, n = self.ranks.get, len(data)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := get(data[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            # a pair is as it was pushed if its first part still ends where the second began, and that one at stop
            middle = end[i]
            if middle < 0 or middle >= n or middle == stop or end[middle] != stop:
                continue
            end[i], end[middle] = stop, -1
            if stop < n:
                before[stop] = i
                if (rank := get(data[i : end[stop]])) is not None:
                    heappush(heap, (rank, i, end[stop]))
            if (first := before[i]) >= 0 and (rank := get(data[first:stop])) is not None:
                heappush(heap, (rank, first, stop))
        out, i = [], 0
        while i < n:
            out.append(data[i : end[i]])
            i = end[i]
        return out

    def merged(self, data: bytes) -> list[bytes]:
        """``merge`` with a cache of short strings; not to be changed by callers."""
        held, limit = (self._merged, PARTS) if len(data) <= 16 else (self._windows, PARTS // 16)
        if (known := held.get(data)) is None:
            known = self.merge(data)
            if len(data) <= 256:
                if len(held) >= limit:
                    held.clear()
                held[data] = known
        return known

    def stable(self, left: bytes, right: bytes) -> bool:
        key = (left, right)
        if (known := self._stable.get(key)) is None:
            if len(self._stable) >= PARTS:
                self._stable.clear()
            known = self._stable[key] = self.merged(left + right) == [left, right]
        return known

    def join(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        """The encoding of the bytes of both: a window at the seam grows until both of its edges are stable."""
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        settled, at = list(left), 0
        while settled and at < len(right) and not self.stable(settled[-1], right[at]):
            window, step = self.merged(settled.pop() + right[at]), 1
            at += 1
            while settled and not self.stable(settled[-1], window[0]):
                window = self.merged(b"".join(settled[-step:]) + b"".join(window))
                del settled[-step:]
                step *= 2
            settled += window
        return settled + right[at:]

    def reduce(self, data: bytes) -> list[bytes]:
        if len(data) <= self.leaf_bytes:
            return self.merged(data)
        half = len(data) // 2
        return self.join(self.reduce(data[:half]), self.reduce(data[half:]))

    def encode_piece(self, data: bytes) -> list[int]:
        """Ids of one match of the pattern; a match that is a token itself stays whole."""
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        return [self.ranks[t] for t in self.reduce(data)]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, each match of the pattern encoded separately."""
        return np.frombuffer(b"".join(map(self._pieces.__getitem__, self.find(text))), np.uint32)

    def decode(self, ids: list[int], leaf: int = 4096) -> bytes:
        """Bytes of the ids, concatenated up the tree from leaves of ``leaf`` ids."""
        get = self.token.__getitem__
        level = [b"".join(map(get, ids[i : i + leaf])) for i in range(0, len(ids), leaf)]
        while len(level) > 1:
            level = [b"".join(level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0] if level else b""


class _Pieces(dict):
    """Match -> its ids as bytes; starts anew at CACHE entries. Long matches aren't kept."""

    def __init__(self, bpe: Bpe):
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.bpe.encode_piece(piece.encode()), np.uint32).tobytes()
        if len(piece) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = ids
        return ids


_loaded: dict[tuple[str, str], Bpe] = {}


def loaded(path: str, pattern: str) -> Bpe:
    """One per Python worker and vocabulary."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Bpe.from_file(path, pattern)
    return _loaded[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, n_tokens, ids (array<int>) for every row of ``docs``; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [bpe.encode(x or "") for x in part.column(1).to_pylist()]
                ends = np.cumsum([0] + [len(x) for x in ids]).astype(np.int32)
                flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(ends).astype(np.int64)), lists], names=["key", "n_tokens", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, f"key {kind}, n_tokens long, ids array<int>").withColumnRenamed("key", key)


def decode_documents(encoded: DataFrame, path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """``key``, data (binary) for every row of an encoded table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                data = [bpe.decode(x or []) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(data, pa.binary())], names=["key", "data"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(encoded[key].alias("key"), "ids").mapInArrow(run, f"key {kind}, data binary").withColumnRenamed("key", key)


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Encodes every text and decodes its ids, in one pass: digests of both.

    Columns: ``key``, n_tokens, ids_sha256, decoded_sha256 and, with ``with_ids``,
    ids (array<int>). Rows are independent, so nothing is exchanged: a lost
    executor costs its running tasks only. A null text counts as empty; repeated
    rows give repeated rows; other columns of ``docs`` are ignored. A long match (a run
    of one character, say) takes time in proportion to its length and the tree's depth.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        named = bpe.text_of.__getitem__
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            counts, ids_sha, data_sha, arrays = [], [], [], []
            for value in batch.column(1):
                found = bpe.encode(value.as_py() or "")
                ids = found.tolist()
                if with_ids:
                    arrays.append(found)
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(named, ids)).encode()).hexdigest())
                data_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            cols = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(data_sha, pa.string())]
            if with_ids:
                ends = np.cumsum([0, *counts]).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*arrays, np.zeros(0, np.uint32)]).astype(np.int32))))
            yield pa.RecordBatch.from_arrays(cols, names=["key", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])])

    kind = docs.schema[key].dataType.simpleString()
    picked = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return picked.mapInArrow(run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")).withColumnRenamed("key", key)
