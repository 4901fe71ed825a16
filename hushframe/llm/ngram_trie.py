"""Language-model scoring with an n-gram trie in Elias-Fano form.

The model is a bigram model with a Dirichlet prior over the add-one unigram model:

    p(w | v) = (c(v w) + MU p(w)) / (c(v) + MU),    p(w) = (c(w) + 1) / (N + V + 1)

with c, N and V counted over all training texts, every text starting after a start
context and ending with an end token. It sums to one over the vocabulary and one
unknown word.

The trie is sharded by word, so it never has to fit one machine: a shard holds its
words with their quantised log terms, and below each context the words of the shard
that follow it. Words that are so frequent that they would swell a shard are sharded
by word and context instead; there are at most a few of them a shard, and their
counts are handed round. Texts are read in chunks; a chunk sends each shard the
distinct pairs it has, with their training counts, and keeps to itself in which
documents they are. The shard adds up the counts, builds its part of the trie and
answers each chunk with a code a pair and a count a word, in the order in which it was
asked; the chunk adds them up by document. What goes round is thus in proportion to
the texts, however many shards there are. What depends on one word alone is added
where its count is, since the logarithm of the denominator is a sum over the context's
occurrences. A context is sent as 40 bits of its hash: below one word, which has far
fewer contexts than that, another one is hardly ever taken for it.
"""

from __future__ import annotations

import mmap
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ngram_join import Words, _mix

#: Weight of the prior, in words; tokens of a chunk; tokens a shard aims at; bits of a quantised value.
MU, CHUNK, PER_SHARD, BITS = 300.0, 1 << 21, 1 << 21, 16
#: A word is frequent if it has more than 1/(FREQUENT x shards) of all tokens.
FREQUENT = 4
START, END = 1, 2
#: Bytes of a context's hash that are sent.
SENT = 5
_words = Words()


class EliasFano:
    """A monotone sequence of whole numbers: low bits as they are, high bits in unary.

    The arrays are views of the buffer they are given (a memory map, for instance).
    """

    HEAD = struct.Struct("<QQQ")

    def __init__(self, buffer, offset: int = 0):
        self.n, self.bits, self.high_bytes = self.HEAD.unpack_from(buffer, offset)
        offset += self.HEAD.size
        low = -(-self.n * self.bits // 64) + 1
        self.low = np.frombuffer(buffer, np.uint64, low, offset)
        offset += low * 8
        self.high = np.frombuffer(buffer, np.uint8, self.high_bytes, offset)
        offset += self.high_bytes
        samples = -(-self.high_bytes // 512) + 1
        self.ones = np.frombuffer(buffer, np.uint64, samples, offset)
        self.end = offset + samples * 8

    @classmethod
    def pack(cls, values: np.ndarray) -> bytes:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1) if n else 0
        low = np.zeros(-(-n * bits // 64) + 1, np.uint64)
        if n and bits:
            part = values & np.uint64((1 << bits) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + np.uint64(bits) > 64
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        where = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros((int(where[-1]) // 64 + 1) * 64 if n else 64, np.uint8)
        flags[where] = 1
        high = np.packbits(flags, bitorder="little")
        blocks = -(-len(high) // 512)
        counts = np.zeros(blocks + 1, np.uint64)
        counts[1:] = np.cumsum(np.add.reduceat(flags, np.arange(0, len(flags), 4096), dtype=np.uint64))
        return b"".join([cls.HEAD.pack(n, bits, len(high)), low.tobytes(), high.tobytes(), counts.tobytes()])

    def decode(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """The values from ``first`` up to ``last``; only the blocks that hold them are read."""
        last = self.n if last is None else min(last, self.n)
        if first >= last:
            return np.zeros(0, np.uint64)
        block = int(np.searchsorted(self.ones, first, side="right")) - 1
        stop = int(np.searchsorted(self.ones, last, side="left"))
        flags = np.unpackbits(self.high[block * 512 : stop * 512], bitorder="little")
        ones = np.flatnonzero(flags)[first - int(self.ones[block]) :][: last - first] + block * 4096
        index = np.arange(first, last)
        high = (ones - index).astype(np.uint64) << np.uint64(self.bits)
        if not self.bits:
            return high
        at = index.astype(np.uint64) * np.uint64(self.bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        part = self.low[word] >> shift
        over = shift + np.uint64(self.bits) > 64
        part[over] |= self.low[word[over] + 1] << (np.uint64(64) - shift[over])
        return high | (part & np.uint64((1 << self.bits) - 1))

    def __getitem__(self, i: int) -> int:
        return int(self.decode(i, i + 1)[0])

    def find(self, value: int, first: int, last: int) -> int:
        """Place of ``value`` among those from ``first`` up to ``last``, or -1."""
        while first < last:
            middle = (first + last) // 2
            if (here := self[middle]) == value:
                return middle
            first, last = (middle + 1, last) if here < value else (first, middle)
        return -1


class Codes:
    """Logarithms in BITS bits each, evenly spaced between the least and the greatest."""

    HEAD = struct.Struct("<Qdd")

    def __init__(self, buffer, offset: int = 0):
        self.n, self.least, self.step = self.HEAD.unpack_from(buffer, offset)
        self.codes = np.frombuffer(buffer, np.uint16, self.n, offset + self.HEAD.size)
        self.end = offset + self.HEAD.size + -(-self.n * 2 // 8) * 8

    @classmethod
    def pack(cls, values: np.ndarray) -> bytes:
        least, most = (float(values.min()), float(values.max())) if len(values) else (0.0, 0.0)
        step = (most - least) / ((1 << BITS) - 1) or 1.0
        data = np.round((values - least) / step).astype(np.uint16).tobytes()
        return cls.HEAD.pack(len(values), least, step) + data + b"\0" * (-len(data) % 8)

    def __getitem__(self, index) -> np.ndarray:
        return self.least + self.codes[index] * self.step


class Trie:
    """Two levels: words with their terms; below each context the words that follow it.

    Pointers say where a context's successors begin. A successor is its place (from
    1) in the shard's words, added to the last value of the context before, so that
    the whole level is monotone; a search is relative to that value.
    """

    PARTS = ("words", "lower", "contexts", "pointers", "successors", "upper")

    def __init__(self, buffer):
        at = 0
        for name in self.PARTS:
            part = (Codes if name in ("lower", "upper") else EliasFano)(buffer, at)
            setattr(self, name, part)
            at = part.end

    @classmethod
    def pack(cls, words: np.ndarray, lower: np.ndarray, word: np.ndarray, context: np.ndarray, upper: np.ndarray) -> bytes:
        """words sorted, lower their terms; pairs as places of words and contexts (hashes), with terms."""
        order = np.lexsort((word, context))
        word, context, upper = word[order], context[order], upper[order]
        contexts, start = np.unique(context, return_index=True)
        ends = np.append(start[1:], len(word)) if len(word) else start
        last = np.cumsum(word[ends - 1] + 1) if len(word) else np.zeros(0, np.int64)
        base = np.repeat(np.concatenate([[0], last[:-1]]), ends - start) if len(word) else np.zeros(0, np.int64)
        parts = [EliasFano.pack(words), Codes.pack(lower), EliasFano.pack(contexts), EliasFano.pack(np.append(start, len(word))), EliasFano.pack(base + word + 1), Codes.pack(upper)]
        return b"".join(parts)

    @classmethod
    def mapped(cls, data: bytes) -> Trie:
        """The levels in a memory map of their own."""
        buffer = mmap.mmap(-1, max(1, len(data)))
        buffer.write(data)
        return cls(memoryview(buffer))

    @classmethod
    def open(cls, path: str) -> Trie:
        """The levels of a file that ``pack`` made, mapped, not read."""
        return cls(memoryview(np.memmap(path, np.uint8, "r")))

    def look_up(self, context: int, word: int) -> int:
        """Place of a pair of hashes in the upper level, or -1."""
        w = self.words.find(word, 0, self.words.n)
        c = self.contexts.find(context, 0, self.contexts.n)
        if w < 0 or c < 0:
            return -1
        first, last = self.pointers[c], self.pointers[c + 1]
        return self.successors.find((self.successors[first - 1] if first else 0) + w + 1, first, last)

    def look_up_all(self, contexts: np.ndarray, word_places: np.ndarray, block: int = 1 << 15) -> np.ndarray:
        """The same for many pairs at once, whose words are given as places.

        The pairs are put in the order of the levels. Of these, ``block`` contexts at a
        time are decoded, and their successors, if a pair asks for one of them; never a
        whole level.
        """
        out = np.full(len(contexts), -1, np.int64)
        order = np.flatnonzero(word_places >= 0)
        order = order[np.argsort(contexts[order], kind="stable")]
        asked = contexts[order]
        for lo in range(0, self.contexts.n, block):
            level = self.contexts.decode(lo, lo + block)
            some = order[np.searchsorted(asked, level[0]) : np.searchsorted(asked, level[-1], side="right")]
            if not len(some):
                continue
            c = np.searchsorted(level, contexts[some])
            hit = level[np.minimum(c, len(level) - 1)] == contexts[some]
            some, c = some[hit], c[hit]
            pointer = self.pointers.decode(lo, lo + len(level) + 1).astype(np.int64)
            start = int(pointer[0])
            # a search is relative to the last value of the context before
            successor = np.concatenate([[self.successors[start - 1] if start else 0], self.successors.decode(start, int(pointer[-1])).astype(np.int64)])
            first, last = pointer[c] - start, pointer[c + 1] - start
            value = successor[first] + word_places[some] + 1
            place = np.minimum(np.searchsorted(successor[1:], value), len(successor) - 2)
            hit = (successor[place + 1] == value) & (place < last) & (place >= first)
            out[some[hit]] = place[hit] + start
        return out


def tokens(text: bytes) -> np.ndarray:
    """Hashes of the words, A-Z in lower case, and the end."""
    words = text.lower().split()
    return np.fromiter((*map(_words.__getitem__, words), END), np.uint64, len(words) + 1)


def _small(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as all need, after that number."""
    most = int(x.max()) if len(x) else 0
    size = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4
    return bytes([size]) + x.astype(f"<u{size}").tobytes()


def _bits(x: np.ndarray) -> bytes:
    """Whole numbers in as few bits each as all need, after that number and how many there are."""
    width = int(x.max()).bit_length() if len(x) else 0
    flags = np.empty((len(x), width), np.uint8)
    for k in range(width):
        flags[:, k] = (x >> k) & 1
    return struct.pack("<BQ", width, len(x)) + np.packbits(flags).tobytes()


def _unbits(data: bytes) -> np.ndarray:
    width, n = struct.unpack_from("<BQ", data)
    flags = np.unpackbits(np.frombuffer(data, np.uint8, offset=9), count=n * width).reshape(n, width)
    out = np.zeros(n, np.int64)
    for k in range(width):
        out |= flags[:, k].astype(np.int64) << k
    return out


def _cut(x: np.ndarray) -> bytes:
    """The low SENT bytes of hashes."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SENT]).tobytes()


def _uncut(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // SENT, 8), np.uint8)
    out[:, :SENT] = np.frombuffer(data, np.uint8).reshape(-1, SENT)
    return out.view("<u8").ravel().astype(np.uint64)


def _put(*parts: bytes) -> bytes:
    return b"".join(struct.pack("<I", len(p)) + p for p in parts)


def _get(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        (n,) = struct.unpack_from("<I", data, at)
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def _ints(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64) if data else np.zeros(0, np.int64)


def _chunks(batches: Iterator[pa.RecordBatch], size: int = CHUNK) -> Iterator[tuple[list, np.ndarray, list[np.ndarray]]]:
    """Keys, training flags and tokens of documents, about ``size`` tokens at a time."""
    keys, train, held, total = [], [], [], 0
    for batch in batches:
        for key, learned, text in zip(batch.column(0), batch.column(1), batch.column(2).cast(pa.binary()), strict=True):
            ids = tokens(text.as_py() or b"")
            keys.append(key.as_py())
            train.append(learned.as_py())
            held.append(ids)
            total += len(ids)
            if total >= size:
                yield keys, np.array(train, bool), held
                keys, train, held, total = [], [], [], 0
    if keys:
        yield keys, np.array(train, bool), held


def _vocabulary(shards: int):
    """Counts of the training tokens of a task, as a blob for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, train, held in _chunks(batches):
            mine = [h for h, t in zip(held, train, strict=True) if t]
            if not mine:
                continue
            words, counts = np.unique(np.concatenate(mine), return_counts=True)
            shard = (_mix(words) % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            cuts = np.searchsorted(shard[order], np.arange(shards + 1))
            some = [s for s in range(shards) if cuts[s] < cuts[s + 1]]
            blobs = [_put(words[order[cuts[s] : cuts[s + 1]]].tobytes(), _small(counts[order[cuts[s] : cuts[s + 1]]])) for s in some]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(blobs, pa.binary())], names=["shard", "blob"])

    return run


def _add_up(most: int):
    """Distinct words and tokens of a shard, and its most frequent words."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        parts = [_get(b) for b in frame["blob"]]
        words = np.concatenate([np.frombuffer(p[0], np.uint64) for p in parts])
        counts = np.concatenate([_ints(p[1]) for p in parts])
        distinct, place = np.unique(words, return_inverse=True)
        total = np.bincount(place, counts).astype(np.int64)
        top = np.argsort(-total, kind="stable")[:most]
        return pd.DataFrame({"distinct": [len(distinct)], "tokens": [int(total.sum())], "words": [distinct[top].view(np.int64).tolist()], "counts": [total[top].tolist()]})

    return run


def _pairs(shards: int, hot_words: np.ndarray, hot_counts: np.ndarray, mu: float):
    """For each chunk: a blob of pairs for each shard, and one of what the chunk knows itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId() << 24
        for number, (keys, train, held) in enumerate(_chunks(batches)):
            size = np.array([len(h) for h in held])
            token = np.concatenate(held)
            owner = np.repeat(np.arange(len(held)), size)
            context = np.empty_like(token)
            context[1:] = token[:-1]
            context[np.cumsum(size) - size] = START

            def of(x: np.ndarray) -> np.ndarray:
                at = np.minimum(np.searchsorted(hot_words, x), len(hot_words) - 1)
                return np.where(hot_words[at] == x, hot_counts[at], -1)

            frequent, above = of(token), of(context)
            docs = len(held)
            # what needs only counts of frequent words: their own, and those of contexts
            known = np.bincount(owner[frequent > 0], minlength=docs)
            base = np.bincount(owner, np.where(frequent >= 0, np.log10(np.maximum(frequent, 0) + 1.0), 0), docs)
            model = np.bincount(owner, np.where(above >= 0, -np.log10(np.maximum(above, 0) + mu), 0), docs)
            null = np.array([k is None for k in keys], np.uint8)
            ids = np.array([k or 0 for k in keys], np.int64)
            about = _put(null.tobytes(), ids.tobytes(), train.astype(np.uint8).tobytes(), size.astype(np.int64).tobytes(), known.astype(np.int64).tobytes(), base.tobytes(), model.tobytes())

            context &= np.uint64((1 << 8 * SENT) - 1)
            spread = np.where(frequent >= 0, _mix(token * np.uint64(0x9E3779B97F4A7C15) + context), _mix(token))
            shard = (spread % np.uint64(shards)).astype(np.int32)
            order = np.lexsort((context, token, shard))
            shard, token, context, owner, own = shard[order], token[order], context[order], owner[order], frequent[order] < 0
            learned = train[owner]
            other = np.ones(len(token), bool)
            other[1:] = (token[1:] != token[:-1]) | (shard[1:] != shard[:-1])
            new = other.copy()
            new[1:] |= context[1:] != context[:-1]
            first, word = np.flatnonzero(new), np.flatnonzero(other)
            many = np.diff(np.append(first, len(token)))
            runs = np.diff(np.append(np.searchsorted(first, word), len(first)))
            taught = np.add.reduceat(learned.astype(np.int64), first)
            asked, cut_pair, cut_word = np.unique(shard), np.searchsorted(shard[first], np.arange(shards + 1)), np.searchsorted(shard[word], np.arange(shards + 1))
            kept = _put(_small(many), _bits(owner), _small(runs), np.packbits(own[word]).tobytes(), asked.tobytes(), np.diff(cut_word)[asked].astype(np.int64).tobytes())
            chunk = task + number
            to, blobs = [int(chunk % shards)], [b"\1" + _put(about, kept)]
            for s in asked.tolist():
                pair, words = slice(cut_pair[s], cut_pair[s + 1]), slice(cut_word[s], cut_word[s + 1])
                blobs.append(b"\0" + _put(token[word[words]].tobytes(), _small(runs[words]), _cut(context[first[pair]]), _small(taught[pair])))
                to.append(s)
            for at in range(0, len(to), 64):
                part = slice(at, at + 64)
                yield pa.RecordBatch.from_arrays([pa.array(to[part], pa.int32()), pa.array([chunk] * len(to[part]), pa.int64()), pa.array(blobs[part], pa.binary())], names=["shard", "chunk", "blob"])

    return run


def _shard(total: int, distinct: int, hot_words: np.ndarray, hot_counts: np.ndarray, mu: float):
    """Builds a shard's trie from all chunks' pairs and answers each chunk."""
    floor = total + distinct + 1.0

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        chunks, answers, parts = [], [], []
        for chunk, blob in zip(frame["chunk"], frame["blob"], strict=True):
            if blob[0] == 1:
                chunks.append(chunk)
                answers.append(bytes(blob))
            else:
                parts.append((chunk, _get(blob[1:])))
        if parts:
            words = [np.frombuffer(p[0], np.uint64) for _, p in parts]
            vocabulary = np.unique(np.concatenate(words))
            place = np.concatenate([np.repeat(np.searchsorted(vocabulary, w), _ints(p[1])) for w, (_, p) in zip(words, parts, strict=True)])
            context = np.concatenate([_uncut(p[2]) for _, p in parts])
            taught = np.concatenate([_ints(p[3]) for _, p in parts])
            at = np.minimum(np.searchsorted(hot_words, vocabulary), len(hot_words) - 1)
            frequent = hot_words[at] == vocabulary
            count = np.where(frequent, hot_counts[at], np.bincount(place, taught, len(vocabulary)).astype(np.int64))
            seen = taught > 0
            order = np.flatnonzero(seen)[np.lexsort((place[seen], context[seen]))]
            new = np.ones(len(order), bool)
            new[1:] = (place[order][1:] != place[order][:-1]) | (context[order][1:] != context[order][:-1])
            first = order[new]
            pair_count = np.add.reduceat(taught[order], np.flatnonzero(new)) if len(order) else np.zeros(0, np.int64)
            prior = mu * (count + 1) / floor
            data = Trie.pack(vocabulary, np.log10(prior), place[first], context[first], np.log10(pair_count + prior[place[first]]))
            del order, first, new, taught, seen
            trie = Trie.mapped(data)
            found = trie.look_up_all(context, place)
            there = found >= 0
            code = trie.lower.codes[place]
            code[there] = trie.upper.codes[found[there]]
            scale = struct.pack("<idddd", frame["shard"].iloc[0], trie.lower.least, trie.lower.step, trie.upper.least, trie.upper.step)
            # of a frequent word the chunk has the count itself
            told = np.where(frequent, 0, count)
            start = 0
            for (chunk, p), w in zip(parts, words, strict=True):
                n = len(p[2]) // SENT
                here = slice(start, start + n)
                start += n
                chunks.append(chunk)
                answers.append(b"\0" + _put(scale, _small(told[np.searchsorted(vocabulary, w)]), np.packbits(there[here]).tobytes(), code[here].tobytes()))
        return pd.DataFrame({"chunk": chunks, "blob": answers})

    return run


def _collect(total: int, distinct: int, mu: float):
    """The documents of a chunk, from what it kept and the shards' answers."""
    width = np.log10(total + distinct + 1.0)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        about, kept = (_get(x) for x in next(_get(b[1:]) for b in frame["blob"] if b[0] == 1))
        null, ids, train = np.frombuffer(about[0], np.uint8), np.frombuffer(about[1], np.int64), np.frombuffer(about[2], np.uint8)
        size, known = np.frombuffer(about[3], np.int64), np.frombuffer(about[4], np.int64).copy()
        base, model = np.frombuffer(about[5]).copy(), np.frombuffer(about[6]).copy()
        many, owner, runs, asked, words = _ints(kept[0]), _unbits(kept[1]), _ints(kept[2]), np.frombuffer(kept[4], np.int32), np.frombuffer(kept[5], np.int64)
        own = np.unpackbits(np.frombuffer(kept[3], np.uint8), count=len(runs)).astype(bool)
        word, values = 0, [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0))]
        told = {struct.unpack_from("<i", a[0])[0]: a for a in (_get(b[1:]) for b in frame["blob"] if b[0] == 0)}
        # shard by shard, in the order in which they were asked
        for s, n in zip(asked.tolist(), words.tolist(), strict=True):
            scale, counts, there, codes = told.pop(s)
            _, low, low_step, high, high_step = struct.unpack("<idddd", scale)
            code = np.frombuffer(codes, np.uint16)
            each = runs[word : word + n]
            infrequent, count = np.repeat(own[word : word + n], each), np.repeat(_ints(counts), each)
            found = np.unpackbits(np.frombuffer(there, np.uint8), count=len(code)).astype(bool)
            # an infrequent word's own count also gives its part as the context of what follows
            term = np.where(found, high + code * high_step, low + code * low_step) - np.where(infrequent, np.log10(count + mu), 0)
            values.append(((infrequent & (count > 0)).astype(np.int64), np.where(infrequent, np.log10(count + 1.0), 0), term))
            word += n
        for sums, parts in zip((known, base, model), zip(*values, strict=True), strict=True):
            sums += np.bincount(owner, np.repeat(np.concatenate(parts), many), len(size)).astype(sums.dtype)
        keys = pd.array(np.where(null == 1, 0, ids), "Int64")
        keys[null == 1] = pd.NA
        return pd.DataFrame({"key": keys, "learned": train.astype(bool), "n_tokens": size, "n_known": known, "base_score": base - size * width, "score": model})

    return run


def score(docs: DataFrame, learn, key: str = "doc_id", text: str = "text", mu: float = MU) -> DataFrame:
    """key, learned, n_tokens, n_known, train_tokens, base_score, score for every row.

    ``learn``: column that is true for the rows to learn from (null counts as false).
    A null text is an empty one: its only token is the end. Words are told by 64-bit
    hashes. Repeated rows count, and are returned, each.
    """
    spark = docs.sparkSession
    picked = docs.select(docs[key].cast("long").alias("key"), F.coalesce(learn, F.lit(False)).alias("learned"), docs[text].alias("text"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = picked.filter("learned").mapInArrow(_vocabulary(partitions), "shard int, blob binary")
    summed = counted.groupBy("shard").applyInPandas(_add_up(64 * FREQUENT), "distinct long, tokens long, words array<long>, counts array<long>").collect()
    total, distinct = sum(r.tokens for r in summed), sum(r.distinct for r in summed)
    shards = max(partitions, -(-total // PER_SHARD))
    # at most FREQUENT x shards words can have so large a share
    hot = {w: c for r in summed for w, c in zip(r.words, r.counts, strict=True) if c * FREQUENT * shards > total}
    ends = next((c for r in summed for w, c in zip(r.words, r.counts, strict=True) if w == END), 0)
    hot |= {START: ends, END: ends}
    hot_words = np.array(list(hot), np.int64).view(np.uint64)
    order = np.argsort(hot_words)
    hot_words, hot_counts = hot_words[order], np.array(list(hot.values()), np.int64)[order]

    pairs = picked.mapInArrow(_pairs(shards, hot_words, hot_counts, mu), "shard int, chunk long, blob binary")
    answers = pairs.groupBy("shard").applyInPandas(_shard(total, distinct, hot_words, hot_counts, mu), "chunk long, blob binary")
    out = answers.groupBy("chunk").applyInPandas(_collect(total, distinct, mu), "key long, learned boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("key").alias(key), "learned", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
