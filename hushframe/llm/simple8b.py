"""Token ids in word-aligned files: Simple-8b with escapes and block offsets.

A 64-bit word is a selector (its top 4 bits) and 60 bits that hold as many values
of one width as fit. Values of more than 60 bits take an escape: a word of selector
0 and then the plain value. Blocks of ``BLOCK`` values are packed on their own, and
a record lists the word at which each block starts, so any block can be unpacked
without those before it, and all of them at once by array operations.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Fixed values of the format: selector -> (values in a word, bits of each). 0 is the escape, 1 a run of zeros.
SELECTORS = ((1, 64), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
MAGIC, BLOCK = b"HS8B", 2048
#: magic, shard, documents, values, blocks, words
HEADER = struct.Struct("<4sIIQII")


def widths(values: np.ndarray) -> np.ndarray:
    """Bits of each value, 0 for 0."""
    if not len(values) or values.max() < 1 << 53:  # exact as floats
        return np.frexp(values.astype(np.float64))[1].astype(np.uint8)
    out = np.zeros(len(values), np.uint8)
    left = values.copy()
    for step in (32, 16, 8, 4, 2, 1):
        high = left >> np.uint64(step)
        big = high > 0
        out += (big * step).astype(np.uint8)
        left = np.where(big, high, left)
    return out + (left > 0).astype(np.uint8)


#: Zeros after each block, so that no word's values reach into the next one.
PAD = 128


def pack(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Words and the word at which each block starts (and, last, their number).

    Each word takes as many of the next values of its block as any selector can: the
    greatest width of a run is known for all places at once, longer runs from shorter.
    """
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    blocks = -(-n // block)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    room = block + PAD
    padded = np.zeros((blocks, room), np.uint64)
    full = n // block
    padded[:full, :block] = values[: full * block].reshape(full, block)
    if full < blocks:
        padded[full, : n - full * block] = values[full * block :]
    padded = padded.reshape(-1)
    most = {1: widths(padded)}

    def run(count: int) -> np.ndarray:
        if count not in most:
            part = max(c for c in most if c < count and 2 * c >= count) if any(2 * c >= count for c in most) else None
            half = most[part] if part else run(-(-count // 2))
            shift = count - (part or -(-count // 2))
            out = half.copy()
            np.maximum(half[:-shift], half[shift:], out=out[:-shift])
            most[count] = out
        return most[count]

    best = np.zeros(len(padded), np.uint8)
    for s in range(15, 0, -1):
        count, width = SELECTORS[s]
        np.copyto(best, np.uint8(s), where=run(count) <= width)
    counts = np.array([1, *(c for c, _ in SELECTORS[1:])])
    # all blocks step through their values together
    lane = np.arange(blocks) * room
    stops = lane + np.minimum(block, n - np.arange(blocks) * block)
    starts, owners = [], []
    live = np.arange(blocks)
    while len(live):
        here = lane[live]
        starts.append(here)
        owners.append(live)
        here = here + counts[best[here]]
        lane[live] = here
        live = live[here < stops[live]]
    start, owner = np.concatenate(starts), np.concatenate(owners)
    order = np.argsort(start, kind="stable")
    start, owner = start[order], owner[order]
    chosen = best[start]
    size = 1 + (chosen == 0).astype(np.int64)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    for s in range(16):
        mine = np.flatnonzero(chosen == s)
        if not len(mine):
            continue
        count, width = SELECTORS[s]
        at = start[mine]
        if s == 0:
            words[place[mine] + 1] = padded[at]
            continue
        word = np.full(len(mine), s << 60, np.uint64)
        if width:
            for k in range(count):
                word |= padded[at + k] << np.uint64(k * width)
        words[place[mine]] = word
    offsets = np.concatenate([np.searchsorted(owner, np.arange(blocks)), [len(owner)]])
    ends = np.concatenate([place, [len(words)]])
    return words, ends[offsets].astype(np.int64)


def unpack(words: np.ndarray, n: int, block: int = BLOCK, offsets: np.ndarray | None = None, first: int = 0, last: int | None = None) -> np.ndarray:
    """The n values, or with ``offsets`` those of the blocks from ``first`` up to ``last``."""
    blocks = -(-n // block)
    last = blocks if last is None else min(last, blocks)
    if offsets is not None:
        words = words[offsets[first] : offsets[last]]
        n = min(last * block, n) - first * block
        offsets = offsets[first : last + 1] - offsets[first]
    if n <= 0:
        return np.zeros(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    plain = np.zeros(len(words), bool)
    for i in np.flatnonzero(selector == 0):
        if not plain[i] and i + 1 < len(words):
            plain[i + 1] = True
    escape = (selector == 0) & ~plain
    counts = np.array([c for c, _ in SELECTORS])[selector]
    counts[escape], counts[plain] = 0, 1
    sizes = np.full(last - first, block, np.int64)
    sizes[-1] = n - block * (len(sizes) - 1)
    if offsets is None:
        starts = _block_starts(counts, sizes)
    else:
        starts = offsets[:-1]
    before = np.cumsum(counts) - counts
    owner = np.searchsorted(starts, np.arange(len(words)), side="right") - 1
    place = before - before[starts][owner] + owner * block
    stop = np.minimum((owner + 1) * block, n)
    out = np.zeros(n, np.uint64)
    out[place[plain]] = words[plain]
    for s in range(2, 16):
        mine = np.flatnonzero((selector == s) & ~plain)
        if not len(mine):
            continue
        count, width = SELECTORS[s]
        mask = np.uint64((1 << width) - 1)
        for k in range(count):
            to = place[mine] + k
            inside = to < stop[mine]
            out[to[inside]] = (words[mine][inside] >> np.uint64(k * width)) & mask
    return out


def _block_starts(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """First word of each block where no offsets are at hand: words are walked in order."""
    starts, word = [], 0
    for size in sizes:
        starts.append(word)
        got = 0
        while got < size:
            got += counts[word]
            word += 1
    return np.array(starts)


def record(shard: int, keys: list[int | None], lengths: np.ndarray, values: np.ndarray, block: int = BLOCK) -> bytes:
    """Header, keys (with a bitmap of nulls), lengths, block offsets, words; then a new line."""
    words, offsets = pack(values, block)
    null = np.array([k is None for k in keys], np.uint8)
    ids = np.array([k or 0 for k in keys], np.int64)
    head = HEADER.pack(MAGIC, shard, len(keys), len(values), len(offsets) - 1, len(words))
    return b"".join([head, null.tobytes(), ids.tobytes(), np.asarray(lengths, np.int64).tobytes(), offsets.astype(np.uint64).tobytes(), words.tobytes()])


def records(data: bytes) -> Iterator[tuple[int, list[int | None], np.ndarray, np.ndarray]]:
    """shard, keys, lengths, values of each record of a file."""
    at = 0
    while at + HEADER.size <= len(data):
        magic, shard, docs, values, blocks, words = HEADER.unpack_from(data, at)
        if magic != MAGIC:
            raise ValueError(f"no record at byte {at}")
        at += HEADER.size

        def take(kind: str, count: int, size: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(data, kind, count, at)
            at += count * size
            return got

        null, keys, lengths = take("u1", docs, 1), take("<i8", docs, 8), take("<i8", docs, 8)
        offsets, packed = take("<u8", blocks + 1, 8).astype(np.int64), take("<u8", words, 8)
        yield shard, [None if x else int(k) for k, x in zip(keys, null, strict=True)], lengths, unpack(packed, values, BLOCK, offsets)
        at += 1


#: How the tokenizer's own pre-tokenizer cuts lower-case text.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: Entries of a generation of a cache.
WORDS, PIECES_HELD = 450_000, 600_000
#: Shards at most; what null keys count as.
MOST_SHARDS, NULL_KEY = 1 << 16, -(1 << 63)


class Cache(dict):
    """Two generations: when the young one is full it becomes the old one, and what is used again returns."""

    limit = WORDS

    def __init__(self):
        self.old: dict = {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


def _byte_letters() -> dict[int, str]:
    """Byte -> the character by which the vocabulary writes it: printable ones as they are, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(others)}}


class PieceCache(Cache):
    """Lower-case piece -> its ids as bytes, by the library's model alone."""

    limit = PIECES_HELD

    def __init__(self, tokenizer, kind: str):
        super().__init__()
        self.merge, self.kind, self.letters = tokenizer.model.tokenize, kind, _byte_letters()

    def make(self, piece: str) -> bytes:
        if not piece.isascii() or not piece.isprintable():
            piece = piece.encode().decode("latin-1").translate(self.letters)
        return array(self.kind, [t.id for t in self.merge(piece)]).tobytes()


class WordCache(Cache):
    """Word (no white space) -> its ids as bytes, and texts of Latin-1 characters.

    Such a text is lower-cased and cut into pieces as the library would, and each piece
    that is new goes to the library's model once. Other texts are cut at spaces: a word
    that has a character above U+012F, where lower-casing and composing take more care,
    or that may have a special token, goes through the whole library.
    """

    def __init__(self, tokenizer):
        import regex

        super().__init__()
        #: ids of two bytes where the vocabulary allows it
        self.kind = "H" if tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.pieces, self.cut, self.encode = PieceCache(tokenizer, self.kind), regex.compile(PIECES).findall, tokenizer.encode
        # the same with the classes of Latin-1 written out, which is quicker
        letters, numbers, white = ("".join(re.escape(chr(c)) for c in range(256) if regex.match(name, chr(c))) for name in (r"\p{L}", r"\p{N}", r"\s"))
        self.cut_plain = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{white}{letters}{numbers}]+").findall

    def text(self, text: str) -> bytes:
        if "<|" not in text:
            try:
                text.isascii() or text.encode("latin-1")
                return b"".join(map(self.pieces.__getitem__, self.cut_plain(text.lower())))
            except UnicodeEncodeError:
                pass
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))

    def make(self, word: str) -> bytes:
        if (word.isascii() or max(word) < "\u0130") and "<|" not in word:
            return b"".join(map(self.pieces.__getitem__, self.cut(word.lower())))
        return array(self.kind, self.encode(word, add_special_tokens=False).ids).tobytes()


_tokenizers: dict[str, WordCache] = {}


def words_of(path: str) -> WordCache:
    if path not in _tokenizers:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers[path] = WordCache(Tokenizer.from_file(path))
    return _tokenizers[path]


def encode_texts(texts: list[str | None], path: str) -> tuple[str, list[bytes]]:
    """The kind of whole number (of array), and the ids of each text, for a tokenizer that lower-cases and drops white space.

    Such a tokenizer never looks across white space, so texts can be cut into pieces and
    each distinct piece goes to the library once per cache.
    """
    words = words_of(path)
    return words.kind, [words.text(x or "") for x in texts]


def bounds(docs: DataFrame, key: str, rows: int) -> list[int]:
    """Keys at which shards of about ``rows`` documents begin, in order; one for each shard but the first.

    There are at most MOST_SHARDS; beyond, shards grow with the table (a task streams
    its shard). A key that fills several shards is there as often. Null keys count as
    the least.
    """
    n, known = docs.agg(F.count(F.lit(1)), F.count(key)).first()
    shards = max(1, min(MOST_SHARDS, -(-n // rows)))
    nulls = int(shards * (n - known) // max(1, n))
    some = shards - nulls
    # probabilities are spaced so that the sketch's error stays below a quarter of a shard
    got = docs.stat.approxQuantile(key, [i / some for i in range(1, some)], 0.25 / some) if some > 1 else []
    return [NULL_KEY] * nulls + sorted(int(x) for x in got)


def shard_of(edges: np.ndarray, keys: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Shard of each key; of a key that fills several, by ``spread`` (from 0 to below 1)."""
    left, right = np.searchsorted(edges, keys, side="left"), np.searchsorted(edges, keys, side="right")
    return np.where(right > left, left + 1 + ((right - left) * spread).astype(np.int64), left).astype(np.int32)


def write_ids(docs: DataFrame, tokenizer: str, path: str, text: str = "text", key: str = "doc_id", end_id: int = 2, shard_rows: int = 4096, record_ids: int = 1 << 20) -> None:
    """Writes the ids of all texts, in ascending order of ``key``, as files in ``path``.

    Each text is encoded by the tokenizers library (no special tokens), ``end_id`` is
    appended. Documents are dealt by ranges of the key into shards, one file each;
    only the packed ids are exchanged. Within a key, repeated rows are ordered by a
    hash of their ids and by them, and fill several shards if they are many; a null
    key comes first, a null text is empty. Spark's own writer
    commits the files, so a retried task leaves no second copy.
    """
    edges = bounds(docs, key, shard_rows)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = np.array(edges, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                kind, ids = encode_texts(part.column(1).to_pylist(), tokenizer)
                size, end = kind.encode(), array(kind, [end_id]).tobytes()
                keys = part.column(0)
                order = np.array([xxhash.xxh3_64_intdigest(x) >> 1 for x in ids], np.int64)
                shard = shard_of(cuts, keys.fill_null(NULL_KEY).to_numpy(zero_copy_only=False), order / 2.0**63)
                yield pa.RecordBatch.from_arrays([pa.array(shard), keys, pa.array(order), pa.array([size + x + end for x in ids], pa.binary())], names=["shard", "key", "order", "ids"])

    def pack_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, parts, held, shard = [], [], 0, None

        def flush() -> pa.RecordBatch:
            values = np.concatenate([*parts, np.zeros(0, np.uint32)]).astype(np.uint64)
            data = record(shard, keys, np.array([len(x) for x in parts]), values)
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["data"])

        for batch in batches:
            for s, k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if keys and (s != shard or held >= record_ids):
                    yield flush()
                    keys, parts, held = [], [], 0
                shard = s
                keys.append(k)
                parts.append(np.frombuffer(ids, ids[:1].decode(), offset=1))
                held += len(parts[-1])
        if keys:
            yield flush()

    picked = docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text"))
    coded = picked.mapInArrow(encode, "shard int, key long, order long, ids binary")
    dealt = coded.repartitionById(len(edges) + 1, F.col("shard")).sortWithinPartitions("shard", "key", "order", "ids")
    packed = dealt.mapInArrow(pack_shard, "data binary")
    packed.select(F.col("data").cast("string").alias("value")).write.option("lineSep", "\n").text(path)


def read_ids(docs_session, path: str, digest: bool = False) -> DataFrame:
    """Documents of the files in ``path``: key, start, n_tokens, and ids or (digest) ids_crc32.

    start: ids of all documents before it. Files are decoded once, the shards'
    totals (one row a shard) give the starts.
    """
    spark = docs_session

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                place = 0
                for shard, keys, lengths, values in records(data.as_py()):
                    cuts = np.cumsum(np.concatenate([[0], lengths]))
                    flat = values.astype("<u4")
                    n = len(keys)
                    cols = [pa.array([shard] * n, pa.int32()), pa.array(place + cuts[:-1]), pa.array(keys, pa.int64()), pa.array(lengths)]
                    if digest:
                        cols.append(pa.array([zlib.crc32(flat[a:b].tobytes()) for a, b in zip(cuts, cuts[1:], strict=False)], pa.int64()))
                    else:
                        cols.append(pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(flat.astype(np.int64))))
                    place += int(cuts[-1])
                    yield pa.RecordBatch.from_arrays(cols, names=["shard", "place", "key", "n_tokens", "ids"])

    kind = "long" if digest else "array<long>"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    rows = common.written(files.mapInArrow(run, f"shard int, place long, key long, n_tokens long, ids {kind}"), "ids-read")
    # one row a shard, of which there are at most MOST_SHARDS
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    starts = F.broadcast(totals.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before")))
    out = rows.join(starts, "shard").select("key", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids")
    return out.withColumnRenamed("ids", "ids_crc32") if digest else out
