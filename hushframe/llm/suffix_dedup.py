"""Removing passages that are there before: every byte covered by a run of LENGTH bytes that also begins earlier.

Suffixes are sorted bucket by bucket, and no task ever holds another bucket's.

A suffix counts if LENGTH bytes are left in its document. Its *anchor* is the least
hash among the ANCHOR-byte windows in these bytes, so suffixes that begin alike have
the same anchor. Neighbouring suffixes mostly share their anchor too: a *stretch* is a
longest run of them, and travels once, as one string of (suffixes + LENGTH - 1) bytes,
to the bucket of its anchor. A common window would draw all passages around it into
one bucket; a sketch of the windows' counts is made first, and common windows come
after all others in the order of hashes, so that they are the anchors of common text
alone, which is the same string again and again.

In a bucket, a stretch whose anchor occurs once, there too, holds no repeats. The others are
laid one after another. First the suffixes at places in a difference cover modulo
PERIOD are ranked to more than LENGTH bytes by doubling. Then one block of anchors
after another is sorted: by eight bytes, and where suffixes still tie, by the ranks
that both have after the same number of bytes, fewer than PERIOD, which the cover
provides for any two places. Ties may be as long as they like: comparing takes two
look-ups. Neighbours in the sorted order tell the classes of equal beginnings; all of
a class but its first member (by document, then place) begin earlier elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

LENGTH = 100
ANCHOR = 24
#: Differences of these three numbers give every remainder of 7.
PERIOD, COVER = 7, (0, 1, 3)
#: Bytes of text hashed at once, and gathered before stretches are sent.
SLICE, GATHER = 1 << 21, 1 << 25
#: Bytes of stretches meant for a bucket, and suffixes sorted at once.
BUCKET, BLOCK = 1 << 23, 1 << 18
#: Rows of stretches sent on at once.
ROWS = 32
#: Counters of the sketch of windows; those with more than this share of all windows are common.
SLOTS, COMMON = 1 << 22, 2.0**-18
#: Times that a task has to see a window to tell of it.
SEEN = 16
#: A stretch of random text has about half as many suffixes as windows, and LENGTH - 1 bytes more.
GROWTH = 2 * (LENGTH - 1) / (LENGTH - ANCHOR + 1) + 1
_ODD = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_TOP = np.uint64(1 << 63)
#: For two remainders, how far to go until both places are in the cover; and a place's number in it.
_STEP = np.array([next(d for d in range(PERIOD) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER) for a in range(PERIOD) for b in range(PERIOD)])
_NUMBER = np.array([COVER.index(r) if r in COVER else 0 for r in range(PERIOD)])


# ---------------------------------------------------------------- windows and stretches


def window_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ANCHOR (three times eight) bytes from each place of ``data`` on that has them."""
    n = len(data) - ANCHOR + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    words = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,)).astype(np.uint64)
    h = words[:n] * _ODD[0]
    h += words[8 : n + 8] * _ODD[1]
    h += words[16 : n + 16] * _ODD[2]
    h ^= h >> np.uint64(32)
    h *= _ODD[3]
    h ^= h >> np.uint64(29)
    return h


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring keys."""
    have = 1
    while 2 * have <= width:
        keys = np.minimum(keys[:-have], keys[have:])
        have *= 2
    return np.minimum(keys[: len(keys) - (width - have)], keys[width - have :]) if have < width else keys


def stretches(data: np.ndarray, ends: np.ndarray, common: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """First place, suffixes, anchor, two fingerprints of every stretch, and whether it may repeat itself; document i is ``data[ends[i]:ends[i + 1]]``.

    Where two suffixes of a stretch begin alike, d places apart, the text has period d
    from the first one on, so the first one's first least window lies less than d
    places from it: a suffix that begins with its anchor, and isn't the stretch's last.
    """
    n = len(data) - LENGTH + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64, np.uint64, bool))
    h = window_hashes(data)
    keys = h >> np.uint64(1)
    if common is not None:
        keys |= np.where(common[(h & np.uint64(SLOTS - 1)).astype(np.intp)], _TOP, np.uint64(0))
    anchor = _least(keys, LENGTH - ANCHOR + 1)
    a, b = ends[:-1], ends[1:]
    long = b - a >= LENGTH
    edge = np.zeros(n + 1, np.int8)
    edge[a[long]] += 1
    edge[b[long] - LENGTH + 1] -= 1
    counts = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    goes_on = np.zeros(n, bool)
    goes_on[1:] = counts[1:] & counts[:-1] & (anchor[1:] == anchor[:-1])
    first = np.flatnonzero(counts & ~goes_on)
    last = np.flatnonzero(counts & ~np.append(goes_on[1:], False))
    upto = last + LENGTH - ANCHOR + 1
    one = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h)])
    two = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * np.arange(len(h), dtype=np.uint64))])
    sums = one[upto] - one[first]
    leads = np.cumsum(keys[:n] == anchor)
    leads -= keys[:n] == anchor
    return first, last - first + 1, anchor[first], sums, two[upto] - two[first] - sums * first.astype(np.uint64), leads[last] > leads[first]


def _texts(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Documents' numbers, digests, ends and bytes, of whole documents, ``most`` bytes at once (a longer one alone)."""
    for batch in batches:
        text = pc.fill_null(batch.column(2), "")
        offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
        raw = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] is not None else np.zeros(0, np.uint8)
        number, digest = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        at = 0
        while at < len(text):
            to = max(int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1, at + 1)
            yield number[at:to], digest[at:to], offsets[at : to + 1] - offsets[at], raw[offsets[at] : offsets[to]]
            at = to


def _joined(intervals: tuple[np.ndarray, ...]) -> list[np.ndarray]:
    """Intervals (document, digest, start, end) with those that meet made one."""
    order = np.lexsort((intervals[2], intervals[1], intervals[0]))
    number, digest, start, end = (x[order] for x in intervals)
    apart = np.ones(len(start), bool)
    apart[1:] = (number[1:] != number[:-1]) | (digest[1:] != digest[:-1]) | (start[1:] != end[:-1])
    first = np.flatnonzero(apart)
    return [number[first], digest[first], start[first], end[np.append(first[1:], len(end))[: len(first)] - 1] if len(end) else end]


_CODEC = "zstd"
SENT = "bucket int, stretches int, known int, size int, head binary, body_size int, body binary"


def _row(bucket: int, made: list[np.ndarray], known: list[np.ndarray], text: list[bytes]) -> tuple:
    head = b"".join(x.tobytes() for x in (*made, *known))
    body = b"".join(text)
    pack = lambda raw: pa.compress(raw, codec=_CODEC, asbytes=True) if raw else b""
    return bucket, len(made[0]), len(known[0]), len(head), pack(head), len(body), pack(body)


#: What is told of a stretch (its suffixes below 0 if it may repeat itself), and of an interval whose suffixes are known to begin earlier.
_MADE, _KNOWN = (np.int64, np.int64, np.int64, np.int32, np.uint32), (np.int64,) * 4


def _unpacked(row: dict) -> tuple[list[np.ndarray], list[np.ndarray], bytes]:
    head = pa.decompress(row["head"], row["size"], codec=_CODEC, asbytes=True) if row["size"] else b""
    body = pa.decompress(row["body"], row["body_size"], codec=_CODEC, asbytes=True) if row["body_size"] else b""
    at, out = 0, []
    for n, kinds in ((row["stretches"], _MADE), (row["known"], _KNOWN)):
        made = []
        for k in kinds:
            made.append(np.frombuffer(head, k, n, at))
            at += made[-1].nbytes
        out.append(made)
    return out[0], out[1], body


def _sender(buckets: int, common: np.ndarray):
    """Texts to rows of stretches, one a bucket and GATHER bytes of text.

    Of equal stretches among these the first is sent; the others begin earlier, with
    all their suffixes. Equal ones are told by two fingerprints of 64 bits.
    """

    def flush(parts: list[tuple]) -> Iterator[tuple]:
        texts = b"".join(p[0].tobytes() for p in parts)
        offset = np.cumsum([0, *(len(p[0]) for p in parts)])[:-1]
        place = np.concatenate([p[1] + o for p, o in zip(parts, offset, strict=True)])
        number, digest, start, count, anchor, one, two, periodic = (np.concatenate([p[k] for p in parts]) for k in range(2, 10))
        order = np.lexsort((digest, start, number, two, one))
        same = np.zeros(len(order), bool)
        same[1:] = (one[order[1:]] == one[order[:-1]]) & (two[order[1:]] == two[order[:-1]]) & (count[order[1:]] == count[order[:-1]])
        lead = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
        known = np.zeros(len(order), bool)
        known[order] = (number[order] != number[lead]) | (start[order] != start[lead])
        again = np.zeros(len(order), bool)
        again[order[1:]] = same[1:] & (number[order[1:]] == number[order[:-1]]) & (start[order[1:]] == start[order[:-1]]) & (digest[order[1:]] == digest[order[:-1]])
        intervals = _joined((number[known], digest[known], start[known], start[known] + count[known]))
        home = intervals[0] % buckets
        bucket = (anchor % np.uint64(buckets)).astype(np.int64)
        sent = np.flatnonzero(~known & ~again)
        sent = sent[np.lexsort((start[sent], number[sent], bucket[sent]))]
        cut = np.searchsorted(bucket[sent], np.arange(buckets + 1))
        by_home = np.argsort(home, kind="stable")
        cut_home = np.searchsorted(home[by_home], np.arange(buckets + 1))
        short = ((anchor * _ODD[1]) >> np.uint64(32)).astype(np.uint32)
        for b in range(buckets):
            mine, old = sent[cut[b] : cut[b + 1]], by_home[cut_home[b] : cut_home[b + 1]]
            if len(mine) or len(old):
                made = [number[mine], digest[mine], start[mine], np.where(periodic[mine], -count[mine], count[mine]).astype(np.int32), short[mine]]
                begin, end = place[mine].tolist(), (place[mine] + count[mine] + LENGTH - 1).tolist()
                yield _row(b, made, [x[old] for x in intervals], [texts[x:y] for x, y in zip(begin, end, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for number, digest, ends, data in _texts(batches, SLICE):
            first, count, anchor, one, two, periodic = stretches(data, ends, common)
            doc = np.searchsorted(ends, first, "right") - 1
            parts.append((data.copy(), first, number[doc], digest[doc], first - ends[doc], count, anchor, one, two, periodic))
            held += len(data)
            if held >= GATHER:
                yield from _batches(flush(parts))
                parts, held = [], 0
        if parts:
            yield from _batches(flush(parts))

    return run


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, ROWS)):
        yield _batch(some)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary())
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in SENT.split(", ")])


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counters above half the common share of this task's windows, and (as counter -1) its bytes.

    What small tasks don't tell only makes buckets less even.
    """
    counts, size, windows = np.zeros(SLOTS, np.int64), 0, 0
    for _, _, _, data in _texts(batches, SLICE):
        h = window_hashes(data)
        counts += np.bincount((h & np.uint64(SLOTS - 1)).astype(np.intp), minlength=SLOTS)
        size, windows = size + len(data), windows + len(h)
    slot = np.flatnonzero(counts > max(windows * COMMON / 2, SEEN))
    yield pa.RecordBatch.from_arrays([pa.array(np.append(slot, -1), pa.int64()), pa.array(np.append(counts[slot], size), pa.int64())], names=["slot", "n"])


# ---------------------------------------------------------------- sorting a bucket


class Suffixes:
    """Suffixes of ``data``, compared by eight bytes, then by the ranks of the cover."""

    def __init__(self, data: bytes):
        self.size = len(data)
        padded = np.frombuffer(data + bytes(2 * LENGTH + 2 * PERIOD), np.uint8)
        self.words = np.ndarray((len(padded) - 7,), ">u8", padded, strides=(1,))
        self.rank = self._cover(len(data) // PERIOD + 1 + LENGTH // PERIOD)

    def eight(self, places: np.ndarray) -> np.ndarray:
        return self.words[places].astype(np.uint64)

    def _cover(self, periods: int) -> np.ndarray:
        """Ranks of the suffixes at the cover's places, by more than LENGTH bytes; equal beginnings have the same."""
        places = (np.arange(periods, dtype=np.int64)[:, None] * PERIOD + np.array(COVER)).ravel()
        first = self.eight(places)
        order = np.argsort(first)
        rank = np.empty(len(places), np.int64)
        tied = _renumber(rank, order, first[order], np.zeros(len(order), np.int64))
        depth, step = 8, 1
        while depth < LENGTH and len(tied):
            before = np.concatenate([rank, np.zeros(step * len(COVER), np.int64)])
            old = rank[tied]
            key = (old << 32) | before[tied + step * len(COVER)]
            order = np.argsort(key)
            tied = _renumber(rank, tied[order], key[order], old[order])
            depth, step = depth + step * PERIOD, 2 * step
        return rank

    def of_cover(self, places: np.ndarray) -> np.ndarray:
        return self.rank[places // PERIOD * len(COVER) + _NUMBER[places % PERIOD]]

    def sorted(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``places`` in the order of their suffixes, and which of them begin with the LENGTH bytes of the one before."""
        key = self.eight(places)
        order = np.argsort(key)
        out, key = places[order], key[order]
        like = np.zeros(len(out), bool)
        like[1:] = key[1:] == key[:-1]
        known = np.zeros(len(out), bool)
        group = np.flatnonzero(~like)
        size = np.diff(np.append(group, len(out)))
        group, size = group[size > 1], size[size > 1]
        while len(group):
            first = np.cumsum(size) - size
            start = np.repeat(group, size)
            slot = np.arange(len(start)) - np.repeat(first - group, size)
            x = out[slot]
            pivot = np.repeat(x[first + size // 2], size)
            step = _STEP[x % PERIOD * PERIOD + pivot % PERIOD]
            mine, its = self.of_cover(x + step), self.of_cover(pivot + step)
            low, even = mine < its, mine == its
            lows, evens = np.add.reduceat(low, first, dtype=np.int64), np.add.reduceat(even, first, dtype=np.int64)
            nth = lambda flag: (c := np.cumsum(flag)) - np.repeat(c[first] - flag[first], size) - 1
            to = start + np.where(low, nth(low), np.where(even, np.repeat(lows, size) + nth(even), np.repeat(lows + evens, size) + nth(~(low | even))))
            out[to] = x
            known[to[even]] = True
            known[group + lows] = False
            group, size = np.concatenate([group, group + lows + evens]), np.concatenate([lows, size - lows - evens])
            group, size = group[size > 1], size[size > 1]
        asked = np.flatnonzero(like & ~known)
        for at in (*range(8, LENGTH - 8, 8), LENGTH - 8):
            asked = asked[self.words[out[asked] + at] == self.words[out[asked - 1] + at]]
        known[asked] = True
        return out, known


def _renumber(rank: np.ndarray, items: np.ndarray, key: np.ndarray, old: np.ndarray) -> np.ndarray:
    """Ranks of sorted ``items``: that of their group plus how many of it are before; returns those that still tie.

    A group's rank is the number of items before it, so that groups are split without
    touching the others.
    """
    n = np.arange(len(items))
    new, other = np.ones(len(items), bool), np.ones(len(items), bool)
    new[1:], other[1:] = key[1:] != key[:-1], old[1:] != old[:-1]
    new |= other
    at = np.maximum.accumulate(np.where(new, n, 0))
    rank[items] = old + at - np.maximum.accumulate(np.where(other, n, 0))
    alone = new & np.append(new[1:], True)
    return items[~alone]


def _firsts(pieces: list[bytes], number: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each of some stretches the first one, by document and place, that has the same bytes."""
    seen: dict[bytes, int] = {}
    kind = np.array([seen.setdefault(p, len(seen)) for p in pieces], np.int64)
    order = np.lexsort((start, number, kind))
    lead = np.maximum.accumulate(np.where(np.diff(kind[order], prepend=-1) != 0, np.arange(len(order)), 0))
    first = np.empty(len(order), np.int64)
    first[order] = order[lead]
    return first


def later(made: list[np.ndarray], body: bytes) -> list[np.ndarray]:
    """Intervals (document, digest, start, end) of suffixes that begin earlier elsewhere, among a bucket's stretches."""
    number, digest, start, count, anchor = made
    periodic, count = count < 0, np.abs(count).astype(np.int64)
    offset = np.concatenate([[0], np.cumsum(count + LENGTH - 1)])
    pieces = [body[a:b] for a, b in zip(offset[:-1].tolist(), offset[1:].tolist(), strict=True)]
    # whole stretches that are there before need no sorting
    first = _firsts(pieces, number, start)
    again = (number != number[first]) | (start != start[first])
    found = [[number[again], digest[again], start[again], start[again] + count[again]]]
    one = np.flatnonzero(~again)
    _, at = np.unique(anchor[one], return_inverse=True)
    # rows of one id at the same place count as one
    distinct = np.bincount(at, first[one] == one)
    kept = one[(distinct[at] > 1) | periodic[one]]
    if not len(kept):
        return found[0]
    kept = kept[np.argsort(anchor[kept], kind="stable")]
    data = b"".join([pieces[k] for k in kept.tolist()])
    del pieces
    number, digest, start, anchor, count = number[kept], digest[kept], start[kept], anchor[kept], count[kept]
    offset = np.concatenate([[0], np.cumsum(count + LENGTH - 1)])
    suffixes = Suffixes(data)
    document = np.unique(number, return_inverse=True)[1].astype(np.int64)
    # blocks of whole anchors, of about BLOCK suffixes
    upto = np.cumsum(count)
    change = np.append(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, len(anchor))
    a = 0
    while a < len(anchor):
        past = upto[a - 1] if a else 0
        b = int(change[min(np.searchsorted(upto[change - 1], past + BLOCK), len(change) - 1)])
        n, base = count[a:b], offset[a]
        owner = np.repeat(np.arange(a, b, dtype=np.int32), n + LENGTH - 1)
        places = np.repeat(offset[a:b] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        order, like = suffixes.sorted(places)
        mine = owner[order - base]
        when = (document[mine] << 32) | (start[mine] + order - offset[mine])
        first = np.flatnonzero(~like)
        least = np.repeat(np.minimum.reduceat(when, first), np.diff(np.append(first, len(when))))
        flag = np.zeros(offset[b] - base + 1, np.int8)
        flag[order[when > least] - base] = 1
        edge = np.diff(flag, prepend=np.int8(0))
        begin, end = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
        mine = owner[begin]
        moved = start[mine] - offset[mine] + base
        found.append([number[mine], digest[mine], begin + moved, end + moved])
        a = b
    return [np.concatenate([f[k] for f in found]) for k in range(4)]


def _sorter(table: pa.Table) -> pa.Table:
    made, known, bodies = [], [], []
    for row in table.to_pylist():
        m, k, body = _unpacked(row)
        made.append(m)
        known.append(k)
        bodies.append(body)
    stretch = [np.concatenate([m[k] for m in made]) for k in range(len(_MADE))]
    found = later(stretch, b"".join(bodies))
    columns = [np.concatenate([f, *(k[i] for k in known)]) for i, f in enumerate(found)]
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("number", "digest", "start", "end"), _joined(tuple(columns)), strict=True)})


# ---------------------------------------------------------------- the operator


def _identity(key: Column, text: Column) -> list[Column]:
    """A document's place in the order of documents (null: last), and what tells rows of the same id apart."""
    return [F.coalesce(key.cast("long"), F.lit((1 << 63) - 1)).alias("number"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("digest")]


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """number, digest, start, end: intervals of places whose LENGTH bytes also begin earlier, written to the shared folder."""
    given = docs.select(*_identity(docs[key], docs[text]), docs[text].alias("t"))
    counted = written(given.mapInArrow(_counter, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")), "windows")
    # at most 2 / COMMON counters a task pass its own threshold, and 2 / COMMON of all this one
    size = F.max(F.when(F.col("slot") == -1, F.col("n")))
    total = counted.agg(size).first()[0] or 0
    hot = [r.slot for r in counted.filter((F.col("slot") >= 0) & (F.col("n") > total * COMMON)).collect()] if total else []
    common = np.zeros(SLOTS, bool)
    common[hot] = True
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    buckets = max(spread, int(total * GROWTH / BUCKET) + 1)
    sent = given.mapInArrow(_sender(buckets, common), SENT)
    found = sent.groupBy("bucket").applyInArrow(_sorter, "number long, digest long, start long, end long")
    return written(found, "repeats")


MADE = "n_bytes long, spans array<struct<start: long, end: long>>, kept binary"


def _cutter(fields: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(whole.column(fields)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < whole.num_rows:
                to = max(int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE, "right")), at + 1)
                yield cut(whole.slice(at, to - at))
                at = to

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        text = pc.fill_null(batch.column(fields), "")
        offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
        raw = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] is not None else np.zeros(0, np.uint8)
        data, begin = raw[offsets[0] : offsets[-1]], offsets - offsets[0]
        lists = batch.column(fields + 1)
        flat = lists.flatten()
        row = np.repeat(np.arange(len(text)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        # rows are laid a byte apart, so that no run goes on in the next one
        start = begin[row] + row + flat.field(0).to_numpy()
        end = begin[row] + row + flat.field(1).to_numpy() + LENGTH - 1
        order = np.argsort(start, kind="stable")
        start, far, row = start[order], np.maximum.accumulate(end[order]), row[order]
        fresh = np.ones(len(start), bool)
        fresh[1:] = start[1:] > far[:-1]
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], len(start)) - 1 if len(first) else first
        row, start, end = row[first], start[first] - row[first], far[last] - row[first]
        edge = np.zeros(len(data) + 1, np.int32)
        np.add.at(edge, start, 1)
        np.add.at(edge, end, -1)
        stays = np.cumsum(edge[:-1]) == 0
        lost = np.bincount(row, weights=end - start, minlength=len(text)).astype(np.int64)
        kept = np.concatenate([[0], np.cumsum(np.diff(begin) - lost)]).astype(np.int32)
        binary = pa.Array.from_buffers(pa.binary(), len(text), [None, pa.py_buffer(kept), pa.py_buffer(data[stays])])
        runs = pa.StructArray.from_arrays([pa.array(start - begin[row], pa.int64()), pa.array(end - begin[row], pa.int64())], ["start", "end"])
        each = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(text)))]).astype(np.int32)
        return pa.RecordBatch.from_arrays([*batch.columns[:fields], pa.array(np.diff(begin), pa.int64()), pa.ListArray.from_arrays(pa.array(each), runs), binary], names=[*(f"k{i}" for i in range(fields)), "n_bytes", "spans", "kept"])

    return run


def dedup(docs: DataFrame, keep: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``keep``, n_bytes, spans (what is removed, in bytes) and kept (the remaining bytes) for every row.

    A byte goes if a run of LENGTH bytes that covers it begins earlier too: in a
    document of a smaller key, or before it in the same one. Runs are looked for in
    the texts as they come, in bytes of UTF-8, and never across documents. Of ties
    (rows with the same key) none is earlier than another at the same place, so
    repeated rows lose or keep the same; rows without a key come after all others. A
    null text is an empty one; texts under LENGTH bytes are never cut; an empty table
    gives an empty one. Texts are looked at whole, however long (below the 2 GB of an
    Arrow cell). Other columns don't matter, whatever they are called.
    """
    fields = [docs.schema[c] for c in keep]
    schema = ", ".join([*(f"`k{i}` {f.dataType.simpleString()}" for i, f in enumerate(fields)), MADE])
    found = repeats(docs, key, text)
    # one document's intervals
    spans = found.groupBy("number", "digest").agg(F.collect_list(F.struct("start", "end")).alias("found"))
    told = docs.select(*(docs[c].alias(f"k{i}") for i, c in enumerate(keep)), docs[text].alias("t"), *_identity(docs[key], docs[text]))
    joined = told.join(spans, ["number", "digest"], "left").select(*(f"k{i}" for i in range(len(keep))), "t", "found")
    return joined.mapInArrow(_cutter(len(keep)), schema).toDF(*keep, "n_bytes", "spans", "kept")
