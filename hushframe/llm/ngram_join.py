"""Near-duplicate documents: an n-gram Jaccard self-join with MinHash banding.

Bands and rows are chosen for a target recall at the least similarity. Documents
are dealt by the hashes of their bands; pairs that share a band are verified on
their full n-gram sets, so no pair below the limit is ever linked.

Documents with the same n-gram set are one class and take part once. Large buckets
are cut into blocks, and pairs of blocks are dealt to tasks. A pair that shares
several bands belongs to the first one: tasks first look, on band hashes alone, which
members of a pair of blocks have such a pair there, and only these members' texts are
sent and their full n-gram sets compared. Pairs are never put out: a task gives each
class its number of links and a spanning forest of them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import components, forest

#: Words of an n-gram; least similarity (as a fraction, exactly); recall aimed at there; most hashes.
WORDS, LEAST, RECALL, MOST_HASHES, SEED = 5, (4, 5), 0.9995, 128, 5
#: Members and set bytes of a block of a bucket.
BLOCK, BLOCK_BYTES = 512, 16 << 20
#: Ids up to which those of colliding classes are broadcast (16 MB); beyond, documents are joined by exchange.
BROADCAST_IDS = 2_000_000


def choose_bands(similarity: float, recall: float, most: int = MOST_HASHES) -> tuple[int, int]:
    """Bands and rows: the most rows (fewest false candidates) that reach the recall with ``most`` hashes.

    Raises ValueError where no number of rows does.
    """
    for rows in range(most, 0, -1):
        miss = 1 - similarity**rows
        bands = 1 if miss <= 0 else math.ceil(math.log(1 - recall) / math.log(miss)) if miss < 1 else most + 1
        if bands * rows <= most:
            return max(1, bands), rows
    raise ValueError(f"{most} hashes can't reach a recall of {recall} at a similarity of {similarity}")


class Words(dict):
    """Word -> 64-bit hash; starts anew at 300,000 entries."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = Words()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: bytes, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams of words; a shorter text has one, all its words."""
    words = text.split()
    if not words:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = min(n, len(ids))
    got = np.full(len(ids) - n + 1, n, np.uint64)
    for k in range(n):
        got = _mix(got * np.uint64(0x9E3779B97F4A7C15) + ids[k : len(ids) - n + 1 + k])
    return np.unique(got)


def _factors(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, count, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, count, np.uint64)


def band_hashes(grams: np.ndarray, bands: int, rows: int, seed: int = SEED) -> np.ndarray:
    """A signed 64-bit hash of each band of the set's MinHash signature."""
    a, b = _factors(bands * rows, seed)
    low = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 1024):
        low = np.minimum(low, (grams[at : at + 1024, None] * a + b).min(0))
    out = np.arange(bands, dtype=np.uint64) + np.uint64(1)
    for k in range(rows):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + low[k::rows][:bands])
    return out.view(np.int64)


def set_key(grams: bytes) -> tuple[int, int]:
    """128 bits that stand for a set of n-grams."""
    first, second = np.frombuffer(hashlib.blake2b(grams, digest_size=16).digest(), np.int64).tolist()
    return first, second


def sketch(docs: DataFrame, bands: int, rows: int, n: int = WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """_id, h1, h2 (the set's 128-bit key; null without words), n (its size), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2, size, hashes = [], [], [], []
            for value in batch.column(1).cast(pa.binary()).to_pylist():
                grams = shingles(value or b"", n)
                size.append(len(grams))
                if len(grams):
                    first, second = set_key(grams.tobytes())
                    h1.append(first)
                    h2.append(second)
                    hashes.append(band_hashes(grams, bands, rows))
                else:
                    h1.append(None)
                    h2.append(None)
                    hashes.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(size, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))], names=["_id", "h1", "h2", "n", "bands"])

    return docs.select(docs[key].cast("long").alias("_id"), docs[text].alias("_text")).mapInArrow(run, "_id long, h1 long, h2 long, n long, bands array<long>")


def whole_groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of complete groups, from frames sorted by ``keys``."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        last = (frame[keys] != frame[keys].iloc[-1]).any(axis=1).to_numpy()
        cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
        if cut:
            yield pd.concat([*held, frame.iloc[:cut]], ignore_index=True)
            held = []
        elif held and (held[0][keys].iloc[0] != frame[keys].iloc[0]).any():
            yield pd.concat(held, ignore_index=True)
            held = []
        held.append(frame.iloc[cut:])
    if held:
        yield pd.concat(held, ignore_index=True)


def _edges_of(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Where groups begin, and the length."""
    change = (frame[keys].to_numpy()[1:] != frame[keys].to_numpy()[:-1]).any(1)
    return np.concatenate([[0], np.flatnonzero(change) + 1, [len(frame)]])


def _first_common(a: np.ndarray, b: np.ndarray, band: int) -> np.ndarray:
    """Whether rows of band hashes have no band before ``band`` in common."""
    return ~(a[:, :band] == b[:, :band]).any(1) if band else np.ones(len(a), bool)


def _needed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Members of pairs of blocks that have a pair there whose first common band this is."""
    keys = ["bucket", "i", "j"]
    for frame in whole_groups(frames, keys):
        cuts = _edges_of(frame, keys)
        keep = np.zeros(len(frame), bool)
        which, block = frame["band"].to_numpy(), frame["block"].to_numpy()
        left, right = frame["i"].to_numpy(), frame["j"].to_numpy()
        bands = frame["before"].to_numpy()
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            mine = np.stack(bands[lo:hi])
            one, other = np.flatnonzero(block[lo:hi] == left[lo]), np.flatnonzero(block[lo:hi] == right[lo])
            for k in one:
                rest = other[other > k] if left[lo] == right[lo] else other
                fresh = rest[_first_common(mine[rest], mine[k : k + 1], int(which[lo]))]
                if len(fresh):
                    keep[lo + k] = True
                    keep[lo + fresh] = True
        yield frame[keep]


def _keyed(n: int):
    """Texts with the keys of their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [set_key(shingles(x or b"", n).tobytes()) for x in batch.column(1).cast(pa.binary()).to_pylist()]
            h1, h2 = np.array(keys, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h1), pa.array(h2), batch.column(1)], names=["rep", "h1", "h2", "text"])

    return run


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of some sorted sets."""
    m = len(sets)
    out = np.zeros((m, m), np.float32)
    if m <= 6:
        for i in range(m):
            for j in range(i + 1, m):
                out[i, j] = out[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return out
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    column = np.cumsum(new) - 1
    shared = np.bincount(column) > 1
    use = shared[column]
    place = np.cumsum(shared) - 1
    column, owner = place[column[use]], owner[use]
    for at in range(0, int(shared.sum()), 4096):
        lo, hi = np.searchsorted(column, [at, at + 4096])
        dense = np.zeros((m, 4096), np.float32)
        dense[owner[lo:hi], column[lo:hi] - at] = 1
        out += dense @ dense.T
    return out


def _verify(top: int, bottom: int, n: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys = ["bucket", "i", "j"]
        for frame in whole_groups(frames, keys):
            cuts = _edges_of(frame, keys)
            reps, mult = frame["rep"].to_numpy(), frame["mult"].to_numpy()
            links, left, right = np.zeros(len(frame), np.int64), [], []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                sets = [shingles(x.encode(), n) for x in frame["text"].iloc[lo:hi]]
                bands = np.stack(frame["before"].iloc[lo:hi].to_numpy())
                size = np.array([len(s) for s in sets])
                common = intersections(sets).astype(np.int64)
                # inter / union >= top / bottom in whole numbers
                near = common * (bottom + top) >= top * (size[:, None] + size[None])
                i, j = int(frame["i"].iloc[lo]), int(frame["j"].iloc[lo])
                if i != j:
                    block = frame["block"].to_numpy()[lo:hi]
                    near &= (block[:, None] == i) & (block[None] == j)
                else:
                    near = np.triu(near, 1)
                a, b = np.nonzero(near)
                first = _first_common(bands[a], bands[b], int(frame["band"].iloc[lo]))
                a, b = a[first] + lo, b[first] + lo
                np.add.at(links, a, mult[b])
                np.add.at(links, b, mult[a])
                left.append(a)
                right.append(b)
            some = np.flatnonzero(links)
            out = [pd.DataFrame({"a": reps[some], "b": pd.array([None] * len(some), "Int64"), "n": links[some]})]
            a, b = np.concatenate(left), np.concatenate(right)
            if len(a):
                distinct, number = np.unique(reps, return_inverse=True)
                root = forest(len(distinct), number[a], number[b])
                leaf = np.flatnonzero(root != np.arange(len(distinct)))
                out.append(pd.DataFrame({"a": distinct[root[leaf]], "b": pd.array(distinct[leaf], "Int64"), "n": 0}))
            yield pd.concat(out)

    return run


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = WORDS, least: tuple[int, int] = LEAST, recall: float = RECALL) -> DataFrame:
    """key, set_id, n_links, class_id, kept for every row of ``docs``.

    set_id: smallest key with the same n-gram set; n_links: other rows with a
    similarity of at least ``least``; class_id: smallest key reachable by links;
    kept: the row's key is its class_id. Words are runs of other than white space,
    compared as they are. A text of fewer than n words has one n-gram, all its words;
    a null text, or one without words, links with nothing. Repeated rows count, and
    are returned, each. A null key's row is a class of its own.
    """
    bands, rows = choose_bands(least[0] / least[1], recall)
    sketched = written(sketch(docs, bands, rows, n, key, text), "ngram-sketches")
    usable = sketched.filter(F.col("h1").isNotNull() & F.col("_id").isNotNull())
    # a class's rows are counted in each task before they are exchanged
    classes = written(usable.groupBy("h1", "h2").agg(F.min("_id").alias("rep"), F.count(F.lit(1)).alias("mult"), F.first("n").alias("n"), F.first("bands").alias("bands")), "ngram-classes")

    each = classes.select("rep", "n", F.posexplode("bands").alias("band", "hash")).select("rep", "n", "band", F.xxhash64("band", "hash").alias("bucket"))
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(8 * F.sum("n") / BLOCK_BYTES)).cast("int")
    shared = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), blocks.alias("blocks")).filter("m > 1").select("bucket", "blocks")
    members = written(each.select("rep", "band", "bucket").join(shared, "bucket"), "ngram-members")
    # of a class, what a pair of blocks needs: the bands before this one, and how its set is known
    body = classes.select("rep", "h1", "h2", "mult", "bands")
    placed = members.join(body, "rep").withColumn("before", F.slice("bands", 1, F.col("band"))).drop("bands")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = placed.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "band", "block", "rep", "h1", "h2", "mult", "before")
    parts = _parts(members)
    looked = dealt.filter("band > 0").repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "rep").mapInPandas(_needed, dealt.schema)
    needed = written(dealt.filter("band = 0").union(looked), "ngram-needed")

    ids = needed.select("rep").distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = docs.select(docs[key].cast("long").alias("rep"), docs[text].alias("_text")).join(ids, "rep", "left_semi")
    # where rows repeat a key with other texts, the class's own is told by its set's key
    texts = texts.mapInArrow(_keyed(n), "rep long, h1 long, h2 long, text string").groupBy("rep", "h1", "h2").agg(F.first("text").alias("text"))
    full = needed.join(texts, ["rep", "h1", "h2"]).select("bucket", "i", "j", "band", "rep", "mult", "block", "before", "text")
    ready = full.repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "rep")
    found = written(ready.mapInPandas(_verify(*least, n), "a long, b long, n long"), "ngram-links")

    counts = found.filter("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    joined = components(found.filter("b is not null").select("a", "b")).withColumnRenamed("node", "rep")
    own = classes.select("h1", "h2", "rep", "mult").join(counts, "rep", "left").join(joined, "rep", "left")
    own = own.select("h1", "h2", F.col("rep").alias("set_id"), (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("class_id"))
    known = F.col("_id").isNotNull()
    out = sketched.select("_id", "h1", "h2").join(own, ["h1", "h2"], "left")
    out = out.select(F.col("_id").alias(key), *(F.when(known, F.coalesce(c, d)).otherwise(d).alias(c) for c, d in (("set_id", F.col("_id")), ("n_links", F.lit(0).cast("long")), ("class_id", F.col("_id")))))
    return out.withColumn("kept", F.col(key).isNull() | (F.col(key) == F.col("class_id")))


def _parts(members: DataFrame) -> int:
    """Partitions for the colliding members: by their number, so that one holds about 20,000."""
    spark = members.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), members.count() // 20_000)


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class; rows that repeat a kept key are reduced to one.

    Whole rows are exchanged once, by key, at every size of the table: the keys that
    stay may be as many as the rows, so they are never broadcast. Rows with a null
    key are classes of their own and stay without an exchange.
    """
    from .common import apart

    theirs, (docs, (key, text)) = docs.columns, apart(docs, key, text)
    decided = join(docs, key, text, **options).filter(F.col("kept") & F.col(key).isNotNull()).select(F.col(key).alias("_kept"))
    once = written(decided.groupBy("_kept").agg(F.count(F.lit(1)).alias("_rows")), "ngram-kept")
    out = docs.join(once.hint("shuffle_hash"), docs[key] == F.col("_kept"), "left_semi")
    repeats = once.filter("_rows > 1").select("_kept")
    if not repeats.isEmpty():
        more = out.join(repeats, out[key] == F.col("_kept"), "left_semi").dropDuplicates([key])
        out = out.join(repeats, out[key] == F.col("_kept"), "left_anti").unionByName(more)
    return out.unionByName(docs.filter(F.col(key).isNull())).toDF(*theirs)
