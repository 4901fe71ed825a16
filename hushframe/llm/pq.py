"""Embedding near-duplicates by product quantisation.

Vectors are dealt to inverted lists by their nearest coarse centroid; what is left
after subtracting it is coded in subspaces. A vector searches the lists of its
nearest centroids: table look-ups give its distance to the coded form of each
vector there, and those that can be near enough are compared exactly. A vector's
own coding error is added to the limit, so in a list that is searched no near pair
is lost; only pairs of which neither searches the other's list can be.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import components, forest

#: Cosine of a link; vectors the index is fitted on; vectors a list aims at; lists searched; subspaces; codes; vectors of a block.
LEAST_COSINE, SAMPLE, PER_LIST, PROBES, SUBSPACES, CODES, BLOCK, SEED = 0.95, 20_000, 200, 12, 8, 64, 2048, 3


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """k centres of the rows of x (fewer if there are fewer distinct rows)."""
    start = np.unique(x, axis=0)
    centres = start[rng.permutation(len(start))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, centres, 1)[:, 0]
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        count = np.bincount(near, minlength=len(centres))
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centres of each row, nearest first."""
    n = min(n, len(centres))
    out = np.empty((len(x), n), np.int64)
    half = (centres**2).sum(1) / 2
    for at in range(0, len(x), 2048):
        far = half - x[at : at + 2048] @ centres.T
        part = np.argpartition(far, n - 1, axis=1)[:, :n]
        order = np.argsort(np.take_along_axis(far, part, 1), axis=1, kind="stable")
        out[at : at + 2048] = np.take_along_axis(part, order, 1)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    big = np.abs(x).max(1, keepdims=True)
    x = x / np.where(big > 0, big, 1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


@dataclass
class Index:
    centroids: np.ndarray
    codebooks: list[np.ndarray]
    dimension: int

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int, subspaces: int = SUBSPACES, codes: int = CODES, seed: int = SEED) -> Index:
        rng = np.random.default_rng(seed)
        centroids = kmeans(sample, lists, 8, rng)
        left = sample - centroids[nearest(sample, centroids, 1)[:, 0]]
        parts = np.array_split(np.arange(sample.shape[1]), min(subspaces, sample.shape[1]))
        return cls(centroids, [kmeans(left[:, p], codes, 8, rng) for p in parts], sample.shape[1])

    def split(self, x: np.ndarray) -> list[np.ndarray]:
        return np.array_split(x, min(len(self.codebooks), x.shape[1]), axis=1)

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of residuals and how far the coded forms are from them."""
        parts = self.split(residual)
        codes = np.stack([nearest(p, book, 1)[:, 0] for p, book in zip(parts, self.codebooks, strict=True)], 1)
        error = sum(((p - book[c]) ** 2).sum(1) for p, book, c in zip(parts, self.codebooks, codes.T, strict=True))
        return codes, np.sqrt(error)

    def tables(self, residual: np.ndarray) -> list[np.ndarray]:
        """Squared distances of each query's part to each code of a subspace."""
        return [((p[:, None, :] - book[None]) ** 2).sum(2) for p, book in zip(self.split(residual), self.codebooks, strict=True)]


def pairs_in_list(index: Index, centroid: np.ndarray, queries: np.ndarray, base: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Query and base rows (unit vectors) whose exact cosine is at least ``least``."""
    codes, error = index.encode(base - centroid)
    # |q - coded| <= |q - x| + |x - coded|; a little more for rounding
    limit = np.sqrt(max(0.0, 2 - 2 * least)) + error + 1e-6
    for at in range(0, len(queries), 256):
        part = queries[at : at + 256]
        tables = index.tables(part - centroid)
        far = sum(t[:, c] for t, c in zip(tables, codes.T, strict=True))
        q, x = np.nonzero(far <= limit[None] ** 2)
        yield q + at, x


def link(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", least: float = LEAST_COSINE, sample: int = SAMPLE, per_list: int = PER_LIST, probes: int = PROBES, block: int = BLOCK) -> DataFrame:
    """key, n_links, component_id, kept for every row of ``vectors``.

    Equal vectors are searched once and counted as often as they occur. The vectors of
    a list and those that search it are both cut into blocks of about ``block``; tasks
    search one block by another, however large a list is.
    A pair that two lists can find is counted in one of them. Pairs aren't put out:
    a task gives each vector's number of links and a spanning forest of them.
    Null, zero and non-finite vectors, and those of a length other than the
    commonest, are linked to equal-length ones only, the invalid ones to nothing.
    A null key's row links and is linked, but names no component.
    """
    spark = vectors.sparkSession
    e = F.col(column)
    fine = e.isNotNull() & (F.size(e) > 0) & F.exists(e, lambda v: v != 0) & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    keyed = vectors.select(F.col(key).alias("_id"), F.when(F.coalesce(fine, F.lit(False)), e.cast("array<float>" if "float" in vectors.schema[column].dataType.simpleString() else "array<double>")).alias("_v"))
    keyed = keyed.withColumns({"_h1": F.xxhash64("_v", F.lit(1)), "_h2": F.xxhash64(F.lit(2), "_v")})
    classes = keyed.filter(F.col("_v").isNotNull()).groupBy("_h1", "_h2").agg(F.min("_id").alias("rep"), F.count(F.lit(1)).alias("mult"), F.first("_v").alias("v"))
    # a class without any key is still searched, under a number of its own
    classes = written(classes.withColumn("rep", F.coalesce(F.col("rep"), -1 - F.abs(F.col("_h1") % (1 << 62)))), "vector-classes")
    lengths = classes.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is None:
        return keyed.select(F.col("_id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"), F.lit(True).alias("kept"))
    dimension, total = lengths.n, lengths["count"]
    # the first by a seeded hash, of all rows alike; a few more than needed are below the bound
    place = F.pmod(F.xxhash64("_h1", "_h2", F.lit(SEED)), F.lit(1 << 30))
    near_first = classes.filter((F.size("v") == dimension) & (place < int(min(1.0, 1.1 * sample / total) * (1 << 30)) + 1))
    fit_on = near_first.orderBy(place, "rep").select("rep", "v").limit(sample).collect()
    fit_on.sort(key=lambda r: r.rep)
    lists = max(1, min(sample // 8, total // per_list))
    index = Index.fit(unit(np.array([r.v for r in fit_on] or [[1.0] * dimension])), lists)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.full((batch.num_rows, min(probes, len(index.centroids))), -1, np.int64)
            size = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
            mine = np.flatnonzero(size == dimension)
            if len(mine):
                x = batch.column(2).take(pa.array(mine)).flatten().to_numpy(zero_copy_only=False)
                near[mine] = nearest(unit(x.reshape(len(mine), dimension)), index.centroids, probes)
            # other lengths have a list each, below 0
            found = [row.tolist() if row[0] >= 0 else [-int(n)] for row, n in zip(near, size, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int64()))], names=["rep", "mult", "v", "probes"])

    kind = classes.schema["v"].dataType.simpleString()
    placed = written(classes.select("rep", "mult", "v").mapInArrow(assign, f"rep long, mult long, v {kind}, probes array<long>"), "vector-lists")
    home = F.col("probes")[0]
    searched = placed.withColumn("list", F.explode("probes")).withColumn("base", home == F.col("list"))
    # one row a list: as many as centroids
    many = lambda of: F.greatest(F.ceil(of / block), F.lit(1)).cast("int")
    sizes = searched.groupBy("list").agg(many(F.count_if("base")).alias("blocks"), many(F.count(F.lit(1))).alias("askers"))
    searched = searched.join(F.broadcast(sizes), "list")
    own, every = (lambda n, salt: F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(n)).cast("int")), (lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
    asking = searched.select("list", every("blocks").alias("block"), own("askers", 1).alias("asker"), F.lit(False).alias("base"), "rep", "mult", "probes", "v")
    there = searched.filter("base").select("list", own("blocks", 2).alias("block"), every("askers").alias("asker"), F.lit(True).alias("base"), "rep", "mult", "probes", "v")

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        at = int(frame["list"].iloc[0])
        frame = frame.sort_values(["base", "rep"], kind="stable")
        rep, mult = frame["rep"].to_numpy(), frame["mult"].to_numpy()
        first = int((~frame["base"]).sum())  # askers, then the vectors of the list
        links, edges = np.zeros(len(frame), np.int64), []
        if 0 < first < len(frame):
            x = unit(np.stack(frame["v"].to_numpy()))
            near = np.stack(frame["probes"].to_numpy())
            homes = near[:, 0]
            use = index if at >= 0 else Index.fit(x[first:][:1000], 1)
            for q, b in pairs_in_list(use, use.centroids[at if at >= 0 else 0], x[:first], x[first:], least):
                y = b + first
                # of a pair at home here, or that both lists can find, one side counts
                alone = ~(near[y] == homes[q][:, None]).any(1)
                counted = np.where(homes[q] == at, rep[q] < rep[y], alone | (at < homes[q]))
                q, y = q[counted], y[counted]
                near_enough = np.einsum("ij,ij->i", x[q], x[y]) >= least
                q, y = q[near_enough], y[near_enough]
                np.add.at(links, q, mult[y])
                np.add.at(links, y, mult[q])
                if len(q):
                    edges.append((q, y))
        out = [pd.DataFrame({"a": rep[links > 0], "b": pd.array([None] * int((links > 0).sum()), "Int64"), "n": links[links > 0]})]
        if edges:
            a, b = (np.concatenate(z) for z in zip(*edges, strict=True))
            # a vector may be there on both sides
            distinct, number = np.unique(rep, return_inverse=True)
            root = forest(len(distinct), number[a], number[b])
            leaf = np.flatnonzero(root != np.arange(len(distinct)))
            out.append(pd.DataFrame({"a": distinct[root[leaf]], "b": pd.array(distinct[leaf], "Int64"), "n": 0}))
        return pd.concat(out)

    found = written(asking.union(there).groupBy("list", "block", "asker").applyInPandas(search, "a long, b long, n long"), "vector-links")
    counts = found.filter("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    joined = components(found.filter("b is not null").select("a", "b"))
    own = classes.select("_h1", "_h2", "rep", "mult")
    own = own.join(counts.withColumnRenamed("a", "rep"), "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    own = own.select("_h1", "_h2", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"), F.lit(True).alias("_found"))
    out = keyed.join(own, ["_h1", "_h2"], "left")
    component = F.when(F.col("_found") & F.col("_v").isNotNull(), F.col("component_id")).otherwise(F.col("_id"))
    out = out.select(F.col("_id").alias(key), F.when(F.col("_v").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))
