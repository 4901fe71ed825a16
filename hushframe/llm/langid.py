"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from a seed and its code
point; the white space between words has one too. Three letters in a row are bound:
the first's vector rotated by two places, the second's by one, and the third's are
multiplied. A text is the bundle (sum) of its bound vectors, a language the bundle
of its documents; a document gets the language of the highest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Components of a vector; documents of a language that its profile is learned from.
DIMENSIONS, PER_LANGUAGE, SEED = 1024, 500, 7
UNKNOWN = "und"


class Space:
    """Symbols of letters and their vectors; symbol 0 is anything else."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        self.dimensions, self.seed = dimensions, seed
        self.symbol = np.full(0x110000, -1, np.int32)
        self.rows = [self._draw(32)]
        self._bound = None

    def _draw(self, code: int) -> np.ndarray:
        return (np.random.default_rng([self.seed, code]).integers(0, 2, self.dimensions) * 2 - 1).astype(np.int8)

    def symbols(self, points: np.ndarray) -> np.ndarray:
        got = self.symbol[points]
        if (new := got < 0).any():
            for code in np.unique(points[new]).tolist():
                if chr(code).isalpha():
                    self.symbol[code] = len(self.rows)
                    self.rows.append(self._draw(code))
                else:
                    self.symbol[code] = 0
            self._bound = None
            got = self.symbol[points]
        return got

    def bound(self, codes: np.ndarray) -> np.ndarray:
        """Vectors of trigrams, given as (first x n + second) x n + third for n symbols."""
        if self._bound is None:
            base = np.array(self.rows)
            self._bound = np.roll(base, 2, 1), np.roll(base, 1, 1), base
        n = len(self.rows)
        first, second, third = self._bound
        return (first[codes // (n * n)] * second[codes // n % n] * third[codes % n]).astype(np.float32)

    def bundles(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """A row for each text, and whether it has a letter."""
        points = [np.frombuffer((x or "").lower().encode("utf-32-le"), np.uint32) for x in texts]
        owner = np.repeat(np.arange(len(texts)), [len(p) + 2 for p in points])
        edge = np.array([32], np.uint32)
        flat = self.symbols(np.concatenate([y for p in points for y in (edge, p, edge)]) if points else np.zeros(0, np.uint32))
        letters = np.bincount(owner[flat > 0], minlength=len(texts)) > 0
        keep = flat > 0
        keep[1:] |= flat[:-1] > 0
        # the white space before each text, wherever it is in the batch
        keep[1:] |= owner[1:] != owner[:-1]
        keep[0:1] = True
        flat, owner = flat[keep].astype(np.int64), owner[keep]
        out = np.zeros((len(texts), self.dimensions), np.float32)
        if len(flat) < 3:
            return out, letters
        n = len(self.rows)
        codes = (flat[:-2] * n + flat[1:-1]) * n + flat[2:]
        inside = (owner[:-2] == owner[2:]) & (flat[1:-1] > 0)
        codes, owner = codes[inside], owner[:-2][inside]
        if n**3 <= 1 << 22:
            seen = np.flatnonzero(np.bincount(codes, minlength=n**3))
            where = np.zeros(n**3, np.int32)
            where[seen] = np.arange(len(seen))
            place = where[codes]
        else:
            seen, place = np.unique(codes, return_inverse=True)
        for at in range(0, len(seen), 4096):  # bounds the memory of the bound vectors
            part = seen[at : at + 4096]
            mine = (place >= at) & (place < at + len(part)) if len(seen) > 4096 else slice(None)
            cell = owner[mine] * len(part) + place[mine] - at
            counts = np.bincount(cell, minlength=len(texts) * len(part)).astype(np.float32).reshape(len(texts), len(part))
            out += counts @ self.bound(part)
        return out, letters


_spaces: dict[tuple[int, int], Space] = {}


def space(dimensions: int, seed: int) -> Space:
    if (dimensions, seed) not in _spaces:
        _spaces[dimensions, seed] = Space(dimensions, seed)
    return _spaces[dimensions, seed]


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(size > 0, size, 1)


def fit(sample: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS, seed: int = SEED) -> dict[str, np.ndarray]:
    """Profile of each language of ``sample``; tasks send one sum a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                rows, letters = space(dimensions, seed).bundles(part.column(0).to_pylist())
                for row, good, name in zip(_unit(rows), letters, part.column(1).to_pylist(), strict=True):
                    if good and name is not None:
                        sums[name] = sums.get(name, 0) + row.astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.float64()))], names=["lang", "profile"])

    total: dict[str, np.ndarray] = {}
    for r in sorted(sample.select(text, lang).mapInArrow(run, "lang string, profile array<double>").collect(), key=lambda r: (r.lang, r.profile)):
        total[r.lang] = total.get(r.lang, 0) + np.array(r.profile)
    return total


def _pieces(batch: pa.RecordBatch, column: int, rows: int = 256, size: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Slices of at most so many rows, and so many bytes of text unless one row has more."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        fit = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))
        end = max(at + 1, min(at + rows, fit))
        yield batch.slice(at, end - at)
        at = end


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], keep: list[str], text: str = "text", dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """``keep``, lang_pred and score (the cosine, 0 where negative) for every row.

    A null text, or one without a letter, gets ``und`` and 0. Of equal cosines the
    language first by code point wins. What is sent to executors is one vector a
    language. Repeated rows give repeated rows.
    """
    names = sorted(profiles)
    matrix = _unit(np.array([profiles[n] for n in names])).T.astype(np.float32) if names else np.zeros((dimensions, 0), np.float32)
    fields = [docs.schema[c] for c in keep]
    schema = ", ".join([*(f"`k{i}` {f.dataType.simpleString()}" for i, f in enumerate(fields)), "lang_pred string, score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _pieces(batch, len(fields)):
                rows, letters = space(dimensions, seed).bundles(part.column(len(fields)).to_pylist())
                pred, score = [UNKNOWN] * len(rows), np.zeros(len(rows))
                if names:
                    cosine = _unit(rows) @ matrix
                    best = cosine.argmax(1)
                    score = np.where(letters, np.clip(cosine[np.arange(len(rows)), best], 0, 1), 0).astype(np.float64)
                    pred = [names[b] if good else UNKNOWN for b, good in zip(best, letters, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(pred, pa.string()), pa.array(score)], names=[*(f"k{i}" for i in range(len(fields))), "lang_pred", "score"])

    out = docs.select(*(docs[c].alias(f"k{i}") for i, c in enumerate(keep)), docs[text].alias("t")).mapInArrow(run, schema)
    return out.toDF(*keep, "lang_pred", "score")


def training_sample(docs: DataFrame, fold_column, per_language: int = PER_LANGUAGE, key: str = "doc_id", lang: str = "lang") -> DataFrame:
    """At most ``per_language`` rows of each language for which ``fold_column`` is true."""
    from .common import bounded_sample

    docs = docs.select(key, "text", lang)
    ids = bounded_sample(docs.filter(fold_column & F.col(lang).isNotNull() & F.col("text").isNotNull()).select(key, lang), lang, per_language, key, SEED)
    # at most per_language ids a language
    return docs.join(F.broadcast(ids.select(F.col(key).alias("_id")).distinct()), F.col(key) == F.col("_id"), "left_semi")


def told_rows(docs: DataFrame, profiles: dict[str, np.ndarray], least: float, text: str = "text") -> DataFrame:
    """``docs`` without the rows whose language can't be told: no letter, or no profile with a cosine of ``least``."""
    from .common import apart

    plain, (t,) = apart(docs, text)
    told = predict(plain, profiles, plain.columns, t)
    return told.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(*plain.columns).toDF(*docs.columns)
