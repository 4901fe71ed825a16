"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is logistic in the
distinct words it has; a document's is their noisy-or, 1 - prod(1 - p). Only
documents are labelled: the gradient of the noisy-or shares a document's label out
among its sentences. The sentence scores then say where the offence is.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled documents of each label that are learned from; rounds; step; L1 penalty a document; documents a word needs.
PER_LABEL, ROUNDS, STEP, PENALTY, LEAST_DOCS, SEED = 2500, 150, 0.3, 2e-4, 3, 11
#: Code points up to which a document is learned from (longer ones are scored whole, as all are).
LONGEST = 20_000
ENDS = re.compile(r"[.!?\n]+")
_PUNCT = str.maketrans({c: " " for c in ",;:\"()[]{}<>"})


def sentences(text: str) -> list[list[str]]:
    """Words (lower case, without punctuation) of each sentence that has some."""
    return [w for s in ENDS.split(text.lower().translate(_PUNCT)) if (w := s.split())]


class Model:
    """Words with a weight other than 0, and the bias of a sentence."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias

    def _logs(self, text: str) -> tuple[int, list[tuple[int, float]]]:
        """Sentences, and log(1 - p) of those that have a weighted word."""
        found, weights, n = [], self.weights, 0
        for words in sentences(text):
            if not weights.keys().isdisjoint(words):
                z = self.bias + sum(weights[w] for w in set(words) if w in weights)
                found.append((n, -max(z, 0) - math.log1p(math.exp(-abs(z)))))
            n += 1
        return n, found

    def score(self, text: str | None) -> float:
        n, found = self._logs(text or "")
        plain = -math.log1p(math.exp(self.bias)) if self.bias < 30 else -self.bias
        return -math.expm1((n - len(found)) * plain + sum(x for _, x in found))

    def locate(self, text: str | None, least: float = 0.5) -> list[tuple[int, int, float]]:
        """start, end (code points) and probability of each sentence of at least ``least``."""
        out, at, text = [], 0, text or ""
        for m in [*ENDS.finditer(text), None]:
            end = m.start() if m else len(text)
            if (words := text[at:end].lower().translate(_PUNCT).split()) and not self.weights.keys().isdisjoint(words):
                z = self.bias + sum(self.weights.get(w, 0) for w in set(words))
                if (p := 1 / (1 + math.exp(-z))) >= least:
                    out.append((at, end, p))
            at = m.end() if m else end
        return out


def fit(texts: list[str], labels: list[int], rounds: int = ROUNDS, step: float = STEP, penalty: float = PENALTY, least_docs: int = LEAST_DOCS) -> Model:
    """Proximal gradient steps (with Adam's scaling) on the noisy-or's log loss."""
    bags = [[sorted(set(s)) for s in sentences(t)] for t in texts]
    seen = Counter(w for bag in bags for w in {w for s in bag for w in s})
    words = sorted(w for w, n in seen.items() if n >= least_docs)
    number = {w: i for i, w in enumerate(words)}
    y = np.array(labels, np.float64)
    sentence_of, word_of, doc_of, n = [], [], [], 0
    for d, bag in enumerate(bags):
        for s in bag:
            own = [number[w] for w in s if w in number]
            word_of += own
            sentence_of += [n] * len(own)
            doc_of.append(d)
            n += 1
    if not n or not words or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model({}, -30.0 if share < 0.5 else 30.0)
    sentence_of, word_of, doc_of = np.array(sentence_of), np.array(word_of), np.array(doc_of)
    w, bias, docs = np.zeros(len(words)), -5.0, len(texts)
    m, v, mb, vb = np.zeros(len(words)), np.zeros(len(words)), 0.0, 0.0
    for k in range(1, rounds + 1):
        z = bias + np.bincount(sentence_of, w[word_of], n)
        log_not = -np.logaddexp(0, z)
        p = -np.expm1(log_not)
        bag_not = np.bincount(doc_of, log_not, docs)
        big = np.clip(-np.expm1(bag_not), 1e-9, 1)
        pull = np.where(y > 0, -(1 - big) / big, 1.0)
        g = pull[doc_of] * p / docs
        gw = np.bincount(word_of, g[sentence_of], len(words))
        gb = g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = step / (np.sqrt(v / (1 - 0.99**k)) + 1e-5)
        w = w - rate * m / (1 - 0.9**k)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * penalty, 0)
        bias -= step / (math.sqrt(vb / (1 - 0.99**k)) + 1e-5) * mb / (1 - 0.9**k)
    return Model({words[i]: float(w[i]) for i in np.flatnonzero(np.abs(w) > 1e-3)}, float(bias))


def training_sample(docs: DataFrame, labels: DataFrame, fold_column, per_label: int = PER_LABEL, key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """text and label of at most ``per_label`` documents of each label, the first by a seeded hash; texts above LONGEST are left out."""
    from .common import bounded_sample

    one = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max(label).alias("_label"))
    ids = bounded_sample(one.filter(fold_column), "_label", per_label, key, SEED)
    # at most per_label ids a label
    docs, chosen = docs.select(key, "text"), F.broadcast(ids.withColumnRenamed(key, "_id"))
    return docs.join(chosen, docs[key] == F.col("_id")).filter(docs["text"].isNull() | (F.length(docs["text"]) <= LONGEST)).select(docs["text"], "_label")


def train(docs: DataFrame, labels: DataFrame, fold_column, **options) -> Model:
    """A model of the labelled documents that ``fold_column`` (of the key) allows.

    Learned on the driver from ``training_sample``: at most 2 x PER_LABEL texts of at
    most LONGEST code points. Of several labels of a document the highest counts, null
    labels none; a null text is an empty one, repeated rows count each.
    """
    rows = training_sample(docs, labels, fold_column, **options).collect()
    rows.sort(key=lambda r: (r._label, r.text or ""))
    return fit([r.text or "" for r in rows], [int(r._label > 0) for r in rows])


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text", spans: bool = False) -> DataFrame:
    """``keep``, score and, with ``spans``, the offending sentences of every row.

    A null text scores as an empty one. Repeated rows give repeated rows. The model
    holds the weighted words of a bounded sample, whatever the size of ``docs``.
    """
    fields = [docs.schema[c] for c in keep]
    more = ", spans array<struct<start:int,end:int,score:double>>" if spans else ""
    schema = ", ".join([*(f"`k{i}` {f.dataType.simpleString()}" for i, f in enumerate(fields)), "score double"]) + more
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(len(fields)).to_pylist()
                cols = [*part.columns[:-1], pa.array([min(1.0, max(0.0, model.score(t))) for t in texts], pa.float64())]
                if spans:
                    cols.append(pa.array([[dict(zip(("start", "end", "score"), s, strict=True)) for s in model.locate(t)] for t in texts], kind))
                yield pa.RecordBatch.from_arrays(cols, names=[*(f"k{i}" for i in range(len(fields))), "score", *(["spans"] if spans else [])])

    out = docs.select(*(docs[c].alias(f"k{i}") for i, c in enumerate(keep)), docs[text].alias("t")).mapInArrow(run, schema)
    return out.toDF(*keep, "score", *(["spans"] if spans else []))
