"""What each of several filters removes, in every order in which they may be applied.

A document is told by the mask of the filters it fails; a part of the corpus by how
many documents have each mask (its cells). All orders are then visited by swaps of two
neighbours: a swap changes what the two swapped steps remove and nothing else, so only
these two are counted anew, from the cells. What each filter removes is added up on the
way: its mean over the orders is its Shapley value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE

LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
MARKS = "[#$%&*|]"
NAMES = "ABCDE"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def conditions(text: Column) -> list[Column]:
    """Failure of the four filters that look at a text alone: A, B, C, D."""
    spaces = WHITE.decode()
    words = F.array_remove(F.split(F.translate(text, spaces, " " * len(spaces)), " "), "")
    return [
        F.size(words) < LEAST_WORDS,
        100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * F.size(words),
        100 * F.regexp_count(text, F.lit("[A-Z]")) > MOST_CAPITALS * F.length(text),
        text.rlike(MARKS),
    ]


def mask_cells(docs: DataFrame, labels: DataFrame, part: str = "lang", key: str = "doc_id", text: str = "text") -> DataFrame:
    """part, mask, n, good, toxic: documents of each part and mask, and those of them labelled good or toxic.

    Bit 4 is A and bit 0 is E. Texts become 32 bytes and a mask before anything is
    exchanged. Copies of a text are counted in each task by part and label, with their
    smallest id, so a group of copies, however large, arrives as a few rows: whether a
    copy has an earlier one needs no join back. Null texts are empty ones and a null
    part is the empty string; a row without an id fails E never, nor does it make
    others fail. Repeated rows count each; a document with several labels has each of them.
    """
    body = F.coalesce(docs[text], F.lit(""))
    told = docs.select(docs[key].alias("id"), F.coalesce(docs[part].cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(body, 256)).alias("digest"), sum((c.cast("int") * bit for c, bit in zip(conditions(body), (16, 8, 4, 2), strict=True)), F.lit(0)).alias("mask"))
    marked = labels.groupBy(labels[key].alias("of")).agg(F.coalesce(F.max((labels["quality"] == 1).cast("int")), F.lit(0)).alias("good"), F.coalesce(F.max((labels["toxic"] == 1).cast("int")), F.lit(0)).alias("toxic"))
    # null ids find no label; a second key keeps them from meeting in one task
    apart = F.when(F.col("id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("long"))
    joined = told.withColumn("apart", apart).join(marked.filter(F.col("of").isNotNull()).withColumn("none", F.lit(0).cast("long")), (F.col("id") == F.col("of")) & (F.col("apart") == F.col("none")), "left")
    keys = ["digest", "part", "mask", "good", "toxic"]
    rows = joined.select("id", "digest", "part", "mask", *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("good", "toxic")))
    # a document has one row in most tables: first rows an id, then rows a text
    by_id = rows.groupBy(*keys, "id").agg(F.count(F.lit(1)).alias("n"))
    nameless = F.col("id").isNull()
    copies = by_id.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.when(nameless, F.col("n")).otherwise(0)).alias("nameless"), F.min(F.when(~nameless, F.struct("id", "n"))).alias("least"))
    # a text has a few such rows: one a part and label
    firsts = copies.groupBy("digest").agg(F.min("least.id").alias("first"), F.collect_list(F.struct("part", "mask", "good", "toxic", "n", "nameless", "least")).alias("of_part")).select("first", F.inline("of_part"))
    unlike = F.col("nameless") + F.when(F.col("least.id") == F.col("first"), F.col("least.n")).otherwise(F.lit(0))
    each = firsts.select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("mask").alias("mask"), unlike.alias("n")), F.struct((F.col("mask") + 1).alias("mask"), (F.col("n") - unlike).alias("n")))).alias("cell"))
    n = F.col("cell.n")
    return each.filter(n > 0).groupBy("part", F.col("cell.mask").alias("mask")).agg(F.sum(n).alias("n"), F.sum(n * F.col("good")).alias("good"), F.sum(n * F.col("toxic")).alias("toxic"))


def swaps(n: int) -> Iterator[int]:
    """Places k at which to swap k and k + 1, so that each order of n things is met once: the last thing wanders through every order of the others, to and fro."""
    if n < 2:
        return
    down = True
    for inner in [*swaps(n - 1), None]:
        yield from (range(n - 2, -1, -1) if down else range(n - 1))
        if inner is not None:
            # the wanderer stands at an end: first (others one to the right), or last
            yield inner + (1 if down else 0)
        down = not down


def walk(cells: np.ndarray, names: str = NAMES) -> tuple[list[str], np.ndarray]:
    """Orders in the order of the walk, and kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley of each of their steps.

    ``cells`` has a row a mask (2^filters) with its documents, good and toxic ones.
    """
    f = len(names)
    masks = np.arange(1 << f)
    bits = [1 << (f - 1 - k) for k in range(f)]
    fails = [int(cells[(masks & b) > 0, 0].sum()) for b in bits]
    alone = [int(cells[b, 0]) for b in bits]
    order = list(range(f))
    lost = np.zeros((f, 3), np.int64)
    kept = np.zeros(f, np.int64)

    def count(step: int) -> None:
        before = sum(bits[k] for k in order[:step])
        here = ((masks & bits[order[step]]) > 0) & ((masks & before) == 0)
        lost[step] = cells[here].sum(0)
        kept[step] = (kept[step - 1] if step else cells[:, 0].sum()) - lost[step, 0]

    for step in range(f):
        count(step)
    orders, steps, shapley = [], [], np.zeros(f, np.int64)

    def visit() -> None:
        orders.append("".join(names[k] for k in order))
        shapley[order] += lost[:, 0]
        steps.append([(kept[s], lost[s, 0], fails[k] - lost[s, 0], alone[k], lost[s, 1], lost[s, 2], k) for s, k in enumerate(order)])

    visit()
    for at in swaps(f):
        order[at], order[at + 1] = order[at + 1], order[at]
        count(at)
        count(at + 1)
        visit()
    out = np.array(steps, np.int64)
    out[:, :, 6] = shapley[out[:, :, 6]]
    return orders, out


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", key: str = "doc_id", text: str = "text") -> DataFrame:
    """part, filter_order, step, and the counts of ``COUNTS``: a row for each part, order and step.

    A part's cells are at most 32 rows, whatever its size; parts are walked in tasks of
    their own. Texts are judged whole, however long; an empty table gives an empty one;
    for nulls and repeated rows see ``mask_cells``. Other columns aren't looked at.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        cells = np.zeros((1 << len(NAMES), 3), np.int64)
        cells[group["mask"]] = group[["n", "good", "toxic"]]
        orders, steps = walk(cells)
        out = pd.DataFrame(steps.reshape(-1, len(COUNTS)), columns=list(COUNTS))
        out.insert(0, "step", np.tile(np.arange(1, len(NAMES) + 1), len(orders)))
        out.insert(0, "filter_order", np.repeat(orders, len(NAMES)))
        out.insert(0, "part", group["part"].iloc[0])
        return out

    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)
    return mask_cells(docs, labels, part, key, text).groupBy("part").applyInPandas(run, schema)
