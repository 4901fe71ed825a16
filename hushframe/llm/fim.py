"""Fill-in-the-middle: texts cut into prefix, middle and suffix at token boundaries, and put together in another order.

Whole batches are cut at once, on the UTF-8 buffers that Arrow hands over: a table
of 256 byte classes, a mask of bytes that begin a token (from each byte and the one
before it), its running sum, which each document reads from its own first byte on, and
one searchsorted for the cuts of all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts so many are cut, and of a hundred cut ones so many have the suffix first.
CUT_PERCENT, SPM_PERCENT = 90, 20
SEED = 1
#: Bytes of text that one kernel call works on (a longer text is a call of its own).
SLICE = 1 << 24
LETTER, INNER = 1, 2
_BYTES = np.arange(256)
#: Class of a byte: letter, inner byte of a character, or anything else.
CLASS = (((_BYTES | 32) >= ord("a")) & ((_BYTES | 32) <= ord("z"))).astype(np.uint8) * LETTER + ((_BYTES & 0xC0) == 0x80).astype(np.uint8) * INNER
MADE = "n long, form string, output string, prefix_chars long, middle_chars long"


def cuts(ends: np.ndarray, data: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens a document, the bytes at which its prefix and its middle end, and code points before each byte.

    Document i is ``data[ends[i]:ends[i + 1]]``; the prefix has the smaller, prefix and
    middle together the larger of ``first`` and ``second`` modulo (tokens + 1) tokens.
    """
    kind = CLASS[data]
    begins = kind != INNER
    chars = np.concatenate([[0], np.cumsum(begins)])
    begins[1:] &= (kind[1:] != LETTER) | (kind[:-1] != LETTER)
    begins[ends[:-1][ends[:-1] < ends[1:]]] = True
    total = np.cumsum(begins)
    before = np.concatenate([[0], total])
    base = before[ends[:-1]]
    n = before[ends[1:]] - base
    a, b = first % (n + 1), second % (n + 1)

    def byte(k: np.ndarray) -> np.ndarray:
        return np.where(k < n, np.searchsorted(total, base + k + 1), ends[1:])

    return n, byte(np.minimum(a, b)), byte(np.maximum(a, b)), chars


def _transformed(text: pa.StringArray, h: list[np.ndarray], cut_percent: int, spm_percent: int) -> list[pa.Array]:
    offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    raw = text.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    ends = offsets - offsets[0]
    n, one, two, chars = cuts(ends, data, h[0], h[1])
    marked = np.logical_or.reduce([pc.match_substring(text, m).to_numpy(zero_copy_only=False) for m in (PREFIX, SUFFIX, MIDDLE)])
    plain = (n == 0) | marked | (h[2] % 100 >= cut_percent)
    spm = h[3] % 100 < spm_percent
    # prefix, middle and suffix of every text lie one after another in the same buffer
    bounds = np.append(np.stack([ends[:-1], one, two], 1).ravel(), ends[-1]).astype(np.int32)
    parts = pa.StringArray.from_buffers(3 * len(text), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data)))
    at = np.arange(len(text)) * 3
    p, m, s = (parts.take(pa.array(at + k)) for k in range(3))
    psm = pc.binary_join_element_wise(PREFIX, p, SUFFIX, s, MIDDLE, m, "")
    other = pc.binary_join_element_wise(SUFFIX, s, PREFIX, p, MIDDLE, m, "")
    output = pc.if_else(pa.array(plain), text, pc.if_else(pa.array(spm), other, psm))
    form = pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm")), pa.string())
    return [pa.array(n, pa.int64()), form, output, pa.array(chars[one] - chars[ends[:-1]], pa.int64(), mask=plain), pa.array(chars[two] - chars[one], pa.int64(), mask=plain)]


def draws(key: Column, seed: int = SEED) -> list[Column]:
    """Four numbers below 2^32 from the SHA-256 of ``seed:key``; a null key counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, keep: list[str], key: str = "doc_id", text: str = "text", seed: int = SEED, cut_percent: int = CUT_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """``keep``, n (tokens), form, output, prefix_chars and middle_chars for every row.

    Tokens are runs of ASCII letters, and every other character alone. form is plain
    (the text as it is), psm (prefix, suffix, middle) or spm (suffix, prefix, middle);
    the two lengths are null where it is plain. A null text is an empty one, and plain;
    so is a text that holds one of the three marks, since it couldn't be put together
    again. Cuts depend on seed, key and text alone: reruns agree, repeated rows give
    equal rows, and a null key is an empty one. Texts are cut whole, however long;
    an empty table gives an empty one; only the columns ``keep`` are returned beside
    ours, whatever they are called.
    """
    fields = [docs.schema[c] for c in keep]
    schema = ", ".join([*(f"`k{i}` {f.dataType.simpleString()}" for i, f in enumerate(fields)), MADE])
    names = [*(f"k{i}" for i in range(len(fields))), "n", "form", "output", "prefix_chars", "middle_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(len(fields))), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                past = sizes[at - 1] if at else 0
                to = max(int(np.searchsorted(sizes, past + SLICE, "right")), at + 1)
                part = batch.slice(at, to - at)
                told = pc.fill_null(part.column(len(fields)), "")
                h = [c.to_numpy() for c in part.columns[len(fields) + 1 :]]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(fields)], *_transformed(told, h, cut_percent, spm_percent)], names=names)
                at = to

    asked = docs.select(*(docs[c].alias(f"k{i}") for i, c in enumerate(keep)), docs[text].alias("t"), *(h.alias(f"h{i}") for i, h in enumerate(draws(docs[key], seed))))
    return asked.mapInArrow(run, schema).toDF(*keep, *names[len(fields) :])


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of.

    No text that was cut holds a mark, and marks can't overlap (only their first
    character is a ``<``), so each mark is there once.
    """
    after = lambda c, mark: F.substring_index(c, mark, -1)
    until = lambda c, mark: F.substring_index(c, mark, 1)
    psm = F.concat(after(until(output, SUFFIX), PREFIX), after(output, MIDDLE), until(after(output, SUFFIX), MIDDLE))
    spm = F.concat(until(after(output, PREFIX), MIDDLE), after(output, MIDDLE), after(until(output, PREFIX), SUFFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
