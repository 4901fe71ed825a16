"""A record as HTML, for one collected row."""

from __future__ import annotations

import html
import zlib

from pyspark.sql import DataFrame, Row

from .. import schemas

COLORS = ("#2563eb", "#16a34a", "#d97706", "#dc2626", "#7c3aed", "#0891b2", "#be185d", "#4d7c0f")


def color_of(label: str) -> str:
    return COLORS[zlib.crc32(label.encode()) % len(COLORS)]


def highlighted(text: str, entities: list) -> str:
    """The text with its spans boxed; spans that overlap one before, or don't fit, are left plain."""
    out, at = [], 0
    for e in sorted(entities, key=lambda e: (e["start_position"], e["end_position"])):
        start, end = e["start_position"], e["end_position"]
        if start < at or end <= start or end > len(text):
            continue
        out.append(html.escape(text[at:start]))
        out.append(f'<mark style="border:1px solid {color_of(e["label"])}">{html.escape(text[start:end])}<sub>{html.escape(e["label"])}</sub></mark>')
        at = end
    return "".join([*out, html.escape(text[at:])])


def record_html(row: Row) -> str:
    r = row.asDict(recursive=True)
    parts = [f"<h4>Original</h4><p>{highlighted(r[schemas.TEXT] or '', r.get(schemas.FINAL) or [])}</p>"]
    if r.get(schemas.OUTPUT) is not None:
        parts.append(f"<h4>Result</h4><p>{html.escape(r[schemas.OUTPUT])}</p>")
    if pairs := r.get(schemas.MAP):
        cells = "".join(f"<tr><td>{html.escape(p['original'])}</td><td>{html.escape(p['label'])}</td><td>{html.escape(p['synthetic'])}</td></tr>" for p in pairs)
        parts.append(f"<table><tr><th>original</th><th>label</th><th>synthetic</th></tr>{cells}</table>")
    scores = {k: r[k] for k in ("utility_score", "leakage_mass", "weighted_leakage_rate", "any_high_leaked", "needs_human_review", "detection_valid") if k in r}
    if scores:
        parts.append("<ul>" + "".join(f"<li>{k}: {html.escape(str(v))}</li>" for k, v in scores.items()) + "</ul>")
    return "<div>" + "".join(parts) + "</div>"


def show(trace: DataFrame, index: int = 0) -> str:
    """The record at ``index`` in the order of record ids."""
    rows = trace.orderBy(schemas.RECORD_ID).offset(index).limit(1).collect()
    if not rows:
        raise IndexError(f"no record {index}")
    return record_html(rows[0])
