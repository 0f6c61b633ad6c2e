"""Byte-level removal of repeated strings by a depth-limited radix sort of suffixes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Prefix, mix, ranges
from .repeats import GROUP, Windows, joined, repeated_spans, with_spans

THRESHOLD = 200
#: Bytes of a digit of the radix sort.
DIGIT = 50
GRAM = 32


def _sorted_out(batch: pa.RecordBatch, c: dict, spec: Windows):
    """Most significant digit first: suffixes are ordered digit by digit, through the threshold only.

    A digit stands for its bytes by a 64-bit hash. Suffixes alone in their group leave
    after each pass; the groups left after the last are the repeated windows.
    """
    _, values, _, _, first = spec.units(batch.column("text"))
    n = c["n"].astype(np.int64)
    piece = np.repeat(np.arange(len(n)), n)
    at = ranges(first[:-1], n)
    _, group = np.unique(c["anchor"][piece], return_inverse=True)
    weight = np.where(c["many"], 2, 1)
    digits = Prefix(values)
    for low in range(0, spec.window, DIGIT):
        digit = mix(digits.spans(at + low, at + min(low + DIGIT, spec.window)))
        order = np.lexsort((digit, group))
        digit, group = digit[order], group[order]
        new = np.concatenate([[True], (digit[1:] != digit[:-1]) | (group[1:] != group[:-1])])[: len(order)]
        group = np.cumsum(new) - 1
        alive = np.bincount(group, weights=weight[piece[order]])[group] > 1
        order, group = order[alive], group[alive]
        piece, at = piece[order], at[order]
        if not len(piece):
            return None
    # the windows of a piece start closer together than a window is long
    offset = at - first[piece]
    low, high = np.full(len(n), 1 << 60), np.full(len(n), -1)
    np.minimum.at(low, piece, offset)
    np.maximum.at(high, piece, offset)
    hit = np.flatnonzero((high >= 0) & ~c["many"])
    start = c["start"][hit]
    return c["doc_id"][hit], c["tag"][hit], start + low[hit], start + high[hit] + spec.window


def repeated_bytes(docs: DataFrame, threshold: int = THRESHOLD, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """``doc_id, text, spans`` for every row: byte ranges (UTF-8) inside strings of ``threshold`` bytes that also start elsewhere.

    Elsewhere is any other place, in the same or another row; overlaps count. Null text
    is empty, and texts shorter than the threshold have no spans. Rows alike in id and
    text are two places. ``spans`` are not merged, null for none; see ``repeats`` for
    how places meet. Two strings count as equal if four 64-bit hashes of their quarters
    agree. Other columns are not looked at.
    """
    spec = Windows(threshold, min(gram, threshold), words=False)
    return with_spans(docs, repeated_spans(docs, spec, _sorted_out, earliest=False, group=group))


def _cut(batches):
    for batch in batches:
        out = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            data = (text or "").encode()
            gone = joined((s["start"], s["end"]) for s in spans or ())
            kept, at = [], 0
            for start, end in gone:
                kept.append(data[at:start])
                at = end
            kept.append(data[at:])
            out.append((len(data), sum(b - a for a, b in gone), len(gone), hashlib.sha256(b"".join(kept)).hexdigest()))
        columns = list(zip(*out)) if out else [[], [], [], []]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in columns[:3]], pa.array(columns[3], pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def removal(found: DataFrame) -> DataFrame:
    """What ``repeated_bytes`` takes away: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""
    return found.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
