"""Word-level removal of later copies of passages by matching statistics over an FM-index."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Prefix, mix, ranges
from .fm_index import FMIndex
from .repeats import GROUP, Windows, first_of_equal, joined, repeated_spans, with_spans

THRESHOLD = 20
GRAM = 6


def _matched(batch: pa.RecordBatch, c: dict, spec: Windows):
    """A shard is what meets at some anchors; its pieces are streamed through its own index.

    Equal pieces go in once, as their earliest place. Each piece is read from its end:
    a full backward search gives the interval of its last window. For the window before,
    the interval is widened to one word less, and extended by the word in front: the
    matching statistics, kept at the threshold. The smallest place in an interval is the
    window's first.
    """
    window = spec.window
    _, values, _, _, first = spec.units(batch.column("text"))
    n = c["n"].astype(np.int64)
    doc = np.unique(np.stack([c["doc_id"], c["tag"]], axis=1), axis=0, return_inverse=True)[1].ravel()
    place = (doc << 40) + c["start"]
    a, b = spec.digests(values, first[:-1], n + window - 1)
    rows, new, _ = first_of_equal(a, b, place)
    heads = rows[new]
    later = rows[~new & (place[rows] != place[heads[np.cumsum(new) - 1]])]

    # the index over the earliest pieces, a separator behind each
    sizes = n[heads] + window - 1
    words, ids = np.unique(values, return_inverse=True)
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    total = int((sizes + 1).sum())
    seq = np.zeros(total, np.int64)
    inside = ranges(begin, sizes)
    seq[inside] = ids[ranges(first[heads], sizes)] + 1
    index = FMIndex(seq, len(words) + 1, depth=window)

    # rows of the index whose suffixes agree in one word less than the threshold
    shorter = np.concatenate([Prefix(mix(seq.astype(np.uint64))).rolling(window - 1), mix(np.arange(window - 1, dtype=np.uint64))])
    shorter = shorter[np.minimum(index.suffixes, len(shorter) - 1)]
    opens = np.flatnonzero(np.concatenate([[True], shorter[1:] != shorter[:-1]]))
    opens_at = np.append(opens, len(shorter))
    interval = np.repeat(np.arange(len(opens)), np.diff(opens_at))

    order = np.zeros(total + 1, np.int64)
    order[:] = np.iinfo(np.int64).max
    order[inside] = np.repeat(place[heads], sizes) + ranges(np.zeros(len(heads), np.int64), sizes)
    order = order[index.suffixes]

    left = n[heads] - 1  # the window each piece is at
    ends = begin + left
    rows_of = seq[ends[:, None] + np.arange(window)[None, :]]
    lo, hi = index.search(rows_of, np.full(len(heads), window))
    where, at_lo, at_hi = [], [], []
    on = np.arange(len(heads))
    while len(on):
        where.append(begin[on] + left[on])
        at_lo.append(lo[on])
        at_hi.append(hi[on])
        left[on] -= 1
        on = on[left[on] >= 0]
        wider = interval[lo[on]]
        word = np.zeros((len(on), 1), np.int64)
        word[:, 0] = seq[begin[on] + left[on]]
        lo[on], hi[on] = index.extend(word[:, 0], opens_at[wider], opens_at[wider + 1])
    where, at_lo, at_hi = (np.concatenate(x) for x in (where, at_lo, at_hi))
    starts, inverse = np.unique(at_lo, return_inverse=True)
    stops = np.zeros(len(starts), np.int64)
    stops[inverse] = at_hi
    edges = np.stack([starts, stops], axis=1).ravel()
    edges = edges[:-1] if edges[-1] == len(order) else edges
    earliest = np.minimum.reduceat(order, edges)[::2][inverse]

    piece = np.searchsorted(begin, where, "right") - 1
    offset = where - begin[piece]
    late = earliest < place[heads[piece]] + offset
    low, high = np.full(len(heads), 1 << 60), np.full(len(heads), -1)
    np.minimum.at(low, piece[late], offset[late])
    np.maximum.at(high, piece[late], offset[late])
    hit = np.flatnonzero(high >= 0)
    some = heads[hit]
    return (
        np.concatenate([c["doc_id"][some], c["doc_id"][later]]),
        np.concatenate([c["tag"][some], c["tag"][later]]),
        np.concatenate([c["start"][some] + low[hit], c["start"][later]]),
        np.concatenate([c["start"][some] + high[hit] + window, c["start"][later] + n[later] + window - 1]),
    )


def repeated_words(docs: DataFrame, threshold: int = THRESHOLD, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """``doc_id, text, spans`` for every row: word ranges inside windows of ``threshold`` words that also start earlier.

    Words are runs of bytes other than ASCII white space. Earlier is a smaller doc_id,
    or the same document and a smaller start. Rows that differ in text under one id are
    taken in the order of a hash of their texts, rows alike in both are one document;
    rows without an id come before all others. Null text has no words. ``spans`` are not
    merged, null for none. Words count as equal if their 64-bit hashes are. Other columns
    are not looked at.
    """
    spec = Windows(threshold, min(gram, threshold), words=True)
    return with_spans(docs, repeated_spans(docs, spec, _matched, earliest=True, group=group))


def _cut(batches):
    for batch in batches:
        out = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            words = (text or "").encode().split()
            gone = joined((s["start"], s["end"]) for s in spans or ())
            kept, at = [], 0
            for start, end in gone:
                kept += words[at:start]
                at = end
            kept += words[at:]
            out.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        columns = list(zip(*out)) if out else [[], [], []]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in columns[:2]], pa.array(columns[2], pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_sha256"],
        )


def removal(found: DataFrame) -> DataFrame:
    """What ``repeated_words`` takes away: ``doc_id, n_words, n_removed, kept_sha256``."""
    return found.mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_sha256 string")
