"""SimHash near duplicates by a covering code.

Fingerprints within three bits differ in at most one bit in one of their halves. On a
half of 32 bits, a perfect Hamming code over 31 bits (the last bit free) serves as set
of anchors: every half lies within one bit of exactly one anchor, its home. A half is
copied to every anchor within covering radius plus threshold, 1 + 1 bits; so a half at
most one bit from another reaches the other's home, and the two meet there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, chunked, flat, handing_back, written
from .components import min_labels

SHINGLE = 3
MAX_BITS = 3
SEED = 42

_PRINTS = "doc_id long, fingerprint long"
_KEYED_PRINTS = "doc_id long, tag long, row long, fingerprint long"


def _fingerprint(words: list[bytes], shingle: int, seed: int) -> int:
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    hashed = xxhash.xxh64_intdigest
    h = np.array([hashed(g, seed) for g in grams], "<u8")
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def _prints(batches, shingle: int, seed: int, keep=("doc_id",)):
    # bytes split at ASCII white space only, unlike text
    for batch in chunked(batches):
        data, offsets = flat(batch.column("text"))
        data = LOWER[data].tobytes()
        out = [_fingerprint(data[a:b].split(), shingle, seed) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.int64())], names=[*keep, "fingerprint"])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``doc_id, fingerprint`` (64 bits as a long): bitwise majority over the hashed word shingles.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased. Shingles count
    as often as they occur; a text of fewer words is one shingle, a text without words
    (null too) has fingerprint 0. Other columns are not looked at.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return own.mapInArrow(lambda batches: handing_back(_prints(batches, shingle, seed)), _PRINTS)


# The parity check of a Hamming code over 31 bits: bit i stands for the number i + 1.
_CHECK = [sum(1 << i for i in range(31) if (i + 1) >> r & 1) for r in range(5)]
_PAIRS = np.zeros((32, 15), np.uint32)
for _s in range(1, 32):
    _seen = sorted({tuple(sorted((a, a ^ _s))) for a in range(1, 32) if a != _s and a ^ _s})
    _PAIRS[_s] = [(1 << (a - 1)) | (1 << (b - 1)) for a, b in _seen]


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each 32-bit half its home, and the anchors within two bits (a repeated one fills up).

    The error number of the low 31 bits says which bit to turn for the nearest code
    word (none if it is 0); the next ones are two turned bits away. The free bit may
    differ too.
    """
    error = np.zeros(len(half), np.uint32)
    for r, mask in enumerate(_CHECK):
        error |= (np.bitwise_count(half & np.uint32(mask)).astype(np.uint32) & np.uint32(1)) << np.uint32(r)
    turn = np.where(error > 0, np.uint32(1) << (np.maximum(error, 1) - np.uint32(1)), np.uint32(0)).astype(np.uint32)
    home = half ^ turn
    free = np.uint32(1 << 31)
    near = np.where((error > 0)[:, None], half[:, None] ^ _PAIRS[error], home[:, None])
    return home, np.concatenate([home[:, None], (home ^ free)[:, None], near], axis=1).astype(np.uint32)


_REPLICAS = "anchor long, fingerprint long, home boolean"


def _replicas(batches):
    for batch in batches:
        for a in range(0, batch.num_rows, 20_000):
            prints = batch.column("fingerprint").slice(a, 20_000).to_numpy(zero_copy_only=False)
            unsigned = prints.view(np.uint64)
            for half in (0, 1):
                home, near = anchors((unsigned >> np.uint64(32 * half)).astype(np.uint32))
                own = np.ones(near.shape, bool)
                own[:, 2:] = near[:, 2:] != home[:, None]  # the fill
                at = near[own].astype(np.int64) | (half << 32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at), pa.array(np.repeat(prints, own.sum(axis=1))), pa.array(near[own] == np.repeat(home, own.sum(axis=1)))],
                    names=["anchor", "fingerprint", "home"],
                )


_LINKS = "a long, b long"
#: Fingerprints compared with as many others at once; where all are close a pair takes some 40 bytes.
_BLOCK = 512


def _group_links(prints: np.ndarray, home: np.ndarray, max_bits: int):
    """Links that join what is connected at one anchor: at most one per member, two at a member.

    Members at home are held against all, in blocks; which are connected is followed by
    labels, and each class becomes a path.
    """
    prints = prints.view(np.uint64)
    label = np.arange(len(prints))
    mine = np.flatnonzero(home)
    changed = True
    while changed:
        before = label.copy()
        for a in range(0, len(mine), _BLOCK):
            rows = mine[a : a + _BLOCK]
            for b in range(0, len(prints), _BLOCK):
                close = np.bitwise_count(prints[rows, None] ^ prints[None, b : b + _BLOCK]) <= max_bits
                i, j = np.nonzero(close)
                low = np.minimum(label[rows[i]], label[b + j])
                np.minimum.at(label, rows[i], low)
                np.minimum.at(label, b + j, low)
        while (label[label] != label).any():
            label = label[label]
        changed = (label != before).any()
    order = np.argsort(label, kind="stable")
    same = label[order[1:]] == label[order[:-1]]
    return order[:-1][same], order[1:][same]


def _links(batches, max_bits: int):
    """Anchors come in order; one that goes on in the next batch is held over."""
    held = None

    def found(anchor, prints, home):
        cuts = np.flatnonzero(np.diff(anchor)) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(anchor)]])
        homes = np.concatenate([[0], np.cumsum(home)])
        for s, e in zip(*((x[(ends - starts > 1) & (homes[ends] > homes[starts])]) for x in (starts, ends))):
            a, b = _group_links(prints[s:e], home[s:e], max_bits)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(prints[s:e][a]), pa.array(prints[s:e][b])], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "fingerprint", "home")]
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now)]
        last = np.searchsorted(now[0], now[0][-1])
        held = [x[last:] for x in now]
        if last:
            yield from found(*(x[:last] for x in now))
    if held is not None:
        yield from found(*held)


def links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links ``a, b`` between different fingerprints that join all within ``max_bits`` of one another.

    Not every close pair is listed: at each anchor the pairs are compared, and what they
    connect is passed on as a path, so no group yields more links than members.
    """
    if max_bits > 3:
        raise ValueError("halves that meet within one bit stand for at most three bits in all")
    distinct = prints.select("fingerprint").distinct()
    replicas = distinct.mapInArrow(lambda batches: handing_back(_replicas(batches)), _REPLICAS)
    met = replicas.repartition("anchor").sortWithinPartitions("anchor")
    return met.mapInArrow(lambda batches: handing_back(_links(batches, max_bits)), _LINKS).distinct()


def _members(prints: DataFrame, order: Column, max_bits: int) -> DataFrame:
    """``fingerprint, first, label``: the least ``order`` of each fingerprint, and its component's label."""
    labels = min_labels(written(links(prints, max_bits), "simhash-links"))
    first = prints.groupBy("fingerprint").agg(F.min(order).alias("first"))
    return written(
        first.join(labels, first["fingerprint"] == labels["id"], "left").select(
            "fingerprint", "first", F.coalesce("label", "fingerprint").alias("label")
        ),
        "simhash-members",
    )


def first_rows(docs: DataFrame, row: Column, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, tag, row`` of the first row of each component: by doc_id, no id last, by the text's hash, by ``row``."""
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tag"), row.alias("row"), F.col("text").alias("text")
    )
    keyed = own.mapInArrow(lambda batches: handing_back(_prints(batches, shingle, SEED, ("doc_id", "tag", "row"))), _KEYED_PRINTS)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag", "row")
    first = _members(written(keyed, "simhash-fingerprints"), order, max_bits).groupBy("label").agg(F.min("first").alias("first"))
    return first.select("first.doc_id", "first.tag", "first.row")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    Documents whose fingerprints differ in at most ``max_bits`` bits are linked; the
    component is the smallest doc_id reachable over links, its own included. Texts
    without words all have fingerprint 0 and are linked like any other. Rows with the
    same doc_id are judged each by its text; rows without a doc_id take part but name no
    component (null if nobody else does).

    Copies meet as one fingerprint. Fingerprints, links and labels are written to the
    shared folder, so lost executors cost a stage at most.
    """
    prints = written(fingerprints(docs, shingle), "simhash-fingerprints")
    member = _members(prints, F.col("doc_id"), max_bits)
    smallest = member.groupBy("label").agg(F.min("first").alias("component_id"))
    named = written(member.join(written(smallest, "simhash-smallest"), "label").select("fingerprint", "component_id"), "simhash-components")
    return prints.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")
