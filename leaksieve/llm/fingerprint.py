"""Document fingerprints: one-permutation MinHash with optimal densification and packed low bits."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK, NOT_SPACE, Prefix, mix, word_hashes, word_spans

SHINGLE = 5
#: Bins of a fingerprint, and low bits kept of each.
BINS = 512
BITS = 4

_LOWEST = -(2**63)


@lru_cache(maxsize=2)
def _probes(bins: int) -> np.ndarray:
    """For each bin the order in which it looks for another that is not empty."""
    return np.argsort(np.random.Generator(np.random.PCG64(11)).random((bins, bins)), axis=1)


def prints(texts: list[bytes], shingle: int = SHINGLE, bins: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """The low four bits of each bin's least shingle hash (a row a text), and which texts have words.

    Each shingle is hashed once: the high bits say its bin, the rest competes in it. A
    text of fewer words than a shingle is one shingle. An empty bin takes the value of
    the first full one in its own fixed random order, the same for all texts.
    """
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
    starts, ends, first = word_spans(data, offsets, NOT_SPACE)
    words = Prefix(word_hashes(data, starts, ends))
    counts = np.diff(first)
    number = np.where(counts > 0, np.maximum(counts - shingle + 1, 1), 0)
    doc = np.repeat(np.arange(len(texts)), number)
    at = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
    hashes = mix(words.spans(at, at + np.minimum(counts[doc], shingle)))
    width = np.uint64(64 - (bins.bit_length() - 1))
    empty = np.uint64(2**64 - 1)
    least = np.full((len(texts), bins), empty, np.uint64)
    np.minimum.at(least, (doc, (hashes >> width).astype(np.int64)), hashes & ((np.uint64(1) << width) - np.uint64(1)))
    full = least != empty
    rows, columns = np.nonzero(~full & (counts > 0)[:, None])
    order = _probes(bins)
    for step in range(bins):
        if not len(rows):
            break
        source = order[columns, step]
        ok = full[rows, source]
        least[rows[ok], columns[ok]] = least[rows[ok], source[ok]]
        rows, columns = rows[~ok], columns[~ok]
    return (mix(least) & np.uint64((1 << BITS) - 1)).astype(np.uint8), counts > 0


def packed(values: np.ndarray, has: np.ndarray) -> list[str]:
    """Two bins a byte, in hex; empty for a text without words."""
    both = values[:, 0::2] << 4 | values[:, 1::2]
    return [row.tobytes().hex() if h else "" for row, h in zip(both, has)]


def likeness(a: np.ndarray, a_has: np.ndarray, b: np.ndarray, b_has: np.ndarray) -> np.ndarray:
    """The share of equal shingles: of equal bins, less what equal low bits give by chance.

    Two texts without words are alike (1), one with and one without are not (0).
    """
    chance = 1 / (1 << BITS)
    alike = np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0, 1)
    return np.where(a_has & b_has, alike, (a_has == b_has).astype(float))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fingerprint`` for every row: 512 bins of four bits in hex, empty without words (or text)."""

    def made(batches):
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            for part in _parts(texts):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(part.start, len(part)), pa.array(packed(*prints([texts[i] for i in part], shingle)))],
                    names=["doc_id", "fingerprint"],
                )

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return own.mapInArrow(made, "doc_id long, fingerprint string")


def _parts(texts: list[bytes]):
    """Ranges of texts of about a chunk together, and of at most 4096."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK or i - start >= 4095:
            yield range(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield range(start, len(texts))


_DEALT = "part int, guest boolean, doc_id long, tag long, text string"


class Ranges:
    """Parts of the rows in order of doc_id, rows of one id in falling order of ``tag``.

    Made of quantiles of doc_id. An id that several of them name has so many rows that its tags,
    which are spread evenly, are cut into as many ranges.
    """

    def __init__(self, quantiles: list[float]):
        self.ids, self.times = np.unique(np.array(quantiles, np.float64).astype(np.int64), return_counts=True)
        self.before = self.times.cumsum() - self.times

    def part(self, ids: np.ndarray, tags: np.ndarray) -> np.ndarray:
        if not len(self.ids):
            return np.zeros(len(ids), np.int32)
        at = np.searchsorted(self.ids, ids, "right") - 1
        times = self.times[at].astype(np.uint64)
        even = ~(tags.astype(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)
        within = np.where(ids == self.ids[at], (even * times >> np.uint64(32)).astype(np.int64), self.times[at] - 1)
        return np.where(at < 0, 0, 1 + self.before[at] + within).astype(np.int32)


def _key(ids: np.ndarray, tags: np.ndarray) -> list[tuple[int, int]]:
    """What rows are ordered by: the next document is the one with the next smaller key."""
    return list(zip(ids.tolist(), (-1 - tags).tolist()))


def _dealt(batches, bounds: Ranges, largest: dict[int, tuple[int, int]], after: dict[int, int]):
    """Each row to the part of its id; what comes next for another part goes there too, as a guest.

    Rows alike in id and text are one guest: it does not matter which of them comes next.
    """
    for batch in batches:
        ids, tags = batch.column("doc_id").to_numpy(), batch.column("tag").to_numpy()
        part = bounds.part(ids, tags)
        rest = [batch.column(c) for c in ("doc_id", "tag", "text")]
        names = ["part", "guest", "doc_id", "tag", "text"]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.zeros(len(part), bool)), *rest], names=names)
        first: dict[int, int] = {}
        for i, (p, key) in enumerate(zip(part.tolist(), _key(ids, tags))):
            if key == largest[p]:
                first.setdefault(p, i)
        guests = np.array(sorted(first.values()), np.int64)
        if len(guests):
            to = np.array([after[p] for p in part[guests].tolist()], np.int32)
            rows = pa.array(guests)
            yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(np.ones(len(guests), bool)), *[c.take(rows) for c in rest]], names=names)


_EDITED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _edited(batches, shingle: int):
    """Rows come by part, guests last, ids falling: the next row of the part is the next document."""

    def judged(rows):
        """All but the last row, which waits for its successor."""
        texts = [r[3] for r in rows]
        edits = []
        for text, following in zip(texts, texts[1:]):
            n = len(text) // 3
            edits.append(text[: len(text) - n] + following[:n])
        own, has = prints([t.encode() for t in texts], shingle)
        other, other_has = prints([t.encode() for t in edits], shingle)
        near_edited = likeness(own[:-1], has[:-1], other, other_has)
        near_next = likeness(own[:-1], has[:-1], own[1:], has[1:])
        mine, theirs = packed(own, has), packed(other, other_has)
        keep = [i for i in range(len(edits)) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
        out = [
            (
                None if rows[i][2] == _LOWEST else rows[i][2], len(texts[i]), hashlib.sha256(edits[i].encode()).hexdigest(),
                mine[i], theirs[i], float(near_edited[i]), float(near_next[i]),
            )
            for i in keep
        ]
        if out:
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            names = [c.split()[0] for c in _EDITED.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=names)

    rows, size = [], 0
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("part", "guest", "doc_id", "text")]
        for row in zip(*columns):
            rows.append((*row[:3], row[3] or ""))
            size += len(rows[-1][3])
            if size >= CHUNK or len(rows) >= 4096:
                yield from judged(rows)
                rows, size = rows[-1:], len(rows[-1][3])
    if len(rows) > 1:
        yield from judged(rows)


def edit_likeness(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Fingerprints of every text and of an edit of it, and how alike they and the next text's are.

    The edit puts, for the last third of a text's code points, as many from the start of
    the next document by falling doc_id (after the last comes the first). Columns:
    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next``. Null text is empty. Rows with the same doc_id follow each other by a
    hash of their texts; rows without an id come last. Other columns are not looked at.

    Rows are dealt to ranges of ids, and of text hashes where one id has many rows, and sorted
    there, so texts are shuffled once; the document that comes next for a whole range goes
    there as a guest. The driver holds two numbers for each range.
    """
    spark = docs.sparkSession
    own = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)).alias("doc_id"),
        F.xxhash64("text").alias("tag"),
        F.col("text").alias("text"),
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = own.select("doc_id")
    quantiles = ids.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.1 / parts) if parts > 1 else []
    bounds = Ranges(quantiles)
    tops = own.select("doc_id", "tag").mapInArrow(lambda batches: _tops(batches, bounds), "part int, id long, rest long")
    largest = {r.part: tuple(r.top) for r in tops.groupBy("part").agg(F.max(F.struct("id", "rest")).alias("top")).collect()}
    order = sorted(largest)
    after = {p: order[(i + 1) % len(order)] for i, p in enumerate(order)}
    dealt = own.mapInArrow(lambda batches: _dealt(batches, bounds, largest, after), _DEALT)
    sorted_rows = dealt.repartition(parts, "part").sortWithinPartitions("part", "guest", F.desc("doc_id"), "tag")
    return sorted_rows.mapInArrow(lambda batches: _edited(batches, shingle), _EDITED)


def _tops(batches, bounds: Ranges):
    top: dict[int, tuple[int, int]] = {}
    for batch in batches:
        ids, tags = batch.column("doc_id").to_numpy(), batch.column("tag").to_numpy()
        part = bounds.part(ids, tags)
        keys = _key(ids, tags)
        for p in np.unique(part).tolist():
            mine = np.flatnonzero(part == p)
            most = ids[mine].max()
            best = max(keys[i] for i in mine[ids[mine] == most].tolist())
            top[p] = max(best, top.get(p, best))
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(top), pa.int32()), pa.array([k[0] for k in top.values()], pa.int64()), pa.array([k[1] for k in top.values()], pa.int64())],
        names=["part", "id", "rest"],
    )
