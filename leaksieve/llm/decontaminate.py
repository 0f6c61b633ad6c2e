"""Benchmark decontamination: an FM-index per shard of documents, searched for the test phrases."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, chunked, flat, handing_back, ranges, word_hashes, word_spans, written
from .fm_index import FMIndex

WINDOW = 13
#: Different windows searched for in one pass over the documents, in bytes of their words' hashes (a
#: million windows of 13 words); more make more passes.
BLOCK_BYTES = 104 << 20

#: Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing.
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True

_OUT = "doc_id long, tag long, n_words long, spans array<struct<start:long,end:long>>, items array<string>"
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def _words(column) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = flat(column)
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets, WORD)
    return word_hashes(data, starts, ends), first


class Phrases:
    """The different windows of a block, each with the ids of its items, over the block's own vocabulary."""

    def __init__(self, windows: pa.Array, owners: pa.Array, window: int):
        n = len(windows)
        windows = windows.cast(pa.large_binary())
        _, offsets, data = windows.buffers() if n else (None, bytes(8), b"")
        offsets = np.frombuffer(offsets, np.int64)[windows.offset : windows.offset + n + 1]
        hashes = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(np.uint64)
        self.lengths = np.diff(offsets) // 8
        self.vocabulary = np.unique(hashes)
        self.rows = np.zeros((n, window), np.int32)
        # shorter ones stand at the end of their row
        at = np.arange(n) * window + window - self.lengths
        self.rows.ravel()[ranges(at, self.lengths)] = np.searchsorted(self.vocabulary, hashes) + 1
        self.owners = owners
        # the phrases by their rarest word: a shard is searched for those alone whose rarest word it has
        often = np.bincount(self.rows.ravel(), minlength=len(self.vocabulary) + 1)
        often[0] = len(hashes) + 1
        rarest = self.rows[np.arange(n), often[self.rows].argmin(1)] if n else np.zeros(0, np.int32)
        self.by_rarest = np.argsort(rarest, kind="stable").astype(np.int32)
        self.opens = np.searchsorted(rarest[self.by_rarest], np.arange(len(self.vocabulary) + 2)).astype(np.int32)

    def possible(self, symbols: np.ndarray) -> np.ndarray:
        """The phrases all of whose words are among these symbols."""
        present = np.zeros(len(self.vocabulary) + 1, bool)
        present[symbols] = True
        words = np.flatnonzero(present[1:]) + 1
        present[0] = True  # what stands before a short phrase in its row
        starts = self.opens[words].astype(np.int64)
        some = self.by_rarest[ranges(starts, self.opens[words + 1] - starts)]
        return some[present[self.rows[some]].all(1)]

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word in the vocabulary, 0 for all others."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def occurrences(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word position and window of every occurrence in a shard of documents.

        The index holds the shard's runs of vocabulary words that are long enough for
        the shortest window: no window lies anywhere else.
        """
        none = np.zeros(0, np.int64)
        if not len(self.rows) or not len(words):
            return none, none
        symbols = self.symbols(words)
        new = np.concatenate([[True], (symbols[1:] > 0) != (symbols[:-1] > 0)])
        new[first[first < len(words)]] = True
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(words)))
        keep = (symbols[starts] > 0) & (sizes >= self.lengths.min())
        if not keep.any():
            return none, none
        starts, sizes = starts[keep], sizes[keep]
        places = ranges(starts, sizes + 1)  # a separator follows each run
        seq = symbols[np.minimum(places, len(words) - 1)]
        seq[np.cumsum(sizes + 1) - 1] = 0
        some = self.possible(seq)
        if not len(some):
            return none, none
        used, numbered = np.unique(seq, return_inverse=True)  # 0, the separator, comes first
        index = FMIndex(numbered, len(used))
        lo, hi = index.search(np.searchsorted(used, self.rows[some]), self.lengths[some])
        found = index.locate(ranges(lo, hi - lo))
        return places[found], np.repeat(some, hi - lo)


def _scan(batches, phrases: Phrases):
    for batch in chunked(batches):
        words, first = _words(batch.column("text"))
        at, window = phrases.occurrences(words, first)
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + phrases.lengths[window], -1)
        hit = np.concatenate([np.cumsum(edge[:-1]) > 0, [False]])
        new = np.concatenate([[True], hit[1:] != hit[:-1]])
        new[first] = True
        opens = np.flatnonzero(new & hit)
        closes = np.flatnonzero(new)
        closes = closes[np.searchsorted(closes, opens, "right")] if len(opens) else opens
        doc = np.searchsorted(first, opens, "right") - 1
        pairs = np.unique(np.stack([np.searchsorted(first, at, "right") - 1, window]), axis=1)
        items: list[set] = [set() for _ in range(batch.num_rows)]
        for d, w in pairs.T:
            items[d].update(phrases.owners[w].as_py())
        counts = np.bincount(doc, minlength=batch.num_rows)
        spans = pa.StructArray.from_arrays(
            [pa.array(opens - first[doc]), pa.array(closes - first[doc])], fields=list(_SPAN)
        )
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("tag"),
                pa.array(np.diff(first)),
                pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), spans),
                pa.array([sorted(x) for x in items], pa.list_(pa.string())),
            ],
            names=["doc_id", "tag", "n_words", "spans", "items"],
        )


_WINDOWS = "window binary, item string"


def _windows(batches, window: int):
    """Every window of every item, as the hashes of its words."""
    for batch in chunked(batches, limit=1 << 16):
        hashes, first = _words(batch.column("text"))
        n = np.diff(first)
        many = np.where(n > 0, np.maximum(1, n - window + 1), 0)
        item = np.repeat(np.arange(batch.num_rows), many)
        starts = first[item] + ranges(np.zeros(batch.num_rows, np.int64), many)
        sizes = np.minimum(window, first[item + 1] - starts)
        data = hashes[ranges(starts, sizes)].astype(np.uint64).tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes * 8)]).astype(np.int64)
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(item), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)])
        yield pa.RecordBatch.from_arrays([found.cast(pa.binary()), batch.column("item").take(pa.array(item))], names=["window", "item"])


def _counted(batches):
    for batch in chunked(batches):
        _, first = _words(batch.column("text"))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("tag"), pa.array(np.diff(first))], names=["doc_id", "tag", "n_words"]
        )


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, tagged: bool = False
) -> DataFrame:
    """The test phrases in each document: ``doc_id, n_words, spans, items``.

    A phrase is ``window`` consecutive words of an item, or all words of a shorter one.
    ``spans`` are the merged runs of words inside any occurrence, as word numbers, end
    exclusive; ``items`` the ids of the items found, in order. Documents are cut into
    shards of about 1 MB; each shard's FM-index is searched for all phrases at once whose
    rarest word the shard has, and occurrences are located by sampled suffix positions. The
    different phrases are made by Spark tasks and go out in blocks of ``block_bytes``, so what
    the driver and a task hold is bounded; a further block costs a further pass, whose hits are
    written before the next block is made, and a join to the rows.

    A null or empty text has no words and no spans; items without words match nothing;
    an item without an id marks words but is not listed. A row per input row comes back,
    whatever the number of blocks. Other columns are not looked at. With ``tagged`` a column ``tag``, the hash of the text, tells rows of one id apart.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), F.xxhash64("text").alias("tag"))
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("text"))
    distinct = items.mapInArrow(lambda batches: handing_back(_windows(batches, window)), _WINDOWS).groupBy("window").agg(F.collect_set("item").alias("items"))
    phrases = written(distinct, "benchmark-windows")
    size = phrases.agg(F.sum(F.octet_length("window"))).first()[0] or 0
    n_blocks = max(1, -(-size // block_bytes))

    def sent(block: int):
        table = phrases.where(F.pmod(F.xxhash64("window"), F.lit(n_blocks)) == block).toArrow()
        return spark.sparkContext.broadcast(Phrases(table.column("window").combine_chunks(), table.column("items").combine_chunks(), window))

    def scanned(block) -> DataFrame:
        return own.mapInArrow(lambda batches: handing_back(_scan(batches, block.value)), _OUT)

    if n_blocks == 1:
        return scanned(sent(0)).drop(*([] if tagged else ["tag"]))
    found = None
    for number in range(n_blocks):
        block = sent(number)
        hits = written(scanned(block).where(F.size("spans") > 0).drop("n_words").distinct(), "benchmark-hits")
        block.destroy()
        found = hits if found is None else found.unionByName(hits)
    # the hits of each id and text, once, for however many rows have them
    same = [F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("tag").alias("_tag")]
    merged = found.groupBy(*same).agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    joined = F.aggregate(
        "spans",
        F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= s["start"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(
                    F.struct(
                        F.element_at(done, -1)["start"].alias("start"),
                        F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end"),
                    )
                ),
            ),
        ).otherwise(F.concat(done, F.array(s))),
    )
    merged = merged.withColumn("spans", joined)
    rows = own.mapInArrow(lambda batches: handing_back(_counted(batches)), "doc_id long, tag long, n_words long")
    every = rows.join(merged, (F.coalesce(rows["doc_id"], F.lit(0)) == merged["_id"]) & (rows["tag"] == merged["_tag"]), "left")
    return every.select(
        "doc_id",
        *(["tag"] if tagged else []),
        "n_words",
        F.coalesce("spans", F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")).alias("spans"),
        F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"),
    )


def contamination(hits: DataFrame) -> DataFrame:
    """The figures of ``benchmark_hits`` and the verdict: a twentieth of the words or more is hit; a ``tag`` is kept."""
    tag = [c for c in hits.columns if c == "tag"]
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return hits.select(
        "doc_id",
        *tag,
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        "spans",
    ).select(
        "doc_id", *tag, "n_words", "n_hit", "n_items", "items_sha256",
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        "spans",
    )
