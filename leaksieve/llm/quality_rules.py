r"""Quality rules: statistics of whole texts, base limits, and an isolation forest over them.

A tree of the forest splits a sample of rows at random values of random statistics until
each stands alone. Rows unlike the others stand alone after few splits, so the mean depth
over many trees, set against the depth that ordinary rows reach, scores how odd a document
is. The score from which a document goes is read off labelled rows.

Words are `[^\x20\x09-\x0D]+`, lines are split at `\n`.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, Prefix, byte_values, chunked, flat, mix, word_spans, written

#: What is counted in each text; the first five are those of the contract.
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_lower", "n_marks",
)
WINDOW = 5
#: A text of fewer words fails, and one with a greater percentage of words in repeated windows.
FEWEST_WORDS, MOST_REPEATED = 10, 20
#: The forest: trees, and rows that each is grown from. Their product bounds what is collected.
TREES, TREE_ROWS = 100, 256
#: The greatest share of labelled good rows that the forest may reject.
MOST_GOOD_LOST = 0.02
#: Steps of the scale on which scores are counted for the threshold.
STEPS = 2000

_SYMBOL, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
_MARK[np.r_[0x21:0x30, 0x3A:0x41, 0x5B:0x61, 0x7B:0x7F]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _per_document(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the keys equal an earlier one, and which equal any other."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    later, any_ = np.zeros((2, len(keys)), bool)
    later[order[1:][same]] = True
    any_[order[1:][same]] = any_[order[:-1][same]] = True
    return later, any_


def count_texts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """All ``COUNTS`` of the documents that stand one after the other in ``data``.

    Words, lines and windows are told apart by 64-bit hashes.
    """
    n = len(offsets) - 1
    starts, ends, first = word_spans(data, offsets, NOT_SPACE)
    out = {"n_words": np.diff(first)}
    in_word = NOT_SPACE[data]
    out["word_chars"] = _per_document(in_word & ((data & 0xC0) != 0x80), offsets)
    out["n_symbols"] = _per_document(_SYMBOL[data], offsets)
    out["n_upper"] = _per_document((data >= 0x41) & (data <= 0x5A), offsets)
    out["n_lower"] = _per_document((data >= 0x61) & (data <= 0x7A) | (data >= 0xC0), offsets)
    out["n_marks"] = _per_document(_MARK[data], offsets)
    out["n_lines"] = out["n_dup_lines"] = out["n_repeat_words"] = np.zeros(n, np.int64)
    if len(starts):
        prefix = Prefix(byte_values(3)[data])
        hashed = lambda a, b: mix(prefix.spans(a, b) + (b - a).astype(np.uint64) * _ODD)
        out["n_lines"], out["n_dup_lines"] = _lines(data, offsets, starts, hashed)
        out["n_repeat_words"] = _repeated_words(hashed(starts, ends), first)
    return {c: out[c] for c in COUNTS}


def _lines(data, offsets, words, hashed):
    """Lines with a word, and those that equal an earlier one, in each document."""
    n = len(offsets) - 1
    begin = np.unique(np.r_[offsets[:-1], np.flatnonzero(data == 0x0A) + 1])
    begin = begin[begin < len(data)]
    end = np.r_[begin[1:], len(data)]
    end = end - (data[end - 1] == 0x0A)
    full = np.searchsorted(words, end) > np.searchsorted(words, begin)
    begin, end = begin[full], end[full]
    of = np.searchsorted(offsets, begin, "right") - 1
    later, _ = _repeats(mix(hashed(begin, end) + of.astype(np.uint64) * _ODD))
    return np.bincount(of, minlength=n), np.bincount(of[later], minlength=n)


def _repeated_words(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words inside windows that occur twice or more in their document."""
    of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    windows = Prefix(words).rolling(WINDOW)
    inside = np.flatnonzero(of[WINDOW - 1 :][: len(windows)] == of[: len(windows)])
    windows = mix(mix(windows[inside]) + of[inside].astype(np.uint64) * _ODD)
    _, again = _repeats(windows)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, inside[again], 1)
    np.add.at(edges, inside[again] + WINDOW, -1)
    return _per_document(np.cumsum(edges[:-1]) > 0, first)


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunked(batches):
        found = count_texts(*flat(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, found.values())], ["doc_id", *COUNTS])


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the ``COUNTS`` of every whole text: one row per input row, no shuffle.

    Null and empty texts count nothing. Other columns are not looked at. A task holds about
    1 MB of text at once, or one document if that is longer.
    """
    schema = ", ".join(["doc_id long", *(f"{c} long" for c in COUNTS)])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_counted, schema)


def base_failed() -> Column:
    """Too few words, or too many of them in repeated windows."""
    return (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


#: The statistics: what is counted, out of what, and how much of the usual rate is mixed in.
#: Numbers and identifiers say little of quality, so digits are none of them.
RATES = (
    ("word_chars", ("n_words",), 20),
    ("n_symbols", ("n_words",), 20),
    ("n_dup_lines", ("n_lines",), 2),
    ("n_repeat_words", ("n_words",), 20),
    ("n_upper", ("n_upper", "n_lower"), 100),
    ("n_marks", ("word_chars",), 100),
)


def usual_rates(counts: dict[str, np.ndarray]) -> list[float]:
    """Each rate over all rows together."""
    whole = lambda names: float(sum(np.asarray(counts[c], float).sum() for c in names))
    return [whole((part,)) / max(whole(of), 1.0) for part, of, _ in RATES]


def features(counts: dict[str, np.ndarray], usual: list[float]) -> np.ndarray:
    """The rates of each document, a row per document.

    Some of the usual rate is mixed into each, so that a short text is not odd by chance. Square
    roots keep apart what is rare.
    """
    columns = []
    for (part, of, mixed), rate in zip(RATES, usual):
        whole = sum(np.asarray(counts[c], float) for c in of)
        columns.append(np.sqrt((np.asarray(counts[part], float) + mixed * rate) / (whole + mixed)))
    return np.column_stack(columns)


def _usual_depth(n) -> np.ndarray:
    """The mean depth of a row in a random tree over ``n`` rows."""
    n = np.asarray(n, float)
    harmonic = np.log(np.maximum(n - 1, 1)) + np.euler_gamma
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass(frozen=True)
class Forest:
    """Trees as arrays over all nodes; ``column`` is -1 at a leaf, whose ``split`` is the depth reached there."""

    roots: np.ndarray
    column: np.ndarray
    split: np.ndarray
    left: np.ndarray
    rows: int
    usual: list[float]

    def depths(self, points: np.ndarray) -> np.ndarray:
        """The mean depth at which each point ends."""
        total = np.zeros(len(points))
        for root in self.roots:
            at = np.full(len(points), root)
            going = np.flatnonzero(self.column[at] >= 0)
            while len(going):
                node = at[going]
                right = points[going, self.column[node]] >= self.split[node]
                at[going] = self.left[node] + right
                going = going[self.column[at[going]] >= 0]
            total += self.split[at]
        return total / len(self.roots)

    def scores(self, counts: dict[str, np.ndarray]) -> np.ndarray:
        """From 0, ordinary, to 1: set apart by the first splits."""
        points = features(counts, self.usual)
        return 2.0 ** (-self.depths(points) / max(float(_usual_depth(self.rows)), 1.0))


def grow(counts: dict[str, np.ndarray], trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = 11) -> Forest:
    """A forest over a bounded sample; each tree takes ``tree_rows`` of its rows, or all if there are fewer."""
    usual = usual_rates(counts)
    points = features(counts, usual)
    random = np.random.Generator(np.random.PCG64(seed))
    column, split, left, roots = [], [], [], []
    size = min(tree_rows, len(points))
    deepest = max(1, int(np.ceil(np.log2(max(size, 2)))))
    for _ in range(trees):
        rows = points[random.permutation(len(points))[:size]]
        roots.append(len(column))
        column.append(-1), split.append(0.0), left.append(0)
        open_ = [(roots[-1], rows, 0)]
        while open_:
            node, here, depth = open_.pop()
            low, high = (here.min(0), here.max(0)) if len(here) else (np.zeros(0), np.zeros(0))
            varied = np.flatnonzero(high > low)
            if depth >= deepest or not len(varied):
                split[node] = depth + float(_usual_depth(len(here)))
                continue
            c = int(random.choice(varied))
            at = random.uniform(low[c], high[c])
            right = here[:, c] >= at
            column[node], split[node], left[node] = c, float(at), len(column)
            for part in (here[~right], here[right]):
                open_.append((len(column), part, depth + 1))
                column.append(-1), split.append(0.0), left.append(0)
    return Forest(np.array(roots), np.array(column), np.array(split), np.array(left), size, usual)


def labelled(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """The statistics of labelled documents with ``good``.

    A document labelled more than once is good if at least half of its labels say so; null
    labels and null ids say nothing. Rows alike in id and statistics count once.
    """
    verdict = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality"))
        .where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg((F.avg("quality") >= 0.5).alias("good"))
    )
    return stats.distinct().join(verdict, "doc_id")


def fit(known: DataFrame, trees: int = TREES, tree_rows: int = TREE_ROWS) -> Forest | None:
    """A forest from at most ``trees * tree_rows`` labelled rows, those of the least hashes; None without rows."""
    sample = known.orderBy(F.xxhash64("doc_id", *COUNTS), "doc_id", *COUNTS).limit(trees * tree_rows).select(*COUNTS).toPandas()
    return grow({c: sample[c].to_numpy() for c in COUNTS}, trees, tree_rows) if len(sample) else None


def score(stats: DataFrame, forest: Forest | None) -> DataFrame:
    """Adds ``score``; 0 without a forest."""
    if forest is None:
        return stats.withColumn("score", F.lit(0.0))
    shared = stats.sparkSession.sparkContext.broadcast(forest)

    def scored(batches):
        for batch in batches:
            found = shared.value.scores({c: batch.column(c).to_numpy(zero_copy_only=False) for c in COUNTS})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stats.schema)
    return stats.mapInArrow(scored, f"{fields}, score double")


def threshold(scored: DataFrame, most_good_lost: float = MOST_GOOD_LOST) -> float:
    """The score from which documents go, from all labelled rows (``score, good``) that pass the base limits.

    Of the thresholds that reject at most ``most_good_lost`` of the good rows it is the one
    that sets good and bad apart best, the share of bad rows above less that of good ones; of
    equal ones the highest. Without good or without bad rows nothing is rejected. Scores are
    counted by Spark on a scale of ``STEPS`` steps.
    """
    step = F.least(F.floor(F.col("score") * STEPS), F.lit(STEPS - 1)).cast("int")
    counts = scored.where(~base_failed()).groupBy(step.alias("step"), "good").count().collect()
    above = np.zeros((2, STEPS))
    for row in counts:
        above[int(row["good"]), row["step"]] = row["count"]
    above = above[:, ::-1].cumsum(1)[:, ::-1]
    bad, good = above[:, 0]
    if not bad or not good:
        return float("inf")
    apart = np.where(above[1] / good <= most_good_lost, above[0] / bad - above[1] / good, -1.0)
    best = int(np.flatnonzero(apart == apart.max())[-1])
    return best / STEPS if apart[best] > 0 else float("inf")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document's counts, ``base_failed``, ``score`` and ``kept``.

    The texts are read once; their counts are written to the shared folder, and the forest
    and its threshold come from the counts of labelled documents. One row per input row:
    null and empty texts fail the base limits, equal texts get equal scores, and rows
    without an id are judged like all others. Without usable labels only the base limits
    reject. Null ``doc_id`` or extra columns do no harm.
    """
    stats = written(statistics(docs), "quality-counts")
    known = written(labelled(stats, labels), "quality-labelled")
    forest = fit(known)
    limit = threshold(score(known, forest)) if forest else float("inf")
    failed = base_failed()
    return score(stats, forest).withColumns({"base_failed": failed, "kept": ~failed & (F.col("score") < limit)})
