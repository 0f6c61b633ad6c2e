"""Language identification as a mixture: which languages make up a document, and in what shares."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CHUNK, LOWER, chunked, flat, handing_back, word_spans

#: Numbers that byte trigrams are hashed to. Bounds the model: 384 KB for each language.
GRAMS = 1 << 16
#: Languages whose counts a task holds at once, and that share a chunk of full size; with more, chunks are smaller.
TOGETHER = 64
ROUNDS = 10
#: What an added language must gain, in units of half the logarithm of the number of words.
PENALTY = 4.0

UNDETERMINED = "und"

_LETTER = np.zeros(256, bool)
_LETTER[0x61:0x7B] = _LETTER[0x80:] = True


def _grams(column):
    """The hashed trigram around each letter, the letters' words, and each document's words.

    What is no letter counts as one kind of gap, and so do the ends of a document.
    """
    data, offsets = flat(column)
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets, _LETTER)
    letters = np.flatnonzero(_LETTER[data])
    padded = np.zeros(len(data) + 2, np.uint32)
    padded[1:-1] = np.where(_LETTER[data], data, 0)
    left, right = padded[letters].copy(), padded[letters + 2].copy()
    word_first = np.cumsum(ends - starts) - (ends - starts)
    left[word_first] = 0  # also where a document ends without a gap
    if len(starts):
        right[np.cumsum(ends - starts) - 1] = 0
    code = (left << np.uint32(16)) | (padded[letters + 1] << np.uint32(8)) | right
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(16), word_first, first


def _counted(batches):
    total: dict[str, np.ndarray] = {}

    def sent():
        for lang, counts in total.items():
            seen = np.flatnonzero(counts)
            for a in range(0, len(seen), 20_000):
                part = seen[a : a + 20_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part), pa.string()), pa.array(part, pa.int32()), pa.array(counts[part])],
                    names=["lang", "gram", "n"],
                )

    for batch in chunked(batches):
        grams, word_first, first = _grams(batch.column("text"))
        edges = np.append(word_first, len(grams))[first]
        for i, lang in enumerate(batch.column("lang").to_pylist()):
            if lang not in total:
                if len(total) == TOGETHER:
                    yield from sent()
                    total.clear()
                total[lang] = np.zeros(GRAMS, np.int64)
            np.add.at(total[lang], grams[edges[i] : edges[i + 1]], 1)
    yield from sent()


@dataclass
class LanguageModel:
    """Log-likelihoods of the trigrams under each language: of those seen in it, and of any other."""

    languages: list[str]
    grams: list[np.ndarray]
    logs: list[np.ndarray]
    unseen: np.ndarray

    def row(self, i: int) -> np.ndarray:
        full = np.full(GRAMS, self.unseen[i], np.float32)
        full[self.grams[i]] = self.logs[i]
        return full


def train(docs: DataFrame) -> LanguageModel:
    """Counts the trigrams of every labelled text (``text``, ``lang``); null labels are left out.

    Any number of languages. Of each, only the trigrams seen in it are gathered, at most
    65,536, so a label that few texts have takes little.
    """
    known = docs.select(F.col("lang").alias("lang"), F.col("text").alias("text")).where("lang is not null")
    counts = known.mapInArrow(lambda batches: handing_back(_counted(batches)), "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = counts.toArrow()
    label = table.column("lang").combine_chunks().dictionary_encode()
    names = label.dictionary.to_pylist()
    order = sorted(range(len(names)), key=names.__getitem__)
    rank = np.argsort(order) if names else np.zeros(0, np.int64)
    row = rank[label.indices.to_numpy(zero_copy_only=False)] if names else np.zeros(0, np.int64)
    by_row = np.argsort(row, kind="stable")
    grams, n = (table.column(c).to_numpy()[by_row] for c in ("gram", "n"))
    edges = np.searchsorted(row[by_row], np.arange(len(names) + 1))
    parts = [slice(a, b) for a, b in zip(edges[:-1], edges[1:])]
    totals = np.array([0.5 * GRAMS + n[p].sum() for p in parts])
    return LanguageModel(
        [names[i] for i in order],
        [grams[p].astype(np.uint16) for p in parts],
        [np.log((0.5 + n[p]) / t).astype(np.float32) for p, t in zip(parts, totals)],
        np.log(0.5 / totals).astype(np.float32),
    )


def _mixture(weights: np.ndarray, first: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Each document's shares of the rows by expectation-maximisation, and its log-likelihood.

    ``weights`` has a column for each word, ``first`` the first column of each document, none empty.
    """
    counts = np.diff(np.append(first, weights.shape[1]))
    share = np.full((len(weights), len(first)), 1 / len(weights))
    for _ in range(rounds):
        part = weights * np.repeat(share.astype(np.float32), counts, axis=1)
        part /= part.sum(axis=0)
        share = np.add.reduceat(part, first, axis=1, dtype=np.float64) / counts
    share = np.maximum(share, 1e-12)
    given = np.log((weights * np.repeat(share.astype(np.float32), counts, axis=1)).sum(axis=0))
    return share, np.add.reduceat(given, first, dtype=np.float64)


def _chosen(weights: np.ndarray, singles: np.ndarray, price: float, rounds: int):
    """Languages of one document by forward selection: the best addition, while it is worth its price."""
    zero = np.zeros(1, np.int64)
    best, score, share = [int(singles.argmax())], float(singles.max()), np.ones(1)
    while len(best) < len(weights):
        tried = []
        for lang in set(range(len(weights))) - set(best):
            s, ll = _mixture(weights[[*best, lang]], zero, rounds)
            tried.append((float(ll[0]), lang, s[:, 0]))
        ll, lang, s = max(tried, key=lambda x: x[:2])
        if ll - score <= price:
            break
        best, score, share = [*best, lang], ll, s
    return best, share


def _identified(batches, model: LanguageModel, penalty: float, rounds: int):
    n = len(model.languages)
    for batch in chunked(batches, limit=max(1, CHUNK * TOGETHER // max(TOGETHER, n))):
        grams, word_first, first = _grams(batch.column("text"))
        has = np.flatnonzero(np.diff(first) > 0)
        shares: list[list] = [[] for _ in range(batch.num_rows)]
        score = np.zeros(batch.num_rows)
        if n and len(has):
            by_word = np.stack([np.add.reduceat(model.row(i)[grams], word_first) for i in range(n)])
            weights = np.maximum(by_word - by_word.max(axis=0), -60)
            start = first[:-1][has]
            singles = np.add.reduceat(weights, start, axis=1, dtype=np.float64).T
            weights = np.exp(weights)
            words = np.diff(first)[has]
            _, most = _mixture(weights, start, rounds)
            order = np.sort(singles, axis=1)
            sure = 1 / (1 + np.exp(np.minimum(order[:, -2] - order[:, -1], 0))) if n > 1 else np.ones(len(has))
            price = penalty * 0.5 * np.log(words + 1)
            for i, doc in enumerate(has):
                # no set of languages does better than all of them
                if most[i] - order[i, -1] <= price[i]:
                    shares[doc], score[doc] = [(model.languages[singles[i].argmax()], 1.0)], sure[i]
                else:
                    rows = weights[:, start[i] : start[i] + words[i]]
                    best, share = _chosen(rows, singles[i], price[i], rounds)
                    shares[doc] = sorted(((model.languages[b], float(s)) for b, s in zip(best, share)), key=lambda x: (-x[1], x[0]))
                    score[doc] = min(1.0, shares[doc][0][1])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("held_out"),
                pa.array([[{"lang": a, "share": b} for a, b in x] for x in shares], pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))),
                pa.array(score),
                batch.column("letters"),
                batch.column("tag"),
            ],
            names=["doc_id", "held_out", "languages", "score", "letters", "tag"],
        )


def held_out(doc_id: Column) -> Column:
    """A third of the documents, by the checksum of the id; they are not learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def identify(
    docs: DataFrame, model: LanguageModel, penalty: float = PENALTY, rounds: int = ROUNDS, tagged: bool = False
) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, languages`` for every row of ``docs``.

    Words are the units of the mixture: expectation-maximisation on their trigram
    likelihoods estimates the shares of all languages; a language set is then chosen by
    penalised likelihood. ``lang_pred`` has the largest share, ``languages`` lists all
    chosen with their shares. ``score`` is that share, or for a single language its
    odds against the next best one. A null text, one without a letter, or an empty
    model gives ``und``, score 0 and no languages. Only ``text`` is looked at. No shuffle; the model
    is broadcast (at most 384 KB for each language). With ``tagged`` a column ``tag``, the hash of the
    text, tells rows of one id apart.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("text").alias("text"),
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"),
        F.xxhash64("text").alias("tag"),
    )
    out = own.mapInArrow(
        lambda batches: handing_back(_identified(batches, sent.value, penalty, rounds)),
        "doc_id long, held_out boolean, languages array<struct<lang:string,share:double>>, score double, letters boolean, tag long",
    )
    ok = F.col("letters") & (F.size("languages") > 0)
    return out.select(
        "doc_id",
        "held_out",
        F.when(ok, F.get("languages", F.lit(0))["lang"]).otherwise(UNDETERMINED).alias("lang_pred"),
        F.when(ok, F.col("score")).otherwise(0.0).alias("score"),
        F.when(ok, F.col("languages")).otherwise(F.slice("languages", 1, 0)).alias("languages"),
        *(["tag"] if tagged else []),
    )
