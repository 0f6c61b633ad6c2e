"""Hot ids, copied stretches and large benchmarks: what must not pile up, and the results where it might."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from leaksieve.llm import decontaminate, fingerprint, pii


def by_falling_id(rows, hashes):
    """What comes after each row: ids fall, rows of one id follow by the hash of their texts, none come last."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]]))
    return [(r, order[(i + 1) % len(order)]) for i, r in enumerate(order)]


def test_ids_with_many_rows_are_cut_by_text(spark):
    rng = random.Random(4)
    text = lambda: " ".join(rng.choice("abcdefgh") * rng.randrange(1, 5) for _ in range(rng.randrange(1, 40)))
    rows = [(7, text()) for _ in range(300)] + [(None, text()) for _ in range(300)] + [(i, text()) for i in range(200)] + [(7, "same copy")] * 40
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    hashes = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    want = []
    for (doc, own), (_, after) in by_falling_id(rows, hashes):
        k = len(own) // 3
        want.append((doc, len(own), hashlib.sha256((own[: len(own) - k] + after[:k]).encode()).hexdigest()))
    got = [(r.doc_id, r.n_chars, r.edited_sha256) for r in fingerprint.edit_likeness(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_ranges_are_even_and_in_order():
    rng = np.random.default_rng(1)
    ids = np.concatenate([np.full(50_000, 12), rng.integers(0, 30, 50_000)])
    tags = rng.integers(-(2**63), 2**63 - 1, len(ids))
    quantiles = np.quantile(ids, np.arange(1, 40) / 40, method="lower").astype(float).tolist()
    part = fingerprint.Ranges(quantiles).part(ids, tags)
    order = sorted(range(len(ids)), key=lambda i: (ids[i], -1 - int(tags[i])))
    assert (np.diff(part[order]) >= 0).all()
    assert np.bincount(part).max() < 3 * len(ids) / 40
    assert fingerprint.Ranges([]).part(ids, tags).max() == 0


def test_copies_of_a_stretch_train_as_one(spark):
    rng = random.Random(2)
    rows = [f"see u{rng.randrange(10**6)}@mail{i}.example.org about it" for i in range(400)]
    rows += [f"from {rng.randrange(1000, 9999)} on" for i in range(400)]
    rows += [f"u{rng.randrange(10**6)}@x.org 10.{rng.randrange(256)}.{i % 256}.1 both" for i in range(400)]
    seen = []

    def examples(texts):
        df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
        fit, pii.fit = pii.fit, lambda found: seen.append(found) or fit(found[:20])
        try:
            pii.train(df)
        finally:
            pii.fit = fit
        return seen[-1]

    alone = examples(rows)
    assert len(alone) == 600 and [sum(min(len(m), 2) == c for _, m in alone) for c in range(3)] == [200, 200, 200]
    least = [p for p, m in alone if len(m) == 1]
    assert examples(rows + [f"see {p} about it" for p in least for _ in range(300)]) == alone
    assert examples([]) == []


def plain_hits(docs, items, window):
    phrases = {}
    for item, text in items:
        words = text.split()
        for a in range(max(1, len(words) - window + 1)):
            phrases.setdefault(tuple(words[a : a + window]), set()).add(item)
    out = {}
    for doc, text in docs:
        words, hit, found = text.split(), set(), set()
        for a in range(len(words)):
            for size in {len(p) for p in phrases}:
                owners = phrases.get(tuple(words[a : a + size])) if a + size <= len(words) else None
                if owners:
                    hit |= set(range(a, a + size))
                    found |= owners
        out[doc] = (len(words), len(hit), sorted(found))
    return out


def test_large_benchmarks_find_the_same_in_blocks(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(900)]
    items = [(f"i{n}", " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 3, 30])))) for n in range(400)]
    docs = []
    for n in range(120):
        words = rng.choices(vocabulary, k=60)
        for _ in range(rng.randrange(3)):
            part = rng.choice(items)[1].split()
            a = rng.randrange(len(part))
            words[5:5] = part[a : a + rng.randrange(1, 12)]
        docs.append((n, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = plain_hits(docs, items, 4)
    for block in (1 << 20, 4000):
        hits = decontaminate.benchmark_hits(df, bench, window=4, block_bytes=block)
        got = {r.doc_id: (r.n_words, sum(s.end - s.start for s in r.spans), r["items"]) for r in hits.collect()}
        assert got == want


def test_only_phrases_whose_words_are_there_are_searched():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    words = rng.integers(1, 2**62, 5000).astype(np.uint64)
    windows = [rng.choice(words, 5) for _ in range(20_000)]
    phrases = decontaminate.Phrases(pa.array([w.tobytes() for w in windows], pa.binary()), pa.array([["i"]] * len(windows)), 5)
    shard = np.concatenate([windows[17], windows[4242]])
    symbols = phrases.symbols(shard)
    found = set(phrases.possible(symbols).tolist())
    there = set(shard.tolist())
    assert found == {i for i, w in enumerate(windows) if set(w.tolist()) <= there} >= {17, 4242}
    at, window = phrases.occurrences(shard, np.array([0, len(shard)]))
    assert sorted(zip(at.tolist(), window.tolist())) == [(0, 17), (5, 4242)]
