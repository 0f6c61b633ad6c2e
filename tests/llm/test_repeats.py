"""Removal of repeated bytes and words against counting every window."""

import hashlib
import random
from collections import Counter

import pyarrow as pa
import pytest

from leaksieve.llm import repeats, substring_dedup, suffix_dedup

SCHEMA = "doc_id long, text string"


def plain_bytes(rows, size):
    counts = Counter()
    for _, t in rows:
        d = (t or "").encode()
        counts.update(d[i : i + size] for i in range(len(d) - size + 1))
    out = []
    for doc, t in rows:
        d = (t or "").encode()
        gone = {j for i in range(len(d) - size + 1) if counts[d[i : i + size]] > 1 for j in range(i, i + size)}
        kept = bytes(b for i, b in enumerate(d) if i not in gone)
        spans = sum(1 for i in gone if i - 1 not in gone)
        out.append((doc, len(d), len(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def plain_words(rows, size):
    first = {}
    for doc, t in rows:
        w = (t or "").encode().split()
        for i in range(len(w) - size + 1):
            key = tuple(w[i : i + size])
            first[key] = min(first.get(key, (doc, i)), (doc, i))
    out = []
    for doc, t in rows:
        w = (t or "").encode().split()
        gone = {j for i in range(len(w) - size + 1) if first[tuple(w[i : i + size])] < (doc, i) for j in range(i, i + size)}
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((doc, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def texts(seed, n=60):
    rng = random.Random(seed)
    letters = rng.choice(["ab ", "abc é\n", "abcdefgh "])
    made = []
    for _ in range(n):
        kind = rng.randrange(6)
        t = "".join(rng.choice(letters) for _ in range(rng.randrange(120)))
        if kind == 1 and made:
            t = rng.choice(made)
        elif kind == 2 and made:
            t = t[:9] + rng.choice(made)[5:60] + t[9:]
        elif kind == 3:
            t = rng.choice(["a", "ab ", "ab c é "]) * rng.randrange(40)
        made.append(t)
    return [(i, t) for i, t in enumerate(made)]


@pytest.mark.parametrize("group", [50_000, 2])
@pytest.mark.parametrize("seed", [1, 2])
def test_bytes(spark, seed, group):
    rows = [*texts(seed), (90, None), (91, ""), (92, "same row " * 4), (92, "same row " * 4), (93, "a" * 15)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = suffix_dedup.removal(suffix_dedup.repeated_bytes(df, 16, 5, group)).collect()
    assert sorted(map(tuple, got), key=str) == plain_bytes(rows, 16)


@pytest.mark.parametrize("group", [50_000, 2])
@pytest.mark.parametrize("seed", [1, 2])
def test_words(spark, seed, group):
    rows = [*texts(seed), (90, None), (91, ""), (92, "same row x y z " * 4), (92, "same row x y z " * 4), (93, "a \t" * 5)]
    random.Random(seed).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = substring_dedup.removal(substring_dedup.repeated_words(df, 5, 2, group)).collect()
    assert sorted(map(tuple, got), key=str) == plain_words(rows, 5)


def test_real_windows(spark):
    rng = random.Random(6)
    passage = " ".join(str(rng.randrange(10**6)) for _ in range(50))
    rows = [(i, " ".join(str(rng.randrange(10**6)) for _ in range(60)) + " " + passage[i:]) for i in range(12)]
    rows += [(20, rows[0][1]), (21, rows[0][1])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = suffix_dedup.removal(suffix_dedup.repeated_bytes(df)).collect()
    assert sorted(map(tuple, got), key=str) == plain_bytes(rows, 200)
    got = substring_dedup.removal(substring_dedup.repeated_words(df)).collect()
    assert sorted(map(tuple, got), key=str) == plain_words(rows, 20)


def test_anchors_are_gathered_by_text(spark):
    """Rows without an id, or with one id, do not get each other's anchors."""
    shared = "one passage that stands in every text of this small table "
    rows = [(None if i % 2 else 7, f"{shared}{i} " + " ".join(f"w{i}x{j}" for j in range(30)) * 2 + shared) for i in range(20)]
    rows += [rows[0], rows[1]] * 5
    spec = repeats.Windows(8, 3, words=True)
    docs = repeats._keyed(spark.createDataFrame(rows, "doc_id long, text string"))
    anchors = docs.mapInArrow(lambda b: repeats._anchors(b, spec), repeats._ANCHORS)
    every = anchors.select("anchor").distinct().selectExpr("anchor", "false as hot")
    got = {(r.doc_id, r.tag): r.anchors for r in repeats.wanted_anchors(anchors, every).collect()}
    assert len(got) == 20
    own = {}
    for r in anchors.collect():
        own.setdefault((r.doc_id, r.tag), set()).add(r.anchor)
    assert all(len(a) == len(set(a)) and set(a) == own[k] for k, a in got.items())


def test_odd_tables(spark):
    odd = [(None, "no id " * 60, "a"), (None, None, "b"), (1, "x" * 100_000, "c"), (2, "x" * 300, "d")]
    df = spark.createDataFrame(odd, "doc_id long, text string, spans string").selectExpr("*", "1 as tag", "2 as anchor", "3 as start")
    got = {(r.doc_id, r.n_bytes): r.n_removed for r in suffix_dedup.removal(suffix_dedup.repeated_bytes(df)).collect()}
    assert got == {(None, 360): 360, (None, 0): 0, (1, 100_000): 100_000, (2, 300): 300}
    got = {(r.doc_id, r.n_words): r.n_removed for r in substring_dedup.removal(substring_dedup.repeated_words(df)).collect()}
    assert got == {(None, 120): 118, (None, 0): 0, (1, 1): 0, (2, 1): 0}
    for operator in (suffix_dedup.repeated_bytes, substring_dedup.repeated_words):
        assert operator(df.limit(0)).count() == 0


def met_rows(spec, rows, group, hot=False, method=None, earliest=True):
    """What one task makes of pieces ``(anchor, doc_id, start, text)`` that come in order of anchor, in small batches."""
    size = lambda t: len(t.split()) - spec.window + 1
    columns = {
        "anchor": [r[0] for r in rows], "doc_id": [r[1] for r in rows], "tag": [0] * len(rows), "start": [r[2] for r in rows],
        "n": pa.array([size(r[3]) for r in rows], pa.int32()), "many": [False] * len(rows), "answered": [False] * len(rows),
        "hot": [hot] * len(rows), "text": pa.array([r[3].encode() for r in rows], pa.binary()),
    }
    batch = pa.RecordBatch.from_pydict(columns)
    batches = [batch.slice(a, 100) for a in range(0, len(rows), 100)]
    return [r for b in repeats._met(iter(batches), spec, method, earliest, group) for r in b.to_pylist()]


def test_hot_anchors_are_cut_at_longer_ones():
    """A phrase of six words in 3,000 contexts: no anchor of twelve words has more than some of its pieces."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10**6)}"
    phrase = " ".join(word() for _ in range(6))
    rows = [(5, i, 0, " ".join([*(word() for _ in range(14)), phrase, *(word() for _ in range(14))])) for i in range(3000)]
    spec = repeats.Windows(20, 6, words=True)
    out = met_rows(spec, rows, 50_000, hot=True)
    assert {r["doc_id"] for r in out} == set(range(3000))
    assert sum(r["n"] for r in out) == 3000 * 15
    windows = sorted((r["doc_id"], r["start"] + i) for r in out for i in range(r["n"]))
    assert windows == [(d, i) for d in range(3000) for i in range(15)]
    assert max(Counter(r["anchor"] for r in out).values()) == 1
    chain = []
    while spec:
        chain.append(spec.gram)
        spec = spec.finer()
    assert chain == [6, 12, 20]


@pytest.mark.parametrize("earliest", [True, False])
def test_a_task_holds_one_of_equal_pieces(earliest):
    """Thousands of copies at one anchor: those held stay few, and each copy is answered."""
    copy = " ".join(f"c{i}" for i in range(25))
    rows = [(9, i, 3, copy) for i in range(4000)]
    held = []

    def method(batch, columns, spec):
        held.append(batch.num_rows)
        return (substring_dedup._matched if earliest else suffix_dedup._sorted_out)(batch, columns, spec)

    out = met_rows(repeats.Windows(20, 20, words=True), rows, 150, method=method, earliest=earliest)
    assert held[0] <= 300
    assert {(r["doc_id"], r["start"], r["end"]) for r in out} == {(i, 3, 28) for i in range(1 if earliest else 0, 4000)}
