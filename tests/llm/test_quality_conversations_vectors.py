"""Quality rules, conversation repair and whitening against plain re-computations."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from leaksieve.llm import conversations, quality_rules, whitening
from leaksieve.llm.queries import op11_quality_rules, op12_conversation_repair, op13_whitening

SF_DIR = "/root/testdata/sf0.001"


# quality rules


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 5)}
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }


def random_texts(n, seed=3):
    random_ = random.Random(seed)
    words = ["a", "b", "é", "ß#", "**", "c|d", " x", "日本", "<e>"]
    gaps = [" ", "\n", "\n\n", "\t", " \r\n", "\x0b"]
    return ["".join(random_.choice(words) + random_.choice(gaps) for _ in range(random_.randrange(0, 40))) for _ in range(n)]


def test_counts_are_those_of_plain_python(spark):
    texts = random_texts(300) + ["", None, "\n", " \n\n", "x", "\nx\n\nx\n", "x\n" * 50, "a b c d e a b c d e", "w " * 30_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.asDict() for r in quality_rules.statistics(docs).collect()}
    for i, text in enumerate(texts):
        assert {k: got[i][k] for k in plain_counts(text)} == plain_counts(text), repr(text)


def _prose(random_, n):
    return " ".join("".join(random_.choice("abcdefgh") for _ in range(random_.randrange(2, 9))) for _ in range(n)) + "."


def test_forest_sets_odd_documents_apart_with_a_threshold_from_labels(spark):
    random_ = random.Random(5)
    good = [_prose(random_, random_.randrange(20, 200)) for _ in range(600)]
    shouting = [_prose(random_, random_.randrange(20, 200)).upper().replace(" ", "!!! ") for _ in range(60)]
    tables = [_prose(random_, random_.randrange(20, 200)).replace(" ", " | ## ") for _ in range(60)]
    texts = [*good, *shouting, *tables]
    rows = [(i, t, int(i < 600)) for i, t in enumerate(texts)]
    random_.shuffle(rows)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i % 2], "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in quality_rules.judge(docs, labels).collect()}
    unseen = [i for i in kept if i % 2 == 0]
    assert sum(not kept[i] for i in unseen if i < 600) <= 0.05 * 300
    assert sum(not kept[i] for i in unseen if i >= 600) >= 0.9 * 60


def test_forest_depths_follow_the_trees():
    counts = {c: np.arange(1, 41) for c in quality_rules.COUNTS}
    forest = quality_rules.grow(counts, trees=7, tree_rows=16, seed=2)
    points = quality_rules.features(counts, forest.usual)

    def depth(node, point):
        while forest.column[node] >= 0:
            node = forest.left[node] + (point[forest.column[node]] >= forest.split[node])
        return forest.split[node]

    want = [np.mean([depth(root, p) for root in forest.roots]) for p in points]
    assert np.allclose(forest.depths(points), want)
    assert all(0 < s <= 1 for s in forest.scores(counts))


def test_quality_of_odd_tables(spark):
    schema = "doc_id long, text string, score string, kept int, n_words string"
    texts = ["ok " * 3, None, "", " ".join(f"w{i}" for i in range(40))]
    rows = [(i if i != 3 else None, t, "x", 1, "y") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + [rows[3]], schema)
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.base_failed, r.kept) for r in quality_rules.judge(docs, none).collect())
    assert got == [(False, 0, True, False), (False, 1, True, False), (False, 2, True, False), (True, 0, False, True), (True, 0, False, True)]
    labels = spark.createDataFrame([(None, 1), (0, None), (0, 0), (0, 1), (7, 0)], "doc_id long, quality int")
    assert quality_rules.judge(docs, labels).count() == 5
    assert quality_rules.judge(docs.limit(0), labels).count() == 0


def test_threshold_counts_all_labelled_rows(spark):
    rows = [(0.1 + i / 10_000, True) for i in range(1000)] + [(0.9, False)] * 10 + [(0.05, False)] * 10
    scored = spark.createDataFrame(rows, "score double, good boolean").withColumns({"n_words": F.lit(100), "n_repeat_words": F.lit(0)})
    limit = quality_rules.threshold(scored, 0.01)
    assert 0.2 <= limit <= 0.9 and sum(s >= limit for s, good in rows if good) <= 10
    assert quality_rules.threshold(scored.where("good")) == float("inf")
    assert quality_rules.threshold(scored.where("not good")) == float("inf")


def test_quality_query_has_a_row_per_document(spark):
    got = op11_quality_rules(spark, SF_DIR)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = got.collect()
    assert len(rows) == len(docs) and {r.doc_id for r in rows} == set(docs)
    for r in rows:
        want = plain_counts(docs[r.doc_id])
        assert {k: r[k] for k in want} == want
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.kept and r.base_failed)


# conversation repair


def accepts(initials):
    return re.fullmatch("(s?(ua)+)?", initials) is not None


def cheapest_by_trial(rows, most=8):
    """All edit strings in order of cost and ASCII, each carried out in full; rows are (initial, kind)."""
    best = None
    for length in range(most + 1):
        for audit in itertools.product("DIKR", repeat=length):
            if sum(e != "I" for e in audit) != len(rows):
                continue
            for speakers in itertools.product("ua", repeat=sum(e in "IR" for e in audit)):
                cost, out, at, said = 0, "", 0, iter(speakers)
                for e in audit:
                    if e == "I":
                        cost, out = cost + 3, out + next(said)
                        continue
                    initial, kind = rows[at]
                    at += 1
                    if e == "D":
                        cost += 4
                    elif kind == 2 or e == "K" and initial == 3:
                        break
                    else:
                        cost += (3 if e == "R" else 0) + (3 if kind == 1 else 0)
                        out += "sua"[initial] if e == "K" else next(said)
                else:
                    if accepts(out) and (best is None or (cost, "".join(audit)) < best):
                        best = cost, "".join(audit)
    return best


def cheapest_by_table(codes):
    """Dynamic programming from the end over (cost, audit)."""
    after, wanted = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}, (2, 2, 3, 2)
    best = [(0, ""), None, None, (0, "")]
    for row in range(len(codes), -1, -1):
        if row < len(codes):
            kind, initial = divmod(codes[row], 4)
            new = []
            for s in range(4):
                options = [(4 + best[s][0], "D" + best[s][1])]
                if kind < 2:
                    if (s, initial) in after:
                        c, a = best[after[s, initial]]
                        options.append((3 * kind + c, "K" + a))
                    c, a = best[wanted[s]]
                    options.append((3 + 3 * kind + c, "R" + a))
                new.append(min(options))
            best = new
        for _ in range(3):
            for s in range(4):
                options = [x for x in (best[s], best[wanted[s]] and (3 + best[wanted[s]][0], "I" + best[wanted[s]][1])) if x]
                best[s] = min(options) if options else None
    return best[0]


def test_search_finds_the_first_of_the_cheapest_repairs():
    random_ = random.Random(1)
    for n in (0, 1, 2, 3):
        for rows in itertools.islice(itertools.product(itertools.product(range(4), range(3)), repeat=n), 0, None, 1 + 12**n // 60):
            cost, path = conversations.repair_edits(bytes(4 * k + i for i, k in rows))
            assert (cost, "".join(m[0] for m in path)) == cheapest_by_trial(rows, n + 2 + (n == 0))
    for _ in range(1500):
        codes = bytes(random_.choice([0, 1, 2, 1, 2, 3, 5, 6, 9, 10]) for _ in range(random_.randrange(0, 14)))
        cost, path = conversations.repair_edits(codes)
        assert (cost, "".join(m[0] for m in path)) == cheapest_by_table(codes)
    for n in (15, 16, 17, 33, 64, 200, 1500):
        codes = bytes(random_.choice([1, 2, 1, 2, 3, 5, 6, 9]) for _ in range(n))
        cost, path = conversations.repair_edits(codes)
        assert (cost, "".join(m[0] for m in path)) == cheapest_by_table(codes)


def plain_repairs(rows):
    """The contract word by word; rows of one turn are alike or told apart by nothing."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text, fate = role if role is not None else " ", text if text is not None else " ", zlib.crc32(key.encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(fate, text)
        by[conv] += [(turn, "user" if fate == 4 else role, text)] * {0: 0, 3: 2}.get(fate, 1)
    out = {}
    for conv, rows_ in by.items():
        rows_.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))
        seen, codes, counts = set(), [], Counter()
        for _, role, text in rows_:
            words = text.strip(" \t\n\x0b\x0c\r")
            kind = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else ""
            seen.add((role, text))
            counts[kind] += 1
            codes.append(4 * {"": 0, "truncated": 1}.get(kind, 2) + ("sua".find(role[0]) % 4 if role else 3))
        cost, audit = cheapest_by_table(codes)
        lines, state, at = [], "", 0
        for e in audit:
            speaker = "assistant" if state == "u" else "user"
            _, role, text = rows_[at] if at < len(rows_) else (None, "", "")
            at += e != "I"
            if e != "D":
                role, text = (role, text) if e == "K" else (speaker, text if e == "R" else "")
                lines.append(f"{role}:{text}")
                state = role[0]
        turns = [t for t, _, _ in rows_ if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows_, rows_[1:])]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, counts["blank"], counts["duplicate"], counts["truncated"],
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def repairs(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def test_repairs_are_those_of_plain_python(spark):
    random_ = random.Random(9)
    rows = []
    for conv in [None, *range(150)]:
        for turn in range(random_.randrange(1, 9)):
            role = random_.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
            text = random_.choice(["Hi.", "Yes!", "cut", " ", "", None, "\x0b", "é? \n", "a\nb.", "Hi."])
            rows.append((conv, random_.choice([turn, turn + 100]), role, text))
    rows += [(999, t, "ua"[t % 2] and ("user", "assistant")[t % 2], f"line {t}" + ".,"[t % 3 == 0]) for t in range(2000)]
    rows += [(1000, None, "user", "Same.")] * 3
    rows = list({(r[0], r[1]): r for r in rows if r[0] != 1000}.values()) + rows[-3:]
    random_.shuffle(rows)
    schema = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame(rows, schema).repartition(5)
    got, want = repairs(conversations.repair(conversations.damage(df))), plain_repairs(rows)
    assert got == want
    assert any(v[6] == "" for v in want.values()) and any("I" in v[6] for v in want.values())


def test_repair_of_odd_tables(spark):
    schema = "conv_id long, turn long, role string, text string, part int, step string, code string, h1 string"
    none = spark.createDataFrame([], schema)
    assert conversations.repair(none).count() == 0 and conversations.repair(conversations.damage(none)).count() == 0
    nothing = hashlib.sha256(b"").hexdigest()
    rows = [(1, 1, "user", "a.", 9, "x", "y", "z"), (1, 2, "assistant", "b.", 9, "x", "y", "z"), (2, None, None, None, 9, "x", "y", "z")]
    got = repairs(conversations.repair(spark.createDataFrame(rows, schema)))
    assert got == {
        1: (0, 0, 0, 0, 0, 0, "KK", hashlib.sha256(b"user:a.\nassistant:b.").hexdigest()),
        2: (0, 1, 0, 0, 0, 4, "D", nothing),
    }
    dropped = spark.createDataFrame([(5, 1, "user", "a.", True)], "conv_id long, turn long, role string, text string, dropped boolean")
    assert repairs(conversations.repair(dropped)) == {5: (0, 0, 0, 0, 0, 0, "", nothing)}


def test_repair_does_not_depend_on_partitions(spark):
    # rows of one turn that differ, and turns at both ends of the range
    rows = [(1, 3, "user", f"t{i}.") for i in range(20)] + [(1, -(2**63), "system", "s."), (1, 2**63 - 1, "assistant", "e.")]
    schema = "conv_id long, turn long, role string, text string"
    results = []
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        results.append(repairs(conversations.repair(spark.createDataFrame(rows, schema).repartition(seed + 2))))
    assert results[0] == results[1] and results[0][1][0] == 2**63 - 1


def test_repair_query_follows_the_contract(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert repairs(op12_conversation_repair(spark, SF_DIR)) == plain_repairs(rows)


# whitening


def exact_scatter(x):
    n, d = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(d)]
    return [[n * sum(r[i] * r[j] for r in x) - sums[i] * sums[j] for j in range(d)] for i in range(d)]


def exact_polynomial(matrix):
    """Faddeev-LeVerrier in fractions, the constant first."""
    d = len(matrix)
    m, c = [[Fraction(0)] * d for _ in range(d)], [Fraction(0)] * d + [Fraction(1)]
    for k in range(1, d + 1):
        m = [[sum(matrix[i][t] * m[t][j] for t in range(d)) + (c[d - k + 1] if i == j else 0) for j in range(d)] for i in range(d)]
        c[d - k] = -sum(matrix[i][t] * m[t][i] for i in range(d) for t in range(d)) / k
    return [int(x) for x in c]


def test_characteristic_polynomial_is_exact(spark):
    random_ = np.random.default_rng(0)
    for d in (1, 2, 3, 7):
        matrix = exact_scatter(random_.integers(-(10**6), 10**6, (d + 3, d)).tolist())
        assert whitening.characteristic_polynomial(spark, matrix) == exact_polynomial(matrix)
    rank_one = exact_scatter([[1, 2, 3], [2, 4, 6]])
    assert whitening.characteristic_polynomial(spark, rank_one) == exact_polynomial(rank_one)


def test_roots_come_with_their_multiplicity():
    polynomial = np.array([1], object)
    for root in (0, 0, 3, 3, 3, 10, 10**9):
        polynomial = np.convolve(polynomial, np.array([-root, 1], object))
    found = whitening.greatest_roots([int(c) for c in polynomial], 16)
    assert [(round((2 * f + 1) / 2 ** (k + 1), 9), m) for f, k, m in found] == [(10**9, 1), (10, 1), (3, 3)]
    assert whitening.greatest_roots([0, 0, 1], 4) == []


def test_equal_eigenvalues_get_orthogonal_components():
    matrix = [[2, 0, 0], [0, 2, 0], [0, 0, 5]]
    vectors = np.array(whitening.null_vectors(matrix, (2 << 120, 120, 2)))
    assert np.allclose(vectors @ vectors.T, np.eye(2), atol=1e-15) and np.allclose(vectors[:, 2], 0, atol=1e-12)


def test_products_are_exact_beyond_doubles():
    x = np.random.default_rng(1).integers(-(2**62), 2**62, (40, 3))
    assert whitening._products(x).tolist() == [[sum(int(a) * int(b) for a, b in zip(x[:, i], x[:, j])) for j in range(3)] for i in range(3)]


def check_whitening(rows, vectors, components=16):
    """The result against exact sums and numpy's eigenvectors."""
    x = {i: [int(np.floor(64 * float(c))) + 1_000_000 for c in v] for i, v in vectors.items()}
    fit = sorted({tuple(v) for v in x.values()})
    n, d = len(fit), len(fit[0])
    sums = [sum(v[i] for v in fit) for i in range(d)]
    values, basis = np.linalg.eigh(np.array(exact_scatter(fit), float) / n**2)
    values, basis = values[::-1], basis[:, ::-1]
    got = defaultdict(dict)
    for r in rows:
        got[r.vec_id][r.component] = r
    assert set(got) == set(vectors)
    usual = next(iter(got.values()))
    k = min(components, int((values > 1e-9 * values[0]).sum()))
    signs = {}
    for i, v in x.items():
        assert sorted(got[i]) == list(range(1, k + 1))
        deviation = sum((n * a - s) ** 2 for a, s in zip(v, sums))
        centred = np.array([(n * a - s) / n for a, s in zip(v, sums)])
        for c, r in got[i].items():
            want = centred @ basis[:, c - 1] / np.sqrt(values[c - 1])
            sign = signs.setdefault(c, 1 if abs(r.whitened - want) < abs(r.whitened + want) else -1)
            assert abs(r.whitened * sign - want) < 1e-6
            assert r.n == n and r.deviation == deviation and r.identity_error < 1e-9
            assert r.identity_error == usual[1].identity_error and abs(r.explained / (values[c - 1] / values.sum()) - 1) < 1e-9


def test_whitening_of_the_table(spark):
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()}
    check_whitening(op13_whitening(spark, SF_DIR).collect(), vectors)


def test_whitening_of_odd_rows(spark):
    random_ = np.random.default_rng(4)
    good = [(i, [float(v) for v in random_.normal(size=5)]) for i in range(40)]
    bad = [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0]), (102, [float("nan")] * 5), (103, [float("inf")] * 5)]
    copies = [(200 + i, good[0][1]) for i in range(30)]
    df = spark.createDataFrame([(i, v, "x", 7) for i, v in good + bad + copies], "vec_id long, embedding array<double>, x string, n int")
    check_whitening(whitening.whitened(df).collect(), dict(good + copies))
    other = spark.createDataFrame([(300, [1.0, 2.0], "x", 7), (None, good[3][1], "x", 7), (301, [], "x", 7)], df.schema)
    rows = [r for r in whitening.whitened(df.unionByName(other)).collect()]
    short = [r for r in rows if r.vec_id in (300, 301)]
    assert len(short) == 2 and all(r.component is None and r.whitened is None and r.n == 40 for r in short)
    assert sum(r.vec_id is None for r in rows) == 5
    assert whitening.whitened(df.limit(0)).count() == 0
    same = whitening.whitened(df.where("vec_id >= 200")).collect()
    assert len(same) == 30 and all(r.component is None and r.n == 1 and r.deviation == 0 for r in same)


@pytest.mark.parametrize("huge", [1e12, 1e300])
def test_whitening_of_huge_entries(spark, huge):
    df = spark.createDataFrame([(1, [huge, 0.5]), (2, [0.0, 1.0]), (3, [-huge, -3.0])], "vec_id long, embedding array<double>")
    x = whitening.whole_vectors(df)
    assert {r.vec_id: r.x for r in x.collect()}[1][0] == min(int(huge * 64) + 1_000_000, 2**63 - 1)
    rows = whitening.whitened(df).collect()
    assert {r.component for r in rows} == {1, 2} and all(r.identity_error < 1e-6 for r in rows)
