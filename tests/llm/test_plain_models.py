"""The language mixture and the URL features and trees, computed again in plain Python."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash

from leaksieve.llm import langid, url_filter

# --- languages


def plain_grams(text):
    """Of each word its hashed trigrams; words are runs of a-z and of bytes from 0x80."""
    data = (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
    out = []
    for word in re.findall(rb"[a-z\x80-\xff]+", data):
        padded = b"\0" + word + b"\0"
        codes = (int.from_bytes(padded[i : i + 3], "big") for i in range(len(word)))
        out.append([(c * 0x9E3779B1 % 2**32) >> 16 for c in codes])
    return out


def plain_model(rows):
    counts = defaultdict(Counter)
    for text, lang in rows:
        for word in plain_grams(text):
            counts[lang].update(word)

    def logs(seen):
        total = langid.GRAMS / 2 + sum(seen.values())
        return lambda gram: math.log((0.5 + seen[gram]) / total)

    return {lang: logs(counts[lang]) for lang in sorted(counts)}


def plain_mixture(weights, rounds):
    """Shares of languages (rows of weights), and the log-likelihood of the words under them."""
    share, words = [1 / len(weights)] * len(weights), list(zip(*weights))
    for _ in range(rounds):
        total = [0.0] * len(weights)
        for word in words:
            norm = sum(w * s for w, s in zip(word, share))
            total = [t + w * s / norm for t, w, s in zip(total, word, share)]
        share = [t / len(words) for t in total]
    share = [max(s, 1e-12) for s in share]
    return share, sum(math.log(sum(w * s for w, s in zip(word, share))) for word in words)


def plain_languages(text, model, penalty, rounds):
    words = plain_grams(text)
    if not words:
        return [], 0.0
    names = list(model)
    by_word = [[sum(model[lang](g) for g in word) for word in words] for lang in names]
    best = [max(column) for column in zip(*by_word)]
    logs = [[max(x - b, -60) for x, b in zip(row, best)] for row in by_word]
    weights = [[math.exp(x) for x in row] for row in logs]
    singles = [sum(row) for row in logs]
    price = penalty * 0.5 * math.log(len(words) + 1)
    chosen, score, share = [max(range(len(names)), key=singles.__getitem__)], max(singles), [1.0]
    if plain_mixture(weights, rounds)[1] - score > price:
        while len(chosen) < len(names):
            tried = [(ll, lang, s) for lang in range(len(names)) if lang not in chosen for s, ll in [plain_mixture([weights[i] for i in [*chosen, lang]], rounds)]]
            ll, lang, s = max(tried)
            if ll - score <= price:
                break
            chosen, score, share = [*chosen, lang], ll, s
        ranked = sorted(zip((names[i] for i in chosen), share), key=lambda x: (-x[1], x[0]))
        return ranked, min(1.0, ranked[0][1])
    last = sorted(singles)
    return [(names[chosen[0]], 1.0)], 1 / (1 + math.exp(last[-2] - last[-1]))


def test_shares_and_chosen_languages_equal_plain_python(spark):
    rng = random.Random(12)
    # neighbours share half of their words, so that sets are no easy choice
    pool = ["".join(rng.choice("abcdefghijklmnoprstuvé") for _ in range(rng.randrange(2, 8))) for _ in range(100)]
    vocabulary = {f"l{n}": pool[n * 15 : n * 15 + 30] for n in range(5)}
    learned = [(" ".join(rng.choices(vocabulary[lang], k=25)), lang) for lang in vocabulary for _ in range(20)]
    texts = [None, "", "12 ?", "X", "Éé"]
    for _ in range(150):
        parts = [" ".join(rng.choices(vocabulary[lang], k=rng.randrange(1, 40))) for lang in rng.sample(list(vocabulary), rng.choice([1, 1, 2, 3]))]
        texts.append(rng.choice([" ", ", ", "\n"]).join(parts))
    model = langid.train(spark.createDataFrame(learned, "text string, lang string").repartition(3))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    plain, sets = plain_model(learned), Counter()
    for i, text in enumerate(texts):
        languages, score = plain_languages(text, plain, langid.PENALTY, langid.ROUNDS)
        assert [x.lang for x in got[i].languages] == [lang for lang, _ in languages], text
        assert [x.share for x in got[i].languages] == pytest.approx([share for _, share in languages], abs=1e-3)
        assert got[i].score == pytest.approx(score, abs=1e-3)
        assert got[i].lang_pred == (languages[0][0] if languages else "und")
        sets[len(languages)] += 1
    assert min(sets[n] for n in (0, 1, 2, 3)) > 1


# --- URLs


def plain_features(url, suffix, domain):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    query = url.split("?", 1)[1].split("#", 1)[0] if "?" in url else ""
    n = max(len(url), 1)
    bucket = lambda labels: xxhash.xxh64_intdigest(".".join(host.split(".")[-labels:]).encode(), 42) % url_filter.SUFFIXES
    return {
        "length": len(url), "host_length": len(host), "depth": sum(p != "" for p in path.split("/")),
        "digit_ratio": sum(c in "0123456789" for c in url) / n,
        "entropy": -sum(k / n * math.log2(k / n) for k in Counter(url).values()),
        "parameters": sum(p != "" for p in query.split("&")), "query_length": len(query),
        "labels": host.count(".") + (host != ""), "hyphens": host.count("-"), "fragment": "#" in url,
        "extension": re.search(r"\.[A-Za-z0-9]{1,5}\Z", path) is not None, "secure": url.startswith("https:"),
        "suffix": suffix[bucket(1)], "domain": domain[bucket(2)],
    }


def plain_tree(node, values):
    while node.getClass().getSimpleName() != "LeafNode":
        split = node.split()
        node = node.leftChild() if values[split.featureIndex()] <= split.threshold() else node.rightChild()
    return node.prediction()


def test_features_and_scores_equal_plain_python(spark):
    rng = random.Random(5)
    urls = [None, "", "no scheme?a&b", "https://", "https://É-x.example.ORG/a/b.html?x=1&&y#z", "http://a.b-c.d/..//e.f#?q", "ftp://net"]
    labels = [None] * len(urls)
    for _ in range(500):
        bad = rng.random() < 0.5
        host = rng.choice(["a.com", "shop.example.net", "x-y.org"])
        path = "/".join(f"{rng.getrandbits(30):x}" if bad else rng.choice(["news", "team", "faq.html"]) for _ in range(rng.randrange(1, 4)))
        urls.append(f"{rng.choice(['http', 'https'])}://{host}/{path}" + (f"?id={rng.getrandbits(40)}&v=2" if rng.random() < 0.4 else ""))
        labels.append(rng.choice(["block" if bad else "allow"] * 9 + ["allow", None]))
    rows = spark.createDataFrame([(i, u, v) for i, (u, v) in enumerate(zip(urls, labels))], "page_id long, url string, verdict string")
    model = url_filter.train(rows, trees=4)

    def shares(labels_of_host):
        counts = defaultdict(lambda: [1.0, 2.0])
        for url, verdict in zip(urls, labels):
            if verdict is not None:
                host = re.match(r"[^/?#]*", url.split("://", 1)[1])[0]
                at = counts[xxhash.xxh64_intdigest(".".join(host.split(".")[-labels_of_host:]).encode(), 42) % url_filter.SUFFIXES]
                at[0] += verdict == "block"
                at[1] += 1
        return [counts[b][0] / counts[b][1] if b in counts else 0.5 for b in range(url_filter.SUFFIXES)]

    assert model.suffix == pytest.approx(shares(1)) and model.domain == pytest.approx(shares(2))
    made = url_filter._with_features(url_filter._split(rows, ["page_id"]), model.suffix, model.domain)
    roots = [(t._call_java("rootNode"), w) for t, w in zip(model.trees.trees, model.trees.treeWeights)]
    found = {r.page_id: r for r in url_filter.judge(rows, (), model).collect()}
    for r in made.collect():
        want = plain_features(urls[r.page_id], model.suffix, model.domain)
        assert {k: r[k] for k in want} == pytest.approx({k: float(v) for k, v in want.items()}), urls[r.page_id]
        if r.page_id < 60:
            margin = sum(w * plain_tree(root, [r[k] for k in url_filter._FEATURES]) for root, w in roots)
            assert found[r.page_id].score == pytest.approx(1 / (1 + math.exp(-2 * margin)))
            assert found[r.page_id].verdict == ("block" if margin > 0 else "allow")
