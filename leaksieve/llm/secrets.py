"""Secrets: keyword assignments, key ids and long hex runs, and tokens that pass a battery of randomness tests.

Everything is built from Spark's own functions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = (
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
#: Runs of at least the length that counts; shorter runs are dropped, and no start inside a run finds a longer one.
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
#: Runs of the characters of base64, its URL form, base32, base36 and hex, with the padding that ends them;
#: an equals sign inside a run ends it, as in name=key.
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+(?:=++(?![A-Za-z0-9+/_-]))?+"
#: What is tried of a run besides the whole: what stands between slashes, and between any signs.
PARTS = (r"[A-Za-z0-9+_-]{20,}+=*+", r"[A-Za-z0-9]{20,}+=*+")
KINDS = ("assign", "access", "hex", "random")
#: Share of false finds among the tokens reported as random.
FALSE_DISCOVERIES = 0.001
#: A test that random text fails less often than this speaks against randomness.
REJECT = 0.001

# Chance in ordinary text, set high, that upper case, lower case, digits and signs change from
# one character to the next.
_CHANGE = 0.4
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
_ALPHABETS = {
    "hex": _DIGITS + "ABCDEF", "base32": _UPPER + "234567", "base36": _UPPER + _DIGITS, "base64": _UPPER + _LOWER + _DIGITS + "+/"
}

# How rare each letter is after a, b, ..., z and as the first of a word: quarter nats, a to z for
# 0 to 25. Counted in the help texts that come with Python (pydoc_data.topics).
_ENGLISH = (
    "zomqzxtzozuilhzrzijhqszvrz lzqwgzzznhzizzmuzpqyizzzjz jzpzhzzknzojzzhyzoxhmzzzzz orzndzzzgzzqzzmzzzlulzzzrz "
    "ovkjqnuyvzzonizorhilzrulrz lzzzlnzzgzzozzfyzkzoizzztz nyxzezpmjzzltjtyzmloizzzzz hzzzczzzkzzzxzjzzsztzzzzzz "
    "qpmqpmqzzzxnofiszriizqzxzu vzuzazzzzzzzzzuzzzzzozzzzz pzvzczrzkzzvzszmzrlzozqzzz izzogpzzjzzizzkyzzmnlywzlz "
    "hnzzdzzznzzzozkizzptnzzzyz kzkijwizpzzrtrkzzzkhpszzsz wmplvkwzuzvpmfrnzhplmrpzzz izzsgzzwozzjzzkmzhujtzzzoz "
    "zzzzzzzzzzzzzzzzzzzzazzzzz ixtpfxnzizzyonkuznlnpzvzoz qzozfzzojzyrzznmzziglzzzqz kzvzhzzfizzuxzlzzlmopzwznz "
    "moosjwpzmzzjlixmzkiizzzzzz ezzzdzzzizzzvzozzzzzzzzzzz kzzzkzzgezztzpjzzppzzzyzzz kzfzhzzylzzzzztfzztjzzzsvz "
    "zxrzrzzzlzzvsjoezzjhzxlzzz jzzzcrzzjzzzzzrzzzvzzzzzoz jnlnnmssjzuponkozokirrozyz"
)
_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _no_spans() -> Column:
    return F.expr(f"cast(array() as {_SPAN})")


#: Items that a running fold takes at once: arrays grow by copying, so they are grown in blocks.
_BLOCK = 128


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often it is used: inside a lambda all else is done anew for each item."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(items: Column, zero: Column, add, join, emit, emitted: str) -> Column:
    """``emit(state, item)`` for each item in order, the state being that before the item; in time that grows with the items.

    Each block is folded for its total by ``add``, the totals are joined by ``join``, and then each
    block is run through from where the blocks before it end. ``emitted`` is the type of what comes out.
    """

    def over_blocks(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, zero, add))
        start = F.struct(zero.alias("at"), F.array().cast(f"array<{_STATE}>").alias("starts"))
        starts = F.aggregate(
            totals,
            start,
            lambda a, t: F.struct(join(a["at"], t).alias("at"), F.concat(a["starts"], F.array(a["at"])).alias("starts")),
            lambda a: a["starts"],
        )
        return F.flatten(F.zip_with(blocks, starts, inside))

    def inside(block: Column, before: Column) -> Column:
        return F.aggregate(
            block,
            F.struct(before.alias("at"), F.array().cast(f"array<{emitted}>").alias("out")),
            lambda a, x: F.struct(add(a["at"], x).alias("at"), F.concat(a["out"], F.array(emit(a["at"], x).cast(emitted))).alias("out")),
            lambda a: a["out"],
        )

    def in_blocks(whole: Column) -> Column:
        last = F.floor((F.size(whole) - 1) / _BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(whole, i * _BLOCK + 1, F.lit(_BLOCK)))

    whole = _bound(items, lambda whole: _bound(in_blocks(whole), over_blocks))
    return F.when(F.size(items) > 0, whole).otherwise(F.array().cast(f"array<{emitted}>"))


_STATE = "int"
_ONE = "struct<start:int,kind:int,end:int>"


def _places(text: Column, found: Column, pattern: str, kind: int) -> Column:
    """The spans of all matches, from the lengths of the matches and of what stands between them."""
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("between"), found.alias("match"))
    lengths = F.transform(
        F.filter(zipped, lambda z: z["match"].isNotNull()),
        lambda z: F.struct(F.length(z["between"]).alias("gap"), F.length(z["match"]).alias("size")),
    )
    span = lambda at, x: F.struct((at + x["gap"]).alias("start"), F.lit(kind).alias("kind"), (at + x["gap"] + x["size"]).alias("end"))
    spans = _running(lengths, F.lit(0), lambda at, x: at + x["gap"] + x["size"], lambda a, b: a + b, span, _ONE)
    return F.when(F.size(found) > 0, spans).otherwise(_no_spans())


def _tail(z: Column) -> Column:
    """The chance that a normal variable is above ``z``, by the logistic curve closest to it."""
    return 1 / (1 + F.exp(1.5976 * z + 0.070566 * z * z * z))


def _both_tails(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * _tail(F.abs(z)))


#: How many letters of a row of the fixed counts weigh against those of a corpus, and the share of
#: any letter after any other, which bounds what a rare pair says.
_FIXED, _ANY = 200.0, 0.1


def _rarities(pairs: dict[tuple[str, str], int]) -> list[str]:
    """As ``_ENGLISH``, in eighths of a nat from ``!``, for counts of (letter or nothing, next letter)."""
    out = []
    for before, fixed in zip([*_LOWER, ""], _ENGLISH.split()):
        shares = [math.exp(-(ord(c) - ord("a")) / 4) for c in fixed]
        counts = [pairs.get((before, c), 0) + _FIXED * share / sum(shares) for c, share in zip(_LOWER, shares)]
        out.append("".join(chr(33 + round(-8 * math.log((1 - _ANY) * n / sum(counts) + _ANY / 26))) for n in counts))
    return out


def letters(docs: DataFrame) -> list[str]:
    """How rare each letter is after each other one in the words of ``text``, for ``secret_spans``.

    Words are runs of two or more ASCII letters with no digit or sign of an encoding beside
    them. Counted by Spark; 702 numbers at most are collected. A corpus with few words changes little.
    """
    words = F.filter(F.split(F.lower("text"), "[^a-z0-9+/_=-]+"), lambda w: w.rlike("^[a-z]{2,}$"))
    counted = docs.select(F.explode(words).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    steps = F.transform(
        F.sequence(F.lit(1), F.length("w")),
        lambda i: F.struct(F.when(i > 1, F.substring("w", i - 1, F.lit(1))).otherwise("").alias("a"), F.substring("w", i, F.lit(1)).alias("b")),
    )
    pairs = counted.select("n", F.explode(steps).alias("p")).groupBy("p.a", "p.b").agg(F.sum("n").alias("n"))
    return _rarities({(r["a"], r["b"]): r["n"] for r in pairs.collect()})


def _battery(token: Column, encoding: str, rare: Sequence[str]) -> Column:
    """``random``: no test rejects randomness; ``chance``: that ordinary text looks as random.

    Three tests on the symbols' numbers in the alphabet: chi-squared against equal
    shares (with the variance that holds at this length), runs above and below the
    middle, and serial correlation. The chance is the likelihood of the characters as
    ordinary text over that as random ones, which bounds it (Markov's inequality). In ordinary
    text letters follow letters as in ``rare``, in any case, digits and signs are equally
    likely, and kinds of characters change at a fixed rate. Both likelihoods are products over
    the characters, so the chance of random ones falls with the length.
    """
    alphabet = _ALPHABETS[encoding]
    size = len(alphabet)
    bare = F.rtrim(token, F.lit("="))
    text = F.translate(bare, "-_", "+/") if encoding == "base64" else F.upper(bare)
    number = F.filter(
        F.transform(F.split(text, ""), lambda c: F.instr(F.lit(alphabet), c) - 1), lambda x: x >= 0
    )

    def kind(v: Column) -> Column:
        if size == 16:
            return F.when(v < 10, 2).otherwise(0)
        if size < 64:
            return F.when(v < 26, 0).otherwise(2)
        return F.when(v < 26, 0).when(v < 52, 1).when(v < 62, 2).otherwise(3)

    rows = F.array(*[F.lit(r) for r in rare])
    turn = math.log((3 if size == 64 else 1) / _CHANGE)

    def letter(v: Column) -> Column:
        """0 to 25, or 26 for what is no letter."""
        if size == 64:
            return F.when(v < 52, v % 26).otherwise(26)
        if size == 16:
            return F.when(v >= 10, v - 10).otherwise(26)
        return F.when(v < 26, v).otherwise(26)

    def symbol(before: Column, v: Column) -> Column:
        """Nats of a character in ordinary text, given that of which kind it is."""
        after = F.ascii(F.substring(F.get(rows, before), letter(v) + 1, F.lit(1))) - 33
        return F.when(letter(v) < 26, after / 8.0).when(kind(v) == 3, math.log(2)).otherwise(math.log(10))

    def judged(x: Column) -> Column:
        n = F.size(x).cast("double")
        counts = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(x, lambda v: v == i)))
        squares = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c)
        chi = size * squares / n - n
        z_chi = (chi - (size - 1)) / F.sqrt(2.0 * (size - 1) * (n - 1) / n)
        high = F.transform(x, lambda v: (v >= size // 2).cast("int"))
        ones = F.aggregate(high, F.lit(0), lambda a, v: a + v).cast("double")
        follow = F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        turns = F.size(F.filter(follow, lambda p: (p["a"] >= size // 2) != (p["b"] >= size // 2))).cast("double")
        mean_runs = 1 + 2 * ones * (n - ones) / n
        spread = F.greatest((mean_runs - 1) * (mean_runs - 2) / (n - 1), F.lit(0.25))
        z_runs = (turns + 1 - mean_runs) / F.sqrt(spread)
        mid = (size - 1) / 2
        lagged = F.aggregate(follow, F.lit(0.0), lambda a, p: a + (p["a"] - mid) * (p["b"] - mid))
        z_serial = lagged / ((size * size - 1) / 12) / F.sqrt(n - 1)
        first = F.get(x, F.lit(0))
        ordinary = F.aggregate(
            follow,
            F.lit(math.log(4 if size == 64 else 2)) + symbol(F.lit(26), first),
            lambda a, p: a + symbol(letter(p["a"]), p["b"]) + F.when(kind(p["a"]) != kind(p["b"]), turn).otherwise(-math.log(1 - _CHANGE)),
        )
        chance = F.least(F.lit(1.0), F.exp(n * math.log(size) - ordinary))
        passed = (_tail(z_chi) >= REJECT) & (_both_tails(z_runs) >= REJECT) & (_both_tails(z_serial) >= REJECT)
        return F.struct((passed & (n >= 20)).alias("random"), chance.alias("chance"))

    # a one-element array names the numbers once for all tests
    return F.element_at(F.transform(F.array(number), judged), 1)


def _judged(token: Column, rare: Sequence[str]) -> Column:
    """The battery under the encoding inferred from the characters; null if none is likely."""
    digit, letter = token.rlike("[0-9]"), token.rlike("[A-Za-z]")
    is_hex = token.rlike("^([0-9a-f]+|[0-9A-F]+)$") & digit & letter
    is_32 = token.rlike("^([A-Z2-7]+|[a-z2-7]+)=*$") & digit & letter
    is_36 = token.rlike("^([A-Z0-9]+|[a-z0-9]+)$") & digit & letter
    is_64 = token.rlike("^([A-Za-z0-9+/]+|[A-Za-z0-9_-]+)=*$") & token.rlike("[a-z]") & token.rlike("[A-Z]")
    return (
        F.when(is_hex, _battery(token, "hex", rare))
        .when(is_32, _battery(token, "base32", rare))
        .when(is_36, _battery(token, "base36", rare))
        .when(is_64, _battery(token, "base64", rare))
    )


def _parts(of: Column, pattern: str) -> Column:
    """What a pattern finds in a candidate, as candidates; one that is all of it is not tried again."""
    token, found = of["token"], F.regexp_extract_all(of["token"], F.lit(pattern), F.lit(0))
    zipped = F.arrays_zip(_places(token, found, pattern, KINDS.index("random")).alias("place"), found.alias("token"))
    return F.transform(
        zipped,
        lambda z: _candidate(
            of["start"] + z["place"]["start"], of["start"] + z["place"]["end"], z["token"], F.length(z["token"]) < F.length(token)
        ),
    )


def _candidate(start: Column, end: Column, token: Column, tried: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"), token.alias("token"), tried.alias("tried"))


def _groups(run: Column, token: Column) -> Column:
    """A run alone, then each part between slashes followed by its parts between any signs."""

    def groups(r: Column) -> Column:
        parts = F.transform(_parts(r, PARTS[0]), lambda p: F.concat(F.array(p), _parts(p, PARTS[1])))
        return F.concat(F.array(F.array(r)), parts)

    return _bound(_candidate(run["start"], run["end"], token, F.lit(True)), groups)


def _near(base: Column, runs: Column) -> Column:
    """For each of the runs, which lie apart and in order, the base spans that may overlap it.

    Base spans are in order of their starts. Those that start before a run's end are a
    beginning of that order; so are those up to which none ends after the run's start.
    """

    def counted(keys: Column, asked: Column) -> Column:
        """For each asked number how many keys are smaller (or equal, where keys are put first)."""
        event = lambda at, is_asked: F.struct(at.alias("at"), F.lit(is_asked).alias("asked"))
        events = F.array_sort(F.concat(F.transform(keys, lambda k: event(k, 0)), F.transform(asked, lambda x: event(x, 1))))
        seen = _running(
            events, F.lit(0), lambda n, e: n + 1 - e["asked"], lambda a, b: a + b,
            lambda n, e: F.struct(n.alias("n"), e["asked"].alias("asked")), "struct<n:int,asked:int>",
        )
        return F.transform(F.filter(seen, lambda e: e["asked"] == 1), lambda e: e["n"])

    ends = _running(base, F.lit(0), lambda m, b: F.greatest(m, b["end"]), lambda a, b: F.greatest(a, b), lambda m, b: F.greatest(m, b["end"]), "int")
    first = counted(ends, F.transform(runs, lambda r: r["start"]))
    last = counted(F.transform(base, lambda b: b["start"]), F.transform(runs, lambda r: r["end"] - 1))
    near = lambda spans: F.zip_with(first, last, lambda a, b: F.slice(spans, a + 1, F.greatest(b - a, F.lit(0))))
    none = F.transform(runs, lambda r: _no_spans())
    return F.when(F.size(base) > 0, _bound(base, near)).otherwise(none)


def _trees(runs: Column, tokens: Column, base: Column, rare: Sequence[str]) -> Column:
    """Each run's groups of candidates, with ``judged``, the battery, and ``free``: tried, of a likely encoding and apart from base spans."""
    zipped = F.arrays_zip(runs.alias("run"), tokens.alias("token"), _near(base, runs).alias("near"))

    def node(c: Column, near: Column) -> Column:
        judged = F.when(c["tried"], _judged(c["token"], rare))
        fields = lambda j: F.struct(
            c["start"].alias("start"),
            F.lit(KINDS.index("random")).alias("kind"),
            c["end"].alias("end"),
            j.alias("judged"),
            (j.isNotNull() & ~F.exists(near, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))).alias("free"),
        )
        return _bound(judged, fields)

    return F.transform(
        zipped, lambda z: F.transform(_groups(z["run"], z["token"]), lambda g: F.transform(g, lambda c: node(c, z["near"])))
    )


def _controlled(chances: Column, alpha: float) -> Column:
    """Benjamini-Hochberg over a document's tokens: the chance up to which finds are kept."""
    within = lambda ordered, n: F.transform(
        ordered, lambda p, i: F.when(p <= alpha * (i + 1) / n, p).otherwise(F.lit(-1.0))
    )
    return _bound(F.array_sort(chances), lambda ordered: _bound(F.size(ordered), lambda n: F.array_max(within(ordered, n))))


def _kept(groups: Column, limit: Column) -> Column:
    """Of a run and its parts the likeliest finds, none inside another.

    A find goes where something inside it is a likelier one; then what lies inside another that
    is left goes.
    """
    found = lambda x: F.coalesce(x["free"] & x["judged"]["random"] & (x["judged"]["chance"] <= limit), F.lit(False))
    chance = lambda x: F.when(found(x), x["judged"]["chance"]).otherwise(2.0)
    span = lambda x: F.struct(*[x[f].alias(f) for f in ("start", "kind", "end")])
    finds = lambda nodes: F.transform(F.filter(nodes, found), span)
    none = _no_spans()

    def least(nodes: Column) -> Column:
        return F.coalesce(F.array_min(F.transform(nodes, chance)), F.lit(2.0))

    def headed(group: Column, head: Column) -> Column:
        """The head's span if it is found and nothing after it is likelier."""
        return F.when(found(head) & (chance(head) <= least(group)), F.array(span(head)))

    def of_part(group: Column) -> Column:
        return F.coalesce(headed(group, F.get(group, F.lit(0))), finds(F.slice(group, 2, F.size(group))))

    run = F.get(F.get(groups, F.lit(0)), F.lit(0))
    parts = F.slice(groups, 2, F.size(groups))
    likeliest = F.coalesce(F.array_min(F.transform(parts, least)), F.lit(2.0))
    whole = found(run) & (chance(run) <= likeliest)
    return F.when(whole, F.array(span(run))).otherwise(F.coalesce(F.flatten(F.transform(parts, of_part)), none))


def secret_spans(
    docs: DataFrame,
    alpha: float = FALSE_DISCOVERIES,
    keep: Sequence[str] = (),
    name: str = "spans",
    rare: Sequence[str] | None = None,
) -> DataFrame:
    """``doc_id, text, spans`` for every row: the secrets of each text, beside the ``keep`` columns.

    ``spans`` (or ``name``) holds structs of start, kind (a number in ``KINDS``) and end in code points,
    end exclusive, in order of start, kind, end. Kinds ``assign``, ``access`` and ``hex``
    are the leftmost non-overlapping matches of their patterns. Kind ``random`` has
    further tokens of 20 or more characters, whole runs and their parts between signs, apart
    from those matches, that no test of the battery finds other than random, and whose chance of being ordinary text passes
    false-discovery control within the document; chances fall with length, so short
    tokens must look better. What is ordinary follows ``rare``, from ``letters`` of a corpus; by
    default it is English. Of a run and its parts the likeliest are reported, none inside another. A null or empty text has no spans. No shuffle, no Python.
    """
    rare = _rarities({}) if rare is None else rare
    kept_as = {f"_k{i}": c for i, c in enumerate(keep)}  # their own names may clash with ours
    own = docs.select(
        F.col("doc_id").alias("doc_id"), F.col("text").alias("text"), *[F.col(f"`{c}`").alias(k) for k, c in kept_as.items()]
    )
    rest = list(kept_as)
    text = F.coalesce(F.col("text"), F.lit(""))
    patterns = (ASSIGN, ACCESS, HEX, TOKEN)
    nothing = F.expr("cast(array() as array<string>)")
    any_case = F.lower(text)
    words = [F.contains(any_case, F.lit(w)) for w in ("passw", "secret", "token", "api")]
    # what must be in a text for a pattern to match, cheaper to look for than the pattern
    may_hold = {
        "_assign": words[0] | words[1] | words[2] | words[3],
        "_access": F.contains(text, F.lit("AKIA")),
        "_hex": F.size("_random") > 0,
        "_random": F.lit(True),
    }
    found = own
    for kind, pattern in reversed([*zip(KINDS, patterns)]):
        matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        found = found.withColumn(f"_{kind}", F.when(may_hold[f"_{kind}"], matches).otherwise(nothing))
    all_of = [_places(text, F.col(f"_{k}"), p, i) for i, (k, p) in enumerate(zip(KINDS, patterns))]
    long_enough = F.transform("_assign", lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6)
    placed = found.select(
        "doc_id",
        "text",
        *rest,
        F.filter(F.transform(F.arrays_zip(all_of[0].alias("s"), long_enough.alias("ok")), lambda z: F.when(z["ok"], z["s"])), lambda s: s.isNotNull()).alias("assign"),
        all_of[1].alias("access"),
        all_of[2].alias("hex"),
        all_of[3].alias("runs"),
        F.col("_random").alias("tokens"),
    )
    base = placed.select("doc_id", "text", *rest, F.array_sort(F.concat("assign", "access", "hex")).alias("base"), "runs", "tokens")
    trees = F.when(F.size("runs") > 0, _trees(F.col("runs"), F.col("tokens"), F.col("base"), rare))
    # one row in, one row out: the trees are made once, whatever is done with them
    judged = base.select("doc_id", "text", *rest, "base", F.explode(F.array(trees)).alias("trees"))
    chances = F.transform(
        F.filter(F.flatten(F.flatten("trees")), lambda x: x["free"]),
        lambda x: F.when(x["judged"]["random"], x["judged"]["chance"]).otherwise(1.0),
    )
    judged = judged.select("*", F.when(F.size("trees") > 0, _controlled(chances, alpha)).alias("limit"))
    kept = F.flatten(F.transform("trees", lambda t: _kept(t, F.col("limit"))))
    return judged.select(
        "doc_id",
        "text",
        *[F.col(k).alias(c) for k, c in kept_as.items()],
        F.when(F.col("limit") >= 0, F.array_sort(F.concat("base", kept))).otherwise(F.col("base")).alias(name),
    )


def span_list(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def masked(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with every span, overlapping ones together, replaced by ``mask``; null stays null.

    Spans come in order. The text is cut in blocks of them and the blocks in pieces, so that no
    piece is looked for from the beginning of the text.
    """
    piece = lambda at, s: F.struct(at.alias("from"), s["start"].alias("to"))
    pieces = _running(
        spans, F.lit(0), lambda at, s: F.greatest(at, s["end"]), lambda a, b: F.greatest(a, b), piece, "struct<from:int,to:int>"
    )

    def of_block(block: Column) -> Column:
        first = F.element_at(block, 1)["from"]
        region = F.substring(text, first + 1, F.element_at(block, -1)["to"] - first)
        named = F.struct(first.alias("first"), region.alias("region"), block.alias("block"))
        return _bound(
            named,
            lambda n: F.array_join(
                F.transform(n["block"], lambda p: F.concat(F.substring(n["region"], p["from"] - n["first"] + 1, p["to"] - p["from"]), F.lit(mask))), ""
            ),
        )

    def whole(kept: Column) -> Column:
        last = F.floor((F.size(kept) - 1) / _BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(kept, i * _BLOCK + 1, F.lit(_BLOCK)))
        return F.array_join(F.transform(blocks, of_block), "")

    done = _bound(F.filter(pieces, lambda p: p["to"] >= p["from"]), whole)
    end = F.array_max(F.transform(spans, lambda s: s["end"]))
    return F.when(F.size(spans) > 0, F.concat(done, F.substring(text, end + 1, F.length(text)))).otherwise(text)
