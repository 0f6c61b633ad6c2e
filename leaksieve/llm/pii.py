"""Personal data: fixed patterns, and a semi-Markov conditional random field for what they miss.

The patterns fail where entities touch: a phone number followed by a card number is one
match with too many digits. The field scores whole candidate segments by their features
and chooses boundaries and types of all entities of a stretch together.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Units a candidate segment may have.
LONGEST = 16
#: Stretches that the field is fitted on, and the units each may have.
TRAINING = 600
TRAINING_UNITS = 80

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits is tried at its start only: nothing that starts inside it does better.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """(start, kind, end) of the patterns' matches that pass, in order, and the spans of those that fail."""
    kept, failed = [], []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            kept.append((start, 0, domain.end()))
            free = domain.end()
        at = text.find("@", max(at + 1, free))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split(".")):
                kept.append((m.start(), 1, m.end()))
            else:
                failed.append(m.span())
        for kind, pattern in ((2, _CARD), (3, _PHONE)):
            for m in pattern.finditer(text):
                digits = _digits(m[0])
                ok = 12 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 9 <= len(digits) <= 15
                if ok:
                    kept.append((m.start(), kind, m.end()))
                elif len(digits) >= 9:
                    failed.append(m.span())
    return sorted(kept), failed


# --- stretches, units and candidate segments

#: Neighbouring words with a digit or an at sign make a stretch.
_STRETCH = re.compile(r"(?:(?<=\s)|\A)[^\s0-9@]*+[0-9@]\S*(?:\s[^\s0-9@]*+[0-9@]\S*)*")
_UNIT = re.compile(r"[0-9]+|[A-Za-z]+|\s|.", re.S)

_EMAIL_LIKE = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_QUAD = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}")
_NUMBER = re.compile(r"[0-9]+(?:[ -][0-9]+)*")
_GROUPS = re.compile(r"\+?[0-9()][0-9 ().-]*[0-9]")
N_FEATURES = 16


def _features(text: str, start: int, end: int) -> list[float]:
    """What a whole segment looks like, and what stands beside it."""
    s = text[start:end]
    digits = _digits(s)
    n = len(digits)
    number, groups = bool(_NUMBER.fullmatch(s)), bool(_GROUPS.fullmatch(s))
    before, after = text[start - 1 : start], text[end : end + 1]
    return [
        1.0,
        float(bool(_EMAIL_LIKE.fullmatch(s))),
        float(bool(_QUAD.fullmatch(s)) and all(int(p) <= 255 for p in s.split("."))),
        float(number and 12 <= n <= 19 and luhn(digits)),
        float(number and n in (15, 16) and " " not in s),
        float(number and 12 <= n <= 19),
        float(groups and s[0] == "+" and 9 <= n <= 15),
        float(groups and s[0] == "+" and "(" in s and ")" in s),
        float(groups and s[0] == "+" and 11 <= n <= 13),
        float(groups),
        float("@" in s),
        float(n < 7),
        float(n > 16),
        float(before.isalnum() or before in ("_", "@") and bool(before)),
        float(after.isalnum() or after in ("_", "@") and bool(after)),
        float(any(c.isspace() for c in s)),
    ]


def _stretches(text: str):
    for m in _STRETCH.finditer(text):
        yield m.start(), m.end()


def _units(text: str, start: int, end: int) -> list[int]:
    """The borders between units, both ends included."""
    return [start, *[m.end() for m in _UNIT.finditer(text, start, end)]]


def _segments(text: str, borders: list[int]) -> list[tuple[int, int]]:
    """Candidates as pairs of border numbers: they begin and end like an entity and have a digit or at sign enough."""
    out = []
    for i in range(len(borders) - 1):
        c = text[borders[i]]
        if not (c.isalnum() and c.isascii() or c in "+("):
            continue
        for j in range(i + 1, min(len(borders), i + 1 + LONGEST)):
            last = text[borders[j] - 1]
            if last.isalnum() and last.isascii():
                s = text[borders[i] : borders[j]]
                if "@" in s or sum(ch in "0123456789" for ch in s) >= 4:
                    out.append((i, j))
    return out


@dataclass
class Field:
    """Weights of the features for each kind; a unit outside all entities scores nothing."""

    weights: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        return features @ self.weights.T


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + float(np.log(np.exp(np.array(values) - top).sum()))


def _expected(n: int, segments: list[tuple[int, int]], scores: np.ndarray) -> tuple[np.ndarray, float]:
    """Chance of each segment and kind, and the log of the sum over all segmentations."""
    total = np.array([_log_sum(list(s)) for s in scores]) if len(segments) else np.zeros(0)
    ending: list[list[int]] = [[] for _ in range(n + 1)]
    opening: list[list[int]] = [[] for _ in range(n + 1)]
    for k, (i, j) in enumerate(segments):
        ending[j].append(k)
        opening[i].append(k)
    forward, back = [0.0] * (n + 1), [0.0] * (n + 1)
    for j in range(1, n + 1):
        forward[j] = _log_sum([forward[j - 1], *[forward[segments[k][0]] + total[k] for k in ending[j]]])
    for i in range(n - 1, -1, -1):
        back[i] = _log_sum([back[i + 1], *[back[segments[k][1]] + total[k] for k in opening[i]]])
    chance = np.array([forward[i] + back[j] for i, j in segments]) if segments else np.zeros(0)
    return np.exp(chance[:, None] + scores - forward[n]) if segments else scores, forward[n]


def fit(examples: list[tuple[str, list[tuple[int, int, int]]]], rounds: int = 30, rate: float = 0.5, decay: float = 1e-3) -> Field:
    """Maximum likelihood by gradient ascent (adaptive steps) on stretches with their entities.

    ``examples`` are texts with (start, kind, end) of what is marked in them; entities
    that no candidate segment equals are left out.
    """
    made = []
    for text, marked in examples:
        borders = _units(text, 0, len(text))
        segments = _segments(text, borders)
        features = np.array([_features(text, borders[i], borders[j]) for i, j in segments]).reshape(-1, N_FEATURES)
        place = {(borders[i], borders[j]): k for k, (i, j) in enumerate(segments)}
        truth = np.zeros((len(segments), len(KINDS)))
        for start, kind, end in marked:
            if (start, end) in place:
                truth[place[start, end], kind] = 1
        made.append((len(borders) - 1, segments, features, truth))
    weights, squares = np.zeros((len(KINDS), N_FEATURES)), np.full((len(KINDS), N_FEATURES), 1e-6)
    weights[:, 0] = -2.0
    for _ in range(rounds):
        step = -decay * len(made) * weights
        for n, segments, features, truth in made:
            if segments:
                chance, _ = _expected(n, segments, features @ weights.T)
                step += (truth - chance).T @ features
        squares += step * step
        weights += rate * step / np.sqrt(squares)
    return Field(weights)


def decode(field: Field, text: str, start: int, end: int) -> list[tuple[int, int, int]]:
    """The best segmentation of a stretch: (start, kind, end) of its entities."""
    borders = _units(text, start, end)
    segments = _segments(text, borders)
    if not segments:
        return []
    scores = field.scores(np.array([_features(text, borders[i], borders[j]) for i, j in segments]))
    kind, score = scores.argmax(axis=1), scores.max(axis=1)
    ending: dict[int, list[int]] = {}
    for k, (_, j) in enumerate(segments):
        ending.setdefault(j, []).append(k)
    best, via = [0.0] * len(borders), [-1] * len(borders)
    for j in range(1, len(borders)):
        best[j] = best[j - 1]
        for k in ending.get(j, ()):
            value = best[segments[k][0]] + score[k]
            if value > best[j]:
                best[j], via[j] = value, k
    out, j = [], len(borders) - 1
    while j > 0:
        if via[j] < 0:
            j -= 1
        else:
            i = segments[via[j]][0]
            out.append((borders[i], int(kind[via[j]]), borders[j]))
            j = i
    return out[::-1]


# --- over documents


#: What fails a pattern for certain: without a break inside it holds no two entities that touch.
_UNBROKEN = re.compile(r"[0-9.]+")


def _class(marked: list, refused: bool) -> int:
    """0, 1 or more entities; 3 where a pattern fails for certain."""
    return 3 if refused else min(len(marked), 2)


def _examples(batches, each: int):
    """Stretches whose pattern matches are beyond doubt: none fails there but for certain, none crosses another.

    Of each class a task hands on the ``each`` different ones of smallest hash, with that hash.
    """
    least: list[list] = [[] for _ in range(4)]
    held: set[str] = set()
    for batch in batches:
        for text in batch.column("text").to_pylist():
            if not text:
                continue
            kept, failed = base_spans(text)
            for start, end in _stretches(text):
                inside = [s for s in kept if start <= s[0] and s[2] <= end]
                refused = [text[a:b] for a, b in failed if a < end and start < b]
                clean = all(a[2] <= b[0] for a, b in zip(inside, inside[1:])) and all(map(_UNBROKEN.fullmatch, refused))
                if clean and len(inside) <= 8 and end - start <= 4 * TRAINING_UNITS:
                    part = text[start:end]
                    if part in held or len(_units(part, 0, len(part))) > TRAINING_UNITS:
                        continue
                    marked = [{"start": s - start, "kind": k, "end": e - start} for s, k, e in inside]
                    row = (-int.from_bytes(hashlib.blake2b(part.encode(), digest_size=7).digest()), part, marked)
                    heap = least[_class(marked, bool(refused))]
                    if len(heap) < each:
                        heapq.heappush(heap, row)
                        held.add(part)
                    elif row[:2] > heap[0][:2]:
                        held.discard(heapq.heapreplace(heap, row)[1])
                        held.add(part)
    rows = [(*r, shape) for shape, heap in enumerate(least) for r in heap]
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([-r[0] for r in rows], pa.int64()),
            pa.array([r[1] for r in rows], pa.string()),
            pa.array([r[2] for r in rows], pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int64()), ("end", pa.int64())]))),
            pa.array([r[3] for r in rows], pa.int32()),
        ],
        names=["h", "part", "marked", "shape"],
    )


_MADE = "h long, part string, marked array<struct<start:long,kind:long,end:long>>, shape int"


def train(docs: DataFrame, limit: int = TRAINING) -> Field:
    """A field fitted on what the patterns mark in ``docs``.

    Bounded: ``limit`` different stretches, those of smallest hash, a third each with several
    marks, with one and without, each of at most 80 units; and a third of ``limit`` more in which an
    unbroken run fails its pattern, as a number of a card's length with a wrong check digit, so that
    the field learns what to refuse. Copies count once, however many there are. The texts are read
    once; a task hands on no more than those. Without any, the field marks nothing.
    """
    each = limit // 3
    found = (
        docs.select(F.col("text").alias("text"))
        .where(F.col("text").rlike("[0-9@]"))
        .mapInArrow(lambda batches: _examples(batches, each), _MADE)
    )
    once = found.groupBy("h", "part").agg(F.min("marked").alias("marked"), F.min("shape").alias("shape"))
    rank = F.row_number().over(Window.partitionBy("shape").orderBy("h", "part"))
    rows = once.withColumn("rank", rank).where(F.col("rank") <= each).collect()
    return fit(sorted((r.part, [(m.start, m.kind, m.end) for m in r.marked]) for r in rows))


_OUT = "doc_id long, base array<struct<start:int,kind:int,end:int>>, added array<struct<start:int,kind:int,end:int>>"
_LIST = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))


def _named(spans):
    return [{"start": s, "kind": k, "end": e} for s, k, e in spans]


def _found(batches, field: Field):
    for batch in batches:
        base, added = [], []
        for text in batch.column("text").to_pylist():
            text = text or ""
            kept, failed = base_spans(text)
            more = []
            if kept or failed or _DIGIT.search(text):
                for start, end in _stretches(text):
                    more += decode(field, text, start, end)
            taken = sorted((s, e) for s, _, e in kept)
            starts = np.array([s for s, _ in taken], np.int64)
            reach = np.maximum.accumulate(np.array([e for _, e in taken], np.int64)) if taken else starts
            clear = []
            for s, k, e in more:
                before = int(np.searchsorted(starts, e)) if taken else 0  # base spans that start before the end
                if not before or reach[before - 1] <= s:
                    clear.append((s, k, e))
            base.append(_named(kept))
            added.append(_named(clear))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(base, _LIST), pa.array(added, _LIST)], names=["doc_id", "base", "added"]
        )


def personal_data(docs: DataFrame, field: Field) -> DataFrame:
    """``doc_id, base, added`` for every row: the patterns' spans and what the field finds beside them.

    Spans are structs of start, kind (a number in ``KINDS``) and end in code points, end
    exclusive, by start and kind. ``added`` spans lie apart from all ``base`` spans. Null
    or empty text has none. The field looks at stretches of words with digits or at signs
    only, in time that grows with their length. No shuffle; other columns are not looked at.
    """
    sent = docs.sparkSession.sparkContext.broadcast(field)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return own.mapInArrow(lambda batches: _found(batches, sent.value), _OUT)


def span_list(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )
