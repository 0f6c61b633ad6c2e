"""What byte-level and word-level removal of repeated windows share.

A window is a run of ``window`` units (bytes or words) of one document. Among its grams
of ``gram`` units the one of smallest hash is its anchor: equal windows have equal
anchors. So windows are looked at together only where their anchor occurs twice:

1. Every document's anchors are counted. Consecutive windows share an anchor, so there
   are far fewer anchors than windows.
2. Documents learn which of their anchors are repeated, and send out the pieces of text
   around those. Of pieces that are equal within a task, one stands for all.
3. Pieces with the same anchor meet. There the caller's method finds the equal windows.
4. Pieces of a hot anchor, one that occurs more often than a task should hold, do not
   meet there: they are dealt out over all tasks and cut again, at anchors of twice as many
   units, which are shared by fewer places. These meet in the next round, by the same
   method. In the last round a whole window is its own anchor: what meets is equal, and of
   equal pieces a task holds one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    NOT_SPACE, Prefix, byte_values, chunked, flat, mix, ranges, word_hashes, word_spans, written,
)

#: Pieces of one anchor that a task holds at once; an anchor that occurs more often is hot, and cut at longer ones.
GROUP = 50_000
#: Bytes of pieces looked at together.
TOGETHER = 3 << 20
#: Windows looked at in one go while anchors are chosen.
SEGMENT = 1 << 20
#: Second base for hashes of 128 bits.
_OTHER = 0xD1342543DE82EF95

_ANCHORS = "doc_id long, tag long, anchor long, n long"
_PIECES = "anchor long, doc_id long, tag long, start long, n int, many boolean, answered boolean, hot boolean, text binary"
_FOUND = "doc_id long, tag long, start long, end long, anchor long, n int, many boolean, text binary"


@dataclass(frozen=True)
class Windows:
    """``window`` units make a window, ``gram`` an anchor; units are words or bytes."""

    window: int
    gram: int
    words: bool

    def finer(self) -> Windows | None:
        """The same windows at anchors of twice as many units, at most a window; none if they are that long."""
        return replace(self, gram=min(2 * self.gram, self.window)) if self.gram < self.window else None

    def units(self, column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The bytes, the units' values, starts and ends, and each document's first unit."""
        data, offsets = flat(column)
        if not self.words:
            at = np.arange(len(data) + 1)
            return data, byte_values(1)[data], at[:-1], at[1:], offsets
        starts, ends, first = word_spans(data, offsets, NOT_SPACE)
        return data, word_hashes(data, starts, ends), starts, ends, first

    def runs(self, values: np.ndarray, first: np.ndarray):
        """Runs of windows with the same anchor: its hash, the first window, how many, the document."""
        none = np.zeros(0, np.int64)
        parts = [(none.astype(np.uint64), none, none, none)]
        total = len(values) - self.window + 1
        for base in range(0, total, SEGMENT):
            size = min(SEGMENT, total - base)
            end = np.minimum(len(values), base + size + self.window - 1)
            grams = mix(Prefix(values[base:end]).rolling(self.gram))
            low = np.uint64((1 << int(len(grams)).bit_length()) - 1)
            least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
            span, width = self.window - self.gram + 1, 1
            while 2 * width <= span:
                least = np.minimum(least[:-width], least[width:])
                width *= 2
            least = np.minimum(least[: size], least[span - width : span - width + size])
            doc = np.searchsorted(first, np.arange(base, base + size), "right") - 1
            at = np.flatnonzero(np.arange(base, base + size) + self.window <= first[doc + 1])
            if not len(at):
                continue
            anchor = (least[at] & low).astype(np.int64)
            new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (np.diff(at) > 1)]))
            parts.append((grams[anchor[new]], at[new] + base, np.diff(np.append(new, len(at))), doc[at[new]]))
        return tuple(np.concatenate(x) for x in zip(*parts))

    def digests(self, values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of 128 bits for runs of units."""
        return tuple(mix(p.spans(starts, starts + lengths)) for p in (Prefix(values), Prefix(mix(values), _OTHER)))


def _keyed(docs: DataFrame) -> DataFrame:
    """Id (the lowest number for none), a tag of the text to tell rows with one id apart, and the text."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"),
        F.xxhash64("text").alias("tag"),
        F.col("text").alias("text"),
    )


def _anchors(batches, spec: Windows):
    for batch in chunked(batches):
        _, values, _, _, first = spec.units(batch.column("text"))
        anchor, _, _, doc = spec.runs(values, first)
        if not len(anchor):
            continue
        order = np.lexsort((anchor, doc))
        anchor, doc = anchor[order], doc[order]
        new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").take(pa.array(doc[new])),
                batch.column("tag").take(pa.array(doc[new])),
                pa.array(anchor[new].view(np.int64)),
                pa.array(np.diff(np.append(new, len(anchor)))),
            ],
            names=["doc_id", "tag", "anchor", "n"],
        )


def first_of_equal(a, b, *order) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows sorted by hash and then ``order``; which are the first of their hash, and how many there are of it."""
    rows = np.lexsort((*reversed(order), b, a))
    new = np.concatenate([[True], (a[rows][1:] != a[rows][:-1]) | (b[rows][1:] != b[rows][:-1])]) if len(rows) else np.zeros(0, bool)
    sizes = np.diff(np.append(np.flatnonzero(new), len(rows)))
    return rows, new, np.repeat(sizes, sizes)


def one_of_equal(a, b, doc_id, tag, place, many, earliest: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of equal pieces the first, in the order given; whether it stands for many; and those whose windows are known to be repeated."""
    rows, new, sizes = first_of_equal(a, b, doc_id, tag, place)
    group = np.cumsum(new) - 1
    if earliest:
        # a repeat of the first place is no later place, and rows that repeat id and text are one place
        at = np.stack([doc_id[rows], tag[rows], place[rows]])
        told = (at != at[:, new][:, group]).any(axis=0)
        told[1:] &= new[1:] | (at[:, 1:] != at[:, :-1]).any(axis=0)
    else:
        told = (sizes > 1) & ~many[rows]
    stands = sizes[new] > 1
    stands[group[many[rows]]] = True
    carry = rows[new]
    order = np.argsort(carry)
    return carry[order], stands[order], rows[told]


def _cut(spec: Windows, units, run, doc_id, tag, base, many, earliest: bool):
    """Runs of windows as pieces: all their columns, which go on with their texts, and which are repeated already.

    ``doc_id``, ``tag``, ``many`` and ``base``, the place of the first unit, are those of the texts they are cut from.
    """
    data, values, unit_start, unit_end, first = units
    anchor, start, n, doc = run
    a, b = spec.digests(values, start, n + spec.window - 1)
    cut = {"anchor": anchor, "doc_id": doc_id[doc], "tag": tag[doc], "start": start - first[doc] + base[doc], "n": n.astype(np.int32)}
    carry, stands, told = one_of_equal(a, b, cut["doc_id"], cut["tag"], cut["start"], many[doc], earliest)
    lengths = unit_end[start[carry] + n[carry] + spec.window - 2] - unit_start[start[carry]]
    text = data[ranges(unit_start[start[carry]], lengths)]
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    texts = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(carry), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(text.tobytes())]
    ).cast(pa.binary())
    return cut, carry, stands, texts, told


def _pieces(batches, spec: Windows, earliest: bool):
    for batch in chunked(batches):
        units = spec.units(batch.column("text"))
        run = spec.runs(units[1], units[-1])
        wanted, hot = (
            np.unique(batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            for c in ("anchors", "hot")
        )
        on = np.flatnonzero(np.isin(run[0], wanted))
        if not len(on):
            continue
        doc_id, tag = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "tag"))
        none = np.zeros(batch.num_rows, np.int64)
        cut, carry, many, texts, told = _cut(spec, units, [x[on] for x in run], doc_id, tag, none, none > 0, earliest)
        apart = np.isin(cut["anchor"], hot)
        for chosen, many_of, answered, sent in (
            (carry, many, False, texts),
            (told, np.ones(len(told), bool), True, pa.nulls(len(told), pa.binary())),
        ):
            if len(chosen):
                c = {k: v[chosen] for k, v in cut.items()}
                # what need not meet is dealt out by its place
                dealt = mix(mix(c["doc_id"].view(np.uint64)) + c["start"].astype(np.uint64))
                key = np.where(apart[chosen] | answered, dealt, c["anchor"]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key), pa.array(c["doc_id"]), pa.array(c["tag"]), pa.array(c["start"]), pa.array(c["n"]),
                        pa.array(many_of), pa.array(np.full(len(chosen), answered)), pa.array(apart[chosen] & (not answered)), sent,
                    ],
                    names=["anchor", "doc_id", "tag", "start", "n", "many", "answered", "hot", "text"],
                )


def _spans(doc_id, tag, start, end):
    columns = [pa.array(x) for x in (doc_id, tag, start, end)]
    none = [pa.nulls(len(doc_id), t) for t in (pa.int64(), pa.int32(), pa.bool_(), pa.binary())]
    return pa.RecordBatch.from_arrays([*columns, *none], names=["doc_id", "tag", "start", "end", "anchor", "n", "many", "text"])


def _columns(batch):
    return {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "doc_id", "tag", "start", "n", "many")}


def _whole(c: dict, rows, spec: Windows):
    """Spans of whole pieces."""
    start = c["start"][rows]
    return _spans(c["doc_id"][rows], c["tag"][rows], start, start + c["n"][rows] + spec.window - 1)


def _cut_again(batch, spec: Windows, earliest: bool):
    """Pieces of hot anchors, cut at longer ones for the next round."""
    c = _columns(batch)
    units = spec.units(batch.column("text"))
    cut, carry, many, texts, told = _cut(spec, units, spec.runs(units[1], units[-1]), c["doc_id"], c["tag"], c["start"], c["many"], earliest)
    if len(told):
        yield _whole(cut, told, spec)
    c = {k: v[carry] for k, v in cut.items()}
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(c["doc_id"]), pa.array(c["tag"]), pa.array(c["start"]), pa.array(c["start"] + c["n"] + spec.window - 1),
            pa.array(c["anchor"].view(np.int64)), pa.array(c["n"]), pa.array(many), texts,
        ],
        names=["doc_id", "tag", "start", "end", "anchor", "n", "many", "text"],
    )


def _met(batches, spec: Windows, method: Callable, earliest: bool, group: int):
    """Pieces come in order of anchor; whole anchors are handed to ``method``, hot ones are cut again.

    Where more than ``group`` pieces are held, of equal ones only the first stays.
    """
    held: list[pa.RecordBatch] = []
    finer, full = spec.finer(), group

    def together():
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def judged():
        if held:
            table = together()
            out = method(table, _columns(table), spec)
            if out is not None and len(out[0]):
                yield _spans(*out)

    for whole in batches:
        answered, hot = (whole.column(c).to_numpy(zero_copy_only=False) for c in ("answered", "hot"))
        if answered.any():
            c = _columns(whole)
            yield _whole(c, np.flatnonzero(answered), spec)
        if hot.any():
            for part in chunked([whole.filter(pa.array(hot))], "text", TOGETHER):
                yield from _cut_again(part, finer, earliest)
        for batch in chunked([whole.filter(pa.array(~(answered | hot)))], "text", TOGETHER):
            anchor = batch.column("anchor").to_numpy(zero_copy_only=False)
            last = int(np.searchsorted(anchor, anchor[-1]))
            if last or (held and held[-1].column("anchor")[-1].as_py() != anchor[0]):
                if last:
                    held.append(batch.slice(0, last))
                yield from judged()
                held, batch, full = [], batch.slice(last), group
            held.append(batch)
            if sum(x.num_rows for x in held) > full:
                table = together()
                c = _columns(table)
                _, values, _, _, first = spec.units(table.column("text"))
                a, b = spec.digests(values, first[:-1], c["n"].astype(np.int64) + spec.window - 1)
                carry, many, told = one_of_equal(a, b, c["doc_id"], c["tag"], c["start"], c["many"], earliest)
                if len(told):
                    yield _whole(c, told, spec)
                one = table.take(pa.array(carry))
                held = [one.set_column(one.schema.get_field_index("many"), "many", pa.array(many))]
                full = max(group, 2 * len(carry))
    yield from judged()


def wanted_anchors(anchors: DataFrame, repeated: DataFrame) -> DataFrame:
    """``doc_id, tag, anchors, hot``: the repeated anchors of each text, and those that are hot.

    By text, as many rows may share an id or have none; rows alike in both count once.
    """
    return anchors.join(repeated, "anchor").groupBy("doc_id", "tag").agg(
        F.collect_set("anchor").alias("anchors"), F.collect_set(F.when(F.col("hot"), F.col("anchor"))).alias("hot")
    )


def repeated_spans(docs: DataFrame, spec: Windows, method: Callable, earliest: bool, group: int = GROUP) -> DataFrame:
    """``doc_id, tag, spans``: unit ranges of each document covered by repeated windows.

    With ``earliest`` a window counts unless it is the first of its kind by doc_id and
    start; else every window that occurs twice counts. ``method(batch, columns, spec)``
    gets whole anchors' pieces and returns (doc_id, tag, start, end) of what it finds;
    anchors that occur more than ``group`` times are cut at longer ones, round by round.
    """
    docs = _keyed(docs)
    anchors = written(docs.mapInArrow(lambda b: _anchors(b, spec), _ANCHORS), "anchors")
    repeated = written(
        anchors.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor", (F.col("n") > group).alias("hot")),
        "repeated",
    )
    wanted = wanted_anchors(anchors, repeated)
    pieces = docs.join(wanted.hint("shuffle_hash"), ["doc_id", "tag"]).mapInArrow(lambda b: _pieces(b, spec, earliest), _PIECES)
    found = _round(pieces, spec, method, earliest, group)
    spans = found.where("text is null").select("doc_id", "tag", "start", "end")
    finer = spec
    while (finer := finer.finer()) and not (again := found.where("text is not null")).isEmpty():
        found = _round(_next_pieces(again, finer, group), finer, method, earliest, group)
        spans = spans.unionByName(found.where("text is null").select("doc_id", "tag", "start", "end"))
    return spans.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def _round(pieces: DataFrame, spec: Windows, method: Callable, earliest: bool, group: int) -> DataFrame:
    """Pieces meet by anchor; what is found in them, and the pieces of hot anchors cut again."""
    met = pieces.repartition("anchor").sortWithinPartitions("anchor")
    return written(met.mapInArrow(lambda b: _met(b, spec, method, earliest, group), _FOUND), "repeats")


def _next_pieces(cut: DataFrame, spec: Windows, group: int) -> DataFrame:
    """Pieces that were cut again, those of anchors that are still hot dealt out; whole windows are no longer cut."""
    if spec.finer() is None:
        cut = cut.withColumn("hot", F.lit(False))
    else:
        hot = cut.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > group).select("anchor", F.lit(True).alias("hot"))
        cut = cut.join(written(hot, "hot"), "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    key = F.when(F.col("hot"), F.xxhash64("doc_id", "tag", "start")).otherwise(F.col("anchor"))
    return cut.select(key.alias("anchor"), "doc_id", "tag", "start", "n", "many", F.lit(False).alias("answered"), "hot", "text")


def joined(spans) -> list[tuple[int, int]]:
    """Ranges in order, those that touch or overlap as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def with_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``doc_id, text, spans`` for every row of ``docs``, ids as given."""
    keyed = _keyed(docs)
    return keyed.join(found.hint("shuffle_hash"), ["doc_id", "tag"], "left").select(
        F.when(F.col("doc_id") != -(2**63), F.col("doc_id")).alias("doc_id"), "text", "spans"
    )
