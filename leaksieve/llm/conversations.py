r"""Conversation structure repair: the cheapest edits that make speakers take turns.

The role initials of a repaired conversation read `(s?(ua)+)?`. What follows depends on the
last initial alone, so a search has four states for each row. It is an iterative-deepening
A*: depth first, edits in ASCII order (Delete, Insert, Keep, Rerole), under a cost bound that
grows to the least cost that went beyond it. States that failed under a bound are held in a
table with what they must cost at least. The first path that accepts is the answer: of the
cheapest, the one whose initials come first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What an edit costs; a truncated row that stays costs ``TRUNCATED`` more.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
SPACE = " \t\n\x0b\x0c\r"
#: Rows between two places from which the cost to the end is found first, see ``repair_edits``.
BLOCK = 16

_INITIALS = "sua"
#: States: nothing yet, after s, after u, after a. Where each initial leads, or -1.
_AFTER = ((1, 2, -1, -1), (-1, 2, -1, -1), (-1, -1, 3, -1), (-1, 2, -1, -1))
#: The state that an inserted or re-roled row leads to; 2 is a user's, 3 an assistant's.
_WANTED = (2, 2, 3, 2)
_ACCEPTING = (0, 3)
_FINE, _CUT, _FORCED = range(3)  # a row that is fine, is truncated, or must go


def _moves(initial: int, kind: int) -> tuple:
    """For each state the edits of a row in ASCII order: initial, cost, rows used, next state, what comes out."""
    out = []
    more = TRUNCATED if kind == _CUT else 0
    for state, wanted in enumerate(_WANTED):
        speaker = "ua"[wanted - 2]
        moves = [("D", DELETE, 1, state, ""), ("I", INSERT, 0, wanted, speaker)]
        if kind != _FORCED:
            if _AFTER[state][initial] >= 0:
                moves.append(("K", more, 1, _AFTER[state][initial], "k"))
            moves.append(("R", REROLE + more, 1, wanted, speaker.upper()))
        out.append(tuple(moves))
    return tuple(out)


#: By the code of a row: 4 * kind + initial.
_MOVES = tuple(_moves(code % 4, code // 4) for code in range(12))
_AT_END = tuple(tuple(m for m in moves if m[0] == "I") for moves in _MOVES[0])
_AT_LEAST = np.array([0, TRUNCATED, DELETE])


def _search(codes: bytes, low: list[int], solved: set[int], root: int, budget: int) -> list | None:
    """Depth-first search for a path of at most this cost; ``low`` takes what failed states cost at least.

    Nodes are 4 * row + state. A node of a ``solved`` row is a path's end: its bound is exact.
    """
    n = len(codes)
    path: list = []
    stack = [[root, budget, 0, None]]  # node, what may still be spent, next edit, least cost beyond
    while stack:
        node, left, tried, beyond = frame = stack[-1]
        row, state = divmod(node, 4)
        if row == n and state in _ACCEPTING or row in solved and node != root:
            return path
        moves = _MOVES[codes[row]][state] if row < n else _AT_END[state]
        for k in range(tried, len(moves)):
            _, cost, used, after, _ = moves[k]
            child = 4 * (row + used) + after
            least = cost + low[child]
            if least <= left:
                frame[2], frame[3] = k, beyond
                path.append(moves[k])
                stack.append([child, left - cost, 0, None])
                break
            if beyond is None or least < beyond:
                beyond = least
        else:
            low[node] = max(low[node], beyond)
            stack.pop()
            if stack:
                path.pop()  # the parent now finds this child too dear
    return None


def repair_edits(codes: bytes) -> tuple[int, list]:
    """The least cost of a repair and its edits, of those of least cost the first in ASCII order.

    Bounds start at what rows that must go or are truncated cost anyway. From the end on,
    the costs from every ``BLOCK``-th row to the end are searched first. They stand in the
    table as exact bounds and raise those of the rows before, so that no later search goes
    wrong for more than a block, and time and memory grow with the rows.
    """
    n = len(codes)
    rest = np.zeros(n + 1, np.int64)
    rest[:n] = _AT_LEAST[np.frombuffer(codes, np.uint8) // 4][::-1].cumsum()[::-1]
    low = np.repeat(rest, 4).tolist()
    for state in range(4):
        if state not in _ACCEPTING:
            low[4 * n + state] = INSERT
    for row in range((n - 1) // BLOCK * BLOCK, -1, -BLOCK):
        after = min(row + BLOCK, n)
        if after < n:  # whatever way leads there, no less than this is to come
            more = min(low[4 * after : 4 * after + 4]) - int(rest[after])
            low[4 * row : 4 * after] = [x + more for x in low[4 * row : 4 * after]]
        for node in range(4 * row, 4 * row + 4) if row else ():
            while _search(codes, low, {after} if after < n else set(), node, low[node]) is None:
                pass
    while (path := _search(codes, low, set(), 0, low[0])) is None:
        pass
    return low[0], path


_short_repair = lru_cache(maxsize=10_000)(repair_edits)


def damage(conversations: DataFrame) -> DataFrame:
    """The rows of ``conversations`` as a rule by crc32 of ``conv_id:turn`` spoils them, nulls being one space.

    Of 20 remainders 0 drops a row, 1 empties its text, 2 takes out its ``[.!?]``, 3 repeats it,
    4 makes it a user's. Dropped rows come out marked ``dropped``. Equal ids and turns share
    their fate; a null id or turn stays null.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))), F.lit(20))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        text("role").alias("role"), text("text").alias("text"), kind.alias("kind"),
    )
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") == 0).alias("dropped"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


_ROW = ["h1", "h2"]


def _prepared(rows: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    dropped = F.coalesce(F.col("dropped"), F.lit(False)) if "dropped" in rows.columns else F.lit(False)
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        text("role").alias("role"), text("text").alias("text"), dropped.alias("dropped"),
    ).withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit(1), "text", "role")})


def _coded(rows: DataFrame) -> DataFrame:
    """Of each row what the search needs: initial, blank or truncated, and 128 bits of role and text."""
    end = F.right(F.rtrim(F.col("text"), F.lit(SPACE)), F.lit(1))
    kind = F.when(end == "", _FORCED).when(end.isin(".", "!", "?"), _FINE).otherwise(_CUT)
    initial = F.instr(F.lit(_INITIALS), F.substring("role", 1, 1))
    initial = F.when((F.col("role") == "") | (initial == 0), len(_INITIALS)).otherwise(initial - 1)
    return rows.select("conv_id", "turn", "dropped", *_ROW, (4 * kind + initial).cast("tinyint").alias("code"))


_SUMMARY = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_STEP_SCHEMA = (
    "conv_id long, part int, turn long, h1 long, h2 long, seq long, step string, "
    + ", ".join(f"{c} long" for c in _SUMMARY)
    + ", audit string"
)


def _whole_conversations(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by conversation, in tables that end where a conversation ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("conv_id")
        value, valid = ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False)
        changes = np.flatnonzero((value[1:] != value[:-1]) | (valid[1:] != valid[:-1])) + 1
        if held and held[-1].column("conv_id")[-1].as_py() != ids[0].as_py():
            yield pa.Table.from_batches(held)
            held = []
        if len(changes):
            yield pa.Table.from_batches([*held, batch.slice(0, changes[-1])])
            held, batch = [], batch.slice(changes[-1])
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _steps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _whole_conversations(batches):
        yield from _table_steps(table)


def _table_steps(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """For each conversation its summary (part 0), the edits of its rows (part 1) and what comes after them (part 2)."""
    column = lambda c: table.column(c).combine_chunks()
    ids, turns = column("conv_id"), column("turn")
    value, valid = ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False)
    opens = np.r_[0, np.flatnonzero((value[1:] != value[:-1]) | (valid[1:] != valid[:-1])) + 1]
    stays = np.flatnonzero(~column("dropped").to_numpy(zero_copy_only=False))
    of = (np.searchsorted(opens, np.arange(len(ids)), "right") - 1)[stays]
    first = np.searchsorted(of, np.arange(len(opens) + 1))
    h1, h2 = (column(c).to_numpy()[stays] for c in _ROW)
    code = column("code").to_numpy()[stays].astype(np.uint8)
    order = np.lexsort((h2, h1, of))
    again = np.zeros(len(stays), bool)
    a, b = order[:-1], order[1:]
    again[b] = (of[a] == of[b]) & (h1[a] == h1[b]) & (h2[a] == h2[b])
    blank = code // 4 == _FORCED
    again &= ~blank
    cut = (code // 4 == _CUT) & ~again
    initial = code % 4
    code = np.where(again, 4 * _FORCED + initial, code).astype(np.uint8)
    pairs = initial[:-1] * 4 + initial[1:]
    bad_pair = ~np.isin(pairs, (0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1)) & (of[:-1] == of[1:])
    per = lambda flags, at=of: np.bincount(at[flags], minlength=len(opens))
    counts = {"blank": per(blank), "duplicate": per(again), "truncated": per(cut), "illegal": per(bad_pair, of[:-1])}
    turn = turns.fill_null(0).to_numpy()[stays]
    given = turns.is_valid().to_numpy(zero_copy_only=False)[stays]
    gaps = _gaps(turn[given], of[given], len(opens))
    out: dict[str, list] = {f: [] for f in ("conv_id", "part", "turn", "h1", "h2", "seq", "step", *_SUMMARY, "audit")}

    def put(**values):
        for name, cells in out.items():
            cells.append(values.get(name))

    for k, opening in enumerate(opens):
        conv = ids[int(opening)].as_py()
        rows = range(first[k], first[k + 1])
        codes = code[first[k] : first[k + 1]].tobytes()
        cost, path = _short_repair(codes) if len(codes) <= 64 else repair_edits(codes)
        put(conv_id=conv, part=0, gaps=gaps[k], cost=cost, audit="".join(m[0] for m in path), **{c: int(x[k]) for c, x in counts.items()})
        step, at = "", 0
        for _, _, used, _, made in path:
            step += made
            if used:
                if step:
                    i = rows[at]
                    put(conv_id=conv, part=1, turn=int(turn[i]) if given[i] else None, h1=int(h1[i]), h2=int(h2[i]), seq=at, step=step)
                step, at = "", at + 1
        if step:
            put(conv_id=conv, part=2, seq=at, step=step)
        if len(out["conv_id"]) > 10_000 or k == len(opens) - 1:
            yield _batch(out)
            out = {f: [] for f in out}


def _gaps(turn: np.ndarray, of: np.ndarray, n: int) -> list[int]:
    """Turns missing between the least and the greatest, for each conversation; turns come in order."""
    out = [0] * n
    if len(of):
        opens = np.r_[0, np.flatnonzero(of[1:] != of[:-1]) + 1]
        new = np.r_[True, (turn[1:] != turn[:-1]) | (of[1:] != of[:-1])]
        for a, b, distinct in zip(opens, np.r_[opens[1:], len(of)], np.add.reduceat(new, opens, dtype=np.int64)):
            out[of[a]] = min(int(turn[b - 1]) - int(turn[a]) + 1 - int(distinct), 2**63 - 1)
    return out


def _batch(out: dict[str, list]) -> pa.RecordBatch:
    kinds = {"part": pa.int32(), "step": pa.string(), "audit": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()], list(out))


_RESULT_SCHEMA = "conv_id long, " + ", ".join(f"{c} long" for c in _SUMMARY) + ", audit string, repaired_sha256 string"


def _lines(step: str, role: str | None, text: str | None) -> Iterator[str]:
    for made in step:
        if made == "k":
            yield f"{role}:{text}"
        else:
            speaker = "user" if made in "uU" else "assistant"
            yield f"{speaker}:{text if made.isupper() else ''}"


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows, edits before the texts they are for: one result for each conversation.

    A text is read on its own and goes into the digest; nothing but the edits of equal rows is held.
    """
    names = ["conv_id", *_SUMMARY, "audit", "repaired_sha256"]
    done: list[list] = []
    digest, lines, key, waiting = None, 0, None, []

    def take(role=None, text=None):
        nonlocal lines, waiting
        for step in waiting:
            for line in _lines(step, role, text):
                digest.update(b"\n" * (lines > 0) + line.encode())
                lines += 1
        waiting = []

    def batch(rows):
        kinds = [pa.string() if c in ("audit", "repaired_sha256") else pa.int64() for c in names]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)

    for found in batches:
        columns = found.to_pydict()
        for i in range(found.num_rows):
            part = columns["part"][i]
            if part == 0:
                if done:
                    done[-1].append(digest.hexdigest())
                    if len(done) > 5000:
                        yield batch(done)
                        done = []
                done.append([columns[c][i] for c in names[:-1]])
                digest, lines, key, waiting = hashlib.sha256(), 0, None, []
            elif part == 2:
                waiting = [columns["step"][i]]
                take()
            else:
                here = columns["turn"][i], columns["h1"][i], columns["h2"][i]
                if here != key:
                    key, waiting = here, []
                if columns["text"][i] is None:
                    waiting.append(columns["step"][i])
                elif waiting:
                    take(columns["role"][i], columns["text"][i])
    if done:
        done[-1].append(digest.hexdigest())
        yield batch(done)


def _by_conversation(rows: DataFrame, *order: str | Column) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def repair(rows: DataFrame) -> DataFrame:
    """Each conversation's faults and its cheapest repair, a row per ``conv_id``.

    Takes ``conv_id, turn, role, text``; of rows marked in a column ``dropped``, if there is
    one, only the conversation counts. Columns: ``gaps, blank, duplicate, truncated, illegal,
    cost, audit, repaired_sha256``.

    Rows come by turn, nulls first, those of one turn in the order of a hash of role and text,
    so the result does not depend on how the table is split. A null role or text is one space;
    a null ``conv_id`` is a conversation like any other. A role that does not begin with s, u or
    a cannot stay, nor can an empty one. Rows alike in everything are duplicates. Empty texts
    are blank. A conversation without rows has zeros, an empty audit and the digest of
    nothing. An empty table gives no rows; extra columns are not looked at.

    A task holds the codes of one conversation at a time (17 bytes and the search's four bounds
    a row). Texts are sorted by Spark and read one by one.
    """
    rows = _prepared(rows)
    steps = _by_conversation(_coded(rows), "turn", *_ROW).mapInArrow(_steps, _STEP_SCHEMA)
    texts = rows.where(~F.col("dropped")).select("conv_id", F.lit(1).alias("part"), "turn", *_ROW, "role", "text")
    merged = steps.unionByName(texts, allowMissingColumns=True)
    # of equal keys the edits, in their order, then the texts
    return _by_conversation(merged, "part", "turn", *_ROW, F.col("seq").asc_nulls_last()).mapInArrow(_hashed, _RESULT_SCHEMA)
