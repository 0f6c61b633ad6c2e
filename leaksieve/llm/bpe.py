"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece there is exactly one token that can end its encoding. It is
found from the shorter prefixes: a token may end a prefix if it is what the merges make
of its bytes, and if it may follow the last token of the prefix before it. Storing the
last token of every prefix gives the encoding by walking back from the end, lets bytes
be appended without looking at what stands before, and lets an edit re-encode from the
edit on only until old and new states agree.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import handing_back

#: Bytes that remembered pieces may take in a task, roughly; then it starts afresh.
MEMORY = 16 << 20
#: Neighbours remembered, some 70 bytes each.
PAIRS = 150_000
#: Bytes of pieces that are encoded many at once, and how many.
SHORT, AT_ONCE = 48, 10_000
#: Texts that are cut into pieces at once; their pieces are held until all are encoded.
TEXTS = 250


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line for each token, its bytes in base64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


#: What stands for a property where every character is at most U+024F (fixed by Unicode).
_LATIN = {
    r"\p{L}": "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ",
    r"\p{N}": "0-9\xb2\xb3\xb9\xbc-\xbe",
    r"\s": "\t-\r \x85\xa0",
}
_WIDE = re.compile("[^\x00-ɏ]")


def _respelled(pattern: str, latin: bool) -> str:
    """The pattern with white space as Unicode defines it, or all classes spelled out for Latin texts."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = next((x for x in (r"\p{L}", r"\p{N}", r"\s", r"\S") if pattern.startswith(x, i)), None)
        c = c or (pattern[i : i + 2] if pattern[i] == "\\" else pattern[i])
        i += len(c)
        inside = c == "[" or inside and c != "]"
        if c in (r"\s", r"\S") and not latin:
            bare = r"\p{White_Space}"
        elif c in (*_LATIN, r"\S") and latin:
            bare = _LATIN[r"\s" if c == r"\S" else c]
        else:
            out.append(c)
            continue
        if c == r"\S" and inside:
            raise ValueError(r"\S inside brackets is not supported")
        out.append(f"[^{bare}]" if c == r"\S" else bare if inside else f"[{bare}]")
    return "".join(out)


class Splitter:
    r"""Cuts texts into pieces; ``\s`` is Unicode white space, as rank files assume.

    Texts of Latin letters take the same pattern with its classes spelled out, which
    Python's own engine matches faster.
    """

    def __init__(self, pattern: str):
        self._any = regex.compile(_respelled(pattern, latin=False)).findall
        spelled = _respelled(pattern, latin=True)
        self._latin = None if r"\p" in spelled else re.compile(spelled).findall

    def __call__(self, text: str) -> list[str]:
        return self._any(text) if self._latin is None or _WIDE.search(text) else self._latin(text)


class Table:
    """Whole numbers by whole numbers that are not negative, for many at once: open addressing."""

    def __init__(self, bits: int = 12):
        self._clear(bits)

    def _clear(self, bits: int) -> None:
        self._shift, self.held = np.uint64(64 - bits), 0
        self._keys, self._values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)

    def clear(self) -> None:
        self._clear(12)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, or -1."""
        out, slot, at = np.full(len(keys), -1, np.int32), self._slots(keys), np.arange(len(keys))
        while len(at):
            there = self._keys[slot]
            found = there == keys
            out[at[found]] = self._values[slot[found]]
            on = np.flatnonzero(~found & (there >= 0))
            at, keys, slot = at[on], keys[on], (slot[on] + 1) & (len(self._keys) - 1)
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Takes up different keys that it does not hold yet."""
        if 2 * (self.held + len(keys)) > len(self._keys):
            old = self._keys >= 0
            keys, values = np.r_[self._keys[old], keys], np.r_[self._values[old], values]
            self._clear(int(4 * len(keys)).bit_length())
        self.held += len(keys)
        slot = self._slots(keys)
        while len(keys):
            free = self._keys[slot] < 0
            self._keys[slot[free]] = keys[free]  # of several keys one gets the slot
            got = self._keys[slot] == keys
            self._values[slot[got]] = values[got]
            keys, values, slot = keys[~got], values[~got], (slot[~got] + 1) & (len(self._keys) - 1)


class Vocabulary:
    """Token bytes and ranks, and which tokens may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {rank: token for token, rank in ranks.items()}
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("every single byte must have a rank")
        self.longest = max(map(len, ranks))
        self.pairs: dict[int, bool] = {}
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._spines: dict[tuple[int, int], list[int]] = {}
        #: The tokens that merges make of their bytes.
        self.whole = {data for data, token in ranks.items() if self.halves(token)}
        self._index()

    def _index(self) -> None:
        """Reads the tokens that merges make from their ends: a byte at a time leads from node to node.

        ``back`` has the next node by ``node << 8 | byte``, ``ends`` the token that is complete
        there or -1, ``size`` each token's bytes and ``shorter`` the longest token that it ends
        with, or -1.
        """
        self.back: dict[int, int] = {}
        self.ends = [-1]
        self.size = [0] * (max(self.bytes) + 1)
        self.shorter = [-1] * len(self.size)
        for token, data in sorted(self.bytes.items(), key=lambda x: len(x[1])):
            if data not in self.whole:
                continue
            node = 0
            for byte in reversed(data):
                if self.ends[node] >= 0:
                    self.shorter[token] = self.ends[node]
                key = node << 8 | byte
                node = self.back.get(key, 0)
                if not node:
                    node = self.back[key] = len(self.ends)
                    self.ends.append(-1)
            self.ends[node], self.size[token] = token, len(data)
        # the same for many pieces at once
        self.steps, self.follows = Table(), Table()
        self.steps.put(np.fromiter(self.back, np.int64), np.fromiter(self.back.values(), np.int32))
        self.tables = [np.array(x, np.int32) for x in (self.ends, self.size, self.shorter)]

    def merged(self, data: bytes, stop: int = 1) -> list[int]:
        """The definition: join the neighbours of lowest rank, leftmost first, while more than ``stop`` are left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > stop:
            best, at = min((self.ranks.get(a + b, len(self.ranks) + 256), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if parts[at] + parts[at + 1] not in self.ranks:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the last merge joins to this one; itself twice for a byte, None if no merges make it."""
        if token not in self._halves:
            data = self.bytes[token]
            last = self.merged(data, 2) if len(data) > 1 else [token, token]
            self._halves[token] = tuple(last) if len(last) == 2 else None
            if len(data) > 1 and len(last) == 2 and max(last) >= token:
                raise ValueError("a token is ranked before its own parts; the ranks are not those of a BPE")
        return self._halves[token]

    def _spine(self, token: int, side: int) -> list[int]:
        """What the merges have made at one end of a token (0 its left, 1 its right), from a byte to the whole."""
        known = self._spines.get((token, side))
        if known is None:
            known = [token]
            while len(self.bytes[known[-1]]) > 1:
                known.append(self.halves(known[-1])[side])
            known = self._spines[token, side] = known[::-1]
        return known

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the merges of both tokens' bytes leave the border between them."""
        known = self.pairs.get(left << 32 | right)
        if known is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            known = self.pairs[left << 32 | right] = self._border_stays(left, right)
        return known

    def _border_stays(self, left: int, right: int) -> bool:
        """Parts rank before what they make, so each token at the border lives until the
        rank of the next one on its side. The border goes if two that live at the same
        time can be joined before either is used up; among equal ranks, what lies
        further left comes first.
        """
        ranks, data, never = self.ranks, self.bytes, len(self.ranks) + 256
        a, b = self._spine(left, 1), self._spine(right, 0)
        i = j = 0
        while True:
            until_a = a[i + 1] if i + 1 < len(a) else never
            until_b = b[j + 1] if j + 1 < len(b) else never
            joined = ranks.get(data[a[i]] + data[b[j]], never)
            if joined < until_a and joined <= until_b and joined != never:
                return False
            if until_a == until_b == never:
                return True
            if until_a <= until_b:
                i += 1
            else:
                j += 1

    def may_follow_all(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``may_follow`` of many pairs; each that is not remembered is worked out once."""
        if self.follows.held > PAIRS:
            self.follows.clear()
        keys = left.astype(np.int64) << 32 | right
        known = self.follows.get(keys)
        new = np.unique(keys[known < 0])
        if len(new):
            low = (1 << 32) - 1
            self.follows.put(new, np.array([self._border_stays(k >> 32, k & low) for k in new.tolist()], np.int32))
            known = self.follows.get(keys)
        return known > 0


class Piece:
    """The encoding of one piece, open to appends and edits; ``last[i]`` ends prefix i + 1."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def _extend(self, until: int) -> None:
        """Finds the last token of each prefix that has none yet, up to ``until`` bytes.

        Tried from the longest token on: the first that may follow what ends before it is the only one.
        """
        data, last, v = self.data, self.last, self.vocabulary
        back, ends, size, shorter = v.back.get, v.ends, v.size, v.shorter
        pairs, may_follow, take = v.pairs.get, v.may_follow, last.append
        for at in range(len(last), until):
            node, first = 0, at
            while first >= 0:
                node = back(node << 8 | data[first])
                if node is None:
                    break
                if ends[node] >= 0:
                    token = ends[node]
                first -= 1
            while before := at + 1 - size[token]:
                left = last[before - 1]
                known = pairs(left << 32 | token)
                if known is None:
                    known = may_follow(left, token)
                if known:
                    break
                token = shorter[token]
                if token < 0:
                    raise ValueError("no token ends here; the ranks are not those of a BPE")
            take(token)

    def append(self, data: bytes) -> None:
        self.data += bytes(data)
        self._extend(len(self.data))

    def cut(self, size: int) -> None:
        """Goes back to the prefix of this size."""
        self.data = self.data[:size]
        del self.last[size:]

    def replace(self, start: int, end: int, data: bytes) -> int:
        """Puts ``data`` for the bytes from ``start`` to ``end``; returns how many prefixes were encoded anew.

        Behind the edit it stops once as many prefixes in a row as the longest token has
        bytes end as before: what follows depends on these alone.
        """
        old, shift = self.last, len(data) - (end - start)
        self.data = self.data[:start] + data + self.data[end:]
        self.last, same = old[:start], 0
        for at in range(start + 1, len(self.data) + 1):
            self._extend(at)
            before = at - shift
            same = same + 1 if before > end and old[before - 1] == self.last[-1] else 0
            if same >= self.vocabulary.longest:
                self.last += old[before:]
                return at - start
        return len(self.data) - start

    def tokens(self) -> list[int]:
        """The tokens: a piece that is a token itself is that token."""
        whole = self.vocabulary.ranks.get(self.data)
        if whole is not None:
            return [whole]
        out, end, last, size = [], len(self.data), self.last, self.vocabulary.size
        while end:
            token = last[end - 1]
            out.append(token)
            end -= size[token]
        return out[::-1]


def encode_pieces(vocabulary: Vocabulary, pieces: list[bytes]) -> list[bytes]:
    """The ids of many pieces at once, none empty, in order of their bytes.

    The last tokens of all prefixes of one length are found together, each from those of shorter
    ones; a prefix that a piece shares with the piece before is looked at once.
    """
    _, size, _ = vocabulary.tables
    n, lengths = len(pieces), np.fromiter(map(len, pieces), np.int64, len(pieces))
    starts, width = lengths.cumsum() - lengths, int(lengths.max())
    data, last = np.zeros((n, width), np.uint8), np.zeros((n, width), np.int32)
    row = np.repeat(np.arange(n), lengths)
    data[row, np.arange(len(row)) - starts[row]] = np.frombuffer(b"".join(pieces), np.uint8)
    shared = np.arange(n) > 0  # with the piece before, so far
    for at in range(width):
        there = lengths > at
        shared[1:] &= there[1:] & there[:-1] & (data[1:, at] == data[:-1, at])
        new = np.flatnonzero(there & ~shared)
        last[new, at] = _last_tokens(vocabulary, data, last, new, at)
        same = np.flatnonzero(shared)
        last[same, at] = last[new[np.searchsorted(new, same) - 1], at]
    steps, left, rows = [], lengths.copy(), np.arange(n)
    while len(rows):
        token = last[rows, left[rows] - 1]
        steps.append((rows, token))
        left[rows] -= size[token]
        rows = rows[left[rows] > 0]
    counts = np.bincount(np.concatenate([r for r, _ in steps]), minlength=n)
    stops = counts.cumsum()
    out = np.zeros(int(stops[-1]), "<u4")
    for k, (rows, token) in enumerate(steps):
        out[stops[rows] - 1 - k] = token
    ids, stops = out.tobytes(), (4 * stops).tolist()
    return [ids[a:b] for a, b in zip([0, *stops], stops)]


def _last_tokens(v: Vocabulary, data: np.ndarray, last: np.ndarray, rows: np.ndarray, at: int) -> np.ndarray:
    """The token that ends the prefix up to byte ``at`` of each of the rows: ``Piece._extend`` for many."""
    ends, size, shorter = v.tables
    token, node, open_ = np.zeros(len(rows), np.int32), np.zeros(len(rows), np.int64), np.arange(len(rows))
    for first in range(at, -1, -1):
        step = v.steps.get(node[open_] << 8 | data[rows[open_], first])
        on = step >= 0
        open_, step = open_[on], step[on]
        if not len(open_):
            break
        node[open_] = step
        complete = ends[step]
        token[open_[complete >= 0]] = complete[complete >= 0]
    open_ = np.flatnonzero(size[token] <= at)  # a token that is the whole prefix has nothing to follow
    while len(open_):
        before = last[rows[open_], at - size[token[open_]]]
        open_ = open_[~v.may_follow_all(before, token[open_])]
        token[open_] = shorter[token[open_]]
        if (token[open_] < 0).any():
            raise ValueError("no token ends here; the ranks are not those of a BPE")
    return token


class Coder:
    """Texts to ids and back; remembers the pieces it has seen."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.vocabulary = Vocabulary(ranks)
        self.pieces = Splitter(pattern)
        self._known: dict[str, bytes] = {}
        self._held = 0

    def _learn(self, pieces: Iterable[str]) -> None:
        """Encodes pieces in order of their bytes, which brings shared prefixes together.

        Many short ones are taken at once, a long one alone.
        """
        known, ranks, short = self._known, self.vocabulary.ranks, []
        for data in sorted(p.encode() for p in pieces):
            self._held += 200 + 5 * len(data)
            whole = ranks.get(data)
            if whole is not None:
                known[data.decode()] = struct.pack("<I", whole)
            elif len(data) <= SHORT:
                short.append(data)
            else:
                tokens = Piece(self.vocabulary, data).tokens()
                known[data.decode()] = struct.pack(f"<{len(tokens)}I", *tokens)
        for a in range(0, len(short), AT_ONCE):
            part = short[a : a + AT_ONCE]
            known.update(zip((p.decode() for p in part), encode_pieces(self.vocabulary, part)))

    def encode_all(self, texts: Iterable[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.pieces(t) for t in texts]
        if self._held > MEMORY:
            self.forget()
        known = self._known
        self._learn(set().union(*cut).difference(known))
        return [b"".join(map(known.__getitem__, pieces)) for pieces in cut]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def forget(self) -> None:
        """Drops the pieces it has seen; the vocabulary stays."""
        self._known, self._held = {}, 0


class Decoder:
    """Ids to bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self._bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self._bytes[rank] = token

    def decode(self, ids: bytes) -> bytes:
        table = self._bytes
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()])


_CODERS: dict[str, Coder] = {}


def _coder(path_key: str, ranks, pattern: str) -> Coder:
    if path_key not in _CODERS:
        _CODERS.clear()
        _CODERS[path_key] = Coder(ranks, pattern)
    return _CODERS[path_key]


def _encoded(batches: Iterable[pa.RecordBatch], coder: Coder):
    for batch in batches:
        for a in range(0, batch.num_rows, TEXTS):
            part = batch.slice(a, TEXTS)
            ids = coder.encode_all([t or "" for t in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"]
            )
    coder.forget()  # the coder outlives the task


def _shared(spark, ranks_path: str, pattern: str):
    ranks = read_ranks(ranks_path)
    key = hashlib.sha256(repr((sorted(ranks.items()), pattern)).encode()).hexdigest()
    return key, spark.sparkContext.broadcast(ranks)


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Every text as ids: ``doc_id, ids`` (binary, little-endian unsigned 32-bit).

    The rank file is read on the driver and broadcast (a vocabulary, some MB at any
    input size). Null and empty texts have no ids. One row per input row, no shuffle;
    other columns are not looked at.
    """
    key, ranks = _shared(docs.sparkSession, ranks_path, pattern)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(
        lambda batches: handing_back(_encoded(batches, _coder(key, ranks.value, pattern))), "doc_id long, ids binary"
    )


def _decoded(batches, coder: Decoder):
    for batch in batches:
        for a in range(0, batch.num_rows, TEXTS):
            part = batch.slice(a, TEXTS)
            out = [coder.decode(x or b"") for x in part.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("ids"), pa.array(out, pa.binary())],
                names=["doc_id", "ids", "decoded"],
            )


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """The bytes that ids stand for: adds ``decoded`` to ``doc_id, ids``; null ids give no bytes."""
    ranks = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    return encoded.select("doc_id", "ids").mapInArrow(
        lambda batches: handing_back(_decoded(batches, Decoder(ranks.value))), "doc_id long, ids binary, decoded binary"
    )


def _round_trip(batches, coder: Coder, decoder: Decoder):
    return _decoded(_encoded(batches, coder), decoder)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``encode`` and ``decode`` in one step, so that a task needs one Python worker: ``doc_id, ids, decoded``."""
    key, ranks = _shared(docs.sparkSession, ranks_path, pattern)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(
        lambda batches: handing_back(_round_trip(batches, _coder(key, ranks.value, pattern), Decoder(ranks.value))),
        "doc_id long, ids binary, decoded binary",
    )


def token_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per document the number of tokens and the digests of its ids and of what they decode to."""
    return round_trip(docs, ranks_path, pattern).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
