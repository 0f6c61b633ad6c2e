"""What several operators need: written tables, flat byte arrays, words, rolling hashes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text handled at once inside a task; longer documents make a chunk of their own.
CHUNK = 1 << 20

#: Bytes that end a word where words are `[^\x20\x09-\x0D]+`.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: A-Z to a-z, all else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application: they need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_leaksieve_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="leaksieve-")) / "leaksieve.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._leaksieve_shipped = True


@lru_cache(maxsize=1)
def _local_base() -> str:
    return tempfile.mkdtemp(prefix="leaksieve-")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under the folder that ``spark.checkpoint.dir`` names; gone when the JVM ends.

    Where that is unset (local tests) a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local_base()
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """A string column as one byte array and the documents' offsets; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunked(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about ``limit`` bytes of text, or one document."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        cuts = np.flatnonzero(np.diff(ends // limit)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield batch.slice(a, b - a)


def handing_back(made: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; after the last, memory that the task no longer uses goes back to the system.

    Python workers wait for further tasks and would keep it through stages that need none.
    """
    try:
        yield from made
    finally:
        del made
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library alone
        if trim is not None:
            trim(0)


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
    """Starts and ends of the words, and the first word of each document (one more at the end).

    ``inside`` says for each byte value if it belongs to a word; no word crosses documents.
    """
    n = len(data)
    word = inside[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    opens = word.copy()
    opens[1:] &= ~word[:-1] | first[1:n]
    closes = word.copy()
    closes[:-1] &= ~word[1:] | first[1:n]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets)


_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64; at least n of them."""
    return _powers(base, 1 << max(16, int(n).bit_length()))[:n]


@lru_cache(maxsize=4)
def byte_values(seed: int) -> np.ndarray:
    """A random 64-bit value for each byte."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**64 - 1, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all others, one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Prefix:
    """Hashes of any span of a sequence of 64-bit values, from prefix sums modulo 2^64."""

    def __init__(self, values: np.ndarray, base: int = _ODD):
        n = len(values)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers(base, n), out=self.sums[1:])
        self.inverse = powers(pow(base, -1, 1 << 64), n + 1)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.inverse[starts]

    def rolling(self, k: int) -> np.ndarray:
        """The hash of every run of ``k`` values."""
        n = len(self.sums) - k
        return (self.sums[k:] - self.sums[:n]) * self.inverse[:n] if n > 0 else np.zeros(0, np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each word: of its bytes under random byte values, and its length."""
    spans = Prefix(byte_values(seed)[data]).spans(starts, ends)
    return mix(spans + (ends - starts).astype(np.uint64) * np.uint64(_ODD))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - before, lengths)
