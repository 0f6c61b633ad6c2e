"""Embedding whitening: principal components from the exact characteristic polynomial.

Vectors become whole numbers, so their scatter is a matrix of whole numbers, summed exactly
by Spark. Its characteristic polynomial is found modulo many primes, by Hessenberg reduction,
and put together by Chinese remaindering. The matrix is symmetric, so all roots are real, and
the sign changes of the polynomial shifted to a point count the roots beyond it, multiple ones
too: halving isolates the greatest roots to any number of bits. Inverse iteration at a root so
precise takes any vector into the null space of the shifted matrix, which holds the components.

The scatter's size is that of a vector, not of the table; what follows it is bounded by that.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Entries are multiples of 1/64, moved by this much.
SCALE, MOVED = 64, 1_000_000
COMPONENTS = 16
#: Bits to which a root is known, set against the greatest.
ROOT_BITS = 128
#: Decimal digits that inverse iteration reckons with.
DIGITS = 80

_LIMB = 20  # bits of a part of an entry
_SLICE = 2048  # rows whose products of parts add up exactly in doubles: 2 * 20 + 11 bits
_LOW = 60  # bits of the lower half of a sum


def whole_vectors(vectors: DataFrame, embedding: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``vec_id, x``: entries as ``floor(64 c) + 1000000``, rows without a usable vector left out.

    Those are null vectors and vectors with null, NaN or infinite entries. An entry beyond the
    range of longs takes its end.
    """
    c = F.col(embedding).cast("array<double>")
    usable = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    most = 2**63 - 1 - MOVED
    x = F.transform(c, lambda v: F.least(F.floor(v * SCALE), F.lit(most)) + F.lit(MOVED))
    return vectors.where(F.coalesce(c.isNotNull() & usable, F.lit(False))).select(
        F.col(key).cast("long").alias("vec_id"), x.cast("array<long>").alias("x")
    )


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions) - MOVED


def _limbs(x: np.ndarray) -> list[np.ndarray]:
    """Parts of ``_LIMB`` bits as doubles, the last with the sign; as many as the entries need."""
    out = []
    while True:
        if not len(x) or (int(x.max()) < 1 << _LIMB and int(x.min()) >= -(1 << _LIMB)):
            return [*out, x.astype(float)]
        out.append((x & ((1 << _LIMB) - 1)).astype(float))
        x = x >> _LIMB


def _products(x: np.ndarray) -> np.ndarray:
    """The sum of all rows' outer products, exactly, as Python integers."""
    d = x.shape[1]
    total = np.zeros((d, d), object)
    for a in range(0, len(x), _SLICE):
        parts = _limbs(x[a : a + _SLICE])
        for i, left in enumerate(parts):
            for j, right in enumerate(parts):
                total += (left.T @ right).astype(np.int64).astype(object) << (_LIMB * (i + j))
    return total


def _partial_sums(batches: Iterable[pa.RecordBatch], dimensions: int) -> Iterator[pa.RecordBatch]:
    """A task's count, sums and products of a triangle, as numbered cells in two halves."""
    n, sums, products = 0, np.zeros(dimensions, object), np.zeros((dimensions, dimensions), object)
    for batch in batches:
        x = _matrix(batch.column("x"), dimensions)
        n += len(x)
        sums += x.sum(0, dtype=object) if len(x) and max(int(x.max()), -int(x.min())) >= 1 << 40 else x.sum(0).astype(object)
        products += _products(x)
    if n:
        cells = [n, *sums, *products[np.triu_indices(dimensions)]]
        halves = [(Decimal(int(v) >> _LOW), int(v) & ((1 << _LOW) - 1)) for v in cells]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(len(cells))),
                pa.array([h for h, _ in halves], pa.decimal128(38, 0)),
                pa.array([low for _, low in halves], pa.int64()),
            ],
            ["cell", "high", "low"],
        )


@dataclass(frozen=True)
class Sums:
    """Count, sums per dimension and sums of products of the fit list, its entries moved back to zero."""

    n: int
    sums: list[int]
    products: list[list[int]]

    def scatter(self) -> list[list[int]]:
        """n times the centred sums of products: n squared times the covariance, in whole numbers."""
        d = range(len(self.sums))
        return [[self.n * self.products[i][j] - self.sums[i] * self.sums[j] for j in d] for i in d]


def dimensions_of(fit_list: DataFrame) -> int:
    """The commonest length of a vector, of equally common ones the greatest; 0 without vectors."""
    found = fit_list.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return found[0]["d"] if found else 0


def sums_of(fit_list: DataFrame, dimensions: int) -> Sums:
    """Exact sums over all vectors of so many dimensions: a partial sum per task, added up by Spark."""
    parts = fit_list.where(F.size("x") == dimensions).select("x")
    cells = parts.mapInArrow(lambda batches: _partial_sums(batches, dimensions), "cell long, high decimal(38,0), low long")
    total = cells.groupBy("cell").agg(F.sum("high").alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"))
    value = {r["cell"]: (int(r["high"]) << _LOW) + int(r["low"]) for r in total.collect()}
    if not value:
        return Sums(0, [0] * dimensions, [[0] * dimensions for _ in range(dimensions)])
    products = [[0] * dimensions for _ in range(dimensions)]
    for k, (i, j) in enumerate(zip(*np.triu_indices(dimensions))):
        products[i][j] = products[j][i] = value[1 + dimensions + k]
    return Sums(value[0], [value[1 + i] for i in range(dimensions)], products)


def _is_prime(p: int) -> bool:
    """Exact for what 32 bits hold."""
    if p % 2 == 0:
        return p == 2
    odd, twos = p - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, p)
        if p != base and x != 1 and all((x := x if i == 0 else x * x % p) != p - 1 for i in range(twos)):
            return False
    return True


def primes_beyond(bound: int) -> list[int]:
    """Primes below 2^31, from the greatest on, whose product is greater."""
    out, product, p = [], 1, 2**31 - 1
    while product <= bound:
        if _is_prime(p):
            out.append(p)
            product *= p
        p -= 2
    return out


def polynomial_modulo(matrix: np.ndarray, p: int) -> np.ndarray:
    """The characteristic polynomial modulo a prime below 2^31, its constant first.

    Similar row and column operations bring the matrix to Hessenberg form, whose leading minors
    follow from each other.
    """
    h, d = matrix.copy(), len(matrix)
    for c in range(d - 2):
        rows = np.flatnonzero(h[c + 1 :, c]) + c + 1
        if not len(rows):
            continue
        r = rows[0]
        if r != c + 1:
            h[[r, c + 1]] = h[[c + 1, r]]
            h[:, [r, c + 1]] = h[:, [c + 1, r]]
        factors = h[c + 2 :, c] * pow(int(h[c + 1, c]), -1, p) % p
        h[c + 2 :] = (h[c + 2 :] - factors[:, None] * h[c + 1] % p) % p
        h[:, c + 1] = (h[:, c + 1] + (h[:, c + 2 :] * factors % p).sum(1)) % p
    minors = np.zeros((d + 1, d + 1), np.int64)
    minors[0, 0] = 1
    for k in range(d):
        weights, chain = np.zeros(k + 1, np.int64), 1
        for i in range(k, -1, -1):
            weights[i] = int(h[i, k]) * chain % p
            chain = chain * int(h[i, i - 1]) % p if i else chain
        minors[k + 1, 1:] = minors[k, :-1]
        minors[k + 1] = (minors[k + 1] - (weights[:, None] * minors[: k + 1] % p).sum(0)) % p
    return minors[d]


def joined(residues: dict[int, list[int]]) -> list[int]:
    """The whole numbers nearest to zero that leave these residues by each prime."""
    product = math.prod(residues)
    out = [0] * len(next(iter(residues.values())))
    for p, values in residues.items():
        others = product // p
        unit = others * pow(others, -1, p)
        out = [(a + int(v) * unit) % product for a, v in zip(out, values)]
    return [a - product if 2 * a > product else a for a in out]


def characteristic_polynomial(spark, matrix: list[list[int]]) -> list[int]:
    """Of a positive semidefinite matrix of whole numbers: exact coefficients, the constant first.

    The k-th symmetric sum of d roots that are not negative is at most C(d, k) times the k-th
    power of their mean, which bounds the primes needed. The primes are dealt out to Spark tasks.
    """
    d = len(matrix)
    trace = sum(matrix[i][i] for i in range(d))
    bound = max(math.comb(d, k) * (trace**k // d**k + 1) for k in range(d + 1))
    primes = primes_beyond(2 * bound + 1)
    shared = spark.sparkContext.broadcast(matrix)

    def residues(batches):
        for batch in batches:
            values = batch.column("p").to_pylist()
            found = [polynomial_modulo(np.array([[v % p for v in row] for row in shared.value], np.int64), p).tolist() for p in values]
            yield pa.RecordBatch.from_arrays([batch.column("p"), pa.array(found, pa.list_(pa.int64()))], ["p", "residues"])

    tasks = max(1, min(len(primes) // 4, spark.sparkContext.defaultParallelism))
    dealt = spark.createDataFrame([(p,) for p in primes], "p long").repartition(tasks)
    rows = dealt.mapInArrow(residues, "p long, residues array<long>").collect()
    return joined({r["p"]: r["residues"] for r in rows})


def _shifted(polynomial: list[int], a: int) -> list[int]:
    c = list(polynomial)
    for i in range(len(c) - 1):
        for j in range(len(c) - 2, i - 1, -1):
            c[j] += a * c[j + 1]
    return c


def roots_above(polynomial: list[int], a: int) -> int:
    """How many roots are greater, multiple ones as often: exact, since all roots are real."""
    signs = [c > 0 for c in _shifted(polynomial, a) if c]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def greatest_roots(polynomial: list[int], count: int, bits: int = ROOT_BITS) -> list[tuple[int, int, int]]:
    """At least ``count`` of the greatest positive roots, if there are, as ``(floor(root * 2^k), k, multiplicity)``.

    All roots must be real and none negative. Roots that agree in ``bits`` bits, set against
    the greatest, count as one.
    """
    zeros = next(i for i, c in enumerate(polynomial) if c)
    q = polynomial[zeros:]
    r = len(q) - 1
    if not r:
        return []
    trace = -q[-2]
    k = max(0, bits - max(1, trace // r).bit_length())
    q = [c << (k * (r - i)) for i, c in enumerate(q)]
    lower, upper, found = 0, (trace << k) + 1, []
    open_ = [(lower, upper, r, 0)]  # roots in (lower, upper], and how many lie above
    while open_:
        low, high, inside, above = open_.pop()
        if above >= count or not inside:
            continue
        if high - low == 1:
            found.append((low, k, inside))
            continue
        if inside == 1:
            found.append((_refined(q, low, high), k, 1))
            continue
        middle = (low + high) // 2
        upper_half = roots_above(q, middle) - above
        open_.append((low, middle, inside - upper_half, above + upper_half))
        open_.append((middle, high, upper_half, above))
    if min(f for f, _, _ in found).bit_length() < bits // 2:
        return greatest_roots(polynomial, count, 2 * bits)  # far smaller than the greatest: more bits for all
    return found


def _refined(q: list[int], low: int, high: int) -> int:
    """Where the sign changes between two whole numbers with a single root between them."""

    def value(x: int) -> int:
        out = 0
        for c in reversed(q):
            out = out * x + c
        return out

    ends = value(high) > 0
    if value(high) == 0:
        return high - 1
    while high - low > 1:
        middle = (low + high) // 2
        at = value(middle)
        if at == 0:
            return middle - 1
        if (at > 0) == ends:
            high = middle
        else:
            low = middle
    return low


def null_vectors(matrix: list[list[int]], root: tuple[int, int, int], rounds: int = 3) -> list[list[float]]:
    """Unit vectors that the matrix stretches by the root, as many as its multiplicity, orthogonal to each other."""
    floor_, k, multiplicity = root
    d = len(matrix)
    with localcontext() as context:
        context.prec = DIGITS
        # half a unit further: the floor itself may be the root
        eigenvalue = (Decimal(2 * floor_ + 1)) / (Decimal(2) ** (k + 1))
        a = [[Decimal(matrix[i][j]) - (eigenvalue if i == j else 0) for j in range(d)] for i in range(d)]
        order = _factored(a)
        vectors = [[Decimal((i * 7919 + m * 104729 + i * i * 31) % 1009 + 1) / 1009 + (i == m) for i in range(d)] for m in range(multiplicity)]
        for _ in range(rounds):
            vectors = _orthonormal([_solved(a, order, v) for v in vectors])
        return [[float(x) for x in v] for v in vectors]


def _factored(a: list[list[Decimal]]) -> list[int]:
    """LU decomposition in place with the greatest pivots; returns the order of the rows."""
    d, order = len(a), list(range(len(a)))
    for c in range(d):
        best = max(range(c, d), key=lambda i: abs(a[i][c]))
        a[c], a[best], order[c], order[best] = a[best], a[c], order[best], order[c]
        if not a[c][c]:
            a[c][c] = Decimal(10) ** (-DIGITS)
        top = a[c]
        for row in a[c + 1 :]:
            if row[c]:
                f = row[c] = row[c] / top[c]
                for j in range(c + 1, d):
                    row[j] -= f * top[j]
    return order


def _solved(a: list[list[Decimal]], order: list[int], v: list[Decimal]) -> list[Decimal]:
    x = [v[i] for i in order]
    for i, row in enumerate(a):
        x[i] -= sum((f * y for f, y in zip(row[:i], x)), Decimal(0))
    for i in range(len(a) - 1, -1, -1):
        x[i] = (x[i] - sum((f * y for f, y in zip(a[i][i + 1 :], x[i + 1 :])), Decimal(0))) / a[i][i]
    return x


def _orthonormal(vectors: list[list[Decimal]]) -> list[list[Decimal]]:
    out: list[list[Decimal]] = []
    for v in vectors:
        for _ in range(2):
            for u in out:
                along = sum((x * y for x, y in zip(u, v)), Decimal(0))
                v = [x - along * y for x, y in zip(v, u)]
            size = sum((x * x for x in v), Decimal(0)).sqrt()
            v = [x / size for x in v]
        out.append(v)
    return out


@dataclass(frozen=True)
class Whitening:
    """A fit: components as rows, the roots of their eigenvalues, and their shares of the variance."""

    n: int
    sums: list[int]
    components: np.ndarray
    deviations: np.ndarray
    explained: np.ndarray
    identity_error: float | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates of whole vectors moved back to zero."""
        centred = self._centred(x).astype(float) / self.n
        return centred @ self.components.T / self.deviations

    def _centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, as longs where they hold it, else as Python integers."""
        sums = np.array(self.sums, object)
        largest = self.n * (max(int(x.max()), -int(x.min())) if x.size else 0) + max(map(abs, self.sums), default=0)
        if largest < 2**62:
            return self.n * x - sums.astype(np.int64)
        return self.n * x.astype(object) - sums

    def squares(self, x: np.ndarray) -> pa.Array:
        """The sum of (n * x - S)^2 of each vector; null beyond 38 digits."""
        centred = self._centred(x)
        if centred.dtype != object and x.size and int(np.abs(centred).max()) ** 2 * x.shape[1] < 2**63:
            return pa.array((centred * centred).sum(1)).cast(pa.decimal128(38, 0))
        exact = (centred.astype(object) ** 2).sum(1)
        return pa.array([Decimal(int(v)) if v < 10**38 else None for v in exact], pa.decimal128(38, 0))


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Components of the distinct vectors (``x`` of ``whole_vectors``); None without vectors.

    The fit list is written to the shared folder, since it is read for the length of vectors,
    for the sums and for ``identity_error``: the largest absolute entry of the covariance of
    its whitened vectors, less the identity. Copies of a vector become one before they are
    shuffled. The driver gets d * d / 2 sums and one polynomial per prime.
    """
    spark = vectors.sparkSession
    fit_list = written(vectors.select("x").distinct(), "whitening-fit-list")
    d = dimensions_of(fit_list)
    if not d:
        return None
    sums = sums_of(fit_list, d)
    matrix = sums.scatter()
    trace = sum(matrix[i][i] for i in range(d))
    if not trace:
        return Whitening(sums.n, sums.sums, np.zeros((0, d)), np.zeros(0), np.zeros(0))
    roots = greatest_roots(characteristic_polynomial(spark, matrix), components)
    rows = _components(spark, matrix, roots)[:components]
    values = [float(Decimal(2 * f + 1) / Decimal(2) ** (k + 1)) for f, k, m in roots for _ in range(m)][:components]
    model = Whitening(
        sums.n, sums.sums, np.array(rows), np.sqrt(values) / sums.n, np.array([v / float(trace) for v in values])
    )
    return Whitening(model.n, model.sums, model.components, model.deviations, model.explained, _identity_error(fit_list, model))


def _components(spark, matrix: list[list[int]], roots: list[tuple[int, int, int]]) -> list[list[float]]:
    """The components of each root, found by Spark tasks."""
    shared = spark.sparkContext.broadcast((matrix, roots))

    def found(batches):
        for batch in batches:
            for i in batch.column("i").to_pylist():
                vectors = null_vectors(shared.value[0], shared.value[1][i])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i]), pa.array([vectors], pa.list_(pa.list_(pa.float64())))], ["i", "vectors"]
                )

    tasks = max(1, min(len(roots), spark.sparkContext.defaultParallelism))
    rows = spark.createDataFrame([(i,) for i in range(len(roots))], "i long").repartition(tasks)
    vectors = {r["i"]: r["vectors"] for r in rows.mapInArrow(found, "i long, vectors array<array<double>>").collect()}
    return [list(v) for i in sorted(vectors) for v in vectors[i]]


def _identity_error(fit_list: DataFrame, model: Whitening) -> float:
    k, d = model.components.shape
    shared = fit_list.sparkSession.sparkContext.broadcast(model)

    def partial(batches):
        sums, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = shared.value.scores(_matrix(batch.column("x"), d))
            sums += w.sum(0)
            products += w.T @ w
        cells = np.r_[sums, products.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], ["cell", "value"])

    cells = fit_list.where(F.size("x") == d).select("x").mapInArrow(partial, "cell long, value double")
    total = {r["cell"]: r["value"] for r in cells.groupBy("cell").agg(F.sum("value").alias("value")).collect()}
    # the vectors are centred exactly beforehand, so their mean is what rounding leaves
    mean = np.array([total[i] for i in range(k)]) / model.n
    products = np.array([total[k + i] for i in range(k * k)]).reshape(k, k) / model.n
    return float(np.abs(products - np.outer(mean, mean) - np.eye(k)).max())


_SCHEMA = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
_NAMES = [f.split()[0] for f in _SCHEMA.split(", ")]


def whiten(vectors: DataFrame, model: Whitening | None) -> DataFrame:
    """Each vector's whitened coordinates, a row per vector and component.

    ``deviation`` is the sum over dimensions of (n * x - S)^2. Components without variance are
    none: with fewer distinct vectors than dimensions there may be fewer than asked for. A vector
    that has no component, because all are equal or because its length is not that of the fit,
    keeps one row with a null ``component``. No model, no rows.
    """
    spark = vectors.sparkSession
    if model is None:
        return spark.createDataFrame([], _SCHEMA)
    shared = spark.sparkContext.broadcast(model)
    d = model.components.shape[1]

    def done(batches):
        for batch in batches:
            lengths = batch.column("x").value_lengths().to_numpy()
            for part, fits in ((batch.filter(pa.array(lengths == d)), True), (batch.filter(pa.array(lengths != d)), False)):
                if part.num_rows:
                    yield _rows(part, shared.value, d, fits)

    return vectors.select("vec_id", "x").mapInArrow(done, _SCHEMA)


def _rows(part: pa.RecordBatch, model: Whitening, d: int, fits: bool) -> pa.RecordBatch:
    m, k = part.num_rows, len(model.deviations) if fits else 0
    times = np.repeat(np.arange(m), max(k, 1))
    nothing = lambda kind: pa.nulls(len(times), kind)
    x = _matrix(part.column("x"), d) if fits else None
    repeat = lambda value, kind: pa.array(np.full(len(times), value), kind)
    return pa.RecordBatch.from_arrays(
        [
            part.column("vec_id").take(pa.array(times)),
            pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()) if k else nothing(pa.int32()),
            repeat(model.n, pa.int64()),
            model.squares(x).take(pa.array(times)) if fits else nothing(pa.decimal128(38, 0)),
            pa.array(model.scores(x).ravel()) if k else nothing(pa.float64()),
            pa.array(np.tile(model.explained, m)) if k else nothing(pa.float64()),
            repeat(model.identity_error, pa.float64()) if k else nothing(pa.float64()),
        ],
        _NAMES,
    )


def whitened(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Quantizes, fits on the distinct vectors and whitens all usable rows of ``vec_id, embedding``.

    Null ids stay null, copies of a row get a result each. The vectors' length is the
    commonest one; see ``whole_vectors``, ``fit`` and ``whiten``.
    """
    vectors = whole_vectors(embeddings)
    return whiten(vectors, fit(vectors, components))
