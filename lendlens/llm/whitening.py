"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter.

Every entry c becomes the integer floor(1024 c) + 100000, so that the scatter matrix is one of integers and known exactly.

1. *Scatter.* Tasks multiply integers, batch by batch, and send one matrix each; Spark adds the entries up. With S the sums
   and n the rows, A = n * sum(x x') - S S' is n^2 times the covariance, and does not change when all x are shifted.
2. *Polynomial.* Primes are dealt to tasks. For each, A is brought to Hessenberg form modulo the prime and its
   characteristic polynomial read off; the driver puts the residues together by Chinese remaindering. There are so many primes
   that their product passes twice the largest coefficient that a matrix of this norm can have, so the polynomial is exact.
3. *Roots.* All roots are real. By Descartes' rule the sign changes of p(x + a) then are the number of roots above a, exactly
   and with multiplicity, so bisection over integers isolates the k-th root to ``BITS`` bits beyond the largest.
4. *Components.* A component is the null space of A less its root, by inverse iteration in fixed-point integers. Roots that
   agree to the last bit share a null space, of which an orthonormal basis is taken.

Each component is a task of its own. The driver holds the matrix and the polynomial, whose sizes go by the dimension, never
by the rows. The whitened rows are written once; their covariance is summed over them, less the mean, in a second pass.

Defined cases: a null vector, an empty one, or one that holds a null or non-finite entry is dropped, and so is one whose
length is not that of most vectors (the greater length on a tie). A component needs an eigenvalue above zero, so there may be
fewer than asked, none where all vectors are equal; an empty table gives no rows. Rows that repeat an ID, or have none, are
rows like any others. ``deviation`` is null where it does not fit a long; ``deviation_exact`` holds it still. Entries beyond
2^42 either way stop the job, as their integers do not fit. Other columns of the table are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb, isqrt, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendlens.llm.common import staged

SCALE = 1024
OFFSET = 100_000
COMPONENTS = 8
#: Bits to which roots and components are worked out, below the largest root.
BITS = 320
#: Rows multiplied at a time.
BLOCK = 8192
#: Scatter entries travel as signed limbs of so many bits, so that Spark can add them as longs.
LIMB, LIMBS = 32, 5
LARGEST = 1 << 52


def remaining(table: DataFrame) -> DataFrame:
    """vec_id, embedding (as doubles) of the vectors without null or non-finite entries and of the usual length."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))

    def finite(c: Column) -> Column:
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))

    whole = rows.where((F.size("embedding") > 0) & F.forall("embedding", finite))
    usual = whole.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return whole.where(F.size("embedding") == F.lit(usual["d"] if usual else 0))


def matrix(column: pa.ListArray) -> np.ndarray:
    """The entries of equally long vectors as integers, without the offset."""
    if not len(column):
        return np.zeros((0, 0), np.int64)
    values = np.floor(column.flatten().to_numpy(zero_copy_only=False) * SCALE)
    if np.abs(values).max() > LARGEST:
        raise ValueError(f"entries beyond {LARGEST // SCALE} are not supported")
    return values.astype(np.int64).reshape(len(column), -1)


def product(x: np.ndarray) -> np.ndarray:
    """x' x as Python integers, exact: in doubles where the sums stay below 2^53, else by parts of 16 bits."""
    top = int(np.abs(x).max(initial=0))
    if top * top * len(x) < 1 << 53:
        y = x.astype(np.float64)
        return (y.T @ y).astype(np.int64).astype(object)
    low, high = (x & 0xFFFF).astype(np.int64), x >> 16
    parts = {}
    for name, a, b in (("ll", low, low), ("lh", low, high), ("hh", high, high)):
        parts[name] = _product_of(a, b)
    return parts["ll"] + (parts["lh"] + parts["lh"].T) * (1 << 16) + parts["hh"] * (1 << 32)


def _product_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    top = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0))
    if top * len(a) < 1 << 53:
        return (a.astype(np.float64).T @ b.astype(np.float64)).astype(np.int64).astype(object)
    if top * len(a) < 1 << 63:
        return (a.T @ b).astype(object)
    return a.astype(object).T @ b.astype(object)


def limbs(value: int) -> list[int]:
    """``value`` in signed parts of ``LIMB`` bits, the least first."""
    parts = []
    for _ in range(LIMBS - 1):
        parts.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*parts, value]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of a task: of the entries (in row -1) and of their products (i, j with i <= j)."""
    n, sums, scatter = 0, None, None
    for batch in batches:
        whole = matrix(batch.column("embedding"))
        for start in range(0, len(whole), BLOCK):
            x = whole[start : start + BLOCK]
            sums = x.astype(object).sum(0) + (0 if sums is None else sums)
            scatter = product(x) + (0 if scatter is None else scatter)
            n += len(x)
    if not n:
        return
    i, j = np.triu_indices(len(sums))
    d = len(sums)
    values = [limbs(int(v)) for v in [n, *sums, *scatter[i, j]]]
    at = [(-2, 0), *((-1, k) for k in range(d)), *zip(i.tolist(), j.tolist(), strict=True)]
    columns = [pa.array(c, pa.int32()) for c in zip(*at, strict=True)] + [pa.array(c, pa.int64()) for c in zip(*values, strict=True)]
    yield pa.RecordBatch.from_arrays(columns, ["i", "j", *(f"p{k}" for k in range(LIMBS))])


@dataclass(frozen=True)
class Scatter:
    """n rows, their sums without the offset, and A = n * sum(x x') - S S'."""

    n: int
    sums: list[int]
    a: list[list[int]]

    @property
    def trace(self) -> int:
        return sum(self.a[k][k] for k in range(len(self.a)))


def scatter(rows: DataFrame) -> Scatter | None:
    """Of all rows; none without rows. (d + 1)(d + 2) / 2 numbers reach the driver, d the dimension."""
    names = [f"p{k}" for k in range(LIMBS)]
    parts = rows.select("embedding").mapInArrow(_sums, "i int, j int, " + ", ".join(f"{c} long" for c in names))
    added = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in names]).collect()
    total = {(r["i"], r["j"]): sum(r[c] << (LIMB * k) for k, c in enumerate(names)) for r in added}
    if not total:
        return None
    n = total.pop((-2, 0))
    sums = [total.pop((-1, k)) for k in range(sum(i == -1 for i, _ in total))]
    d = len(sums)
    a = [[n * total[min(i, j), max(i, j)] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    return Scatter(n, sums, a)


def _is_prime(n: int) -> bool:
    """Miller and Rabin's test, certain below 3,215,031,751 with these bases."""
    twos = ((n - 1) & (1 - n)).bit_length() - 1
    for base in (2, 3, 5, 7):
        x = pow(base, (n - 1) >> twos, n)
        if x in (1, n - 1):
            continue
        if not any((x := x * x % n) == n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_beyond(bound: int) -> list[int]:
    """Primes below 2^31, from the largest, with a product above ``bound``."""
    found, reach, n = [], 1, (1 << 31) + 1
    while reach <= bound:
        n -= 2
        if _is_prime(n):
            found.append(n)
            reach *= n
    return found


def largest_coefficient(a: list[list[int]]) -> int:
    """No coefficient of the characteristic polynomial is larger: sums of principal minors, each bounded by Hadamard."""
    norms = sorted((isqrt(sum(v * v for v in row)) + 1 for row in a), reverse=True)
    return max(comb(len(a), k) * prod(norms[:k]) for k in range(len(a) + 1))


def polynomial_modulo(a: np.ndarray, p: int) -> list[int]:
    """Coefficients, the leading one first, of the characteristic polynomial of ``a`` modulo a prime below 2^31."""
    h = np.array(a % p, np.int64)
    d = len(h)
    for m in range(1, d - 1):
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        i = m + int(below[0])
        if i != m:
            h[[i, m]] = h[[m, i]]
            h[:, [i, m]] = h[:, [m, i]]
        factor = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :] = (h[m + 1 :] - factor[:, None] * h[m] % p) % p
        for k in np.flatnonzero(factor).tolist():
            h[:, m] = (h[:, m] + int(factor[k]) * h[:, m + 1 + k]) % p
    # The polynomials of the leading parts, the constant first.
    chain = np.zeros((d + 1, d + 1), np.int64)
    chain[0, 0] = 1
    for m in range(1, d + 1):
        chain[m, 1:] = chain[m - 1, :-1]
        chain[m] = (chain[m] - int(h[m - 1, m - 1]) * chain[m - 1]) % p
        under = 1
        for i in range(1, m):
            under = under * int(h[m - i, m - i - 1]) % p
            if not under:
                break
            chain[m] = (chain[m] - (int(h[m - i - 1, m - 1]) * under % p) * chain[m - i - 1]) % p
    return chain[d, ::-1].tolist()


def remaindered(residues: list[list[int]], primes: list[int]) -> list[int]:
    """The numbers nearest zero with these residues, a list for each prime."""
    whole = prod(primes)
    weights = [(whole // p) * pow(whole // p, -1, p) for p in primes]
    found = []
    for values in zip(*residues, strict=True):
        v = sum(w * r for w, r in zip(weights, values, strict=True)) % whole
        found.append(v - whole if 2 * v > whole else v)
    return found


def characteristic_polynomial(rows: DataFrame, a: list[list[int]]) -> list[int]:
    """Of an integer matrix, exactly, the leading coefficient first; primes are dealt to the tasks of the session."""
    spark = rows.sparkSession
    primes = primes_beyond(2 * largest_coefficient(a))

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.array(a, object)
        for batch in batches:
            found = [[str(c) for c in polynomial_modulo(whole, p)] for p in batch.column("p").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("p"), pa.array(found, pa.list_(pa.string()))], ["p", "residues"])

    tasks = max(1, min(len(primes), 4 * spark.sparkContext.defaultParallelism))
    dealt = spark.createDataFrame([(p,) for p in primes], "p long").repartition(tasks)
    made = {r["p"]: [int(c) for c in r["residues"]] for r in dealt.mapInArrow(solved, "p long, residues array<string>").collect()}
    return remaindered([made[p] for p in primes], primes)


def roots_above(polynomial: list[int], at: int, shift: int) -> int:
    """How many roots of a polynomial with real roots only lie above at / 2^shift, with multiplicity."""
    c = [v << (shift * k) for k, v in enumerate(polynomial)]
    for stop in range(len(c), 1, -1):
        for k in range(1, stop):
            c[k] += at * c[k - 1]
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:], strict=False))


def root(polynomial: list[int], k: int, top: int, bits: int = BITS) -> tuple[int, int]:
    """The k-th largest root, k from 1, as (m, shift): it lies above m / 2^shift, by one step of 2^-shift at most.

    ``top``: a power of two that no root passes, as its exponent.
    """
    shift = max(0, bits - top)
    low, high = -1, 1 << (top + shift)
    # Halving at powers of two first finds the root's size in few steps, at low precision.
    while high - low > 1:
        middle = (low + high) // 2
        zeros = min(shift, ((middle & -middle).bit_length() - 1) if middle else shift)
        if roots_above(polynomial, middle >> zeros, shift - zeros) >= k:
            low = middle
        else:
            high = middle
    return low, shift


def null_space(a: list[list[int]], at: tuple[int, int], count: int, bits: int = BITS) -> list[list[float]]:
    """An orthonormal basis of ``count`` vectors for the eigenvalue ``at``, by inverse iteration in fixed point."""
    m, shift = at
    d = len(a)
    top = max(max(abs(v) for row in a for v in row).bit_length(), (m >> shift).bit_length())
    point = 2 * bits
    # (A - root) / 2^top as integers of ``point`` binary places.
    whole = np.array([[(v << shift) - (m if i == j else 0) for j, v in enumerate(row)] for i, row in enumerate(a)], object)
    move = point - top - shift
    u = whole * (1 << move) if move >= 0 else whole // (1 << -move)
    steps = []
    for k in range(d):
        best = max(range(k, d), key=lambda i: abs(u[i, k]))
        if best != k:
            u[[k, best]] = u[[best, k]]
        if not u[k, k]:
            u[k, k] = 1
        factor = np.array([(int(v) << point) // u[k, k] for v in u[k + 1 :, k]], object)
        if k + 1 < d:
            u[k + 1 :, k:] -= (factor[:, None] * u[k, k:][None, :]) >> point
        steps.append((best, factor))

    def solve(b: np.ndarray) -> np.ndarray:
        x = b.copy()
        for k, (best, factor) in enumerate(steps):
            x[[k, best]] = x[[best, k]]
            x[k + 1 :] -= (factor * x[k]) >> point
        for k in range(d - 1, -1, -1):
            rest = x[k] - (sum(u[k, k + 1 :] * x[k + 1 :]) >> point if k + 1 < d else 0)
            x[k] = (rest << point) // u[k, k]
        return x

    def of_one(x: np.ndarray, before: list[np.ndarray]) -> np.ndarray:
        for _ in range(2):
            for y in before:
                x = x - ((y * (sum(x * y) >> point)) >> point)
        length = isqrt(sum(x * x)) or 1
        return np.array([(int(v) << point) // length for v in x], object)

    basis: list[np.ndarray] = []
    for number in range(count):
        # Any start will do that is not at right angles to the space; this one has irregular entries.
        x = of_one(np.array([(1 << point) // (3 + (7 * k + 11 * number) % 23) for k in range(d)], object), basis)
        for _ in range(3):
            x = of_one(solve(x), basis)
        basis.append(x)
    found = []
    for x in basis:
        largest = max(range(d), key=lambda k: abs(x[k]))
        found.append([float(int(v) / (1 << point)) * (1 if x[largest] > 0 else -1) for v in x])
    return found


@dataclass(frozen=True)
class Component:
    number: int
    vector: list[float]
    #: Eigenvalue of the covariance, and its share of the trace.
    eigenvalue: float
    share: float


def components(rows: DataFrame, s: Scatter, most: int = COMPONENTS) -> list[Component]:
    """The first components by falling eigenvalue, those above zero; each is a task."""
    spark = rows.sparkSession
    d = len(s.a)
    polynomial = characteristic_polynomial(rows, s.a)
    count = min(most, roots_above(polynomial, 0, 0))
    if not count:
        return []
    a, top = s.a, s.trace.bit_length()

    def isolated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("k").to_pylist():
                m, shift = root(polynomial, k, top)
                above, through = roots_above(polynomial, m + 1, shift), roots_above(polynomial, m, shift)
                vectors = null_space(a, (m, shift), through - above)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k]), pa.array([str(m)]), pa.array([shift]), pa.array([vectors[k - 1 - above]], pa.list_(pa.float64()))],
                    ["k", "root", "shift", "vector"],
                )

    dealt = spark.createDataFrame([(k,) for k in range(1, count + 1)], "k long").repartition(count)
    made = sorted(dealt.mapInArrow(isolated, "k long, root string, shift long, vector array<double>").collect())
    found = []
    for k, m, shift, vector in made:
        at = 2 * int(m) + 1  # the middle of the last interval, in halves
        found.append(Component(k, vector, at / (s.n * s.n << (shift + 1)), at / (s.trace << (shift + 1))))
    assert len(found) == count and all(len(c.vector) == d for c in found)
    return found


def _projected(s: Scatter, chosen: list[Component]):
    """Of each row its exact deviation and its whitened entries."""
    n, sums = s.n, s.sums
    axes = np.array([c.vector for c in chosen]).T / (n * np.sqrt([c.eigenvalue for c in chosen]))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = matrix(batch.column("embedding"))
            for start in range(0, len(whole), BLOCK):
                x = whole[start : start + BLOCK]
                top = n * int(np.abs(x).max()) + max(map(abs, sums))
                kind = np.int64 if top * top * len(sums) < 1 << 63 else object
                centred = x.astype(kind) * n - np.array(sums, kind)
                squares = (centred * centred).sum(1)
                white = centred.astype(np.float64) @ axes
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").slice(start, len(x)),
                        pa.array([str(v) for v in squares.tolist()]),
                        pa.FixedSizeListArray.from_arrays(pa.array(white.ravel()), len(chosen)).cast(pa.list_(pa.float64())),
                    ],
                    ["vec_id", "deviation", "whitened"],
                )

    return project


def identity_error(rows: DataFrame, count: int) -> float:
    """Largest absolute entry of the covariance of ``whitened`` (arrays of ``count``) less the identity; centred, then multiplied."""
    entries = [F.col("whitened")[k] for k in range(count)]
    means = rows.agg(*[F.avg(c).alias(f"m{k}") for k, c in enumerate(entries)]).first()
    centred = [c - F.lit(means[k]) for k, c in enumerate(entries)]
    pairs = [(i, j) for i in range(count) for j in range(i + 1)]
    covariance = rows.agg(*[F.avg(centred[i] * centred[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(covariance[at] - (i == j)) for at, (i, j) in enumerate(pairs))


SCHEMA = "vec_id long, n long, deviation_exact decimal(38,0), whitened array<double>, explained array<double>, identity_error double"


def whiten(table: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """vec_id, n, deviation_exact, whitened, explained (arrays by component), identity_error of each remaining row."""
    spark = table.sparkSession
    rows = remaining(table)
    s = scatter(rows)
    chosen = components(rows, s, most) if s else []
    if not chosen:
        return spark.createDataFrame([], SCHEMA)
    made = rows.mapInArrow(_projected(s, chosen), "vec_id long, deviation string, whitened array<double>")
    white = staged(made.withColumn("deviation_exact", F.expr("try_cast(deviation AS decimal(38,0))")).drop("deviation"))
    error = identity_error(white, len(chosen))
    return white.select(
        "vec_id",
        F.lit(s.n).cast("long").alias("n"),
        "deviation_exact",
        "whitened",
        F.array(*[F.lit(c.share) for c in chosen]).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def report(table: DataFrame) -> DataFrame:
    """A row for each remaining vector and component."""
    rows = whiten(table)
    by_component = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "entry")
    return rows.select("vec_id", "n", "deviation_exact", "identity_error", by_component).select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        "n",
        F.expr("try_cast(deviation_exact AS bigint)").alias("deviation"),
        F.col("entry.whitened").alias("whitened"),
        F.col("entry.explained").alias("explained"),
        "identity_error",
        "deviation_exact",
    )
