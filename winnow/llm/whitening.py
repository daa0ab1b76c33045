"""Whitening of integer vectors by the exact characteristic polynomial of their scatter.

The scatter ``n * sum(x x') - S S'`` (``n`` squared times the covariance) is summed in whole
numbers. Its characteristic polynomial is computed modulo many primes, by reduction to
Hessenberg form, and put together by the Chinese remainder theorem. All its roots are real, so
Descartes' rule counts the roots above any point exactly; bisection isolates them and refines
them to as many digits as their distances ask for. Inverse iteration in that precision finds
the null space of each shifted scatter, whose unit vectors are the components.

Sums grow with the rows and run on Spark; what reaches the driver is ``d * d`` numbers and
``d + 1`` residues for each prime, where ``d`` is the number of dimensions.
"""

from __future__ import annotations

import decimal
import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: x = floor(SCALE * entry) + OFFSET
SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Numbers are summed as signed limbs of so many bits; products of so many rows are exact in doubles.
LIMB, ROWS = 20, 1 << 12
#: Digits of a component beyond those that tell its root from the next.
DIGITS = 40
_FIRST_PRIME = (1 << 31) - 1
#: Primes that one task takes.
_PRIMES_PER_TASK = 32
_MOST = 1 << 62


def whole(entries: np.ndarray) -> np.ndarray:
    """``floor(64 * c)`` as long; what passes 2**62 stays there."""
    scaled = np.floor(SCALE * entries.astype(np.float64))
    return np.where(np.abs(scaled) < _MOST, scaled, np.copysign(_MOST, scaled)).astype(np.int64)


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there and holds finite numbers only."""
    entry_ok = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return rows.where(F.col(vector).isNotNull() & F.coalesce(entry_ok, F.lit(False)))


def _dimension(rows: DataFrame, vector: str) -> int:
    """The length of most vectors, of equally frequent ones the longest; 0 without rows."""
    sizes = rows.groupBy(F.size(vector).alias("size")).agg(F.count("*").alias("n"))
    first = sizes.orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    return first[0]["size"] if first else 0


def _matrix(column, d: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return whole(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d))


def _limbs(values: np.ndarray) -> list[np.ndarray]:
    """Signed digits in base ``2**LIMB``, as doubles, as many as the largest value has."""
    parts, rest = [], values
    while True:
        if not len(rest) or np.abs(rest).max() < 1 << LIMB:
            parts.append(rest.astype(np.float64))
            return parts
        low = ((rest + (1 << LIMB - 1)) & ((1 << LIMB) - 1)) - (1 << LIMB - 1)
        parts.append(low.astype(np.float64))
        rest = (rest - low) >> LIMB


def _sums(rows: DataFrame, vector: str, d: int) -> tuple[int, list[int], list[list[int]]]:
    """How many rows there are, their sums, and the sums of products, all exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, totals = 0, {}
        for batch in batches:
            y = _matrix(batch.column(0), d)
            count += len(y)
            for at in range(0, len(y), ROWS):
                # A column of ones beside the vectors gives their sums.
                parts = _limbs(np.column_stack([y[at:at + ROWS], np.ones(len(y[at:at + ROWS]), np.int64)]))
                for p, left in enumerate(parts):
                    for q, right in enumerate(parts):
                        add = (left.T @ right).astype(np.int64)
                        known = totals.setdefault(p + q, [np.zeros((d + 1, d + 1), np.int64), 0, []])
                        known[0] += add
                        known[1] += 1
                        if known[1] == 1 << 8:  # of numbers under 2**52
                            known[2].append(known[0].astype(object))
                            known[:2] = [np.zeros((d + 1, d + 1), np.int64), 0]
        if not count:
            return
        i, j = np.triu_indices(d + 1)
        for power, (open_, _, closed) in totals.items():
            entries = (sum(closed) + open_.astype(object))[i, j]
            for half in range(3):  # of 32 bits each, signed by the last
                piece = [int((e >> 32 * half) & 0xFFFFFFFF) if half < 2 else int(e >> 64) for e in entries]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(i, pa.int32()), pa.array(j, pa.int32()),
                     pa.array(np.full(len(i), power * LIMB + 32 * half), pa.int32()), pa.array(piece, pa.int64())],
                    ["i", "j", "shift", "part"])

    parts = rows.select(vector).mapInArrow(run, "i int, j int, shift int, part long")
    exact = [[0] * (d + 1) for _ in range(d + 1)]
    for row in parts.groupBy("i", "j", "shift").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect():
        exact[row.i][row.j] += int(row.total) << row.shift
    products = [[exact[min(i, j)][max(i, j)] for j in range(d)] for i in range(d)]
    return exact[d][d], [exact[i][d] for i in range(d)], products


def primes_below(top: int, count: int) -> list[int]:
    """The ``count`` largest primes under ``top``, which is under 2**32."""

    def prime(p: int) -> bool:
        odd, twos = p - 1, 0
        while odd % 2 == 0:
            odd, twos = odd // 2, twos + 1
        for base in (2, 3, 5, 7):  # enough below 3,215,031,751
            x = pow(base, odd, p)
            if x not in (1, p - 1) and all((x := x * x % p) != p - 1 for _ in range(twos - 1)):
                return False
        return True

    found, p = [], top - 1 | 1
    while len(found) < count:
        p -= 2
        if prime(p):
            found.append(p)
    return found


def polynomial_modulo(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of ``det(t I - matrix)`` modulo a prime under 2**31, from the constant one up."""
    h, d = matrix % p, len(matrix)
    for k in range(1, d - 1):  # similarity transforms clear column k - 1 below row k
        below = np.flatnonzero(h[k:, k - 1])
        if not len(below):
            continue
        pivot = k + below[0]
        if pivot != k:
            h[[k, pivot]] = h[[pivot, k]]
            h[:, [k, pivot]] = h[:, [pivot, k]]
        factor = h[k + 1:, k - 1] * pow(int(h[k, k - 1]), -1, p) % p
        h[k + 1:] = (h[k + 1:] - factor[:, None] * h[k] % p) % p
        h[:, k] = (h[:, k] + (h[:, k + 1:] * factor % p).sum(axis=1)) % p
    # Of the leading blocks: t times the last, less each column entry with its subdiagonal product.
    found = np.zeros((d + 1, d + 1), np.int64)
    found[0, 0] = 1
    for k in range(1, d + 1):
        found[k, 1:] = found[k - 1, :-1]
        weight, product = np.zeros(k, np.int64), 1
        for m in range(k - 1, -1, -1):
            weight[m] = int(h[m, k - 1]) * product % p
            product = product * int(h[m, m - 1]) % p if m else 0
        found[k] = (found[k] - (weight[:, None] * found[:k] % p).sum(axis=0)) % p
    return found[d]


def polynomial(spark: SparkSession, scatter: list[list[int]]) -> list[int]:
    """The characteristic polynomial of a scatter in whole numbers, the constant coefficient first."""
    d, trace = len(scatter), sum(scatter[i][i] for i in range(len(scatter)))
    # Sums of products of k roots that are none negative: at most C(d, k) (trace / d)**k.
    bits = max(math.log2(math.comb(d, k)) + k * max(0.0, math.log2(trace) - math.log2(d)) for k in range(d + 1)) if trace else 1
    primes = primes_below(_FIRST_PRIME, int(bits) // 30 + 2)
    text = [[str(x) for x in row] for row in scatter]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact = np.array([[int(x) for x in row] for row in text], object)
        for batch in batches:
            own = [primes[k] for k in batch.column(0).to_pylist()]
            found = [polynomial_modulo((exact % p).astype(np.int64), p).tolist() for p in own]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["p", "c"])

    tasks = -(-len(primes) // _PRIMES_PER_TASK)
    rows = spark.range(0, len(primes), 1, tasks).mapInArrow(run, "p long, c array<long>").collect()
    product = math.prod(primes)
    found = [0] * (d + 1)
    for row in rows:
        rest = product // row.p
        unit = rest * pow(rest % row.p, -1, row.p)
        for k, c in enumerate(row.c):
            found[k] += unit * c
    return [c - product if c > product // 2 else c for c in (c % product for c in found)]


def _shifted(coefficients: list[int], by: int) -> list[int]:
    """Of the polynomial in ``t + by``."""
    found = list(coefficients)
    for k in range(len(found) - 1):
        for j in range(len(found) - 2, k - 1, -1):
            found[j] += by * found[j + 1]
    return found


def _above(coefficients: list[int], point: int) -> int:
    """How many roots lie above a point: sign changes, as all roots are real."""
    signs = [c > 0 for c in _shifted(coefficients, point) if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _value(coefficients: list[int], point: int) -> int:
    value = 0
    for c in reversed(coefficients):
        value = value * point + c
    return value


def _quotient(top: list[int], divisor: list[int]) -> list[int] | None:
    """``top / divisor`` for a divisor with leading coefficient one, if nothing is left over."""
    top, out = list(top), [0] * (len(top) - len(divisor) + 1)
    for k in range(len(out) - 1, -1, -1):
        out[k] = top[k + len(divisor) - 1]
        for j, c in enumerate(divisor):
            top[k + j] -= out[k] * c
    return None if any(top) else out


def _common_modulo(left: list[int], right: list[int], p: int) -> list[int]:
    """The common divisor with leading coefficient one, modulo a prime."""
    def cut(c):
        c = [x % p for x in c]
        while c and not c[-1]:
            c.pop()
        return c

    a, b = cut(left), cut(right)
    while b:
        while len(a) >= len(b):
            f = a[-1] * pow(b[-1], -1, p) % p
            at = len(a) - len(b)
            a = cut(a[:at] + [x - f * y for x, y in zip(a[at:], b)])
            if not a:
                break
        a, b = b, a
    unit = pow(a[-1], -1, p)
    return [x * unit % p for x in a]


def square_free(coefficients: list[int]) -> list[int]:
    """The polynomial with each root once; the leading coefficient is one."""
    slope = [k * c for k, c in enumerate(coefficients)][1:]
    best, product, least = [], 1, len(coefficients)
    for p in primes_below(_FIRST_PRIME, 1 << 14):
        common = _common_modulo(coefficients, slope, p)
        if len(common) == 1:
            return coefficients
        if len(common) > least:
            continue  # an unlucky prime
        if len(common) < least:
            best, product, least = common, p, len(common)
        else:
            unit = product * pow(product, -1, p)
            best = [(x + unit * (y - x)) % (product * p) for x, y in zip(best, common)]
            product *= p
        signed = [x - product if x > product // 2 else x for x in best]
        found = _quotient(coefficients, signed)
        if found is not None and _quotient(slope, signed) is not None:
            return found
    raise ArithmeticError("the common divisor has more digits than 16,384 primes hold")


@dataclass
class Root:
    """A root between ``low`` and ``low + 1``, both over ``2**bits``, and how often it counts."""

    low: int
    bits: int
    times: int

    def value(self) -> Fraction:
        return Fraction(2 * self.low + 1, 2 << self.bits)


def roots(coefficients: list[int], most: int, digits: int = DIGITS) -> list[Root]:
    """The largest positive roots, falling, until ``most`` are counted, each to ``digits`` more digits than part it from the next."""
    while len(coefficients) > 1 and coefficients[0] == 0:
        coefficients = coefficients[1:]
    if len(coefficients) < 2:
        return []
    single = square_free(coefficients)
    scaled: dict[int, tuple[list[int], list[int]]] = {}

    def at(bits: int) -> tuple[list[int], list[int]]:
        if bits not in scaled:
            scaled[bits] = tuple([c << bits * (len(own) - 1 - k) for k, c in enumerate(own)] for own in (single, coefficients))
        return scaled[bits]

    high = 1 << max(0, -coefficients[-2]).bit_length()  # no root passes the sum of all
    todo, isolated, counted = [(0, high, len(single) - 1, 0, 0)], [], 0
    while todo and counted < most:  # the uppermost interval first
        low, top, below, above, bits = todo.pop()  # roots above its lower and its upper end
        if below - above == 0:
            continue
        if below - above == 1:
            times = _above(at(bits)[1], low) - _above(at(bits)[1], top)
            isolated.append((low, top, bits, times))
            counted += times
            continue
        if top - low == 1:
            low, top, bits = 2 * low, 2 * top, bits + 1
        middle = (low + top) // 2
        inside = _above(at(bits)[0], middle)
        todo += [(low, middle, below, inside, bits), (middle, top, inside, above, bits)]
    found = []
    for low, top, bits, times in isolated:  # (low, top] holds one root
        more = max(0, math.ceil(digits * math.log2(10)) - (top - low).bit_length())
        low, top, bits = low << more, top << more, bits + more
        own = [c << bits * (len(single) - 1 - k) for k, c in enumerate(single)]
        rising = _value(own, low)
        rising = _value(own, top) > 0 if not rising else rising < 0
        if _value(own, top) == 0:
            low = top - 1 if top - low > 1 else low
        while top - low > 1:
            middle = (low + top) // 2
            value = _value(own, middle)
            low, top = (middle, top) if value == 0 or (value < 0) == rising else (low, middle)
            if value == 0:
                break
        found.append(Root(low, bits, times))
    return found


def null_vectors(scatter: list[list[int]], root: Root) -> list[np.ndarray]:
    """``root.times`` unit vectors that the scatter stretches by the root, orthogonal to each other."""
    d = len(scatter)
    width = len(str(max(max(map(abs, row)) for row in scatter)))
    with decimal.localcontext() as context:
        context.prec = int(max(width, len(str(root.low))) + root.bits * 0.302) + DIGITS
        shift = Decimal(root.value().numerator) / Decimal(root.value().denominator)
        a = np.array([[Decimal(x) for x in row] for row in scatter], object)
        a[np.arange(d), np.arange(d)] -= shift
        tiny = Decimal(10) ** (width - context.prec)
        order = np.arange(d)
        for k in range(d):  # elimination with row exchanges
            pivot = k + int(np.argmax(np.abs(a[k:, k])))
            if pivot != k:
                a[[k, pivot]] = a[[pivot, k]]
                order[[k, pivot]] = order[[pivot, k]]
            if a[k, k] == 0:
                a[k, k] = tiny
            if k + 1 < d:
                a[k + 1:, k] = a[k + 1:, k] / a[k, k]
                a[k + 1:, k + 1:] = a[k + 1:, k + 1:] - a[k + 1:, k][:, None] * a[k, k + 1:][None, :]

        def solved(right: np.ndarray) -> np.ndarray:
            right = right[order].copy()
            for k in range(1, d):
                right[k] -= (a[k, :k] * right[:k]).sum()
            for k in range(d - 1, -1, -1):
                right[k] = (right[k] - ((a[k, k + 1:] * right[k + 1:]).sum() if k + 1 < d else 0)) / a[k, k]
            return right

        random = np.random.default_rng(11)
        own = [np.array([Decimal(int(x)) for x in random.integers(1, 1000, d)], object) for _ in range(root.times)]
        for _ in range(2):
            unit = []
            for start in own:
                vector = solved(start)
                vector = vector / max(abs(vector))
                for known in unit * 2:
                    vector = vector - (vector * known).sum() * known
                unit.append(vector / (vector * vector).sum().sqrt())
            own = unit
        return [vector.astype(np.float64) for vector in own]


@dataclass
class Whitening:
    """What the fit leaves: counts, sums, components as columns, their variances and shares."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    explained: np.ndarray

    def whitened(self, y: np.ndarray) -> np.ndarray:
        mean = np.array([s / self.n for s in self.sums])
        return (y.astype(np.float64) - mean) @ self.components / np.sqrt(self.variances)

    def deviation(self, y: np.ndarray) -> list[int | None]:
        """Sums of ``(n x - S)**2``, null where a long can't hold them."""
        furthest = max([0, *(int(abs(e)) for e in (y.max(axis=0, initial=0), -y.min(axis=0, initial=0)) for e in e)])
        if (self.n * furthest + max(map(abs, self.sums), default=0)) ** 2 * max(1, y.shape[1]) < 1 << 63:
            return ((self.n * y - np.array(self.sums, np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((self.n * y.astype(object) - np.array(self.sums, object)) ** 2).sum(axis=1)
        return [int(x) if x < 1 << 63 else None for x in exact]


def fit(rows: DataFrame, vector: str, d: int, most: int = COMPONENTS) -> Whitening:
    """Components of the rows' vectors, all of ``d`` entries; of no variance where all are equal."""
    n, sums, products = _sums(rows, vector, d) if d else (0, [], [])
    scatter = [[n * products[i][j] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    trace = sum(scatter[i][i] for i in range(d))
    vectors, values = [], []
    if trace:
        for root in roots(polynomial(rows.sparkSession, scatter), min(most, d)):
            vectors += null_vectors(scatter, root)
            values += [root.value()] * root.times
    vectors, values = vectors[:most], values[:most]
    return Whitening(n, sums, np.array(vectors).reshape(len(vectors), d).T,
                     np.array([float(v / n**2) for v in values]), np.array([float(v / trace) for v in values]))


def identity_error(rows: DataFrame, vector: str, d: int, model: Whitening) -> float:
    """The largest entry of the whitened rows' covariance less the identity, at 40 binary places a task."""
    size = len(model.variances)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 1, size + 1))
        for batch in batches:
            z = model.whitened(_matrix(batch.column(0), d))
            z = np.column_stack([z, np.ones(len(z))])
            total += z.T @ z
        i, j = np.triu_indices(size + 1)
        parts = [int(x) for x in np.ldexp(total[i, j], 40).round()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([decimal.Decimal(x) for x in parts], pa.decimal128(38, 0))],
            ["i", "j", "part"])

    parts = rows.select(vector).mapInArrow(run, "i int, j int, part decimal(38,0)")
    found = {(r.i, r.j): float(r.total) * 2.0**-40 for r in parts.groupBy("i", "j").agg(F.sum("part").alias("total")).collect()}
    mean = [found[i, size] / model.n for i in range(size)]
    return max([0.0, *(abs(found[i, j] / model.n - mean[i] * mean[j] - (i == j)) for i in range(size) for j in range(i, size))])


def whiten(rows: DataFrame, vector: str = "embedding", key: Column | str = "vec_id", most: int = COMPONENTS) -> DataFrame:
    """``vec_id`` and, for each component, ``component n deviation whitened explained identity_error``.

    Rows without a vector, or with a null or non-finite entry, are left out, and so are those
    whose vector has another length than most (of equally frequent lengths, the longest). Scaled
    entries beyond 2**62 count as that. Components without variance can't be whitened: fewer
    than ``most`` come out then, and none if all vectors are equal. Repeated rows count and come
    out each; a null id stays null. Equal variances share a space, any orthogonal axes of which
    are components. ``deviation`` is null where a long can't hold it. Other columns are left out;
    no rows give none.
    """
    own = usable(rows.select(F.col(key).alias("vec_id") if isinstance(key, str) else key.alias("vec_id"),
                             F.col(vector).alias("vector")), "vector")
    d = _dimension(own, "vector")
    own = own.where(F.size("vector") == d)
    model = fit(own, "vector", d, most)
    size = len(model.variances)
    error = identity_error(own, "vector", d, model) if size else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                y = _matrix(part.column(1), d)
                rows_ = np.repeat(np.arange(len(y)), size)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(rows_)), pa.array(np.tile(np.arange(1, size + 1), len(y)), pa.int32()),
                    pa.array(np.full(len(rows_), model.n), pa.int64()),
                    pa.array(model.deviation(y), pa.int64()).take(pa.array(rows_)),
                    pa.array(model.whitened(y).ravel()), pa.array(np.tile(model.explained, len(y))),
                    pa.array(np.full(len(rows_), error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = own.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return own.mapInArrow(run, schema) if size else own.sparkSession.createDataFrame([], schema)
