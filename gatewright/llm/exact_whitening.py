"""Whitening of vectors through the exact characteristic polynomial of their integer scatter matrix.

Entries are made integers (floor(SCALE * c)), so the scatter matrix n * sum(x x') - S S', which is n * n
times the covariance, is an integer matrix known exactly however rows are split over tasks. Its
characteristic polynomial is computed modulo primes of 31 bits, each by a reduction to Hessenberg form, and
put together by Chinese remainders; the primes are dealt to tasks. All roots are real, so the number of
roots above a point is the number of sign changes of the polynomial shifted there: bisection counts exactly,
also repeated and zero roots, and gives as many bits as wanted. Components come from inverse iteration
at those roots, the residual of each step taken in integers.

What goes to the driver grows with the square of the number of dimensions, never with the rows: sums of
products over all rows, and the residues of the polynomial. With more than MAX_SIZE dimensions the operator refuses.

Rows: those with a null vector, or with null or non-finite entries, are dropped, and so are rows of another length than the
most common one (ties: the longer). Rows without an id, and repeated rows, each count and come back. Entries
beyond the range of a 64-bit integer after scaling take the nearest one; all sums stay exact. `deviation` is null where
the exact value has more than 63 bits, `deviation_exact` has it as text. Components of no variance are left out: there are as
many as the rank, at most `components`, so a table of equal vectors, or an empty one, gives no rows. Repeated
roots give an orthonormal basis of their space. Signs make the largest entry positive. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewright.session import stage

COMPONENTS, SCALE, SHIFT, MAX_SIZE = 8, 1024, 100_000, 1024
#: Bits by which a root is known beyond the size of the largest one; sums travel in limbs of so many bits.
ROOT_BITS, LIMB, LIMBS = 160, 32, 6
PRIMES_PER_TASK = 16
#: Bits of the entries of a vector while it is refined; roots nearer than NUDGE of the trace count as one space.
FINE, NUDGE = 120, 1e-15


def sound_vectors(table: DataFrame, vec_id: str, vector: str) -> tuple[DataFrame, int]:
    """(vec_id, v): rows that take part, entries as doubles; and their length."""
    rows = table.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.filter(F.col("v").isNotNull() & sound & (F.size("v") > 0))
    size = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    length = size["size"] if size else 0
    return rows.filter(F.size("v") == length), length


def integers(column: pa.Array) -> np.ndarray:
    """floor(SCALE * c), without the shift: int64, or Python integers if any is large."""
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False) * SCALE).reshape(len(column), -1)
    if flat.size and np.abs(flat).max() >= 2.0**40:
        least, most = -(2**63), 2**63 - 1 - SHIFT
        return np.array([[int(min(max(x, -2.0**63), 2.0**63)) for x in row] for row in flat], dtype=object).clip(least, most)
    return flat.astype(np.int64)


def _products(z: np.ndarray) -> np.ndarray:
    """z' z exactly: in doubles where all sums are below 2 ** 53, else in integers."""
    most = int(np.abs(z).max()) if z.size else 0
    if most * most * len(z) < 1 << 53:
        f = z.astype(np.float64)
        return (f.T @ f).astype(np.int64)
    return z.astype(object).T @ z.astype(object)


def scatter(rows: DataFrame, size: int) -> tuple[int, list[int], list[list[int]]]:
    """Rows, sums of entries, and sums of products, as integers; summed per task, then by place."""
    up, low = np.triu_indices(size)
    limbs = [f"l{k}" for k in range(LIMBS)]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + size + len(up), dtype=object)
        for batch in batches:
            for at in range(0, len(batch), 4096):
                z = integers(batch.column(0).slice(at, 4096))
                total[0] += len(z)
                total[1: size + 1] += z.sum(axis=0)
                total[size + 1:] += _products(z)[up, low]
        if total[0]:
            parts = []
            for k in range(LIMBS):
                parts.append(pa.array([int(x) for x in (total if k == LIMBS - 1 else total & (2**LIMB - 1))], pa.int64()))
                total = total >> LIMB
            yield pa.record_batch([pa.array(np.arange(len(total))), *parts], names=["place", *limbs])

    found = rows.select("v").mapInArrow(partial, "place bigint, " + ", ".join(f"{x} bigint" for x in limbs))
    found = found.groupBy("place").agg(*[F.sum(x).alias(x) for x in limbs]).collect()
    total = [0] * (1 + size + len(up))
    for r in found:
        total[r.place] = sum(r[x] << LIMB * k for k, x in enumerate(limbs))
    products = [[0] * size for _ in range(size)]
    for i, j, x in zip(up.tolist(), low.tolist(), total[size + 1:], strict=True):
        products[i][j] = products[j][i] = x
    return total[0], total[1: size + 1], products


def primes_below(top: int, wanted: int) -> list[int]:
    """The largest `wanted` primes below `top`, at most 2 ** 31, by sieving windows from the top down."""
    small = np.ones(1 << 16, dtype=bool)
    small[:2] = False
    for p in range(2, 256):
        if small[p]:
            small[p * p:: p] = False
    small = np.flatnonzero(small)
    found: list[int] = []
    while len(found) < wanted:
        low = top - (1 << 16)
        open_ = np.ones(1 << 16, dtype=bool)
        for p in small.tolist():
            open_[-low % p:: p] = False
        found += [low + int(x) for x in np.flatnonzero(open_)[::-1]]
        top = low
    return found[:wanted]


def polynomial_mod(matrix: np.ndarray, p: int) -> np.ndarray:
    """Characteristic polynomial det(tI - matrix) modulo a prime under 2 ** 31, lowest coefficient first.

    The matrix is brought to Hessenberg form by similar row and column steps, then the
    polynomials of its leading blocks follow from each other.
    """
    h = matrix.copy() % p
    size = len(h)
    for m in range(1, size - 1):
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        at = m + int(below[0])
        if at != m:
            h[[m, at]] = h[[at, m]]
            h[:, [m, at]] = h[:, [at, m]]
        if m + 1 < size:
            u = h[m + 1:, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
            h[m + 1:] = (h[m + 1:] - u[:, None] * h[m] % p) % p
            # Sums of products of 31 bits are taken apart, so that they stay below 2 ** 63.
            cols = h[:, m + 1:]
            low, high = u & 0xFFFF, u >> 16
            h[:, m] = (h[:, m] + cols @ low % p + (cols @ high % p << 16)) % p
    polys = np.zeros((size + 1, size + 1), dtype=np.int64)
    polys[0, 0] = 1
    for m in range(size):
        under, factors = 1, [int(h[m, m])]
        for k in range(m - 1, -1, -1):
            under = under * int(h[k + 1, k]) % p
            factors.append(under * int(h[k, m]) % p)
        less = (polys[: m + 1] * np.array(factors[::-1])[:, None] % p).sum(axis=0)
        polys[m + 1] = (np.roll(polys[m], 1) - less) % p
    return polys[size]


def characteristic(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Coefficients of det(tI - matrix), lowest first, for a symmetric matrix without negative roots.

    The k-th elementary function of the roots is at most comb(d, k) * (trace / d) ** k, which bounds
    the coefficients and so the number of primes. One prime more checks the result.
    """
    size = len(matrix)
    trace = sum(matrix[i][i] for i in range(size))
    bound = max(comb(size, k) * -(-trace**k // size**k) for k in range(size + 1))
    primes = primes_below(1 << 31, (2 * bound).bit_length() // 30 + 2)
    # Entries go to the tasks as 30-bit limbs, which any prime can put together again.
    parts, sign = -(-max(1, trace).bit_length() // 30), np.array([[1 if x >= 0 else -1 for x in row] for row in matrix])
    limbs = np.array([[[abs(x) >> 30 * k & (1 << 30) - 1 for x in row] for row in matrix] for k in range(parts)], dtype=np.int64)

    def residues(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for p in batch.column(0).to_pylist():
                m = np.zeros_like(limbs[0])
                for k in range(parts - 1, -1, -1):
                    m = ((m << 30) % p + limbs[k]) % p
                got.append(polynomial_mod(m * sign % p, p).tolist())
            yield pa.record_batch([batch.column(0), pa.array(got, pa.list_(pa.int64()))], names=["p", "c"])

    todo = spark.createDataFrame([(p,) for p in primes], "p bigint").repartition(-(-len(primes) // PRIMES_PER_TASK))
    found = sorted(tuple(r) for r in todo.mapInArrow(residues, "p bigint, c array<bigint>").collect())
    (check, checked), *found = found
    whole, coefficients = 1, [0] * (size + 1)
    for p, c in found:
        back = pow(whole, -1, p)
        coefficients = [x + whole * ((y - x) * back % p) for x, y in zip(coefficients, c, strict=True)]
        whole *= p
    coefficients = [x - whole if 2 * x > whole else x for x in coefficients]
    if any((x - y) % check for x, y in zip(coefficients, checked, strict=True)):
        raise ArithmeticError("the residues of the characteristic polynomial do not agree")
    return coefficients


def roots_above(coefficients: list[int], at: int, bits: int) -> int:
    """Roots greater than at / 2 ** bits, repeated ones as often: exact, as all roots are real.

    The signs of the polynomial shifted to that point change once for each of them.
    """
    size = len(coefficients) - 1
    c = [x << bits * (size - k) for k, x in enumerate(coefficients)]
    for i in range(size):
        for k in range(size - 1, i - 1, -1):
            c[k] += at * c[k + 1]
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def _positive(coefficients: list[int], at: int, bits: int) -> bool:
    value, scale = 0, 0
    for x in reversed(coefficients):
        value = value * at + (x << scale)
        scale += bits
    return value > 0


def top_roots(coefficients: list[int], wanted: int) -> tuple[list[int], int]:
    """The largest positive roots in falling order, as floors of roots * 2 ** bits, and bits.

    Each is bisected by counts until it is alone in its interval, then by the sign of the polynomial.
    Roots that do not part within all bits are repeated ones.
    """
    zero = next(k for k, x in enumerate(coefficients) if x)
    c = coefficients[zero:]
    wanted = min(wanted, len(c) - 1)
    if not wanted:
        return [], 0
    top = -c[-2] + 1  # above the sum of the roots, of which none is negative
    # Wide enough for the smallest possible wanted root beside the largest.
    bits = max(0, ROOT_BITS - top.bit_length() + 1)
    found: list[int] = []
    counts: dict[int, int] = {0: len(c) - 1, top << bits: 0}

    def count(at: int) -> int:
        if at not in counts:
            counts[at] = roots_above(c, at, bits)
        return counts[at]

    for k in range(1, wanted + 1):  # the k-th root: the largest point with at least k roots above it
        low = max(x for x, n in counts.items() if n >= k)
        high = min(x for x, n in counts.items() if n < k)
        while high - low > 1 and not (count(low) == k and count(high) == k - 1):
            middle = (low + high) // 2
            if count(middle) >= k:
                low = middle
            else:
                high = middle
        if high - low > 1:
            # Above an even number of roots the polynomial is positive.
            above = (k - 1) % 2 == 0
            while high - low > 1:
                middle = (low + high) // 2
                if _positive(c, middle, bits) == above:
                    high = middle
                else:
                    low = middle
        found.append(low)
    return found, bits


def null_vectors(matrix: list[list[int]], roots: list[int], bits: int) -> np.ndarray:
    """Unit eigenvectors (in columns) of the roots, by inverse iteration refined with residuals in integers.

    Vectors are kept as integers over 2 ** FINE. Each refinement solves for what the exact residual
    asks to take off, so the result is as near as doubles can tell, however near the next root is.
    """
    size = len(matrix)
    trace = sum(matrix[i][i] for i in range(size))
    exact = np.array(matrix, dtype=object)
    scaled = np.array([[x / trace for x in row] for row in matrix])
    found: list[np.ndarray] = []
    rng = np.random.default_rng(17)

    def fixed(x: np.ndarray) -> np.ndarray:
        return np.array([int(c * 2.0**FINE) for c in x.tolist()], dtype=object)

    def unit(v: np.ndarray) -> np.ndarray:
        for w in found:
            v = v - (w * int(w @ v) >> 2 * FINE)
        length = isqrt(int(v @ v))
        return np.array([(int(x) << FINE) // length for x in v], dtype=object)

    def doubles(v: np.ndarray) -> np.ndarray:
        return np.array([int(x) / (1 << FINE) for x in v])

    for root in roots:
        at = root / (trace << bits)
        shifted = scaled - np.eye(size) * at
        v = unit(fixed(rng.uniform(-1, 1, size)))
        for _ in range(3):
            solved = np.linalg.solve(shifted - np.eye(size) * NUDGE, doubles(v))
            v = unit(fixed(solved / np.abs(solved).max()))
        for _ in range(30):
            r = ((exact @ v) << bits) - root * v
            r = np.array([int(x) / (trace << bits + FINE) for x in r])
            # The least solution leaves out the space of the root itself, where the residual says nothing.
            move = np.linalg.lstsq(shifted, r, rcond=NUDGE)[0]
            v = unit(v - fixed(move))
            if np.abs(move).max() < 2.0**-60:
                break
        found.append(v)
    if not found:
        return np.zeros((size, 0))
    out = np.stack([doubles(v) for v in found], axis=1)
    return out * np.where(out[np.abs(out).argmax(axis=0), np.arange(len(found))] < 0, -1.0, 1.0)


def whiten(table: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, deviation_text), a row per vector and component."""
    spark = table.sparkSession
    rows, size = sound_vectors(table, vec_id, vector)
    if size > MAX_SIZE:
        raise ValueError(f"vectors have {size} dimensions, more than {MAX_SIZE}")
    n, sums, products = scatter(rows, size)
    matrix = [[n * products[i][j] - sums[i] * sums[j] for j in range(size)] for i in range(size)]
    trace = sum(matrix[i][i] for i in range(size))
    roots, bits = top_roots(characteristic(spark, matrix), components) if trace else ([], 0)
    axes = null_vectors(matrix, roots, bits) if roots else np.zeros((size, 0))
    axes = axes / np.sqrt(np.array([r / (n * n << bits) for r in roots]))
    big_sums = np.array(sums, dtype=object)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                z = integers(part.column(1))
                most = n * (int(np.abs(z).max()) + 1) + max(map(abs, sums))
                wide = most * most * size >= 1 << 63
                y = z.astype(object) * n - big_sums if wide else z * n - big_sums.astype(np.int64)
                far = (y * y).sum(axis=1)
                w = (y / n).astype(np.float64) @ axes
                fits = [int(x) if x < 1 << 63 else None for x in far]
                yield pa.record_batch([
                    part.column(0), pa.array(fits, pa.int64()),
                    pa.array([None if f is not None else str(x) for f, x in zip(fits, far, strict=True)], pa.string()),
                    pa.array(w.tolist(), pa.list_(pa.float64())),
                ], names=["vec_id", "deviation", "deviation_text", "w"])

    id_type = rows.schema["vec_id"].dataType.simpleString()
    wide = stage(rows.mapInArrow(project, f"vec_id {id_type}, deviation bigint, deviation_text string, w array<double>"), "whitened")
    error = _identity_error(wide, len(roots))
    explained = F.array(*[F.lit(r / (trace << bits)) for r in roots]).cast("array<double>")
    return wide.select("*", F.posexplode("w").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"), "deviation_text",
    )


def _identity_error(wide: DataFrame, k: int) -> float:
    """Largest entry of the covariance of column w less the identity: means first, then centred products."""
    if not k:
        return 0.0
    mean = wide.agg(*[F.avg(F.get("w", F.lit(i))).alias(f"m{i}") for i in range(k)]).first()
    off = [F.get("w", F.lit(i)) - mean[i] for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    cov = wide.agg(*[F.avg(off[i] * off[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(c - (i == j)) for c, (i, j) in zip(cov, pairs, strict=True))


def op13_exact_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
