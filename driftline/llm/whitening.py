"""Whitening of embeddings by an exact covariance: integer products in float64 by slices of their digits.

Vectors become whole numbers. Their sums over all rows are exact, and so are the sums of products: centred numbers are split into limbs of
20 bits, and a block of 4096 rows multiplies limb matrices with BLAS in float64, where no sum reaches 2^53. The products are put
together as whole numbers of any size, split into digits that a plain sum over tasks can add up, and merged by Spark. Rounding happens
once, when the exact covariance becomes the matrix whose eigenvectors are taken.

Centring comes before multiplying: first by the whole part of the mean of each dimension, which keeps limbs few, and then exactly by its
fraction, as the sum of (x - S/n)(x' - S'/n) is that of zz' less RR'/n for x = S div n + z and R = S mod n.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction
from itertools import combinations, combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import lean_batches
from .common import Scratch, batches_of

#: A vector's entry c becomes floor(SCALE * c) + SHIFT; components that are returned.
SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Rows of a block and bits of a limb: 2^12 products of two limbs below 2^20 stay below 2^53.
BLOCK, LIMB = 1 << 12, 20
#: Digits that exact sums pass between tasks in: so many of 32 bits each, the last with the sign.
DIGITS = 8
#: Entries beyond these bounds are taken as the bounds, so that differences of two fit 64 bits.
MOST = 1 << 61
#: Rounds of rotations at most; two or three do.
SWEEPS = 12
#: An eigenvalue below so much of the largest, for each dimension, is none.
NOTHING = 2.0**-96


def whole(vectors: np.ndarray, scale: int = SCALE, shift: int = SHIFT) -> np.ndarray:
    """Whole numbers of the entries."""
    return np.clip(np.floor(vectors.astype(np.float64) * scale), -MOST, MOST).astype(np.int64) + shift


def limbs(z: np.ndarray) -> list[np.ndarray]:
    """Matrices of limbs, lowest first; all but the last are not negative, and z is their sum with weights 2^(LIMB k)."""
    out = []
    while z.size and (z.max() >= 1 << (LIMB - 1) or z.min() < -(1 << (LIMB - 1))):
        out.append((z & ((1 << LIMB) - 1)).astype(np.float64))
        z = z >> LIMB
    return [*out, z.astype(np.float64)]


def gram(z: np.ndarray) -> np.ndarray:
    """The exact sum over rows of products of two entries, as whole numbers of any size."""
    total = np.zeros((z.shape[1], z.shape[1]), object)
    for at in range(0, len(z), BLOCK):
        parts = limbs(z[at : at + BLOCK])
        for i, left in enumerate(parts):
            for j, right in enumerate(parts[i:], i):
                product = (left.T @ right).astype(np.int64).astype(object) << (LIMB * (i + j))
                total += product if i == j else product + product.T
    return total


def digits(values: list[int]) -> np.ndarray:
    """Whole numbers as rows of DIGITS numbers of 32 bits, the last one signed."""
    raw = b"".join([v.to_bytes(4 * DIGITS, "little", signed=True) for v in values])
    out = np.frombuffer(raw, "<u4").reshape(-1, DIGITS).astype(np.int64)
    out[:, -1] = out[:, -1].astype(np.int32)
    return out


def undigits(sums: list[int]) -> int:
    return sum(d << (32 * k) for k, d in enumerate(sums))


_SUMS = "i int, j int, " + ", ".join(f"d{k} bigint" for k in range(DIGITS))


def exact_sums(vectors: DataFrame, cells: Callable[[np.ndarray], list[tuple[int, int, int]]]) -> dict[tuple[int, int], int]:
    """Sums over all rows of whole numbers named by two indices, of which cells tells those of a block of rows. A task sends one row a
    cell, and the driver gets one row a cell, of which there are as many as dimensions or pairs of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], int] = {}
        for block in blocks(batches):
            for i, j, value in cells(block):
                total[i, j] = total.get((i, j), 0) + value
        if total:
            rows = digits(list(total.values()))
            columns = [pa.array([k[0] for k in total], pa.int32()), pa.array([k[1] for k in total], pa.int32()), *(pa.array(rows[:, k]) for k in range(DIGITS))]
            yield pa.RecordBatch.from_arrays(columns, names=["i", "j", *(f"d{k}" for k in range(DIGITS))])

    sums = vectors.select("v").mapInArrow(lean_batches(run), _SUMS).groupBy("i", "j").agg(*[F.sum(f"d{k}").alias(f"d{k}") for k in range(DIGITS)])
    return {(r[0], r[1]): undigits(list(r[2:])) for r in sums.collect()}


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The batch's vectors as rows."""
    v = batch.column("v")
    return v.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        if batch.num_rows:
            yield matrix(batch)


@dataclass
class Fit:
    """What whitening needs of the fit list: rows, sums by dimension, eigenvalues (largest first, none that are nothing) with unit vectors
    as rows, and all that eigenvalues add up to."""

    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray
    trace: float


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows as vec_id and v, without those whose vector is null or holds null, NaN or infinite entries. Of vectors of different lengths those
    of the most frequent one stay, the longest of equally frequent ones."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    valid = rows.select("vec_id", v.alias("v")).where(F.col("v").isNotNull() & finite & (F.size("v") > 0))
    most = valid.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return valid.where(F.size("v") == (most["d"] if most else 0))


def fit(vectors: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> Fit | None:
    """The exact covariance of the whole numbers of all vectors, divisor n, and its eigenvectors; None without vectors."""

    def first(block: np.ndarray) -> list[tuple[int, int, int]]:
        x = whole(block, scale, shift)
        low, high = x & ((1 << 31) - 1), x >> 31  # so that no sum of a block overflows
        return [(-1, -1, len(x)), *((-1, d, int(a) + (int(b) << 31)) for d, (a, b) in enumerate(zip(low.sum(0), high.sum(0), strict=True)))]

    found = exact_sums(vectors, first)
    if not found:
        return None
    n = found.pop((-1, -1))
    dims = len(found)
    sums = [found[-1, d] for d in range(dims)]
    centre = np.array([s // n for s in sums], np.int64)

    def second(block: np.ndarray) -> list[tuple[int, int, int]]:
        total = gram(whole(block, scale, shift) - centre)
        return [(i, j, total[i, j]) for i, j in combinations_with_replacement(range(dims), 2)]

    products = exact_sums(vectors, second)
    rest = [s - n * int(c) for s, c in zip(sums, centre, strict=True)]
    covariance = np.empty((dims, dims), object)  # times n * n
    for (i, j), total in products.items():
        covariance[i, j] = covariance[j, i] = n * total - rest[i] * rest[j]
    values, axes = eigen(covariance, n * n)
    order = [k for k in np.argsort(-values, kind="stable") if values[k] > NOTHING * dims * max(values.max(), 0.0)]
    return Fit(n, sums, values[order], axes[order], float(Fraction(sum(covariance.diagonal()), n * n)))


def eigen(exact: np.ndarray, divisor: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and unit vectors, as rows, of a matrix of whole numbers over a divisor. The usual routine errs by a share of the largest
    eigenvalue, which can be more than a small one; so the matrix is turned by its vectors in exact numbers, and what is then left
    beside the diagonal is rotated away, which errs by a share of each."""
    scaled = lambda m, bits: np.array([[float(Fraction(int(v), divisor << bits)) for v in row] for row in m])
    _, columns = np.linalg.eigh(scaled(exact, 0))
    turn = np.array([[int(v) for v in row] for row in np.rint(columns * 2.0**52)], object)
    m, axes = scaled(turn.T.dot(exact).dot(turn), 104), columns.T.copy()
    for _ in range(SWEEPS):
        turned = False
        for p, q in combinations(range(len(m)), 2):
            if abs(m[p, q]) <= 2.0**-53 * np.sqrt(abs(m[p, p] * m[q, q])):
                continue
            turned = True
            theta = (m[q, q] - m[p, p]) / (2 * m[p, q])
            t = (1.0 if theta >= 0 else -1.0) / (abs(theta) + np.hypot(1.0, theta))
            c = 1 / np.hypot(1.0, t)
            rotation = np.array([[c, -t * c], [t * c, c]])
            m[[p, q]] = rotation @ m[[p, q]]
            m[:, [p, q]] = m[:, [p, q]] @ rotation.T
            axes[[p, q]] = rotation @ axes[[p, q]]
        if not turned:
            break
    return m.diagonal().copy(), axes / np.linalg.norm(axes, axis=1, keepdims=True)


def _deviations(z: np.ndarray, n: int, rest: list[int]) -> list[int | None]:
    """The sum over dimensions of (n * z - R)^2 of each row; None where that is no 64-bit number."""
    widest = (max(-int(z.min()), int(z.max()), 0) + 1) * n
    if widest * widest * z.shape[1] < 1 << 63:
        y = n * z - np.array(rest, np.int64)
        return (y * y).sum(1).tolist()
    y = n * z.astype(object) - np.array(rest, object)
    return [d if d < 1 << 63 else None for d in (y * y).sum(1)]


def whitened(vectors: DataFrame, held: Fit, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id, deviation and w, the values of the first components, of each vector."""
    kept = min(components, len(held.values))
    centre = np.array([s // held.n for s in held.sums], np.int64)
    rest = [s - held.n * int(c) for s, c in zip(held.sums, centre, strict=True)]
    fraction = np.array([r / held.n for r in rest])
    axes = (held.axes[:kept] / np.sqrt(held.values[:kept])[:, None]).T
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            z = whole(matrix(batch), scale, shift) - centre
            w = (z - fraction) @ axes
            limits = pa.array(np.arange(len(w) + 1) * kept, pa.int32())
            columns = [batch.column("vec_id"), pa.array(_deviations(z, held.n, rest), pa.int64()), pa.ListArray.from_arrays(limits, pa.array(w.reshape(-1)))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "deviation", "w"])

    return vectors.mapInArrow(lean_batches(run), f"vec_id {kind}, deviation bigint, w array<double>")


def query(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error: a row for each vector and component.

    Vectors that are null, or hold a null or an entry that isn't finite, give no rows, nor do those of another length than most;
    empty tables give none. A null vec_id is carried through, repeated rows count as often as they stand, other columns aren't looked
    at. Directions without variance are no components, so equal vectors give no rows, and vectors of fewer dimensions or ranks fewer
    components. A deviation beyond 64 bits is null. Entries beyond 2^61 after scaling count as that.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "whitening")
    with batches_of(spark, BLOCK):
        vectors = scratch.keep(usable(rows, vector))
        held = fit(vectors)
        if held is None or not len(held.values):
            kind = rows.schema["vec_id"].dataType.simpleString()
            return spark.createDataFrame([], f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
        out = scratch.keep(whitened(vectors, held, components))
    kept = min(components, len(held.values))
    pairs = list(combinations_with_replacement(range(kept), 2))
    centred = out.agg(*[F.covar_pop(F.col("w")[i], F.col("w")[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    error = max(abs(centred[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    explained = F.array(*[F.lit(float(e) / held.trace) for e in held.values[:kept]])
    each = out.select("vec_id", "deviation", F.posexplode("w").alias("k", "whitened"))
    return each.select(
        "vec_id", (F.col("k") + 1).alias("component"), F.lit(held.n).cast("long").alias("n"), "deviation", "whitened",
        explained[F.col("k")].alias("explained"), F.lit(float(error)).alias("identity_error"),
    )
