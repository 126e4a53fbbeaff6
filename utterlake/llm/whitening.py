"""Embedding whitening by a bidiagonal qd solver.

Vectors become integers x = floor(scale * c) + offset, so that sums and
deviations from the mean are exact. Each task folds its centred rows into one
triangular factor by blockwise QR; factors meet by 64 in a tree until one is
left, of dims x dims numbers whatever the number of rows. Its Householder
bidiagonalisation B has the singular values of the centred rows; dqds finds
them to high relative accuracy from the squares of B's entries, and twisted
factorisations of B'B - s, one for each component, give its vectors.
Whitened rows are projections over the root of the variance.

No row moves between tasks, so hot keys and copies cost nothing extra; the
driver meets one triangular factor and sums by dimension.

Defined cases: rows whose vector is null, of another size than the most
frequent one (ties: the smaller), or holds null or non-finite entries take no
part; zero vectors do; rows without an id and rows that repeat an id stay;
repeated rows all count; entries beyond 2**62 / scale count as that;
components whose variance is zero to rounding are left out, so equal rows give
no rows, nor does an empty table; other columns are left out, so their names
never clash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ann import matrix

EPS = float(np.finfo(float).eps)
#: Factors that meet in one task.
FAN_IN = 64
LIMIT = 1 << 62


def finite(v: Column) -> Column:
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(v.isNotNull() & sound, F.lit(False))


def integers(batch: pa.Array, scale: int, offset: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = np.floor(matrix(batch) * scale)
    return np.clip(x, -LIMIT, LIMIT).astype(np.int64) + offset


def exact_sums(x: np.ndarray) -> list[int]:
    if len(x) and int(np.abs(x).max()) * len(x) >= LIMIT:
        return x.astype(object).sum(0).tolist()
    return x.sum(0).tolist()


def from_mean(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exactly: 64-bit integers where they hold it, else Python's."""
    top = max(int(np.abs(x).max()) * n, max(abs(s) for s in sums)) if x.size else 0
    if top < LIMIT:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def squared_length(z: np.ndarray) -> list[int]:
    """Exact sums of squares of the rows: halves of 26 bits where entries have at most 52."""
    if z.dtype == object or (z.size and int(np.abs(z).max()) >= 1 << 52) or z.shape[1] > 1 << 9:
        return (z.astype(object) ** 2).sum(1).tolist()
    hi, lo = z >> 26, z & ((1 << 26) - 1)
    a, b, c = (hi * hi).sum(1).tolist(), (hi * lo).sum(1).tolist(), (lo * lo).sum(1).tolist()
    return [(p << 52) + (q << 27) + r for p, q, r in zip(a, b, c, strict=True)]


def triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal and superdiagonal of U'RV, and the right reflectors, in order; the k-th acts on entries from k + 1 on."""
    a, right = np.array(r, float), []
    d = len(a)

    def reflector(v: np.ndarray) -> np.ndarray:
        """w of I - w w' that takes v to a multiple of the first unit vector."""
        top = np.abs(v).max(initial=0.0)
        if top == 0.0:
            return np.zeros_like(v)
        w = v / top
        w[0] += math.copysign(np.linalg.norm(w), w[0])
        return w * (math.sqrt(2.0) / np.linalg.norm(w))

    for k in range(d):
        w = reflector(a[k:, k])
        a[k:, k:] -= np.outer(w, w @ a[k:, k:])
        if k < d - 1:
            w = reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= np.outer(a[k:, k + 1 :] @ w, w)
            right.append(w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float] | None:
    """One differential qd step with a shift; None if it is larger than the least eigenvalue. With the least d."""
    d = q[0] - shift
    low, qs, es = d, [], []
    for after, off in zip(q[1:], e, strict=True):
        if d < 0:
            return None
        new = d + off
        if new == 0.0:
            es.append(0.0)
            d = after - shift
        else:
            t = after / new
            es.append(off * t)
            d = d * t - shift
        qs.append(new)
        low = min(low, d)
    return None if d < 0 else ([*qs, d], es, low)


def dqds(q: list[float], e: list[float]) -> list[float]:
    """Squared singular values, falling, of the bidiagonal matrix whose squared diagonal is q and squared superdiagonal e."""
    small, found, blocks = (100 * EPS) ** 2, [], [(list(q), list(e), 0.0)]
    while blocks:
        q, e, moved = blocks.pop()
        if len(q) > 1 and 1.5 * q[0] < q[-1]:  # small ones last
            q, e = q[::-1], e[::-1]
        low, rounds = 0.0, 0
        while q:
            m = len(q)
            parted = next((k for k in range(m - 2, -1, -1) if e[k] <= small * (moved + min(q[k], q[k + 1]))), None)
            if m == 1 or parted == m - 2:
                found.append(moved + q[-1])
                q, e, rounds = q[:-1], e[:-1] if m > 1 else [], 0
                continue
            if parted is not None:
                blocks.append((q[: parted + 1], e[:parted], moved))
                q, e, low = q[parted + 1 :], e[parted + 1 :], 0.0
                continue
            ratio = e[-1] / q[-2] if q[-2] > 0 else 1.0
            shift = low * (1 - math.sqrt(ratio)) ** 2 if ratio < 0.0625 else low / 4
            for shift in (shift, shift / 8, 0.0):
                if done := sweep(q, e, shift):
                    break
            q, e, low = done
            moved += shift
            rounds += 1
            if rounds > 200 + 10 * m:
                raise ArithmeticError("dqds does not converge")
    return sorted(found, reverse=True)


def twisted(a: np.ndarray, b: np.ndarray, s: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Twisted factorisations of B'B - s for B of diagonal a and superdiagonal b: multipliers from the top and from the bottom, and the twists."""
    d = len(a)
    q, e, ab = a * a, b * b, a[:-1] * b
    tiny = EPS * EPS * max(float(q.max(initial=0.0)), float(e.max(initial=0.0)), s, 1e-300)
    top, bottom, stationary, progressive = np.zeros(d), np.zeros(d), np.empty(d), np.empty(d)
    stationary[0] = -s
    for k in range(d - 1):
        pivot = stationary[k] + q[k] or tiny
        top[k] = ab[k] / pivot
        stationary[k + 1] = stationary[k] * (e[k] / pivot) - s
    progressive[-1] = q[-1] - s
    for k in range(d - 2, -1, -1):
        pivot = e[k] + progressive[k + 1] or tiny
        bottom[k] = ab[k] / pivot
        progressive[k] = progressive[k + 1] * (q[k] / pivot) - s
    return top, bottom, stationary + progressive + s


def untwist(top: np.ndarray, bottom: np.ndarray, r: int) -> np.ndarray:
    """The unit vector that the factorisation twisted at r gives."""
    z = np.zeros(len(top))
    z[r] = 1.0
    with np.errstate(all="ignore"):
        for k in range(r - 1, -1, -1):
            z[k] = -top[k] * z[k + 1]
        for k in range(r, len(z) - 1):
            z[k + 1] = -bottom[k] * z[k]
        z = z / np.abs(z).max()
        return z / np.linalg.norm(z)


def directions(a: np.ndarray, b: np.ndarray, squares: list[float]) -> np.ndarray:
    """A right singular vector of B for each squared singular value, as columns.

    Values that lie close together share their factorisations' smallest twist,
    so each vector is made orthogonal to the earlier ones, and the next twist
    is tried where little is left of it or where it does not solve.
    """
    d, found = len(a), []
    scale = max(squares[0], 1e-300)

    def times(z: np.ndarray) -> np.ndarray:
        y = a * z
        y[:-1] += b * z[1:]
        out = a * y
        out[1:] += b * y[:-1]
        return out

    for s in squares:
        best = None
        for tried in range(3):
            top, bottom, twist = twisted(a, b, s * (1 + tried * 4 * EPS))
            for r in np.argsort(np.abs(twist), kind="stable")[: d if tried == 2 else 4]:
                z = untwist(top, bottom, int(r))
                if not np.isfinite(z).all():
                    continue
                for _ in range(2):
                    for other in found:
                        z = z - other * (other @ z)
                    left = float(np.linalg.norm(z))
                    if left < 1e-6:
                        break
                    z = z / left
                if left < 1e-6:
                    continue
                error = float(np.linalg.norm(times(z) - s * z))
                if best is None or error < best[0]:
                    best = (error, z)
                if error <= 64 * EPS * d * scale:
                    break
            if best and best[0] <= 64 * EPS * d * scale:
                break
        if best is None:
            raise ArithmeticError("no direction found")
        found.append(best[1])
    return np.stack(found, axis=1)


def principal(r: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of R'R, falling, at most `count` of them and none that is zero to rounding, and their unit vectors as columns."""
    d = r.shape[1]
    scale = float(np.abs(r).max(initial=0.0))
    if scale == 0.0:
        return np.zeros(0), np.zeros((d, 0))
    a, b, right = bidiagonalise(r / scale)
    squares = dqds((a * a).tolist(), (b * b).tolist())
    squares = [s for s in squares[:count] if s > squares[0] * (d * EPS) ** 2]
    z = directions(a, b, squares)
    for k in range(len(right) - 1, -1, -1):
        w = right[k]
        z[k + 1 :] -= np.outer(w, w @ z[k + 1 :])
    return np.array(squares) * scale * scale, z


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: list[int]  # by dimension, exact
    variances: np.ndarray  # of the components, falling
    total: float  # trace of the covariance
    components: np.ndarray  # dims x components

    def whitened(self, away: np.ndarray) -> np.ndarray:
        """away: n * x - sums."""
        return (away.astype(float) / self.n) @ self.components / np.sqrt(self.variances)


def sound_vectors(table: DataFrame, key: str, vector: str) -> DataFrame | None:
    """key and v of the rows that take part."""
    sound = table.select(F.col(key).alias("key"), F.col(vector).alias("v")).where(finite(F.col("v")) & (F.size("v") > 0))
    sizes = sound.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    return None if sizes is None else sound.where(F.size("v") == sizes["d"])


def fit(vectors: DataFrame, components: int, scale: int, offset: int) -> Whitening:
    """vectors: key, v. Two passes: exact sums, then triangular factors."""

    def add(batches):
        n, sums = 0, None
        for batch in batches:
            if len(batch):
                part = exact_sums(integers(batch.column(0), scale, offset))
                n, sums = n + len(batch), part if sums is None else [p + q for p, q in zip(sums, part, strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(sums)), pa.int32()), pa.array([Decimal(n), *map(Decimal, sums)], pa.decimal128(38, 0))], ["dim", "s"])

    parts = vectors.select("v").mapInArrow(add, "dim int, s decimal(38,0)")
    n, *sums = (int(r["s"]) for r in parts.groupBy("dim").agg(F.sum("s").alias("s")).orderBy("dim").collect())  # a number for each dimension
    dims = len(sums)

    def factor(batches):
        r = np.zeros((0, dims))
        for batch in batches:
            for i in range(0, len(batch), 4096):
                block = from_mean(integers(batch.column(0).slice(i, 4096), scale, offset), n, sums).astype(float) / n
                r = triangle(np.vstack([r, block]))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], ["block", "r"])

    def meet(group: pa.Table) -> pa.Table:
        r = np.zeros((0, dims))
        for one in group.sort_by("block")["r"]:
            r = triangle(np.vstack([r, np.frombuffer(one.as_py()).reshape(-1, dims)]))
        return pa.table({"block": pa.array([group["block"][0].as_py() // FAN_IN], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())})

    factors, width = vectors.select("v").mapInArrow(factor, "block long, r binary"), vectors.rdd.getNumPartitions()
    while width > 1:
        factors, width = factors.groupBy(F.expr(f"block div {FAN_IN}")).applyInArrow(meet, "block long, r binary"), math.ceil(width / FAN_IN)
    r = triangle(np.vstack([np.zeros((dims, dims)), *[np.frombuffer(x["r"]).reshape(-1, dims) for x in factors.select("r").collect()]]))  # one factor
    squares, vectors_ = principal(r, components)
    return Whitening(n, sums, squares / n, float((r * r).sum()) / n, vectors_)


def identity_error(vectors: DataFrame, model: Whitening, scale: int, offset: int) -> float:
    """Largest absolute entry of the whitened rows' covariance less the identity, over all rows."""
    k = len(model.variances)

    def add(batches):
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if len(batch):
                w = model.whitened(from_mean(integers(batch.column(0), scale, offset), model.n, model.sums))
                first, second = first + w.sum(0), second + w.T @ w
        i, j = np.divmod(np.arange(k * k), k)
        cells = [np.concatenate([np.full(k, -1), i]).astype(np.int32), np.concatenate([np.arange(k), j]).astype(np.int32), np.concatenate([first, second.ravel()])]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], ["i", "j", "s"])

    cells = vectors.select("v").mapInArrow(add, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()  # components squared
    mean, second = np.zeros(k), np.zeros((k, k))
    for c in cells:
        if c["i"] < 0:
            mean[c["j"]] = c["s"] / model.n
        else:
            second[c["i"], c["j"]] = c["s"] / model.n
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())


def whiten(table: DataFrame, components: int = 8, key: str = "vec_id", vector: str = "embedding", scale: int = 1024, offset: int = 100_000) -> DataFrame:
    """key, component (from 1, by falling variance), n, deviation (sum of (n * x - S)^2, exact; null beyond 38 digits), whitened, explained and identity_error: a row for each row that takes part and component."""
    kind = dict(table.dtypes)[key]
    schema = f"`{key}` {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    vectors = sound_vectors(table, key, vector)
    model = fit(vectors, components, scale, offset) if vectors is not None else None
    if model is None or not len(model.variances):
        return table.sparkSession.createDataFrame([], schema)
    error, k = identity_error(vectors, model, scale, offset), len(model.variances)
    share, most = model.variances / model.total, 10**38

    def project(batches):
        for batch in batches:
            for i in range(0, len(batch), 2048):
                one = batch.slice(i, 2048)
                away = from_mean(integers(one.column(1), scale, offset), model.n, model.sums)
                m = len(one)
                lengths = pa.array([Decimal(s) if s < most else None for s in squared_length(away)], pa.decimal128(38, 0))
                each = pa.array(np.repeat(np.arange(m), k))
                columns = [
                    one.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n, np.int64)), lengths.take(each), pa.array(model.whitened(away).ravel()),
                    pa.array(np.tile(share, m)), pa.array(np.full(m * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.select("key", "v").mapInArrow(project, schema)


def op12_whitening(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return whiten(table).select("vec_id", "component", "n", F.col("deviation").try_cast("long").alias("deviation"), "whitened", "explained", "identity_error")
