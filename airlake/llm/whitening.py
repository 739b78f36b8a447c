"""Embedding whitening: leading principal components of integer vectors, found on the driver from a distributed covariance."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlake.llm.common import Scratch
from airlake.llm.vectors import integers, parcel, schema, summed, usable

#: Added to every component; what is computed does not depend on it.
OFFSET = 100_000
BLOCK = 2048
EPS = float(np.finfo(np.float64).eps)


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray | None]]:
    """Householder: (diagonal, off-diagonal, reflectors) of a symmetric matrix; reflector k acts on the rows after k."""
    a, n, mirrors = matrix.copy(), len(matrix), []
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        size = np.sqrt(x @ x)
        if size == 0:
            mirrors.append(None)
            continue
        head = -math.copysign(size, x[0])
        x[0] -= head
        x /= np.sqrt(x @ x)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ x
        p -= (x @ p) * x
        rest -= 2 * (np.outer(x, p) + np.outer(p, x))
        a[k + 1, k] = head
        mirrors.append(x)
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def below(diagonal: np.ndarray, off: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Sturm counts: how many eigenvalues lie below each shift."""
    least = np.finfo(np.float64).tiny / EPS + EPS * EPS * float(np.abs(diagonal).max(initial=0.0) + np.abs(off).max(initial=0.0))
    q, count = np.ones(len(shifts)), np.zeros(len(shifts), np.int64)
    for d, e in zip(diagonal, [0.0, *off], strict=True):
        q = d - shifts - e * e / q
        q = np.where(np.abs(q) < least, -least, q)
        count += q < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, each by bisection until no double lies between its bounds."""
    n = len(diagonal)
    around = np.zeros(n)
    around[:-1] += np.abs(off)
    around[1:] += np.abs(off)
    low = np.full(k, (diagonal - around).min())
    high = np.full(k, (diagonal + around).max())
    index = n - 1 - np.arange(k)
    for _ in range(200):
        mid = low + (high - low) / 2
        if ((mid <= low) | (mid >= high)).all():
            break
        over = below(diagonal, off, mid) > index
        low, high = np.where(over, low, mid), np.where(over, mid, high)
    return low + (high - low) / 2


def _solve(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, least: float) -> np.ndarray:
    """(T - shift) z = right by elimination with row exchanges; pivots under ``least`` count as it."""
    n = len(diagonal)
    a, b, c, r = (diagonal - shift).tolist(), [*off.tolist(), 0.0], [0.0] * n, right.tolist()
    for i in range(n - 1):
        down = float(off[i])
        if abs(a[i]) < abs(down):
            m = a[i] / down
            a[i], b[i], c[i], a[i + 1], b[i + 1] = down, a[i + 1], b[i + 1], b[i] - m * a[i + 1], -m * b[i + 1]
            r[i], r[i + 1] = r[i + 1], r[i] - m * r[i + 1]
        else:
            a[i] = a[i] if abs(a[i]) >= least else math.copysign(least, a[i])
            m = down / a[i]
            a[i + 1] -= m * b[i]
            r[i + 1] -= m * r[i]
    z = [0.0] * n
    for i in range(n - 1, -1, -1):
        pivot = a[i] if abs(a[i]) >= least else math.copysign(least, a[i])
        z[i] = (r[i] - (b[i] * z[i + 1] if i + 1 < n else 0.0) - (c[i] * z[i + 2] if i + 2 < n else 0.0)) / pivot
    return np.array(z)


def leading_components(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(falling eigenvalues, unit eigenvectors as rows) of a symmetric matrix, k of them.

    Inverse iteration gives the tridiagonal form's vectors. Values nearer than a thousandth of its norm form a cluster, whose vectors are made orthogonal to each
    other in every step; reflectors lead back to the matrix, whose Rayleigh quotients are the values.
    """
    scale = float(np.abs(matrix).max(initial=0.0)) or 1.0
    matrix = matrix / scale
    diagonal, off, mirrors = tridiagonal(matrix)
    values = leading_values(diagonal, off, k)
    norm = float(np.abs(diagonal).max() + 2 * np.abs(off).max(initial=0.0)) or 1.0
    vectors: list[np.ndarray] = []
    cluster = 0
    for j, value in enumerate(values):
        if j and values[j - 1] - value > 1e-3 * norm:
            cluster = j
        z = np.random.default_rng(j).standard_normal(len(diagonal))
        for _ in range(6):
            z = _solve(diagonal, off, float(value), z / np.abs(z).max(), EPS * norm)
            z /= np.abs(z).max()
            for _ in range(2):
                for other in vectors[cluster:j]:
                    z -= (other @ z) * other
            z /= np.sqrt(z @ z)
        vectors.append(z)
    found = np.array(vectors)
    for n, mirror in reversed(list(enumerate(mirrors))):
        if mirror is not None:
            found[:, n + 1 :] -= 2 * np.outer(found[:, n + 1 :] @ mirror, mirror)
    found /= np.sqrt((found * found).sum(1))[:, None]
    values = np.einsum("ij,jk,ik->i", found, matrix, found)
    order = np.argsort(-values, kind="stable")
    return values[order] * scale, found[order]


def whiten(vectors: DataFrame, components: int = 8) -> DataFrame:
    """One row per kept vector and leading component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, or holds null or non-finite components, are dropped. A component c becomes x = floor(1024 c) + 100000, with |c| above 2**52
    counted as 2**52; shorter vectors end in zeros, up to the longest length. n counts the kept vectors. deviation is the sum of (n x - S)**2 over the dimensions, S being their sums, exact, or null
    where it is beyond a long. Components are numbered from 1 by falling variance, ``components`` at most and no more than
    dimensions; those without variance (a single vector, equal vectors) have a null whitened and leave identity_error, 0 if none is left.
    explained is the variance's share of the trace, 0 if that is 0. Repeated rows and rows with a null vec_id count each; an empty table, or empty
    vectors alone, give an empty result.

    Sums are exact, so what is left after the mean is: n x - S is an integer, of which only the quotient by n is rounded. Tasks add up the products of
    centred rows; the driver holds one matrix of dimensions by dimensions, whatever the number of rows, and sends the components back. The whitened
    rows' covariance is measured in a pass of its own; their mean is 0, as the centred integers add up to 0.
    """
    scratch = Scratch(vectors.sparkSession)
    kept = scratch.keep(usable(vectors).select("vec_id", "embedding"))
    kind = kept.schema["vec_id"].dataType.simpleString()
    out = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    n, width = kept.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    if not n or not width:
        return vectors.sparkSession.createDataFrame([], out)

    def sums(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                x = integers(batch.column("embedding"), width)
                # halves of a long each, so that no sum leaves it
                high, low = (x >> 31).sum(0).tolist(), (x & (2**31 - 1)).sum(0).tolist()
                part = [(h << 31) + s + OFFSET * len(x) for h, s in zip(high, low, strict=True)]
                total = part if total is None else [a + b for a, b in zip(total, part, strict=True)]
        if total:
            yield parcel([()], [total], [], pa.decimal128(38, 0))

    s = [int(v) for v in summed(kept.select("embedding").mapInArrow(sums, schema([], "decimal(38,0)")), [], width)[()]]
    reach = max(abs(v) for v in s)

    def centred(column):
        """(n x - S as integers, x - S/n as doubles) of blocks of a batch."""
        x = integers(column, width)
        for k in range(0, len(x), BLOCK):
            part = x[k : k + BLOCK] + OFFSET
            if n * int(np.abs(part).max()) + reach < 2**62:
                exact = n * part - np.array(s, np.int64)
            else:
                exact = n * part.astype(object) - np.array(s, object)
            yield exact, (exact / n).astype(np.float64)

    def products(batches):
        total = None
        for batch in batches:
            for _, d in centred(batch.column("embedding")):
                total = d.T @ d if total is None else total + d.T @ d
        if total is not None:
            yield parcel([(i,) for i in range(width)], total.tolist(), ["row"], pa.float64())

    rows = summed(kept.select("embedding").mapInArrow(products, schema(["row"], "double")), ["row"], width)
    covariance = np.array([rows[(i,)] for i in range(width)]) / n
    covariance = (covariance + covariance.T) / 2
    k, trace = min(components, width), float(np.trace(covariance))
    values, axes = leading_components(covariance, k)
    alive = values > 4 * width * EPS * max(trace, 0.0)
    project = (axes / np.sqrt(np.where(alive, values, 1.0))[:, None]).T

    def spread(batches):
        total = np.zeros((k, k))
        for batch in batches:
            for _, d in centred(batch.column("embedding")):
                w = d @ project
                total += w.T @ w
        yield parcel([(i,) for i in range(k)], total.tolist(), ["row"], pa.float64())

    found = summed(kept.select("embedding").mapInArrow(spread, schema(["row"], "double")), ["row"], k)
    off = np.abs(np.array([found[(i,)] for i in range(k)]) / n - np.eye(k))[alive][:, alive]

    def score(batches):
        for batch in batches:
            white, deviation = [], []
            for exact, d in centred(batch.column("embedding")):
                white.append(d @ project)
                wide = exact if width * int(np.abs(exact).max()) ** 2 < 2**63 else exact.astype(object)
                deviation += [v if v < 2**63 else None for v in (wide * wide).sum(1).tolist()]
            flat = pa.array(np.concatenate(white).ravel() if white else [], pa.float64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, k), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(deviation, pa.int64()), lists], ["vec_id", "deviation", "w"])

    scored = kept.mapInArrow(score, f"vec_id {kind}, deviation bigint, w array<double>")

    def listed(numbers) -> Column:
        return F.get(F.array(*[F.lit(v) for v in numbers]), F.col("at"))

    return scored.select("vec_id", "deviation", F.posexplode("w").alias("at", "w")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        F.when(listed([bool(a) for a in alive]), F.col("w")).alias("whitened"),
        listed([float(max(v, 0.0)) / trace if trace > 0 else 0.0 for v in values]).alias("explained"),
        F.lit(float(off.max(initial=0.0))).alias("identity_error"),
    )
