"""Embedding whitening by a tall-skinny QR (TSQR), without a covariance matrix.

Each entry c of a vector becomes the whole number floor(64 * c) + 1000000. The fit list is each distinct
vector of these once. Its rows are centred with exact sums, each partition keeps the triangular factor of
its own rows' QR, factors merge in a tree, and the last one's singular values and right vectors give the
eigenvalues and components of the covariance, which is never formed.

Vectors that are null or hold a null, a NaN or an infinite entry take no part. The fit needs vectors of one
length: the one that most vectors have (of equal numbers the larger); others, empty ones too, get no
rows. Repeated rows are kept, and weigh once in the fit. Entries beyond 2 ** 52 in size count as 2 ** 52.
Directions without variance (to double precision) are no components, so a table of one distinct vector
gives no rows, as does an empty one. Components are turned so that their largest entry is positive. Columns
other than vec_id and embedding are not read.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from .common import cut, on_workers

SCALE, SHIFT, LIMIT = 64, 1_000_000, 2**52
COMPONENTS = 16
#: Triangular factors that one task merges; rows that are factored at once.
FAN_IN, BLOCK = 8, 4096


@dataclasses.dataclass(frozen=True)
class Whitening:
    """n distinct vectors with sums (whole numbers), unit components as rows, their eigenvalues, the covariance's trace."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def base(self) -> np.ndarray:
        """Whole numbers near the means, so that differences stay small."""
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)

    def off(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exactly: 64-bit numbers, or Python's where these could overflow."""
        base, n = self.base, self.n
        rest = np.array([s - n * int(b) for s, b in zip(self.sums, base)], object)
        near = x - base
        most = int(np.abs(near).max(initial=0))
        if n * (most + 1) < 2**62:
            return near * n - rest.astype(np.int64)
        return near.astype(object) * n - rest

    def white(self, x: np.ndarray) -> np.ndarray:
        return (self.off(x) / self.n).astype(np.float64) @ self.components.T / np.sqrt(self.eigenvalues)


def _finite(embedding: str = "embedding"):
    bad = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    return F.col(embedding).isNotNull() & ~F.exists(F.col(embedding).cast("array<double>"), bad)


def whole(vectors: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(SCALE * vectors.astype(np.float64)), -LIMIT, LIMIT).astype(np.int64) + SHIFT


def _matrix(col: pa.Array, d: int) -> np.ndarray:
    """Lists of d numbers each as rows."""
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _packed(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    """Each distinct vector of a batch once, as bytes: equal ones do not travel together."""
    for b in batches:
        x = np.unique(whole(_matrix(b.column("embedding"), d)), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary())], ["x"])


def _unpacked(b: pa.RecordBatch, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(b.column("x").to_pylist()), np.int64).reshape(-1, d)


def _sums(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    """(dim, n, total) of a partition; the totals of high and low halves cannot overflow."""
    n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
    for b in batches:
        x = _unpacked(b, d)
        n, high, low = n + len(x), high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0)
    yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(high), pa.array(low)], ["dim", "n", "high", "low"])


def _triangle(rows: np.ndarray, d: int) -> np.ndarray:
    return np.linalg.qr(rows, mode="r") if len(rows) else np.zeros((0, d))


def _factored(batches: Iterator[pa.RecordBatch], fit: Whitening, d: int) -> Iterator[pa.RecordBatch]:
    """The triangular factor of a partition's centred rows, at most d rows of them held beside a block."""
    r = np.zeros((0, d))
    for b in batches:
        x = (fit.off(_unpacked(b, d)) / fit.n).astype(np.float64)
        for at in range(0, len(x), BLOCK):
            r = _triangle(np.vstack([r, x[at : at + BLOCK]]), d)
    yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], ["r"])


def _merged(table: pa.Table, d: int) -> pa.Table:
    rows = [np.frombuffer(r, np.float64).reshape(-1, d) for r in table.column("r").to_pylist()]
    return pa.table({"node": table.column("node")[:1], "r": pa.array([_triangle(np.vstack(rows), d).tobytes()], pa.binary())})


def _last_factor(factors: DataFrame, d: int) -> np.ndarray:
    """The triangular factor of all rows: FAN_IN factors a task, level by level, until one is left."""
    factors = cut(factors.select(F.spark_partition_id().cast("long").alias("node"), "r"))
    left = (factors.agg(F.max("node")).first()[0] or 0) + 1
    while left > 1:
        up = factors.withColumn("node", F.expr(f"node div {FAN_IN}"))
        factors, left = cut(up.groupBy("node").applyInArrow(lambda t: _merged(t, d), "node long, r binary")), -(-left // FAN_IN)
    last = factors.first()
    return np.frombuffer(last["r"], np.float64).reshape(-1, d) if last else np.zeros((0, d))


def _moments(batches: Iterator[pa.RecordBatch], fit: Whitening, d: int) -> Iterator[pa.RecordBatch]:
    """Sums of products of a partition's whitened rows; the rows were centred before."""
    k = len(fit.eigenvalues)
    total = np.zeros((k, k))
    for b in batches:
        w = fit.white(_unpacked(b, d))
        total += w.T @ w
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(total.ravel())], ["cell", "total"])


def vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, embedding) of the vectors that take part, and their length."""
    good = df.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding")).where(_finite())
    lengths = good.where(F.size("embedding") > 0).groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = lengths["d"] if lengths else 0
    return good.where(F.size("embedding") == d), d


def fit(good: DataFrame, d: int, most: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors; null without any."""
    on_workers(good.sparkSession)
    rows = good.select("embedding").mapInArrow(lambda b: _packed(b, d), "x binary").where("x is not null")
    distinct = cut(rows.distinct())
    wide = DecimalType(38, 0)
    total = (F.sum(F.col("high").cast(wide)) * F.lit(2**32) + F.sum(F.col("low").cast(wide))).cast("string")
    sums = distinct.mapInArrow(lambda b: _sums(b, d), "dim int, n long, high long, low long").groupBy("dim").agg(F.sum("n").alias("n"), total.alias("total")).orderBy("dim").collect()
    n = sums[0]["n"] if sums else 0
    if not n:
        return None
    centre = Whitening(n, tuple(int(r["total"]) for r in sums), np.zeros((0, d)), np.zeros(0), 0.0)
    r = _last_factor(distinct.mapInArrow(lambda b: _factored(b, centre, d), "r binary"), d)
    _, sigma, right = np.linalg.svd(r, full_matrices=False)
    trace = float((sigma**2).sum() / n)
    kept = sigma > sigma.max(initial=0) * max(n, d) * np.finfo(float).eps
    sigma, right = sigma[kept][:most], right[kept][:most]
    largest = np.take_along_axis(right, np.abs(right).argmax(1)[:, None], 1) if len(right) else np.ones((0, 1))
    out = dataclasses.replace(centre, components=right * np.sign(largest), eigenvalues=sigma**2 / n, trace=trace)
    k = len(sigma)
    if not k:
        return out
    cells = distinct.mapInArrow(lambda b: _moments(b, out, d), "cell long, total double").groupBy("cell").agg(F.sum("total").alias("total")).collect()
    covariance = np.zeros(k * k)
    for c in cells:
        covariance[c["cell"]] = c["total"] / n
    return dataclasses.replace(out, identity_error=float(np.abs(covariance.reshape(k, k) - np.eye(k)).max()))


def _deviation(off: np.ndarray) -> list[int]:
    """Sums of squares of whole numbers, exact at any size."""
    most = int(np.abs(off).max(initial=0))
    if most**2 * off.shape[1] < 2**63:
        off = off.astype(np.int64)
        return (off * off).sum(1).tolist()
    return [sum(int(v) ** 2 for v in row) for row in off]


def _whitened(batches: Iterator[pa.RecordBatch], of: Whitening, d: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = whole(_matrix(b.column("embedding"), d))
        deviation = pa.array([str(v) for v in _deviation(of.off(x))], pa.string())
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), deviation, pa.array(list(of.white(x)), pa.list_(pa.float64()))], ["vec_id", "deviation", "whitened"])


def whiten(good: DataFrame, d: int, of: Whitening) -> DataFrame:
    """(vec_id, deviation decimal(38, 0), whitened array<double>), a row for each vector: its exact squared distance from
    the sums (n * x - sums), and its coordinates. by_component gives it as a long; beyond that is an error."""
    on_workers(good.sparkSession)
    kind = good.schema["vec_id"].dataType.simpleString()
    out = good.mapInArrow(lambda b: _whitened(b, of, d), f"vec_id {kind}, deviation string, whitened array<double>")
    return out.withColumn("deviation", F.col("deviation").cast(DecimalType(38, 0)))


def by_component(df: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component."""
    good, d = vectors(df)
    of = fit(good, d, most) if d else None
    if of is None or not len(of.eigenvalues):
        return df.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    explained = F.array(*[F.lit(float(e / of.trace)) for e in of.eigenvalues])
    rows = whiten(good, d, of).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(F.col("vec_id").cast("long"), (F.col("at") + 1).alias("component"), F.lit(of.n).cast("long").alias("n"), F.col("deviation").cast("long").alias("deviation"), "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(of.identity_error).alias("identity_error"))
