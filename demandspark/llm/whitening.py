"""Whitening of embeddings from exact integers.

Entries become integers, so the scatter of the distinct vectors is an integer matrix, summed exactly. Its characteristic
polynomial is computed modulo many primes, one Spark row per prime, and put together by Chinese remaindering; the real
roots are isolated in integers, and each gives its component by inverse iteration in 90 digits, one Spark row per root
(``charpoly``). The driver holds nothing that grows with the rows: a matrix of the dimension and the polynomial.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from math import gcd, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandspark.llm import charpoly
from demandspark.llm.common import materialize

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
LIMIT = 1 << 62  # integers beyond saturate
LIMB = 21
PART = 40
BLOCK = 2048


def _keys(y: np.ndarray) -> list[bytes]:
    """Each vector of integers as bytes: the width of an entry, then its entries in the least width that holds them all."""
    largest = np.maximum(y.max(axis=1), -1 - y.min(axis=1)) if y.size else np.zeros(len(y), np.int64)
    keys = [b""] * len(y)
    for width, low, high in ((2, -1, 1 << 15), (4, 1 << 15, 1 << 31), (8, 1 << 31, None)):
        rows = np.flatnonzero((largest >= low) & (largest < high)) if high else np.flatnonzero(largest >= low)
        for i, row in zip(rows.tolist(), y[rows].astype(f"<i{width}"), strict=True):
            keys[i] = bytes([width]) + row.tobytes()
    return keys


def _vectors(keys: pa.Array) -> np.ndarray:
    held = keys.to_pylist()
    return np.array([np.frombuffer(k, f"<i{k[0]}", offset=1).astype(np.int64) for k in held]).reshape(len(held), -1)


def integer_vectors(embeddings: DataFrame, dimension: int) -> DataFrame:
    """vec_id and key: the vector of floor(64 c), packed, for rows of ``dimension`` finite entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            long_enough = pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), dimension), False)
            batch = batch.filter(long_enough)
            entries = pc.cast(batch.column(1).flatten(), pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dimension)
            finite = np.isfinite(entries).all(axis=1)
            with np.errstate(over="ignore"):
                y = np.floor(SCALE * entries[finite])
            y = np.where(np.abs(y) < LIMIT, y, 0).astype(np.int64) + np.where(y >= LIMIT, LIMIT, 0) - np.where(y <= -LIMIT, LIMIT, 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(finite)), pa.array(_keys(y), pa.binary())], names=["vec_id", "key"])

    return embeddings.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "vec_id long, key binary")


def _limbs(y: np.ndarray) -> list[np.ndarray]:
    """Signed pieces of 21 bits whose weighted sum is ``y``; only as many as its largest entry needs."""
    pieces, half = [], 1 << (LIMB - 1)
    while True:
        piece = ((y + half) & ((1 << LIMB) - 1)) - half
        pieces.append(piece.astype(np.float64))
        y = (y - piece) >> LIMB
        if not y.any():
            return pieces


def _parts(value: int) -> list[int]:
    """Signed pieces of 40 bits, so that sums over all tasks stay within a long."""
    sign, value, pieces = (-1 if value < 0 else 1), abs(value), []
    while value:
        pieces.append(sign * (value & ((1 << PART) - 1)))
        value >>= PART
    return pieces


def products(distinct: DataFrame) -> dict[tuple[int, int], int]:
    """Sums over the vectors of the products of entries i <= j, with a last entry of 1: also the sums and the count.

    Blocks of 2048 rows are multiplied as floats of 21 bits, exact below 2^53; all beyond is integer.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                y = _vectors(batch.column(0).slice(at, BLOCK))
                limbs = _limbs(np.concatenate([y, np.ones((len(y), 1), np.int64)], axis=1))
                for a, left in enumerate(limbs):
                    for b, right in enumerate(limbs):
                        part = (left.T @ right).astype(np.int64).astype(object) << LIMB * (a + b)
                        total = part if total is None else total + part
        if total is not None:
            rows = [(i, j, k, v) for i in range(len(total)) for j in range(i, len(total)) for k, v in enumerate(_parts(int(total[i, j])))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=list("ijkv"))

    sums = distinct.mapInArrow(run, "i int, j int, k int, v long").groupBy("i", "j", "k").agg(F.sum("v").alias("v"))
    found: dict[tuple[int, int], int] = {}
    for i, j, k, v in sums.collect():  # bounded by the square of the dimension
        found[i, j] = found.get((i, j), 0) + (v << PART * k)
    return found


def _polynomial(spark: SparkSession, matrix: list[list[int]], trace: int) -> list[int]:
    found = charpoly.primes(2 * charpoly.coefficient_bound(trace, len(matrix)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column(0).to_pylist():
                residues = charpoly.polynomial_mod((np.array(matrix, dtype=object) % p).astype(np.int64), p)
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([residues.tolist()], pa.list_(pa.int64()))], names=["p", "residues"])

    tasks = min(len(found), 4 * spark.sparkContext.defaultParallelism)
    rows = spark.createDataFrame([(p,) for p in found], "p long").repartition(tasks).mapInArrow(run, "p long, residues array<long>")
    return charpoly.remaindered((r["p"], r["residues"]) for r in rows.collect())  # bounded by the dimension


def _null_spaces(spark: SparkSession, matrix: list[list[int]], roots: list[tuple[int, int, int]]) -> list[np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in batch.column(0).to_pylist():
                space = charpoly.null_space(matrix, *roots[at])
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([space.tolist()], pa.list_(pa.list_(pa.float64())))], names=["at", "space"])

    rows = spark.createDataFrame([(k,) for k in range(len(roots))], "at int").repartition(len(roots))
    found = rows.mapInArrow(run, "at int, space array<array<double>>").collect()  # bounded by the dimension
    return [np.array(r["space"]) for r in sorted(found, key=lambda r: r["at"])]


@dataclass
class Whitening:
    """Count and sums of the fit list (of floor(64 c)), the eigenvalues of its covariance, and their components as rows."""

    n: int
    sums: list[int]
    eigenvalues: list[Fraction]
    trace: Fraction
    components: np.ndarray

    def centred(self, y: np.ndarray) -> np.ndarray:
        """n times each vector minus the sums, exactly; Python integers only where a long could overflow."""
        most = int(np.abs(y).max(initial=0)) * self.n + max(map(abs, self.sums), default=0)
        if most < 1 << 62:
            return y * self.n - np.array(self.sums, np.int64)
        return y.astype(object) * self.n - np.array(self.sums, dtype=object)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        scale = np.array([self.n * sqrt(e) for e in self.eigenvalues])
        return centred.astype(np.float64) @ self.components.T / scale

    def deviations(self, centred: np.ndarray) -> list[int | None]:
        """Sums of squares; null where one passes the range of a long."""
        if centred.dtype != object and int(np.abs(centred).max(initial=0)) ** 2 * centred.shape[1] < 1 << 63:
            return (centred * centred).sum(axis=1).tolist()
        found = (centred.astype(object) ** 2).sum(axis=1).tolist()
        return [v if v < 1 << 63 else None for v in found]


def fit(distinct: DataFrame, dimension: int, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors (key); None if they are all one, or none."""
    found = products(distinct)
    n = found.get((dimension, dimension), 0)
    if n < 2:
        return None
    sums = [found.get((i, dimension), 0) for i in range(dimension)]
    scatter = [[n * found.get((min(i, j), max(i, j)), 0) - sums[i] * sums[j] for j in range(dimension)] for i in range(dimension)]
    common = gcd(*(x for row in scatter for x in row)) or 1
    matrix = [[x // common for x in row] for row in scatter]
    trace = sum(matrix[i][i] for i in range(dimension))
    spark = distinct.sparkSession
    poly = _polynomial(spark, matrix, trace)
    roots = charpoly.largest_roots(poly, trace, components)
    values = [Fraction(root * common, n * n << bits) for root, bits, multiplicity in roots for _ in range(multiplicity)]
    spaces = _null_spaces(spark, matrix, roots) if roots else []
    vectors = np.concatenate(spaces) if spaces else np.empty((0, dimension))
    return Whitening(n, sums, values[:components], Fraction(trace * common, n * n), vectors[:components])


def _matrix_sums(distinct: DataFrame, per_block) -> np.ndarray:
    """Sum of ``per_block``'s arrays, which have the size of the components, over all vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(per_block(_vectors(b.column(0).slice(at, BLOCK))) for b in batches for at in range(0, b.num_rows, BLOCK))
        flat = np.asarray(total, np.float64).ravel().tolist()
        if flat != [0.0]:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat, pa.float64())], names=["at", "v"])

    found = distinct.mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(max((r["at"] for r in found), default=-1) + 1)
    for r in found:
        out[r["at"]] = r["v"]
    return out


def identity_error(distinct: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity; means are taken off first."""
    size = len(model.components)
    if not size:
        return 0.0
    plain = lambda y: model.whitened(model.centred(y))
    sums = _matrix_sums(distinct, lambda y: np.append(plain(y).sum(axis=0), 0.0))
    means = sums[:size] / model.n

    def squares(y: np.ndarray) -> np.ndarray:
        own = plain(y) - means
        return np.append((own.T @ own).ravel(), 0.0)

    covariance = _matrix_sums(distinct, squares)[:-1].reshape(size, size) / model.n
    return float(np.abs(covariance - np.eye(size)).max())


def apply(vectors: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, deviation, whitened (one entry a component) of every row of ``vectors`` (vec_id, key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                centred = model.centred(_vectors(part.column(1)))
                whitened = pa.array(model.whitened(centred).tolist(), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.deviations(centred), pa.int64()), whitened], names=["vec_id", "deviation", "whitened"])

    return vectors.mapInArrow(run, "vec_id long, deviation long, whitened array<double>")


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error per remaining row and component.

    Rows whose vector is null or holds a null or non-finite entry are dropped, and so are vectors of another length than
    the most frequent one (of equally frequent ones the longest). Repeated vectors count once in the fit, each row is
    returned; null and repeated vec_ids are kept. Entries whose integer passes 2^62 saturate there. Components with an
    eigenvalue of zero can't be whitened and are left out, so there are no rows if all vectors are equal or none is left.
    Equal eigenvalues get any orthonormal components of their space. A deviation beyond a long is null. Other columns are ignored.
    """
    lengths = embeddings.select(F.size("embedding").alias("length")).filter("length > 0").groupBy("length").count()
    top = lengths.orderBy(F.col("count").desc(), F.col("length").desc()).first()
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = embeddings.sparkSession
    if top is None:
        return spark.createDataFrame([], schema)
    vectors = materialize(integer_vectors(embeddings, top["length"]), "integer-vectors")
    distinct = materialize(vectors.select("key").distinct(), "distinct-vectors")
    model = fit(distinct, top["length"], components)
    if model is None or not len(model.components):
        return spark.createDataFrame([], schema)
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues])
    rows = apply(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(identity_error(distinct, model)).alias("identity_error"),
    )
