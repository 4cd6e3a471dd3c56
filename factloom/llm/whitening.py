"""Embedding whitening by a bit-sliced scatter matrix.

Entries become integers, ``floor(scale * c) + offset``. The fit list holds each distinct integer vector once. In blocks of
rows every dimension, shifted by its least value, is cut into bit planes; a plane's bits are packed across rows into 64-bit words.
The cross-product of two dimensions is the sum over pairs of their planes of 2**(k + l) times the popcount of the planes' AND: exact at
any number of rows, with one pass over the fit list. The products are added up exactly in Spark, centred as integers
(n * C - S * S'), divided once, and go to ``eigh`` on the driver: a matrix of dimensions by dimensions, whatever the number of rows.

Rows whose vector is null, or holds null, NaN or infinite entries, are dropped, and so are rows of another length
than the most common one (of equally common ones the longest). Repeated rows stay, each with its result; copies count once in the fit.
Other columns of the table, of whatever name, are not read. Components without variance (under 1e-12 of the
largest eigenvalue: fewer distinct vectors than dimensions, constant dimensions) cannot be scaled to variance one and are left
out, so a table of one distinct vector, like an empty one, gives an empty result. A deviation beyond 64 bits is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

BLOCK_ROWS, LEAST_SHARE = 8192, 1e-12


def integers(vec: Column, scale: int, offset: int) -> Column:
    """The vector as longs; null where it is null or holds entries that are null or not finite."""
    sound = F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return F.when(sound, F.transform(vec, lambda c: F.floor(c.cast("double") * scale) + F.lit(offset).cast("long")))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, width)


def exact_sums(x: np.ndarray) -> list[int]:
    """Column sums beyond 64 bits: upper and lower halves are added apart."""
    return [(int(h) << 32) + int(low) for h, low in zip((x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0), strict=True)]


def _moments(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    n, sums, least, most = 0, [0] * width, None, None
    for b in batches:
        if b.num_rows:
            x = matrix(b.column("x"), width)
            n += len(x)
            sums = [a + s for a, s in zip(sums, exact_sums(x), strict=True)]
            least = x.min(axis=0) if least is None else np.minimum(least, x.min(axis=0))
            most = x.max(axis=0) if most is None else np.maximum(most, x.max(axis=0))
    if n:
        columns = [pa.array(range(width), pa.int32()), pa.array([n] * width, pa.int64()), pa.array(map(Decimal, sums), pa.decimal128(38, 0)), pa.array(least), pa.array(most)]
        yield pa.RecordBatch.from_arrays(columns, names=["i", "n", "s", "least", "most"])


def bit_planes(x: np.ndarray, bits: list[int]) -> np.ndarray:
    """Planes by words: bit k of dimension i for 64 rows a word, dimensions in order, low bits first. ``x`` is unsigned."""
    rows = -(-len(x) // 64) * 64
    planes = np.zeros((sum(bits), rows // 64), np.uint64)
    at = 0
    for i, b in enumerate(bits):
        for k in range(b):
            one = np.zeros(rows, bool)
            one[: len(x)] = (x[:, i] >> np.uint64(k)) & np.uint64(1)
            planes[at] = np.packbits(one, bitorder="little").view(np.uint64)
            at += 1
    return planes


def plane_products(planes: np.ndarray) -> np.ndarray:
    """Popcounts of the ANDs of all pairs of planes (the upper triangle)."""
    out = np.zeros((len(planes), len(planes)), np.int64)
    for q, plane in enumerate(planes):
        out[q, q:] = np.bitwise_count(planes[q:] & plane).sum(axis=1, dtype=np.int64)
    return out


def weighted(counts: np.ndarray, bits: list[int]) -> list[list[int]]:
    """Cross-products of dimensions out of the popcounts of their planes: Python's integers, so of any size."""
    both = counts + np.triu(counts, 1).T
    first = np.concatenate([[0], np.cumsum(bits)])
    out = [[0] * len(bits) for _ in bits]
    for i, b in enumerate(bits):
        for j in range(i, len(bits)):
            part = both[first[i] : first[i + 1], first[j] : first[j + 1]]
            out[i][j] = sum(int(part[k, m]) << (k + m) for k in range(b) for m in range(bits[j]))
    return out


def _scatter(batches: Iterator[pa.RecordBatch], shift: list[int], bits: list[int]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((sum(bits), sum(bits)), np.int64)
    least = np.array(shift, np.int64)
    for b in batches:
        x = matrix(b.column("x"), len(bits))
        for at in range(0, len(x), BLOCK_ROWS):
            shifted = x[at : at + BLOCK_ROWS].view(np.uint64) - least.view(np.uint64)  # right modulo 2**64, so at any range of longs
            counts += plane_products(bit_planes(shifted, bits))
    if counts.any():
        products = weighted(counts, bits)
        i, j = np.triu_indices(len(bits))
        values = [products[a][b] for a, b in zip(i, j, strict=True)]
        halves = [pa.array([Decimal(v >> 64) for v in values], pa.decimal128(38, 0)), pa.array([Decimal(v & (1 << 64) - 1) for v in values], pa.decimal128(38, 0))]
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *halves], names=["i", "j", "hi", "lo"])


class Whitening:
    """What is fitted: n, the sums S, unit components (columns, by falling eigenvalue), eigenvalues and the trace."""

    def __init__(self, n: int, sums: list[int], covariance: np.ndarray, components: int):
        value, vector = np.linalg.eigh(covariance)
        order = np.argsort(value)[::-1][:components]
        order = order[value[order] > LEAST_SHARE * max(value.max(), 0.0)]
        self.n, self.sums, self.trace = n, sums, float(np.trace(covariance))
        self.values, self.vectors = value[order], vector[:, order]

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, bool]:
        """n * x - S: longs where they fit, Python's integers where not."""
        most = max((abs(int(v)) for v in (x.min(initial=0), x.max(initial=0))), default=0)
        small = self.n * most + max(map(abs, self.sums)) < 1 << 62
        if small:
            return x * self.n - np.array(self.sums, np.int64), True
        return x.astype(object) * self.n - np.array(self.sums, object), False

    def project(self, centred: np.ndarray) -> np.ndarray:
        return (centred / self.n).astype(np.float64) @ self.vectors / np.sqrt(self.values)


def deviations(centred: np.ndarray, longs: bool) -> list[int | None]:
    """Sums of squares of each row, exact; null beyond 64 bits."""
    if longs and len(centred) and float(np.abs(centred).max()) ** 2 * centred.shape[1] < 2**62:
        return (centred * centred).sum(axis=1).tolist()
    found = [sum(int(v) ** 2 for v in row) for row in centred]
    return [v if v < 1 << 63 else None for v in found]


def _whitened_moments(batches: Iterator[pa.RecordBatch], fitted: Whitening) -> Iterator[pa.RecordBatch]:
    k = len(fitted.values)
    total = np.zeros((k, k + 1))
    for b in batches:
        z = fitted.project(fitted.centred(matrix(b.column("x"), len(fitted.sums)))[0])
        total += np.column_stack([z.T @ z, z.sum(axis=0)])
    i, j = np.indices(total.shape)
    yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], names=["i", "j", "t"])


def _project(batches: Iterator[pa.RecordBatch], fitted: Whitening, error: float) -> Iterator[pa.RecordBatch]:
    k = len(fitted.values)
    explained = fitted.values / fitted.trace
    for b in batches:
        centred, longs = fitted.centred(matrix(b.column("x"), len(fitted.sums)))
        rows, count = pa.array(np.repeat(np.arange(b.num_rows), k)), b.num_rows
        columns = [
            b.column("vec_id").take(rows), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), count)), pa.array(np.full(count * k, fitted.n)),
            pa.array(deviations(centred, longs), pa.int64()).take(rows), pa.array(fitted.project(centred).ravel()), pa.array(np.tile(explained, count)), pa.array(np.full(count * k, error)),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])


def fit(fit_list: DataFrame, width: int, components: int = 16) -> Whitening | None:
    """The whitening of a table of distinct integer vectors ``x``, all of ``width`` entries; None for an empty one."""
    schema = "i int, n long, s decimal(38,0), least long, most long"
    moments = fit_list.mapInArrow(partial(_moments, width=width), schema).groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("least").alias("least"), F.max("most").alias("most"))
    found = sorted(moments.collect())  # a row a dimension
    if not found:
        return None
    n, sums, shift = found[0]["n"], [int(r["s"]) for r in found], [r["least"] for r in found]
    bits = [(r["most"] - r["least"]).bit_length() for r in found]
    products = fit_list.mapInArrow(partial(_scatter, shift=shift, bits=bits), "i int, j int, hi decimal(38,0), lo decimal(38,0)").groupBy("i", "j").agg(F.sum("hi").alias("hi"), F.sum("lo").alias("lo"))
    covariance = np.zeros((width, width))
    shifted = [s - n * least for s, least in zip(sums, shift, strict=True)]
    for r in products.collect():  # a row a pair of dimensions
        i, j = r["i"], r["j"]
        covariance[i, j] = covariance[j, i] = (n * ((int(r["hi"]) << 64) + int(r["lo"])) - shifted[i] * shifted[j]) / (n * n)
    return Whitening(n, sums, covariance, components)


def whiten(
    vectors: DataFrame, components: int = 16, scale: int = 64, offset: int = 1_000_000, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """A row per sound row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("vec_id"), integers(F.col(vec_col), scale, offset).alias("x")).filter("x IS NOT NULL")
    kind = rows.schema["vec_id"].dataType
    schema = T.StructType([
        T.StructField("vec_id", kind), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()),
        T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType()),
    ])
    widths = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).limit(1).collect()
    width = widths[0]["width"] if widths else 0
    fitted = None
    if width:
        rows = rows.filter(F.size("x") == width)
        fit_list = written(rows.select("x").distinct(), "fit-list")
        fitted = fit(fit_list, width, components)
    if fitted is None or not len(fitted.values):
        return spark.createDataFrame([], schema)
    sums = fit_list.mapInArrow(partial(_whitened_moments, fitted=fitted), "i int, j int, t double").groupBy("i", "j").agg(F.sum("t").alias("t"))
    k = len(fitted.values)
    total = np.zeros((k, k + 1))
    for r in sums.collect():  # at most 16 by 17
        total[r["i"], r["j"]] = r["t"] / fitted.n
    error = float(np.abs(total[:, :k] - np.outer(total[:, k], total[:, k]) - np.eye(k)).max())
    return rows.mapInArrow(partial(_project, fitted=fitted, error=error), schema)
