"""Whitening of embeddings by a covariance that counts equal vectors once and weighs them.

Entries become whole numbers, so equal vectors are equal exactly and sums are exact. Rows with equal vectors are grouped;
a group's number of rows (or one, on request) is its weight in the fit. The covariance adds up `w * c c'` over the groups
as a matrix product per Arrow batch, where `c = (n x - S) / n` is centred in whole numbers first. Its eigenvectors give
the projection; each distinct vector is projected once and the result joined back to its rows.

Scale: rows are combined on the map side by vector, so a vector held by a third of all rows is one row per task; what
travels back is joined on a 128-bit digest, and AQE splits a hot one. Per task a triangle of `d * d` sums leaves the
matrix product, added up by Spark; the driver gets `d` sums and `d * (d + 1) / 2` products, whatever the number of rows.

Cases: rows whose vector is null, empty or holds null or non-finite entries go; where lengths differ, the most frequent
one (of equal ones the greater) is fitted and the other rows go; null and repeated `vec_id`s stay rows of their own;
components without variance (up to rounding) are not returned, so equal vectors alone, or no vectors, give no rows;
entries beyond 2**40 / 64 are held there; a deviation that no long holds is null; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage

SCALE, SHIFT, MOST = 64, 1_000_000, 32
#: Larger numbers are held there, so that sums of longs and doubles stay exact enough.
LIMIT = 1 << 40
#: An eigenvalue below this share of the largest is rounding.
RANK = 1e-10
ROW = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Whitening:
    """n rows with sums `total` per dimension; `project` has a column per component, already divided by the root of its
    eigenvalue; `explained` is each component's share of the variance."""

    n: int
    total: tuple[int, ...]
    project: np.ndarray
    explained: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """`n x - S`, exact: whole numbers of 64 bits where they fit, else of any size."""
        highest = self.n * max(int(np.abs(x).max(initial=0)), 1) + max(map(abs, self.total), default=0)
        wide = np.int64 if highest < 1 << 62 else object
        return x.astype(wide) * self.n - np.array(self.total, wide)

    def whiten(self, centred: np.ndarray) -> np.ndarray:
        return (centred / self.n).astype(np.float64) @ self.project


def whole_numbers(vector: Column) -> Column:
    """Entries as longs, null for a vector that cannot be used."""
    def number(entry: Column) -> Column:
        high = F.lit(float(LIMIT))
        return F.floor(F.greatest(F.least(entry.cast("double") * SCALE, high), -high)) + SHIFT

    def fits(entry: Column) -> Column:
        value = entry.cast("double")
        return F.coalesce(~F.isnan(value) & (F.abs(value) < float("inf")), F.lit(False))
    return F.when((F.size(vector) > 0) & F.forall(vector, fits), F.transform(vector, number))


def prepared(vectors: DataFrame) -> DataFrame:
    """(vec_id, x, same) of the rows that stay; `same` names x by 128 bits. Written once."""
    rows = cut_lineage(vectors.select("vec_id", whole_numbers(F.col("embedding")).alias("x")).filter("x is not null"))
    lengths = rows.groupBy(F.size("x").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).limit(1).collect()
    length = lengths[0].length if lengths else 0
    same = F.struct(F.xxhash64("x").alias("a"), F.xxhash64(F.lit(1), "x").alias("b"))
    return rows.filter(F.size("x") == length).withColumn("same", same)


def distinct(rows: DataFrame) -> DataFrame:
    """(same, x, rows): each vector once with the number of rows that have it. Written once."""
    return cut_lineage(rows.groupBy("same", "x").agg(F.count("*").alias("rows")))


def _products(centre, weighted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                found = centre(_matrix(batch))
                weights = batch.column("rows").to_numpy().astype(np.float64) if weighted else np.ones(len(found))
                held = np.column_stack([found, np.ones(len(found))])  # the last column gives the sums
                more = held.T @ (held * weights[:, None])
                total = more if total is None else total + more
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "product"])
    return run


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)


def covariance(vectors: DataFrame, centre, weighted: bool = True) -> np.ndarray:
    """The covariance of `centre(x)` over (x, rows), which is centred already up to rounding; its own mean is taken off."""
    sums = vectors.mapInArrow(_products(centre, weighted), "i int, j int, product double").groupBy("i", "j").agg(F.sum("product").alias("product")).collect()
    size = max((row.j for row in sums), default=0)
    held = np.zeros((size + 1, size + 1))
    for row in sums:
        held[row.i, row.j] = held[row.j, row.i] = row["product"]
    n = held[size, size] or 1.0
    mean = held[size, :size] / n
    return held[:size, :size] / n - np.outer(mean, mean)


def fit(vectors: DataFrame, most: int = MOST, weighted: bool = True) -> Whitening | None:
    """The whitening of (x, rows); None without vectors. `weighted` false counts each distinct vector once."""
    weight = F.col("rows") if weighted else F.lit(1).cast("long")
    sums = (vectors.select(weight.alias("weight"), F.posexplode("x").alias("at", "entry")).groupBy("at")
            .agg(F.sum(F.col("entry").cast("decimal(20,0)") * F.col("weight")).alias("total"), F.sum("weight").alias("n")).orderBy("at").collect())
    if not sums:
        return None
    plain = Whitening(int(sums[0].n), tuple(int(row.total) for row in sums), np.empty((0, 0)), np.empty(0))
    found = covariance(vectors, lambda x: (plain.centred(x) / plain.n).astype(np.float64), weighted)
    values, axes = np.linalg.eigh(found)
    order = [at for at in np.argsort(values)[::-1] if values[at] > RANK * max(values.max(), 0.0)][:most]
    return Whitening(plain.n, plain.total, axes[:, order] / np.sqrt(values[order]), values[order] / np.trace(found))


def _whitened(model: Whitening):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            centred = model.centred(_matrix(batch))
            found = np.ascontiguousarray(model.whiten(centred))
            squares = centred.astype(object) ** 2 if np.abs(centred).max() > 1 << 28 else centred ** 2
            sums = squares.sum(axis=1)
            deviation = pa.array([int(v) if v < 1 << 63 else None for v in sums.tolist()], pa.int64())
            ends = np.arange(0, found.size + 1, max(found.shape[1], 1), dtype=np.int32)[:batch.num_rows + 1]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), deviation, pa.ListArray.from_arrays(pa.array(ends), pa.array(found.ravel()))],
                                             ["a", "b", "deviation", "whitened"])
    return run


def whiten(vectors: DataFrame, most: int = MOST, weighted: bool = True) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row per row that stays and component."""
    spark = vectors.sparkSession
    rows = prepared(vectors)
    each = distinct(rows)
    model = fit(each, most, weighted)
    if model is None or not len(model.explained):
        return spark.createDataFrame([], ROW)
    check = covariance(each, lambda x: model.whiten(model.centred(x)), weighted)
    error = float(np.abs(check - np.eye(len(check))).max())
    done = cut_lineage(each.select("same.a", "same.b", "x").mapInArrow(_whitened(model), "a long, b long, deviation long, whitened array<double>"))
    joined = rows.select("vec_id", "same.a", "same.b").join(done, ["a", "b"])
    every = joined.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.element_at(F.array([F.lit(float(share)) for share in model.explained]), F.col("at") + 1)
    return every.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                        explained.alias("explained"), F.lit(error).alias("identity_error"))
