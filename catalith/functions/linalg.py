"""Tall-and-skinny factorisation: singular values and rank without a Gramian."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

FAN_IN = 16


def _triangle(parts: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.vstack(parts), mode="r")


def tsqr(matrix: DataFrame, column: str, width: int) -> np.ndarray:
    """R (width x width) of the rows in ``column`` (array<double> of ``width``).

    Each partition reduces its rows to one triangle, batch by batch; triangles are then
    reduced FAN_IN at a time, so a task holds FAN_IN triangles, and the driver one.
    """

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = np.zeros((0, width))
        for pdf in batches:
            if len(pdf):
                r = _triangle([r, np.array(pdf[column].tolist(), float)])
        if len(r):
            yield pd.DataFrame({"r": [r.ravel().tolist()]})

    rows = matrix.select(column).mapInPandas(local, "r array<double>")
    parts = matrix.rdd.getNumPartitions()
    while parts > FAN_IN:
        parts = -(-parts // FAN_IN)

        def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            r = np.zeros((0, width))
            for pdf in batches:
                r = _triangle([r, *(np.array(x, float).reshape(-1, width) for x in pdf.r)])
            if len(r):
                yield pd.DataFrame({"r": [r.ravel().tolist()]})

        rows = rows.repartition(parts).mapInPandas(merge, "r array<double>")
    got = [np.array(x["r"], float).reshape(-1, width) for x in rows.collect()]
    return _triangle(got) if got else np.zeros((0, width))


@dataclass(frozen=True)
class Spectrum:
    """Singular values (descending), right singular vectors (rows), means, row count, tolerance and rank of a centred matrix."""

    values: np.ndarray
    vectors: np.ndarray
    means: np.ndarray
    rows: int
    tolerance: float
    rank: int

    @property
    def condition(self) -> float:
        return float(self.values[0] / self.values[-1]) if len(self.values) and self.values[-1] > 0 else float("inf")

    @property
    def explained(self) -> np.ndarray:
        squares = self.values**2
        return squares / squares.sum() if squares.sum() > 0 else squares


def spectrum(matrix: DataFrame, column: str, width: int) -> Spectrum:
    """Centre the columns, factorise, and count singular values above max(n, p) * eps * largest.

    The matrix is written once, so that whatever makes it runs once.
    """
    matrix = written(matrix.select(column), "matrix")
    means = matrix.agg(F.count("*").alias("n"), *[F.avg(F.col(column)[i]).alias(f"m{i}") for i in range(width)]).first()
    n, mean = means["n"], [means[f"m{i}"] or 0.0 for i in range(width)]
    centred = matrix.select(F.array(*[F.col(column)[i] - mean[i] for i in range(width)]).alias(column))
    r = tsqr(centred, column, width)
    values, vectors = (np.linalg.svd(r)[1:]) if len(r) else (np.zeros(0), np.zeros((0, width)))
    tolerance = max(n, width) * np.finfo(float).eps * (values[0] if len(values) else 0.0)
    return Spectrum(values, vectors, np.array(mean), n, float(tolerance), int((values > tolerance).sum()))


def project(matrix: DataFrame, column: str, s: Spectrum, d: int, to: str = "components") -> DataFrame:
    """First ``d`` principal components of each row as expressions; signs make each vector's largest entry positive."""
    signed = [v * (1 if v[np.abs(v).argmax()] >= 0 else -1) for v in s.vectors[:d]]
    numbers = lambda v: F.array(*[F.lit(float(x)) for x in v])
    centred = F.zip_with(column, numbers(s.means), lambda x, m: x - m)
    parts = F.transform(F.array(*map(numbers, signed)), lambda v: F.aggregate(F.zip_with(centred, v, lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x))
    return matrix.withColumn(to, parts)
