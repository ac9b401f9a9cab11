"""Monte-Carlo error propagation and paired bootstrap, with hash-seeded random numbers."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.uniform import counted, counted_normals, deviate, gaussian, key_hash
from ..sources.scratch import written
from . import features as fea
from .evaluate import pr_curve, threshold_at_recall


def realisations(long: DataFrame, keys: Sequence[str], n: int, seed: str) -> DataFrame:
    """Perturbed magnitudes: ``n`` realisations of (keys, band, mag, mag_err), each mag + mag_err * normal deviate of its key."""
    d = long.withColumn("realisation", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    parts = [*[F.col(k) for k in keys], F.col("band"), F.col("realisation")]
    return d.withColumn("mag", F.col("mag") + F.col("mag_err") * gaussian(*parts, seed))


def monte_carlo_colors(long: DataFrame, keys: Sequence[str], bands: Sequence[str], n: int, seed: str) -> DataFrame:
    """name, n, mean, std of features over ``n`` realisations, each mag + mag_err * normal deviate of its keys, band and number. failed counts non-finite ones.

    A member's bands are brought into one row first; realisations are drawn there, so nothing is shuffled n times.
    """
    wide = fea.pivot(long, keys, bands).withColumn("realisation", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    own = [F.col(k) for k in keys]
    hashed = wide.select("*", *[key_hash(*own, F.lit(b), F.col("realisation"), seed).alias(f"h{i}") for i, b in enumerate(bands)])
    drawn = hashed.select(*[(F.col(f"b{i}") + F.col(f"e{i}") * deviate(F.col(f"h{i}"))).alias(f"b{i}") for i in range(len(bands))], *[f"e{i}" for i in range(len(bands))])
    f = fea.unpivoted(drawn, [], bands)
    ok = ~F.isnan("value") & (F.abs("value") != float("inf"))
    return f.groupBy("name").agg(F.count("*").alias("n"), F.avg(F.when(ok, F.col("value"))).alias("mean"), F.stddev_pop(F.when(ok, F.col("value"))).alias("std"), F.count_if(~ok).alias("failed"))


@dataclass(frozen=True)
class Measured:
    """Columns of a table of measurements: key long, magnitudes and errors (double), target 0 or 1."""

    key: str
    magnitudes: Sequence[str]
    errors: Sequence[str]
    target: str

    def select(self, df: DataFrame) -> DataFrame:
        one = lambda c, t: F.col(c).cast(t)
        return df.select(one(self.key, "long").alias("key"), one(self.target, "int").alias("target"), F.array(*[one(c, "double") for c in self.magnitudes]).alias("x"), F.array(*[one(c, "double") for c in self.errors]).alias("e"))


def _measured(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, magnitudes and errors of a batch, taken from its lists once for all realisations."""
    return pdf.key.to_numpy().astype(np.uint64), *(np.array(pdf[c].tolist(), float).reshape(len(pdf), -1) for c in "xe")


def _colors(rows: tuple[np.ndarray, np.ndarray, np.ndarray], r: int, n: int, seed: int) -> np.ndarray:
    """Differences of adjacent magnitudes of realisation ``r`` of ``n``; of the measurements themselves for -1."""
    key, x, e = rows
    if r >= 0:
        with np.errstate(over="ignore"):
            c = (key[:, None] * np.uint64(n) + np.uint64(r)) * np.uint64(x.shape[1]) + np.arange(x.shape[1], dtype=np.uint64)
        x = x + e * counted_normals(seed, c)
    with np.errstate(invalid="ignore"):
        return x[:, :-1] - x[:, 1:]


@dataclass(frozen=True)
class Discriminant:
    """The locked method: scaled distance from the other rows' mean less that from the focal rows' mean; fitted by sums alone."""

    means: np.ndarray
    variance: np.ndarray

    def score(self, c: np.ndarray) -> np.ndarray:
        d = [((c - m) ** 2 / self.variance).sum(axis=1) for m in self.means]
        return d[0] - d[1]


def _fitted(rows: DataFrame, n: int, seed: int, width: int) -> dict[int, Discriminant]:
    """The method fitted to the measurements (-1) and to each realisation. Every task brings sums for each realisation and class."""
    color = [F.col("x")[i] - F.col("x")[i + 1] for i in range(width)]
    mean = rows.agg(*[F.avg(F.when(F.abs(c) < float("inf"), c)).alias(f"m{i}") for i, c in enumerate(color)]).first()
    shift = np.array([v or 0.0 for v in mean])  # squares are summed about it, lest they cancel
    names = [f"{p}{i}" for p in "sq" for i in range(width)]

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((n + 1, 2, 1 + 2 * width))
        for pdf in batches:
            target, own_rows = pdf.target.to_numpy(), _measured(pdf)
            for r in range(-1, n) if len(pdf) else ():
                c = _colors(own_rows, r, n, seed) - shift
                sound = np.isfinite(c).all(axis=1)
                for t in (0, 1):
                    own = c[sound & (target == t)]
                    total[r + 1, t] += np.concatenate([[len(own)], own.sum(axis=0), (own * own).sum(axis=0)])
        flat = pd.DataFrame(total.reshape(2 * (n + 1), -1), columns=["n", *names])
        yield flat.assign(n=flat.n.astype("int64"), realisation=np.repeat(np.arange(-1, n), 2).astype("int32"), target=np.tile(np.array([0, 1], "int32"), n + 1))[["realisation", "target", "n", *names]]

    part = rows.mapInPandas(sums, f"realisation int, target int, n long, {', '.join(f'{c} double' for c in names)}")
    got = {(r["realisation"], r["target"]): r for r in part.groupBy("realisation", "target").agg(*[F.sum(c).alias(c) for c in ("n", *names)]).collect()}  # two rows a realisation
    out = {}
    for r in range(-1, n):
        both = [got[r, t] for t in (0, 1)] if (r, 0) in got else []
        if any(b["n"] for b in both):
            count = np.array([b["n"] for b in both], float)[:, None]
            s, q = (np.array([[b[f"{p}{i}"] for i in range(width)] for b in both]) for p in "sq")
            mean = s.sum(axis=0) / count.sum()
            variance = q.sum(axis=0) / count.sum() - mean**2
            with np.errstate(invalid="ignore", divide="ignore"):
                out[r] = Discriminant(s / count + shift, np.where(variance > 0, variance, 1.0))
    return out


def realisation_metrics(measured: DataFrame, columns: Measured, n: int, seed: int, recall: float) -> DataFrame:
    """realisation, n, failed, tp, fp, fn, precision, recall, contamination, f1 for each of ``n`` realisations of the measurements.

    Each magnitude is drawn about itself by its error; colors follow from the drawn magnitudes. The method is refitted to
    each realisation and judged at one threshold, that of ``recall`` on the measurements as they are, so nothing is
    tuned. Numbers are drawn from key, realisation and band, so nothing depends on partitioning, and where they are used: all
    realisations pass over a batch of rows, and only sums leave the task. failed counts rows whose colors or score are not finite.
    """
    rows = written(columns.select(measured), "measured")
    models = _fitted(rows, n, seed, len(columns.magnitudes) - 1)
    base = models.get(-1)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"score": base.score(_colors(_measured(pdf), -1, n, seed)), "target": pdf.target})

    curve = pr_curve(rows.mapInPandas(scored, "score double, target int").where("not isnan(score)")) if base else None
    limit = threshold_at_recall(curve, recall).first()["threshold"] if base else None

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((n, 5), np.int64)
        for pdf in batches:
            focal, own_rows = pdf.target.to_numpy() == 1, _measured(pdf)
            for r in range(n) if len(pdf) else ():
                score = models[r].score(_colors(own_rows, r, n, seed))
                sound, hit = np.isfinite(score), score >= (np.inf if limit is None else limit)
                total[r] += [len(pdf), (~sound).sum(), (sound & hit & focal).sum(), (sound & hit & ~focal).sum(), (sound & ~hit & focal).sum()]
        yield pd.DataFrame(total, columns=["n", "failed", "tp", "fp", "fn"]).assign(realisation=np.arange(n, dtype="int32"))[["realisation", "n", "failed", "tp", "fp", "fn"]]

    m = rows.mapInPandas(counts, "realisation int, n long, failed long, tp long, fp long, fn long") if base else rows.sparkSession.createDataFrame([], "realisation int, n long, failed long, tp long, fp long, fn long")
    m = m.groupBy("realisation").agg(*[F.sum(c).alias(c) for c in ("n", "failed", "tp", "fp", "fn")])
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    m = m.withColumn("precision", p).withColumn("recall", r).withColumn("contamination", 1 - F.col("precision"))
    return m.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def summarize_realisations(metrics: DataFrame, names: Sequence[str] = ("precision", "recall", "contamination", "f1"), level: float = 0.95) -> DataFrame:
    """metric, realisations, finite, failed, mean, std, lower, upper over the realisations (a row each); failed ones are those without a finite value."""
    long = metrics.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in names])))
    v = F.when(~F.isnan("v") & (F.abs("v") != float("inf")), F.col("v"))
    lo, hi = (1 - level) / 2, 1 - (1 - level) / 2
    return long.withColumn("v", v).groupBy("metric").agg(F.count("*").alias("realisations"), F.count("v").alias("finite"), (F.count("*") - F.count("v")).alias("failed"), F.avg("v").alias("mean"),
                                                         F.stddev_pop("v").alias("std"), F.percentile("v", lo).alias("lower"), F.percentile("v", hi).alias("upper"))


CELLS, DRAWS = 4_096, 4_096  # different rows of a stratum that a task counts; draws (of all replicates) that are made at once


def _drawn_sums(spark: SparkSession, cells: list[list[tuple]], replicates: int, seed: int, width: int) -> DataFrame:
    """replicate, n, s: rows drawn and sums of their columns for each replicate, from each stratum's different rows (columns and how many)."""
    sizes = [sum(n for *_, n in c) for c in cells]
    slices = [-(-s // DRAWS) for s in sizes]
    first = np.cumsum([0, *slices])
    ends = [np.cumsum([n for *_, n in c]) for c in cells]
    values = [np.array([v for *v, _ in c], float).reshape(len(c), width) for c in cells]

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s = np.zeros(replicates, np.int64), np.zeros((replicates, width))
        for pdf in batches:
            for at in pdf.id.tolist():
                k = int(np.searchsorted(first, at, "right")) - 1
                i = np.arange((at - first[k]) * DRAWS, min(sizes[k], (at - first[k] + 1) * DRAWS), dtype=np.uint64)
                for b in range(replicates):
                    c = np.uint64((k * replicates + b) << 40) + i
                    cell = np.searchsorted(ends[k], np.floor(counted(seed, c) * sizes[k]), "right")
                    times = np.bincount(cell, minlength=len(ends[k]))
                    n[b] += len(i)
                    s[b] += times @ values[k]
        yield pd.DataFrame({"replicate": np.arange(replicates, dtype="int32"), "n": n, "s": list(s)})

    part = spark.range(0, int(first[-1]), 1, max(1, min(int(first[-1]), int(spark.conf.get("spark.sql.shuffle.partitions"))))).mapInPandas(draw, "replicate int, n long, s array<double>")
    return part.groupBy("replicate").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(width)])


def paired_bootstrap(predictions: DataFrame, strata: str, replicates: int, seed: int, level: float = 0.95,
                     columns: Sequence[str] = ("ok_a", "ok_b"), metric: Callable[[Callable[[str], Column]], Column] | None = None) -> DataFrame:
    """difference of a metric of two classifiers with a percentile interval: of accuracy (0/1 columns ok_a, ok_b) unless ``metric`` is given.

    ``metric`` makes the difference from weighted sums over a replicate's rows: it is called with a
    function from a column's name to the sum of that column (of ``columns``, or "n": the number of rows).

    Within each stratum as many rows are drawn as it has; both classifiers are judged on the same draws. Rows that are equal in
    ``columns`` are the same to the metric, so a draw is a place among a stratum's rows in order of the columns, and tasks
    count draws by different rows: what leaves a task is a sum for each replicate, and neither rows nor draws are shuffled.
    That needs the different rows of a stratum to be few, as those of 0/1 columns are; more than CELLS fail.
    """
    if metric is None:
        def metric(total: Callable[[str], Column]) -> Column:
            return (total("ok_a") - total("ok_b")) / total("n")

    spark = predictions.sparkSession
    counted_rows = written(predictions.groupBy(F.col(strata).alias("__stratum"), *columns).agg(F.count("*").alias("__n")), "cells")
    most = counted_rows.groupBy("__stratum").count().agg(F.max("count"), F.count("*")).first()
    if (most[0] or 0) > CELLS or most[1] > CELLS:
        raise ValueError(f"{most[0]} different rows in one of {most[1]} strata; {CELLS} at most")
    cells: dict[object, list[tuple]] = {}
    for r in counted_rows.orderBy(F.asc_nulls_first("__stratum"), *columns).collect():
        cells.setdefault(r["__stratum"], []).append((*[r[c] for c in columns], r["__n"]))
    drawn = _drawn_sums(spark, list(cells.values()), replicates, seed, len(columns))
    r = drawn.select("replicate", metric(lambda c: F.col("n") if c == "n" else F.col(f"s{list(columns).index(c)}")).alias("difference"))
    lo, hi = (1 - level) / 2, 1 - (1 - level) / 2
    observed = counted_rows.agg(metric(lambda c: F.sum("__n") if c == "n" else F.sum(F.col(c) * F.col("__n"))).alias("observed"))
    b = r.agg(F.count("*").alias("replicates"), F.avg("difference").alias("mean"), F.percentile("difference", lo).alias("lower"), F.percentile("difference", hi).alias("upper"))  # a row for each replicate
    return observed.crossJoin(b)  # one row each
