"""Evaluation: fold-local scaling, out-of-fold predictions, curves, thresholds and ledgers."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import ROWS, in_ranges, quantiles, running
from ..sources.scratch import shared, written


def split_matrix(features: DataFrame, splits: DataFrame, key: str, split: str, selections: DataFrame | None = None) -> DataFrame:
    """Rows of a split. The test split can be read only with a frozen selection (a row of ``selections``)."""
    if split == "test" and (selections is None or selections.isEmpty()):
        raise PermissionError("the test split is locked until a selection is frozen")
    return features.join(splits.where(F.col("split") == split).select(key), key, "left_semi")


def alignment(a: DataFrame, b: DataFrame, key: str, label: str) -> DataFrame:
    """n_left, n_right, mismatches: keys on one side only, or with another label."""
    x = a.select(key, F.col(label).alias("la"), F.lit(1).alias("ina"))
    y = b.select(key, F.col(label).alias("lb"), F.lit(1).alias("inb"))
    return x.join(y, key, "full").agg(F.count("ina").alias("n_left"), F.count("inb").alias("n_right"),
                                      F.count_if(F.col("ina").isNull() | F.col("inb").isNull() | ~F.col("la").eqNullSafe(F.col("lb"))).alias("mismatches"))


def matrix_validation(matrix: DataFrame, key: str, column: str, label: str) -> DataFrame:
    """rows, distinct_keys, null_labels, widths (least and most), non_finite."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return matrix.agg(F.count("*").alias("n_rows"), F.countDistinct(key).alias("distinct_keys"), F.count_if(F.col(label).isNull()).alias("null_labels"),
                      F.min(F.size(column)).alias("width_min"), F.max(F.size(column)).alias("width_max"), F.count_if(bad).alias("non_finite"))


def aligned_subset(matrix: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return matrix.join(keys.select(key), key, "left_semi")


def standardize(folded: DataFrame, column: str, width: int, to: str = "scaled") -> DataFrame:
    """Each row scaled by mean and deviation of the rows of all other folds; a constant column is only centred.

    Sums of a fold are the total's less the fold's own, so one pass (after one for the mean) gives the statistics of all.
    """
    folded = written(folded, "folded")  # read three times
    first = folded.agg(*[F.avg(F.col(column)[i]).alias(f"a{i}") for i in range(width)]).first()
    shift = [first[f"a{i}"] or 0.0 for i in range(width)]  # squares are summed about the mean of all rows, lest they cancel
    x = [F.col(column)[i] - shift[i] for i in range(width)]
    sums = folded.groupBy("fold").agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(x)], *[F.sum(c * c).alias(f"q{i}") for i, c in enumerate(x)])
    got = sums.collect()  # one row a fold
    n, s, q = np.array([r["n"] for r in got], float), *(np.array([[r[f"{c}{i}"] for i in range(width)] for r in got], float).reshape(-1, width) for c in "sq")
    rest = np.maximum(n.sum() - n, 1)[:, None]
    mean = (s.sum(axis=0) - s) / rest
    std = np.sqrt(np.maximum((q.sum(axis=0) - q) / rest - mean**2, 0))
    fit = folded.sparkSession.createDataFrame([(r["fold"], (m + shift).tolist(), d.tolist()) for r, m, d in zip(got, mean, std, strict=True)],
                                              f"fold {folded.schema['fold'].dataType.simpleString()}, __mean array<double>, __std array<double>")
    out = folded.join(F.broadcast(fit), "fold")
    scaled = F.transform(F.arrays_zip(column, "__mean", "__std"), lambda x: (x[column] - x["__mean"]) / F.when(x["__std"] > 0, x["__std"]).otherwise(1.0))
    return out.withColumn(to, scaled).drop("__mean", "__std")


def out_of_fold(folded: DataFrame, key: str, column: str, label: str, folds: int, classes: int, trees: int = 500, depth: int = 10, seed: int = 7, parallel: int = 5, nodes: int = 65_536) -> DataFrame:
    """key, label, fold, probability: each row predicted by a balanced random forest fitted on the other folds. Labels are 0 to classes - 1.

    The driver holds the trees that grow, so a forest is grown in lots of trees of about ``nodes`` nodes together, each lot with its own seed: a lot's votes for
    the fold's rows are written before the next one starts, and a row's votes are added up in the order of the lots. ``parallel`` folds are fitted at a time, so
    that the rounds of one fit fill the tasks that another leaves idle; the driver holds about parallel * nodes nodes, however many rows and trees there are.
    """
    spark = folded.sparkSession
    d = folded.select(F.monotonically_increasing_id().alias("row"), key, F.col(label).cast("double").alias("label"), "fold", F.col(column).alias("x"))
    d = written(d, "folded")  # read by each fit
    n = [(r["fold"], r["label"], r["n"]) for r in d.where("label is not null").groupBy("fold", "label").agg(F.count("*").alias("n")).collect()]  # a row for each fold and class
    at_once = max(1, nodes // max(1, min(2 << depth, sum(count for _, _, count in n))))  # a tree has no more nodes than its depth allows, and about as many as rows (bags hold two thirds of them)
    d = d.withColumn("features", array_to_vector(F.col("x"))).drop("x")
    votes = shared(spark, "votes")

    def voted(k: int) -> None:
        own: Counter[float] = Counter()
        for fold, y, count in n:
            own[y] += count if fold != k else 0
        weight = {y: own.total() / (sum(c > 0 for c in own.values()) * c) for y, c in own.items() if c}
        train = d.where((F.col("fold") != k) & F.col("label").isNotNull()).withColumn("weight", F.create_map(*[F.lit(v) for yw in weight.items() for v in yw])[F.col("label")])
        rows = d.where(F.col("fold") == k)
        for lot, first in enumerate(range(0, trees, at_once)):
            size = min(at_once, trees - first)
            forest = RandomForestClassifier(numTrees=size, maxDepth=depth, featureSubsetStrategy="sqrt", weightCol="weight", seed=seed + 1_000_003 * lot)
            p = forest.fit(train).transform(rows).select("row", key, F.col("label").cast("int").alias("label"), F.transform(vector_to_array("probability"), lambda x: x * size).alias("votes"))
            p.write.parquet(f"{votes}/fold={k}/lot={lot}")

    with ThreadPool(max(1, min(parallel, folds))) as pool:
        pool.map(inheritable_thread_target(spark)(voted), range(folds))
    schema = f"row long, {key} {folded.schema[key].dataType.simpleString()}, label int, votes array<double>, fold int, lot int"
    lots = spark.read.schema(schema).parquet(votes).groupBy("row", key, "label", "fold").agg(F.sort_array(F.collect_list(F.struct("lot", "votes"))).alias("lots"))
    total = F.transform(F.col("lots")[0]["votes"], lambda _, i: F.aggregate("lots", F.lit(0.0), lambda a, v: a + v["votes"][i]) / trees)
    return lots.select(key, "label", F.col("fold").cast(folded.schema["fold"].dataType).alias("fold"), total.alias("probability"))


def one_vs_rest(df: DataFrame, label: str, focal: object) -> Column:
    return (F.col(label) == focal).cast("int")


def pr_curve(scored: DataFrame, score: str = "score", target: str = "target", rows: int = ROWS) -> DataFrame:
    """score, tp, fp, precision, recall at each distinct score, counting rows of at least that score.

    Rows are first summed by score; running sums are taken within ranges of about ``rows`` scores, on top of the sums of the ranges above.
    """
    s = scored.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(F.sum(F.col(target).cast("long")).alias("p"), F.count("*").alias("n"))
    s = running(in_ranges(s, [F.col("score")], rows), "range", [F.desc("score")], {"tp": F.col("p"), "seen": F.col("n")}, descending=True)
    tp, n = F.col("tp"), F.col("seen")
    return s.select("score", tp.alias("tp"), (n - tp).alias("fp"), (tp / n).alias("precision"), F.try_divide(tp, F.col("all_tp")).alias("recall"), "p", F.col("all_tp").alias("all_p"))


def average_precision(curve: DataFrame) -> DataFrame:
    """Sum over thresholds of the gain in recall times precision (a score's own positives are its gain)."""
    return curve.agg(F.sum(F.try_divide(F.col("p"), F.col("all_p")) * F.col("precision")).alias("average_precision"))


def threshold_at_recall(curve: DataFrame, recall: float) -> DataFrame:
    """Highest score whose recall reaches the target."""
    return curve.where(F.col("recall") >= recall).agg(F.max("score").alias("threshold"))


def at_threshold(scored: DataFrame, threshold: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """n, tp, fp, fn, precision, recall, contamination, f1 of score >= threshold (a one-row table), in all or by slices."""
    d = scored.crossJoin(F.broadcast(threshold))
    hit, pos = F.col("score") >= F.col("threshold"), F.col("target") == 1
    aggs = [F.count("*").alias("n"), F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn")]
    m = d.groupBy(*by).agg(*aggs) if by else d.agg(*aggs)
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    m = m.withColumn("precision", p).withColumn("recall", r).withColumn("contamination", 1 - F.col("precision"))
    return m.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def precision_at_recall(curve: DataFrame, recall: float) -> DataFrame:
    return curve.where(F.col("recall") >= recall).agg(F.max("precision").alias("precision"))


def recall_at_precision(curve: DataFrame, precision: float) -> DataFrame:
    return curve.where(F.col("precision") >= precision).agg(F.max("recall").alias("recall"))


def argmax(probability: str) -> Column:
    """Index of the largest probability, the first of equal ones."""
    return F.array_position(F.col(probability), F.array_max(probability)).cast("int") - 1


def confusion(predicted: DataFrame, label: str, prediction: str, classes: Sequence[object]) -> DataFrame:
    """A row for each true class, a column pred_<class> for each predicted one."""
    cols = [F.count_if(F.col(prediction) == c).alias(f"pred_{c}") for c in classes]
    return predicted.groupBy(label).agg(*cols)


def select_candidate(candidates: DataFrame) -> DataFrame:
    """The best of (name, dimensions, metric): highest metric rounded to 1e-12, then fewer dimensions, then name."""
    return candidates.orderBy(F.desc(F.round("metric", 12)), "dimensions", "name").limit(1)


def long_embedding(df: DataFrame, run: str, key: str, column: str) -> DataFrame:
    """run, key, component (from 0), value."""
    return df.select(F.lit(run).alias("run"), key, F.posexplode(column).alias("component", "value"))


def harder_contaminants(scored: DataFrame, label: str, focal: object) -> DataFrame:
    """label, n, above: rows of each other class, and how many score above the focal class's median."""
    median, = quantiles(scored.where(F.col(label) == focal), "score", [0.5])
    return scored.where(F.col(label) != focal).groupBy(label).agg(F.count("*").alias("n"), F.count_if(F.col("score") > F.lit(median).cast("double")).alias("above"))
