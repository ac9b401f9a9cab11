"""Contracts that a frozen plan depends on, over ledger tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A plan may not be frozen."""


def sample_contract(ledger: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """sample, a column for each kind's digest, missing (names of kinds without one), from (sample, kind, digest) rows."""
    p = ledger.groupBy("sample").agg(*[F.max(F.when(F.col("kind") == k, F.nullif("digest", F.lit("")))).alias(k) for k in kinds])
    missing = F.array_join(F.sort_array(F.array_compact(F.array(*[F.when(F.col(k).isNull(), F.lit(k)) for k in kinds]))), ",")
    return p.withColumn("missing", missing)


def feature_contract(feature_sets: DataFrame, samples: DataFrame) -> DataFrame:
    """feature_set, sample, sealed, known: whether it has a digest and its sample exists."""
    s = samples.select("sample").distinct().withColumn("known", F.lit(True))
    return feature_sets.join(s, "sample", "left").select("feature_set", "sample", F.coalesce(F.col("digest") != "", F.lit(False)).alias("sealed"), F.coalesce("known", F.lit(False)).alias("known"))


def population_contract(members: DataFrame, expected: Mapping[str, Sequence[str]]) -> DataFrame:
    """split, members, classes (sorted), as_declared, for every split that is there or declared."""
    spark = members.sparkSession
    want = spark.createDataFrame([(k, sorted(v)) for k, v in expected.items()], "split string, want array<string>")
    got = members.groupBy("split").agg(F.count("*").alias("members"), F.sort_array(F.collect_set("target_class")).alias("classes"))
    out = got.join(want, "split", "full")
    return out.select("split", F.coalesce("members", F.lit(0)).alias("members"), F.array_join("classes", ",").alias("classes"),
                      F.coalesce(F.col("classes") == F.col("want"), F.lit(False)).alias("as_declared"))


def freeze(sample: DataFrame, features: DataFrame, population: DataFrame, name: str, test_locked: bool = True) -> DataFrame:
    """The plan's ledger row, if all contracts hold; the inputs are rows of the three contracts for one sample."""
    s, f = sample.limit(2).collect(), features.limit(2).collect()  # more than one is an error
    if len(s) != 1 or s[0]["missing"]:
        raise ContractError(f"digests missing: {[r['missing'] for r in s]}")
    if len(f) != 1 or not (f[0]["sealed"] and f[0]["known"]) or f[0]["sample"] != s[0]["sample"]:
        raise ContractError("the feature set is not sealed for this sample")
    bad = [r["split"] for r in population.where("not as_declared").limit(20).collect()]
    if bad:
        raise ContractError(f"splits or classes are not as declared: {sorted(bad)}")
    total = population.agg(F.sum("members").alias("members"))
    return sample.drop("missing").crossJoin(features.select("feature_set")).crossJoin(total).select(F.lit(name).alias("plan"), "*", F.lit(test_locked).alias("test_locked"))
