"""Frozen stratified splits and folds by stable hashes."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import ROWS, ranges_for, running


def stable_hash(parts: Sequence[str], seed: object) -> Column:
    """md5 of the parts and the seed joined by ":"; null parts count as empty."""
    return F.md5(F.concat_ws(":", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts], F.lit(str(seed))))


def hash_ranked(df: DataFrame, strata: str, parts: Sequence[str], seed: object, rows: int = ROWS) -> DataFrame:
    """``df`` with place (from 1, in order of hash, then parts) and size of its stratum.

    No window holds a whole stratum: hashes are uniform, so their first digits, as many as the table's count asks for, cut a
    stratum into ranges of at most about ``rows`` rows, over which ``running`` counts.
    """
    digits = max(1, math.ceil(math.log(ranges_for(df.count(), rows), 16)))
    d = df.withColumn("__hash", stable_hash(parts, seed)).withColumn("__range", F.substring("__hash", 1, digits))
    d = running(d, "__range", ["__hash", *parts], {"place": F.lit(1).cast("long")}, [strata])
    return d.withColumnRenamed("all_place", "stratum_size").drop("__hash", "__range")


def stratified_split(df: DataFrame, strata: str, parts: Sequence[str], fraction: float, seed: object, names: tuple[str, str] = ("test", "train")) -> DataFrame:
    """``df`` with split: the first floor(size * fraction + 0.5) places of each stratum, and the others."""
    if not 0 < fraction < 1 or names[0] == names[1]:
        raise ValueError("a fraction between 0 and 1 and two names are needed")
    d = hash_ranked(df, strata, parts, seed)
    first = F.col("place") <= F.floor(F.col("stratum_size") * fraction + 0.5)
    return d.withColumn("split", F.when(first, names[0]).otherwise(names[1])).drop("place", "stratum_size")


def require_unassigned(sample: DataFrame) -> None:
    bad = sample.where("split <> 'unassigned' or split is null").groupBy("split").count().limit(5).collect()
    if bad:
        raise ValueError(f"members are assigned already: {[(r['split'], r['count']) for r in bad]}")


def ledger(df: DataFrame, strata: str) -> DataFrame:
    return df.groupBy(strata, "split").agg(F.count("*").alias("n"))


def k_folds(df: DataFrame, strata: str, parts: Sequence[str], k: int, seed: object) -> DataFrame:
    """``df`` with fold (0 to k - 1); each row is validated in exactly one, and folds of a stratum differ by one row at most."""
    d = hash_ranked(df, strata, parts, seed)
    return d.withColumn("fold", F.pmod(F.col("place") - 1, F.lit(k)).cast("int")).drop("place", "stratum_size")
