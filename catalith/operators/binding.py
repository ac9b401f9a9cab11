"""Binding of sample members to the exact records that describe them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .population import apply_policy


def bind(sample: DataFrame, edges: DataFrame, policy: str) -> DataFrame:
    """object_id, source_role, record_id: the reference record, and the target record of the sample's policy."""
    ref = sample.select("object_id", F.lit("reference").alias("source_role"), F.col("object_id").alias("record_id"))
    chosen = apply_policy(edges, policy).select(F.col("ref").alias("object_id"), F.col("target").alias("record_id"))
    tar = sample.select("object_id").join(chosen, "object_id").select("object_id", F.lit("target").alias("source_role"), "record_id")
    return ref.unionByName(tar)


def per_role(bindings: DataFrame) -> DataFrame:
    """source_role, members, most: members with a record of the role, and the most records that one of them has."""
    per = bindings.groupBy("source_role", "object_id").agg(F.count("*").alias("n"))
    return per.groupBy("source_role").agg(F.count("*").alias("members"), F.max("n").alias("most"))


def require_one_each(bindings: DataFrame, sample: DataFrame, roles: tuple[str, ...] = ("reference", "target")) -> None:
    """Every member has exactly one record of each role."""
    n = sample.count()
    found = {r["source_role"]: (r["members"], r["most"]) for r in per_role(bindings).collect()}
    if n and (bad := {r: found.get(r) for r in roles if found.get(r) != (n, 1)}):
        raise ValueError(f"bindings of {n} members: {bad}")


def summary(bindings: DataFrame) -> DataFrame:
    return bindings.groupBy("source_role").agg(F.count("*").alias("bindings"), F.countDistinct("record_id").alias("records"))
