"""Heterogeneous catalogues as one table of records, and objects seeded from one of them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Catalogue:
    """Where a catalogue's records come from: its code, key columns and position columns."""

    code: str
    key: tuple[str, ...]
    ra: str
    dec: str


def normalize(sources: Sequence[tuple[Catalogue, DataFrame]]) -> DataFrame:
    """catalog_code, source_key (JSON array of the key's parts), ra_deg, dec_deg of all sources."""
    out = None
    for c, df in sources:
        key = F.to_json(F.array(*[F.col(k).cast("string") for k in c.key]))
        part = df.select(F.lit(c.code).alias("catalog_code"), key.alias("source_key"), F.col(c.ra).alias("ra_deg"), F.col(c.dec).alias("dec_deg"))
        out = part if out is None else out.unionByName(part)
    return out


def registered(records: DataFrame, registry: DataFrame) -> DataFrame:
    """Records with their registry row (code, ...); a code without one is an error."""
    missing = records.select(F.col("catalog_code").alias("code")).distinct().join(registry, "code", "left_anti")
    if codes := [r["code"] for r in missing.orderBy("code").limit(20).collect()]:
        raise ValueError(f"not in the registry: {', '.join(codes)}")
    return records.join(registry, records["catalog_code"] == registry["code"])


def catalogue_slice(records: DataFrame, code: str) -> DataFrame:
    out = records.where(F.col("catalog_code") == code)
    if out.isEmpty():
        raise ValueError(f"catalogue {code} has no records")
    return out


def seed_objects(records: DataFrame, code: str) -> DataFrame:
    """object_key, ra_deg, dec_deg: an object for each record of the reference catalogue, known by its stable key."""
    return records.where(F.col("catalog_code") == code).select(F.col("source_key").alias("object_key"), "ra_deg", "dec_deg")


def identity_edges(objects: DataFrame) -> DataFrame:
    """Each object's edge to the record it was seeded from."""
    return objects.select("object_key", F.col("object_key").alias("record_key"), F.lit(0.0).alias("sep"), F.lit(1).cast("long").alias("candidate_count"),
                          F.lit(1).cast("long").alias("candidate_rank"), F.lit(True).alias("selected"), F.lit(False).alias("ambiguous"))
