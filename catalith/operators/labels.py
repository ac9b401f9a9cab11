"""Label evidence of several kinds, never collapsed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ("object_id", "record_id", "target_class", "evidence", "provenance", "confidence", "details")


def evidence(rows: DataFrame, object_id: str, record_id: str, target_class: Column | str, kind: str, provenance: str,
             confidence: Column | None = None, details: Sequence[str] = ()) -> DataFrame:
    """Evidence rows of one kind from already filtered rows; details become a JSON object."""
    cls = F.lit(target_class) if isinstance(target_class, str) else target_class
    conf = F.lit(None).cast("double") if confidence is None else confidence
    info = F.to_json(F.struct(*details)) if details else F.lit("{}")
    return rows.select(F.col(object_id).alias("object_id"), F.col(record_id).alias("record_id"), cls.alias("target_class"), F.lit(kind).alias("evidence"),
                       F.lit(provenance).alias("provenance"), conf.alias("confidence"), info.alias("details"))


def unify(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0].select(*COLUMNS)
    for p in parts[1:]:
        out = out.unionByName(p.select(*COLUMNS))
    return out


def repeated_evidence(labels: DataFrame) -> DataFrame:
    """(object, record, evidence, provenance) that occur more than once; a sound table has none."""
    return labels.groupBy("object_id", "record_id", "evidence", "provenance").agg(F.count("*").alias("n")).where("n > 1")


def support(sample: DataFrame, labels: DataFrame) -> DataFrame:
    """target_class, members, supported, unsupported: whether the object has evidence of its class."""
    seen = labels.select("object_id", "target_class").distinct().withColumn("seen", F.lit(True))
    s = sample.join(seen, ["object_id", "target_class"], "left")
    return s.groupBy("target_class").agg(F.count("*").alias("members"), F.count("seen").alias("supported"), (F.count("*") - F.count("seen")).alias("unsupported"))


def unsupported(sample: DataFrame, labels: DataFrame) -> DataFrame:
    return sample.join(labels.select("object_id", "target_class").distinct(), ["object_id", "target_class"], "left_anti")


def summary(labels: DataFrame) -> DataFrame:
    return labels.groupBy("target_class", "evidence", "provenance").agg(F.count("*").alias("n_rows"), F.countDistinct("object_id").alias("objects"))
