"""Measurements from wide to long form."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Band:
    """A band's value and error columns, and its extinction coefficient if values are corrected."""

    name: str
    value: str
    error: str
    coefficient: float | None = None


def _values(bands: Sequence[Band], sentinels: Sequence[float], reddening: str | None) -> list[tuple[Column, Column]]:
    """Each band's value, null where it is a sentinel, and its magnitude."""
    if reddening and (missing := [b.name for b in bands if b.coefficient is None]):
        raise ValueError(f"no coefficient for {', '.join(missing)}")
    value = [F.when(~F.col(b.value).isin(list(sentinels)), F.col(b.value)) if sentinels else F.col(b.value) for b in bands]
    return [(v, v - b.coefficient * F.col(reddening) if reddening else v) for b, v in zip(bands, value, strict=True)]


def unpivot(df: DataFrame, keys: Sequence[str], bands: Sequence[Band], sentinels: Sequence[float] = (), reddening: str | None = None) -> DataFrame:
    """keys, band, mag, mag_err; null and sentinel values have no row. With ``reddening`` mag is value - coefficient * reddening."""
    rows = F.array(*[F.struct(F.lit(b.name).alias("band"), mag.cast("double").alias("mag"), F.col(b.error).cast("double").alias("mag_err"), value.isNotNull().alias("__there"))
                     for b, (value, mag) in zip(bands, _values(bands, sentinels, reddening), strict=True)])
    return df.select(*keys, F.inline(rows)).where("__there").drop("__there")


def banded(df: DataFrame, keys: Sequence[str], bands: Sequence[Band], sentinels: Sequence[float] = (), reddening: str | None = None) -> DataFrame:
    """keys, and each band's magnitude and error as columns b0, e0, b1, e1, ...: what ``features.pivot`` makes of ``unpivot``, of a table with one row for each key, without a shuffle."""
    values = _values(bands, sentinels, reddening)
    there = [v.isNotNull() for v, _ in values]
    pairs = [c for i, (b, (v, m), t) in enumerate(zip(bands, values, there, strict=True)) for c in (F.when(t, m.cast("double")).alias(f"b{i}"), F.when(t, F.col(b.error).cast("double")).alias(f"e{i}"))]
    return df.where(reduce(lambda a, b: a | b, there)).select(*keys, *pairs)


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def invalid_counts(df: DataFrame, bands: Sequence[Band], sentinels: Sequence[float] = (), reddening: str | None = None) -> DataFrame:
    """band, invalid: values that are there but not finite, or with a null, negative or non-finite error, or (corrected) reddening."""
    aggs = []
    for b in bands:
        v, e = F.col(b.value).cast("double"), F.col(b.error).cast("double")
        there = v.isNotNull() & (~v.isin(list(sentinels)) if sentinels else F.lit(True))
        bad = ~_finite(v) | ~_finite(e) | F.coalesce(e < 0, F.lit(True))
        if reddening:
            bad |= ~_finite(F.col(reddening).cast("double"))
        aggs.append(F.count_if(there & bad).alias(b.name))
    row = df.agg(*aggs)
    return row.select(F.inline(F.array(*[F.struct(F.lit(b.name).alias("band"), F.col(b.name).alias("invalid")) for b in bands])))


def require_valid(df: DataFrame, bands: Sequence[Band], sentinels: Sequence[float] = (), reddening: str | None = None) -> DataFrame:
    bad = {r["band"]: r["invalid"] for r in invalid_counts(df, bands, sentinels, reddening).collect() if r["invalid"]}
    if bad:
        raise ValueError(f"invalid measurements: {bad}")
    return df


def coverage(long: DataFrame, wide: DataFrame, bands: Sequence[Band]) -> DataFrame:
    """band, eligible, inserted, missing_or_sentinel."""
    n = wide.agg(F.count("*").alias("eligible")).select("eligible", F.explode(F.array(*[F.lit(b.name) for b in bands])).alias("band"))
    got = long.groupBy("band").agg(F.count("*").alias("inserted"))
    out = n.join(got, "band", "left").withColumn("inserted", F.coalesce("inserted", F.lit(0)))
    return out.select("band", "eligible", "inserted", (F.col("eligible") - F.col("inserted")).alias("missing_or_sentinel"))


def present(existing: DataFrame, new: DataFrame, identity: Sequence[str]) -> DataFrame:
    """Identities of ``new`` that ``existing`` has already."""
    return new.select(*identity).distinct().join(existing, list(identity), "left_semi")


def require_absent(existing: DataFrame, new: DataFrame, identity: Sequence[str]) -> None:
    """Fail if a measurement of the same identity (such as catalogue, measure, corrected) is there already."""
    if not present(existing, new, identity).isEmpty():
        raise ValueError(f"measurements of the same {', '.join(identity)} exist")
