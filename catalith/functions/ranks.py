"""Order statistics and running sums of any number of rows, without a task that holds them all."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

ROWS, LAST, PARTS = 200_000, 20_000, 4_096


def ranges_for(rows: int, each: int = ROWS) -> int:
    """Ranges of about ``each`` rows."""
    return max(1, -(-rows // each))


def in_ranges(df: DataFrame, order: Sequence[Column], each: int = ROWS) -> DataFrame:
    """``df`` written, with an ascending ``range`` of about ``each`` rows by ``order``; equal keys share one."""
    rows = written(df, "unordered")
    n = ranges_for(rows.count(), each)
    if n == 1:
        return rows.withColumn("range", F.lit(0))
    return written(rows.repartitionByRange(n, *order).withColumn("range", F.spark_partition_id()), "ordered")


def running(df: DataFrame, ranges: str, order: Sequence[Column | str], sums: Mapping[str, Column], by: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """``df`` with a running sum for each of ``sums`` (up to and with the row, in ``order``) and its total, ``all_<name>``, within ``by``.

    Rows carry an ordered column ``ranges``; sums of ranges are added up in the small table of ranges, and rows only
    within their range (in ``order``, which must break all ties). ``descending`` tells that ``order`` runs against the ranges.
    """
    d = df.withColumns({f"__{name}": c for name, c in sums.items()})
    at = F.desc(ranges) if descending else F.asc(ranges)
    own, before = Window.partitionBy(*by, ranges).orderBy(*order), Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    inside = own.rowsBetween(Window.unboundedPreceding, 0)
    totals = d.groupBy(*by, ranges).agg(*[F.sum(f"__{n}").alias(f"__t_{n}") for n in sums])
    keys = {c: f"__k{i}" for i, c in enumerate([*by, ranges])}
    totals = totals.select(*[F.col(c).alias(k) for c, k in keys.items()], *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in sums],
                           *[F.sum(f"__t_{n}").over(Window.partitionBy(*by)).alias(f"all_{n}") for n in sums])
    d = d.withColumns({f"__{n}": F.sum(f"__{n}").over(inside) for n in sums})
    same = [F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()]
    d = d.join(totals, same).withColumns({n: F.col(f"__{n}") + F.col(f"__b_{n}") for n in sums})
    return d.drop(*keys.values(), *[f"__{n}" for n in sums], *[f"__b_{n}" for n in sums])


def _counted(values: DataFrame, part: Column) -> list[tuple[int, float, float]]:
    """Number, least and most of the values in each part, ascending."""
    got = values.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most")).collect()  # a row for each part
    return [(r["n"], r["least"], r["most"]) for r in sorted(got, key=lambda r: r["part"])]


def quantiles(values: DataFrame, column: str, shares: Sequence[float], last: int = LAST, parts: int = PARTS) -> list[float | None]:
    """Exact quantiles, interpolated as ``percentile`` does; None without values. Nulls and NaN are left out.

    Selection by counting: values are counted in parts of their magnitude, then the part that holds a
    wanted rank in ``parts`` equal ones, and so on; a part of at most ``last`` values, or of one value only, is read. Two
    numbers of one magnitude differ within 52 bits, so the rounds are few whatever the distribution, and
    no task or round holds more than the counts of the parts.
    """
    v = written(values.select(F.col(column).cast("double").alias("v")).where("v is not null and not isnan(v)"), "values")  # read in every round
    size = F.least(F.log2(F.abs("v")), F.lit(1_100.0)) + 1_075
    found = _counted(v, F.when(F.col("v") == 0, 0).otherwise(F.floor(F.signum("v") * size * 2)).cast("int"))
    n = sum(c for c, _, _ in found)
    if not n:
        return [None] * len(shares)
    at = [s * (n - 1) for s in shares]
    ranks = sorted({r for a in at for r in (math.floor(a), math.ceil(a))})

    def selected(ranks: list[int], found: list[tuple[int, float, float]], before: int) -> dict[int, float]:
        out: dict[int, float] = {}
        for count, least, most in found:
            own = [r for r in ranks if before <= r < before + count]
            if own and least == most:
                out |= dict.fromkeys(own, least)
            elif own:
                inner = v.where(F.col("v").between(least, most))
                if count <= last:
                    each = [(r["n"], r["v"], r["v"]) for r in inner.groupBy("v").agg(F.count("*").alias("n")).orderBy("v").collect()]
                else:
                    half = most / 2 - least / 2  # halves, lest the width be infinite
                    each = _counted(inner, F.least(F.floor((F.col("v") / 2 - least / 2) / half * parts), F.lit(parts - 1)).cast("int")) if math.isfinite(half) and half > 0 else _counted(inner, F.col("v"))
                out |= selected(own, each, before)
            before += count
        return out

    value = selected(ranks, found, 0)
    lo, hi = ([value[f(a)] for a in at] for f in (math.floor, math.ceil))
    return [x if x == y else x + (y - x) * (a - math.floor(a)) for x, y, a in zip(lo, hi, at, strict=True)]
