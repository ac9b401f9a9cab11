"""Data-quality audits as one-pass aggregates, in long form (check, column, value)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _long(row: DataFrame, name: str, columns: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias(name)) for c in columns])
    return row.select(F.inline(pairs))


def null_counts(df: DataFrame) -> DataFrame:
    """column, nulls."""
    return _long(df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]), "nulls", df.columns)


def key_audit(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """null_key_rows, duplicate_groups, duplicate_rows (rows beyond the first of each group of a whole key)."""
    whole = F.lit(True)
    for c in key:
        whole &= F.col(c).isNotNull()
    nulls = df.agg(F.count_if(~whole).alias("null_key_rows"))
    groups = df.where(whole).groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    dups = groups.agg(F.count("*").alias("duplicate_groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))
    return nulls.crossJoin(dups)  # one row each


def bounds_audit(df: DataFrame, ra: str, dec: str, ra_range: tuple[float, float] = (0, 360), dec_range: tuple[float, float] = (-90, 90)) -> DataFrame:
    """null_rows and invalid_rows: ra half-open, dec closed; a null part is invalid only if the other part is out of range."""
    a, d = F.col(ra), F.col(dec)
    out = (a < ra_range[0]) | (a >= ra_range[1]) | (d < dec_range[0]) | (d > dec_range[1])
    return df.agg(F.count_if(a.isNull() | d.isNull()).alias("null_rows"), F.count_if(out).alias("invalid_rows"))


def numeric_ranges(df: DataFrame) -> DataFrame:
    """column, min, max (double) of every numeric column; NaN is above all numbers."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, min double, max double")
    aggs = [F.struct((F.min(c).cast("double") + 0.0).alias("min"), (F.max(c).cast("double") + 0.0).alias("max")).alias(c) for c in names]  # + 0.0: no -0.0
    row = df.agg(*aggs)
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).min.alias("min"), F.col(c).max.alias("max")) for c in names])))


def sentinel_counts(df: DataFrame, columns: Sequence[str], sentinel: float) -> DataFrame:
    """column, sentinels."""
    return _long(df.agg(*[F.count_if(F.col(c) == sentinel).alias(c) for c in columns]), "sentinels", columns)


def source_contract(tables: Mapping[str, DataFrame], registry: DataFrame) -> DataFrame:
    """Per code: files, rows, distinct (file, row), first and last row, contiguous, and whether the registry agrees.

    Tables have source_file and source_row; the registry has code and expected_rows.
    """
    union = None
    for code, df in tables.items():
        part = df.select(F.lit(code).alias("code"), "source_file", "source_row")
        union = part if union is None else union.unionByName(part)
    a = union.groupBy("code").agg(
        F.countDistinct("source_file").alias("files"), F.count("*").alias("rows"), F.countDistinct(F.struct("source_file", "source_row")).alias("distinct_rows"),
        F.min("source_row").alias("first_row"), F.max("source_row").alias("last_row"))
    one = (F.col("rows") == F.col("distinct_rows")) & (F.col("first_row") == 1) & (F.col("last_row") == F.col("rows")) & (F.col("files") == 1)
    a = a.withColumn("contiguous", one)
    out = a.join(registry.select("code", "expected_rows"), "code", "left")
    return out.withColumn("as_expected", F.coalesce(F.col("rows") == F.col("expected_rows"), F.lit(False)))


def audit_tables(tables: Mapping[str, DataFrame], loaded: Sequence[str]) -> DataFrame:
    """table, check, column, value (text) of all tables, rows, nulls, and min and max of numbers, one pass a table; the audited set must be the loaded set."""
    if set(tables) != set(loaded):
        raise ValueError(f"audited {sorted(tables)}, loaded {sorted(loaded)}")
    out = None
    for name, df in tables.items():
        number = lambda c: (c.cast("double") + 0.0).cast("string")  # noqa: E731  + 0.0: no -0.0
        checks = [("rows", "", F.count(F.lit(1)).cast("string"))]
        for f in df.schema:
            c = F.col(f"`{f.name}`")
            checks.append(("nulls", f.name, F.count_if(c.isNull()).cast("string")))
            if isinstance(f.dataType, T.NumericType):
                checks += [("min", f.name, number(F.min(c))), ("max", f.name, number(F.max(c)))]
        row = df.agg(*[v.alias(f"v{i}") for i, (_, _, v) in enumerate(checks)])
        cells = [F.struct(F.lit(name).alias("table"), F.lit(k).alias("check"), F.lit(c).alias("column"), F.col(f"v{i}").alias("value")) for i, (k, c, _) in enumerate(checks)]
        part = row.select(F.inline(F.array(*cells)))
        out = part if out is None else out.unionByName(part)
    return out


def flag_crosstab(df: DataFrame, flags: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows, and rows without a value in each of ``columns``, by the values of the flags."""
    return df.groupBy(*flags).agg(F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in columns])
