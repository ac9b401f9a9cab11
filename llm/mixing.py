"""Mixing sources to target weights by budgets over hash-random orders.

Every document gets a hash-random key. Within a source, documents are taken in key
order: whole epochs first, then the documents whose prefix sum of sizes still fits the
rest of the budget, the last one cut to the exact rest. Prefix sums are distributed:
keys are uniform, so their leading digits are range partitions of each source, and the
sums of ranges, then of ranges within one of them, find the range that the budget ends
in. Rows before it are taken and rows behind it are not, so only the rows of that one
range (one of 16^DIGITS of a source) are sorted, and texts are not shuffled at all.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WEIGHTS, SHARE, EPOCHS, DIGITS = (3, 1, 2), 1.5, 2, 4
WORD = r"[^\x20\x09-\x0D]+"


def budgets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, target: shares of ``share`` of all sizes by weight, none above ``epochs`` times its size.

    Weights repeat over the sources in code-point order, null last. The excess of capped
    sources is shared again by weight until none is above: a source is capped iff its
    cap / weight is below the level that the uncapped end at, so one pass in that
    order finds the level. ``sources`` has a row for each source (source, source_size).
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(0))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sources.withColumn("w", w.cast("double")).withColumn("cap", F.col("source_size") * float(epochs))
    t = t.withColumn("total", F.sum("source_size").over(every) * float(share))
    up = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                     / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    # the first source in the order that its level does not fill sets the level for all after it
    free = F.when(F.col("cap") > F.col("level") * F.col("w"), F.col("level"))
    t = t.withColumn("level", F.first(free, ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    capped = F.col("level").isNull() | (F.col("cap") <= F.col("level") * F.col("w"))
    return t.select("source", "source_size", F.when(capped, F.col("cap")).otherwise(F.col("level") * F.col("w")).alias("target"))


def _prefix(seed: str) -> tuple[Column, Column]:
    """A row's key, and its leading digits."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return key, F.substring(key, 1, DIGITS)


def _ends(ranges: DataFrame, part: Column) -> DataFrame:
    """For each source the first range ``part`` whose sizes go beyond what is left: source, ..., cut, n, left (before that range)."""
    own = [c for c in ranges.columns if c not in ("range", "n")]
    upto = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    g = ranges.groupBy(*own, part.alias("part")).agg(F.sum("n").alias("n"))
    g = g.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).where(F.col("before") + F.col("n") > F.col("left"))
    g = g.groupBy(*own).agg(F.min(F.struct("part", "before")).alias("first"))
    return g.select(*[c for c in own if c != "left"], F.col("first.part").alias("cut"), (F.col("left") - F.col("first.before")).alias("left"))


def goals(thin: DataFrame) -> DataFrame:
    """A row for each source of ``thin`` (source, size, range): source, source_size, target, epochs, cut, left.

    ``left`` is what of the budget is left for the rows of the range ``cut``, after
    ``epochs`` of the whole source and the ranges before it. Both are null for a source of size 0.
    """
    ranges = written(thin.groupBy("source", "range").agg(F.sum("size").alias("n")), "ranges")
    by = budgets(ranges.groupBy("source").agg(F.sum("n").alias("source_size")))
    budget = F.floor(F.col("target") + 0.5).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(floor(target + 0.5) as long) div source_size")).otherwise(F.lit(0).cast("long"))
    by = written(by.withColumn("epochs", epochs).withColumn("left", budget - epochs * F.col("source_size")), "budgets")

    def meet(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
        r = right.select(F.col("source").alias("s"), *columns)
        return left.join(r, F.col("source").eqNullSafe(F.col("s"))).drop("s")

    half = F.substring("range", 1, DIGITS // 2)
    coarse = written(_ends(meet(ranges, by, ["left"]), half).withColumnRenamed("cut", "head"), "coarse")
    fine = meet(ranges, coarse, ["head", "left"]).where(half == F.col("head")).drop("head")
    cut = written(_ends(fine, F.col("range")), "cuts").withColumnRenamed("source", "s")
    return written(by.drop("left").join(cut, F.col("source").eqNullSafe(F.col("s")), "left").drop("s"), "goals")


def _placed(rows: DataFrame, by: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` (source, range, ...) with their source's goal: those before or behind its cut (column extra: whole or not), and those in it."""
    g = by.withColumnRenamed("source", "s")
    both = rows.join(g, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    sure = both.where(~F.coalesce(F.col("range") == F.col("cut"), F.lit(False)))
    return sure.withColumn("extra", F.coalesce(F.col("range") < F.col("cut"), F.lit(False))), both.where(F.col("range") == F.col("cut"))


def _in_cut(rows: DataFrame) -> DataFrame:
    """Rows of the ranges that the budgets end in, with ``part``: what is taken of each beyond whole epochs."""
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.coalesce(F.sum("size").over(inside), F.lit(0)))))


def mix(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target, taken for each row of ``docs`` (doc_id, text, source).

    Sizes are words (null text: 0). Null is a source of its own. The key is the md5 of
    seed and doc_id, ties are ordered by doc_id and size, so reruns agree; exact
    repeats may share what is left of a budget either way, and rows of one doc_id lie in
    one range. A source without words takes nothing. ``budgets`` orders the table of
    sources (one row each) in one task. Other columns are ignored; an empty table gives no rows.
    """
    key, head = _prefix(seed)
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    thin = written(docs.select("doc_id", "source", size.alias("size"), key.alias("key"), head.alias("range")), "sizes")
    sure, edge = _placed(thin, goals(thin))
    sure = sure.withColumn("part", F.when(F.col("extra"), F.col("size")).otherwise(0)).drop("extra")
    both = sure.unionByName(_in_cut(edge))
    return both.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken"))


def first_words(text: str, n: int) -> str:
    """The text up to the end of its n-th word."""
    end = 0
    for k, m in enumerate(re.finditer(WORD, text)):
        if k >= n:
            break
        end = m.end()
    return text[:end]


def mixed(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, the last time cut to the exact rest; same columns, whatever their names.

    Rows of which nothing is taken go. Texts stay where they are, but for those of the range that a budget ends in.
    """
    own = {c: c if c in ("doc_id", "source", "text") else f"in_{i}" for i, c in enumerate(docs.columns)}
    d = docs.select(*[docs[c].alias(n) for c, n in own.items()])
    key, head = _prefix(seed)
    count = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    by = goals(d.select("source", count.alias("size"), head.alias("range")))
    sure, edge = _placed(d.withColumn("range", head), by)
    back = [F.col(n).alias(c) for c, n in own.items()]
    times = (F.col("epochs") + F.col("extra").cast("long")).cast("int")
    whole = sure.where(F.col("text").rlike(WORD)).withColumn("turn", F.explode(F.when(times > 0, F.sequence(F.lit(1), times)))).select(*back)
    m = _in_cut(edge.withColumn("key", key).withColumn("size", count))
    m = m.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs"))))
    n = F.when(F.col("turn") < F.col("epochs"), F.col("size")).otherwise(F.col("part"))
    m = written(m.withColumn("n", n).where("n > 0"), "cut")
    part = F.pandas_udf(lambda t, k: pd.Series([first_words(x, y) for x, y in zip(t, k, strict=True)]), "string")
    cut = m.where("n < size").withColumn("text", part("text", F.col("n").cast("int")))
    if "n_chars" in docs.columns:
        cut = cut.withColumn(own["n_chars"], F.length("text").cast(docs.schema["n_chars"].dataType))
    return whole.unionByName(m.where("n = size").select(*back)).unionByName(cut.select(*back))


SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                  md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w
      FROM d GROUP BY source),
c AS (SELECT *, source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(cap) OVER u, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER u, 0)) AS level FROM c
      WINDOW u AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(level, cap / w) AS level FROM l WHERE cap > level * w),
t AS (SELECT l.source, source_size, CASE WHEN f.level IS NULL OR cap <= f.level * w THEN cap ELSE f.level * w END AS target FROM l CROSS JOIN f),
p AS (SELECT d.*, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS budget,
             CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken
FROM e"""
