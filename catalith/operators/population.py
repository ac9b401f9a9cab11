"""Population selection: match policies, quality predicates, evidence, classes, funnel and sample."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.ledger import counted_write
from ..sources.scratch import delete

POLICIES = ("nearest", "reciprocal")
STAGES = ("matched", "complete", "error_qualified", "focal", "second", "third", "labelled")


@dataclass(frozen=True)
class ClassRule:
    """Code equals ``code`` and magnitude in the closed range."""

    name: str
    code: int
    low: float
    high: float

    def column(self, code: Column, magnitude: Column) -> Column:
        return (code == self.code) & magnitude.between(self.low, self.high)


def apply_policy(edges: DataFrame, policy: str) -> DataFrame:
    """Edges (candidate_rank, reference_rank) of a policy: nearest of each reference, or nearest both ways."""
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy}")
    first = edges.where("reference_rank = 1")
    return first if policy == "nearest" else first.where("candidate_rank = 1")


def complete(columns: Sequence[str], sentinels: Sequence[float] = ()) -> Column:
    """All columns have a value that is no sentinel."""
    one = lambda c: F.col(c).isNotNull() & ~F.coalesce(F.col(c).isin(list(sentinels)), F.lit(False)) if sentinels else F.col(c).isNotNull()
    return reduce(lambda a, b: a & b, map(one, columns), F.lit(True))


def within_error(columns: Sequence[str], limit: float) -> Column:
    """All errors have a value of at most ``limit``."""
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() & (F.col(c) <= limit) for c in columns], F.lit(True))


def has_evidence(df: DataFrame, key: str, sources: Sequence[tuple[DataFrame, str]], name: str) -> DataFrame:
    """``df`` with boolean ``name``: the key is in any of the evidence tables. Repeated evidence multiplies no rows."""
    out = df.withColumn(name, F.lit(False))
    for k, (evidence, column) in enumerate(sources):
        flag = f"__seen{k}"
        seen = evidence.where(F.col(column).isNotNull()).select(F.col(column).alias(key)).distinct().withColumn(flag, F.lit(True))
        out = out.join(seen, key, "left").withColumn(name, F.col(name) | F.coalesce(flag, F.lit(False))).drop(flag)
    return out


def classified(population: DataFrame, focal: str = "is_focal", second: str = "is_second", third: str = "is_third") -> Column:
    """Class by precedence focal, second, third; null if none."""
    return F.when(F.col(focal), "focal").when(F.col(second), "second").when(F.col(third), "third")


def _stages() -> list[Column]:
    q, focal = F.col("error_qualified"), F.col("is_focal")
    second, third = F.col("is_second") & ~focal, F.col("is_third") & ~focal & ~F.coalesce(F.col("is_second"), F.lit(False))
    return [F.count("*").alias("matched"), F.count_if(F.col("complete")).alias("complete"), F.count_if(q).alias("error_qualified"),
            F.count_if(q & focal).alias("focal"), F.count_if(q & second).alias("second"), F.count_if(q & third).alias("third"),
            F.count_if(q & classified(None).isNotNull()).alias("labelled")]


def funnel(population: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts of the stages in one pass over the population (complete, error_qualified, is_focal, is_second, is_third)."""
    return population.groupBy(*by).agg(*_stages()) if by else population.agg(*_stages())


def against_expected(counts: DataFrame, expected: Mapping[str, int]) -> DataFrame:
    """stage, found, expected, difference (null where nothing is expected) of a one-row funnel."""
    pairs = F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).alias("found"), F.lit(expected.get(s)).cast("long").alias("expected")) for s in STAGES])
    return counts.select(F.inline(pairs)).withColumn("difference", F.col("found") - F.col("expected"))


def members(population: DataFrame) -> DataFrame:
    """The sample: qualified and classified rows with target_class, split unassigned, weight 1."""
    p = population.withColumn("target_class", classified(population)).where("error_qualified and target_class is not null")
    return p.withColumn("split", F.lit("unassigned")).withColumn("weight", F.lit(1.0))


def require_labelled(counts: Mapping[str, int]) -> None:
    """The sample has as many rows as the funnel labels."""
    if counts["rows"] != counts["labelled"]:
        raise ValueError(f"{counts['rows']} members, but the funnel labels {counts['labelled']}")


def publish_members(population: DataFrame, path: str) -> dict[str, int]:
    """Write the sample, and return the funnel's counts and its rows; both are gathered in the write, and where they differ nothing stays."""
    seen = Observation()
    counts = counted_write(members(population.observe(seen, *_stages())), path)
    counts = {s: seen.get[s] for s in STAGES} | counts
    try:
        require_labelled(counts)
    except ValueError:
        delete(population.sparkSession, path)
        raise
    return counts


def class_counts(sample: DataFrame, classes: Sequence[str]) -> DataFrame:
    """target_class, n; 0 for a class without members."""
    spark = sample.sparkSession
    every = spark.createDataFrame([(c,) for c in classes], "target_class string")
    n = sample.groupBy("target_class").agg(F.count("*").alias("n"))
    return every.join(n, "target_class", "left").select("target_class", F.coalesce("n", F.lit(0)).alias("n"))


def sample_lookup(samples: DataFrame, sample: DataFrame) -> DataFrame:
    """name, members for every named sample, 0 for an empty one; a name that is not there has no row."""
    n = sample.groupBy("name").agg(F.count("*").alias("n"))
    return samples.select("name").join(n, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("members"))
