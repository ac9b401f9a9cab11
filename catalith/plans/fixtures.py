"""Catalogues, populations and measurements derived from the test tables, in Spark and as SQL text for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import population as pop
from ..operators import spatial
from ..sources.scratch import tasks_for, written

RADIUS = 4.0
BANDS = ("u", "g", "r", "i", "z", "y")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _position(k: str, ra: str, dec: str) -> tuple[str, str]:
    half = f"CAST(floor({k}/2) AS BIGINT)"
    return f"((({half}*7919) % 36000)/1e2 + {ra} + 3.6e2) % 3.6e2", f"(({half}*104729) % 12000)/1e2 - 6e1 + {dec}"


REF_RA, REF_DEC = _position("p_partkey", "(p_partkey%2)*1.1e-3", "(p_partkey%2)*7e-4")
TAR_RA, TAR_DEC = _position("o_custkey", "((o_orderkey*31)%41-20)*1e-4", "((o_orderkey*17)%37-18)*5e-5")

SKY = f"""ref AS (SELECT p_partkey AS id, {REF_RA} AS ra, {REF_DEC} AS dec FROM part),
tar AS (SELECT o_orderkey AS id, {TAR_RA} AS ra, {TAR_DEC} AS dec FROM orders)"""

_V = "cos(radians(dec))*cos(radians(ra)) AS {0}x, cos(radians(dec))*sin(radians(ra)) AS {0}y, sin(radians(dec)) AS {0}z"
EDGES = SKY + f""",
rv AS (SELECT id AS ref, dec AS rd, {_V.format("p")} FROM ref), tv AS (SELECT id AS target, dec AS td, {_V.format("q")} FROM tar),
pairs AS (SELECT ref, target, atan2(sqrt((py*qz-pz*qy)*(py*qz-pz*qy)+(pz*qx-px*qz)*(pz*qx-px*qz)+(px*qy-py*qx)*(px*qy-py*qx)), px*qx+py*qy+pz*qz)*206264.80624709636e0 AS s
          FROM rv JOIN tv ON td BETWEEN rd - 2e-3 AND rd + 2e-3),
edges AS (SELECT ref, target, sep, count(*) OVER (PARTITION BY target) AS candidate_count, row_number() OVER (PARTITION BY target ORDER BY sep, ref) AS candidate_rank,
                 row_number() OVER (PARTITION BY ref ORDER BY sep, target) AS reference_rank
          FROM (SELECT ref, target, round(s, 6) AS sep FROM pairs WHERE s <= 4e0))"""


def catalogues(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    ref = table(spark, sf, "part").selectExpr("p_partkey AS id", f"{REF_RA} AS ra", f"{REF_DEC} AS dec")
    tar = table(spark, sf, "orders").selectExpr("o_orderkey AS id", f"{TAR_RA} AS ra", f"{TAR_DEC} AS dec")
    return ref, tar


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    ref, tar = catalogues(spark, sf)
    return spatial.radius_pairs(ref, tar, RADIUS)


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.reference_ranked(spatial.ranked(pairs(spark, sf), spatial.DIGITS))


def ranked_edges(spark: SparkSession, sf: str) -> DataFrame:
    """``edges``, where their ranks are asked."""
    return spatial.ranked_edges(*catalogues(spark, sf), RADIUS, spatial.DIGITS)


def nearest(spark: SparkSession, sf: str) -> DataFrame:
    """Each reference's nearest edge, all that policies choose from; written, since several read it."""
    return written(spatial.nearest(pairs(spark, sf), spatial.DIGITS), "nearest")


POPULATION = EDGES + """,
chosen AS (SELECT 'nearest' AS policy, * FROM edges WHERE reference_rank = 1 UNION ALL SELECT 'reciprocal', * FROM edges WHERE reference_rank = 1 AND candidate_rank = 1),
measured AS (SELECT c.*, p_retailprice AS price, CASE WHEN o_orderkey % 11 = 0 THEN 99e0 ELSE o_totalprice END AS total, ((p_partkey*7) % 60)/1e2 AS ref_err, ((o_orderkey*13) % 60)/1e2 AS tar_err,
                    CAST(substring(o_orderpriority, 1, 1) AS INTEGER) AS code
             FROM chosen c JOIN part ON p_partkey = ref JOIN orders ON o_orderkey = target),
focal AS (SELECT doc_id AS k FROM labels WHERE toxic = 1 OR (quality = 1 AND (doc_id % 100)/1e2 > 7.5e-1)
          UNION SELECT s_suppkey FROM supplier WHERE s_acctbal/1e3 >= 3 AND s_nationkey % 5 IN (0, 1)),
flags AS (SELECT *, price IS NOT NULL AND price <> 99 AND total IS NOT NULL AND total <> 99 AS complete, ref IN (SELECT k FROM focal) AS is_focal,
                 code = 3 AND total BETWEEN 50000 AND 400000 AS is_second, code = 1 AND total BETWEEN 20000 AND 300000 AS is_third FROM measured),
population AS (SELECT *, complete AND ref_err <= 5e-1 AND tar_err <= 5e-1 AS error_qualified, CASE WHEN is_focal THEN 'focal' WHEN is_second THEN 'second' WHEN is_third THEN 'third' END AS target_class FROM flags)"""


def evidence_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    labels = table(spark, sf, "labels").where("toxic = 1 OR (quality = 1 AND (doc_id % 100)/1e2 > 7.5e-1)")
    supplier = table(spark, sf, "supplier").where("s_acctbal/1e3 >= 3 AND s_nationkey % 5 IN (0, 1)")
    return labels, supplier


def population(spark: SparkSession, sf: str, policy: str, e: DataFrame | None = None) -> DataFrame:
    """The measured population of a policy, with quality and class flags; of the edges ``e``, if several read the same."""
    e = pop.apply_policy(nearest(spark, sf) if e is None else e, policy)
    part = table(spark, sf, "part").selectExpr("p_partkey AS ref", "p_retailprice AS price", "((p_partkey*7) % 60)/1e2 AS ref_err")
    orders = table(spark, sf, "orders").selectExpr("o_orderkey AS target", "CASE WHEN o_orderkey % 11 = 0 THEN 99e0 ELSE o_totalprice END AS total",
                                                   "((o_orderkey*13) % 60)/1e2 AS tar_err", "CAST(substring(o_orderpriority, 1, 1) AS INTEGER) AS code")
    p = e.join(part, "ref").join(orders, "target")
    labels, supplier = evidence_tables(spark, sf)
    p = pop.has_evidence(p, "ref", [(labels, "doc_id"), (supplier, "s_suppkey")], "is_focal")
    second, third = pop.ClassRule("second", 3, 50000, 400000), pop.ClassRule("third", 1, 20000, 300000)
    p = p.withColumn("complete", pop.complete(["price", "total"], [99.0]))
    p = p.withColumn("error_qualified", F.col("complete") & pop.within_error(["ref_err", "tar_err"], 0.5))
    code, total = F.col("code"), F.col("total")
    return p.withColumn("is_second", second.column(code, total)).withColumn("is_third", third.column(code, total))


BAND_SQL = {"u": "l_quantity", "g": "l_extendedprice", "r": "l_discount", "i": "CASE WHEN l_linenumber % 7 = 0 THEN 99e0 ELSE l_tax*1e1 END",
            "z": "l_extendedprice*l_discount", "y": "l_quantity*l_tax"}
_MEANS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
#: One row for each (l_orderkey, l_linenumber), which the table does not promise.
LINES = "lines AS (SELECT l_orderkey, l_linenumber, " + ", ".join(f"max({c}) AS {c}" for c in _MEANS) + " FROM lineitem GROUP BY l_orderkey, l_linenumber),\n"
WIDE = LINES + "wide AS (SELECT l_orderkey, l_linenumber, " + ", ".join(f"{x} AS {b}, (l_linenumber + {k})/1e2 AS {b}_err" for k, (b, x) in enumerate(BAND_SQL.items())) + ", l_tax AS ebv FROM lines)"
LONG = WIDE + ",\nlong AS (" + " UNION ALL ".join(f"SELECT l_orderkey, l_linenumber, '{b}' AS band, {b} AS mag, {b}_err AS mag_err, ebv FROM wide WHERE {b} IS NOT NULL AND {b} <> 99" for b in BAND_SQL) + ")"
_PAIRS = [(a, b) for i, a in enumerate(BANDS) for b in BANDS[i + 1:]]
FEATURES = LONG + """,
feat AS (SELECT l_orderkey, l_linenumber, band AS name, mag AS value, mag_err AS uncertainty FROM long
         UNION ALL SELECT a.l_orderkey, a.l_linenumber, a.band || '-' || b.band, a.mag - b.mag, sqrt(a.mag_err*a.mag_err + b.mag_err*b.mag_err)
         FROM long a JOIN long b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND strpos('ugrizy', a.band) < strpos('ugrizy', b.band))"""
KEYS = ["l_orderkey", "l_linenumber"]


def wide(spark: SparkSession, sf: str) -> DataFrame:
    cols = [f"{x} AS {b}" for b, x in BAND_SQL.items()] + [f"(l_linenumber + {k})/1e2 AS {b}_err" for k, b in enumerate(BANDS)]
    lines = table(spark, sf, "lineitem").select(*KEYS, *_MEANS)
    lines = lines.repartition(tasks_for(lines), *KEYS).groupBy(*KEYS).agg(*[F.max(c).alias(c) for c in _MEANS])
    return lines.selectExpr(*KEYS, *cols, "l_tax AS ebv")
