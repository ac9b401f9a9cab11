"""A corpus pipeline of five operators: each stage's result is written and read again as the next one's documents.

All stages but the last return the columns of documents, whatever other columns there are and whatever
they are called. Null texts are empty texts to every stage: they are scored as clean, link with nothing,
repeat nothing, take no part in a mix (which has no words to take) and so reach no sequence. Null doc_ids and
sources pass; a null source is a source of its own. Rows that repeat another are one group of copies, of which
one row stays; ties go to the smallest doc_id, then to the text's hash. An empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import mixing, neardup, packing, repeats, toxicity
from llm.common import shared_dir, tidy, written
from llm.queries import PASSAGE, TOKENIZER


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold; the lexicon is learned from the table labels, held-out ones left out.

    A text's score depends on nothing but the text, so null, empty, tied and repeated rows are kept or go alike.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    lexicon = toxicity.learn(docs, labels.where(~toxicity.held_out("doc_id")))
    return docs.where(toxicity.probability("text", lexicon) < toxicity.THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: of the smallest doc_id (null last), then of the least text hash.

    Every row is judged by its own text, so repeated rows and rows with a null doc_id
    leave one, too. Wordless rows link with nothing; of those equal in doc_id and text one stays.
    """
    own = {c: f"column{i}" for i, c in enumerate(docs.columns)}  # any name may come in
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), *[docs[c].alias(n) for c, n in own.items()]), "rows")
    doc_id, text = own["doc_id"], own["text"]
    judged = neardup.near_duplicates(rows.select(F.col("row").alias("doc_id"), F.col(text).alias("text")))
    judged = judged.select(F.col("doc_id").alias("row"), F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("component"))
    known = rows.select("row", F.col(doc_id).isNull().alias("last"), F.col(doc_id).alias("id"), F.xxhash64(text, F.length(text)).alias("hash"))
    alone = F.when(F.col("component").isNull(), F.struct("id", "hash"))
    kept = known.join(judged, "row").groupBy("component", alone.alias("alone")).agg(F.min(F.struct("last", "id", "hash", "row")).alias("least"))
    return rows.join(kept.select("least.row"), "row", "left_semi").select(*[F.col(n).alias(c) for c, n in own.items()])


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated passages; those of which only white space is left go."""
    own = {c: c if c == "text" else f"column{i}" for i, c in enumerate(docs.columns)}  # any name may come in
    out = repeats.remove_repeats(docs.select(*[docs[c].alias(n) for c, n in own.items()]), texts=True, length=PASSAGE)
    out = out.where((F.col("n_removed") == 0) | F.col("kept_text").rlike(r"\S"))
    if "n_chars" in own:
        n = own["n_chars"]
        out = out.withColumn(n, F.when(F.col("n_removed") > 0, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(n)))
    return out.withColumn("text", F.col("kept_text")).select(*[F.col(n).alias(c) for c, n in own.items()])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences: doc_id and the packing's columns. Null and empty texts are their end id alone; repeated rows are packed each."""
    return packing.pack(docs.select("doc_id", "text"), TOKENIZER)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("repeats", drop_repeats), ("mixing", mix_sources), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents, each stage written as Parquet and read again; what a stage has read is deleted once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    old = None
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if old is not None:
            tidy(old)
        old = docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
