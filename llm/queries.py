"""One query for each operator, over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, lzprint, mixing, neardup, packing, pagediff, preference, repeats, simplex, toxicity, urltree, vectors, warc

PASSAGE = 200  # bytes; over 50 words are seldom fewer
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_LEVEL, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held = toxicity.held_out("doc_id")
    lexicon = toxicity.learn(docs, labels.where(~held))
    out = toxicity.score(docs, lexicon)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lzprint.fingerprints(_table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents").select("doc_id", "text"), TOKENIZER)


def op5_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = preference.format_pairs(*preference.pairs_of(_table(spark, sf_dir, "conversations")))

    def trained(mask: str):
        return F.aggregate(mask, F.lit(0).cast("long"), lambda n, s: n + F.when(s["train"], s["length"]).otherwise(0))

    return out.select("pair_id", "n_prompt_turns", "prompt", "chosen", "rejected",
                      preference.mask_text("chosen_mask").alias("chosen_mask"), preference.mask_text("rejected_mask").alias("rejected_mask"),
                      trained("chosen_mask").alias("chosen_trained"), trained("rejected_mask").alias("rejected_trained"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urltree.judge(_table(spark, sf_dir, "pages"))


def op9_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(_table(spark, sf_dir, "embeddings"))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), also=PASSAGE)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(_table(spark, sf_dir, "documents"), BYTE_LEVEL, PIECES)


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagediff.main_texts(_table(spark, sf_dir, "pages"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simplex.cluster(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_warc, op3_fingerprints, op4_packing, op5_preference, op6_mixing,
                                    op7_near_dedup, op8_url_filter, op9_vector_dedup, op10_repeats, op11_token_alignment, op12_main_text, op13_centroid_clusters)}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": warc.SQL, "op5_preference": preference.SQL, "op6_mixing": mixing.SQL, "op13_centroid_clusters": simplex.SQL}
