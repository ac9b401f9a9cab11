"""Lempel-Ziv phrase fingerprints.

A text is parsed from left to right into the shortest phrases not met before; the set of
phrases is hashed, and SIZE minimum hashes of it are the fingerprint. The share of equal
minima estimates the Jaccard similarity of the phrase sets, which behaves like a
compression distance: texts that share long stretches share phrases.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tasks_for

SIZE = 128
RANGES, SAMPLE = 50_000, 2_000_000  # of doc_ids, at most; ids that place their bounds
_rng = np.random.default_rng(5)
_MUL = (_rng.integers(1, 2**31, SIZE, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_ADD = _rng.integers(0, 2**32 - 1, SIZE, dtype=np.uint32)


def phrases(text: str, known: set[str], start: int = 0) -> tuple[int, list[str]]:
    """Add the phrases of text[start:] to ``known``; where the unfinished last phrase (a known one) begins, and the new phrases."""
    add, n, end, new = known.add, len(text), start + 1, []
    while end <= n:
        p = text[start:end]
        if p not in known:
            add(p)
            new.append(p)
            start = end
        end += 1
    return start, new


def minima(new: list[str]) -> np.ndarray:
    """SIZE minimum hashes of phrases; that of a union is the smaller one at each place."""
    out = np.full(SIZE, 0xFFFFFFFF, np.uint32)
    digest = xxhash.xxh32_intdigest
    h = np.fromiter((digest(p.encode("utf-8", "surrogatepass")) for p in new), np.uint32, len(new))
    for at in range(0, len(h), 512):  # hashes are mixed already, so their order under odd multiples is random
        v = h[None, at : at + 512] * _MUL[:, None]
        v += _ADD[:, None]
        np.minimum(out, v.min(axis=1), out=out)
    return out


def _print(text: str, least: np.ndarray) -> np.ndarray:
    """A text's fingerprint: the lower 16 bits of each minimum; empty for the empty text.

    A minimum over n phrases is about 2^32 / n, so its upper bits vanish as a text grows.
    By the lower ones minima of unrelated sets are equal by a chance of 2^-16, or n / 2^33 where that is more
    (over 2^17 phrases; 2^-13 at 2^20).
    """
    return (least & np.uint32(0xFFFF)).astype("<u2") if text else np.empty(0, "<u2")


def fingerprint(text: str | None) -> np.ndarray:
    """Minimum hashes of a text's phrases; a text without phrases (null, empty) has none."""
    return _print(text or "", minima(phrases(text or "", set())[1]))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal minima; 1 for two empty texts, 0 for an empty and another."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return float((a == b).mean())


def _edited(text: str, nxt: str) -> tuple[str, np.ndarray, np.ndarray]:
    """The text with its last half replaced by the next one's beginning, and both fingerprints.

    Both share their first half, so it is parsed and hashed once.
    """
    half = len(text) // 2
    head = text[: len(text) - half]
    edited = head + nxt[:half]
    known: set[str] = set()
    begun, new = phrases(head, known)
    shared, other = minima(new), set(known)
    prints = [_print(t, np.minimum(shared, minima(phrases(t, own, begun)[1]))) for t, own in ((text, known), (edited, other))]
    return edited, prints[0], prints[1]


def with_next(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, own, doc_id, text): rows by ranges of doc_id; each range ends with a copy (own false) of the first row of the next.

    After the last row comes the first. Only range bounds and one id for each range
    reach the driver, RANGES at most; each text is shuffled once. Bounds are quantiles of the ids whose hash is in a
    sample of about SAMPLE; they are about balance only, so results do not depend on it.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    low = -(2**63)
    key = F.coalesce("doc_id", F.lit(low))
    buckets = min(buckets, RANGES)
    sample = d.where(F.pmod(F.xxhash64(key), F.lit(docs.count() // SAMPLE + 1)) == 0)
    cuts = sample.select(F.percentile_approx(key, F.lit([i / buckets for i in range(1, buckets)]), F.lit(max(10_000, 20 * buckets)))).first()[0] or []
    cuts = np.array(sorted(set(cuts)), np.int64)

    @F.pandas_udf("long")
    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids.to_numpy(), side="right"))

    d = d.withColumn("bucket", place(key))
    firsts = sorted((r["bucket"], r["first"]) for r in d.groupBy("bucket").agg(F.min(key).alias("first")).collect())
    if not firsts:
        return d.withColumn("own", F.lit(True)).withColumn("at", F.lit(low))
    heads = np.array([f for _, f in firsts], np.int64)
    before = np.array([firsts[i - 1][0] for i in range(len(firsts))], np.int64)

    @F.pandas_udf("long")
    def head_of(ids: pd.Series) -> pd.Series:
        """The bucket that a range's first row ends, else null."""
        at = np.minimum(np.searchsorted(heads, ids.to_numpy()), len(heads) - 1)
        return pd.Series(before[at]).where(heads[at] == ids.to_numpy()).astype("Int64")

    own = F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(True).alias("own")))
    copy = F.array(F.struct(F.col("ends").alias("bucket"), F.lit(False).alias("own")))
    return (d.withColumn("at", key).withColumn("ends", head_of("at")).withColumn("to", F.explode(F.when(F.col("ends").isNotNull(), F.concat(own, copy)).otherwise(own)))
            .select("to.bucket", "to.own", "at", "doc_id", "text"))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket, own rows first, then doc_id and text: each own row meets the next row of its bucket."""
    held, waiting, rows = None, None, []

    def name(x: np.ndarray) -> str:
        return x.tobytes().hex()

    def batch() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                          ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    for b in batches:
        for bucket, own, doc_id, text in zip(*(b.column(c).to_pylist() for c in ("bucket", "own", "doc_id", "text")), strict=True):
            same = held is not None and held[0] == bucket
            if same:
                edited, f, g = _edited(held[2], text)
                if waiting is not None:
                    rows.append((*waiting[0], likeness(waiting[1], f)))
                waiting = ((held[1], len(held[2]), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), name(f), name(g), likeness(f, g)), f)
            if own:
                if not same and waiting is not None:  # a bucket ended: its last row's next one is at hand
                    waiting = None
                held = (bucket, doc_id, text)
            else:
                if waiting is not None:
                    rows.append((*waiting[0], likeness(waiting[1], fingerprint(text))))
                held = waiting = None
            if len(rows) >= 1_000:
                yield batch()
                rows = []
    if rows:
        yield batch()


def fingerprints(docs: DataFrame) -> DataFrame:
    """The fingerprint of every text (null: empty), of its edited text, and their likeness to each other and to the next text's.

    Edited: the last floor(n_chars / 2) code points replaced by as many first ones (or
    all) of the next row by doc_id; after the last row comes the first, so a single row
    is its own next. Null doc_ids come first; rows of the same doc_id are ordered by
    text. Other columns are ignored; an empty table gives no rows.
    """
    tasks = tasks_for(docs)
    dealt = with_next(docs, 4 * tasks)
    kinds = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double")
    return (dealt.repartition(tasks, "bucket").sortWithinPartitions("bucket", F.desc("own"), "at", "text")
            .select("bucket", "own", "doc_id", "text").mapInArrow(_walk, kinds))
