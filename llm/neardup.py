"""MinHash near-duplicates: banded candidates, sequential Bayesian pruning, exact check.

Documents are sets of distinct word 5-shingles (lower-case ASCII; words are runs of
other than ASCII white space). Two documents are linked if 100 * intersection >= 75 *
union, always confirmed on the whole sets.

Plan. (1) One pass over the texts gives each document the size, digest and MinHash
signature of its set. (2) Documents of equal sets form one class, represented by its
smallest doc_id, so a group of exact copies of any size is one node. (3) Bands of the
signature give buckets. Each member of a bucket is first paired with HUBS members of it
(those of the least hashes), which is linear in the bucket. (4) Pairs are
compared in batches of the signature and dropped once the posterior probability that
their similarity reaches the threshold is below ``miss``; survivors are checked on
their sets. (5) Connected components. (6) Only pairs that lie in one bucket but still in
different components can add anything: those of small buckets go through (4), large
buckets are compared in blocks of signatures and sets, bounded in rows and bytes, where
survivors are checked at once and only links leave the block, one for each two
components. So no link that joins two components is lost, and no group is expanded
into all its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, tidy, written

WIDTH, ROWS, BANDS, BATCH = 5, 5, 36, 30
PERMS = ROWS * BANDS
THRESHOLD, MISS = 0.75, 1e-5
HUBS, SMALL, BLOCK, BLOCK_BYTES, WORDS_KEPT = 1, 24, 256, 1 << 22, 300_000
_rng = np.random.default_rng(7)
_MUL = (_rng.integers(1, 2**31, PERMS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_ADD = _rng.integers(0, 2**32 - 1, PERMS, dtype=np.uint32)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Word -> 64-bit hash; emptied when it holds WORDS_KEPT words, so memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; empty without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - WIDTH + 1)
    out = np.full(n, len(h) if len(h) < WIDTH else 0, np.uint64)
    for i in range(min(WIDTH, len(h))):
        out = _mix(out + h[i : i + n] + np.uint64(0x9E3779B97F4A7C15))
    return np.unique(out)


def signature(s: np.ndarray) -> np.ndarray:
    """PERMS minima of multiply-add permutations of the shingles' upper 32 bits."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(PERMS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 4096):  # memory stays small for very long texts
        part = x[at : at + 4096]
        for j in range(0, PERMS, 20):
            v = part[None, :] * _MUL[j : j + 20, None] + _ADD[j : j + 20, None]
            v ^= v >> np.uint32(15)
            v *= np.uint32(0x2C1B3C6D)
            np.minimum(out[j : j + 20], v.min(axis=1), out=out[j : j + 20])
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 512):
            part = b.slice(at, 512)
            n, key, sig = [], [], []
            for t in part.column("text").to_pylist():
                s = shingles(t)
                n.append(len(s))
                key.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sig.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary())],
                ["doc_id", "n", "key", "sig"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 512):
            part = b.slice(at, 512)
            sets = [shingles(t).tobytes() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("node"), pa.array(map(xxhash.xxh3_128_digest, sets), pa.binary()), pa.array(sets, pa.binary())],
                ["node", "key", "hashes"])


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets are linked."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x) or 100 * len(x) < 75 * len(y):
        return False
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= 75 * (len(x) + len(y) - both)


def least_matches(t: float = THRESHOLD, miss: float = MISS) -> list[int]:
    """For n = 0, BATCH, 2 BATCH, ...: fewest equal minima that keep a pair of n compared.

    Under a uniform prior the similarity is Beta(m+1, n-m+1) distributed, and
    P(S >= t) = P(Bin(n+1, t) <= m); a pair stays while that is at least ``miss``.
    """
    out = []
    for n in range(0, PERMS + 1, BATCH):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def _survive(a: np.ndarray, b: np.ndarray, least: list[int]) -> np.ndarray:
    """Indices of row pairs (signatures a[i], b[i]) that no batch rules out."""
    left, m = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k in range(PERMS // BATCH):
        part = slice(k * BATCH, (k + 1) * BATCH)
        m = m + (a[left, part] == b[left, part]).sum(axis=1)
        ok = m >= least[k + 1]
        left, m = left[ok], m[ok]
    return left


def _unpack(col: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(col), np.uint32).reshape(len(col), PERMS)


def _likely(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    least = least_matches()
    for pdf in batches:
        if len(pdf):
            yield pdf.iloc[_survive(_unpack(pdf.sig_a), _unpack(pdf.sig_b), least)][["a", "b"]]


def _linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        ok = [_similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(pdf.set_a, pdf.set_b, strict=True)]
        yield pdf.loc[ok, ["a", "b"]]


def _block(pdf: pd.DataFrame) -> pd.DataFrame:
    """Within a block of a bucket: a link of each two components that have one."""
    least = least_matches()
    i, j, band = int(pdf.i.iloc[0]), int(pdf.j.iloc[0]), int(pdf.band.iloc[0])
    sig, comp, node, own = _unpack(pdf.sig), pdf.comp.to_numpy(), pdf.node.to_numpy(), pdf.own.to_numpy()
    sets = [np.frombuffer(h, np.uint64) for h in pdf.hashes]
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    right, found = np.flatnonzero(own == j), {}
    for x in np.flatnonzero(own == i):
        ys = right[(comp[right] != comp[x]) & ((i != j) | (right > x))]
        ys = ys[(100 * n[ys] >= 75 * n[x]) & (100 * n[x] >= 75 * n[ys])]
        ys = ys[_survive(np.broadcast_to(sig[x], (len(ys), PERMS)), sig[ys], least)]
        met = (sig[ys] == sig[x]).reshape(-1, BANDS, ROWS).all(axis=2)
        for y in ys[met.argmax(axis=1) == band]:  # a pair counts in the first bucket that holds both
            pair = min(comp[x], comp[y]), max(comp[x], comp[y])
            if pair not in found and _similar(sets[x], sets[y]):
                found[pair] = node[x], node[y]
    return pd.DataFrame(list(found.values()), columns=["a", "b"], dtype=np.int64)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id long, text string).

    Null and wordless texts have an empty set and link with nothing. Rows of equal sets
    are linked. A set is known by the smallest doc_id that has it, so if rows of one doc_id hold different
    sets and it is the smallest of both, what either links to is one component; n_shingles is each row's own. A row with
    a null doc_id has a null component_id and is kept. Other columns are ignored; an
    empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    used = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        used.append(written(df, name))
        return used[-1]

    signed = written(docs.mapInArrow(_sign, "doc_id long, n long, key binary, sig binary"), "signed")
    known = signed.where("key is not null and doc_id is not null")
    classes = written(known.groupBy("key").agg(F.min("doc_id").alias("node"), F.first("sig").alias("sig"), F.first("n").alias("n")), "classes")
    sigs = classes.select("node", "sig")

    bands = classes.select("node", "n", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda b: F.xxhash64(b, F.substring("sig", b * 4 * ROWS + 1, F.lit(4 * ROWS))))).alias("band", "bucket"))
    seeds = range(HUBS)
    hubs = bands.groupBy("bucket").agg(
        F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("size"),
        F.sum(8 * F.col("n") + 4 * PERMS).alias("bytes"),
        *[F.min(F.struct(F.xxhash64("node", F.lit(k)), "node")).alias(f"h{k}") for k in seeds]).where("lo <> hi")
    hubs = kept(hubs.select("bucket", "size", "bytes", F.array_distinct(F.array(*[f"h{k}.node" for k in seeds])).alias("hubs")), "hubs")
    members = kept(bands.join(hubs, "bucket"), "members")

    def likely(pairs: DataFrame) -> DataFrame:
        a = sigs.select(F.col("node").alias("a"), F.col("sig").alias("sig_a"))
        b = sigs.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"))
        return kept(pairs.join(a, "a").join(b, "b").select("a", "b", "sig_a", "sig_b")
                       .mapInPandas(_likely, "a long, b long"), "likely")

    def sets_of(nodes: DataFrame) -> DataFrame:
        texts = docs.withColumnRenamed("doc_id", "node").join(kept(nodes.distinct(), "need"), "node", "left_semi")
        return kept(texts.mapInArrow(_sets, "node long, key binary, hashes binary"), "sets")

    def linked(pairs: DataFrame) -> DataFrame:
        sets = sets_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")))
        a = sets.select(F.col("node").alias("a"), F.col("hashes").alias("set_a"))
        b = sets.select(F.col("node").alias("b"), F.col("hashes").alias("set_b"))
        return kept(pairs.join(a, "a").join(b, "b").select("a", "b", "set_a", "set_b")
                       .mapInPandas(_linked, "a long, b long"), "linked")

    def ordered(a: str, b: str) -> list:
        return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]

    stars = members.select("node", F.explode("hubs").alias("hub")).select(*ordered("node", "hub")).where("a <> b")
    stars = kept(stars.distinct(), "stars")
    links = linked(likely(stars))
    labels = components(links)
    lab = labels.select("node", F.col("component").alias("comp"))
    placed = members.join(lab, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    placed = kept(placed.select("bucket", "band", "node", "size", "bytes", "comp"), "placed")
    mixed = placed.groupBy("bucket").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("bucket")
    mixed = kept(placed.join(kept(mixed, "mixed"), "bucket"), "mixed")

    low = mixed.where(F.col("size") <= SMALL)
    x, y = (low.select("bucket", F.col("node").alias(n), F.col("comp").alias(f"c{n}")) for n in "ab")
    pairs = x.join(y, "bucket").where("a < b and ca <> cb").select("a", "b").distinct()
    fresh = linked(likely(pairs.join(stars, ["a", "b"], "left_anti")))

    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    high = kept(mixed.where(F.col("size") > SMALL).withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int")), "high")
    cells = high.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cells = cells.select("bucket", "band", "node", "comp", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    sets = sets_of(high.select("node")).groupBy("node", "key").agg(F.first("hashes").alias("hashes"))
    bodies = kept(sets.join(classes.select("node", "key", "sig"), ["node", "key"]).drop("key"), "bodies")
    blocked = kept(cells.join(bodies, "node").groupBy("bucket", "i", "j").applyInPandas(_block, "a long, b long"), "blocked")
    labels = components(links.unionAll(fresh).unionAll(blocked))
    tidy(*used)

    by_key = classes.select("key", "node")
    out = (signed.select("doc_id", "n", "key").join(by_key, "key", "left")
           .withColumn("node", F.coalesce("node", "doc_id")).join(labels, "node", "left"))
    comp = F.coalesce("component", "node")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), comp).alias("component_id"),
                      F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"))
