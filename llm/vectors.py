"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosine checks.

Normalised vectors are projected on random Gaussian directions and quantised; DEPTH
quantised projections are a bucket key, in each of TABLES tables. On the sphere a
cosine c is a distance sqrt(2 - 2c), for which the chance to share a bucket is known, and
the number of tables follows from it, the threshold and the chance to miss a pair at
it (``plan``); pairs of greater cosine are missed less. Members of a bucket are compared
in blocks; a pair counts only in the first table that holds it together, which both
members' keys tell, so counts need no list of pairs. Instead of all pairs, a block
yields each member's number of links and, for the components, a spanning forest.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, tasks_for, tidy, written

THRESHOLD, WIDTH, MISS, BLOCK = 0.93, 2.0, 1e-3, 128


def collide(distance: float, width: float = WIDTH) -> float:
    """Chance that one quantised Gaussian projection of two points at a distance is the same."""
    r = width / distance
    below = 0.5 * (1 + math.erf(-r / math.sqrt(2)))
    return 1 - 2 * below - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(rows: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """(depth, tables): depth so that orthogonal vectors of a table of ``rows`` meet about 16 others in a bucket at most."""
    near, far = collide(math.sqrt(2 - 2 * threshold)), collide(math.sqrt(2))
    depth = max(4, math.ceil(math.log(max(rows, 2) / 16) / -math.log(far)))
    return depth, math.ceil(math.log(miss) / math.log(1 - near**depth))


def near_vectors(vectors: DataFrame, label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``vectors`` (vec_id long, embedding array of numbers, label).

    Only vectors of equal label are compared. Vectors that are null, empty, zero or hold
    null or non-finite components, and those of a null label, link with nothing; so do
    vectors of different lengths. Rows of equal vector and label are one class whose
    members are all linked, however many they are. Rows of the same vec_id are distinct
    rows, and count each other if alike. A row with a null vec_id counts as another's
    link and has a null component_id of its own. An empty table gives no rows.
    """
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("x"), F.col(label).alias("label"))
    fine = F.col("label").isNotNull() & (F.size("x") > 0) & ~F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists("x", lambda e: e != 0)
    v = v.withColumn("key", F.when(F.coalesce(fine, F.lit(False)), F.concat(F.xxhash64("label", "x").cast("string"), F.lit(":"), F.md5(F.to_json(F.struct("label", "x"))))))
    classes = v.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("id"), F.count("*").alias("size"), F.first("x").alias("x"), F.first("label").alias("label"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    rows = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    depth, tables = plan(rows)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng, planes = np.random.default_rng(3), {}
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                part = pdf.iloc[at : at + 1000]
                for n, own in part.groupby(part.x.map(len)):
                    if n not in planes:
                        rng = np.random.default_rng([3, n])
                        planes[n] = rng.standard_normal((n, depth * tables)), rng.uniform(0, WIDTH, depth * tables)
                    x = np.array(own.x.tolist(), float)
                    x /= np.abs(x).max(axis=1)[:, None]
                    x /= np.linalg.norm(x, axis=1)[:, None]
                    a, b = planes[n]
                    q = np.floor((x @ a + b) / WIDTH).astype(np.int16).reshape(len(x), tables, depth)
                    lab = [f"{n}:{t!r}:".encode() for t in own.label]
                    keys = [[xxhash.xxh3_64_intdigest(row[t].tobytes(), t + 1) ^ s & 0xFFFFFFFFFFFFFFFF for t in range(tables)]
                            for row, s in zip(q, map(xxhash.xxh3_64_intdigest, lab), strict=True)]
                    yield pd.DataFrame({"node": own.node, "size": own["size"], "unit": [r.tobytes() for r in x], "sketch": sketches(x),
                                        "keys": [np.array(k, np.uint64).tobytes() for k in keys]})

    h = written(classes.select("node", "size", "x", F.col("label").cast("string").alias("label")).mapInPandas(hashed, "node long, size long, unit binary, sketch binary, keys binary"), "hashed")
    thin = h.select("node", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(tables - 1)), lambda t: F.xxhash64(t, F.substring("keys", t * 8 + 1, F.lit(8))))).alias("table", "bucket"))
    full = written(thin.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1"), "buckets")
    met = thin.join(full, "bucket")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    met = met.withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    met = met.select("node", "table", "own", F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), (F.col("own") == F.col("other")).alias("inner"))
    # each sketch is sent about once for each table, a vector only where it can have a link
    tasks = tasks_for(h.select("node", "sketch")) * max(1, tables // 8)
    met = met.join(h.select("node", "sketch"), "node").repartition(tasks, "cell").sortWithinPartitions("cell")
    near = written(met.mapInPandas(lambda b: _cells(b, _possible), "node long, table int, own int, cell long, inner boolean"), "near")
    near = near.join(h.select("node", "size", "unit", "keys"), "node").repartition(tasks, "cell").sortWithinPartitions("cell")
    found = written(near.mapInPandas(lambda b: _cells(b, _compare), "node long, links long, to long"), "found")

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    comp = components(found.where("to is not null").select(F.col("node").alias("a"), F.col("to").alias("b")))
    by = classes.select("key", "node", "id", "size").join(links, "node", "left").join(comp, "node", "left")
    by = by.withColumn("component", F.coalesce("component", "node"))
    least = by.groupBy("component").agg(F.min("id").alias("component_id"))
    by = written(by.join(least, "component").select("key", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n"), "component_id"), "classes")
    tidy(classes, h, full, found)
    v = v.withColumn("key", F.coalesce("key", F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))))
    out = v.select("vec_id", "key").join(by, "key", "left")
    c = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), c.alias("component_id"), F.coalesce(c == F.col("vec_id"), F.lit(True)).alias("kept"))


def sketches(x: np.ndarray) -> list[bytes]:
    """Unit vectors as bytes: step and length of the rounding (two floats of 64 bits), then a signed byte for each component."""
    step = np.abs(x).max(axis=1)[:, None] / 127
    q = np.rint(x / step)
    off = np.linalg.norm(x - q * step, axis=1)[:, None]
    return [h.tobytes() + r.tobytes() for h, r in zip(np.hstack([step, off]), q.astype(np.int8), strict=True)]


def _cells(batches: Iterator[pd.DataFrame], each: Callable[[pd.DataFrame], pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cells come one after the other; ``each`` gets whole ones."""
    held = None
    for pdf in batches:
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        cut = int(np.flatnonzero((pdf.cell == pdf.cell.iloc[-1]).to_numpy())[0]) if len(pdf) else 0
        held = pdf.iloc[cut:]
        if cut:
            yield each(pdf.iloc[:cut])
    if held is not None and len(held):
        yield each(held)


def _starts(pdf: pd.DataFrame) -> list[tuple[int, int]]:
    cell = pdf.cell.to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    return list(zip(starts.tolist(), [*starts[1:].tolist(), len(pdf)], strict=True))


def _possible(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows that by their sketches may have a link in their cell."""
    pdf = pdf.reset_index(drop=True)
    keep, own = np.zeros(len(pdf), bool), pdf.own.to_numpy()
    for lo, hi in _starts(pdf):
        raw = pdf.sketch.iloc[lo:hi].tolist()
        if len({len(r) for r in raw}) > 1:  # vectors of another length, by a collision of hashes
            keep[lo:hi] = True
            continue
        raw = np.frombuffer(b"".join(raw), np.uint8).reshape(hi - lo, -1)
        step, off = np.ascontiguousarray(raw[:, :16]).view(np.float64).T
        x = np.ascontiguousarray(raw[:, 16:]).view(np.int8) * step[:, None]
        near = x @ x.T + (off[:, None] * (1 + off) + off) >= THRESHOLD - 1e-9
        np.fill_diagonal(near, False)
        if not pdf.inner.iloc[lo]:
            near &= own[lo:hi, None] != own[lo:hi]
        keep[lo:hi] = near.any(axis=1)
    return pdf.loc[keep, ["node", "table", "own", "cell", "inner"]]


def _compare(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links of each row to others of its cell (across its two blocks, or within its one), and a spanning forest."""
    pdf = pdf.reset_index(drop=True)
    n_dim = len(pdf.unit.iloc[0])
    node, size, own, table = (pdf[c].to_numpy() for c in ("node", "size", "own", "table"))
    keys = np.frombuffer(b"".join(pdf["keys"]), np.uint64).reshape(len(pdf), -1)
    links, edges = np.zeros(len(pdf), np.int64), []
    even = bool((pdf.unit.map(len) == n_dim).all())
    units = np.frombuffer(b"".join(pdf.unit), float).reshape(len(pdf), -1) if even else None
    for lo, hi in _starts(pdf):
        x = units[lo:hi] if even else np.frombuffer(b"".join(pdf.unit.iloc[lo:hi]), float).reshape(hi - lo, -1)
        inner = bool(pdf.inner.iloc[lo])
        i, j = np.nonzero(np.triu(x @ x.T >= THRESHOLD, 1))
        ok = inner | (own[lo:hi][i] != own[lo:hi][j])
        i, j = i[ok] + lo, j[ok] + lo
        first = (keys[i] == keys[j]).argmax(axis=1) == table[i]  # pairs count in the first table that holds both
        i, j = i[first], j[first]
        np.add.at(links, i, size[j])
        np.add.at(links, j, size[i])
        top = {}  # a spanning forest of the cell's links
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            while a in top:
                a = top[a]
            while b in top:
                b = top[b]
            if a != b:
                top[max(a, b)] = min(a, b)
                edges.append((node[max(a, b)], node[min(a, b)]))
    counted = pd.DataFrame({"node": node, "links": links, "to": pd.array([None] * len(node), "Int64")})
    counted = counted[counted.links > 0]
    forest = pd.DataFrame(edges, columns=["node", "to"], dtype="int64").assign(links=0)
    return pd.concat([counted, forest[["node", "links", "to"]].astype({"to": "Int64"})], ignore_index=True)
