"""Clusters of integer vectors by exact rounds of assignment, with centroids filtered by n-simplex projection.

Some of the first centroids are pivots. A point's distances to them fix the apex of a
simplex over the pivots' own: its coordinates in their hull, and its height above the
hull. With y the coordinates and h the height,

    |y - y'|^2 + (h - h')^2  <=  squared distance  <=  |y - y'|^2 + (h + h')^2

Apexes of all vectors are computed once and written; in each round only those of the
centroids are new. A centroid whose lower bound is over the least upper bound cannot be nearest; of those left
the one with the least lower bound is compared exactly, and then all whose lower bound
does not exceed that distance, in integers. Rounds read the written table and
bring a row for each centroid and component to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy, written

SIZE, SCALE, CENTROIDS, ROUNDS, PIVOTS, SEED = 64, 256, 40, 5, 40, 2
LIMIT = 2.0**54  # of a component: beyond it the integer does not fit 62 bits
EXACT = 1 << 27  # of integers whose squared distances fit 64 bits, over 64 components
FLAT = 1e-3  # a pivot that is nearer to the hull of those before, as a share of the largest distance, is none
SLACK = 1e-7  # of bounds, as a share of the largest coordinate: far over the rounding of 64-bit floats
RESULTS = "cluster int, distance long"


class Projection:
    """Apexes over pivots chosen from ``points`` (integers, a row each): each the one farthest from the hull of those before."""

    def __init__(self, points: np.ndarray, most: int):
        p = points.astype(np.float64)
        self.pivots, self.edges = points[:1], np.zeros((0, 0))  # edges: lower triangle of the pivots' coordinates
        for _ in range(min(most, len(points)) - 1):
            height = self.apexes(points)[:, -1]
            far = int(np.argmax(height))
            if height[far] <= FLAT * np.sqrt(((p - p[0]) ** 2).sum(axis=1).max()):
                break
            y = self.apexes(points[far : far + 1])[0]
            n = len(self.edges)
            edges = np.zeros((n + 1, n + 1))
            edges[:n, :n], edges[n] = self.edges, y
            self.pivots, self.edges = np.vstack([self.pivots, points[far]]), edges

    def apexes(self, x: np.ndarray) -> np.ndarray:
        """Coordinates of each row of x, the height last, from its distances to the pivots alone."""
        d = np.stack([((x - p).astype(np.float64) ** 2).sum(axis=1) for p in self.pivots], axis=1)
        own = (self.edges**2).sum(axis=1)  # squared distances of the other pivots to the first
        y = np.zeros((len(x), len(self.edges)))
        right = (d[:, :1] + own - d[:, 1:]) / 2
        for i in range(len(own)):  # forward substitution
            y[:, i] = (right[:, i] - y[:, :i] @ self.edges[i, :i]) / self.edges[i, i]
        height = np.sqrt(np.maximum(d[:, 0] - (y * y).sum(axis=1), 0))
        return np.hstack([y, height[:, None]])


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows, as 64-bit integers or, where these might overflow, as Python's."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) >= EXACT:
        x, c = x.astype(object), c.astype(object)
    return ((x - c) ** 2).sum(axis=1)


def nearest(x: np.ndarray, apex: np.ndarray, centroids: np.ndarray, tops: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each row (ties: the smaller number), its squared distance, and the number of exact distances computed."""
    y, h, cy, ch = apex[:, :-1], apex[:, -1:], tops[:, :-1], tops[:, -1]
    hull = (y * y).sum(axis=1)[:, None] + (cy * cy).sum(axis=1) - 2 * y @ cy.T
    scale = max(float((apex * apex).sum(axis=1).max(initial=0)), float((tops * tops).sum(axis=1).max()), 1.0)
    low, high = hull + (h - ch) ** 2 - SLACK * scale, hull + (h + ch) ** 2 + SLACK * scale
    possible = low <= high.min(axis=1)[:, None]
    first = np.argmin(low, axis=1)
    rows = np.arange(len(x))
    best = squares(x, centroids[first])
    possible &= low <= best.astype(np.float64)[:, None] * (1 + SLACK)
    possible[rows, first] = False
    i, c = np.nonzero(possible)
    at, who = np.concatenate([rows, i]), np.concatenate([first, c])
    all_d = np.concatenate([best, squares(x[i], centroids[c])])
    if all_d.dtype == object:
        order = np.array(sorted(range(len(at)), key=lambda k: (at[k], all_d[k], who[k])), np.int64)
    else:
        order = np.lexsort((who, all_d, at))
    one = order[np.flatnonzero(np.diff(at[order], prepend=-1))]
    return who[one].astype(np.int32), all_d[one], len(all_d)


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(n, -1)


def kept(vectors: DataFrame, size: int = SIZE) -> DataFrame:
    """vec_id and x, the integer components, of rows that have all ``size`` components, finite and within LIMIT."""
    v = vectors.select(vectors["vec_id"].alias("vec_id"), vectors["embedding"].cast("array<double>").alias("e"))
    sound = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LIMIT))
    return v.where((F.size("e") == size) & sound).select("vec_id", F.transform("e", lambda x: F.floor(x * SCALE)).alias("x"))


def with_apexes(rows: DataFrame, projection: Projection) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                apex = projection.apexes(_matrix(b.column("x"), np.int64))
                flat = pa.ListArray.from_arrays(np.arange(b.num_rows + 1, dtype=np.int32) * apex.shape[1], apex.ravel())
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("x"), flat], ["vec_id", "x", "apex"])

    return rows.mapInArrow(run, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, x array<long>, apex array<double>")


def _sums(centroids: np.ndarray, tops: np.ndarray):
    """Arrow batches (x, apex) to the number and component sums of a task's rows for each centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(centroids), np.int64), np.zeros((2, *centroids.shape), np.int64)  # of the upper and the lower 32 bits
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("x"), np.int64)
                own = nearest(x, _matrix(b.column("apex"), float), centroids, tops)[0]
                n += np.bincount(own, minlength=len(n))
                order = np.argsort(own, kind="stable")
                there, at = np.unique(own[order], return_index=True)
                for part, bits in zip(total, (x >> 32, x & 0xFFFFFFFF), strict=True):
                    part[there] += np.add.reduceat(bits[order], at)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), *(pa.array(part[some].tolist(), pa.list_(pa.int64())) for part in total)], ["cluster", "n", "upper", "lower"])

    return run


def _assigned(centroids: np.ndarray, tops: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                own, d, _ = nearest(_matrix(b.column("x"), np.int64), _matrix(b.column("apex"), float), centroids, tops)
                fits = d if d.dtype != object else [v if v < 1 << 63 else None for v in d]
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(own), pa.array(fits, pa.int64())], ["vec_id", "cluster", "distance"])

    return run


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, pivots: int = PIVOTS, seed: int = SEED, size: int = SIZE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for each vector of ``vectors`` (vec_id, embedding) that is kept.

    Kept are vectors of exactly ``size`` components, none null, non-finite or of 2^54 or more in magnitude. The first centroids are the ``k`` vectors (all, if there are fewer) of the least
    hash of seed and vec_id; rows of one vec_id are ordered by their components, and rows without a vec_id come last.
    Each row is a vector of its own, repeated or not. Distances and sums that do not fit 64 bits are null (no distance above 2^63 is part of a sum), but assignments are exact. Other
    columns are ignored; without a vector there are no rows.
    """
    spark = vectors.sparkSession
    rows = kept(vectors, size)
    chosen = rows.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("hash"), "x").orderBy(F.asc_nulls_last("hash"), "x").limit(k).collect()
    kind = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, {RESULTS}"
    if not chosen:
        return spark.createDataFrame([], f"{kind}, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r["x"] for r in chosen], np.int64)
    projection = Projection(centroids, pivots)
    state = written(with_apexes(rows, projection), "apexes")
    for _ in range(rounds):
        part = state.select("x", "apex").mapInArrow(_sums(centroids, projection.apexes(centroids)), "cluster int, n long, upper array<long>, lower array<long>")
        part = part.select("cluster", "n", F.posexplode(F.arrays_zip("upper", "lower")).alias("at", "s")).select("cluster", "n", "at", "s.upper", "s.lower")
        whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
        centroids = centroids.copy()
        for r in part.groupBy("cluster", "at").agg(whole("n"), whole("upper"), whole("lower")).collect():  # k times size rows
            centroids[r["cluster"], r["at"]] = ((int(r["upper"]) << 32) + int(r["lower"])) // int(r["n"])
    out = written(state.mapInArrow(_assigned(centroids, projection.apexes(centroids)), kind), "assigned")
    tidy(state)
    fits = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).try_cast("long")
    names = spark.createDataFrame([(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())], "cluster int, centroid_sha256 string")
    sums = out.groupBy("cluster").agg(fits("distance").alias("cluster_inertia")).join(F.broadcast(names), "cluster").crossJoin(out.agg(fits("distance").alias("inertia")))
    return out.join(F.broadcast(sums), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """The rounds as common table expressions."""
    d = "CAST(list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
    parts = [f"""kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {SIZE})""",
             f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (SELECT sha256('{SEED}:' || vec_id) AS h, v FROM kept ORDER BY h LIMIT {CENTROIDS}))"]
    for r in range(ROUNDS + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, v, m % {CENTROIDS} AS c, m // {CENTROIDS} AS d FROM (SELECT vec_id, k.v, min(CAST({d} AS HUGEINT) * {CENTROIDS} + c.c) AS m FROM kept k, c{r} c GROUP BY ALL))")
        if r < ROUNDS:
            parts.append(f"""c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(n.v, c.v) AS v FROM c{r} c LEFT JOIN (SELECT c, list((s - (s % n + n) % n) // n ORDER BY i) AS v FROM
(SELECT c, i, CAST(sum(x) AS HUGEINT) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY c, i) GROUP BY c) n ON n.c = c.c)""")
    return f"""WITH {', '.join(parts)} SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.c = a.c"""


SQL = _sql()
