"""Centroid clustering: Lloyd's rounds with exponion search, in exact integers.

A vector carries the number of its centroid, an upper bound of the distance to it and a lower bound of the distance to every other. When centroids
move the bounds move with them. A vector whose upper bound is below the lower one, or below half the distance from its centroid to the
nearest other, stays without a distance computed. For any other the upper bound is made exact; if that doesn't settle it, only the centroids inside a ball
around its present one are scanned: with u the distance and s the distance to that centroid's nearest other, both nearest centroids lie within 2u + s
of it. Lists of inter-centroid distances, sorted once a round, say which these are; the radius is inclusive, with a hair of room for rounding, so that ties are scanned, and the smaller
number wins them. Bounds are doubles rounded outwards; what decides is compared in exact integers.

A round is one pass without a shuffle: tasks read vectors and bounds, write them anew, and add one row with the sums by which
clusters have changed. Only these, a row for each cluster and component, reach the driver. The table before is deleted then. Each task holds the
centroids and their k x k distances, which bounds k to some thousands.

Vectors are kept if they have exactly ``dim`` components, none of them null or not finite. Null arrays go, too. Repeated rows are vectors of their own. Null ids are
kept; none of them is a first centroid unless there are too few others. Ties of first centroids (one id in several rows) are broken by the components. Fewer vectors than ``k``: every one is
a first centroid. Components of 2^27 or more after scaling are an error, as distances wouldn't fit a long. Extra columns, whatever their names, are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixlattice.llm.ranges import long_array
from fixlattice.llm.store import discard, result, written

DIM = 64
CENTROIDS = 40
ROUNDS = 5
SCALE = 256
LIMIT = 1 << 27
#: Relative room by which bounds are rounded outwards.
ROOM = 1e-9
_STATE = "vec_id long, v array<int>, cluster int, upper double, lower double, distance long, change struct<cluster:int,n:long,sums:array<long>>"


def kept_vectors(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): rows with dim finite components, as floor(scale * x)."""
    x = F.col(vector)
    whole = (F.size(x) == dim) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))

    def scaled(c):
        c = c.cast("double") * scale
        return F.when(F.abs(c) < LIMIT, F.floor(c).cast("int")).otherwise(F.raise_error(F.lit(f"a component times {scale} isn't below 2^27")).cast("int"))

    return embeddings.where(whole).select(F.col(key).cast("long").alias("vec_id"), F.transform(x, scaled).alias("v"))


class Geometry:
    """Centroids with their sorted lists of inter-centroid distances."""

    def __init__(self, centroids: list[list[int]]):
        self.at = np.array(centroids, np.int64)
        k = len(self.at)
        squared = np.array([((self.at - c) ** 2).sum(1) for c in self.at])
        self.order = np.argsort(squared, axis=1, kind="stable")
        self.reach = np.sqrt(np.take_along_axis(squared, self.order, 1).astype(float))
        # the nearest other: the second of a list that begins with 0 for the centroid itself
        self.nearest = self.reach[:, 1] if k > 1 else np.full(k, np.inf)

    def search(self, x: np.ndarray, cluster: np.ndarray, squared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(nearest centroid, its squared distance, lower bound of the others, distances computed) for vectors and their present ones."""
        radius = (2 * np.sqrt(squared.astype(float)) + self.nearest[cluster]) * (1 + ROOM)
        best, found = np.full(len(x), len(self.at), np.int64), np.full(len(x), np.iinfo(np.int64).max)
        second, computed = found.copy(), 0
        for a in np.unique(cluster):
            rows = np.flatnonzero(cluster == a)
            inside = np.searchsorted(self.reach[a], radius[rows], side="right")
            by_ball = np.argsort(-inside, kind="stable")
            rows, inside = rows[by_ball], inside[by_ball]
            for k in range(int(inside[0])):
                some = rows[: np.searchsorted(-inside, -k, side="left")]
                c = self.order[a, k]
                d = ((x[some] - self.at[c]) ** 2).sum(1)
                computed += len(some)
                before, number = found[some], best[some]
                nearer = (d < before) | ((d == before) & (c < number))
                second[some] = np.minimum(second[some], np.where(nearer, before, d))
                best[some], found[some] = np.where(nearer, c, number), np.where(nearer, d, before)
        lower = np.where(second == np.iinfo(np.int64).max, np.inf, np.sqrt(second.astype(float)) * (1 - ROOM))
        return best, found, lower, computed


def settle(geometry: Geometry, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(cluster, upper, lower, distances computed) after one assignment of vectors whose bounds hold."""
    cluster, upper, lower = cluster.copy(), upper.copy(), lower.copy()
    floor = geometry.nearest * (0.5 - ROOM)
    open_ = np.flatnonzero(upper >= np.maximum(lower, floor[cluster]))
    squared = ((x[open_] - geometry.at[cluster[open_]]) ** 2).sum(1)
    computed = len(open_)
    upper[open_] = np.sqrt(squared.astype(float)) * (1 + ROOM)
    left = upper[open_] >= np.maximum(lower[open_], floor[cluster[open_]])
    rows = open_[left]
    if len(rows):
        cluster[rows], found, lower[rows], more = geometry.search(x[rows], cluster[rows], squared[left])
        upper[rows] = np.sqrt(found.astype(float)) * (1 + ROOM)
        computed += more
    return cluster, upper, lower, computed


def _round(centroids: list[list[int]], moved: list[float] | None, last: bool):
    """A pass over vectors and bounds. moved: how far each centroid has gone since the pass before; None: there was none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        geometry, k, dim = Geometry(centroids), len(centroids), len(centroids[0])
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        if moved is not None:
            gone = np.array(moved)
            most = int(np.argmax(gone))
            others = np.full(k, gone[most])
            others[most] = np.max(np.delete(gone, most), initial=0.0)
        schema = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.int32())), ("cluster", pa.int32()), ("upper", pa.float64()), ("lower", pa.float64()), ("distance", pa.int64()), ("change", pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))])
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(n, dim).astype(np.int64)
            if moved is None:
                before = None
                cluster, upper, lower = np.zeros(n, np.int64), np.full(n, np.inf), np.zeros(n)
            else:
                before = batch.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64)
                upper = (batch.column("upper").to_numpy(zero_copy_only=False) + gone[before]) * (1 + ROOM)
                lower = (batch.column("lower").to_numpy(zero_copy_only=False) - others[before]) * (1 - ROOM)
                cluster = before
            cluster, upper, lower, _ = settle(geometry, x, cluster, upper, np.maximum(lower, 0))
            if before is None:
                np.add.at(sums, cluster, x)
                counts += np.bincount(cluster, minlength=k)
            elif len(away := np.flatnonzero(cluster != before)):
                np.add.at(sums, cluster[away], x[away])
                np.subtract.at(sums, before[away], x[away])
                counts += np.bincount(cluster[away], minlength=k) - np.bincount(before[away], minlength=k)
            distance = pa.array(((x - geometry.at[cluster]) ** 2).sum(1)) if last else pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cluster.astype(np.int32)), pa.array(upper), pa.array(lower), distance, pa.nulls(n, schema.field("change").type)], schema=schema)
        touched = np.flatnonzero((counts != 0) | (sums != 0).any(1))
        if len(touched) and not last:
            change = pa.array([{"cluster": int(c), "n": int(counts[c]), "sums": sums[c].tolist()} for c in touched], schema.field("change").type)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(touched), f.type) for f in list(schema)[:-1]] + [change], schema=schema)

    return run


def cluster(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", centroids: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: str = "2") -> tuple[DataFrame, list[list[int]]]:
    """((vec_id, cluster, distance) of each kept vector, final centroids)."""
    spark = embeddings.sparkSession
    vectors = kept_vectors(embeddings, key, vector, dim, scale)
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    firsts = vectors.orderBy(drawn.asc_nulls_last(), "v").limit(centroids).collect()
    if not firsts:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), []
    at = [list(r.v) for r in firsts]
    k = len(at)
    counts, sums = [0] * k, [[0] * dim for _ in range(k)]
    state, moved = vectors, None
    for t in range(rounds + 1):
        keep = result if t == rounds else written
        made = keep(state.mapInArrow(_round(at, moved, t == rounds), _STATE), "centroid-state")
        if moved is not None:
            discard(state)
        state = made.where("change IS NULL").drop("change")
        state._written_path = made._written_path
        if t == rounds:
            break
        change = made.where("change IS NOT NULL").select("change.*")
        for r in change.groupBy("cluster").agg(F.sum("n").alias("n")).collect():
            counts[r.cluster] += r.n
        each = change.select("cluster", F.posexplode("sums").alias("i", "x")).groupBy("cluster", "i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
        for r in each.collect():
            sums[r.cluster][r.i] += int(r.x)
        new = [[x // counts[c] for x in sums[c]] if counts[c] else at[c] for c in range(k)]
        moved = [float(np.sqrt(float(sum((a - b) ** 2 for a, b in zip(p, q))))) * (1 + ROOM) for p, q in zip(at, new)]
        at = new
    return state.select("vec_id", "cluster", "distance"), at


def with_inertia(clustered: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """clustered with cluster_inertia, inertia (sums of distance over a cluster and over all) and centroid_sha256."""
    totals = dict.fromkeys(range(len(centroids)), 0) | {r.cluster: r.x for r in clustered.groupBy("cluster").agg(F.sum("distance").alias("x")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    each = long_array([totals[c] for c in sorted(totals)])
    return clustered.select("vec_id", "cluster", "distance", F.get(each, F.col("cluster")).alias("cluster_inertia"), F.lit(sum(totals.values())).cast("long").alias("inertia"), F.get(F.split(F.lit(",".join(digests)), ","), F.col("cluster")).alias("centroid_sha256"))


def oracle(centroids: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: str = "2") -> str:
    """The clustering as SQL: every round compares each vector with every centroid."""
    near = "list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    steps = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v
    FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim})""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM
    (SELECT sha256('{seed}:' || vec_id) AS h, v FROM kept ORDER BY h, v LIMIT {centroids}))""",
    ]
    for t in range(rounds + 1):
        steps.append(f"""a{t} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT k.r, c.c, {near} AS d FROM kept k, c{t} c) GROUP BY r)""")
        if t < rounds:
            steps.append(f"""s{t} AS (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM
    (SELECT a.c, unnest(range(1, {dim + 1})) AS i, unnest(k.v) AS x FROM a{t} a JOIN kept k USING (r)) GROUP BY c, i)""")
            steps.append(f"""c{t + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.v, o.v) AS v FROM c{t} o LEFT JOIN
    (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM s{t} GROUP BY c) m ON m.c = o.c)""")
    return f"""WITH {", ".join(steps)}
SELECT k.vec_id, a.c::INT AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia,
    sha256(array_to_string(list_transform(c.v, lambda x: x::VARCHAR), ',')) AS centroid_sha256
FROM a{rounds} a JOIN kept k USING (r) JOIN c{rounds} c ON c.c = a.c"""


ORACLE = oracle()
