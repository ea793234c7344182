"""Wiring graphs: undirected edges, modularity, and moves that improve a clustering."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fixlattice.operators.segments import cut


def combine_wiring(*directed: tuple[DataFrame, float]) -> DataFrame:
    """(src, dst, w) with src < dst: the directed (src, dst, w) tables, each scaled, summed both ways; self-edges go."""
    parts = [df.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), (F.col("w") * F.lit(scale)).alias("w")) for df, scale in directed]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.where("src <> dst").groupBy("src", "dst").agg(F.sum("w").alias("w"))


def modularity(edges: DataFrame, assign: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Q = sum over clusters of in/m - (deg/2m)^2 for each candidate ``by`` (columns of assign); 0 without weight.

    Endpoints that a candidate doesn't assign count in m alone. Three hash aggregates, no scan of edges for each cluster.
    """
    by = by or []
    m = edges.agg(F.coalesce(F.sum("w"), F.lit(0)).cast("double").alias("m"))
    a = assign.select(*by, F.col("node").alias("src"), F.col("cluster").alias("c1"))
    b = assign.select(*by, F.col("node").alias("dst"), F.col("cluster").alias("c2"))
    inside = edges.join(a, "src").join(b, ["dst", *by]).where("c1 = c2").groupBy(*by, F.col("c1").alias("cluster")).agg(F.sum("w").alias("inside"))
    ends = edges.select(F.col("src").alias("node"), "w").union(edges.select("dst", "w")).groupBy("node").agg(F.sum("w").alias("w"))
    degree = ends.join(assign.select(*by, "node", "cluster"), "node").groupBy(*by, "cluster").agg(F.sum("w").alias("degree"))
    parts = degree.join(inside, [*by, "cluster"], "left").crossJoin(F.broadcast(m))  # m is one row
    q = F.sum(F.when(F.col("m") > 0, F.coalesce(F.col("inside"), F.lit(0)) / F.col("m") - F.pow(F.col("degree") / (2 * F.col("m")), 2)).otherwise(0.0))
    out = parts.groupBy(*by).agg(q.alias("q")) if by else parts.agg(F.coalesce(q, F.lit(0.0)).alias("q"))
    return out


def neighbors(edges: DataFrame) -> DataFrame:
    """(node, other, w) both ways."""
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), "w").union(edges.select("dst", "src", "w"))


def move_to_mass(edges: DataFrame, assign: DataFrame) -> DataFrame:
    """For each node the foreign cluster of greatest wiring mass (ties: least name): (node, cluster, mass)."""
    n = neighbors(edges).join(assign.select(F.col("node").alias("other"), F.col("cluster").alias("to")), "other")
    own = n.join(assign.select("node", F.col("cluster").alias("own")), "node").where("to <> own")
    mass = own.groupBy("node", "to").agg(F.sum("w").alias("mass"))
    return mass.groupBy("node").agg(F.min(F.struct((-F.col("mass")).alias("less"), F.col("to").alias("cluster"), "mass")).alias("top")).select("node", "top.cluster", "top.mass")


def merge_hottest(edges: DataFrame, assign: DataFrame, k: int = 3) -> DataFrame:
    """The k heaviest pairs of clusters: (a, b, w), ties by names."""
    e = edges.join(assign.select(F.col("node").alias("src"), F.col("cluster").alias("c1")), "src").join(assign.select(F.col("node").alias("dst"), F.col("cluster").alias("c2")), "dst").where("c1 <> c2")
    return e.groupBy(F.least("c1", "c2").alias("a"), F.greatest("c1", "c2").alias("b")).agg(F.sum("w").alias("w")).orderBy(F.desc("w"), "a", "b").limit(k)


def coactivation(calls: DataFrame, bank, order: str = "seq", by: str = "trace") -> DataFrame:
    """(src, dst, w): for each banked call the nearest banked call before it in its trace; self pairs go. ``bank`` is a condition.

    The last banked call is looked for in a segment of the trace; where there is none, it is the last one of the segments before."""
    segments = cut(calls, [by], order)
    banked = F.when(bank, F.col("name"))
    none = F.lit(None).cast(calls.schema["name"].dataType)
    rows = segments.with_carry(segments.rows, {"last": F.max_by(banked, F.when(bank, F.col(order)))}, none, lambda held, s: F.coalesce(s["last"], held))
    before = F.last(banked, ignorenulls=True).over(segments.window().rowsBetween(Window.unboundedPreceding, -1))
    pairs = rows.withColumn("src", F.coalesce(before, "_carry")).where(bank & F.col("src").isNotNull() & (F.col("src") != F.col("name")))
    return pairs.groupBy("src", F.col("name").alias("dst")).agg(F.count("*").alias("w"))


def learn_clusters(edges: DataFrame, rounds: int = 8, brood: int = 8, seed: int = 13, keep_best: bool = True) -> tuple[DataFrame, list[float]]:
    """(node, cluster) and the modularity after each round: singletons improved by proposals that follow the wiring.

    Each round proposes up to six moves of nodes and three merges of clusters and scores all of them in one job. The driver holds
    the proposals and scores of a round alone; assignments stay tables.
    """
    from fixlattice.plans.checkpoints import cut as written

    rng, spark = random.Random(seed), edges.sparkSession
    edges = written(edges)
    assign = written(neighbors(edges).select("node").distinct().withColumn("cluster", F.concat(F.lit("r_"), F.col("node").cast("string"))))
    best_q, trail = modularity(edges, assign).first()["q"] or 0.0, []
    for _ in range(rounds):
        # six of all nodes' moves, drawn by a hash that each round seeds anew
        drawn = move_to_mass(edges, assign).orderBy(F.xxhash64("node", F.lit(rng.getrandbits(62))), "node").limit(6)
        moves = [("move", r["node"], r["cluster"]) for r in drawn.collect()]
        merges = [("merge", r["b"], r["a"]) for r in merge_hottest(edges, assign).collect()]
        proposals = [(i, *p) for i, p in enumerate((moves + merges)[:brood])]
        if not proposals:
            break
        p = spark.createDataFrame([(i, kind, str(what), str(to)) for i, kind, what, to in proposals], "pos int, kind string, what string, into string")
        changed = assign.crossJoin(F.broadcast(p))  # as many copies as a brood has members
        hit = ((F.col("kind") == "move") & (F.col("node").cast("string") == F.col("what"))) | ((F.col("kind") == "merge") & (F.col("cluster") == F.col("what")))
        candidates = changed.select("pos", "node", F.when(hit, F.col("into")).otherwise(F.col("cluster")).alias("cluster"))
        scores = sorted(((r["q"], -r["pos"]) for r in modularity(edges, candidates, ["pos"]).collect()), reverse=True)
        q, pos = scores[0][0], -scores[0][1]
        if keep_best and q <= best_q:
            trail.append(best_q)
            continue
        best_q = q
        assign = written(candidates.where(F.col("pos") == pos).select("node", "cluster"))
        trail.append(best_q)
    return assign, trail


def emit_clusters(assign: DataFrame) -> DataFrame:
    """(cluster, class_name, text): a class of each cluster, members sorted; text alone, never executed."""
    g = assign.groupBy("cluster").agg(F.array_sort(F.collect_list(F.col("node").cast("string"))).alias("members"))
    name = F.initcap(F.regexp_replace("cluster", "^r_", ""))
    body = F.array_join(F.transform("members", lambda x: F.concat(F.lit("    # "), x)), "\n")
    return g.select("cluster", name.alias("class_name"), F.concat(F.lit("class "), name, F.lit(":\n"), body).alias("text"))
