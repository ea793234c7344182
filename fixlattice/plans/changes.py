"""Queries over deltas and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from fixlattice.operators import deltas as D
from fixlattice.operators import graph as R
from fixlattice.plans.logs import K
from fixlattice.session import table


def _deltas(spark, sf):
    """Events as delta programs of their users: purchases add, errors exclude, all else overrides; the path is k mod 10."""
    op = F.when(F.col("event_type") == "purchase", "add").when(F.col("event_type") == "error", "exclude").otherwise("override")
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", K().alias("k"))
    return e.select(F.col("user_id").alias("program"), F.col("event_id").alias("seq"), op.alias("op"), (F.col("k") % 10).cast("string").alias("path"), F.col("k").cast("string").alias("value"))


def _short(spark, sf):
    """The first three deltas of each hour of a user: programs short enough to succeed at times."""
    from pyspark.sql import Window

    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts", K().alias("k"))
    op = F.when(F.col("event_type") == "purchase", "add").when(F.col("event_type") == "error", "exclude").otherwise("override")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return e.select((F.col("user_id") * 100000 + F.floor(n / 3)).alias("program"), F.col("event_id").alias("seq"), op.alias("op"), (F.col("k") % 10).cast("string").alias("path"), F.col("k").cast("string").alias("value"))


def delta_fuse(spark, sf):
    return D.fuse(_short(spark, sf)).select("program", "path", "op", "value", "n", "reason")


def delta_compose(spark, sf):
    return D.compose(_short(spark, sf)).select("program", "path", "op", "value", "pos", "status")


def delta_apply(spark, sf):
    base = spark.createDataFrame([(str(i), str(-i)) for i in range(5)], "path string, value string")
    return D.apply_programs(_short(spark, sf), base).select("program", "path", "value", "status", "abort_seq", "reason")


def delta_apply_trees(spark, sf):
    d = _short(spark, sf).withColumn("path", F.array(F.concat(F.lit("p"), (F.col("path").cast("int") % 3).cast("string")), F.col("path")))
    return D.apply_trees(d, {"p0": {"0": 1}, "p1": {"1": 2}})


def delta_apply_nested(spark, sf):
    """Programs whose paths overlap: a third of them names a container itself."""
    k = F.col("path").cast("int")
    top = F.concat(F.lit("p"), (k % 3).cast("string"))
    d = _short(spark, sf).withColumn("path", F.when(F.col("seq") % 3 == 0, F.array(top)).otherwise(F.array(top, F.col("path"))))
    base = spark.createDataFrame([(["p0", "0"], "1"), (["p1", "1"], "2"), (["p2"], "3")], "path array<string>, value string")
    return D.apply_nested(d, base).select("program", F.array_join("path", ".").alias("path"), "value", "status", "abort_seq", "reason")


def delta_overlaps(spark, sf):
    d = _short(spark, sf).withColumn("path", F.when(F.col("path").cast("int") % 2 == 0, F.array(F.lit("p"), F.col("path"))).otherwise(F.array(F.lit("p"))))
    return D.overlapping(d).select("program", F.array_join("path", ".").alias("path"), F.array_join("prefix", ".").alias("prefix"))


def delta_crossover(spark, sf):
    g = D.fuse(_short(spark, sf)).where("reason IS NULL").select("program", "path", "op", "value")
    a = g.withColumnRenamed("program", "pair")
    b = g.select((F.col("program") - 1).alias("pair"), "path", "op", "value")
    return D.crossover(a, b, ["pair"])


def genome_ids(spark, sf):
    d = _short(spark, sf).withColumn("path", F.array("path"))
    return D.canonical_json(d).select("program", D.genome_id(F.col("ops")).alias("id"))


def _nation_edges(spark, sf):
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    cust = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    supp = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    j = line.join(orders, "l_orderkey").join(cust, "o_custkey").join(supp, "l_suppkey")
    return R.combine_wiring((j.groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.count("*").alias("w")), 1))


def wiring_nation(spark, sf):
    return _nation_edges(spark, sf).select("src", "dst", F.col("w").cast("bigint").alias("w"))


def _assigned(spark, sf, cluster):
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("node"), cluster.alias("cluster"))


def modularity_region(spark, sf):
    return R.modularity(_nation_edges(spark, sf), _assigned(spark, sf, F.col("n_regionkey"))).select(F.round("q", 9).alias("q"))


def modularity_singletons(spark, sf):
    return R.modularity(_nation_edges(spark, sf), _assigned(spark, sf, F.col("n_nationkey"))).select(F.round("q", 9).alias("q"))


def modularity_one(spark, sf):
    return R.modularity(_nation_edges(spark, sf), _assigned(spark, sf, F.lit(0))).select((F.round("q", 9) + 0.0).alias("q"))


def move_to_mass(spark, sf):
    return R.move_to_mass(_nation_edges(spark, sf), _assigned(spark, sf, F.col("n_regionkey"))).select("node", "cluster", F.col("mass").cast("bigint").alias("mass"))


def merge_hottest(spark, sf):
    return R.merge_hottest(_nation_edges(spark, sf), _assigned(spark, sf, F.col("n_regionkey"))).select("a", "b", F.col("w").cast("bigint").alias("w"))


def coactivation(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("trace"), F.col("event_id").alias("seq"), F.col("event_type").alias("name"))
    return R.coactivation(e, F.col("name").isin("click", "purchase", "signup"))


def learn_clusters(spark, sf):
    return R.learn_clusters(_nation_edges(spark, sf))[0]


def emit_clusters(spark, sf):
    return R.emit_clusters(_assigned(spark, sf, F.concat(F.lit("r_"), F.col("n_regionkey"))))


_SHORT = """e AS (SELECT event_id, user_id, event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events),
d AS (SELECT CAST(user_id * 100000 + n // 3 AS BIGINT) AS program, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'add' WHEN 'error' THEN 'exclude' ELSE 'override' END AS op, CAST(k % 10 AS VARCHAR) AS path, CAST(k AS VARCHAR) AS value FROM e),
f AS (SELECT program, path, min_by(op, seq) AS op, max_by(value, seq) AS value, min(seq) AS first_seq, count(*) AS n, count(*) FILTER (op = 'exclude') AS nx, count(*) FILTER (op = 'add') AS na FROM d GROUP BY 1, 2),
fused AS (SELECT *, CASE WHEN n > 1 AND nx > 0 THEN 'exclude_among_others' WHEN n > 1 AND na - CASE WHEN op = 'add' THEN 1 ELSE 0 END > 0 THEN 'add_after_first' END AS reason FROM f)"""
_EDGES = """j AS (SELECT c_nationkey AS a, s_nationkey AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey),
edges AS (SELECT least(a, b) AS src, greatest(a, b) AS dst, count(*) AS w FROM j WHERE a <> b GROUP BY 1, 2), both_ AS (SELECT src AS node, dst AS other, w FROM edges UNION ALL SELECT dst, src, w FROM edges)"""


def _q(cluster):
    return f"WITH {_EDGES}, asg AS (SELECT n_nationkey AS node, {cluster} AS cluster FROM nation), m AS (SELECT CAST(sum(w) AS DOUBLE) AS m FROM edges), i AS (SELECT a.cluster, sum(w) AS inside FROM edges JOIN asg a ON src = a.node JOIN asg b ON dst = b.node WHERE a.cluster = b.cluster GROUP BY 1), g AS (SELECT cluster, sum(w) AS degree FROM both_ JOIN asg USING (node) GROUP BY 1) SELECT round(sum(coalesce(inside, 0) / m - pow(degree / (2 * m), 2)), 9) + 0.0 AS q FROM g LEFT JOIN i USING (cluster), m"


QUERIES = {f.__name__: f for f in (delta_fuse, delta_compose, delta_apply, delta_apply_trees, delta_apply_nested, delta_overlaps, delta_crossover, genome_ids, wiring_nation, modularity_region, modularity_singletons, modularity_one, move_to_mass, merge_hottest, coactivation, learn_clusters, emit_clusters)}
ORACLES = {
    "delta_fuse": f"WITH {_SHORT} SELECT program, path, op, value, n, reason FROM fused",
    "delta_compose": f"WITH {_SHORT} SELECT program, path, op, value, CAST(row_number() OVER (PARTITION BY program ORDER BY first_seq) - 1 AS INT) AS pos, CASE WHEN bool_or(reason IS NOT NULL) OVER (PARTITION BY program) THEN 'refused' ELSE 'ok' END AS status FROM fused",
    "delta_apply": f"WITH {_SHORT}, base AS (SELECT CAST(i AS VARCHAR) AS path, CAST(-i AS VARCHAR) AS value FROM range(5) t(i)), m AS (SELECT d.*, coalesce(lag(op) OVER (PARTITION BY program, path ORDER BY seq) <> 'exclude', b.path IS NOT NULL) AS was FROM (SELECT * FROM d) d LEFT JOIN base b USING (path)), x AS (SELECT *, (op = 'add' AND was) OR (op = 'exclude' AND NOT was) AS bad FROM m), s AS (SELECT program, min(seq) FILTER (bad) AS abort_seq, min_by(CASE op WHEN 'add' THEN 'present' ELSE 'absent' END, seq) FILTER (bad) AS reason FROM x GROUP BY 1), k AS (SELECT x.program, path, max_by(op, seq) AS op, max_by(value, seq) AS value FROM x JOIN s USING (program) WHERE abort_seq IS NULL OR seq < abort_seq GROUP BY 1, 2), b2 AS (SELECT program, path, value FROM s, base), u AS (SELECT coalesce(k.program, b2.program) AS program, coalesce(k.path, b2.path) AS path, CASE WHEN k.op IS NOT NULL THEN k.value ELSE b2.value END AS value, k.op FROM b2 FULL JOIN k ON b2.program = k.program AND b2.path = k.path) SELECT u.program, path, value, CASE WHEN abort_seq IS NULL THEN 'ok' ELSE 'refused' END AS status, abort_seq, reason FROM u JOIN s USING (program) WHERE op IS DISTINCT FROM 'exclude'",
    "delta_apply_nested": f"""WITH {_SHORT}, o AS (SELECT program, seq, op, value, 'p' || CAST(path AS INT) % 3 AS top, CASE WHEN seq % 3 <> 0 THEN path END AS leaf FROM d),
base AS (SELECT * FROM (VALUES ('p0', '0', '1'), ('p1', '1', '2'), ('p2', NULL, '3')) t(top, leaf, value)),
-- before each operation: the last one that touched its top, and the last one on its own path
m AS (SELECT o.*, (SELECT max_by(CASE WHEN x.leaf IS NOT NULL THEN 'container' WHEN x.op = 'exclude' THEN 'absent' ELSE 'leaf' END, x.seq) FROM o x WHERE x.program = o.program AND x.top = o.top AND x.seq < o.seq) AS top_kind,
  (SELECT max(x.seq) FROM o x WHERE x.program = o.program AND x.top = o.top AND x.leaf IS NULL AND x.seq < o.seq) AS top_cut,
  (SELECT max_by(x.op, x.seq) FROM o x WHERE x.program = o.program AND x.top = o.top AND x.leaf = o.leaf AND x.seq < o.seq) AS leaf_op,
  (SELECT max(x.seq) FROM o x WHERE x.program = o.program AND x.top = o.top AND x.leaf = o.leaf AND x.seq < o.seq) AS leaf_seq FROM o),
k AS (SELECT m.*, coalesce(top_kind, CASE WHEN top = 'p2' THEN 'leaf' ELSE 'container' END) AS tk,
  CASE WHEN leaf_seq IS NOT NULL THEN leaf_op <> 'exclude' AND leaf_seq > coalesce(top_cut, -1) ELSE top_cut IS NULL AND (top, leaf) IN (SELECT (top, leaf) FROM base WHERE leaf IS NOT NULL) END AS has_leaf FROM m),
x AS (SELECT *, CASE WHEN leaf IS NULL THEN CASE WHEN op = 'add' AND tk <> 'absent' THEN 'present' WHEN op = 'exclude' AND tk = 'absent' THEN 'absent' END
  WHEN tk = 'leaf' THEN 'not_a_container' WHEN op = 'exclude' AND tk = 'absent' THEN 'absent' WHEN op = 'add' AND has_leaf THEN 'present' WHEN op = 'exclude' AND NOT has_leaf THEN 'absent' END AS bad FROM k),
s AS (SELECT program, min(seq) FILTER (bad IS NOT NULL) AS abort_seq, min_by(bad, seq) FILTER (bad IS NOT NULL) AS reason FROM x GROUP BY 1),
kept AS (SELECT o.* FROM o JOIN s USING (program) WHERE abort_seq IS NULL OR seq < abort_seq
  UNION ALL SELECT program, -1, 'override', value, top, leaf FROM s, base),
cuts AS (SELECT program, top, max(seq) AS cut FROM kept WHERE leaf IS NULL GROUP BY 1, 2),
leaves AS (SELECT program, top, leaf, max_by(op, seq) AS op, max_by(value, seq) AS value, max(seq) AS touched FROM kept WHERE leaf IS NOT NULL GROUP BY 1, 2, 3),
alive AS (SELECT program, top, leaf, value FROM leaves LEFT JOIN cuts USING (program, top) WHERE op <> 'exclude' AND touched > coalesce(cut, -2)),
tops AS (SELECT program, top, max_by(CASE WHEN leaf IS NOT NULL THEN 'container' WHEN op = 'exclude' THEN 'absent' ELSE 'leaf' END, seq) AS kind, max_by(value, seq) AS value FROM kept GROUP BY 1, 2),
t AS (SELECT program, top || '.' || leaf AS path, value FROM alive UNION ALL SELECT program, top, value FROM tops WHERE kind = 'leaf'
  UNION ALL SELECT program, top, '{{}}' FROM tops WHERE kind = 'container' AND (program, top) NOT IN (SELECT (program, top) FROM alive))
SELECT program, path, value, CASE WHEN abort_seq IS NULL THEN 'ok' ELSE 'refused' END AS status, abort_seq, reason FROM t JOIN s USING (program)""",
    "delta_overlaps": f"WITH {_SHORT}, p AS (SELECT DISTINCT program, CASE WHEN CAST(path AS INT) % 2 = 0 THEN 'p.' || path ELSE 'p' END AS path FROM d) SELECT a.program, a.path, b.path AS prefix FROM p a JOIN p b ON a.program = b.program AND b.path = 'p' AND a.path <> 'p'",
    "delta_crossover": f"WITH {_SHORT}, g AS (SELECT program, path, op, value FROM fused WHERE reason IS NULL), a AS (SELECT program AS pair, path, op, value FROM g), b AS (SELECT program - 1 AS pair, path, op, value FROM g), j AS (SELECT coalesce(a.pair, b.pair) AS pair, coalesce(a.path, b.path) AS path, a.op AS ao, a.value AS av, b.op AS bo, b.value AS bv, a.pair IS NOT NULL AND b.pair IS NOT NULL AND (a.op <> b.op OR a.value <> b.value) AS conflict FROM a FULL JOIN b ON a.pair = b.pair AND a.path = b.path) SELECT pair, path, CASE WHEN NOT conflict THEN coalesce(ao, bo) END AS op, CASE WHEN NOT conflict THEN coalesce(av, bv) END AS value, conflict FROM j",
    "genome_ids": f"""WITH {_SHORT} SELECT program, 'g_' || substr(sha256('[' || string_agg('["' || op || '", ["' || path || '"], ' || value || ']', ', ' ORDER BY seq) || ']'), 1, 16) AS id FROM d GROUP BY 1""",
    "wiring_nation": f"WITH {_EDGES} SELECT * FROM edges",
    "modularity_region": _q("n_regionkey"),
    "modularity_singletons": _q("n_nationkey"),
    "modularity_one": _q("0"),
    "move_to_mass": f"WITH {_EDGES}, asg AS (SELECT n_nationkey AS node, n_regionkey AS cluster FROM nation), x AS (SELECT both_.node, t.cluster, CAST(sum(w) AS BIGINT) AS mass FROM both_ JOIN asg o ON both_.node = o.node JOIN asg t ON other = t.node WHERE t.cluster <> o.cluster GROUP BY 1, 2) SELECT node, cluster, mass FROM x QUALIFY row_number() OVER (PARTITION BY node ORDER BY mass DESC, cluster) = 1",
    "merge_hottest": f"WITH {_EDGES}, asg AS (SELECT n_nationkey AS node, n_regionkey AS cluster FROM nation) SELECT least(a.cluster, b.cluster) AS a, greatest(a.cluster, b.cluster) AS b, CAST(sum(w) AS BIGINT) AS w FROM edges JOIN asg a ON src = a.node JOIN asg b ON dst = b.node WHERE a.cluster <> b.cluster GROUP BY 1, 2 ORDER BY w DESC, 1, 2 LIMIT 3",
    "coactivation": "WITH e AS (SELECT user_id, event_id, event_type AS dst, last_value(CASE WHEN event_type IN ('click', 'purchase', 'signup') THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS src FROM events) SELECT src, dst, count(*) AS w FROM e WHERE dst IN ('click', 'purchase', 'signup') AND src IS NOT NULL AND src <> dst GROUP BY 1, 2",
    "emit_clusters": "WITH g AS (SELECT n_regionkey AS r, string_agg('    # ' || n_nationkey, chr(10) ORDER BY CAST(n_nationkey AS VARCHAR)) AS body FROM nation GROUP BY 1) SELECT 'r_' || r AS cluster, CAST(r AS VARCHAR) AS class_name, 'class ' || r || ':' || chr(10) || body AS text FROM g",
}
