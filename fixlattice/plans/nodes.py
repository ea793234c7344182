"""Queries over node requests, projects, driven states and ring documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from fixlattice.functions import dims as V
from fixlattice.operators import nodes as N
from fixlattice.plans.logs import _LOG, _U, K, _pick, _user_masks, as_log
from fixlattice.session import table
from fixlattice.sources import codecs as W


def _requests(spark, sf):
    """Events as node requests of their users: clicks cool, purchases advance, views bring rites; all others are unknown."""
    k = F.col("k")
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", K().alias("k"))
    action = F.when(F.col("event_type") == "click", "cool").when(F.col("event_type") == "purchase", "advance").when(F.col("event_type") == "view", "rite").otherwise("other")
    what = F.when(F.col("event_type") == "click", F.coalesce(V.nth(V.COOLING, k % 9), F.lit("nothing"))).when(F.col("event_type") == "view", F.coalesce(V.nth(V.RITES, k % 7), F.lit("nothing"))).otherwise("")
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("name"), action.alias("action"), what.alias("what"), F.when(k % 4 == 0, "").otherwise("w").alias("witness"))


def node_requests(spark, sf):
    return N.validate(_requests(spark, sf)).select("seq", "name", "action", "status", "reason")


def node_states(spark, sf):
    return N.state(N.validate(_requests(spark, sf))).select("name", "level", "w", "r", F.round("heat", 9).alias("heat"), "golden", "is_agent", "provenance_size")


def admissible_transitions(spark, sf):
    """Line items as steps from the rung of their supplier to that of their part: how often each step is taken, and whether it is admissible."""
    line = table(spark, sf, "lineitem").select(V.nth(V.LADDER, F.col("l_suppkey") % 10).alias("a"), V.nth(V.LADDER, F.col("l_partkey") % 10).alias("b"))
    return line.groupBy("a", "b").agg(F.count("*").alias("n")).withColumn("admissible", N.admissible(F.col("a"), F.col("b")))


def project_position(spark, sf):
    return N.project_state(as_log(spark, sf), "u1", {"suite": True, "manual": True, "package": True})


def drive_node(spark, sf):
    return N.drive(_user_masks(spark, sf))


def loop_chain(spark, sf):
    """The verbs over the events table: the effect is whether any purchase was seen; goldenize then keeps purchases alone."""
    steps = {
        "witnessed_effect": lambda c, d: (c | {"witnessed_effect": not d.where("event_type = 'purchase'").isEmpty()}, d),
        "goldenize": lambda c, d: (c, d.where("event_type = 'purchase'")),
    }
    _, kept, trace = N.run_chain(steps, {}, table(spark, sf, "events").select("event_id", "event_type"))
    return trace.select("idx", "verb", "fired", F.lit(kept.count()).cast("long").alias("n_kept"))


def ring_owl_roundtrip(spark, sf):
    """Rings from nations by region, written as OWL and read back."""
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    verbs = F.array_sort(F.collect_list(F.struct(F.col("n_name").alias("name"), F.concat(F.lit("a < b & "), "n_name").alias("source"), F.array(F.lit("who"), F.concat(F.lit("s"), "n_nationkey")).alias("slots"))))
    rings = n.groupBy(F.col("r_name").alias("name"), F.col("r_regionkey").alias("pos")).agg(verbs.alias("verbs"))
    ring = F.struct("name", F.array(F.lower("name")).alias("adds"), F.array(F.lit("base")).alias("requires"), "verbs")
    doc = W.document(rings.select("pos", W.owl_ring(ring).alias("fragment")), "urn:rings")
    back = doc.lateralJoin(W.RingsFromOwl(F.col("text").outer()).alias("r")).select("r.*")
    return back.select("name", F.array_join("adds", ",").alias("adds"), F.array_join("requires", ",").alias("requires"), F.array_join(F.transform("verbs", lambda v: F.concat_ws(":", v["name"], v["source"], F.array_join(v["slots"], "+"))), ",").alias("verbs"))


_REQ = """e AS (SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS name, event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
q AS (SELECT seq, name, k, CASE event_type WHEN 'click' THEN 'cool' WHEN 'purchase' THEN 'advance' WHEN 'view' THEN 'rite' ELSE 'other' END AS action, k % 4 = 0 AS blank,
  sum(CASE WHEN event_type = 'purchase' AND k % 4 <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY name ORDER BY seq) AS tries FROM e),
v AS (SELECT *, CASE WHEN action = 'cool' AND k % 9 > 6 THEN 'unknown_step' WHEN action = 'rite' AND k % 7 > 5 THEN 'unknown_rite' WHEN action = 'other' THEN 'unknown_action' WHEN action IN ('cool', 'advance') AND blank THEN 'empty_witness' WHEN action = 'advance' AND tries > 9 THEN 'at_top' END AS reason FROM q)"""

QUERIES = {f.__name__: f for f in (node_requests, node_states, admissible_transitions, project_position, drive_node, loop_chain, ring_owl_roundtrip)}
ORACLES = {
    "node_requests": f"WITH {_REQ} SELECT seq, name, action, CASE WHEN reason IS NULL THEN 'ok' ELSE 'refused' END AS status, reason FROM v",
    "node_states": f"WITH {_REQ}, s AS (SELECT name, CAST(count(*) FILTER (reason IS NULL AND action = 'advance') AS INT) AS level, CAST(coalesce(bit_or(1 << (k % 9)) FILTER (reason IS NULL AND action = 'cool'), 0) AS BIGINT) AS w, CAST(coalesce(bit_or(1 << (k % 7)) FILTER (reason IS NULL AND action = 'rite'), 0) AS BIGINT) AS r, count(*) FILTER (reason IS NULL) AS provenance_size FROM v GROUP BY name) SELECT name, level, w, r, round(1 - bit_count(w) / 7.0, 9) AS heat, w = 127 AS golden, r = 63 AS is_agent, provenance_size FROM s",
    "admissible_transitions": "WITH s AS (SELECT l_suppkey % 10 AS i, l_partkey % 10 AS j, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT " + _pick(V.LADDER, "i") + " AS a, " + _pick(V.LADDER, "j") + " AS b, n, j = i + 1 AS admissible FROM s",
    "project_position": f"WITH {_LOG}, o AS (SELECT * FROM l WHERE starts_with(name, 'u1')), f AS (SELECT bool_or(NOT wit) AS seen, bool_or(wit AND NOT starts_with(witness_id, 'process_rerun')) AS ext FROM o) SELECT CASE WHEN seen THEN 2 ELSE 1 END AS level, CAST(1 + 2 + CASE WHEN seen THEN 8 + 32 + 64 ELSE 0 END + CASE WHEN ext THEN 16 ELSE 0 END AS BIGINT) AS w, CAST(1 + 8 + CASE WHEN seen THEN 32 ELSE 0 END + CASE WHEN ext THEN 16 ELSE 0 END AS BIGINT) AS r FROM f",
    "drive_node": f"WITH {_U} SELECT user_id, CAST(9 - level + 7 - bit_count(w) + 6 - bit_count(r) + 1 AS INT) AS cycles, 9 AS level, CAST(127 AS BIGINT) AS w, CAST(63 AS BIGINT) AS r FROM u",
    "loop_chain": "SELECT idx, verb, true AS fired, (SELECT count(*) FROM events WHERE event_type = 'purchase') AS n_kept FROM (VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(V.LOOP)) + ") t(idx, verb)",
    "ring_owl_roundtrip": "SELECT r_name AS name, lower(r_name) AS adds, 'base' AS requires, string_agg(n_name || ':a < b & ' || n_name || ':who+s' || n_nationkey, ',' ORDER BY n_name) AS verbs FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
}
