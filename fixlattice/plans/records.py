"""Queries over registries and records in a log, assembly, rules and substrates."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fixlattice.functions import dims as V
from fixlattice.operators import checks as X
from fixlattice.operators import climb as C
from fixlattice.operators import registry as G
from fixlattice.operators import rules as U
from fixlattice.plans import checking
from fixlattice.plans.checkpoints import shared_root
from fixlattice.plans.logs import _LOG, _U, _listed, _pick, _user_masks, as_log
from fixlattice.session import dealt, table
from fixlattice.sources import codecs as W
from fixlattice.sources import log_store, record_log
from fixlattice.sources import ring_files as R


def _fresh(spark, name):
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def registry_reloaded(spark, sf):
    """Labelled documents as genomes: good ones recorded and gauged as champions, then bad ones recorded, then every other one accepted from outside; all read back from the log."""
    path = _fresh(spark, "registry")
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    g = docs.select(F.col("doc_id").alias("at"), F.sha2("text", 256).alias("id"), F.col("n_chars").cast("string").alias("ops"), "source", F.col("quality").cast("double").alias("fitness"), F.when(F.col("quality") == 1, "KEEP").otherwise("REJECT").alias("verdict")).withColumnRenamed("source", "proposed_by")
    good = g.where("verdict = 'KEEP'")
    record_log.append(G.genome_records(good), path, "at")
    record_log.append(G.champion_records(good), path, "at")
    record_log.append(G.genome_records(g.where("verdict = 'REJECT'")), path, "at")
    witness = F.when(F.col("at") % 2 == 0, "seat").otherwise("process_rerun:loop")
    record_log.append(g.select(F.col("id").alias("name"), F.lit("witness").alias("kind"), witness.alias("witness_id"), "at"), path, "at")
    log = record_log.records(spark, path)
    return G.registry(log).join(G.promotions(log), "id", "left").select("id", "verdict", "fitness", "promoted", "pending")


def intake_appended(spark, sf):
    """Candidates judged against the rings, the admitted ones appended to a log and read from it."""
    path = _fresh(spark, "intake")
    candidates = checking._candidates(spark, sf)
    rings = spark.createDataFrame([x[1:] for x in checking.RINGS], "ring string, member string")
    record_log.append(X.admitted_records(candidates, X.intake(candidates, rings)), path, "at")
    return record_log.records(spark, path).select("name", "seq", "kind", F.get_json_object("payload", "$.ring").alias("ring"))


def assemble_orders(spark, sf):
    """An order as a stack, a line a ring of two verbs; lines of one number lie in the order of their parts and suppliers."""
    line = table(spark, sf, "lineitem")
    s, p, q = F.concat(F.lit("s"), F.col("l_suppkey") % 5), F.concat(F.lit("p"), F.col("l_partkey") % 5), F.concat(F.lit("q"), F.col("l_quantity").cast("int") % 3)
    none = F.array().cast("array<string>")
    first = F.struct(p.alias("name"), F.array(q).alias("slots"), F.array(s, F.when(F.col("l_quantity").cast("int") % 10 == 0, "q9").otherwise(q)).alias("accesses"))
    second = F.struct(F.when(F.col("l_suppkey") % 10 == 0, "zz").otherwise(s).alias("name"), none.alias("slots"), none.alias("accesses"))
    wants = F.when(F.col("l_linenumber") > 1, F.array(F.concat(F.lit("s"), F.col("l_partkey") % 4))).otherwise(none)
    rings = line.select(F.col("l_orderkey").alias("key"), ((F.col("l_linenumber").cast("long") * 100_000_000 + F.col("l_partkey")) * 10_000_000 + F.col("l_suppkey")).alias("depth"), F.array(s, p).alias("adds"), wants.alias("requires"), F.array(first, second).alias("verbs"))
    return X.assemble(rings, "key", ["s0", "s1"]).select("key", "status", "depth", "reason", "verb", F.array_join("names", ",").alias("names"))


def _part_rings(spark, sf):
    """A ring for each part; every 13th has no name, every 11th a verb without source."""
    k = F.col("p_partkey")
    c = lambda x: F.concat(F.lit("c"), x.cast("string"))
    verb = F.struct(F.concat(F.lit("v<"), k).alias("name"), F.when(k % 11 != 0, F.concat(F.lit("a < b & "), k)).alias("source"), F.array(F.concat(F.lit("s"), k % 3)).alias("slots"))
    return dealt(table(spark, sf, "part").select("p_partkey"), "p_partkey").select("p_partkey", F.when(k % 13 != 0, F.concat(F.lit("r"), k)).alias("name"), F.array(c(k), F.lit("all")).alias("adds"), F.array(c(F.floor(k / 2))).alias("requires"), F.array(verb).alias("verbs"))


def _shown(rings):
    verbs = F.transform("verbs", lambda v: F.concat_ws(":", v["name"], v["source"], F.array_join(v["slots"], "+")))
    return rings.select("name", F.array_join("adds", ",").alias("adds"), F.array_join("requires", ",").alias("requires"), F.array_join(verbs, ",").alias("verbs"), "status", "reason")


def ring_xml_files(spark, sf):
    """The parts' rings written as XML and read back, with elements that don't parse beside them, one for every 7th part."""
    path, broken = _fresh(spark, "rings"), _fresh(spark, "broken")
    rings = _part_rings(spark, sf)
    R.write_rings(rings, path)
    rings.where("p_partkey % 7 = 0").select(F.lit("<ring name=\"x\"><adds>y</ring>").alias("value")).write.text(broken)
    return _shown(R.read_rings(spark, [path, broken]))


def ring_owl_files(spark, sf):
    """The parts' rings as OWL fragments in files and read back; the verb of every 5th is missing."""
    path = _fresh(spark, "owl")
    rings = _part_rings(spark, sf).where("name IS NOT NULL").withColumn("verbs", F.transform("verbs", lambda v: F.struct(v["name"].alias("name"), F.coalesce(v["source"], F.lit("")).alias("source"), v["slots"].alias("slots"))))
    text = W.owl_ring(F.struct("name", "adds", "requires", "verbs"))
    cut = F.regexp_replace(text, "(?s)<owl:NamedIndividual.*?</owl:NamedIndividual>", "")
    rings.select(F.when(F.col("p_partkey") % 5 == 0, cut).otherwise(text).alias("value")).write.option("maxRecordsPerFile", R.FILE_RINGS).text(path)
    return _shown(R.read_owl_rings(spark, path))


def climb_requirements(spark, sf):
    return C.positions(as_log(spark, sf)).select("name", "next_name", "requires")


def rule_closures(spark, sf):
    """The rules over the users' states: what is next and missing, who is golden or an agent, and how long the chain to the top is."""
    states = _user_masks(spark, sf).select(F.col("user_id").alias("id"), "level", "w", "r")
    steps = U.apply_rule(spark, "kleene", states).groupBy("id").agg(F.max("step").alias("steps"))
    out = U.apply_rule(spark, "next_admissible_closure", states).join(steps, "id")
    for rule in ("golden", "is_agent"):
        out = out.join(U.apply_rule(spark, rule, states).withColumn(rule, F.lit(True)), "id", "left").withColumn(rule, F.coalesce(rule, F.lit(False)))
    return out.select(F.col("id").alias("user_id"), "next", F.array_join("missing", ",").alias("missing"), "golden", "is_agent", "steps")


def rule_steps(spark, sf):
    """The state after each user's, by the rule."""
    states = _user_masks(spark, sf).select(F.col("user_id").alias("id"), "level", "w", "r")
    return U.apply_rule(spark, "closure_step", states).select(F.col("id").alias("user_id"), F.col("level").cast("int").alias("level"), "w", "r")


#: Columns whose text both engines write alike.
_DIGESTED = {"lineitem": ("l_orderkey", "l_linenumber", "l_returnflag"), "orders": ("o_orderkey", "o_custkey"), "nation": ("n_nationkey", "n_name")}


def substrate_digests(spark, sf):
    """Tables written to each registered format and read back, slice by slice, and deleted: rows, a digest of some columns as SQL can make it, and whether all columns survive."""
    rows = []
    for name, columns in _DIGESTED.items():
        df = table(spark, sf, name)
        wanted = log_store.digest(df)
        for s in sorted(log_store.SUBSTRATES):
            found, total = log_store.digests_back(df, s, _fresh(spark, "substrate"), list(columns), wanted[0])
            rows.append((name, s, found[0], total, found == wanted))
    return spark.createDataFrame(rows, "source string, substrate string, n long, digest long, preserved boolean")


_STEP = "CAST(CASE WHEN w < 127 OR r < 63 THEN level ELSE least(level + 1, 9) END AS INT) AS level, CAST(CASE WHEN w < 127 THEN w | (w + 1) ELSE w END AS BIGINT) AS w, CAST(CASE WHEN w = 127 AND r < 63 THEN r | (r + 1) ELSE r END AS BIGINT) AS r"
QUERIES = {f.__name__: f for f in (registry_reloaded, intake_appended, assemble_orders, ring_xml_files, ring_owl_files, climb_requirements, rule_closures, rule_steps, substrate_digests)}
ORACLES = {
    "registry_reloaded": "WITH g AS (SELECT sha256(text) AS id, doc_id, quality FROM documents JOIN labels USING (doc_id)), x AS (SELECT id, min(quality) AS q, bool_or(quality = 1) AS champion, bool_or(doc_id % 2 = 0) AS seen FROM g GROUP BY 1) SELECT id, CASE WHEN q = 1 THEN 'KEEP' ELSE 'REJECT' END AS verdict, CAST(q AS DOUBLE) AS fitness, CASE WHEN champion THEN seen END AS promoted, CASE WHEN champion AND NOT seen THEN 'external_acceptance' END AS pending FROM x",
    "intake_appended": f"WITH j AS ({checking.ORACLES['intake_diff']}) SELECT CAST(id AS VARCHAR) AS name, row_number() OVER (ORDER BY id) - 1 AS seq, 'candidate_envelope' AS kind, lang AS ring FROM j JOIN documents ON doc_id = id WHERE status = 'admitted'",
    "assemble_orders": """WITH l AS (SELECT l_orderkey AS key, (l_linenumber::BIGINT * 100000000 + l_partkey) * 10000000 + l_suppkey AS depth, 's' || l_suppkey % 5 AS s, 'p' || l_partkey % 5 AS p, 'q' || CAST(l_quantity AS INT) % 3 AS q, CAST(l_quantity AS INT) % 10 = 0 AS odd, l_suppkey % 10 = 0 AS zz, CASE WHEN l_linenumber > 1 THEN 's' || l_partkey % 4 END AS need FROM lineitem),
b AS (SELECT key, depth, -1 AS stage, 'missing' AS reason, NULL AS verb, need AS names FROM l a WHERE need NOT IN ('s0', 's1') AND NOT EXISTS (SELECT 1 FROM l x WHERE x.key = a.key AND x.depth < a.depth AND a.need IN (x.s, x.p))
  UNION ALL SELECT key, depth, 0, 'leak', p, 'q9' FROM l WHERE odd UNION ALL SELECT key, depth, 1, 'outside_adds', 'zz', 'zz' FROM l WHERE zz),
f AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY key ORDER BY depth, stage) = 1)
SELECT k.key, CASE WHEN f.key IS NULL THEN 'ok' ELSE 'refused' END AS status, depth, reason, verb, names FROM (SELECT DISTINCT key FROM l) k LEFT JOIN f USING (key)""",
    "ring_xml_files": "WITH p AS (SELECT p_partkey AS k FROM part) SELECT CASE WHEN k % 13 <> 0 THEN 'r' || k END AS name, 'c' || k || ',all' AS adds, 'c' || k // 2 AS requires, 'v<' || k || CASE WHEN k % 11 <> 0 THEN ':a < b & ' || k ELSE '' END || ':s' || k % 3 AS verbs, CASE WHEN k % 13 = 0 OR k % 11 = 0 THEN 'refused' ELSE 'ok' END AS status, CASE WHEN k % 13 = 0 THEN 'no_name' WHEN k % 11 = 0 THEN 'bad_verb' END AS reason FROM p UNION ALL SELECT NULL, '', '', '', 'refused', 'malformed' FROM p WHERE k % 7 = 0",
    "ring_owl_files": "WITH p AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 13 <> 0) SELECT 'r' || k AS name, 'c' || k || ',all' AS adds, 'c' || k // 2 AS requires, CASE WHEN k % 5 = 0 THEN '' ELSE 'v<' || k || ':' || CASE WHEN k % 11 <> 0 THEN 'a < b & ' || k ELSE '' END || ':s' || k % 3 END AS verbs, CASE WHEN k % 5 = 0 THEN 'refused' ELSE 'ok' END AS status, CASE WHEN k % 5 = 0 THEN 'no_such_verb' END AS reason FROM p",
    "climb_requirements": f"WITH {_LOG} SELECT name, next_name, CASE WHEN next_kind = 'rung' THEN 'state' ELSE CASE next_name " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.EVIDENCE.items()) + " END END AS requires FROM pos",
    "rule_closures": f"WITH {_U} SELECT user_id, coalesce({_pick(V.LADDER, 'level + 1')}, 'none') AS next, {_listed(V.COOLING, 'w', 0)} AS missing, w = 127 AS golden, r = 63 AS is_agent, CAST(9 - level + 7 - bit_count(w) + 6 - bit_count(r) AS INT) AS steps FROM u",
    "rule_steps": f"WITH {_U} SELECT user_id, {_STEP} FROM u",
    "substrate_digests": " UNION ALL ".join(f"SELECT '{t}' AS source, s AS substrate, count(*) AS n, CAST(sum(CAST('0x' || substr(md5({" || '|' || ".join(c)}), 1, 10) AS BIGINT)) AS BIGINT) AS digest, true AS preserved FROM {t}, (SELECT unnest(['json', 'orc', 'parquet']) AS s) GROUP BY s" for t, c in _DIGESTED.items()),
}
