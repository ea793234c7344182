"""Queries over lattice states and logs; events stand in for a log."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fixlattice.functions import dims as V
from fixlattice.functions import lattice as L
from fixlattice.operators import climb as C
from fixlattice.operators import log as G
from fixlattice.operators import nodes as N
from fixlattice.plans.checkpoints import shared_root
from fixlattice.session import table
from fixlattice.sources import log_store, record_log
from fixlattice.streaming import node_state


def K():
    """The one number in an event's props."""
    return F.get_json_object("props", "$.k").cast("int")


def _bit(i):
    return F.call_function("shiftleft", F.lit(1), i)


def as_log(spark, sf):
    """Events as log records: sign-ups are witnesses, purchases bring gauge passes."""
    return _log_of(table(spark, sf, "events"))


def _log_of(events):
    e = events.select("event_id", "user_id", "event_type", K().alias("k"))
    none = F.array().cast("array<string>")

    def some(test, word):
        return F.when(test, F.array(F.lit(word))).otherwise(none)

    again = F.when(F.col("k") % 4 == 0, F.array(F.concat(F.lit("by:"), "event_type"), F.concat(F.lit("again:"), "event_type")))
    cooled = F.array(F.array(V.nth(V.COOLING, F.col("k") % 7), V.nth(V.COOLING, (F.col("k") + 2) % 7)))
    return e.select(
        F.col("event_id").alias("seq"), F.concat(F.lit("u"), "user_id").alias("name"), F.when(F.col("event_type") == "signup", "witness").otherwise("node").alias("kind"), F.lit(None).cast("string").alias("python_path"),
        F.concat(F.lit("id"), F.col("k") % 3).alias("graph_identity"), V.nth(V.LADDER, F.col("k") % 10).alias("realization_level"),
        again.otherwise(F.array(F.concat(F.lit("by:"), "event_type"))).alias("provenance"), none.alias("adapters"), some(F.col("k") % 2 == 0, "doc").alias("generated_documentation"),
        none.alias("generated_agents"), some(F.col("k") % 3 == 0, "pkg").alias("generated_packages"), some(F.col("k") % 5 != 0, "test").alias("tests"),
        F.when(F.col("event_type") == "purchase", cooled).otherwise(F.array().cast("array<array<string>>")).alias("golden_history"),
        F.when(F.col("event_type") == "signup", F.concat(F.when(F.col("k") % 2 == 0, "process_rerun:").otherwise("seat"), "k")).alias("witness_id"),
    )


def ladder_next(spark, sf):
    """The rung of each user and the one above it."""
    own = V.nth(V.LADDER, F.col("level"))
    return _user_masks(spark, sf).select("user_id", own.alias("name"), N.next_level(own).alias("next_name"))


def loop_trace(spark, sf):
    """Eleven verbs a cycle; cycles are days of events, a cycle has an effect if a purchase was made."""
    days = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.bool_or(F.col("event_type") == "purchase").alias("effect"))
    verbs = F.explode(F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(v).alias("verb"), F.lit(v in V.CONDITIONAL_VERBS).alias("conditional")) for i, v in enumerate(V.LOOP)]))
    return days.select("day", "effect", verbs.alias("v")).select(F.col("day").cast("string").alias("day"), "v.idx", "v.verb", (~F.col("v.conditional") | F.col("effect")).alias("fired"))


def _user_masks(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.bit_or(F.when(F.col("event_type") == "purchase", _bit(K() % 7))).alias("w0"), F.bit_or(F.when(F.col("event_type") == "click", _bit(K() % 6))).alias("r0"), (F.count("*") % 10).cast("int").alias("level")).select(
        "user_id", "level", F.coalesce("w0", F.lit(0)).cast("bigint").alias("w"), F.coalesce("r0", F.lit(0)).cast("bigint").alias("r")
    )


def golden_users(spark, sf):
    s = _user_masks(spark, sf)
    return s.select("user_id", F.round(1 - F.bit_count("w") / 7.0, 9).alias("heat"), (F.col("w") == V.ALL_COOLING).alias("golden"), (F.col("r") == V.ALL_RITES).alias("is_agent"))


def node_closure_answer(spark, sf):
    s = _user_masks(spark, sf)
    missing = F.array_join(V.names_of(F.bitwise_not(F.col("w")), V.COOLING), ",")
    rites = F.array_join(V.names_of(F.bitwise_not(F.col("r")), V.RITES), ",")
    return s.select("user_id", V.nth(V.LADDER, F.col("level")).alias("level_name"), V.nth(V.LADDER, F.col("level") + 1).alias("next_name"), missing.alias("unwitnessed"), rites.alias("missing_rites"))


def lattice_states(spark, sf):
    """How many users are how far from the top."""
    return _user_masks(spark, sf).groupBy(L.distance(F.col("level"), F.col("w"), F.col("r")).alias("distance")).agg(F.count("*").alias("n"))


def closure_step_all(spark, sf):
    """How many users get to each state by one step."""
    l, w, r = L.closure_step(F.col("level"), F.col("w"), F.col("r"))
    return _user_masks(spark, sf).select(l.alias("level"), w.alias("w"), r.alias("r")).groupBy("level", "w", "r").agg(F.count("*").alias("n_from"))


def closure_inflationary_violations(spark, sf):
    """Users whose next state isn't above theirs, of which there are none, and those at the fixpoint."""
    s = _user_masks(spark, sf)
    l, w, r = L.closure_step(F.col("level"), F.col("w"), F.col("r"))
    both = s.select(F.struct("level", "w", "r").alias("a"), F.struct(l.alias("level"), w.alias("w"), r.alias("r")).alias("b"))
    return both.agg(F.sum(F.when(~L.leq(F.col("a"), F.col("b")), 1).otherwise(0)).alias("violations"), F.sum(F.when(F.col("a") == F.col("b"), 1).otherwise(0)).alias("fixpoints"), F.count("*").alias("n"))


def leq_pairs(spark, sf):
    users = _user_masks(spark, sf).select("user_id", "level", "w", "r")
    above = L.count_above(users.withColumn("n", F.lit(1)))
    # a row for each state of the lattice
    return users.withColumn("index", L.state_index(F.col("level"), F.col("w"), F.col("r"))).join(F.broadcast(above), "index").select("user_id", "n_above")


def lub_by_event_type(spark, sf):
    e = table(spark, sf, "events").select("event_type", (K() % 10).alias("level"), _bit(K() % 7).cast("bigint").alias("w"), _bit(K() % 6).cast("bigint").alias("r"))
    return e.groupBy("event_type").agg(*L.lub())


def kleene_chain(spark, sf):
    """The chain of each user's state up to the top."""
    return L.chain(_user_masks(spark, sf)).select("user_id", "step", "level", "w", "r")


def log_latest(spark, sf):
    return G.latest(as_log(spark, sf)).select("name", "seq", "kind", "graph_identity")


def log_latest_node(spark, sf):
    return G.latest(as_log(spark, sf), witnesses=False).select("name", "seq", "realization_level", "graph_identity")


def log_history(spark, sf):
    return G.history(as_log(spark, sf), "u8").select("name", "seq", "kind", "realization_level")


def external_witnesses(spark, sf):
    return G.external_witnesses(as_log(spark, sf)).select("name", "seq", "witness_id")


def agentify(spark, sf):
    r = G.rites(G.evidence(as_log(spark, sf)))
    return r.select("name", F.array_join(V.names_of(F.col("r"), V.RITES), ",").alias("granted"), F.array_join(V.names_of(F.bitwise_not(F.col("r")), V.RITES), ",").alias("missing"), (F.col("r") == V.ALL_RITES).alias("is_agent"))


def climb_positions(spark, sf):
    return C.positions(as_log(spark, sf)).select("name", "level", "w", "r", "distance", "next_kind", "next_name")


def climb_step(spark, sf):
    s = C.step(as_log(spark, sf), "handler")
    return s.select("name", "realization_level", F.element_at("provenance", -1).alias("last_provenance"), "status", "reason")


def gauge(spark, sf):
    return C.gauge(as_log(spark, sf))


def fork_nodes(spark, sf):
    f = G.fork(as_log(spark, sf), "lab", "handler")
    return f.select("name", "graph_identity", "realization_level", F.array_join("provenance", ",").alias("provenance"), F.size("tests").alias("n_tests"), "status")


def registry_new(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("pos"), F.sha2("text", 256).alias("id"))
    seen = docs.join(table(spark, sf, "labels").select(F.col("doc_id").alias("pos")), "pos", "left_semi")
    return G.registry_new(docs, seen).select("id", "pos")


def bestiary(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("id"))
    g = docs.join(table(spark, sf, "labels"), "doc_id").select("id", F.col("doc_id").alias("seq"), F.when(F.col("quality") == 1, "KEEP").otherwise("REJECT").alias("verdict"))
    return G.bestiary(g)


def promoted_users(spark, sf):
    log = as_log(spark, sf)
    return G.promote(log.select("name").distinct(), log)


def _stream_of_states(spark, sf):
    """Evidence from keyed state over the events' log, appended in two parts with a run of the stream after each; the last row of each name."""
    root = f"{shared_root(spark)}/states-{uuid.uuid4().hex}"
    events = table(spark, sf, "events")
    middle = events.agg(F.coalesce(F.max("event_id"), F.lit(0)) / 2).first()[0]
    for part in (events.where(F.col("event_id") <= middle), events.where(F.col("event_id") > middle)):
        # events are sorted before they become records: those are wider, and sorting looks at its rows twice
        record_log.append(_log_of(part.orderBy("event_id")), f"{root}/log")
        states = node_state.evidence_stream(record_log.stream(spark, f"{root}/log"))
        schema = states.schema
        write = lambda batch, i: batch.write.mode("overwrite").parquet(f"{root}/out/batch={i}")
        query = states.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    rows = spark.read.schema(schema).parquet(f"{root}/out")
    rest = [c for c in schema.names if c != "name"]
    last = rows.groupBy("name").agg(F.max_by(F.struct(*rest), "n_records").alias("s"))
    return last.select("name", *[F.col(f"s.{c}").alias(c) for c in rest])


def climb_positions_stream(spark, sf):
    found = C.located(_stream_of_states(spark, sf).withColumn("provenance", F.lit(None).cast("array<string>")))
    granted = F.array_join(V.names_of(F.col("r"), V.RITES), ",").alias("granted")
    at = C.positions_of(found).select("name", "level", "w", "r", "distance", "next_kind", "next_name")
    return at.withColumn("granted", granted)


def log_appended_twice(spark, sf):
    """Documents mirrored into a log, then once more as programs: the last record of each, numbered over both appends."""
    path = f"{shared_root(spark)}/log-{uuid.uuid4().hex}"
    docs = table(spark, sf, "documents").select("doc_id", "text")
    for text, kind in ((F.col("text"), "function"), (F.concat("text", F.lit("\n")), "program")):
        record_log.append(log_store.mirror(docs.withColumn("text", text), "doc_id", "text", kind).withColumn("at", F.col("name").cast("long")), path, "at")
    return G.latest(record_log.records(spark, path)).select("name", "seq", "kind", "graph_identity", "realization_level")


def substrate_roundtrip(spark, sf):
    """Whether region and nation survive each registered format; files go to a session's own folder."""
    root = shared_root(spark)
    rows = []
    for t in ("region", "nation"):
        for s in sorted(log_store.SUBSTRATES):
            rows.append((t, s, log_store.preserved(table(spark, sf, t), s, f"{root}/substrate-{uuid.uuid4().hex}")))
    return spark.createDataFrame(rows, "source string, substrate string, preserved boolean")


def _pick(names, idx):
    return "CASE " + idx + " " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END"


def _listed(names, mask, want=1):
    parts = ", ".join(f"CASE WHEN ({mask} >> {i}) & 1 = {want} THEN '{n}' END" for i, n in enumerate(names))
    return f"array_to_string(list_filter([{parts}], lambda x: x IS NOT NULL), ',')"


_E = "e AS (SELECT event_id AS seq, 'u' || user_id AS name, CAST(json_extract_string(props, '$.k') AS INT) AS k, event_type, user_id, ts FROM events)"
_LOG = _E + """, l AS (SELECT *, event_type = 'signup' AS wit, CASE WHEN event_type = 'purchase' THEN (1 << (k % 7)) | (1 << ((k + 2) % 7)) ELSE 0 END AS pass,
  CASE WHEN event_type = 'signup' THEN CASE WHEN k % 2 = 0 THEN 'process_rerun:' ELSE 'seat' END || k END AS witness_id FROM e),
last AS (SELECT name, max_by(k, seq) AS k, max_by(event_type, seq) AS event_type FROM l WHERE NOT wit GROUP BY name),
h AS (SELECT name, count(*) FILTER (NOT wit) AS n_nodes, count(DISTINCT k % 3) FILTER (NOT wit) AS n_ids, bit_or(CASE WHEN wit THEN 0 ELSE pass END) AS cooled,
  count(*) FILTER (wit AND NOT starts_with(witness_id, 'process_rerun')) AS n_ext FROM l GROUP BY name),
ev AS (SELECT name, n_nodes, n_ids, cooled, n_ext, last.k, last.event_type,
  CASE WHEN last.k % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN n_ids >= 2 THEN 2 ELSE 0 END + CASE WHEN last.k % 5 <> 0 AND cooled & 2 > 0 THEN 4 ELSE 0 END
  + CASE WHEN last.k % 3 = 0 THEN 8 ELSE 0 END + CASE WHEN n_ext > 0 THEN 16 ELSE 0 END + CASE WHEN last.k IS NOT NULL THEN 32 ELSE 0 END AS r FROM h LEFT JOIN last USING (name)),
st AS (SELECT name, CAST(CASE WHEN n_nodes > 0 THEN k % 10 ELSE 0 END AS INT) AS level, CAST(CASE WHEN n_nodes > 0 THEN (cooled & 111) + CASE WHEN n_ext > 0 THEN 16 ELSE 0 END ELSE 0 END AS BIGINT) AS w,
  CAST(CASE WHEN n_nodes > 0 THEN r ELSE 0 END AS BIGINT) AS r, n_nodes, k, event_type FROM ev),
pos AS (SELECT *, CAST(9 - level + 7 - bit_count(w) + 6 - bit_count(r) AS INT) AS distance,
  CASE WHEN w < 127 THEN 'cooling' WHEN r < 63 THEN 'rite' WHEN level < 9 THEN 'rung' ELSE 'fixpoint' END AS next_kind,
  CASE WHEN w < 127 THEN """ + _pick(V.COOLING, "bit_count(xor(w, w + 1)) - 1") + " WHEN r < 63 THEN " + _pick(V.RITES, "bit_count(xor(r, r + 1)) - 1") + " WHEN level < 9 THEN " + _pick(V.LADDER, "level + 1") + " END AS next_name FROM st)"
_U = _E + ", u AS (SELECT user_id, CAST(count(*) % 10 AS INT) AS level, CAST(bit_or(CASE WHEN event_type = 'purchase' THEN 1 << (k % 7) ELSE 0 END) AS BIGINT) AS w, CAST(bit_or(CASE WHEN event_type = 'click' THEN 1 << (k % 6) ELSE 0 END) AS BIGINT) AS r FROM e GROUP BY user_id)"
_ALL = "s AS (SELECT CAST(i // 8192 AS INT) AS level, (i // 64) % 128 AS w, i % 64 AS r FROM range(81920) t(i))"
_STEP = "CAST(CASE WHEN w < 127 OR r < 63 THEN level ELSE least(level + 1, 9) END AS INT) AS level2, CASE WHEN w < 127 THEN w | (w + 1) ELSE w END AS w2, CASE WHEN w = 127 AND r < 63 THEN r | (r + 1) ELSE r END AS r2"

QUERIES = {f.__name__: f for f in (ladder_next, loop_trace, golden_users, node_closure_answer, lattice_states, closure_step_all, closure_inflationary_violations, leq_pairs, lub_by_event_type, kleene_chain, log_latest, log_latest_node, log_history, external_witnesses, agentify, climb_positions, climb_step, gauge, fork_nodes, registry_new, bestiary, promoted_users, log_appended_twice, climb_positions_stream, substrate_roundtrip)}
ORACLES = {
    "ladder_next": f"WITH {_U} SELECT user_id, {_pick(V.LADDER, 'level')} AS name, {_pick(V.LADDER, 'level + 1')} AS next_name FROM u",
    "loop_trace": "WITH d AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, bool_or(event_type = 'purchase') AS effect FROM events GROUP BY 1), v AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(V.LOOP)) + ") t(idx, verb)) SELECT day, idx, verb, verb NOT IN ('goldenize', 'improve_compiler') OR effect AS fired FROM d, v",
    "golden_users": f"WITH {_U} SELECT user_id, round(1 - bit_count(w) / 7.0, 9) AS heat, w = 127 AS golden, r = 63 AS is_agent FROM u",
    "node_closure_answer": f"WITH {_U} SELECT user_id, {_pick(V.LADDER, 'level')} AS level_name, {_pick(V.LADDER, 'level + 1')} AS next_name, {_listed(V.COOLING, 'w', 0)} AS unwitnessed, {_listed(V.RITES, 'r', 0)} AS missing_rites FROM u",
    "lattice_states": f"WITH {_U} SELECT CAST(9 - level + 7 - bit_count(w) + 6 - bit_count(r) AS INT) AS distance, count(*) AS n FROM u GROUP BY 1",
    "closure_step_all": f"WITH {_U}, t AS (SELECT {_STEP} FROM u) SELECT level2 AS level, CAST(w2 AS BIGINT) AS w, CAST(r2 AS BIGINT) AS r, count(*) AS n_from FROM t GROUP BY 1, 2, 3",
    "closure_inflationary_violations": f"WITH {_U}, t AS (SELECT *, {_STEP} FROM u) SELECT CAST(sum(CASE WHEN level <= level2 AND w & ~w2 = 0 AND r & ~r2 = 0 THEN 0 ELSE 1 END) AS BIGINT) AS violations, CAST(sum(CASE WHEN level = level2 AND w = w2 AND r = r2 THEN 1 ELSE 0 END) AS BIGINT) AS fixpoints, count(*) AS n FROM t",
    "leq_pairs": f"WITH {_U} SELECT a.user_id, count(*) AS n_above FROM u a JOIN u b ON a.level <= b.level AND a.w & ~b.w = 0 AND a.r & ~b.r = 0 GROUP BY 1",
    "lub_by_event_type": f"WITH {_E} SELECT event_type, max(k % 10) AS level, CAST(bit_or(1 << (k % 7)) AS BIGINT) AS w, CAST(bit_or(1 << (k % 6)) AS BIGINT) AS r FROM e GROUP BY 1",
    "kleene_chain": f"WITH RECURSIVE {_U}, c AS (SELECT user_id, 0 AS step, level, w, r FROM u UNION ALL SELECT user_id, step + 1, level2, CAST(w2 AS BIGINT), CAST(r2 AS BIGINT) FROM (SELECT user_id, step, {_STEP} FROM c WHERE level < 9 OR w < 127 OR r < 63)) SELECT user_id, step, level, w, r FROM c",
    "log_latest": f"WITH {_LOG} SELECT name, max(seq) AS seq, max_by(CASE WHEN wit THEN 'witness' ELSE 'node' END, seq) AS kind, max_by('id' || (k % 3), seq) AS graph_identity FROM l GROUP BY 1",
    "log_latest_node": f"WITH {_LOG} SELECT name, max(seq) AS seq, {_pick(V.LADDER, 'max_by(k, seq) % 10')} AS realization_level, max_by('id' || (k % 3), seq) AS graph_identity FROM l WHERE NOT wit GROUP BY 1",
    "log_history": f"WITH {_LOG} SELECT name, seq, CASE WHEN wit THEN 'witness' ELSE 'node' END AS kind, {_pick(V.LADDER, 'k % 10')} AS realization_level FROM l WHERE name = 'u8'",
    "external_witnesses": f"WITH {_LOG} SELECT name, seq, witness_id FROM l WHERE wit AND NOT starts_with(witness_id, 'process_rerun')",
    "agentify": f"WITH {_LOG} SELECT name, {_listed(V.RITES, 'r')} AS granted, {_listed(V.RITES, 'r', 0)} AS missing, r = 63 AS is_agent FROM ev",
    "climb_positions": f"WITH {_LOG} SELECT name, level, w, r, distance, next_kind, next_name FROM pos",
    "climb_step": f"WITH {_LOG} SELECT name, CASE WHEN next_kind = 'rung' THEN next_name ELSE {_pick(V.LADDER, 'k % 10')} END AS realization_level, CASE WHEN next_kind = 'rung' THEN 'transition:' || {_pick(V.LADDER, 'level')} || '->' || next_name || ':by:handler' WHEN k % 4 = 0 THEN 'again:' || event_type ELSE 'by:' || event_type END AS last_provenance, CASE WHEN next_kind = 'rung' THEN 'ok' ELSE 'refused' END AS status, CASE WHEN next_kind = 'fixpoint' THEN 'at_fixpoint' WHEN next_kind <> 'rung' THEN 'derived_only:' || next_name END AS reason FROM pos WHERE n_nodes > 0",
    "gauge": f"WITH {_LOG} SELECT name, true AS execution, k % 5 <> 0 AND cooled & 2 > 0 AS testing, true AS relational_validation, true AS observation, n_ext > 0 AS independent_witnessing, k % 4 = 0 AS provenance, n_nodes > 1 AS append_only_crystallization FROM ev WHERE n_nodes > 0",
    "fork_nodes": f"WITH {_LOG} SELECT name || '@lab' AS name, 'id' || (k % 3) AS graph_identity, {_pick(V.LADDER, 'k % 10')} AS realization_level, 'fork:' || name || '->lab:by:handler' AS provenance, 0 AS n_tests, 'ok' AS status FROM last",
    "registry_new": "WITH d AS (SELECT sha256(text) AS id, doc_id FROM documents), s AS (SELECT id FROM d JOIN labels USING (doc_id)) SELECT id, min(doc_id) AS pos FROM d WHERE id NOT IN (SELECT id FROM s) GROUP BY 1",
    "bestiary": "WITH d AS (SELECT sha256(text) AS id, doc_id, quality FROM documents JOIN labels USING (doc_id)) SELECT id FROM d GROUP BY 1 HAVING max_by(quality, doc_id) = 0",
    "climb_positions_stream": f"WITH {_LOG} SELECT name, level, w, r, distance, next_kind, next_name, {_listed(V.RITES, 'r')} AS granted FROM pos",
    "log_appended_twice": "SELECT CAST(doc_id AS VARCHAR) AS name, (SELECT count(*) FROM documents) + row_number() OVER (ORDER BY doc_id) - 1 AS seq, 'program' AS kind, sha256(text || chr(10)) AS graph_identity, 'program' AS realization_level FROM documents",
    "promoted_users": f"WITH {_LOG} SELECT name, n_ext > 0 AS promoted FROM h",
}
