"""Queries over deduction, names, claims, stacks, slots, source rows, codecs and evolution."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from fixlattice.functions import text as T
from fixlattice.operators import checks as X
from fixlattice.operators import climb as C
from fixlattice.operators import deduce as P
from fixlattice.operators import evolve as V
from fixlattice.operators import source_rows as B
from fixlattice.plans.checkpoints import cut
from fixlattice.plans.logs import _LOG, _U, _pick, _user_masks, as_log
from fixlattice.functions import dims
from fixlattice.session import dealt, table
from fixlattice.sources import codecs as W
from fixlattice.sources.log_store import LOG_SCHEMA

# A pool of five units.
UNITS = [
    (0, "source", ["contacts"], ["pull_api"], []),
    (1, "qualify", ["fit_scores"], ["contacts"], []),
    (2, "write", ["copy"], ["contacts"], []),
    (3, "deliver", ["sends"], ["copy", "send_api"], ["postal_address"]),
    (4, "report", ["verdict"], ["sends"], []),
]
RINGS = [(0, "en", "the"), (0, "en", "and"), (0, "en", "of"), (1, "fr", "la"), (1, "fr", "le"), (1, "fr", "de"), (2, "de", "und"), (2, "de", "der"), (2, "de", "die")]
CONFIG, KNOWN = ["to", "que", "in"], ["is", "en", "un", "a"]
SOURCES = {
    "wilson": "def interval(k, n, z=1.96):\n    if n == 0:\n        return (0.0, 1.0)\n    p = k / n\n    d = 1 + z * z / n\n    lo = p / d\n    if k == 0:\n        lo = 0.0\n    return (lo, d)\n",
    "sums": "def total(xs):\n    out = 0\n    for x in xs:\n        out += x\n    return [y for y in (out,)]\n",
    "nested": "def outer(a):\n    f = lambda b: a + b\n    a = 2\n    return f(1)\n",
    "module": "import os\ndef a(x):\n    return b(x)\ndef b(y):\n    return a(y) + b(y)\nclass C:\n    def m(self):\n        return self.x\n@d\ndef e():\n    pass\ndef g():\n    yield 1\n",
}


def _units(spark):
    return spark.createDataFrame(UNITS, P.UNIT)


def predict_status(spark, sf):
    """The parts' units under each of two bases; every fifth has slots, of which one is bound."""
    pool = _numeric(spark, sf).withColumn("slots", F.when(F.col("pos") % 5 == 0, F.array(F.lit("slot0"), F.lit("slot1"))).otherwise(F.col("slots")))
    out = None
    for label, base in (("few", ["c0", "c1"]), ("more", ["c0", "c1", "c2", "c3", "none"])):
        rows = P.predict(pool, base, ["slot0"]).select(F.lit(label).alias("base"), "name", "status", F.array_join("capability_residue", ",").alias("capability_residue"), F.array_join("binding_residue", ",").alias("binding_residue"))
        out = rows if out is None else out.unionByName(rows)
    return out


#: Parts of a small pool.
_POOL = 40


def closure_fixture(spark, sf):
    """Small pools of parts, each closed in order."""
    p = table(spark, sf, "part").select(F.floor(F.col("p_partkey") / _POOL).alias("pool"), (F.col("p_partkey") % _POOL + 1).alias("i"))
    c = lambda x: F.concat(F.lit("c"), F.floor(x).cast("string"))
    units = p.select("pool", F.col("i").cast("int").alias("pos"), F.concat(F.lit("u"), "i").alias("name"), F.array(c(F.col("i"))).alias("provides"), F.when(F.col("i") % 17 == 0, F.array(F.lit("none"))).otherwise(F.array(c(F.col("i") / 2), c(F.col("i") / 3))).alias("requires"))
    out = P.closure_fold(units, ["c0"], ["pool"])
    return out.select("pool", *[F.array_join(x, ",").alias(x) for x in ("available", "order", "active")])


def _numeric(spark, sf):
    """Parts as units: part i provides c<i> and requires c<i/2> and c<i/3>, but for every 17th, which requires one that nothing provides."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("i"))
    name = lambda x: F.concat(F.lit("c"), F.floor(x).cast("string"))
    none = F.array().cast("array<string>")
    return p.select(F.col("i").cast("int").alias("pos"), F.concat(F.lit("u"), "i").alias("name"), F.array(name(F.col("i"))).alias("provides"), F.when(F.col("i") % 17 == 0, F.array(F.lit("none"))).otherwise(F.array(name(F.col("i") / 2), name(F.col("i") / 3))).alias("requires"), none.alias("slots"))


def closure_numeric(spark, sf):
    base = spark.createDataFrame([("c0",)], "cap string")
    return P.closure_rounds(_numeric(spark, sf), base)[1]


def _two_ways(spark, sf):
    """The parts' units and, for every third part, a second provider that requires its neighbour: cycles, and ways to choose among."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("i")).where("i % 3 = 0")
    none = F.array().cast("array<string>")
    more = p.select((F.col("i") + 100_000_000).cast("int").alias("pos"), F.concat(F.lit("v"), "i").alias("name"), F.array(F.concat(F.lit("c"), "i")).alias("provides"), F.array(F.concat(F.lit("c"), (F.col("i") + 1).cast("string"))).alias("requires"), none.alias("slots"))
    return _numeric(spark, sf).unionByName(more)


DEPTH = 4


def best_ways_parts(spark, sf):
    """The best way to each part's capability within a few levels, from c0, c1 and c5."""
    found = P.best_ways(_two_ways(spark, sf), ["c0", "c1", "c5"], DEPTH)
    return found.select("cap", F.array_join("chain", ",").alias("chain"), F.array_join("residue", ",").alias("residue"))


def predict_parts(spark, sf):
    """Which of the parts' units could be built from what those ways make without residue; every fifth has a slot, and slot0 is bound."""
    pool = _two_ways(spark, sf).withColumn("slots", F.when(F.col("pos") % 5 == 0, F.array(F.lit("slot0"), F.lit("slot1"))).otherwise(F.col("slots")))
    available = P.best_ways(pool, ["c0", "c1", "c5"], DEPTH).where(F.size("residue") == 0).select("cap")
    return P.predict(pool, available, ["slot0"]).select("name", "status", F.array_join("capability_residue", ",").alias("capability_residue"), F.array_join("binding_residue", ",").alias("binding_residue"))


#: A part whose capability has two providers.
_TARGET = "c12"


def derivations(spark, sf):
    d = P.derivations(_two_ways(spark, sf), _TARGET, ["c0", "c1", "c5"], DEPTH)
    return d.select("pos", F.array_join("chain", ",").alias("chain"), F.array_join("residue", ",").alias("residue"))


def residue(spark, sf):
    pool = _two_ways(spark, sf)
    return spark.createDataFrame([(t, ",".join(P.residue(pool, t, ["c0", "c1", "c5"], DEPTH))) for t in ("c51", "none")], "target string, residue string")


def _names(spark, sf):
    """The distinct tokens of every document's whole text."""
    return table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(T.tokenize(F.col("text")))).alias("name"))


def _classified(spark, sf):
    return X.classify_names(_names(spark, sf), spark.createDataFrame(RINGS, "pos int, ring string, member string"), CONFIG, KNOWN)


def classify_names(spark, sf):
    return _classified(spark, sf).groupBy("alphabet").agg(F.count("*").alias("n"), F.count_distinct("name").alias("n_names"))


def doc_verdict(spark, sf):
    found = X.verdicts(_classified(spark, sf), "doc_id")
    return table(spark, sf, "documents").select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("verdict", F.lit("pure")).alias("verdict"))


def doc_params_verdict(spark, sf):
    """Verdicts where a document's language and source are its parameters, and a language and two sources name config slots: ``de``, otherwise a ring's, among them."""
    docs = table(spark, sf, "documents").select("doc_id", F.explode(F.array("lang", "source")).alias("name"))
    found = X.verdicts(X.with_params(_classified(spark, sf), docs, ["de", "src1", "src2"], "doc_id"), "doc_id")
    return table(spark, sf, "documents").select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("verdict", F.lit("pure")).alias("verdict"), "placement")


def doc_placement(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(X.verdicts(_classified(spark, sf), "doc_id").select("doc_id", "placement"), "doc_id", "left")


def curry_plan(spark, sf):
    return X.curry_plan(_classified(spark, sf)).groupBy("action").agg(F.count("*").alias("n"))


def _turns(spark, sf):
    tokens = F.array_distinct(T.tokenize(F.col("text")))
    return table(spark, sf, "conversations").select("conv_id", "turn", tokens.alias("tokens"))


def effect_blocks(spark, sf):
    b = _turns(spark, sf).select("conv_id", F.col("turn").alias("i"), F.col("tokens").alias("reads"), F.filter("tokens", lambda x: F.length(x) == 2).alias("writes"))
    # the block's own writes are no frees: a name first written at i itself is not later than i
    return X.effect_blocks(b, ["the", "les", "und", "que"], "conv_id").select("conv_id", "i", F.size("global_frees").alias("n_frees"), "effect")


def _candidates(spark, sf):
    tokens = lambda c: F.array_distinct(T.tokenize(c))
    d = table(spark, sf, "documents")
    return d.select(
        F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 13 == 0, "").otherwise(F.col("source")).alias("seat"), F.lit("demand").alias("demand"), F.lit("because").alias("rationale"),
        tokens(F.col("text")).alias("reads"), F.when(F.col("doc_id") % 3 == 0, F.array_append(tokens(F.col("text")), F.lit("zz9"))).otherwise(tokens(F.col("text"))).alias("declared_reads"),
        F.array(F.lit("w")).alias("writes"), F.array(F.when(F.col("doc_id") % 5 == 0, "v").otherwise("w")).alias("declared_writes"), F.array(F.lit("id")).alias("shadowed"),
        F.when(F.col("doc_id") % 11 == 0, "zz").otherwise(F.col("lang")).alias("ring"),
    )


def intake_diff(spark, sf):
    r = spark.createDataFrame([x[1:] for x in RINGS], "ring string, member string")
    return X.intake(_candidates(spark, sf), r).select("id", "status", "reason", F.array_join("overclaimed", ",").alias("overclaimed"))


_BASE = ["a", "an", "as", "at", "au", "be"]


def _rings_of_turns(spark, sf):
    """A conversation as a stack, a turn a ring: short tokens are added, tokens of two and four letters required and accessed."""
    t = _turns(spark, sf)
    of = lambda n: F.filter("tokens", lambda x: F.length(x) == n)
    return t.select("conv_id", F.col("turn").alias("depth"), F.filter("tokens", lambda x: F.length(x) <= 3).alias("adds"), F.filter(of(2), lambda x: x < "c").alias("requires"), F.filter(of(4), lambda x: x < "b").alias("accesses"))


def stack_validate(spark, sf):
    return X.validate_stack(_rings_of_turns(spark, sf), "conv_id", _BASE).select("conv_id", "status", "depth", "reason", F.array_join("names", ",").alias("names"))


def _slots(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "lang")
    slots = d.select(F.col("source").alias("instance"), F.col("lang").alias("verb"), F.col("doc_id").alias("pos"), F.concat(F.lit("s"), F.col("doc_id") % 40).alias("slot"))
    bound = d.join(table(spark, sf, "labels"), "doc_id").where("toxic = 1").select(F.col("source").alias("instance"), F.col("doc_id").alias("pos"), F.concat(F.lit("s"), F.col("doc_id") % 40).alias("slot"), F.col("quality").cast("string").alias("value"))
    return slots, bound


def soup(spark, sf):
    slots, bound = _slots(spark, sf)
    return X.soup(slots, bound).select("instance", "verb", F.array_join("unbound", ",").alias("unbound"))


def heat(spark, sf):
    return X.heat(*_slots(spark, sf))


def bind_new(spark, sf):
    slots, bound = _slots(spark, sf)
    requests = slots.select("instance", "pos", "slot", F.lit("x").alias("value"))
    return X.bind(requests, bound).select("instance", "pos", "slot", "status")


def morph_split(spark, sf):
    slots, bound = _slots(spark, sf)
    return X.morph(bound, slots.where("verb = 'en'")).select("instance", "slot", "pos", "transported")


def shared_params(spark, sf):
    line = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("fn"), F.col("l_partkey").alias("param"), F.col("l_linenumber").alias("pos")).distinct()
    s = line.select("fn", "param", "pos", F.lit("positional").alias("kind"), (F.col("pos") > 3).alias("has_default"))
    return X.shared_params(s, 30).groupBy("role").agg(F.count("*").alias("n"), F.count_distinct("param").alias("n_params"))


def bound_query(spark, sf):
    table(spark, sf, "lineitem").createOrReplaceTempView("_bound_lineitem")
    q = X.BoundQuery(spark, "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM _bound_lineitem WHERE l_discount <= :most AND l_quantity >= :least GROUP BY l_returnflag", ("most", "least"))
    return q.bind("most", 0.05)(least=10)


def bound_group(spark, sf):
    """Two methods over the line items that share the slot least: only one of them has a further slot."""
    table(spark, sf, "lineitem").createOrReplaceTempView("_group_lineitem")
    select = "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM _group_lineitem WHERE l_quantity >= :least"
    methods = {"cheap": (f"{select} AND l_discount >= :discount GROUP BY l_returnflag", ("least", "discount")), "taxed": (f"{select} AND l_tax >= :tax GROUP BY l_returnflag", ("least", "tax"))}
    g = X.BoundGroup(spark, methods, ("least", "discount"), {"tax": 0.04}).bind("least", 10)
    taxed, cheap = g.call("taxed"), g.bind("discount", 0.05).call("cheap")
    return taxed.withColumn("method", F.lit("taxed")).unionByName(cheap.withColumn("method", F.lit("cheap")))


def _sources(spark, sf):
    """Four shapes of source text for each part, with its key and brand in them."""
    p = dealt(table(spark, sf, "part").select("p_partkey", "p_brand"), "p_partkey").select("p_partkey", F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "_")).alias("brand"))
    shapes = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("text")) for n, t in SOURCES.items()])).alias("s")
    text = F.regexp_replace(F.regexp_replace("s.text", r"\bn\b", F.concat(F.lit("n_"), F.col("brand"))), r"\b1\b", F.col("p_partkey").cast("string"))
    return p.select("p_partkey", "brand", shapes).select(F.concat("s.name", F.lit("_"), "p_partkey").alias("source_name"), text.alias("src"))


def blockify_rows(spark, sf):
    return B.applied(_sources(spark, sf), B.Blockify, True, False).select("source_name", "i", "kind", F.array_join("reads", ",").alias("reads"), F.array_join("writes", ",").alias("writes"), "capture_risk", "reason")


def module_report(spark, sf):
    return B.applied(_sources(spark, sf), B.ModuleReport)


def block_functions(spark, sf):
    """Blocks of the sources that can be cut, as functions of their own."""
    rows = B.applied(_sources(spark, sf), B.Blockify, True).where("reason IS NULL")
    return rows.select("source_name", "i", B.functionalize(F.col("source_name"), F.col("i"), F.col("reads"), F.col("writes"), F.col("source")).alias("text"))


def signatures(spark, sf):
    return B.applied(_sources(spark, sf), B.Signature)


def self_accesses(spark, sf):
    return B.applied(_sources(spark, sf), B.SelfAccesses).select("source_name", F.array_join("accesses", ",").alias("accesses"), "reason")


def derived_envelopes(spark, sf):
    d = B.applied(_sources(spark, sf), B.Derive)
    return d.select("source_name", "name", *[F.array_join(c, ",").alias(c) for c in ("reads", "writes", "builtin_named")], "n_blocks", "reason")


def callable_units(spark, sf):
    u = B.applied(_sources(spark, sf), B.CallableUnit)
    return u.select("source_name", "name", *[F.array_join(c, ",").alias(c) for c in ("provides", "requires", "slots")], "reason")


def relational_validation(spark, sf):
    """Whether the relations that each name of the log declares stack up: a conversation stands for the name of its number."""
    rings = _rings_of_turns(spark, sf).select(F.concat(F.lit("c"), "conv_id").alias("name"), "depth", "adds", "requires", "accesses")
    log = rings.select("name").distinct().select(F.xxhash64("name").alias("seq"), "name", F.lit("node").alias("kind"), F.md5("name").alias("graph_identity"))
    log = spark.createDataFrame([], LOG_SCHEMA).unionByName(log, allowMissingColumns=True)
    return C.gauge(log, rings, _BASE).select("name", "relational_validation")


def static_calls(spark, sf):
    return B.applied(_sources(spark, sf), B.StaticCalls)


def owl_individuals(spark, sf):
    s = C.node_states(as_log(spark, sf)).where("n_nodes > 0")
    return s.select("name", F.md5(W.owl_individual(F.col("name"), F.col("level"), F.col("w"), F.col("r"))).alias("digest"))


def _witnessed(spark, sf):
    """(predicate, idx, name): the steps that each user has witnessed, in order."""
    steps = F.posexplode(F.array(*[F.when(F.col("w").bitwiseAND(1 << i) != 0, F.lit(n)) for i, n in enumerate(dims.COOLING)])).alias("idx", "name")
    return _user_masks(spark, sf).select(F.concat(F.lit("witnessed_u"), "user_id").alias("predicate"), steps).where("name IS NOT NULL")


def prolog_facts(spark, sf):
    return W.indexed_facts(_witnessed(spark, sf))


def prolog_roundtrip(spark, sf):
    lines = W.indexed_facts(_witnessed(spark, sf)).select(F.col("line").alias("value"))
    return W.parse_prolog(lines).select("predicate", F.array_join("atoms", ",").alias("atoms"))


def xml_rings(spark, sf):
    """Regions as stacks of their nations' rings, as XML and back."""
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    verb = F.struct(F.lower("n_name").alias("_name"), F.concat(F.lit("a < "), "n_nationkey").alias("source"), F.array(F.lit("who")).alias("slot"))
    ring = F.struct("n_nationkey", F.col("n_name").alias("_name"), F.array(F.lower("n_name"), F.lit("all")).alias("adds"), F.array(F.lower("r_name")).alias("requires"), F.array(verb).alias("verb"))
    held = n.groupBy("r_name").agg(F.array_sort(F.collect_list(ring)).alias("l"))
    rings = F.transform("l", lambda x: F.struct(*[x[c].alias(c) for c in ("_name", "adds", "requires", "verb")]))
    d = held.select(W.rings_to_xml(F.struct(F.col("r_name").alias("_name"), rings.alias("ring"))).alias("text")).select(W.rings_from_xml(F.col("text")).alias("o"))
    return d.select(F.col("o._name").alias("onion"), F.posexplode("o.ring").alias("depth", "r")).select("onion", "depth", F.col("r._name").alias("ring"), F.array_join(F.col("r.adds"), ",").alias("adds"), F.array_join(F.col("r.requires"), ",").alias("requires"), F.size("r.verb").alias("n_verbs"))


def evolve_threshold(spark, sf):
    """A quantity threshold evolved towards half of all line items."""
    counted = cut(table(spark, sf, "lineitem").groupBy("l_quantity").agg(F.count("*").alias("k")))
    n = counted.agg(F.sum("k")).first()[0]

    def score(genomes):
        config = genomes.select("id", F.get_json_object("config", "$.threshold").cast("int").alias("t"))
        above = counted.join(F.broadcast(config), F.col("l_quantity") >= F.col("t"))  # a brood is bounded
        return above.groupBy("id").agg((-F.abs(F.sum("k") / F.lit(float(n)) - 0.5)).alias("fitness"))

    def nudge(ops, rng: random.Random):
        now = ops[0][2] if ops else 10
        return [[("override", ("threshold",), max(1, now + rng.choice([-9, -3, 3, 9, 15])))] for _ in range(3)]

    return V.evolve(spark, {"threshold": 10}, score, [nudge], generations=5, lam=6, seed=3)


def _sql_list(items):
    return ", ".join(f"'{x}'" for x in items)


_TOKENS = "tok AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '([a-z'']+)', 1)) AS name FROM documents)"
_CLS = f"{_TOKENS}, rings AS (SELECT * FROM (VALUES {', '.join(f'({p}, {chr(39)}{r}{chr(39)}, {chr(39)}{m}{chr(39)})' for p, r, m in RINGS)}) t(pos, ring, member)), cls AS (SELECT doc_id, name, CASE WHEN ring IS NOT NULL THEN 'ring:' || ring WHEN name IN ({_sql_list(CONFIG)}) THEN 'config' WHEN name IN ({_sql_list([*dims.EFFECT_AMBIENT, *dims.EFFECT_CALLS])}) THEN 'ambient:effect' WHEN name IN ({_sql_list(dims.PURE_AMBIENT)}) THEN 'ambient:pure' WHEN name IN ({_sql_list(KNOWN)}) THEN 'known' ELSE 'demand' END AS alphabet FROM tok LEFT JOIN rings ON member = name)"
_PLACED = "mass AS (SELECT doc_id, alphabet[6:] AS ring, count(*) AS m FROM cls WHERE starts_with(alphabet, 'ring:') GROUP BY 1, 2), placed AS (SELECT doc_id, ring AS placement FROM mass QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY m DESC, ring) = 1)"
_TURNS = "t AS (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(lower(text), '([a-z'']+)', 1)) AS name FROM conversations)"
_SLOTS = "s AS (SELECT source AS instance, lang AS verb, doc_id AS pos, 's' || (doc_id % 40) AS slot FROM documents), b AS (SELECT source AS instance, doc_id AS pos, 's' || (doc_id % 40) AS slot FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)"
_FLAGS = " || chr(10) || ".join(f"'    <{p} rdf:datatype=\"{W.BOOLEAN}\">' || CASE WHEN ({m} >> {i}) & 1 = 1 THEN 'true' ELSE 'false' END || '</{p}>'" for names, m, pre in ((dims.COOLING, "w", "witnessed_"), (dims.RITES, "r", "rite_")) for i, p in ((i, pre + n) for i, n in enumerate(names)))

def _best_ways_sql(depth: int = DEPTH, without: str = "") -> str:
    """Ways level by level: a level joins each unit's requirements with the level before."""
    steps = ["""u AS (SELECT p_partkey AS pos, 'u' || p_partkey AS name, 'c' || p_partkey AS cap, CASE WHEN p_partkey % 17 = 0 THEN ['none'] ELSE ['c' || p_partkey // 2, 'c' || p_partkey // 3] END AS requires FROM part
  UNION ALL SELECT p_partkey + 100000000, 'v' || p_partkey, 'c' || p_partkey, ['c' || (p_partkey + 1)] FROM part WHERE p_partkey % 3 = 0)""",
        "given AS (SELECT unnest(['c0', 'c1', 'c5']) AS cap)",
        "leaf AS (SELECT DISTINCT cap FROM (SELECT unnest(requires) AS cap FROM u) WHERE cap NOT IN (SELECT cap FROM u) AND cap NOT IN (SELECT cap FROM given))",
        "n AS (SELECT cap, pos, name, len(requires) AS n, unnest(requires) AS need, unnest(range(len(requires))) AS k FROM u WHERE cap NOT IN (SELECT cap FROM given) AND cap <> '" + without + "')",
        "w0 AS (SELECT cap, []::VARCHAR[] AS chain, []::VARCHAR[] AS residue FROM given)"]
    once = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
    for d in range(1, depth + 1):
        chain, rest = once.format("flatten(list(w.chain ORDER BY k))"), once.format("flatten(list(w.residue ORDER BY k))")
        steps.append(f"m{d} AS (SELECT n.cap, pos, name, {chain} AS chain, list_sort({rest}) AS residue FROM n JOIN w{d - 1} w ON w.cap = need GROUP BY n.cap, pos, name, n HAVING count(*) = n)")
        steps.append(f"w{d} AS (SELECT cap, []::VARCHAR[] AS chain, []::VARCHAR[] AS residue FROM given UNION ALL SELECT cap, [], [cap] FROM leaf UNION ALL SELECT cap, list_append(chain, name), residue FROM (SELECT *, row_number() OVER (PARTITION BY cap ORDER BY len(residue), len(chain), pos) AS best FROM m{d}) WHERE best = 1)")
    return "WITH " + ", ".join(steps)


QUERIES = {f.__name__: f for f in (predict_status, closure_fixture, closure_numeric, best_ways_parts, predict_parts, derivations, residue, classify_names, doc_verdict, doc_params_verdict, doc_placement, curry_plan, effect_blocks, intake_diff, stack_validate, soup, heat, bind_new, morph_split, shared_params, bound_query, bound_group, blockify_rows, module_report, static_calls, block_functions, signatures, self_accesses, derived_envelopes, callable_units, relational_validation, owl_individuals, prolog_facts, prolog_roundtrip, xml_rings, evolve_threshold)}
ORACLES = {
    "bound_group": "SELECT 'taxed' AS method, l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_quantity >= 10 AND l_tax >= 0.04 GROUP BY l_returnflag UNION ALL SELECT 'cheap', l_returnflag, count(*), round(sum(l_quantity), 2) FROM lineitem WHERE l_quantity >= 10 AND l_discount >= 0.05 GROUP BY l_returnflag",
    "predict_status": " UNION ALL ".join(f"SELECT '{label}' AS base, 'u' || p_partkey AS name, CASE WHEN len(lack) > 0 THEN 'blocked' WHEN p_partkey % 5 = 0 THEN 'buildable' ELSE 'active' END AS status, array_to_string(lack, ',') AS capability_residue, CASE WHEN p_partkey % 5 = 0 THEN 'slot1' ELSE '' END AS binding_residue FROM (SELECT p_partkey, list_sort(list_distinct(list_filter(CASE WHEN p_partkey % 17 = 0 THEN ['none'] ELSE ['c' || p_partkey // 2, 'c' || p_partkey // 3] END, lambda x: x NOT IN {base}))) AS lack FROM part)" for label, base in (("few", ("c0", "c1")), ("more", ("c0", "c1", "c2", "c3", "none")))),
    "closure_fixture": f"WITH RECURSIVE a AS (SELECT 0 AS round, [0::BIGINT] AS have UNION ALL SELECT round + 1, list_concat(have, new) FROM (SELECT round, have, (SELECT coalesce(list(i), []) FROM range(1, {_POOL + 1}) t(i) WHERE i % 17 <> 0 AND NOT list_contains(have, i) AND list_contains(have, i // 2) AND list_contains(have, i // 3)) AS new FROM a) WHERE len(new) > 0), f AS (SELECT DISTINCT unnest(have) AS i FROM a), m AS (SELECT p_partkey // {_POOL} AS pool, p_partkey % {_POOL} + 1 AS i FROM part), g AS (SELECT pool, list('c' || i ORDER BY i) AS o, list('u' || i ORDER BY 'u' || i) AS v FROM m WHERE i IN (SELECT i FROM f) GROUP BY 1) SELECT pool, array_to_string(list_sort(list_append(coalesce(o, []), 'c0')), ',') AS available, coalesce(array_to_string(o, ','), '') AS \"order\", coalesce(array_to_string(v, ','), '') AS active FROM (SELECT DISTINCT pool FROM m) LEFT JOIN g USING (pool)",
    "closure_numeric": "WITH RECURSIVE p AS (SELECT p_partkey AS i FROM part), lim AS (SELECT max(i) AS m FROM p), a AS (SELECT 0 AS round, [0::BIGINT] AS have UNION ALL SELECT round + 1, list_concat(have, new) FROM (SELECT round, have, (SELECT coalesce(list(i), []) FROM p WHERE i % 17 <> 0 AND NOT list_contains(have, i) AND list_contains(have, i // 2) AND list_contains(have, i // 3)) AS new FROM a) WHERE len(new) > 0), f AS (SELECT round, unnest(have) AS i FROM a) SELECT 'u' || i AS name, CAST(min(round) AS INT) AS round FROM f WHERE i > 0 GROUP BY i",
    "derivations": _best_ways_sql(DEPTH - 1, _TARGET) + f", t AS (SELECT pos, name, len(requires) AS n, unnest(requires) AS need, unnest(range(len(requires))) AS k FROM u WHERE cap = '{_TARGET}'), x AS (SELECT pos, name, flatten(list(w.chain ORDER BY k)) AS c, flatten(list(w.residue ORDER BY k)) AS r FROM t JOIN w{DEPTH - 1} w ON w.cap = need GROUP BY pos, name, n HAVING count(*) = n) SELECT CAST(row_number() OVER (ORDER BY pos) - 1 AS INT) AS pos, array_to_string(list_append(list_filter(c, lambda y, i: list_position(c, y) = i), name), ',') AS chain, array_to_string(list_sort(list_distinct(r)), ',') AS residue FROM x",
    "residue": _best_ways_sql() + f" SELECT t AS target, CASE WHEN w.cap IS NULL THEN t ELSE array_to_string(residue, ',') END AS residue FROM (SELECT unnest(['c51', 'none']) AS t) LEFT JOIN w{DEPTH} w ON w.cap = t",
    "best_ways_parts": _best_ways_sql() + f" SELECT cap, array_to_string(chain, ',') AS chain, array_to_string(residue, ',') AS residue FROM w{DEPTH}",
    "predict_parts": _best_ways_sql() + f", a AS (SELECT cap FROM w{DEPTH} WHERE len(residue) = 0), r AS (SELECT DISTINCT name, unnest(requires) AS cap FROM u), y AS (SELECT name, list(cap ORDER BY cap) AS l FROM r WHERE cap NOT IN (SELECT cap FROM a) GROUP BY 1), x AS (SELECT name, pos, coalesce(l, []) AS lack FROM u LEFT JOIN y USING (name)) SELECT name, CASE WHEN len(lack) > 0 THEN 'blocked' WHEN pos % 5 = 0 THEN 'buildable' ELSE 'active' END AS status, array_to_string(lack, ',') AS capability_residue, CASE WHEN pos % 5 = 0 THEN 'slot1' ELSE '' END AS binding_residue FROM x",
    "classify_names": f"WITH {_CLS} SELECT alphabet, count(*) AS n, count(DISTINCT name) AS n_names FROM cls GROUP BY 1",
    "doc_verdict": f"WITH {_CLS}, {_PLACED} SELECT doc_id, CASE WHEN bool_or(alphabet = 'ambient:effect') THEN 'effectful' WHEN bool_or(alphabet = 'demand') THEN 'open' WHEN bool_or(alphabet = 'config') THEN 'config_dependent' WHEN any_value(placement) IS NOT NULL THEN 'ring_coupled:' || any_value(placement) ELSE 'pure' END AS verdict FROM documents LEFT JOIN cls USING (doc_id) LEFT JOIN placed USING (doc_id) GROUP BY 1",
    "doc_params_verdict": f"WITH {_CLS.replace('cls AS (', 'cls0 AS (')}, par AS (SELECT DISTINCT doc_id, name FROM (SELECT doc_id, unnest([lang, source]) AS name FROM documents) WHERE name IN ('de', 'src1', 'src2')), cls AS (SELECT * FROM cls0 ANTI JOIN par USING (doc_id, name) UNION ALL SELECT doc_id, name, 'config' FROM par), {_PLACED} SELECT doc_id, CASE WHEN bool_or(alphabet = 'ambient:effect') THEN 'effectful' WHEN bool_or(alphabet = 'demand') THEN 'open' WHEN bool_or(alphabet = 'config') THEN 'config_dependent' WHEN any_value(placement) IS NOT NULL THEN 'ring_coupled:' || any_value(placement) ELSE 'pure' END AS verdict, any_value(placement) AS placement FROM documents LEFT JOIN cls USING (doc_id) LEFT JOIN placed USING (doc_id) GROUP BY 1",
    "doc_placement": f"WITH {_CLS}, {_PLACED} SELECT doc_id, placement FROM documents LEFT JOIN placed USING (doc_id)",
    "curry_plan": f"WITH {_CLS} SELECT CASE WHEN starts_with(alphabet, 'ring:') THEN 'bind_ring:' || alphabet[6:] WHEN alphabet = 'config' THEN 'curry_to_slot' WHEN alphabet = 'ambient:effect' THEN 'isolate_effect' WHEN alphabet = 'demand' THEN 'demand' ELSE 'leave' END AS action, count(*) AS n FROM cls GROUP BY 1",
    "effect_blocks": f"WITH {_TURNS}, w AS (SELECT conv_id, name, min(turn) AS first FROM t WHERE length(name) = 2 GROUP BY 1, 2), r AS (SELECT t.conv_id, t.turn, t.name FROM t LEFT JOIN w USING (conv_id, name) WHERE (first IS NULL OR first > t.turn)), g AS (SELECT conv_id, turn, count(*) AS n, bool_or(name IN ('the', 'les', 'und', 'que')) AS e FROM r GROUP BY 1, 2) SELECT c.conv_id, c.turn AS i, CAST(coalesce(n, 0) AS INT) AS n_frees, coalesce(e, false) AS effect FROM conversations c LEFT JOIN g USING (conv_id, turn)",
    "intake_diff": f"WITH {_CLS}, mass AS (SELECT doc_id, ring, count(*) AS m FROM tok JOIN rings ON member = name GROUP BY 1, 2), n AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY 1), c AS (SELECT d.doc_id, CASE WHEN doc_id % 11 = 0 THEN 'zz' ELSE lang END AS ring, coalesce(n, 0) AS n FROM documents d LEFT JOIN n USING (doc_id)), o AS (SELECT c.*, coalesce(a.m, 0) AS own, coalesce((SELECT max(m) FROM mass b WHERE b.doc_id = c.doc_id AND b.ring <> c.ring), 0) AS other FROM c LEFT JOIN mass a ON a.doc_id = c.doc_id AND a.ring = c.ring), x AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'missing_intent' WHEN doc_id % 3 = 0 THEN 'reads_differ' WHEN doc_id % 5 = 0 THEN 'writes_differ' WHEN ring NOT IN ('en', 'fr', 'de') THEN 'no_such_ring' WHEN own = 0 AND n > 0 THEN 'no_support' WHEN other >= own THEN 'not_unique' END AS reason FROM o) SELECT doc_id AS id, CASE WHEN reason IS NULL THEN 'admitted' ELSE 'refused' END AS status, reason, CASE WHEN doc_id % 3 = 0 THEN 'zz9' ELSE '' END AS overclaimed FROM x",
    "stack_validate": f"WITH {_TURNS}, a AS (SELECT conv_id, name, min(turn) AS first FROM t WHERE length(name) <= 3 GROUP BY 1, 2), gap AS (SELECT t.conv_id, turn AS depth, 0 AS chk, string_agg(t.name, ',' ORDER BY t.name) AS names FROM t LEFT JOIN a USING (conv_id, name) WHERE length(t.name) = 2 AND t.name < 'c' AND t.name NOT IN ('a', 'an', 'as', 'at', 'au', 'be') AND (first IS NULL OR first >= turn) GROUP BY 1, 2), leak AS (SELECT conv_id, turn AS depth, 1 AS chk, string_agg(name, ',' ORDER BY name) AS names FROM t WHERE length(name) = 4 AND name < 'b' GROUP BY 1, 2), f AS (SELECT * FROM (SELECT * FROM gap UNION ALL SELECT * FROM leak) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY depth, chk) = 1) SELECT c.conv_id, CASE WHEN f.conv_id IS NULL THEN 'ok' ELSE 'refused' END AS status, depth, CASE chk WHEN 0 THEN 'missing' WHEN 1 THEN 'leak' END AS reason, names FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN f USING (conv_id)",
    "relational_validation": "",
    "soup": f"WITH {_SLOTS} SELECT instance, verb, string_agg(slot, ',' ORDER BY pos) AS unbound FROM s ANTI JOIN b USING (instance, slot) GROUP BY 1, 2",
    "heat": f"WITH {_SLOTS}, o AS (SELECT instance, count(DISTINCT slot) AS h FROM s ANTI JOIN b USING (instance, slot) GROUP BY 1) SELECT i.instance, coalesce(h, 0) AS heat FROM (SELECT DISTINCT instance FROM s) i LEFT JOIN o USING (instance)",
    "bind_new": f"WITH {_SLOTS} SELECT instance, pos, slot, CASE WHEN row_number() OVER (PARTITION BY instance, slot ORDER BY pos) = 1 AND NOT EXISTS (SELECT 1 FROM b WHERE b.instance = s.instance AND b.slot = s.slot) THEN 'bound' ELSE 'refused' END AS status FROM s",
    "morph_split": f"WITH {_SLOTS} SELECT instance, slot, pos, slot IN (SELECT slot FROM s WHERE verb = 'en') AS transported FROM b",
    "shared_params": "WITH l AS (SELECT DISTINCT l_suppkey AS fn, l_partkey AS param, l_linenumber AS pos FROM lineitem), c AS (SELECT param FROM l GROUP BY 1 HAVING count(DISTINCT fn) >= 30), r AS (SELECT l.*, CASE WHEN c.param IS NOT NULL THEN 'config' WHEN pos > 3 THEN 'call' ELSE 'required_call' END AS role FROM l LEFT JOIN c USING (param)) SELECT role, count(*) AS n, count(DISTINCT param) AS n_params FROM r GROUP BY 1",
    "bound_query": "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_discount <= 0.05 AND l_quantity >= 10 GROUP BY 1",
    "owl_individuals": f"WITH {_LOG} SELECT name, md5('  <owl:NamedIndividual rdf:about=\"#' || name || '\">' || chr(10) || '    <rdf:type rdf:resource=\"#AtLeast_' || {_pick(dims.LADDER, 'level')} || '\"/>' || chr(10) || {_FLAGS} || chr(10) || '  </owl:NamedIndividual>') AS digest FROM st WHERE n_nodes > 0",
    "xml_rings": "SELECT r_name AS onion, CAST(row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) - 1 AS INT) AS depth, n_name AS ring, lower(n_name) || ',all' AS adds, lower(r_name) AS requires, 1 AS n_verbs FROM nation JOIN region ON n_regionkey = r_regionkey",
    "prolog_facts": f"WITH {_U}, s AS (SELECT user_id, w, unnest(range(7)) AS idx FROM u) SELECT 'witnessed_u' || user_id AS predicate, CAST(idx AS INT) AS idx, 'witnessed_u' || user_id || '(' || idx || ', ' || {_pick(dims.COOLING, 'idx')} || ').' AS line FROM s WHERE (w >> idx) & 1 = 1",
    "prolog_roundtrip": f"WITH {_U}, s AS (SELECT user_id, w, unnest(range(7)) AS idx FROM u) SELECT 'witnessed_u' || user_id AS predicate, string_agg({_pick(dims.COOLING, 'idx')}, ',' ORDER BY idx) AS atoms FROM s WHERE (w >> idx) & 1 = 1 GROUP BY user_id",
}
ORACLES["relational_validation"] = f"SELECT 'c' || conv_id AS name, status = 'ok' AS relational_validation FROM ({ORACLES['stack_validate']})"
