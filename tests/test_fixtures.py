"""Exact fixtures, exhaustive laws and seeded differential tests of the core operators."""

import json
import random

import pytest
from pyspark.sql import functions as F

from fixlattice.functions import dims, lattice, stats
from fixlattice.functions import text as T
from fixlattice.operators import attributes, checks, climb, deduce, deltas, evolve, graph, selection, source_rows
from fixlattice.operators import log as G
from fixlattice.plans.checking import SOURCES, UNITS
from fixlattice.sources import codecs, log_store

WILSON = [(0, 10, 0.0, 0.2775401687666166), (5, 58, 0.03738483193379338, 0.18643861377265664), (6, 58, 0.04828075015859154, 0.20788338531008968), (7, 58, 0.059708902448596696, 0.22879592278231584), (58, 58, 0.9378800031047062, 1.0), (1, 2, 0.09452865480086614, 0.9054713451991339), (50, 580, 0.06600049440043944, 0.11185870576618111), (0, 0, 0.0, 1.0)]
GENOMES = {"[]": "g_4f53cda18c2baa0c", '[["override", ["x"], 1]]': "g_802f4fef4f3df97b", '[["override", ["x"], 2]]': "g_4450795dfa4c3c64", '[["add", ["a"], 1]]': "g_e193584f56caf15a", '[["exclude", ["nope"], null]]': "g_e3af59accf1eec1c"}


def test_wilson(spark):
    df = stats.with_rate(spark.createDataFrame([w[:2] for w in WILSON], "k long, n long"))
    for r, (_, _, lo, hi) in zip(df.collect(), WILSON):
        assert r.lo == pytest.approx(lo, abs=1e-12) and r.hi == pytest.approx(hi, abs=1e-12)
    odd = stats.with_rate(spark.createDataFrame([(3, 2), (-1, 5)], "k long, n long")).collect()
    assert all(r.lo is None and r.hi is None for r in odd)


def test_genome_ids(spark):
    df = spark.createDataFrame([(k,) for k in GENOMES], "ops string").select("ops", deltas.genome_id(F.col("ops")).alias("id"))
    assert {r.ops: r.id for r in df.collect()} == GENOMES
    for ops, i in GENOMES.items():
        assert evolve.genome_id([(op, tuple(p), v) for op, p, v in json.loads(ops)]) == i


def test_word_statistics(spark):
    docs = spark.createDataFrame([(1, "The cat and the dog. A cat!"), (2, ""), (3, None), (4, "  Zé \n")], "doc_id long, text string")
    stop = ["the", "a", "and"]
    assert {(r.word, r.n) for r in T.word_count(docs.where("doc_id = 1"), stop).collect()} == {("cat", 2), ("dog", 1)}
    got = {r.doc_id: (r.total, r.top) for r in T.report(docs, stop, 1, "doc_id").collect()}
    assert got[1] == (3, "cat=2") and got[2] == (0, "")
    assert docs.where("doc_id = 4").select(T.normalize(F.col("text"))).first()[0] == "zé"


def test_selection(spark):
    rows = [(0, "base", 5, 58), (1, "neutral", 5, 58), (2, "better", 7, 58)]
    s = stats.with_rate(spark.createDataFrame(rows, "pos int, name string, k long, n long")).withColumn("primary", F.col("rate"))
    assert [r.name for r in selection.hillclimb(s, 2, 5 / 58).collect()] == ["better"]
    assert [r.name for r in selection.mu_plus_lambda(s.where("pos > 0"), 2, 5 / 58).orderBy("rank").collect()] == ["better", "neutral"]
    v = spark.createDataFrame([(0, 1, 0), (1, 0, 1), (2, 0, 0), (3, 1, 0)], "pos int, a int, b int")
    assert sorted(r.pos for r in selection.pareto_front(v, ["a", "b"]).collect()) == [0, 1, 3]
    v3 = v.withColumn("c", F.lit(1))
    assert sorted(r.pos for r in selection.pareto_front(v3, ["a", "b", "c"]).collect()) == [0, 1, 3]
    u = stats.with_rate(spark.createDataFrame([(0, 10, 80), (1, 1, 8)], "pos int, k long, n long")).withColumn("primary", F.col("rate"))
    assert selection.ucb(u, 1).first().pos == 1
    assert selection.tournament(s, 3).count() == 3


def test_lattice_laws(spark):
    s = lattice.all_states(spark)
    assert s.count() == 81_920
    assert s.agg(F.sum(lattice.distance(F.col("level"), F.col("w"), F.col("r")))).first()[0] == 901_120
    some = s.where("(level * 8192 + w * 64 + r) % 4099 = 0")
    ends = lattice.chain(some).groupBy().agg(F.max("step"), F.max("level")).first()
    assert ends[1] == dims.TOP_LEVEL
    l, w, r = lattice.closure_step(F.col("level"), F.col("w"), F.col("r"))
    stepped = some.select("level", "w", "r", F.struct(l.alias("level"), w.alias("w"), r.alias("r")).alias("n"))
    second = lattice.chain(some.select("level", "w", "r", F.struct("level", "w", "r").alias("from"))).where("step = 1").select("from", F.struct("level", "w", "r").alias("n2"))
    joined = stepped.select(F.struct("level", "w", "r").alias("from"), "n").join(second, "from")
    assert joined.where("n <> n2").isEmpty() and joined.count() > 0


def _fold(ops, base):
    tree = dict(base)
    for seq, (op, path, value) in enumerate(ops):
        if (op == "add" and path in tree) or (op == "exclude" and path not in tree):
            return tree, seq
        if op == "exclude":
            del tree[path]
        else:
            tree[path] = value
    return tree, None


def test_apply_equals_a_sequential_fold(spark):
    rng = random.Random(5)
    base = {"a": "1", "b": "2"}
    programs = [[(rng.choice(deltas.OPS), rng.choice("abcd"), str(rng.randrange(9))) for _ in range(rng.randrange(1, 6))] for _ in range(150)]
    rows = [(i, s, *d) for i, p in enumerate(programs) for s, d in enumerate(p)]
    df = spark.createDataFrame(rows, "program long, seq long, op string, path string, value string")
    found = deltas.apply_programs(df, spark.createDataFrame(list(base.items()), "path string, value string")).collect()
    for i, p in enumerate(programs):
        tree, stop = _fold(p, base)
        own = [r for r in found if r.program == i]
        assert {r.path: r.value for r in own} == tree
        assert all(r.abort_seq == stop for r in own)
    trees = {r.program: r for r in deltas.apply_trees(df.withColumn("path", F.array("path")), {"a": 1, "b": 2}).collect()}
    for i, p in enumerate(programs):
        tree, stop = _fold(p, base)
        assert json.loads(trees[i].tree) == {k: int(v) for k, v in tree.items()} and (trees[i].abort_seq is None) == (stop is None)


def test_overlapping_paths_are_named(spark):
    d = spark.createDataFrame([(1, 0, "override", ["b", "c"], "1"), (1, 1, "override", ["b"], "{}"), (2, 0, "add", ["b"], "1")], "program long, seq long, op string, path array<string>, value string")
    assert [(r.program, r.path, r.prefix) for r in deltas.overlapping(d).collect()] == [(1, ["b", "c"], ["b"])]
    assert deltas.apply_trees(d.where("program = 1"), {"b": 3}).first().reason == "not_a_container"


def test_deduction(spark):
    pool = spark.createDataFrame(UNITS, deduce.UNIT)
    c = deduce.closure_fold(pool, ["pull_api"]).first()
    assert c["active"] == ["qualify", "source", "write"] and c["order"] == ["contacts", "fit_scores", "copy"]
    base = spark.createDataFrame([("pull_api",), ("send_api",)], "cap string")
    available, active = deduce.closure_rounds(pool, base)
    assert sorted(r.name for r in active.collect()) == ["deliver", "qualify", "report", "source", "write"]
    assert {r.name: r.status for r in deduce.predict(pool, available).collect()}["deliver"] == "buildable"
    assert deduce.residue(pool, "verdict", []) == ["pull_api", "send_api"] and deduce.residue(pool, "x", []) == ["x"]
    ways = deduce.derivations(pool, "verdict", ["pull_api", "send_api"]).collect()
    assert [(r.pos, r.chain, r.residue) for r in ways] == [(0, ["source", "write", "deliver", "report"], [])]
    assert deduce.derivations(pool, "pull_api", ["pull_api"]).first().chain == [] and deduce.derivations(pool, "verdict", [], depth=2).isEmpty()
    rows = [(0, "long", ["t"], ["a", "b"], []), (1, "short", ["t"], ["a"], []), (2, "loop", ["t"], ["l"], []), (3, "back", ["l"], ["t"], []), (4, "free", ["t"], [], []), (5, "mk_a", ["a"], ["x"], []), (6, "mk_b", ["b"], ["a", "y"], [])]
    ways = deduce.derivations(spark.createDataFrame(rows, deduce.UNIT), "t", ["x"]).collect()
    # "loop" would need t for t; the others in pool order
    assert [(r.pos, r.chain, r.residue) for r in ways] == [(0, ["mk_a", "mk_b", "long"], ["y"]), (1, ["mk_a", "short"], []), (2, ["free"], [])]
    empty = pool.limit(0)
    assert deduce.residue(empty, "x", []) == ["x"]
    assert deduce.closure_rounds(empty, base)[1].isEmpty()


def test_blocks():
    kinds = [b[1] for b in source_rows.blocks(SOURCES["wilson"])]
    assert kinds == ["control", "binding", "binding", "binding", "control", "return"]
    assert source_rows.blocks(SOURCES["wilson"])[4][2] == ["k", "lo"]
    with pytest.raises(ValueError):
        source_rows.blocks(SOURCES["nested"])
    assert any(b[5] for b in source_rows.blocks(SOURCES["nested"], opaque=True))
    assert source_rows.free_names("def f(a):\n    return g(a) + len(a)\n") == (["g"], ["len"], "f")


def test_sources_that_do_not_parse_are_rows_with_a_reason(spark):
    bad = spark.createDataFrame([("x", "def f(:"), ("y", None), ("z", "x = 1"), ("ok", "import re\n")], "n string, src string")
    for function in (source_rows.Signature, source_rows.Derive, source_rows.CallableUnit, source_rows.Blockify):
        arguments = [F.col("src").outer(), *([F.lit(True)] if function is source_rows.Blockify else [])]
        rows = bad.lateralJoin(function(*arguments).alias("r")).select("n", "r.reason").collect()
        assert {r.n: r.reason for r in rows} == {"x": "syntax_error", "y": "not_a_function", "z": "not_a_function", "ok": "not_a_function"}
    rows = bad.lateralJoin(source_rows.SelfAccesses(F.col("src").outer()).alias("r")).select("n", "r.reason").collect()
    assert {r.n: r.reason for r in rows}["x"] == "syntax_error"
    good = spark.createDataFrame([("def f(a, *b, c=1, **d):\n    total = re.sub(a, g(b), len(d))\n    return total\n",)], "src string")
    d = good.lateralJoin(source_rows.Derive(F.col("src").outer()).alias("d")).select("d.*").first()
    assert (d.name, d.reads, d.writes, d.builtin_named, d.n_blocks) == ("f", ["g", "re"], ["f"], ["len"], 2)
    u = good.lateralJoin(source_rows.CallableUnit(F.col("src").outer()).alias("d")).select("d.*").first()
    assert (u.provides, u.requires) == (["f"], ["g"])
    s = good.lateralJoin(source_rows.Signature(F.col("src").outer()).alias("d")).select("d.*").collect()
    assert [(r.param, r.kind, r.has_default) for r in s] == [("a", "positional", False), ("b", "varargs", True), ("c", "keyword", True), ("d", "varkw", True)]


def test_a_block_as_a_function(spark):
    row = spark.createDataFrame([("f", 2, ["a"], ["b"], "if a:\n    b = 1")], "fn string, i int, r array<string>, w array<string>, s string")
    text = row.select(source_rows.functionalize(*(F.col(c) for c in ("fn", "i", "r", "w", "s")))).first()[0]
    assert text == "def _f_block_2(a):\n    if a:\n        b = 1\n    return (b,)\n"


def test_decorated_classes_stay_verbatim(spark):
    df = spark.createDataFrame([("@d\nclass A:\n    pass\nclass B:\n    def m(self): pass\n",)], "src string")
    rows = df.lateralJoin(source_rows.ModuleReport(F.col("src").outer()).alias("m")).select("m.*").collect()
    assert [(r.name, r.granularity, r.reason, r.n_blocks) for r in rows] == [("A", "verbatim", "decorated", 0), ("B", "opened", None, 1)]


def test_json_text_of_any_path(spark):
    paths = [['a"b', "c\\d"], ["é\n\t", "😀", "\x01\x7f"], ["", "plain"]]
    df = spark.createDataFrame([(f"p{i}", 0, "add", p, "1") for i, p in enumerate(paths)], "program string, seq long, op string, path array<string>, value string")
    got = {r.program: r.ops for r in deltas.canonical_json(df).collect()}
    for i, p in enumerate(paths):
        assert got[f"p{i}"] == json.dumps([["add", p, 1]])


def test_programs_of_overlapping_paths_are_refused(spark):
    rows = [("p", 0, "override", ["a"], "1"), ("p", 1, "override", ["a", "b"], "2"), ("q", 0, "override", ["a"], "1"), ("q", 1, "override", ["b"], "2")]
    df = spark.createDataFrame(rows, "program string, seq long, op string, path array<string>, value string")
    got = {(r.program, tuple(r.path)): (r.status, r.reason) for r in deltas.compose(df).collect()}
    assert got[("p", ("a",))] == got[("p", ("a", "b"))] == ("refused", "prefix_overlap") and got[("q", ("a",))] == ("ok", None)
    assert deltas.compose(deltas.identity(spark)).isEmpty()


def test_evolution(spark):
    assert evolve.phenotype({"a": {"b": 1}}, [("override", ("a", "b"), 2), ("add", ("c", "d"), 3)]) == {"a": {"b": 2}, "c": {"d": 3}}
    for ops, reason in (([("add", ("a",), 1)], "present"), ([("exclude", ("x",), None)], "absent"), ([("replace", ("a",), 1)], "unknown_op")):
        with pytest.raises(ValueError, match=reason):
            evolve.phenotype({"a": 1}, ops)

    def score(genomes):
        return genomes.select("id", F.get_json_object("config", "$.x").cast("long").alias("k"), F.lit(10).alias("n"))

    def ladder(ops, rng):
        now = ops[0][2] if ops else 1
        return [[("override", ("x",), now + 1)], [("override", ("x",), 0)], [("exclude", ("gone",), None)]]

    rows = evolve.evolve(spark, {"x": 1}, score, [ladder], generations=4, mu=1).collect()
    assert (rows[0].generation, rows[0].fitness, rows[0].verdict_at_eval) == (-1, 0.1, "BASELINE")
    best = [(r.generation, r.fitness) for r in rows if r.verdict_at_eval == "KEEP"]
    assert best == [(0, 0.2), (1, 0.3), (2, 0.4), (3, 0.5)] and len({r.id for r in rows}) == len(rows)
    assert [r.verdict_at_eval for r in rows].count("UNVIABLE") == 1
    # what an earlier run has scored is passed over
    again = evolve.evolve(spark, {"x": 1}, score, [ladder], generations=2, mu=1, registry=spark.createDataFrame(rows))
    assert [r.verdict_at_eval for r in again.collect()] == ["BASELINE"]
    # strictly above the baseline: neutral genomes don't survive
    neutral = [("override", ("x",), 1)]
    assert evolve.best_above([(neutral, 0.1)], 2, 0.1, None) == [] and evolve.best_with_baseline([(neutral, 0.1)], 2, 0.1, None) == [(neutral, 0.1)]
    rows = evolve.evolve(spark, {"x": 1}, score, [lambda ops, rng: [neutral]], generations=1, select=evolve.best_above).collect()
    assert [r.verdict_at_eval for r in rows] == ["BASELINE", "REJECT"]


def test_pareto_front_against_brute_force(spark):
    import random

    rng = random.Random(1)
    for keys in (["a", "b"], ["a", "b", "c"]):
        rows = [(i, *(rng.randrange(12) for _ in range(3))) for i in range(300)] + [(900, None, 1, 1)]
        df = spark.createDataFrame(rows, "pos long, a long, b long, c long").repartition(7)
        got = {r.pos for r in selection.pareto_front(df, keys).collect()}
        n = len(keys) + 1
        vectors = {r[0]: r[1:n] for r in rows if r[1] is not None}
        assert got == {p for p, v in vectors.items() if not any(w != v and all(x >= y for x, y in zip(w, v)) for w in vectors.values())}


def test_modularity_of_planted_clusters(spark):
    edges = [(a, b, 10) for g in (0, 4) for a in range(g, g + 4) for b in range(a + 1, g + 4)] + [(0, 4, 1)]
    e = spark.createDataFrame(edges, "src long, dst long, w long")
    assign, trail = graph.learn_clusters(e, rounds=8)
    groups = {}
    for r in assign.collect():
        groups.setdefault(r["cluster"], set()).add(r["node"])
    assert trail == sorted(trail) and trail[-1] > 0.2
    planted = spark.createDataFrame([(i, i // 4) for i in range(8)], "node long, cluster int")
    assert graph.modularity(e, planted).first()["q"] == pytest.approx(0.4917, abs=1e-3)
    assert graph.modularity(e.limit(0), planted).first()["q"] == 0.0


def test_log_roundtrip_and_views(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    assert log_store.records(spark, path).isEmpty()
    docs = spark.createDataFrame([("f", "def f(): pass")], "name string, src string")
    log_store.append(log_store.mirror(docs, "name", "src"), path)
    ok = G.accept_witness(spark.createDataFrame([("f", "seat1"), ("f", "process_rerun:x"), ("f", "")], "name string, witness_id string"))
    assert [r.status for r in ok.collect()] == ["ok", "refused", "refused"]
    log_store.append(ok.where("status = 'ok'").select(F.lit(1 << 60).alias("seq"), "name", "kind", "witness_id"), path)
    log = log_store.records(spark, path)
    assert G.latest(log).first().kind == "witness" and G.latest(log, witnesses=False).first().realization_level == "function"
    p = climb.positions(log).first()
    assert p.w == 1 << 4 and p.next_kind == "cooling" and p.next_name == "execution"
    fork = G.fork(log, "lab", "me", spark.createDataFrame([("f",), ("g",)], "name string")).collect()
    assert {(r.name, r.status) for r in fork} == {("f@lab", "ok"), ("g@lab", "refused")}


def test_prolog_and_rings_roundtrip(spark):
    lines = codecs.prolog_facts(spark).select(F.col("line").alias("value")).unionByName(spark.createDataFrame([("x('q').",), ("% c",)], "value string"))
    got = {r.predicate: r.atoms for r in codecs.parse_prolog(lines).collect()}
    assert got["ladder"] == dims.LADDER and "x" not in got
    text = '[{"name":"Greet","adds":["greet"],"requires":[],"verbs":[{"name":"hi","source":"s","slots":["who"]}]}]'
    back = spark.createDataFrame([(text,)], "t string").select(codecs.rings_to_json(codecs.rings_from_json(F.col("t")))).first()[0]
    assert json.loads(back) == json.loads(text)


def test_bound_query(spark):
    q = checks.BoundQuery(spark, "SELECT :a + :b AS s", ("a", "b"))
    with pytest.raises(ValueError):
        q()
    assert q.bind("a", 1)(b=2).first().s == 3 and q.unbound == ["a", "b"]
    with pytest.raises(ValueError):
        q.bind("a", 1).bind("a", 2)


def test_stream_keeps_the_latest(spark, tmp_path):
    from fixlattice.streaming import log_stream as S

    path, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    for k in range(2):
        rows = spark.createDataFrame([(k * 10 + i, f"n{i}", "node", f"g{k}") for i in range(3 - k)], "seq long, name string, kind string, graph_identity string")
        log_store.append(rows, path)
        S.keep_latest(S.log_stream(spark, path), out, f"file://{tmp_path}/ck").awaitTermination()
    last = {r.name: r.graph_identity for r in spark.read.parquet(f"{out}/1").collect()}
    assert last == {"n0": "g1", "n1": "g1", "n2": "g0"}


def test_bound_group(spark):
    g = checks.BoundGroup(spark, {"add": ("SELECT :a + :x AS s", ("a", "x")), "both": ("SELECT :a * :b + :y AS s", ("y", "b", "a"))}, ("b", "a"), {"y": 1})
    assert g.plan() == {"add": (["a"], ["x"], ["a"]), "both": (["b", "a"], ["y"], ["b", "a"])}
    one = g.bind("a", 2)
    assert one.unbound == ["b"] and g.unbound == ["a", "b"]
    assert one.call("add", x=5).first().s == 7
    for bad in (lambda: one.call("both"), lambda: one.call("add"), lambda: one.call("add", x=1, a=3), lambda: one.bind("a", 1), lambda: one.bind("z", 1)):
        with pytest.raises(ValueError):
            bad()
    assert one.bind("b", 3).call("both").first().s == 7 and one.bind("b", 3).call("both", y=4).first().s == 10


def test_curried_stacks(spark):
    begun = checks.Curried(spark, ("log",))("Greet", adds=["greet"], requires=["log"])
    good = begun("Shout", adds=["shout"], requires=["greet"], accesses=["greet", "shout"])
    assert [(r.depth, r.ring) for r in good.rings("s").orderBy("depth").collect()] == [(0, "Greet"), (1, "Shout")]
    assert good.build("s").first().status == "ok" and len(begun.held) == 1
    gap = begun("Sing", requires=["tune"]).build("s").first()
    assert (gap.status, gap.depth, gap.reason, gap["names"]) == ("refused", 1, "missing", ["tune"])
    leak = begun("Peek", accesses=["greet"]).build("s").first()
    assert (leak.reason, leak["names"]) == ("leak", ["greet"])
    assert checks.Curried(spark).build("none").count() == 0


def test_units_of_classes_and_callables(spark):
    classes = spark.createDataFrame([(0, "Send", "send", ["to", "cc"]), (1, "Plain", None, None)], "pos int, name string, impl string, slots array<string>")
    got = [tuple(r) for r in deduce.unit_from_classes(classes).orderBy("pos").collect()]
    assert got == [(0, "Send", ["send"], [], ["cc", "to"]), (1, "Plain", ["Plain"], [], [])]
    src = "def f(p):\n    print(math.pi, len(p), fetch(p))\n    return open(p)\n"
    u = spark.createDataFrame([(src,)], "src string").lateralJoin(source_rows.CallableUnit(F.col("src").outer()).alias("u")).select("u.*").first()
    assert (u.name, u.provides, u.requires) == ("f", ["f"], ["fetch", "open", "print"])


def test_attribute_kit(spark):
    kit = attributes.Kit().add("gross", "net * (1 + rate)", computed=True, dependencies=["rate"]).add_from({"name": "rate", "value": 0.5, "type": "double"})
    assert kit.order() == ["rate", "gross"] and kit.dependencies("gross") == ["rate"] and kit.dependencies("rate") == kit.dependencies("none") == []
    out = kit.apply(spark.createDataFrame([(2.0,)], "net double"))
    assert out.first().gross == 3.0 and out.schema["rate"].metadata == {"comment": "Attribute rate"}
    assert kit.update("rate", 1.0).apply(spark.createDataFrame([(2.0,)], "net double")).first().gross == 4.0 and kit.get("rate").value == 0.5
    with pytest.raises(KeyError):
        kit.update("none", 1)
    with pytest.raises(ValueError):
        kit.add_from({"value": 1})
    with pytest.raises(ValueError):
        attributes.Kit().add("a", "b", computed=True, dependencies=["b"]).add("b", "a", computed=True, dependencies=["a"]).order()
