"""Names, claims and stacks checked by set differences: classification by precedence, intake, stacking, slots, factoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fixlattice.functions.dims import ACTIONS, EFFECT_AMBIENT, EFFECT_CALLS, PURE_AMBIENT
from fixlattice.operators.segments import cut


def _strings(*items: str) -> Column:
    return F.array(*[F.lit(i) for i in items]).cast("array<string>")


def classify_names(names: DataFrame, rings: DataFrame, config: list[str] = (), known: list[str] = (), name: str = "name") -> DataFrame:
    """names with alphabet: ring, then config, effect, pure, known, else demand. rings: (pos, ring, member); the first ring by pos has the name."""
    first = rings.groupBy(F.col("member").alias(name)).agg(F.min_by("ring", "pos").alias("_ring"))
    c = F.col(name)
    effect, pure = [*EFFECT_AMBIENT, *EFFECT_CALLS], PURE_AMBIENT
    alphabet = (
        F.when(F.col("_ring").isNotNull(), F.concat(F.lit("ring:"), "_ring"))
        .when(c.isin(*config) if config else F.lit(False), "config")
        .when(c.isin(*effect), "ambient:effect")
        .when(c.isin(*pure), "ambient:pure")
        .when(c.isin(*known) if known else F.lit(False), "known")
        .otherwise("demand")
    )
    return names.join(first, name, "left").withColumn("alphabet", alphabet).drop("_ring")


def with_params(classified: DataFrame, params: DataFrame, config: list[str], key: str, name: str = "name") -> DataFrame:
    """classified (key, name, alphabet) with the parameters (key, name) that name a config slot as ``config``, whatever their names are otherwise, and whether or not they occur among the names."""
    forced = params.where(F.col(name).isin(*config) if config else F.lit(False)).select(key, name).distinct()
    rest = classified.select(key, name, "alphabet").join(forced, [key, name], "left_anti")
    return rest.unionByName(forced.withColumn("alphabet", F.lit("config")))


def verdicts(classified: DataFrame, key: str, name: str = "name") -> DataFrame:
    """(key, verdict, placement): effectful, open, config_dependent, ring_coupled:<ring> or pure; placement is the ring of greatest mass, ties by name."""
    ring = F.when(F.col("alphabet").startswith("ring:"), F.substring("alphabet", 6, 1000))
    mass = classified.where(ring.isNotNull()).groupBy(key, ring.alias("ring")).agg(F.count_distinct(name).alias("mass"))
    place = mass.groupBy(key).agg(F.max("mass").alias("top"))
    placed = mass.join(place, key).where("mass = top").groupBy(key).agg(F.min("ring").alias("placement"))
    flags = classified.groupBy(key).agg(*[F.bool_or(F.col("alphabet") == a).alias(n) for a, n in (("ambient:effect", "e"), ("demand", "d"), ("config", "c"))])
    out = flags.join(placed, key, "left")
    verdict = F.when(F.col("e"), "effectful").when(F.col("d"), "open").when(F.col("c"), "config_dependent").when(F.col("placement").isNotNull(), F.concat(F.lit("ring_coupled:"), "placement")).otherwise("pure")
    return out.select(key, verdict.alias("verdict"), "placement")


def curry_plan(classified: DataFrame) -> DataFrame:
    """classified with action."""
    actions = F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])
    ring = F.col("alphabet").startswith("ring:")
    return classified.withColumn("action", F.when(ring, F.concat(F.lit("bind_ring:"), F.substring("alphabet", 6, 1000))).otherwise(actions[F.when(~ring, F.col("alphabet"))]))


def effect_blocks(blocks: DataFrame, effect: list[str], key: str) -> DataFrame:
    """blocks (key, i, reads, writes) with global_frees (reads that neither earlier blocks nor the block itself write) and effect.

    A name's first writer is one minimum for each (key, name): no block's set of earlier names is gathered.
    """
    w = blocks.select(key, "i", F.explode("writes").alias("name")).groupBy(key, "name").agg(F.min("i").alias("first"))
    r = blocks.select(key, "i", F.explode(F.array_distinct("reads")).alias("name")).join(w, [key, "name"], "left").where(F.col("first").isNull() | (F.col("first") > F.col("i")))
    free = r.groupBy(key, "i").agg(F.array_sort(F.collect_set("name")).alias("global_frees"))
    out = blocks.join(free, [key, "i"], "left").withColumn("global_frees", F.coalesce("global_frees", _strings()))
    return out.withColumn("effect", F.arrays_overlap("global_frees", _strings(*effect)))


def intake(candidates: DataFrame, rings: DataFrame) -> DataFrame:
    """Candidates (id, seat, demand, rationale, declared_reads, declared_writes, reads, writes, shadowed, ring) with status, reason and named differences.

    rings: (ring, member). Checks in order: required fields, reads both ways (shadowed builtins may be claimed), writes both
    ways, the ring exists, it holds some of the reads, it alone holds most.
    """
    held = candidates.select("id", F.explode(F.array_distinct("reads")).alias("member")).join(rings, "member").groupBy("id", F.col("ring").alias("_r")).agg(F.count("*").alias("mass"))
    ours = held.join(candidates.select("id", F.col("ring").alias("_r"), F.lit(True).alias("_own")), ["id", "_r"], "left")
    best = ours.groupBy("id").agg(F.max(F.when(F.col("_own"), F.col("mass"))).alias("own"), F.max(F.when(F.col("_own").isNull(), F.col("mass"))).alias("other"))
    exists = rings.select(F.col("ring")).distinct().withColumn("exists", F.lit(True))
    n_rings = rings.select("ring").distinct().agg(F.count("*").alias("n_rings"))
    c = candidates.join(best, "id", "left").join(exists, "ring", "left").crossJoin(F.broadcast(n_rings))  # one row
    undeclared_r, over_r = F.array_except("reads", "declared_reads"), F.array_except(F.array_except("declared_reads", "reads"), F.col("shadowed"))
    undeclared_w, over_w = F.array_except("writes", "declared_writes"), F.array_except("declared_writes", "writes")
    own, other = F.coalesce("own", F.lit(0)), F.coalesce("other", F.when(F.col("n_rings") > 1, 0).otherwise(-1))
    claims = F.col("ring").isNotNull() & (F.col("n_rings") > 0)
    blank = F.lit(False)
    for f in ("seat", "demand", "rationale"):
        blank = blank | (F.coalesce(f, F.lit("")) == "")
    reason = (
        F.when(blank, "missing_intent")
        .when((F.size(undeclared_r) > 0) | (F.size(over_r) > 0), "reads_differ")
        .when((F.size(undeclared_w) > 0) | (F.size(over_w) > 0), "writes_differ")
        .when(claims & F.col("exists").isNull(), "no_such_ring")
        .when(claims & (own == 0) & (F.size("reads") > 0), "no_support")
        .when(claims & (other >= own), "not_unique")
    )
    return c.select("id", F.when(reason.isNull(), "admitted").otherwise("refused").alias("status"), reason.alias("reason"), F.array_sort(undeclared_r).alias("undeclared"), F.array_sort(over_r).alias("overclaimed"))


def validate_stack(rings: DataFrame, key: str, base: list[str] = ()) -> DataFrame:
    """(key, status, depth, reason, names): the first ring, innermost first, that requires what nothing below adds, or accesses what it neither adds nor requires.

    A capability's first adder is one minimum for each (key, name).
    """
    added = rings.select(key, "depth", F.explode("adds").alias("name")).groupBy(key, "name").agg(F.min("depth").alias("first"))
    wanted = rings.select(key, "depth", F.explode(F.array_distinct("requires")).alias("name")).join(added, [key, "name"], "left")
    if base:
        wanted = wanted.where(~F.col("name").isin(*base))
    gaps = wanted.where(F.col("first").isNull() | (F.col("first") >= F.col("depth"))).groupBy(key, "depth").agg(F.array_sort(F.collect_set("name")).alias("names"))
    leaks = rings.select(key, "depth", F.array_sort(F.array_except("accesses", F.concat("adds", "requires"))).alias("names")).where(F.size("names") > 0)
    bad = gaps.select(key, "depth", F.lit(0).alias("check"), "names").union(leaks.select(key, "depth", F.lit(1).alias("check"), "names"))
    first = bad.groupBy(key).agg(F.min(F.struct("depth", "check", "names")).alias("f"))
    all_ = rings.select(key).distinct().join(first, key, "left")
    return all_.select(key, F.when(F.col("f").isNull(), "ok").otherwise("refused").alias("status"), F.col("f.depth").alias("depth"), F.when(F.col("f.check") == 0, "missing").when(F.col("f.check") == 1, "leak").alias("reason"), F.col("f.names").alias("names"))


def assemble(rings: DataFrame, key: str, base: list[str] = ()) -> DataFrame:
    """(key, status, depth, reason, verb, names) of stacks whose rings have verbs (name, slots, accesses): the first refusal, innermost ring first.

    A ring is refused for what it requires and nothing below adds (``missing``); then, verb by verb, for one that isn't among its adds (``outside_adds``) and for what a verb accesses that
    is neither added, required nor a slot of it (``leak``).
    """
    stacked = validate_stack(rings.withColumn("accesses", F.array().cast("array<string>")), key, base).where("status = 'refused'")
    gaps = stacked.select(key, "depth", F.lit(-1).alias("at"), F.lit("missing").alias("reason"), F.lit(None).cast("string").alias("verb"), "names")
    verbs = rings.select(key, "depth", "adds", "requires", F.posexplode("verbs").alias("at", "v"))
    leaks = F.array_sort(F.array_distinct(F.array_except("v.accesses", F.concat("adds", "requires", "v.slots"))))
    outside = ~F.array_contains("adds", F.col("v.name"))
    reason = F.when(outside, "outside_adds").when(F.size(leaks) > 0, "leak")
    bad = verbs.select(key, "depth", "at", reason.alias("reason"), F.col("v.name").alias("verb"), F.when(outside, F.array("v.name")).otherwise(leaks).alias("names")).where("reason IS NOT NULL")
    first = gaps.union(bad).groupBy(key).agg(F.min(F.struct("depth", "at", "reason", "verb", "names")).alias("f"))
    out = rings.select(key).distinct().join(first, key, "left")
    return out.select(key, F.when(F.col("f").isNull(), "ok").otherwise("refused").alias("status"), *[F.col(f"f.{c}").alias(c) for c in ("depth", "reason", "verb", "names")])


def admitted_records(candidates: DataFrame, judged: DataFrame) -> DataFrame:
    """The candidates that ``intake`` admits, as log records to append: name, kind, provenance (the seat) and what they declare as payload."""
    kept = candidates.join(judged.where("status = 'admitted'").select("id"), "id", "left_semi")
    payload = F.to_json(F.struct("demand", "rationale", "ring", "reads", "writes"))
    return kept.select(F.col("id").cast("string").alias("name"), F.lit("candidate_envelope").alias("kind"), F.array(F.concat(F.lit("seat:"), "seat")).alias("provenance"), payload.alias("payload"), F.col("id").alias("at"))


def soup(slots: DataFrame, bindings: DataFrame) -> DataFrame:
    """(instance, verb, unbound): declared order. slots: (instance, verb, pos, slot)."""
    open_ = slots.join(bindings.select("instance", "slot"), ["instance", "slot"], "left_anti")
    g = open_.groupBy("instance", "verb").agg(F.array_sort(F.collect_list(F.struct("pos", "slot"))).alias("l"))
    return g.select("instance", "verb", F.transform("l", lambda x: x["slot"]).alias("unbound"))


def heat(slots: DataFrame, bindings: DataFrame) -> DataFrame:
    """(instance, heat): distinct slots unbound, 0 for instances without any."""
    open_ = slots.join(bindings.select("instance", "slot"), ["instance", "slot"], "left_anti").groupBy("instance").agg(F.count_distinct("slot").alias("h"))
    return slots.select("instance").distinct().join(open_, "instance", "left").select("instance", F.coalesce("h", F.lit(0)).alias("heat"))


def bind(requests: DataFrame, bindings: DataFrame) -> DataFrame:
    """requests (instance, pos, slot, value) with status: the first of a slot is bound unless it already is; all others are refused."""
    segments = cut(requests, ["instance", "slot"], "pos")
    rows = segments.with_carry(segments.rows, {"n": F.count("*")}, F.lit(0).cast("long"), lambda held, s: held + s["n"])
    rows = rows.withColumn("_first", (F.col("_carry") == 0) & (F.row_number().over(segments.window()) == 1)).drop("_seg", "_carry")
    held = bindings.select("instance", "slot").distinct().withColumn("held", F.lit(True))
    return rows.join(held, ["instance", "slot"], "left").withColumn("status", F.when(F.col("held").isNull() & F.col("_first"), "bound").otherwise("refused")).drop("held", "_first")


def morph(bindings: DataFrame, slots: DataFrame) -> DataFrame:
    """bindings with transported: whether the new rings declare the slot."""
    named = slots.select("slot").distinct().withColumn("transported", F.lit(True))
    return bindings.join(named, "slot", "left").withColumn("transported", F.coalesce("transported", F.lit(False)))


def shared_params(signatures: DataFrame, least: int = 2, mask: list[str] | None = None) -> DataFrame:
    """signatures (fn, pos, param, kind, has_default) with role config for a parameter that ``least`` functions have (or that is in the mask), else call or required_call."""
    plain = signatures.where("kind = 'positional'")
    if mask is None:
        shared = plain.groupBy("param").agg(F.count_distinct("fn").alias("n")).where(F.col("n") >= least).select("param")
    else:
        shared = signatures.sparkSession.createDataFrame([(m,) for m in mask], "param string")
    marked = plain.join(shared.withColumn("shared", F.lit(True)), "param", "left")
    return marked.withColumn("role", F.when(F.col("shared"), "config").when(F.col("has_default"), "call").otherwise("required_call")).drop("shared")


class BoundQuery:
    """A parameterised SQL text whose slots are bound once each; it refuses to run while one is unbound. Call-time values come first."""

    def __init__(self, spark: SparkSession, sql: str, slots: tuple[str, ...], bound: dict | None = None):
        self.spark, self.sql, self.slots, self.bound = spark, sql, slots, dict(bound or {})

    def bind(self, slot: str, value) -> "BoundQuery":
        if slot not in self.slots:
            raise ValueError(f"no slot {slot!r}")
        if slot in self.bound:
            raise ValueError(f"{slot!r} is bound already")
        return BoundQuery(self.spark, self.sql, self.slots, self.bound | {slot: value})

    @property
    def unbound(self) -> list[str]:
        return [s for s in self.slots if s not in self.bound]

    def __call__(self, **call) -> DataFrame:
        values = self.bound | call
        if missing := [s for s in self.slots if s not in values]:
            raise ValueError(f"unbound: {', '.join(missing)}")
        return self.spark.sql(self.sql, args={s: values[s] for s in self.slots})


class BoundGroup:
    """Parameterised SQL texts (method: (sql, parameters)) that share one table of bound slots.

    A method takes the parameters that aren't slots at its call, and refuses to run while one of its own slots is unbound;
    slots that only other methods have don't hold it up.
    """

    def __init__(self, spark: SparkSession, methods: dict[str, tuple[str, tuple[str, ...]]], slots: tuple[str, ...], defaults: dict | None = None, bound: dict | None = None):
        self.spark, self.methods, self.slots, self.defaults = spark, dict(methods), tuple(sorted(slots)), dict(defaults or {})
        if unknown := sorted((bound or {}).keys() - set(self.slots)):
            raise ValueError(f"no slot {', '.join(unknown)}")
        self.bound = dict(bound or {})

    def bind(self, slot: str, value) -> "BoundGroup":
        if slot in self.bound:
            raise ValueError(f"{slot!r} is bound already")
        return BoundGroup(self.spark, self.methods, self.slots, self.defaults, self.bound | {slot: value})

    @property
    def unbound(self) -> list[str]:
        return [s for s in self.slots if s not in self.bound]

    def plan(self) -> dict[str, tuple[list[str], list[str], list[str]]]:
        """method: (slots, parameters given at the call, slots still unbound), each in the method's own order."""
        out = {}
        for name, (_, params) in self.methods.items():
            own = [p for p in params if p in self.slots]
            out[name] = (own, [p for p in params if p not in self.slots], [p for p in own if p not in self.bound])
        return out

    def call(self, method: str, **given) -> DataFrame:
        own, rest, missing = self.plan()[method]
        if missing:
            raise ValueError(f"{method}, unbound: {', '.join(missing)}")
        if odd := sorted(given.keys() - set(rest)):
            raise ValueError(f"{method}, no parameter {', '.join(odd)}")
        values = {p: self.bound[p] for p in own} | {p: self.defaults[p] for p in rest if p in self.defaults} | given
        if absent := [p for p in rest if p not in values]:
            raise ValueError(f"{method}, not given: {', '.join(absent)}")
        return self.spark.sql(self.methods[method][0], args=values)


class Curried:
    """A stack put together one ring at a time, innermost first; each call returns a new composer, so a beginning can be shared."""

    def __init__(self, spark: SparkSession, base: tuple[str, ...] = (), rings: tuple[tuple, ...] = ()):
        self.spark, self.base, self.held = spark, tuple(base), tuple(rings)

    def __call__(self, ring: str, adds=(), requires=(), accesses=()) -> "Curried":
        return Curried(self.spark, self.base, (*self.held, (ring, list(adds), list(requires), list(accesses))))

    def rings(self, stack: str) -> DataFrame:
        """(stack, depth, ring, adds, requires, accesses), depth 0 the innermost."""
        rows = [(stack, depth, *r) for depth, r in enumerate(self.held)]
        return self.spark.createDataFrame(rows, "stack string, depth int, ring string, adds array<string>, requires array<string>, accesses array<string>")

    def build(self, stack: str) -> DataFrame:
        """The stack's one row of ``validate_stack``: ok, or the first ring that is refused and why."""
        return validate_stack(self.rings(stack), "stack", list(self.base))
