"""Ordered delta programs (program, seq, op, path, value): fusion, composition, application, keyed merge.

Values are canonical JSON text. A program whose paths include one that is a proper prefix of another is refused: there the
order of operations on different paths matters, which fusing by path would lose. Refusals are rows with a reason.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import batched, groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from fixlattice.operators.segments import cut
from fixlattice.plans.checkpoints import cut as written

OPS = ("override", "add", "exclude")


def fuse(deltas: DataFrame, program: str = "program", path: str = "path") -> DataFrame:
    """One row for each program and path: (program, path, op, value, first_seq, n, reason). Combined before the shuffle."""
    g = deltas.groupBy(program, path).agg(
        F.min_by("op", "seq").alias("op"),
        F.max_by("value", "seq").alias("value"),
        F.min("seq").alias("first_seq"),
        F.count("*").alias("n"),
        F.sum(F.when(F.col("op") == "exclude", 1).otherwise(0)).alias("n_exclude"),
        F.sum(F.when(F.col("op") == "add", 1).otherwise(0)).alias("n_add"),
        F.sum(F.when(F.col("op").isin(*OPS), 0).otherwise(1)).alias("n_unknown"),
    )
    later_adds = F.col("n_add") - F.when(F.col("op") == "add", 1).otherwise(0)
    reason = F.when(F.col("n_unknown") > 0, "unknown_op").when((F.col("n") > 1) & (F.col("n_exclude") > 0), "exclude_among_others").when((F.col("n") > 1) & (later_adds > 0), "add_after_first")
    return g.withColumn("reason", reason).drop("n_exclude", "n_add", "n_unknown")


def overlapping(deltas: DataFrame, program: str = "program", path: str = "path") -> DataFrame:
    """(program, path, prefix): paths of array type that have another path of the program as a proper prefix. An equi-join on the prefixes, no pairs."""
    paths = deltas.select(program, path).distinct()
    cut = paths.where(F.size(path) > 1).select(program, F.col(path), F.explode(F.sequence(F.lit(1), F.size(path) - 1)).alias("i")).select(program, path, F.slice(F.col(path), 1, F.col("i")).alias("prefix"))
    return cut.join(paths.select(program, F.col(path).alias("prefix")), [program, "prefix"]).select(program, path, "prefix")


def identity(spark) -> DataFrame:
    """The program without operations: composing with it, or applying it, changes nothing."""
    return spark.createDataFrame([], "program string, seq long, op string, path array<string>, value string")


def compose(deltas: DataFrame, program: str = "program", path: str = "path") -> DataFrame:
    """fuse with pos (order of first appearance) and status: one refused path refuses its program.

    Paths given as arrays are also refused where one is a proper prefix of another of its program."""
    fused = fuse(deltas, program, path)
    if dict(deltas.dtypes)[path].startswith("array"):
        over = overlapping(deltas, program, path)
        both = over.select(program, F.explode(F.array(path, "prefix")).alias(path)).distinct().withColumn("_over", F.lit("prefix_overlap"))
        fused = fused.join(both, [program, path], "left").withColumn("reason", F.coalesce("reason", "_over")).drop("_over")
    segments = cut(fused, [program], "first_seq")
    rows = segments.with_carry(segments.rows, {"n": F.count("*")}, F.lit(0).cast("long"), lambda held, s: held + s["n"])
    rows = segments.with_totals(rows, {"refused": F.bool_or(F.col("reason").isNotNull())})
    out = rows.withColumn("pos", (F.col("_carry") + F.row_number().over(segments.window()) - 1).cast("int"))
    return out.withColumn("status", F.when(F.col("refused"), "refused").otherwise("ok")).drop("refused", "_seg", "_carry")


def apply_programs(deltas: DataFrame, base: DataFrame, program: str = "program", path: str = "path", whole: bool = True) -> DataFrame:
    """Final (program, path, value) with status, abort_seq and reason, for disjoint paths.

    base: (path, value) present before. add refuses a present path, exclude an absent one; the first violation
    aborts its program, and what came before it stands. whole: the result has a row for each path of the base and program, touched or not;
    otherwise for the paths that operations before the abort name, with a null value where a path is gone.
    """
    was = segments_of_last(deltas, [program, path])
    with_base = was.join(base.select(F.col("path").alias(path), F.lit(True).alias("in_base")), path, "left")
    present = F.coalesce(F.col("_before") != "exclude", F.col("in_base"), F.lit(False))
    marked = with_base.withColumn("bad", F.when(F.col("op") == "add", present).when(F.col("op") == "exclude", ~present).otherwise(F.lit(False))).select(program, path, "seq", "op", "value", "bad")
    by_program = cut(marked, [program], "seq")
    at = F.when(F.col("bad"), F.col("seq"))
    stops = {"abort_seq": F.min(at), "reason": F.min_by(F.when(F.col("op") == "add", "present").otherwise("absent"), at)}
    kept = by_program.with_totals(by_program.rows, stops).where(F.col("abort_seq").isNull() | (F.col("seq") < F.col("abort_seq")))
    final = kept.groupBy(program, path).agg(F.max_by("op", "seq").alias("last_op"), F.max_by("value", "seq").alias("value"), F.first("abort_seq").alias("abort_seq"), F.first("reason").alias("reason"))
    status = F.when(F.col("abort_seq").isNull(), "ok").otherwise("refused").alias("status")
    if not whole:
        return final.select(program, path, F.when(F.col("last_op") != "exclude", F.col("value")).alias("value"), status, "abort_seq", "reason")
    names = marked.groupBy(program).agg(*[c.alias(n) for n, c in stops.items()])
    every = names.crossJoin(base.select(F.col("path").alias(path), F.col("value").alias("base_value")))  # the result has a row for each of these
    touched = final.select(program, path, "last_op", "value")
    # operations on paths outside the base: their own stops; all others: those of the names
    both = every.join(touched.join(base.select(F.col("path").alias(path)), path, "left_semi"), [program, path], "left").select(program, path, F.when(F.col("last_op").isNotNull(), F.col("value")).otherwise(F.col("base_value")).alias("value"), "last_op", "abort_seq", "reason")
    beside = final.join(base.select(F.col("path").alias(path)), path, "left_anti").select(program, path, "value", "last_op", "abort_seq", "reason")
    return both.unionByName(beside).where("last_op IS NULL OR last_op <> 'exclude'").select(program, path, "value", status, "abort_seq", "reason")


def segments_of_last(deltas: DataFrame, keys: list[str]) -> DataFrame:
    """deltas with _before, the operation before each one on its keys, found in segments."""
    segments = cut(deltas, keys, "seq")
    rows = segments.with_carry(segments.rows, {"last": F.max_by("op", "seq")}, F.lit(None).cast("string"), lambda held, s: s["last"])
    return rows.withColumn("_before", F.coalesce(F.lag("op").over(segments.window()), "_carry")).drop("_seg", "_carry")


_NEVER = -(1 << 63)


def _nodes(paths: DataFrame, path: str) -> DataFrame:
    """One row for each prefix of each path that isn't empty, itself (``_own``) included: its ``_node`` and depth ``_k``."""
    out = paths.where(F.size(path) > 0).withColumn("_k", F.explode(F.sequence(F.lit(1), F.size(path))))
    return out.withColumns({"_node": F.slice(F.col(path), 1, F.col("_k")), "_own": F.col("_k") == F.size(path)})


def _violation(op: str, levels: str) -> Column:
    """The reason why an operation can't be carried out, from the kinds of the nodes on its path before it (levels: (k, own, kind, at, cut) by k)."""

    def walk(acc: Column, x: Column) -> Column:
        # what an operation on a node above has removed since the node was last touched is absent
        kind = F.when(acc["reach"] > x["at"], "absent").otherwise(x["kind"])
        inner = F.when(kind == "leaf", "not_a_container").when((F.col(op) == "exclude") & (kind == "absent"), "absent")
        leaf = F.when((F.col(op) == "add") & (kind != "absent"), "present").when((F.col(op) == "exclude") & (kind == "absent"), "absent")
        return F.struct(F.greatest(acc["reach"], x["cut"]).alias("reach"), F.coalesce(acc["reason"], F.when(x["own"], leaf).otherwise(inner)).alias("reason"))

    return F.aggregate(levels, F.struct(F.lit(_NEVER).cast("long").alias("reach"), F.lit(None).cast("string").alias("reason")), walk)["reason"]


def apply_nested(deltas: DataFrame, base: DataFrame, program: str = "program", path: str = "path", whole: bool = True) -> DataFrame:
    """Final (program, path, value, status, abort_seq, reason) of programs over a nested tree, a row for each leaf and each empty container (value {}).

    base: (path, value), the leaves before. Paths are arrays and may overlap. Setting a path makes what is missing above it and removes what was below it; a leaf above it
    is a violation, and so are add of what is there and exclude of what isn't. The first violation aborts its program. Values are
    JSON text of anything but an object; one that is an object is refused (``object_value``).

    No program is folded in one place. Each operation touches the prefixes of its path; the state of a node before an operation is that of the last touch of it,
    unless an operation on a node above came later: a last value and a greatest number, both found in segments of (program, node). An operation's
    few levels are then read together. States after a program's first violation are wrong and of no account.
    whole: with the leaves of the base that no operation touched, in every program.
    """
    base_nodes = _nodes(base.select(F.col("path").alias(path), F.col("value").alias("_base_value")), path)
    base_nodes = base_nodes.groupBy("_node").agg(F.max(F.when(~F.col("_own"), "container").otherwise("leaf")).alias("_m"), F.bool_or(~F.col("_own")).alias("_inner"), F.max(F.when(F.col("_own"), F.col("_base_value"))).alias("_base_value"))
    base_nodes = base_nodes.select("_node", F.when(F.col("_inner"), "container").otherwise("leaf").alias("_base_kind"), "_base_value")
    # the operations, and what is wrong with each, are written once: segments read their rows several times
    ops = written(deltas.select(program, "seq", "op", path, "value"))
    plain = F.when(~F.col("op").isin(*OPS) | F.col("op").isNull(), "unknown_op").when(F.coalesce(F.size(path), F.lit(0)) < 1, "empty_path").when((F.col("op") != "exclude") & F.startswith(F.ltrim("value"), F.lit("{")), "object_value")
    touch = _nodes(ops, path).withColumn("_effect", F.when(~F.col("_own"), "container").when(F.col("op") == "exclude", "absent").otherwise("leaf"))
    segments = cut(touch, [program, "_node"], "seq")
    own_seq = F.when(F.col("_own"), F.col("seq"))
    start = F.struct(F.lit(None).cast("string").alias("effect"), F.lit(None).cast("long").alias("at"), F.lit(None).cast("long").alias("cut"))

    def step(held: Column, s: Column) -> Column:
        return F.struct(s["effect"].alias("effect"), s["at"].alias("at"), F.greatest(held["cut"], s["cut"]).alias("cut"))

    seq = F.col("seq").cast("long")
    rows = segments.with_carry(segments.rows, {"effect": F.max_by("_effect", "seq"), "at": F.max(seq), "cut": F.max(own_seq.cast("long"))}, start, step)
    w = segments.window()
    rows = rows.withColumns({"_was": F.coalesce(F.lag("_effect").over(w), "_carry.effect"), "_at": F.coalesce(F.lag(seq).over(w), "_carry.at"), "_cut": F.greatest(F.max(own_seq.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, -1)), "_carry.cut")})
    rows = rows.join(base_nodes.select("_node", "_base_kind"), "_node", "left")
    never = F.lit(_NEVER).cast("long")
    level = F.struct(F.col("_k"), F.col("_own").alias("own"), F.coalesce("_was", "_base_kind", F.lit("absent")).alias("kind"), F.coalesce("_at", never).alias("at"), F.coalesce("_cut", never).alias("cut"))
    told = rows.groupBy(program, "seq").agg(F.first("op").alias("op"), F.first(path).alias(path), F.first("value").alias("value"), F.array_sort(F.collect_list(level)).alias("_levels"))
    judged = told.withColumn("_bad", F.coalesce(plain, _violation("op", "_levels"))).select(program, "seq", "op", path, "value", "_bad")
    judged = written(judged.unionByName(ops.withColumn("_bad", plain).where(F.coalesce(F.size(path), F.lit(0)) < 1)))
    by_program = cut(judged, [program], "seq")
    at = F.when(F.col("_bad").isNotNull(), F.col("seq"))
    stops = {"abort_seq": F.min(at), "reason": F.min_by("_bad", at)}
    kept = by_program.with_totals(by_program.rows, stops).where(F.col("abort_seq").isNull() | (F.col("seq") < F.col("abort_seq")))
    told = ("abort_seq", "reason")
    last = _nodes(kept, path).withColumn("_effect", F.when(~F.col("_own"), "container").when(F.col("op") == "exclude", "absent").otherwise("leaf"))
    last = last.groupBy(program, "_node").agg(F.max_by(F.struct(F.col("_effect").alias("effect"), "value"), "seq").alias("_s"), F.max(seq).alias("_at"), F.max(own_seq.cast("long")).alias("_cut"), *[F.first(c).alias(c) for c in told])
    last = last.select(program, "_node", F.col("_s.effect").alias("_effect"), F.col("_s.value").alias("value"), "_at", "_cut", *told)
    if whole:
        names = judged.groupBy(program).agg(*[c.alias(n) for n, c in stops.items()])
        # the result has a row for each leaf of the base and program
        every = names.crossJoin(base_nodes).select(program, "_node", F.col("_base_kind").alias("_effect"), F.col("_base_value").alias("value"), never.alias("_at"), never.alias("_cut"), *told)
        last = last.unionByName(every).groupBy(program, "_node").agg(F.max_by(F.struct("_effect", "value"), "_at").alias("_s"), F.max("_at").alias("_at"), F.max("_cut").alias("_cut"), *[F.first(c).alias(c) for c in told])
        last = last.select(program, "_node", F.col("_s._effect").alias("_effect"), F.col("_s.value").alias("value"), "_at", "_cut", *told)
    # gone with what lay above it
    standing = last.where("_effect <> 'absent'")
    above = standing.where(F.size("_node") > 1).withColumn("_k", F.explode(F.sequence(F.lit(1), F.size("_node") - 1))).select(program, "_node", "_at", F.slice("_node", F.lit(1), F.col("_k")).alias("_above"))
    cuts = last.where("_cut IS NOT NULL").select(program, F.col("_node").alias("_above"), "_cut")
    gone = above.join(cuts, [program, "_above"]).where(F.col("_cut") > F.col("_at")).select(program, "_node").distinct()
    alive = standing.join(gone, [program, "_node"], "left_anti")
    parents = alive.where(F.size("_node") > 1).select(program, F.slice("_node", F.lit(1), F.size("_node") - 1).alias("_node")).distinct()
    bare = alive.where("_effect = 'container'").join(parents, [program, "_node"], "left_anti").withColumn("value", F.lit("{}"))
    status = F.when(F.col("abort_seq").isNull(), "ok").otherwise("refused").alias("status")
    return alive.where("_effect = 'leaf'").unionByName(bare).select(program, F.col("_node").alias(path), "value", status, *told)


def fold_tree(ops, tree: dict) -> tuple[dict, int | None, str | None]:
    """(tree, seq of the first violation, its reason) after (seq, op, path, JSON value) in order; changes the tree."""
    for seq, op, path, value in ops:
        if op not in OPS:
            return tree, int(seq), "unknown_op"
        at = tree
        if not len(path):
            return tree, int(seq), "empty_path"
        for key in path[:-1]:
            if not isinstance(at, dict):
                return tree, int(seq), "not_a_container"
            if op != "exclude":
                at = at.setdefault(key, {})
            elif key not in at:
                return tree, int(seq), "absent"
            else:
                at = at[key]
        if not isinstance(at, dict):
            return tree, int(seq), "not_a_container"
        leaf = path[-1]
        if op == "add" and leaf in at:
            return tree, int(seq), "present"
        if op == "exclude":
            if leaf not in at:
                return tree, int(seq), "absent"
            del at[leaf]
        else:
            at[leaf] = json.loads(value)
    return tree, None, None


#: Trees of a batch.
_TREES = 1000


def apply_trees(deltas: DataFrame, base: dict, program: str = "program", path: str = "path") -> DataFrame:
    """(program, tree, status, abort_seq, reason): each program folded in order over a nested tree, for paths that may overlap.

    A task reads its programs' operations in order, many programs a batch, and holds one tree at a time; a program of any length may run over batches, but is one task's."""
    held = json.dumps(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None

        def rows() -> Iterator[tuple]:
            nonlocal schema
            for batch in batches:
                schema = schema or pa.schema([batch.schema.field(0), ("tree", pa.string()), ("status", pa.string()), ("abort_seq", pa.int64()), ("reason", pa.string())])
                yield from zip(*(c.to_pylist() for c in batch.columns))

        def folded() -> Iterator[tuple]:
            for name, group in groupby(rows(), key=itemgetter(0)):
                tree, stop, reason = fold_tree((r[1:] for r in group), json.loads(held))
                yield name, json.dumps(tree, sort_keys=True), "ok" if stop is None else "refused", stop, reason

        for some in batched(folded(), _TREES):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), schema.types)], schema=schema)

    kind = dict(deltas.dtypes)[program]
    ordered = deltas.select(program, "seq", "op", path, "value").repartition(program).sortWithinPartitions(program, F.asc_nulls_last("seq"))
    return ordered.mapInArrow(run, f"`{program}` {kind}, tree string, status string, abort_seq bigint, reason string")


def crossover(a: DataFrame, b: DataFrame, pair: list[str], path: str = "path") -> DataFrame:
    """Fused genes aligned by path: (pair..., path, op, value, conflict). Equal on both sides: one copy; on one: kept; different: a conflict row."""
    left = a.select(*pair, path, F.struct("op", "value").alias("l"))
    right = b.select(*pair, path, F.struct("op", "value").alias("r"))
    j = left.join(right, [*pair, path], "full")
    conflict = F.col("l").isNotNull() & F.col("r").isNotNull() & ~F.col("l").eqNullSafe(F.col("r"))
    gene = F.coalesce("l", "r")
    return j.select(*pair, path, F.when(~conflict, gene["op"]).alias("op"), F.when(~conflict, gene["value"]).alias("value"), conflict.alias("conflict"))


def genome_id(ops_json):
    """Content address of a program given as canonical JSON text of [[op, path, value], ...] with Python's separators (ASCII)."""
    return F.concat(F.lit("g_"), F.substring(F.sha2(ops_json, 256), 1, 16))


_ESCAPES = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\f": "\\f", "\b": "\\b"}


def json_string(text: Column) -> Column:
    """A string as ASCII JSON text: quotes, backslashes, control characters and all beyond ASCII are escaped."""
    named = F.create_map(*[F.lit(x) for kv in _ESCAPES.items() for x in kv])
    unit = lambda n: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n), 4, "0")))

    def of(c: Column) -> Column:
        n = F.ascii(c)
        pair = F.concat(unit(F.shiftright(n - 0x10000, 10) + 0xD800), unit((n - 0x10000).bitwiseAND(0x3FF) + 0xDC00))
        return F.coalesce(named[c], F.when(n.between(0x20, 0x7E), c).when(n < 0x10000, unit(n)).otherwise(pair))

    plain = text.rlike(r'^[ !#-\[\]-~]*$')
    escaped = F.array_join(F.transform(F.split(text, ""), of), "")
    return F.concat(F.lit('"'), F.when(plain, text).otherwise(escaped), F.lit('"'))


def canonical_json(deltas: DataFrame, program: str = "program") -> DataFrame:
    """(program, ops): each program as canonical JSON text; path elements are any strings, values JSON text."""
    quoted = F.concat(F.lit("["), F.array_join(F.transform("path", json_string), ", "), F.lit("]"))
    one = F.concat(F.lit("["), json_string(F.col("op")), F.lit(", "), quoted, F.lit(", "), F.coalesce("value", F.lit("null")), F.lit("]"))
    listed = deltas.select(program, "seq", one.cast(StringType()).alias("x")).groupBy(program).agg(F.array_sort(F.collect_list(F.struct("seq", "x"))).alias("l"))
    return listed.select(program, F.concat(F.lit("["), F.array_join(F.transform("l", lambda s: s["x"]), ", "), F.lit("]")).alias("ops"))
