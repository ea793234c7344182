"""Personal data: patterns, and terms that disclose it, by information-theoretic sanitisation.

SQL functions only. Patterns find e-mail addresses, IP addresses, payment cards and phone numbers in
every whole text; each distinct value is a protected entity. Terms are runs of letters outside those values,
lower-cased. How strongly a term reveals an entity is estimated from co-occurrence in whole documents over the corpus
of N rows:

    PMI(t, e) = ln(N n(t, e) / (n(t) n(e))),   IC(e) = ln(N / n(e)).

A term discloses an entity if PMI(t, e) >= ``threshold`` * IC(e), so that it gives away that part of what there is to know,
and if at most ``residual_bits`` bits of IC(e) are left once it is seen (IC - PMI = -log P(e | t)). At least
``support`` documents must hold both; rarer pairs are no evidence. Every occurrence of a disclosing term outside base spans, in any document, is
a span of kind ``term``; ``sanitised`` generalises every span to its kind. A text that was copied says nothing new: rows of equal texts count as one document
in all four counts, and so do rows of one class where ``copy_class`` names a column of near copies; with ``copies_once=False`` every row counts.

Only entities of ``support`` documents can have disclosing terms, so only their documents are paired with terms, equal
texts once with their number; pairs of one document are as many as its entities times its terms.

Null text: empty. Texts of no spans give zero counts and empty strings. Repeated rows are documents of their own and found alike. Ties: a
pair exactly at a threshold discloses. Very long texts are read whole. Extra columns, whatever their names, are carried along by
``sanitised`` and ignored by ``find``. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixlattice.llm.native import let, matches, running
from fixlattice.llm.store import free_names, result, scratch, written

KINDS = ("email", "ip", "card", "phone")
SUPPORT = 2
THRESHOLD = 0.8
RESIDUAL_BITS = 0.5

_LOCAL = "A-Za-z0-9._%+-"
#: A match can only begin where a run of its first class does, or where the match before has ended: said
#: outright, and with runs that aren't given back, the search is linear in the text.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_NONE = "array<struct<start:bigint,stop:bigint,value:string>>"
_SPANS = "array<struct<kind:string,start:bigint,stop:bigint>>"


def _luhn(digits: Column) -> Column:
    def doubled(i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 0, d * 2).otherwise(d)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + doubled(i)) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: let(F.regexp_replace(p, "^0+", ""), lambda q: (F.length(q) < 3) | ((F.length(q) == 3) & (q <= "255"))))
    if kind == "card":
        return let(F.regexp_replace(value, r"[\x20-]", ""), lambda d: F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> dict[str, Column]:
    """For each kind, the spans of its pattern that hold."""
    digits = text.rlike("[0-9]")
    wanted = {"email": text.contains("@"), "ip": digits & text.contains("."), "card": digits, "phone": text.contains("+") & digits}
    none = F.array().cast(_NONE)

    def of(kind: str) -> Column:
        return F.when(wanted[kind], F.filter(matches(text, PATTERNS[kind]), lambda s: _holds(kind, s["value"]))).otherwise(none)

    return {k: of(k) for k in KINDS}


def _without(text: Column, mentions: Column) -> Column:
    """The text with each mention, or what of it is left of an overlap, replaced by a space."""
    return F.when(F.size(mentions) > 0, _replaced(text, mentions, lambda s: F.lit(" "))).otherwise(text)


def _terms(text: Column) -> Column:
    """The distinct terms of a text: array<string>."""
    return F.array_remove(F.array_distinct(F.transform(F.split(text, r"\P{L}+"), F.lower)), "")


def _text_of(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"]))


def _key(text: Column) -> Column:
    return F.struct(F.xxhash64(text).alias("a"), F.crc32(text).alias("b"))


#: Classes of copies that are broadcast at most, 24 bytes each; more are merged.
MOST_BROADCAST = 500_000


def _first_copies(base: DataFrame) -> DataFrame:
    """The rows of base, a written table (row, copy, ...), that are the first of their class of copies."""
    classes = base.groupBy("copy").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1").select("copy", "first")
    classes = written(classes, "personal-copies", narrow=True)
    classes = F.broadcast(classes) if classes.count() <= MOST_BROADCAST else classes.hint("merge")
    return base.join(classes, "copy", "left").where("first IS NULL OR first = row").drop("first")


def disclosing(base: DataFrame, support: int = SUPPORT, threshold: float = THRESHOLD, residual_bits: float = RESIDUAL_BITS, copies_once: bool = True) -> DataFrame:
    """(entity, term, n_e, n_t, n_te): the pairs that disclose, from base, a written table (row, copy, text_key, entities, terms)."""
    if copies_once:
        base = _first_copies(base)
    n = base.count()
    known = base.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_e")).where((F.col("n_e") >= support) & (F.col("n_e") < n))
    held = base.where(F.size("entities") > 0).groupBy("text_key").agg(F.count("*").alias("copies"), F.first("entities").alias("entities"), F.first("terms").alias("terms"))
    # texts of entities that occur often enough, with those entities alone
    told = held.select("text_key", "copies", "terms", F.explode("entities").alias("entity")).join(known, "entity")
    pairs = told.select("entity", "n_e", "copies", F.explode("terms").alias("term")).groupBy("entity", "n_e", "term").agg(F.sum("copies").alias("n_te")).where(F.col("n_te") >= support)
    pairs = written(pairs, "personal-pairs", narrow=True)
    # counted in each task before anything is dealt out
    frequency = base.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    content = F.log(F.lit(float(max(n, 1))) / F.col("n_e"))
    left = F.log(F.col("n_t") / F.col("n_te"))  # IC - PMI
    # a hair of room for what rounding does to a pair exactly at a threshold
    return pairs.join(frequency, "term").where((content - left >= threshold * content - 1e-12) & (left <= residual_bits * math.log(2) + 1e-12)).select("entity", "term", "n_e", "n_t", "n_te")


def find(docs: DataFrame, text: str = "text", copy_class: str | None = None, **options) -> DataFrame:
    """(doc_id, text_key, n_email, n_ip, n_card, n_phone, base_spans, term_spans) of each row; options: those of ``disclosing``.

    copy_class: a column of ids; rows of one id are copies of each other, those of none of equal texts alone.

    Spans are array<struct<kind, start, stop>> in code points, stop exclusive: base ones by kind, then start; terms by start.
    text_key is a struct of two hashes of the text, by which rows of one text can be joined.
    """
    copy = _key(F.coalesce(F.col(text), F.lit("")))
    if copy_class is not None:
        named = F.col(copy_class).cast("string")
        copy = F.when(named.isNotNull(), _key(F.concat(F.lit("class:"), named))).otherwise(copy)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), copy.alias("copy"))
    spans = own.select("doc_id", "text", "copy", *[c.alias(k) for k, c in base_spans(F.col("text")).items()])

    def tagged(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["value"].alias("value")))

    spans = spans.select("doc_id", "text", "copy", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.concat(*map(tagged, KINDS)).alias("mentions"))
    base = written(
        spans.select(
            F.monotonically_increasing_id().alias("row"),
            "copy",
            "doc_id",
            _key(F.col("text")).alias("text_key"),
            *[f"n_{k}" for k in KINDS],
            F.transform("mentions", lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["stop"].alias("stop"))).alias("base_spans"),
            F.array_distinct(F.transform("mentions", lambda m: F.concat_ws(":", m["kind"], F.lower(m["value"])))).alias("entities"),
            _terms(_without(F.col("text"), F.col("mentions"))).alias("terms"),
        ),
        "personal-data",
    )
    found = [*[c for c in base.columns if c not in ("row", "copy", "entities", "terms")]]
    revealing = written(disclosing(base, **options).select("term").distinct(), "personal-terms", narrow=True)
    if revealing.isEmpty():
        return base.select(*found, F.array().cast(_SPANS).alias("term_spans"))
    # the texts that hold them, once each; the written tables' sizes decide what is broadcast
    texts = base.select("text_key", "base_spans", F.explode("terms").alias("term")).join(revealing, "term")
    texts = texts.groupBy("text_key").agg(F.first("base_spans").alias("spans"), F.collect_set("term").alias("told"))
    texts = written(texts.select(F.col("text_key.a").alias("a"), F.col("text_key.b").alias("b"), "spans", "told"), "personal-texts", narrow=True)
    placed = own.select(_key(F.col("text")).alias("k"), "text").select("k.a", "k.b", "text").join(texts, ["a", "b"])
    words = F.filter(
        matches(F.col("text"), r"\p{L}++"),
        lambda w: F.array_contains(F.col("told"), F.lower(w["value"])) & ~F.exists("spans", lambda m: (m["start"] < w["stop"]) & (w["start"] < m["stop"])),
    )
    placed = placed.select("a", "b", F.transform(words, lambda w: F.struct(F.lit("term").alias("kind"), w["start"].alias("start"), w["stop"].alias("stop"))).alias("term_spans"))
    placed = placed.groupBy("a", "b").agg(F.first("term_spans").alias("term_spans")).select(F.struct("a", "b").alias("text_key"), "term_spans")
    return base.join(placed, "text_key", "left").select(*found, F.coalesce("term_spans", F.array().cast(_SPANS)).alias("term_spans"))


def digest(found: DataFrame) -> DataFrame:
    """The columns of ``find`` as counts, a hash of the base spans and all spans as text."""
    base, more = _text_of(F.col("base_spans")), _text_of(F.col("term_spans"))
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.concat(base, more), ",").alias("spans"))


def _replaced(text: Column, spans: Column, by) -> Column:
    """The text with each span, or what of it is left of an overlap, replaced by ``by`` of the span."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["stop"], s["kind"])))

    def whole(s: Column) -> Column:
        # reach: where the spans before each one end
        return let(running(F.transform(s, lambda x: x["stop"]), F.lit(0).cast("bigint"), lambda a, x: F.greatest(a, x)), lambda reach: joined(s, reach))

    def joined(s: Column, reach: Column) -> Column:
        parts = F.transform(s, lambda x, i: let(F.get(reach, i), lambda at: F.when(x["stop"] <= at, F.lit("")).otherwise(F.concat(_between(text, at, F.greatest(x["start"], at)), by(x)))))
        return F.concat(F.array_join(parts, ""), _between(text, F.element_at(reach, -1), F.length(text)))

    return F.when(F.size(spans) > 0, let(ordered, whole)).otherwise(text)


def _between(text: Column, start: Column, stop: Column) -> Column:
    return F.substr(text, (start + 1).cast("int"), F.greatest(stop - start, F.lit(0)).cast("int"))


def _generalised(text: Column, spans: Column) -> Column:
    """The text with each span, or what of it is left of an overlap, replaced by its kind in brackets."""
    return _replaced(text, spans, lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))


def sanitised(docs: DataFrame, text: str = "text", length: str | None = "n_chars", **options) -> DataFrame:
    """docs with every span of their texts generalised, and ``length`` (if there is such a column) brought up to date. All columns stay, whatever their names."""
    a, b, spans, new = free_names(docs, "_a", "_b", "_spans", "_new")
    classed = [F.col(options["copy_class"]).alias("copy_class")] if options.get("copy_class") else []
    plain = docs.select(F.lit(None).cast("long").alias("doc_id"), F.col(text).alias("text"), *classed)
    with scratch():
        found = find(plain, **options | ({"copy_class": "copy_class"} if classed else {})).withColumn("spans", F.concat("base_spans", "term_spans")).where(F.size("spans") > 0)
        by_text = found.groupBy("text_key").agg(F.first("spans").alias(spans)).select(F.col("text_key.a").alias(a), F.col("text_key.b").alias(b), spans)
        by_text = result(by_text, "personal-spans", narrow=True)
    key = _key(F.coalesce(F.col(text), F.lit("")))
    # merged at every size: the texts with spans grow with the documents
    joined = docs.withColumns({a: key["a"], b: key["b"]}).hint("merge").join(by_text, [a, b], "left")
    out = joined.withColumn(new, F.when(F.col(spans).isNotNull(), _generalised(F.col(text), F.col(spans))).otherwise(F.col(text)))
    replaced = {text: F.col(new)} | ({length: F.when(F.col(spans).isNotNull(), F.length(new).cast(docs.schema[length].dataType)).otherwise(F.col(length))} if length and length in docs.columns else {})
    return out.select(*[replaced.get(c, F.col(c)).alias(c) for c in docs.columns])
