"""Quality rules: counts of each text, and the frequency of its lines across the documents of its host.

SQL functions only. A line is normalised (lower case, white space collapsed, ends trimmed) and hashed. For each host
the distinct documents that hold a line are counted: every row is a document, and a line that it repeats counts
once. Lines held by more than ``line_limit`` documents of a host are removed; a document that keeps less than
``least_left`` of its words is depleted and rejected. With ``copies_once`` (off by default) rows of one host with
equal texts count as one document, so that copies of one text leave its lines alone.

Null text: no words, which fails the base rule. Null hosts are one host. Repeated rows are documents of their own and
judged alike. Ties: a line held by exactly ``line_limit`` documents stays, a document that keeps exactly
``least_left`` of its words too. Very long texts are read whole, one at a time. Extra columns, whatever their names, are carried
along by ``keep_good`` and ignored by ``judge``. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixlattice.llm.native import BLANK, let, words
from fixlattice.llm.store import free_names, result, scratch, written

LINE_LIMIT = 50
LEAST_LEFT = 0.2
WINDOW = 8


def _covered(hashes: Column, window: int) -> Column:
    """Words in windows whose hash occurs twice or more."""

    def repeated(g: Column) -> Column:
        ordered = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        at = let(
            ordered,
            lambda s: F.array_sort(
                F.transform(
                    F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))),
                    lambda x: x["p"],
                )
            ),
        )
        return let(at, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - x, F.lit(window)))), F.lit(0).cast("bigint"), lambda a, x: a + x))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)]))

    def count(h: Column) -> Column:
        return let(windows(h), lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("bigint")).otherwise(repeated(g)))

    return let(hashes, lambda h: F.when(F.size(h) < window, F.lit(0).cast("bigint")).otherwise(count(h)))


def counts(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """(row, doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, copy, lines) of each row; lines: (key, words) of each; copy: a hash of the text. One pass, no shuffle."""
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = own.withColumn("words", words(F.col("text"))).withColumn("split", F.filter(F.split("text", "\n", -1), lambda x: x.rlike(f"[^{BLANK}]")))
    normal = F.transform("split", lambda x: F.lower(F.array_join(words(x), " ")))
    return own.select(
        "row",
        "doc_id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", f"[{BLANK}]+", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("split") - F.size(F.array_distinct("split"))).cast("long").alias("n_dup_lines"),
        _covered(F.transform("words", lambda w: F.xxhash64(w)), WINDOW).alias("n_repeat_words"),
        F.xxhash64("text").alias("copy"),
        F.transform(normal, lambda x: F.struct(F.xxhash64(x).alias("key"), F.size(F.split(x, " ")).alias("words"))).alias("lines"),
    )


def _frequent(base: DataFrame, line_limit: int, copies_once: bool) -> DataFrame:
    """(host, key) of the lines that more than line_limit documents of the host hold, as a written table."""
    held = base.select("host", "copy", F.explode(F.array_distinct(F.transform("lines", lambda x: x["key"]))).alias("key"))
    if copies_once:
        held = held.distinct()
    return written(held.groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") > line_limit).select("host", "key"), "quality-lines", narrow=True)


def judge(docs: DataFrame, host: str = "source", text: str = "text", line_limit: int = LINE_LIMIT, least_left: float = LEAST_LEFT, copies_once: bool = False) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_removed_words) of each row."""
    return _judged(docs, host, text, line_limit, least_left, copies_once).drop("cut")


def _judged(docs: DataFrame, host: str, text: str, line_limit: int = LINE_LIMIT, least_left: float = LEAST_LEFT, copies_once: bool = False) -> DataFrame:
    """The columns of ``judge`` and cut, the keys of the lines that are removed (null: none)."""
    base = written(counts(docs, host, text), "quality")
    frequent = _frequent(base, line_limit, copies_once)
    lines = base.select("row", "host", F.explode("lines").alias("l")).select("row", "host", "l.key", "l.words")
    # the written table's size decides whether it is broadcast; the rows of a hot line stay where they are or are split
    removed = lines.join(frequent, ["host", "key"]).groupBy("row").agg(F.sum("words").alias("n_removed_words"), F.collect_set("key").alias("cut"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = base.join(removed, "row", "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)).cast("long"))
    depleted = (F.col("n_words") - F.col("n_removed_words")) < F.lit(least_left) * F.col("n_words")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), "n_removed_words", "cut")


def _without(text: Column, cut: Column) -> Column:
    """The text without the lines whose keys are in cut; all other lines, blank ones too, as they are."""
    key = lambda x: F.xxhash64(F.lower(F.array_join(words(x), " ")))
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~(x.rlike(f"[^{BLANK}]") & F.array_contains(cut, key(x)))), "\n")


def keep_good(docs: DataFrame, host: str = "source", text: str = "text", length: str | None = "n_chars", **options) -> DataFrame:
    """docs without the rows that are rejected, and the texts of the others without their frequent lines; ``length`` (if there is such a column) follows.

    Verdict and lines follow from text and host, by whose hash rows are joined. All columns stay, whatever their names."""
    own, kept, cut, new = free_names(docs, "_key", "_kept", "_cut", "_new")
    marked = docs.withColumn(own, F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(host).cast("string"), F.lit(""))))
    with scratch():
        judged = _judged(marked.select(F.col(own).alias("doc_id"), F.col(host).alias("source"), F.col(text).alias("text")), "source", "text", **options)
        changed = result(judged.where("not kept or cut is not null").groupBy(F.col("doc_id").alias(own)).agg(F.first("kept").alias(kept), F.first("cut").alias(cut)), "quality-changed", narrow=True)
    # merged at every size: what changes grows with the documents
    out = marked.hint("merge").join(changed, own, "left").where(F.coalesce(kept, F.lit(True)))
    out = out.withColumn(new, F.when(F.col(cut).isNotNull(), _without(F.col(text), F.col(cut))).otherwise(F.col(text)))
    replaced = {text: F.col(new)} | ({length: F.when(F.col(cut).isNotNull(), F.length(new).cast(docs.schema[length].dataType)).otherwise(F.col(length))} if length and length in docs.columns else {})
    return out.select(*[replaced.get(c, F.col(c)).alias(c) for c in docs.columns])


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, source, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
win AS (SELECT doc_id, i, array_to_string(words[i : i + 7], ' ') AS s
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
dup AS (SELECT doc_id, s FROM win GROUP BY doc_id, s HAVING count(*) >= 2),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT win.doc_id, unnest(range(i, i + 8)) AS p FROM win JOIN dup USING (doc_id, s)) GROUP BY doc_id),
ls AS (SELECT doc_id, coalesce(source, '') AS source, unnest(string_split(text, chr(10))) AS line FROM d),
lw AS (SELECT doc_id, source, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS words FROM ls),
ln AS (SELECT doc_id, source, line, len(words) AS n, lower(array_to_string(words, ' ')) AS norm FROM lw WHERE len(words) > 0),
dl AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM ln GROUP BY doc_id),
fr AS (SELECT source, norm FROM ln GROUP BY source, norm HAVING count(DISTINCT doc_id) > 50),
rm AS (SELECT doc_id, sum(n) AS n FROM ln JOIN fr USING (source, norm) GROUP BY doc_id),
b AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(dl.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
             CAST(coalesce(rm.n, 0) AS BIGINT) AS n_removed_words
      FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN dl USING (doc_id) LEFT JOIN rm USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT (n_words - n_removed_words < 0.2 * n_words) AS kept,
       n_removed_words
FROM b
"""
