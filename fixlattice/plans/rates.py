"""Queries over rates, selection and word statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from fixlattice.functions import text as T
from fixlattice.functions.stats import with_rate
from fixlattice.operators import selection as S
from fixlattice.operators.segments import cut
from fixlattice.session import table

STOPWORDS = ["the", "a", "and", "of", "la", "le", "de", "und", "der"]
_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)

_RATED = """
g AS (SELECT source, CAST(sum(quality) AS BIGINT) AS k, count(quality) AS n FROM labels JOIN documents USING (doc_id) GROUP BY source),
p AS (SELECT *, CAST(k AS DOUBLE) / nullif(CAST(n AS DOUBLE), 0) AS p, CAST(n AS DOUBLE) AS nd FROM g),
rated AS (SELECT source, k, n, coalesce(p, 0.0) AS rate,
  CASE WHEN n = 0 OR k = 0 THEN 0.0 ELSE greatest(0.0, ((p + 3.8416 / (2 * nd)) / (1 + 3.8416 / nd)) - 1.96 * sqrt(p * (1 - p) / nd + 3.8416 / (4 * nd * nd)) / (1 + 3.8416 / nd)) END AS lo,
  CASE WHEN n = 0 OR k = n THEN 1.0 ELSE least(1.0, ((p + 3.8416 / (2 * nd)) / (1 + 3.8416 / nd)) + 1.96 * sqrt(p * (1 - p) / nd + 3.8416 / (4 * nd * nd)) / (1 + 3.8416 / nd)) END AS hi FROM p),
scored AS (SELECT CAST(substr(source, 4) AS INT) AS pos, source, rate AS primary_, lo, hi FROM rated)"""
_BASE = "(SELECT CAST(sum(quality) AS DOUBLE) / count(quality) FROM labels)"


def _rated(spark, sf):
    labels, docs = table(spark, sf, "labels"), table(spark, sf, "documents").select("doc_id", "source")
    return with_rate(labels.join(docs, "doc_id").groupBy("source").agg(F.sum("quality").alias("k"), F.count("quality").alias("n")))


def wilson_by_source(spark, sf):
    return _rated(spark, sf).select("source", "k", "n", *[F.round(c, 9).alias(c) for c in ("rate", "lo", "hi")])


def ci_separated_pairs(spark, sf):
    return S.significantly_above(_rated(spark, sf), "source")


def ci_counts_below(spark, sf):
    return S.counts_below(_rated(spark, sf), "source")


def ci_counts_users(spark, sf):
    """Users whose rate of purchases lies significantly above how many others'."""
    e = table(spark, sf, "events").groupBy("user_id").agg(F.sum(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).alias("k"), F.count("*").alias("n"))
    return S.counts_below(with_rate(e), "user_id")


def _scored(spark, sf):
    return _rated(spark, sf).select(F.substring("source", 4, 9).cast("int").alias("pos"), "source", F.col("rate").alias("primary"), "lo", "hi")


def _baseline(spark, sf):
    return table(spark, sf, "labels").agg(F.sum("quality") / F.count("quality")).first()[0] or 0.0


def select_hillclimb(spark, sf):
    return S.hillclimb(_scored(spark, sf), 5, _baseline(spark, sf)).select("source", F.round("primary", 9).alias("value"), "rank")


def select_mu_plus_lambda(spark, sf):
    return S.mu_plus_lambda(_scored(spark, sf), 8, _baseline(spark, sf)).select("source", F.round("primary", 9).alias("value"), "rank")


def select_ucb(spark, sf):
    return S.ucb(_scored(spark, sf), 5).select("source", F.round("bound", 9).alias("value"), "rank")


def select_tournament(spark, sf):
    return S.tournament(_scored(spark, sf), 4).select("source", "rank")


def pareto_suppliers(spark, sf):
    line = table(spark, sf, "lineitem")
    per = line.groupBy("l_suppkey").agg(F.round(F.sum("l_extendedprice"), 0).cast("bigint").alias("revenue"), F.count("*").alias("n_lines"))
    return S.pareto_front(per.withColumnRenamed("l_suppkey", "pos"), ["revenue", "n_lines"]).select(F.col("pos").alias("suppkey"), "revenue", "n_lines")


def word_count_by_lang(spark, sf):
    return T.word_count(table(spark, sf, "documents").select("lang", "text"), STOPWORDS, by=["lang"])


def total_words_by_doc(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.total_words(F.col("text"), STOPWORDS).alias("total"))


def top_words_by_lang(spark, sf):
    return T.top_words(word_count_by_lang(spark, sf), 5, ["lang"])


def normalized_digest(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.normalize(F.col("text"))).alias("digest"))


def word_report(spark, sf):
    return T.report(table(spark, sf, "documents").select("doc_id", "text"), STOPWORDS, 3, "doc_id")


def content_identity(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("identity"))
    return docs.groupBy("identity").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"))


def quality_rollup(spark, sf):
    """Beyond the reference: grouping sets over language and source."""
    labels, docs = table(spark, sf, "labels"), table(spark, sf, "documents").select("doc_id", "source", "lang")
    return labels.join(docs, "doc_id").rollup("lang", "source").agg(F.sum("quality").alias("good"), F.count("*").alias("n"))


def user_sessions(spark, sf):
    """Beyond the reference: sessions of a user's events, closed by 30 idle minutes."""
    e = table(spark, sf, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    segments = cut(e, ["user_id"], "at")
    rows = segments.with_carry(segments.rows, {"last": F.max("at")}, F.lit(None).cast("long"), lambda held, s: F.coalesce(s["last"], held))
    gap = F.col("at") - F.coalesce(F.lag("at").over(segments.window()), "_carry")
    new = rows.withColumn("new", F.when(gap.isNull() | (gap >= 30 * 60 * 1_000_000), 1).otherwise(0))
    return new.groupBy("user_id").agg(F.sum("new").alias("sessions"), F.count("*").alias("n"))


_TOK = f"tok AS (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '([a-z'']+)', 1)) AS word FROM documents), wc AS (SELECT lang, word, count(*) AS n FROM tok WHERE word NOT IN ({_STOP}) GROUP BY lang, word)"

QUERIES = {f.__name__: f for f in (wilson_by_source, ci_separated_pairs, ci_counts_below, ci_counts_users, select_hillclimb, select_mu_plus_lambda, select_ucb, select_tournament, pareto_suppliers, word_count_by_lang, total_words_by_doc, top_words_by_lang, normalized_digest, word_report, content_identity, quality_rollup, user_sessions)}


def _tournament_sql(mu: int, size: int = 2, seed: int = 0) -> str:
    """The rounds one after another: each draws by MD5 among those that no round before has won."""
    rounds, won = [], "SELECT NULL::BIGINT AS pos, 0 AS rank WHERE false"
    for n in range(1, mu + 1):
        rounds.append(f"d{n} AS (SELECT pos, primary_, row_number() OVER (ORDER BY md5('{seed}:{n}:' || pos), pos) AS k FROM scored WHERE pos NOT IN (SELECT pos FROM ({won})) QUALIFY k <= {size}), w{n} AS (SELECT pos, {n} AS rank FROM d{n} ORDER BY primary_ DESC, k LIMIT 1)")
        won = " UNION ALL ".join(f"SELECT * FROM w{j}" for j in range(1, n + 1))
    return f"WITH {_RATED}, {', '.join(rounds)} SELECT source, CAST(rank AS INT) AS rank FROM ({won}) JOIN scored USING (pos)"


ORACLES = {
    "select_tournament": _tournament_sql(4),
    "wilson_by_source": f"WITH {_RATED} SELECT source, k, n, round(rate, 9) AS rate, round(lo, 9) AS lo, round(hi, 9) AS hi FROM rated",
    "ci_separated_pairs": f"WITH {_RATED} SELECT a.source AS above, b.source AS below FROM rated a JOIN rated b ON a.lo > b.hi",
    "ci_counts_below": f"WITH {_RATED} SELECT a.source, count(b.source) AS n_below FROM rated a LEFT JOIN rated b ON a.lo > b.hi GROUP BY 1",
    "ci_counts_users": "WITH " + _RATED.replace("g AS (SELECT source, CAST(sum(quality) AS BIGINT) AS k, count(quality) AS n FROM labels JOIN documents USING (doc_id) GROUP BY source)", "g AS (SELECT user_id AS source, count(*) FILTER (event_type = 'purchase') AS k, count(*) AS n FROM events GROUP BY 1)").split(",\nscored AS")[0] + " SELECT a.source AS user_id, count(b.source) AS n_below FROM rated a LEFT JOIN rated b ON a.lo > b.hi GROUP BY 1",
    "select_hillclimb": f"WITH {_RATED} SELECT source, round(primary_, 9) AS value, CAST(row_number() OVER (ORDER BY primary_ DESC, pos) AS INT) AS rank FROM scored WHERE primary_ > {_BASE} QUALIFY rank <= 5",
    "select_mu_plus_lambda": f"WITH {_RATED}, u AS (SELECT pos, source, primary_, false AS b FROM scored UNION ALL SELECT (SELECT max(pos) + 1 FROM scored), NULL, {_BASE}, true), r AS (SELECT *, CAST(row_number() OVER (ORDER BY primary_ DESC, pos) AS INT) AS rank FROM u) SELECT source, round(primary_, 9) AS value, rank FROM r WHERE rank <= 8 AND NOT b",
    "select_ucb": f"WITH {_RATED}, r AS (SELECT source, primary_ + (hi - lo) / 2 AS v, pos FROM scored) SELECT source, round(v, 9) AS value, CAST(row_number() OVER (ORDER BY v DESC, pos) AS INT) AS rank FROM r QUALIFY rank <= 5",
    "pareto_suppliers": "WITH s AS (SELECT l_suppkey AS suppkey, CAST(round(sum(l_extendedprice), 0) AS BIGINT) AS revenue, count(*) AS n_lines FROM lineitem GROUP BY 1) SELECT * FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.revenue >= a.revenue AND b.n_lines >= a.n_lines AND (b.revenue > a.revenue OR b.n_lines > a.n_lines))",
    "word_count_by_lang": f"WITH {_TOK} SELECT * FROM wc",
    "total_words_by_doc": f"SELECT doc_id, CAST(len(list_filter(regexp_extract_all(lower(text), '([a-z'']+)', 1), lambda w: w NOT IN ({_STOP}))) AS BIGINT) AS total FROM documents",
    "top_words_by_lang": f"WITH {_TOK} SELECT lang, word, n, CAST(row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS INT) AS rank FROM wc QUALIFY rank <= 5",
    "normalized_digest": r"SELECT doc_id, md5(regexp_replace(lower(text), '^\s+|\s+$', '', 'g')) AS digest FROM documents",
    "word_report": f"WITH {_TOK}, c AS (SELECT doc_id, word, count(*) AS n FROM tok WHERE word NOT IN ({_STOP}) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS k FROM c), t AS (SELECT doc_id, sum(n) AS total, string_agg(word || '=' || n, ',' ORDER BY k) FILTER (WHERE k <= 3) AS top FROM r GROUP BY 1) SELECT d.doc_id, CAST(coalesce(total, 0) AS BIGINT) AS total, coalesce(top, '') AS top FROM documents d LEFT JOIN t USING (doc_id)",
    "content_identity": "SELECT sha256(text) AS identity, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1",
    "quality_rollup": "SELECT lang, source, CAST(sum(quality) AS BIGINT) AS good, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (lang, source)",
    "user_sessions": "WITH g AS (SELECT user_id, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events) SELECT user_id, CAST(sum(CASE WHEN gap IS NULL OR gap >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) AS BIGINT) AS sessions, count(*) AS n FROM g GROUP BY 1",
}
