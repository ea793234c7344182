"""Word statistics of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalize(text: Column) -> Column:
    """Lower case, without Unicode white space at the ends."""
    return F.regexp_replace(F.lower(text), r"(?U)^\s+|\s+$", "")


def tokenize(text: Column) -> Column:
    """Runs of ASCII letters and apostrophes of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z']+)"), 1)


def _unlisted(token: Column, stopwords: list[str]) -> Column:
    return ~token.isin(stopwords) if stopwords else F.lit(True)


def word_count(docs: DataFrame, stopwords: list[str], text: str = "text", by: list[str] | None = None) -> DataFrame:
    """(by..., word, n): counts without stopwords."""
    by = by or []
    words = docs.select(*by, F.explode(tokenize(F.col(text))).alias("word")).where(_unlisted(F.col("word"), stopwords))
    return words.groupBy(*by, "word").agg(F.count("*").alias("n"))


def total_words(text: Column, stopwords: list[str]) -> Column:
    tokens = tokenize(text)
    return F.size(F.filter(tokens, lambda w: _unlisted(w, stopwords))).cast("bigint")


def top_words(counts: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """The k most frequent words of each group (ties by word) with their rank. Without groups the k rows of the whole are merged, never gathered."""
    by = by or []
    if not by:
        counts = counts.orderBy(F.desc("n"), "word").limit(k)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "word"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k)


def report(docs: DataFrame, stopwords: list[str], k: int, key: str, text: str = "text") -> DataFrame:
    """(key, total, top): words of each document and its k most frequent ones (ties by word) as ``word=n`` in order. Within the row: no shuffle."""
    words = F.array_sort(F.filter(tokenize(F.col(text)), lambda w: _unlisted(w, stopwords)))

    def counted(ws: Column) -> Column:
        # where each word's run begins in the sorted words
        begins = F.filter(F.sequence(F.lit(0), F.size(ws) - 1), lambda i: (i == 0) | (F.get(ws, i) != F.get(ws, i - 1)))
        return _once(begins, lambda b: F.transform(b, lambda at, j: F.struct((at - F.coalesce(F.get(b, j + 1), F.size(ws))).alias("less"), F.get(ws, at).alias("word"))))

    ranked = _once(words, lambda ws: F.when(F.size(ws) > 0, F.slice(F.array_sort(counted(ws)), 1, k)))
    joined = F.array_join(F.transform(ranked, lambda x: F.concat_ws("=", x["word"], (-x["less"]).cast("string"))), ",")
    return docs.select(key, total_words(F.col(text), stopwords).alias("total"), F.coalesce(joined, F.lit("")).alias("top"))


def _once(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), 0)
