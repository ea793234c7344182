"""Mixing sources to target weights by soft membership.

A classifier fitted on the labelled table gives each document a posterior over domains. Nonnegative
document rates x are then fitted so that the expected tokens of every domain, sum_d x_d n_d p_dk, meet their targets, by
projected-gradient least squares from x = 1, with a slight pull (``pull``) of the rates towards 1. The gradient for a document, in the metric
of its tokens, is its posterior times one number a domain. These are summed over the steps and projected once: x_d = max(0, 1 - p_d . s), so a
document's rate follows from its posterior and the sums s alone, and nothing is carried or folded. Steps are scaled by the second
moments of the posteriors of documents with a rate above 0, in several lengths, of which a pass tries all and the driver takes the one of least dual loss. Each step is one
pass over a narrow written table that returns one row of sums a partition; it ends where what remains of the residuals is the pull alone, after some
ten passes, and is an error if it doesn't within ``STEPS``.

The classifier (multinomial logistic regression on hashed words and a few proportions) is fitted on the driver on a
bounded sample: about ``per_class`` labelled documents of each class, by a hash of their id. All else
covers every row. Null text: no words, posterior from the bias alone. Labels with nulls or without a document are
left out; without labels there is one domain. Repeated rows get equal rates. Ties: a rate halfway between whole numbers
is rounded up by ``take_nearest``. Very long texts are read whole, a row at a time beyond a megabyte. ``mix`` returns the columns it is asked for; ``take_nearest``
carries all along, whatever their names. An empty table gives no rows. Targets that can't be reached are met as nearly as least squares allow: ``mix`` returns the shares reached beside the targets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixlattice.llm.store import free_names, result, scratch, with_fields, written
from fixlattice.llm.text import Memo, release, slices

BUCKETS = 1 << 18
DENSE = 6
PER_CLASS = 2_000
#: Passes of the fit; it converges in some ten.
STEPS = 60
#: What the residuals may differ from the pull's, as part of the targets.
TOLERANCE = 1e-4
#: Weight of the squares of x - 1 against those of the residuals.
PULL = 1e-4
#: Parts of a full step that a pass tries.
LENGTHS = (1.0, 0.5, 0.2, 0.05)
#: Standard errors by which a hashed word's share in one class must differ from the others' to be a feature.
SIGNIFICANT = 4.0

_SIGNS, _CAPITALS, _DIGITS = b"#*$%&|<>!", bytes(range(65, 91)), b"0123456789"
_bucket = Memo(lambda w: xxhash.xxh32_intdigest(w) % BUCKETS)


def features(text: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """(hashed words that occur, proportions, number of words)."""
    words = text.lower().split()
    n = len(words)
    columns = np.unique(np.fromiter(map(_bucket.__getitem__, words), np.int64, n))
    size = max(1, len(text))
    symbols, capitals, digits = ((len(text) - len(text.translate(None, kind))) / size for kind in (_SIGNS, _CAPITALS, _DIGITS))
    lines = text.split(b"\n")
    dense = (symbols * 5, len(columns) / max(1, n), capitals * 5, np.log1p(n) / 8, len(set(lines)) / len(lines), digits * 5)
    return columns, np.array(dense), n


def fit_logistic(rows: list[np.ndarray], dense: np.ndarray, labels: np.ndarray, classes: int, prior: np.ndarray, steps: int = 150, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias) of a multinomial logistic regression by Adam; the bias carries the classes' shares in the whole.

    Of the hashed words only those are features whose share of documents differs between a class and the rest
    by SIGNIFICANT standard errors; all others have weight 0.
    """
    n = len(rows)
    sizes = np.array([len(c) for c in rows])
    columns, owner = np.concatenate(rows), np.repeat(np.arange(n), sizes)
    chosen = np.zeros(BUCKETS, bool)
    everywhere = np.bincount(columns, minlength=BUCKETS)
    for k in range(classes):
        own = labels == k
        inside = np.bincount(columns[own[owner]], minlength=BUCKETS)
        a, b, p = inside / own.sum(), (everywhere - inside) / max(1, n - own.sum()), everywhere / n
        error = np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / own.sum() + 1 / max(1, n - own.sum())))
        chosen |= (np.abs(a - b) > SIGNIFICANT * error) & (everywhere >= 5)
    at = np.full(BUCKETS, -1)
    at[chosen] = np.arange(chosen.sum())
    # the words as (owner, column) pairs: memory grows with the words of the sample, not with samples times words
    used = chosen[columns]
    owner, columns, m = owner[used], at[columns[used]], int(chosen.sum())
    by_column = np.argsort(columns, kind="stable")
    words, word_starts = np.unique(columns[by_column], return_index=True)
    owners, owner_starts = np.unique(owner, return_index=True)
    w, bias = np.zeros((m + DENSE, classes)), np.zeros(classes)
    truth = np.eye(classes)[labels]
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros(classes), np.zeros(classes)]
    for step in range(1, steps + 1):
        scores = dense @ w[m:] + bias
        if len(owners):
            scores[owners] += np.add.reduceat(w[columns], owner_starts)
        p = np.exp(scores - scores.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        error = (p - truth) / n
        gradient = l2 * w
        gradient[m:] += dense.T @ error
        if len(words):
            gradient[words] += np.add.reduceat(error[owner[by_column]], word_starts)
        for own, g, first, second in ((w, gradient, moments[0], moments[1]), (bias, error.sum(axis=0), moments[2], moments[3])):
            first += 0.1 * (g - first)
            second += 0.01 * (g**2 - second)
            own -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    share = np.bincount(labels, minlength=classes) / n
    weights = np.zeros((BUCKETS + DENSE, classes))
    weights[:BUCKETS][chosen] = w[:m]
    weights[BUCKETS:] = w[m:]
    return weights, bias + np.log(prior) - np.log(share)


def fit_domains(docs: DataFrame, labels: DataFrame, domain: Column, per_class: int = PER_CLASS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(domains, weights, bias) from the labelled rows; ``domain`` is a string expression over labels."""
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), domain.cast("string").alias("domain")).where("doc_id is not null and domain is not null")
    sizes = sorted((r["domain"], r["count"]) for r in named.groupBy("domain").count().collect())
    domains = [d for d, _ in sizes]
    if not domains:
        return ["all"], np.zeros((BUCKETS + DENSE, 1)), np.zeros(1)
    unit = F.xxhash64("doc_id", F.lit("sample")).bitwiseAND((1 << 53) - 1) / F.lit(float(1 << 53))
    limit = F.create_map(*[F.lit(x) for d, n in sizes for x in (d, per_class / n)])
    sample = named.where(unit < limit[F.col("domain")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(x or b"")[:2] for x in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("domain"), pa.array([c.astype(np.int32) for c, _ in made], pa.list_(pa.int32())), pa.array([v for _, v in made], pa.list_(pa.float64()))], names=["domain", "columns", "dense"])

    # about per_class ids a domain: bounded by that parameter
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").select("domain", "text")
    got = own.mapInArrow(run, "domain string, columns array<int>, dense array<double>").toArrow()
    found = got["domain"].to_pylist()
    if len(set(found)) < 2:
        return domains[:1] if not found else [found[0]], np.zeros((BUCKETS + DENSE, 1)), np.zeros(1)
    domains = sorted(set(found))
    rows = [c.values.to_numpy() for c in got["columns"]]
    truth = np.array([domains.index(x) for x in found])
    prior = np.array([n for d, n in sizes if d in domains], float)
    weights, bias = fit_logistic(rows, np.array(got["dense"].to_pylist()), truth, len(domains), prior / prior.sum())
    return domains, weights, bias


def posteriors(docs: DataFrame, weights: np.ndarray, bias: np.ndarray, *columns: str) -> DataFrame:
    """(columns, n_tokens, posterior) of every row of docs: words of the whole text and the domains' probabilities. No shuffle."""
    kept = docs.select(*columns, F.coalesce("text", F.lit("")).alias("_text"))
    schema = with_fields(kept.drop("_text").schema, "n_tokens long, posterior array<double>")
    # BUCKETS + DENSE rows, one column a domain
    model = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        w, b = model.value
        for batch in batches:
            for part in slices(batch, "_text"):
                n, p = [], []
                for text in part.column("_text").cast(pa.binary()).to_pylist():
                    own, dense, size = features(text)
                    scores = w[own].sum(axis=0) + dense @ w[BUCKETS:] + b
                    e = np.exp(scores - scores.max())
                    n.append(size)
                    p.append(e / e.sum())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(n, pa.int64()), pa.array(p, pa.list_(pa.float64()))], names=[*columns, "n_tokens", "posterior"])

    return kept.mapInArrow(run, schema)


def rates_of(p: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Rates of documents with posteriors p."""
    return np.maximum(0.0, 1.0 - p @ sums)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A batch of (n_tokens, posterior) as one row of two byte strings: what each step reads."""
    for batch in batches:
        if batch.num_rows:
            n, p = batch.column("n_tokens").to_numpy().tobytes(), batch.column("posterior").flatten().to_numpy().tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.binary()), pa.array([p], pa.binary())], names=["n", "p"])


def _tried(tries: list[np.ndarray], total: float):
    """One row for each partition: for each of the tried sums, the expected tokens of each domain, the squares of the rates, and the moments of posteriors with a rate above 0."""
    domains = len(tries[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((len(tries), domains + 1 + domains * domains))
        for batch in batches:
            for sizes, posteriors in zip(batch.column("n").to_pylist(), batch.column("p").to_pylist()):
                p = np.frombuffer(posteriors).reshape(-1, domains)
                w = np.frombuffer(sizes, np.int64) / total
                for row, sums in zip(out, tries):
                    x = rates_of(p, sums)
                    row[:domains] += (w * x) @ p
                    row[domains] += (w * x) @ x
                    row[domains + 1 :] += ((p * (w * (x > 0))[:, None]).T @ p).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([out.ravel().tolist()])], names=["sums"])

    return run


def fit_rates(table: DataFrame, domains: int, targets: np.ndarray, total: float, pull: float = PULL, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray, int]:
    """(sums, expected shares reached, passes) for targets as shares of ``total`` tokens. table: a written (n_tokens, posterior)."""
    blocks = written(table.select("n_tokens", "posterior").mapInArrow(_blocks, "n binary, p binary"), "mixture-blocks")
    tries, best = [np.zeros(domains)], None
    for n in range(1, STEPS + 1):
        rows = blocks.mapInArrow(_tried(tries, total), "sums array<double>").collect()
        found = np.sum([r["sums"] for r in rows], axis=0).reshape(len(tries), -1)
        for sums, row in zip(tries, found):
            loss = (pull * (sums @ sums) + row[domains]) / 2 + targets @ sums
            if best is None or loss < best[0]:
                best = loss, sums, row[:domains], row[domains + 1 :].reshape(domains, domains)
        _, sums, reached, moments = best
        left = reached - targets - pull * sums
        # targets of nothing have no scale of their own
        if np.linalg.norm(left) <= tolerance * max(1e-3, np.linalg.norm(targets)):
            return sums, reached, n
        step = np.linalg.solve(moments + pull * np.eye(domains), left)
        tries = [sums + length * step for length in LENGTHS]
    raise ValueError(f"rates didn't converge in {STEPS} passes: {np.linalg.norm(left)} of the targets' {np.linalg.norm(targets)} is left")


def mix(docs: DataFrame, labels: DataFrame, domain: Column, targets: dict[str, float] | None, without: tuple[str, ...] = (), budget: float = 1.0, columns: tuple[str, ...] = ("doc_id",)) -> tuple[DataFrame, list[str], np.ndarray, np.ndarray]:
    """(table, domains, targets, reached): table has columns, n_tokens, posterior and rate of every row of docs.

    targets: weights of domains in the mixture, brought to ``budget`` times all tokens; a domain that isn't named gets none.
    None: every domain keeps the tokens expected in rows that are more likely outside the domains of ``without`` than in them.
    """
    names, weights, bias = fit_domains(docs, labels, domain)
    table = written(posteriors(docs, weights, bias, *columns), "posteriors")
    shares = [F.get("posterior", F.lit(k)) for k in range(len(names))]
    left_out = sum((s for s, d in zip(shares, names) if d in without), F.lit(0.0)) >= 0.5
    first = table.agg(F.sum("n_tokens"), *[F.sum(F.when(left_out, 0.0).otherwise(F.col("n_tokens") * s)) for s in shares]).first()
    total = float(first[0] or 0)
    if not total:
        return table.withColumn("rate", F.lit(1.0)), names, np.zeros(len(names)), np.zeros(len(names))
    if targets is None:
        wanted = np.array([x or 0.0 for x in first[1:]]) / total
    else:
        wanted = np.array([targets.get(d, 0.0) for d in names])
        wanted = wanted / max(1e-12, wanted.sum()) * budget
    sums, reached, _ = fit_rates(table, len(names), wanted, total)
    pulled = sum((s * F.lit(float(x)) for s, x in zip(shares, sums)), F.lit(0.0))
    return table.withColumn("rate", F.greatest(F.lit(0.0), 1 - pulled)), names, wanted, reached


def label_domain() -> Column:
    """good, poor, good-toxic or poor-toxic."""
    return F.concat(F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor"), F.when(F.col("toxic") == 1, "-toxic").when(F.col("toxic") == 0, ""))


#: The production mixture over those domains: no toxic tokens.
TARGETS = {"good": 0.85, "poor": 0.15}
TOXIC = ("good-toxic", "poor-toxic")


def take_nearest(docs: DataFrame, labels: DataFrame, domain: Column, targets: dict[str, float] | None = None, without: tuple[str, ...] = TOXIC, budget: float = 1.0) -> DataFrame:
    """docs, each row as many times as the whole number nearest to its rate (halves up); targets, without and budget as in ``mix``.

    All columns stay, whatever their names."""
    key, copies, copy = free_names(docs, "_key", "_copies", "_copy")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    with scratch():
        rates = mix(keyed, labels, domain, targets, without, budget, columns=(key,))[0]
        # rows of one key are alike and have one rate
        odd = rates.select(key, F.floor(F.col("rate") + 0.5).cast("int").alias(copies)).where(F.col(copies) != 1).distinct()
        odd = result(odd, "mixture-copies", narrow=True)
    # merged at every size: what is left out grows with the documents
    out = keyed.hint("merge").join(odd, key, "left").withColumn(copies, F.coalesce(copies, F.lit(1)))
    return out.withColumn(copy, F.explode(F.when(F.col(copies) > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>")))).select(*docs.columns)
