"""Selection among scored candidates: (pos, primary, ...) in, ranked rows out. Every ranking ends with pos."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fixlattice.operators.segments import cut


def _ranked(df: DataFrame, mu: int, value: str = "primary") -> DataFrame:
    """The first mu rows by value descending, then pos, with their rank. A top-k: only mu rows meet in one task."""
    top = df.orderBy(F.desc(value), "pos").limit(mu)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(value), "pos")))


def hillclimb(scored: DataFrame, mu: int, baseline: float | None = None) -> DataFrame:
    """The best mu strictly above the baseline."""
    kept = scored if baseline is None else scored.where(F.col("primary") > F.lit(baseline))
    return _ranked(kept, mu)


def mu_plus_lambda(scored: DataFrame, mu: int, baseline: float) -> DataFrame:
    """The baseline competes as the last candidate and is then dropped: it may cost a place."""
    last = scored.agg((F.coalesce(F.max("pos"), F.lit(-1)) + 1).alias("pos")).select(*[F.col("pos") if c == "pos" else F.lit(baseline).alias(c) if c == "primary" else F.lit(None).cast(dict(scored.dtypes)[c]).alias(c) for c in scored.columns], F.lit(True).alias("is_baseline"))
    return _ranked(scored.withColumn("is_baseline", F.lit(False)).unionByName(last), mu).where("not is_baseline").drop("is_baseline")


def ucb(scored: DataFrame, mu: int, c: float = 1.0) -> DataFrame:
    """Ranks by rate + c (hi - lo) / 2, by the primary value where there is no interval."""
    bound = F.coalesce(F.col("primary") + F.lit(c) * (F.col("hi") - F.col("lo")) / 2, F.col("primary"))
    return _ranked(scored.withColumn("bound", bound), mu, "bound")


#: Cells of the grid of a front at most, over all keys.
MOST_CELLS = 4096


def pareto_front(scored: DataFrame, keys: list[str], mu: int | None = None) -> DataFrame:
    """Rows that no other dominates (at least as good in all keys, better in one); equal vectors all stay, rows with a null key go.

    Quantiles of each key cut the space into a grid of at most MOST_CELLS cells. A cell that has one above it in every key, with any row in it,
    is gone as a whole. Rows of the cells that are left are thinned in their tasks, then a cell a task; the fronts of cells then go to
    those cells that are below them or level with them in every key, and each cell drops what they dominate. No task gets more than the fronts
    of the cells that bear on one, and the result stays dealt out by cells.
    """
    spark = scored.sparkSession
    vectors = scored.select(*keys).dropna().distinct()
    each = max(2, int(MOST_CELLS ** (1 / len(keys)) + 1e-9))
    if (bounds := vectors.agg(*[F.percentile_approx(F.col(k).cast("double"), [i / each for i in range(1, each)], 20 * each).alias(f"b{i}") for i, k in enumerate(keys)]).first()) is None or bounds[0] is None:
        return scored.limit(0)
    place = F.lit(0)
    for k, b in zip(keys, bounds):
        held = F.array(*[F.lit(float(x)) for x in sorted(set(b))])
        place = place * each + _cell(F.col(k).cast("double"), held)
    celled = vectors.withColumn("_cell", place.cast("int"))
    cells = sorted(r["_cell"] for r in celled.select("_cell").distinct().collect())
    at = np.array([[c // each**i % each for i in range(len(keys) - 1, -1, -1)] for c in cells])
    beaten = np.array([bool((at > p).all(1).any()) for p in at])
    left = [c for c, gone in zip(cells, beaten) if not gone]
    stand = at[~beaten]
    sends = [(c, [d for d, q in zip(left, stand) if (q <= p).all()]) for c, p in zip(left, stand)]
    dealt = spark.createDataFrame(sends, "_cell int, _to array<int>")  # MOST_CELLS rows at most
    schema = celled.schema
    thin = celled.join(F.broadcast(dealt.select("_cell")), "_cell", "left_semi").select(*schema.names).mapInArrow(_thinned(keys), schema)
    fronts = thin.groupBy("_cell").applyInArrow(_front_of(keys), schema)
    sent = fronts.join(F.broadcast(dealt), "_cell").select(*schema.names, F.explode("_to").alias("_of"))
    front = sent.groupBy("_of").applyInArrow(_undominated(keys), scored.select(*keys).schema)
    kept = scored.join(front, keys, "left_semi")
    return kept if mu is None else kept.orderBy("pos").limit(mu)


def _cell(value: Column, bounds: Column) -> Column:
    """How many of the ascending bounds are <= value: a binary search."""
    steps = F.array(*[F.lit(1 << k) for k in range(MOST_CELLS.bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when((n + step <= F.size(bounds)) & (F.get(bounds, n + step - 1) <= value), n + step).otherwise(n))


def _columns(rows: pa.Table, keys: list[str]) -> list[np.ndarray]:
    return [rows[k].to_numpy() if not pa.types.is_decimal(rows[k].type) else np.array(rows[k].to_pylist(), object) for k in keys]


#: Rows that are held against a front at a time.
_BLOCK = 512


def front_positions(columns: list[np.ndarray]) -> np.ndarray:
    """Positions of the vectors that no other dominates; equal ones all stay."""
    if not len(columns[0]):
        return np.empty(0, np.int64)
    order = np.lexsort([c for c in columns[::-1]])[::-1]  # best first: a vector can only be dominated by one before it
    sorted_ = [c[order] for c in columns]
    if len(columns) == 1:
        return order[sorted_[0] == sorted_[0][0]]
    same = np.ones(len(order), bool)
    same[1:] = ~np.logical_and.reduce([c[1:] == c[:-1] for c in sorted_])
    first = np.flatnonzero(same)  # of each distinct vector
    distinct = [c[first] for c in sorted_]
    if len(columns) == 2:
        best = np.maximum.accumulate(distinct[1])
        good = np.ones(len(first), bool)
        good[1:] = distinct[1][1:] > best[:-1]
    else:
        good = np.zeros(len(first), bool)
        kept = [c[:0] for c in distinct]
        for a in range(0, len(first), _BLOCK):
            block = [c[a : a + _BLOCK] for c in distinct]
            open_ = ~_dominated(block, kept)
            rows = np.flatnonzero(open_)
            inside = [c[rows] for c in block]
            # within the block: distinct vectors, so at least as good in all keys is better in one
            over = np.logical_and.reduce([c[None, :] >= c[:, None] for c in inside])
            np.fill_diagonal(over, False)
            rows = rows[~over.any(1)]
            good[a + rows] = True
            kept = [np.concatenate([k, c[rows]]) for k, c in zip(kept, block)]
    return order[np.repeat(good, np.diff([*first, len(order)]))]


def _dominated(columns: list[np.ndarray], by: list[np.ndarray]) -> np.ndarray:
    """Whether each vector is dominated by one of ``by``."""
    out = np.zeros(len(columns[0]), bool)
    for a in range(0, len(by[0]), _BLOCK * 8):
        left = np.flatnonzero(~out)
        held = [c[a : a + _BLOCK * 8] for c in by]
        for b in range(0, len(left), _BLOCK):
            rows = left[b : b + _BLOCK]
            level = np.logical_and.reduce([h[None, :] >= c[rows][:, None] for c, h in zip(columns, held)])
            over = np.logical_or.reduce([h[None, :] > c[rows][:, None] for c, h in zip(columns, held)])
            out[rows] = (level & over).any(1)
    return out


def _thinned(keys: list[str]):
    """The front of what a task holds: what it drops is dominated by what it keeps."""

    def run(batches):
        held: pa.Table | None = None
        for batch in batches:
            if batch.num_rows:
                new = pa.Table.from_batches([batch])
                held = new if held is None else pa.concat_tables([held, new])
                held = held.take(pa.array(front_positions(_columns(held, keys))))
        if held is not None:
            yield from held.combine_chunks().to_batches()

    return run


def _front_of(keys: list[str]):
    return lambda rows: rows.take(pa.array(front_positions(_columns(rows, keys))))


def _undominated(keys: list[str]):
    """Of a cell's own rows those that no row sent to it dominates."""

    def run(rows: pa.Table) -> pa.Table:
        own = rows.filter(pc.equal(rows["_cell"], rows["_of"]))
        if len(keys) == 2:
            best = rows.take(pa.array(front_positions(_columns(rows, keys))))
            return best.filter(pc.equal(best["_cell"], best["_of"])).select(keys)
        others = rows.filter(pc.not_equal(rows["_cell"], rows["_of"]))
        return own.filter(pa.array(~_dominated(_columns(own, keys), _columns(others, keys)))).select(keys)

    return run


def tournament(scored: DataFrame, mu: int, size: int = 2, seed: int = 0) -> DataFrame:
    """mu rounds: ``size`` candidates are drawn without replacement, the best (first drawn on a tie) wins and leaves the pool.

    A round draws the first by MD5 of ``seed:round:pos`` among those that are left. No more than mu - 1 have left by then, so the first size + mu - 1 of
    every round are enough: one pass finds them for all rounds, of which the driver sees (size + mu - 1) mu rows and plays the rounds.
    """
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.col("round"), F.lit(":"), F.col("pos").cast("string")))
    entered = scored.select("pos", "primary", F.explode(F.sequence(F.lit(1), F.lit(mu))).alias("round")).withColumn("draw", draw)
    # a limit by group: each task sends its first few of each round
    first = F.row_number().over(Window.partitionBy("round").orderBy("draw", "pos"))
    drawn: dict[int, list] = {}
    for r in entered.withColumn("n", first).where(F.col("n") < size + mu).collect() if mu > 0 else []:
        drawn.setdefault(r["round"], []).append(r)
    won: dict[int, int] = {}
    for n in range(1, mu + 1):
        left = [r for r in sorted(drawn.get(n, []), key=lambda r: r["n"]) if r["pos"] not in won][:size]
        if left:
            won[max(left, key=lambda r: r["primary"])["pos"]] = n
    winners = scored.sparkSession.createDataFrame(list(won.items()), "pos long, rank int")
    return scored.join(F.broadcast(winners), "pos")  # mu rows


#: Ranks of upper ends that are paired at a time.
_PAIRED = 256


def n_below(rated: DataFrame) -> DataFrame:
    """rated with _n, of how many rows the interval ends before a point, twice: at its lower end (_is_hi 0), and at its upper one (_is_hi 1), where _n is the place of its hi among all, from 1.

    Both ends are points of one order, counted in segments of it."""
    ends = rated.withColumn("_end", F.explode(F.array(F.struct(F.lit(0).alias("is_hi"), F.col("lo").alias("at")), F.struct(F.lit(1).alias("is_hi"), F.col("hi").alias("at")))))
    ends = ends.select(*rated.columns, F.col("_end.is_hi").alias("_is_hi"), F.col("_end.at").alias("_at")).where("_is_hi = 0 OR _at IS NOT NULL")
    # one key for all, which the optimizer doesn't know to be one
    ends = ends.withColumn("_all", F.pmod(F.hash("_at"), F.lit(1)))
    segments = cut(ends, ["_all"], "_at")
    rows = segments.with_carry(segments.rows, {"n": F.sum("_is_hi")}, F.lit(0).cast("long"), lambda held, s: held + s["n"])
    # lower ends come first among equals: they lie above what ends before them
    before = F.sum("_is_hi").over(Window.partitionBy("_all", "_seg").orderBy("_at", "_is_hi").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("_n", F.col("_carry") + before).drop("_seg", "_carry", "_all", "_at")


def significantly_above(rated: DataFrame, name: str) -> DataFrame:
    """(above, below): pairs whose intervals are apart, a.lo > b.hi.

    The rows below a group are the first so many by their upper end: blocks of ranks are joined, and the work is that of the pairs that are asked for."""
    counted = n_below(rated.select(name, "lo", "hi"))
    a = counted.where("_is_hi = 0 AND _n > 0").select(F.col(name).alias("above"), "_n").withColumn("_block", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / _PAIRED))))
    b = counted.where("_is_hi = 1").select(F.col(name).alias("below"), (F.col("_n") - 1).alias("_rank")).withColumn("_block", F.floor(F.col("_rank") / _PAIRED))
    return a.join(b, "_block").where("_rank < _n").select("above", "below")


def counts_below(rated: DataFrame, name: str) -> DataFrame:
    """(name, n_below): above how many groups each one lies significantly."""
    return n_below(rated.select(name, "lo", "hi")).where("_is_hi = 0").select(name, F.col("_n").alias("n_below"))
