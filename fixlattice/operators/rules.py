"""The fixed rules as SQL over tables of states: one statement a rule, the chain to the fixpoint by a recursive one.

Facts are small tables of the fixed vocabularies; states are rows (id, level, w, r), w and r masks of steps and rites. What rules say must be
what ``functions.lattice`` and ``operators.nodes`` compute by other means; the queries compare both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fixlattice.functions import dims

RULES = {
    "next_level": "SELECT a.name AS level, b.name AS next FROM {ladder} a JOIN {ladder} b ON b.idx = a.idx + 1",
    "golden": "SELECT id FROM {states} WHERE NOT EXISTS (SELECT 1 FROM {cooling} c WHERE (shiftright(w, c.idx) & 1) = 0)",
    "is_agent": "SELECT id FROM {states} WHERE NOT EXISTS (SELECT 1 FROM {rites} c WHERE (shiftright(r, c.idx) & 1) = 0)",
    "next_admissible_closure": """SELECT s.id, coalesce(n.name, 'none') AS next, coalesce(m.missing, array()) AS missing
        FROM {states} s LEFT JOIN {ladder} n ON n.idx = s.level + 1
        LEFT JOIN (SELECT id, transform(array_sort(collect_list(struct(c.idx, c.name))), x -> x.name) AS missing
            FROM {states} JOIN {cooling} c ON (shiftright(w, c.idx) & 1) = 0 GROUP BY id) m ON m.id = s.id""",
    # the first step that lacks, else the first rite, else the next rung, else itself
    "closure_step": """SELECT s.id, CASE WHEN c.bit IS NULL AND a.bit IS NULL THEN least(s.level + 1, t.top) ELSE s.level END AS level,
        s.w | coalesce(c.bit, 0L) AS w, s.r | CASE WHEN c.bit IS NULL THEN coalesce(a.bit, 0L) ELSE 0L END AS r FROM {states} s
        LEFT JOIN (SELECT id, shiftleft(1L, min(c.idx)) AS bit FROM {states} JOIN {cooling} c ON (shiftright(w, c.idx) & 1) = 0 GROUP BY id) c ON c.id = s.id
        LEFT JOIN (SELECT id, shiftleft(1L, min(c.idx)) AS bit FROM {states} JOIN {rites} c ON (shiftright(r, c.idx) & 1) = 0 GROUP BY id) a ON a.id = s.id
        CROSS JOIN (SELECT max(idx) AS top FROM {ladder}) t""",
    # w & (w + 1) clears the steps below the first that lacks: w | (w + 1) sets it
    "kleene": """WITH RECURSIVE chain(id, step, level, w, r) AS (
        SELECT id, 0, level, w, r FROM {states}
        UNION ALL
        SELECT id, step + 1, CASE WHEN w < {all_w} OR r < {all_r} THEN level ELSE level + 1 END,
            CASE WHEN w < {all_w} THEN w | (w + 1) ELSE w END, CASE WHEN w = {all_w} AND r < {all_r} THEN r | (r + 1) ELSE r END
        FROM chain WHERE level < {top} OR w < {all_w} OR r < {all_r})
        SELECT * FROM chain""",
}


def apply_rule(spark: SparkSession, rule: str, states: DataFrame | None = None) -> DataFrame:
    """The rows of a rule over states (id, level, w, r)."""
    text = RULES[rule]
    named = {k: dims.dimension(spark, k) for k in ("ladder", "cooling", "rites") if "{" + k + "}" in text}
    if "{states}" in text:
        named["states"] = states
    if rule == "kleene":
        # a chain has as many steps as a state lacks, 22 at most
        spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
        named |= {"all_w": dims.ALL_COOLING, "all_r": dims.ALL_RITES, "top": dims.TOP_LEVEL}
    return spark.sql(text, **named)
