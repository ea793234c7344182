"""The pipeline's stages on a small table: each keeps what it should of its own input."""

import corpus_pipeline
from fixlattice.llm import near_copies, quality, simhash
from fixlattice.llm.store import written
from tests.llm.brute import personal


def _kept_by_brute_force(rows, long_similarity=0.8):
    """Least doc_id of each group that links of five-word SimHash within 4 bits, or Jaccard similarity 0.8, make; long_similarity: that of texts which sketches only estimate."""
    sets, bits = {}, {}
    for r in rows:
        w = (r.text or "").encode().lower().split()
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        bits[r.doc_id] = simhash.fingerprint((r.text or "").encode(), 5)
    root = {d: d for d in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            least = long_similarity if max(len(sets[a]), len(sets[b])) >= near_copies.SKETCH else 0.8
            if (bits[a] ^ bits[b]).bit_count() <= 4 or len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) > 0:
                p, q = top(a), top(b)
                root[max(p, q)] = min(p, q)
    return {d for d in ids if top(d) == d}


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "personal data", "mixture", "packing"]
    made = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, sf), "stage")
        made[name] = (before, docs)
        if name != "packing":
            assert docs.columns == columns
    before, after = made["quality rules"]
    kept = {r.doc_id for r in quality.judge(before).where("kept").collect()}
    assert {r.doc_id for r in after.collect()} == kept
    before, after = made["near-duplicates"]
    rows, kept = before.collect(), {r.doc_id for r in after.collect()}
    assert _kept_by_brute_force(rows, 0.72) <= kept <= _kept_by_brute_force(rows, 0.88)
    before, after = made["personal data"]
    assert before.count() == after.count()
    assert all(personal(r.text)[1] == [0, 0, 0, 0] and r.n_chars == len(r.text) for r in after.collect())
    before, after = made["mixture"]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    gone = {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()}
    known = [labels[d] for d in gone if d in labels]
    assert sum(known) >= 0.6 * len(known)
    before, after = made["packing"]
    assert {r.doc_id for r in before.collect()} == {r.doc_id for r in after.collect()}
    assert corpus_pipeline.run(spark, sf).count() == after.count()


def test_stages_with_odd_rows(spark, sf):
    """Nulls, empty and long texts, repeated rows, an empty table and further columns, through every stage."""
    body = " ".join(f"own{k} words{k}" for k in range(40))
    rows = [(1, body, "en", "s", 9), (1, body, "en", "s", 9), (2, None, None, None, None), (3, "", "en", "s", 0), (None, " ".join(f"other{k} text{k}" for k in range(30)), "en", None, 3), (4, "long " + " ".join(f"w{k}" for k in range(30_000)), "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'x' AS _key", "'y' AS row", "'z' AS node")
    made = docs
    for name, stage in corpus_pipeline.STAGES:
        made = written(stage(spark, made, sf), "odd")
        assert stage(spark, docs.limit(0), sf).isEmpty()
        alone = stage(spark, docs, sf)
        if name != "packing":
            assert alone.columns == made.columns == docs.columns and alone.count() <= len(rows)
            assert all((r._key, r.row, r.node) == ("x", "y", "z") for r in made.collect())
    assert {r.doc_id for r in made.collect()} == {1, None, 4}
