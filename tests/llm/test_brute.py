"""Queries of the training-data operators on a small table, held against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from fixlattice.llm import disclosure, mixing, packing, ppm, queries, quality, sharding, simhash, weighted_sampling
from fixlattice.llm.components import components
from fixlattice.llm.text import PieceEncoder, public_vocabulary
from tests.compare import oracle, same


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_generalised_jaccard_is_met():
    rng = random.Random(3)
    for _ in range(6):
        a = Counter(rng.choices(range(40), k=60))
        b = a + Counter(rng.choices(range(60), k=rng.randrange(1, 60)))
        truth = sum((a & b).values()) / sum((a | b).values())
        hashes = [np.array([xxhash.xxh64_intdigest(str(x)) for x in c.elements()], np.uint64) for c in (a, b)]
        s = weighted_sampling.signatures(hashes, 4096)
        assert weighted_sampling.likeness(s[0], s[1]) == pytest.approx(truth, abs=0.04)


def test_simhash_components(spark, sf, texts):
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.QUERIES["op5_simhash_pivots"](spark, sf).collect()}

    def plain(text):
        words = text.encode().lower().split()
        shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    fps = {d: plain(t or "") for d, t in texts.items()}
    assert {d: f"{f:016x}" for d, f in fps.items()} == {d: f for d, (f, _) in found.items()}
    root = {d: d for d in fps}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                p, q = top(a), top(b)
                root[max(p, q)] = min(p, q)
    assert {d: top(d) for d in ids} == {d: c for d, (_, c) in found.items()}


def test_links_of_dense_groups_and_hot_places(spark, monkeypatch):
    rng = random.Random(1)
    centre = rng.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6))) for _ in range(300)} | {rng.getrandbits(64) for _ in range(200)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")

    def groups(links):
        joined = {r.u: r.root for r in components(links).collect()}
        out = {}
        for f in signed:
            out.setdefault(joined.get(f, f), set()).add(f)
        return sorted(map(sorted, out.values()))

    root = {f: f for f in signed}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(signed):
        for b in signed[i + 1 :]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4:
                root[top(a)] = top(b)
    wanted = {}
    for f in signed:
        wanted.setdefault(top(f), set()).add(f)
    wanted = sorted(map(sorted, wanted.values()))
    assert groups(simhash.links(df)) == wanted
    monkeypatch.setattr(simhash, "HOT", 20)
    monkeypatch.setattr(simhash, "BLOCK", 8)
    assert groups(simhash.links(df)) == wanted


def test_pivot_coordinates_never_discard_a_link():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 63, 400, dtype=np.int64).view(np.uint64)
    b = a.copy()
    for i in range(400):
        for bit in rng.choice(64, rng.integers(0, 9), replace=False):
            b[i] ^= np.uint64(1 << int(bit))
    near = np.bitwise_count(a ^ b) <= 4
    tally = []
    left, _ = simhash.by_pivots(a, b, np.arange(400), np.arange(400), 4, simhash.pivots(), tally)
    assert left.tolist() == np.flatnonzero(near).tolist() and tally[0][0] == 400 and tally[0][1] < 400
    for n in (10, 10**6, 10**8, 10**11):
        widths = simhash.bands_for(n)
        rows = [simhash.band_rows(x, widths) for x in (a, b)]
        same = sum((p == q).astype(int) for p, q in zip(*rows))
        assert sum(widths) == 64 and (same[near] >= len(widths) - 4).all()


def test_sketches_against_sets():
    from fixlattice.llm import near_copies

    rng = random.Random(9)
    for size in (3, 60, 200, 900):
        for share in (0.0, 0.05, 0.5):
            a = rng.sample(range(1 << 62), size)
            b = a[: size - int(size * share)] + rng.sample(range(1 << 62), int(size * share))
            truth = len(set(a) & set(b)) / len(set(a) | set(b))
            sketches = [np.frombuffer(near_copies.sketch_and_places(np.array(x, np.uint64) << np.uint64(1))[0], np.uint32) for x in (a, b)]
            if abs(truth - 0.8) > 0.1 or size < 200:
                assert near_copies.alike(*sketches) == (truth >= 0.8)


def test_near_copies_in_large_places(spark, monkeypatch):
    from fixlattice.llm import near_copies

    rng = random.Random(3)
    base = [f"w{k}" for k in range(120)]
    texts = [" ".join(w if rng.random() > 0.008 else f"e{i}" for w in base) for i in range(90)] + [" ".join(rng.choices(base, k=40)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    wanted = sorted(r.doc_id for r in simhash.keep_one(df).collect())
    rows = df.collect()
    from tests.llm.test_pipeline import _kept_by_brute_force

    assert wanted == sorted(_kept_by_brute_force(rows)) and len(wanted) < 60
    monkeypatch.setattr(near_copies, "HOT", 8)
    monkeypatch.setattr(near_copies, "BLOCK", 5)
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == wanted


def test_encoders_equal_the_library(texts):
    odd = ["", "  a  b ", "\n\n x\t y \n z", "it's we'll 'S İstanbul ΣΑΣ ß é é ́x", "a b　c\x1cd", "<|endoftext|> x<|startoftext|>", "a <|endoftext|> b <|ENDOFTEXT|> <| c", "😀 日本語 123 4567", "x " * 50 + "end \n", "Foo. bar, BAZ! ǅ"]
    for name, level in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        enc = PieceEncoder(public_vocabulary(name), level)
        for t in [*odd, *texts.values()]:
            assert np.frombuffer(enc.encode(t.encode()), enc.dtype).tolist() == enc.tok.encode(t, add_special_tokens=False).ids


def test_token_files_and_packing(spark, sf, texts):
    enc = PieceEncoder(public_vocabulary("byte_bpe_50k.json"), True)
    ids = {d: np.array([*enc.tok.encode(t, add_special_tokens=False).ids, 0], "<u4") for d, t in texts.items()}
    at = 0
    for r in sorted(queries.QUERIES["op4_token_files"](spark, sf).collect(), key=lambda r: r.doc_id):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids[r.doc_id]), zlib.crc32(ids[r.doc_id].tobytes()))
        at += r.n_tokens
    rows = queries.QUERIES["op9_residual_packing"](spark, sf).collect()
    total = sum(r.length for r in rows)
    used = Counter()
    for r in rows:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 4096 and len(used) <= math.ceil(total / 4096) * 1.02 + 1


def test_packing_over_many_nodes(spark):
    rng = random.Random(2)
    sizes = [rng.choice([4096, 2500, 1500, 900, 60, rng.randrange(1, 4096)]) for _ in range(4000)]
    df = spark.createDataFrame([(i, 0, 0, s, 0) for i, s in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(19, "doc_id")
    from fixlattice.llm.store import written

    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        rows = packing.pack(written(df, "sizes")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(r.doc_id for r in rows) == list(range(4000))
    whole = {}
    for r in rows:
        whole.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in whole.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(whole) <= len(packing.best_fit(sizes)[2]) * 1.03


def test_trie_is_a_distribution_and_shards_agree(spark, sf, texts):
    raw = [t.encode().lower() for t in list(texts.values())[:60]]
    tally = ppm.Tally()
    tally.add(ppm.grams(raw)[0])
    trie = ppm.Trie(*tally.take())
    for context in (b"the t", b"\xff" * 5, b"zzzzz", raw[3][:5]):
        at = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256)], np.uint64)
        assert (10.0 ** trie.costs(at).astype(float)).sum() == pytest.approx(1, abs=1e-4)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    one = {r.doc_id: r for r in ppm.score_documents(docs, held).collect()}
    many = {r.doc_id: r for r in ppm.score_documents(docs, held, shard_entries=3_000).collect()}
    for d, r in one.items():
        assert many[d].score == pytest.approx(r.score, rel=1e-6) and r.held_out == (zlib.crc32(str(d).encode()) % 7 == 2)
    train = Counter()
    for d, t in texts.items():
        if not one[d].held_out:
            train.update([*t.encode().lower().split(), None])
    n, v = sum(train.values()), len(train)
    for d, t in texts.items():
        tokens = [*t.encode().lower().split(), None]
        assert one[d].base_score == pytest.approx(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in tokens))
        assert (one[d].n_tokens, one[d].n_known, one[d].train_tokens) == (len(tokens), sum(w in train for w in tokens), n)


def test_adaptive_code_length():
    assert ppm.adaptive_bits(b"") == 8.0
    assert ppm.adaptive_bits(b"abracadabra" * 20) < 8 * 11 * 20 / 4


def test_quality_against_sql(spark, sf):
    same(queries.QUERIES["op7_line_frequency"](spark, sf).toPandas(), oracle(quality.ORACLE, sf))


def test_copies_count_as_documents_unless_told_otherwise(spark):
    body = [f"word{i} other{i} line number {i} of the document text here it is" for i in range(12)]
    copies = [(i, "\n".join(body), "h") for i in range(80)]
    many = [(100 + i, f"own words {i} and {i * 7} of this document are here and there are enough of them to be kept {i}\nfooter of every page", "h") for i in range(80)]
    thin = [(300, "only a few of it\n" + "\n".join(["footer of every page"] * 9), "h")]
    df = spark.createDataFrame(copies + many + thin, "doc_id long, text string, source string")
    rows = {r.doc_id: r for r in quality.judge(df).collect()}
    assert all(rows[i].n_removed_words == rows[i].n_words and not rows[i].kept for i in range(80))
    assert all(rows[i].kept for i in range(100, 180)) and rows[100].n_removed_words == 4 and not rows[300].kept
    rows = {r.doc_id: r for r in quality.judge(df, copies_once=True).collect()}
    assert all(rows[i].kept and not rows[i].n_removed_words for i in range(80)) and rows[100].n_removed_words == 4 and not rows[300].kept
    # exactly the limit is not above it
    rows = {r.doc_id: r for r in quality.judge(df, line_limit=81).collect()}
    assert not any(r.n_removed_words for r in rows.values())


def _page(i):
    return " ".join(f"own{i}x{k}" for k in range(20))


def test_a_line_counts_once_for_each_document(spark):
    footer = "footer of every page"
    pages = [(i, f"{_page(i)}\n{footer}", "h") for i in range(80)]
    log = [(300, "\n".join([_page(300).rsplit(" ", 16)[0]] + [footer] * 21), "h")]
    rows = {r.doc_id: r for r in quality.judge(spark.createDataFrame(pages + log, "doc_id long, text string, source string")).collect()}
    assert all(rows[i].kept and rows[i].n_removed_words == 4 for i in range(80))
    assert rows[300].n_removed_words == 84 and not rows[300].kept


def test_template_lines_are_boilerplate(spark):
    template = [" ".join(f"{part}{k}" for k in range(10)) for part in ("header", "menu", "side", "legal", "footer")]
    pages = [(i, "\n".join([*template[:2], _page(i), *template[2:]]), "h") for i in range(200)]
    thin = [(300 + i, "\n".join([*template[:2], " ".join(f"short{i}x{k}" for k in range(6)), *template[2:]]), "h") for i in range(70)]
    rows = {r.doc_id: r for r in quality.judge(spark.createDataFrame(pages + thin, "doc_id long, text string, source string")).collect()}
    total = sum(len(x.split()) for x in template)
    assert all(rows[i].n_removed_words == total and rows[i].kept for i in range(200))
    assert all(rows[300 + i].n_removed_words == total and not rows[300 + i].base_failed and not rows[300 + i].kept for i in range(70))


def test_frequent_lines_are_cut_from_the_texts(spark):
    import corpus_pipeline

    pages = [(i, f"{_page(i)}\n\nFooter  of every page\nlast {i}", "h", 1) for i in range(80)] + [(90, None, "h", None), (91, _page(91), "g", 7)]
    df = spark.createDataFrame(pages, "doc_id long, text string, source string, n_chars long")
    rows = {r.doc_id: r for r in corpus_pipeline.quality_rules(spark, df, "").collect()}
    assert set(rows) == {*range(80), 91} and rows[91].text == _page(91) and rows[91].n_chars == 7
    assert all(rows[i].text == f"{_page(i)}\n\nlast {i}" and rows[i].n_chars == len(rows[i].text) for i in range(80))


def test_shards_are_near_equal_with_a_hot_text(spark):
    rows = [(i, "hot " * 200) for i in range(1500)] + [(2000 + i, f"text {i} " * (i % 90 + 1)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.place(df).collect()
    sums = Counter()
    for r in got:
        sums[r.shard] += r["size"]
    assert max(sums.values()) - min(sums.values()) < 4000 and len(sums) == 8
    text = dict(rows)
    of = {}
    for r in got:
        of.setdefault(text[r.doc_id], set()).add(r.shard)
    assert all(len(s) == 1 for t, s in of.items() if not t.startswith("hot"))


def _disclosed(texts, support=disclosure.SUPPORT, threshold=disclosure.THRESHOLD, bits=disclosure.RESIDUAL_BITS):
    """Term spans of each text by the definition, over a list of texts."""
    from tests.llm.brute import PATTERNS, holds

    mentions = [[(m.start(), m.end(), f"{k}:{m.group().lower()}") for k, p in PATTERNS.items() for m in re.finditer(p, t) if holds(k, m.group())] for t in texts]
    runs = []
    for t, own in zip(texts, mentions):
        masked = list(t)
        for a, b, _ in own:
            masked[a:b] = " " * (b - a)
        runs.append([(m.start(), m.end(), m.group().lower()) for m in regex.finditer(r"\p{L}+", "".join(masked))])
    terms, entities = [{r[2] for r in x} for x in runs], [{m[2] for m in x} for x in mentions]
    n_t, n_e = Counter(t for x in terms for t in x), Counter(e for x in entities for e in x)
    n_te = Counter((t, e) for x, y in zip(terms, entities) for t in x for e in y)
    out, n = set(), len(texts)
    for (t, e), k in n_te.items():
        content, left = math.log(n / n_e[e]), math.log(n_t[t] / k)
        if k >= support and n_e[e] < n and content - left >= threshold * content - 1e-12 and left <= bits * math.log(2) + 1e-12:
            out.add(t)
    return [[f"term:{a}:{b}" for a, b, t in x if t in out] for x in runs], out


def _spans_of(terms, texts):
    """Spans of the given terms in each text, outside personal data."""
    from tests.llm.brute import PATTERNS, holds

    out = []
    for t in texts:
        masked = list(t)
        for k, p in PATTERNS.items():
            for m in re.finditer(p, t):
                if holds(k, m.group()):
                    masked[m.start() : m.end()] = " " * (m.end() - m.start())
        out.append([f"term:{m.start()}:{m.end()}" for m in regex.finditer(r"\p{L}+", "".join(masked)) if m.group().lower() in terms])
    return out


def test_ranges_have_partitions_of_their_own(spark):
    from fixlattice.llm import ranges

    for parts in (7, 51):
        df = spark.range(2000).select(F.col("id"), ranges.count_at_or_below(F.col("id"), list(range(50, 50 * parts, 50))).alias("bucket"))
        dealt = df.withColumn("slot", ranges.even_slot(spark, F.col("bucket"), parts)).repartition(parts, "slot").withColumn("p", F.spark_partition_id())
        rows = dealt.groupBy("bucket").agg(F.min("p").alias("a"), F.max("p").alias("b")).collect()
        assert all(r.a == r.b for r in rows) and len({r.a for r in rows}) == len(rows) == min(parts, 40)
        assert {r.bucket for r in rows} == set(range(len(rows)))


def test_equal_texts_share_a_shard_beside_a_hot_text(spark):
    rows = [(i, "hot " * 200) for i in range(1500)] + [(2000 + i, f"text {i % 700} " * (i % 7 + 1)) for i in range(2800)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    shard = {r.doc_id: r.shard for r in sharding.place(df).collect()}
    by = {}
    for i, t in rows:
        by.setdefault(t, set()).add(shard[i])
    assert all(len(s) == 1 for t, s in by.items() if not t.startswith("hot")) and len(by["hot " * 200]) > 1


def test_sharding_query(spark, sf, texts):
    rows = queries.QUERIES["op6_sampled_splitters"](spark, sf).collect()
    assert {r.doc_id: (r["size"], r.text_crc32) for r in rows} == {d: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in texts.items()}
    sums, slots, law = Counter(), {}, {r.law for r in rows}
    for r in rows:
        sums[r.shard] += r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    assert law == {"bytes"} and set(sums) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sums.values()) - min(sums.values()) <= 2 * max(r["size"] for r in rows) and all(r.grown_shard is None for r in rows)


def test_terms_that_disclose(spark):
    rng = random.Random(4)
    words = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("al", "en", "is", "or", "um")]
    # far from the mention, twice in a text, and once where the address isn't
    rows = [(i, f"Zorblax {' '.join(rng.choices(words, k=90))} bob@x.org {' '.join(rng.choices(words, k=40))} zorblax; frequent") for i in range(6)]
    rows += [(50, " ".join(rng.choices(words, k=30)) + " ZORBLAX")]
    rows += [(100 + i, " ".join(rng.choices(words, k=30)) + " frequent" * (i % 2)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in disclosure.digest(disclosure.find(df)).collect()}
    spans, terms = _disclosed([t for _, t in rows])
    assert terms == {"zorblax"}
    for (i, text), own in zip(rows, spans):
        assert [x for x in found[i].spans.split(",") if x.startswith("term")] == own
    assert len(found[0].spans.split(",")) == 3 and found[50].spans.startswith("term:")
    clean = {r.doc_id: r.text for r in disclosure.sanitised(df).collect()}
    assert not any("zorblax" in t.lower() or "bob@" in t for t in clean.values()) and clean[0].startswith("[TERM] ") and "[EMAIL]" in clean[0]
    assert clean[101] == dict(rows)[101]


def test_copies_are_no_evidence_of_disclosure(spark):
    rng = random.Random(11)
    words = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("al", "en", "is", "or", "um")]

    def plain(n):
        return " ".join(rng.choices(words, k=n))

    one = f"Quibblet {plain(40)} ann@y.org {plain(20)}"
    unlike = [f"{plain(30)} cy@z.org wuzzle {plain(10)}" for _ in range(3)]
    rows = [(i, one, None) for i in range(5)] + [(5, one + " more", 7), (6, one + " and more", 7)]
    rows += [(10 + i, t, None) for i, t in enumerate(unlike)] + [(100 + i, plain(40), None) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, class long")

    def told(**options):
        found = {r.doc_id: r.spans for r in disclosure.digest(disclosure.find(df, **options)).collect()}
        return {k: [dict((i, t) for i, t, _ in rows)[k][int(a) : int(b)].lower() for _, a, b in (x.split(":") for x in v.split(",")) if _ == "term"] for k, v in found.items() if "term" in v}

    by_text, by_class, by_row = told(), told(copy_class="class"), told(copies_once=False)
    assert all(by_text[10 + i] == by_class[10 + i] == by_row[10 + i] == ["wuzzle"] for i in range(3))
    assert "quibblet" in by_row[0] and "quibblet" in by_text[0]  # three texts hold it: one and two that are near it
    assert "quibblet" in by_class[0]  # of which two classes are left
    alone = df.where("doc_id < 5 OR doc_id >= 100")
    assert not any("term" in r.spans for r in disclosure.digest(disclosure.find(alone)).collect())
    near = df.where("doc_id IN (5, 6) OR doc_id >= 100")
    assert not any("term" in r.spans for r in disclosure.digest(disclosure.find(near, copy_class="class")).collect())
    assert disclosure.sanitised(near, copy_class="class").columns == df.columns


def test_disclosure_query_against_brute_force(spark, sf, texts):
    ids = sorted(texts)
    more = {10_000 + i: texts[i] for i in ids if "@" in texts[i]}  # copies, so that some entities have two documents
    docs = spark.createDataFrame([*texts.items(), *more.items()], "doc_id long, text string")
    every = {**texts, **more}
    for support in (2, 3):
        spans, _ = _disclosed(list(every.values()), support)
        rows = {r.doc_id: r for r in disclosure.digest(disclosure.find(docs, support=support, copies_once=False)).collect()}
        assert any(spans)
        for i, own in zip(every, spans):
            assert [x for x in rows[i].spans.split(",") if x.startswith("term")] == own
    # by default a copy is no evidence
    assert not any("term" in r.spans for r in disclosure.digest(disclosure.find(docs)).collect())
    once = {texts[i]: i for i in reversed(ids)}
    _, terms = _disclosed([texts[i] for i in sorted(once.values())])
    spans = _spans_of(terms, [texts[i] for i in ids])
    rows = {r.doc_id: r for r in queries.QUERIES["op10_information_disclosure"](spark, sf).collect()}
    for i, own in zip(ids, spans):
        assert [x for x in rows[i].spans.split(",") if x.startswith("term")] == own


def test_mixture_meets_its_targets(spark):
    rng = random.Random(7)
    common = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(1200):
        toxic = i % 10 == 0
        good = i % 3 > 0
        t = rng.choices(common, k=60) + (["vile", "nasty"] if toxic else []) + ([] if good else ["junk", "###"])
        rng.shuffle(t)
        rows.append((i, " ".join(t)))
        if i % 2 == 0 or i % 7 == 0:
            labels.append((i, int(good), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table, names, wanted, reached = mixing.mix(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), mixing.label_domain(), mixing.TARGETS)
    assert np.abs(wanted - reached).max() < 0.02
    rate = {r.doc_id: r.rate for r in table.collect()}
    truth = {i: i % 10 == 0 for i in range(1200)}
    held = [i for i in truth if i % 3 and i not in {x[0] for x in labels}]
    assert np.mean([(rate[i] < 0.5) == truth[i] for i in held]) > 0.95
    kept = {r.doc_id for r in mixing.take_nearest(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), mixing.label_domain()).collect()}
    assert np.mean([(i in kept) != truth[i] for i in truth]) > 0.97


def test_personal_data_against_brute_force(spark, sf, texts):
    import hashlib

    from tests.llm.brute import personal

    for r in queries.QUERIES["op10_information_disclosure"](spark, sf).collect():
        spans, counts = personal(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts and r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()


def test_fingerprint_query_against_exact_similarity(spark, sf, texts):
    """Texts, hashes and edits exactly; likeness within sampling error of the exact generalised Jaccard similarity."""
    import hashlib

    rows = {r.doc_id: r for r in queries.QUERIES["op1_weighted_sampling"](spark, sf).collect()}
    ids = sorted(texts)
    off = []

    def shingles(t):
        w = t.encode().lower().split()
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()

    for d, n in zip(ids, ids[1:] + ids[:1]):
        text, following, r = texts[d] or "", texts[n] or "", rows[d]
        cut = len(text) // 4
        changed = text[: len(text) - cut] + following[:cut]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        for other, found in ((changed, r.near_edited), (following, r.near_next)):
            a, b = shingles(text), shingles(other)
            truth = sum((a & b).values()) / max(1, sum((a | b).values())) if a or b else 1.0
            off.append(found - truth)
    assert abs(np.mean(off)) < 0.01 and np.sqrt(np.mean(np.square(off))) < 0.065 and np.abs(off).max() < 0.3
    by_text = {}
    for d in ids:
        by_text.setdefault(texts[d] or "", set()).add(rows[d].fingerprint)
    assert all(len(x) == 1 for x in by_text.values())


def test_rates_against_a_dense_solver(spark):
    """The fitted document rates reach the least squares that a dense projected gradient reaches."""
    rng = np.random.default_rng(8)
    p = rng.dirichlet([0.4, 0.4, 0.4], 300)
    n = rng.integers(20, 400, 300)
    df = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p)], "n_tokens long, posterior array<double>")
    total = float(n.sum())
    for target in ([0.5, 0.3, 0.2], [0.9, 0.1, 0.0], [1.5, 0.0, 0.0]):
        target = np.array(target)
        sums, reached, passes = mixing.fit_rates(df, 3, target, total)
        w = n / total
        x = np.ones(300)
        for _ in range(20_000):
            x = np.maximum(0, x - 0.5 / (w @ (p**2).sum(axis=1)) * (p @ ((w * x) @ p - target)))
        best = ((w * x) @ p - target) @ ((w * x) @ p - target)
        own = mixing.rates_of(p, sums)
        assert (own >= 0).all() and (w * own) @ p == pytest.approx(reached) and passes < 25
        # targets at the edge of what is reachable end short by what the pull towards 1 holds
        assert np.linalg.norm(reached - target) <= np.sqrt(best) + 0.015
        exact, at, _ = mixing.fit_rates(df, 3, target, total, pull=1e-6)
        assert np.linalg.norm(at - target) <= np.sqrt(best) + 1e-3


def _plain_ppm(counts, text, order=5):
    """log10 probability by dictionaries: escape method D, symbol exclusion, update exclusion in the counts."""
    past, out = b"\xff" * order, 0.0
    for byte in text + b"\xff":
        seen = set()
        for k in range(order, -1, -1):
            node = {s: c for s, c in counts.get(past[len(past) - k :], {}).items() if s not in seen}
            if not node:
                continue
            total = 2 * sum(node.values())
            if byte in node:
                out += math.log10((2 * node[byte] - 1) / total)
                break
            out += math.log10(len(node) / total)
            seen |= node.keys()
        else:
            out -= math.log10(256 - len(seen))
        past = (past + bytes([byte]))[1:]
    return out


def test_scores_against_a_plain_model(spark):
    rng = random.Random(6)
    words = ["alpha", "beta", "gamma", "delta", "al", "be", "Gam"]
    docs = {i: " ".join(rng.choices(words, k=rng.randrange(0, 25))) + ("é\n" if i % 5 == 0 else "") for i in range(60)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    rows = {r.doc_id: r for r in ppm.score_documents(df, F.col("doc_id") % 4 == 1).collect()}
    counts: dict[bytes, Counter] = {}
    longest = Counter()
    for i, t in docs.items():
        if i % 4 != 1:
            raw = b"\xff" * 5 + t.encode().lower() + b"\xff"
            longest.update((raw[j : j + 5], raw[j + 5]) for j in range(len(raw) - 5))
    level = longest
    for k in range(5, -1, -1):
        for (context, byte), c in level.items():
            counts.setdefault(context, Counter())[byte] = c
        level = Counter((context[1:], byte) for context, byte in level) if k else None
    for i, t in docs.items():
        assert rows[i].score == pytest.approx(_plain_ppm(counts, t.encode().lower()), rel=1e-4), i


def test_mixture_query_against_plain_numpy(spark, sf, texts):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    names, weights, bias = mixing.fit_domains(docs, labels, mixing.label_domain())
    ids = sorted(texts)
    p, n = [], []
    for i in ids:
        own, dense, size = mixing.features((texts[i] or "").encode())
        scores = weights[own].sum(axis=0) + dense @ weights[mixing.BUCKETS :] + bias
        e = np.exp(scores - scores.max())
        p.append(e / e.sum())
        n.append(size)
        assert size == len((texts[i] or "").encode().lower().split())
    p, n = np.array(p), np.array(n, float)
    rows = {r.doc_id: r for r in queries.QUERIES["op2_soft_membership"](spark, sf).collect()}
    assert rows.keys() == set(ids)
    toxic = [k for k, d in enumerate(names) if d in mixing.TOXIC]
    for k, i in enumerate(ids):
        assert rows[i].n_tokens == n[k] and rows[i].domain == names[int(p[k].argmax())]
        assert rows[i].probability == pytest.approx(p[k].max(), abs=1e-4) and rows[i].toxic_probability == pytest.approx(p[k][toxic].sum(), abs=1e-4)
    # what the rates reach, against plain projected gradient that goes on for long
    target = np.array([mixing.TARGETS.get(d, 0.0) for d in names])
    target = target / target.sum()
    a = (p * n[:, None] / n.sum()).T
    rates = np.array([rows[i].rate for i in ids])
    assert (rates >= 0).all()
    x, step = np.ones(len(ids)), 1 / np.linalg.eigvalsh((p * (n / n.sum())[:, None]).T @ p)[-1]
    for _ in range(20_000):
        x = np.maximum(0, x - step * (p @ (a @ x - target)))
    reached, best = np.linalg.norm(a @ rates - target), np.linalg.norm(a @ x - target)
    # with the pull, no other rates are better
    loss = lambda r: np.sum((a @ r - target) ** 2) + mixing.PULL * np.sum(n / n.sum() * (r - 1) ** 2)
    assert loss(rates) <= loss(x) + 1e-6 and reached <= best + 0.015


def test_allocation_rules_against_characters():
    from fixlattice.llm.token_counts import allocate

    rng = random.Random(2)
    for _ in range(200):
        n = rng.randrange(1, 30)
        cuts = sorted(rng.sample(range(1, n + 1), rng.randrange(0, min(n, 6))))
        bounds = np.array([0, *[c for c in cuts if c < n], n])
        ends = np.array(sorted({*rng.sample(range(1, n + 1), rng.randrange(1, n + 1)), n}))
        starts = np.array([0, *ends[:-1]])
        of = np.searchsorted(bounds, np.arange(n), side="right") - 1
        for rule in ("largest", "first", "last"):
            section, crosses = allocate(starts, ends, bounds, rule)
            for k, (a, b) in enumerate(zip(starts, ends)):
                own = of[a:b].tolist()
                held = Counter(own)
                most = max(held.values())
                wanted = {"first": own[0], "last": own[-1], "largest": min(s for s in held if held[s] == most)}[rule]
                assert section[k] == wanted and crosses[k] == (len(held) > 1)


def _character_spans(tok, text):
    """Of each token of the library the characters of which it holds a byte; a token is written with one sign for each of its bytes."""
    of = [i for i, c in enumerate(text) for _ in c.encode()]
    out, at = [], 0
    for t in tok.encode(text, add_special_tokens=False).tokens:
        out.append((of[at], of[at + len(t) - 1] + 1))
        at += len(t)
    assert at == len(of)
    return out


def test_section_query_against_the_library(spark, sf, texts):
    tok = PieceEncoder(public_vocabulary("byte_bpe_50k.json"), True).tok
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {}
    for r in queries.QUERIES["op8_section_tokens"](spark, sf).collect():
        got.setdefault(r.doc_id, []).append(r)
    for d, doc in docs.items():
        parts = [doc.source or "", doc.lang or "", *(doc.text or "").split("\n")]
        whole = "\n".join(parts)
        ends = np.cumsum([len(p) + 1 for p in parts])
        ends[-1] -= 1
        starts = np.array([0, *ends[:-1]])
        counts = Counter()
        for a, b in _character_spans(tok, whole):
            held = np.minimum(ends, b) - np.maximum(starts, a)
            counts[int(np.argmax(held))] += 1
        rows = sorted(got[d], key=lambda r: r.section)
        assert [(r.start, r.end, r.n_tokens) for r in rows] == [(int(a), int(b), counts[k]) for k, (a, b) in enumerate(zip(starts, ends))]


def test_packing_query_against_the_library(spark, sf, texts):
    tok = PieceEncoder(public_vocabulary("word_bpe_49k.json"), False).tok
    got = {(r.doc_id, r.piece): r for r in queries.QUERIES["op9_residual_packing"](spark, sf).collect()}
    wanted = 0
    for d, t in texts.items():
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part, r = ids[at : at + 4096], got[(d, piece)]
            assert (r.start, r.length, r.ids_crc32) == (at, len(part), zlib.crc32(part.tobytes()))
            wanted += 1
    assert len(got) == wanted
