"""Secret scans, exponion clustering and importance resampling, held against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fixlattice.llm import exponion, queries, resampling, secret_scans
from tests.compare import oracle, same

HEX = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
BASE = {
    "assign": r"""(?a)([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}


def base_of(text: str) -> list[tuple[int, int, int, str]]:
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            value = m[2] if kind == "assign" else m[0]
            if len(value) >= (6, 20, 24)[rank]:
                out.append((m.start(), rank, m.end(), value))
    return sorted(out)


def plain_scan(rows: list[tuple]) -> list[tuple]:
    """What the query gives for rows of (doc_id, text, source, lang)."""
    found, owners = [], defaultdict(set)
    for _, text, source, _ in rows:
        base = base_of(text or "")
        tokens = [(m.start(), 3, m.end(), m[0]) for m in re.finditer(r"[A-Za-z0-9+/_=-]+", text or "") if len(m[0]) >= 20]
        more = [t for t in tokens if not any(a < t[2] and t[0] < b for a, _, b, _ in base)]
        found.append((base, more))
        for *_, v in base + more:
            owners[v].add(source)
    out = []
    for (doc_id, *_), (base, more) in zip(rows, found):
        live = [t for t in more if len(owners[t[3]]) <= 2 and secret_scans.looks_live(t[3])]
        text = [",".join(f"{secret_scans.KINDS[r]}:{a}:{b}" for a, r, b, _ in spans) for spans in (base, sorted(base + live))]
        counts = [sum(r == k for _, r, _, _ in base) for k in range(3)]
        n_example = sum(len(owners[v]) >= 5 for *_, v in base)
        n_live = sum(len(owners[v]) <= 2 and secret_scans.looks_live(v) for *_, v in base)
        out.append((doc_id, *counts, len(live), hashlib.sha256(text[0].encode()).hexdigest(), text[1], n_live, n_example))
    return sorted(out, key=repr)


SCAN = ("doc_id", "n_assign", "n_access", "n_hex", "n_live", "base_sha256", "spans", "n_base_live", "n_base_example")


def as_rows(df) -> list[tuple]:
    return sorted((tuple(r[c] for c in SCAN) for r in df.collect()), key=repr)


def test_secret_query_against_a_plain_version(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")  # the smallest has none
    rows = [(r.doc_id, r.text, r.source, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = queries.QUERIES["op11_ownership_frequency"](spark, sf)
    assert as_rows(found) == plain_scan(rows)
    assert sum(r.n_hex for r in found.collect()) > 0


def test_copied_examples_and_owned_credentials_are_told_apart(spark):
    live, copied = "sk9Tb2Vn4Qx7Zr1Lm8Kd3Wp", "ex4Rt8Ui2Op6As1Df7Gh3Jk"
    rows = [(i, f"{'é' * (i % 3)} see {copied} in the manual; API_KEY: 'abcdef{i}'", f"owner{i % 9}", "en") for i in range(40)]
    rows += [(100 + i, f"mine is {live}, and token = \"{live}\"", "hot", ("en", "fr", "de")[i % 3]) for i in range(60)]
    rows += [(200, f"{live}", "other", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    scanned = secret_scans.scan(docs, repository="lang")
    spans = {r.doc_id: r.spans for r in scanned.collect()}
    assert all(secret_scans.KINDS[s["rank"]] != "live" for i in range(40) for s in spans[i])
    assert all([secret_scans.KINDS[s["rank"]] for s in spans[100 + i]] == ["live", "assign"] for i in range(60))
    assert [(s["verdict"], s["n_owners"], s["n_repositories"], s["n_docs"]) for s in spans[200]] == [("live", 2, 4, 61)]
    assert as_rows(secret_scans.digest(scanned)) == plain_scan(rows)


def test_secret_scan_of_odd_rows(spark):
    rows = [
        (1, None, "a", "en"), (2, "", None, None), (None, f"token={HEX}", None, None), (3, f"tokEn = \"{HEX}\" AKIA{'A1' * 8} AKIAAKIA", "a", "en"),
        (3, f"tokEn = \"{HEX}\" AKIA{'A1' * 8} AKIAAKIA", "a", "en"), (4, "x" * 50_000 + " " + "token " * 5000 + "a1" * 20_000, "b", "en"),
        (5, "api_key=12345 passwd:123456 toKen=abcdefgh ſecret=abcdefgh", "b", "en"), (6, f"😀 {HEX}{HEX.upper()} secret  ==  'x/y+z._-'", "c", "en"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumns({c: F.lit("clash") for c in ("row", "found", "value", "owner", "repository", "spans", "key")})
    assert as_rows(secret_scans.digest(secret_scans.scan(docs, repository="lang"))) == plain_scan(rows)
    assert secret_scans.scan(docs.limit(0)).isEmpty()


def plain_clusters(vectors: list[tuple], k: int, rounds: int) -> dict:
    """{position: (cluster, distance)} and the centroids, by comparing all with all in Python's integers."""
    firsts = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in vectors)[:k]
    at = [list(v) for _, v in firsts]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(at)) for _, v in vectors]

    for _ in range(rounds):
        own = [n for _, n in assign()]
        for n in range(len(at)):
            held = [v for (_, v), c in zip(vectors, own) if c == n]
            if held:
                at[n] = [sum(x) // len(held) for x in zip(*held)]
    return [(n, d) for d, n in assign()], at


def test_exponion_query_against_sql(spark, sf):
    same(queries.QUERIES["op12_exponion"](spark, sf).toPandas(), oracle(queries.ORACLES["op12_exponion"], sf))


@pytest.mark.parametrize("n, k, spread", [(300, 12, 3), (400, 40, 50), (30, 40, 2), (1, 3, 1), (200, 1, 9)])
def test_exponion_against_plain_rounds(spark, n, k, spread):
    rng = random.Random(n + k)
    vectors = [(i % (n - n // 10) if n > 9 else i, [rng.randrange(-spread, spread) / 256 for _ in range(6)]) for i in range(n)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumns({c: F.lit(0) for c in ("v", "cluster", "upper", "change")})
    found, at = exponion.cluster(df, centroids=k, rounds=5, dim=6)
    own, wanted = plain_clusters([(i, [round(x * 256) for x in v]) for i, v in vectors], k, 5)
    assert at == wanted
    got = sorted((r.vec_id, r.cluster, r.distance) for r in found.collect())
    assert got == sorted((i, c, d) for (i, _), (c, d) in zip(vectors, own))
    total = {}
    for c, d in own:
        total[c] = total.get(c, 0) + d
    for r in exponion.with_inertia(found, at).collect():
        assert r.cluster_inertia == total[r.cluster] and r.inertia == sum(total.values())
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, wanted[r.cluster])).encode()).hexdigest()


def test_exponion_looks_at_few_centroids_and_keeps_ties():
    rng = np.random.default_rng(5)
    at = rng.integers(-100, 100, (30, 4)) * 20
    x = np.repeat(at, 40, 0) + rng.integers(-30, 30, (1200, 4))
    geometry = exponion.Geometry(at.tolist())
    d = ((x[:, None] - at[None]) ** 2).sum(2)
    near = d.argmin(1)
    best, found, lower, computed = geometry.search(x, near, d[np.arange(len(x)), near])
    assert (best == near).all() and (found == d.min(1)).all() and computed < 0.3 * d.size
    assert (lower <= np.sqrt(np.sort(d, 1)[:, 1])).all()
    # a vector half-way between two centroids, and centroids that are equal
    tied = exponion.Geometry([[10, 0], [0, 0], [10, 0], [0, 0]])
    for start in range(4):
        s = np.array([start])
        assert exponion.settle(tied, np.array([[5, 0]]), s, np.array([np.inf]), np.array([0.0]))[0].tolist() == [0]


def test_exponion_drops_what_isnt_a_vector(spark):
    rows = [(1, [1.0] * 64), (2, None), (3, [1.0] * 63), (4, [1.0] * 63 + [None]), (5, [float("nan")] * 64), (6, [float("inf")] * 64), (None, [2.0] * 64), (1, [1.0] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = exponion.with_inertia(*exponion.cluster(df, centroids=2)).collect()
    # both first centroids are vector 1; the third vector draws number 0 half-way, then all the way, as no tie goes to number 1
    assert sorted((r.vec_id or 0, r.cluster, r.distance) for r in got) == [(0, 0, 0), (1, 1, 0), (1, 1, 0)]
    assert exponion.with_inertia(*exponion.cluster(df.limit(0))).isEmpty()
    with pytest.raises(Exception, match="2\\^27"):
        exponion.cluster(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>"))


def plain_draw(docs: list[tuple], target: list[str | None], percent: int = 5) -> list[tuple]:
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for doc_id, text in docs:
        n, held = features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in held)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(held), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n >= 20])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=repr)


def drawn(df) -> list[tuple]:
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in df.collect()), key=repr)


def test_resampling_query_against_a_plain_version(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert drawn(queries.QUERIES["op13_importance_resampling"](spark, sf)) == plain_draw(docs, target)


def test_resampling_of_odd_rows(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(["Aa", "b-c", "dé", "x9", "_"], k=rng.randrange(10, 60)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "é" * 300 + " " + "w" * 5000 + " end"), (None, "no id " * 30), (None, "no id " * 30)] + [(7, "same text of one id " * 8)] * 90
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7).withColumns({c: F.lit(1) for c in ("row", "place", "score", "rank", "range", "bucket", "weight", "eligible")})
    target = spark.createDataFrame([("same text of b c",), (None,), ("dé x9",)], "text string")
    for percent in (0, 5, 50, 100):
        got = drawn(resampling.resample(docs, target, percent=percent))
        wanted = plain_draw(rows, [r.text for r in target.collect()], percent)
        # rows that are equal but for their rank share the ranks between them
        assert got == wanted
    assert resampling.resample(docs.limit(0), target).isEmpty()
    assert drawn(resampling.resample(docs, target.limit(0))) == plain_draw(rows, [])


def test_tournament_gives_ascending_order_of_any_runs():
    rng = random.Random(4)
    for _ in range(100):
        runs = [sorted(rng.choices(range(20), k=rng.randrange(1, 9))) for _ in range(rng.randrange(0, 9))]
        keys = np.array([b"%03d" % x for run in runs for x in run], "S3")
        found = resampling.ascending_runs(keys)
        assert [keys[i] for i in resampling.tournament(keys, found)] == sorted(keys.tolist())
        assert len(set(resampling.tournament(keys, found))) == len(keys)


def test_draws_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(resampling, "_ROW_BYTES", 1 << 20)
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices("abcdefgh", k=25))) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    target = spark.createDataFrame([("a b c",)], "text string")
    assert drawn(resampling.resample(docs, target, percent=37)) == plain_draw(rows, ["a b c"], 37)


def test_crcs_of_runs_are_those_of_their_bytes():
    made = resampling.RunBuckets(1 << 31)
    texts = [[b"a", b"bb", b"x" * 200, b"c"], [], [b"\xc3\xa9"], [b"q", b"r"]]
    counts, out = made(texts)
    words = [w for t in texts for w in t]
    assert counts.tolist() == [4, 0, 1, 2]
    for k, (bucket, whole) in enumerate(out):
        for i in np.flatnonzero(whole):
            assert bucket[i] == zlib.crc32(b" ".join(words[i - k : i + 1])) % (1 << 31)
