"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns for every training-data operator."""

import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fixlattice.llm import disclosure, mixing, packing, ppm, quality, sharding, simhash, token_counts, token_files, weighted_sampling
from fixlattice.llm.text import PieceEncoder, byte_level_pieces, public_vocabulary
from tests.llm.brute import personal

LONG = "word " * 6000 + "x" * 20_000
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog by a@b.org and far away", "en", "s0", 10),
    (2, None, "en", "s0", None),
    (3, "", None, None, 0),
    (4, LONG, "en", "s1", len(LONG)),
    (5, "the quick brown fox jumps over the lazy dog by a@b.org and far away", "en", "s0", 10),
    (6, " \n\t ", "fr", "s1", 4),
    (7, "é😀 日本語 #$% +49 30 1234567; 4111 1111 1111 1111; 1.2.3.4", "ja", "s1", 3),
    (7, "é😀 日本語 #$% +49 30 1234567; 4111 1111 1111 1111; 1.2.3.4", "ja", "s1", 3),
    (None, "no id here", "en", "s0", 10),
    (8, "two words", "en", "s0", 9),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHES = ("row", "bucket", "ahead", "size", "fp", "place", "node", "bin", "used", "n", "key", "host", "words", "lines", "mentions", "near", "rate", "posterior", "slot", "shard", "range", "fingerprint")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_fingerprints(docs, none):
    rows = weighted_sampling.fingerprints(docs).collect()
    assert len(rows) == len(ROWS)
    by = {}
    for r in rows:
        by.setdefault(r["text"], set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in by.values())
    assert by[None] == by[""] == by[" \n\t "] == {"0" * 512}
    assert weighted_sampling.fingerprints(none).isEmpty()


def test_compare_with_edited(docs, none, spark):
    rows = sorted(weighted_sampling.compare_with_edited(docs).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert len(rows) == len(ROWS)
    texts = [r[1] or "" for r in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))]
    for r, a, b in zip(rows, texts, texts[1:] + texts[:1]):
        assert r.n_chars == len(a) and r.edited_sha256 == hashlib.sha256(weighted_sampling.edited(a, b).encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert weighted_sampling.compare_with_edited(none).isEmpty()
    one = weighted_sampling.compare_with_edited(docs.where("doc_id = 1")).first()
    assert one.near_next == 1.0


def test_simhash(docs, none):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS)
    got = {r.doc_id: r.component_id for r in rows}
    assert got[5] == got[1] == 1 and got[2] == got[3] == got[6] == 2 and got[7] == 7
    assert simhash.near_duplicates(none).isEmpty()
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 4, 7, 8]
    assert simhash.keep_one(none).isEmpty()


def test_rows_without_an_id_or_of_one_id_are_told_apart(spark):
    def text(i):
        return " ".join(f"w{i}x{k}" for k in range(30))

    rows = [(None, text(1)), (None, text(2)), (None, text(2)), (None, text(3)), (5, text(4)), (5, text(5)), (6, text(5)), (4, text(6)), (5, text(6)), (None, text(6))]
    kept = sorted(simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=lambda r: r.text)
    assert [(r.doc_id, r.text) for r in kept] == [(None, text(1)), (None, text(2)), (None, text(3)), (5, text(4)), (5, text(5)), (4, text(6))]
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in found) == [(0, 0), (0, 0), (0, 0), (0, 0), (0, 4), (4, 4), (5, 4), (5, 5), (5, 5), (6, 5)]


def test_columns_called_as_operators_call_theirs_stay_as_they_are(spark):
    names = ["_key", "_a", "_b", "_keep", "_kept", "_cut", "_new", "_row", "_copies", "_copy", "_spans", "_TEXT", "Node"]
    rows = [(i, f"{' '.join(f'w{i}x{k}' for k in range(30))}\nmail a{i}@b.org to all", "h", 1) for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA.replace("lang string, ", "").replace(" n_chars long", " n_chars long"))
    docs = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in names})
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for stage in (quality.keep_good, simhash.keep_one, disclosure.sanitised, lambda d: mixing.take_nearest(d, labels, mixing.label_domain())):
        made = stage(docs)
        assert made.columns == docs.columns
        got = made.collect()
        assert len(got) == 60 and all(r[c] == f"{c}{r.doc_id}" for r in got for c in names)


def test_packing(docs, none):
    path = public_vocabulary("word_bpe_49k.json")
    rows = packing.pack_documents(docs, path).collect()
    assert {r.doc_id for r in rows} == {r[0] for r in ROWS}
    whole = {}
    for r in rows:
        whole.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in whole.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert packing.pack_documents(none, path).isEmpty()


def test_token_files(docs, none, spark):
    path = public_vocabulary("byte_bpe_50k.json")
    folder = token_files.token_folder(spark)
    parts = token_files.write_token_files(docs, folder, path)
    rows = sorted(token_files.read_token_files(parts, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 4, 5, 6, 7, 7, 8]
    at = 0
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids[-1] == 0
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    empty = token_files.token_folder(spark)
    assert token_files.read_token_files(token_files.write_token_files(none, empty, path), empty).isEmpty()


def test_section_tokens(docs, none):
    path = public_vocabulary("byte_bpe_50k.json")
    rows = token_counts.section_tokens(docs, path).collect()
    enc = PieceEncoder(path, True)
    for doc_id, text, lang, source, _ in ROWS:
        if doc_id == 7 or doc_id is None:
            continue
        whole = "\n".join([source or "", lang or "", text or ""])
        own = [r for r in rows if r.doc_id == doc_id]
        assert sum(r.n_tokens for r in own) == len(enc.tok.encode(whole, add_special_tokens=False).ids)
        assert [r.start for r in sorted(own, key=lambda r: r.section)][1:] == [r.end for r in sorted(own, key=lambda r: r.section)][:-1]
    assert token_counts.section_tokens(none, path).isEmpty()


def test_ppm(docs, none):
    rows = ppm.score_documents(docs, F.col("doc_id") == 8).collect()
    assert len(rows) == len(ROWS) and all(math.isfinite(r.score) and r.score <= 0 for r in rows)
    held = next(r for r in rows if r.doc_id == 8)
    assert held.held_out and held.n_tokens == 3 and held.n_known == 1
    assert ppm.score_documents(none, F.lit(False)).isEmpty()
    untrained = ppm.score_documents(docs.where("doc_id = 8"), F.lit(True)).first()
    assert untrained.score == pytest.approx(-10 * math.log10(256)) and untrained.n_known == 0 and untrained.train_tokens == 0


def test_sharding(docs, none):
    rows = sharding.place(docs, 3).collect()
    assert len(rows) == len(ROWS)
    for k in {r.shard for r in rows}:
        own = sorted(r.slot for r in rows if r.shard == k)
        assert own == list(range(len(own)))
    assert sum(r.size for r in rows) == sum(len((r[1] or "").encode()) + 1 for r in ROWS)
    assert sharding.place(none).isEmpty()


def test_quality(docs, none):
    rows = quality.judge(docs).collect()
    assert len(rows) == len(ROWS)
    long = next(r for r in rows if r.doc_id == 4)
    assert long.n_words == 6001 and long.n_repeat_words == 6000 and long.base_failed and not long.kept
    blank = next(r for r in rows if r.doc_id == 6)
    assert (blank.n_words, blank.word_chars, blank.n_dup_lines, blank.base_failed) == (0, 0, 0, True)
    assert quality.judge(none).isEmpty()
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.isEmpty()


def test_personal_data(docs, none):
    rows = disclosure.digest(disclosure.find(docs)).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        text = next(x[1] for x in ROWS if x[0] == r.doc_id) or ""
        spans, counts = personal(text)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts
        assert r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
    clean = disclosure.sanitised(docs)
    assert clean.columns == docs.columns and clean.count() == len(ROWS)
    seven = next(r for r in clean.collect() if r.doc_id == 7)
    assert "[EMAIL]" not in seven.text and "[CARD]" in seven.text and seven.n_chars == len(seven.text)
    assert disclosure.find(none).isEmpty() and disclosure.sanitised(none).isEmpty()


def test_mixing(docs, none, spark):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (8, 1, 1), (99, 1, 1), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    table = mixing.mix(docs, labels, mixing.label_domain(), mixing.TARGETS)[0]
    rows = table.collect()
    assert len(rows) == len(ROWS) and all(r.rate >= 0 and sum(r.posterior) == pytest.approx(1) for r in rows)
    assert mixing.mix(none, labels, mixing.label_domain(), mixing.TARGETS)[0].isEmpty()
    assert mixing.mix(docs, labels.limit(0), mixing.label_domain(), mixing.TARGETS)[1] == ["all"]
    taken = mixing.take_nearest(docs, labels, mixing.label_domain())
    assert taken.columns == docs.columns
    assert mixing.take_nearest(none, labels, mixing.label_domain()).isEmpty()


def test_pieces_join_to_the_text():
    for text in ("", " ", "a", " a  b ", "a\n b\t c", "x y  z", "  ", "a b "):
        head, rest = byte_level_pieces(text.encode())
        assert "".join([head, *(" " + p for p in rest)]) == text
