"""Language ID: the filter against plain sets, held-out accuracy, edges."""

import numpy as np
from pyspark.sql import functions as F

from wikilake.llm import lang_filters as L

SMALL = "/root/testdata/sf0.01"
EN = "the cat and the dog were in the house while she was reading with her friends "
DE = "die katze und der hund waren in dem haus und sie hat mit ihren freunden gelesen "


def test_grams_are_those_of_the_padded_words():
    words = ["ab", "é", "straße"]
    found, owner = L.grams(words)
    expect = {}
    for i, w in enumerate(words):
        p = f" {w} "
        parts = [p[j:j + n] for n in L.SIZES for j in range(len(p) - n + 1) if p[j:j + n].strip()]
        expect[i] = parts
    for i, parts in expect.items():
        mine = found[owner == i]
        assert len(mine) == len(parts) and len(set(mine.tolist())) == len(set(parts))
    again, _ = L.grams(["ab"])
    assert sorted(again.tolist()) == sorted(found[owner == 0].tolist())


def test_masks_name_every_language_that_holds_a_gram(spark):
    rng = np.random.default_rng(0)
    n = 70  # more than one 64-bit word of languages
    sets = [set(rng.integers(-2**63, 2**63 - 1, 50).tolist()) for _ in range(n)]
    shared = int(rng.integers(-2**63, 2**63 - 1))
    sets[3].add(shared), sets[69].add(shared)
    rows = [(g, k) for k, s in enumerate(sets) for g in s]
    made = (spark.createDataFrame(rows, "gram bigint, number int").select(F.explode(L.positions(F.col("gram"))).alias("p"),
            F.floor(F.col("number") / 64).cast("int").alias("w"), F.expr("shiftleft(1L, number % 64)").alias("bit"))
            .groupBy("p", "w").agg(F.bit_or("bit").alias("mask")).toArrow())
    f = L.SlicedFilter([f"l{k:02}" for k in range(n)], *(made.column(c).to_numpy() for c in ("p", "w", "mask")))
    for k, s in enumerate(sets):
        assert f.bits(f.masks(np.array(sorted(s), dtype=np.int64).view(np.uint64)))[:, k].all()
    both = f.bits(f.masks(np.array([shared], dtype=np.int64).view(np.uint64)))[0]
    assert both[3] and both[69] and both.sum() <= 4
    other = f.bits(f.masks(rng.integers(0, 2**63, 20000).astype(np.uint64)))
    assert abs(other.mean(axis=0) - f.false_rate).max() < 1e-3


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = L.identify_languages(docs).select("lang", "language.*").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and len(held) > 150
    assert np.mean([r.lang == r.lang_pred for r in held]) >= 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_edges(spark):
    train = [(i, (EN if i % 2 else DE) * 3, "en" if i % 2 else "de") for i in range(60)]
    odd = [(None, EN, "de"), (1000, None, "en"), (1001, "", None), (1002, "12 34 _ !! ²", "en"), (1003, "ΩΩΩ", None),
           (1004, DE * 20000, None), (1005, "x" * 600000, None), (1006, EN, None), (1006, EN, None), (1007, EN + "\x00 " + "\U0001f600", None)]
    docs = spark.createDataFrame(train + odd, "doc_id bigint, text string, lang string").repartition(3).select(
        "*", *[F.lit("own").alias(c) for c in ("language", "language_found", "n", "word", "gram", "score")])
    found = L.identify_languages(docs)
    assert found.columns == docs.columns + ["_language"]
    by_id = {}
    for r in found.collect():
        assert r.language == "own" and r.word == "own"
        by_id.setdefault(r.doc_id, []).append((r._language.lang_pred, r._language.score, r._language.held_out))
    assert by_id[None] == [("en", by_id[None][0][1], False)]
    assert [by_id[i][0][0] for i in (1000, 1001, 1002)] == ["und"] * 3 and by_id[1000][0][1] == 0.0
    assert by_id[1003][0][:2] == (by_id[1003][0][0], 0.0) and by_id[1003][0][0] in ("de", "en")
    assert by_id[1004][0][0] == "de" and by_id[1005][0][0] in ("de", "en") and by_id[1007][0][0] == "en"
    assert by_id[1006] == [by_id[1006][0]] * 2 and by_id[1006][0][0] == "en"
    empty = L.identify_languages(spark.createDataFrame([], "doc_id bigint, text string, lang string"))
    assert empty.count() == 0
    alone = L.identify_languages(docs.select("doc_id", "text", F.lit(None).cast("string").alias("lang"))).collect()
    assert {(r.language.lang_pred, r.language.score) for r in alone} == {("und", 0.0)}


def test_long_texts_are_cut_between_words():
    text = ("alpha beta " * 1000) + "y" * 5000 + " gamma"
    pieces = list(L.stretches(text, 300))
    assert "".join(pieces) == text and len(pieces) > 10
    assert [w for p in pieces for w in L.words_of(p)] == L.words_of(text)
