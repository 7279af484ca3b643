"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

from wikilake.llm import (ann_tree, bpe_codec, html_extract, jaccard_join, mixing, secret_scan, suffix_dedup, token_counts,
                          topk_threshold, toxicity)
from wikilake.llm.queries import vocabulary

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "one two three four five six seven eight nine ten " * 12000
ROWS = [
    (1, "a b c d e f g h", "en", "s1", 15), (1, "a b c d e f g h", "en", "s1", 15), (2, "a b c d e f g h", None, None, None),
    (None, "a b c d e f g h", "en", "s2", 15), (3, None, "en", "s1", 0), (4, "", "en", "s1", 0), (5, " \n\t ", "en", "s1", 4),
    (6, LONG, "en", "s2", len(LONG)), (7, LONG, "en", "s2", len(LONG)), (None, None, None, None, None),
    (8, "password = 'abcdef99' é 中文 \U0001f600 <|endoftext|>", "en", "", 40), (9, "x" * 30000, "en", "s1", 30000),
]
CLASH = ("mix tokens near dedup bpe secrets toxicity main id h s n size node batch digest rank component label features key "
         "low sigs c0 c1 bucket spans kept src source_size ids numbers answers score").split()


def doc_operators(labels):
    return {
        "mixing": lambda d: mixing.mix_plan(d),
        "mix_documents": lambda d: mixing.mix_documents(d),
        "tokens": lambda d: token_counts.count_tokens(d, vocabulary("byte_bpe_50k.json")),
        "secrets": lambda d: secret_scan.scan_secrets(d),
        "redact": lambda d: secret_scan.redact_secrets(d),
        "toxicity": lambda d: toxicity.score_toxicity(d, labels),
        "near": lambda d: jaccard_join.jaccard_components(d),
        "keep_one": lambda d: jaccard_join.keep_one(d),
        "dedup": lambda d: suffix_dedup.remove_repeats(d),
        "bpe": lambda d: bpe_codec.encode_documents(d, vocabulary("word_bpe_49k.json")),
    }


NAMES = list(doc_operators(None))
ALL_ROWS = {"mixing", "tokens", "secrets", "redact", "toxicity", "near", "dedup", "bpe"}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, None, 1), (None, 0, 0), (99, 1, 1), (6, None, None)], "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize("name", NAMES)
def test_edge_rows(spark, docs, labels, name):
    found = doc_operators(labels)[name](docs)
    assert found.columns[:5] == docs.columns
    n = len(found.collect())
    assert n == len(ROWS) if name in ALL_ROWS else n <= 3 * len(ROWS)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, labels, name):
    found = doc_operators(labels)[name](spark.createDataFrame([], SCHEMA))
    assert found.columns[:5] == [c.split()[0] for c in SCHEMA.split(", ")]
    assert found.count() == 0


@pytest.mark.parametrize("name", NAMES)
def test_clashing_columns(spark, docs, labels, name):
    wide = docs.filter("doc_id < 6").select("*", *[F.lit(f"own {c}").alias(c) for c in CLASH])
    rows = doc_operators(labels)[name](wide).collect()
    assert rows
    for r in rows:
        assert all(r[c] == f"own {c}" for c in CLASH)


def test_vector_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (100, [0.0, 1.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (3, None), (4, []),
            (5, [None, 1.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [0.0, 0.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").select("*", F.lit(1).alias("id"), F.lit(2).alias("v"))
    exact = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk_threshold.exact_top_k(table).collect()}
    assert exact[0, 1] == (1, 1024 * 1024) and exact[0, 2] == (2, 1024 * 1024) and exact[0, 3] == (2, 1024 * 1024)
    assert exact[0, 4] == (8, 0) and exact[0, 5] == (100, 0) and (0, 6) not in exact
    assert exact[100, 1] == (1, 1024 * 1024)
    near = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in ann_tree.nearest_neighbours(table).collect()}
    assert near[0, 1] == (1, 1.0) and near[0, 4] == (100, 0.0) and (0, 5) not in near  # the zero vector takes no part
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert topk_threshold.exact_top_k(empty).count() == 0 and ann_tree.nearest_neighbours(empty).count() == 0


def test_page_edges(spark):
    rows = [(1, "http://a/x", None), (2, None, ""), (3, None, "<p>hi"), (3, None, "<p>hi"), (None, "http://a/y", "<article>x<p>" + "y " * 50000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").select("*", F.lit("own").alias("main"), F.lit("own").alias("p"))
    found = html_extract.extract_main_text(pages)
    assert found.columns == ["page_id", "url", "html", "main", "p", "_main"]
    texts = sorted((r.page_id or 0, r._main.text[:3], r._main.n_chars) for r in found.collect())
    assert texts == [(0, "x y", 100001), (1, "", 0), (2, "", 0), (3, "hi", 2), (3, "hi", 2)]
    assert html_extract.extract_main_text(pages.limit(0)).count() == 0
