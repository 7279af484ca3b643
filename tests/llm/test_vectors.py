"""Nearest neighbours by measured recall, exact top-k by brute force."""

import numpy as np

from wikilake.llm import ann_tree, topk_threshold

SMALL = "/root/testdata/sf0.001"


def vectors(spark, n=3000, d=16, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) + 3 * rng.normal(size=(8, d))[rng.integers(0, 8, n)]
    x[n // 2:n // 2 + n // 3] = x[n // 2]  # a third of all rows are one vector
    x = x.astype(np.float32)
    return x.astype(np.float64), spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>").cache()


def top(x, q, k):
    s = (x * x[q]).sum(axis=1)
    s[q] = -np.inf
    order = np.lexsort((np.arange(len(x)), -s))[:k]
    return order, s[order]


def test_recall_and_scores(spark):
    x, table = vectors(spark)
    found = {}
    for r in ann_tree.nearest_neighbours(table).collect():
        found.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(found) == set(range(0, len(x), 20))
    hits = total = 0
    for q, rows in found.items():
        ids, scores = top(x, q, 20)
        assert sorted(rows) == list(range(1, 21)) and q not in {i for i, _ in rows.values()}
        got = [rows[k] for k in range(1, 21)]
        assert got == sorted(got, key=lambda p: (-p[1], p[0]))
        assert all(abs(s - (x[q] * x[i]).sum()) < 1e-9 for i, s in got)
        hits += sum(s >= scores[-1] - 1e-9 for _, s in got)
        total += 20
    assert hits / total >= 0.9


def test_recall_on_given_vectors(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = table.orderBy("vec_id").collect()
    x, ids = np.array([r.embedding for r in rows]), np.array([r.vec_id for r in rows])
    found = {}
    for r in ann_tree.nearest_neighbours(table).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    at = {v: k for k, v in enumerate(ids.tolist())}
    recalls = [len(got & set(ids[top(x, at[q], 20)[0]].tolist())) / 20 for q, got in found.items()]
    assert np.mean(recalls) >= 0.9


def test_tree_visits_every_leaf_once_and_places_rows():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 8))
    tree = ann_tree.Tree(x)
    leaves = len(tree.unit)
    assert 1 < leaves <= ann_tree.MAX_LEAVES
    assert sorted(tree.visits(x[0], leaves)) == list(range(leaves))
    placed = tree.leaf_of(x)
    assert placed.min() >= 0 and placed.max() < leaves


def test_threshold_algorithm_is_exact(spark):
    x, table = vectors(spark, seed=2)
    y = np.floor(1024 * x).astype(np.int64)
    found = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk_threshold.exact_top_k(table).collect()}
    assert len(found) == 10 * len(range(0, len(x), 100))
    for q in range(0, len(x), 100):
        s = y @ y[q]
        order = [i for i in np.lexsort((np.arange(len(y)), -s)) if i != q][:10]
        assert [found[q, k + 1] for k in range(10)] == [(i, int(s[i])) for i in order]


def test_threshold_stops_early_and_handles_signs():
    rng = np.random.default_rng(3)
    v = rng.integers(-50, 50, size=(4000, 3))
    lists, ids = topk_threshold.SortedLists(v), np.arange(4000)
    for q in ([5, -3, 0], [0, 0, 0], [-1, -1, -1], [1, 0, 0]):
        at, scores = lists.top(np.array(q), ids, -1, 10)
        s = v @ np.array(q)
        order = np.lexsort((ids, -s))[:10]
        assert at.tolist() == order.tolist() and scores.tolist() == s[order].tolist()


def test_large_components_use_exact_integers(spark):
    rows = [(0, [3e12, 1.0]), (1, [2e3, 5.0]), (2, [-1e12, 0.0])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = [(r.vec_id, r.score) for r in topk_threshold.exact_top_k(table).collect()]
    assert got == [(1, 2**63 - 1), (2, -2**63)] or got[0] == (1, int(1024 * 3e12) * 2048000 + 1024 * 5120)
