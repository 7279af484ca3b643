"""Hard negatives against brute force; boxes and pruning of the tree."""

import numpy as np
from pyspark.sql import functions as F

from wikilake.llm.rtree import MOST, LEAST, RTree, Tiling, hard_negatives, packed_order, spans


def brute(rows, every=100, k=5, m=10, relabel=False):
    """rows: (id, vector or None, label)."""
    good = [(i, np.floor(256 * np.array(v)).astype(np.int64), (lab + 1) % 10 if relabel and i % 7 == 0 else lab) for i, v, lab in rows
            if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for a in {r[0] for r in good if r[0] % every == 0}:
        _, q, lab = min(((r[0], r[1].tolist(), r[2]) for r in good if r[0] == a), key=lambda r: (r[1], r[2]))
        scored = [(int(np.dot(q, v)), i, own) for i, v, own in good if i != a]
        same = sorted([(-s, i) for s, i, own in scored if own == lab])[:k]
        for slot, (minus, p) in enumerate(same):
            ps = -minus
            hard = sorted((-s, i) for s, i, own in scored if own != lab and 30 * ps <= 100 * s <= 90 * ps)[:m]
            out |= {(a, p, r + 1, i, ps, -s, slot + 1) for r, (s, i) in enumerate(hard)}
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(4)


def clustered(n=3000, d=12, seed=0):
    rng = np.random.default_rng(seed)
    labels = rng.integers(0, 10, n)
    x = (rng.normal(size=(10, d))[labels] + rng.normal(size=(n, d)) * 0.7).astype(np.float32).astype(float)
    x[n // 2:n // 2 + n // 3] = x[n // 2]  # a third of all rows share one vector
    return [(int(i), x[i].tolist(), int(labels[i])) for i in range(n)]


def test_many_small_tiles_give_the_brute_force_rows(spark):
    rows = clustered()
    found = hard_negatives(table(spark, rows), every=50, rows_per_block=150).collect()
    assert len(found) == len(set(map(tuple, found)))
    assert set(map(tuple, found)) == brute(rows, 50)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (100, [0.5, 1.0], 1), (100, [0.25, 1.0], 2), (1, [1.0, 1.0], 1), (2, [0.5, 0.25], 2),
            (2, [0.5, 0.25], 2), (3, None, 1), (4, [], 1), (5, [None, 1.0], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [0.0, 0.0], 2),
            (9, [1.0, 1.0], None), (None, [1.0, 1.0], 1), (200, [-1.0, -1.0], 1), (300, [0.0, 0.0], 3)]
    wide = table(spark, rows).select("*", *[F.lit("own").alias(c) for c in ("id", "v", "tile", "part", "anchor", "slot", "x", "q")])
    assert set(map(tuple, hard_negatives(wide).collect())) == brute(rows)
    assert hard_negatives(wide.limit(0)).count() == 0
    assert hard_negatives(table(spark, [(1, [1.0], 1)])).count() == 0  # no anchor
    long = hard_negatives(table(spark, rows + [(400, [1.0, 2.0, 3.0], 1)]))  # another length takes no part
    assert set(map(tuple, long.collect())) == brute(rows)


def test_labels_change_by_rule(spark):
    rows = clustered(700, 5, 3)
    found = hard_negatives(table(spark, rows), relabel=lambda i, lab: F.when(i % 7 == 0, (lab + 1) % 10).otherwise(lab), rows_per_block=90).collect()
    assert set(map(tuple, found)) == brute(rows, relabel=True)


def test_large_components(spark):
    rows = [(0, [3e9, 1.0], 1), (1, [2e9, 5.0], 1), (2, [1e9, 0.0], 2), (3, [-1e9, 0.0], 2)]
    got = hard_negatives(table(spark, rows)).collect()
    assert [(r.positive_id, r.negative_id) for r in got] == [] or all(LEAST <= r.negative_score <= MOST for r in got)


def test_tree_prunes_and_boxes_hold_their_rows():
    rng = np.random.default_rng(2)
    v = rng.integers(-300, 300, size=(5000, 3))
    order = packed_order(v, 32)
    assert sorted(order.tolist()) == list(range(5000))
    ids, labels = np.arange(5000), rng.integers(0, 4, 5000)
    tree = RTree(v, ids, labels, leaf=32, fanout=32)
    q = np.array([250, -100, 30])
    for (low, high), size in zip(tree.levels, (32, 32 ** 2)):
        bottom, top = spans(q, low, high)
        for node in range(len(low)):
            s = tree.v[node * size:(node + 1) * size] @ q
            assert bottom[node] <= s.min() and s.max() <= top[node]
    ((found, scores),) = tree.search(q, 17, 2, True, [(LEAST, MOST, LEAST)], 5)
    s = v @ q
    right = [i for i in np.lexsort((ids, -s)) if labels[i] == 2 and i != 17][:5]
    assert found == right and scores == s[right].tolist() and tree.opened < 40
    tree.opened = 0
    ((found, _),) = tree.search(q, 17, 2, False, [(40000, 41000, 40000)], 10)
    right = [i for i in np.lexsort((ids, -s)) if labels[i] != 2 and i != 17 and 40000 <= s[i] <= 41000][:10]
    assert found == right and tree.opened < len(tree.levels[0][0])


def test_tiles_are_balanced():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(8000, 6))
    t = Tiling(x[:2000], 50)
    sizes = np.bincount(t.place(x), minlength=t.count)
    assert t.count >= 40 and sizes.max() < 3 * 8000 / t.count
    assert len(set(Tiling(np.ones((500, 4)), 50).place(np.ones((10, 4))).tolist())) == 1  # equal vectors share a tile
