"""Interval sweep over captured listings against plain counting of offsets."""

import random
from collections import Counter

from wikilake.operators import coverage as CO
from wikilake.operators import ranges

EXTENT = "instance string, kind string, space_key string, capture long, start int, n_items int"


def test_sweep_is_the_count_of_every_offset(spark):
    rnd = random.Random(12)
    rows = []
    for key in [("i0", "page", None, 1), ("i0", "page", None, 2), ("i0", "page", "S", 1), ("i1", "space", None, 1)]:
        rows += [(*key, rnd.randrange(300), rnd.randrange(0, 30)) for _ in range(rnd.randrange(3, 40))]
    rows += [("i2", "page", None, 1, 5, 0), ("i3", "page", None, 1, 0, 10), ("i3", "page", None, 1, 10, 10), ("i3", "page", None, 2, 0, 10)]
    got = {(r.instance, r.kind, r.space_key, r.capture): r for r in CO.listing_coverage(spark.createDataFrame(rows, EXTENT).repartition(4)).collect()}
    assert len(got) == len({r[:4] for r in rows})
    for key, r in got.items():
        mine = [x for x in rows if x[:4] == key]
        depth = Counter(o for x in mine for o in range(x[4], x[4] + x[5]))
        assert (r.n_responses, r.n_items, r.covered) == (len(mine), sum(x[5] for x in mine), len(depth))
        if not depth:
            assert (r.first_offset, r.end_offset, r.n_gaps, r.n_overlaps) == (None, None, 0, 0)
            continue
        line = [depth.get(o, 0) for o in range(min(depth), max(depth) + 1)]
        assert (r.first_offset, r.end_offset) == (min(depth), max(depth) + 1)
        starts = [(a, b) for a, b in zip([9, *line], line)]
        assert (r.n_gaps, r.gap_items) == (sum(b == 0 != a for a, b in starts), line.count(0))
        assert r.n_overlaps == sum(b >= 2 for b in line[:1]) + sum(b >= 2 > a for a, b in zip(line, line[1:]))
        assert r.extra_items == sum(d - 1 for d in line if d > 1)


def test_moves_between_captures(spark):
    rows = [("i0", c, p, o) for c, pages in ((1, "abcd"), (5, "bacx"), (9, "bacx")) for o, p in enumerate(pages)] + [("i0", 1, "a", 7), ("i1", 1, "q", 0)]
    got = CO.listing_moves(spark.createDataFrame(rows, "instance string, capture long, page_id string, ordinal long")).collect()
    assert sorted(map(tuple, got)) == [("i0", 1, 5, 1, 2, 1, 1), ("i0", 5, 9, 4, 0, 0, 0)]


def test_prefix_sums_over_many_ranges(spark):
    rows = spark.range(1000).selectExpr("if(id % 3 = 0, 'hot', null) AS g", "id AS k", "id % 7 - 3 AS v").repartition(6)
    for r in ranges.prefix_sums(rows, ["g"], ["k"], "v", 1000, "s").collect():
        same = [k for k in range(r.k + 1) if (k % 3 == 0) == (r.g == "hot")]
        assert r.s == sum(k % 7 - 3 for k in same)
