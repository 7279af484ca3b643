"""Version table, as-of lookups and restores against a plain dictionary; dry run and roll-back."""

import random

from pyspark.sql import functions as F

from test_updates import PAGE_SCHEMA, REQ_SCHEMA, _pages, _requests
from wikilake.operators import dryrun as DR
from wikilake.operators import history as HI
from wikilake.operators import ranges
from wikilake.operators import updates as U

VERSION_SCHEMA = "instance string, page_id string, version int, title string, storage_html string, change string"


def _versions(seed=4, n=300):
    """A third of all versions belong to one page; numbers have gaps."""
    rnd = random.Random(seed)
    out = {}
    for k in range(n):
        page = "hot" if k % 3 == 0 else str(rnd.randrange(20))
        out[page, rnd.randrange(1, 900)] = ("i0", page, f"T{k}", f"body {rnd.randrange(60)}")
    return [(i, p, v, t, b, "update") for (p, v), (i, _, t, b) in out.items()]


def _asks(seed=5, n=400):
    rnd = random.Random(seed)
    return [(rnd.randrange(150), "i0", "hot" if k % 3 == 0 else str(rnd.randrange(22)), rnd.choice([None, rnd.randrange(0, 1000)]))
            for k in range(n)]


ASK_SCHEMA = "request_seq long, instance string, page_id string, as_of int"


def _found(versions, page, as_of):
    have = [v for _, p, v, *_ in versions if p == page and (as_of is None or v <= as_of)]
    return max(have) if have else None


def test_as_of_is_the_latest_version_at_or_before(spark):
    versions, asks = _versions(), _asks()
    got = HI.page_as_of(spark.createDataFrame(versions, VERSION_SCHEMA).repartition(4), spark.createDataFrame(asks, ASK_SCHEMA).repartition(3))
    body = {(p, v): (t, b) for _, p, v, t, b, _ in versions}
    rows = sorted(((r.request_seq, r.page_id, r.as_of, r.found_version, r.title, r.storage_html) for r in got.collect()), key=repr)
    expect = []
    for seq, _, page, as_of in asks:
        f = _found(versions, page, as_of)
        expect.append((seq, page, as_of, f, *body.get((page, f), (None, None))))
    assert rows == sorted(expect, key=repr)


def test_history_links_neighbours(spark):
    versions = _versions()
    rows = HI.page_history(spark.createDataFrame(versions, VERSION_SCHEMA).repartition(5)).collect()
    assert len(rows) == len(versions)
    for page in {v[1] for v in versions}:
        mine = sorted((r for r in rows if r.page_id == page), key=lambda r: r.version)
        chain = sorted((v[2], v[4]) for v in versions if v[1] == page)
        assert [r.position for r in mine] == list(range(len(chain))) and [r.version for r in mine] == [v for v, _ in chain]
        assert [r.previous_version for r in mine] == [None, *[v for v, _ in chain[:-1]]]
        assert [r.body_changed for r in mine] == [True, *[a[1] != b[1] for a, b in zip(chain, chain[1:])]]
        assert [r.is_latest for r in mine] == [False] * (len(chain) - 1) + [True]


def test_restores_go_one_after_another(spark):
    versions, asks = _versions(), _asks(6)
    got = HI.restore(spark.createDataFrame(versions, VERSION_SCHEMA), spark.createDataFrame(asks, ASK_SCHEMA).repartition(3)).collect()
    expect = set()
    for page in {a[2] for a in asks}:
        newest = state = _found(versions, page, None)
        for _, _, _, as_of in sorted((a for a in asks if a[2] == page), key=lambda a: (a[0], -1 if a[3] is None else a[3])):
            f = _found(versions, page, as_of)
            if f is not None and f != state:
                newest, state = newest + 1, f
                expect.add((page, newest, f))
    assert {(r.page_id, r.version, r.restored_from) for r in got} == expect and len(got) == len(expect)
    body = {(v[1], v[2]): (v[3], v[4]) for v in versions}
    assert all((r.title, r.storage_html) == body[r.page_id, r.restored_from] and r.change == "restore" for r in got)


def test_a_repeated_batch_adds_nothing_and_a_later_one_wins(spark, tmp_path):
    path = str(tmp_path / "versions")
    pages = spark.createDataFrame(_pages(), PAGE_SCHEMA)
    HI.append_versions(HI.stored_versions(pages), path, 0)
    applied = U.apply_requests(pages, spark.createDataFrame(_requests(), REQ_SCHEMA))
    for _ in range(2):
        HI.append_versions(HI.update_versions(applied), path, 1)
    rows = HI.read_versions(spark, path).collect()
    assert len(rows) == 6 + applied.count() and {r.change for r in rows} == {"stored", "update"}
    HI.append_versions(HI.stored_versions(pages.limit(1), "import"), path, 2)
    again = HI.read_versions(spark, path)
    assert again.count() == len(rows) and again.filter("change = 'import'").count() == 1
    newest = {r.page_id: r.storage_html for r in HI.current_pages(again).collect()}
    want = {r.page_id: r.new_body for r in applied.collect()}
    assert all(newest[p] == b for p, b in want.items()) and len(newest) == 6


def test_empty_tables(spark):
    none = spark.createDataFrame([], VERSION_SCHEMA)
    asks = spark.createDataFrame(_asks()[:5], ASK_SCHEMA)
    assert HI.page_history(none).count() == 0 and HI.restore(none, asks).count() == 0
    assert [r.found_version for r in HI.page_as_of(none, asks).collect()] == [None] * 5
    assert HI.page_as_of(none, asks.limit(0)).count() == 0


def test_ranges_number_and_carry_over_many_ranges(spark):
    rows = spark.range(500).select((F.col("id") % 2).alias("g"), F.col("id").alias("k"), F.when(F.col("id") % 50 < 2, F.col("id")).alias("v")).repartition(7)
    got = ranges.last_before(ranges.numbered(rows, ["g"], ["k"], 500), ["g"], ["k"], "v", 500, "last").collect()
    for r in got:
        assert r.pos == r.k // 2 and r.last == r.k // 50 * 50 + r.g


def test_dry_run_reports_exact_hunks_and_writes_nothing(spark, tmp_path):
    pages, reqs = spark.createDataFrame(_pages(), PAGE_SCHEMA), spark.createDataFrame(_requests(), REQ_SCHEMA)
    run = DR.dry_run(pages, reqs)
    report = {r.page_id: r for r in DR.change_report(run).collect()}
    applied = {r.page_id: r for r in U.apply_requests(pages, reqs).collect()}
    assert set(report) == set(applied)
    for p, r in report.items():
        assert r.exact and r.new_version == applied[p].new_version and r.n_hunks >= 1
        old, new = next(x[6] for x in _pages() if x[1] == p).split("\n"), applied[p].new_body.split("\n")
        assert r.n_added - r.n_removed == len(new) - len(old)
    path = str(tmp_path / "backup")
    DR.write_backup(run, path)
    done = applied
    changed = spark.createDataFrame([(*x[:5], done[x[1]].new_version, done[x[1]].new_body) if x[1] in done else x for x in _pages()], PAGE_SCHEMA)
    back = DR.roll_back(changed, spark.read.parquet(path))
    assert sorted(map(tuple, back.collect())) == sorted(_pages())
