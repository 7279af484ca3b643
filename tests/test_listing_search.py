"""Listings (S1-S5, A1) and fuzzy search."""

import json

from pyspark.sql import functions as F

from wikilake.operators.search import search_pages
from wikilake.sources import listing as L

TITLES = [("VAMP", "Vampire Lair Home"), ("VAMP", "Welcome to the Vampire Lair"),
          ("VAMP", "Elephant Migration Patterns"), ("TEST", "TEST"), ("TEST", "Elephant Diet Guide")]


def _raw(spark, responses):
    rows = [("i0", "page", None, start, body) for start, body in responses]
    return spark.createDataFrame(rows, "instance string, kind string, space_key string, start int, body string")


def _body(items, start, limit=100, nxt=True):
    return json.dumps({"results": items, "start": start, "limit": limit, "size": len(items),
                       "_links": {"next": "/more"} if nxt else {}})


def test_listing_gives_table_back_and_defaults(spark):
    items = [{"id": str(i), "title": f"T{i}", "space": {"key": "K", "name": "N"}} for i in range(250)]
    items[5].pop("title")
    items[7].pop("space")
    responses = [(s, _body(items[s:s + 100], s, nxt=s + 100 < 250)) for s in range(0, 250, 100)]
    out = L.page_listing(_raw(spark, responses)).orderBy("ordinal").collect()
    assert [r.page_id for r in out] == [str(i) for i in range(250)]
    assert out[5].title == "Untitled" and out[7].space_key == "UNKNOWN" and out[7].space_name == "Unknown Space"


def test_audit_flags_gap_dups_and_early_stop(spark):
    items = [{"id": str(i)} for i in range(300)]
    responses = [(0, _body(items[0:100], 0)), (200, _body(items[200:300] + [{"id": "0"}], 200)),
                 (301, _body(items[0:3], 301, nxt=True)), (304, "")]
    a = {r.start: r for r in L.listing_audit(_raw(spark, responses)).collect()}
    assert a[0].gap_after and not a[0].is_last
    assert a[301].is_last and a[301].stops_early
    assert a[304].empty_body and a[304].is_last and a[304].n_items == 0
    assert a[0].n_dup_ids == 4  # ids 0, 1, 2 listed twice and 0 three times
    assert a[0].fetched_so_far == 100


def test_counts(spark):
    rows = [("i0", str(i), "t", "A" if i % 3 else "B", "n", i) for i in range(9)]
    lst = spark.createDataFrame(rows, "instance string, page_id string, title string, space_key string, space_name string, ordinal long")
    got = {(r.instance, r.space_key): r.n_pages for r in L.listing_counts(lst).collect()}
    assert got[("i0", "A")] == 6 and got[("i0", "B")] == 3 and got[("i0", None)] == 9 and got[(None, None)] == 9


def _search(spark, query):
    rows = [("i0", k, f"{k} space", t, str(i), i) for i, (k, t) in enumerate(TITLES)]
    df = spark.createDataFrame(rows, "instance string, space_key string, space_name string, title string, page_id string, ordinal long")
    return [r.title for r in search_pages(df, query).orderBy("ordinal").collect()]


def test_search_examples(spark):
    assert _search(spark, "TEST") == ["TEST", "Elephant Diet Guide"]
    assert _search(spark, "elephant") == ["Elephant Migration Patterns", "Elephant Diet Guide"]
    # fuzzy terms match across the whole row text, as the list tool does; results keep input order
    assert _search(spark, "vlh") == ["Vampire Lair Home", "Welcome to the Vampire Lair", "Elephant Migration Patterns"]
    assert _search(spark, "vamp home") == ["Vampire Lair Home"]
    assert _search(spark, "^TEST 'diet") == ["Elephant Diet Guide"]
    assert _search(spark, "vamp !lair") == ["Elephant Migration Patterns"]
    assert _search(spark, "diet | home") == ["Vampire Lair Home", "Elephant Diet Guide"]
    assert _search(spark, "Elephant") == ["Elephant Migration Patterns", "Elephant Diet Guide"]
    assert _search(spark, "ELEPHANT") == []


def test_stored_listing_prunes_partitions(spark, tmp_path):
    rows = [("i0", 0, i, i, str(i), "t", "A" if i % 2 else "B", "n") for i in range(10)]
    lst = spark.createDataFrame(rows, "instance string, resp_start int, item_pos int, ordinal long, page_id string, "
                                      "title string, space_key string, space_name string")
    L.write_listing(lst, str(tmp_path / "lst"))
    df = L.read_space(spark, str(tmp_path / "lst"), "A")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(space_key" in plan and "(space_key" in plan
    assert sorted(r.page_id for r in df.collect()) == ["1", "3", "5", "7", "9"]


def test_first_pages_per_space(spark):
    rows = [("i0", 0, i, 10 - i, str(i), "t", "A" if i % 2 else "B", "n") for i in range(10)]
    lst = spark.createDataFrame(rows, "instance string, resp_start int, item_pos int, ordinal long, page_id string, "
                                      "title string, space_key string, space_name string")
    got = sorted((r.space_key, r.rank, r.page_id) for r in L.first_pages(lst, 2).collect())
    assert got == [("A", 1, "9"), ("A", 2, "7"), ("B", 1, "8"), ("B", 2, "6")]


def test_corrupt_and_empty_responses_are_flagged_not_lost(spark):
    items = [{"id": str(i)} for i in range(30)]
    whole = _body(items[10:20], 10, limit=10)
    responses = [(0, _body(items[0:10], 0, limit=10)), (10, whole[:40]), (20, ""), (30, '{"statusCode":500}')]
    raw = _raw(spark, responses)
    assert L.page_listing(raw).count() == 10
    assert {r.start: r.body for r in L.listing_rejects(raw).collect()} == {10: whole[:40], 30: '{"statusCode":500}'}
    a = {r.start: r for r in L.listing_audit(raw).collect()}
    assert [a[s].is_corrupt for s in (0, 10, 20, 30)] == [False, True, False, True]
    assert not a[10].is_last and a[10].gap_after and not a[30].is_last
    assert not a[0].is_last and not a[0].gap_after and a[0].fetched_so_far == 10  # the response's own limit


def test_parent_is_the_last_ancestor(spark):
    body = json.dumps({"id": "9", "title": "t", "ancestors": [{"id": "root"}, {"id": "mid"}, {"id": "parent"}]})
    rows = spark.createDataFrame([("i0", body), ("i0", body[:30])], "instance string, body string")
    got = sorted(L.page_details(rows).collect(), key=lambda r: r.is_corrupt)
    assert got[0].parent_id == "parent" and got[0].bad_text is None
    assert got[1].is_corrupt and got[1].bad_text == body[:30]


def test_audit_parses_each_response_once(spark):
    plan = L.listing_audit(_raw(spark, [(0, _body([{"id": "1"}], 0))]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(instance") <= 4


def test_many_queries_in_one_join_find_what_each_finds_alone(spark, monkeypatch):
    """Against the one-query search, with a hot key in many parts and every odd query form."""
    from wikilake.operators import search_many as SM
    monkeypatch.setattr(SM, "ROWS_PER_KEY", 7)
    titles = ["Vampire Lair Home", "Elephant Diet Guide", "TEST", "a|b $x ^y", "Straße ÄÖ", "", "x", "Lair | Home!", "two\nlines vlh", "V\nlh"] + \
        [f"Page {i} {'odd' if i % 2 else 'even'}" for i in range(40)]
    rows = [("i0", i, str(i), t, "EN" if i % 3 else "DE", "Space", "k") for i, t in enumerate(titles)] + [("i0", 1, "1", titles[1], "DE", "Space", "k")]
    listing = spark.createDataFrame(rows, "instance string, ordinal int, page_id string, title string, space_key string, space_name string, own string")
    queries = ["vlh", "TEST", "test", "'lair home", "^EN page odd", "!page", "!page !lair", "lair | diet", "lair | !page", "| x |", "a | | b", "", "   ",
               "x$", "^DE 'diet 1$", "qzx", "!a | b", "Page even 'en", "$x", "^", "'", "ÄÖ", "äö", "straße", "7 | 8 | 9 odd", "p", "pg", "xx | yy", "vlh two", "!"]
    asked = spark.createDataFrame(list(enumerate(queries)) + [(99, None)], "query_id int, query string").repartition(3)
    found = SM.search_many(listing, asked)
    assert found.columns == ["query_id", *listing.columns]
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append((r.ordinal, r.page_id))
    for i, q in list(enumerate(queries)) + [(99, "")]:
        alone = sorted((r.ordinal, r.page_id) for r in search_pages(listing, q).collect())
        assert sorted(got.get(i, [])) == alone, q


def test_many_queries_need_no_cross_join(spark):
    from wikilake.operators import search_many as SM
    listing = spark.createDataFrame([("i0", 1, "1", "A", "EN", "S")], "instance string, ordinal int, page_id string, title string, space_key string, space_name string")
    found = SM.search_many(listing, spark.createDataFrame([(1, "a")], "query_id int, query string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "Cartesian" not in found._jdf.queryExecution().executedPlan().toString()
    assert SM.search_many(listing.limit(0), spark.createDataFrame([(1, "a")], "query_id int, query string")).count() == 0
    assert SM.search_many(listing, spark.createDataFrame([], "query_id int, query string")).count() == 0


def test_blocks_of_queries_look_for_each_term_once(spark, monkeypatch):
    import pyarrow as pa
    from wikilake.operators import search_many as SM
    looked = []
    real = SM.term_hits
    monkeypatch.setattr(SM, "term_hits", lambda term, text, low: looked.append(term) or real(term, text, low))
    term = {"negate": False, "exact": True, "head": False, "tail": False, "fold": True, "text": "ab"}
    own = {"_group": 1, "_no": 0, "t": term}
    rows = pa.table({"_row": ["xAB", "b a", "ab"], "_low": ["xab", "b a", "ab"], "own": [{"n": i} for i in range(3)]})
    asked = pa.table({"_q": list(range(50)), "_via": [0] * 50, "_terms": [[own]] * 50})
    assert sorted(map(str, SM.found_in_block(rows, asked).to_pylist())) == sorted(str({"q": q, "own": {"n": n}}) for q in range(50) for n in (0, 2))
    assert len(looked) == 1
    # blocks of two rows and two queries find the same
    monkeypatch.setattr(SM, "ROWS_PER_KEY", 2)
    monkeypatch.setattr(SM, "QUERIES_PER_BLOCK", 2)
    listing = spark.createDataFrame([("i0", i, str(i), f"T{i % 3}", "EN", "S") for i in range(9)],
                                    "instance string, ordinal int, page_id string, title string, space_key string, space_name string")
    asked = spark.createDataFrame([(i, "en") for i in range(7)] + [(9, "!t1 | t2")], "query_id int, query string")
    got = sorted((r.query_id, r.ordinal) for r in SM.search_many(listing, asked).collect())
    assert got == sorted([(q, i) for q in range(7) for i in range(9)] + [(9, i) for i in range(9) if i % 3 != 1])


def records_shuffled(node) -> int:
    """Records written by the exchanges of a plan that was run."""
    if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return records_shuffled(node.executedPlan())
    if "QueryStage" in node.getClass().getSimpleName():
        return records_shuffled(node.plan())
    own = node.metrics().get("shuffleRecordsWritten")
    below = node.children()
    return (own.get().value() if own.isDefined() else 0) + sum(records_shuffled(below.apply(i)) for i in range(below.size()))


def test_rows_are_not_sent_for_every_common_key(spark):
    """A row with the keys of 60 queries was sent 60 times."""
    from wikilake.operators import search_many as SM
    words = [chr(97 + i // 26) + chr(97 + i % 26) + "q" for i in range(60)]
    listing = spark.createDataFrame([("i0", i, str(i), " ".join(words[i % 2:]), "EN", "S") for i in range(200)],
                                    "instance string, ordinal int, page_id string, title string, space_key string, space_name string")
    asked = spark.createDataFrame([(n, "'" + w) for n, w in enumerate(words)] + [(99, "'q 'en 7$")], "query_id int, query string")
    found = SM.search_many(listing, asked)
    got = sorted((r.query_id, r.ordinal) for r in found.collect())
    assert got == sorted([(n, i) for n in range(60) for i in range(200) if n or i % 2 == 0] + [(99, i) for i in range(7, 200, 10)])
    assert records_shuffled(found._jdf.queryExecution().executedPlan()) < 200 * 60 / 2


def test_common_keys_of_few_queries_keep_to_their_rows(spark):
    from wikilake.operators import search_many as SM
    drivers = spark.createDataFrame([(1, 0, "3abc"), (2, 0, "3abc"), (2, 1, "1x"), (3, 0, "3rare")], "_q int, _via int, _key string")
    counts = spark.createDataFrame([("3abc", 100), ("1x", 5), ("3rare", 3), (SM.ANY, 1000)], "_key string, _n long")
    kept = SM.on_every_row(drivers, counts, 4, 1000)  # 92 copies saved are not worth 1,000
    assert sorted(map(tuple, kept.collect())) == [(1, 0, "3abc"), (2, 0, "3abc"), (2, 1, "1x"), (3, 0, "3rare")]
    moved = SM.on_every_row(drivers, counts, 4, 80)  # query 2 moves with all its alternatives
    assert sorted(map(tuple, moved.collect()), key=str) == [(1, None, SM.ANY), (2, None, SM.ANY), (3, 0, "3rare")]
    with_open = drivers.union(spark.createDataFrame([(4, None, SM.ANY)], drivers.schema))
    assert {r._q for r in SM.on_every_row(with_open, counts, 4, 1000).filter(f"_key = '{SM.ANY}'").collect()} == {1, 2, 4}
