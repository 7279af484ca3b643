"""Suffix-array dedup and the Jaccard join against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wikilake.llm import jaccard_join as J
from wikilake.llm import suffix_dedup as S
from wikilake.llm.components import connected_components
from wikilake.llm.lyndon import suffix_array
from wikilake.llm.packing import pack, unpack

SMALL = "/root/testdata/sf0.001"


def test_suffix_array_by_grouping():
    rnd = random.Random(1)
    assert suffix_array([]) == []
    for k in range(1500):
        s = rnd.choices(range(2 + k % 4), k=rnd.randint(1, 40))
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_packing_round_trip():
    rng = np.random.default_rng(0)
    for bits in (1, 7, 8, 28, 33, 62):
        x = rng.integers(0, 2**bits, 500)
        assert (unpack(pack(x)) == x).all()
    assert len(unpack(pack(np.empty(0, dtype=np.int64)))) == 0


def removed_by_brute_force(rows):
    least = {}
    for i, t in rows:
        b, own = (t or "").encode(), S.LAST_ID if i is None else i
        for s in range(len(b) - 49):
            w = b[s:s + 50]
            least[w] = min(own, least.get(w, own))
    out = []
    for i, t in rows:
        b, own = (t or "").encode(), S.LAST_ID if i is None else i
        gone = bytearray(len(b))
        for s in range(len(b) - 49):
            if least[b[s:s + 50]] < own:
                gone[s:s + 50] = b"\1" * 50
        spans = sum(1 for j in range(len(b)) if gone[j] and not (j and gone[j - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def removed(table, **options):
    found = S.remove_repeats(table, keep=["doc_id"], **options)
    return sorted([tuple(r) for r in found.select("doc_id", "dedup.n_bytes", "dedup.n_removed", F.size("dedup.spans"),
                                                  F.sha2("dedup.kept", 256)).collect()], key=str)


def passages():
    rnd = random.Random(4)
    base = ["".join(rnd.choices("abc é", k=rnd.randint(0, 400))) for _ in range(12)] + ["a" * 700, "ab" * 300]
    rows = []
    for i in range(100):
        t = ""
        for _ in range(rnd.randint(0, 4)):
            b = rnd.choice(base)
            a = rnd.randint(0, len(b))
            t += b[a:a + rnd.randint(0, 300)]
        rows.append((rnd.choice([i, None, 3]) if i % 7 == 0 else i, rnd.choice([t, t, t, rnd.choice(base), None])))
    return rows + [(i + 500, t) for i, t in rows[:25] if i is not None]


@pytest.mark.parametrize("options", [{}, {"batch_chars": 500, "hot": 3}])
def test_repeats_are_removed_as_by_brute_force(spark, options):
    rows = passages()
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).cache()
    assert removed(table, **options) == removed_by_brute_force(rows)


def token_sets(rows):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append((i, frozenset(zip(w, w[1:], w[2:])) if len(w) > 2 else frozenset([tuple(w)] if w else [])))
    return sets


def components_by_brute_force(sets):
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    inverted = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for token in s:
            inverted[token].append(k)
    shared = Counter((a, b) for ks in inverted.values() for x, a in enumerate(ks) for b in ks[x + 1:])
    for (a, b), n in shared.items():
        if 100 * n >= 90 * (len(sets[a][1]) + len(sets[b][1]) - n):
            up[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for k, (i, _) in enumerate(sets):
        least[root(k)] = min(x for x in (i, least.get(root(k))) if x is not None) if i is not None else least.get(root(k))
    return sorted([(i, len(s), least[root(k)] if s else i) for k, (i, s) in enumerate(sets)], key=str)


def near_copies():
    rnd = random.Random(7)
    rows = []
    for c in range(25):
        words = [f"w{rnd.randint(0, 300)}" for _ in range(rnd.choice([1, 2, 3, 8, 12, 40, 150, 900]))]
        for _ in range(rnd.randint(1, 12)):
            rows.append((len(rows), " ".join(words).upper() if rnd.random() < 0.2 else " ".join(words)))
            for _ in range(rnd.randint(0, max(1, len(words) // 60))):  # the chain drifts away from its start
                words[rnd.randrange(len(words))] = f"w{rnd.randint(0, 300)}"
    rnd.shuffle(rows)
    return rows + [(None, rows[0][1]), (10_000, rows[1][1]), (10_001, "")]


def test_components_as_by_brute_force(spark):
    rows = near_copies()
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).cache()
    found = J.jaccard_components(table).select("doc_id", "near.n_shingles", "near.component_id").collect()
    assert sorted([tuple(r) for r in found], key=str) == components_by_brute_force(token_sets(rows))
    kept = [r.doc_id for r in J.keep_one(table).collect()]
    roots = {r[2] for r in components_by_brute_force(token_sets(rows))}
    assert sorted(kept) == sorted(roots)


def test_components_on_given_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    found = J.jaccard_components(docs.select("doc_id", "text")).select("doc_id", "near.n_shingles", "near.component_id").collect()
    assert sorted([tuple(r) for r in found], key=str) == components_by_brute_force(token_sets(rows))


def components_by_matrix(rows, n_words, percent):
    """As ``components_by_brute_force``, for larger tables: all overlaps by one product."""
    sets = []
    for _, t in rows:
        w = t.lower().split()
        sets.append({tuple(w[i:i + n_words]) for i in range(max(1, len(w) - n_words + 1))} if w else set())
    at = {t: k for k, t in enumerate(set().union(*sets))}
    has = np.zeros((len(sets), len(at)), dtype=np.float32)
    for k, one in enumerate(sets):
        has[k, [at[t] for t in one]] = 1
    size = np.array([len(one) for one in sets])
    shared = (has @ has.T).astype(np.int64)
    link = (100 * shared >= percent * (size[:, None] + size[None, :] - shared)) & (shared > 0)
    least = np.array([i for i, _ in rows])
    while True:
        now = np.array([least[row].min() if row.any() else own for row, own in zip(link, least)])
        if (now == least).all():
            return sorted(zip([i for i, _ in rows], size.tolist(), least.tolist()))
        least = now


def family(n, seed=11):
    """``n`` near copies of one text, each changed in its own places; one in 97 links with none."""
    rnd = random.Random(seed)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(rnd.choice([1, 1, 1, 2, 2]) if i % 97 else 7):
            words[rnd.randrange(200)] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    return rows


def test_a_family_of_near_copies_takes_rows_in_proportion(spark, monkeypatch):
    asked, real = [], J.cross_queries

    def counted(rows, placed):
        found = real(rows, placed)
        asked.append(found.count())
        return found

    monkeypatch.setattr(J, "GROUP", 16)
    monkeypatch.setattr(J, "cross_queries", counted)
    rows = family(1200)
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = J.jaccard_components(table).select("doc_id", "near.n_shingles", "near.component_id").collect()
    assert sorted(tuple(r) for r in found) == components_by_matrix(rows, 3, 90)
    assert sum(asked) < 3 * len(rows)  # every pair of groups once would be 37 rows a node


def test_components_with_other_shingles_and_similarity(spark):
    rows = [(i, t) for i, t in near_copies() if i is not None]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = J.jaccard_components(table, words=5, percent=80).select("doc_id", "near.n_shingles", "near.component_id").collect()
    assert sorted(tuple(r) for r in found) == components_by_matrix(rows, 5, 80)
    assert sorted(r.doc_id for r in J.keep_one(table, words=5, percent=80).collect()) == sorted(
        {c for _, n, c in components_by_matrix(rows, 5, 80)})


def test_parts_lose_no_pair():
    """Any two sets at the threshold share a signature."""
    rnd = np.random.default_rng(3)
    ends = J.class_ends()
    for _ in range(400):
        n = int(rnd.integers(9, 400))
        a = np.unique(rnd.integers(0, 2**63, n).astype(np.uint64))
        out = int(rnd.integers(0, max(1, len(a) // 18) + 1))
        keep = np.sort(rnd.permutation(a)[out:])
        b = np.unique(np.concatenate([keep, rnd.integers(0, 2**63, int(rnd.integers(0, max(1, len(a) // 18) + 1))).astype(np.uint64)]))
        if J.links(a, b) and len(a) != len(b) or J.links(a, b) and (a != b).any():
            sigs = []
            for x in (a, b):
                c = int(np.searchsorted(ends, len(x)))
                sigs.append(set(np.concatenate([J.part_signatures(x, k) for k in (c - 1, c) if k >= 0]).tolist()))
            assert sigs[0] & sigs[1]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 200)] + [(500, 501), (501, 500)], "a bigint, b bigint")
    found = {r.node: r.component for r in connected_components(edges).collect()}
    assert found == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def test_a_question_is_asked_once_however_many_signatures_are_shared(spark):
    """Against the questions signature by signature; the joins make fewer rows than those."""
    rnd = random.Random(5)
    rows = spark.createDataFrame([(sig, node, node % 40 if node % 3 else 0, 0) for sig in range(30) for node in range(120) if rnd.random() < 0.7],
                                 "sig bigint, node bigint, component bigint, dominant bigint")
    placed = spark.createDataFrame([(node, node % 7 + 100) for node in range(120)], "node bigint, grp bigint")
    at = rows.join(placed, "node").collect()
    reach, each = {}, []
    for r in at:
        reach.setdefault((r.sig, r.grp), []).append(r.component)
    for r in at:
        each += [(r.node, r.component, g) for (sig, g), held in reach.items() if sig == r.sig and r.component != r.dominant and g != r.grp
                 and (r.dominant in held or r.grp > g) and (min(held) != r.component or max(held) != r.component)]
    found = J.cross_queries(rows, placed)
    got = [tuple(x) for x in found.collect()]
    assert len(got) == len(set(got)) and set(got) == set(each)

    def most(p):
        own = int(p.metrics().apply("numOutputRows").value()) if p.metrics().contains("numOutputRows") and "Join" in p.nodeName() else 0
        return max([own] + [most(p.children().apply(i)) for i in range(p.children().size())])

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        again = J.cross_queries(rows, placed)
        executed = again._jdf.queryExecution().executedPlan()
        executed.executeCollect()
        assert most(executed) * 3 < len(each)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
