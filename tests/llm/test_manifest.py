"""Merkle manifest against a plain recursive hash of the same rows."""

import hashlib
import random

from pyspark.sql import functions as F

from wikilake.llm.merkle import ARITY, folded, manifest, proof_digest

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def climb(nodes):
    """(root, proof of each node) of a list of digests."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i:i + ARITY] for i in range(0, len(nodes), ARITY)]
        for i, k in enumerate(at):
            run = runs[k // ARITY]
            proofs[i].append(("".join(run[:k % ARITY]), "".join(run[k % ARITY + 1:])))
        at = [k // ARITY for k in at]
        nodes = [h(*run) for run in runs]
    return nodes[0], proofs


def expected(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf_of(row)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[2] for x in sorted(groups[s])]) for s in order}
    root, upper = climb([trees[s][0] for s in order])
    out = []
    for s, above in zip(order, upper):
        for (known, key, leaf), proof in zip(sorted(groups[s]), trees[s][1]):
            out.append((key if known else None, leaf, trees[s][0], root, h(*(a + b for a, b in proof + above))))
    return sorted(out, key=repr)


def found(docs):
    m = manifest(docs)
    rows = m.select("doc_id", "merkle.leaf", "merkle.subroot", "merkle.root", proof_digest(F.col("merkle.proof")).alias("proof"),
                    folded(F.col("merkle.leaf"), F.col("merkle.proof")).alias("again")).collect()
    assert all(r.again == r.root for r in rows)
    return sorted((tuple(r)[:5] for r in rows), key=repr)


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def test_manifest_is_the_recursive_hash(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, "", "a", "ä", "a/0/1", "z"] + ["hot"] * 6), rng.choice([None, "en"]), i % 7 or None,
             rng.choice([None, "", "Text é \U0001f600", f"TEXT {i}"])) for i in rng.sample(range(-500, 9000), 700)]
    rows += [(9999, "one", "en", 1, "alone"), (None, "a", None, None, None), (None, "a", None, None, None), rows[0], rows[0]]
    rows += [(20000 + i, f"s{i:03}", "en", 1, "x") for i in range(40)]  # more than one run of subroots
    assert found(table(spark, rows)) == expected(rows)


def test_small_and_empty_tables(spark):
    for n in (1, 2, 16, 17, 257):
        rows = [(i, "s", "en", 1, "x" * i) for i in range(n)]
        assert found(table(spark, rows)) == expected(rows)
    one = [(1, None, None, None, None)]
    assert found(table(spark, one)) == [(1, leaf_of(one[0]), leaf_of(one[0]), leaf_of(one[0]), h(""))]
    empty = manifest(spark.createDataFrame([], SCHEMA))
    assert empty.columns == ["doc_id", "merkle"] and empty.count() == 0


def test_any_change_breaks_its_own_proof_only(spark):
    rows = [(i, f"s{i % 3}", "en", 1, f"text {i}") for i in range(100)]
    docs = table(spark, rows).select("*", *[F.lit("own").alias(c) for c in ("key", "digest", "tree", "pos", "members", "seg", "merkle", "at")])
    altered = F.when(F.col("doc_id") == 42, F.sha2(F.lit("other"), 256))
    m = manifest(docs, carry={"altered": altered})
    ok = m.select("doc_id", (folded(F.coalesce("altered", "merkle.leaf"), F.col("merkle.proof")) == F.col("merkle.root")).alias("ok")).collect()
    assert [r.doc_id for r in ok if not r.ok] == [42] and len(ok) == 100
