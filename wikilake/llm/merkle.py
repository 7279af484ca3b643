"""Merkle dataset manifest: one root for a table, one proof per row, by pointer jumping.

Every row is a leaf, H of its chosen fields (H: lowercase hex sha256 of the joined inputs). The
leaves of a group (source) ascend by id and are hashed in runs of ``ARITY`` until one node,
the group's subroot, remains; the subroots ascend by group and are hashed likewise to the root.

Numbering needs no window over a group: rows are dealt by ranges of (group, id), numbered
inside their range, and each range gets the count of the ranges before it. Levels are then
plain aggregates of at most ``ARITY`` digests by (group, position div ``ARITY``).

Proofs come by pointer jumping. The nodes that jump are runs (the members of a run share all
their ancestors), each with a pointer to an ancestor and the sibling segments on the way
there. A self-join by pointer doubles the distance and concatenates the segments until every
run of leaves points at the root; last, each leaf puts its own run's siblings in front. An
ancestor 2^k levels up is one of few: only nodes of that height are joined, and Spark
broadcasts them where their size allows.

Defined results: a null field counts as ``-``, unlike an empty one; null groups and null ids
come first; rows of equal id ascend by digest (exact copies of a row are leaves of their own,
in any order); an empty table has no root and no proofs; a table of one row has its leaf as
root and an empty proof. Columns besides the fields and ``carry`` are not read, so none clash.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import column, shuffle_width, written

ARITY = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ROWS_PER_RANGE = 500_000
#: One step of a proof: the digests before and after the path's node in its run, end to end.
HOP = "struct<left:binary,right:binary>"


def leaf_digest(values: Sequence[Column]) -> Column:
    """H over the values: ``-`` for null, else UTF-8 byte count, colon, value."""
    def field(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(field, values)), 256)


def as_hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def joined(digests: Column) -> Column:
    """An array of binary digests, end to end (empty for none)."""
    return F.aggregate(digests, F.lit(b""), lambda acc, x: F.concat(acc, x))


def numbered(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``pos`` (0, 1, ... inside the group, by ``order``) and ``n`` (its rows).

    Ranges of (group, order) are numbered as they are read; the numbers before a range come
    from one row per (range, group), so a group may hold any share of the rows.
    """
    spark = rows.sparkSession
    width = shuffle_width(spark, rows.count(), ROWS_PER_RANGE)
    by = [F.col(c).asc_nulls_first() for c in group + order]
    dealt = written(rows.repartitionByRange(width, *by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()))
    in_range = F.shiftright("at", 33).alias("part")
    counts = dealt.groupBy(*group, in_range).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    all_of = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))  # one row per range
    before = all_of.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = written(counts.select(*[F.col(c).alias(f"_{c}") for c in group], F.col("part").alias("_part"),
                           (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"),
                           F.sum("rows").over(all_of).alias("n")))
    same = F.col("_part") == F.shiftright("at", 33)
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return dealt.join(ranges, same).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "shift", "_part", *[f"_{c}" for c in group])


def runs_of(nodes: DataFrame, level: int, payload: list[str]) -> DataFrame:
    """One row per run of ``ARITY`` nodes (tree, pos, n, digest, above, payload): its members
    in order, the digest they make (a node alone in its tree keeps its own), id and height."""
    rows = nodes.groupBy("tree", F.floor(F.col("pos") / ARITY).cast("bigint").alias("run")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "digest", "above", *payload))).alias("members"),  # at most ARITY
        F.max("n").alias("of"), F.max("above").alias("height"))
    made = F.when(F.col("of") == 1, F.col("members")[0]["digest"]).otherwise(
        F.unhex(F.sha2(as_hex(joined(F.transform("members", lambda m: m["digest"]))), 256)))
    return rows.select("tree", "run", "members", "height", "of", F.ceil(F.col("of") / ARITY).cast("bigint").alias("n"),
                       made.alias("digest"), F.concat("tree", F.lit(f"/{level}/"), F.col("run").cast("string")).alias("id"))


def climbed(nodes: DataFrame, payload: list[str]) -> list[DataFrame]:
    """The runs of every level of the trees, lowest first; a tree is in as many as it needs."""
    levels = []
    while True:
        made = written(runs_of(nodes, len(levels), payload))
        levels.append(made)
        if made.agg(F.max("n")).first()[0] == 1:
            return levels
        payload = ["child"]
        nodes = made.filter("n > 1").select("tree", F.col("run").alias("pos"), "n", "digest",
                                            F.col("id").alias("child"), (F.col("height") + 1).alias("above"))


def hop(digests: Column, k: Column) -> Column:
    """The siblings of the k-th (from 0) of a run's digests."""
    return F.struct(joined(F.slice(digests, F.lit(1), k)).alias("left"),
                    joined(F.slice(digests, k + 2, F.lit(ARITY))).alias("right"))


def one_hop(runs: DataFrame, enters_top: bool) -> DataFrame:
    """A pointer (id, height, anc, seg, subroot) from each child of a run to that run. A
    child that enters the top tree is its group's subroot; others learn theirs by jumping."""
    digests = F.transform("members", lambda m: m["digest"])
    each = runs.select(F.col("id").alias("anc"), digests.alias("digests"), F.posexplode("members").alias("k", "m"))
    return each.select(F.col("m.child").alias("id"), (F.col("m.above") - 1).alias("height"), "anc",
                       F.array(hop(F.col("digests"), F.col("k"))).alias("seg"),
                       (F.col("m.digest") if enters_top else F.lit(None).cast("binary")).alias("subroot"))


def jumped(pointers: DataFrame, height: int) -> DataFrame:
    """The pointers of height 0 after jumping to the root, which is ``height`` hops up."""
    distance = 1
    while distance < height:
        far = pointers.filter(F.col("height") >= distance).select(
            F.col("id").alias("anc"), F.col("anc").alias("next"), F.col("seg").alias("more"), F.col("subroot").alias("above"))
        distance *= 2
        pointers = written(pointers.filter((F.col("height") == 0) | (F.col("height") >= distance)).join(far, "anc", "left").select(
            "id", "height", F.coalesce("next", "anc").alias("anc"),
            F.when(F.col("more").isNull(), F.col("seg")).otherwise(F.concat("seg", "more")).alias("seg"),
            F.coalesce("subroot", "above").alias("subroot")))
    return pointers.filter("height = 0")


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", group_col: str = "source",
             carry: dict[str, Column] | None = None) -> DataFrame:
    """Per row: ``id_col``, the columns of ``carry`` (name to expression over ``docs``) and
    ``merkle``: struct of leaf, subroot, root (hex) and proof (the hops from leaf to root)."""
    carry = carry or {}
    payload = ["key", *[f"c{i}" for i in range(len(carry))]]
    leaves = written(docs.select(
        column(docs, id_col).alias("key"), column(docs, group_col).cast("string").alias("grp"),
        F.unhex(leaf_digest([column(docs, f) for f in fields])).alias("digest"),
        *[value.alias(c) for value, c in zip(carry.values(), payload[1:])]))
    empty = leaves.isEmpty()
    # "n" sorts before any "s...": null groups first, the others by their bytes
    tree = F.coalesce(F.concat(F.lit("s"), "grp"), F.lit("n")).alias("tree")
    placed = numbered(leaves, ["grp"], ["key", "digest"]).select(tree, "pos", "n", "digest", F.lit(0).alias("above"), *payload)
    lower = climbed(placed, payload) if not empty else [runs_of(placed, 0, payload)]
    steps = [one_hop(runs, False) for runs in lower[1:]]

    subroots = reduce(DataFrame.unionByName, [runs.filter("n = 1").select("tree", "digest", "height", F.col("id").alias("child")) for runs in lower])
    entering = numbered(written(subroots), [], ["tree"])
    if entering.limit(2).count() > 1:
        upper = climbed(entering.select(F.lit("t").alias("tree"), "pos", "n", "digest", (F.col("height") + 1).alias("above"), "child"), ["child"])
        steps += [one_hop(runs, level == 0) for level, runs in enumerate(upper)]
        top = upper[-1].select("digest", "height").first()  # one row, as is the subroot of an only group
    else:
        top = entering.select("digest", "height").first()
    root, height = (F.lit(bytes(top["digest"])), top["height"]) if top else (F.lit(None).cast("binary"), 0)

    digests = F.transform("members", lambda m: m["digest"]).alias("digests")
    paths = lower[0].select("id", "of", "members", digests)
    if steps:
        known = jumped(written(reduce(DataFrame.unionByName, steps)), height).select("id", "seg", "subroot")
        paths = paths.join(known, "id", "left")
    else:
        paths = paths.select("*", F.lit(None).cast(f"array<{HOP}>").alias("seg"), F.lit(None).cast("binary").alias("subroot"))
    each = paths.select("of", "digests", F.coalesce("seg", F.array().cast(f"array<{HOP}>")).alias("seg"),
                        F.coalesce("subroot", root).alias("subroot"), F.posexplode("members").alias("k", "m"))
    # a leaf alone in its group is the subroot itself: no run to be hashed in
    proof = F.when(F.col("of") == 1, F.col("seg")).otherwise(F.concat(F.array(hop(F.col("digests"), F.col("k"))), "seg"))
    return each.select(F.col("m.key").alias(id_col), *[F.col(f"m.{c}").alias(name) for name, c in zip(carry, payload[1:])],
                       F.struct(as_hex("m.digest").alias("leaf"), as_hex("subroot").alias("subroot"), as_hex(root).alias("root"),
                                proof.alias("proof")).alias("merkle"))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that ``proof`` makes of a leaf digest (hex)."""
    return F.aggregate(proof, leaf, lambda acc, step: F.sha2(F.concat(as_hex(step["left"]), acc, as_hex(step["right"])), 256))


def proof_digest(proof: Column) -> Column:
    """H of all sibling digests of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: F.concat(as_hex(step["left"]), as_hex(step["right"]))), ""), 256)
