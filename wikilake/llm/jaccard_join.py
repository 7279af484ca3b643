"""N-gram Jaccard join through a token-group matrix.

A document's tokens are the hashes (64 bits) of its distinct word shingles. Documents with
equal token sets are one node. Two nodes link when the Jaccard similarity of their sets is
at least ``percent`` / 100; the result is the components of the links.

1. Reach. Linked sets of sizes q <= s differ in at most q / 9 tokens (at 90 %), so if the
   token space is cut into more parts than that, a part is the same in both. A node writes
   one signature per part for the size class it is in and for the class below, which its
   smaller partners use. Nodes that share no signature have no links and go no further.
2. Groups. The others are partitioned by the signature that they share with most nodes
   (so a family of near copies stays together) into groups of about ``GROUP`` nodes; a
   large partition is cut by hash.
3. Rounds. Nodes are linked inside their group. A signature whose nodes are all in one
   component is closed, as no link at it could say more. The nodes of open signatures are
   dealt into new groups by another hash, at the signature with most nodes outside its
   largest component, and linked again, as long as that halves the questions left between
   groups: a family of near copies is one component after two or three rounds, and each
   costs as many rows as there are open nodes.
4. Matrix. A group's row is the union of its nodes' tokens. At each signature still open,
   the nodes outside its largest component are queries to the other groups that hold it,
   found by pairs of groups and made once, however many signatures a node shares with a group;
   the overlap of a query with the group's row bounds its overlap with every member, and
   only groups whose bound reaches the needed overlap are opened, member by member. Two
   nodes outside the largest component are asked in one direction.
5. A task joins the components of linked nodes by union-find and returns each with its
   local root; the components of these rows give the classes.

Scale: signatures are a fifth of the tokens; token sets travel only for nodes that share
one. Groups and blocks of queries are bounded in nodes, a hot group of copies is one node,
a hot group of near copies is many groups that rounds make one component. Many nodes that
share a signature and do not link are still asked pair of groups by pair of groups. No
similarity is estimated and no pair is capped: the parts argument loses nothing, and the
rounds only leave out pairs that are in one component already. Part classes that are empty are counted in the
number of parts; a node with more empty parts than that allows writes their signatures too.

Defined results: null text, or text without words, has no shingles and links with nothing;
fewer words than a shingle are one token, the whole sequence; repeated rows are copies;
rows with a null doc_id take part, and a component's id is its smallest doc_id that is
not null; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import MEMOS, column, free_name, pieces, written
from .components import connected_components

WORDS = 3
PERCENT = 90
GROUP = 256
QUERIES_PER_BLOCK = 256
MEMO = 1 << 17

SHAPE = "struct<n:bigint,digest:binary,sigs:array<bigint>>"
_memo: dict[bytes, int] = {}
MEMOS.append(_memo.clear)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_numbers(words: list[bytes]) -> np.ndarray:
    if len(_memo) > MEMO:
        _memo.clear()
    get, out = _memo.get, []
    for w in words:
        h = get(w)
        if h is None:
            h = _memo[w] = xxhash.xxh3_64_intdigest(w)
        out.append(h)
    return np.array(out, dtype=np.uint64)


def token_set(text: str, n: int = WORDS) -> np.ndarray:
    """Sorted distinct tokens of a text."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z are lowered, only ASCII blanks split
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = word_numbers(words)
    width = min(n, len(words))
    token = np.full(len(h) - width + 1, width, dtype=np.uint64)
    for i in range(width):
        token = mixed(token * np.uint64(0x9E3779B97F4A7C15) + h[i:len(h) - width + 1 + i])
    return np.unique(token)


@lru_cache(maxsize=8)
def class_ends(percent: int = PERCENT) -> np.ndarray:
    """Largest sizes of the size classes: the partners of a set that are not smaller are
    in its class or in the next."""
    ends, low = [], 1
    while low < 1 << 40:
        ends.append(low * 100 // percent)
        low = ends[-1] + 1
    return np.array(ends)


def part_signatures(tokens: np.ndarray, size_class: int, percent: int = PERCENT) -> np.ndarray:
    most = int(class_ends(percent)[size_class])
    differ = most * (100 - percent) // percent
    if not differ:
        return np.empty(0, dtype=np.uint64)  # only equal sets link
    spare = 1 if most < 50 else 2
    parts = differ + 1 + spare
    which = ((tokens >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)  # ascends with the tokens
    first = np.searchsorted(which, np.arange(parts + 1, dtype=np.uint64))
    full = np.flatnonzero(np.diff(first))
    content = np.add.reduceat(mixed(tokens ^ np.uint64(0x5851F42D4C957F2D)), first[full])
    salt = mixed(np.array(full, dtype=np.uint64) + np.uint64(size_class << 32))
    sigs = mixed(content ^ salt)
    if parts - len(full) > spare:
        empty = np.setdiff1d(np.arange(parts), full).astype(np.uint64)
        sigs = np.concatenate([sigs, mixed(~mixed(empty + np.uint64(size_class << 32)))])
    return sigs


def shape_of(text: str | None, words: int = WORDS, percent: int = PERCENT) -> dict:
    tokens = token_set(text or "", words)
    if not len(tokens):
        return {"n": 0, "digest": None, "sigs": []}
    c = int(np.searchsorted(class_ends(percent), len(tokens)))
    sigs = np.concatenate([part_signatures(tokens, k, percent) for k in (c - 1, c) if k >= 0])
    return {"n": len(tokens), "digest": hashlib.blake2b(tokens.tobytes(), digest_size=16).digest(), "sigs": sigs.view(np.int64)}


def links(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    if percent * max(len(a), len(b)) > 100 * min(len(a), len(b)):
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


class Groups:
    """Union-find over the nodes of one task."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)


Sets = list[tuple[int, np.ndarray]]  # (component, tokens)


def ask_group(members: Sets, queries: Sets, inside: bool, percent: int = PERCENT) -> list[tuple[int, int]]:
    """(component, root) of the components that links join. ``inside``: the members are
    asked about each other too."""
    union = np.unique(np.concatenate([t for _, t in members]))  # the group's row of the matrix
    found = Groups()
    for mine, tokens in queries:
        at = np.searchsorted(union, tokens)
        at[at == len(union)] = 0
        if 100 * int((union[at] == tokens).sum()) < percent * len(tokens):
            continue  # no member can reach the needed overlap
        for other, theirs in members:
            if found.root(mine) != found.root(other) and links(tokens, theirs, percent):
                found.join(mine, other)
    if inside:
        for i, (mine, tokens) in enumerate(members):
            for other, theirs in members[:i]:
                if found.root(mine) != found.root(other) and links(tokens, theirs, percent):
                    found.join(mine, other)
    return [(x, found.root(x)) for x in list(found.up) if found.root(x) != x]


def sets_of(table: pa.Table, component: str, tokens: str) -> Sets:
    return [(n, np.frombuffer(b, dtype=np.uint64)) for n, b in zip(table.column(component).to_pylist(), table.column(tokens).to_pylist())]


def edge_table(found: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})


def placed_nodes(rows: DataFrame, salt: int) -> DataFrame:
    """(node, grp): the nodes of ``rows`` (sig, node, c) in groups of about ``GROUP`` by
    the signature of the largest c; ``salt`` deals a large one anew."""
    home = rows.groupBy("node").agg(F.max(F.struct("c", "sig"))["sig"].alias("home"))
    sizes = home.groupBy("home").agg(F.count("*").alias("c"))
    cut = F.pmod(F.xxhash64("node", F.lit(salt)), F.ceil(F.col("c") / GROUP).cast("bigint"))
    return home.join(sizes, "home").select("node", F.xxhash64("home", cut).alias("grp"))


def open_rows(shared: DataFrame, comps: DataFrame) -> DataFrame:
    """(sig, node, component, dominant, n, most) at the signatures whose nodes are in more
    than one component: the largest one, the number of nodes and how many are in it."""
    rows = shared.select("sig", "node").join(comps, "node")
    sizes = rows.groupBy("sig", "component").agg(F.count("*").alias("c"))
    sigs = sizes.groupBy("sig").agg(
        F.max_by("component", F.struct("c", "component")).alias("dominant"), F.sum("c").alias("n"), F.max("c").alias("most"))
    return rows.join(sigs.filter("most < n"), "sig")


def cross_queries(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """(node, component, grp): which node of ``rows`` (see ``open_rows``) asks which group.

    Which group asks which at which signatures is found first, with a row per signature and
    pair of groups; of these, a node outside a largest component asks the groups that its own
    group asks at a signature of the node. A family shares many signatures, and a row per
    signature, node and group would repeat each question at every one of them."""
    at = rows.join(placed, "node")
    reach = at.groupBy("sig", F.col("grp").alias("asked")).agg(
        F.max(F.col("component") == F.col("dominant")).alias("dominant_there"), F.min("component").alias("low"), F.max("component").alias("high"))
    outside = at.filter("component <> dominant")
    asking = outside.groupBy("sig", "grp").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    pairs = asking.join(reach, "sig").filter(
        "grp <> asked and (dominant_there or grp > asked) and (least <> most or low <> high or low <> least)").groupBy("grp", "asked").agg(
        F.collect_set("sig").alias("sigs"), F.min("low").alias("low"), F.max("high").alias("high"))  # at most the signatures of a group
    nodes = outside.groupBy("node", "component", "grp").agg(F.collect_set("sig").alias("own"))
    return nodes.join(pairs, (nodes["grp"] == pairs["grp"]) & F.arrays_overlap("own", "sigs") & (
        (F.col("low") != F.col("component")) | (F.col("high") != F.col("component")))).select("node", "component", F.col("asked").alias("grp"))


def merged(comps: DataFrame, edges: DataFrame) -> DataFrame:
    """``comps`` (node, component) after the components that ``edges`` (a, b) join."""
    joined = connected_components(edges).select(F.col("node").alias("component"), F.col("component").alias("now"))
    return written(comps.join(joined, "component", "left").select("node", F.coalesce("now", "component").alias("component")))


def linked_components(shapes: DataFrame, texts: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(node, component) of the nodes that share a signature. ``shapes``: one row per node
    (node, digest, sigs, id, h); ``texts``: (id, h, text) that holds every node."""
    sigs = shapes.select("node", F.explode("sigs").alias("sig"))
    by_sig = Window.partitionBy("sig")
    shared = written(sigs.withColumn("first", F.min("node").over(by_sig)).withColumn("last", F.max("node").over(by_sig))
                     .withColumn("c", F.count("*").over(by_sig)).filter("first < last").select("sig", "node", "c"))
    placed = written(placed_nodes(shared, 0))
    nodes = shapes.select("node", "digest", "id", "h").join(placed, "node")

    @F.arrow_udf("struct<digest:binary,tokens:binary>")
    def tokens_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in pieces(batches):
            sets = [token_set(t.as_py() or "", words).tobytes() for t in batch]
            yield pa.StructArray.from_arrays([
                pa.array([hashlib.blake2b(s, digest_size=16).digest() for s in sets], pa.binary()), pa.array(sets, pa.binary())],
                ["digest", "tokens"])

    held = written(
        texts.alias("t").join(nodes.alias("n"), F.col("t.id").eqNullSafe(F.col("n.id")) & (F.col("t.h") == F.col("n.h")))
        .select("node", "grp", "digest", tokens_of("t.text").alias("x")).filter("x.digest = digest")
        .select("node", "grp", F.col("x.tokens").alias("tokens")).dropDuplicates(["node"]))

    def ask_inside(group: pa.Table) -> pa.Table:
        return edge_table(ask_group(sets_of(group, "component", "tokens"), [], True, percent))

    def ask(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        if not len(mine):
            return edge_table([])
        inside = mine.column("block")[0].as_py() == 0
        return edge_table(ask_group(sets_of(mine, "component", "tokens"), sets_of(theirs, "qc", "qt"), inside, percent))

    # groups of the first round hold each node once, so its edges are components already
    first = held.select("grp", F.col("node").alias("component"), "tokens").groupBy("grp").applyInArrow(ask_inside, "a bigint, b bigint")
    comps = written(placed.select("node").join(first, F.col("node") == F.col("a"), "left").select("node", F.coalesce("b", "node").alias("component")))

    before, salt = None, 0
    while True:
        rows = written(open_rows(shared, comps))
        n_open, asks = rows.select(F.count("*"), F.sum(F.when(F.col("component") != F.col("dominant"), F.ceil(F.col("n") / GROUP)))).first()
        if not n_open:
            return comps
        salt += 1
        placed = written(placed_nodes(rows.select("sig", "node", (F.col("n") - F.col("most")).alias("c")), salt))
        members = held.drop("grp").join(placed, "node").join(comps, "node")
        if asks <= n_open or (before is not None and 2 * asks > before):
            break
        before = asks
        comps = merged(comps, members.select("grp", "component", "tokens").groupBy("grp").applyInArrow(ask_inside, "a bigint, b bigint"))

    queries = written(cross_queries(rows, placed))
    per_group = queries.groupBy("grp").agg(F.ceil(F.count("*") / QUERIES_PER_BLOCK).cast("int").alias("blocks"))
    asked = members.join(per_group, "grp", "left").select(
        "grp", "component", "tokens", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1)).alias("block"))
    asking = queries.join(per_group, "grp").join(held.select("node", "tokens"), "node").select(
        F.col("grp").alias("g"), F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("b"),
        F.col("component").alias("qc"), F.col("tokens").alias("qt"))
    return merged(comps, asked.groupBy("grp", "block").cogroup(asking.groupBy("g", "b")).applyInArrow(ask, "a bigint, b bigint"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "near",
                       words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with a struct ``out``: n_shingles, component_id and component (the number
    of the class; null without shingles). ``words``: words of a shingle; ``percent``: the
    similarity of a link."""
    out = free_name(docs, out)

    @F.arrow_udf(SHAPE)
    def shapes_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in pieces(batches):
            rows = [shape_of(t.as_py(), words, percent) for t in batch]
            yield pa.StructArray.from_arrays([
                pa.array([r["n"] for r in rows], pa.int64()), pa.array([r["digest"] for r in rows], pa.binary()),
                pa.array([r["sigs"] for r in rows], pa.list_(pa.int64()))],
                ["n", "digest", "sigs"])

    text = column(docs, text_col).cast("string")
    rows = docs.select(column(docs, id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    shaped = written(rows.select("id", "h", shapes_of("text").alias("s")).select("id", "h", "s.*"))
    nodes = shaped.filter("n > 0").groupBy("digest").agg(
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "h"))).alias("named"), F.min("h").alias("any"),
        F.first("sigs").alias("sigs"))
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("node"), "digest", "sigs", F.col("named.id").alias("id"),
                                 F.coalesce(F.col("named.h"), F.col("any")).alias("h")))
    found = linked_components(nodes, rows, words, percent)
    named = nodes.select("node", "digest", "id").join(found, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    ids = named.groupBy("component").agg(F.min("id").alias("component_id"))
    classes = written(named.join(ids, "component").select("digest", "component", "component_id"))

    kept = [f"c{i}" for i in range(len(docs.columns))]
    work = docs.select(*[column(docs, c).alias(k) for c, k in zip(docs.columns, kept)],
                       column(docs, id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("h"))
    # rows meet their class by (id, text hash), both of which stand in the written shapes
    keys = shaped.select("id", "h", "n", "digest").distinct().join(classes, "digest", "left").select(
        F.col("id").alias("kid"), F.col("h").alias("kh"), "n", "component", "component_id")
    work = work.join(keys, F.col("id").eqNullSafe(F.col("kid")) & (F.col("h") == F.col("kh")), "left")
    return work.select(*[F.col(k).alias(c) for c, k in zip(docs.columns, kept)], F.struct(
        F.coalesce("n", F.lit(0)).alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        F.when(F.col("n") > 0, F.col("component")).alias("component")).alias(out))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each component, the one with the smallest doc_id, and every row without
    shingles; columns as given."""
    out = free_name(docs, "near")
    found = jaccard_components(docs, id_col, text_col, out, words, percent)
    part, rank = F.col(out).getField("component"), free_name(found, "rank")
    order = Window.partitionBy(part).orderBy(column(docs, id_col).asc_nulls_last(), F.xxhash64(column(docs, text_col)))
    first = found.filter(part.isNotNull()).withColumn(rank, F.row_number().over(order)).filter(F.col(rank) == 1).drop(rank)
    return first.unionByName(found.filter(part.isNull())).drop(out)
