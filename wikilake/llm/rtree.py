"""Hard-negative mining with an STR-packed R-tree over integer vectors.

Packing (sort, tile, recurse) happens twice. Over the table: the rows are cut at quantiles of
the dimension of largest variance, each slab again at quantiles of the next one, into at most
``TILES`` tiles; quantiles come from a bounded sample, every row is placed by them. A tile of more
than ``ROWS_PER_BLOCK`` rows is split by hash, so that a vector repeated by a third of all rows is
many blocks. Inside a block, a task packs its rows into leaves of ``LEAF`` rows and nodes of ``FANOUT`` boxes, bottom up.

Every node has its minimum bounding box. For an anchor q each coordinate of the box gives an
interval of products, and their sum an interval [low, high] that holds the score of every row
below. A priority queue opens the node with the largest high first. A node is pruned when for
all of the anchor's searches its interval misses the score window or its high is strictly below
the k-th score found (an equal score may still have the smaller id).

Two searches per anchor: its positives (no window, same label), then one per positive for its
negatives (window from the positive's score, other labels), all of an anchor's negative searches
in one walk. Each first runs in the anchor's own tile; the k-th scores found there are handed to
the other tiles, which are asked only where their box passes the same test.

Scores are exact integers. Vectors with components too large for 64-bit scores are worked on
as Python integers; scores returned are then cut to the 64-bit range.

Defined results: rows take no part with a null id or label, with a vector that is null, empty
or has null or non-finite components, or of another length than most. Repeated rows count
each, as positives and as negatives; of several rows with an anchor's id the smallest (vector,
label) is the anchor, none of them its positive or negative. Fewer than asked for: all. A
negative positive_score has an empty window; a window's ends belong to it.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import column, written
from .topk_threshold import scaled
from .vectors import best, matrix

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH, WHOLE = 30, 90, 100
LEAF = 256
FANOUT = 16
TILES = 1024
ROWS_PER_BLOCK = 8192
ANCHORS_PER_BLOCK = 1024
SAMPLE = 20_000
LEAST, MOST = -2**63, 2**63 - 1


def slabs(parts: int, left: int) -> int:
    """Into how many slabs a dimension is cut if ``parts`` tiles are wanted from ``left`` dimensions."""
    return max(1, round(parts ** (1 / left))) if left > 1 else parts


class Tiling:
    """Quantile cuts, one dimension after the other; ``place`` numbers the tiles."""

    def __init__(self, sample: np.ndarray, tiles: int, depth: int = 4) -> None:
        self.dims = np.argsort(-sample.astype(np.float64).var(axis=0), kind="stable")[:depth] if len(sample) else np.empty(0, int)
        self.count = 0
        self.root = self.cut(sample, 0, tiles)

    def cut(self, rows: np.ndarray, level: int, tiles: int):
        left = len(self.dims) - level
        n = slabs(tiles, left) if left else 1
        if n < 2 or len(rows) < n:
            if level < len(self.dims) and tiles > 1 and len(rows) >= 2:
                return self.cut(rows, level + 1, tiles)
            self.count += 1
            return self.count - 1
        x = rows[:, self.dims[level]]
        borders = np.unique(np.sort(x)[[len(x) * i // n for i in range(1, n)]])
        slab = np.searchsorted(borders, x, side="right")
        return self.dims[level], borders, [self.cut(rows[slab == s], level + 1, -(-tiles // n)) for s in range(len(borders) + 1)]

    def place(self, rows: np.ndarray) -> np.ndarray:
        out = np.empty(len(rows), dtype=np.int32)

        def go(node, at: np.ndarray) -> None:
            if isinstance(node, int):
                out[at] = node
                return
            dim, borders, below = node
            slab = np.searchsorted(borders, rows[at, dim], side="right")
            for s in np.unique(slab):
                go(below[s], at[slab == s])

        go(self.root, np.arange(len(rows)))
        return out


def spans(query: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the inner product with anything in each box [low, high]."""
    pos, neg = np.maximum(query, 0), np.minimum(query, 0)
    return low @ pos + high @ neg, high @ pos + low @ neg


def packed_order(v: np.ndarray, leaf: int) -> np.ndarray:
    """Positions in sort-tile-recursive order for leaves of ``leaf`` rows."""
    dims = np.argsort(-v.astype(np.float64).var(axis=0), kind="stable")

    def go(at: np.ndarray, level: int) -> list[np.ndarray]:
        pages = -(-len(at) // leaf)
        if pages <= 1 or level >= len(dims):
            return [at]
        at = at[np.argsort(v[at, dims[level]], kind="stable")]
        n = max(2, slabs(pages, min(3, len(dims)) - level)) if level < 2 else pages
        size = leaf * -(-pages // n)
        return [x for lo in range(0, len(at), size) for x in go(at[lo:lo + size], level + 1)]

    return np.concatenate(go(np.arange(len(v)), 0)) if len(v) else np.empty(0, dtype=np.int64)


def exact_numbers(y: np.ndarray) -> np.ndarray:
    """Integers as doubles where every inner product is exact in them (and fast)."""
    if y.dtype == object or not y.size or float(np.abs(y).max()) ** 2 * y.shape[1] >= 2.0**52:
        return y
    return y.astype(np.float64)


class RTree:
    """Rows in packed order, ``leaf`` to a leaf; boxes of the leaves and, level by level, of
    ``fanout`` consecutive boxes."""

    def __init__(self, v: np.ndarray, ids: np.ndarray, labels: np.ndarray, leaf: int = LEAF, fanout: int = FANOUT) -> None:
        order = packed_order(v, leaf)
        self.v, self.ids, self.labels, self.leaf, self.fanout = v[order], ids[order], labels[order], leaf, fanout
        self.levels = []
        low, high, step = self.v, self.v, leaf
        while True:
            starts = np.arange(0, len(low), step)
            low, high, step = np.minimum.reduceat(low, starts, axis=0), np.maximum.reduceat(high, starts, axis=0), fanout
            self.levels.append((low, high))
            if len(low) == 1:
                break
        self.opened = 0

    def bounds(self, queries: np.ndarray) -> list[tuple[list, list]]:
        """Per level the score intervals of every query (row) with every box."""
        return [tuple(x.T.tolist() for x in spans(queries.T, low, high)) for low, high in self.levels]

    def search(self, query: np.ndarray, own: int, label: int, same: bool, windows: list[tuple], k: int,
               bounds: list[tuple[list, list]] | None = None) -> list[tuple[list, list]]:
        """Per window (low, high, floor): ids and scores of the k best rows with low <= score
        <= high, ties to smaller ids; rows scoring under ``floor`` are not needed. ``bounds``:
        the query's own intervals per level."""
        if bounds is None:
            bounds = [(low[0], high[0]) for low, high in self.bounds(query[None])]
        best_of: list[list[tuple]] = [[] for _ in windows]  # (-score, id), ascending
        need = [max(w[0], w[2]) for w in windows]
        most = [w[1] for w in windows]
        top = len(self.levels) - 1
        queue = [(-bounds[top][1][0], bounds[top][0][0], top, 0)]
        while queue:
            minus_high, lowest, level, node = heapq.heappop(queue)
            least = min(need)
            if -minus_high < least:
                break
            if not any(-minus_high >= n and lowest <= m for n, m in zip(need, most)):
                continue
            self.opened += 1
            if level:
                low, high = bounds[level - 1]
                for child in range(node * self.fanout, min((node + 1) * self.fanout, len(high))):
                    if high[child] >= least:
                        heapq.heappush(queue, (-high[child], low[child], level - 1, child))
                continue
            at = slice(node * self.leaf, (node + 1) * self.leaf)
            scores = self.v[at] @ query
            fit = ((self.labels[at] == label) == same) & (scores >= least) & (self.ids[at] != own)
            rows = np.flatnonzero(fit)
            if not len(rows):
                continue
            scores, ids = scores[rows], self.ids[at][rows]
            for j in range(len(windows)):
                good = np.flatnonzero((scores >= need[j]) & (scores <= most[j]))
                if len(good):
                    good = good[best(scores[good], ids[good], k)]
                    both = sorted(best_of[j] + [(-int(scores[i]), int(ids[i])) for i in good])[:k]
                    best_of[j] = both
                    if len(both) == k:
                        need[j] = max(need[j], -both[-1][0])
        return [([b[1] for b in found], [-b[0] for b in found]) for found in best_of]


FOUND = "anchor bigint, slot int, ids array<bigint>, scores array<bigint>"
ASKED = "anchor bigint, q array<double>, label bigint, home int, lows array<bigint>, highs array<bigint>, floors array<bigint>"


def clipped(scores: list) -> list:
    return [min(max(int(s), LEAST), MOST) for s in scores]


def search_blocks(blocks: DataFrame, asked: DataFrame, cuts: DataFrame, same: bool, k: int, n_asked: int) -> DataFrame:
    """FOUND rows: the k best in each (tile, part) for each anchor routed to the tile."""
    n_q = max(1, -(-n_asked // ANCHORS_PER_BLOCK))
    every_q = F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("qb")
    left = blocks.select("tile", "part", "id", "label", "v", every_q)
    right = asked.join(F.broadcast(cuts), "tile").select(  # one row per tile
        "tile", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("part"), F.pmod(F.xxhash64("anchor"), F.lit(n_q)).cast("int").alias("qb"),
        "anchor", "q", F.col("label").alias("own_label"), "lows", "highs", "floors")

    def search(block: pa.Table, asking: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(block) and len(asking):
            n = len(block)
            both = exact_numbers(scaled(np.concatenate([matrix(block.column("v")), matrix(asking.column("q"))]), SCALE))
            tree = RTree(both[:n], block.column("id").to_numpy(), block.column("label").to_numpy())
            bounds = tree.bounds(both[n:])
            rest = zip(asking.column("anchor").to_pylist(), asking.column("own_label").to_pylist(),
                       *(asking.column(c).to_pylist() for c in ("lows", "highs", "floors")))
            for i, (anchor, label, lows, highs, floors) in enumerate(rest):
                for slot, (ids, scores) in enumerate(tree.search(
                        both[n + i], anchor, label, same, list(zip(lows, highs, floors)), k, [(low[i], high[i]) for low, high in bounds])):
                    if ids:
                        out.append((anchor, slot, ids, clipped(scores)))
        return pa.table([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int32()),
                         pa.array([r[2] for r in out], pa.list_(pa.int64())), pa.array([r[3] for r in out], pa.list_(pa.int64()))],
                        names=["anchor", "slot", "ids", "scores"])

    keys = ("tile", "part", "qb")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, FOUND)


def k_best(found: DataFrame, k: int) -> DataFrame:
    """anchor, slot, rank, id, score of the k best over all blocks; an anchor's rows are at
    most k per block that was asked."""
    flat = found.select("anchor", "slot", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select(
        "anchor", "slot", F.col("x.ids").alias("id"), F.col("x.scores").alias("score"))
    order = Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), "id")
    return flat.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k)


def mined(blocks: DataFrame, asked: DataFrame, cuts: DataFrame, boxes: tuple[np.ndarray, np.ndarray], same: bool, k: int, n_asked: int) -> DataFrame:
    """The k best per anchor and slot over all tiles (``asked``: ASKED rows): the anchor's own
    tile first, then every tile whose box can hold more."""
    home = written(search_blocks(blocks, asked.withColumn("tile", F.col("home")), cuts, same, k, n_asked))
    ranks = k_best(home, k).filter(F.col("rank") == k).groupBy("anchor").agg(
        F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("kth"))  # one entry per slot
    better = F.transform("floors", lambda f, j: F.greatest(f, F.coalesce(F.try_element_at("kth", j), F.lit(LEAST).cast("bigint"))))
    raised = asked.join(ranks, "anchor", "left").withColumn("floors", F.when(F.col("kth").isNull(), F.col("floors")).otherwise(better)).drop("kth")
    low, high = boxes

    @F.arrow_udf("array<int>")
    def route(q: pa.Array, home: pa.Array, lows: pa.Array, highs: pa.Array, floors: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(q), 256):
            asking = matrix(pa.chunked_array([q.slice(at, 256)]))
            y = exact_numbers(scaled(np.concatenate([asking, low / SCALE, high / SCALE]), SCALE))
            y_q, y_low, y_high = np.split(y, [len(asking), len(asking) + len(low)])
            for i in range(len(asking)):
                bottom, top = spans(y_q[i], y_low, y_high)
                wanted = np.zeros(len(low), dtype=bool)
                for ends in zip(lows[at + i].as_py(), highs[at + i].as_py(), floors[at + i].as_py()):
                    wanted |= (top >= max(ends[0], ends[2])) & (bottom <= ends[1])
                wanted[home[at + i].as_py()] = False
                out.append(np.flatnonzero(wanted))
        return pa.array(out, pa.list_(pa.int32()))

    others = raised.withColumn("tile", F.explode(route("q", "home", "lows", "highs", "floors")))
    return k_best(home.unionByName(search_blocks(blocks, written(others), cuts, same, k, n_asked)), k)


def labelled_vectors(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, relabel) -> DataFrame:
    """(id, label, v) of the rows that take part; label after ``relabel(id, label)``."""
    keyed = vectors.select(column(vectors, id_col).cast("bigint").alias("id"), column(vectors, label_col).cast("bigint").alias("label"),
                           column(vectors, vec_col).cast("array<double>").alias("v")).filter(
        "id IS NOT NULL AND label IS NOT NULL AND size(v) > 0").filter(
        ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x * SCALE) == float("inf"))))
    common = keyed.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), "d").first()
    label = relabel(F.col("id"), F.col("label")) if relabel else F.col("label")
    return keyed.filter(F.size("v") == (common["d"] if common else 0)).select("id", label.cast("bigint").alias("label"), "v")


def tile_boxes(placed: DataFrame, n_tiles: int) -> tuple[np.ndarray, np.ndarray]:
    """Minimum bounding boxes of the tiles, in scaled components; one row per tile and
    dimension comes to the driver, at most ``TILES`` times the dimensions."""
    def boxes(batches):
        for batch in batches:
            if len(batch):
                v, tile = np.floor(SCALE * matrix(pa.chunked_array([batch.column("v")]))), batch.column("tile").to_numpy()
                order = np.argsort(tile, kind="stable")
                found, starts = np.unique(tile[order], return_index=True)
                low, high = (f.reduceat(v[order], starts, axis=0) for f in (np.minimum, np.maximum))
                d = v.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(found, d), pa.int32()), pa.array(np.tile(np.arange(d, dtype=np.int32), len(found))),
                                                  pa.array(low.ravel()), pa.array(high.ravel())], ["tile", "dim", "low", "high"])

    found = placed.select("tile", "v").mapInArrow(boxes, "tile int, dim int, low double, high double").groupBy("tile", "dim").agg(
        F.min("low").alias("low"), F.max("high").alias("high")).toArrow()
    tile, dim = found.column("tile").to_numpy(), found.column("dim").to_numpy()
    low, high = (np.zeros((n_tiles, dim.max() + 1)) for _ in range(2))
    low[tile, dim], high[tile, dim] = found.column("low").to_numpy(), found.column("high").to_numpy()
    return low, high


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, id_col: str = "vec_id",
                   vec_col: str = "embedding", label_col: str = "label", relabel=None, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank
    for the anchors, whose ids are divisible by ``every``."""
    spark = vectors.sparkSession
    rows = written(labelled_vectors(vectors, id_col, vec_col, label_col, relabel))
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, "
                                         "negative_score bigint, positive_rank int")
    sample = rows.select("v", F.xxhash64("id", "v").alias("h")).orderBy("h", "v").limit(SAMPLE).toArrow()
    tiling = Tiling(matrix(sample.column("v")), min(TILES, -(-n // rows_per_block)))

    @F.arrow_udf("int")
    def tile_of(v: pa.Array) -> pa.Array:
        return pa.array(tiling.place(matrix(pa.chunked_array([v]))) if len(v) else [], pa.int32())

    placed = written(rows.withColumn("tile", tile_of("v")).withColumn("at", F.monotonically_increasing_id()))
    cuts = written(placed.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / rows_per_block).cast("int").alias("cuts")))  # one row per tile
    blocks = placed.join(F.broadcast(cuts), "tile").withColumn("part", F.pmod(F.xxhash64("at"), F.col("cuts")).cast("int"))
    boxes = tile_boxes(placed, tiling.count)

    least, most = F.array(F.lit(LEAST).cast("bigint")), F.array(F.lit(MOST).cast("bigint"))
    anchors = written(placed.filter(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("v", "label", "tile")).alias("x")).select(
        F.col("id").alias("anchor"), F.col("x.v").alias("q"), F.col("x.label").alias("label"), F.col("x.tile").alias("home")))
    n_asked = anchors.count()
    first = anchors.select("*", least.alias("lows"), most.alias("highs"), least.alias("floors"))
    found = written(mined(blocks, first, cuts, boxes, True, positives, n_asked).select(
        "anchor", F.col("rank").alias("positive_rank"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))

    exact = F.col("positive_score").cast("decimal(20,0)")
    low, high = F.ceil(exact * LOW / WHOLE).cast("bigint"), F.floor(exact * HIGH / WHOLE).cast("bigint")
    windows = found.withColumn("low", low).withColumn("high", high).filter("low <= high")
    slots = F.array_sort(F.collect_list(F.struct("positive_rank", "positive_id", "positive_score", "low", "high")))  # at most ``positives``
    pairs = written(windows.groupBy("anchor").agg(slots.alias("slots")))
    lows, highs = F.transform("slots", lambda s: s["low"]), F.transform("slots", lambda s: s["high"])
    second = anchors.join(pairs, "anchor").select(*anchors.columns, lows.alias("lows"), highs.alias("highs"), lows.alias("floors"))
    hard = mined(blocks, second, cuts, boxes, False, negatives, n_asked)
    slot = pairs.select("anchor", F.posexplode("slots").alias("slot", "s"))
    return hard.join(slot, ["anchor", "slot"]).select(
        F.col("anchor").alias("anchor_id"), F.col("s.positive_id").alias("positive_id"), "rank", F.col("id").alias("negative_id"),
        F.col("s.positive_score").alias("positive_score"), F.col("score").alias("negative_score"), F.col("s.positive_rank").alias("positive_rank"))
