"""Ordered line comparison of two texts per row (R6), by patience alignment.

Both texts are cut into lines. Rounds flag lines as matched: in every open segment first the
common lines at its start and at its end, then, of the lines that occur once on each side, a
longest increasing subsequence. The t-th matched line of one side stands for the t-th of the
other, so the number of matched lines before a line names its segment on either side, and the
next round works between the new anchors. A round without a new match is the last. What is never
matched forms the hunks, and the hunks turn the old text into the new one exactly.

A text pair is a row of the input; its lines stay together in one partition (all windows
and groups start with the pair), and pairs are spread over the partitions. Only the longest
increasing subsequence of a segment's anchors is computed in an Arrow function.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import library_on_workers, partitions_for, staged

PAIR = "_pair"
OLD, NEW = 0, 1


def longest_increasing(values: list[int]) -> list[int]:
    """Positions of a longest strictly increasing subsequence."""
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        back.append(at[k - 1] if k else -1)
        if k == len(tails):
            tails.append(v)
            at.append(i)
        else:
            tails[k], at[k] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def increasing(lists: Column) -> Column:
    """``longest_increasing`` of a column of lists."""
    @F.arrow_udf("array<int>")
    def positions(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([longest_increasing(x.as_py()) for x in batch], pa.list_(pa.int32()))

    return positions(lists)


def text_lines(pairs: DataFrame, key: list[str], old: str, new: str) -> DataFrame:
    """(pair, side, i, line): the lines of both texts; a null text has none."""
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(c).alias("text")) for s, c in ((OLD, old), (NEW, new))])
    each = pairs.select(F.struct(*key).alias(PAIR), F.explode(sides).alias("s"))
    return each.select(PAIR, F.col("s.side").alias("side"), F.posexplode(F.split("s.text", "\n", -1)).alias("i", "line"))


def matched_once(t: DataFrame) -> DataFrame:
    """One round over (pair, side, i, h, matched): ``matched`` with the new matches."""
    at_side = Window.partitionBy(PAIR, "side")
    before = at_side.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("seg", F.sum(F.col("matched").cast("int")).over(before))
    # matched lines take part in no group: they get a segment of their own
    t = t.withColumn("seg", F.when(F.col("matched"), -1 - F.col("i")).otherwise(F.col("seg")))
    own = Window.partitionBy(PAIR, "side", "seg")
    t = t.withColumn("p", F.col("i") - F.min("i").over(own)).withColumn("q", F.max("i").over(own) - F.col("i"))
    seg = Window.partitionBy(PAIR, "seg")

    def side(c: Column, s: int) -> Column:
        return F.when(F.col("side") == s, c)

    def common(step: str) -> Column:
        """Number of equal lines in a row from where ``step`` is 0."""
        facing = Window.partitionBy(PAIR, "seg", step)
        same = F.max(side(F.col("h"), OLD)).over(facing) == F.max(side(F.col("h"), NEW)).over(facing)
        return F.when(~F.coalesce(same, F.lit(False)), F.col(step))

    t = t.withColumn("bad_p", common("p")).withColumn("bad_q", common("q"))
    whole = F.lit(2**31 - 1)
    t = t.withColumns({"head": F.coalesce(F.min("bad_p").over(seg), whole), "tail": F.coalesce(F.min("bad_q").over(seg), whole),
                       "n_old": F.sum(side(F.lit(1), OLD)).over(seg), "n_new": F.sum(side(F.lit(1), NEW)).over(seg)})
    room = F.least("n_old", "n_new") - F.least("head", F.least("n_old", "n_new"))  # null where a side is empty
    trimmed = (F.col("p") < F.col("head")) | (F.col("q") < F.least(F.col("tail"), room))
    t = t.withColumn("trimmed", ~F.col("matched") & F.coalesce(trimmed, F.lit(False)))
    alike = Window.partitionBy(PAIR, "seg", "trimmed", "h")
    t = t.withColumns({"o": F.max(side(F.col("i"), OLD)).over(alike), "n": F.max(side(F.col("i"), NEW)).over(alike),
                       "copies": F.count(F.lit(1)).over(alike)})
    anchor = ~F.col("matched") & ~F.col("trimmed") & (F.col("copies") == 2) & F.col("o").isNotNull() & F.col("n").isNotNull()
    once = t.filter(anchor & (F.col("side") == OLD)).groupBy(PAIR, "seg").agg(F.array_sort(F.collect_list(F.struct("o", "n"))).alias("c"))
    kept = once.select(PAIR, "c", F.explode(increasing(F.transform("c", lambda x: x["n"]))).alias("k")).select(
        PAIR, F.get("c", F.col("k")).alias("x"))
    hits = kept.select(PAIR, F.explode(F.array(F.struct(F.lit(OLD).alias("side"), F.col("x.o").alias("i")),
                                               F.struct(F.lit(NEW).alias("side"), F.col("x.n").alias("i")))).alias("e")).select(
        PAIR, "e.side", "e.i", F.lit(True).alias("hit"))
    j = t.select(PAIR, "side", "i", "h", "matched", "trimmed").join(hits, [PAIR, "side", "i"], "left")
    return j.select(PAIR, "side", "i", "h", (F.col("matched") | F.col("trimmed") | F.coalesce("hit", F.lit(False))).alias("matched"))


def line_hunks(pairs: DataFrame, key: list[str], old: str, new: str) -> DataFrame:
    """key, hunk (0, 1, ...), old_start, new_start (from 0), removed, added (lines in order):
    the differences between the texts ``old`` and ``new`` of each row of ``pairs``.

    Equal texts have no hunk. A null text has no lines, an empty one a single empty line.
    ``key`` must name a row."""
    pairs = pairs.select(*key, old, new)
    width = partitions_for(pairs)
    library_on_workers(pairs.sparkSession)
    lines = text_lines(pairs.filter(~F.col(old).eqNullSafe(F.col(new))), key, old, new)
    t = staged(lines.select(PAIR, "side", "i", F.md5("line").alias("h"), F.lit(False).alias("matched")).repartition(width, PAIR))
    done = 0
    while True:
        t = staged(matched_once(t))
        now = t.filter("matched").count()
        if now == done:
            break
        done = now
    count = Window.partitionBy(PAIR, "side").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    flags = t.withColumn("gap", F.sum(F.col("matched").cast("int")).over(count)).select(PAIR, "side", "i", "matched", "gap")
    full = flags.join(lines, [PAIR, "side", "i"])

    def after(side: int) -> Column:
        return F.coalesce(F.max(F.when(F.col("matched") & (F.col("side") == side), F.col("i"))) + 1, F.lit(0))

    def open_lines(side: int) -> Column:
        got = F.array_sort(F.collect_list(F.when(~F.col("matched") & (F.col("side") == side), F.struct("i", "line"))))
        return F.transform(got, lambda x: x["line"])

    gaps = full.groupBy(PAIR, "gap").agg(after(OLD).alias("old_start"), after(NEW).alias("new_start"),
                                         open_lines(OLD).alias("removed"), open_lines(NEW).alias("added"))
    number = F.row_number().over(Window.partitionBy(PAIR).orderBy("gap")) - 1
    return gaps.filter((F.size("removed") > 0) | (F.size("added") > 0)).withColumn("hunk", number).select(
        F.col(f"{PAIR}.*"), "hunk", "old_start", "new_start", "removed", "added")


def apply_hunks(texts: DataFrame, hunks: DataFrame, key: list[str], old: str, out: str = "rebuilt") -> DataFrame:
    """``texts`` with ``out``: the text that the hunks make of the column ``old``."""
    per = hunks.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("old_start", "hunk", F.size("removed").alias("gone"), "added"))).alias("_h"))
    j = texts.join(per, key, "left")
    lines = F.coalesce(F.split(F.col(old), "\n", -1), F.array().cast("array<string>"))
    j = j.withColumn("_l", lines)

    def until(i: Column) -> Column:  # lines of the old text that are behind hunk i - 1
        last = F.get("_h", i - 1)
        return F.when(i > 0, last["old_start"] + last["gone"]).otherwise(F.lit(0))

    parts = F.transform("_h", lambda h, i: F.concat(F.slice("_l", until(i) + 1, h["old_start"] - until(i)), h["added"]))
    rest = F.slice("_l", until(F.size("_h")) + 1, F.greatest(F.size("_l") - until(F.size("_h")), F.lit(0)))
    made = F.concat(F.flatten(parts), rest)
    text = F.when(F.col("_h").isNull(), F.col(old)).when(F.size(made) > 0, F.array_join(made, "\n"))
    return j.withColumn(out, text).drop("_h", "_l")
