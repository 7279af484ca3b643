"""Coverage of captured listings (S5): a sweep over the intervals of their responses.

A response that starts at s and holds n items covers [s, s + n) of its listing. Per listing and
capture the sweep turns the intervals into a depth at every offset: depth 0 between the first and
the last offset is a gap, depth 2 and more an overlap. Captures are never mixed, so two captures
of one listing are not duplicates of each other. The depth is a running sum by ranges
(``ranges.prefix_sums``), so one listing may hold any share of the responses.

``listing_moves`` compares every capture with the next one of its instance: pages that stayed
at their place, moved, were added or removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import staged
from .ranges import numbered, prefix_sums

LISTING = ["instance", "kind", "space_key", "capture"]


def listing_coverage(responses: DataFrame) -> DataFrame:
    """Per listing and capture over (LISTING, start, n_items): items covered, first offset and
    end, and number and length of gaps and overlaps. ``extra_items`` counts every item beyond
    the first at its offset. Responses without items cover nothing; a listing that has only
    such responses has neither gaps nor overlaps, and first and end are null."""
    marks = F.explode(F.array(F.struct(F.col("start").cast("long").alias("at"), F.lit(1).cast("long").alias("d")),
                              F.struct((F.col("start") + F.col("n_items")).cast("long").alias("at"), F.lit(-1).cast("long").alias("d"))))
    held = responses.filter("n_items > 0").select(*LISTING, marks.alias("m"))
    steps = staged(held.groupBy(*LISTING, "m.at").agg(F.sum("m.d").alias("d")))
    n = steps.count()
    depth = staged(prefix_sums(steps, LISTING, ["at"], "d", n, "depth"))
    placed = staged(numbered(depth.select(*LISTING, "at", "depth"), LISTING, ["at"], n))
    follow = placed.select(*[F.col(c).alias(f"_{c}") for c in LISTING], (F.col("pos") - 1).alias("_pos"), F.col("at").alias("next_at"))
    same = F.col("pos") == F.col("_pos")
    for c in LISTING:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    pieces = placed.join(follow, same, "left").withColumn("size", F.coalesce(F.col("next_at") - F.col("at"), F.lit(0)))
    # neighbouring pieces of depth 2 and 3 are one overlap: it begins where the depth before was below 2
    before = placed.select(*[F.col(c).alias(f"b_{c}") for c in LISTING], (F.col("pos") + 1).alias("b_pos"), F.col("depth").alias("last_depth"))
    prior = F.col("pos") == F.col("b_pos")
    for c in LISTING:
        prior = prior & F.col(c).eqNullSafe(F.col(f"b_{c}"))
    pieces = pieces.join(before, prior, "left")
    gap, over = (F.col("depth") == 0) & (F.col("size") > 0), F.col("depth") >= 2

    def total(c) -> F.Column:
        return F.coalesce(F.sum(c), F.lit(0)).cast("long")

    swept = pieces.groupBy(*LISTING).agg(
        F.min("at").alias("first_offset"), F.max("at").alias("end_offset"),
        total(F.when(F.col("depth") > 0, F.col("size"))).alias("covered"),
        total(gap.cast("int")).alias("n_gaps"), total(F.when(gap, F.col("size"))).alias("gap_items"),
        total((over & (F.coalesce("last_depth", F.lit(0)) < 2)).cast("int")).alias("n_overlaps"),
        total(F.when(over, F.col("size") * (F.col("depth") - 1))).alias("extra_items"))
    every = responses.groupBy(*LISTING).agg(F.count(F.lit(1)).alias("n_responses"), total("n_items").alias("n_items"))
    e, s = every.alias("e"), swept.alias("s")
    on = F.lit(True)
    for c in LISTING:
        on = on & F.col(f"e.{c}").eqNullSafe(F.col(f"s.{c}"))
    zero = ("covered", "n_gaps", "gap_items", "n_overlaps", "extra_items")
    return e.join(s, on, "left").select(*[F.col(f"e.{c}").alias(c) for c in LISTING], "n_responses", "n_items", "first_offset", "end_offset",
                                        *[F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in zero])


def listing_moves(listing: DataFrame) -> DataFrame:
    """Per instance and pair of successive captures over (instance, capture, page_id, ordinal):
    pages at the same ordinal, moved, added and removed. A page listed more than once in a
    capture stands at its first place."""
    first = staged(listing.groupBy("instance", "capture", "page_id").agg(F.min("ordinal").alias("ordinal")))
    by_time = Window.partitionBy("instance").orderBy("capture")
    pairs = first.select("instance", "capture").distinct().withColumn("next_capture", F.lead("capture").over(by_time)).filter(
        "next_capture IS NOT NULL")  # one row per capture
    pairs = staged(pairs)
    old = first.join(pairs, ["instance", "capture"]).select("instance", "capture", "next_capture", "page_id", F.col("ordinal").alias("was"))
    new = first.withColumnRenamed("capture", "next_capture").join(pairs, ["instance", "next_capture"]).select(
        "instance", "capture", "next_capture", "page_id", F.col("ordinal").alias("now"))
    both = old.join(new, ["instance", "capture", "next_capture", "page_id"], "full")

    def number(c) -> F.Column:
        return F.sum(F.coalesce(c, F.lit(False)).cast("int")).cast("long")

    return both.groupBy("instance", "capture", "next_capture").agg(
        number(F.col("was") == F.col("now")).alias("n_kept"), number(F.col("was") != F.col("now")).alias("n_moved"),
        number(F.col("was").isNull()).alias("n_added"), number(F.col("now").isNull()).alias("n_removed"))
