"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

Every document of a source expects ``target / source_size`` copies. Inside a source the
documents stand in a fixed order (hash bucket, size, doc_id); the running sum of expected
copies plus one random offset per source crosses an integer boundary once for each copy
to emit. The order by size inside a bucket keeps the words taken close to the target; of
``offsets`` random offsets a source uses the one whose words come nearest to it, which
matters for small sources with a few very long documents.

Scale: a source is cut into hash buckets of about ``rows_per_bucket`` rows, so a source
holding a third of all rows is many window groups; only the bucket counts, one row per
``rows_per_bucket`` documents, meet in a per-source window. The tables of sources and of
buckets are written first, so the optimizer knows their size and broadcasts them only if
they are below its threshold.

Defined results: null text or text without words has size 0 and is sampled at its
source's rate (it takes no words); null source is one source, last in the order; a source
without words has target 0 and no copies; repeated rows are separate documents; rows with
a null doc_id are ordered first; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, column, free_name, written

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SEED = "mix-1"
ROWS_PER_BUCKET = 4096
OFFSETS = 16


def hash32(c: Column) -> Column:
    """First 32 bits of the md5 digest, as a bigint."""
    return F.conv(F.substring(F.md5(c.cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint")


def offset_of(src: Column, seed: str, i: int) -> Column:
    """The ``i``-th random offset of a source, in (0, 1), a function of seed and source."""
    name = F.coalesce(F.concat(F.lit("s"), src), F.lit("n"))
    return (hash32(F.concat(F.lit(f"{seed}:{i}:"), name)) % 1024 + F.lit(0.5)) / F.lit(1024.0)


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``sizes`` (src, n, source_size) with ``target`` and the sampling ``rate``.

    Sources by code point (null last) take ``weights`` in turn. Targets share the total
    by weight; one that would pass ``max_repeat`` times its source is held there and the
    excess goes to the others by weight. In ascending order of cap / weight the held
    sources are a prefix: source i is held when its cap is at most its share of what the
    sources before it leave, so two running sums give the common level.
    """
    by_name = Window.orderBy(F.col("src").asc_nulls_last())
    ranked = sizes.withColumn("k", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumn("w", F.element_at(F.array(*[F.lit(int(x)) for x in weights]),
                                                 (F.col("k") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(max_repeat))
    fill = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("k"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    ranked = (ranked
              .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
              .withColumn("w_before", F.coalesce(F.sum("w").over(before), F.lit(0)))
              .withColumn("total", F.sum("source_size").over(whole))
              .withColumn("w_all", F.sum("w").over(whole)))
    level = (F.col("total") - F.col("cap_before")).cast("double") / (F.col("w_all") - F.col("w_before")).cast("double")
    ranked = ranked.withColumn("level", level).withColumn("pos", F.row_number().over(fill))
    free = F.when(F.col("cap") > F.col("level") * F.col("w"), F.struct("pos", "level"))
    ranked = ranked.withColumn("first_free", F.min(free).over(whole))
    ranked = ranked.withColumn("common", F.col("first_free.level")).withColumn(
        "held", F.coalesce(F.col("pos") < F.col("first_free.pos"), F.lit(True)))
    target = F.when(F.col("held"), F.col("cap").cast("double")).otherwise(F.col("common") * F.col("w"))
    return ranked.select("src", "n", "source_size", target.alias("target"),
                         F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"))


def mix_plan(docs: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, seed: str = SEED,
             rows_per_bucket: int = ROWS_PER_BUCKET, offsets: int = OFFSETS, id_col: str = "doc_id", text_col: str = "text",
             source_col: str = "source", out: str = "mix") -> DataFrame:
    """All rows and columns of ``docs`` plus a struct ``out`` with size, source_size,
    target, copies and taken (underscores are put in front of ``out`` if taken)."""
    out = free_name(docs, out)
    size = F.regexp_count(F.coalesce(column(docs, text_col), F.lit("")), F.lit(WORD)).cast("bigint")
    key = hash32(F.coalesce(column(docs, id_col).cast("string"), F.lit("")))
    keys = [column(docs, source_col).cast("string").alias("s"), key.alias("h"), size.alias("size"),
            column(docs, id_col).alias("id"), F.xxhash64(column(docs, text_col)).alias("tie")]
    narrow = written(docs.select(*keys))  # no texts
    sizes = narrow.groupBy(F.col("s").alias("src")).agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    n_buckets = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(rows_per_bucket))).cast("bigint")
    params = written(source_targets(sizes, weights, max_repeat).withColumn("nb", n_buckets))

    # where each hash bucket starts inside its source
    counts = (narrow.join(params.select(F.col("src").alias("ps"), "nb"), F.col("s").eqNullSafe(F.col("ps")))
              .select("s", (F.col("h") % F.col("nb")).alias("b")).groupBy("s", "b").agg(F.count("*").alias("m")))
    earlier = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(counts.select(F.col("s").alias("bs"), F.col("b").alias("bb"),
                                   F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("start")))

    def placed(rows: DataFrame) -> DataFrame:
        rows = rows.join(params, rows["s"].eqNullSafe(params["src"])).withColumn("b", F.col("h") % F.col("nb"))
        rows = rows.withColumn("rn", F.row_number().over(
            Window.partitionBy("s", "b").orderBy(F.col("size"), F.col("id").asc_nulls_first(), F.col("tie"))))
        return rows.join(starts, F.col("s").eqNullSafe(F.col("bs")) & (F.col("b") == F.col("bb")))

    def copies(u: Column) -> Column:
        at = F.col("start") + F.col("rn")
        return F.least(F.floor(u + at * F.col("rate")) - F.floor(u + (at - 1) * F.col("rate")), F.lit(max_repeat)).cast("bigint")

    # of a few random offsets each source takes the one whose words come nearest its target
    draws = [offset_of(F.col("s"), seed, i) for i in range(offsets)]
    totals = placed(narrow).groupBy("s").agg(
        *[F.sum(copies(u) * F.col("size")).alias(f"t{i}") for i, u in enumerate(draws)], F.first("target").alias("target"))
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"t{i}") - F.col("target")).alias("off"), F.lit(i).alias("i"), u.alias("u"))
                                 for i, u in enumerate(draws)]))
    chosen = written(totals.select(F.col("s").alias("us"), best.getField("u").alias("u")))

    kept = [f"c{i}" for i in range(len(docs.columns))]  # renamed: clash-free, and unused ones are pruned
    work = placed(docs.select(*[column(docs, c).alias(k) for c, k in zip(docs.columns, kept)], *keys))
    work = work.join(chosen, F.col("s").eqNullSafe(F.col("us")))
    return work.select(
        *[F.col(k).alias(c) for c, k in zip(docs.columns, kept)],
        F.struct(F.col("size"), F.col("source_size"), F.col("target"), copies(F.col("u")).alias("copies"),
                 (copies(F.col("u")) * F.col("size")).alias("taken")).alias(out))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` once per copy, columns as given."""
    out = free_name(docs, "mix")
    plan = mix_plan(docs, out=out, **options)
    copies = F.col(out).getField("copies")
    return (plan.filter(copies > 0)
            .select(*[column(plan, c) for c in docs.columns], F.explode(F.sequence(F.lit(1), copies)).alias(out))
            .drop(out))
