"""Toxicity: gradient-boosted trees over dense text features, isotonic calibration.

1. Training rows: at most ``SAMPLE`` labelled documents whose crc32(doc_id) mod 5 is not 0,
   the first ones in the order of a hash (the bound also bounds what is broadcast), equal
   texts as one row.
2. Lexicon: half of them give, per word and word stem (prefixes of 4 to 7 letters),
   the documents of either label that hold it; the ``LEXICON`` keys that are most
   significantly over-represented in toxic ones are kept with their log-odds. Counting is done by Spark, pre-aggregated per task.
3. Features of every text, in an Arrow function: lexicon densities, log-odds mass,
   proximity of hits to second-person words, capitals, punctuation, obfuscation rates.
4. Spark ML gradient-boosted trees on another three tenths, isotonic regression of their
   probability on the rest.

The lexicon (bounded) is the only model part in the Arrow function; trees and calibration
run in the JVM. Scoring needs no shuffle. Labels, language, source and doc_id are never
inputs of a score.

Defined results: null text counts as empty; an empty text has all features 0 and gets the
score the model gives there; labels that are null or whose document is missing are not
used; of several labels of one document the largest counts; without labels of both kinds
the score is the training rate (0.5 where nothing is labelled at all, minus a hair so that
nothing is predicted toxic); rows with a null doc_id count as not held out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, free_name, pieces, written

SAMPLE = 20_000
LEXICON = 300
MIN_DOCS = 5
MIN_Z = 4.0
MIN_ODDS = 1.0
TREES = 20
DEPTH = 4
STEMS = (4, 5, 6, 7)
NEAR = 5
#: Of ten training rows: for the lexicon (0), the trees (1) and the calibration (2).
PARTS = (0, 0, 0, 0, 0, 1, 1, 1, 2, 2)

WORD = re.compile(r"[^\W_]+(?:[.*@$!_'-][^\W_]+)*[^\W_]?")
#: Second-person words of the four languages, and look-alike characters.
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine "
                          "deinen euch ihr euer usted ustedes ti tus su sus vosotros os".split())
LOOKALIKES = str.maketrans("013457@$!", "oieastasi")
SEPARATORS = str.maketrans("", "", ".*@$!_'-")

FEATURES = ("log_words", "hit_density", "log_hits", "distinct_hits", "mass_density", "top_mass", "stem_density",
            "near_second_person", "second_person_rate", "capital_rate", "all_caps_rate", "exclamation_rate",
            "punctuation_rate", "repeat_rate", "digit_in_word_rate", "obfuscated_hits", "separator_rate")


def keys_of(word: str) -> list[str]:
    return [word, *[word[:n] + "~" for n in STEMS if len(word) > n]]


def plain(word: str) -> str:
    """A word without look-alike characters and separators."""
    return word.translate(LOOKALIKES).translate(SEPARATORS)


def text_features(text: str, lexicon: dict[str, float]) -> list[float]:
    found = WORD.findall(text)
    words = [w.lower() for w in found]
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    get = lexicon.get
    at: list[int] = []
    masses: list[float] = []
    distinct = set()
    stems = hidden = digits = split = 0
    for i, w in enumerate(words):
        mass = get(w, 0.0)
        if not mass and len(w) > STEMS[0]:
            mass = max(get(w[:k] + "~", 0.0) for k in STEMS)
            stems += mass > 0
        if not mass and not w.isalpha():
            digits += any(c.isdigit() for c in w) and any(c.isalpha() for c in w)
            bare = plain(w)
            split += len(bare) < len(w)
            mass = get(bare, 0.0)
            hidden += mass > 0
        if mass:
            at.append(i)
            masses.append(mass)
            distinct.add(w)
    seconds = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    near, k = 0, 0
    for i in at:  # both lists ascend
        while k < len(seconds) and seconds[k] < i - NEAR:
            k += 1
        near += k < len(seconds) and seconds[k] <= i + NEAR
    chars = len(text)
    capitals = sum(len(x) for x in re.findall(r"[A-ZÀ-ÖØ-Þ]+", text))
    caps_words = sum(1 for w in found if len(w) > 2 and w.isupper())
    marks = sum(map(text.count, ".,;:!?\"'()"))
    return [math.log1p(n), len(at) / n, math.log1p(len(at)), math.log1p(len(distinct)), sum(masses) / n,
            max(masses, default=0.0), stems / n, near / n, len(seconds) / n, capitals / chars, caps_words / n,
            text.count("!") / n, marks / chars, len(re.findall(r"(.)\1{2,}", text)) / n, digits / n, math.log1p(hidden), split / n]


def features(text: Column, lexicon: dict[str, float]) -> Column:
    from pyspark.ml.functions import array_to_vector  # here, not above: Python workers need no Spark ML

    @F.arrow_udf("array<double>")
    def dense(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in pieces(batches):
            yield pa.array((text_features(t.as_py() or "", lexicon) for t in texts), pa.list_(pa.float64()))

    return array_to_vector(dense(text))


def key_counts(rows: DataFrame) -> DataFrame:
    """Documents per key and label; each task adds up its own rows first."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, Counter] = {0: Counter(), 1: Counter()}

        def table() -> pa.RecordBatch:
            names = list(totals[0].keys() | totals[1].keys())
            batch = pa.RecordBatch.from_arrays([
                pa.array(names, pa.string()), pa.array([totals[0][k] for k in names], pa.int64()),
                pa.array([totals[1][k] for k in names], pa.int64())], ["key", "clean", "toxic"])
            totals[0].clear()
            totals[1].clear()
            return batch

        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                totals[label].update({k for w in set(WORD.findall((text or "").lower())) for k in keys_of(w)})
                if len(totals[0]) + len(totals[1]) > 500_000:
                    yield table()
        yield table()

    return rows.select("text", "label").mapInArrow(count, "key string, clean bigint, toxic bigint").groupBy("key").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def fit_lexicon(rows: DataFrame, size: int = LEXICON) -> dict[str, float]:
    n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return {}
    a, b = F.col("toxic") + 0.5, F.col("clean") + 0.5
    odds = F.log(a / (n[1] - F.col("toxic") + 0.5)) - F.log(b / (n[0] - F.col("clean") + 0.5))
    rate = n[1] / (n[0] + n[1])
    expected = (F.col("toxic") + F.col("clean")) * rate
    ranked = (key_counts(rows).filter(F.col("toxic") >= MIN_DOCS)
              .select("key", odds.alias("odds"), ((F.col("toxic") - expected) / F.sqrt(expected * (1 - rate))).alias("z"))
              .filter((F.col("z") >= MIN_Z) & (F.col("odds") >= MIN_ODDS))
              .orderBy(F.col("z").desc(), "key").limit(size))
    return {r["key"]: float(r["odds"]) for r in ranked.collect()}  # at most ``size`` rows


def is_held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: int) -> DataFrame:
    """text, label and part (0, 1, 2) of the bounded sample of labelled rows."""
    key = column(labels, "doc_id")
    order = F.crc32(F.concat(F.lit("fit:"), F.col("id").cast("string")).cast("binary"))
    chosen = (labels.filter(column(labels, "toxic").isNotNull() & key.isNotNull() & ~is_held_out(key))
              .groupBy(key.alias("id")).agg(F.max(column(labels, "toxic")).cast("int").alias("label"))
              .withColumn("order", order).orderBy("order", "id").limit(sample))
    chosen = written(chosen)  # at most ``sample`` narrow rows, so their size is known to the join
    texts = docs.select(column(docs, id_col).alias("doc"), F.coalesce(column(docs, text_col).cast("string"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), F.col("doc") == F.col("id"))
    # copies of a text are one training row, so they cannot vouch for its words
    return written(found.groupBy("text").agg(F.when(F.avg((F.col("label") > 0).cast("int")) >= 0.5, 1).otherwise(0).alias("label"))
                   .withColumn("part", F.element_at(
                       F.array(*map(F.lit, PARTS)), (F.crc32(F.col("text").cast("binary")) % len(PARTS) + 1).cast("int"))))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   sample: int = SAMPLE, trees: int = TREES, out: str = "toxicity") -> DataFrame:
    """``docs`` with a struct ``out``: held_out, score, predicted."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    out = free_name(docs, out)
    rows = training_rows(docs, labels, id_col, text_col, sample)
    text = F.coalesce(column(docs, text_col).cast("string"), F.lit(""))
    counts = {(r["part"], r["label"]): r["n"] for r in rows.groupBy("part", "label").agg(F.count("*").alias("n")).collect()}
    if all(counts.get((t, k)) for t in range(3) for k in (0, 1)):
        lexicon = fit_lexicon(rows.filter("part = 0"))
        known = written(rows.select("label", "part", vector_to_array(features(F.col("text"), lexicon)).alias("x"))).select(
            "part", F.col("label").cast("double").alias("label"), array_to_vector("x").alias("features")).repartition(4).cache()
        trained = GBTClassifier(maxIter=trees, maxDepth=DEPTH, stepSize=0.2, seed=11, maxBins=64, minInstancesPerNode=5).fit(
            known.filter("part = 1"))
        held = trained.transform(known.filter("part = 2")).select("label", vector_to_array("probability")[1].alias("raw"))
        curve = IsotonicRegression(labelCol="label", featuresCol="raw").fit(held)
        known.unpersist()
        names = {x: free_name(docs, f"toxicity_{x}") for x in ("features", "raw", "cal")}
        trained.setFeaturesCol(names["features"]).setPredictionCol("").setRawPredictionCol("").setProbabilityCol(names["raw"])
        scored = trained.transform(docs.withColumn(names["features"], features(text, lexicon)))
        scored = scored.withColumn(names["raw"], vector_to_array(names["raw"])[1])
        scored = curve.setFeaturesCol(names["raw"]).setPredictionCol(names["cal"]).transform(scored)
        # a step of the curve keeps a trace of the trees' own order
        score = 0.98 * F.least(F.greatest(F.col(names["cal"]), F.lit(0.0)), F.lit(1.0)) + 0.02 * F.col(names["raw"])
    else:
        labelled = sum(counts.values())
        rate = sum(n for (_, k), n in counts.items() if k) / labelled if labelled else 0.499
        scored, score, names = docs, F.lit(float(rate)), {}
    return scored.withColumn(out, F.struct(
        is_held_out(column(docs, id_col)).alias("held_out"), score.cast("double").alias("score"),
        (score >= 0.5).cast("int").alias("predicted"))).drop(*names.values())
