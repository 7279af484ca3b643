"""A training corpus from raw documents: five stages, each written as Parquet and reread.

1. toxicity: documents predicted toxic go.
2. ngram_jaccard_join: of each group of near copies (three-word shingles, Jaccard 0.9) the
   document with the smallest id stays.
3. secret_scans: every secret in the remaining texts is replaced by a mark, and n_chars
   follows the new text; no document goes.
4. mixing: documents are repeated or left out so that the sources meet their weights.
5. bpe_codec: the mix is encoded and decoded; one row per document of the mix.

Stages 1 to 4 return the columns of ``documents`` as they came.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wikilake.llm.common import library_on_workers, written
from wikilake.llm.jaccard_join import keep_one
from wikilake.llm.mixing import mix_documents
from wikilake.llm.queries import bpe_digests
from wikilake.llm.secret_scan import redact_secrets
from wikilake.llm.toxicity import score_toxicity
from wikilake.sources.tables import read_table

#: The toxicity model has no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    library_on_workers(spark)
    scored = score_toxicity(docs, read_table(spark, sf_dir, "labels"), out="toxicity_found")
    return scored.filter(F.col("toxicity_found.predicted") == 0).select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    library_on_workers(spark)
    return keep_one(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    library_on_workers(spark)
    clean = redact_secrets(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    library_on_workers(spark)
    return mix_documents(docs)


def bpe_codec(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    library_on_workers(spark)
    return bpe_digests(docs)


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("secret_scans", secret_scans),
    ("mixing", mixing),
    ("bpe_codec", bpe_codec),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), spark)
    return docs
