"""The registered queries of the operators and their DuckDB twins.

Each query applies one operator, with its production parameters, to its whole table and
derives the contract's columns from the operator's output.
"""

from __future__ import annotations

import functools
import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wikilake.sources.tables import read_table

from .common import library_on_workers


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file, the same on every node."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_toxicity(docs, read_table(spark, sf_dir, "labels")).select("doc_id", "toxicity.*")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, keep=["doc_id"]).select(
        "doc_id", F.col("dedup.n_bytes").alias("n_bytes"), F.col("dedup.n_removed").alias("n_removed"),
        F.size("dedup.spans").cast("bigint").alias("n_spans"), F.sha2("dedup.kept", 256).alias("kept_sha256"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, vocabulary("byte_bpe_50k.json")).select("doc_id", "tokens.*")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract_main_text

    return extract_main_text(read_table(spark, sf_dir, "pages"), keep=["page_id", "url"]).select("page_id", "url", "main.*")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_components(docs).select("doc_id", F.col("near.n_shingles").alias("n_shingles"),
                                           F.col("near.component_id").alias("component_id"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_plan

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_plan(docs).select("doc_id", F.col("mix.size").alias("size"), F.col("mix.source_size").alias("source_size"),
                                 F.col("mix.target").alias("target"), F.col("mix.taken").alias("taken"))


def bpe_digests(docs: DataFrame) -> DataFrame:
    from .bpe_codec import encode_documents

    found = encode_documents(docs, vocabulary("word_bpe_49k.json"), keep=["doc_id"])
    return found.select("doc_id", F.col("bpe.n_tokens").alias("n_tokens"), F.sha2("bpe.ids", 256).alias("ids_sha256"),
                        F.sha2(F.col("bpe.decoded").cast("binary"), 256).alias("decoded_sha256"))


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann_tree import nearest_neighbours

    return nearest_neighbours(read_table(spark, sf_dir, "embeddings"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk_threshold import exact_top_k

    return exact_top_k(read_table(spark, sf_dir, "embeddings"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import scan_secrets, span_list

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan_secrets(docs, keep=["doc_id"])
    base = F.filter("secrets", lambda s: s.getField("kind") != "random")

    def number(kind: str):
        return F.size(F.filter("secrets", lambda s: s.getField("kind") == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select("doc_id", number("assign"), number("access"), number("hex"),
                        F.sha2(span_list(base), 256).alias("base_sha256"), span_list(F.col("secrets")).alias("spans"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import FIELDS, folded, leaf_digest, manifest, proof_digest

    docs = read_table(spark, sf_dir, "documents").select(*FIELDS)
    small = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    altered = leaf_digest([small if f == "text" else F.col(f) for f in FIELDS])
    chosen = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    found = manifest(docs, carry={"altered": F.unhex(F.when(chosen, altered))})
    leaf, root, proof = (F.col(f"merkle.{c}") for c in ("leaf", "root", "proof"))
    start = F.coalesce(F.lower(F.hex("altered")), leaf)
    return found.select("doc_id", leaf.alias("leaf"), F.col("merkle.subroot").alias("subroot"), root.alias("root"),
                        proof_digest(proof).alias("proof_sha256"), folded(start, proof).alias("folded_root")
                        ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lang_filters import identify_languages

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify_languages(docs).select("doc_id", "language.*")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rtree import hard_negatives

    def relabel(vec_id, label):
        return F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)

    return hard_negatives(read_table(spark, sf_dir, "embeddings"), relabel=relabel)


def on_workers(query):
    """The query, with this library importable in the Python workers of a local session."""
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        library_on_workers(spark)
        return query(spark, sf_dir)
    return run


REGISTRY = {query.__name__: on_workers(query) for query in (
    op1_toxicity, op2_suffix_dedup, op3_token_counts, op4_html_extraction, op5_jaccard_join,
    op6_mixing, op7_bpe_codec, op8_nearest_neighbours, op9_exact_top_k, op10_secret_scans, op11_merkle_manifest,
    op12_language_id, op13_hard_negatives)}



def merkle_sql(levels: int = 8, top_levels: int = 6) -> str:
    """Level by level, as the contract words it: nodes of a tree, their runs, and every
    leaf's folded digest and proof text; ``levels`` covers 16**levels rows a source."""
    def field(expr: str) -> str:
        return f"coalesce(strlen({expr})::VARCHAR || ':' || {expr}, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(map(field, ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text))) + ")"

    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = ("list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda acc, b: "
           "list_reduce(range(8), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, xor(acc, b)), 4294967295)")
    parts = [f"""
d AS (SELECT doc_id, source AS src, {leaf('text')} AS leaf,
             CASE WHEN xor({crc}, 4294967295) % 5 = 0 THEN {leaf(low)} END AS altered FROM documents),
n0 AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY src) AS n,
              leaf AS h FROM d),
p0 AS (SELECT doc_id, src, pos, n, leaf, coalesce(altered, leaf) AS f, '' AS proof FROM n0)"""]

    def level(nodes: str, paths: str, to_nodes: str, to_paths: str) -> str:
        return f"""
{nodes}g AS (SELECT src, pos // 16 AS run, any_value(n) AS n, list(h ORDER BY pos) AS hs FROM {nodes} GROUP BY src, pos // 16),
{to_nodes} AS (SELECT src, run AS pos, (n + 15) // 16 AS n, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM {nodes}g),
{to_paths} AS (
  SELECT p.* REPLACE (p.pos // 16 AS pos, (p.n + 15) // 16 AS n,
    CASE WHEN p.n = 1 THEN f ELSE sha256(array_to_string(hs[:p.pos % 16], '') || f || array_to_string(hs[p.pos % 16 + 2:], '')) END AS f,
    CASE WHEN p.n = 1 THEN proof ELSE proof || array_to_string(hs[:p.pos % 16], '') || array_to_string(hs[p.pos % 16 + 2:], '') END AS proof)
  FROM {paths} p JOIN {nodes}g g ON p.src IS NOT DISTINCT FROM g.src AND p.pos // 16 = g.run)"""

    for i in range(levels):
        parts.append(level(f"n{i}", f"p{i}", f"n{i + 1}", f"p{i + 1}"))
    parts.append(f"""
s AS (SELECT src AS name, h AS subroot, row_number() OVER (ORDER BY src NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM n{levels}),
t0 AS (SELECT 0 AS src, pos, n, subroot AS h FROM s),
u0 AS (SELECT p.* REPLACE (0 AS src, s.pos AS pos, s.n AS n), s.subroot FROM p{levels} p JOIN s ON p.src IS NOT DISTINCT FROM s.name)""")
    for i in range(top_levels):
        parts.append(level(f"t{i}", f"u{i}", f"t{i + 1}", f"u{i + 1}"))
    return "WITH" + ",".join(parts) + f"""
SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = r.h AS verified
FROM u{top_levels}, t{top_levels} r"""


ORACLE = {
    "op11_merkle_manifest": merkle_sql(),
    "op13_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS y
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
         list_sum(list_transform(list_zip(a.y, c.y), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
         row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id)::INTEGER AS positive_rank
  FROM s WHERE same),
n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_rank ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
  WHERE positive_rank <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank FROM n WHERE rank <= 10
""",
    "op9_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS y
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.y, c.y), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
""",
    "op6_mixing": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source AS src, count(*) AS n, sum(size)::BIGINT AS source_size
  FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY src NULLS LAST) - 1 AS k FROM s),
w AS (SELECT *, CASE k % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 3 * source_size AS cap FROM r),
f AS (
  SELECT *, (total - cap_before)::DOUBLE / (w_all - w_before)::DOUBLE AS level FROM (
    SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS w_all,
      coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
      coalesce(sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_before
    FROM w)),
o AS (SELECT *, row_number() OVER (ORDER BY cap / w, k) AS pos FROM f),
z AS (SELECT min(pos) AS free_pos, arg_min(level, pos) AS common FROM o WHERE cap > level * w),
g AS (SELECT o.*, coalesce(pos < free_pos, true) AS held, common FROM o, z),
t AS (
  SELECT src, n, source_size::BIGINT AS source_size, CASE WHEN held THEN cap::DOUBLE ELSE common * w END AS target,
         greatest(1, ceil(n / 4096.0))::BIGINT AS nb
  FROM g),
e AS (
  SELECT d.*, t.src, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate, d.h % t.nb AS b
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.src),
p AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY b, size, doc_id NULLS FIRST) AS rn FROM e),
u AS (
  SELECT src, i, ((('0x' || substr(md5('mix-1:' || i || ':' || coalesce('s' || src, 'n')), 1, 8))::BIGINT % 1024) + 0.5::DOUBLE) / 1024.0::DOUBLE AS u
  FROM t, range(16) AS r(i)),
c AS (SELECT p.*, i, u, least(floor(u + rn * rate) - floor(u + (rn - 1) * rate), 3)::BIGINT AS copies
      FROM p JOIN u ON p.src IS NOT DISTINCT FROM u.src),
a AS (SELECT src, i, abs(sum(copies * size) - any_value(target)) AS off FROM c GROUP BY src, i),
m AS (SELECT src, arg_min(i, struct_pack(off := off, i := i)) AS i FROM a GROUP BY src)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken
FROM c JOIN m ON c.src IS NOT DISTINCT FROM m.src AND c.i = m.i
""",
}
