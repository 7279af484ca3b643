"""Each stage of the pipeline against brute force on its own input."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from wikilake.llm import secret_scan
from wikilake.llm.common import written
from wikilake.llm.queries import vocabulary

from .test_dedup_and_joins import components_by_brute_force, token_sets

MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{MID}/documents.parquet")
    out = [docs]
    for _, stage in P.STAGES:
        out.append(written(stage(spark, out[-1], MID)))
    return out


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_columns_and_order(steps):
    assert [n for n, _ in P.STAGES] == ["toxicity", "ngram_jaccard_join", "secret_scans", "mixing", "bpe_codec"]
    assert all(s.dtypes == steps[0].dtypes for s in steps[:5])


def test_toxicity_keeps_clean_documents_as_they_are(spark, steps):
    before, after = Counter(rows(steps[0])), Counter(rows(steps[1]))
    assert not after - before
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{MID}/labels.parquet").collect()}
    gone = {r[0] for r in (before - after)}
    clean = [i for i, t in toxic.items() if t == 0]
    assert np.mean([i in gone for i in clean]) < 0.03
    assert np.mean([i in gone for i, t in toxic.items() if t == 1]) > 0.6


def test_one_document_of_each_group_stays(steps):
    before = rows(steps[1])
    roots = {r[2] for r in components_by_brute_force(token_sets([(r[0], r[1]) for r in before]))}
    assert sorted(rows(steps[2])) == sorted(r for r in before if r[0] in roots)


def test_secrets_are_replaced_and_no_document_goes(steps):
    before, after = {r[0]: r for r in rows(steps[2])}, {r[0]: r for r in rows(steps[3])}
    assert before.keys() == after.keys()
    for i, r in after.items():
        assert r[2:4] == before[i][2:4] and r[4] == len(r[1])
        assert not any(k in ("access", "hex") for k, _, _ in secret_scan.base_spans(r[1]))
        if not secret_scan.scan_text(before[i][1])["base"] and not secret_scan.scan_text(before[i][1])["runs"]:
            assert r[1] == before[i][1]


def test_mix_repeats_whole_rows(steps):
    before, after = set(rows(steps[3])), Counter(rows(steps[4]))
    assert set(after) <= before and max(after.values()) <= 3


def test_last_stage_digests_the_mix(spark, steps):
    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    expected = Counter()
    for r in steps[4].collect():
        ids = t.encode(r.text, add_special_tokens=False).ids
        expected[r.doc_id, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(),
                 hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(rows(steps[5])) == expected
    assert Counter(rows(P.run(spark, MID))) == expected
