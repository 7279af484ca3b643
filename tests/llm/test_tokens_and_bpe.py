"""Token counts and the BPE round trip against the tokenizers library."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from wikilake.llm import bpe_codec, token_counts
from wikilake.llm.queries import bpe_digests, vocabulary

PIECES = ["a", "B", " ", "  ", "\n", "\t", "\r\n", "'s", "'", "1", "23", "É", "é", "中文", "ß", "ßö", "<|endoftext|>", "<|ENDOFTEXT|>", "!", "_",
          "\x1c", "²", "ab", "'LL", "\x85", " ", "İ", "ſ", "Σ", "é", "\U0001f600"]


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(1)
    found = ["".join(rnd.choices(PIECES, k=rnd.randint(0, 30))) for _ in range(4000)]
    return [*found, "x" * 40000 + " 1a" * 30000, "a1" * 50000, "word " * 30000, ""]


def test_counts_match_the_library(texts):
    path = vocabulary("byte_bpe_50k.json")
    whole = [len(e) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert token_counts.count_batch(texts, path) == whole
    assert token_counts.count_batch(texts, path, call_chars=50) == whole


def test_chunks_are_the_text(texts):
    assert all("".join(token_counts.chunks(t)) == t for t in texts if t)


def test_counts_of_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    path = vocabulary("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    for r in token_counts.count_tokens(docs, path).collect():
        n = len(t.encode(r.text, add_special_tokens=False))
        assert (r.tokens.n_bytes, r.tokens.n_tokens, r.tokens.over_limit) == (len(r.text.encode()), n, n > 512)


def test_round_trip_matches_the_library(spark, texts):
    rows = [*enumerate(texts), (10**6, None)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).cache()
    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    found = {r.doc_id: r for r in bpe_digests(table).collect()}
    assert len(found) == len(rows)
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        expected = (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(),
                    hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert (found[i].n_tokens, found[i].ids_sha256, found[i].decoded_sha256) == expected


def test_small_batches_and_kept_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    path = vocabulary("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = bpe_codec.encode_documents(docs, path, batch_chars=20_000).select("text", "lang", "bpe.*").collect()
    assert len(rows) == docs.count()
    for r in rows:
        ids = t.encode(r.text, add_special_tokens=False).ids
        assert np.frombuffer(r.ids, dtype="<u4").tolist() == ids and r.decoded == t.decode(ids, skip_special_tokens=False)


def test_batches_of_equal_words_have_names_of_their_own(spark):
    def names(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([bpe_codec.batch_name(["a"], k) for k in (1, 2)])], ["name"])

    found = spark.range(4).repartition(2).mapInArrow(names, "name bigint").collect()
    assert len({r.name for r in found}) == len(found) == 4


def test_copies_that_fill_many_batches(spark):
    path = vocabulary("word_bpe_49k.json")
    rows = [(i, "the same old text " * 40) for i in range(200)] + [(900 + i, "") for i in range(50)] + [(999, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    found = {r.doc_id: r.decoded for r in bpe_codec.encode_documents(docs, path, batch_chars=2_000).select("doc_id", "bpe.decoded").collect()}
    lib = Tokenizer.from_file(path)
    one = lib.decode(lib.encode("the same old text " * 40, add_special_tokens=False).ids, skip_special_tokens=False)
    assert found == {i: one if t else "" for i, t in rows}
