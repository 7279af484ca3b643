"""BPE encoding and decoding through a distinct-word table.

Words are what blanks (space, tab, newline, return) separate; neither the normalizer nor
the pre-tokenizer of the vocabulary looks across one, so a text's ids are its words' ids
in a row.

1. Split. A task cuts its documents into batches of about ``BATCH_CHARS`` characters,
   numbers the distinct words of a batch by falling frequency, and keeps each document as
   the sequence of its word numbers (one to three bytes a word).
2. Distinct-word table. The words of all batches are shuffled by hash into buckets, every
   distinct word is encoded once in its bucket, and its pieces are joined to its ids
   through the vocabulary's id-to-piece table.
3. Join back. Each batch gets the rows of its own words and puts them in place of the word
   numbers, position by position.

Texts are never shuffled: what moves is a batch's distinct words, their ids, and the word
numbers. A batch and a bucket are bounded in size; the number of buckets grows with the
input. A frequent word is one row per batch. A batch is named by a hash of its partition,
its number there and its words, so batches of equal texts stay apart, and a batch that is
computed again after a loss finds the same answers (or, if the input itself is not
reproducible, the job fails rather than answer wrongly).

Defined results: null or empty text, or only blanks, has no ids and decodes to the empty
string; special strings inside a text become their ids, as the library does by default;
repeated rows are encoded each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, free_name, shuffle_width
from .packing import pack, squeeze, unpack, unsqueeze
from .token_counts import BYTE_CHARS, PLAIN, tokenizer

BATCH_CHARS = 1 << 23
CHARS_PER_BUCKET = 1 << 26
CALL_CHARS = 1 << 18

BLANKS = re.compile(r"[ \t\n\r]+")
#: Fixed value: the pre-tokenizer's pattern, for chunks of ASCII and Latin-1 letters.
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")


def split_words(text: str) -> list[str]:
    return [w for w in BLANKS.split(text) if w]


def batches_of(texts: list[str | None], batch_chars: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= batch_chars:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def number_words(texts: list[str | None]) -> tuple[list[str], list[np.ndarray]]:
    """(distinct words by falling frequency, word numbers of each text)."""
    at: dict[str, int] = {}
    rows = []
    for t in texts:
        rows.append(np.array([at.setdefault(w, len(at)) for w in split_words(t)] if t else [], dtype=np.int64))
    counts = np.bincount(np.concatenate(rows), minlength=len(at)) if at else np.empty(0, dtype=np.int64)
    order = np.argsort(-counts, kind="stable")
    number = np.empty(len(at), dtype=np.int64)
    number[order] = np.arange(len(at))
    words = list(at)
    return [words[i] for i in order], [number[r] for r in rows]


def batch_name(words: list[str], number: int) -> int:
    """Names the ``number``-th batch of this task's partition by its place and its words."""
    place = f"{TaskContext.get().partitionId()} {number}\n"
    return int(np.uint64(xxhash.xxh3_64_intdigest((place + "\n".join(words)).encode())).view(np.int64))


def encode_words(words: list[str], path: str) -> list[list[int]]:
    """Ids of each word. Words of plain Latin letters go through the model's merge step
    alone, the others through the whole encoder, in calls of bounded size."""
    whole = tokenizer(path)
    merge, known, out = whole.model.tokenize, {}, [None] * len(words)
    call: list[int] = []
    held = 0

    def flush() -> None:
        for i, e in zip(call, whole.encode_batch_fast([words[i] for i in call], add_special_tokens=False)):
            out[i] = e.ids
        call.clear()

    for i, word in enumerate(words):
        if PLAIN.fullmatch(word) and "<|" not in word:
            ids: list[int] = []
            for piece in PIECE.findall(word.lower()):
                found = known.get(piece)
                if found is None:
                    found = known[piece] = [t.id for t in merge(piece.encode().decode("latin-1").translate(BYTE_CHARS))]
                ids += found
            out[i] = ids
            continue
        call.append(i)
        held += len(word)
        if held >= CALL_CHARS:
            flush()
            held = 0
    if call:
        flush()
    return out


def piece_table(path: str) -> list[str]:
    """The vocabulary's pieces by id (its size bounds the table)."""
    vocabulary = tokenizer(path).get_vocab(with_added_tokens=True)
    pieces = [""] * (max(vocabulary.values()) + 1)
    for piece, i in vocabulary.items():
        pieces[i] = piece
    return pieces


def encode_documents(docs: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None, out: str = "bpe",
                     batch_chars: int = BATCH_CHARS) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all by default) with a struct ``out``: n_tokens, ids
    (binary: little-endian unsigned 32-bit numbers) and decoded (pieces joined by a space,
    which is how the library decodes a vocabulary without a decoder)."""
    keep = docs.columns if keep is None else keep
    out = free_name(docs, out)
    spark = docs.sparkSession
    text = column(docs, text_col).cast("string")
    total = docs.agg(F.sum(F.length(text))).first()[0] or 0
    buckets = shuffle_width(spark, total, CHARS_PER_BUCKET)
    names = [f"c{i}" for i in range(len(keep))]
    given = docs.select(*[column(docs, c).alias(n) for c, n in zip(keep, names)])
    rows = docs.select(*[column(docs, c).alias(n) for c, n in zip(keep, names)], text.alias("text"))
    doc_schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in given.schema],
                               T.StructField("batch", T.LongType()), T.StructField("numbers", T.BinaryType())])

    def split_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for got in batches:
            texts = got.column("text").to_pylist()
            for start, end in batches_of(texts, batch_chars):
                number += 1
                words, numbers = number_words(texts[start:end])
                n = end - start
                name = batch_name(words, number)
                yield pa.RecordBatch.from_arrays(
                    [*[got.column(c).slice(start, n) for c in names], pa.array(np.full(n, name)),
                     pa.array([pack(x) for x in numbers], pa.binary())], [*names, "batch", "numbers"])

    def split_vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for got in batches:
            texts = got.column("text").to_pylist()
            for start, end in batches_of(texts, batch_chars):
                number += 1
                words, _ = number_words(texts[start:end])
                name = batch_name(words, number)
                of = np.array([xxhash.xxh32_intdigest(w.encode()) % buckets for w in words], dtype=np.int64)
                order = np.argsort(of, kind="stable")
                cuts = np.flatnonzero(np.diff(of[order])) + 1
                parts = [p for p in np.split(order, cuts) if len(p)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(of[p[0]]) for p in parts], pa.int32()), pa.array(np.full(len(parts), name)),
                     pa.array([pack(np.diff(p, prepend=0)) for p in parts], pa.binary()),
                     pa.array([squeeze("\n".join([words[i] for i in p]).encode()) for p in parts], pa.binary())],
                    ["bucket", "batch", "at", "words"])

    def encode_bucket(asked: pa.Table) -> pa.Table:
        lists = [unsqueeze(w).decode().split("\n") for w in asked.column("words").to_pylist()]
        distinct = list(dict.fromkeys(w for words in lists for w in words))
        ids = dict(zip(distinct, encode_words(distinct, path)))
        sizes = [pack(np.array([len(ids[w]) for w in words])) for words in lists]
        flat = [squeeze(pack(np.array([i for w in words for i in ids[w]], dtype=np.int64))) for words in lists]
        return pa.table({"batch": asked.column("batch"), "at": asked.column("at"),
                         "sizes": pa.array(sizes, pa.binary()), "ids": pa.array(flat, pa.binary())})

    def join_back(mine: pa.Table, answers: pa.Table) -> pa.Table:
        pieces = pa.array(piece_table(path))
        at = [np.cumsum(unpack(b)) for b in answers.column("at").to_pylist()]
        sizes = [unpack(b) for b in answers.column("sizes").to_pylist()]
        flat = [unpack(unsqueeze(b)) for b in answers.column("ids").to_pylist()]
        known = np.concatenate(at) if at else np.empty(0, dtype=np.int64)
        n_words = int(known.max()) + 1 if len(known) else 0
        size = np.full(n_words, -1)
        start = np.zeros(n_words, dtype=np.int64)
        offsets = np.cumsum([0, *map(len, flat)])
        for a, s, o in zip(at, sizes, offsets):
            size[a] = s
            start[a] = o + np.cumsum(s) - s
        ids = np.concatenate(flat).astype("<u4") if flat else np.empty(0, dtype="<u4")
        texts = pc.take(pieces, pa.array(ids)).to_pylist()  # the id-to-piece join
        piece_of = [" ".join(texts[b:b + s]) for b, s in zip(start.tolist(), size.tolist())]
        del texts
        n, packed, decoded = [], [], []
        for numbers in mine.column("numbers").to_pylist():
            w = unpack(numbers)
            if len(w) and (w.max() >= n_words or (size[w] < 0).any()):
                raise RuntimeError("a batch changed between two readings of the input; write the input first")
            s = size[w]
            w, s = w[s > 0], s[s > 0]
            ends = np.cumsum(s)
            total_ids = int(ends[-1]) if len(ends) else 0
            place = np.repeat(start[w] - (ends - s), s) + np.arange(total_ids)
            n.append(total_ids)
            packed.append(ids[place].tobytes())
            decoded.append(" ".join([piece_of[i] for i in w.tolist()]))
        return pa.table([*[mine.column(c) for c in names], pa.array(n, pa.int64()), pa.array(packed, pa.binary()),
                         pa.array(decoded, pa.string())], names=[*names, "n_tokens", "ids", "decoded"])

    asked = rows.select("text").mapInArrow(split_vocabulary, "bucket int, batch bigint, at binary, words binary")
    answers = asked.groupBy("bucket").applyInArrow(encode_bucket, "batch bigint, at binary, sizes binary, ids binary")
    numbered = rows.mapInArrow(split_documents, doc_schema)
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in given.schema], T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])
    found = numbered.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(join_back, schema)
    return found.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], F.struct("n_tokens", "ids", "decoded").alias(out))
