"""Token counts: batch encoding in Arrow functions that return lengths only.

A task receives texts in Arrow batches. Texts are cut at places where the byte-level
pre-tokenizer always starts a new piece (before a run of blanks, in very long chunks also
between a letter and a digit), so the counts of the chunks add up to the count of the
text. Texts are taken in groups of about equal bytes; the chunks of a group that were not
met lately are encoded in calls of about equal bytes, of which only the lengths are kept,
and one number per text leaves the task. The memory of lengths is bounded. No shuffle.

Defined results: null or empty text has 0 bytes and 0 tokens; a text without a safe
boundary is encoded whole; special strings inside a text count as the library's default
has them; repeated rows are counted each; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, free_name

PART_CHARS = 1 << 14
CALL_CHARS = 1 << 18
CACHE_ENTRIES = 1 << 19
LIMIT = 512

#: Blanks other than the usual four; where one occurs only ``SAFE`` places are cut.
RARE_BLANK = re.compile(r"[^\S \n\t\r]")
#: A blank beside a space: there a single space does not decide where a piece starts.
BLANK_RUN = re.compile(r" [ \n\t\r]|[\n\t\r] ")
#: A run of blanks with what follows it: the pre-tokenizer always starts a piece there.
CHUNK = re.compile(r"[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
#: Places inside a long chunk, or in a text with rare blanks, that pieces never cross (a
#: special string holds no blank and no digit, so it is never cut either).
SAFE = re.compile(r"(?<=[\w.,;:!?])(?=[ \n])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
#: The pre-tokenizer's pattern, for chunks of ASCII and Latin-1 letters.
PLAIN = re.compile(r"[\x00-\x1B\x20-\x7EÀ-ÖØ-öø-ÿ]*")
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-zÀ-ÖØ-öø-ÿ0-9]+|\s+(?!\S)|\s+")


def byte_chars() -> dict[int, int]:
    """The printable character that the byte-level alphabet writes for each byte: the
    visible Latin-1 characters stand for themselves, the rest follow from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(visible)]
    return {b: b for b in visible} | {b: 0x100 + k for k, b in enumerate(rest)}


BYTE_CHARS = byte_chars()


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def safe_parts(text: str, part_chars: int = PART_CHARS) -> Iterator[str]:
    """``text`` in order, in parts of at least ``part_chars`` that end at safe places."""
    at = 0
    while len(text) - at > part_chars:
        cut = SAFE.search(text, at + part_chars)
        if cut is None:
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def chunks(text: str) -> list[str]:
    """``text`` cut at safe places only: the counts of the chunks sum to its count."""
    if RARE_BLANK.search(text):
        return list(safe_parts(text))
    if BLANK_RUN.search(text):
        found = CHUNK.findall(text)
    else:
        first, *rest = text.split(" ")
        found = [first, *[f" {w}" for w in rest]] if first else [f" {w}" for w in rest]
    if len(text) > PART_CHARS and max(map(len, found)) > PART_CHARS:
        return [p for c in found for p in safe_parts(c)]
    return found


def encode_new(new: set[str], counts: dict[str, int], path: str, call_chars: int) -> None:
    """Lengths of ``new`` into ``counts``. Plain Latin chunks are cut into the model's
    pieces here and go to its merge step alone; the others go through the whole encoder,
    in calls of about ``call_chars`` characters each."""
    whole = tokenizer(path)
    merge, encode = whole.model.tokenize, whole.encode_batch_fast
    pieces: dict[str, int] = {}
    call: list[str] = []
    held = 0
    for chunk in new:
        if PLAIN.fullmatch(chunk) and "<|" not in chunk:
            n = 0
            for piece in PIECE.findall(chunk):
                k = pieces.get(piece)
                if k is None:
                    k = pieces[piece] = len(merge(piece.encode().decode("latin-1").translate(BYTE_CHARS)))
                n += k
            counts[chunk] = n
            continue
        call.append(chunk)
        held += len(chunk)
        if held >= call_chars:
            counts.update(zip(call, map(len, encode(call, add_special_tokens=False))))
            call, held = [], 0
    if call:
        counts.update(zip(call, map(len, encode(call, add_special_tokens=False))))


@lru_cache(maxsize=4)
def known(path: str) -> dict[str, int]:
    return {}


def count_batch(texts: list[str | None], path: str, call_chars: int = CALL_CHARS) -> list[int]:
    """Tokens of each text. Texts are taken in groups of about ``call_chars`` characters,
    and each chunk that was not met lately is encoded once."""
    counts, totals = known(path), []
    group: list[list[str]] = []
    held = 0

    def flush() -> None:
        if len(counts) > CACHE_ENTRIES:
            counts.clear()
        new = set().union(*group).difference(counts)
        encode_new(new, counts, path, call_chars)
        totals.extend(sum(map(counts.__getitem__, g)) for g in group)

    for text in texts:
        group.append(chunks(text) if text else [])
        held += len(text or "")
        if held >= 8 * call_chars:
            flush()
            group, held = [], 0
    if group:
        flush()
    return totals


def token_length(text: Column, path: str, call_chars: int = CALL_CHARS) -> Column:
    """Number of tokens of each whole text under the tokenizer file at ``path``."""

    @F.arrow_udf("bigint")
    def lengths(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(count_batch(texts.to_pylist(), path, call_chars), pa.int64())

    return lengths(text)


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", limit: int = LIMIT, out: str = "tokens") -> DataFrame:
    """``docs`` with a struct ``out``: n_bytes, n_tokens, over_limit."""
    out = free_name(docs, out)
    text = F.coalesce(column(docs, text_col).cast("string"), F.lit(""))
    n = free_name(docs, "n_tokens_found")
    return (docs.withColumn(n, token_length(text, path))
            .withColumn(out, F.struct(F.octet_length(text).cast("bigint").alias("n_bytes"), F.col(n).alias("n_tokens"),
                                      (F.col(n) > limit).alias("over_limit"))).drop(n))
