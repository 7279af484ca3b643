"""Language ID by a bit-sliced Bloom filter over n-grams.

Learning counts words per language over all training texts, then the n-grams (1 to 4
characters, word borders included) of the distinct words. A language's profile is the n-grams
whose share in it is at least ``RATIO`` of their largest share in any language; at most about
``PROFILE`` n-grams of a language are kept, the most frequent, which bounds the model whatever
the corpus. All profiles lie in one filter of bit slices: row p holds, as a bitmask, the
languages with an n-gram that hashes to p. The rows are or-ed together by an aggregate.

Asking for an n-gram is ``HASHES`` rows and-ed: the mask of every language that has it. A text's
hits per language are popcounts of its masks. A column that is filled to f answers a foreign
n-gram with probability f ** HASHES, so c = (hits - n * fp) / (1 - fp) of the n asked are
expected to be real; the language with the largest c is the prediction and the score is its
share of the two largest, c1 / (c1 + c2).

Defined results: null texts and texts without a letter are ``und`` with score 0, as is every
text where no language can be learned; texts that hit no profile get the language with the most
training letters and score 0; ties go to that order, too. Rows without an id are never held
out and teach nothing. Letters are Unicode letters, words are runs of them, in lower case.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import column, free_name, written

SIZES = (1, 2, 3, 4)
RATIO = 0.2
PROFILE = 65_536
MIN_COUNT = 2
HASHES = 3
ROWS = 1 << 20  # of the filter; a power of two
HELD_OUT = 2
UNKNOWN = "und"
STRETCH = 1 << 18  # characters worked on at once
MEMO = 1 << 17  # words counted before they are handed on
LETTERS = re.compile(r"[^\W\d_]+")
BREAK = re.compile(r"[\W\d_]")
FACTOR = np.uint64(0x9E3779B97F4A7C15)  # any odd number: it only spreads the hash


def stretches(text: str, size: int = STRETCH) -> Iterator[str]:
    """The text in pieces of at least ``size`` characters, cut where no word is cut."""
    at = 0
    while at < len(text):
        end = BREAK.search(text, at + size) if len(text) - at > size else None
        to = end.start() if end else len(text)
        yield text[at:to]
        at = to


def words_of(piece: str) -> list[str]:
    return LETTERS.findall(piece.lower())


def in_lots(values: Iterator, size, most: int = STRETCH) -> Iterator[list]:
    """Lists of values whose sizes together reach ``most``."""
    lot, held = [], 0
    for value in values:
        lot.append(value)
        held += size(value)
        if held >= most:
            yield lot
            lot, held = [], 0
    if lot:
        yield lot


def spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, word number) of every n-gram of every word, borders being blanks."""
    points = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    blank = points == 32
    owner = np.cumsum(blank) - 1
    hashes, numbers = [], []
    rolled = np.zeros(len(points), dtype=np.uint64)
    inner = np.zeros(len(points), dtype=np.int64)  # blanks strictly inside the window
    for n in range(1, max(SIZES) + 1):
        size = len(points) - n + 1
        if size <= 0:
            break
        if n > 2:
            inner = inner[:size] + blank[n - 2:n - 2 + size]
        rolled = rolled[:size] * FACTOR + points[n - 1:n - 1 + size]
        if n in SIZES:
            good = ~blank if n == 1 else inner[:size] == 0
            hashes.append(spread(rolled[good] ^ np.uint64(n << 56)))
            numbers.append(owner[:size][good])
    return np.concatenate(hashes), np.concatenate(numbers)


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, n) over (lang, text)."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()),
                                               pa.array(list(seen.values()), pa.int64())], ["lang", "word", "n"])
            seen.clear()
            return made

        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text")):
                lang = lang.as_py()
                for piece in stretches(text.as_py()):
                    seen.update((lang, word) for word in words_of(piece))
                    if len(seen) >= MEMO:
                        yield out()
        yield out()

    return texts.mapInArrow(counted, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def gram_counts(words: DataFrame) -> DataFrame:
    """(lang, gram, n): n-grams by their hash, over (lang, word, n)."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("lang").to_pylist(), batch.column("word").to_pylist(), batch.column("n").to_pylist())
            for lot in in_lots(rows, lambda row: len(row[1])):
                for lang in sorted({row[0] for row in lot}):
                    mine = [row for row in lot if row[0] == lang]
                    found, owner = grams([row[1] for row in mine])
                    distinct, at = np.unique(found, return_inverse=True)
                    n = np.bincount(at, weights=np.array([row[2] for row in mine], dtype=np.float64)[owner], minlength=len(distinct))
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(distinct)), pa.array(distinct.view(np.int64)),
                                                      pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    return words.mapInArrow(counted, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def positions(gram: Column) -> Column:
    """The filter rows of an n-gram; ``SlicedFilter.masks`` computes the same."""
    low, high = gram.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(gram, 32).bitwiseOR(F.lit(1))
    return F.array(*[(low + i * high).bitwiseAND(F.lit(ROWS - 1)).cast("int") for i in range(HASHES)])


class SlicedFilter:
    """langs: names in order of preference; slices: (rows, bytes) of language bits, little
    end first."""

    def __init__(self, langs: list[str], rows: np.ndarray, numbers: np.ndarray, masks: np.ndarray) -> None:
        self.langs = langs
        words = max(1, -(-len(langs) // 64))
        table = np.zeros((ROWS, words), dtype="<u8")
        table[rows, numbers] = masks.view(np.uint64)
        self.slices = np.ascontiguousarray(table.view(np.uint8)[:, :max(1, -(-len(langs) // 8))])
        filled = np.zeros(len(langs), dtype=np.int64)
        for lo in range(0, ROWS, 1 << 16):
            filled += self.bits(self.slices[lo:lo + (1 << 16)]).sum(axis=0, dtype=np.int64)
        self.false_rate = (filled / ROWS) ** HASHES

    def bits(self, masks: np.ndarray) -> np.ndarray:
        return np.unpackbits(masks, axis=1, bitorder="little")[:, :len(self.langs)]

    def masks(self, found: np.ndarray) -> np.ndarray:
        low, high = found & np.uint64(0xFFFFFFFF), (found >> np.uint64(32)) | np.uint64(1)
        out = self.slices[low & np.uint64(ROWS - 1)]
        for i in range(1, HASHES):
            out &= self.slices[(low + np.uint64(i) * high) & np.uint64(ROWS - 1)]
        return out

    def hits(self, words: list[str]) -> np.ndarray:
        """Per word: hits per language, then the number of n-grams asked."""
        out = np.zeros((len(words), len(self.langs) + 1))
        if words:
            found, owner = grams(words)
            hit = self.bits(self.masks(found))
            for k in range(len(self.langs)):
                out[:, k] = np.bincount(owner, weights=hit[:, k], minlength=len(words))
            out[:, -1] = np.bincount(owner, minlength=len(words))
        return out

    def decide(self, sums: np.ndarray) -> tuple[str, float]:
        asked = sums[-1]
        real = np.maximum((sums[:-1] - asked * self.false_rate) / np.maximum(1 - self.false_rate, 1e-9), 0.0)
        order = np.lexsort((np.arange(len(real)), -real))
        if real[order[0]] <= 0:
            return self.langs[0], 0.0
        rest = real[order[1]] if len(order) > 1 else 0.0
        return self.langs[order[0]], float(real[order[0]] / (real[order[0]] + rest))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        sums = np.zeros((len(texts), len(self.langs) + 1))
        letters = np.zeros(len(texts), dtype=bool)
        pieces = ((i, piece) for i, text in enumerate(texts) for piece in stretches(text or ""))
        for lot in in_lots(pieces, lambda p: len(p[1])):
            index: dict[str, int] = {}
            numbers = [(i, [index.setdefault(w, len(index)) for w in words_of(piece)]) for i, piece in lot]
            distinct = list(index)
            known = self.hits(distinct)
            lettered = np.array([w.isalpha() or any(map(str.isalpha, w)) for w in distinct], dtype=bool)
            for i, at in numbers:
                if at:
                    sums[i] += known[at].sum(axis=0)
                    letters[i] |= lettered[at].any()
        return [self.decide(s) if has and self.langs else (UNKNOWN, 0.0) for s, has in zip(sums, letters)]


def is_held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def fit_filter(texts: DataFrame, ratio: float = RATIO, profile: int = PROFILE) -> SlicedFilter:
    """The filter of (lang, text) rows, neither null. One number per language and at most
    ``ROWS`` filter rows come to the driver."""
    counts = written(gram_counts(written(word_counts(texts))))
    totals = counts.groupBy("lang").agg(F.sum("n").cast("bigint").alias("total"))
    found = sorted(((-r["total"], r["lang"]) for r in totals.collect()))  # one row per language
    langs = [lang for _, lang in found]
    if not langs:
        return SlicedFilter([], np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
    known = texts.sparkSession.createDataFrame([(lang, i, float(-n)) for i, (n, lang) in enumerate(found)], "lang string, number int, total double")
    shares = counts.join(F.broadcast(known), "lang").select("gram", F.struct("number", "n", (F.col("n") / F.col("total")).alias("share")).alias("x"))
    per_gram = shares.groupBy("gram").agg(F.collect_list("x").alias("xs"))  # at most one entry per language
    top = F.array_max(F.transform("xs", lambda x: x["share"]))
    owned = written(per_gram.select("gram", F.explode(F.filter("xs", lambda x: (x["share"] >= ratio * top) & (x["n"] >= MIN_COUNT))).alias("x"))
                    .select("gram", F.col("x.number").alias("number"), F.col("x.n").alias("n")))
    # the count from which a language's n-grams number at most ``profile``: from a histogram of counts
    steps = owned.groupBy("number", "n").agg(F.count(F.lit(1)).alias("grams"))
    above = Window.partitionBy("number").orderBy(F.col("n").desc())
    least = steps.withColumn("kept", F.sum("grams").over(above)).filter(F.col("kept") <= profile).groupBy("number").agg(F.min("n").alias("least"))
    chosen = owned.join(F.broadcast(least), "number").filter(F.col("n") >= F.col("least"))
    bit = F.expr("shiftleft(1L, number % 64)")
    rows = (chosen.select(F.explode(positions(F.col("gram"))).alias("p"), F.floor(F.col("number") / 64).cast("int").alias("w"), bit.alias("bit"))
            .groupBy("p", "w").agg(F.bit_or("bit").alias("mask")).toArrow())
    return SlicedFilter(langs, *(rows.column(c).to_numpy() for c in ("p", "w", "mask")))


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                       out: str = "language") -> DataFrame:
    """``docs`` with a struct ``out``: held_out, lang_pred, score. Learns from the rows that
    are not held out and have a language and a text."""
    out, held = free_name(docs, out), is_held_out(column(docs, id_col))
    learn = column(docs, id_col).isNotNull() & ~held
    texts = docs.filter(learn).select(column(docs, lang_col).cast("string").alias("lang"), column(docs, text_col).cast("string").alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(fit_filter(texts.filter("lang IS NOT NULL AND text IS NOT NULL")))

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = []
            for lo in range(0, len(batch), 256):
                found += model.value.predict(batch.slice(lo, 256).to_pylist())
            yield pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                                             ["lang_pred", "score"])

    p = free_name(docs, "language_found")
    with_p = docs.withColumn(p, predicted(column(docs, text_col).cast("string")))
    return with_p.withColumn(out, F.struct(held.alias("held_out"), F.col(p)["lang_pred"].alias("lang_pred"), F.col(p)["score"].alias("score"))).drop(p)
