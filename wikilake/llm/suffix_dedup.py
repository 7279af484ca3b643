"""Suffix-array dedup: bytes covered by a string of ``LENGTH`` bytes that also starts in a
document with a smaller id are removed.

Every start of such a string (a window) is compared with all windows of the table:

1. Batches. Documents are cut into batches of about ``BATCH_CHARS`` characters and written
   once, compressed; equal texts of a batch are held once, with their smallest id.
2. Anchors. A window's anchor is the smallest hash of its ``GRAM``-byte grams, so equal
   windows have equal anchors. Neighbouring windows with one anchor form a segment. Each
   batch sends its distinct anchors, a few bytes each, to buckets by value; an anchor met
   in only one text needs no more work, and one bit or two per anchor come back.
3. Suffix arrays. The distinct segments of the other anchors travel to their bucket, each
   with the smallest id of its batch. A bucket puts the segments of an anchor side by
   side and sorts their suffixes (``lyndon.suffix_array``: descending groups, previous
   smaller pointers, second phase without renaming); suffixes that agree in ``LENGTH``
   bytes are neighbours, and the smallest id of each such class goes back to the batches.
   An anchor with one distinct segment needs no sorting, nor does a segment that differs
   from all others of its anchor on each of the stretches beside the anchor of which an
   equal window would hold at least one.
4. Removal. A batch covers the windows whose class has a smaller id than the document.

Scale: no text leaves its batch but the segments of shared anchors. An anchor with more
than ``HOT`` distinct segments is cut into single windows that are dealt by their own hash,
so a common phrase is not one task; copies meet as one text per batch and one segment per
bucket. Batches and buckets are bounded and their number grows with the input.

Defined results: null text counts as empty; a null id counts as larger than every other;
rows with equal ids do not remove from each other; texts shorter than a window keep all
bytes; spans are in bytes, may cut a character, and touching spans are one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, free_name, shuffle_width, written
from .lyndon import suffix_array
from .packing import pack, squeeze, unpack, unsqueeze

LENGTH = 50
GRAM = 24
BATCH_CHARS = 1 << 22
BYTES_PER_BUCKET = 1 << 24
SLICE = 1 << 19
#: Windows a segment may have; a longer run of one anchor is several segments.
LONGEST = 256
HOT = 8192
#: Suffixes are sorted in strings of about this many bytes (whole anchors).
SORTED_BYTES = 1 << 12
LAST_ID = (1 << 63) - 1
#: A window has r bytes before its anchor and LENGTH - GRAM - r after it. For each range of r
#: the bytes (before, after) that all its windows hold; equal windows agree on one of them.
ROOM = LENGTH - GRAM
CUTS = [i * (ROOM + 1) // 4 for i in range(5)]
BESIDE = [(low, ROOM - (high - 1)) for low, high in zip(CUTS, CUTS[1:])]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def combined(first: np.ndarray, n: int, step: int, join) -> np.ndarray:
    """Every run of ``n`` neighbours of ``first`` joined, by doubling."""
    done, width = first, step
    while 2 * width <= n:
        done = join(done[:-width], done[width:])
        width *= 2
    return join(done[:len(done) - (n - width)], done[n - width:]) if width < n else done


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of every ``GRAM``-byte gram."""
    base = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        done, power, width = data.astype(np.uint64) + np.uint64(1), np.array([base]), 1
        parts: list[tuple[int, np.ndarray]] = []
        left = GRAM
        while True:
            if left & width:
                parts.append((width, done))
                left -= width
            if not left:
                break
            done = done[:-width] * power + done[width:]
            power, width = power * power, 2 * width
        n, at = len(data) - GRAM + 1, 0
        total = np.zeros(n, dtype=np.uint64)
        for width, h in parts:
            total = mixed(total + np.uint64(width)) + h[at:at + n]
            at += width
        return mixed(total)


def segments(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer of all texts, start, number of windows, anchor) of the segments."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    ends = np.cumsum([len(t) for t in texts]) if texts else np.empty(0, dtype=np.int64)
    starts = ends - np.array([len(t) for t in texts], dtype=np.int64) if texts else ends
    valid = np.zeros(len(data) + 1, dtype=np.int8)
    full = ends - starts >= LENGTH
    np.add.at(valid, starts[full], 1)
    np.add.at(valid, ends[full] - LENGTH + 1, -1)
    valid = np.cumsum(valid[:-1], dtype=np.int8).astype(bool)
    found = []
    for a in range(0, len(data) - LENGTH + 1, SLICE):
        b = min(a + SLICE, len(data) - LENGTH + 1)
        least = combined(gram_hashes(data[a:b + LENGTH - 1]), LENGTH - GRAM + 1, 1, np.minimum)
        ok = valid[a:b]
        change = np.ones(b - a, dtype=bool)
        change[1:] = (least[1:] != least[:-1]) | ~ok[:-1]
        first = np.flatnonzero(change & ok)
        last = np.ones(b - a, dtype=bool)
        last[:-1] = change[1:] | ~ok[1:]
        n = np.flatnonzero(last & ok) - first + 1
        found.append((first + a, n, mixed(least[first])))
    if not found:
        empty = np.empty(0, dtype=np.int64)
        return data, empty, empty, empty.astype(np.uint64)
    first, n, anchor = (np.concatenate(x) for x in zip(*found))
    pieces = -(-n // LONGEST)
    if len(n) and pieces.max() > 1:
        which = np.repeat(np.arange(len(n)), pieces)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first, n, anchor = first[which] + nth * LONGEST, np.minimum(n[which] - nth * LONGEST, LONGEST), anchor[which]
    return data, first, n, anchor


class Batch:
    """One batch row: its distinct texts and their smallest ids."""

    def __init__(self, texts: bytes, sizes: bytes, ids: bytes) -> None:
        whole, at = unsqueeze(texts), 0
        self.texts = []
        for n in unpack(sizes).tolist():
            self.texts.append(whole[at:at + n])
            at += n
        self.ids = np.frombuffer(ids, dtype=np.int64)
        self.data, self.start, self.n, self.anchor = segments(self.texts)
        ends = np.cumsum([len(t) for t in self.texts])
        self.text = np.searchsorted(ends, self.start, side="right")

    def keys(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct anchors of ``bits`` bits, and each segment's place among them."""
        return np.unique(self.anchor >> np.uint64(64 - bits), return_inverse=True)


def bucket_of(keys: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    top = keys >> np.uint64(bits - 32) if bits >= 32 else keys << np.uint64(32 - bits)
    return ((top & np.uint64(0xFFFFFFFF)) * np.uint64(buckets)) >> np.uint64(32)


def slices(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of a sorted array of bucket numbers."""
    cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
    for a, b in zip(cuts, cuts[1:]):
        if a < b:
            yield int(bucket[a]), a, b


def ask_anchors(batch: Batch, bits: int, buckets: int) -> Iterator[tuple[int, bytes]]:
    """Per bucket the batch's anchors: gaps, distinct segments each has, and whether two
    texts of the batch have it."""
    keys, place = batch.keys(bits)
    if not len(keys):
        return
    several = np.zeros(len(keys), dtype=np.uint8)
    order = np.argsort(place, kind="stable")
    p, t = place[order], batch.text[order]
    several[p[1:][(p[1:] == p[:-1]) & (t[1:] != t[:-1])]] = 1
    # a fingerprint of a segment is enough to count the distinct ones
    edges = np.minimum(batch.start[:, None] + np.arange(0, LENGTH, 7)[None, :], len(batch.data) - 1)
    tail = np.maximum(batch.start + batch.n + LENGTH - 2, 0)[:, None] - np.arange(0, LENGTH, 7)[None, :]
    print_ = np.concatenate([batch.data[edges], batch.data[np.maximum(tail, 0)]], axis=1).astype(np.uint64)
    mark = (print_ * (mixed(np.arange(print_.shape[1], dtype=np.uint64) + np.uint64(1)) | np.uint64(1))).sum(axis=1) + batch.n.astype(np.uint64)
    pairs = np.unique(np.stack([place.astype(np.uint64), mark]), axis=1)[0].astype(np.int64)
    count = np.bincount(pairs, minlength=len(keys))
    for k, a, b in slices(bucket_of(keys, bits, buckets)):
        gaps = np.diff(keys[a:b], prepend=np.uint64(0))
        yield k, bundle(pack(gaps), pack(count[a:b]), several[a:b].tobytes())


def bundle(*parts: bytes) -> bytes:
    return squeeze(b"".join(len(x).to_bytes(4, "little") + x for x in parts))


def parts_of(data: bytes) -> list[bytes]:
    raw, at, out = unsqueeze(data), 0, []
    while at < len(raw):
        n = int.from_bytes(raw[at:at + 4], "little")
        out.append(raw[at + 4:at + 4 + n])
        at += 4 + n
    return out


def answer_anchors(blobs: list[bytes], hot: int = HOT) -> list[bytes]:
    """For each blob one byte per anchor: 0 in one text only, 1 shared, 2 shared and hot."""
    keys, counts, several = [], [], []
    for blob in blobs:
        gaps, count, more = parts_of(blob)
        keys.append(np.cumsum(unpack(gaps).view(np.uint64)))
        counts.append(unpack(count))
        several.append(np.frombuffer(more, dtype=np.uint8))
    _, place, seen = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    total = np.bincount(place, weights=np.concatenate(counts))
    code = ((seen > 1) | (np.bincount(place, weights=np.concatenate(several)) > 0)).astype(np.uint8)
    code[(code > 0) & (total > hot)] = 2
    out, at = [], 0
    for k in keys:
        out.append(squeeze(code[place[at:at + len(k)]].tobytes()))
        at += len(k)
    return out


class Plan:
    """The distinct segments that a batch sends, and where each of them stands."""

    def __init__(self, batch: Batch, codes: dict[int, bytes], bits: int, buckets: int) -> None:
        keys, place = batch.keys(bits)
        code = np.zeros(len(keys), dtype=np.uint8)
        for k, a, b in slices(bucket_of(keys, bits, buckets)) if len(keys) else ():
            code[a:b] = np.frombuffer(unsqueeze(codes[k]), dtype=np.uint8)
        code = code[place]
        start, n, anchor, text = (x[code == 1] for x in (batch.start, batch.n, batch.anchor, batch.text))
        if (code == 2).any():
            hot_start, hot_n, hot_text = (x[code == 2] for x in (batch.start, batch.n, batch.text))
            which = np.repeat(np.arange(len(hot_n)), hot_n)
            each = hot_start[which] + np.arange(len(which)) - np.repeat(np.cumsum(hot_n) - hot_n, hot_n)
            view = np.lib.stride_tricks.sliding_window_view(batch.data, LENGTH)
            weight = mixed(np.arange(LENGTH, dtype=np.uint64) + np.uint64(7)) | np.uint64(1)
            own = np.concatenate([mixed((view[each[i:i + SLICE]].astype(np.uint64) * weight).sum(axis=1))
                                  for i in range(0, len(each), SLICE)])
            start, n = np.concatenate([start, each]), np.concatenate([n, np.ones(len(each), dtype=n.dtype)])
            anchor, text = np.concatenate([anchor, own]), np.concatenate([text, hot_text[which]])
        self.start, self.n, self.text = start, n, text
        whole = batch.data.tobytes()
        at: dict[tuple[int, bytes], int] = {}
        self.number = np.array([at.setdefault((k, whole[s:s + m]), len(at)) for k, s, m in zip(
            anchor.tolist(), start.tolist(), (n + LENGTH - 1).tolist())], dtype=np.int64)
        self.least = np.full(len(at), LAST_ID, dtype=np.int64)
        np.minimum.at(self.least, self.number, batch.ids[text])
        self.pieces = [s for _, s in at]
        self.keys = np.array([k for k, _ in at], dtype=np.uint64)
        self.order = np.argsort(self.keys, kind="stable")
        self.buckets = bucket_of(self.keys[self.order], 64, buckets)

    def asks(self) -> Iterator[tuple[int, bytes]]:
        for k, a, b in slices(self.buckets):
            mine = self.order[a:b]
            pieces = [self.pieces[i] for i in mine]
            yield k, bundle(self.keys[mine].tobytes(), pack(np.array([len(p) for p in pieces])), self.least[mine].tobytes(),
                            b"".join(pieces))

    def window_ids(self, answers: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(first window of each distinct segment, smallest id of every window's class)."""
        sizes = np.array([len(p) - LENGTH + 1 for p in self.pieces], dtype=np.int64)
        first = np.zeros(len(sizes), dtype=np.int64)
        first[self.order] = np.cumsum(sizes[self.order]) - sizes[self.order]
        parts = []
        for k, _, _ in slices(self.buckets):
            runs, ids = parts_of(answers[k])
            parts.append(np.repeat(np.frombuffer(ids, dtype=np.int64), unpack(runs)))
        return first, np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)


def window_classes(pieces: list[bytes], ids: list[int]) -> np.ndarray:
    """For all windows of the pieces in order, the smallest id among the pieces that have
    the window, from the suffix array of the pieces."""
    text: list[int] = []
    starts, own = [], []
    for p, i in zip(pieces, ids):
        starts.append(np.arange(len(text), len(text) + len(p) - LENGTH + 1))
        own.append(np.full(len(p) - LENGTH + 1, i, dtype=np.int64))
        text += p
        text.append(-1)  # below every byte
    starts, own = np.concatenate(starts), np.concatenate(own)
    at = np.full(len(text), -1, dtype=np.int64)
    at[starts] = np.arange(len(starts))
    order = at[np.array(suffix_array(text), dtype=np.int64)]
    order = order[order >= 0]  # windows in the order of their suffixes
    view = np.lib.stride_tricks.sliding_window_view(np.array(text, dtype=np.int16), LENGTH)
    sorted_windows = view[starts[order]]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (sorted_windows[1:] != sorted_windows[:-1]).any(axis=1)
    least = np.minimum.reduceat(own[order], np.flatnonzero(new))
    out = np.empty(len(order), dtype=np.int64)
    out[order] = least[np.cumsum(new) - 1]
    return out


def anchors_in(pieces: list[bytes]) -> np.ndarray:
    """Where each piece's anchor begins; -1 where its gram occurs more than once."""
    sizes = np.array([len(p) for p in pieces])
    first = np.cumsum(sizes) - sizes
    grams = np.append(gram_hashes(np.frombuffer(b"".join(pieces), dtype=np.uint8)), np.uint64(0xFFFFFFFFFFFFFFFF))
    ends = first + sizes - GRAM + 1
    least = np.minimum.reduceat(grams, np.stack([first, ends], axis=1).ravel())[::2]
    n = ends - first
    which = np.repeat(np.arange(len(pieces)), n)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    hit = grams[first[which] + nth] == least[which]
    out = np.zeros(len(pieces), dtype=np.int64)
    out[which[hit]] = nth[hit]
    out[np.bincount(which[hit], minlength=len(pieces)) != 1] = -1
    return out


def may_share(pieces: list[bytes], at: list[int]) -> list[int]:
    """Numbers of the pieces of one anchor that can have a window in common with another."""
    if min(at) < 0:
        return list(range(len(pieces)))
    beside = []
    for p, a in zip(pieces, at):
        b = a + GRAM
        beside.append([(k, p[a - before:a], p[b:b + after]) for k, (before, after) in enumerate(BESIDE)
                       if a >= before and len(p) - b >= after])
    seen = Counter(x for mine in beside for x in mine)
    return [i for i, mine in enumerate(beside) if any(seen[x] > 1 for x in mine)]


def answer_segments(blobs: list[bytes]) -> list[bytes]:
    """For each blob, per window of its segments, the smallest id of the window's class
    over all blobs, run-length coded."""
    at: dict[tuple[int, bytes], int] = {}
    numbers, ids = [], []
    for blob in blobs:
        keys, sizes, least, whole = parts_of(blob)
        cuts = np.cumsum(unpack(sizes)).tolist()
        numbers.append(np.array([at.setdefault((k, whole[a:b]), len(at)) for k, a, b in zip(
            np.frombuffer(keys, dtype=np.uint64).tolist(), [0, *cuts], cuts)], dtype=np.int64))
        ids.append(np.frombuffer(least, dtype=np.int64))
    smallest = np.full(len(at), LAST_ID, dtype=np.int64)
    np.minimum.at(smallest, np.concatenate(numbers), np.concatenate(ids))
    pieces = [p for _, p in at]
    keys = np.array([k for k, _ in at], dtype=np.uint64)
    n = np.array([len(p) - LENGTH + 1 for p in pieces], dtype=np.int64)
    order = np.argsort(keys, kind="stable")
    first = np.zeros(len(n), dtype=np.int64)
    first[order] = np.cumsum(n[order]) - n[order]
    classes = np.repeat(smallest[order], n[order])
    held: list[int] = []
    size = 0

    def sort_held() -> None:
        found = window_classes([pieces[i] for i in held], smallest[held].tolist())
        where = np.concatenate([np.arange(first[i], first[i] + n[i]) for i in held])
        classes[where] = found

    several = [order[a:b].tolist() for _, a, b in slices(keys[order]) if b - a > 1]
    for lot in range(0, len(several), 4096):
        lots = several[lot:lot + 4096]
        places = anchors_in([pieces[i] for mine in lots for i in mine]).tolist()
        at_lot = 0
        for mine in lots:
            chosen = may_share([pieces[i] for i in mine], places[at_lot:at_lot + len(mine)])
            at_lot += len(mine)
            held += [mine[i] for i in chosen]
            size += sum(len(pieces[mine[i]]) for i in chosen)
            if size >= SORTED_BYTES:
                sort_held()
                held, size = [], 0
    if held:
        sort_held()
    out = []
    for number in numbers:
        m = n[number]
        each = classes[np.repeat(first[number] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))]
        change = np.flatnonzero(np.concatenate([[True], each[1:] != each[:-1]]))
        runs = pack(np.diff(np.append(change, len(each))))
        out.append(bundle(runs, each[change].tobytes()))
    return out


def covered(batch: Batch, plan: Plan, answers: dict[int, bytes]) -> np.ndarray:
    """Which bytes of the batch's buffer are removed."""
    first, ids = plan.window_ids(answers)
    which = np.repeat(np.arange(len(plan.n)), plan.n)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(plan.n) - plan.n, plan.n)
    gone = ids[first[plan.number[which]] + nth] < batch.ids[plan.text[which]]
    at = (plan.start[which] + nth)[gone]
    edge = np.zeros(len(batch.data) + 1, dtype=np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + LENGTH, -1)
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None,
                   out: str = "dedup", batch_chars: int = BATCH_CHARS, hot: int = HOT) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all by default) with a struct ``out``: n_bytes,
    n_removed, spans (array of start, end in bytes) and kept (binary)."""
    spark = docs.sparkSession
    keep = docs.columns if keep is None else keep
    out = free_name(docs, out)
    names = [f"c{i}" for i in range(len(keep))]
    text = F.coalesce(column(docs, text_col).cast("string"), F.lit(""))
    rows = docs.select(*[column(docs, c).alias(n) for c, n in zip(keep, names)],
                       F.coalesce(column(docs, id_col).cast("bigint"), F.lit(LAST_ID)).alias("id"), text.alias("text"))
    given = rows.select(*names).schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            texts, ids = [t.encode() for t in got.column("text").to_pylist()], got.column("id").to_numpy()
            start = size = 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= batch_chars or i == len(texts) - 1:
                    yield one(got, texts[start:i + 1], ids[start:i + 1], start, i + 1)
                    start, size = i + 1, 0

    def one(got: pa.RecordBatch, texts: list[bytes], ids: np.ndarray, a: int, b: int) -> pa.RecordBatch:
        at: dict[bytes, int] = {}
        which = np.array([at.setdefault(t, len(at)) for t in texts], dtype=np.int64)
        least = np.full(len(at), LAST_ID, dtype=np.int64)
        np.minimum.at(least, which, ids)
        sink = pa.BufferOutputStream()
        rest = pa.RecordBatch.from_arrays([*[got.column(c).slice(a, b - a) for c in names], pa.array(ids), pa.array(which)],
                                          [*names, "id", "which"])
        with pa.ipc.new_stream(sink, rest.schema) as writer:
            writer.write_batch(rest)
        return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (
            squeeze(sink.getvalue().to_pybytes()), squeeze(b"".join(at)), pack(np.array([len(t) for t in at])), least.tobytes())]
            + [pa.array([sum(map(len, at))], pa.int64())], ["rest", "texts", "sizes", "ids", "n"])

    batches = written(rows.mapInArrow(cut, "rest binary, texts binary, sizes binary, ids binary, n bigint").withColumn(
        "batch", F.monotonically_increasing_id()))
    total = batches.agg(F.sum("n")).first()[0] or 0
    buckets = shuffle_width(spark, total, BYTES_PER_BUCKET)
    bits = min(64, max(32, total.bit_length() + 14))  # anchors that clash by chance only cost work
    held = batches.select("batch", "texts", "sizes", "ids")

    def batch_of(table) -> Batch:
        return Batch(*(table.column(c)[0].as_py() for c in ("texts", "sizes", "ids")))

    def ask(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows_ in got:
            for i in range(len(rows_)):
                row = rows_.slice(i, 1)
                asked = list(ask_anchors(batch_of(row), bits, buckets))
                yield pa.RecordBatch.from_arrays([
                    pa.array([row.column("batch")[0].as_py()] * len(asked), pa.int64()), pa.array([k for k, _ in asked], pa.int32()),
                    pa.array([x for _, x in asked], pa.binary())], ["batch", "bucket", "blob"])

    def answering(answer):
        def group(asked: pa.Table) -> pa.Table:
            found = answer(asked.column("blob").to_pylist())
            return asked.select(["batch", "bucket"]).append_column("blob", pa.array(found, pa.binary()))
        return group

    blobs = "batch bigint, bucket int, blob binary"
    codes = written(held.mapInArrow(ask, blobs).groupBy("bucket").applyInArrow(answering(lambda x: answer_anchors(x, hot)), blobs))

    def by_kind(answers: pa.Table, kind: int) -> dict[int, bytes]:
        return {k: x for k, x, q in zip(*(answers.column(c).to_pylist() for c in ("bucket", "blob", "kind"))) if q == kind}

    def send(mine: pa.Table, answers: pa.Table) -> pa.Table:
        batch = batch_of(mine)
        asked = list(Plan(batch, by_kind(answers, 0), bits, buckets).asks())
        return pa.table({"batch": pa.array([mine.column("batch")[0].as_py()] * len(asked), pa.int64()),
                         "bucket": pa.array([k for k, _ in asked], pa.int32()), "blob": pa.array([x for _, x in asked], pa.binary())})

    first = codes.withColumn("kind", F.lit(0))
    sent = held.groupBy("batch").cogroup(first.groupBy("batch")).applyInArrow(send, blobs)
    second = sent.groupBy("bucket").applyInArrow(answering(answer_segments), blobs).withColumn("kind", F.lit(1))

    schema = T.StructType([*given, T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
                           T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()),
                                                                            T.StructField("end", T.LongType())]))),
                           T.StructField("kept", T.BinaryType())])
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def remove(mine: pa.Table, answers: pa.Table) -> pa.Table:
        batch = batch_of(mine)
        plan = Plan(batch, by_kind(answers, 0), bits, buckets)
        gone = covered(batch, plan, by_kind(answers, 1))
        texts, at = [], 0
        for t in batch.texts:
            mask = gone[at:at + len(t)]
            edges = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0)).tolist()
            spans = [{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2])]
            texts.append((int(mask.sum()), spans, batch.data[at:at + len(t)][~mask].tobytes()))
            at += len(t)
        rest = pa.ipc.open_stream(unsqueeze(mine.column("rest")[0].as_py())).read_all()
        n, removed, spans, kept = [], [], [], []
        for i, own in zip(rest.column("which").to_pylist(), rest.column("id").to_pylist()):
            size = len(batch.texts[i])
            found = texts[i]
            if own > batch.ids[i] and size >= LENGTH:  # an equal text of this batch has a smaller id
                found = (size, [{"start": 0, "end": size}], b"")
            n.append(size)
            removed.append(found[0])
            spans.append(found[1])
            kept.append(found[2])
        return pa.table([*[rest.column(c) for c in names], pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
                         pa.array(spans, span_type), pa.array(kept, pa.binary())],
                        names=[*names, "n_bytes", "n_removed", "spans", "kept"])

    answers = first.unionByName(second)
    found = batches.select("batch", "rest", "texts", "sizes", "ids").groupBy("batch").cogroup(
        answers.groupBy("batch")).applyInArrow(remove, schema)
    return found.select(*[F.col(n).alias(c) for c, n in zip(keep, names)],
                        F.struct("n_bytes", "n_removed", "spans", "kept").alias(out))
