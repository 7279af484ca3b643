"""Line hunks against a recursive patience alignment, and as an exact round trip."""

import random

from pyspark.sql import functions as F

from wikilake.operators.linediff import apply_hunks, line_hunks, longest_increasing


def patience(a, b):
    """Matched (i, j) pairs, by recursion over lists."""
    def go(alo, ahi, blo, bhi):
        found = []
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            found.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            found.append((ahi, bhi))
        x, y = a[alo:ahi], b[blo:bhi]
        once = [(alo + i, blo + y.index(v)) for i, v in enumerate(x) if x.count(v) == 1 and y.count(v) == 1]
        keep = [once[k] for k in longest_increasing([j for _, j in once])]
        if keep:
            edges = [(alo - 1, blo - 1), *keep, (ahi, bhi)]
            for (i, j), (i2, j2) in zip(edges, edges[1:]):
                found += go(i + 1, i2, j + 1, j2)
            found += keep
        return found
    return sorted(go(0, len(a), 0, len(b)))


def hunks_of(a, b):
    pairs = [(-1, -1), *patience(a, b), (len(a), len(b))]
    out = []
    for (i, j), (i2, j2) in zip(pairs, pairs[1:]):
        if i2 - i > 1 or j2 - j > 1:
            out.append((len(out), i + 1, j + 1, a[i + 1:i2], b[j + 1:j2]))
    return out


def cases():
    rnd = random.Random(9)
    out = [("a\nb\nc", "a\nb\nc"), ("", "x"), ("x", ""), (None, "x\ny"), ("x\ny", None), (None, None), ("a\nb", "b\na"), ("", ""),
           ("a\na\na", "a\na"), ("\n\n", "\n"), ("a\nX\nb\nY\nc", "a\nY\nb\nX\nc"), ("same\n" * 40 + "end", "same\n" * 39 + "end")]
    for _ in range(60):
        a = [rnd.choice("abcdefgh") + str(rnd.randrange(6)) * rnd.randrange(2) for _ in range(rnd.randrange(40))]
        b = list(a)
        for _ in range(rnd.randrange(12)):
            k = rnd.randrange(len(b) + 1)
            move = rnd.randrange(3)
            if move == 0:
                b.insert(k, rnd.choice(["", "new", "a0", "zz"]))
            elif b and move == 1:
                b.pop(k % len(b))
            elif b:
                b.insert(k % len(b), b.pop(rnd.randrange(len(b))))
        out.append(("\n".join(a), "\n".join(b)))
    return out


def test_hunks_are_the_patience_alignment_and_rebuild_the_text(spark):
    rows = [(i, a, b) for i, (a, b) in enumerate(cases())]
    pairs = spark.createDataFrame(rows, "id int, before string, after string").repartition(4)
    hunks = line_hunks(pairs, ["id"], "before", "after")
    got = {}
    for r in hunks.collect():
        got.setdefault(r.id, []).append((r.hunk, r.old_start, r.new_start, r.removed, r.added))
    for i, a, b in rows:
        expect = hunks_of([] if a is None else a.split("\n"), [] if b is None else b.split("\n")) if a != b else []
        assert sorted(got.get(i, [])) == expect, (a, b)
    made = apply_hunks(pairs, hunks, ["id"], "before").collect()
    assert len(made) == len(rows) and all(r.rebuilt == r.after for r in made)


def test_empty_table_has_no_hunks(spark):
    none = spark.createDataFrame([], "id int, before string, after string")
    assert line_hunks(none, ["id"], "before", "after").count() == 0


def test_long_text_with_one_change(spark):
    lines = [f"line {i % 700}" for i in range(20000)]
    changed = lines[:9999] + ["other"] + lines[10000:]
    pairs = spark.createDataFrame([(1, "\n".join(lines), "\n".join(changed))], "id int, a string, b string")
    (h,) = line_hunks(pairs, ["id"], "a", "b").collect()
    assert (h.old_start, h.new_start, h.removed, h.added) == (9999, 9999, [lines[9999]], ["other"])
