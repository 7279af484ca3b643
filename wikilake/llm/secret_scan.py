"""Secret scans: pattern spans plus strings that a battery of randomness tests takes for keys.

Each whole text is searched for the three base patterns (all of their matches stay). Every
other run of at least ``MIN_RUN`` key characters is given an encoding (hex, base32,
letters, alphanumeric, base64, base64url) and three tests against uniform random symbols of that
encoding: chi-squared uniformity of the alphabet and of its character classes, a runs test
about the alphabet's middle, and lag-one serial correlation. Fisher's method joins them to
one p-value: large for keys, tiny for words.

Which p-values count as random is decided by a fixed null. ``word_run`` makes words that look
like runs: common words, words of syllables and digit groups (years, dates, counters),
joined plain, in camel case or by the encoding's signs. ``NULL_TAILS`` counts, per step of
``NULL_LENGTHS`` (at that length; longer words pass less easily) and encoding, how many of
``DECOYS`` such words reach each bound of the grid; that gives a run's p-value as a word, in
a corpus of any size. Per length class Benjamini-Hochberg at ``FDR`` over the runs of the
corpus decides. Only the counts per length, encoding and grid cell, a table of fixed size,
come to the driver. Runs of small letters alone are words, runs of digits alone numbers;
every other run is tested.

Spans are in code points, end exclusive, ordered by start, then kind (assign, access, hex,
random). Defined results: null or empty text has no spans; a run overlapping a base span is
not tested; repeated rows are scanned each; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, free_name, pieces, written

FDR = 0.01
MIN_RUN = 20
#: Lower ends of the length classes, and the grid of bounds on the joint p-value.
LENGTHS = (20, 28, 40, 64)
GRID = (0.0, 0.001, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9)
REDACTED = "[REDACTED]"

#: The base patterns. A run that is too short for its pattern is no match.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")

RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{%d,}(?:={0,2})(?![A-Za-z0-9+/_=-])" % MIN_RUN)
#: Encodings from narrow to wide: what a run must match, and its alphabet in classes.
UPPER, LOWER, DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ENCODINGS = (
    (re.compile("[0-9a-f]+"), (DIGIT, "abcdef")),
    (re.compile("[0-9A-F]+"), (DIGIT, "ABCDEF")),
    (re.compile("[A-Z2-7]+"), (UPPER, "234567")),
    (re.compile("[A-Za-z]+"), (UPPER, LOWER)),
    (re.compile("[A-Za-z0-9]+"), (DIGIT, UPPER, LOWER)),
    (re.compile("[A-Za-z0-9+/]+"), (DIGIT, UPPER, LOWER, "+/")),
    (re.compile("[A-Za-z0-9_-]+"), (DIGIT, UPPER, LOWER, "-_")),
    (re.compile("[A-Za-z0-9+/_-]+"), (DIGIT, UPPER, LOWER, "+/", "-_")),
)
ALPHABETS = [({c: i for i, c in enumerate("".join(cs))}, {c: k for k, part in enumerate(cs) for c in part}, [len(x) for x in cs])
             for _, cs in ENCODINGS]

#: The parts of the null's words, and its tails: per length step and encoding
#: null_tail(step, encoding, DECOYS, 1), the words out of DECOYS at or above each bound of the grid.
WORDS = ("access account action active address admin agent alert array article asset author backup base batch block body book "
         "border buffer button cache call center change channel check class client close cloud code color column comment common "
         "config content control copy count create current data date default delete detail device digest direct document domain "
         "download edge element email enable encode entry error event export field file filter folder format frame function gallery "
         "general get global graph group handler header height history home html http image import index info input internal item "
         "javascript key label language layer length level library license link list load local lock manager map market master media "
         "member memory menu message method mobile model module name network news next node number object offset online open option "
         "order origin output package page panel parent password path phone photo picture player point policy port position post "
         "product profile project property public query queue random record region release report request resource response result "
         "root route sample schema screen script search section secure select server service session setting share source space "
         "stage start state static status storage stream string style summary support switch system table target task template test "
         "text thread thumb time title token total type update upload user utility value version video view website width window "
         "wikipedia world write").split()
HEX_WORDS = "ace added bad bead bed bee beef cab cafe dad dead deaf deed decade ebb facade face fade fed fee feed".split()
DECOYS = 25_000
NULL_LENGTHS = (20, 22, 24, 26, 28, 30, 32, 34, 36, 40, 48, 64)
NULL_TAILS = (
    (25000, 4667, 1920, 1341, 740, 406, 193, 111, 46, 18, 2),
    (25000, 3729, 1497, 1032, 559, 326, 168, 103, 40, 11, 1),
    (25000, 22853, 20486, 19179, 16525, 13458, 8603, 4704, 1303, 541, 121),
    (25000, 21040, 17115, 12965, 7992, 3330, 320, 102, 0, 0, 0),
    (25000, 5908, 2950, 2148, 1271, 665, 249, 112, 26, 7, 1),
    (25000, 10404, 4326, 2272, 628, 0, 0, 0, 0, 0, 0),
    (25000, 10460, 4328, 2260, 571, 0, 0, 0, 0, 0, 0),
    (25000, 15919, 12041, 10369, 7124, 4420, 1794, 788, 193, 0, 0),
    (25000, 3335, 1214, 845, 456, 227, 106, 54, 19, 3, 1),
    (25000, 2833, 1044, 691, 371, 197, 95, 48, 17, 6, 4),
    (25000, 22316, 19578, 18122, 15311, 11945, 6926, 3320, 1041, 329, 67),
    (25000, 19690, 13849, 10550, 4867, 1028, 156, 9, 0, 0, 0),
    (25000, 4994, 2347, 1592, 801, 330, 112, 43, 6, 1, 0),
    (25000, 8332, 2164, 898, 104, 0, 0, 0, 0, 0, 0),
    (25000, 8288, 2231, 937, 102, 0, 0, 0, 0, 0, 0),
    (25000, 14291, 10040, 8031, 5033, 2633, 809, 365, 10, 0, 0),
    (25000, 2264, 767, 525, 271, 154, 61, 30, 8, 0, 0),
    (25000, 1933, 678, 450, 221, 107, 47, 29, 7, 3, 0),
    (25000, 21551, 18363, 16704, 13564, 10110, 5280, 2197, 851, 288, 36),
    (25000, 18100, 11319, 7153, 2367, 458, 26, 0, 0, 0, 0),
    (25000, 4087, 1731, 1127, 461, 191, 42, 22, 1, 0, 0),
    (25000, 5879, 887, 159, 0, 0, 0, 0, 0, 0, 0),
    (25000, 5858, 937, 163, 0, 0, 0, 0, 0, 0, 0),
    (25000, 13022, 8316, 6252, 3545, 1666, 487, 119, 0, 0, 0),
    (25000, 1503, 519, 305, 156, 68, 30, 18, 6, 3, 1),
    (25000, 1335, 443, 282, 133, 72, 31, 15, 7, 1, 1),
    (25000, 20892, 17240, 15429, 12126, 8552, 3820, 1488, 561, 172, 7),
    (25000, 16423, 8383, 5170, 1079, 127, 1, 0, 0, 0, 0),
    (25000, 3172, 1215, 742, 298, 99, 24, 6, 0, 0, 0),
    (25000, 3683, 171, 22, 0, 0, 0, 0, 0, 0, 0),
    (25000, 3730, 165, 21, 0, 0, 0, 0, 0, 0, 0),
    (25000, 11656, 6657, 4702, 2381, 1039, 197, 27, 0, 0, 0),
    (25000, 1087, 334, 232, 112, 48, 17, 10, 3, 1, 0),
    (25000, 997, 263, 162, 64, 35, 14, 4, 3, 2, 0),
    (25000, 19913, 15765, 13835, 10394, 6866, 2506, 1233, 380, 108, 13),
    (25000, 14467, 5898, 2911, 345, 18, 0, 0, 0, 0, 0),
    (25000, 2523, 809, 452, 144, 47, 7, 1, 0, 0, 0),
    (25000, 2086, 22, 0, 0, 0, 0, 0, 0, 0, 0),
    (25000, 2072, 21, 0, 0, 0, 0, 0, 0, 0, 0),
    (25000, 10114, 5129, 3503, 1637, 554, 55, 0, 0, 0, 0),
    (25000, 805, 218, 138, 59, 25, 6, 2, 1, 1, 1),
    (25000, 621, 173, 113, 57, 29, 11, 3, 2, 0, 0),
    (25000, 18870, 14309, 12358, 8965, 5514, 1701, 966, 262, 40, 3),
    (25000, 12475, 3684, 1153, 85, 0, 0, 0, 0, 0, 0),
    (25000, 1929, 501, 260, 60, 15, 2, 1, 0, 0, 0),
    (25000, 1008, 0, 0, 0, 0, 0, 0, 0, 0, 0),
    (25000, 982, 0, 0, 0, 0, 0, 0, 0, 0, 0),
    (25000, 8780, 4074, 2663, 1085, 290, 9, 0, 0, 0, 0),
    (25000, 492, 122, 75, 29, 10, 4, 2, 1, 0, 0),
    (25000, 409, 97, 57, 27, 14, 5, 2, 0, 0, 0),
    (25000, 17596, 12820, 10820, 7443, 4099, 1305, 699, 196, 44, 3),
    (25000, 9876, 1771, 425, 9, 0, 0, 0, 0, 0, 0),
    (25000, 1346, 304, 127, 25, 7, 0, 0, 0, 0, 0),
    (25000, 407, 0, 0, 0, 0, 0, 0, 0, 0, 0),
    (25000, 379, 0, 0, 0, 0, 0, 0, 0, 0, 0),
    (25000, 7454, 3089, 1891, 631, 142, 0, 0, 0, 0, 0),
    (25000, 337, 81, 45, 17, 10, 4, 3, 1, 0, 0),
    (25000, 272, 63, 34, 15, 6, 2, 2, 0, 0, 0),
    (25000, 16274, 11340, 9335, 5984, 2946, 919, 434, 111, 23, 2),
    (25000, 7646, 808, 135, 0, 0, 0, 0, 0, 0, 0),
    (25000, 1027, 142, 57, 12, 4, 0, 0, 0, 0, 0),
    (25000, 102, 0, 0, 0, 0, 0, 0, 0, 0, 0),
    (25000, 110, 0, 0, 0, 0, 0, 0, 0, 0, 0),
    (25000, 6239, 2288, 1258, 327, 18, 0, 0, 0, 0, 0),
    (25000, 205, 44, 23, 11, 8, 3, 3, 0, 0, 0),
    (25000, 196, 52, 29, 10, 4, 1, 0, 0, 0, 0),
    (25000, 14982, 9879, 7813, 4673, 2045, 744, 339, 67, 16, 4),
    (25000, 5473, 296, 27, 0, 0, 0, 0, 0, 0, 0),
    (25000, 655, 74, 25, 6, 1, 0, 0, 0, 0, 0),
    (25000, 4, 0, 0, 0, 0, 0, 0, 0, 0, 0),
    (25000, 12, 0, 0, 0, 0, 0, 0, 0, 0, 0),
    (25000, 5110, 1717, 892, 132, 2, 0, 0, 0, 0, 0),
    (25000, 73, 12, 5, 2, 1, 1, 0, 0, 0, 0),
    (25000, 79, 7, 3, 2, 0, 0, 0, 0, 0, 0),
    (25000, 11952, 7008, 5238, 2682, 1062, 374, 156, 30, 5, 0),
    (25000, 2156, 17, 0, 0, 0, 0, 0, 0, 0, 0),
    (25000, 217, 11, 4, 0, 0, 0, 0, 0, 0, 0),
    (25000, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0),
    (25000, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0),
    (25000, 3590, 798, 267, 16, 0, 0, 0, 0, 0, 0),
    (25000, 14, 3, 1, 0, 0, 0, 0, 0, 0, 0),
    (25000, 12, 2, 0, 0, 0, 0, 0, 0, 0, 0),
    (25000, 6493, 2881, 1858, 689, 282, 79, 28, 1, 0, 0),
    (25000, 89, 0, 0, 0, 0, 0, 0, 0, 0, 0),
    (25000, 20, 2, 1, 0, 0, 0, 0, 0, 0, 0),
    (25000, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0),
    (25000, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0),
    (25000, 1327, 43, 0, 0, 0, 0, 0, 0, 0, 0),
    (25000, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0),
    (25000, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0),
    (25000, 781, 184, 79, 26, 7, 2, 1, 0, 0, 0),
    (25000, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0),
    (25000, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0),
    (25000, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0),
    (25000, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0),
    (25000, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0),
)

SCAN_TYPE = ("struct<base:array<struct<kind:string,start:int,end:int>>,"
             "runs:array<struct<start:int,end:int,cell:int>>>")


def upper_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi_squared_tail(x: float, df: int) -> float:
    """Wilson-Hilferty approximation of the upper tail."""
    return upper_tail(((max(x, 0.0) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))


def uniformity(x: str, at: dict[str, int], part: dict[str, int], sizes: list[int]) -> float:
    n, k = len(x), len(at)
    counts = [x.count(c) for c in set(x)]
    chi = k / n * sum(c * c for c in counts) - n
    by_symbol = upper_tail((chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n))
    seen = [0] * len(sizes)
    for c in x:
        seen[part[c]] += 1
    by_class = chi_squared_tail(sum((s - n * w / k) ** 2 / (n * w / k) for s, w in zip(seen, sizes)), len(sizes) - 1)
    return min(1.0, 2 * min(by_symbol, by_class))


def runs(y: list[int], k: int) -> float:
    high = [2 * v >= k for v in y]
    n1 = sum(high)
    n0, n = len(y) - n1, len(y)
    if not n0 or not n1:
        return 2.0 ** (1 - n)
    mean = 2 * n0 * n1 / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    r = 1 + sum(a != b for a, b in zip(high, high[1:]))
    return 2 * upper_tail(abs(r - mean) / math.sqrt(var)) if var > 0 else 1.0


def serial_correlation(y: list[int]) -> float:
    n = len(y)
    m = sum(y) / n
    var = sum((v - m) ** 2 for v in y)
    if not var:
        return 0.0
    r = sum((a - m) * (b - m) for a, b in zip(y, y[1:])) / var
    return 2 * upper_tail(abs(r + 1 / n) * math.sqrt(n))


def encoding(x: str) -> int:
    return next(i for i, (pattern, _) in enumerate(ENCODINGS) if pattern.fullmatch(x))


def randomness(run: str) -> float:
    """Joint p-value of the battery for one run of key characters."""
    x = run.rstrip("=")
    at, part, sizes = ALPHABETS[encoding(x)]
    y = [at[c] for c in x]
    h = -sum(math.log(max(p, 1e-300)) for p in (uniformity(x, at, part, sizes), runs(y, len(at)), serial_correlation(y)))
    return math.exp(-h) * (1 + h + h * h / 2)  # chi-squared with six degrees of freedom at 2h


def grid_cell(run: str) -> int:
    p = randomness(run)
    return max(i for i, t in enumerate(GRID) if p >= t)


def cell(run: str) -> int:
    """Length step, encoding and grid cell of a run as one number."""
    x = run.rstrip("=")
    return (max(i for i, low in enumerate(NULL_LENGTHS) if len(x) >= low) * len(ENCODINGS) + encoding(x)) * len(GRID) + grid_cell(run)


def word_run(rnd: random.Random, k: int, n: int) -> str:
    """A word of the null: ``n`` characters whose encoding is number ``k``."""
    signs = "".join(ENCODINGS[k][1][3:])
    while True:
        style, join, out = rnd.randrange(3), rnd.choice(signs) if signs else "", ""
        while len(out) < n:
            if k != 3 and rnd.random() < 0.25:
                part = rnd.choice((f"{rnd.randint(1990, 2030)}", f"20{rnd.randint(0, 30):02}{rnd.randint(1, 12):02}{rnd.randint(1, 28):02}",
                                   f"{rnd.randrange(10)}", f"{rnd.randrange(100):02}", f"{rnd.randrange(1000):04}"))
            elif k < 2:
                part = rnd.choice(HEX_WORDS)
            elif rnd.random() < 0.5:
                part = rnd.choice(WORDS)
            else:
                part = "".join(rnd.choice("bcdfghklmnprstvwz") + rnd.choice("aeiou") + rnd.choice(("", "", "n", "r", "s", "l"))
                               for _ in range(rnd.randint(1, 4)))
            part = part.upper() if k in (1, 2) else part if k == 0 or style == 0 else part.capitalize() if style == 1 or out else part
            out += part + (rnd.choice(signs) if k == 7 else join)
        out = out[:n]
        if encoding(out) == k and any(c.isalpha() for c in out) and any(c.isdigit() or c.isupper() for c in out):
            return out


def null_tail(step: int, k: int, n: int, seed: int) -> list[int]:
    """How many of ``n`` words of a length step and encoding reach each bound of the grid."""
    rnd, at = random.Random(f"{seed}:{step}:{k}"), [0] * len(GRID)
    for _ in range(n):
        at[grid_cell(word_run(rnd, k, NULL_LENGTHS[step]))] += 1
    return [sum(at[t:]) for t in range(len(GRID))]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def scan_text(text: str) -> dict:
    base, found = base_spans(text), []
    for m in RUN.finditer(text):
        start, end = m.span()
        x = m[0]
        if any(c.isalpha() for c in x) and any(c.isdigit() or c.isupper() for c in x) and not any(s < end and start < e for _, s, e in base):
            found.append({"start": start, "end": end, "cell": cell(x)})
    return {"base": [{"kind": k, "start": s, "end": e} for k, s, e in base], "runs": found}


def scanned(docs: DataFrame, text_col: str, out: str) -> DataFrame:
    """``docs`` with the raw findings of each text as the struct ``out``."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_type(_parse_datatype_string(SCAN_TYPE))

    @F.arrow_udf(SCAN_TYPE)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in pieces(batches):
            yield pa.array((scan_text(t.as_py() or "") for t in texts), kind)

    return docs.withColumn(out, scan(F.coalesce(column(docs, text_col).cast("string"), F.lit(""))))


def bounds(found: DataFrame, out: str, fdr: float = FDR) -> list[int]:
    """Per length step and encoding the first grid cell that counts as random (len(GRID):
    none), by Benjamini-Hochberg over the runs of each length class."""
    cells = found.select(F.explode(F.col(out).getField("runs")).alias("x")).select(F.col("x.cell").alias("cell"))
    counts = {r["cell"]: r["count"] for r in cells.groupBy("cell").count().collect()}  # at most steps * encodings * grid rows
    g, e = len(GRID), len(ENCODINGS)
    chosen = []
    for low, end in zip(LENGTHS, (*LENGTHS[1:], math.inf)):
        group = [i * e + k for i, n in enumerate(NULL_LENGTHS) if low <= n < end for k in range(e)]
        p = {(k, t): (NULL_TAILS[k][t] + 1) / (DECOYS + 1) for k in group for t in range(g)}
        n_runs = sum(counts.get(k * g + t, 0) for k, t in p)
        limit, accepted = 0.0, 0
        for (k, t), v in sorted(p.items(), key=lambda x: x[1]):
            accepted += counts.get(k * g + t, 0)
            if accepted and v * n_runs / accepted <= fdr:
                limit = v
        chosen += [min((t for t in range(g) if p[k, t] <= limit), default=g) for k in group]
    return chosen


def spans_of(out: str, chosen: list[int]) -> Column:
    """Base spans and accepted runs, by start and kind."""
    g = len(GRID)
    first = F.array(*[F.lit(b) for b in chosen])
    kept = F.filter(F.col(out).getField("runs"), lambda r: (r.getField("cell") % g) >= F.element_at(
        first, (F.floor(r.getField("cell") / g) + 1).cast("int")))
    keys = F.transform(kept, lambda r: F.struct(F.lit("random").alias("kind"), r.getField("start").alias("start"),
                                                  r.getField("end").alias("end")))
    order = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    keyed = F.transform(F.concat(F.col(out).getField("base"), keys), lambda s: F.struct(
        s.getField("start").alias("start"), order[s.getField("kind")].alias("order"), s.getField("end").alias("end"),
        s.getField("kind").alias("kind")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(
        s.getField("kind").alias("kind"), s.getField("start").alias("start"), s.getField("end").alias("end")))


def scan_secrets(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, out: str = "secrets",
                 fdr: float = FDR) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all by default) with ``out``: array of kind, start, end."""
    keep = docs.columns if keep is None else keep
    out = free_name(docs, out)
    found = written(scanned(docs, text_col, out).select(*[column(docs, c) for c in keep], F.col(out)))
    return found.withColumn(out, spans_of(out, bounds(found, out, fdr)))


def redact_text(text: str, spans: list[dict], mark: str = REDACTED) -> str:
    parts, at = [], 0
    for s, e in sorted((x["start"], x["end"]) for x in spans):
        if e <= at:
            continue
        if s >= at:
            parts += [text[at:s], mark]
        at = e
    return "".join([*parts, text[at:]])


def redact_secrets(docs: DataFrame, text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """``docs``, columns as given, with every span of the texts replaced by a mark. Rows
    without spans are unchanged (a null text stays null)."""
    out = free_name(docs, "secrets")
    found = scan_secrets(docs, text_col, out=out, fdr=fdr)

    @F.arrow_udf("string")
    def redact(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, spans in pieces(batches):
            yield pa.array((redact_text(t, s) if s and t else t for t, s in zip(texts.to_pylist(), spans.to_pylist())), pa.string())

    return found.select(*[redact(column(docs, c), F.col(out)).alias(c) if c == text_col else column(docs, c)
                          for c in docs.columns])


def span_list(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", s.getField("kind"), s.getField("start").cast("string"), s.getField("end").cast("string"))))
