"""Toxicity, secrets, page extraction and mixing: held-out accuracy, brute force, oracles."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from wikilake.llm import html_extract, mixing, secret_scan, toxicity
from wikilake.llm.queries import ORACLE, REGISTRY

SMALL, MID = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def auc(scores, labels):
    order = np.argsort(np.argsort(scores)) + 1.0
    pos = labels == 1
    return (order[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def insults(spark, n=1500):
    rnd = random.Random(5)
    bad, mild = ["idiot", "loser", "scum"], [f"{a}{b}" for a in ("ba", "ti", "ro", "mel") for b in ("na", "sol", "kin", "der", "pu")]
    docs, labels = [], []
    for i in range(n):
        words = rnd.choices(mild, k=rnd.randint(5, 80))
        toxic = i % 5 == 0
        for _ in range(2 if toxic else 0):
            word = rnd.choice(bad)
            words.insert(rnd.randrange(len(words)), f"you {word.replace('i', '1') if rnd.random() < 0.1 else word}")
        docs.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    return (spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").cache(),
            spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").cache())


def test_toxicity_held_out(spark):
    docs, labels = insults(spark)
    rows = toxicity.score_toxicity(docs, labels).join(labels, "doc_id").select("text", "toxic", "toxicity.*").collect()
    held = [r for r in rows if r.held_out]
    y, s = np.array([r.toxic for r in held]), np.array([r.score for r in held])
    assert 0 <= s.min() and s.max() <= 1 and auc(s, y) > 0.97
    assert np.mean([r.predicted == r.toxic for r in held]) > 0.95
    by_text = {}
    for r in rows:
        assert r.predicted == int(r.score >= 0.5)
        assert by_text.setdefault(r.text, r.score) == r.score  # the text alone decides


def test_toxicity_features_see_obfuscation():
    lexicon = {"idiot": 5.0, "loweic~": 3.0}
    at = dict(zip(toxicity.FEATURES, toxicity.text_features("You are an 1d10t and an i.d.i.o.t", lexicon)))
    assert at["obfuscated_hits"] > 1 and at["near_second_person"] > 0
    assert dict(zip(toxicity.FEATURES, toxicity.text_features("loweichtum", lexicon)))["stem_density"] == 1.0
    assert toxicity.text_features("", lexicon) == [0.0] * len(toxicity.FEATURES)


def test_base_spans_by_brute_force():
    rnd = random.Random(2)
    parts = ["password", "PassWD", "api_key", "apikey", "token", "secret", '"', "'", " ", ":", "=", "AKIA", "ABCDEF0123456789", "abcdef012345",
             "x", "\n", "ſecret", "K", "z" * 5, "-", "é"]
    for _ in range(4000):
        t = "".join(rnd.choices(parts, k=rnd.randint(1, 14)))
        expected = []
        word = "(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in (
            "password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY])"
        for m in re.finditer(word + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
            expected += [("assign", *m.span())] if len(m[2]) >= 6 else []
        expected += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        expected += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert secret_scan.base_spans(t) == sorted(expected, key=lambda s: (s[1], secret_scan.KINDS.index(s[0])))


def test_battery_separates_keys_from_words():
    rnd = random.Random(3)
    alphabet = secret_scan.UPPER + secret_scan.LOWER + secret_scan.DIGIT
    keys = [secret_scan.randomness("".join(rnd.choices(alphabet, k=32))) for _ in range(300)]
    assert np.mean([p >= 0.01 for p in keys]) > 0.93
    for w in ("internationalization2024report", "abcdefghijklmnopqrstuvwxyz0123456789", "aaaaaaaaaaaaaaaaaaaaaaaa1"):
        assert secret_scan.randomness(w) < 1e-6


def test_corpus_bounds_accept_keys_and_leave_words(spark):
    rnd = random.Random(8)
    alphabet = secret_scan.UPPER + secret_scan.LOWER + secret_scan.DIGIT
    keys = ["".join(rnd.choices(alphabet, k=33)) for _ in range(40)]
    words = ["".join(rnd.choices(["ba", "ti", "ro", "mel", "kin"], k=14)) for _ in range(3000)]
    rows = [(i, f"see {words[i]} and {words[i - 1]}{2 if i < 400 else ''} then {keys[i] if i < 40 else 'none'} end") for i in range(3000)]
    found = {r.doc_id: r for r in secret_scan.scan_secrets(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    got = {i: [r.text[s.start:s.end] for s in r.secrets] for i, r in found.items()}
    real = [i for i in range(40) if any(c.isdigit() for c in keys[i])]
    assert np.mean([keys[i] in got[i] for i in real]) > 0.85
    assert sum(len(got[i]) for i in range(40, 3000)) == 0


def test_a_single_key_is_found_in_a_small_corpus(spark):
    rnd = random.Random(11)
    alphabet = secret_scan.UPPER + secret_scan.LOWER + secret_scan.DIGIT + "+/"
    keys = ["".join(rnd.choices(alphabet, k=40)) for _ in range(60)] + ["".join(rnd.choices(alphabet[:52], k=24)) for _ in range(60)]
    found = []
    for at in range(0, len(keys), 12):  # each group is a corpus of its own, without any long word
        rows = [(i, f"the value {k} here") for i, k in enumerate(keys[at:at + 12])] + [(99, "see getElementsByClassNameOrDefault2 and INTERNATIONALIZATION2024")]
        got = {r.doc_id: [r.text[s.start:s.end] for s in r.secrets]
               for r in secret_scan.scan_secrets(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
        assert got[99] == []
        found += [keys[at + i] in got[i] for i in range(12)]
    assert np.mean(found[:60]) > 0.85 and np.mean(found[60:]) > 0.6


def test_null_tails_are_those_of_the_word_model():
    e = len(secret_scan.ENCODINGS)
    for i, kept in enumerate(secret_scan.NULL_TAILS):
        for a, b in zip(secret_scan.null_tail(i // e, i % e, 300, 2), kept, strict=True):
            p = b / secret_scan.DECOYS
            assert abs(a / 300 - p) < 5 * (p * (1 - p) / 300) ** 0.5 + 0.01


def test_redaction(spark):
    text = "é token = 'abcdef0123' and deadbeefdeadbeefdeadbeef, password: 0123456789abcdef0123456789abcdef!"
    rows = spark.createDataFrame([(1, text), (2, "clean"), (3, None)], "doc_id bigint, text string")
    found = {r.doc_id: r.text for r in secret_scan.redact_secrets(rows).collect()}
    assert found == {1: "é [REDACTED]' and [REDACTED], [REDACTED]!", 2: "clean", 3: None}


def test_shared_lines_are_a_longest_common_subsequence():
    rnd = random.Random(2)

    def length(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
            row = new
        return row[-1]

    for _ in range(1500):
        a, b = (rnd.choices("abcd", k=rnd.randint(0, 12)) for _ in range(2))
        shared = [x for x, y in zip(a, html_extract.shared_lines(a, b)) if y]
        rest = iter(b)
        assert all(x in rest for x in shared) and len(shared) == length(a, b)
        assert html_extract.row_lengths(a, b) == [length(a, b[:j]) for j in range(len(b) + 1)] if b else True


def test_long_pages_are_halved(monkeypatch):
    a, b = [str(i % 7) for i in range(300)], [str(i % 5) for i in range(280)]
    whole = sum(html_extract.shared_lines(a, b))
    big = html_extract.shared_lines(a * 60, b * 60)
    assert whole > 0 and sum(big) >= 60 * whole


def test_marked_article_is_kept_whole():
    marked, lines = html_extract.page_lines(
        "<html><head><title>t</title><style>x</style></head><body><header>H</header><nav><ul><li>a<li>b</nav><main><article><header><h1>T &amp; U</h1>"
        "</header><p>one <b>b</b>old<aside>no</aside> more<ul><li>x<li>y</ul><div class='share-buttons'>s</div><section id='comments'>"
        "<article class='comment'><p>c</article></section><form>f</form></article></main><div class=ad>z</div><footer>f</footer>")
    assert marked and " ".join(lines) == "T & U one bold more x y"


def test_unmarked_pages_lose_shared_lines(spark):
    def page(k):
        return f"<body><p>Site name<p>Story {k} starts<p>and ends {k * k}<p>All rights kept<div class=comments>hi</div>"

    rows = [(k, f"http://h/news/{k}?utm=1", page(k)) for k in range(20)] + [(50, "http://other/x", page(3)), (51, None, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = {r.page_id: r.main.text for r in html_extract.extract_main_text(pages).collect()}
    assert all(found[k] == f"Story {k} starts and ends {k * k}" for k in range(20))
    assert found[50].startswith("Site name Story 3") and found[51] == ""


def test_pages_alone_in_their_directory_meet_the_host(spark):
    rows = [(k, f"http://h/story-{k}/index.html", f"<p>Site name<p>Story {k} starts<p>and ends {k * k}<p>All rights kept") for k in range(20)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = {r.page_id: r.main.text for r in html_extract.extract_main_text(pages).collect()}
    assert all(found[k] == f"Story {k} starts and ends {k * k}" for k in range(20))


def test_template_heavy_pages_are_no_versions(spark):
    template = "".join(f"<p>menu {i}" for i in range(12))
    rows = [(k, f"http://h/a/{k}", f"{template}<p>Story {k}") for k in range(20)]
    article = "".join(f"<p>Long line {i}" for i in range(14))
    rows += [(50, "http://h/a/zz", template + article + "<p>first"), (51, "http://h/a/zz-print", template + article + "<p>second")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = {r.page_id: r.main.text for r in html_extract.extract_main_text(pages).collect()}
    whole = " ".join(f"Long line {i}" for i in range(14))
    assert all(found[k] == f"Story {k}" for k in range(20))
    assert found[50] == whole + " first" and found[51] == whole + " second"


def test_marked_pages_are_differenced(spark):
    """Lines outside the article go if the nearest page has them; those inside stay."""
    def page(k):
        return (f"<body><nav>menu</nav><p>Site name<p>Own words {k} before<article class=teaser><p>Quoted passage<p>Look at {k * k}</article>"
                f"<p>Own words {k} after<p>All rights kept<div class=ad>buy {k}</div><footer>f</footer>")

    rows = [(k, f"http://h/news/{k}", page(k)) for k in range(20)] + [(0, "http://h/news/0", page(0))]
    rows += [(50, "http://alone/x", page(50)), (51, "http://empty/x", page(51)), (52, "http://empty/y", None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = [(r.page_id, r.main.text) for r in html_extract.extract_main_text(pages).collect()]
    own = [(k, f"Own words {k} before Quoted passage Look at {k * k} Own words {k} after") for k in [0, *range(20)]]
    lone = [(k, f"Site name Own words {k} before Quoted passage Look at {k * k} Own words {k} after All rights kept") for k in (50, 51)]
    assert sorted(found) == own + lone + [(52, "")]


def test_marked_and_unmarked_pages_are_neighbours(spark):
    rows = [(k, f"http://h/news/{k}", f"<p>Site name<p>All rights kept{'<article>' if k != 7 else ''}<p>Story {k}<p>and so on") for k in range(20)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = {r.page_id: r.main.text for r in html_extract.extract_main_text(pages).collect()}
    assert found == {k: f"Story {k}{' and so on' * (k != 7)}" for k in range(20)}


def test_two_addresses_of_a_marked_page_keep_its_text(spark):
    body = "".join(f"<p>Long line {i}" for i in range(14))
    rows = [(k, f"http://h/a/{k}", f"<p>Site name<article><p>Story {k}</article>") for k in range(20)]
    rows += [(k, f"http://h/z/{k}", f"<p>Site name<article><p>See also</article>{body}") for k in (50, 51)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = {r.page_id: r.main.text for r in html_extract.extract_main_text(pages).collect()}
    assert all(found[k] == f"Story {k}" for k in range(20))
    assert found[50] == found[51] == "See also " + " ".join(f"Long line {i}" for i in range(14))


def test_nearest_paths_over_ranges(spark):
    rnd = random.Random(4)
    rows = sorted({(rnd.choice("hhhhgf"), "/" + "".join(rnd.choices("ab/", k=rnd.randint(0, 9)))) for _ in range(400)})
    got = {(r.host, r.path): r.near for r in html_extract.nearest_paths(spark.createDataFrame(rows, "host string, path string")).collect()}
    assert len(got) == len(rows)
    for host, path in rows:
        rest = [p for h, p in rows if h == host and p != path]
        best = max((html_extract.common_prefix(path, p) for p in rest), default=None)
        assert html_extract.common_prefix(path, got[host, path]) == best if rest else got[host, path] is None


def test_given_pages_give_their_article(spark):
    import html

    source = {r.page_id: r.html for r in spark.read.parquet(f"{MID}/pages.parquet").collect()}
    for r in REGISTRY["op4_html_extraction"](spark, MID).collect():
        inner = re.search(r"<article>(.*?)</article>", source[r.page_id], re.S)[1]
        inner = re.sub(r"<[^>]*>", "", re.sub(r"<(/?p|/?h\d|br|/?li|/?ul|/?td|/?tr)\b[^>]*>", " ", inner))
        assert r.text == " ".join(html.unescape(inner).split()) and r.n_chars == len(r.text)


def fill(sizes, weights=(5, 2, 1)):
    """Targets by resharing the excess until none is above three times its source."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    held, rest = {}, set(names)
    while True:
        left = sum(sizes.values()) - sum(held.values())
        share = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > 3 * sizes[s]]
        if not over:
            return {**held, **share}
        for s in over:
            held[s] = 3 * sizes[s]
            rest.discard(s)


def test_mix_meets_targets_with_a_hot_source(spark):
    rnd = random.Random(9)
    rows = [(i, " ".join(["w"] * rnd.randint(0, 60)), rnd.choice(["hot", "hot", "a", "b", "c", None, "tiny" if i % 40 == 0 else "d"])) for i in range(6000)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = mixing.mix_plan(table, rows_per_bucket=300).select("doc_id", "source", "mix.*").collect()
    sizes = Counter()
    for r in found:
        sizes[r.source] += r.size
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
    targets = fill(sizes)
    taken = Counter()
    for r in found:
        taken[r.source] += r.taken
        assert abs(r.target - targets[r.source]) < 1e-6 * max(1, targets[r.source]) and r.source_size == sizes[r.source]
    assert all(abs(taken[s] - targets[s]) <= max(120, 0.02 * targets[s]) for s in sizes)
    copies = Counter(r.doc_id for r in mixing.mix_documents(table, rows_per_bucket=300).collect())
    assert copies == Counter({r.doc_id: r.copies for r in found if r.copies})


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    mine = REGISTRY[name](spark, SMALL).toPandas()
    theirs = con.sql(ORACLE[name]).df()[list(mine.columns)]
    key = list(mine.columns)
    assert mine.sort_values(key).reset_index(drop=True).equals(theirs.sort_values(key).reset_index(drop=True))


def test_mixing_runs_no_python(spark):
    plan = REGISTRY["op6_mixing"](spark, SMALL)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
