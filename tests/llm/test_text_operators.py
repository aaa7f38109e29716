"""HTML text, quality rules, URL filter, licence scan, chat perspectives."""

import math
import os
import random
import re
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import brute
from procweave.llm import chat, html_blocks, license_scan, quality_rules, url_reputation
from procweave.llm.queries import page_outcomes

DOC = "doc_id long, text string, lang string, n_words long, kept boolean, _key string, _text int, block long"


def docs(spark, rows):
    """Documents with extra columns whose names clash with columns the operators use."""
    return spark.createDataFrame([(i, t, g, -1, None, "x", 0, 9) for i, t, g in rows], DOC)


# ------------------------------------------------------------------ html

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header class="site-header"><a href=/>Site</a> tag line</header>
<div class="wrap"><div id="sidebar"><p>Some long sidebar text with many words in it to look like an article</p></div>
<div class="article-body"><header><h1>Head &amp; line</h1><p class="byline">By X</p></header><p>First&nbsp;para <a href=x>link</a>
 text.<br>More &#65;<p>Ok.<div class="ad-slot">Buy now</div><script>var t="</p>";</script><!-- no --><blockquote>Said so</blockquote>
<form><label>Name</label><input><button>Go</button></form></div>
<section id="comments"><p>I think this is a great article with a long text and so on and on.</p></section></div>
<div class="cookie-banner">We use cookies</div><footer>c</footer></body></html>"""


def test_main_text_of_a_page():
    tree = html_blocks.labelled_tree()
    assert html_blocks.main_text(PAGE, tree) == "Head & line\n\nFirst para link text. More A\n\nOk.\n\nSaid so"
    assert html_blocks.main_text("<article><p>One two</p><p>three <b>fo", tree) == "One two\n\nthree fo"
    assert html_blocks.main_text("<article><p>Some text <span class=ad>buy</span> goes on</p><p class='ad'>x<h2>Next</h2><p data-hidden=1>y</p></article>",
                                 tree) == "Some text\n\ngoes on\n\nNext\n\ny"
    assert html_blocks.main_text("<article><p>One</p><article class=comment><p>nice</p></article><p>Two</p></article>", tree) == "One\n\nTwo"
    assert html_blocks.main_text("<article><p>a < b &lt;c&gt; d</p></article><p", tree) == "a < b <c> d"


@pytest.mark.parametrize("opened,closed", [
    ("<div class='content has-sidebar'>", "</div>"), ("<main class='main-content no-sidebar'>", "</main>"), ("<div id=main class=page-with-sidebar>", "</div>"),
    ("<article class='post tag-privacy category-legal'>", "</article>"), ("<div class='post sidebar-left hasToc'>", "</div>"),
    ("<main role=main class=search>", "</main>")])
def test_layout_marks_are_no_furniture(opened, closed):
    tree = html_blocks.labelled_tree()
    own = ("<header class=entry-header><h1>A title</h1></header><div class=article-header><p>Lead text</p></div><p>" + "word " * 30 + "</p>"
           "<div class=entry-meta>by me</div><div class=comment-text><p>nice text of a reader</p></div>")
    page = f"<body class=has-sidebar><header class=main-header><p>Site name</p></header>{opened}{own}{closed}<div class=sidebar-left><p>{'other ' * 9}</p></div></body>"
    assert html_blocks.main_text(page, tree).split("\n\n") == ["A title", "Lead text", ("word " * 30).strip()]


@pytest.mark.parametrize("name", ["ad", "sidebar-left", "comment-content", "post-meta", "tag-links", "main-menu", "mainMenu", "site-header", "widget_text"])
def test_furniture_stays_out(name):
    page = f"<body><article><p>{'word ' * 30}</p></article><div class='x {name}'><p>{'other ' * 12}</p></div></body>"
    assert html_blocks.main_text(page, html_blocks.labelled_tree()) == ("word " * 30).strip()


@pytest.mark.parametrize(("page", "text"), [
    ("<body><p>Short.</p></body>", "Short."), ("<div class=menu-page><article><p>Some words.</p></article></div>", "Some words."),
    ("<div class='has-ads-banner post'><p>Some words.</p></div>", "Some words."), ("<section id=search-results-article><p>Some words.</p></section>", "Some words."),
    ("<article><p>One two three</p><div class=legal-text><p>stays here</p></div></article>", "One two three\n\nstays here"),
    ("<article><p>One two three</p><div class=notice-box><p>goes</p></div><section class=comments><div class=content><p>" + "w " * 90 + "</p></div></section></article>", "One two three"),
    ("<article><p>" + "w " * 70 + "</p><p>The end.</p></article>", "w " * 70 + "\n\nThe end."),
    ("<body><h1>One</h1><p>" + "w " * 70 + "</p><p>" + "v " * 12 + "</p></body>", "One\n\n" + "w " * 70 + "\n\n" + "v " * 12),
    ("<body><div class=privacy-section><p>" + "w " * 60 + "</p></div></body>", ("w " * 60).strip())])
def test_names_of_furniture_around_real_text(page, text):
    assert html_blocks.main_text(page, html_blocks.labelled_tree()) == "\n\n".join(x.strip() for x in text.split("\n\n"))


@pytest.mark.parametrize("page", ["<div>" * 20_000 + "x" + "</span>" * 20_000, "<div><span>" * 20_000 + "x" + "</span>" * 20_000, "<p class=ad>" * 40_000,
                                  "<a><b><div" * 30_000])
def test_deep_nesting_takes_linear_time(page):
    begin = time.process_time()
    html_blocks.main_text(page, html_blocks.labelled_tree())
    assert time.process_time() - begin < 3  # under 0.3 s where it was 23 s


def test_labelled_blocks_are_learnt():
    tree = html_blocks.labelled_tree()
    for page in html_blocks.LABELLED:
        found = html_blocks.blocks(re.sub(r"\{(\d+)\}", lambda m: "w " * int(m[1]), page))
        for block, row in zip(found, html_blocks.features(found)):
            assert html_blocks.decide(tree, row) == block[0].startswith("+")


def test_held_out_pages(spark, sf_small):
    """Pages with one <article> element: its blocks, in order (pages of the tables are not in the labelled table)."""
    pages = spark.read.parquet(f"{sf_small}/pages.parquet")
    got = {r.page_id: r for r in html_blocks.extract(pages).collect()}
    import html as h
    for r in pages.collect():
        body = r.html.split("<article>", 1)[1].split("</article>")[0]
        parts = [" ".join(h.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1)>", re.sub(r"<[^>]*\Z", "", body))]
        want = "\n\n".join(p for p in parts if p)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want) and got[r.page_id].url == r.url


def test_html_edges(spark):
    schema = "page_id long, url string, html string, text string, _html int"
    rows = [(1, None, None, "x", 0), (2, "u", "", "x", 0), (None, "u", "<article>a</article>", None, 0), (3, "u", "<p>" * 3, "x", 0),
            (3, "u", "<article><p>" + "word " * 200_000 + "</p></article>", "x", 0), (4, "u", "<script>x", "x", 0)]
    got = sorted(((r.page_id or 0, r.n_chars, r.text[:4]) for r in html_blocks.extract(spark.createDataFrame(rows, schema)).collect()))
    assert got == [(0, 1, "a"), (1, 0, ""), (2, 0, ""), (3, 0, ""), (3, 999_999, "word"), (4, 0, "")]
    assert html_blocks.extract(spark.createDataFrame([], schema)).count() == 0


# ------------------------------------------------------------------ quality rules

TEXTS = [None, "", "  \n\t ", "a b", "x " * 7, "x " * 8, "x " * 9, "é ü " * 30, "a b c d e f g h\n" * 3, "one\n\none\n two\none",
         " ".join(f"w{i % 11}" for i in range(60)), " ".join(f"w{i}" for i in range(50)), "#1 $2 <b> & | % *\n" * 4,
         "a\x0bb\x0cc\rd\x1fe\u00a0f\u2028g", " ".join(f"v{i % 4000}" for i in range(12_000))]


def test_quality_counts_match_brute_force(spark):
    rng = random.Random(3)
    texts = TEXTS + [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 60))) for _ in range(40)]
    got = {r["_key"]: r for r in quality_rules.measure(docs(spark, [(i, t, "en") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        want = brute.quality_counts(t)
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == want, t
        assert got[i].base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])


def test_binomial_tail(spark):
    cases = [(k, n, p) for n in (1, 5, 40, 700) for k in (0, 1, 3, n // 7, n // 3) if k <= n for p in (0.0025, 0.2, 0.5)]
    for p in {c[2] for c in cases}:
        own = [c for c in cases if c[2] == p]
        df = spark.createDataFrame([(float(k), float(n)) for k, n, _ in own], "k double, n double")
        got = [r.t for r in df.select(quality_rules.binomial_tail(F.col("k"), F.col("n"), p).alias("t")).collect()]
        for (k, n, _), t in zip(own, got):
            want = sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1))
            assert t == 1.0 if k >= n * p else abs(t - want) < 1e-9 * max(1, want) + 1e-12
            assert k < n * p or want >= 0.25


def test_cutoffs_are_risk_controlled(spark):
    words = " ".join(f"w{i}" for i in range(30))
    junk = " ".join(f"w{i}%%%" for i in range(30))
    n = 3000
    rows = [(i, junk if i % 10 == 0 else words, "en") for i in range(n)] + [(n + i, junk, "fr") for i in range(40)]
    labels = spark.createDataFrame([(i, 0 if i % 10 == 0 else 1) for i in range(n)] + [(n + i, 0) for i in range(20)] + [(None, 1), (5, None)],
                                   "doc_id long, quality int")
    judged = quality_rules.judge(docs(spark, rows), labels)
    got = {r.doc_id: r.kept for r in judged.collect()}
    assert judged.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert all(got[i] == (i % 10 != 0) for i in range(n))
    assert all(got[n + i] for i in range(40))  # no good holdout texts in the stratum: nothing can be guaranteed
    few = quality_rules.judge(docs(spark, rows[:300]), labels.where("doc_id < 300"))
    assert few.where("not kept").count() == 0  # too few labels for the bound


@pytest.mark.parametrize(("es", "admitted"), [(100, False), (400, True)])
def test_cutoffs_of_small_languages(spark, es, admitted):
    """Some hundred labels of a language admit its cutoffs; smaller ones are one stratum together, to which large ones lend nothing."""
    words = " ".join(f"w{i}" for i in range(30))
    junk = " ".join(f"w{i}%%%" for i in range(30))
    kinds = [("fr", words, 1, 900), ("fr", junk, 0, 40), ("es", words, 1, es), ("es", junk, 0, 20), ("it", junk, 1, 1), ("it", junk, 0, 9),
             ("pt", junk, 0, 9), (None, words, 1, 250), (None, junk, 0, 5)]
    rows = [(text, lang, good) for lang, text, good, n in kinds for _ in range(n)]
    labels = spark.createDataFrame([(i, r[2]) for i, r in enumerate(rows)], "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in quality_rules.judge(docs(spark, [(i, r[0], r[1]) for i, r in enumerate(rows)]), labels).collect()}
    n_small = es + 250 + 1  # of it's good texts the rule rejects one
    level = 0.05 / (2 + (es >= 299))
    assert (sum(math.comb(n_small, k) * 0.01 ** k * 0.99 ** (n_small - k) for k in range(2)) <= level) == admitted
    for i, (text, lang, _) in enumerate(rows):
        # it: the rule rejects its good texts; pt: no good text
        assert got[i] == (text == words or lang in ("it", "pt") or (lang != "fr" and not admitted)), (i, lang)
    steps = quality_rules.sequence()
    assert len(steps) == sum(map(len, quality_rules.GRIDS.values()))
    assert all([c for name, c in steps if name == m] == list(grid) for m, grid in quality_rules.GRIDS.items())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_verdicts_match_brute_force(spark, sf):
    folder = f"/root/testdata/{sf}"
    if not os.path.isdir(folder):
        pytest.skip("driver test data not present")
    documents, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    rows = [(r.doc_id, r.text, r.lang) for r in documents.collect()]
    kept, chosen = brute.quality_verdicts(rows, [(r.doc_id, r.quality) for r in labels.collect()])
    got = {r.doc_id: r.kept for r in quality_rules.judge(documents, labels).collect()}
    assert len(got) == len(rows) and got == {i: k for (i, _, _), k in zip(rows, kept)}
    if sf == "sf0.1":  # the learned rules act here
        assert {"en", "fr", "de"} <= set(chosen) and {r.doc_id for r in quality_rules.keep(documents, labels).collect()} == {i for i, k in got.items() if k}


def test_verdicts_of_random_strata_match_brute_force(spark):
    rng = random.Random(12)
    rows, labels = [], []
    for stratum, good, bad in (("a", 700, 60), ("b", 330, 30), ("c", 200, 30), (None, 150, 10), ("d", 3, 9), ("e", 0, 20)):
        for k in range(good + bad):
            junk = k >= good
            plain = [f"{stratum}{rng.randrange(10 ** 6)}" for _ in range(rng.randint(21, 40))]
            if rng.random() < (0.9 if junk else 0.004):  # some good texts look like junk, some junk does not
                mark = rng.choice(["%", "!!", "#*", "q" * 30])
                plain = [w + (mark if rng.random() < rng.choice([0.1, 0.5, 1]) else "") for w in plain]
            rows.append((len(rows), " ".join(plain), stratum))
            if rng.random() < 0.97:
                labels.append((rows[-1][0], 0 if junk else 1))
    labels += [(5, 0), (None, 1), (6, None)]
    kept, chosen = brute.quality_verdicts(rows, labels)
    got = {r.doc_id: r.kept for r in quality_rules.judge(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert got == {i: k for (i, _, _), k in zip(rows, kept)}
    assert chosen and not all(kept)


def test_quality_edges(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    rows = [(None, "a b", None), (1, "w " * 5, "en"), (1, " ".join(f"w{i}" for i in range(25)), "en"), (1, None, None)]
    got = sorted((r.n_words, r.kept) for r in quality_rules.judge(docs(spark, rows), labels).collect())
    assert got == [(0, False), (2, False), (5, False), (25, True)]
    kept = quality_rules.keep(docs(spark, rows), labels)
    assert kept.count() == 1 and kept.columns == docs(spark, rows).columns
    assert quality_rules.judge(docs(spark, []), labels).count() == 0


# ------------------------------------------------------------------ urls

def test_rules_hosts_and_paths(spark):
    rows = [(1, "http://Example.COM/en/1?x"), (2, "https://www.example.com/en/"), (3, "https://a.www.example.com/en/x#y"), (4, "http://x.net/es/1"),
            (5, "http://x.net/en/1"), (6, "http://shop.com"), (7, None), (8, "no scheme"), (9, "a://b://c/d"), (10, "http://notexample.com/en/1"),
            (11, "http://ÉX.example.com/en/2"), (12, "http://h?q=://z/"), (13, "")]
    pages = spark.createDataFrame([(i, u, "h", "r", "v") for i, u in rows], "page_id long, url string, host string, rule string, verdict string")
    none = spark.createDataFrame([], "page_id long, bad int")
    got = {r.page_id: tuple(r)[1:5] for r in url_reputation.filter_urls(pages, none).collect()}
    assert got[1] == ("example.com", "/en/1", "example.com/en/", "block")
    assert got[2] == ("www.example.com", "/en/", "www.example.com/en/", "allow")
    assert got[3] == ("a.www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[4] == ("x.net", "/es/1", "net/es/", "block") and got[5] == ("x.net", "/en/1", None, "allow")
    assert got[6] == ("shop.com", "", None, "allow") and got[7] == got[8] == got[13] == ("", "", None, "allow")
    assert got[9][:2] == ("b:", "//c/d") and got[10][2:] == ("com/", "allow")
    assert got[11][0] == "Éx.example.com" and got[12][:2] == ("h", "")
    assert url_reputation.filter_urls(pages.limit(0), none).count() == 0


def test_reputation_shrinks_and_blocks(spark):
    bad = [(i, "http://bad.example.org/x") for i in range(60)]
    good = [(100 + i, f"http://h{i % 6}.fine.org/x") for i in range(120)]
    one = [(900, "http://new.fine.org/x"), (901, "http://bad.example.org/y"), (902, "http://u@bad.example.org:80/z")]
    pages = spark.createDataFrame(bad + good + one, "page_id long, url string")
    marks = spark.createDataFrame([(i, 1) for i, _ in bad] + [(i, 0) for i, _ in good] + [(0, 0), (None, 1), (3, None), (900, 1)], "page_id long, bad int")
    got = {r.page_id: r for r in url_reputation.filter_urls(pages, marks).collect()}
    assert got[901].verdict == "block" and got[100].verdict == "allow" and got[0].bad_rate > 0.9
    assert got[900].verdict == "allow" and got[900].bad_rate < 1  # one bad page is shrunk to its good domain
    assert got[902].host == "u@bad.example.org:80" and got[902].bad_rate > 0.5  # no labels of its own: its domain's rate
    hosts = {r.host: r for r in url_reputation.host_reputation(pages, marks).collect()}
    assert hosts["bad.example.org"].n == 60 and hosts["bad.example.org"].bad == 60
    assert all(0 <= h.lower <= h.mean <= 1 for h in hosts.values() if h.lower >= 0)


def incomplete_beta(a, b, x):
    """I_x(a, b) by midpoint sums of the density in ln(t / (1 - t)), far finer than the operator's grid."""
    top = math.log(a / b)
    step = 0.002 * math.sqrt(1 / a + 1 / b)

    def mass(lo, hi):
        n = max(1, int((hi - lo) / step))
        us = (lo + (hi - lo) * (i + 0.5) / n for i in range(n))
        return (hi - lo) / n * sum(math.exp(a * (u - top) - (a + b) * (math.log1p(math.exp(u)) - math.log1p(math.exp(top)))) for u in us)

    cut = math.log(x / (1 - x))
    low, high = top - 40 * math.sqrt(1 / a + 1 / b), top + 40 * math.sqrt(1 / a + 1 / b)
    left = mass(low, cut)
    return left / (left + mass(cut, high))


def test_beta_quantile(spark):
    shapes = [(0.8, 2.5), (1.0, 1.0), (3.0, 1.5), (12.0, 4.0), (150.0, 850.0), (60.2, 0.9), (4e5, 6e5)]
    frame = spark.createDataFrame(shapes, "a double, b double")
    for level in (0.05, 0.5):
        for r in frame.select("a", "b", url_reputation.beta_quantile(F.col("a"), F.col("b"), level).alias("q")).collect():
            assert abs(incomplete_beta(r.a, r.b, r.q) - level) < 2e-3 * level + 3e-4, r


def test_only_the_reputation_blocks(spark):
    """Hosts without any rule: those whose posterior has at most LEVEL of its mass up to the cutoff are blocked, by brute force."""
    rng = random.Random(4)
    hosts = {f"h{i}.d{i % 7}.org": (rng.randint(1, 40), rng.choice([0.05, 0.1, 0.6, 0.97])) for i in range(60)}
    rows, marks = [], []
    for host, (n, rate) in hosts.items():
        for _ in range(n):
            rows.append((len(rows), f"https://{host}/x/{len(rows)}"))
            marks.append((len(marks), int(rng.random() < rate)))
    pages, outcomes = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(marks, "page_id long, bad int")
    rated = {r.host: r for r in url_reputation.host_reputation(pages, outcomes).collect()}
    found = url_reputation.filter_urls(pages, outcomes, rules=()).collect()
    blocked = {r.host for r in found if r.verdict == "block"}
    assert all(r.rule is None for r in found) and 5 <= len(blocked) <= 40
    for host, r in rated.items():
        mass = incomplete_beta(r.alpha, r.beta, 0.5)
        if abs(mass - 0.05) > 1e-3:
            assert (mass < 0.05) == (host in blocked), (host, mass)


def test_all_pages_good_or_bad(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 3}.org/") for i in range(30)], "page_id long, url string")
    for bad, verdict in ((0, "allow"), (1, "block")):
        marks = pages.select("page_id", F.lit(bad).alias("bad"))
        assert {(r.verdict, r.bad_rate, r.bad_rate_lower) for r in url_reputation.filter_urls(pages, marks).collect()} == {(verdict, bad, bad)}


def test_table_of_suffixes(spark):
    pages = spark.createDataFrame([(0, "http://a.b.city.kawasaki.jp/"), (1, "http://x.github.io:80/"), (2, "http://u@www.shop.co.uk/"),
                                   (3, "http://plain.org/"), (4, "http://co.uk/"), (5, "http://localhost/"), (6, None)], "page_id long, url string")
    suffixes = spark.createDataFrame([("co.uk",), ("GitHub.io",), ("city.kawasaki.jp",), ("kawasaki.jp",), ("jp",), ("co.uk",), (None,)], "suffix string")
    hosts = pages.select(url_reputation.url_host(F.col("url")).alias("host"))
    got = {r.host: (r.domain, r.suffix) for r in url_reputation.with_domains(hosts, suffixes).collect()}
    assert got == {"a.b.city.kawasaki.jp": ("b.city.kawasaki.jp", "city.kawasaki.jp"), "x.github.io:80": ("x.github.io", "github.io"),
                   "u@www.shop.co.uk": ("shop.co.uk", "co.uk"), "plain.org": ("plain.org", "org"), "co.uk": ("co.uk", "co.uk"),
                   "localhost": ("localhost", "localhost"), "": ("", "")}
    none = spark.createDataFrame([], "page_id long, bad int")
    assert url_reputation.filter_urls(pages, none, suffix_table=suffixes).count() == 7


def test_page_outcomes(spark):
    pages = spark.createDataFrame([(1, "http://a/en/12.html"), (2, "http://a/en/13/?x"), (3, "http://a/en/"), (4, None)], "page_id long, url string")
    labels = spark.createDataFrame([(12, 1, 1), (13, 1, 0)], "doc_id long, quality int, toxic int")
    assert sorted(tuple(r) for r in page_outcomes(pages, labels).collect()) == [(1, 1), (2, 0)]


# ------------------------------------------------------------------ licences

def brute_scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.lower(text or ""))
    places = [(i, label) for phrase, label in license_scan.BASE_PHRASES for i in range(len(words))
              if words[i:i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return (len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))


def test_license_base_matches_brute_force(spark):
    rng = random.Random(1)
    vocabulary = ["GNU", "general", "Public", "license", "Apache", "cc", "by", "MIT", "the", "é", "cc0", "\u00a0", "x1"]
    texts = [None, "", "MIT License", "mit, license; cc-by-nc", "Apache\nLicense apache license", "xmit license", "mit licensé", "cc\x7fby", "CC BY" * 2]
    texts += [rng.choice([" ", ", ", "-", "\n", "\x85"]).join(rng.choice(vocabulary) for _ in range(rng.randint(1, 40))) for _ in range(200)]
    texts.append("mit license " * 20_000)
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs(spark, [(i, t, "en") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i])[1:6] == brute_scan(t), t
        assert 0 <= got[i].score <= 1 and set(filter(None, got[i].base_labels.split(","))) <= set(got[i].labels.split(","))


@pytest.mark.parametrize("expression,labels,score", [
    ("mit", {"mit"}, 1.0), ("gpl-2.0-only or mit", {"gpl", "mit"}, 1.0), ("gpl-2.0+ and mit", {"gpl", "mit"}, 0.3),
    ("gpl-2.0 with classpath-exception-2.0", {"gpl"}, 0.65), ("mit and (gpl-3.0 or apache-2.0)", {"mit", "gpl", "apache"}, 1.0),
    ("mit or gpl-2.0 and agpl-3.0", {"mit", "gpl", "agpl"}, 1.0), ("(mit or gpl-2.0) and agpl-3.0", {"mit", "gpl", "agpl"}, 0.2),
    ("mit and", {"mit"}, 1.0), ("((mit", {"mit"}, 1.0), ("", set(), 0.0), ("weird-1.0", {"weird-1.0"}, 0.1)])
def test_license_expressions(expression, labels, score):
    assert license_scan.evaluate(expression) == (labels, pytest.approx(score))


@pytest.mark.parametrize("expression,labels,score", [
    ("mit this file is part of foo and the bar copyright 2020", {"mit"}, 1.0), ("(gpl-2.0 proprietary", {"gpl", "proprietary"}, 0.0),
    ("(gpl-2.0 some text mit) proprietary", {"gpl", "mit"}, 0.3), ("mit; and gpl-3.0", {"mit"}, 1.0), ("* mit */ gpl-3.0", {"mit"}, 1.0), ("mit (see file)", {"mit"}, 1.0),
    ("mit) or gpl-3.0", {"mit"}, 1.0), ("or mit", set(), 0.0), ("gpl-2.0 with (mit", {"gpl"}, 0.3), ("gpl-3.0+ with x or mit", {"gpl", "mit"}, 1.0),
    ("gpl-2.0 with and mit", {"gpl"}, 0.3), ("()", set(), 0.0), ("(mit) (gpl-3.0)", {"mit"}, 1.0), ("mit and\tapache-2.0.", {"mit", "apache"}, 1.0)])
def test_where_expressions_end(expression, labels, score):
    assert license_scan.evaluate(expression) == (labels, pytest.approx(score))


def brute_value(tree):
    if isinstance(tree, str):
        return license_scan.OPENNESS.get(license_scan.family(tree), license_scan.UNKNOWN_OPENNESS)
    op, a, b = tree
    a, b = brute_value(a), 1.0 if op == "with" else brute_value(b)
    return max(a, b) if op == "or" else min(a, b) if op == "and" else (a + 1) / 2


def test_random_expressions_match_their_trees():
    rng = random.Random(8)
    names = ["mit", "gpl-2.0", "apache-2.0", "agpl-3.0", "mpl-2.0", "odd-1", "cc-by-4.0", "lgpl-2.1"]
    rank = {"or": 1, "and": 2, "with": 3}

    def grow(depth):
        if depth == 0 or rng.random() < 0.2:
            name = rng.choice(names)
            return ("with", name, "some-exception") if rng.random() < 0.2 else name
        return rng.choice(["and", "or"]), grow(depth - 1), grow(depth - 1)

    def write(tree, outer=0):
        if isinstance(tree, str):
            return tree
        op, a, b = tree
        body = f"{write(a, rank[op])} {op} {write(b, rank[op] + 1)}"
        return f"({body})" if rank[op] < outer or rng.random() < 0.2 and op != "with" else body

    for _ in range(500):
        tree = grow(rng.randrange(6))
        text = write(tree)
        assert license_scan.evaluate(text)[1] == pytest.approx(brute_value(tree)), text
        assert license_scan.evaluate(text + " trailing words")[1] == pytest.approx(brute_value(tree)), text


def test_tags_of_one_line_take_linear_time():
    words, tags = license_scan._automata()
    for body in ("mit and ", "(mit odd ", "((((", "mit"):
        raw = (f"SPDX-License-Identifier: {body} " * 4000).encode()
        begin = time.process_time()
        license_scan.scan_text(raw, words, tags)
        assert time.process_time() - begin < 1


def test_every_notice_matches_brute_force():
    """All phrases of the tables, whole, cut short, run together and interrupted, against a search of word lists."""
    rng = random.Random(8)
    tables = license_scan.DEFAULT
    pairs = license_scan.BASE_PHRASES + tables.phrases
    words, tags = license_scan._automata()
    for _ in range(300):
        parts = []
        for _ in range(rng.randint(0, 6)):
            phrase = rng.choice(pairs)[0].split()
            parts += phrase[:rng.choice([len(phrase), len(phrase), len(phrase) - 1])] + rng.choice([[], ["the"], ["license"]])
        text = "".join(w.upper() + rng.choice([" ", "\n", ", ", " (", "-"]) for w in parts)
        want = {label for phrase, label in pairs for i in range(len(parts)) if parts[i:i + len(phrase.split())] == phrase.split()}
        got = license_scan.scan_text(text.encode(), words, tags)
        assert got[0] == len(parts) and got[5] == ",".join(sorted(want)), text
        assert got[6] == min((tables.openness[x] for x in want), default=0.0)


def test_clauses_and_given_tables(spark):
    clause = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software\n"
              "// and associated documentation files (the \"Software\")")
    rows = [(0, clause, "en"), (1, "Acme Open-Source Deal applies; see MIT License", "en"),
            (2, "SPDX-License-Identifier: acme-1.0 WITH Acme-Lift", "en"), (3, "SPDX-License-Identifier: acme-1.0 WITH other", "en"),
            (4, "the zlib license", "en"), (5, None, None)]
    plain = {r.doc_id: (r.labels, r.score) for r in license_scan.scan_licenses(docs(spark, rows)).collect()}
    assert plain[0] == ("mit", 1.0) and plain[1] == ("mit", 1.0) and plain[4] == ("zlib", 1.0) and plain[5] == ("", 0.0)
    assert plain[2] == plain[3] == ("acme-1.0", pytest.approx(0.55))
    given = license_scan.licences(
        spark.createDataFrame([("Acme open source DEAL", "acme"), ("MIT license", "expat"), ("acme open source deal", "deal"), (None, "x"), ("...", "y")], "phrase string, label string"),
        spark.createDataFrame([("acme", 0.2), ("Acme", 0.4), ("acme", 0.3), ("deal", 0.7), ("mit", 1.0), (None, 1.0)], "label string, openness double"),
        spark.createDataFrame([("Acme-Lift", 1.0)], "exception string, lift double"))
    got = {r.doc_id: (r.labels, r.base_labels, r.score) for r in license_scan.scan_licenses(docs(spark, rows), tables=given).collect()}
    assert got[0] == ("", "", 0.0) and got[1] == ("acme,deal,expat,mit", "mit", license_scan.UNKNOWN_OPENNESS)
    assert got[2] == ("acme", "", 1.0) and got[3] == ("acme", "", pytest.approx(0.6)) and got[4] == ("", "", 0.0)


def test_a_table_beyond_the_bound_is_refused(spark, monkeypatch):
    monkeypatch.setattr(license_scan, "MAX_TABLE", 3)
    with pytest.raises(ValueError):
        license_scan.licences(spark.range(4).selectExpr("concat('p', id) AS phrase", "'l' AS label"))
    assert len(license_scan.licences(spark.range(3).selectExpr("concat('p', id) AS phrase", "'l' AS label")).phrases) == 3


def test_license_tags(spark):
    rows = [(1, "// SPDX-License-Identifier: (MIT OR GPL-2.0-only) */\nrest", "en"), (2, "SPDX-License-Identifier: GPL-3.0 AND MIT", "en"),
            (3, "Mozilla Public License and MIT License", "en"), (3, "none", "en"), (None, "All rights reserved", "en")]
    got = sorted((r.doc_id or 0, r.labels, r.score) for r in license_scan.scan_licenses(docs(spark, rows)).collect())
    assert got == [(0, "proprietary", 0.0), (1, "gpl,mit", 1.0), (2, "gpl,mit", 0.3), (3, "", 0.0), (3, "mit,mpl", 0.6)]
    assert license_scan.scan_licenses(docs(spark, [])).count() == 0


# ------------------------------------------------------------------ chat

def test_chat_perspectives(spark):
    schema = "conv_id long, turn int, role string, text string, segment string, copies int"
    rows = [(1, 0, "system", "S"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, "cy", "yé"), (1, 600, "ann", "bye"), (1, 3, "cy", "yé"),
            (None, None, "ann", "x"), (None, 1, None, "y"), (2, 0, "system", "only"), (3, 0, "ann", "w" * 300_000)]
    df = spark.createDataFrame([(*r, "s", 3) for r in rows], schema)
    got = chat.perspectives(df).collect()
    groups = {}
    for r in got:
        groups.setdefault((r.conv_id, r.assistant), []).append(r)
    assert set(groups) == {(1, "ann"), (1, "bob"), (1, "cy"), (None, "ann"), (3, "ann")}
    for (conv, who), turns in groups.items():
        turns.sort(key=lambda r: r.seq)
        assert [r.seq for r in turns] == list(range(len(turns))) and len(turns) == sum(x[0] == conv for x in rows)
        whole = "".join(r.segment for r in turns)
        for r in turns:
            assert whole[r.start:r.end] == r.segment
            assert (r.mask_start is not None) == (r.speaker == who)
            if r.mask_start is not None:
                assert whole[r.mask_start:r.mask_end].endswith("<|im_end|>") and whole[:r.mask_start].endswith("assistant\n")
    whole = "".join(r.segment for r in groups[1, "bob"])
    assert whole == ("<|im_start|>system\nS<|im_end|>\n<|im_start|>user name=ann\nhi<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
                     + "<|im_start|>user name=cy\nyé<|im_end|>\n" * 2 + "<|im_start|>user name=ann\nbye<|im_end|>\n")
    assert [r.speaker for r in groups[None, "ann"]] == ["ann", None]
    assert chat.perspectives(df.limit(0)).count() == 0
    assert isinstance(df.schema["text"].dataType, T.StringType)
