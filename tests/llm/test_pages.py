"""Page operators against brute force, over odd, repeated, very long and empty inputs."""

import hashlib
import html
import re
import time

import pytest
from pyspark.sql import functions as F

from radarframe.llm import htmltext, urlfilter, warc


@pytest.fixture(scope="module")
def pages(spark):
    long = "<p>" + "text &amp; more " * 20_000 + "</p>"
    rows = [(k, f"http://a.example.org/{k}", "<p>" + "same payload " * 20 + "</p>") for k in range(5, 30)]
    rows += [(40, None, None), (41, "nonsense", ""), (42, "http://b.example.com/x", long), (None, "http://c.d/", "<p>no id</p>"), (43, "http://c.d/e\r\nf", "tiny"), (44, "http://c.d/", "tiny"), (5, "http://a.example.org/5", "<p>" + "same payload " * 20 + "</p>")]
    return spark.createDataFrame([(*r, 7) for r in rows], "page_id long, url string, html string, host int").repartition(3)


def test_archives_round_trip(pages):
    got = sorted((tuple(r) for r in warc.archived(pages).collect()), key=str)
    want = []
    for r in pages.collect():
        data = (r.html or "").encode()
        revisit = "same payload" in (r.html or "") and r.page_id != 5
        want.append((r.page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", 5 if revisit else None))
    assert got == sorted(want, key=str)
    assert warc.archived(pages.where("false")).count() == 0


def test_archive_files_open_with_the_dictionary(spark, pages, tmp_path):
    warc.write_archives(pages, f"file://{tmp_path}/w")
    files = [p for p in (tmp_path / "w").iterdir() if p.name.startswith("part-")]
    assert files and all(p.read_bytes()[:4] == warc.DICTIONARY_FRAME for p in files if p.stat().st_size)


def test_main_text_of_a_page():
    page = """<html><head><title>T</title><script>if (a<b) "</p>"</script></head><body><header><h1>Site</h1></header><nav><ul><li>Menu</ul></nav>
    <div class="cookie-notice">Accept</div><article class="post"><h1>A &lt;title&gt;</h1><p>First <b>bold<br>line</b>&nbsp;&amp; so   on<p>Second<div class="ad">Buy</div>
    <section id="comments"><p>Nice!</p></section><ul><li>x<li>y</ul></article><aside>More</aside><footer>&copy; us</footer>"""
    assert htmltext.main_text(page) == "A <title>\nFirst bold line & so on\nSecond\nx\ny"
    assert htmltext.main_text("") == "" and htmltext.main_text("a < b &amp c") == "a < b & c"
    assert htmltext.main_text("<p>cut <scr") == "cut" and htmltext.main_text("<div>" * 5000 + "deep") == "deep"


def test_site_templates_are_deleted(spark):
    rows = [(k, f"http://t.example.org/{k}", f"<body><div><p>Our slogan</p></div><div><p>Article number {k}</p></div></body>") for k in range(12)]
    rows += [(100, "http://other.example.org/", "<body><div><p>Our slogan</p></div></body>")]
    got = {r.page_id: r.text for r in htmltext.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**{k: f"Article number {k}" for k in range(12)}, 100: "Our slogan"}


def test_repeated_paragraphs_of_articles_stay(spark):
    rows = [(k, f"http://t.example.org/{k}", f"<body><article><p>License line</p><p>Number {k}</p></article></body>") for k in range(12)]
    got = {r.page_id: r.text for r in htmltext.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"License line\nNumber {k}" for k in range(12)}


def test_copies_on_one_host_keep_their_text(spark, pages):
    got = [r.text for r in htmltext.extract_text(pages).collect() if r.url and r.url.startswith("http://a.example.org/")]
    assert len(got) == 26 and set(got) == {" ".join(["same payload"] * 20)}
    rows = [(k, f"http://t.example.org/{k}", f"<body><div>Our slogan</div><p>Article number {k % 9}</p></body>") for k in range(90)]
    got = {r.page_id: r.text for r in htmltext.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Article number {k % 9}" for k in range(90)}


def test_templates_of_a_section_of_a_large_host(spark):
    rows = [(k, f"http://t.example.org/{k}", f"<body>{'<div>Section list</div>' if k < 50 else ''}<p>Article number {k}</p></body>") for k in range(600)]
    rows += [(600 + k, f"http://other.example.org/{k}", f"<body><div>Section list</div><p>Other {k}</p></body>") for k in range(4)]
    got = {r.page_id: r.text for r in htmltext.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**{k: f"Article number {k}" for k in range(600)}, **{600 + k: f"Section list\nOther {k}" for k in range(4)}}


def test_text_of_odd_pages(pages):
    got = htmltext.extract_text(pages).collect()
    assert len(got) == pages.count() and all(r.n_chars == len(r.text) for r in got)
    assert htmltext.extract_text(pages.where("false")).count() == 0


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("http://X.Example.ORG:80/es/a?b", "x.example.org:80", "/es/a", None, "allow"), ("http://x.Example.org/es/a?b", "x.example.org", "/es/a", "example.org/es/", "block"),
        ("https://example.org/en/12#t", "example.org", "/en/12", "example.org/en/1", "block"), ("https://example.org/fr", "example.org", "/fr", "org/", "allow"), ("http://org", "org", "", None, "allow"),
        ("http://badexample.org/es/", "badexample.org", "/es/", "org/", "allow"), ("https://casino.example.com/fr/1", "casino.example.com", "/fr/1", "com/fr/", "allow"), ("https://casino.example.net/", "casino.example.net", "/", None, "block"),
        ("https://casinos.example.net/", "casinos.example.net", "/", None, "allow"), ("https://free-bets.example.net/", "free-bets.example.net", "/", None, "block"), ("https://free-free.example.net/", "free-free.example.net", "/", None, "allow"),
        ("casino", "", "", None, "block"), (None, "", "", None, "allow"), ("://?casino", "", "", None, "block"), ("casino.example.net/xxx", "", "", None, "block"), ("nothing here", "", "", None, "allow"),
        ("http://a.example.net/c%61sino", "a.example.net", "/c%61sino", None, "block"), ("http://a.example.net/?q=free&r=%62ets", "a.example.net", "/", None, "block"), ("http://a.example.net/casino%C3%A9", "a.example.net", "/casino%C3%A9", None, "allow"),
    ],
)
def test_urls(spark, url, host, path, rule, verdict):
    r = urlfilter.judge_urls(spark.createDataFrame([(1, url)], "page_id long, url string")).first()
    assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)


def test_urls_of_tables(pages):
    assert urlfilter.judge_urls(pages).count() == pages.count() and urlfilter.judge_urls(pages.where("false")).count() == 0
    assert urlfilter.keep_allowed(pages).columns == pages.columns


def test_allowed_rows_not_ids(spark):
    rows = [(1, "http://a.example.net/"), (1, "http://casino.example.net/"), (None, "http://xxx.example.net/"), (None, "http://b.example.net/"), (None, None)]
    kept = urlfilter.keep_allowed(spark.createDataFrame(rows, "page_id long, url string"))
    assert sorted(r.url or "" for r in kept.collect()) == ["", "http://a.example.net/", "http://b.example.net/"]


def test_own_vocabulary(spark):
    pages = spark.createDataFrame([(1, "http://a.example.net/tea-and-milk"), (2, "http://a.example.net/tea/tea"), (3, "http://a.example.net/casino")], "page_id long, url string")
    got = {r.page_id: (r.verdict, r.n_strict, r.n_soft) for r in urlfilter.judge_urls(pages, strict=(), soft=("tea", "milk"), rules=()).collect()}
    assert got == {1: ("block", 0, 2), 2: ("allow", 0, 1), 3: ("allow", 0, 0)}


def test_a_vocabulary_is_a_table_of_terms_and_weights(spark, monkeypatch):
    """A hundred thousand terms, and urls judged by plain Python."""
    import random

    rng = random.Random(3)
    terms = {f"t{k}x{rng.randrange(1000)}": (k % 10 == 0, 0.5 + k % 3 * 0.5) for k in range(100_000)}
    listed = list(terms)
    rows = [(t, s, w) for t, (s, w) in terms.items()] + [(None, True, 1.0), ("", True, 1.0), ("unweighted", False, None), ("ZERO", False, 0.0), ("TWICE", False, 0.2), ("twice", False, 5.0)]
    words = urlfilter.vocabulary_of(spark.createDataFrame(rows, "term string, strict boolean, weight double"))
    assert len(words.strict) == 10_000 and len(words.soft) == 90_001 and words.soft["twice"] == 5.0
    urls = ["http://a.b/" + "-".join(rng.choice(listed) if rng.random() < 0.4 else f"plain{rng.randrange(99)}" for _ in range(rng.randrange(5))) for _ in range(300)] + ["http://a.b/Twice", "http://a.b/unweighted/zero", None]
    urls.append("http://a.b/" + "y" * 50_000 + "/" + listed[10])
    got = urlfilter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules=(), vocabulary=words).collect()
    for r in got:
        parts = set(re.split("[^a-z0-9]+", (urls[r.page_id] or "").lower()))
        strict, soft = parts & words.strict, [words.soft[t] for t in parts if t in words.soft]
        assert (r.n_strict, r.n_soft, r.verdict) == (len(strict), len(soft), "block" if strict or sum(soft) >= 2 else "allow"), urls[r.page_id]
    assert {r.verdict for r in got} == {"allow", "block"}
    monkeypatch.setattr(urlfilter, "MOST_TERMS", 5)
    with pytest.raises(ValueError):
        urlfilter.vocabulary_of(spark.createDataFrame(rows, "term string, strict boolean, weight double"))


ARTICLE = re.compile("<article>(.*?)</article>", re.S)


def article_text(source):
    """The blocks of a page made of plain paragraphs and headings in one article."""
    (inside,) = ARTICLE.findall(source)
    lines = re.split("</?(?:p|h1|h2|h3|ul|ol|li|pre|blockquote)>", inside.replace("<br>", " "))
    texts = (" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in lines)
    return "\n".join(x for x in texts if x)


@pytest.fixture(scope="module")
def web(spark):
    return spark.read.parquet("/root/testdata/sf0.01/pages.parquet")


def test_text_of_all_pages_equals_brute_force(web):
    want = {r.page_id: article_text(r.html) for r in web.collect() if r.html and ARTICLE.search(r.html)}
    got = {r.page_id: r.text for r in htmltext.extract_text(web).collect()}
    assert len(want) > 200 and {k: got[k] for k in want} == want


@pytest.mark.parametrize("names", [True, False])
def test_counting_alone_finds_the_text(spark, web, names):
    """Without the opinion of tags and classes, and even without their names, the counted templates leave the same text, and lose none."""
    want = {r.page_id: r.text for r in htmltext.extract_text(web).collect()}
    if not names:
        plain = F.regexp_replace(F.regexp_replace("html", "<(/?)(nav|footer|article|main|header|aside)\\b", "<$1div"), ' (class|id|role)="[^"]*"', "")
        web = web.withColumn("html", plain)
    got = {r.page_id: r.text for r in htmltext.extract_text(web, marks=False).collect()}
    assert all(set(want[k].split("\n")) <= set(got[k].split("\n")) for k in want)
    assert sum(got[k] == want[k] for k in want) >= 0.9 * len(want)


def test_menus_and_adverts_whose_words_differ(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rows = []
    for k in range(12):
        menu = "".join(f"<li><a href='/{w}'>{w} {k}</a></li>" for w in words[k % 5 : k % 5 + 4])
        body = "".join(f"<p>Paragraph {j} of page {k} tells of rivers and towns at some length.</p>" for j in range(3 + k % 4))
        rows.append((k, f"http://t.example.org/{k}", f"<body><div><ul>{menu}</ul></div><div>Advert {words[k % 10]}</div><div><h2>Title {k}</h2>{body}</div><div><span>Imprint {k}</span></div></body>"))
    got = {r.page_id: r.text for r in htmltext.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(12):
        assert got[k].split("\n") == [f"Title {k}", *(f"Paragraph {j} of page {k} tells of rivers and towns at some length." for j in range(3 + k % 4))]


def test_nesting_takes_time_in_proportion():
    for tag in ("<div>", "<ul>", "<ul><li>", "<b>", "<p>", "<table><tr><td>", "<div></x>"):
        began = time.perf_counter()
        source = "<main>" + tag * (1_000_000 // len(tag)) + "deep"
        htmltext.candidates(htmltext.hashed(htmltext.tree(source)))
        assert time.perf_counter() - began < 30, tag


def test_samples_are_of_rows_and_bounded(spark, monkeypatch):
    monkeypatch.setattr(warc, "SAMPLE", 20)
    drawn = []
    monkeypatch.setattr(warc, "record", lambda *a, real=warc.record: drawn.append(a) or real(*a))
    for ids in ("cast(null as long)", "7L", "id"):
        warc.trained(spark.range(500).selectExpr(f"{ids} as page_id", "'http://a.b/' as url", "repeat(concat('<p>', id), 50) as html"))
    assert 20 <= len(drawn) <= 63


def test_large_pages_share_no_file_with_many(spark, tmp_path, monkeypatch):
    """No file holds more than the bound and one record, whatever sizes follow each other in a task."""
    monkeypatch.setattr(warc, "FILE_BYTES", 10_000)
    pages = spark.range(30).selectExpr("id as page_id", "'http://a.b/' as url", "repeat(cast(id as string), cast(case when id < 10 then 50 when id < 20 then 1000 else 9000 end as int)) as html").coalesce(1)
    warc.write_archives(pages, f"file://{tmp_path}/w")
    got = warc.read_archives(spark, f"file://{tmp_path}/w").collect()
    assert sorted(r.page_id for r in got) == list(range(30))
    held = {r.page_id: r.payload_bytes for r in got}
    files = [p for p in (tmp_path / "w").iterdir() if p.name.startswith("part-") and p.stat().st_size]
    each = [[r.page_id for r in warc.read_archives(spark, f"file://{p}").collect()] for p in files]
    assert len(files) >= 10 and all(sum(held[k] for k in ids[:-1]) <= 10_000 for ids in each)


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<form><article><p>kept?</p></article></form>", "kept?"), ('<article class="social-science"><p>kept</p></article>', "kept"), ('<article id="menu"><p>kept</p></article>', "kept"),
        ('<main><section class="header-story"><p>kept</p></section></main>', "kept"), ('<form id="aspnetForm"><div><p>All of the page</p></div><div class="ad">Buy</div></form>', "All of the page"),
        ('<article><p>Text</p><section class="related-work"><p>Others did this</p></section><p class="share-price">It fell</p></article>', "Text\nOthers did this\nIt fell"),
        ('<form><nav>Menu</nav><article><p>Own</p></article><section id="comments"><article class="comment"><p>Nice</p></article></section></form>', "Own"),
        ('<article class="promo"><p>Buy</p></article><article><p>Own</p></article>', "Own"), ('<article class="menu"><p>One</p></article><article class="ad"><p>Two</p></article>', "One\nTwo"),
        ('<div class="site-header">Site</div><div><p>A text that is long enough</p></div><div class="page-footer-links">End</div>', "A text that is long enough"),
        ('<article><p>Short own text here</p><div class="comments"><p>' + "much longer reader comment " * 2 + "</p></div></article>", "Short own text here"),
        ('<div role="main" class="ads"><p>kept</p></div>', "kept"), ('<div hidden><article>no</article></div><p>yes</p>', "yes"), ('<aside><p>All there is</p></aside>', "All there is"),
    ],
)
def test_marks_lose_no_article(source, text):
    assert htmltext.main_text(source) == text


def test_many_marks_take_linear_time():
    began = time.process_time()
    assert htmltext.main_text("<div class=ad>" * 20_000 + "deep") == "deep"
    htmltext.main_text("<div class=ad><p>x</p></div>" * 20_000)
    assert time.process_time() - began < 20


def test_archive_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    rows = [(k, None, f"{k} " * (500 if k != 40 else 30_000)) for k in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    warc.write_archives(pages, f"file://{tmp_path}/w")
    files = [p.read_bytes() for p in (tmp_path / "w").iterdir() if p.name.startswith("part-")]
    sizes = [sum(m == 0xFD2FB528 for m, _ in warc.frames(d)) for d in files]
    assert sum(sizes) == 60 and max(sizes) <= 21 and len(files) >= 4
    assert all(d.startswith(warc.DICTIONARY_FRAME) for d in files if d)
    assert warc.read_archives(spark, f"file://{tmp_path}/w").count() == 60
