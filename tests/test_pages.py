"""Page extraction: links, metadata, images and text of pages that are not tidy."""

from pyspark.sql import functions as F

from pagesift.functions.html import extract
from pagesift.operators import pages
from pagesift.sources.pages import read_pages

URL = "https://example.com/dir/page"


def links(html, scope="body"):
    found = extract(URL, html, scope)
    return [(x["url"], x["text"]) for x in found["internal"]], [(x["url"], x["text"]) for x in found["external"]]


def test_links():
    inner, outer = links('<body><a href="/internal" title="t">Inter <b>nal</b></a><a href="https://other.com">External</a></body>')
    assert inner == [("https://example.com/internal", "Internal")] and outer == [("https://other.com", "External")]
    assert extract(URL, '<a href="/x" title="t">y</a>')["internal"][0]["title"] == "t"


def test_untidy_links():
    assert links('<a href="/a">one<a href="/b">two')[0] == [("https://example.com/a", "one"), ("https://example.com/b", "two")]
    assert links('<a href="">self</a><a href=" /c ">c</a><a>none</a>')[0] == [(URL, "self"), ("https://example.com/c", "c")]
    assert links("<nav><a href='/n'>n</a></nav><a href='/m'>m</a>")[0] == [("https://example.com/m", "m")]
    assert len(links("<nav><a href='/n'>n</a></nav><a href='/m'>m</a>", "all")[0]) == 2
    assert len(extract(URL, "".join(f"<a href='/{i}'>x</a>" for i in range(150)))["internal"]) == 100


def test_links_that_cannot_be_parsed():
    found = extract("http://[bad", '<a href="http://[x">bad</a><a href="https://ok.com/">ok</a><img src="http://[y"><p>text</p>')
    assert [x["url"] for x in found["external"]] == ["https://ok.com/"] and [x["url"] for x in found["internal"]] == ["http://[x"]
    assert found["content"].endswith("text") and found["images"] == [{"url": "http://[y", "alt": ""}]


def test_metadata_and_title():
    html = """<meta name="description" content="Desc"><meta name="description" content="later"><meta name="keywords" content="test, demo"><meta property="og:x" content="1">
        <meta property="og:x" content=""><meta property="og:x" content="2"><meta name="author" content="Author"><link rel="canonical" href="https://example.com/canonical">"""
    assert extract(URL, html)["metadata"] == {
        "description": "Desc", "keywords": "test, demo", "og:x": "2", "author": "Author", "canonical_url": "https://example.com/canonical"
    }
    assert extract(URL, "<title> T </title>")["title"] == "T"
    assert extract(URL, '<title> </title><meta property="og:title" content="OG">')["title"] == "OG"
    assert extract(URL, "<p>x</p>")["title"] == "No title found"


def test_text():
    assert extract(URL, "<title>T</title><p>no body</p>at all")["content"] == "no body\nat all"
    assert extract(URL, "<body><article>b</article><main>m<nav>n</nav></main></body>")["content"] == "m"
    assert extract(URL, "<body>a<article>b</article></body>")["content"] == "b"
    assert len(extract(URL, "<body>" + "x" * 20_000)["content"]) == 12_000
    assert extract(None, None)["content"] == ""


def test_images():
    found = extract(URL, '<img src="a.png" alt="A"><img data-src="/b.png"><img alt="none">' + "<img src='z'>" * 60)["images"]
    assert found[:2] == [{"url": "https://example.com/dir/a.png", "alt": "A"}, {"url": "https://example.com/b.png", "alt": ""}] and len(found) == 50


def test_tables(spark, tmp_path):
    rows = spark.createDataFrame(
        [(1, URL, '<a href="/a">a</a><a href="https://o.com">o</a><a href="/b">b</a>', 200), (2, None, None, None)],
        "page_id long, url string, html string, status_code int"
    )
    rows.write.parquet(str(tmp_path / "p"))
    rows.write.json(str(tmp_path / "j"))
    for kind in ("parquet", "json"):
        found = pages.extract_pages(read_pages(spark, str(tmp_path / kind[0]), kind))
        assert sorted(map(tuple, pages.link_counts(found).collect())) == [(1, 2, 1), (2, 0, 0)]
        assert sorted(
            (r.kind, r.pos, r.text) for r in pages.page_links(found).collect()
        ) == [("external", 0, "o"), ("internal", 0, "a"), ("internal", 1, "b")]
    arriving = read_pages(spark, str(tmp_path / "p"), streaming=True)
    query = pages.link_counts(pages.extract_pages(arriving)).writeStream.format("memory").queryName("arriving").option(
        "checkpointLocation", str(tmp_path / "state")
    ).trigger(availableNow=True).start()
    assert query.awaitTermination(60) and spark.table("arriving").count() == 2


def test_page_passes_take_time_in_proportion():
    import time

    from pagesift.functions import serp
    from pagesift.functions.html import extract
    from pagesift.functions.text import sanitize

    def seconds(run, text):
        best = 9.0
        for _ in range(2):
            began = time.perf_counter()
            run(text)
            best = min(best, time.perf_counter() - began)
        return best

    extracted = lambda t: extract("http://a.example/", t)
    cases = {
        "unclosed p": (extracted, lambda n: "<body>" + "<p>word" * n), "unclosed li": (extracted, lambda n: "<body>" + "<li>word</b>" * n),
        "result page": (lambda t: serp.hits(t, "duckduckgo"), lambda n: '<div class="result">' + "<li>word</b>" * n),
        "open fences": (lambda t: sanitize(t, 8000), lambda n: "```py\nx " * n),
    }
    for name, (run, text) in cases.items():
        small, large = seconds(run, text(8_000)), seconds(run, text(32_000))
        assert large <= 6 * small + 0.05 and seconds(run, text(16_000)) < 0.5, (name, small, large)


def test_spaced_lists_of_many_lines(spark):
    import time

    from pagesift.functions import text as T

    lines = spark.range(1).select(T.spaced_lists(F.repeat(F.lit("word\n- item\n"), F.lit(16_000))).alias("x"))
    began = time.time()
    assert lines.select(F.length("x")).first()[0] == 16_000 * 13
    assert time.time() - began < 2


def test_addresses_against_the_standard_library(spark):
    import ipaddress
    import random

    from pagesift.functions import urls as U

    def want(text):
        try:
            ip = ipaddress.ip_address(text.partition("%")[0])
        except ValueError:
            return None
        return (getattr(ip, "ipv4_mapped", None) or ip).is_global

    rng = random.Random(1)
    some = ["", "1.2.3", "01.2.3.4", "1.2.3.256", "::", "::1", "1::2::3", ":::", "fe80::1%eth0", "::ffff:8.8.8.8", "64:ff9b::1.2.3.4", "12345::", "1:2:3:4:5:6:7::", "1:2:3:4:5:6:7:8:9", "::1.2.3", ":1:2:3:4:5:6:7", "host", "::1\n"]
    for _ in range(2000):
        four = ipaddress.ip_address(rng.getrandbits(32))
        edge = int(rng.choice(["a00", "7f00", "a9fe", "ac10", "ac20", "c000", "c0a8", "c612", "cb00", "f000", "6440", "6480"]).ljust(8, "0"), 16) + rng.randrange(-3, 700)
        six = ipaddress.IPv6Address((rng.choice([0x2001, 0x2002, 0xFC00, 0xFE80, 0xFEC0, 0x0064, 0x2606]) << 112) + rng.getrandbits(rng.choice([3, 40, 112])))
        some += [str(four), str(ipaddress.ip_address(edge % 2**32)), str(six), six.exploded.upper(), f"::ffff:{four}"]
    df = spark.createDataFrame([(x,) for x in some], "x string").select("x", U.public_address(F.col("x")).alias("public"))
    assert [(r.x, r.public) for r in df.collect() if r.public != want(r.x)] == []
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_the_best_of_several_scrapes(spark):
    base = spark.createDataFrame([("a", "short", "timeout"), ("b", "long enough", None), ("c", None, None)], "url string, content string, error string")
    again = spark.createDataFrame(
        [("a", "a longer text", None), ("a", "middling", None), ("a", "the longest text of all", "timeout"), ("b", "x", None), ("c", None, None)],
        "url string, content string, error string"
    )
    got = sorted(map(tuple, pages.prefer_rescrapes(base, again).collect()))
    assert got == [("a", "a longer text", None), ("b", "long enough", None), ("c", None, None)]
