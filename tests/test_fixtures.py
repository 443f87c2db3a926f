"""Small cases with known results: payloads, pages, URLs, queries, reports, alerts."""

import json
import unicodedata

import pytest
from pyspark.sql import functions as F

from pagesift.functions import text as T
from pagesift.functions import urls as U
from pagesift.functions.html import extract
from pagesift.operators import monitor, pages, querylog, ranking, replay, reports
from pagesift.sources import feeds

RSS = "<rss><channel><item><title>Test Article</title><link>https://example.com/article</link><description>Test description</description><pubDate>Mon, 01 Jan 2026 00:00:00 GMT</pubDate></item></channel></rss>"
ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://a/1</id><title>One</title><summary>About</summary><published>2024-01-02</published></entry><entry><id>http://a/1</id><title>Again</title></entry><entry><id>http://a/2</id></entry></feed>'
PUBMED = "<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID Version='1'>77</PMID><Article><Journal><JournalIssue><PubDate><Year>2023</Year></PubDate></JournalIssue></Journal><ArticleTitle>On x</ArticleTitle><Abstract><AbstractText>First</AbstractText><AbstractText>Second</AbstractText></Abstract></Article></MedlineCitation></PubmedArticle><PubmedArticle><MedlineCitation><PMID Version='1'>78</PMID></MedlineCitation></PubmedArticle></PubmedArticleSet>"
SERP = """<div class="result"><h2><a class="result__a" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fexample.com%2Farticle%2Bx&rut=1">A <b>title</b></a></h2><a class="result__snippet" href="#">Some text</a></div>
<div class="result"><a class="result__a" href="/own">Own</a></div><div class="result">no link</div>
<form><input type="hidden" name="q" value="x"></form><form><input type="hidden" name="s" value="10"><input type="hidden" name="vqd" value="token-123"><input name="seen"></form>"""


def values(df):
    return [tuple(r) for r in df.collect()]


def one(spark, value, function, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(function(F.col("x"))).first()[0]


def test_feeds(spark):
    raw = spark.createDataFrame([(1, RSS), (2, "not xml at all <><"), (3, None)], "query_id long, xml string")
    assert values(feeds.feed_candidates(raw)) == [
        (1, 0, "Test Article", "https://example.com/article", "Test description", "Mon, 01 Jan 2026 00:00:00 GMT")
    ]
    raw = spark.createDataFrame([(1, ATOM), (2, "<"), (3, None)], "query_id long, xml string")
    assert values(feeds.arxiv_candidates(raw)) == [(1, 0, "One", "http://a/1", "About", "2024-01-02")]
    raw = spark.createDataFrame([(1, PUBMED), (2, "<")], "query_id long, xml string")
    assert sorted(values(feeds.pubmed_candidates(raw))) == [
        (1, 0, "On x", "https://pubmed.ncbi.nlm.nih.gov/77/", "First", "2023"), (1, 1, "PubMed 78", "https://pubmed.ncbi.nlm.nih.gov/78/", "", None)
    ]


def test_json_payloads(spark):
    wiki = json.dumps({"query": {"search": [{"title": "Café x", "snippet": "<b>a</b> b"}]}})
    raw = spark.createDataFrame([(1, wiki), (2, "{"), (3, None)], "query_id long, json string")
    assert values(feeds.encyclopedia_candidates(raw)) == [(1, 0, "Café x", "https://en.wikipedia.org/wiki/Caf%C3%A9_x", "a b")]
    raw = spark.createDataFrame(
        [(1, json.dumps({"hits": [{"title": None, "story_title": "S", "url": "", "story_url": "http://s"}, {"title": "T"}]}))],
        "query_id long, json string"
    )
    assert values(feeds.story_candidates(raw)) == [(1, 0, "S", "http://s", "{}", None)]


def test_result_pages(spark):
    raw = spark.createDataFrame([(1, SERP), (2, None)], "query_id long, html string")
    assert values(feeds.result_page_candidates(raw)) == [(1, 0, "Atitle", "https://example.com/article+x", "Some text", "example")]
    assert values(feeds.next_page_fields(raw)) == [(1, {"s": "10", "vqd": "token-123"}), (2, None)]
    google = '<div class="g"><a href="/url?q=1&url=https%3A%2F%2Fgithub.com%2Fx"><h3>G</h3></a><div class="VwiC3b">Text</div></div><div class="g"><h3>S</h3><a href="/search?q=2">x</a></div>'
    raw = spark.createDataFrame([(1, google)], "query_id long, html string")
    assert values(feeds.result_page_candidates(raw, "google")) == [(1, 0, "G", "https://github.com/x", "Text", "github")]


def test_results_are_written_as_json_lines(spark, tmp_path):
    spark.createDataFrame([(1, "a\nb")], "n int, t string").write.json(str(tmp_path / "out"))
    assert values(spark.read.schema("n int, t string").json(str(tmp_path / "out"))) == [(1, "a\nb")]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<pre><code class='language-python'>\n\nif x:\n    y  = 1\n\n</code></pre><p>after</p>", "```python\nif x:\n    y  = 1\n```\nafter"),
        ("<pre class='hl sql'>SELECT  1</pre>", "```sql\nSELECT  1\n```"),
        ("<p>use</p><code>pip</code>", "use\n`pip`"),
        ("<code>" + "a" * 50 + "\n" + "b" * 20 + "</code>", "```\n" + "a" * 50 + "\n" + "b" * 20 + "\n```"),
        ("<pre>  \n </pre><p>x</p>", "x"),
        ("<pre>open", "```\nopen\n```"),
        ("<script>alert('test');</script><p>Real   content</p>", "Real content"),
        ("", ""),
    ],
)
def test_code_blocks(html, want):
    assert extract("https://example.com", f"<html><body>{html}</body></html>")["content"] == want


def test_sanitized():
    assert T.sanitize("a &lt;b&gt;  c\x00\r\n\n\n\nd javascript:alert(1) e", 99) == "a <b> c\n\nd e"
    assert T.sanitize("x\n```py\na    b\n\n\n\nc\n```\ny    z", 99) == "x\n```py\na    b\n\n\n\nc\n```\ny z"
    assert T.sanitize("abc ```\ncode\n```", 9) == "abc" + T.SAFETY_NOTE
    assert T.sanitize(None, 9) == ""


@pytest.mark.parametrize(
    ("url", "reason"),
    [
        ("http://127.0.0.1/admin", "private_address"),
        ("http://[::1]/admin", "private_address"),
        ("http://169.254.169.254/latest/meta-data/", "private_address"),
        ("http://0.0.0.0/", "private_address"),
        ("http://[::ffff:127.0.0.1]/", "private_address"),
        ("file:///etc/passwd", "scheme"),
        ("http://u:p@example.com/", "credentials"),
        ("http://localhost./", "localhost"),
        ("http:///x", "no_host"),
        (None, "scheme"),
        ("https://example.com:8443/articles?id=1", None),
    ],
)
def test_unsafe_urls(spark, url, reason):
    assert one(spark, url, U.unsafe_reason) == reason


def test_resolved_urls(spark):
    urls = spark.createDataFrame(
        [("https://internal.example.test",), ("https://example.com/articles?id=1",), ("http://nowhere.example/",), ("http://8.8.8.8/",)], "url string"
    )
    dns = spark.createDataFrame(
        [("internal.example.test", "10.0.0.8"), ("internal.example.test", "93.184.216.34"), ("example.com", "93.184.216.34")],
        "host string, ip string"
    )
    got = {r.url: r.reason for r in U.screen_resolved(urls, dns).collect()}
    assert got == {
        "https://internal.example.test": "private_address", "https://example.com/articles?id=1": None, "http://nowhere.example/": "unresolved",
        "http://8.8.8.8/": None
    }


def test_variants(spark):
    rows = spark.createDataFrame(
        [
            (
                1, "OpenAI ajanlari", "OpenAI ajanlari son gelismeler",
                ["OpenAI ajanlari son gelismeler", "OpenAI agents latest updates", "  OpenAI ajanlari  ", "extra"]
            ),
            (2, "x", None, None), (3, None, None, [])
        ],
        "query_id long, original string, normalized string, variants array<string>",
    )
    got = [r.variants for r in querylog.query_variants(rows, 3).orderBy("query_id").collect()]
    assert got == [["OpenAI ajanlari son gelismeler", "OpenAI ajanlari", "OpenAI agents latest updates"], ["x"], []]


def test_case_is_folded_in_every_script(spark):
    """Letters are equal just where Python's case folding makes them equal, as far as both know them."""
    letters = [c for c in map(chr, range(1, 0xD800)) if unicodedata.category(c) != "Cn"]
    rows = spark.createDataFrame([(c,) for c in letters], "c string").select("c", T.caseless(F.col("c")).alias("k")).collect()
    ours, python = {}, {}
    for c, k in rows:
        ours.setdefault(k, set()).add(c)
        python.setdefault(c.casefold(), set()).add(c)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, python.values()))
    text = "Straße STRASSE ΟΔΟΣ οδος ırmak IRMAK"
    same = spark.createDataFrame([tuple(text.split())], "a string, b string, c string, d string, e string, f string")
    two = lambda x, y: T.caseless(F.col(x)) == T.caseless(F.col(y))
    assert tuple(same.select(two("a", "b"), two("c", "d"), two("e", "f")).first()) == (True, True, False)


def test_budget(spark):
    rows = spark.createDataFrame(
        [(5, None, True), (70, None, True), (None, 1, False), (None, 40, False), (40, None, False)], "requested int, suggested int, deep boolean"
    )
    assert [(r.target, r.pool) for r in querylog.source_budget(rows).collect()] == [(15, 25), (50, 50), (1, 15), (15, 20), (15, 20)]


def test_expanded_sources(spark):
    selected = spark.createDataFrame([(1, "u1", "t", "web", 7)], "query_id long, url string, title string, type string, priority int")
    ranked = spark.createDataFrame(
        [(1, "u1", "rust", "", "s", 1), (1, "u2", "off topic", "", None, 2), (1, "u3", "Rust book", "", None, 3), (1, "u4", "", "on rust", "s", 4)],
        "query_id long, url string, title string, snippet string, source string, rank int"
    )
    asked = spark.createDataFrame([(1, "the Rust", 3)], "query_id long, query string, target int")
    assert sorted(
        values(ranking.expand_sources(selected, ranked, asked))
    ) == [(1, "u1", "t", "web", 7), (1, "u3", "Rust book", "unknown", 2), (1, "u4", "", "s", 3)]


@pytest.mark.parametrize(
    ("raw", "status", "summary"),
    [
        ('Sure: {"executive_summary": "a [1]", "x": {"y": 1}} bye', "strict", "a [1]"),
        ('{"executive_summary": "cut in the mid', "repaired", "cut in the mid"),
        ('{"executive_summary": "a \\"q\\"", "key_findings": ["b", ', "repaired", 'a "q"'),
        ('{"executive_summary": "a", "data_table": [{"metric": "m", "val', "repaired", "a"),
        ('{"executive_summary": "it\\"s" oops} and {', "excerpt", 'it"s'),
        ('{"executive_summary": "a", oops} and {', "repaired", "a"),
        ("no object at all", "excerpt", "no object at all"),
        ("", "empty", None),
        (None, "empty", None),
    ],
)
def test_parsed_reports(raw, status, summary):
    found, how = reports.parsed(raw)
    assert (how, json.loads(found).get("executive_summary")) == (status, summary)


def test_normalized_reports(spark):
    raw = json.dumps(
        {
            "summary": "s [1][2]", "recommendations": ["a", "b"], "confidence_level": " High ",
            "data_table": [{"metric": "m", "value": 3}, {"metric": "", "value": "x"}]
        }
    )
    rows = reports.normalize_reports(reports.parse_reports(spark.createDataFrame([(1, raw), (2, None)], "report_id long, raw string")))
    got = {r.report_id: r for r in rows.collect()}
    assert (got[1].executive_summary, got[1].recommendations, got[1].confidence_level) == ("s [1], [2]", "a\nb", "High")
    assert (got[2].executive_summary, got[2].confidence_level, got[2].key_findings) == ("", "Medium", [])
    assert values(reports.data_table_rows(rows).select("report_id", "metric", "value")) == [(1, "m", "3")]


def test_better_scrape_wins(spark):
    schema = "url string, content string, error string"
    base = spark.createDataFrame([("a", "short", "404"), ("b", "long enough", None), ("c", None, "x")], schema)
    again = spark.createDataFrame([("a", "much longer", None), ("b", "no", None), ("c", "text", "timeout")], schema)
    assert sorted(
        values(pages.prefer_rescrapes(base, again).select("url", "content", "error"))
    ) == [("a", "much longer", None), ("b", "long enough", None), ("c", None, "x")]


def test_breaker_alert(spark):
    rows = spark.createDataFrame(
        [("u", 1000, 1), ("u", 1200, 1), ("u", 9000, 1), ("v", 0, 0)], "up string, s long, state int"
    ).withColumn("ts", F.timestamp_seconds("s"))
    assert sorted(values(monitor.breaker_alert(rows, "up"))) == [("u", 1065, 1485), ("u", 9060, 9285)]


def test_rate_limit(spark):
    rows = spark.createDataFrame(
        [(1, 0, "s", "e"), (2, 10, "s", "e"), (3, 61, "s", "e")], "event_id long, t long, subject string, endpoint string"
    ).withColumn("ts", F.timestamp_seconds("t"))
    got = {r.event_id: r.admitted for r in replay.rate_limit(rows, 1, 60.0).collect()}
    assert got == {1: True, 2: False, 3: True}
