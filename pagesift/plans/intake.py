"""Sources, URL screens, crawl frontier, query log, parsed reports: bound to the given tables, with DuckDB SQL."""

from pyspark.sql import functions as F

from pagesift import constants as K
from pagesift.functions import text as T
from pagesift.functions import urls as U
from pagesift.operators import monitor, pages, querylog, ranking, reports, results
from pagesift.plans import bindings as B
from pagesift.plans.queries import _C, _DOMAIN, _HOST, _LOG, _PART, _Q, _R, _REL, _has, _in, _ranked, _score, _scored
from pagesift.sources import feeds, history
from pagesift.sources.pages import read_pages
from pagesift.streaming import monitor as live


_LOW = "abcdefghijklmnopqrstuvwxyz"


def _pages(s, d):
    return B.table(s, d, "pages")


def _redirects(s, d):
    """Every third URL behind one search engine's redirect, every third behind another's."""
    kind, coded = F.col("page_id") % 3, F.url_encode("url")
    link = F.when(
        kind == 0, F.concat(F.lit("//duckduckgo.com/l/?uddg="), coded, F.lit("&rut=1"))
    ).when(kind == 1, F.concat(F.lit("/url?q=x&url="), coded, F.lit("&sa=U"))).otherwise(F.col("url"))
    return _pages(s, d).select("page_id", link.alias("url"))


def _risky(s, d):
    kind, rest = F.col("page_id") % 7, F.regexp_replace("url", "^https?://", "")
    low = (F.col("page_id") % 250).cast("string")
    url = F.when(
        kind == 1, F.concat(F.lit("ftp://"), rest)
    ).when(kind == 2, F.concat(F.lit("http://me:pw@"), rest)).when(kind == 3, "http://a.localhost:80/")
    url = url.when(
        kind == 4, F.concat(F.lit("http://10.0.0."), low, F.lit("/x"))
    ).when(kind == 5, F.concat(F.lit("http://[::ffff:8.8.8."), low, F.lit("]/"))).when(kind == 6, "https:///x").otherwise(F.col("url"))
    return _pages(s, d).select("page_id", url.alias("url"))


def _dns(s, d):
    """An address for each host of pages; none for hosts of a length that five divides, a private one for those that three does."""
    hosts = _pages(s, d).select(U.bare_host(F.col("url")).alias("host")).distinct().where(F.length("host") % 5 != 0)
    return hosts.withColumn("ip", F.when(F.length("host") % 3 == 0, "10.0.0.8").otherwise("93.184.216.34"))


def _links(s, d):
    return _pages(s, d).select(F.concat(F.lit("https://"), U.domain(F.col("url")), F.lit("/")).alias("root"), "url", F.col("page_id").alias("pos"))


def _written(s, d):
    """Queries as a user writes them, with page URLs inside."""
    text = F.concat(
        F.lit("see "), F.col("url"), F.lit(". and "), F.col("url"),
        F.when(F.col("page_id") % 2 == 0, ", crawl (https://a.example/x)!").otherwise(","), F.lit(" please")
    )
    return _pages(s, d).select(F.col("page_id").alias("query_id"), F.when(F.col("page_id") % 5 == 0, "plain words").otherwise(text).alias("query"))


def _technical(s, d):
    """Each query, naming two technologies by its number."""
    names = F.array(*map(F.lit, K.TECH_DOCS))
    name = lambda n: F.element_at(names, (F.pmod(n, F.lit(len(K.TECH_DOCS))) + 1).cast("int"))
    return B.queries(s, d).withColumn(
        "query", F.concat("query", F.lit(" usage of "), name(F.col("query_id")), F.lit(", "), name(F.col("query_id") * 7))
    )


def _budgets(s, d):
    q = F.col("query_id")
    return B.queries(s, d).select(
        "query_id", "query", F.when(q % 3 == 0, q % 70).cast("int").alias("requested"), F.when(q % 2 == 0, q % 45).cast("int").alias("suggested"),
        (q % 5 == 0).alias("deep")
    )


def _planned(s, d):
    return querylog.source_budget(_budgets(s, d))


def _answers(s, d):
    """Documents as a model's answers: whole JSON, JSON cut off, a cut inside a list, and no JSON; table rows of several kinds, some lacking a field."""
    kind, text = F.col("doc_id") % 4, F.translate(F.coalesce("text", F.lit("")), '"\\\n\t\r', "")
    level = F.when(F.col("doc_id") % 3 == 0, "High").otherwise("sure")
    number = F.col("doc_id").cast("string")
    table = [
        F.lit('{"metric": "m'), number, F.lit('", "value": '), number, F.lit('.5}, {"metric": "only"}, {"metric": "n", "value": "'), number, F.lit(' %", "source": "[1]", "date": "2024"}'),
        F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit(', {"metric": "k", "value": true, "source": null}'))).otherwise("")
    ]
    tail = F.concat(F.lit('", "confidence_level": "'), level, F.lit('", "data_table": ['), *table)
    body = F.concat(F.lit('{"executive_summary": "s [1][2] '), F.regexp_replace(text, r"[\x00-\x1f]", ""))
    raw = F.when(
        kind == 0, F.concat(F.lit("Here: "), body, tail, F.lit("]} done"))
    ).when(kind == 1, body).when(kind == 2, F.concat(body, tail, F.lit(","))).otherwise(F.lit("no answer"))
    return B.table(s, d, "documents").select(F.col("doc_id").alias("report_id"), raw.alias("raw"))


def _reports(s, d):
    return reports.normalize_reports(reports.parse_reports(_answers(s, d)))


def _per_item(of):
    """An array of of(j, title, url, body, date) for the two to five items of a page: some without a title, some of one URL, every second without a date."""
    def one(j):
        text = j.cast("string")
        title = F.when((F.col("page_id") + j) % 5 == 4, "").otherwise(F.concat(_plain(_title()), F.lit(" "), text))
        url = F.concat(F.lit("https://e.example/"), F.col("page_id").cast("string"), F.lit("/"), F.floor(j / 2).cast("string"))
        return of(j, title, url, F.concat(F.lit("a <b>bold</b> word "), text), F.when(j % 2 == 0, F.concat(F.lit("2024-01-0"), (j + 1).cast("string"))))

    return F.transform(F.sequence(F.lit(0), (F.col("page_id") % 4 + 1).cast("int")), one)


def _json(s, d, of, *path):
    """Each page as a JSON payload with its items under the path."""
    body = _per_item(of)
    for name in reversed(path):
        body = F.struct(body.alias(name))
    return _pages(s, d).select(F.col("page_id").alias("query_id"), F.to_json(body).alias("json"))


def _hits(s, d):
    """Titles of encyclopedia hits come twice each, with signs that a URL must escape."""
    title = lambda j, title: F.when(title == "", title).otherwise(F.concat(_plain(_title()), F.lit(" AC/DC (band)*~ "), F.floor(j / 2).cast("string")))
    return _json(s, d, lambda j, t, u, b, x: F.struct(title(j, t).alias("title"), b.alias("snippet")), "query", "search")


def _stories(s, d):
    """Every second hit has a story's title alone, every third a story's URL alone."""
    return _json(s, d, lambda j, t, u, b, x: F.struct(
        F.when(j % 2 == 0, t).alias("title"), t.alias("story_title"), F.when(j % 3 == 0, "").otherwise(u).alias("url"), u.alias("story_url"), x.alias("created_at"),
        F.struct(b.alias("t")).alias("_highlightResult")
    ), "hits")


def _xml(s, d, head, of, tail):
    """Each page as an XML feed of its items; every tenth is broken."""
    body = F.concat(F.lit(head), F.array_join(_per_item(of), ""), F.lit(tail))
    return _pages(s, d).select(F.col("page_id").alias("query_id"), F.when(F.col("page_id") % 10 == 0, "not xml <><").otherwise(body).alias("xml"))


def _tag(name, value):
    """An element, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>")), F.lit(""))


def _feeds(s, d):
    item = lambda j, t, u, b, x: F.concat(F.lit("<item>"), _tag("title", t), _tag("link", u), _tag("description", F.regexp_replace(b, "<[^>]*>", "")), _tag("pubDate", x), F.lit("</item>"))
    return _xml(s, d, "<rss><channel>", item, "</channel></rss>")


def _described(s, d):
    """Pages with metadata and an image in front."""
    number, odd = F.col("page_id").cast("string"), F.col("page_id") % 2 == 1
    front = F.concat(
        F.lit('<meta name="description" content="about '), number, F.lit('"><meta property="og:url" content="x"><meta name="empty" content=""><meta property="og:url" content="y'), number,
        F.lit('"><meta name="keywords" content="a, b"><meta name="keywords" content="c"><link rel="canonical" href="/c/'), number, F.lit('">'),
        F.when(odd, F.lit('<meta name="author" content="A &amp; B">')).otherwise(""), F.lit('<img src="/i/'), number, F.lit('.png" alt="an image"><img alt="none"><img data-src="late.png">'),
        F.when(odd, F.lit('<img src="https://other.example/z.png" alt="z">')).otherwise("")
    )
    return pages.extract_pages(_pages(s, d).withColumn("html", F.concat(front, F.coalesce("html", F.lit("")))), "all")


def _plain(column):
    return F.regexp_replace(column, "[&<>]", " ")


def _title():
    return F.regexp_extract("html", "<title>([^<]*)</title>", 1)


def _atom(s, d, paper=False):
    where = lambda u: _tag("id", u) if paper else F.concat(F.lit('<link href="'), u, F.lit('"/>'))
    about = lambda j, b: F.concat(F.regexp_replace(b, "<[^>]*>", ""), F.repeat(F.concat(F.lit(" about "), j.cast("string")), F.lit(60)))
    entry = lambda j, t, u, b, x: F.concat(
        F.lit("<entry>"), where(u), _tag("title", t), _tag("summary", about(j, b)), _tag("published" if paper else "updated", x), F.lit("</entry>")
    )
    return _xml(s, d, '<feed xmlns="http://www.w3.org/2005/Atom">', entry, "</feed>")


def _articles(s, d):
    """Article sets: some articles share an id, some have no title, and titles and abstracts have markup."""
    def one(j, t, u, b, x):
        number = F.concat(F.col("page_id").cast("string"), F.floor(j / 2).cast("string"))
        year = F.coalesce(F.concat(F.lit("<Journal><JournalIssue><PubDate>"), _tag("Year", F.substring(x, 1, 4)), F.lit("</PubDate></JournalIssue></Journal>")), F.lit(""))
        title = F.when(t == "", F.lit("")).otherwise(F.concat(t, F.lit(" in <i>vivo</i>")))
        abstract = F.concat(F.lit("<Abstract><AbstractText>"), F.regexp_replace(b, "<[^>]*>", ""), F.lit("</AbstractText><AbstractText>more</AbstractText></Abstract>"))
        return F.concat(F.lit("<PubmedArticle><MedlineCitation>"), _tag("PMID", number), F.lit("<Article>"), _tag("ArticleTitle", title), abstract, year, F.lit("</Article></MedlineCitation></PubmedArticle>"))

    return _xml(s, d, "<PubmedArticleSet>", one, "</PubmedArticleSet>")


def _result_pages(s, d):
    """Each page as a search-result page: hits behind redirects, some without a title, one of the engine itself, and the next page's form behind another."""
    hit = lambda j, t, u, b, x: F.concat(
        F.lit('<div class="result"><li><p>'), F.when(j == 3, F.lit('<a class="result__a" href="https://duckduckgo.com/y">')).otherwise(
            F.concat(F.lit('<a class="result__a" href="//duckduckgo.com/l/?uddg='), F.url_encode(u), F.lit('&rut=1">'))
        ), t, F.lit('</a><a class="result__snippet" href="#">Text '), j.cast("string"), F.lit("</a></div>")
    )
    number = F.col("page_id").cast("string")
    forms = F.concat(
        F.lit('<form><input type="hidden" name="q" value="x"></form>'), F.when(F.col("page_id") % 3 > 0, F.concat(
            F.lit('<form><input type="hidden" name="s" value="'), number, F.lit('"><input type="text" name="t" value="no"><input type="HIDDEN" name="vqd" value="v-'), number, F.lit('"></form>')
        )).otherwise("")
    )
    return _pages(s, d).select(F.col("page_id").alias("query_id"), F.concat(F.array_join(_per_item(hit), ""), forms).alias("html"))


def _coded(s, d):
    """Pages with blocks of code and inline code: languages by prefix and by name, an empty block, a short and a long one of several lines."""
    number, long = F.col("page_id").cast("string"), F.concat(F.lit("x = "), F.col("page_id").cast("string"), F.lit("\n"), F.repeat(F.lit("y"), F.lit(70)))
    body = F.concat(
        F.lit('<html><body><p>Run <code>make '), number, F.lit('</code> first</p><pre class="highlight-source-'), F.when(F.col("page_id") % 2 == 0, "python").otherwise("js"),
        F.lit('">\n\n  a  =  '), number, F.lit('\n\n    b\n\n</pre><pre>  </pre><code class="bash">'), long, F.lit("</code><code>one\ntwo</code></body></html>")
    )
    return pages.extract_pages(_pages(s, d).withColumn("html", body)).select("page_id", "content")


def _documented(s, d):
    """Candidates, of which every third is a page of a technology's documentation."""
    named = F.concat(F.lit("https://docs.python.org/3/library/"), F.col("pos").cast("string"))
    return B.candidates(s, d).withColumn(
        "url", F.when(F.col("pos") % 3 == 0, named).otherwise(F.col("url"))
    ).withColumns({"error": F.when(F.col("pos") % 7 == 0, "timeout"), "content": F.when(F.col("pos") % 11 == 0, "").otherwise("text")}).where("query_id % 5 <> 1 or pos % 3 <> 0")


def _gapped(s, d):
    """Scored results, some without source, URL or tier."""
    rows, n = _scored(s, d), F.col("pos")
    return rows.withColumns({
        "source": F.when(n % 10 != 3, F.col("source")), "url": F.when(n % 10 != 4, F.col("url")), "source_tier": F.when(n % 10 == 5, 0).when(n % 10 != 6, F.col("source_tier"))
    })


def _jsonl(s, d):
    """Pages written as JSON lines and read again."""
    path = B.scratch(s)
    history.write_results_jsonl(_pages(s, d).select("page_id", "url", F.length("html").alias("n_chars"), F.lit(None).cast("string").alias("error")), path)
    return s.read.schema("page_id long, url string, n_chars int, error string").json(path)


def _shortlist(s, d):
    return _ranked(s, d).withColumn("source", U.source_name(F.col("url")))


def _selected(s, d):
    return _shortlist(s, d).where("rank <= 2").select("query_id", "url", "title", F.col("source").alias("type"), F.col("rank").alias("priority"))


def _states(s, d):
    return B.log(s, d).select((F.col("subject") % 10).alias("upstream"), "ts", (F.col("status") >= 500).cast("int").alias("state"))


def _rescraped(s, d):
    base = B.table(s, d, "documents").select(F.col("doc_id").cast("string").alias("url"), "text", "doc_id")
    half = F.expr("substring(text, 1, length(text) div 2)")
    first = base.select("url", half.alias("content"), F.when(F.col("doc_id") % 4 == 0, "timeout").alias("error"))
    again = base.where("doc_id % 3 = 0").select("url", F.col("text").alias("content"), F.when(F.col("doc_id") % 9 == 0, "timeout").alias("error"))
    again = again.unionByName(base.where("doc_id % 6 = 0").select("url", F.concat("text", F.lit(" again")).alias("content"), F.lit(None).cast("string").alias("error")))
    again = again.unionByName(base.where("doc_id % 12 = 0").select("url", F.lit("x").alias("content"), F.lit(None).cast("string").alias("error")))
    return pages.prefer_rescrapes(first, again)


def _collected(s, d):
    c = B.candidates(s, d).drop("set_pos")
    return (c.where("pos % 2 = 0").withColumn("error", F.when(F.col("pos") % 6 == 0, "timeout")), c.where("pos % 2 = 1").drop("snippet"))


QUERIES = {
    "s2_json_candidates": lambda s, d: feeds.encyclopedia_candidates(_hits(s, d)),
    "s1_pages": lambda s, d: read_pages(s, f"{d}/pages.parquet").select("page_id", "url", F.length("html").alias("n_chars"), "status_code"),
    "s2_stories": lambda s, d: feeds.story_candidates(_stories(s, d)),
    "s2_answers": lambda s, d: feeds.answer_candidates(_json(s, d, lambda j, t, u, b, x: F.struct(t.alias("title"), u.alias("link"), b.alias("body")), "items")),
    "s3_atom": lambda s, d: feeds.feed_candidates(_atom(s, d)),
    "s4_papers": lambda s, d: feeds.arxiv_candidates(_atom(s, d, True)),
    "s4_pubmed": lambda s, d: feeds.pubmed_candidates(_articles(s, d)),
    "s5_next_page": lambda s, d: feeds.next_page_fields(_result_pages(s, d)).select(
        "query_id", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("fields")))).alias("fields")
    ),
    "s7_jsonl": lambda s, d: _jsonl(s, d),
    "p3_code_blocks": _coded,
    "s5_result_pages": lambda s, d: feeds.result_page_candidates(_result_pages(s, d)).select("query_id", "pos", "title", "url", "snippet"),
    "m11_progress": lambda s, d: live.progress(B.results(s, d)),
    "s3_feed_candidates": lambda s, d: feeds.feed_candidates(_feeds(s, d)),
    "s6_feed_filter": lambda s, d: feeds.filter_feed_by_query(B.candidates(s, d), B.queries(s, d)).select("query_id", "pos", "url"),
    "u4_redirects": lambda s, d: _redirects(s, d).select("page_id", U.decode_redirect(F.col("url")).alias("url")),
    "u5_source_name": lambda s, d: _pages(s, d).select("page_id", U.source_name(F.col("url")).alias("source")),
    "u7_unsafe_urls": lambda s, d: _risky(s, d).select("page_id", F.coalesce(U.unsafe_reason(F.col("url")), F.lit("safe")).alias("reason")),
    "u8_resolved_urls": lambda s, d: U.screen_resolved(
        _pages(s, d).select("page_id", "url"), _dns(s, d)
    ).select("page_id", F.coalesce("reason", F.lit("safe")).alias("reason")),
    "u10_frontier_score": lambda s, d: _links(s, d).select("pos", U.frontier_score(F.col("url"), F.col("root")).alias("score")),
    "u11_frontier": lambda s, d: U.select_frontier(_links(s, d), 99),
    "q2_variants": lambda s, d: querylog.query_variants(
        B.queries(s, d).select(
            "query_id", F.col("query").alias("original"), T.clean(F.col("query")).alias("normalized"),
            F.array(
                F.translate("query", _LOW, _LOW.upper()), F.concat(F.lit(" a  guide to "), F.col("query")), F.lit("x"), F.lit("more"), F.lit("most"),
                F.lit("mist")
            ).alias("variants")
        ), 5
    ).select("query_id", F.array_join("variants", "|").alias("variants")),
    "q6_intents": lambda s, d: querylog.intent_flags(
        B.table(s, d, "conversations").select("conv_id", "turn", F.col("text").alias("query"))
    ).drop("query"),
    "q7_direct_urls": lambda s, d: querylog.direct_urls(_written(s, d)),
    "q8_routes": lambda s, d: querylog.route_queries(_written(s, d)).select("query_id", "route"),
    "q9_official_docs": lambda s, d: querylog.official_docs(_technical(s, d)),
    "q9_injected_docs": lambda s, d: querylog.inject_docs(
        _technical(s, d).select("query_id", F.lit("https://docs.python.org/3/").alias("url"), F.lit(1).alias("priority")), _technical(s, d)
    ),
    "q10_budget": lambda s, d: _planned(s, d).select("query_id", "target", "pool"),
    "q11_fallback_plan": lambda s, d: querylog.fallback_plan(_planned(s, d), B.candidates(s, d).where("query_id % 4 <> 0")),
    "q12_request_key": lambda s, d: B.log(s, d).select("event_id", querylog.request_key(F.col("endpoint"), "subject", "cached").alias("request_key")),
    "p4_metadata": lambda s, d: _described(s, d).select("page_id", F.explode("metadata").alias("name", "content")),
    "p6_images": lambda s, d: _described(s, d).select("page_id", F.posexplode("images").alias("pos", "i")).select("page_id", "pos", "i.url", "i.alt"),
    "p8_sanitized": lambda s, d: B.table(s, d, "documents").select(
        "doc_id", F.sha2(T.sanitized(F.concat(F.lit("a &amp; b "), F.coalesce("text", F.lit(""))), 8000), 256).alias("sha")
    ),
    "p12_rescrapes": _rescraped,
    "r12_expanded": lambda s, d: ranking.expand_sources(_selected(s, d), _shortlist(s, d), _planned(s, d)).select("query_id", "url", "priority"),
    "r13_collected": lambda s, d: ranking.union_collectors(*_collected(s, d)).select(
        "query_id", "set_pos", "pos", "provider", F.col("snippet").isNull().alias("bare")
    ),
    "r13_failures": lambda s, d: ranking.collector_failures(*_collected(s, d)),
    "c7_official_docs": lambda s, d: results.official_doc_hits(_documented(s, d)),
    "a1_parse_status": lambda s, d: reports.parse_reports(_answers(s, d)).select(
        "report_id", "parse_status", F.col("report.confidence_level").alias("level"), F.coalesce(F.size("report.data_table"), F.lit(-1)).alias("n_rows")
    ),
    "a2_normalized": lambda s, d: _reports(s, d).select("report_id", "executive_summary", "confidence_level"),
    "a7_citations": lambda s, d: results.map_citations(_gapped(s, d)),
    "a7_sources": lambda s, d: results.map_sources(_gapped(s, d)).drop("content"),
    "a8_data_rows": lambda s, d: reports.data_table_rows(_reports(s, d)),
    "m5_breaker_alert": lambda s, d: monitor.breaker_alert(_states(s, d), "upstream"),
}

_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
_FLAG = lambda words: f"coalesce({_has('lower(text)', words)}, false)"
_SEG = "list_filter(string_split(lower({p}), '/'), lambda x: x <> '')"
_WRITTEN = "wq AS (SELECT page_id AS query_id, CASE WHEN page_id % 5 = 0 THEN 'plain words' ELSE 'see ' || url || '. and ' || url || CASE WHEN page_id % 2 = 0 THEN ', crawl (https://a.example/x)!' ELSE ',' END || ' please' END AS query FROM pages)"
_LINKS = f"l AS (SELECT 'https://' || {_DOMAIN()} || '/' AS root, url, page_id AS pos FROM pages)"
_FRONT = f"""g AS (SELECT *, {_PART(3)} AS path, {_PART(4)} AS asked, {_SEG.format(p=_PART(3))} AS seg FROM l),
    sc AS (SELECT *, CASE WHEN path = {_PART(3, 'root')} AND asked = {_PART(4, 'root')} OR len(list_filter(seg, lambda x: {_in('x', K.DEAD_ENDS)})) > 0 THEN 0
        ELSE greatest(0, 10 + 5 * least(len(seg), 5) - CASE WHEN asked <> '' THEN 8 ELSE 0 END - CASE WHEN regexp_matches(coalesce(seg[-1], ''),
            '^[0-9]+$') THEN 6 ELSE 0 END
        + CASE WHEN regexp_matches(coalesce(seg[-1], ''), '^[a-z\\-À-ɏ]+$') THEN 4 ELSE 0 END) END::INTEGER AS score FROM g)"""
_TECHQ = f"""{_Q}, names AS (SELECT [{', '.join(repr(k) for k in K.TECH_DOCS)}] AS x), tq AS (SELECT query_id, query || ' usage of ' || x[query_id %
            len(x) + 1] || ', ' || x[query_id * 7 % len(x) + 1] AS query FROM q, names)"""
_DOCS = f"""dk(word, w, u, url) AS (VALUES {', '.join(f"('{k}', {i}, {j}, '{u}')" for i, (k, us) in enumerate(K.TECH_DOCS.items()) for j, u in enumerate(us))}),
    dm AS (SELECT query_id, url, min(w * 10 + u) AS place FROM tq JOIN dk ON regexp_matches(lower(query), '\\b' || replace(word, '.', '\\.') || '\\b')
            GROUP BY query_id, url)"""
_BUD = f"""{_Q}, b0 AS (SELECT query_id, query, CASE WHEN query_id % 3 = 0 THEN query_id % 70 END AS requested, CASE WHEN query_id % 2 = 0 THEN
            query_id % 45 END AS suggested, query_id % 5 = 0 AS deep FROM q),
    b1 AS (SELECT *, coalesce(requested, suggested, CASE WHEN deep THEN 20 ELSE 5 END) AS wish FROM b0),
    b AS (SELECT *, (CASE WHEN deep THEN least(greatest(wish, 15), 50) ELSE least(greatest(wish, 1), 15) END)::INTEGER AS target FROM b1)"""
_TOPIC = f"list_filter(list_transform(list_filter(regexp_split_to_array(replace(query, '-', ' '), '\\s+'), lambda x: len(x) > 2), lambda x: lower(x)), lambda x: NOT {_in('x', K.TOPIC_STOPWORDS)})"

_ITEMS = rf"""it AS (SELECT page_id AS query_id, pos, page_title, CASE WHEN (page_id + pos) % 5 = 4 THEN '' ELSE page_title || ' ' || pos END AS title, 'https://e.example/' || page_id || '/' || pos // 2 AS url,
    'a <b>bold</b> word ' || pos AS body, CASE WHEN pos % 2 = 0 THEN '2024-01-0' || (pos + 1) END AS date
    FROM (SELECT page_id, regexp_replace({_TITLE}, '[&<>]', ' ', 'g') AS page_title, unnest(range((page_id % 4 + 2)::BIGINT))::INTEGER AS pos FROM pages))"""

def _clean(text: str, size: int = 8000) -> str:
    """SQL of sanitized texts without fences: entities that occur, script URIs, control characters, line ends, runs, and the cut."""
    out = text
    for entity, sign in (("&nbsp;", "chr(160)"), ("&quot;", "chr(34)"), ("&#39;", "chr(39)"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&amp;", "'&'")):
        out = f"replace({out}, '{entity}', {sign})"
    out = rf"regexp_replace({out}, '(javascript|vbscript|data:(text/html|application/[a-z+\-]+)):[^\s]*', '', 'gi')"
    out = rf"regexp_replace({out}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g')"
    out = f"replace(replace({out}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    out = rf"regexp_replace(regexp_replace({out}, '[ \t]{{{{2,}}}}', ' ', 'g'), '\n{{{{3,}}}}', chr(10) || chr(10), 'g')"
    out = rf"regexp_replace({out}, '^\s+|\s+$', '', 'g')"
    return f"(SELECT CASE WHEN len(z) <= {size} THEN z ELSE substr(z, 1, {size}) || '{T.SAFETY_NOTE}' END FROM (SELECT {out} AS z))".replace("{{", "{").replace("}}", "}")


ORACLE_SQL = {
    "s2_json_candidates": f"""WITH {_ITEMS}, x AS (SELECT query_id, pos, trim(page_title || ' AC/DC (band)*~ ' || pos // 2) AS title, body FROM it WHERE title <> '')
        SELECT query_id, pos, title, 'https://en.wikipedia.org/wiki/' || url_encode(replace(title, ' ', '_')) AS url, 'a bold word ' || pos AS snippet FROM x QUALIFY row_number() OVER (PARTITION BY query_id, url ORDER BY pos) = 1""",
    "s1_pages": "SELECT page_id, url, len(html)::INTEGER AS n_chars, NULL::INTEGER AS status_code FROM pages",
    "s2_stories": f"""WITH {_ITEMS} SELECT query_id, pos, trim(title) AS title, url, '{{"t":"' || body || '"}}' AS snippet, date AS publication_date FROM it WHERE trim(title) <> '' QUALIFY row_number() OVER (PARTITION BY query_id, url ORDER BY pos) = 1""",
    "s2_answers": f"""WITH {_ITEMS} SELECT query_id, pos, trim(title) AS title, url, 'a bold word ' || pos AS snippet FROM it WHERE trim(title) <> '' QUALIFY row_number() OVER (PARTITION BY query_id, url ORDER BY pos) = 1""",
    "s3_atom": f"""WITH {_ITEMS} SELECT query_id, pos, trim(title) AS title, url, trim(substr('a bold word ' || pos || repeat(' about ' || pos, 60), 1, 300)) AS snippet, date AS publication_date FROM it WHERE trim(title) <> '' AND query_id % 10 <> 0""",
    "s4_papers": f"""WITH {_ITEMS} SELECT query_id, pos, trim(title) AS title, url, substr('a bold word ' || pos || repeat(' about ' || pos, 60), 1, 350) AS snippet, date AS publication_date FROM it WHERE trim(title) <> '' AND query_id % 10 <> 0 QUALIFY row_number() OVER (PARTITION BY query_id, url ORDER BY pos) = 1""",
    "s5_result_pages": f"""WITH {_ITEMS} SELECT query_id, pos, trim(title) AS title, url, 'Text ' || pos AS snippet FROM it WHERE title <> '' AND pos <> 3""",
    "m11_progress": f"WITH {_R} SELECT query_id, count(*) AS done, count(*) FILTER (error IS NULL) AS succeeded, coalesce(sum(len(content)) FILTER (error IS NULL), 0)::BIGINT AS total_chars FROM d GROUP BY query_id",
    "p4_metadata": f"""SELECT page_id, unnest(['description', 'og:url', 'keywords', 'canonical_url'] || CASE WHEN page_id % 2 = 1 THEN ['author'] ELSE [] END) AS name, unnest(['about ' || page_id, 'y' || page_id, 'a, b', '/c/' || page_id] || CASE WHEN page_id % 2 = 1 THEN ['A & B'] ELSE [] END) AS content FROM pages""",
    "p6_images": f"""WITH b AS (SELECT page_id, url, regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) AS base FROM pages) SELECT page_id, 0 AS pos, base || '/i/' || page_id || '.png' AS url, 'an image' AS alt FROM b
        UNION ALL SELECT page_id, 1, base || regexp_replace({_PART(3)}, '[^/]*$', '') || 'late.png', '' FROM b UNION ALL SELECT page_id, 2, 'https://other.example/z.png', 'z' FROM b WHERE page_id % 2 = 1""",
    "a2_normalized": r"""SELECT doc_id AS report_id, CASE doc_id % 4 WHEN 3 THEN 'no answer' WHEN 1 THEN regexp_replace(rtrim('s [1], [2] ' || t),
            '[,\s]+$', '') ELSE 's [1], [2] ' || t END AS executive_summary,
        CASE WHEN doc_id % 4 = 3 THEN 'Low' WHEN doc_id % 4 IN (0, 2) AND doc_id % 3 = 0 THEN 'High' ELSE 'Medium' END AS confidence_level FROM
            (SELECT doc_id, regexp_replace(coalesce(text, ''), '["\\\x00-\x1f]', '', 'g') AS t FROM documents)""",
    "s3_feed_candidates": f"""WITH {_ITEMS} SELECT query_id, pos, trim(title) AS title, url, 'a bold word ' || pos AS snippet, date AS publication_date FROM it WHERE trim(title) <> '' AND query_id % 10 <> 0""",
    "s6_feed_filter": f"""WITH {_C}, k AS (SELECT query_id, list_filter(regexp_split_to_array(lower(query), '[\\s,;]+'), lambda x: len(x) > 3) AS words FROM q)
        SELECT query_id, pos, url FROM c JOIN k USING (query_id) WHERE url <> '' AND (len(words) = 0 OR len(list_filter(words, lambda x:
            contains(lower(title || ' ' || snippet), x))) > 0)
        QUALIFY row_number() OVER (PARTITION BY query_id, url ORDER BY pos) = 1""",
    "u4_redirects": "SELECT page_id, url FROM pages",
    "u5_source_name": f"SELECT page_id, CASE {' '.join(f'''WHEN contains({_HOST()}, '{k}') THEN '{v}' ''' for k, v in K.SOURCE_NAMES.items())} ELSE regexp_extract({_HOST()}, '^([^.]*)', 1) END AS source FROM pages",
    "u7_unsafe_urls": "SELECT page_id, ['safe', 'scheme', 'credentials', 'localhost', 'private_address', 'safe', 'no_host'][page_id % 7 + 1] AS reason FROM pages",
    "u8_resolved_urls": f"SELECT page_id, CASE WHEN len({_DOMAIN()}) % 5 = 0 THEN 'unresolved' WHEN len({_DOMAIN()}) % 3 = 0 THEN 'private_address' ELSE 'safe' END AS reason FROM pages",
    "u10_frontier_score": f"WITH {_LINKS}, {_FRONT} SELECT pos, score FROM sc",
    "u11_frontier": f"""WITH l0 AS (SELECT 'https://' || {_DOMAIN()} || '/' AS root, regexp_replace(url, '/+$', '') AS url, page_id AS pos FROM
            pages), l AS (SELECT root, url, min(pos) AS pos FROM l0 WHERE url <> '' GROUP BY ALL), {_FRONT},
        f AS (SELECT * FROM sc WHERE score > 0 AND NOT regexp_matches(regexp_extract(lower(url), '^([^?]*)', 1),
            '({'|'.join(x.replace('.', chr(92) + '.') for x in K.SKIPPED_EXTENSIONS)})$')
            QUALIFY row_number() OVER (PARTITION BY root, regexp_replace(path, '[0-9]+', 'N', 'g') ORDER BY pos, url) <= 5)
        SELECT root, url, score, row_number() OVER (PARTITION BY root ORDER BY score DESC, url)::INTEGER AS rank FROM f QUALIFY rank <= 99""",
    "q2_variants": f"""WITH {_Q}, v AS (SELECT query_id, list_filter(list_transform([query, query, translate(query, '{_LOW}', '{_LOW.upper()}'),
            ' a  guide to ' || query, 'x', 'more', 'most', 'mist'], lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: len(x) BETWEEN 2
            AND 500) AS x FROM q),
        e AS (SELECT query_id, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM v), o AS (SELECT query_id, arg_min(y, i) AS y, min(i) AS i FROM e
            GROUP BY query_id, lower(y)),
        t AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY i) <= 5) SELECT query_id, string_agg(y, '|' ORDER BY i) AS
            variants FROM t GROUP BY query_id""",
    "q6_intents": f"SELECT conv_id, turn, {_FLAG(K.CODE_WORDS)} AS wants_code, {_FLAG(K.CODE_SOURCE_WORDS)} AS wants_code_sources, {_FLAG(K.TABLE_WORDS)} AS wants_table, {_FLAG(K.BENCHMARK_WORDS)} AS wants_benchmark FROM conversations",
    "q7_direct_urls": "SELECT page_id AS query_id, 0 AS pos, url FROM pages WHERE page_id % 5 <> 0 UNION ALL SELECT page_id, 1, 'https://a.example/x' FROM pages WHERE page_id % 5 <> 0 AND page_id % 2 = 0",
    "q8_routes": f"WITH {_WRITTEN} SELECT query_id, CASE WHEN NOT contains(query, 'http') THEN 'search' WHEN {_has('lower(query)', K.SUBPAGE_WORDS)} THEN 'direct+subpages' ELSE 'direct' END AS route FROM wq",
    "q9_official_docs": f"WITH {_TECHQ}, {_DOCS} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY place)::INTEGER - 1 AS pos, url FROM dm",
    "q9_injected_docs": f"WITH {_TECHQ}, {_DOCS} SELECT query_id, 'https://docs.python.org/3/' AS url, 1 AS priority FROM tq UNION ALL SELECT query_id, url, 0 FROM dm WHERE url <> 'https://docs.python.org/3/'",
    "q10_budget": f"WITH {_BUD} SELECT query_id, target, least(greatest(target + CASE WHEN deep THEN 10 ELSE 5 END, CASE WHEN deep THEN target ELSE 15 END), 50)::INTEGER AS pool FROM b",
    "q11_fallback_plan": f"""WITH {_BUD}, has AS (SELECT DISTINCT page_id % (SELECT count(*) FROM benchmark) AS query_id FROM pages), lone AS (SELECT
            * FROM b WHERE query_id % 4 = 0 OR query_id NOT IN (SELECT query_id FROM has)),
        p AS (SELECT *, unnest(range(1, CASE WHEN deep THEN least(target, 50) ELSE greatest(1, least(target, {len(K.TEMPLATES)})) END + 1))::INTEGER
            AS priority FROM lone)
        SELECT query_id, [{', '.join(repr(k) for k in K.TEMPLATES)}][(priority - 1) % {len(K.TEMPLATES)} + 1] AS type,
        [{', '.join(repr(u.partition('{')[0]) for u in K.TEMPLATES.values())}][(priority - 1) % {len(K.TEMPLATES)} + 1] || replace(url_encode(query), '%20', '+') AS url, type || ' results for ' || query AS title, priority FROM p""",
    "q12_request_key": f"WITH {_LOG} SELECT event_id, sha256(endpoint || ':' || '{{\"cached\":' || cached || ',\"subject\":' || coalesce(subject::VARCHAR, 'null') || '}}') AS request_key FROM l",
    "p12_rescrapes": f"""WITH f AS (SELECT doc_id::VARCHAR AS url, doc_id, substr(text, 1, len(text) // 2) AS a, CASE WHEN doc_id % 4 = 0 THEN 'timeout' END AS error,
            CASE WHEN doc_id % 6 = 0 THEN coalesce(text || ' again', CASE WHEN doc_id % 12 = 0 THEN 'x' END) WHEN doc_id % 3 = 0 AND doc_id % 9 <> 0 THEN text END AS b FROM documents)
        SELECT url, CASE WHEN len(trim(b, ' ')) > len(trim(coalesce(a, ''), ' ')) THEN b ELSE a END AS content, CASE WHEN len(trim(b, ' ')) > len(trim(coalesce(a, ''), ' ')) THEN NULL ELSE error END AS error FROM f""",
    "r12_expanded": f"""WITH {_C}, {_score('m50')}, {_BUD.replace(_Q + ',', '')}, tp AS (SELECT query_id, target, {_TOPIC} AS topic FROM b),
        x AS (SELECT DISTINCT r.query_id, r.url, r.rank, target, rank <= 2 AS chosen FROM r JOIN s USING (query_id, url) JOIN tp USING (query_id)
            WHERE rank <= 2 OR len(topic) = 0 OR len(list_filter(topic, lambda w: contains(lower(coalesce(s.title, '') || ' ' || coalesce(s.snippet,
            '') || ' ' || r.url), w))) > 0),
        y AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INTEGER AS k FROM x) SELECT query_id, url, CASE WHEN chosen THEN rank
            ELSE k END AS priority FROM y WHERE k <= target""",
    "r13_collected": f"WITH {_C} SELECT query_id, (pos % 2)::INTEGER AS set_pos, pos, provider, pos % 2 = 1 AS bare FROM c WHERE pos % 6 <> 0",
    "r13_failures": f"WITH {_C} SELECT provider, 'timeout' AS error, count(*) AS n FROM c WHERE pos % 6 = 0 GROUP BY provider",
    "c7_official_docs": f"""WITH {_C}, dc AS (SELECT query_id, pos, CASE WHEN pos % 3 = 0 THEN 'https://docs.python.org/3/library/' || pos ELSE url END AS url FROM c WHERE query_id % 5 <> 1 OR pos % 3 <> 0),
        h AS (SELECT query_id, pos, url, row_number() OVER (PARTITION BY query_id ORDER BY pos, url) AS k FROM dc WHERE pos % 7 <> 0 AND pos % 11 <> 0 AND {_has('lower(url)', K.DOC_URL_SIGNS)}),
        g AS (SELECT query_id, string_agg(url, ' ' ORDER BY k) AS urls FROM h WHERE k <= 5 GROUP BY query_id)
        SELECT query_id, coalesce(urls, '') AS doc_urls, urls IS NOT NULL AS has_official_docs FROM (SELECT DISTINCT query_id FROM dc) LEFT JOIN g USING (query_id)""",
    "a1_parse_status": f"""SELECT doc_id AS report_id, ['strict', 'repaired', 'repaired', 'excerpt'][doc_id % 4 + 1] AS parse_status, CASE doc_id % 4 WHEN 3 THEN 'Low' WHEN 1 THEN NULL ELSE CASE WHEN doc_id % 3 = 0 THEN 'High' ELSE 'sure' END END AS level,
        CASE WHEN doc_id % 4 IN (1, 3) THEN -1 WHEN doc_id % 3 = 1 THEN 4 ELSE 3 END AS n_rows FROM documents""",
    "a7_sources": f"""WITH {_REL} SELECT query_id, pos, CASE WHEN pos % 10 = 3 THEN 'unknown' ELSE coalesce(source, 'unknown') END AS source, CASE WHEN pos % 10 = 4 THEN '' ELSE url END AS url, title, error, relevance_score,
        CASE WHEN pos % 10 IN (5, 6) THEN 5 ELSE source_tier END AS source_tier, published AS publication_date FROM e""",
    "a8_data_rows": f"""WITH o AS (SELECT * FROM documents WHERE doc_id % 4 IN (0, 2)) SELECT doc_id AS report_id, 0 AS pos, 'm' || doc_id AS metric, doc_id || '.5' AS value, NULL AS source, NULL AS date FROM o
        UNION ALL SELECT doc_id, 2, 'n', doc_id || ' %', '[1]', '2024' FROM o UNION ALL SELECT doc_id, 3, 'k', 'true', NULL, NULL FROM o WHERE doc_id % 3 = 1""",
    "m5_breaker_alert": f"""WITH {_LOG}, st AS (SELECT DISTINCT subject % 10 AS upstream, ceil(epoch_us(ts) / 15000000)::BIGINT AS step FROM l WHERE
            status >= 500),
        nw AS (SELECT *, CASE WHEN step - coalesce(lag(step) OVER w, -1099511627776) > 20 THEN 1 ELSE 0 END AS new FROM st WINDOW w AS (PARTITION BY
            upstream ORDER BY step)),
        sp AS (SELECT *, sum(new) OVER (PARTITION BY upstream ORDER BY step) AS spell FROM nw) SELECT upstream, min(step) * 15 + 60 AS start,
            (max(step) + 19) * 15 AS "end" FROM sp GROUP BY upstream, spell""",
    "s4_pubmed": f"""WITH {_ITEMS}, x AS (SELECT *, query_id::VARCHAR || pos // 2 AS pmid FROM it WHERE query_id % 10 <> 0 QUALIFY row_number() OVER (PARTITION BY query_id, pos // 2 ORDER BY pos) = 1)
        SELECT query_id, pos, CASE WHEN title = '' THEN 'PubMed ' || pmid ELSE trim(title || ' in vivo') END AS title, 'https://pubmed.ncbi.nlm.nih.gov/' || pmid || '/' AS url, 'a bold word ' || pos AS snippet, date[1:4] AS publication_date FROM x""",
    "s5_next_page": f"""SELECT page_id AS query_id, CASE WHEN page_id % 3 > 0 THEN '{{"s":"' || page_id || '","vqd":"v-' || page_id || '"}}' END AS fields FROM pages""",
    "s7_jsonl": f"""SELECT page_id, url, len(html)::INTEGER AS n_chars, NULL::VARCHAR AS error FROM pages""",
    "p3_code_blocks": f"""SELECT page_id, 'Run' || chr(10) || '`make ' || page_id || '`' || chr(10) || 'first' || chr(10) || '```' || CASE WHEN page_id % 2 = 0 THEN 'python' ELSE 'js' END || chr(10) || '  a  =  ' || page_id || chr(10) || chr(10) || '    b' || chr(10) || '```'
        || chr(10) || '```bash' || chr(10) || 'x = ' || page_id || chr(10) || repeat('y', 70) || chr(10) || '```' || chr(10) || '`one' || chr(10) || 'two`' AS content FROM pages""",
    "p8_sanitized": f"""SELECT doc_id, sha256({_clean("('a &amp; b ' || coalesce(text, ''))")}) AS sha FROM documents""",
    "a7_citations": rf"""WITH {_REL}, x AS (SELECT *, {_clean("coalesce(content, '')")} AS clean FROM e WHERE error IS NULL), y AS (SELECT *, trim(regexp_replace(clean, '\s+', ' ', 'g')) AS flat FROM x)
        SELECT query_id, pos, CASE WHEN pos % 10 = 3 THEN 'unknown' ELSE coalesce(source, 'unknown') END AS source, CASE WHEN pos % 10 = 4 THEN '' ELSE url END AS url, title, relevance_score,
        CASE WHEN pos % 10 IN (5, 6) THEN 5 ELSE source_tier END AS source_tier, published AS publication_date, CASE WHEN len(flat) <= 280 THEN flat ELSE rtrim(substr(flat, 1, 280)) || '...' END AS snippet FROM y""",
}
