"""Payloads of search providers as candidate rows: JSON and XML."""

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagesift.functions import text as T
from pagesift.functions import urls as U

_TAGS = r"<[^>]+>"


def _flat(column) -> F.Column:
    return F.trim(F.regexp_replace(F.coalesce(column, F.lit("")), _TAGS, ""))


def encyclopedia_candidates(raw: DataFrame) -> DataFrame:
    """raw(query_id, json) of an encyclopedia's search: pos, title, url and snippet of each hit with a title, each URL once."""
    parsed = F.from_json("json", "query struct<search:array<struct<title:string,snippet:string>>>")
    rows = raw.select("query_id", F.posexplode(parsed["query"]["search"]).alias("pos", "hit"))
    title = F.trim("hit.title")
    page = U.quote_plus(F.replace(title, F.lit(" "), F.lit("_")))
    rows = rows.select("query_id", "pos", title.alias("title"), F.concat(F.lit("https://en.wikipedia.org/wiki/"), page).alias("url"), _flat(F.col("hit.snippet")).alias("snippet"))
    return _once(rows.where("title <> ''"))


def feed_candidates(raw: DataFrame) -> DataFrame:
    """raw(query_id, xml) of RSS 2.0 and Atom 1.0 feeds: pos, title, url, snippet and date; items without title or link, and broken XML, give no rows."""
    item = "array<struct<title:string,link:string,description:string,pubDate:string>>"
    entry = "array<struct<title:string,link:array<struct<_href:string>>,summary:string,updated:string>>"
    parsed = F.from_xml("xml", f"channel struct<item:{item}>, entry {entry}", {"mode": "PERMISSIVE"})
    text = lambda x, name: F.trim(F.coalesce(x[name], F.lit("")))
    row = lambda x, link, about, date: F.struct(text(x, "title").alias("title"), link.alias("url"), text(x, about).alias("about"), T.some(text(x, date)).alias("date"))
    rss = F.transform(parsed["channel"]["item"], lambda x: row(x, text(x, "link"), "description", "pubDate"))
    atom = F.transform(parsed["entry"], lambda x: row(x, F.trim(F.coalesce(F.get(x["link"], 0)["_href"], F.lit(""))), "summary", "updated"))
    rows = raw.select("query_id", F.posexplode(F.coalesce(rss, atom)).alias("pos", "i")).where("i.title <> '' and i.url <> ''")
    return rows.select(
        "query_id", "pos", "i.title", "i.url", _flat(F.substring("i.about", 1, 300)).alias("snippet"), F.col("i.date").alias("publication_date")
    )


def _once(rows: DataFrame, key: str = "url") -> DataFrame:
    """The first row of each query and key, by pos."""
    return rows.withColumn("k", F.row_number().over(W.partitionBy("query_id", key).orderBy("pos"))).where("k = 1").drop("k")


def arxiv_candidates(raw: DataFrame) -> DataFrame:
    """raw(query_id, xml) of Atom feeds of papers: each paper once; without id or title, and broken XML, no rows."""
    parsed = F.from_xml("xml", "entry array<struct<id:string,title:string,summary:string,published:string>>", {"mode": "PERMISSIVE"})
    rows = raw.select("query_id", F.posexplode(parsed["entry"]).alias("pos", "e"))
    text = lambda name: F.trim(_flat(F.col(f"e.{name}")))
    rows = rows.select(
        "query_id", "pos", text("title").alias("title"), text("id").alias("url"), F.substring(text("summary"), 1, 350).alias("snippet"),
        F.col("e.published").alias("publication_date")
    )
    return _once(rows.where("url <> '' and title <> ''"))


def pubmed_candidates(raw: DataFrame) -> DataFrame:
    """raw(query_id, xml) of article sets: each article once by its id; without id no rows; without title it is named by its id."""
    article = "struct<ArticleTitle:string,Abstract:struct<AbstractText:array<string>>,Journal:struct<JournalIssue:struct<PubDate:struct<Year:string>>>>"
    parsed = F.from_xml("xml", f"PubmedArticle array<struct<MedlineCitation:struct<PMID:string,Article:{article}>>>", {"mode": "PERMISSIVE"})
    rows = raw.select(
        "query_id", F.posexplode(parsed["PubmedArticle"]).alias("pos", "a")
    ).select("query_id", "pos", F.trim("a.MedlineCitation.PMID").alias("pmid"), F.col("a.MedlineCitation.Article").alias("a"))
    rows = _once(rows.where("pmid <> ''"), "pmid")
    title = F.coalesce(F.nullif(_flat(F.col("a.ArticleTitle")), F.lit("")), F.concat(F.lit("PubMed "), F.col("pmid")))
    first = F.try_element_at("a.Abstract.AbstractText", F.lit(1))
    url = F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), F.col("pmid"), F.lit("/"))
    return rows.select(
        "query_id", "pos", title.alias("title"), url.alias("url"), F.substring(_flat(first), 1, 300).alias("snippet"),
        F.col("a.Journal.JournalIssue.PubDate.Year").alias("publication_date")
    )


def filter_feed_by_query(items: DataFrame, queries: DataFrame) -> DataFrame:
    """items(query_id, pos, title, url, snippet) that hold a word over three characters of their query (all, if it has none), each URL once."""
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce("query", F.lit(""))), r"[\s,;]+"), lambda w: F.length(w) > 3))
    hay = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit(""))))
    rows = items.where("url <> ''").join(queries.select("query_id", words.alias("__words")), "query_id")
    return _once(rows.where((F.size("__words") == 0) | F.exists("__words", lambda w: hay.contains(w))).drop("__words"))


def story_candidates(raw: DataFrame) -> DataFrame:
    """raw(query_id, json) of a story search: rows without title or URL go; a story's own fields stand in for missing ones; each URL once.

    The snippet is the start of the hit's highlights, as their JSON text.
    """
    parsed = F.from_json("json", "hits array<struct<title:string,story_title:string,url:string,story_url:string,created_at:string,_highlightResult:string>>")
    rows = raw.select("query_id", F.posexplode(parsed["hits"]).alias("pos", "h"))
    either = lambda a, b: F.trim(F.coalesce(F.nullif(F.col(f"h.{a}"), F.lit("")), F.col(f"h.{b}")))
    rows = rows.select(
        "query_id", "pos", either("title", "story_title").alias("title"), either("url", "story_url").alias("url"),
        F.substring(F.coalesce("h._highlightResult", F.lit("{}")), 1, 240).alias("snippet"), F.col("h.created_at").alias("publication_date")
    )
    return _once(rows.where("title <> '' and url <> ''"))


def answer_candidates(raw: DataFrame) -> DataFrame:
    """raw(query_id, json) of a question-and-answer search: pos, title, url and snippet of each item with both, each URL once."""
    parsed = F.from_json("json", "items array<struct<link:string,title:string,body:string>>")
    rows = raw.select("query_id", F.posexplode(parsed["items"]).alias("pos", "i"))
    rows = rows.select(
        "query_id", "pos", F.trim("i.title").alias("title"), F.trim("i.link").alias("url"), _flat(F.substring("i.body", 1, 300)).alias("snippet")
    )
    return _once(rows.where("title <> '' and url <> ''"))


def result_page_candidates(pages: DataFrame, provider: str = "duckduckgo") -> DataFrame:
    """pages(query_id, html) of search results: pos, title, url, snippet and source of each hit, redirects resolved; the provider's own links go."""
    from pagesift.functions.serp import hits

    @F.pandas_udf("array<struct<title:string,url:string,snippet:string>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: hits(t, provider))

    rows = pages.select("query_id", F.posexplode(run("html")).alias("pos", "h"))
    rows = rows.select(
        "query_id", "pos", "h.title", U.decode_redirect(F.col("h.url")).alias("url"), F.substring("h.snippet", 1, 300).alias("snippet")
    )
    base = "https://duckduckgo.com" if provider == "duckduckgo" else "https://www.google.com"
    rows = rows.withColumn("url", F.when(F.col("url").startswith("/"), F.concat(F.lit(base), F.col("url"))).otherwise(F.col("url")))
    own = F.col("url").contains("duckduckgo.com") if provider == "duckduckgo" else F.col("url").startswith(f"{base}/search")
    rows = rows.where((F.col("title") != "") & (F.col("url") != "") & ~own)
    return rows.withColumn("source", U.source_name(F.col("url")))


def next_page_fields(pages: DataFrame) -> DataFrame:
    """pages(query_id, html) with fields, the hidden inputs of the first form that has `s` and `vqd`; null without one."""
    from pagesift.functions.serp import form

    @F.pandas_udf("map<string,string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(form)

    return pages.select("query_id", run("html").alias("fields"))
