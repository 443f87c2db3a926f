"""Queries: variants, intents, direct URLs, documentation, budgets, fallback plans and keys. All but plans are plain projections."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift import constants as K
from pagesift.functions import urls as U
from pagesift.functions import text as T

_URL = r"""(?i)https?://[^\s,，、;；"'<>()\[\]{}]+"""


def query_variants(queries: DataFrame, cap: int = 5, longest: int = 500) -> DataFrame:
    """queries(query_id, original, normalized, variants) with variants cleaned, of 2 to `longest` characters, first seen (whatever their case), `cap` at most.

    The normalized query leads, then the original one. Where nothing is left, the cleaned original is taken, if it has any text.
    """
    every = F.concat(F.array("normalized", "original"), F.coalesce("variants", F.array().cast("array<string>")))
    fit = F.filter(F.transform(every, T.clean), lambda x: F.length(x).between(2, longest))
    rows = queries.withColumn("__fit", fit).withColumn("__keys", F.transform("__fit", T.caseless))
    first = F.slice(F.filter("__fit", lambda x, i: F.array_position("__keys", T.caseless(x)) == i + 1), 1, cap)
    original = T.clean(F.col("original"))
    rows = rows.withColumn(
        "variants", F.when(F.size(first) > 0, first).when(original != "", F.array(original)).otherwise(F.array().cast("array<string>"))
    )
    return rows.drop("__fit", "__keys")


def _any(query: Column, words) -> Column:
    lower, out = F.lower(query), F.lit(False)
    for w in words:
        out = out | lower.contains(w)
    return F.coalesce(out, F.lit(False))


def intent_flags(queries: DataFrame) -> DataFrame:
    """queries with wants_code, wants_code_sources, wants_table and wants_benchmark."""
    q = F.col("query")
    kinds = {
        "wants_code": K.CODE_WORDS, "wants_code_sources": K.CODE_SOURCE_WORDS, "wants_table": K.TABLE_WORDS, "wants_benchmark": K.BENCHMARK_WORDS
    }
    return queries.withColumns({name: _any(q, words) for name, words in kinds.items()})


def urls_in(query: Column) -> Column:
    """URLs in a query, first seen first, without punctuation at their ends."""
    found = F.regexp_extract_all(F.coalesce(query, F.lit("")), F.lit(_URL), F.lit(0))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?)]+$", "")))


def direct_urls(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.posexplode(urls_in(F.col("query"))).alias("pos", "url"))


def route_queries(queries: DataFrame) -> DataFrame:
    """queries with route: `direct` if they hold URLs, `direct+subpages` if they ask for subpages too, else `search`."""
    q = F.col("query")
    return queries.withColumn(
        "route", F.when(F.size(urls_in(q)) == 0, "search").when(_any(q, K.SUBPAGE_WORDS), "direct+subpages").otherwise("direct")
    )


def official_docs(queries: DataFrame) -> DataFrame:
    """query_id, pos and url of the documentation of each technology that a query names as a whole word, in the table's order."""
    lower = F.lower(F.coalesce("query", F.lit("")))
    named = [
        F.when(lower.rlike(r"\b" + word.replace(".", r"\.") + r"\b"), F.array(*map(F.lit, urls))).otherwise(F.array().cast("array<string>")) for word,
        urls in K.TECH_DOCS.items()
    ]
    return queries.select("query_id", F.posexplode(F.array_distinct(F.concat(*named))).alias("pos", "url"))


def inject_docs(plan: DataFrame, queries: DataFrame) -> DataFrame:
    """plan(query_id, url, priority), led (priority 0) by documentation of queries about code that isn't in it yet."""
    asked = intent_flags(queries).where("wants_code_sources")
    docs = official_docs(asked).join(plan.select("query_id", "url").distinct(), ["query_id", "url"], "left_anti")
    return plan.unionByName(docs.select("query_id", "url", F.lit(0).alias("priority")), allowMissingColumns=True)


def source_budget(queries: DataFrame) -> DataFrame:
    """queries(requested, suggested, deep) with target (1 to 15 sources, deep 15 to 50; 5 or 20 if unasked) and pool, the candidates to gather."""
    deep = F.col("deep")
    wish = F.coalesce("requested", "suggested", F.when(deep, 20).otherwise(5))
    target = F.when(deep, F.least(F.greatest(wish, F.lit(15)), F.lit(50))).otherwise(F.least(F.greatest(wish, F.lit(1)), F.lit(15)))
    floor = F.when(deep, F.col("target")).otherwise(15)
    rows = queries.withColumn("target", target.cast("int"))
    pool = F.least(F.greatest(F.col("target") + F.when(deep, 10).otherwise(5), floor), F.lit(50))
    return rows.withColumn("pool", pool.cast("int"))


def fallback_plan(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """query_id, type, url, title and priority for queries(query_id, query, target, deep) without candidates: templates in order, deep ones over again."""
    lone = queries.join(candidates.select("query_id").distinct(), "query_id", "left_anti")
    n = F.when(F.col("deep"), F.least("target", F.lit(50))).otherwise(F.greatest(F.lit(1), F.least("target", F.lit(len(K.TEMPLATES)))))
    kinds = F.array(*[F.struct(F.lit(k).alias("type"), F.lit(u.partition("{")[0]).alias("head")) for k, u in K.TEMPLATES.items()])
    rows = lone.select("query_id", "query", F.explode(F.sequence(F.lit(1), n.cast("int"))).alias("priority"))
    rows = rows.withColumn("t", F.element_at(kinds, (F.pmod(F.col("priority") - 1, F.lit(len(K.TEMPLATES))) + 1).cast("int")))
    return rows.select("query_id", F.col("t.type").alias("type"), F.concat("t.head", U.quote_plus(F.col("query"))).alias("url"), F.concat("t.type", F.lit(" results for "), "query").alias("title"), "priority")


def request_key(route: Column, *fields: str) -> Column:
    """SHA-256 of the route and the request's fields as JSON in order of their names, nulls included."""
    return F.sha2(F.concat(route, F.lit(":"), F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"})), 256)
