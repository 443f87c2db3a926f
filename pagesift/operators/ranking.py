"""Search candidates: merged, scored, deduplicated and cut to a diverse shortlist for each query.

merge_variants bounds a provider's rows of a query: its windows are limits by rank, which Spark applies to each partition
before it shuffles, so a query with very many candidates never gathers. What is left is dealt by query once (by_query);
scores, dedup, diversity and top-up all lead with query_id and need no further exchange. Scores are built-in expressions;
what depends on the query alone is worked out once for each query, not for each candidate.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagesift import constants as K
from pagesift.functions import text as T
from pagesift.functions import urls as U


def merge_variants(candidates: DataFrame, cap: int) -> DataFrame:
    """Of each query and provider the first of every URL in order of set and position, `cap` at most."""
    first = W.partitionBy("query_id", "provider", "url").orderBy("set_pos", "pos")
    place = W.partitionBy("query_id", "provider").orderBy("set_pos", "pos")
    kept = candidates.where("url is not null and url <> ''").withColumn("n", F.row_number().over(first)).where("n = 1")
    return kept.withColumn("n", F.row_number().over(place)).where(F.col("n") <= cap).drop("n")


def by_query(candidates: DataFrame) -> DataFrame:
    """candidates dealt by query_id, for all that follows; for candidates that merge_variants has bounded."""
    return candidates.repartition("query_id")


def with_dates(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("publication_date", F.coalesce(T.some(F.col("publication_date")), T.snippet_date(F.col("snippet"))))


def query_features(queries: DataFrame) -> DataFrame:
    """query_id, query, tokens, profile, and the hosts of documentation of technologies named in it (the table of these is fixed)."""
    named = lambda word: F.lower("query").rlike(rf"(?<![a-z0-9_])\Q{word}\E(?![a-z0-9_])")
    hosts = [F.when(named(word), F.array(*[F.lit(u.split("/")[2]) for u in urls])) for word, urls in K.TECH_DOCS.items()]
    official = F.array_distinct(F.flatten(F.array_compact(F.array(*hosts))))
    return queries.select("query_id", "query", official.alias("official"), T.tokens(F.col("query")).alias("qt"), T.profile(F.col("query")).alias("profile"))


def _domain_boost(host: Column, tech, standard) -> Column:
    """tech and standard: boosts of (official,) trusted, institutional and other non-profit hosts."""
    trusted, state, org = host.isin(*K.TRUSTED), host.rlike(r"\.(gov|edu|int)$"), host.endswith(".org")
    official = U.bound(host, lambda h: F.exists("official", lambda x: x.contains(h)))
    by_tech = F.when(official, tech[0]).when(trusted, tech[1]).when(state, tech[2]).when(org, tech[3]).otherwise(0.0)
    plain = F.when(trusted, standard[0]).when(state, standard[1]).when(org, standard[2]).otherwise(0.0)
    in_host = U.bound(host, lambda h: F.exists("qt", lambda t: (F.length(t) > 3) & h.contains(t)))
    return F.when(F.size("official") > 0, by_tech).otherwise(plain) + F.when(in_host, 0.1).otherwise(0.0)


def _profile_boost(url: Column, source: Column, fresh: Column) -> Column:
    both = F.concat_ws(" ", F.lower(url), F.lower(source))
    news = F.when(both.rlike("|".join(K.NEWS_SITES)), 0.15).otherwise(0.0)
    academic = F.when(
        both.rlike("|".join(K.ACADEMIC_SITES)), 0.2
    ).otherwise(0.0) + F.when(F.lower(url).rlike(r"\.(edu|gov|org)$"), 0.08).otherwise(0.0)
    docs = F.when(F.lower(url).rlike("|".join(K.DOC_SITES)), 0.12).otherwise(0.0)
    return F.when(F.col("profile") == "news", 0.8 * fresh + news).when(F.col("profile") == "academic", academic).otherwise(docs)


def score_parts(candidates: DataFrame, queries: DataFrame, as_of_year: int = 2026) -> DataFrame:
    """candidates with the normalized url and what their score is made of; rows without an http URL or on a blacklisted host go.

    overlap with the query's tokens, exact (the search was the query itself), provider_boost, freshness, domain_boost (in
    the score), merge_boost (at the merge of providers), profile_boost, and path_boost (a token in the path).
    """
    rows = candidates.where(F.col("url").startswith("http") & ~U.blacklisted(F.col("url"))).withColumn("url", U.normalize(F.col("url")))
    rows = rows.join(query_features(queries), "query_id")
    host, url = U.host(F.col("url")), F.col("url")
    have = F.array_union(F.array_union(T.tokens(F.col("title")), T.tokens(F.col("snippet"))), T.tokens(F.col("source")))
    path = F.lower(U.part(url, 3))
    rows = rows.withColumns({
        "overlap": F.when(F.size("qt") == 0, 0.0).otherwise(F.size(F.array_intersect("qt", have)) / F.size("qt")),
        "exact": F.when(T.caseless(F.col("search_query")) == T.caseless(F.col("query")), 0.15).otherwise(0.0),
        "provider_boost": F.when(F.col("provider") == "duckduckgo", 0.05).otherwise(0.0),
        "freshness": T.freshness(F.col("publication_date"), F.col("snippet"), as_of_year),
        "domain_boost": _domain_boost(host, (0.6, 0.2, 0.0, 0.1), (0.3, 0.3, 0.15)),
        "merge_boost": _domain_boost(host, (0.8, 0.3, 0.0, 0.1), (0.5, 0.4, 0.2)),
        "path_boost": F.when(U.bound(path, lambda p: F.exists("qt", lambda t: (F.length(t) > 3) & p.contains(t))), 0.05).otherwise(0.0),
    })
    rows = rows.withColumn("profile_boost", _profile_boost(url, F.col("source"), F.col("freshness")))
    return rows.drop("qt", "official", "profile", "query")


def score_candidates(candidates: DataFrame, queries: DataFrame, as_of_year: int = 2026) -> DataFrame:
    """candidates with the normalized url and rank_score, which adds up all parts and is rounded before and after the merge."""
    rows = score_parts(candidates, queries, as_of_year)
    inner = F.round(
        F.col("overlap") + F.col("exact") + F.col("provider_boost") + F.col("domain_boost") + F.col("freshness") + F.col("profile_boost"), 6
    )
    rows = rows.withColumn("rank_score", F.round(inner + F.col("merge_boost") + F.col("path_boost"), 6))
    return rows.select(*candidates.columns, "rank_score")


def dedupe_candidates(scored: DataFrame) -> DataFrame:
    """One row for each query and URL: the best score (the earliest of equals) at the place of its first hit, with all providers."""
    place = F.struct("set_pos", "pos")
    best = F.max_by(F.struct("title", "snippet", "rank_score", "source"), F.struct("rank_score", -F.col("set_pos"), -F.col("pos")))
    out = scored.groupBy("query_id", "url").agg(
        best.alias("b"), F.min(place).alias("p"), F.array_join(F.array_sort(F.collect_set("provider")), ",").alias("providers")
    )
    return out.select("query_id", "url", "b.title", "b.snippet", "b.source", "b.rank_score", "p.set_pos", "p.pos", "providers")


def diversity_topk(deduped: DataFrame, k: int, first: float = 0.25, later: float = 0.08) -> DataFrame:
    """The k best of each query when the first of a domain gains and later ones lose, as a greedy choice would pick them.

    A domain's rows leave in order of score, and what they gain or lose never rises, so the greedy merge is one sort.
    """
    rows = deduped.withColumn("domain", U.domain(F.col("url")))
    inside = W.partitionBy("query_id", "domain").orderBy(F.desc("rank_score"), "set_pos", "pos")
    rows = rows.withColumn("j", F.row_number().over(inside) - 1)
    rows = rows.withColumn("effective", F.when(F.col("j") == 0, F.col("rank_score") + first).otherwise(F.col("rank_score") - later * F.col("j")))
    order = W.partitionBy("query_id").orderBy(F.desc("effective"), "set_pos", "pos")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("j", "effective")


def collection_summary(ranked: DataFrame, first: tuple = ("duckduckgo",), fallback: tuple = ("google",)) -> DataFrame:
    """Of each query: results, providers, and whether a fallback gave results, or a provider for its profile (any other)."""
    each = ranked.withColumn("provider", F.explode(F.split("providers", ",")))
    return each.groupBy("query_id").agg(
        F.countDistinct("url").alias("n_results"),
        F.array_join(F.array_sort(F.collect_set("provider")), ",").alias("providers_used"),
        F.bool_or(F.col("provider").isin(*fallback)).alias("fallback_used"),
        F.bool_or(~F.col("provider").isin(*first, *fallback)).alias("profile_used"),
    )


def append_new(early: DataFrame, extra: DataFrame) -> DataFrame:
    """early, and of extra the rows of each query whose URL is not there yet."""
    return early.unionByName(extra.join(early.select("query_id", "url").distinct(), ["query_id", "url"], "left_anti"), allowMissingColumns=True)


def evaluate(ranked: DataFrame, fallback: tuple = ("google",)) -> DataFrame:
    """Of each query: results, distinct domains, providers, whether a fallback gave results, and its first five results
    (title, url, provider, source)."""
    have = lambda name: F.col(name) if name in ranked.columns else F.lit(None).cast("string")
    texts = [F.coalesce(have(c), F.lit(other)).alias(name) for c, name, other in (("title", "title", ""), ("url", "url", ""), ("providers", "provider", "unknown"), ("source", "source", "unknown"))]
    top = F.array_sort(F.collect_list(F.when(F.col("rank") <= 5, F.struct("rank", F.struct(*texts).alias("hit")))))
    providers = F.array_sort(F.array_distinct(F.flatten(F.transform(F.collect_set("providers"), lambda x: F.split(x, ",")))))  # sets of the few providers
    out = ranked.groupBy("query_id").agg(
        F.count("*").alias("n_results"),
        F.countDistinct(U.domain(F.col("url"))).alias("n_domains"),
        F.array_join(providers, ",").alias("providers_used"),
        F.transform(top, lambda x: x["hit"]).alias("top_results"),
    )
    return out.withColumn("fallback_used", F.arrays_overlap(F.split("providers_used", ","), F.array(*map(F.lit, fallback))))


def evaluation_summary(each: DataFrame) -> DataFrame:
    """Over all queries: how many, means of results and domains, how many needed a fallback, and the providers seen."""
    seen = each.agg(
        F.count("*").alias("n_queries"),
        F.round(F.avg("n_results"), 6).alias("avg_results"),
        F.round(F.avg("n_domains"), 6).alias("avg_domains"),
        F.sum(F.col("fallback_used").cast("long")).alias("n_fallback"),
        F.collect_set("providers_used").alias("seen"),  # sets of the few providers
    )
    providers = F.array_sort(F.array_distinct(F.flatten(F.transform("seen", lambda x: F.split(x, ",")))))
    return seen.withColumn("providers_seen", F.array_join(providers, ",")).drop("seen")


def expand_sources(selected: DataFrame, ranked: DataFrame, queries: DataFrame) -> DataFrame:
    """selected(query_id, url, title, type, priority), topped up to the query's target from ranked(query_id, url, title, snippet, source, rank).

    queries has query_id, query and target. Added rows hold a word of the query's topic in title, snippet or URL, or are
    all there is if it has none. Each URL counts once, where it stands first; added rows go on from the selected ones.
    """
    said = F.split(F.replace(F.coalesce("query", F.lit("")), F.lit("-"), F.lit(" ")), r"\s+")
    topic = F.array_distinct(F.filter(F.transform(F.filter(said, lambda w: F.length(w) > 2), F.lower), lambda w: ~w.isin(*K.TOPIC_STOPWORDS)))
    asked = queries.select("query_id", topic.alias("topic"), "target")
    hay = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit("")), F.coalesce("url", F.lit(""))))
    fit = ranked.join(asked.select("query_id", "topic"), "query_id").where((F.size("topic") == 0) | F.exists("topic", lambda w: hay.contains(w)))
    kind = F.coalesce("source", F.lit("unknown"))
    both = selected.select("query_id", "url", "title", "type", "priority", F.lit(0).alias("late"), F.col("priority").alias("place")).unionByName(
        fit.select(
            "query_id", "url", F.coalesce("title", F.lit("")).alias("title"), kind.alias("type"), F.lit(None).cast("int").alias("priority"),
            F.lit(1).alias("late"), F.col("rank").alias("place")
        )
    )
    both = both.where("url is not null and url <> ''")
    both = both.withColumn("k", F.row_number().over(W.partitionBy("query_id", "url").orderBy("late", "place"))).where("k = 1")
    both = both.withColumn(
        "k", F.row_number().over(W.partitionBy("query_id").orderBy("late", "place", "url"))
    ).join(asked.select("query_id", "target"), "query_id")
    return both.where("k <= target").select("query_id", "url", "title", "type", F.coalesce("priority", "k").alias("priority"))


def union_collectors(*parts: DataFrame) -> DataFrame:
    """Rows of all collectors by name, with set_pos by their order; columns that one lacks are null. Rows of failures (error) stay out."""
    out = None
    for i, part in enumerate(parts):
        rows = (part.where("error is null").drop("error") if "error" in part.columns else part).withColumn("set_pos", F.lit(i))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def collector_failures(*parts: DataFrame) -> DataFrame:
    """provider, error and n of the rows of failures of all collectors."""
    out = None
    for part in parts:
        if "error" in part.columns:
            rows = part.where("error is not null").select("provider", "error")
            out = rows if out is None else out.unionByName(rows)
    return out.groupBy("provider", "error").agg(F.count("*").alias("n"))
