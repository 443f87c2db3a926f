"""Citation markers, their claims and the audit; lists; mapped results; history."""

import datetime as dt

from pyspark.sql import functions as F

from pagesift.functions import text as T
from pagesift.operators import ranking, reports, results
from pagesift.sources import feeds, history

RUST = "Rust uses ownership model [1]. Python is interpreted [2]."


def audit(spark, text, sources):
    said = spark.createDataFrame([(1, text)], "query_id long, text string")
    numbered = spark.createDataFrame([(1, i, c) for i, c in enumerate(sources, 1)], "query_id long, n int, content string")
    checked = reports.verify_citations(reports.claim_windows(said), numbered)
    return checked.orderBy("marker").collect(), reports.citation_summary(said, checked).first()


def test_supported(spark):
    rows, summary = audit(
        spark, "The Eiffel Tower is located in Paris [1].", ["The Eiffel Tower is a wrought-iron lattice tower located in Paris, France."]
    )
    assert [(r.n, r.supported, r.reason) for r in rows] == [(1, True, "ok")] and summary.faithfulness == 1.0


def test_out_of_range(spark):
    rows, summary = audit(spark, "Some fact [5].", ["Only one source here."])
    assert [r.reason for r in rows] == ["out_of_range"] and (summary.faithfulness, summary.weak) == (0.0, "5:out_of_range")


def test_no_citations(spark):
    _, summary = audit(spark, "No citations in this text at all.", [])
    assert (summary.total, summary.supported, summary.faithfulness, summary.weak) == (0, 0, 1.0, "")


def test_mixed(spark):
    rows, summary = audit(
        spark, RUST + " Cats sleep [3]. Nothing [4].",
        ["Rust programming language uses ownership and borrowing.", "Python is a scripting language.", "Quantum chromodynamics.", "  "]
    )
    assert [r.reason for r in rows] == ["ok", "ok", "weak", "empty_source"] and rows[1].claim == "Python is interpreted"
    assert (summary.total, summary.supported, summary.faithfulness, summary.weak) == (4, 2, 0.5, "3:weak 4:empty_source")


def test_claims():
    assert [
        claim for _, claim in reports.claims_of("First. Second one [1] and more [2]! Third [3]")
    ] == ["Second one", "Second one [1] and more", "Third"]
    assert len(reports.claims_of("x" * 500 + " [1]")[0][1]) == 299
    assert reports.claims_of("[99999999999]")[0][0] == 2**31 - 1


def test_claim_windows_of_reports_without_markers(spark):
    said = spark.createDataFrame([(1, "One [1]. Two [2]."), (2, "none"), (3, None), (None, "Five [5]")], "query_id long, text string")
    both = [(None, 0, 5, "Five"), (1, 0, 1, "One"), (1, 1, 2, "Two")]
    shown = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert shown(reports.claim_windows(said)) == sorted(both, key=str)
    assert shown(reports.claim_windows(said, outer=True)) == sorted([*both, (2, None, None, None), (3, None, None, None)], key=str)
    assert reports.claim_windows(said.limit(0)).count() == 0


def test_spaced_lists(spark):
    def shown(text):
        return spark.createDataFrame([(text,)], "x string").select(T.spaced_lists(F.col("x"))).first()[0]

    def brute(text):
        out = []
        for line in text.split("\n"):
            s = line.strip()
            if s and (s[0].isdigit() or s[0] in "-•") and out and out[-1].strip():
                out.append("")
            out.append(line)
        return "\n".join(out)

    for text in ("Do:\n- a\n- b\n\n• c\nplain\n 2. d", "1. a", "", "\n\n- x", "a\n\t- b\n \n- c", "no\nitems"):
        assert shown(text) == brute(text)
    assert shown(None) is None


def test_mapped_results(spark):
    rows = spark.createDataFrame(
        [(1, 0, "t", "a  b", None, 0.5, 2), (1, 1, "u", None, "timeout", None, None)],
        "query_id long, pos int, title string, content string, error string, relevance_score double, source_tier int"
    )
    assert [(r.pos, r.snippet) for r in results.map_citations(rows).collect()] == [(0, "a b")]
    assert [
        (r.content, r.relevance_score, r.source_tier) for r in results.map_sources(rows, True).orderBy("pos").collect()
    ] == [("a b", 0.5, 2), (None, 0.0, 5)]


def test_history_and_lines(spark, tmp_path):
    log = spark.createDataFrame(
        [(dt.datetime(2024, 1, 1, 5), "r", "secret", 200, 1.5), (dt.datetime(2024, 1, 2), "r", None, 500, 0.0)],
        "ts timestamp, endpoint string, query string, status int, duration_s double"
    )
    for _ in range(2):
        history.append_history(history.history_rows(log), str(tmp_path / "h"))
    back = spark.read.parquet(str(tmp_path / "h"))
    assert back.count() == 4 and back.where("day = '2024-01-01'").count() == 2 and "secret" not in str(back.collect())
    history.write_results_jsonl(log.select("endpoint", "query"), str(tmp_path / "l"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "l")).collect()) == ['{"endpoint":"r","query":"secret"}', '{"endpoint":"r"}']


def test_greedy_diversity(spark):
    rows = [
        (1, f"https://{h}.example/{i}", s, 0, i) for i,
        (h, s) in enumerate([("a", 1.0), ("a", 0.95), ("b", 0.8), ("a", 0.95), ("c", 0.2), ("b", 0.8)])
    ]
    left, seen, want = list(rows), {}, []
    while left:
        gain = lambda r: r[2] + (0.25 if not seen.get(r[1][8]) else -0.08 * seen[r[1][8]])
        best = max(left, key=lambda r: (gain(r), -r[4]))
        left.remove(best)
        seen[best[1][8]] = seen.get(best[1][8], 0) + 1
        want.append(best[1])
    got = ranking.diversity_topk(spark.createDataFrame(rows, "query_id long, url string, rank_score double, set_pos int, pos int"), 5)
    assert [r.url for r in got.orderBy("rank").collect()] == want[:5]


def test_summaries(spark):
    ranked = spark.createDataFrame(
        [(1, 1, "https://a.x/", "duckduckgo,google"), (1, 2, "https://a.x/2", "wikipedia"), (2, 1, "https://b.x/", "duckduckgo")],
        "query_id long, rank int, url string, providers string"
    )
    got = {r.query_id: (r.providers_used, r.fallback_used, r.profile_used) for r in ranking.collection_summary(ranked).collect()}
    assert got == {1: ("duckduckgo,google,wikipedia", True, True), 2: ("duckduckgo", False, False)}
    total = ranking.evaluation_summary(ranking.evaluate(ranked)).first()
    assert (total.n_queries, total.avg_results, total.n_fallback, total.providers_seen) == (2, 1.5, 1, "duckduckgo,google,wikipedia")


def test_answers_and_atom(spark):
    raw = spark.createDataFrame(
        [
            (
                1,
                '{"items": [{"link": " http://q/1 ", "title": "T", "body": "<p>a <b>b</b></p>"}, {"link": "http://q/1", "title": "again"}, {"link": "", "title": "x"}]}'
            ),
            (2, "{"), (3, None)
        ],
        "query_id long, json string"
    )
    assert [tuple(r) for r in feeds.answer_candidates(raw).collect()] == [(1, 0, "T", "http://q/1", "a b")]
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>One</title><link href="http://a/1"/><link href="http://a/b"/><summary>About</summary><updated>2024</updated></entry><entry><title>Two</title></entry></feed>'
    raw = spark.createDataFrame([(1, atom), (2, "<"), (3, None)], "query_id long, xml string")
    assert [tuple(r) for r in feeds.feed_candidates(raw).collect()] == [(1, 0, "One", "http://a/1", "About", "2024")]


def test_the_same_batch_twice_adds_nothing(spark, tmp_path):
    log = spark.createDataFrame([(dt.datetime(2024, 1, 1, 5), "r", "secret", 200, 1.5), (dt.datetime(2024, 1, 2), None, None, 500, 0.0)], "ts timestamp, endpoint string, query string, status int, duration_s double")
    log = log.withColumns({"model": F.lit("m"), "cached": F.lit(True), "trace_id": F.lit("t"), "error": F.lit(None).cast("string"), "metadata": F.struct(F.lit(1).alias("k"))})
    rows, path = history.history_rows(log), str(tmp_path / "h")
    for batch in (0, 1, 1, 0):
        history.append_history(rows, path, batch)
    back = history.read_history(spark, path)
    assert back.count() == 4 and {r.metadata for r in back.collect()} == {'{"k":1}'} and len(rows.columns) == 11
    assert sorted(map(str, history.history_snapshot(back).collect())) == ["Row(route='r', model='m', n=2, n_success=2, n_cached=2)", "Row(route=None, model='m', n=2, n_success=0, n_cached=2)"]


def test_history_of_a_stream(spark, tmp_path):
    log = spark.createDataFrame([(dt.datetime(2024, 1, 1, 5), "r", "secret", 200, 1.5)] * 3, "ts timestamp, endpoint string, query string, status int, duration_s double")
    for k in range(2):
        log.write.mode("append").parquet(str(tmp_path / "in"))
        arriving = spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))
        history.stream_history(arriving, str(tmp_path / "h"), str(tmp_path / "c")).awaitTermination()
        assert history.read_history(spark, str(tmp_path / "h")).count() == 3 * (k + 1)


def test_a_query_with_very_many_results_stays_bounded(spark):
    rows = spark.range(1_000_000).select(
        F.floor(F.col("id") / 10_000_000).alias("query_id"), F.col("id").alias("pos"), F.lit("t").alias("title"), F.lit("s").alias("source"), F.lit("u").alias("url"), F.lit(None).cast("string").alias("publication_date"),
        F.repeat(F.lit("word "), F.lit(50)).alias("content"), (F.col("id") % 5 + 1).alias("source_tier"), F.lit(0.5).alias("relevance_score")
    )
    packed = results.context_pack(results.number_citations(rows))
    r = packed.first()
    assert r.n_sources == 15 and r.total_chars == 15 * 250 and "[Tier 1]" in r.context and "[Tier 2]" not in r.context
    assert "WindowGroupLimit" in packed._jdf.queryExecution().executedPlan().toString()


def test_tiers_documentation_and_answers(spark):
    rows = spark.createDataFrame(
        [(1, 0, "https://docs.python.org/3/", 1, None, "x"), (1, 1, "https://a.example/", 9, None, "x"), (2, 0, "https://docs.python.org/3/", 1, "timeout", "x"), (2, 1, "https://b.example/", 2, None, "")],
        "query_id long, pos int, url string, source_tier int, error string, content string"
    )
    assert sorted(map(tuple, results.tier_summary(rows).collect())) == [(1, 1, 1, "Official/Institutional"), (1, 9, 1, "Tier 9")]
    assert sorted(map(tuple, results.official_doc_hits(rows).collect())) == [(1, "https://docs.python.org/3/", True), (2, "", False)]


def test_one_exchange_by_query(spark):
    """Merging bounds candidates in two exchanges; from there on all is dealt by query once."""
    from pagesift.plans import queries as plans

    plan = plans.QUERIES["r9_diversity_topk"](spark, "/root/testdata/sf0.001")
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    dealt = [line for line in text.split("\n") if " Exchange hashpartitioning(" in line or "- Exchange hashpartitioning(" in line]
    assert len([line for line in dealt if "hashpartitioning(query_id#" in line and ", provider" not in line]) == 1, text
    assert len(dealt) <= 3 and text.count("pages.parquet") == 1


def test_the_context_holds_every_source(spark):
    """c5_context packs all good results of a query; sf0.01 has queries with more than 15."""
    from pagesift.plans import bindings as B
    from pagesift.plans import queries as plans

    d = "/root/testdata/sf0.01"
    good = {r.query_id: r["count"] for r in results.filter_low_quality(B.results(spark, d)).groupBy("query_id").count().collect()}
    got = {r.query_id: (r.n_sources, r.context.count("SOURCE ["), r.source_index.count("\n") + 1) for r in plans.QUERIES["c5_context"](spark, d).collect()}
    assert got == {k: (n, n, n) for k, n in good.items()} and max(good.values()) > 15
