"""Reports: citation markers, their claims, and how far the cited sources support them."""

import json
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from pagesift import constants as K
from pagesift.functions import text as T
from pagesift.functions.numbers import half_even

_MARK = re.compile(r"\[([0-9]+)\]")


def claims_of(text: str, before: int = K.CLAIM_SIZE) -> list[tuple[int, str]]:
    """Each marker's number, and the text before it from the last end of a sentence on."""
    out = []
    for m in _MARK.finditer(text):
        head = text[max(0, m.start() - before) : m.start()]
        out.append((min(int(m[1]), 2**31 - 1), head[max(at + len(e) if (at := head.rfind(e)) >= 0 else 0 for e in K.SENTENCE_ENDS) :].strip()))
    return out


def audit_reports(numbered: DataFrame, reports: DataFrame) -> DataFrame:
    """verify_citations' rows for the markers of reports(query_id, text) against numbered sources, and a row with a null marker
    for each report without any."""
    return verify_citations(claim_windows(reports, outer=True), numbered)


def claim_windows(reports: DataFrame, outer: bool = False) -> DataFrame:
    """query_id, marker (from 0), n and claim of every marker in reports(query_id, text); outer: nulls for a report without markers."""

    rows = reports.select("query_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches):
        for batch in batches:
            row, marker, n, claim = [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                found = claims_of(text)
                none = outer and not found
                row += [i] * (len(found) or none)
                marker += [None] if none else range(len(found))
                n += [None] if none else [k for k, _ in found]
                claim += [None] if none else [c for _, c in found]
            columns = [pa.array(marker, pa.int32()), pa.array(n, pa.int32()), pa.array(claim, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(row, pa.int64())), *columns], names=["query_id", "marker", "n", "claim"])

    return rows.mapInArrow(run, StructType([rows.schema["query_id"], *(StructField(c, t) for c, t in (("marker", IntegerType()), ("n", IntegerType()), ("claim", StringType())))]))


def words(text) -> F.Column:
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z0-9]*"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) > 2) & ~w.isin(*K.CITATION_STOPWORDS)))


def verify_citations(claims: DataFrame, numbered: DataFrame, least: float = 0.04) -> DataFrame:
    """query_id, marker, n, claim, overlap, supported and reason. A source is cut down to its words before it is joined."""
    sources = numbered.select(
        "query_id", "n", words(F.substring(F.coalesce("content", F.lit("")), 1, 5000)).alias("have"),
        (F.trim(F.coalesce("content", F.lit(""))) == "").alias("empty")
    )
    rows = claims.withColumn("said", words(F.col("claim"))).join(sources, ["query_id", "n"], "left")
    both = F.size(F.array_intersect("have", "said"))  # hashes the claim's few words, not the source's many
    rows = rows.withColumn("both", both)  # either list is distinct
    either = F.size("said") + F.size("have") - F.col("both")
    rows = rows.withColumn("share", F.when(F.least(F.size("said"), F.size("have")) > 0, F.col("both") / either).otherwise(0.0))
    reason = F.when(F.col("have").isNull(), "out_of_range").when(F.col("empty"), "empty_source").when(F.col("share") >= least, "ok").otherwise("weak")
    rows = rows.withColumn("reason", reason).withColumn("overlap", F.when(F.col("reason").isin("ok", "weak"), half_even(F.col("share"), 4)).otherwise(0.0))
    return rows.select(
        "query_id", "marker", "n", F.substring("claim", 1, 120).alias("claim"), "overlap", (F.col("reason") == "ok").alias("supported"), "reason"
    )


def citation_summary(reports: DataFrame, audit: DataFrame) -> DataFrame:
    """audit_summary for all reports(query_id, ...), where audit may lack those without citations."""
    out = reports.select("query_id").join(audit_summary(audit), "query_id", "left")
    return out.na.fill(0, ["total", "supported"]).na.fill("", ["weak"]).na.fill(1.0, ["faithfulness"])


def audit_summary(audit: DataFrame) -> DataFrame:
    """Of each report of audit_reports: citations, supported ones, their share to three digits (1 if there is none), and the weak ones.

    The weak ones are numbers and reasons in order of the markers, as `2:weak 7:out_of_range`.
    """
    weak = F.when(~F.col("supported") & F.col("marker").isNotNull(), F.struct("marker", F.concat(F.col("n").cast("string"), F.lit(":"), F.col("reason")).alias("s")))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(weak)), lambda x: x["s"]), " ")
    good = F.coalesce(F.sum((F.col("supported") & F.col("marker").isNotNull()).cast("long")), F.lit(0)).alias("supported")
    out = audit.groupBy("query_id").agg(F.count("marker").alias("total"), good, listed.alias("weak"))
    return out.withColumn("faithfulness", F.when(F.col("total") == 0, 1.0).otherwise(half_even(F.col("supported") / F.col("total"), 3)))


def _closed(text: str) -> str:
    """The JSON text with the string and the brackets that are still open closed, in order of nesting."""
    wanted, quoted, skip = [], False, False
    for ch in text:
        if skip:
            skip = False
        elif quoted:
            skip, quoted = ch == "\\", ch != '"'
        elif ch == '"':
            quoted = True
        elif ch in "{[":
            wanted.append({"{": "}", "[": "]"}[ch])
        elif wanted and ch == wanted[-1]:
            wanted.pop()
    return text + '"' * quoted + "".join(reversed(wanted))


def _object(text: str) -> dict | None:
    try:
        found = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


_SUMMARY = re.compile(r'"executive_summary"\s*:\s*"((?:[^"\\]|\\.)*)"')


def parsed(raw: str | None) -> tuple[str, str]:
    """A model's answer as JSON text of one object, and how it was found: strict, repaired, excerpt or empty.

    Strict: from the first opening to the last closing brace. Repaired: from the first brace, closed as it stands or
    before its last comma, if that has a summary. Excerpt: the summary alone, or the first 1500 characters.
    """
    raw = raw or ""
    start, end = raw.find("{"), raw.rfind("}")
    if start >= 0 and (found := _object(raw[start : end + 1])):
        return json.dumps(found), "strict"
    if start >= 0:
        cut = raw[start:].rstrip().rstrip(", \n\t\r")
        tries = [raw[start:], _closed(cut)]
        if (comma := cut.rfind(",")) > 0:
            tries.append(_closed(cut[:comma]))
        found = next((x for x in map(_object, tries) if x is not None), None)
        if found and isinstance(found.get("executive_summary"), str):
            return json.dumps(found), "repaired"
    if not raw.strip():
        return "{}", "empty"
    m = _SUMMARY.search(raw)
    said = (_object('{"s": "' + m[1] + '"}') or {"s": m[1]})["s"] if m else raw[:1500]
    return json.dumps({"executive_summary": said, "confidence_level": "Low"}), "excerpt"


_ROW = "array<struct<metric:string,value:string,source:string,date:string>>"
_REPORT = (
    f"executive_summary string, summary string, key_findings array<string>, data_table {_ROW}, conflicts_uncertainty array<string>, "
    "confidence_level string, confidence_reason string, detailed_analysis string, recommendations string"
)


def parse_reports(outputs: DataFrame) -> DataFrame:
    """report_id, report (a struct of the report's fields) and parse_status of outputs(report_id, raw). Never fails: null is empty."""

    @F.pandas_udf("json string, status string")
    def run(raws: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parsed(r) for r in raws], columns=["json", "status"])

    rows = outputs.select("report_id", run("raw").alias("p"))
    return rows.select("report_id", F.from_json("p.json", _REPORT).alias("report"), F.col("p.status").alias("parse_status"))


def _lines(text) -> F.Column:
    """A list that came as JSON text as lines; other text as it is."""
    items = F.from_json(text, "array<string>")
    return F.coalesce(F.when(text.startswith("["), F.array_join(items, "\n")), text, F.lit(""))


def normalize_reports(reports: DataFrame) -> DataFrame:
    """report_id and the fields of parse_reports' rows in normal form: known confidence (else Medium), texts never null, lists joined by lines, spaced citations, an empty line before list items of recommendations."""
    r = lambda name: F.col(f"report.{name}")
    level = F.trim(r("confidence_level"))
    summary = T.spaced_citations(F.coalesce(T.some(r("executive_summary")), r("summary"), F.lit("")))
    none = F.array().cast("array<string>")
    return reports.select(
        "report_id",
        "parse_status",
        summary.alias("executive_summary"),
        T.spaced_citations(_lines(r("detailed_analysis"))).alias("detailed_analysis"),
        T.spaced_lists(_lines(r("recommendations"))).alias("recommendations"),
        F.when(level.isin("High", "Medium", "Low"), level).otherwise("Medium").alias("confidence_level"),
        F.coalesce(r("confidence_reason"), F.lit("")).alias("confidence_reason"),
        F.coalesce(r("key_findings"), none).alias("key_findings"),
        F.coalesce(r("conflicts_uncertainty"), none).alias("conflicts_uncertainty"),
        F.coalesce(r("data_table"), F.array().cast(_ROW)).alias("data_table"),
    )


def data_table_rows(normalized: DataFrame) -> DataFrame:
    """report_id, pos, metric, value, source and date of rows of data tables that have both metric and value."""
    rows = normalized.select("report_id", F.posexplode("data_table").alias("pos", "row")).select("report_id", "pos", "row.*")
    return rows.where("metric <> '' and value <> ''")
