"""Queries on drafts: stand-in drafts made from order keys, so that what they say on their own is known."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stareflow.functions import citations as cit
from stareflow.operators import drafts as dr
from stareflow.operators import filing as fi
from stareflow.operators.staging import staged
from stareflow.plans.filings import _penal_code, _texts, _titles
from stareflow.plans.tables import read

_WORDS = "the whole of these nine words stands in it"
#: Parts of a draft: what the model wrote, and every second time a ruling that was filled in.
_WROTE = f"""CASE k % 6
  WHEN 0 THEN 'Section ' || n || ' of the Penal Code applies, and section ' || n || ' of the Penal Code again. '
  WHEN 1 THEN 'See [2018] KESC ' || (k % 90 + 1) || ' (KLR). Some say "one two three four five" of it. '
  WHEN 2 THEN 'See [2018] KESC 4 (KLR): "{_WORDS}" and no more. '
  WHEN 3 THEN 'Section ' || n || ' of the Penal Code applies. '
  WHEN 4 THEN 'Nothing more was said of it. '
  ELSE CASE WHEN k % 12 = 5 THEN 'We could not confirm Kimani v Otieno so far. ' ELSE 'There is no such case. ' END END"""
_PARTS = f"""SELECT k AS draft_id, 0 AS part_no, 'text' AS kind, {_WROTE} AS text, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS {{text}}) AS quote FROM d
  UNION ALL SELECT k, 1, 'ruling', '"{_WORDS}" (Okuta v Attorney General, [2018] KESC 4 (KLR), section 7 of the Penal Code)', n, '{_WORDS}' FROM d WHERE k % 2 = 0
  UNION ALL SELECT k, 2, 'text', ' The end.', NULL, NULL FROM d"""


def draft_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that is judged in drafts, through the filing checker."""
    d = read(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", "o_orderkey % 300 + 1 AS n")
    none = {"provision_id": F.lit(None).cast("string"), "judgment_id": F.lit(None).cast("bigint"), "title": F.lit(None).cast("string")}
    parts = spark.sql(_PARTS.format(text="STRING").replace("FROM d", "FROM {d}"), d=d).withColumns(none)
    text = staged(dr.rendered(parts))  # read by the steps on cases, quotes and sections
    filings = text.withColumnRenamed("draft_id", "filing_id")
    cases = fi.cited_cases(filings)
    results = fi.case_results(cases, _titles(spark))
    given = fi.quotes_given(filings, cases)
    found = results.where("result = 'found'").select("filing_id", "case_no", "judgment_id")
    quotes = fi.checked_quotes(given, found, _texts(spark))
    cases = cases.join(results.select("filing_id", "case_no", "result"), ["filing_id", "case_no"]).withColumnRenamed("filing_id", "draft_id")
    number = F.regexp_extract("provision_id", r"sec_(\d+)$", 1).cast("int")
    limits = _penal_code(spark).select("provision_id", number.cast("bigint").alias("event_id"), F.when(number % 4 == 0, "repealed_by_statute").when(number % 4 == 1, "read_down").otherwise("upheld").alias("event_type"))
    status = limits.select("provision_id", F.when(number % 4 == 0, "repealed").when(number % 4 == 1, "limited by a court").otherwise("in force").alias("status"))
    docs = text.select(F.col("draft_id").alias("doc_id"), "text", F.lit(None).cast("date").alias("decision_date"))
    sections = fi.section_findings(cit.linked(cit.mentions(docs), _penal_code(spark)), status).withColumnRenamed("filing_id", "draft_id")
    lookups = d.where("k % 6 = 5").selectExpr("k AS draft_id", "explode(array(1, 2)) AS step_no", "'Kimani v Otieno' AS name", "CAST(array() AS array<bigint>) AS confirmed", "array(5L) AS candidate_ids", "array('Kimani v Otieno & 2 others') AS candidate_titles")
    questions = d.selectExpr("k AS draft_id", "'What did Kimani decide in ' || k AS question")
    items = dr.draft_items(parts, cases, quotes.withColumnRenamed("filing_id", "draft_id"), sections, limits, lookups, questions)
    return items.select("draft_id", "raw_text", "kind", "result", "flagged", F.array_join(F.transform("cite", lambda c: c.cast("string")), ",").alias("cite"))


QUERIES = {"draft_check": draft_check}

ORACLE_SQL = {
    "draft_check": f"""WITH d AS (SELECT o_orderkey AS k, o_orderkey % 300 + 1 AS n FROM orders),
        s AS (SELECT k, n, CASE WHEN n > 200 THEN 'not_covered' WHEN n % 4 > 1 THEN 'in_force' WHEN k % 6 = 0 THEN 'limit_mentioned' ELSE 'limit_not_mentioned' END AS result FROM d WHERE k % 3 = 0)
        SELECT k AS draft_id, 'Section ' || n || ' of the Penal Code' AS raw_text, 'section' AS kind, result, result IN ('not_covered', 'limit_not_mentioned') AS flagged, CASE WHEN result = 'limit_not_mentioned' THEN CAST(n AS VARCHAR) ELSE '' END AS cite FROM s WHERE n <= 200 OR k % 6 = 3
        UNION ALL SELECT k, 'Section ' || n || ' of the Penal Code', 'section', 'not_covered', true, '' FROM s WHERE n > 200 AND k % 6 = 0
        UNION ALL SELECT k, '[2018] KESC ' || (k % 90 + 1) || ' (KLR)', 'case', CASE WHEN (k % 90 + 1) % 2 = 0 THEN 'found' ELSE 'not_in_collection' END, (k % 90 + 1) % 2 = 1, '' FROM d WHERE k % 6 = 1
        UNION ALL SELECT k, 'one two three four five', 'quote', 'not_checked', true, '' FROM d WHERE k % 6 = 1
        UNION ALL SELECT k, '[2018] KESC 4 (KLR)', 'case', 'found', false, '' FROM d WHERE k % 6 = 2
        UNION ALL SELECT k, 'Kimani v Otieno', 'case', 'not_confirmed', true, '' FROM d WHERE k % 12 = 11""",
}
