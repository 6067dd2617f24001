"""Queries on filings and views: stand-in filings made from order keys, so that what they cite is known."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stareflow.functions import citations as cit
from stareflow.functions import text as tx
from stareflow.operators import filing as fi
from stareflow.operators import rulings as ru
from stareflow.operators import views as vw
from stareflow.plans.tables import EVENTS_SQL, mentions, read, section_events

_EV = EVENTS_SQL.format(text="VARCHAR")
_P = "CASE o_orderkey % 5 WHEN 0 THEN 'Okuta' WHEN 1 THEN 'Mwangi' WHEN 2 THEN 'Kimaru' WHEN 3 THEN 'Njoroge' ELSE 'Achieng' END"
_SAID = "one two three four five six seven eight nine"
#: The same words as other filings quote them: other marks and letters, or words left out.
_HELD = _SAID.replace("three", "THREE,")
_QUOTED = f"""CASE o_orderkey // 4 % 3 WHEN 0 THEN '{_SAID}' WHEN 1 THEN 'One two, THREE - four (five); six seven: eight nine!' ELSE 'one two three four ... six seven eight nine' END"""
_FILING = f"""CASE o_orderkey % 4
  WHEN 0 THEN 'The court in ' || {_P} || ' & another v Republic (Petition No. ' || (o_orderkey % 400) || ' of 2016) [2017] eKLR held so.'
  WHEN 1 THEN 'A stray " mark.' || chr(10) || ' ' || chr(10) || 'See ' || {_P} || ' v Attorney General [2018] KESC ' || (o_orderkey % 90 + 1) || ' (KLR); it was said "' || {_QUOTED} || '" there.'
  WHEN 2 THEN 'It is settled. Per ' || {_P} || ' v Otieno [2015] eKLR the rule of section ' || (o_orderkey % 300 + 1) || ' of the Penal Code stands.' || chr(10) || chr(10) || 'A quote "{_SAID}" here.'
  ELSE 'Section ' || (o_orderkey % 300 + 1) || ' of the Penal Code alone, and [2018] KESC ' || (o_orderkey % 90 + 1) || ' (KLR).' END"""


def _filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").selectExpr("o_orderkey AS filing_id", f"{_FILING.replace('//', 'DIV')} AS text")


def _titles(spark: SparkSession) -> DataFrame:
    """Judgments 1 to 90, of which the even ones are held."""
    return spark.range(1, 91).where("id % 2 = 0").selectExpr(
        "id AS title_id",
        "'[2018] KESC ' || id || ' (KLR)' AS citation",
        f"{_P.replace('o_orderkey', 'id')} || ' v Attorney General (Petition 1 of 2017) [2018] KESC ' || id || ' (KLR)' AS title",
        "2018 AS year",
        "CAST(NULL AS STRING) AS number",
    )


def _texts(spark: SparkSession) -> DataFrame:
    """Held judgments' texts: with the words quoted, with one word changed, or not whole."""
    passage = f"IF(id % 4 = 0, '{_HELD}', '{_HELD.replace('nine', 'ten')}')"
    body = f"'1. Before. 2. It was held that ' || {passage} || ' after. 3. The end.'"
    return spark.range(1, 91).where("id % 2 = 0").selectExpr("id AS judgment_id", f"{body} AS text", "id % 8 <> 6 AS has_full_text", "IF(id % 3 = 0, array(1), array()) AS ocr_pages")


def filing_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every case that filings cite, with the name and number before the citation."""
    return fi.cited_cases(_filings(spark, sf_dir)).select("filing_id", "form", "char_start", "citation", "year", "name", "number")


def filing_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the collection says of each cited case."""
    found = fi.case_results(fi.cited_cases(_filings(spark, sf_dir)), _titles(spark))
    return found.select("filing_id", "case_no", "result", "judgment_id")


def _quotes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    filings = _filings(spark, sf_dir)
    cases = fi.cited_cases(filings)
    results = fi.case_results(cases, _titles(spark))
    quotes = fi.quotes_given(filings, cases)
    results = fi.settled(results, quotes, _texts(spark))
    found = results.where("result = 'found'").select("filing_id", "case_no", "judgment_id")
    return cases, results, fi.checked_quotes(quotes, found, _texts(spark))


def filing_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every quote that belongs to a cited case, checked against the case's text."""
    return _quotes(spark, sf_dir)[2].select("filing_id", "quote", "judgment_id", "result", "similarity", "court_text", "char_start", "paragraph", "ocr")


def _penal_code(spark: SparkSession) -> DataFrame:
    """Sections 1 to 200 of one law."""
    return spark.range(1, 201).selectExpr("'cap-63' AS act_slug", "CAST(id AS STRING) AS number", "'sec_' || id AS eid", "'cap-63/sec_' || id AS provision_id")


def filing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings of every filing in its order."""
    cases, results, quotes = _quotes(spark, sf_dir)
    docs = _filings(spark, sf_dir).select(F.col("filing_id").alias("doc_id"), "text", F.lit(None).cast("date").alias("decision_date"))
    standing = _penal_code(spark).select("provision_id", F.lit("upheld").alias("status"))
    sections = fi.section_findings(cit.linked(cit.mentions(docs), _penal_code(spark)), standing)
    return fi.report(cases, results, quotes, sections).select("filing_id", "finding_no", "kind", "char_start", "result", "n_quotes", "n_verbatim")


def _provisions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = read(spark, sf_dir, "part")
    own = part.selectExpr("p_brand AS act_id", "p_partkey AS provision_id", "(p_partkey * 7 % 113) || IF(p_partkey % 9 = 0, 'A', '') AS number", "p_name AS heading")
    pairs = part.where("p_partkey % 6 IN (0, 1) AND p_partkey > 1").selectExpr("p_partkey AS provision_id", "p_partkey - p_partkey % 6 AS chain", "CAST(p_partkey % 6 AS INT) AS pos")
    return own, pairs


def act_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each act's sections by current id, with status and counts, in natural order."""
    own, pairs = _provisions(spark, sf_dir)
    standing = own.selectExpr("provision_id AS chain", "IF(provision_id % 3 = 0, 'limited', 'upheld') AS status").where("chain % 4 <> 0")
    cited = mentions(spark, sf_dir).groupBy(F.col("provision_id").alias("chain")).agg(F.count_distinct("judgment_id").alias("cited_by"))
    return vw.act_sections(own, pairs, standing, cited)


def section_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each section's latest text, status, and numbers before and after."""
    own, pairs = _provisions(spark, sf_dir)
    texts = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("provision_id"), F.col("l_shipdate").cast("date").alias("version_date")).agg(F.max("l_orderkey").cast("string").alias("text"))
    standing = own.selectExpr("provision_id AS chain", "'upheld' AS status").where("chain % 4 <> 0")
    return vw.section_pages(own, pairs, texts, standing).drop("heading")


_ACT = "CASE o_orderkey % 5 WHEN 0 THEN 'The Penal Code Act' WHEN 1 THEN 'Cap. 80' WHEN 2 THEN 'Zoning Act' WHEN 3 THEN 'Evidence Act, 1963' ELSE 'Sexual Offences Act No. 3 of 2006' END"
_SECTION = "CASE o_orderkey % 4 WHEN 0 THEN 's.' || (o_orderkey % 60 + 1) WHEN 1 THEN 'the one on murder' WHEN 2 THEN (o_orderkey % 60 + 1) || '(2)' ELSE 'Section ' || (o_orderkey % 60 + 1) || 'A' END"


def find_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections by the names that users give them, with the reason where none is found."""
    asked = read(spark, sf_dir, "orders").selectExpr("o_orderkey AS ask_id", f"{_ACT} AS act", f"{_SECTION} AS section")
    acts = spark.createDataFrame([("ke/act/cap-63", "Penal Code"), ("ke/act/cap-80", "Evidence Act")], "act_id string, title string")
    rows = spark.range(1, 51).selectExpr("explode(array('ke/act/cap-63', 'ke/act/cap-80')) AS act_id", "id")
    own = rows.selectExpr("act_id", "explode(IF(id % 10 = 0, array('x', 'y'), array('x'))) AS v", "CAST(id AS STRING) AS number").selectExpr("act_id", "number", "'' AS heading", "act_id || '/' || v || number AS provision_id")
    chains = spark.createDataFrame([("ke/act/cap-63/x7", "ke/act/cap-63/x7", 0), ("ke/act/cap-63/x8", "ke/act/cap-63/x7", 1)], "provision_id string, chain string, pos int")
    return vw.find_sections(asked, acts, own, chains).select("ask_id", "found", "reason", F.array_join("ids", ",").alias("ids"))


def ruling_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgments with a trigger phrase and a surely linked provision."""
    texts = read(spark, sf_dir, "orders").selectExpr("o_orderkey AS judgment_id", "CASE WHEN o_orderkey % 3 = 0 THEN 'it is NULL and Void' ELSE 'dismissed' END AS text")
    m = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS judgment_id", "l_partkey AS provision_id", "IF(l_partkey % 4 = 0, 'constitution', 'cap-63') AS act_slug", "IF(l_linenumber % 2 = 1, 0.9D, 0.6D) AS confidence")
    return ru.candidates(texts, m)


def events_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of judgments classified anew, verified ones kept."""
    events = section_events(spark, sf_dir).select("event_id", "judgment_id", "provision_id", "event_type", "verified")
    new = events.where("judgment_id % 3 = 0 AND event_id % 2 = 0").withColumns({"event_id": F.col("event_id") + 1_000_000, "verified": F.lit(False)})
    return ru.replace_unverified(events, new)


def second_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of a second pass, counted."""
    answer = lambda c: F.when(c % 5 < 3, "yes").when(c % 5 == 3, "no").when(c % 7 == 0, F.lit(None).cast("string")).otherwise("unsure")
    rows = read(spark, sf_dir, "orders").select(ru.verdict(answer(F.col("o_orderkey")), answer(F.floor(F.col("o_orderkey") / 5))).alias("verdict"))
    return rows.groupBy("verdict").agg(F.count("*").alias("n"))


def ledger_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is still to be asked, by a ledger of answers."""
    items = read(spark, sf_dir, "orders").selectExpr("o_orderkey AS item_id", "'m' AS model", "IF(o_orderkey % 2 = 0, '1', '2') AS version", "'ask ' || o_custkey AS prompt")
    done = items.where("item_id % 3 = 0").select("item_id", "model", F.lit("1").alias("version"), F.lit("").alias("prompt_key"))
    return ru.to_ask(items, done).select("item_id", "version", "prompt_key")


def appeals_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings on appeals that may be loaded, reported by outcome."""
    rows = read(spark, sf_dir, "orders").selectExpr(
        "IF(o_orderkey % 3 = 0, 'pending', 'done') AS status", "element_at(array('low', 'medium', 'high'), CAST(o_custkey % 3 AS INT) + 1) AS confidence", "IF(o_orderkey % 5 = 0, '', 'page') AS source",
        "o_orderpriority AS outcome", "o_orderstatus AS status_before", "IF(o_custkey % 2 = 0, 'F', o_orderstatus) AS status_after",
    )
    return ru.appeal_report(ru.usable_appeals(rows))


def audit_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the issue and stance that an audit gave them, counted."""
    events = section_events(spark, sf_dir)
    labels = events.where("event_id % 5 = 0").select("event_id", F.lit("sentence").alias("issue"), F.when(F.col("event_id") % 2 == 0, "limits").alias("stance"))
    return ru.audited(events, labels).groupBy("issue", "stance").agg(F.count("*").alias("n"))


def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark events and leads that are still to be reviewed."""
    events = section_events(spark, sf_dir)
    agreed = events.where("event_id % 6 = 0").select("event_id")
    verdicts = events.where("event_id % 4 = 0").select("event_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("round"))
    verdicts = verdicts.withColumn("verdict", F.when((F.col("round") == 2) & (F.col("event_id") % 8 == 0), "reopened").otherwise("right"))
    texts = events.select("provision_id").distinct().withColumn("text", F.concat(F.lit("text of "), F.col("provision_id").cast("string")))
    return ru.review_cases(events, agreed, verdicts, texts)


def scalar_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids, dates, lists and names as loaders read them."""
    rows = read(spark, sf_dir, "part")
    cap = F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("Cap. "), F.col("p_partkey").cast("string"), F.lit("A")))
    work = F.when(F.col("p_partkey") % 3 != 0, F.lit("/akn/ke/act/1990/12")).otherwise(F.lit("/akn/ke/act/2010/constitution"))
    date = F.when(F.col("p_size") % 2 == 0, F.concat((F.col("p_partkey") % 28 + 1).cast("string"), F.lit(" March 2015"))).otherwise("no date")
    return rows.select(
        "p_partkey",
        tx.act_id(cap, work).alias("act_id"),
        tx.judgment_date(date, F.lit("2020-01-02").cast("date")).alias("day"),
        F.array_join(tx.listed(F.when(F.col("p_size") % 3 != 0, F.concat(F.lit(" A , ,"), F.col("p_name"), F.lit(",")))), "|").alias("judges"),
        tx.act_key(F.concat(F.lit("The "), F.col("p_name"), F.lit(" Act No. 3 of 2006 (Revised)"))).alias("act_key"),
        F.round(F.get(tx.unit(F.array(F.col("p_size").cast("double"), F.lit(3.0))), F.lit(1)), 9).alias("unit_y"),
        tx.snippet(F.concat(F.repeat(F.lit("word "), F.col("p_size")), F.lit("end"))).alias("snippet"),
        tx.party_span(F.concat(F.lit("What did it hold in Kimaru & 17 others v Attorney General on "), "p_name", F.lit("?"))).alias("span"),
        tx.client(F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("9.9.9.9, 10.0.0."), F.col("p_size").cast("string"))), F.lit("peer")).alias("client"),
        tx.backoff(F.col("p_size") % 4 + 1).alias("wait"),
    )


QUERIES = {f.__name__: f for f in (filing_cases, filing_matches, filing_quotes, filing_report, act_sections, section_page, find_section, ruling_candidates, events_replaced, second_pass, ledger_rest, appeals_usable, audit_labels, review_queue, scalar_forms)}

_F = f"f AS (SELECT o_orderkey AS k, {_P} AS p, {_FILING} AS text FROM orders)"
_CASES = f"""{_F}, c AS (
  SELECT k, 'eklr' AS form, position('[2017]' IN text) - 1 AS char_start, NULL AS citation, 2017 AS year, p || ' & another v Republic' AS name, (k % 400) || ' of 2016' AS number FROM f WHERE k % 4 = 0
  UNION ALL SELECT k, 'neutral', position('[2018]' IN text) - 1, '[2018] KESC ' || (k % 90 + 1) || ' (KLR)', 2018, CASE WHEN k % 4 = 1 THEN p || ' v Attorney General' END, NULL FROM f WHERE k % 4 IN (1, 3)
  UNION ALL SELECT k, 'eklr', position('[2015]' IN text) - 1, NULL, 2015, p || ' v Otieno', NULL FROM f WHERE k % 4 = 2),
  r AS (SELECT *, k % 90 + 1 AS id, CASE WHEN form = 'eklr' OR (k % 90 + 1) % 2 = 1 THEN 'not_in_collection' WHEN name IS NULL OR k % 5 = (k % 90 + 1) % 5 THEN 'found' ELSE 'name_mismatch' END AS result FROM c),
  q AS (SELECT k, CASE WHEN result = 'found' THEN id END AS judgment_id, CASE WHEN result <> 'found' OR id % 8 = 6 THEN 'not_checked' WHEN id % 4 = 0 THEN 'verbatim' WHEN k // 4 % 3 = 2 THEN 'not_found' ELSE 'close' END AS result, {_QUOTED.replace('o_orderkey', 'k')} AS quote, result = 'found' AND id % 8 <> 6 AND id % 3 = 0 AS ocr FROM r WHERE k % 4 = 1)"""
_CH = """o AS (SELECT p_brand AS act_id, p_partkey AS provision_id, CAST(p_partkey * 7 % 113 AS VARCHAR) || CASE WHEN p_partkey % 9 = 0 THEN 'A' ELSE '' END AS number, p_name AS heading,
    CASE WHEN p_partkey % 6 IN (0, 1) AND p_partkey > 1 THEN p_partkey - p_partkey % 6 ELSE p_partkey END AS chain, CASE WHEN p_partkey % 6 = 1 AND p_partkey > 1 THEN 1 ELSE 0 END AS pos FROM part)"""

ORACLE_SQL = {
    "filing_cases": f"WITH {_CASES} SELECT k AS filing_id, form, CAST(char_start AS INT) AS char_start, citation, CAST(year AS INT) AS year, name, number FROM c",
    "filing_matches": f"WITH {_CASES} SELECT k AS filing_id, CAST(0 AS INT) AS case_no, result, CASE WHEN result <> 'not_in_collection' THEN id END AS judgment_id FROM r",
    "filing_quotes": f"""WITH {_CASES}, s AS (SELECT *, result IN ('verbatim', 'close') AS shown FROM q) SELECT k AS filing_id, quote, judgment_id, result, CASE result WHEN 'verbatim' THEN 1e0 WHEN 'close' THEN 0.89e0 END AS similarity,
        CASE WHEN result = 'verbatim' THEN '{_HELD}' WHEN shown THEN '{_HELD.replace("nine", "ten")}' END AS court_text, CASE WHEN shown THEN 31 END AS char_start, CASE WHEN shown THEN '2' END AS paragraph, ocr FROM s""",
    "filing_report": f"""WITH {_CASES}, a AS (
          SELECT r.k, 'case' AS kind, char_start, r.result, CASE WHEN q.k IS NULL THEN 0 ELSE 1 END AS n_quotes, CASE WHEN q.result = 'verbatim' THEN 1 ELSE 0 END AS n_verbatim FROM r LEFT JOIN q USING (k)
          UNION ALL SELECT k, 'section', position(CASE WHEN k % 4 = 2 THEN 'section' ELSE 'Section' END IN text) - 1, CASE WHEN k % 300 + 1 <= 200 THEN 'linked' ELSE 'not_covered' END, 0, 0 FROM f WHERE k % 4 IN (2, 3))
        SELECT k AS filing_id, CAST(row_number() OVER (PARTITION BY k ORDER BY char_start, kind) AS INT) AS finding_no, kind, CAST(char_start AS INT) AS char_start, result, CAST(n_quotes AS BIGINT) AS n_quotes, CAST(n_verbatim AS BIGINT) AS n_verbatim FROM a""",
    "act_sections": f"""WITH {_CH}, l AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY chain ORDER BY pos DESC) = 1),
        c AS (SELECT l_partkey AS chain, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1)
        SELECT act_id, provision_id, number, heading, CASE WHEN chain % 4 = 0 THEN 'no_rulings' WHEN chain % 3 = 0 THEN 'limited' ELSE 'upheld' END AS status, coalesce(n, 0) AS cited_by,
          CAST(row_number() OVER (PARTITION BY act_id ORDER BY CAST(regexp_extract(number, '\\d+') AS BIGINT), number, provision_id) AS INT) AS place FROM l LEFT JOIN c USING (chain)""",
    "section_page": f"""WITH {_CH}, t AS (SELECT l_partkey AS provision_id, CAST(l_shipdate AS DATE) AS d, CAST(max(l_orderkey) AS VARCHAR) AS text FROM lineitem GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY CAST(l_shipdate AS DATE) DESC) = 1)
        SELECT provision_id, number, d AS version_date, text, CASE WHEN chain % 4 = 0 THEN 'no_rulings' ELSE 'upheld' END AS status,
          lag(number) OVER (PARTITION BY chain ORDER BY pos) AS was_number, lead(number) OVER (PARTITION BY chain ORDER BY pos) AS next_number FROM o LEFT JOIN t USING (provision_id)""",
    "find_section": f"""WITH a AS (SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN 'cap-63' WHEN 1 THEN 'cap-80' WHEN 3 THEN 'cap-80' END AS act, o_orderkey % 60 + 1 AS n, o_orderkey % 4 AS f FROM orders),
        b AS (SELECT *, CASE WHEN act IS NULL THEN 'act_not_recognised' WHEN f = 1 THEN 'no_section_number' WHEN f = 3 OR n > 50 THEN 'section_not_held' WHEN n % 10 = 0 THEN 'ambiguous' END AS reason FROM a)
        SELECT k AS ask_id, coalesce(reason, '') IN ('', 'ambiguous') AS found, reason,
          CASE WHEN reason IS NULL THEN 'ke/act/' || act || '/x' || CASE WHEN act = 'cap-63' AND n = 7 THEN 8 ELSE n END WHEN reason = 'ambiguous' THEN 'ke/act/' || act || '/x' || n || ',ke/act/' || act || '/y' || n ELSE '' END AS ids FROM b""",
    "ruling_candidates": "SELECT l_orderkey AS judgment_id, count(DISTINCT l_partkey) AS held FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_orderkey % 3 = 0 AND l_linenumber % 2 = 1 AND l_partkey % 4 <> 0 GROUP BY 1",
    "events_replaced": f"""WITH {_EV}, e AS (SELECT event_id, judgment_id, provision_id, event_type, verified FROM ev), n AS (SELECT * FROM e WHERE judgment_id % 3 = 0 AND event_id % 2 = 0)
        SELECT * FROM e WHERE verified OR judgment_id NOT IN (SELECT judgment_id FROM n)
        UNION ALL SELECT event_id + 1000000, judgment_id, provision_id, event_type, false FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE verified AND e.judgment_id = n.judgment_id AND e.provision_id = n.provision_id AND e.event_type = n.event_type)""",
    "second_pass": """WITH x AS (SELECT CASE WHEN o_orderkey % 5 < 3 THEN 'yes' WHEN o_orderkey % 5 = 3 THEN 'no' WHEN o_orderkey % 7 <> 0 THEN 'unsure' END AS a,
          CASE WHEN o_orderkey // 5 % 5 < 3 THEN 'yes' WHEN o_orderkey // 5 % 5 = 3 THEN 'no' WHEN o_orderkey // 5 % 7 <> 0 THEN 'unsure' END AS b FROM orders)
        SELECT CASE WHEN a = 'yes' AND b = 'yes' THEN 'pass' WHEN coalesce(a, '') = 'no' OR coalesce(b, '') = 'no' THEN 'fail' ELSE 'unsure' END AS verdict, count(*) AS n FROM x GROUP BY 1""",
    "ledger_rest": """WITH i AS (SELECT o_orderkey AS item_id, CASE WHEN o_orderkey % 2 = 0 THEN '1' ELSE '2' END AS version, 'ask ' || o_custkey AS prompt FROM orders)
        SELECT item_id, version, sha256('m|' || version || '|' || prompt) AS prompt_key FROM i WHERE NOT (item_id % 3 = 0 AND version = '1')""",
    "appeals_usable": "SELECT o_orderpriority AS outcome, count(*) AS n, count(*) FILTER (WHERE o_custkey % 2 = 0 AND o_orderstatus <> 'F') AS n_changed FROM orders WHERE o_orderkey % 3 = 0 AND o_custkey % 3 <> 0 AND o_orderkey % 5 <> 0 GROUP BY 1",
    "audit_labels": f"""WITH {_EV} SELECT CASE WHEN event_id % 5 = 0 THEN 'sentence' ELSE issue END AS issue, CASE WHEN event_id % 10 = 0 THEN 'limits' ELSE stance END AS stance, count(*) AS n FROM ev GROUP BY 1, 2""",
    "review_queue": f"""WITH {_EV} SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'benchmark' ELSE 'lead' END AS kind, provision_id, 'text of ' || provision_id AS text FROM ev
        WHERE event_id % 6 = 0 OR (NOT verified AND NOT (event_id % 4 = 0 AND event_id % 8 <> 0))""",
    "scalar_forms": """SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN 'ke/act/cap-' || p_partkey || 'a' ELSE 'ke/act/constitution' END AS act_id,
        CASE WHEN p_size % 2 = 0 THEN make_date(2015, 3, CAST(p_partkey % 28 + 1 AS INT)) ELSE DATE '2020-01-02' END AS day, CASE WHEN p_size % 3 <> 0 THEN 'A|' || p_name END AS judges,
        lower(p_name) AS act_key, round(CAST(3 AS DOUBLE) / sqrt(CAST(p_size AS DOUBLE) * p_size + 9), 9) AS unit_y,
        CASE WHEN p_size * 5 + 3 < 240 THEN repeat('word ', p_size) || 'end' ELSE rtrim(repeat('word ', 47)) || '…' END AS snippet,
        'Kimaru & 17 others v Attorney General' AS span, CASE WHEN p_size % 2 = 0 THEN '10.0.0.' || p_size ELSE 'peer' END AS client, CAST(60 * power(2, p_size % 4) AS DOUBLE) AS wait FROM part""",
}
