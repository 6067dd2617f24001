"""Queries on the standing of sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stareflow.operators import relational as rel
from stareflow.operators import status, views
from stareflow.plans.tables import EVENTS_SQL, JUDGMENTS_SQL, judgments, mentions, read, section_events

_EV = EVENTS_SQL.format(text="VARCHAR")

_HISTORY_SQL = """
{events}, evd AS (
  SELECT *, event_type IN ('repealed_by_statute', 'amended_by_statute') AS stat,
    CASE WHEN event_type IN ('declared_unconstitutional', 'read_down', 'severed', 'repealed_by_statute') THEN 'limits'
      WHEN event_type IN ('upheld', 'reversed_on_appeal') THEN 'validates' END AS dir
  FROM {source}
), evp AS (
  SELECT *, CASE WHEN event_type = 'interpreted' AND coalesce(stance, '') <> '' THEN stance ELSE dir END AS pull FROM evd
), rev AS (
  SELECT provision_id, target, reverser FROM (
    SELECT provision_id, affects_event_id AS target, event_id AS reverser, row_number() OVER (
      PARTITION BY provision_id, affects_event_id ORDER BY effective_date DESC NULLS LAST, event_id DESC) AS rn
    FROM evp WHERE event_type = 'reversed_on_appeal' AND affects_event_id IS NOT NULL) WHERE rn = 1
), dis AS (
  SELECT provision_id, event_id, displacer FROM (
    SELECT e.provision_id, e.event_id, l.event_id AS displacer, row_number() OVER (
      PARTITION BY e.provision_id, e.event_id ORDER BY l.effective_date, l.event_id) AS rn
    FROM evp e JOIN evp l ON e.provision_id = l.provision_id AND l.effective_date > e.effective_date
      AND NOT e.stat AND NOT l.stat AND e.dir IS NOT NULL AND l.pull IS NOT NULL AND l.pull <> e.dir
      AND (e.issue IS NULL OR l.issue IS NULL OR e.issue = l.issue) AND l.rank >= e.rank) WHERE rn = 1
), told AS (
  SELECT e.*, CASE WHEN r.reverser IS NOT NULL THEN 'reversed on appeal'
      WHEN d.displacer IS NOT NULL THEN 'displaced by a later ruling' ELSE 'in effect' END AS state,
    coalesce(r.reverser, d.displacer) AS superseded_by
  FROM evp e LEFT JOIN rev r ON e.provision_id = r.provision_id AND e.event_id = r.target
  LEFT JOIN dis d ON e.provision_id = d.provision_id AND e.event_id = d.event_id
)"""


def _history_sql(source: str = "ev") -> str:
    return _HISTORY_SQL.format(events=_EV, source=source)


def status_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's state and what superseded it."""
    return status.history(section_events(spark, sf_dir)).select("provision_id", "event_id", "state", "superseded_by")


def status_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each section's standing."""
    return status.standing(status.history(section_events(spark, sf_dir)))


_STANDING_SQL = """
, facts AS (
  SELECT t.provision_id, count(*) AS n_events,
    count(*) FILTER (WHERE t.state = 'reversed on appeal') AS n_reversed,
    count(*) FILTER (WHERE t.state = 'displaced by a later ruling') AS n_displaced,
    bool_or(t.state = 'in effect' AND t.event_type = 'repealed_by_statute' AND t.scope = 'total') AS repealed,
    bool_or(t.state = 'in effect' AND t.event_type = 'declared_unconstitutional' AND t.scope = 'total') AS declared,
    bool_or(t.state = 'in effect' AND coalesce(t.dir = 'limits', false) AND NOT t.stat) AS limited,
    bool_or(t.state = 'in effect' AND t.event_type = 'reversed_on_appeal') AS rev,
    bool_or(t.state = 'in effect' AND t.event_type = 'reversed_on_appeal' AND (a.event_id IS NULL OR coalesce(a.dir = 'limits', false))) AS undid,
    bool_or(t.state = 'in effect' AND t.event_type = 'upheld') AS upheld, bool_or(NOT t.stat) AS court
  FROM told t LEFT JOIN evp a ON a.provision_id = t.provision_id AND a.event_id = t.affects_event_id GROUP BY 1
)"""
_LABEL_SQL = """CASE WHEN repealed THEN 'repealed' WHEN declared THEN 'declared unconstitutional'
  WHEN limited THEN 'limited by a court' WHEN rev AND undid THEN 'in force; earlier court limits were reversed'
  WHEN rev THEN 'in force; a lower court''s ruling on it was set aside on appeal'
  WHEN upheld THEN 'in force; its validity has been tested in court'
  WHEN court THEN 'in force; interpreted by a court' ELSE 'in force; no recorded court rulings' END"""


def status_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standing of each section and issue on its own: many small histories, so that all labels occur."""
    events = section_events(spark, sf_dir).withColumn("provision_id", F.col("event_id") % 4001)
    events = events.withColumn("affects_event_id", F.when(F.col("event_type") == "reversed_on_appeal", F.col("event_id") - 4001))
    return status.standing(status.history(events))


_SMALL = "(SELECT * REPLACE (event_id % 4001 AS provision_id, CASE WHEN event_type = 'reversed_on_appeal' THEN event_id - 4001 END AS affects_event_id) FROM ev)"


def status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events that each section's label rests on."""
    events = section_events(spark, sf_dir).withColumn("provision_id", F.col("event_id") % 4001)
    events = events.withColumn("affects_event_id", F.when(F.col("event_type") == "reversed_on_appeal", F.col("event_id") - 4001))
    return status.summary(status.history(events))


_SUMMARY_SQL = """
, live AS (
  SELECT provision_id, event_id, event_type = 'repealed_by_statute' AND scope = 'total' AS repeal,
    coalesce(dir = 'limits', false) AS lim, event_type = 'declared_unconstitutional' AND scope = 'total' AS declared,
    NOT stat AS court, dir IS NOT NULL AS directed, event_type = 'interpreted' AS reads
  FROM told WHERE state = 'in effect'
), f AS (
  SELECT provision_id, bool_or(repeal) AS r, bool_or(declared) AS d, bool_or(lim AND court) AS l, bool_or(court AND directed) AS c
  FROM live GROUP BY 1
)
SELECT live.provision_id, event_id FROM live JOIN f USING (provision_id)
WHERE CASE WHEN r THEN repeal WHEN d THEN lim WHEN l THEN lim AND court WHEN c THEN court AND directed ELSE court END OR (reads AND NOT r)"""


def leads_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histories where leads never change what verified events say."""
    return status.with_leads(section_events(spark, sf_dir)).select("provision_id", "event_id", "verified", "state")


def section_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each section's whole record: status, what it rests on, history with leads, and counts."""
    events, m = section_events(spark, sf_dir), mentions(spark, sf_dir)
    held = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("provision_id"))
    own = lambda df: df.select("provision_id").distinct().select(F.col("provision_id").alias("chain"), "provision_id")
    rulings = events.select("judgment_id").distinct().withColumn("duplicate_of", F.when(F.col("judgment_id") % 13 == 0, F.col("judgment_id") - 1))
    told = status.with_leads(events.join(held, "provision_id", "left_semi"))
    out = views.section_records(held, told, rel.cited_counts(m, judgments(spark, sf_dir), own(m)), rel.lead_counts(events, rulings, own(events)))
    line = lambda h: F.concat_ws(":", h["event_id"].cast("string"), h["state"], F.when(h["verified"], "checked").otherwise("lead"))
    return out.select("provision_id", "status", F.array_join(F.transform("summary", lambda x: x.cast("string")), ",").alias("summary"), F.array_join(F.transform("history", line), ";").alias("history"), "cited_by", "lead_count")


def visible_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that may be shown, leads included: not of a second copy, not failed by the check."""
    events = section_events(spark, sf_dir)
    users = events.select("judgment_id").distinct()
    rulings = users.select("judgment_id", F.when(F.col("judgment_id") % 13 == 0, F.col("judgment_id") - 1).alias("duplicate_of")).where("judgment_id % 10 <> 0")
    return status.visible(events, rulings, include_unverified=True).select("event_id", "provision_id", "verified")


def event_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event for each section, ruling and type."""
    events = section_events(spark, sf_dir).withColumn("event_key", F.lit(None).cast("string"))
    return status.one_per_ruling(events).select("event_id", "provision_id", "event_type")


def chain_event_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of sections renumbered in pairs: what an earlier id has is not repeated under a later one."""
    events = section_events(spark, sf_dir).withColumn("source_paragraph", F.lit(None).cast("string"))
    members = events.select("provision_id").distinct().select((F.col("provision_id") % 25).alias("chain"), F.floor(F.col("provision_id") / 25).alias("pos"), "provision_id")
    events = events.withColumn("judgment_id", F.col("judgment_id") % 3)
    return status.one_per_chain(events, members).select("chain", "provision_id", "event_id")


def status_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each section's standing beside its rulings in order of date."""
    out = views.status_export(section_events(spark, sf_dir))
    line = lambda r: F.concat_ws(":", r["effective_date"].cast("string"), r["event_id"].cast("string"), r["event_type"])
    return out.select("provision_id", "status", F.array_join(F.transform("rulings", line), ";").alias("rulings"))


def standing_by_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standing of sections of two jurisdictions: one by the rules of rulings, one by whether anything repeals them."""
    place = F.when(F.col("provision_id") % 3 == 0, "ug/").otherwise("ke/")
    events = section_events(spark, sf_dir).withColumn("provision_id", F.concat(place, F.col("provision_id").cast("string")))
    repeals = lambda e: e.groupBy("provision_id").agg(F.when(F.bool_or(F.col("event_type") == "repealed_by_statute"), "repealed").otherwise("in force").alias("status"))
    return views.standing_by_rules(events, {"ke/": lambda e: status.standing(status.history(e)).select("provision_id", "status"), "ug/": repeals})


def appeal_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parties with judgments in several courts or years, the lowest court's first."""
    out = views.appeal_cases(judgments(spark, sf_dir).select("judgment_id", F.concat(F.lit("court "), F.col("court").cast("string")).alias("court"), "party"), ["court 3", "court 2", "court 1"])
    return out.select("party", F.array_join(F.transform("rulings", lambda r: r.cast("string")), ",").alias("rulings"))


QUERIES = {
    "status_export": status_export,
    "standing_by_rules": standing_by_rules,
    "appeal_cases": appeal_cases,
    "status_history": status_history,
    "status_resolve": status_resolve,
    "status_small_histories": status_by_month,
    "status_summary": status_summary,
    "leads_overlay": leads_overlay,
    "section_record": section_record,
    "visible_events": visible_events,
    "event_dedup": event_dedup,
    "chain_event_dedup": chain_event_dedup,
}

ORACLE_SQL = {
    "status_history": f"WITH {_history_sql()} SELECT provision_id, event_id, state, superseded_by FROM told",
    "status_resolve": f"WITH {_history_sql()} {_STANDING_SQL} SELECT provision_id, {_LABEL_SQL} AS status, n_events, n_reversed, n_displaced FROM facts",
    "status_small_histories": f"WITH {_history_sql(_SMALL)} {_STANDING_SQL} SELECT provision_id, {_LABEL_SQL} AS status, n_events, n_reversed, n_displaced FROM facts",
    "status_summary": f"WITH {_history_sql(_SMALL)} {_SUMMARY_SQL}",
    "leads_overlay": f"""
        SELECT provision_id, event_id, verified, state FROM (WITH {_history_sql('(SELECT * FROM ev WHERE verified)')} SELECT * FROM told)
        UNION ALL SELECT provision_id, event_id, verified, state FROM (WITH {_history_sql()} SELECT * FROM told) WHERE NOT verified""",
    "status_export": f"""WITH {_history_sql()} {_STANDING_SQL}, r AS (SELECT provision_id, string_agg(strftime(effective_date, '%Y-%m-%d') || ':' || event_id || ':' || event_type, ';' ORDER BY effective_date, event_id) AS rulings FROM ev GROUP BY 1)
        SELECT provision_id, {_LABEL_SQL} AS status, rulings FROM facts JOIN r USING (provision_id)""",
    "standing_by_rules": f"""SELECT 'ke/' || provision_id AS provision_id, status FROM (WITH {_history_sql()} {_STANDING_SQL} SELECT provision_id, {_LABEL_SQL} AS status FROM facts) WHERE provision_id % 3 <> 0
        UNION ALL SELECT 'ug/' || provision_id, CASE WHEN bool_or(event_type = 'repealed_by_statute') THEN 'repealed' ELSE 'in force' END FROM (WITH {_EV} SELECT * FROM ev) WHERE provision_id % 3 = 0 GROUP BY provision_id""",
    "appeal_cases": f"""WITH {JUDGMENTS_SQL} SELECT party, string_agg(CAST(judgment_id AS VARCHAR), ',' ORDER BY CASE WHEN court > 3 THEN -4 ELSE court - 4 END, judgment_id) AS rulings FROM j GROUP BY party HAVING count(*) > 1""",
    "section_record": f"""WITH {JUDGMENTS_SQL}, chk AS (WITH {_history_sql('(SELECT * FROM ev WHERE verified AND provision_id IN (SELECT p_partkey FROM part))')} {_STANDING_SQL} SELECT provision_id, {_LABEL_SQL} AS status FROM facts),
        smr AS (SELECT provision_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS summary FROM (WITH {_history_sql('(SELECT * FROM ev WHERE verified AND provision_id IN (SELECT p_partkey FROM part))')} {_SUMMARY_SQL}) GROUP BY 1),
        h AS (SELECT provision_id, event_id, effective_date, state, verified FROM (WITH {_history_sql('(SELECT * FROM ev WHERE verified)')} SELECT * FROM told)
          UNION ALL SELECT provision_id, event_id, effective_date, state, verified FROM (WITH {_history_sql()} SELECT * FROM told) WHERE NOT verified),
        hs AS (SELECT provision_id, string_agg(event_id || ':' || state || ':' || CASE WHEN verified THEN 'checked' ELSE 'lead' END, ';' ORDER BY effective_date DESC, event_id DESC) AS history FROM h GROUP BY 1),
        cited AS (SELECT provision_id, count(DISTINCT coalesce(duplicate_of, judgment_id)) AS n FROM m JOIN j USING (judgment_id) GROUP BY 1),
        leads AS (WITH {_EV} SELECT provision_id, count(*) AS n FROM (SELECT DISTINCT provision_id, judgment_id, event_type FROM ev e WHERE NOT verified AND check_verdict IS DISTINCT FROM 'fail' AND judgment_id % 13 <> 0
          AND NOT EXISTS (SELECT 1 FROM ev v WHERE v.provision_id = e.provision_id AND v.verified AND v.judgment_id IS NOT DISTINCT FROM e.judgment_id AND v.event_type = e.event_type)) GROUP BY 1)
        SELECT p_partkey AS provision_id, coalesce(status, 'in force; no recorded court rulings') AS status, coalesce(summary, '') AS summary, history, coalesce(cited.n, 0) AS cited_by, coalesce(leads.n, 0) AS lead_count
        FROM part LEFT JOIN chk ON chk.provision_id = p_partkey LEFT JOIN smr ON smr.provision_id = p_partkey LEFT JOIN hs ON hs.provision_id = p_partkey LEFT JOIN cited ON cited.provision_id = p_partkey LEFT JOIN leads ON leads.provision_id = p_partkey""",
    "visible_events": f"""WITH {_EV}, r AS (SELECT DISTINCT judgment_id, CASE WHEN judgment_id % 13 = 0 THEN judgment_id - 1 END AS duplicate_of
          FROM ev WHERE judgment_id % 10 <> 0)
        SELECT event_id, provision_id, verified FROM ev LEFT JOIN r USING (judgment_id)
        WHERE (verified OR check_verdict IS DISTINCT FROM 'fail') AND duplicate_of IS NULL""",
    "event_dedup": f"""WITH {_EV} SELECT event_id, provision_id, event_type FROM (
          SELECT *, row_number() OVER (PARTITION BY provision_id, judgment_id, event_type ORDER BY method = 'manual' DESC, event_id) AS rn FROM ev)
        WHERE rn = 1""",
    "chain_event_dedup": f"""WITH {_EV}, k AS (SELECT event_id, provision_id, provision_id % 25 AS chain, provision_id // 25 AS pos, judgment_id % 3 AS jid, event_type FROM ev)
        SELECT chain, provision_id, event_id FROM (SELECT *, min(pos) OVER (PARTITION BY chain, jid, event_type) AS first FROM k) WHERE pos = first""",
}
