"""Queries on the collection: versions, lists of citing judgments, counts, loading and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stareflow.operators import relational as rel
from stareflow.plans.tables import EVENTS_SQL, JUDGMENTS_SQL, judgments, mentions, read, section_events

_EV = EVENTS_SQL.format(text="VARCHAR")


def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest text of each provision: a part's last line item."""
    rows = read(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_shipdate").cast("date").alias("version_date"), "l_orderkey", "l_linenumber", "l_quantity")
    return rel.latest(rows, ["l_partkey"], "version_date", "l_orderkey", "l_linenumber")


def ordered_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An act's version dates in order, joined to text."""
    rows = read(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderdate").cast("date").cast("string").alias("d"))
    out = rel.ordered(rows, ["o_custkey"], "d", "versions")
    return out.select("o_custkey", F.array_join("versions", ",").alias("versions"), F.size("versions").cast("long").alias("n_versions"), F.get("versions", F.lit(0)).alias("first_version"))


def citing_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every provision's list of judgments, ranked."""
    return rel.citing_list(mentions(spark, sf_dir), judgments(spark, sf_dir))


def citing_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of the list of one provision, with its total."""
    listed = rel.citing_list(mentions(spark, sf_dir).where("provision_id = 7"), judgments(spark, sf_dir))
    total = listed.agg(F.count("*").alias("total"))
    return rel.page(listed, [F.col("rank")], 5, 5).select("judgment_id", "rank").crossJoin(F.broadcast(total))


def _members(df: DataFrame) -> DataFrame:
    return df.select("provision_id").distinct().select(F.floor(F.col("provision_id") / 2).alias("chain"), "provision_id")


def cited_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgments that cite each section, sections being pairs of provisions."""
    m = mentions(spark, sf_dir)
    return rel.cited_counts(m, judgments(spark, sf_dir), _members(m))


def lead_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads of each section without a verified twin."""
    events = section_events(spark, sf_dir)
    rulings = events.select("judgment_id").distinct().withColumn("duplicate_of", F.when(F.col("judgment_id") % 13 == 0, F.col("judgment_id") - 1))
    return rel.lead_counts(events, rulings, _members(events))


def stats_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collection's totals in one row."""
    events = section_events(spark, sf_dir)
    m, j = mentions(spark, sf_dir), judgments(spark, sf_dir)
    lead = ~F.col("verified") & ~F.col("check_verdict").eqNullSafe(F.lit("fail"))
    of_events = events.agg(
        F.count_if("verified").alias("verified_events"),
        F.count_distinct(F.when(F.col("verified"), F.col("provision_id"))).alias("verified_sections"),
        F.count_if(F.col("verified") & F.col("method").startswith("man")).alias("manual_events"),
        F.count_if(lead).alias("leads"),
        F.count_distinct(F.when(lead, F.col("provision_id"))).alias("lead_sections"),
    )
    acts = read(spark, sf_dir, "nation").agg(F.count("*").alias("acts"))
    held = read(spark, sf_dir, "part").agg(F.count("*").alias("provisions"))
    rulings = j.agg(F.count_if(F.col("duplicate_of").isNull()).alias("judgments"))
    cited = m.agg(F.count_distinct("provision_id").alias("cited_provisions"))
    return acts.crossJoin(held).crossJoin(rulings).crossJoin(cited).crossJoin(of_events)  # each is one row


def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgments of one court, normalised number and day: candidates for second copies."""
    rows = read(spark, sf_dir, "orders").withColumn("number", F.concat(F.lit("Petition  No "), (F.col("o_orderkey") % 40).cast("string")))
    keys = [F.col("o_orderpriority").alias("court"), F.lower(F.regexp_replace("number", r"\s+", " ")).alias("number"), F.col("o_orderdate").cast("date").alias("day")]
    return rel.duplicate_groups(rows, keys, "o_orderkey")


def judgment_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each judgment with both open and closed mentions: how many are linked, and to which acts."""
    rows = read(spark, sf_dir, "lineitem")
    out = rows.groupBy("l_orderkey").agg(
        F.bool_or(F.col("l_returnflag") == "R").alias("any_returned"),
        F.count_if(F.col("l_linestatus") == "O").alias("n_open"),
        F.count("*").alias("n"),
        F.array_join(F.sort_array(F.collect_set((F.col("l_partkey") % 5).cast("string"))), ",").alias("acts"),
    )
    return out.where("n_open > 0 AND n_open < n AND any_returned")


def section_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provisions of each brand in natural order of their numbers, such as 8, 8A, 10."""
    number = F.concat((F.col("p_partkey") % 60).cast("string"), F.substring(F.lit("ABCDE"), (F.col("p_size") % 6 + 1).cast("int"), F.lit(1)))
    rows = read(spark, sf_dir, "part").select("p_brand", "p_partkey", number.alias("number"))
    w = Window.partitionBy("p_brand").orderBy(rel.natural_number(F.col("number")), "number", "p_partkey")
    return rows.withColumn("place", F.row_number().over(w))


_COURTS = ["1-URGENT", "3-MEDIUM", "2-HIGH"]


def court_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders ranked inside a customer by the place of their court in a list, others last."""
    rows = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    w = Window.partitionBy("o_custkey").orderBy(rel.list_position(F.col("o_orderpriority"), _COURTS), "o_orderkey")
    return rows.withColumn("place", F.row_number().over(w))


def upsert_preserve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts loaded anew: the vector stays where the text is the same."""
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("text"), F.col("o_custkey").alias("vector"))
    old = rows.where("o_orderkey % 3 <> 0")
    new = rows.where("o_orderkey % 2 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, "changed").otherwise(F.col("text")).alias("text"))
    return rel.upsert_keeping(old, new, ["o_orderkey"], "text", "vector")


def replace_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of listed judgments replaced by new ones."""
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lit("old").alias("method"))
    listed = read(spark, sf_dir, "orders").where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    new = rows.where("l_orderkey % 4 = 0 AND l_linenumber = 1").withColumn("method", F.lit("new"))
    return rel.replace_keys(rows, new, listed, "l_orderkey").groupBy("method").agg(F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("judgments"))


def fill_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a clerk's fixes filled in."""
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")).alias("link"), "o_orderpriority")
    fixes = rows.where("o_orderkey % 5 = 0").select("o_orderkey", F.lit("fixed").alias("link"))
    return rel.fill_from(rows, fixes, ["o_orderkey"], ["link"])


def prune_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statutory events whose key is gone are pruned; others stay."""
    rows = read(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    keys = rows.where("event_type = 'error' AND user_id % 2 = 0").select("event_id")
    return rel.prune(rows, keys, "event_id", F.col("event_type").startswith("err"))


def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct prompts without a cached answer, by the digest of model, version and prompt."""
    rows = read(spark, sf_dir, "conversations").where("role = 'user'").select("text")
    key = F.sha2(F.concat_ws("|", F.lit("model-1"), F.lit("v4"), F.col("text")), 256)
    cache = rows.where(F.length("text") % 3 == 0).select(key.alias("cache_key")).distinct()
    return rel.uncached(rows, cache, key)[1].select("cache_key")


def embedding_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without a vector: each distinct uncached text once, and the rows that wait for it."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("key"))
    have = rows.where("doc_id % 3 = 0").select("key").distinct()
    return rows.join(have, "key", "left_anti").groupBy("key").agg(F.count("*").alias("n_rows"), F.min("doc_id").alias("first_doc"))


def export_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases in batches of 19 by customer and id: what each batch holds."""
    rows = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    out = rel.batches(rows, [F.col("o_custkey"), F.col("o_orderkey")], 19)
    return out.groupBy("batch").agg(F.count("*").alias("n"), F.min("o_custkey").alias("low"), F.max("o_custkey").alias("high"))


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 orders of each year, the courts in turn."""
    rows = read(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("era"), "o_orderpriority", "o_orderkey")
    return rel.stratified(rows, "era", "o_orderpriority", "o_orderkey", 40, "s1-")


def disjoint_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three review samples of 40 events each that share none, in the order of a seeded hash."""
    rows = read(spark, sf_dir, "events").select("event_id", F.sha1(F.concat(F.lit("r-"), F.col("event_id").cast("string"))).alias("h"))
    first = rows.orderBy("h").limit(120)  # the rounds together: a fixed number of rows
    return first.withColumn("round", F.floor((F.row_number().over(Window.orderBy("h")) - 1) / 40)).select("event_id", "round")


def null_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a judgment's fields are there."""
    j = judgments(spark, sf_dir)
    return rel.null_rates(j, ["court", "decision_date", "party", "duplicate_of"])


def era_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgments by era and whether they have a full text."""
    year = F.year("o_orderdate")
    era = F.when(year < 1994, "early").when(year < 1996, "middle").otherwise("late")
    rows = read(spark, sf_dir, "orders").select(era.alias("era"), F.when(F.col("o_totalprice") > 100000, "html").otherwise("pdf_only").alias("fmt"))
    return rows.groupBy("era").pivot("fmt", ["html", "pdf_only"]).count().fillna(0)


def type_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type and verdict."""
    return section_events(spark, sf_dir).groupBy("event_type", F.coalesce("check_verdict", F.lit("none")).alias("verdict")).agg(F.count("*").alias("n"))


def appeal_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgments with the reported appeal against them, if any, and whether the appellate ruling is held."""
    j = judgments(spark, sf_dir).where("duplicate_of IS NULL")
    appeals = j.where("judgment_id % 6 = 0").select("judgment_id", F.when(F.col("judgment_id") % 12 == 0, "pending").otherwise("reversed").alias("later_history"), (F.col("judgment_id") + 5).alias("appellate"))
    held = judgments(spark, sf_dir).select(F.col("judgment_id").alias("appellate"), F.lit(True).alias("held"))
    return rel.left_joined(j.join(appeals, "judgment_id", "left"), held, "appellate", "judgment_id").select("judgment_id", "later_history", F.coalesce("held", F.lit(False)).alias("appellate_held"))


QUERIES = {f.__name__: f for f in (latest_version, ordered_versions, citing_rank, citing_page, cited_by, lead_counts, stats_counts, duplicate_groups, judgment_flags, section_order, court_order, upsert_preserve, replace_partition, fill_links, prune_events, cache_misses, embedding_fill, export_batches, stratified_sample, disjoint_rounds, null_rates, era_pivot, type_histogram, appeal_join)}

_CITING = f"""WITH {JUDGMENTS_SQL}, c AS (
  SELECT provision_id, judgment_id, any_value(court) AS court, any_value(decision_date) AS decision_date, count(*) AS mentions,
    first(raw_text ORDER BY char_start, raw_text, paragraph NULLS FIRST) AS first_text, first(paragraph ORDER BY char_start, raw_text, paragraph NULLS FIRST) AS first_paragraph
  FROM m JOIN j USING (judgment_id) WHERE duplicate_of IS NULL GROUP BY 1, 2
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY provision_id ORDER BY court DESC, decision_date DESC NULLS LAST, judgment_id) AS INT) AS rank FROM c)"""

ORACLE_SQL = {
    "latest_version": """SELECT l_partkey, CAST(l_shipdate AS DATE) AS version_date, l_orderkey, l_linenumber, l_quantity FROM (
        SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY CAST(l_shipdate AS DATE) DESC, l_orderkey DESC, l_linenumber DESC) AS rn FROM lineitem) WHERE rn = 1""",
    "ordered_versions": """SELECT o_custkey, string_agg(d, ',' ORDER BY d) AS versions, count(*) AS n_versions, min(d) AS first_version
        FROM (SELECT DISTINCT o_custkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d FROM orders) GROUP BY 1""",
    "citing_rank": f"{_CITING} SELECT * FROM r",
    "citing_page": f"{_CITING} SELECT judgment_id, rank, (SELECT count(*) FROM r WHERE provision_id = 7) AS total FROM r WHERE provision_id = 7 AND rank BETWEEN 6 AND 10",
    "cited_by": f"WITH {JUDGMENTS_SQL} SELECT provision_id // 2 AS chain, count(DISTINCT coalesce(duplicate_of, judgment_id)) AS cited_by FROM m JOIN j USING (judgment_id) GROUP BY 1",
    "lead_counts": f"""WITH {_EV}, k AS (SELECT provision_id // 2 AS chain, * FROM ev)
        SELECT chain, count(*) AS lead_count FROM (SELECT DISTINCT chain, judgment_id, event_type FROM k e
          WHERE NOT verified AND check_verdict IS DISTINCT FROM 'fail' AND judgment_id % 13 <> 0
            AND NOT EXISTS (SELECT 1 FROM k v WHERE v.chain = e.chain AND v.verified AND v.judgment_id IS NOT DISTINCT FROM e.judgment_id AND v.event_type = e.event_type)) GROUP BY 1""",
    "stats_counts": f"""WITH {_EV} SELECT (SELECT count(*) FROM nation) AS acts, (SELECT count(*) FROM part) AS provisions,
        (SELECT count(*) FROM orders WHERE o_orderkey % 29 <> 0) AS judgments, (SELECT count(DISTINCT l_partkey) FROM lineitem) AS cited_provisions,
        count(*) FILTER (WHERE verified) AS verified_events, count(DISTINCT provision_id) FILTER (WHERE verified) AS verified_sections,
        count(*) FILTER (WHERE verified AND method LIKE 'man%') AS manual_events,
        count(*) FILTER (WHERE NOT verified AND check_verdict IS DISTINCT FROM 'fail') AS leads,
        count(DISTINCT provision_id) FILTER (WHERE NOT verified AND check_verdict IS DISTINCT FROM 'fail') AS lead_sections FROM ev""",
    "duplicate_groups": """SELECT o_orderpriority AS court, lower(regexp_replace('Petition  No ' || CAST(o_orderkey % 40 AS VARCHAR), '\\s+', ' ', 'g')) AS number,
        CAST(o_orderdate AS DATE) AS day, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders GROUP BY 1, 2, 3 HAVING count(*) > 1""",
    "judgment_flags": """SELECT l_orderkey, bool_or(l_returnflag = 'R') AS any_returned, count(*) FILTER (WHERE l_linestatus = 'O') AS n_open, count(*) AS n,
        array_to_string(list_sort(list_distinct(list(CAST(l_partkey % 5 AS VARCHAR)))), ',') AS acts FROM lineitem GROUP BY 1
        HAVING count(*) FILTER (WHERE l_linestatus = 'O') > 0 AND count(*) FILTER (WHERE l_linestatus = 'O') < count(*) AND bool_or(l_returnflag = 'R')""",
    "section_order": """WITH p AS (SELECT p_brand, p_partkey, CAST(p_partkey % 60 AS VARCHAR) || substr('ABCDE', CAST(p_size % 6 + 1 AS INT), 1) AS number FROM part)
        SELECT *, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY CAST(regexp_replace(number, '[^0-9]', '', 'g') AS BIGINT), number, p_partkey) AS INT) AS place FROM p""",
    "court_order": """SELECT o_custkey, o_orderkey, o_orderpriority, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY
        coalesce(list_position(['1-URGENT', '3-MEDIUM', '2-HIGH'], o_orderpriority), 4), o_orderkey) AS INT) AS place FROM orders""",
    "upsert_preserve": """WITH o AS (SELECT o_orderkey, o_orderstatus AS text, o_custkey AS vector FROM orders),
        old AS (SELECT * FROM o WHERE o_orderkey % 3 <> 0), new AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'changed' ELSE text END AS text FROM o WHERE o_orderkey % 2 = 0)
        SELECT new.o_orderkey, new.text, CASE WHEN old.text = new.text THEN old.vector END AS vector FROM new LEFT JOIN old USING (o_orderkey)
        UNION ALL SELECT * FROM old WHERE o_orderkey NOT IN (SELECT o_orderkey FROM new)""",
    "replace_partition": """SELECT 'old' AS method, count(*) AS n, count(DISTINCT l_orderkey) AS judgments FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 4 = 0)
        UNION ALL SELECT 'new', count(*), count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey % 4 = 0 AND l_linenumber = 1""",
    "fill_links": """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'fixed' WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS link, o_orderpriority FROM orders""",
    "prune_events": "SELECT event_id, event_type, user_id FROM events WHERE event_type <> 'error' OR user_id % 2 = 0",
    "cache_misses": """SELECT DISTINCT sha256('model-1|v4|' || text) AS cache_key FROM conversations WHERE role = 'user'
        AND sha256('model-1|v4|' || text) NOT IN (SELECT sha256('model-1|v4|' || text) FROM conversations WHERE role = 'user' AND length(text) % 3 = 0)""",
    "embedding_fill": """SELECT sha256(text) AS key, count(*) AS n_rows, min(doc_id) AS first_doc FROM documents
        WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0) GROUP BY 1""",
    "export_batches": """SELECT (rn - 1) // 19 AS batch, count(*) AS n, min(o_custkey) AS low, max(o_custkey) AS high
        FROM (SELECT *, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS rn FROM orders) GROUP BY 1""",
    "stratified_sample": """WITH t AS (SELECT CAST(year(o_orderdate) AS INT) AS era, o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY year(o_orderdate), o_orderpriority
          ORDER BY sha1('s1-' || CAST(o_orderkey AS VARCHAR)), o_orderkey) AS turn FROM orders)
        SELECT era, o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY era ORDER BY turn, o_orderpriority) AS pick FROM t) WHERE pick <= 40""",
    "disjoint_rounds": """SELECT event_id, (rn - 1) // 40 AS round FROM (SELECT event_id, row_number() OVER (ORDER BY sha1('r-' || CAST(event_id AS VARCHAR))) AS rn FROM events) WHERE rn <= 120""",
    "null_rates": f"""WITH {JUDGMENTS_SQL} SELECT 'court' AS field, count(court) AS n_present, count(*) AS n FROM j UNION ALL SELECT 'decision_date', count(decision_date), count(*) FROM j
        UNION ALL SELECT 'party', count(party), count(*) FROM j UNION ALL SELECT 'duplicate_of', count(duplicate_of), count(*) FROM j""",
    "era_pivot": """SELECT CASE WHEN year(o_orderdate) < 1994 THEN 'early' WHEN year(o_orderdate) < 1996 THEN 'middle' ELSE 'late' END AS era,
        count(*) FILTER (WHERE o_totalprice > 100000) AS html, count(*) FILTER (WHERE o_totalprice <= 100000) AS pdf_only FROM orders GROUP BY 1""",
    "type_histogram": f"WITH {_EV} SELECT event_type, coalesce(check_verdict, 'none') AS verdict, count(*) AS n FROM ev GROUP BY 1, 2",
    "appeal_join": f"""WITH {JUDGMENTS_SQL} SELECT judgment_id, CASE WHEN judgment_id % 12 = 0 THEN 'pending' WHEN judgment_id % 6 = 0 THEN 'reversed' END AS later_history,
        judgment_id % 6 = 0 AND judgment_id + 5 IN (SELECT o_orderkey FROM orders) AS appellate_held FROM j WHERE duplicate_of IS NULL""",
}
