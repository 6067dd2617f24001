"""Queries that score results against labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stareflow.operators import evaluation as ev
from stareflow.operators import relational as rel
from stareflow.plans.tables import EVENTS_SQL, read, section_events

_EV = EVENTS_SQL.format(text="VARCHAR")


def _hash_label(key: str, salt: int, kinds: list[str]):
    out = F.lit(kinds[0])
    for i, k in enumerate(kinds):
        out = F.when((F.col(key) * 31 + F.lit(salt)) % len(kinds) == i, k).otherwise(out)
    return out


def _label_sql(key: str, salt: int, kinds: list[str]) -> str:
    return f"CASE ({key} * 31 + {salt}) % {len(kinds)} " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(kinds)) + " END"


def label_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of links against labels with alternatives."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_custkey").cast("string").alias("c"))
    ids = F.array(F.when(F.col("item_id") % 5 == 0, F.lit("x")).otherwise(F.col("c")), F.col("c"))
    answers = rows.select("item_id", _hash_label("item_id", 3, ["found", "found", "possible_match", "not_in_collection"]).alias("result"), ids.alias("ids"))
    gold = rows.select("item_id", F.when(F.col("item_id") % 4 == 0, "not_held").when(F.col("item_id") % 3 == 0, F.concat(F.lit("a|"), F.col("c"))).otherwise(F.col("c")).alias("gold"))
    return ev.link_scores(answers, gold)


def grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thresholds of fewest wrong finds."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item_id"), (F.col("l_quantity") / 50).alias("top"), (F.col("l_discount") * 5).alias("second"), (F.col("l_quantity") * 7 % 10 > F.col("l_tax") * 30).alias("right"))
    grid = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(f).alias("found_score"), F.lit(m).alias("margin")) for f in (0.6, 0.7, 0.8, 0.9) for m in (0.1, 0.2, 0.3, 0.4)))).alias("g")).select("g.*")
    return ev.best_thresholds(rows, grid)


_KINDS = ["a", "a", "not_held", "b", "unsure"]


def label_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two labellers, a third who decides, and an audit."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"))
    label = lambda salt, keep: rows.where(keep).select("item_id", _hash_label("item_id", salt, _KINDS).alias("label"))
    return ev.merged_labels(rows, label(0, "item_id % 50 <> 0"), label(5, "item_id % 60 <> 0").withColumn("label", F.when(F.col("item_id") % 4 == 0, "c").otherwise(F.col("label"))), label(2, "item_id % 3 <> 0"), label(3, "item_id % 7 = 0"))


def label_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of two labellers with the same rows."""
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("ref"), F.col("l_partkey").alias("law"))
    a, b = rows, rows.where("NOT (l_orderkey % 10 = 0 AND ref = 2)").withColumn("law", F.when(F.col("l_orderkey") % 13 == 0, 0).otherwise(F.col("law")))
    return ev.same_multiset(a, b, ["l_orderkey"], ["ref", "law"]).groupBy("status").agg(F.count("*").alias("n"))


def review_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blind reviews of claimed events by two reviewers."""
    events = section_events(spark, sf_dir)
    def seen(salt: int) -> DataFrame:
        v = ev.review_verdict(_hash_label("event_id", salt, ["yes", "yes", "no", "yes", "unsure", "yes"]), _hash_label("event_id", salt + 1, ["yes", "yes", "yes", "no"]), F.when(F.col("event_id") % (salt + 5) == 0, "upheld").otherwise(F.col("event_type")), F.col("event_type"))
        return events.select("event_id", v.alias("verdict"))

    return ev.agreed_verdicts(seen(0), seen(2))


def checker_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second-pass check by round."""
    rows = section_events(spark, sf_dir).select((F.col("event_id") % 3).alias("round"), F.col("verified").alias("right"), F.coalesce("check_verdict", F.lit("unsure")).alias("verdict"))
    return ev.checker_rounds(rows)


def review_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions against labels of documents."""
    rows = read(spark, sf_dir, "labels").select(_hash_label("doc_id", 1, ["accept", "reject", "accept", "unsure"]).alias("decision"), (F.col("quality") == 1).alias("right"))
    return ev.review_scores(rows)


def event_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted events against an answer key."""
    events = section_events(spark, sf_dir)
    key = events.where("method = 'manual'").select("judgment_id", "provision_id", "event_type", "scope").distinct()
    got = events.where("method <> 'manual' AND event_id % 4 = 1").select("judgment_id", "provision_id", "event_type", "scope")
    return ev.event_scores(key, got)


def event_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted events where an answer key has none."""
    events = section_events(spark, sf_dir)
    key = events.where("event_id % 6 = 0").select("judgment_id", "provision_id")
    negatives = events.where("event_id % 6 = 3").select("judgment_id", "provision_id").distinct().join(key.distinct(), ["judgment_id", "provision_id"], "left_anti")
    return ev.event_alarms(key, negatives, events.where("event_id % 4 = 1").select("judgment_id", "provision_id"))


_LAWS = "CASE {} % 5 WHEN 0 THEN 'Penal Code' WHEN 1 THEN 'Evidence Act' WHEN 2 THEN 'Zoning Act' WHEN 3 THEN 'the Act' END"
_GOLD = f"SELECT l_orderkey AS doc_id, CAST(l_linenumber * 10 AS INT) AS spot, min(l_partkey % 3) AS number, coalesce(min({_LAWS.format('l_partkey')}), 'unknown') AS law FROM lineitem GROUP BY 1, 2"
#: Spans that overlap: each reaches the next place, some the one behind it.
_SPANS = f"SELECT l_orderkey AS doc_id, CAST(l_linenumber * 10 - 2 AS INT) AS start, CAST(l_linenumber * 10 + 11 + l_suppkey % 2 * 10 AS INT) AS stop, l_partkey % 3 AS number, {_LAWS.format('(l_partkey + l_suppkey)')} AS law FROM lineitem WHERE (l_orderkey + l_linenumber) % 7 <> 0"


def mention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected citations, whose spans overlap, against gold places, one for one."""
    rows = read(spark, sf_dir, "lineitem")
    gold, found = (spark.sql(q.replace("FROM lineitem", "FROM {rows}"), rows=rows) for q in (_GOLD, _SPANS))
    return ev.mention_scores(gold.withColumnRenamed("spot", "at"), found.withColumnRenamed("stop", "end"), ["Penal Code", "Evidence Act"])


def key_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with an answer key made from events."""
    rows = read(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("event_key"), F.col("user_id").alias("judgment_id"), (F.col("event_id") % 60).alias("provision_id"), F.col("event_type"),
        F.when(F.col("event_id") % 3 == 0, "partial").when(F.col("event_id") % 31 == 0, "some").otherwise("total").alias("scope"),
        F.when(F.col("event_id") % 6 == 0, "words").alias("scope_text"), F.concat(F.lit("user  "), (F.col("user_id") + (F.col("event_id") % 41 == 0).cast("int")).cast("string"), F.lit(".")).alias("quote"),
        F.when(F.col("event_id") % 9 == 0, (F.col("event_id") + 500).cast("string")).alias("affects_event"),
    )
    texts = rows.where("judgment_id % 20 <> 0").select("judgment_id").distinct().withColumn("text", F.concat(F.lit("said of user "), F.col("judgment_id").cast("string"), F.lit(".")))
    provisions = spark.range(55).select(F.col("id").alias("provision_id"))
    return ev.key_errors(rows, provisions, texts, ["click", "view", "purchase", "error"]).groupBy("error").agg(F.count("*").alias("n"))


def bench_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected flags met, each by a flag of its own."""
    rows = read(spark, sf_dir, "lineitem")
    expected = rows.where("l_returnflag = 'R'").select((F.col("l_orderkey") % 500).alias("k"), "l_linestatus")
    got = rows.where("l_returnflag = 'A'").select((F.col("l_orderkey") % 500).alias("k"), "l_linestatus")
    return ev.multiset_recall(expected, got, ["k", "l_linestatus"])


def answer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers' references against what tools returned and what was expected."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("qid"), (F.col("o_orderkey") % 5).alias("a"), (F.col("o_custkey") % 5).alias("b"))
    return ev.answer_scores(rows.select("qid", F.array("a", "b").alias("refs"), F.array("a", F.lit(3).cast("long")).alias("seen"), F.array("b").alias("expected"), F.array("a", F.lit(1).cast("long")).alias("key_events")))


def saved_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a saved verdict under their key; the last file's verdict wins."""
    events = section_events(spark, sf_dir).select("event_id", "judgment_id", "event_type", F.left(F.lower("props"), F.lit(120)).alias("quote"))
    saved = events.where("event_id % 4 = 0").select("judgment_id", "event_type", "quote", (F.col("event_id") % 3).alias("file_no"), "event_id")
    last = rel.latest(saved.withColumn("decision", F.when(F.col("event_id") % 8 == 0, "accept").otherwise("reject")).drop("event_id").groupBy("judgment_id", "event_type", "quote", "file_no").agg(F.max("decision").alias("decision")), ["judgment_id", "event_type", "quote"], "file_no")
    return events.join(last, ["judgment_id", "event_type", "quote"]).groupBy("decision").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (label_eval, grid_search, label_merge, label_agreement, review_precision, checker_rounds, review_scores, event_scores, event_alarms, mention_scores, key_errors, bench_recall, answer_scores, saved_verdicts)}


def _verdict_sql(salt: int) -> str:
    return f"""SELECT event_id, CASE WHEN e = 'no' THEN 'not an event' WHEN e <> 'yes' THEN 'unsure' WHEN s <> 'yes' THEN 'wrong section' WHEN t = event_type THEN 'right' ELSE 'wrong type (' || t || ')' END AS v
      FROM (SELECT event_id, event_type, {_label_sql('event_id', salt, ['yes', 'yes', 'no', 'yes', 'unsure', 'yes'])} AS e, {_label_sql('event_id', salt + 1, ['yes', 'yes', 'yes', 'no'])} AS s,
        CASE WHEN event_id % {salt + 5} = 0 THEN 'upheld' ELSE event_type END AS t FROM ev)"""


ORACLE_SQL = {
    "label_eval": f"""WITH r AS (SELECT o_orderkey AS i, CAST(o_custkey AS VARCHAR) AS c FROM orders), x AS (SELECT i, c, {_label_sql('i', 3, ['found', 'found', 'possible_match', 'not_in_collection'])} AS result,
          CASE WHEN i % 5 = 0 THEN 'x' ELSE c END AS f, CASE WHEN i % 4 = 0 THEN 'not_held' WHEN i % 3 = 0 THEN 'a|' || c ELSE c END AS gold FROM r)
        SELECT count(*) AS items, count(*) FILTER (WHERE gold <> 'not_held') AS held, count(*) FILTER (WHERE result = 'found') AS found, count(*) FILTER (WHERE result = 'found' AND gold <> 'not_held' AND f = c) AS "right",
          count(*) FILTER (WHERE result = 'found' AND NOT (gold <> 'not_held' AND f = c)) AS wrong, count(*) FILTER (WHERE result = 'possible_match' AND gold <> 'not_held') AS possible,
          count(*) FILTER (WHERE result = 'possible_match' AND gold <> 'not_held') AS possible_hit, count(*) FILTER (WHERE result = 'found' AND gold = 'not_held') AS false_found FROM x""",
    "grid_search": """WITH s AS (SELECT l_quantity / 50 AS top, l_discount * 5 AS second, (l_quantity * 7) % 10 > l_tax * 30 AS r FROM lineitem), g AS (SELECT f, m FROM (VALUES (0.6e0), (0.7e0), (0.8e0), (0.9e0)) a(f), (VALUES (0.1e0), (0.2e0), (0.3e0), (0.4e0)) b(m))
        SELECT f AS found_score, m AS margin, count(*) FILTER (WHERE NOT r) AS wrong, count(*) FILTER (WHERE r) AS cover FROM g LEFT JOIN s ON top >= f AND top - coalesce(second, 0) >= m GROUP BY 1, 2 ORDER BY 3, 4 DESC, 1, 2 LIMIT 1""",
    "label_merge": f"""WITH x AS (SELECT o_orderkey AS item_id, {_label_sql('o_orderkey', 0, _KINDS)} AS a, CASE WHEN o_orderkey % 4 = 0 THEN 'c' ELSE {_label_sql('o_orderkey', 5, _KINDS)} END AS b,
          CASE WHEN o_orderkey % 3 <> 0 THEN {_label_sql('o_orderkey', 2, _KINDS)} END AS c, CASE WHEN o_orderkey % 7 = 0 THEN {_label_sql('o_orderkey', 3, _KINDS)} END AS x FROM orders WHERE o_orderkey % 50 <> 0 AND o_orderkey % 60 <> 0),
        y AS (SELECT item_id, x, a = b AND a <> 'unsure' AS agreed, CASE WHEN a = b AND a <> 'unsure' THEN a ELSE coalesce(c, '') END AS gold FROM x),
        z AS (SELECT *, gold = 'not_held' AND coalesce(x, 'not_held') NOT IN ('not_held', 'unsure', '') AS put FROM y)
        SELECT item_id, CASE WHEN put THEN x ELSE gold END AS gold, agreed AND NOT put AS agreed FROM z""",
    "label_agreement": """WITH a AS (SELECT l_orderkey AS k, list_sort(list({'r': l_linenumber, 'l': l_partkey})) AS x FROM lineitem GROUP BY 1),
        b AS (SELECT l_orderkey AS k, list_sort(list({'r': l_linenumber, 'l': CASE WHEN l_orderkey % 13 = 0 THEN 0 ELSE l_partkey END})) AS y FROM lineitem WHERE NOT (l_orderkey % 10 = 0 AND l_linenumber = 2) GROUP BY 1)
        SELECT CASE WHEN x IS NOT NULL AND coalesce(x = y, false) THEN 'verified' ELSE 'disagree' END AS status, count(*) AS n FROM a FULL JOIN b USING (k) GROUP BY 1""",
    "review_precision": f"WITH {_EV}, a AS ({_verdict_sql(0)}), b AS ({_verdict_sql(2)}) SELECT CASE WHEN a.v = b.v THEN a.v ELSE 'split' END AS verdict, count(*) AS n FROM a JOIN b USING (event_id) GROUP BY 1",
    "checker_rounds": f"""WITH {_EV} SELECT event_id % 3 AS round, count(*) FILTER (WHERE NOT verified) AS wrong, count(*) FILTER (WHERE NOT verified AND coalesce(check_verdict, '') <> 'pass') AS caught,
        count(*) FILTER (WHERE verified) AS "right", count(*) FILTER (WHERE verified AND check_verdict = 'pass') AS kept FROM ev GROUP BY 1""",
    "review_scores": f"""WITH x AS (SELECT {_label_sql('doc_id', 1, ['accept', 'reject', 'accept', 'unsure'])} AS d, quality = 1 AS r FROM labels) SELECT count(*) FILTER (WHERE d = 'accept' AND r) AS tp, count(*) FILTER (WHERE d = 'accept' AND NOT r) AS fp,
        count(*) FILTER (WHERE d = 'reject' AND r) AS fn, count(*) FILTER (WHERE d = 'reject' AND NOT r) AS tn, count(*) FILTER (WHERE d = 'unsure') AS unsure FROM x""",
    "event_scores": f"""WITH {_EV}, k AS (SELECT DISTINCT judgment_id, provision_id, event_type, scope FROM ev WHERE method = 'manual'), g AS (SELECT judgment_id, provision_id, event_type, scope FROM ev WHERE method <> 'manual' AND event_id % 4 = 1),
        b AS (SELECT k.*, g.event_type AS gt, g.scope AS gs, row_number() OVER (PARTITION BY k.judgment_id, k.provision_id, k.event_type, k.scope ORDER BY g.event_type IS NULL, g.event_type <> k.event_type, g.event_type, g.scope) AS rn FROM k LEFT JOIN g USING (judgment_id, provision_id))
        SELECT count(*) AS events, count(gt) AS found, count(*) FILTER (WHERE gt = event_type) AS type_right, count(*) FILTER (WHERE gs = scope) AS scope_right FROM b WHERE rn = 1""",
    "event_alarms": f"""WITH {_EV}, k AS (SELECT judgment_id, provision_id FROM ev WHERE event_id % 6 = 0), n AS (SELECT DISTINCT judgment_id, provision_id FROM ev WHERE event_id % 6 = 3 AND (judgment_id, provision_id) NOT IN (SELECT (judgment_id, provision_id) FROM k)),
        g AS (SELECT judgment_id, provision_id FROM ev WHERE event_id % 4 = 1)
        SELECT (SELECT count(*) FROM n) AS negatives, (SELECT count(*) FROM n WHERE (judgment_id, provision_id) IN (SELECT (judgment_id, provision_id) FROM g)) AS false_alarms,
          (SELECT count(*) FROM g WHERE judgment_id IN (SELECT judgment_id FROM k) AND (judgment_id, provision_id) NOT IN (SELECT (judgment_id, provision_id) FROM k)) AS extras""",
    "mention_scores": f"""WITH RECURSIVE gold AS ({_GOLD}), found AS ({_SPANS}),
        g AS (SELECT doc_id, number, list({{'p': spot, 'law': law}} ORDER BY spot, law) AS gs FROM gold GROUP BY 1, 2),
        s AS (SELECT doc_id, number, list({{'a': start, 'b': stop, 'law': law}} ORDER BY start, stop, law NULLS FIRST) AS ss FROM found GROUP BY 1, 2),
        b AS (SELECT doc_id, number, gs, coalesce(ss, []) AS ss FROM g LEFT JOIN s USING (doc_id, number)),
        r AS (SELECT doc_id, number, gs, ss, 0 AS k, CAST([] AS BIGINT[]) AS taken, CAST(NULL AS BIGINT) AS pick FROM b
          UNION ALL SELECT doc_id, number, gs, ss, k + 1, list_append(taken, pick2), pick2 FROM (SELECT *, list_filter(range(1, len(ss) + 1), lambda i: ss[i].a <= gs[k + 1].p AND gs[k + 1].p < ss[i].b AND NOT list_contains(taken, i))[1] AS pick2 FROM r WHERE k < len(gs))),
        m AS (SELECT gs[k].law AS law, ss[pick].law AS got FROM r WHERE k > 0 AND pick IS NOT NULL),
        c AS (SELECT *, law = 'unknown' AS uns, law <> 'unknown' AND (got IS NULL OR got = 'the Act') AS op,
          CASE WHEN law IN ('Penal Code', 'Evidence Act') THEN got = law ELSE got NOT IN ('Penal Code', 'Evidence Act') END AS fits FROM m)
        SELECT (SELECT count(*) FROM gold) AS gold, count(*) AS matched, (SELECT count(*) FROM gold) - count(*) AS missed, (SELECT count(*) FROM found) AS extracted, (SELECT count(*) FROM found) - count(*) AS spurious,
          count(*) FILTER (WHERE NOT uns AND NOT op AND fits) AS law_right, count(*) FILTER (WHERE NOT uns AND NOT op AND NOT fits) AS law_wrong, count(*) FILTER (WHERE op) AS law_unresolved, count(*) FILTER (WHERE uns) AS law_unscored FROM c""",
    "key_errors": """WITH e AS (SELECT event_id, user_id, event_type, event_id % 60 AS p, CASE WHEN event_id % 3 = 0 THEN 'partial' WHEN event_id % 31 = 0 THEN 'some' ELSE 'total' END AS scope FROM events), m AS (SELECT max(event_id) AS m, min(event_id) AS lo FROM events)
        SELECT 'no text' AS error, count(*) AS n FROM e WHERE user_id % 20 = 0 HAVING count(*) > 0
        UNION ALL SELECT 'quote not found', count(*) FROM e WHERE user_id % 20 <> 0 AND event_id % 41 = 0 HAVING count(*) > 0
        UNION ALL SELECT 'unknown provision', count(*) FROM e WHERE p >= 55 HAVING count(*) > 0 UNION ALL SELECT 'bad type', count(*) FROM e WHERE event_type = 'signup' HAVING count(*) > 0
        UNION ALL SELECT 'bad scope', count(*) FROM e WHERE scope = 'some' HAVING count(*) > 0 UNION ALL SELECT 'partial scope needs words', count(*) FROM e WHERE scope = 'partial' AND event_id % 6 <> 0 HAVING count(*) > 0
        UNION ALL SELECT 'link to no event', count(*) FROM e WHERE event_id % 9 = 0 AND event_id + 500 NOT IN (SELECT event_id FROM events) HAVING count(*) > 0""",
    "bench_recall": """WITH e AS (SELECT l_orderkey % 500 AS k, l_linestatus AS s, count(*) AS e FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2), g AS (SELECT l_orderkey % 500 AS k, l_linestatus AS s, count(*) AS g FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2)
        SELECT CAST(sum(coalesce(e, 0)) AS BIGINT) AS expected, CAST(sum(least(coalesce(e, 0), coalesce(g, 0))) AS BIGINT) AS met, CAST(sum(greatest(coalesce(g, 0) - coalesce(e, 0), 0)) AS BIGINT) AS extra FROM e FULL JOIN g USING (k, s)""",
    "answer_scores": """SELECT o_orderkey AS qid, CAST(CASE WHEN b IN (a, 3) THEN 0 ELSE 1 END AS BIGINT) AS invented, true AS sections_found, 1 IN (a, b) AS rulings_found FROM (SELECT o_orderkey, o_orderkey % 5 AS a, o_custkey % 5 AS b FROM orders)""",
    "saved_verdicts": f"""WITH {_EV}, q AS (SELECT event_id, judgment_id, event_type, substr(lower(props), 1, 120) AS quote FROM ev),
        s AS (SELECT judgment_id, event_type, quote, event_id % 3 AS f, max(CASE WHEN event_id % 8 = 0 THEN 'accept' ELSE 'reject' END) AS decision FROM q WHERE event_id % 4 = 0 GROUP BY 1, 2, 3, 4),
        l AS (SELECT judgment_id, event_type, quote, arg_max(decision, f) AS decision FROM s GROUP BY 1, 2, 3) SELECT decision, count(*) AS n FROM q JOIN l USING (judgment_id, event_type, quote) GROUP BY 1""",
}
