"""Queries on the stemmed word search and on sections found by words and vectors together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stareflow.operators import matching as mt
from stareflow.operators import relational as rel
from stareflow.operators import search, status
from stareflow.plans.rulings import _LABEL_SQL, _STANDING_SQL, _history_sql
from stareflow.plans.tables import EVENTS_SQL, JUDGMENTS_SQL, judgments, mentions, read, section_events

ASKED = ['licenses', '"general public" license', '"apache licensing" or "mit license"', 'licensed -apache', '"released under the MIT"', 'the of -license', 'version or reserved']


def stem_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, phrases, alternatives and exclusions asked of all documents, with scores."""
    docs = read(spark, sf_dir, "documents")
    queries = docs.sparkSession.createDataFrame(list(enumerate(ASKED)), "query_id int, query string")
    return search.matches(search.inverted(docs), queries).select("query_id", "doc_id", F.round("score", 6).alias("score"))


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections' newest texts: two documents in a row are versions of one section."""
    rows = read(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 2).alias("provision_id"), (F.col("doc_id") % 2).alias("version"), "text")
    return rel.latest(rows, ["provision_id"], "version")


def section_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty sections that words and a vector find in the latest texts, with status and counts."""
    latest = _latest(spark, sf_dir)
    queries = spark.createDataFrame([(0, 'licenses or "general public"')], "query_id int, query string")
    by_words = search.ranked(search.matches(search.inverted(latest.select(F.col("provision_id").alias("doc_id"), "text")), queries), mt.DEPTH).select("doc_id", "rank")
    vectors = read(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 2).alias("doc_id"), (F.col("vec_id") % 2).alias("version"), F.col("embedding").alias("v"))
    vectors = rel.latest(vectors, ["doc_id"], "version").select("doc_id", "v")
    fused = mt.fused(by_words, mt.vector_ranks(vectors, vectors.where("doc_id = 0").select(F.col("v").alias("q"))))
    events, m = section_events(spark, sf_dir), mentions(spark, sf_dir)
    standing = status.standing(status.history(events.where("verified")))
    own = lambda df: df.select("provision_id").distinct().select(F.col("provision_id").alias("chain"), "provision_id")
    rulings = events.select("judgment_id").distinct().withColumn("duplicate_of", F.when(F.col("judgment_id") % 13 == 0, F.col("judgment_id") - 1))
    cited = rel.cited_counts(m, judgments(spark, sf_dir), own(m))
    return search.section_hits(fused, latest, standing, cited, rel.lead_counts(events, rulings, own(events)))


QUERIES = {f.__name__: f for f in (stem_search, section_search)}

_FORMS = {
    "licens": "license licenses licensed licensing", "general": "general generals generally", "public": "public publicly", "apach": "apache apaches", "mit": "mit mits",
    "releas": "release releases released releasing", "version": "version versions", "reserv": "reserve reserves reserved reserving",
}
_STEM = "CASE " + " ".join(f"WHEN w IN ({', '.join(repr(f) for f in forms.split())}) THEN '{stem}'" for stem, forms in _FORMS.items()) + " END"
_AWAY = "ln(1 - 0.1 * sqrt(CASE WHEN abs(a.p - b.p) <= 100 THEN 1 / (1.005 + 0.05 * exp(abs(a.p - b.p) / CAST(1.5 AS DOUBLE) - 2)) ELSE 1e-30 END))"


def _terms_sql(docs: str) -> str:
    return f"""w AS (SELECT doc_id, unnest(k) AS w, generate_subscripts(k, 1) AS p FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS k FROM {docs})),
  t AS (SELECT doc_id, {_STEM} AS term, p FROM w WHERE {_STEM} IS NOT NULL),
  h AS (SELECT doc_id, term, list_sum(list_transform(range(1, count(*) + 1), lambda i: 1 / CAST(i * i AS DOUBLE))) AS squares FROM t GROUP BY 1, 2)"""


def _together_sql(*terms: str) -> str:
    some = ", ".join(f"'{t}'" for t in terms)
    return f"(SELECT a.doc_id, 1 - exp(sum({_AWAY})) AS s FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.term < b.term AND a.p <> b.p WHERE a.term IN ({some}) AND b.term IN ({some}) GROUP BY 1)"


def _alone_sql(*terms: str) -> str:
    some = ", ".join(f"'{t}'" for t in terms)
    return f"(SELECT doc_id, sum(squares) * 0.1 / 1.64493406685 / {len(terms)} AS s FROM h WHERE term IN ({some}) GROUP BY 1)"


def _phrase_sql(first: str, then: str, shift: int = 1) -> str:
    return f"(SELECT a.doc_id FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.p = a.p + {shift} WHERE a.term = '{first}' AND b.term = '{then}')"


_EV = EVENTS_SQL.format(text="VARCHAR")
_HAS = "(SELECT doc_id FROM h WHERE term = '{}')"
ORACLE_SQL = {
    "stem_search": f"""WITH {_terms_sql("documents")}, found AS (
        SELECT 0 AS query_id, doc_id, s FROM {_alone_sql("licens")}
        UNION ALL SELECT 1, doc_id, s FROM {_together_sql("general", "public", "licens")} WHERE doc_id IN {_phrase_sql("general", "public")} AND doc_id IN {_HAS.format("licens")}
        UNION ALL SELECT 2, doc_id, s FROM {_alone_sql("apach", "licens", "mit")} WHERE doc_id IN {_phrase_sql("apach", "licens")} OR doc_id IN {_phrase_sql("mit", "licens")}
        UNION ALL SELECT 3, doc_id, 0 FROM h WHERE term = 'licens' AND doc_id NOT IN {_HAS.format("apach")}
        UNION ALL SELECT 4, doc_id, s FROM {_together_sql("releas", "mit")} WHERE doc_id IN {_phrase_sql("releas", "mit", 3)}
        UNION ALL SELECT 6, doc_id, s FROM {_alone_sql("version", "reserv")})
      SELECT CAST(query_id AS INT) AS query_id, doc_id, round(s, 6) AS score FROM found""",
    "section_search": f"""WITH latest AS (SELECT doc_id // 2 AS doc_id, text FROM documents QUALIFY row_number() OVER (PARTITION BY doc_id // 2 ORDER BY doc_id DESC) = 1),
      {_terms_sql("latest")},
      fts AS (SELECT doc_id, row_number() OVER (ORDER BY round(s, 6) DESC, doc_id) AS r FROM {_alone_sql("licens", "general", "public")}
        WHERE doc_id IN {_HAS.format("licens")} OR doc_id IN {_phrase_sql("general", "public")} QUALIFY r <= 50),
      ve AS (SELECT vec_id // 2 AS doc_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings QUALIFY row_number() OVER (PARTITION BY vec_id // 2 ORDER BY vec_id DESC) = 1),
      sem AS (SELECT doc_id, row_number() OVER (ORDER BY s DESC, doc_id) AS r FROM (SELECT a.doc_id, round(list_cosine_similarity(a.v, q.v), 6) AS s FROM ve a, (SELECT v FROM ve WHERE doc_id = 0) q) QUALIFY r <= 50),
      top AS (SELECT doc_id AS provision_id, round(sum(CAST(1 AS DOUBLE) / (60 + r)), 9) AS score FROM (SELECT * FROM fts UNION ALL SELECT * FROM sem) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20),
      {_history_sql("(SELECT * FROM ev WHERE verified AND provision_id IN (SELECT provision_id FROM top))")} {_STANDING_SQL},
      {JUDGMENTS_SQL},
      cited AS (SELECT provision_id, count(DISTINCT coalesce(duplicate_of, judgment_id)) AS n FROM m JOIN j USING (judgment_id) GROUP BY 1),
      leads AS (SELECT provision_id, count(*) AS n FROM (SELECT DISTINCT provision_id, judgment_id, event_type FROM ev e WHERE NOT verified AND check_verdict IS DISTINCT FROM 'fail' AND judgment_id % 13 <> 0
        AND NOT EXISTS (SELECT 1 FROM ev v WHERE v.provision_id = e.provision_id AND v.verified AND v.judgment_id IS NOT DISTINCT FROM e.judgment_id AND v.event_type = e.event_type)) GROUP BY 1)
      SELECT top.provision_id, score, left(latest.text, 240) AS snippet, coalesce({_LABEL_SQL}, 'in force; no recorded court rulings') AS status, coalesce(cited.n, 0) AS cited_by, coalesce(leads.n, 0) AS lead_count
      FROM top JOIN latest ON latest.doc_id = top.provision_id LEFT JOIN facts ON facts.provision_id = top.provision_id LEFT JOIN cited ON cited.provision_id = top.provision_id LEFT JOIN leads ON leads.provision_id = top.provision_id""",
}
