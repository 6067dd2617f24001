"""Queries on search, names, quotes and copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stareflow.operators import matching as mt
from stareflow.plans.tables import read

TERMS = ["license", "work", "public"]
_WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[^ \\t\\n\\r\\f\\x0b]+')"


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))
    return v, v.where("doc_id = 0").select(F.col("v").alias("q"))


def search_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best of word and vector search together."""
    vectors, query = _vectors(spark, sf_dir)
    ranks = mt.word_ranks(read(spark, sf_dir, "documents"), TERMS), mt.vector_ranks(vectors, query)
    return mt.fused(*ranks).select("doc_id", F.round("score", 9).alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)


def word_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word search alone, as when there is no query vector."""
    return mt.word_ranks(read(spark, sf_dir, "documents"), TERMS)


def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector search alone."""
    return mt.vector_ranks(*_vectors(spark, sf_dir))


def near_dupes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of the longest text among those that begin with the same five words, as records of one case do."""
    docs = read(spark, sf_dir, "documents").withColumn("begins", F.array_join(F.slice(mt.words(F.col("text")), 1, 5), " "))
    return mt.copies(docs, ["begins"], "doc_id", "text").select("doc_id", "canonical", F.round("overlap", 6).alias("overlap"))


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    number = F.when(F.col("p_partkey") % 10 == 0, F.concat((F.col("p_partkey") % 300).cast("string"), F.lit(" of "), (F.col("p_size") + 1990).cast("string")))
    return part.select(F.col("p_partkey").alias("title_id"), F.col("p_size").alias("year"), mt.words(F.col("p_name")).alias("words"), number.alias("number"))


def idf_name_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited names, some with a case number, linked to titles of their year."""
    titles = _titles(spark, sf_dir)
    cited = titles.select(
        F.col("title_id").alias("cite_id"), "year", F.when(F.col("title_id") % 3 == 0, F.slice("words", 1, 1)).otherwise(F.concat("words", F.array(F.lit("zzz")))).alias("words"), "number"
    )
    return mt.name_match(cited, titles).select("cite_id", "result", "basis", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


def title_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles by words, one of which no title has."""
    titles = _titles(spark, sf_dir).select("title_id", "words")
    return mt.titles_with(titles, ["small", "ring", "nosuchword"])


def quote_verbatim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages that stand in documents word by word."""
    return mt.quotes_in(read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "documents"))


def quote_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages with every ninth word left out, compared with the documents that share a run with them."""
    gone = F.filter(mt.words(F.col("text")), lambda w, i: i % 9 != 8)
    quotes = read(spark, sf_dir, "benchmark").select("item_id", F.array_join(gone, " ").alias("text"))
    return mt.quote_match(quotes, read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (search_rrf, word_search, vector_search, near_dupes, idf_name_match, title_search, quote_verbatim, quote_close)}

_FTS = f"""d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
  tf AS (SELECT doc_id, {', '.join(f"CAST(len(list_filter(w, lambda x: x = '{t}')) AS DOUBLE) AS tf{i}" for i, t in enumerate(TERMS))} FROM d),
  facts AS (SELECT count(*) AS n, {', '.join(f'count(*) FILTER (WHERE tf{i} > 0) AS df{i}' for i in range(len(TERMS)))} FROM tf),
  fs AS (SELECT doc_id, round({' + '.join(f'tf{i} / (tf{i} + 1) * ln(1 + CAST(n AS DOUBLE) / greatest(df{i}, 1))' for i in range(len(TERMS)))}, 6) AS s FROM tf, facts),
  fts AS (SELECT doc_id, CAST(row_number() OVER (ORDER BY s DESC, doc_id) AS INT) AS rank FROM fs WHERE s > 0 QUALIFY rank <= 50)"""
_SEM = """vs AS (SELECT e.vec_id AS doc_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS s
    FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q),
  sem AS (SELECT doc_id, CAST(row_number() OVER (ORDER BY s DESC, doc_id) AS INT) AS rank FROM vs QUALIFY rank <= 50)"""
_TITLES = """titles AS (SELECT p_partkey AS title_id, p_size AS year, string_split(lower(p_name), ' ') AS words,
    CASE WHEN p_partkey % 10 = 0 THEN (p_partkey % 300) || ' of ' || (p_size + 1990) END AS number FROM part)"""

ORACLE_SQL = {
    "search_rrf": f"""WITH {_FTS}, {_SEM} SELECT doc_id, round(sum(CAST(1 AS DOUBLE) / (60 + rank)), 9) AS score
        FROM (SELECT * FROM fts UNION ALL SELECT * FROM sem) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""",
    "word_search": f"WITH {_FTS} SELECT * FROM fts",
    "vector_search": f"WITH {_SEM} SELECT * FROM sem",
    "near_dupes": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        r AS (SELECT doc_id, array_to_string(w[1:5], ' ') AS begins, len(w) AS n, list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS r FROM d),
        k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY begins ORDER BY n DESC, doc_id DESC) AS canonical FROM r)
        SELECT doc_id, canonical, overlap FROM (SELECT a.doc_id, a.canonical, round(CAST(len(list_intersect(a.r, b.r)) AS DOUBLE) / greatest(1, least(len(a.r), len(b.r))), 6) AS overlap,
          CAST(len(list_intersect(a.r, b.r)) AS DOUBLE) / greatest(1, least(len(a.r), len(b.r))) AS exact
        FROM k a JOIN k b ON a.canonical = b.doc_id WHERE a.doc_id <> a.canonical) WHERE exact >= 0.7""",
    "idf_name_match": f"""WITH {_TITLES},
        cited AS (SELECT title_id AS cite_id, year, CASE WHEN title_id % 3 = 0 THEN words[1:1] ELSE list_append(words, 'zzz') END AS words, number FROM titles),
        tw AS (SELECT DISTINCT title_id, year, unnest(words) AS word FROM titles),
        idf AS (SELECT word, ln(CAST((SELECT count(*) FROM titles) AS DOUBLE) / count(*)) AS idf FROM tw GROUP BY 1),
        cw AS (SELECT DISTINCT cite_id, year, unnest(words) AS word FROM cited),
        ta AS (SELECT title_id, sum(idf) AS t_all FROM tw JOIN idf USING (word) GROUP BY 1),
        ca AS (SELECT cite_id, sum(idf) AS c_all FROM cw JOIN idf USING (word) GROUP BY 1),
        h AS (SELECT cite_id, title_id, sum(idf) AS shared, count(*) AS n FROM cw JOIN tw USING (year, word) JOIN idf USING (word) GROUP BY 1, 2),
        s AS (SELECT c.cite_id, t.title_id, coalesce(h.shared >= 2.0, false) AS hit, ca.c_all IS NULL AS unknown,
            CASE WHEN h.shared >= 2.0 AND h.shared / ca.c_all >= 0.5 THEN h.shared / least(ca.c_all, ta.t_all) ELSE 0 END AS by_name,
            coalesce(h.shared >= 2.0 AND (h.n > 1 OR h.shared >= 6.0), false) AS strong, coalesce(c.number = t.number, false) AS same
          FROM cited c JOIN titles t USING (year) LEFT JOIN h ON h.cite_id = c.cite_id AND h.title_id = t.title_id LEFT JOIN ca ON ca.cite_id = c.cite_id LEFT JOIN ta ON ta.title_id = t.title_id),
        b AS (SELECT cite_id, title_id, same AND (hit OR unknown) AS by_number, CASE WHEN same AND (hit OR unknown) THEN 1.0 ELSE by_name END AS score, strong FROM s),
        k AS (SELECT *, row_number() OVER (PARTITION BY cite_id ORDER BY score DESC, title_id) AS r, count(*) FILTER (WHERE by_number) OVER (PARTITION BY cite_id) AS nn,
          min(title_id) FILTER (WHERE by_number) OVER (PARTITION BY cite_id) AS nid FROM b WHERE by_number OR score > 0),
        g AS (SELECT cite_id, any_value(nn) AS nn, any_value(nid) AS nid, max(title_id) FILTER (WHERE r = 1) AS one, max(score) FILTER (WHERE r = 1) AS s1, bool_or(r = 1 AND (strong OR by_number)) AS st,
          bool_or(r = 1 AND by_number) AS bn, coalesce(max(score) FILTER (WHERE r = 2), 0) AS s2, string_agg(CAST(title_id AS VARCHAR), ',' ORDER BY r) FILTER (WHERE r <= 3 AND score >= 0.3) AS top FROM k GROUP BY 1)
        SELECT cite_id, CASE WHEN nn = 1 THEN 'found' WHEN st AND s1 >= 0.6 AND s1 - s2 >= 0.3 THEN 'found' WHEN top IS NOT NULL THEN 'possible_match' ELSE 'not_in_collection' END AS result,
          CASE WHEN nn = 1 THEN 'case number' WHEN st AND s1 >= 0.6 AND s1 - s2 >= 0.3 THEN CASE WHEN bn THEN 'case number' ELSE 'party names and year' END END AS basis,
          CASE WHEN nn = 1 THEN CAST(nid AS VARCHAR) WHEN st AND s1 >= 0.6 AND s1 - s2 >= 0.3 THEN CAST(one AS VARCHAR) ELSE coalesce(top, '') END AS ids
        FROM cited LEFT JOIN g USING (cite_id)""",
    "title_search": f"""WITH {_TITLES}, h AS (SELECT title_id, CAST(len(list_filter(['small', 'ring', 'nosuchword'], lambda w: list_contains(words, w))) AS INT) AS hits FROM titles)
        SELECT * FROM h WHERE hits >= 2 AND (hits = 3 OR (SELECT max(hits) FROM h) < 3) ORDER BY hits DESC, title_id LIMIT 5""",
    "quote_verbatim": f"""WITH q AS (SELECT item_id, ' ' || array_to_string({_WORDS}, ' ') || ' ' AS said, len({_WORDS}) AS n FROM benchmark),
        d AS (SELECT doc_id, ' ' || array_to_string({_WORDS}, ' ') || ' ' AS body FROM documents)
        SELECT item_id, doc_id FROM q JOIN d ON contains(body, said) WHERE n >= 1""",
}
