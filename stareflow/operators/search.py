"""Word search on stems: a positional index as a table, a query grammar as joins on it, ranks by distance.

The index has a row for each term and document, with the places where the term stands. It is made from a
document alone, without a shuffle, and can be kept as a table sorted by term: a search then reads the
few row groups that hold its terms. Queries are rows of a table: their terms, a few for each query, are
broadcast to the index, and what they meet is grouped by query and document.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stareflow.functions.stems import terms, text_terms
from stareflow.operators.staging import staged

# The weight of a word in a text, the sum of 1/n^2, how the distance of two words counts, and how far.
WEIGHT, SQUARES = 0.1, 1.64493406685
NEAR, FAR_OFF, STEEP, SHIFT, REACH, BEYOND = 1.005, 0.05, 1.5, 2.0, 100, 1e-30
#: Rows of query terms that may be broadcast: some 100 bytes each.
TERMS_BROADCAST = 200_000


def inverted(docs: DataFrame) -> DataFrame:
    """(doc_id, term, places) of docs(doc_id, text): a row for each different term of a document."""
    return docs.select("doc_id", F.explode(text_terms("text")).alias("t")).select("doc_id", "t.term", "t.places")


def write_index(docs: DataFrame, path: str) -> None:
    """The index as a table in order of term: a common term spans several files, none is in one task."""
    index = inverted(docs)
    index.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(path)


def parsed(query: str | None) -> list[dict]:
    """The clauses of a query as rows of terms: words all count, "or" parts alternatives, quotes make phrases, a minus
    before a word or phrase excludes it. Stop words are left out, but keep their places inside a phrase."""
    rows, group, clause, pending = [], 0, 0, False
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"?|([^\s"]+))', query or ""):
        if word.lower() == "or" and not minus:
            pending = bool(rows)
            continue
        found = terms(phrase or word)
        if not found:
            continue
        if pending:
            group, pending = group + 1, False
        first = found[0][1]
        rows += [{"grp": group, "clause": clause, "negated": bool(minus), "n": len(found), "term": t, "shift": p - first} for t, p in found]
        clause += 1
    return rows


_CLAUSE = T.StructType([T.StructField("grp", T.IntegerType()), T.StructField("clause", T.IntegerType()), T.StructField("negated", T.BooleanType()), T.StructField("n", T.IntegerType()), T.StructField("term", T.StringType()), T.StructField("shift", T.IntegerType())])
_ARROW = pa.list_(pa.struct([("grp", pa.int32()), ("clause", pa.int32()), ("negated", pa.bool_()), ("n", pa.int32()), ("term", pa.string()), ("shift", pa.int32())]))


@F.arrow_udf(T.ArrayType(_CLAUSE))
def query_clauses(query: pa.Array) -> pa.Array:
    return pa.array([parsed(q) for q in query.to_pylist()], _ARROW)


def _squares(n: Column) -> Column:
    """1 + 1/4 + ... + 1/n^2."""
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda s, i: s + F.lit(1.0) / (i * i))


def _away(distance: Column) -> Column:
    """How little two words at a distance count together: the log of 1 less their weight."""
    near = F.lit(1.0) / (NEAR + FAR_OFF * F.exp(distance / STEEP - SHIFT))
    return F.log1p(-WEIGHT * F.sqrt(F.when(distance <= REACH, near).otherwise(F.lit(BEYOND))))


def _together(held: Column) -> Column:
    """The weight of terms by the distances of all places of each two of them."""
    far = F.aggregate(
        held,
        F.lit(0.0),
        lambda s, x: s + F.aggregate(F.filter(held, lambda y: y["term"] < x["term"]), F.lit(0.0), lambda t, y: t + F.aggregate(x["places"], F.lit(0.0), lambda u, p: u + F.aggregate(y["places"], F.lit(0.0), lambda v, q: v + F.when(p == q, 0.0).otherwise(_away(F.abs(p - q)))))),
    )
    return F.lit(1.0) - F.exp(far)


def matches(index: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) for queries(query_id, query) on an index(doc_id, term, places).

    A document matches if it fits one alternative: every word and phrase of it, and none that it
    excludes. An alternative that only excludes finds nothing. Scores follow the distances of the
    words if there is one alternative of two or more terms, else how often each term stands there.
    """
    clauses = staged(queries.select("query_id", F.explode(query_clauses("query")).alias("c")).select("query_id", "c.*"))
    few = clauses.count() <= TERMS_BROADCAST
    asked = F.broadcast(clauses) if few else clauses
    hits = index.join(asked, "term").select("query_id", "doc_id", "grp", "clause", "negated", "n", "term", "shift", "places")
    hits = staged(hits)
    at = F.explode(F.transform("places", lambda p: p - F.col("shift"))).alias("at")
    phrases = hits.where("n > 1").select("query_id", "doc_id", "grp", "clause", "negated", "n", "shift", at)
    phrases = phrases.groupBy("query_id", "doc_id", "grp", "clause", "negated", "n", "at").agg(F.count("*").alias("held")).where("held = n")
    keys = ("query_id", "doc_id", "grp", "clause", "negated")
    fit = hits.where("n = 1").select(*keys).unionByName(phrases.select(*keys).distinct())
    facts = clauses.groupBy("query_id", "grp").agg(F.count_distinct(F.when(~F.col("negated"), F.col("clause"))).alias("wanted"))
    own = fit.groupBy("query_id", "doc_id", "grp").agg(F.count_if(~F.col("negated")).alias("held"), F.bool_or("negated").alias("excluded"))
    found = own.join(F.broadcast(facts) if few else facts, ["query_id", "grp"]).where("held = wanted AND wanted > 0 AND NOT excluded").select("query_id", "doc_id").distinct()
    shape = clauses.groupBy("query_id").agg((F.max("grp") + 1).alias("groups"), F.count_distinct("term").alias("size"))
    terms_held = hits.groupBy("query_id", "doc_id").agg(F.collect_set(F.struct("term", "places")).alias("held"))  # a query's terms at most
    scored = found.join(terms_held, ["query_id", "doc_id"]).join(F.broadcast(shape) if few else shape, "query_id")
    alone = F.aggregate("held", F.lit(0.0), lambda s, x: s + _squares(F.size(x["places"]))) * WEIGHT / SQUARES / F.col("size")
    close = (F.col("groups") == 1) & (F.col("size") > 1)
    return scored.select("query_id", "doc_id", F.when(close & (F.size("held") > 1), _together(F.col("held"))).when(close, 1e-20).otherwise(alone).alias("score"))


def ranked(found: DataFrame, depth: int) -> DataFrame:
    """(query_id, doc_id, rank) of the depth best of each query, scores taken to six places, ties by id."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "doc_id")
    return found.select("query_id", "doc_id", F.row_number().over(order).alias("rank")).where(F.col("rank") <= depth)


def section_hits(fused: DataFrame, latest: DataFrame, standing: DataFrame, cited: DataFrame, leads: DataFrame, most: int = 20) -> DataFrame:
    """The most best sections of fused(doc_id, score), with the first 240 characters of their latest
    text(provision_id, text), status(provision_id, status), and counts(chain, cited_by / lead_count) of
    sections that are chains of their own."""
    top = fused.select(F.col("doc_id").alias("provision_id"), F.round("score", 9).alias("score")).orderBy(F.desc("score"), "provision_id").limit(most)
    out = top.join(latest.select("provision_id", F.left("text", F.lit(240)).alias("snippet")), "provision_id")
    out = out.join(standing.select("provision_id", "status"), "provision_id", "left")
    out = out.join(cited.withColumnRenamed("chain", "provision_id"), "provision_id", "left").join(leads.withColumnRenamed("chain", "provision_id"), "provision_id", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("cited_by", "lead_count")]
    return out.select("provision_id", "score", "snippet", F.coalesce("status", F.lit("in force; no recorded court rulings")).alias("status"), *zero)
