"""Record linkage and search: names by rare words, quotes by word runs, copies by shingles, ranks by fusion."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stareflow.operators.staging import shuffled, staged

#: Words of a run by which texts are compared, and the overlap from which a text is a copy.
RUN, COPY = 5, 0.7
#: Ratio from which a quote is close.
CLOSE = 0.85
# Thresholds of the name match.
FOUND, MARGIN, POSSIBLE = 0.6, 0.3, 0.3
LEAST_SHARED, LEAST_CITED, LONE_WORD = 2.0, 0.5, 6.0
#: Titles that a possible match names at most.
RANKED = 3
#: Rank constant of reciprocal rank fusion, and rows that each ranking gives.
FUSION, DEPTH = 60, 50


def words(text: Column) -> Column:
    """Lower-cased words of a text; words end at white space."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[^ \t\n\r\f\x0b]+"), F.lit(0))


def runs(word_array: Column, k: int = RUN) -> Column:
    """The hashes of all runs of k words, in order; none if there are fewer words."""
    n = F.size(word_array)
    hashed = F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.xxhash64(F.slice(word_array, i, k)))
    return F.when(n >= k, hashed).otherwise(F.array().cast("array<bigint>"))


def copies(docs: DataFrame, block: list[str], key: str, text: str, least: float = COPY) -> DataFrame:
    """(key, canonical, overlap) of documents whose runs overlap enough with their block's canonical one:
    of most words, then of the greatest key."""
    sized = docs.select(*block, key, words(F.col(text)).alias("_w")).withColumn("_n", F.size("_w"))
    top = sized.groupBy(*block).agg(F.max(F.struct("_n", key)).alias("_top"), F.count("*").alias("_c")).where("_c > 1")
    pairs = sized.join(top.select(*block, F.col(f"_top.{key}").alias("canonical")), block).select(*block, key, "canonical", F.array_distinct(runs(F.col("_w"))).alias("_r"))
    first = pairs.where(F.col(key) == F.col("canonical")).select(F.col(key).alias("canonical"), F.col("_r").alias("_o"))
    both = pairs.where(F.col(key) != F.col("canonical")).join(first, "canonical")
    share = F.size(F.array_intersect("_r", "_o")) / F.greatest(F.lit(1), F.least(F.size("_r"), F.size("_o")))
    return both.select(key, "canonical", share.alias("overlap")).where(F.col("overlap") >= least)


def word_weights(titles: DataFrame, key: str, word_array: Column) -> DataFrame:
    """(word, idf): the log of all titles over those that hold the word."""
    n = titles.agg(F.count("*").alias("_n"))
    df = titles.select(key, F.explode(F.array_distinct(word_array)).alias("word")).groupBy("word").agg(F.count("*").alias("_df"))
    return df.crossJoin(F.broadcast(n)).select("word", F.ln(F.col("_n") / F.col("_df")).alias("idf"))


def name_match(cited: DataFrame, titles: DataFrame) -> DataFrame:
    """(cite_id, result, basis, ids) for cited(cite_id, year, words, number) among titles(title_id, year,
    words, number): found, possible_match or not_in_collection.

    Candidates share the year and a word; scores are sums of shared word weights over the side that
    is covered better. Cited words that no title has do not count.

    Equal names of a year score alike, so different names are compared, not rows. No more than RANKED ids come out for a
    citation, so as many least ids stand for all titles of a year, name and number.
    """
    name = F.array_sort(F.array_distinct("words")).alias("name")
    t = titles.select("title_id", "year", name, "number")
    c = cited.select("cite_id", "year", name, "number")
    least = lambda df, *by: df.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy("title_id"))).where(F.col("_i") <= RANKED).drop("_i")
    weight = word_weights(t, "title_id", F.col("name"))
    t, kinds = staged(least(t, "year", "name", "number")), staged(c.select("year", "name", "number").distinct())
    t_words = t.select("year", F.col("name").alias("title")).distinct().select("year", "title", F.explode("title").alias("word")).join(weight, "word")
    c_words = kinds.select("year", "name").distinct().select("year", "name", F.explode("name").alias("word")).join(weight, "word")
    t_all = t_words.groupBy("year", "title").agg(F.sum("idf").alias("t_all"))
    c_all = c_words.groupBy("year", "name").agg(F.sum("idf").alias("c_all"))
    hit = c_words.join(t_words.drop("idf"), ["year", "word"]).groupBy("year", "name", "title").agg(F.sum("idf").alias("shared"), F.count("*").alias("n"))
    hit = hit.where(F.col("shared") >= LEAST_SHARED).join(shuffled(t_all), ["year", "title"]).join(shuffled(c_all), ["year", "name"])
    named = F.when(F.col("shared") / F.col("c_all") >= LEAST_CITED, F.col("shared") / F.least("c_all", "t_all")).otherwise(F.lit(0.0))
    hit = staged(hit.select("year", "name", "title", named.alias("score"), ((F.col("n") > 1) | (F.col("shared") >= LONE_WORD)).alias("strong")))
    titled = t.withColumnRenamed("name", "title")
    order = [F.desc("score"), "title_id"]
    by_name = hit.where("score > 0").join(shuffled(least(titled, "year", "title").drop("number")), ["year", "title"])
    by_name = by_name.withColumn("r", F.row_number().over(Window.partitionBy("year", "name").orderBy(*order))).where(F.col("r") <= RANKED)
    by_name = kinds.join(shuffled(by_name), ["year", "name"]).select("year", "name", "number", "title_id", "score", "strong", F.lit(False).alias("by_number"))
    # A number counts if the names overlap, or if none of the cited words is known.
    number = kinds.where("number IS NOT NULL").join(shuffled(titled.where("number IS NOT NULL")), ["year", "number"])
    number = number.join(shuffled(hit.select("year", "name", "title", F.lit(True).alias("_hit"))), ["year", "name", "title"], "left")
    number = number.join(shuffled(c_all.select("year", "name", F.lit(True).alias("_known"))), ["year", "name"], "left").where("_hit OR _known IS NULL")
    number = number.select("year", "name", "number", "title_id", F.lit(1.0).alias("score"), F.lit(True).alias("strong"), F.lit(True).alias("by_number"))
    kind = ["year", "name", "number"]
    both = by_name.unionByName(number).groupBy(*kind, "title_id").agg(F.bool_or("by_number").alias("by_number"), F.max("score").alias("score"), F.bool_or("strong").alias("strong"))
    both = both.withColumn("score", F.when(F.col("by_number"), 1.0).otherwise(F.col("score")))
    ranked = both.withColumn("r", F.row_number().over(Window.partitionBy(*kind).orderBy(*order)))
    best = ranked.groupBy(*kind).agg(
        F.count_if("by_number").alias("n_numbered"),
        F.min(F.when(F.col("by_number"), F.col("title_id"))).alias("numbered"),
        F.max(F.when(F.col("r") == 1, F.struct("title_id", "score", "strong", "by_number"))).alias("one"),
        F.max(F.when(F.col("r") == 2, F.col("score"))).alias("second"),
        F.sort_array(F.collect_list(F.when((F.col("r") <= RANKED) & (F.col("score") >= POSSIBLE), F.struct("r", "title_id")))).alias("top"),
    )
    best = best.select(*(F.col(k).alias(f"_{k}") for k in kind), "n_numbered", "numbered", "one", "second", "top")
    out = c.join(shuffled(best), (F.col("year") == F.col("_year")) & F.col("name").eqNullSafe(F.col("_name")) & F.col("number").eqNullSafe(F.col("_number")), "left")
    lead = F.col("one.score") - F.coalesce("second", F.lit(0.0))
    sure = F.col("one.strong") & (F.col("one.score") >= FOUND) & (lead >= MARGIN)
    ids = F.transform("top", lambda x: x["title_id"])
    return out.select(
        "cite_id",
        F.when(F.col("n_numbered") == 1, "found").when(sure, "found").when(F.size("top") > 0, "possible_match").otherwise("not_in_collection").alias("result"),
        F.when(F.col("n_numbered") == 1, "case number").when(sure & F.col("one.by_number"), "case number").when(sure, "party names and year").alias("basis"),
        F.when(F.col("n_numbered") == 1, F.array("numbered")).when(sure, F.array("one.title_id")).otherwise(F.coalesce(ids, F.array().cast("array<bigint>"))).alias("ids"),
    )


def quotes_in(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, doc_id) of quotes(item_id, text) whose words stand in docs(doc_id, text) one after another. A quote's
    first run, or all of it if it is shorter, finds candidates by an equi-join; their words are compared whole.
    Quotes without words stand nowhere."""
    q = quotes.select("item_id", words(F.col("text")).alias("q")).withColumn("k", F.least(F.size("q"), F.lit(RUN))).where("k > 0")
    q = q.select("item_id", "k", F.xxhash64(F.slice("q", 1, F.col("k"))).alias("run"), F.concat(F.lit(" "), F.array_join("q", " "), F.lit(" ")).alias("said"))
    d = docs.select("doc_id", words(F.col("text")).alias("w"))
    lengths = [r.k for r in q.select("k").distinct().collect()]  # RUN rows at most
    found = None
    for k in lengths or [RUN]:
        some = d.select("doc_id", F.explode(F.array_distinct(runs(F.col("w"), k))).alias("run")).join(q.where(F.col("k") == k).select("item_id", "run"), "run").select("doc_id", "item_id").distinct()
        found = some if found is None else found.unionByName(some)
    whole = d.select("doc_id", F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")).alias("body"))
    return found.join(q.select("item_id", "said"), "item_id").join(whole, "doc_id").where(F.contains("body", "said")).select("item_id", "doc_id")


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two word lists."""
    return pd.Series([round(difflib.SequenceMatcher(None, list(x), list(y), autojunk=False).ratio(), 2) for x, y in zip(a, b, strict=True)])


def quote_match(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, doc_id, result, similarity) for each quote and document that share a run of words: verbatim,
    close, or not_found. The place where most runs line up is compared. A quote that shares none with any document
    is not_found, without a doc_id."""
    q = quotes.select("item_id", words(F.col("text")).alias("q"))
    d = docs.select("doc_id", words(F.col("text")).alias("w"))
    qr = q.select("item_id", F.posexplode(runs(F.col("q"))).alias("k", "run"))
    dr = d.select("doc_id", F.posexplode(runs(F.col("w"))).alias("j", "run"))
    votes = dr.join(qr, "run").groupBy("item_id", "doc_id", (F.col("j") - F.col("k")).alias("at")).count()
    best = votes.groupBy("item_id", "doc_id").agg(F.max_by("at", F.struct("count", -F.col("at"))).alias("at"))
    both = best.join(q, "item_id").join(d, "doc_id")
    passage = F.slice("w", F.greatest(F.col("at"), F.lit(0)) + 1, F.size("q"))
    both = both.withColumn("p", passage).withColumn("similarity", F.when(F.col("p") == F.col("q"), F.lit(1.0)).otherwise(ratio("q", "p")))
    result = F.when(F.col("p") == F.col("q"), "verbatim").when(F.col("similarity") >= CLOSE, "close").otherwise("not_found")
    out = both.select("item_id", "doc_id", result.alias("result"), "similarity")
    nowhere = quotes.select("item_id").distinct().join(votes.select("item_id").distinct(), "item_id", "left_anti")
    return out.unionByName(nowhere.select("item_id", F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.lit("not_found").alias("result"), F.lit(None).cast("double").alias("similarity")))


def word_ranks(docs: DataFrame, terms: list[str], depth: int = DEPTH) -> DataFrame:
    """(doc_id, rank) of the documents that score best: for each term, tf / (tf + 1) times ln(1 + N / df)."""
    w = words(F.col("text"))
    counted = docs.select("doc_id", *((F.size(w) - F.size(F.array_remove(w, t))).cast("double").alias(f"tf{i}") for i, t in enumerate(terms)))
    facts = counted.agg(F.count("*").alias("n"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
    score = sum((F.col(f"tf{i}") / (F.col(f"tf{i}") + 1) * F.ln(1 + F.col("n") / F.greatest(F.col(f"df{i}"), F.lit(1))) for i in range(len(terms))), F.lit(0.0))
    return _ranked(counted.crossJoin(F.broadcast(facts)).select("doc_id", F.round(score, 6).alias("s")).where("s > 0"), depth)


def vector_ranks(vectors: DataFrame, query: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(doc_id, rank) of the vectors of highest cosine with the one row of query(q)."""
    a, b = F.transform("v", lambda x: x.cast("double")), F.transform("q", lambda x: x.cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, r: p * r), F.lit(0.0), lambda s, p: s + p)
    cosine = dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
    return _ranked(vectors.crossJoin(F.broadcast(query)).select("doc_id", F.round(cosine, 6).alias("s")), depth)


def _ranked(scored: DataFrame, depth: int) -> DataFrame:
    top = scored.orderBy(F.desc("s"), "doc_id").limit(depth)  # then the window sees depth rows only
    return top.select("doc_id", F.row_number().over(Window.orderBy(F.desc("s"), "doc_id")).alias("rank"))


def fused(*ranks: DataFrame) -> DataFrame:
    """(doc_id, score): reciprocal rank fusion of rankings."""
    every = ranks[0]
    for r in ranks[1:]:
        every = every.unionByName(r)
    return every.groupBy("doc_id").agg(F.sum(F.lit(1.0) / (F.lit(FUSION) + F.col("rank"))).alias("score"))


def titles_with(titles: DataFrame, asked: list[str], depth: int = 5) -> DataFrame:
    """Titles that hold every asked word, or if none does and three or more are asked, all but one: the first
    depth by words held, then key. titles: (title_id, words)."""
    hits = sum((F.array_contains("words", w).cast("int") for w in asked), F.lit(0))
    least = len(asked) - 1 if len(asked) >= 3 else len(asked)
    some = titles.select("title_id", hits.alias("hits")).where(F.col("hits") >= least)
    most = some.agg(F.max("hits").alias("most"))
    keep = (F.col("most") < len(asked)) | (F.col("hits") == len(asked))
    return some.crossJoin(F.broadcast(most)).where(keep).select("title_id", "hits").orderBy(F.desc("hits"), "title_id").limit(depth)
