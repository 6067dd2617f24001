"""Inputs with declared schemas: parsed documents as JSON, answer keys as CSV, capture indexes, saved pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stareflow.functions import text as tx

#: A parsed document: an act's sections or a judgment's text, with what its page says of it.
DOCUMENT = """work string, url string, title string, expression_date date, metadata map<string, string>, text string, ocr_pages array<int>,
sections array<struct<eid: string, heading: string, text: string>>, display_type string, source_url string, versions array<string>,
remarks array<struct<eid: string, text: string>>, akn_links array<string>"""
ANSWER_KEY = "event_key string, judgment_id string, provision_id string, event_type string, scope string, scope_text string, quote string, affects_event string"


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Parsed documents, one JSON file each. No schema inference: nothing is read before the job."""
    return spark.read.schema(DOCUMENT).json(path, multiLine=True)


def answer_key(spark: SparkSession, path: str, schema: str = ANSWER_KEY) -> DataFrame:
    """A labelled answer key; quoted cells may hold line breaks and doubled quotes."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"')


def captures(lines: DataFrame) -> DataFrame:
    """(original, timestamp, mimetype, status) of capture index lines(value), each original and time once."""
    cell = F.split("value", r"\s+")
    rows = lines.where(F.size(cell) >= 4).select(tx.origin(F.get(cell, F.lit(1))).alias("original"), F.get(cell, F.lit(0)).alias("timestamp"), F.get(cell, F.lit(2)).alias("mimetype"), F.get(cell, F.lit(3)).alias("status"))
    rows = rows.withColumn("original", F.regexp_replace(F.regexp_replace("original", "^http:", "https:"), r":(80|443)(?=/|$)", ""))
    return rows.groupBy("original", "timestamp").agg(F.min(F.struct("mimetype", "status")).alias("x")).select("original", "timestamp", "x.mimetype", "x.status")


def best_capture(found: DataFrame, kinds: list[str]) -> DataFrame:
    """For each original the capture of the first kind that it has, the newest of these; other kinds don't count."""
    kind = F.array_position(F.array(*map(F.lit, kinds)), F.col("mimetype"))
    pick = Window.partitionBy("original").orderBy("_k", F.desc("timestamp"))
    return found.withColumn("_k", kind).where("_k > 0").withColumn("_r", F.row_number().over(pick)).where("_r = 1").drop("_k", "_r")


def judgment_records(docs: DataFrame) -> DataFrame:
    """Judgments' records of documents(): id, citation, title, court, date, judges, text without page footers."""
    said = lambda k: F.try_element_at("metadata", F.lit(k))
    return docs.select(
        F.regexp_replace("work", "^/akn/", "").alias("judgment_id"),
        F.coalesce(F.nullif(said("Media Neutral Citation"), F.lit("")), said("Citation")).alias("citation"),
        "title",
        said("Court").alias("court"),
        tx.judgment_date(said("Judgment date"), F.col("expression_date")).alias("decision_date"),
        tx.listed(said("Judges")).alias("judges"),
        tx.without_footers(F.col("text")).alias("text"),
        (F.size(F.coalesce("ocr_pages", F.array().cast("array<int>"))) > 0).alias("has_ocr"),
    )


def frontier(found: DataFrame) -> DataFrame:
    """The crawl frontier of found(url, kind, depth, source): each URL once, as first found: least depth, then kind."""
    return found.groupBy("url").agg(F.min(F.struct("depth", "kind", "source")).alias("x")).select("url", "x.*")


def next_pending(rows: DataFrame, now: Column, shard: int = 0, shards: int = 1, most: int = 1) -> DataFrame:
    """What to fetch next of rows(id, url, depth, not_before, status): pending, due and of this shard, least depth first."""
    due = (F.col("status") == "pending") & (F.coalesce("not_before", now) <= now) & (F.pmod("id", F.lit(shards)) == shard)
    return rows.where(due).orderBy("depth", "id").limit(most)
