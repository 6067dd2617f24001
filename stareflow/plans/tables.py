"""Stand-in tables: the engine's tables made from the driver's, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rulings on sections: the event log, a section for each user modulo 5003.
EVENTS_SQL = """
ev0 AS (
  SELECT event_id, user_id % 5003 AS provision_id, user_id AS judgment_id, value, props,
    CASE WHEN event_type = 'error' AND event_id % 97 = 0 THEN 'repealed_by_statute'
      WHEN event_type = 'purchase' AND event_id % 7 = 0 THEN 'amended_by_statute'
      WHEN event_type = 'error' THEN 'declared_unconstitutional' WHEN event_type = 'purchase' THEN 'read_down'
      WHEN event_type = 'view' THEN 'upheld' WHEN event_type = 'click' THEN 'interpreted'
      ELSE 'reversed_on_appeal' END AS event_type,
    CASE WHEN value > 400 THEN 'total' ELSE 'partial' END AS scope,
    CAST(event_id % 3 + 1 AS INT) AS rank, CAST(ts AS DATE) AS effective_date,
    CASE WHEN event_id % 4 <> 0 THEN CAST(event_id % 4 AS {text}) END AS issue,
    CASE WHEN event_type = 'click' AND event_id % 5 = 1 THEN 'limits'
      WHEN event_type = 'click' AND event_id % 5 = 2 THEN 'validates' END AS stance,
    event_id % 3 <> 0 AS verified,
    CASE event_id % 11 WHEN 0 THEN 'fail' WHEN 1 THEN 'pass' END AS check_verdict,
    CASE WHEN event_id % 6 = 0 THEN 'manual' ELSE 'extracted' END AS method
  FROM events
), ev AS (
  SELECT *, CASE WHEN event_type = 'reversed_on_appeal'
    THEN lag(event_id) OVER (PARTITION BY provision_id ORDER BY effective_date, event_id) END AS affects_event_id
  FROM ev0
)"""


def section_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log of sections, as EVENTS_SQL has it."""
    return spark.sql(f"WITH {EVENTS_SQL.format(text='STRING').replace('FROM events', 'FROM {events}')} SELECT * FROM ev", events=read(spark, sf_dir, "events"))


#: Mentions of provisions in judgments: a line item cites a part in an order.
def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("provision_id"),
        F.col("l_orderkey").alias("judgment_id"),
        F.col("l_linenumber").alias("char_start"),
        F.concat_ws(" ", F.lit("section"), F.col("l_linenumber"), F.col("l_returnflag")).alias("raw_text"),
        F.when(F.col("l_linestatus") == "O", F.col("l_linenumber").cast("string")).alias("paragraph"),
    )


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as judgments; every 29th is a second copy of the one before it."""
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("judgment_id"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("court"),
        F.when(F.col("o_orderkey") % 17 != 0, F.col("o_orderdate").cast("date")).alias("decision_date"),
        F.col("o_custkey").alias("party"),
        F.when(F.col("o_orderkey") % 29 == 0, F.col("o_orderkey") - 1).alias("duplicate_of"),
    )


JUDGMENTS_SQL = """
j AS (SELECT o_orderkey AS judgment_id, CAST(substr(o_orderpriority, 1, 1) AS INT) AS court,
  CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_orderdate AS DATE) END AS decision_date, o_custkey AS party,
  CASE WHEN o_orderkey % 29 = 0 THEN o_orderkey - 1 END AS duplicate_of FROM orders),
m AS (SELECT l_partkey AS provision_id, l_orderkey AS judgment_id, l_linenumber AS char_start,
  'section ' || l_linenumber || ' ' || l_returnflag AS raw_text,
  CASE WHEN l_linestatus = 'O' THEN CAST(l_linenumber AS VARCHAR) END AS paragraph FROM lineitem)"""


def row_first(partition: list[str], order: list) -> Window:
    return Window.partitionBy(*partition).orderBy(*order)
