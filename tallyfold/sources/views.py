"""Views of the given tables in the shapes of the library: signals, awards, sites and names; with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASOF = "2024-01-30"
FAMILY_OF = {"purchase": "capital", "signup": "regulatory", "error": "github", "click": "social", "view": "hiring"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def asof_day() -> Column:
    """The day that the queries over events look back from."""
    return F.to_date(F.lit(ASOF))


def n_rows() -> Column:
    return F.count(F.lit(1))


def family_of(kind: Column) -> Column:
    return F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in FAMILY_OF.items()])


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals from all events, with a strength that grows with the value."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("signal_id"), F.col("user_id").alias("entity_id"), family_of(F.col("event_type")).alias("family"), F.col("event_type").alias("kind"),
        "ts", F.to_date("ts").alias("occurred_at"), "value", (0.6 * F.col("value") / (F.col("value") + 400)).alias("strength"),
        F.get_json_object("props", "$.k").cast("int").alias("subject"),
    )


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of an entity's signals: the single ones, and of its views and clicks one continuous signal each, a point a week with a strength by the week's rows; single ones of one subject are one award's."""
    e = table(spark, sf_dir, "events").filter(F.col("event_type").isin("view", "click"))
    week = F.date_add(F.to_date("ts"), 6 - F.pmod(F.datediff(F.to_date("ts"), F.to_date(F.lit("2024-01-01"))), F.lit(7)))
    weekly = e.groupBy(F.col("user_id").alias("entity_id"), "event_type", week.alias("t")).agg(n_rows().alias("n"))
    points = weekly.groupBy("entity_id", F.when(F.col("event_type") == "view", "traffic").otherwise("launch").alias("family")).agg(F.max("t").alias("occurred_at"), F.collect_list(F.struct("t", F.col("n").cast("double").alias("v"), (F.col("n") / (F.col("n") + 3)).alias("s"))).alias("series"))
    single = signals(spark, sf_dir).select("entity_id", "family", "occurred_at", "strength", F.lit(None).cast(points.schema["series"].dataType).alias("series"), F.when(F.col("subject") % 3 == 0, F.col("subject").cast("string")).alias("award_key"))
    return single.unionByName(points.select("entity_id", "family", "occurred_at", F.lit(0.5).alias("strength"), "series", F.lit(None).cast("string").alias("award_key")))


def awards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Awards from orders: firm, day, amount and status."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("award_id"), F.col("o_custkey").alias("firm"), F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("amount"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))


SIGNALS_SQL = f"""signals AS (
  SELECT event_id AS signal_id, user_id AS entity_id,
    CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in FAMILY_OF.items())} END AS family, event_type AS kind,
    ts, CAST(ts AS DATE) AS occurred_at, value, 0.6 * value / (value + 400) AS strength,
    CAST(json_extract_string(props, '$.k') AS INTEGER) AS subject
  FROM events)"""
AWARDS_SQL = "awards AS (SELECT o_orderkey AS award_id, o_custkey AS firm, CAST(o_orderdate AS DATE) AS day, o_totalprice AS amount, o_orderstatus AS status, o_orderpriority AS priority FROM orders)"
#: Of each entity, family and date (asofs: d) the strengths that count, as `measured` and the scores have them.
LIVE_SQL = f"""{SIGNALS_SQL}, weekly AS (
  SELECT user_id AS entity_id, CASE event_type WHEN 'view' THEN 'traffic' ELSE 'launch' END AS family,
    CAST(ts AS DATE) + CAST(6 - ((date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) % 7 + 7) % 7) AS INTEGER) AS t, count(*) / (count(*) + 3) AS s
  FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL),
lives AS (
  SELECT entity_id, family, d, CASE WHEN subject % 3 = 0 THEN 'a' || subject ELSE 's' || signal_id END AS award,
    CASE WHEN date_diff('day', occurred_at, d) < -1 THEN 0.0 ELSE strength * pow(0.5, greatest(date_diff('day', occurred_at, d), 0) / {{half}}) END AS live
  FROM signals, asofs
  UNION ALL
  SELECT entity_id, family, d, 'series', arg_max(s, t) * pow(0.5, greatest(date_diff('day', max(t), d), 0) / {{half}}) FROM weekly, asofs WHERE t <= d + 1 GROUP BY entity_id, family, d),
counted AS (SELECT entity_id, family, d, max(live) AS live FROM lives GROUP BY entity_id, family, d, award)"""
