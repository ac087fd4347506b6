"""Scans of landed files and the sinks of served tables. Schemas are given, never inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import parse_date

AWARD_CSV = "`Company` string, `Award Title` string, `Agency` string, `Branch` string, `Phase` string, `Program` string, `Contract` string, `Agency Tracking Number` string, `Proposal Award Date` string, `Award Year` int, `Award Amount` string, `UEI` string, `Duns` string, `Number Employees` int, `Company Website` string, `PI Email` string"
RANK_CSV = "rank int, domain string"
ARCHIVE_EVENT = "id string, type string, actor struct<id: long, login: string>, repo struct<id: long, name: string>, public boolean, created_at timestamp"
HITS = "hits array<struct<objectID: string, author: string, created_at_i: long, title: string, url: string, story_id: long, comment_text: string, points: int, num_comments: int, _tags: array<string>>>"
FILING = "cik string, issuerName string, entityType string, yearOfInc int, industryGroup string, totalOffering string, amountSold string, person array<struct<firstName: string, lastName: string, role: string>>"


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    """Columns that a changed layout no longer has."""
    have = set(df.columns)
    return [c for c in required if c not in have]


def read_awards(spark: SparkSession, path: str) -> DataFrame:
    """The bulk award file, by header; amounts and days parsed, unreadable ones null."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", False).schema(AWARD_CSV).csv(path)
    return df.withColumn("amount", F.expr("try_cast(replace(replace(`Award Amount`, ',', ''), '$', '') AS double)")).withColumn("day", parse_date(F.col("Proposal Award Date")))


def read_rank_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RANK_CSV).csv(path)


def rank_list_faults(ranks: DataFrame, least_rows: int = 3_000_000) -> list[str]:
    """Why a rank list isn't whole; one aggregate decides."""
    r = ranks.agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first"), F.max("rank").alias("last")).first()
    faults = []
    if r["first"] != 1:
        faults.append("does not begin at rank 1")
    if r["n"] < least_rows:
        faults.append("too few rows")
    if r["last"] is None or abs(r["last"] - r["n"]) > max(5, r["n"] / 200):
        faults.append("ranks are missing or repeat")
    return faults


def read_form_index(spark: SparkSession, path: str) -> DataFrame:
    """Filings of forms D and D/A from a fixed-width index: lines that end in a day and a path, after the dashed rule."""
    line = r"^(\S+(?:/A)?)\s{2,}(.+?)\s{2,}(\d+)\s+(\d{4}-?\d{2}-?\d{2})\s+(\S*?([0-9]{10}-[0-9]{2}-[0-9]{6})\S*)\s*$"
    part = lambda k: F.regexp_extract("value", line, k)
    rows = spark.read.text(path).select(part(1).alias("form"), part(2).alias("company"), part(3).alias("cik"), F.to_date(F.replace(part(4), F.lit("-"), F.lit("")), "yyyyMMdd").alias("filed"), part(6).alias("accession"))
    return rows.filter(F.col("form").isin("D", "D/A"))


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """Documents or feed items (`edgarSubmission`, `item`, `entry`) as rows."""
    return spark.read.format("xml").option("rowTag", row_tag).option("ignoreNamespace", True).schema(schema).load(path)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Hourly archives of repository events: stars and forks."""
    return spark.read.schema(ARCHIVE_EVENT).json(path).filter(F.col("type").isin("WatchEvent", "ForkEvent"))


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """Mentions from search dumps, one row a hit, its time in UTC."""
    hit = spark.read.option("multiLine", True).schema(HITS).json(path).select(F.explode("hits").alias("h")).select("h.*")
    return hit.withColumn("at", F.timestamp_seconds("created_at_i")).withColumn("kind", F.when(F.array_contains("_tags", "story"), "story").otherwise("comment"))


def read_roles(spark: SparkSession, greenhouse: str | None = None, lever: str | None = None, ashby: str | None = None) -> DataFrame:
    """Open roles of three board layouts as (title, location, posted, department, url)."""
    parts = []
    read = spark.read.option("multiLine", True)
    if greenhouse:
        j = read.schema("jobs array<struct<title: string, location: struct<name: string>, first_published: string, departments: array<struct<name: string>>, absolute_url: string>>").json(greenhouse).select(F.explode("jobs").alias("j"))
        parts.append(j.select("j.title", F.col("j.location.name").alias("location"), F.to_date(F.substring("j.first_published", 1, 10)).alias("posted"), F.get(F.col("j.departments.name"), F.lit(0)).alias("department"), F.col("j.absolute_url").alias("url")))
    if lever:
        j = read.schema("id string, text string, createdAt long, categories struct<location: string, team: string>, hostedUrl string").json(lever)
        parts.append(j.select(F.col("text").alias("title"), F.col("categories.location").alias("location"), F.to_date(F.timestamp_millis("createdAt")).alias("posted"), F.col("categories.team").alias("department"), F.col("hostedUrl").alias("url")))
    if ashby:
        j = read.schema("jobs array<struct<title: string, location: string, publishedAt: string, department: string, jobUrl: string>>").json(ashby).select(F.explode("jobs").alias("j"))
        parts.append(j.select("j.title", "j.location", F.to_date(F.substring("j.publishedAt", 1, 10)).alias("posted"), "j.department", F.col("j.jobUrl").alias("url")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_briefs(spark: SparkSession, path: str) -> DataFrame:
    """Briefs that have a summary and sources, one a slug."""
    schema = "slug string, generatedAt string, summary string, oneLiner string, thesis string, stage string, team array<struct<name: string, background: string>>, questions array<string>, risks array<string>, sources array<struct<title: string, url: string>>, announcement struct<date: string, what: string, url: string>"
    return spark.read.option("multiLine", True).schema(schema).json(path).filter((F.coalesce(F.trim("summary"), F.lit("")) != "") & (F.size(F.coalesce("sources", F.array())) > 0))


def write_signals(signals: DataFrame, path: str) -> None:
    signals.write.mode("overwrite").partitionBy("family").parquet(path)


def csv_view(df: DataFrame, lists: Sequence[str] = ()) -> DataFrame:
    """The view as it goes to a CSV file: list columns joined by '; '."""
    return df.select(*[F.array_join(c, "; ").alias(c) if c in lists else F.col(c) for c in df.columns])


def write_csv(df: DataFrame, path: str, lists: Sequence[str] = ()) -> None:
    """Quotes doubled as RFC 4180 says."""
    csv_view(df, lists).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def documents_of(df: DataFrame, key: str) -> DataFrame:
    """One JSON document a row, named by its key."""
    return df.select(F.col(key), F.to_json(F.struct("*")).alias("document"))


def run_log(jobs: DataFrame, run_id: Column) -> DataFrame:
    """A line per source job of a run: emitted, inserted, errors."""
    return jobs.groupBy("source").agg(F.count(F.lit(1)).alias("emitted"), F.sum(F.col("is_new").cast("long")).alias("inserted"), F.max("error").alias("error")).withColumn("run_id", run_id)


def carried_forward(log: DataFrame, new_run: Column) -> DataFrame:
    """The last run's report under a new run that collected nothing."""
    last = log.agg(F.max("run_id").alias("run_id"))
    return log.join(F.broadcast(last), "run_id", "left_semi").withColumn("run_id", new_run)  # one row
