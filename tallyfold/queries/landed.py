"""The readers and sinks: given tables are landed as files of each layout in the shared folder, by Spark, and read back."""

from pyspark.sql import functions as F

from ..catalog import query
from ..operators.lineage import shared_place
from ..sources import readers
from ..sources.views import awards, n_rows, signals, table
from .sqltext import AW, SIG


def _landed(df, name, layout="json", by=None, **options):
    """The path that df was written to; `by` gives each of its values a file of its own."""
    path = shared_place(df.sparkSession, f"landed-{name}")
    writer = df.write.format(layout).options(**options)
    (writer.partitionBy(by) if by else writer).save(path)
    return f"{path}/*" if by else path


@query("a1_award_file", f"{AW} SELECT 'Firm, ' || firm AS company, count(*) AS n, round(sum(round(amount, 2)), 2) AS amount, CAST(min(CASE WHEN award_id % 3 < 2 THEN day END) AS VARCHAR) AS first_day FROM awards GROUP BY 1")
def a1_award_file(spark, sf):
    """A bulk file with quoted commas and quotes, amounts as money, days in two formats or unreadable."""
    a, k = awards(spark, sf), F.col("award_id")
    said = F.when(k % 3 == 0, F.date_format("day", "yyyy-MM-dd")).when(k % 3 == 1, F.date_format("day", "MM/dd/yyyy")).otherwise("soon")
    none = F.lit(None).cast("string")
    rows = a.select(
        F.concat(F.lit("Firm, "), F.col("firm").cast("string")).alias("Company"), F.concat(F.lit('A "fine" '), "priority").alias("Award Title"), *[none.alias(c) for c in ("Agency", "Branch", "Phase", "Program", "Contract", "Agency Tracking Number")],
        said.alias("Proposal Award Date"), F.year("day").alias("Award Year"), F.concat(F.lit("$"), F.format_number("amount", 2)).alias("Award Amount"), *[none.alias(c) for c in ("UEI", "Duns", "Number Employees", "Company Website", "PI Email")],
    )
    got = readers.read_awards(spark, _landed(rows, "awards", "csv", header="true", quote='"', escape='"'))
    return got.groupBy(F.col("Company").alias("company")).agg(n_rows().alias("n"), F.round(F.sum("amount"), 2).alias("amount"), F.min("day").cast("string").alias("first_day"))


@query("a2_rank_list", "SELECT length(p_name) AS width, count(*) AS n, min(p_partkey - least_) + 1 AS best, '' AS faults FROM part, (SELECT min(p_partkey) AS least_ FROM part) GROUP BY 1")
def a2_rank_list(spark, sf):
    """A list of ranks and names, with what keeps it from being whole."""
    p = table(spark, sf, "part")
    least = p.agg(F.min("p_partkey").alias("least"))
    ranks = readers.read_rank_list(spark, _landed(p.crossJoin(F.broadcast(least)).select((F.col("p_partkey") - F.col("least") + 1).alias("rank"), "p_name"), "ranks", "csv"))  # one row
    faults = "; ".join(readers.rank_list_faults(ranks, 1))
    return ranks.groupBy(F.length("domain").cast("long").alias("width")).agg(n_rows().alias("n"), F.min("rank").cast("long").alias("best"), F.lit(faults).alias("faults"))


@query("a3_form_index", f"{AW} SELECT CASE WHEN status = 'P' THEN 'D/A' ELSE 'D' END AS form, CAST(day AS VARCHAR) AS filed, count(*) AS n, min(lpad(CAST(firm AS VARCHAR), 10, '0') || '-24-' || lpad(CAST(award_id % 1000000 AS VARCHAR), 6, '0')) AS accession FROM awards WHERE award_id % 5 > 0 GROUP BY ALL")
def a3_form_index(spark, sf):
    """A fixed-width index of forms; other forms are passed over."""
    a, k, f = awards(spark, sf), F.col("award_id"), F.col("firm").cast("string")
    form = F.when(k % 5 == 0, "DEF 14A").when(F.col("status") == "P", "D/A").otherwise("D")
    accession = F.concat(F.lpad(f, 10, "0"), F.lit("-24-"), F.lpad((k % 1_000_000).cast("string"), 6, "0"))
    line = F.concat(F.rpad(form, 12, " "), F.rpad(F.concat(F.lit("Firm "), f, F.lit(", Inc.")), 40, " "), F.rpad(f, 12, " "), F.date_format("day", "yyyyMMdd"), F.lit("    edgar/data/"), f, F.lit("/"), accession, F.lit(".txt"))
    rows = readers.read_form_index(spark, _landed(a.select(line.alias("value")), "index", "text"))
    return rows.groupBy("form", F.col("filed").cast("string").alias("filed")).agg(n_rows().alias("n"), F.min("accession").alias("accession"))


@query("a4_xml_records", f"{AW} SELECT 'Firm & Co ' || firm AS issuer, CAST(count(*) AS BIGINT) AS n, CAST(sum(award_id % 3 + 1) AS BIGINT) AS people FROM awards GROUP BY 1")
def a4_xml_records(spark, sf):
    """Filings as XML documents with lists of people in them."""
    a = awards(spark, sf)
    person = F.transform(F.sequence(F.lit(0), (F.col("award_id") % 3).cast("int")), lambda i: F.struct(F.concat(F.lit("A"), i.cast("string")).alias("firstName"), F.lit("Lee").alias("lastName"), F.lit("Director").alias("role")))
    rows = a.select(F.col("firm").cast("string").alias("cik"), F.concat(F.lit("Firm & Co "), F.col("firm").cast("string")).alias("issuerName"), F.lit("Corporation").alias("entityType"), F.year("day").alias("yearOfInc"), F.col("amount").cast("string").alias("amountSold"), person.alias("person"))
    got = readers.read_xml(spark, _landed(rows, "filings", "xml", rowTag="edgarSubmission", rootTag="all"), "edgarSubmission", readers.FILING)
    return got.groupBy(F.col("issuerName").alias("issuer")).agg(n_rows().alias("n"), F.sum(F.size("person")).alias("people"))


@query("a5_feed", "SELECT 'tag:' || s_suppkey AS id, s_name AS title, n_name AS author FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def a5_feed(spark, sf):
    """Entries of a feed."""
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    rows = s.select(F.concat(F.lit("tag:"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("title"), F.struct(F.col("n_name").alias("name")).alias("author"))
    got = readers.read_xml(spark, _landed(rows, "feed", "xml", rowTag="entry", rootTag="feed"), "entry", "id string, title string, author struct<name: string>")
    return got.select("id", "title", F.col("author.name").alias("author"))


@query("a6_api_dump", "SELECT role AS author, CASE WHEN turn = 0 THEN 'story' ELSE 'comment' END AS kind, count(*) AS n, CAST(min(turn) * 86400 AS BIGINT) AS first FROM conversations GROUP BY ALL")
def a6_api_dump(spark, sf):
    """Dumps of search answers, each an object with an array of hits."""
    c = table(spark, sf, "conversations")
    hit = F.struct(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("objectID"), F.col("role").alias("author"), (F.col("turn") * 86400).cast("long").alias("created_at_i"), F.col("text").alias("comment_text"), F.array(F.when(F.col("turn") == 0, "story").otherwise("comment")).alias("_tags"))
    # An answer has a page of hits: 64 turns of 64 conversations.
    page = F.concat_ws("-", F.floor(F.col("conv_id") / 64).cast("string"), F.floor(F.col("turn") / 64).cast("string"))
    dumps = c.groupBy(page.alias("page")).agg(F.collect_list(hit).alias("hits"))
    got = readers.read_hits(spark, _landed(dumps, "hits", by="page"))
    return got.groupBy("author", "kind").agg(n_rows().alias("n"), F.min(F.unix_timestamp("at")).alias("first"))


@query("a7_event_archive", "SELECT CASE event_type WHEN 'purchase' THEN 'WatchEvent' ELSE 'ForkEvent' END AS type, 'u' || user_id AS login, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events WHERE event_type IN ('purchase', 'click') GROUP BY ALL")
def a7_event_archive(spark, sf):
    """The events as an archive of JSON lines: stars and forks are read, the rest passed over."""
    e, t = table(spark, sf, "events"), F.col("event_type")
    kind = F.when(t == "purchase", "WatchEvent").when(t == "click", "ForkEvent").otherwise("PushEvent")
    rows = e.select(F.col("event_id").cast("string").alias("id"), kind.alias("type"), F.struct(F.col("user_id").cast("long").alias("id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("login")).alias("actor"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"))
    got = readers.read_archive(spark, _landed(rows, "archive"))
    return got.groupBy("type", F.col("actor.login").alias("login"), F.to_date("created_at").cast("string").alias("day")).agg(n_rows().alias("n"))


@query("a8_role_boards", f"{AW} SELECT 'Role ' || priority AS title, 'Dept ' || status AS department, CAST(day AS VARCHAR) AS posted, count(*) AS n FROM awards GROUP BY ALL")
def a8_role_boards(spark, sf):
    """Open roles on boards of three layouts, one after the other by the firm's number."""
    a = awards(spark, sf).select("firm", F.floor(F.col("award_id") / 1000).alias("page"), F.concat(F.lit("Role "), "priority").alias("title"), F.concat(F.lit("Dept "), "status").alias("dept"), F.col("day").cast("string").alias("day"), F.col("award_id").cast("string").alias("url"))
    green = F.struct("title", F.struct(F.lit("NY").alias("name")).alias("location"), F.concat("day", F.lit("T00:00:00Z")).alias("first_published"), F.array(F.struct(F.col("dept").alias("name"))).alias("departments"), F.col("url").alias("absolute_url"))
    ashby = F.struct("title", F.lit("SF").alias("location"), F.col("day").alias("publishedAt"), F.col("dept").alias("department"), F.col("url").alias("jobUrl"))
    # A file has a page of at most a thousand roles.
    board = lambda k, job, name: _landed(a.filter(F.col("firm") % 3 == k).groupBy("page").agg(F.collect_list(job).alias("jobs")), name, by="page")
    lever = a.filter("firm % 3 = 1").select("page", F.col("url").alias("id"), F.col("title").alias("text"), (F.unix_date(F.to_date("day")).cast("long") * 86_400_000).alias("createdAt"), F.struct(F.lit("LA").alias("location"), F.col("dept").alias("team")).alias("categories"), F.col("url").alias("hostedUrl"))
    lever = _landed(lever.select("page", F.to_json(F.struct(*[c for c in lever.columns if c != "page"])).alias("x")).groupBy("page").agg(F.concat(F.lit("["), F.array_join(F.collect_list("x"), ","), F.lit("]")).alias("value")), "lever", "text", by="page")
    got = readers.read_roles(spark, board(0, green, "greenhouse"), lever, board(2, ashby, "ashby"))
    return got.groupBy("title", "department", F.col("posted").cast("string").alias("posted")).agg(n_rows().alias("n"))


@query("a9_signal_store", f"{SIG} SELECT family, kind, count(*) AS n, round(sum(strength), 6) AS strength FROM signals GROUP BY ALL")
def a9_signal_store(spark, sf):
    """Signals stored by family and read again."""
    path = shared_place(spark, "signals")
    readers.write_signals(signals(spark, sf), path)
    return spark.read.parquet(path).groupBy("family", "kind").agg(n_rows().alias("n"), F.round(F.sum("strength"), 6).alias("strength"))


@query("a10_documents", "SELECT c_custkey, c_name AS name, n_name AS nation FROM customer JOIN nation ON n_nationkey = c_nationkey")
def a10_documents(spark, sf):
    """A JSON document a customer, written and read again."""
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", F.col("c_name").alias("name"), F.struct(F.col("n_name").alias("nation")).alias("at"))
    path = _landed(readers.documents_of(c, "c_custkey").select(F.col("document").alias("value")), "documents", "text")
    got = spark.read.schema("c_custkey long, name string, at struct<nation: string>").json(path)
    return got.select(F.col("c_custkey").cast(table(spark, sf, "customer").schema["c_custkey"].dataType), "name", "at.nation")


@query("a13_briefs", f"{AW}, f AS (SELECT firm, min(priority) AS summary, count(*) AS n FROM awards GROUP BY 1) SELECT 'firm-' || firm AS slug, summary, n FROM f WHERE firm % 4 > 0 AND n > 2")
def a13_briefs(spark, sf):
    """Briefs of firms; those without a summary or sources are passed over."""
    f = awards(spark, sf).groupBy("firm").agg(F.min("priority").alias("said"), n_rows().alias("n"))
    source = F.struct(F.lit("t").alias("title"), F.lit("u").alias("url"))
    rows = f.select(F.concat(F.lit("firm-"), F.col("firm").cast("string")).alias("slug"), F.when(F.col("firm") % 4 > 0, F.col("said")).otherwise(" ").alias("summary"), F.when(F.col("n") > 2, F.array(source)).alias("sources"), F.array(F.col("n").cast("string")).alias("questions"), F.floor(F.col("firm") / 200).alias("page"))
    # A folder of documents; several share a file as one array.
    docs = rows.select("page", F.to_json(F.struct("slug", "summary", "sources", "questions")).alias("x")).groupBy("page").agg(F.concat(F.lit("["), F.array_join(F.collect_list("x"), ","), F.lit("]")).alias("value"))
    got = readers.read_briefs(spark, _landed(docs, "briefs", "text", by="page"))
    return got.select("slug", "summary", F.get("questions", F.lit(0)).cast("long").alias("n"))
