"""Boards, feeds, people, dossiers, source jobs and streams."""

from pyspark.sql import functions as F

from ..catalog import SQL, query
from ..functions import fixed
from ..operators import evidence
from ..operators.ranking import ranked_top, top_per
from ..plans import score
from ..sources import jobs, readers
from ..operators.text import classify_groups
from ..sources.views import ASOF, asof_day, awards, measured, n_rows, signals, table
from ..streaming import stream
from . import kinds, texts
from .jobsql import JOB_SQL
from .sqltext import AW, DAY, SIG, over, scored, sq
from .sqltext import measured as all_signals


def _board(spark, sf, n=30):
    s = score.score_entities(signals(spark, sf), ASOF, weeks=1)
    return ranked_top(s.select("entity_id", "edge", "momentum", "convergence"), [F.desc("edge"), F.col("entity_id")], n)


_BOARD = f"{scored()}, board AS (SELECT entity_id, edge, momentum, convergence, CAST(row_number() OVER (ORDER BY edge DESC, entity_id) AS INTEGER) AS rank FROM scored ORDER BY edge DESC, entity_id LIMIT 30)"


@query("p5_board", f"{SIG}, {_BOARD}, d AS (SELECT entity_id, count(*) AS n, min(occurred_at) AS first_day, max(occurred_at) AS last_day FROM signals GROUP BY 1) SELECT board.entity_id, rank, edge, n, CAST(first_day AS VARCHAR) AS first_day, CAST(last_day AS VARCHAR) AS last_day, date_diff('day', first_day, {DAY}) <= 7 AS is_new, convergence >= 2 AS convergent FROM board JOIN d USING (entity_id)")
def p5_board(spark, sf):
    d = signals(spark, sf).groupBy("entity_id").agg(n_rows().alias("n"), F.min("occurred_at").alias("first_day"), F.max("occurred_at").alias("last_day"))
    b = _board(spark, sf).join(d, "entity_id")
    return b.select("entity_id", "rank", "edge", "n", F.col("first_day").cast("string").alias("first_day"), F.col("last_day").cast("string").alias("last_day"), (F.datediff(asof_day(), "first_day") <= 7).alias("is_new"), (F.col("convergence") >= 2).alias("convergent"))


@query("p6_dossier", f"{SIG}, {_BOARD} SELECT entity_id, rank, string_agg(kind || ':' || signal_id, ';' ORDER BY nth) AS top_signals FROM (SELECT s.*, rank, row_number() OVER (PARTITION BY s.entity_id ORDER BY occurred_at DESC, strength DESC, signal_id) AS nth FROM signals s JOIN board USING (entity_id)) WHERE nth <= 10 GROUP BY ALL")
def p6_dossier(spark, sf):
    s = signals(spark, sf).join(_board(spark, sf).select("entity_id", "rank"), "entity_id")
    top = top_per(s, ["entity_id"], [F.desc("occurred_at"), F.desc("strength"), F.col("signal_id")], 10, nth="nth")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "kind", "signal_id"))), lambda x: F.concat(x["kind"], F.lit(":"), x["signal_id"].cast("string"))), ";")
    return top.groupBy("entity_id", "rank").agg(joined.alias("top_signals"))


@query("p7_feed", f"{SIG}, {_BOARD} SELECT signal_id, entity_id, rank, CAST(occurred_at AS VARCHAR) AS day FROM signals JOIN board USING (entity_id) WHERE strength > 0.05 ORDER BY occurred_at DESC, strength DESC, signal_id LIMIT 100")
def p7_feed(spark, sf):
    f = signals(spark, sf).filter("strength > 0.05").join(_board(spark, sf).select("entity_id", "rank"), "entity_id")
    return f.orderBy(F.desc("occurred_at"), F.desc("strength"), "signal_id").limit(100).select("signal_id", "entity_id", "rank", F.col("occurred_at").cast("string").alias("day"))


@query("p2_team", f"WITH p AS (SELECT conv_id, role, count(*) AS n, least(count(*), 3) AS firsts, max(length(text)) AS h FROM conversations GROUP BY ALL) SELECT conv_id, round(1 - product(pow(0.45, CASE WHEN role = 'user' THEN firsts ELSE 0 END) * pow(0.7, CASE WHEN role = 'user' THEN 0 ELSE firsts END) * (1 - 0.6 * {sq('h', 25)})), 4) AS team FROM p GROUP BY 1")
def p2_team(spark, sf):
    p = table(spark, sf, "conversations").groupBy("conv_id", "role").agg(n_rows().alias("n"), F.max(F.length("text")).alias("h"))
    user, zero = F.col("role") == "user", F.lit(0)
    one = score.team_parts(F.when(user, F.col("n")).otherwise(zero), F.when(user, zero).otherwise(F.col("n")), F.col("h"), zero, F.lit(False))
    return p.groupBy("conv_id").agg(F.round(1 - F.product(1 - one), 4).alias("team"))


@query("p9_people_table", "SELECT conv_id, role, round(CASE WHEN role = 'user' THEN 1.35 WHEN role = 'assistant' THEN 1.1 ELSE 1.0 END * (1 + 0.6 * least(count(*), 3) + least(max(turn), 60) / 60.0), 6) AS weight FROM conversations GROUP BY conv_id, role")
def p9_people_table(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id", "role").agg(n_rows().alias("n"), F.max("turn").alias("turn"))
    weight = evidence.role_weight(F.col("role"), {"user": 1.35, "assistant": 1.1}, F.col("n"), F.col("turn"), F.lit(False), F.lit(1.0))
    return c.select("conv_id", "role", F.round(weight, 6).alias("weight"))


@query("p10_run_meta", f"{SIG} SELECT count(*) AS signals, count(DISTINCT entity_id) AS entities, count(DISTINCT kind) AS sources, count(*) FILTER (WHERE strength >= 0.3) AS strong FROM signals")
def p10_run_meta(spark, sf):
    return signals(spark, sf).agg(n_rows().alias("signals"), F.countDistinct("entity_id").alias("entities"), F.countDistinct("kind").alias("sources"), F.count(F.when(F.col("strength") >= 0.3, 1)).alias("strong"))


@query("p12_partition", f"{SIG}, n AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY occurred_at DESC, signal_id) AS nth FROM signals), g AS (SELECT entity_id, count(*) FILTER (WHERE subject % 9 <> 0) AS dated, count(*) FILTER (WHERE subject % 9 = 0) AS undated, count(DISTINCT kind) > count(DISTINCT kind) FILTER (WHERE nth <= 3) AS more_than_why, bool_or(kind = 'view') AS v, bool_or(kind = 'click') AS c, bool_or(kind = 'error') AS e FROM n GROUP BY 1) SELECT entity_id, dated, undated, more_than_why, concat_ws(',', CASE WHEN v THEN 'view' END, CASE WHEN c THEN 'click' END, CASE WHEN e THEN 'error' END) AS links FROM g")
def p12_partition(spark, sf):
    """Dated and undated signals, whether all kinds say more than the three newest signals' do, and the links that are shown: views first; a purchase has none, a sign-up the reviewer's own."""
    state = F.col("subject") % 9 == 0
    s = signals(spark, sf)
    why = top_per(s, ["entity_id"], [F.desc("occurred_at"), F.col("signal_id")], 3).groupBy("entity_id").agg(F.collect_set("kind").alias("why"))
    g = s.groupBy("entity_id").agg(F.count(F.when(~state, 1)).alias("dated"), F.count(F.when(state, 1)).alias("undated"), F.collect_set("kind").alias("kinds")).join(why, "entity_id")
    address = lambda k: F.when(k == "purchase", "none").when(k == "signup", "https://review.example").otherwise(F.concat(F.lit("https://"), k, F.lit(".example")))
    links = F.map_from_entries(F.transform("kinds", lambda k: F.struct(k, address(k))))
    return g.select("entity_id", "dated", "undated", evidence.adds_to(F.col("kinds"), F.col("why")).alias("more_than_why"), F.array_join(evidence.shown_links(links, ["view"], "review.example"), ",").alias("links"))


@query("a11_csv_view", f"{SIG} SELECT entity_id, string_agg(DISTINCT kind, '; ' ORDER BY kind) AS kinds FROM signals GROUP BY 1")
def a11_csv_view(spark, sf):
    return readers.csv_view(signals(spark, sf).groupBy("entity_id").agg(F.array_sort(F.collect_set("kind")).alias("kinds")), ["kinds"])


@query("a12_run_log", f"{SIG} SELECT kind AS source, count(*) AS emitted, CAST(sum(CASE WHEN subject % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS inserted, CAST(NULL AS VARCHAR) AS error, CAST(7 AS INTEGER) AS run_id FROM signals GROUP BY 1")
def a12_run_log(spark, sf):
    rows = signals(spark, sf).select(F.col("kind").alias("source"), (F.col("subject") % 2 == 0).alias("is_new"), F.lit(None).cast("string").alias("error"))
    return readers.run_log(rows, F.lit(7))


# --- source jobs over the given tables


def _tables(spark, sf):
    a = awards(spark, sf)
    e = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    d = F.col("day")
    return {
        "filings": a.select("firm", "day", (F.col("amount") * 10).alias("amount"), (F.year(d) - F.col("firm") % 9).cast("int").alias("year_inc"), F.when(F.col("status") == "P", "Limited Partnership").otherwise("Corporation").alias("kind_of_entity")),
        "agreements": a.select("firm", "day", "amount", F.date_sub(d, (F.col("firm") % 3000).cast("int")).alias("registered")),
        "stars": e.select(F.col("user_id").alias("owner"), (F.col("event_id") % 2).alias("repo"), F.col("ts").cast("timestamp").alias("at")),
        "star_samples": e.select(F.col("user_id").alias("owner"), (F.col("event_id") % 2).alias("repo")).distinct().selectExpr("owner", "repo", "owner % 23 / 40 AS young", "owner % 7 / 7 AS blank", "owner % 800 AS median_age"),
        "roles": a.select(F.col("firm").alias("board"), "day", (F.col("priority") == "1-URGENT").alias("hardware")),
        "mentions": e.select(F.col("user_id").alias("entity"), "day", F.get_json_object("props", "$.k").alias("author"), F.col("value").alias("points")),
        "ranks": table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("domain"), F.to_date(F.when(F.col("l_returnflag") == "R", "2024-01-01").when(F.col("l_returnflag") == "A", "2023-11-02").otherwise("2024-01-31")).alias("list_day")).agg(F.sum("l_quantity").cast("int").alias("rank")),
        "certificates": table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("domain"), F.col("l_partkey").alias("host"), F.to_date("l_shipdate").alias("issued"), F.date_add(F.to_date("l_shipdate"), 90).alias("expires")),
        "licences": a.select(F.concat(F.lit("Firm "), F.col("firm").cast("string"), F.lit(" Labs, Inc.")).alias("applicant"), "day", F.when(F.col("status") == "P", "pending").otherwise("granted").alias("status"), F.when(F.col("priority") == "5-LOW", "sta").otherwise("experimental").alias("kind"), (F.col("award_id") % 120).alias("units"), F.get(F.array(*[F.lit(x) for x in ("Engineer", "Chief Operating Officer", "Vice President", "Founder")]), (F.col("award_id") % 4).cast("int")).alias("title"), (F.col("award_id") % 10 / 10).alias("fit"), F.when(F.col("award_id") % 3 == 0, "call").alias("callsign"), *[(F.col("award_id") % k == 0).alias(c) for k, c in ((5, "own_design"), (7, "gov_contract"), (11, "on_thesis"), (13, "routine"))]),
        "declarations": a.select(F.concat(F.lit("Maker "), F.col("firm").cast("string")).alias("maker"), F.col("priority").alias("series"), "day", F.when(F.col("status") == "O", "accepted").otherwise("pending").alias("status")),
        "papers_filed": a.select((F.col("firm") % 300).alias("docket"), F.col("firm").alias("party"), "day", F.col("priority").alias("kind"), F.floor(F.col("award_id") / 2).alias("package")),
        "hiring_posts": table(spark, sf, "conversations").select((F.col("conv_id") % 70).alias("company"), F.floor(F.col("conv_id") / 20).alias("thread"), F.date_add(F.to_date(F.lit("2024-01-01")), F.floor(F.col("conv_id") / 20).cast("int")).alias("day"), F.when(F.col("turn") % 2 == 0, F.col("turn") * 9 + 1).alias("team_size"), F.lit(0.5).alias("fit"), (F.col("conv_id") % 9 != 0).alias("complete")),
        "launches": a.select(F.col("firm").alias("company"), "day", (F.col("award_id") % 900).alias("votes")),
        "papers": table(spark, sf, "documents").select(F.col("source").alias("company"), F.col("text").alias("title"), F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("doc_id") % 28).cast("int")).alias("day"), F.lit(True).alias("complete")),
    }


def _job(slug, day):
    def q(spark, sf):
        out = jobs.JOBS[slug][2](_tables(spark, sf), F.to_date(F.lit(day)))
        return out.withColumn("occurred_at", F.col("occurred_at").cast("string"))

    q.__doc__ = jobs.JOBS[slug][2].__doc__
    return q


_PRIOR = "count(*) OVER (PARTITION BY firm ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)"
_HEAD = "SELECT '{0}' AS source, '{1}' AS family, {2} AS kind, CAST({3} AS VARCHAR) AS entity, CAST({4} AS VARCHAR) AS occurred_at, CAST({5} AS DOUBLE) AS value, round(least(greatest({6}, 0.0), 1.0), 6) AS strength FROM {7}"
_SIZE = "(CASE WHEN lg <= 5.4 THEN 0.0 WHEN lg <= 6 THEN (lg - 5.4) * (0.35 / 0.6) WHEN lg <= 7 THEN 0.35 + (lg - 6) * 0.4 WHEN lg <= 8 THEN 0.75 + (lg - 7) * 0.25 ELSE 1.0 END)"
_JOB_SQL = {
    "sec_form_d": f"{AW}, f AS (SELECT firm, day, amount * 10 AS amount, year(day) - firm % 9 AS year_inc FROM awards WHERE status <> 'P' AND firm % 9 <= 5 AND amount * 10 >= 250000), h AS (SELECT *, log10(amount) AS lg, {_PRIOR} AS prior, lag(amount) OVER (PARTITION BY firm ORDER BY day, amount) AS before FROM f) "
    + _HEAD.format("sec_form_d", "capital", "CASE WHEN prior > 0 THEN 'form_d_amendment' ELSE 'form_d' END", "firm", "day", "coalesce(amount - before, amount)", f"least(greatest(0.15 + 0.66 * {_SIZE} * (0.35 + 0.35 * least(greatest(1 - (year(day) - year_inc) / 5, 0), 1) + 0.30 * (CASE WHEN prior = 0 THEN 1.0 ELSE 1 / (1 + prior) END)), 0.15), 0.97)", "h"),
    "fpds_ot": f"{AW}, h AS (SELECT *, {_PRIOR} AS prior, least(greatest(1 - (firm % 3000) / 1825, 0), 1) AS fresh, {sq('amount', 750000)} AS money FROM awards) " + _HEAD.format("fpds_ot", "capital", "CASE WHEN prior = 0 THEN 'ot_first_award' ELSE 'ot_award' END", "firm", "least(day + 90, DATE '2001-08-01')", "amount", "least(greatest(0.18 + 0.25 * fresh + 0.17 * money + (CASE WHEN prior = 0 THEN 0.10 + 0.15 * fresh + 0.15 * money ELSE -0.05 END), 0.05), 0.97)", "h"),
    "research_affil": "WITH p AS (SELECT source AS company, text AS title, DATE '2024-01-01' + CAST(doc_id % 28 AS INTEGER) AS day FROM documents), k AS (SELECT *, trim(regexp_replace(lower(regexp_replace(title, '[’''`]', '', 'g')), '[^a-z0-9]+', ' ', 'g')) AS key FROM p), o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company, key ORDER BY day, title) AS x FROM k) WHERE x = 1), f AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY day, key) = 1 AS first FROM o) " + _HEAD.format("research_affil", "research", "CASE WHEN first THEN 'company_first_paper' ELSE 'company_papers' END", "company", "day", "1", "CASE WHEN first THEN 0.6 ELSE 0.35 END", "f"),
}
_JOB_SQL |= JOB_SQL
for _slug, _day in {"sec_form_d": "2001-08-01", "fpds_ot": "2001-08-01", "github_velocity": ASOF, "ats_jobs": "2001-08-01", "hn_attention": ASOF, "tranco_rank": ASOF, "domain_footprint": "2001-08-01", "research_affil": ASOF, "fcc_els": "2001-08-01", "faa_uas": "2001-08-01", "nrc_adams": "2001-08-01", "hn_hiring": ASOF, "yc_directory": "2001-08-01"}.items():
    query(f"c_{_slug}", _JOB_SQL.get(_slug))(_job(_slug, _day))


#: Each job once, on one day: those above, and those of the kinds that stand for their job (the others run the same job over other tables).
_KINDS = [n for n in kinds.LANDED if n not in ("c_energy_by_program", "c_trademarks_by_owner", "c_launches_by_kind", "c_listings_by_program")]
_EVERY = [*(v.replace(f"DATE '{ASOF}'", "DATE '2001-08-01'") for v in _JOB_SQL.values()), *(SQL[n] for n in _KINDS)]


@query("u7_all_sources", "SELECT source, kind, count(*) AS n, round(avg(strength), 3) AS strength FROM (" + " UNION ALL ".join(f"SELECT * FROM ({v})" for v in _EVERY) + ") GROUP BY ALL")
def u7_all_sources(spark, sf):
    """Every job's signals of both stages in one table, counted by source and kind; without website_verified, whose table comes from reading pages (c_web_presence)."""
    tables = _tables(spark, sf)
    for n in _KINDS:
        tables |= kinds.LANDED[n](spark, sf)
    rows = None
    for stage in ("discover", "enrich"):
        out, errors = jobs.run(spark, tables, F.to_date(F.lit("2001-08-01")), stage)
        if set(errors) - {"web_presence"}:
            raise ValueError(str(errors))
        rows = out if rows is None else rows.unionByName(out)
    return rows.groupBy("source", "kind").agg(n_rows().alias("n"), F.round(F.avg("strength"), 3).alias("strength"))


@query("c_web_presence")
def c_web_presence(spark, sf):
    """The sites of the given pages, read and matched to the names that their hosts carry."""
    from ..functions.wording import read_pages

    p = table(spark, sf, "pages")
    facts = read_pages(p, "page_id", "html").join(p.select("page_id", "url"), "page_id")
    label = F.substring_index(F.regexp_replace(F.regexp_extract("url", "://([^/?#]*)", 1), r"^(www|blog|m)\.", ""), ".", 1)
    rows = facts.select(label.alias("entity"), F.initcap(label).alias("name"), "url", "title", F.coalesce("site_name", label).alias("site_name"), "h1", "copyright", F.to_date(F.lit(ASOF)).alias("day"))
    return jobs.JOBS["web_presence"][2]({"pages_read": rows}, asof_day()).withColumn("occurred_at", F.col("occurred_at").cast("string"))


@query("x7_sql_functions", f"SELECT event_type, round(1 - product(1 - {sq('value', 50)} / 1000), 6) AS either FROM events GROUP BY 1")
def x7_sql_functions(spark, sf):
    from ..functions.register import register

    register(spark)
    table(spark, sf, "events").createOrReplaceTempView("tallyfold_events")
    either = spark.sql("SELECT event_type, noisy_or(sum(left_of(squash(value, 50) / 1000))) AS either FROM tallyfold_events GROUP BY 1")
    return either.select("event_type", F.round("either", 6).alias("either"))


@query("x8_sql_names", r"""
SELECT regexp_replace(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '^www\.', '') AS domain, CASE WHEN regexp_matches(lower(html), 'privacy') THEN 'legal' WHEN regexp_matches(lower(html), '<table') THEN 'data' ELSE 'page' END AS kind,
  coalesce(nullif(lower(regexp_extract(html, '<title>([A-Za-z]+)', 1)), ''), 'inc') AS name, count(*) AS n
FROM pages WHERE NOT regexp_matches(lower(url), '\.(edu|gov|mil)(/|$)') GROUP BY ALL""")
def x8_sql_names(spark, sf):
    from ..functions.register import register

    register(spark)
    table(spark, sf, "pages").createOrReplaceTempView("tallyfold_pages")
    rules = "array(named_struct('pattern', 'privacy', 'label', 'legal'), named_struct('pattern', '<table', 'label', 'data'))"
    return spark.sql(f"SELECT clean_domain(url) AS domain, classify(html, {rules}, 'page') AS kind, normalize_name(concat(regexp_extract(html, '<title>([A-Za-z]+)', 1), ', Inc.')) AS name, count(*) AS n FROM tallyfold_pages GROUP BY ALL").filter("domain IS NOT NULL")


@query("x7_explode_series", f"{SIG}, g AS (SELECT DISTINCT entity_id, CAST(d AS DATE) AS day FROM signals, (SELECT unnest(generate_series({DAY} - 21, {DAY}, INTERVAL 7 DAY)) AS d)) SELECT g.entity_id, CAST(g.day AS VARCHAR) AS day, arg_max(v, occurred_at) AS v FROM g JOIN (SELECT entity_id, occurred_at, max(value) AS v FROM signals GROUP BY ALL) s ON s.entity_id = g.entity_id AND s.occurred_at <= g.day + 1 GROUP BY ALL")
def x7_explode_series(spark, sf):
    """Each entity's best value a day as a series, read back on four days by the table function."""
    from ..functions.register import register

    register(spark)
    daily = signals(spark, sf).groupBy("entity_id", F.col("occurred_at").alias("t")).agg(F.max("value").alias("v"))
    # A series has a point a day at most.
    daily.groupBy("entity_id").agg(F.collect_list(F.struct("t", "v")).alias("series")).createOrReplaceTempView("tallyfold_series")
    days = ", ".join(f"DATE '{ASOF}' - {k}" for k in (21, 14, 7, 0))
    return spark.sql(f"SELECT entity_id, CAST(day AS STRING) AS day, v FROM tallyfold_series, LATERAL explode_series(series, array({days}))")


_KNOWN = (
    f"c_ AS (SELECT entity_id, round(1 - round(1 - (1 - {over('n * 100', 500, 8000)}) * (1 - {over('n', 5, 120)}), 4), 4) AS earliness FROM (SELECT user_id AS entity_id, count(*) AS n FROM events GROUP BY 1)), "
    f"p_ AS (SELECT conv_id AS entity_id, round(1 - product(pow(0.45, CASE WHEN role = 'user' THEN firsts ELSE 0 END) * pow(0.7, CASE WHEN role = 'user' THEN 0 ELSE firsts END) * (1 - 0.6 * {sq('h', 25)})), 4) AS team FROM (SELECT conv_id, role, least(count(*), 3) AS firsts, max(length(text)) AS h FROM conversations GROUP BY ALL) GROUP BY 1), "
    + texts.classify_ctes("(SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY 1)")
    + ", k AS (SELECT * FROM (SELECT conv_id AS entity_id, fit FROM c) FULL JOIN c_ USING (entity_id) FULL JOIN p_ USING (entity_id))"
)


@query("p4_entity_scores", f"{all_signals(1, _KNOWN, 'coalesce(fit, 0.0) AS fit, coalesce(earliness, 0.8) AS earliness, coalesce(team, 0.0) AS team')} SELECT entity_id, momentum, fit, earliness, team, edge FROM edges")
def p4_entity_scores(spark, sf):
    """The whole score: momentum of all signals, fit from what is written (a conversation of the entity's number), earliness from what was measured, team from the people who speak."""
    c = table(spark, sf, "conversations").withColumn("entity_id", F.col("conv_id"))
    fits = classify_groups(c, ["entity_id"], "text", texts.DICTIONARY, texts.FRIENDS, texts.SURE)
    metrics = table(spark, sf, "events").groupBy(F.col("user_id").alias("entity_id")).agg((n_rows() * 100.0).alias("stars_total"), n_rows().cast("double").alias("hn_mentions_total"))
    user, zero = F.col("role") == "user", F.lit(0)
    people = c.groupBy("entity_id", "role").agg(n_rows().alias("n"), F.max(F.length("text")).alias("h_index"))
    people = people.select("entity_id", F.when(user, F.col("n")).otherwise(zero).alias("tier_one"), F.when(user, zero).otherwise(F.col("n")).alias("other"), "h_index", zero.alias("followers"), F.lit(False).alias("repeat"))
    known = score.factors("entity_id", fits, metrics, people, asof_day())
    s = score.score_entities(measured(spark, sf), ASOF, weeks=1, known=known, defaults={"fit": 0.0, "earliness": 1 - fixed.UNMEASURED, "team": 0.0})
    return s.select("entity_id", "momentum", "fit", F.round("earliness", 4).alias("earliness"), "team", "edge")


# --- streams: the given events replayed, equal to the batch


def _events_stream(spark, sf):
    batch = table(spark, sf, "events")
    return spark.readStream.schema(batch.schema).parquet(f"{sf}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


@query("t1_stream_windows", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def t1_stream_windows(spark, sf):
    counts = stream.windowed_counts(_events_stream(spark, sf), "ts", ["event_type"], "1 day")
    return stream.drained(counts).select(F.to_date("start").cast("string").alias("day"), "event_type", "n")


@query("t7_stream_once", "SELECT event_type, CAST(count(DISTINCT user_id) AS BIGINT) AS n FROM events GROUP BY 1")
def t7_stream_once(spark, sf):
    """Each (type, user) passes once, however often its rows come."""
    e = _events_stream(spark, sf).withColumn("fingerprint", F.concat_ws("|", "event_type", F.col("user_id").cast("string")))
    once = stream.ingested_once(e, "fingerprint", "ts").select("event_type", "fingerprint")
    return stream.drained(once, "append").groupBy("event_type").agg(n_rows().alias("n"))


@query("t8_stream_latest", "SELECT user_id, event_type, max(event_id) AS event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth = 1 GROUP BY ALL")
def t8_stream_latest(spark, sf):
    latest = stream.latest_reading(_events_stream(spark, sf), ["user_id", "event_type"], "ts", ["event_id"])
    return stream.drained(latest).select("user_id", "event_type", "event_id")


@query("t8_stream_first", "SELECT user_id, CAST(CAST(min(ts) AS DATE) AS VARCHAR) AS first_day FROM events GROUP BY 1")
def t8_stream_first(spark, sf):
    first = stream.first_seen(_events_stream(spark, sf), "user_id", "ts")
    return stream.drained(first).select("user_id", F.to_date("first_seen").cast("string").alias("first_day"))
