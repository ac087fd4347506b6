"""Further kinds of the source jobs over the given tables, read as their landed ones. A stand-in says which column plays which part; the rules are the jobs' own."""

from pyspark.sql import functions as F

from ..catalog import query
from ..sources import jobs, kinds
from ..sources.views import awards, table
from .sqltext import AW, sq

ASOF_AWARDS = "2001-08-01"
_DAY = f"DATE '{ASOF_AWARDS}'"


def job_sql(slug: str, family: str, kind: str, entity: str, day: str, value: str, strength: str, source: str) -> str:
    return f"SELECT '{slug}' AS source, '{family}' AS family, {kind} AS kind, CAST({entity} AS VARCHAR) AS entity, CAST({day} AS VARCHAR) AS occurred_at, CAST({value} AS DOUBLE) AS value, round(least(greatest({strength}, 0.0), 1.0), 6) AS strength FROM {source}"


def _clamp(x: str, low: float, high: float) -> str:
    return f"least(greatest({x}, {low}), {high})"


#: By query: what makes the landed tables of its job from the given ones.
LANDED = {}


def landed(name, job, sql):
    """Registers a query that runs a job over the tables that the function below makes."""

    def add(build):
        def run(spark, sf):
            rows = jobs.JOBS[job][2](build(spark, sf), F.to_date(F.lit(ASOF_AWARDS))).select(*jobs.SIGNAL)
            return rows.withColumn("occurred_at", F.col("occurred_at").cast("string"))

        run.__doc__ = build.__doc__ or jobs.JOBS[job][2].__doc__
        query(name, sql)(run)
        LANDED[name] = build
        return build

    return add


def _one_of(xs, k):
    return F.element_at(F.array(*[F.lit(x) for x in xs]), (k % len(xs) + 1).cast("int"))


def _one_of_sql(xs, k: str) -> str:
    said = ", ".join(f"'{x}'" for x in xs)
    return f"([{said}])[{k} % {len(xs)} + 1]"


_PRIOR = "count(*) OVER (PARTITION BY firm ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)"
_TEAM = "CASE WHEN staff IS NULL THEN 0 WHEN staff <= 10 THEN 0.08 WHEN staff <= 50 THEN 0.02 WHEN staff <= 250 THEN -0.10 ELSE -0.22 END"
_REPEAT = "CASE WHEN prior <= 2 THEN 0.50 WHEN prior <= 9 THEN 0.40 WHEN prior <= 24 THEN 0.28 ELSE 0.18 END + CASE WHEN staff > 250 THEN -0.03 ELSE 0 END"
_GAP = _clamp("(fit - 0.465) * CASE WHEN fit - 0.465 >= 0 THEN 0.33 ELSE 0.6 END", -0.1, 0.1)
_AWARD = f"CASE WHEN NOT whole THEN 0.42 WHEN prior = 0 THEN 0.70 + {_TEAM} ELSE {_REPEAT} END + {_GAP}"
_GRANTED = f"{AW}, h AS (SELECT *, {_PRIOR} AS prior, firm % 11 <> 0 AS whole, CASE WHEN award_id % 4 > 0 THEN award_id % 400 END AS staff, (award_id % 100) / 100 AS fit FROM awards) "


@landed("c_afwerx_order", "sbir_awards/afwerx_order", _GRANTED + job_sql("sbir_awards", "capital", "'afwerx_order'", "firm", "day", "amount", _clamp(f"{_AWARD} - 0.05", 0.15, 0.97), "h"))
def c_afwerx_order(spark, sf):
    return {"small_orders": _grants(spark, sf)}


@landed("c_sbir_awards", "sbir_awards", _GRANTED + job_sql("sbir_awards", "capital", "'sbir_phase1'", "firm", "day", "amount", _clamp(_AWARD, 0.15, 0.97), "h"))
def c_sbir_awards(spark, sf):
    return {"grants": _grants(spark, sf)}


def _grants(spark, sf):
    k, f = F.col("award_id"), F.col("firm")
    return awards(spark, sf).select("firm", "day", "amount", (f % 11 != 0).alias("complete"), F.when(k % 4 > 0, k % 400).alias("employees"), (k % 100 / 100).alias("fit"))


_PROGRAMS = ["nsf_sbir_phase1", "nsf_sttr_phase1", "nsf_sbir_fast_track", "nsf_sttr_fast_track", "arpa_e_project"]
_EVENTS = ["selected", "started", "announced earlier"]
_ARPA = _clamp(f"CASE event WHEN 'selected' THEN 0.45 WHEN 'started' THEN 0.40 ELSE 0.35 END + 0.25 * {sq('amount', 3000000)} + CASE WHEN prior = 0 THEN (CASE WHEN event = 'announced earlier' THEN 0.10 ELSE 0.20 END) WHEN prior >= 2 THEN -0.10 ELSE 0 END", 0.15, 0.95)
_NSF = "0.38 + (CASE WHEN contains(program, 'fast_track') THEN 0.15 ELSE 0 END) + (CASE WHEN prior = 0 THEN 0.07 WHEN prior >= 3 THEN -0.10 ELSE 0 END)"
_SEEN = "CASE WHEN award_id % 6 > 0 THEN day + CAST(award_id % 90 AS INTEGER) ELSE day END"


_BY_PROGRAM = "h AS (SELECT *, count(*) OVER (PARTITION BY firm, program ORDER BY seen RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING) AS prior FROM e) " + job_sql("energy_grants", "capital", "program", "firm", "seen", "amount", f"CASE WHEN program = 'arpa_e_project' THEN {_ARPA} ELSE {_NSF} END", "h")


@landed("c_energy_by_program", "energy_grants", f"{AW}, e AS (SELECT firm, amount, {_one_of_sql(_PROGRAMS, 'award_id')} AS program, {_one_of_sql(_EVENTS, 'firm')} AS event, {_SEEN} AS seen FROM awards), {_BY_PROGRAM}")
def c_energy_by_program(spark, sf):
    k = F.col("award_id")
    released = F.when(k % 6 > 0, F.date_add("day", (k % 90).cast("int")))
    rows = awards(spark, sf).select("firm", "day", released.alias("released"), "amount", _one_of(_PROGRAMS, k).alias("program"), _one_of(_EVENTS, F.col("firm")).alias("event"))
    return {"energy_awards": rows}


@landed("c_energy_grants", "energy_grants", f"{AW}, e AS (SELECT firm, amount, {_one_of_sql(_PROGRAMS, 'award_id // 5')} AS program, {_one_of_sql(_EVENTS, 'firm')} AS event, day + CAST(firm % 60 AS INTEGER) AS seen FROM awards WHERE award_id % 4 <> 0), {_BY_PROGRAM}")
def c_energy_grants(spark, sf):
    """Every fourth contract is on another award list already."""
    a, k = awards(spark, sf), F.col("award_id")
    rows = a.select("firm", "day", F.date_add("day", (F.col("firm") % 60).cast("int")).alias("released"), "amount", _one_of(_PROGRAMS, F.floor(k / 5)).alias("program"), _one_of(_EVENTS, F.col("firm")).alias("event"), F.concat(F.lit("DE-"), k.cast("string")).alias("award"))
    return {"energy_awards": rows, "other_contracts": a.filter(k % 4 == 0).select(F.concat(F.lit("de "), k.cast("string")).alias("contract"))}


_WAIVER = f"CASE WHEN sight AND many THEN 0.56 WHEN sight THEN 0.45 WHEN many THEN 0.40 ELSE 0.27 END + CASE WHEN award_id % 5 = 0 AND (sight OR many) THEN 0.05 ELSE 0 END - CASE WHEN award_id % 200 < 90 THEN 0.1 ELSE 0 END - 0.06 * {sq('others', 3)} + CASE WHEN firm % 4 = 0 THEN 0.05 ELSE 0 END"


@landed("c_faa_waivers", "faa_uas/faa_part107_waiver", f"{AW}, w AS (SELECT *, 'holder ' || firm AS key, award_id % 2 = 0 AS sight, award_id % 3 = 0 AS many, count(*) OVER (PARTITION BY firm) - 1 AS others FROM awards) " + job_sql("faa_uas", "regulatory", "'faa_part107_waiver'", "key", "day", "others + 1", _clamp(f"least({_WAIVER}, CASE WHEN firm % 7 = 0 OR firm % 3 = 0 THEN 0.3 WHEN firm % 3 = 1 THEN 0.5 ELSE 0.8 END)", 0.15, 0.8), "w"))
def c_faa_waivers(spark, sf):
    k, f = F.col("award_id"), F.col("firm")
    w = awards(spark, sf).select(
        F.concat(F.lit("Holder "), f.cast("string"), F.lit(", LLC")).alias("holder"), "day", F.date_add("day", (k % 200).cast("int")).alias("until"), (k % 2 == 0).alias("beyond_sight"), (k % 3 == 0).alias("many_aircraft"),
        (k % 5 == 0).alias("over_people"), (f % 3).alias("cue"), (f % 7 == 0).alias("service"), (f % 4 == 0).alias("maker"),
    )
    return ({"waivers": w})


_SCOPES = ["goods", "related", "software", "services"]
_MARKS = f"""{AW}, m AS (SELECT firm, day, CASE WHEN award_id % 5 > 0 THEN priority || award_id % 7 END AS mark,
  CASE WHEN award_id % 5 = 0 THEN NULL WHEN award_id % 5 < 3 THEN '1b' WHEN award_id % 5 = 3 THEN '1a' ELSE '44d' END AS basis,
  {_one_of_sql(_SCOPES, 'award_id')} AS scope, (award_id % 70) / 100 + 0.3 AS fit, day >= {_DAY} - 180 AS fresh FROM awards),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY firm ORDER BY day DESC, mark NULLS LAST, basis NULLS LAST, scope, fit DESC) AS x FROM m WHERE fresh) WHERE x = 1),
b AS (SELECT firm, bool_or(coalesce(basis = '1b', false)) AS intended, avg(CASE WHEN basis = '1b' THEN 1.0 ELSE 0.0 END) AS share,
  CASE WHEN bool_or(scope = 'goods') THEN 0.15 WHEN bool_or(scope = 'related') THEN 0.09 WHEN bool_or(scope = 'software') THEN 0.05 ELSE 0.0 END AS worth, bool_or(scope = 'goods') AS goods, max(fit) AS best,
  bool_or(coalesce(basis = '44d', false)) AS abroad, count(DISTINCT lower(mark)) + max(CASE WHEN mark IS NULL THEN 1 ELSE 0 END) AS brands FROM m WHERE fresh GROUP BY 1),
o AS (SELECT firm, count(*) FILTER (WHERE NOT fresh) AS before, min(day) AS first_day FROM m GROUP BY 1),
h AS (SELECT l.firm, l.day, l.basis, b.* EXCLUDE (firm), o.before, o.first_day FROM l JOIN b ON b.firm = l.firm JOIN o ON o.firm = l.firm) """
_FILED = f"0.12 + CASE WHEN intended THEN 0.07 ELSE 0 END + CASE WHEN before = 0 THEN 0.09 WHEN date_diff('day', first_day, {_DAY}) <= 1095 AND before <= 5 THEN 0.04 ELSE 0 END + worth + 0.24 * {sq('brands - 1', 2)} + 0.10 * (best - 0.3) / 0.7 + CASE WHEN before = 0 AND share > 0.5 AND goods AND brands >= 3 AND NOT abroad THEN 0.14 ELSE 0 END - CASE WHEN abroad THEN 0.08 ELSE 0 END - 0.20 * {sq('before', 8)}"


_BY_OWNER = _MARKS + job_sql("uspto_trademarks", "regulatory", "CASE basis WHEN '1b' THEN 'trademark_intent_to_use' WHEN '1a' THEN 'trademark_in_use' ELSE 'trademark_filing' END", "firm", "day", "brands", _clamp(_FILED, 0.15, 0.97), "h")


@landed("c_uspto_trademarks", "uspto_trademarks", _BY_OWNER)
@landed("c_trademarks_by_owner", "uspto_trademarks", _BY_OWNER)
def c_trademarks_by_owner(spark, sf):
    return {"filings_of_marks": _marks(spark, sf)}


def _marks(spark, sf):
    k = F.col("award_id")
    mark = F.when(k % 5 > 0, F.concat("priority", (k % 7).cast("string")))
    basis = F.when(k % 5 == 0, None).when(k % 5 < 3, "1b").when(k % 5 == 3, "1a").otherwise("44d")
    return awards(spark, sf).select(F.col("firm").alias("owner"), "day", mark.alias("mark"), basis.alias("basis"), _one_of(_SCOPES, k).alias("scope"), (k % 70 / 100 + 0.3).alias("fit"))


_OWNERS = ", n AS (SELECT firm, count(DISTINCT CASE WHEN fresh THEN lower(mark) END) + max(CASE WHEN fresh AND mark IS NULL THEN 1 ELSE 0 END) AS brands, count(*) AS n FROM m GROUP BY 1) SELECT firm AS owner, n, before, CAST(first_day AS VARCHAR) AS first_day, CAST(brands AS BIGINT) AS brands FROM n JOIN o USING (firm)"


@query("g11_g17_owner_history", _MARKS.rstrip() + _OWNERS)
def g11_g17_owner_history(spark, sf):
    h = kinds.owner_history(_marks(spark, sf), F.date_sub(F.to_date(F.lit(ASOF_AWARDS)), 180))
    return h.select("owner", "n", "before", F.col("first_day").cast("string").alias("first_day"), F.col("brands").cast("long").alias("brands"))


@landed("c_new_org_repo", "github_velocity/new_org_repo", f"{AW}, r AS (SELECT firm, award_id, day, day - CAST(award_id % 700 AS INTEGER) AS made, award_id % 30 AS people, award_id % 900 AS stars FROM awards WHERE award_id % 700 <= 365 AND firm % 5 > 0 AND award_id % 30 >= 2), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY firm ORDER BY day, award_id) AS x FROM r) WHERE x = 1) " + job_sql("github_velocity", "github", "'new_org_repo'", "firm", "day", "people", _clamp(f"0.25 + 0.20 * {sq('people - 1', 4)} + 0.20 * {sq('stars', 400)} + CASE WHEN date_diff('day', made, {_DAY}) <= 180 THEN 0.06 ELSE 0 END + CASE WHEN firm % 2 = 0 THEN 0.03 ELSE 0 END + CASE WHEN firm % 3 = 0 THEN 0.03 ELSE 0 END + CASE WHEN firm % 6 >= 3 THEN 0.04 ELSE 0 END + 0.03", 0.2, 0.92), "f"))
def c_new_org_repo(spark, sf):
    k, f = F.col("award_id"), F.col("firm")
    r = awards(spark, sf).select(
        f.alias("owner"), k.alias("repo"), F.date_sub("day", (k % 700).cast("int")).alias("org_created"), F.col("day").alias("created"), (k % 30).alias("contributors"), (k % 900).alias("stars"),
        (f % 5 > 0).alias("own_domain"), (f % 3 == 0).alias("mail_on_domain"), (f % 2 == 0).alias("has_handle"), (f % 6).alias("repos"),
    )
    return ({"repos": r})


_STORY = f"0.15 + 0.75 * {sq('points + 0.5 * comments', 60)}"
STORIES_SQL = r"""WITH p AS (SELECT regexp_extract(url, '://([^/]+)', 1) AS entity, DATE '2024-01-01' + CAST(page_id % 30 AS INTEGER) AS day, url, page_id % 97 AS points, page_id % 13 AS comments, length(url) % 2 = 0 AS launch, length(url) % 3 AS prior,
  regexp_replace(regexp_replace(regexp_replace(url, '^https?://(www\.)?', ''), '#.*$', ''), '/+(\?|$)', '\1') AS bare FROM pages),
k AS (SELECT *, lower(string_split(bare, '?')[1] || CASE WHEN q = '' THEN '' ELSE '?' || q END) AS page FROM (SELECT *, array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT string_split(x, '=')[1] IN ('utm_source', 'ref'))), '&') AS q FROM p)),
b AS (SELECT *, row_number() OVER (PARTITION BY entity, page ORDER BY points DESC, day, comments DESC, url) AS x, count(*) OVER (PARTITION BY entity, page) AS posted FROM k) """


_BY_STORY = STORIES_SQL + job_sql("hn_launch", "launch", "CASE WHEN launch THEN 'launch_hn' ELSE 'show_hn' END", "entity", "day", "posted", f"least((CASE WHEN launch THEN greatest({_STORY} + 0.05, 0.40) ELSE {_STORY} END) + CASE WHEN prior = 0 AND points >= 20 THEN 0.07 ELSE 0 END, 0.97)", "b WHERE x = 1")


@landed("c_hn_launch", "hn_launch", _BY_STORY)
@landed("c_launches_by_kind", "hn_launch", _BY_STORY)
def c_launches_by_kind(spark, sf):
    """Launches and shows; the value is how often the page was posted (U11)."""
    k = F.col("page_id")
    p = table(spark, sf, "pages").select(F.regexp_extract("url", "://([^/]+)", 1).alias("entity"), F.date_add(F.to_date(F.lit("2024-01-01")), (k % 30).cast("int")).alias("day"), "url", (k % 97).alias("points"), (k % 13).alias("comments"), (F.length("url") % 2 == 0).alias("is_launch"), (F.length("url") % 3).alias("prior"))
    return ({"stories": p})


_AREAS = ["thesis", "industrials", "other"]


@landed("c_yc_batch", "yc_directory/yc_batch", f"{AW}, l AS (SELECT *, row_number() OVER (PARTITION BY firm ORDER BY day, award_id % 100 DESC, award_id % 5 DESC, area, award_id % 2 = 0) AS x FROM (SELECT *, {_one_of_sql(_AREAS, 'firm')} AS area FROM awards)) " + job_sql("yc_directory", "launch", "'yc_batch'", "firm", "day", "award_id % 5", "CASE WHEN firm % 4 > 0 THEN least(0.13 + 0.2 * (award_id % 100) / 100 + CASE area WHEN 'thesis' THEN 0.12 WHEN 'industrials' THEN 0.06 ELSE 0 END + CASE WHEN award_id % 2 = 0 THEN 0.1 ELSE 0 END + 0.03 * least(award_id % 5, 3), 0.64) ELSE 0.15 + 0.1 * (award_id % 100) / 100 END", "l WHERE x = 1"))
def c_yc_batch(spark, sf):
    k, f = F.col("award_id"), F.col("firm")
    rows = awards(spark, sf).select(f.alias("company"), "day", (k % 100 / 100).alias("fit"), _one_of(_AREAS, f).alias("area"), (k % 2 == 0).alias("hard"), (k % 5).alias("tags"), (f % 4 > 0).alias("own_words"))
    return ({"listings": rows})


_RUN = _clamp(f"0.02 + 0.46 * fit + 0.05 * least(labels, 2) + CASE WHEN hard THEN 0.07 ELSE 0 END + CASE WHEN founded >= year({_DAY}) - 1 THEN 0.03 ELSE 0 END", 0.15, 0.72)
_HAX = "least(0.22 + 0.28 * fit + CASE WHEN cohort = year(day) THEN 0.08 ELSE 0 END + CASE WHEN founded >= year(day) - 2 THEN 0.04 ELSE 0 END, 0.7)"


_LISTED = "CASE WHEN program = 'speedrun' THEN 'speedrun_cohort' ELSE 'hax_company' END"
_WORTH = f"CASE WHEN program = 'speedrun' THEN {_RUN} WHEN coalesce(year(day) - cohort >= 2, false) THEN least({_HAX}, 0.3) ELSE {_HAX} END"
_POSTS = """g AS (SELECT award_id, firm, day, CASE WHEN firm % 2 = 0 THEN 'speedrun' ELSE 'hax' END AS program, (award_id % 100) / 100 AS fit, award_id % 4 AS labels, award_id % 3 = 0 AS hard, CASE WHEN award_id % 5 > 0 THEN {since} + award_id % 9 END AS founded, CASE WHEN award_id % 7 > 0 THEN year(day) - award_id % 4 END AS cohort, {company} AS company FROM awards),
v AS (SELECT company, arg_max(firm, (day, award_id)) AS name, min(founded) AS oldest, count(*) AS n FROM g GROUP BY 1),
f AS (SELECT g.*, v.name, v.n, v.oldest, row_number() OVER (PARTITION BY g.company ORDER BY day, fit DESC, labels DESC, hard, founded NULLS FIRST, cohort NULLS FIRST, award_id) AS x FROM g JOIN v USING (company)) """


@landed("c_listings_by_program", "accelerators", f"{AW}, " + _POSTS.format(since=1993, company="firm") + job_sql("accelerators", "launch", _LISTED, "name", "day", "n", _WORTH, "f WHERE x = 1"))
def c_listings_by_program(spark, sf):
    return {"cohort_posts": _posts(spark, sf, 1993, F.lit(None).cast("long"))}


@landed("c_accelerators", "accelerators", f"{AW}, " + _POSTS.format(since=1991, company="CASE WHEN firm % 2 = 0 THEN 'p' || firm // 4 ELSE 'f' || firm END") + job_sql("accelerators", "launch", _LISTED, "name", "day", "n", _WORTH, "f WHERE x = 1 AND (oldest IS NULL OR 2001 - oldest <= 8)"))
def c_accelerators(spark, sf):
    """Firms of even number have portal ids, two firms each."""
    return {"cohort_posts": _posts(spark, sf, 1991, F.when(F.col("firm") % 2 == 0, F.floor(F.col("firm") / 4)))}


def _posts(spark, sf, since, portal):
    k, f = F.col("award_id"), F.col("firm")
    return awards(spark, sf).select(k.alias("post"), portal.alias("portal_id"), f.cast("string").alias("slug"), F.when(f % 2 == 0, "speedrun").otherwise("hax").alias("program"), "day", (k % 100 / 100).alias("fit"), (k % 4).alias("labels"), (k % 3 == 0).alias("hard"), F.when(k % 5 > 0, since + k % 9).alias("founded"), F.when(k % 7 > 0, F.year("day") - k % 4).alias("cohort_year"))


_RECORDS = f"""{AW}, r AS (SELECT firm, min(day) AS registered, bool_and(award_id % 2 = 0) AS project FROM awards WHERE firm % 3 > 0 GROUP BY 1),
d AS (SELECT a.firm, bool_or(award_id % 11 = 0) AS mail, bool_or(award_id % 13 = 0) AS dns, bool_or(award_id % 17 = 0) AS sender, date_diff('day', any_value(registered), {_DAY}) AS age FROM awards a LEFT JOIN r ON r.firm = a.firm GROUP BY 1),
t AS (SELECT firm, count(*) AS n, sum(weight) AS weight, bool_or(telling) AS telling FROM (SELECT firm, priority, max(award_id % 10) / 10 AS weight, bool_or(award_id % 6 = 0) AS telling FROM awards GROUP BY ALL) GROUP BY 1) """
_KINDS_OF_RECORDS = [
    job_sql("domain_footprint", "traffic", "'domain_registered'", "firm", "registered", f"date_diff('day', registered, {_DAY})", "CASE WHEN project THEN 0.35 ELSE 0.45 END", f"r WHERE date_diff('day', registered, {_DAY}) BETWEEN 0 AND 60"),
    job_sql("domain_footprint", "traffic", "'dns_govcloud'", "firm", _DAY, "NULL", "CASE WHEN mail AND dns THEN 0.40 WHEN mail THEN 0.35 WHEN dns THEN 0.30 ELSE 0.25 END + CASE WHEN age <= 1825 THEN 0.05 ELSE 0 END", "d WHERE mail OR dns OR sender"),
    job_sql("domain_footprint", "traffic", "'dns_tooling'", "firm", _DAY, "n", f"0.15 + 0.15 * {sq('weight', 2)}", "t WHERE telling"),
]


@landed("c_domain_records", "domain_footprint/records", _RECORDS + " UNION ALL ".join(_KINDS_OF_RECORDS))
def c_domain_records(spark, sf):
    a, k, f = awards(spark, sf), F.col("award_id"), F.col("firm")
    return ({
        "registrations": a.filter(f % 3 > 0).select(f.alias("domain"), F.col("day").alias("registered"), (k % 2 == 0).alias("project")),
        "dns": a.select(f.alias("domain"), (k % 11 == 0).alias("mail"), (k % 13 == 0).alias("dns"), (k % 17 == 0).alias("sender")),
        "dns_tools": a.select(f.alias("domain"), F.col("priority").alias("tool"), (k % 10 / 10).alias("weight"), (k % 6 == 0).alias("telling")),
    })


@landed("c_hf_papers", "research_affil/hf_paper_with_org", f"{AW}, p AS (SELECT firm, 'paper ' || award_id % 50 AS key, award_id % 300 AS upvotes, award_id % 7 * 100 AS stars, day FROM awards WHERE award_id % 100 >= 55), f AS (SELECT *, row_number() OVER (PARTITION BY firm, key ORDER BY upvotes DESC, stars DESC, day) AS x FROM p) " + job_sql("research_affil", "research", "'hf_paper_with_org'", "firm", "day", "upvotes", f"least(0.18 + 0.5 * {sq('upvotes', 60)} + 0.2 * {sq('stars', 400)}, 0.8)", "f WHERE x = 1"))
def c_hf_papers(spark, sf):
    k = F.col("award_id")
    rows = awards(spark, sf).select(F.col("firm").alias("org"), F.concat(F.lit("Paper: "), (k % 50).cast("string")).alias("title"), "day", (k % 300).alias("upvotes"), (k % 7 * 100).alias("stars"), (k % 100 / 100).alias("fit"))
    return ({"claimed_papers": rows})


@landed("c_website_described", "web_presence/website_described", "WITH p AS (SELECT regexp_extract(url, '://([^/]+)', 1) AS entity, url, DATE '2024-01-01' + CAST(page_id % 30 AS INTEGER) AS day, regexp_extract(html, '<h1>([^<]*)', 1) AS said FROM pages WHERE page_id % 3 > 0), f AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY length(said) DESC, url, day DESC) AS x FROM p WHERE length(trim(said)) >= 20) " + job_sql("web_presence", "traffic", "'website_described'", "entity", "day", "length(said)", "0.0", "f WHERE x = 1"))
def c_website_described(spark, sf):
    k = F.col("page_id")
    rows = table(spark, sf, "pages").select(F.regexp_extract("url", "://([^/]+)", 1).alias("entity"), "url", F.date_add(F.to_date(F.lit("2024-01-01")), (k % 30).cast("int")).alias("day"), F.regexp_extract("html", "<h1>([^<]*)", 1).alias("said"), F.when(k % 3 == 0, "known").alias("known"))
    return ({"descriptions": rows})
