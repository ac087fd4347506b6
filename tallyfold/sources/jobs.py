"""Source jobs: a landed table becomes signal rows (funnel, history, strength). A registry runs them, and one that fails is recorded, not fatal."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import fixed
from ..operators import history, quality
from ..operators.lineage import cut_lineage
from ..operators.ranking import top_per

Job = Callable[[Mapping[str, DataFrame], Column], DataFrame]
#: By source, or source/kind for further kinds of a source over a landed table of their own: family, stage and job.
JOBS: dict[str, tuple[str, str, Job]] = {}
#: Jobs that are submitted side by side: one's short steps leave cores to the others.
AT_ONCE = 4
SIGNAL = ["source", "family", "kind", "entity", "occurred_at", "value", "strength"]


def source(slug: str, family: str, stage: str = "discover") -> Callable[[Job], Job]:
    def add(f: Job) -> Job:
        JOBS[slug] = (family, stage, f)
        return f

    return add


def made(df: DataFrame, slug: str, kind: Column, entity: str, day: str, value: Column, strength: Column) -> DataFrame:
    return df.select(F.lit(slug).alias("source"), F.lit(JOBS[slug][0]).alias("family"), kind.alias("kind"), F.col(entity).cast("string").alias("entity"), F.col(day).alias("occurred_at"), value.cast("double").alias("value"), F.round(X.clamp(strength, 0.0, 1.0), 6).alias("strength"))


def named(df: DataFrame, name: str, key: Callable[[Column], Column]) -> DataFrame:
    """(name, key, n) of each distinct name, n rows of which have it: patterns run once a name, not once a row."""
    return cut_lineage(df.groupBy(name).agg(F.count(F.lit(1)).alias("n")).withColumn("key", key(F.col(name))), "names")


def run(spark: SparkSession, tables: Mapping[str, DataFrame], asof: Column, stage: str = "discover") -> tuple[DataFrame, dict[str, str]]:
    """Signals of all jobs of a stage, further kinds too, each written when it has run, and by slug what went wrong. Some run side by side; a job that fails, at once or in its data, is recorded and doesn't stop the others."""
    from . import kinds  # noqa: F401  registers its jobs

    def ran(slug: str) -> DataFrame | str:
        try:
            return cut_lineage(JOBS[slug][2](tables, asof).select(*SIGNAL), f"source-{slug.replace('/', '-')}")
        except Exception as e:
            return f"{type(e).__name__}: {e}"[:200]

    slugs = [slug for slug, (_, at, _) in JOBS.items() if at == stage]
    with ThreadPoolExecutor(AT_ONCE) as pool:
        found = dict(zip(slugs, pool.map(inheritable_thread_target(spark)(ran), slugs)))
    out, errors = None, {}
    for slug, rows in found.items():
        if isinstance(rows, str):
            errors[slug] = rows
        else:
            out = rows if out is None else out.unionByName(rows)
    if out is None:
        out = spark.createDataFrame([], "source string, family string, kind string, entity string, occurred_at date, value double, strength double")
    return out, errors


@source("sec_form_d", "capital")
def sec_form_d(tables: Mapping[str, DataFrame], asof: Column) -> DataFrame:
    """filings(firm, day, amount, year_inc, kind_of_entity): young corporations of some size; amendments against their baseline."""
    kept, _ = quality.split_rejects(tables["filings"], [(F.col("kind_of_entity") != "Corporation", "entity type"), (F.col("year_inc").isNull(), "no year"), (F.year("day") - F.col("year_inc") > 5, "old"), (F.col("amount") < 250_000, "small")])
    h = history.previous(history.prior_counts(kept, ["firm"], "day"), ["firm"], [F.col("day"), F.col("amount")], {"before": "amount"})
    size = X.interp(F.log10("amount"), [(5.4, 0.0), (6.0, 0.35), (7.0, 0.75), (8.0, 1.0)])
    youth = X.clamp(1 - (F.year("day") - F.col("year_inc")) / 5, 0.0, 1.0)
    novelty = F.when(F.col("prior") == 0, 1.0).otherwise(1 / (1 + F.col("prior")))
    raised = F.coalesce(F.col("amount") - F.col("before"), F.col("amount"))
    return made(h, "sec_form_d", F.when(F.col("prior") > 0, "form_d_amendment").otherwise("form_d"), "firm", "day", raised, X.clamp(0.15 + 0.66 * size * (0.35 + 0.35 * youth + 0.30 * novelty), 0.15, 0.97))


@source("fpds_ot", "capital")
def fpds_ot(tables: Mapping[str, DataFrame], asof: Column) -> DataFrame:
    """agreements(firm, day, amount, registered): first and later agreements, seen after an embargo."""
    h = history.prior_counts(tables["agreements"], ["firm"], "day").withColumn("public_at", X.public_date(F.col("day"), F.col("day"), asof))
    new = X.clamp(1 - F.datediff("day", "registered") / 1825, 0.0, 1.0)
    money = X.squash(F.col("amount"), 750_000)
    first = F.col("prior") == 0
    strength = 0.18 + 0.25 * new + 0.17 * money + F.when(first, 0.10 + 0.15 * new + 0.15 * money).otherwise(-0.05)
    return made(h, "fpds_ot", F.when(first, "ot_first_award").otherwise("ot_award"), "firm", "public_at", F.col("amount"), X.clamp(strength, 0.05, 0.97))


def sample_factor(young: Column, blank: Column, median_age: Column) -> Column:
    """What a sample of the actors leaves of a strength: over a fifth of accounts under 90 days old take it down to two fifths, mostly blank accounts under a year to three fifths of that. Without a sample all stays."""
    f = F.when(young <= 0.2, 1.0).otherwise(X.clamp(1 - 2 * (young - 0.2), 0.4, 1.0)) * F.when((blank >= 0.7) & (median_age < 365), 0.6).otherwise(1.0)
    return F.when(young.isNotNull(), F.round(f, 3)).otherwise(1.0)


@source("github_velocity", "github")
def github_velocity(tables: Mapping[str, DataFrame], asof: Column) -> DataFrame:
    """stars(owner, repo, and either day or at, a timestamp that falls on its day by Pacific time): repositories that move, dated at their biggest day of the last thirty, of each owner the strongest one. star_samples(owner, repo, young, blank, median_age), where known, discount; an owner with one repository whose stars look bought is left out."""
    from ..operators.figures import velocity_stats
    from ..plans.score import velocity_strength

    stars = tables["stars"]
    if "day" not in stars.columns:
        stars = stars.withColumn("day", F.to_date(F.from_utc_timestamp("at", "America/Los_Angeles")))
    key = F.struct("owner", "repo")
    daily = stars.groupBy(key.alias("key"), "day").agg(F.count("*").alias("n"))
    t = velocity_stats(daily, "key", "day", "n", asof).select("key.*", "*").drop("key")
    if "star_samples" in tables:
        t = t.join(tables["star_samples"], ["owner", "repo"], "left")
    else:
        t = t.withColumns({c: F.lit(None).cast("double") for c in ("young", "blank", "median_age")})
    held = t.filter(quality.bought(F.col("young"), F.col("blank"), F.col("median_age"))).select("owner").distinct()
    moving = quality.moves(F.lit(True), F.lit(100), F.col("n_7d"), F.col("n_30d"), F.col("accel_7d"), F.col("accel_30d"))
    s = velocity_strength(F.col("n_7d"), F.col("prev_7d"), F.col("n_30d"), F.col("prev_30d"), F.col("sustained_weeks")) * sample_factor(F.col("young"), F.col("blank"), F.col("median_age"))
    best = top_per(t.filter(moving & (F.col("n_30d") > 0)).join(held, "owner", "left_anti").withColumn("s", s), ["owner"], [F.desc("s"), F.col("repo")])
    return made(best, "github_velocity", F.lit("star_velocity"), "owner", "peak_date", F.col("n_30d"), F.col("s"))


@source("ats_jobs", "hiring")
def ats_jobs(tables: Mapping[str, DataFrame], asof: Column) -> DataFrame:
    """roles(board, day, hardware): volume, acceleration and the share that is new; a first batch is a board's birth."""
    r = tables["roles"]
    t = history.trailing(r, ["board"], "day", asof, {"n30": (0, 30), "p30": (30, 60), "every": (0, 100_000)}).join(r.groupBy("board").agg(F.avg(F.col("hardware").cast("double")).alias("hardware"), F.max("day").alias("day")), "board")
    birth = history.first_batch(r, ["board"], "day").select("board", "is_birth", "first_day")
    share = F.col("n30") / F.greatest("every", F.lit(1))
    s = 0.10 + 0.36 * X.squash(F.col("n30"), 12) + 0.34 * X.squash(history.acceleration(F.col("n30"), F.col("p30")) - 1, 2) + 0.18 * share + 0.06 * F.col("hardware")
    fresh = F.col("is_birth") & (F.datediff(asof, "first_day") <= 60)
    rows = t.filter("n30 > 0").join(birth, "board")
    return made(rows, "ats_jobs", F.when(fresh, "ats_board_created").otherwise("hiring_velocity"), "board", "day", F.col("n30"), s)


@source("hn_attention", "social", "enrich")
def hn_attention(tables: Mapping[str, DataFrame], asof: Column) -> DataFrame:
    """mentions(entity, day, author, points): a first mention, a rise, or the baseline (strength 0)."""
    age = F.datediff(asof, F.col("day"))
    m = tables["mentions"].groupBy("entity").agg(F.count(F.when(age < 28, 1)).alias("n4"), F.count(F.when(age.between(28, 83), 1)).alias("n8"), F.countDistinct(F.when(age < 28, F.col("author"))).alias("authors"), F.max(F.when(age < 28, F.col("points"))).alias("top"), F.max("day").alias("day"), F.min("day").alias("first_day"), F.count(F.lit(1)).alias("every"))
    lift = F.when(F.col("n8") > 0, F.col("n4") / (F.col("n8") / 2))
    rise = quality.rises(F.col("n4"), F.col("authors"), lift)
    first = F.datediff(asof, F.col("first_day")) < 28
    core = X.noisy_or(X.squash(F.col("n4"), 8), X.squash(F.col("top"), 120))
    damp = 1 - 0.6 * X.squash(F.col("every") - 50, 400)
    s = X.ladder((first, 0.25 + 0.68 * core), (rise, 0.15 + 0.80 * core * damp), otherwise=F.lit(0.0))
    return made(m, "hn_attention", X.ladder((first, "hn_first_mention"), (rise, "hn_attention"), otherwise="hn_baseline"), "entity", "day", F.col("n4"), s)


def _material(ranks: DataFrame, old: str, least_ratio: float) -> DataFrame:
    """(domain, s, ratio) of the domains on both lists that rose more than nine tenths of those that were ranked like them, and by `least_ratio` or more; s by how few did as well."""
    from ..operators.cohorts import cohort_share

    both = ranks.filter(F.col("now").isNotNull() & F.col(old).isNotNull()).select("domain", F.col(old).alias("was"), (F.col(old) / F.col("now")).alias("ratio"))
    c = cohort_share(both, "was", "ratio", "domain", fixed.COHORT_BAND, fixed.COHORT_MIN, fixed.COHORT_MAX)
    tail = F.greatest(1 - F.col("share"), 0.5 / F.col("cohort"))
    return c.filter((F.col("share") >= fixed.MATERIAL_SHARE) & (F.col("ratio") >= least_ratio)).select("domain", X.interp(-F.log10(tail), fixed.MOVE_ANCHORS).alias("s"), "ratio")


@source("tranco_rank", "traffic", "enrich")
def tranco_rank(tables: Mapping[str, DataFrame], asof: Column) -> DataFrame:
    """ranks(list_day, domain, rank) of the newest list and of older ones: moves over a month and over a quarter (lists within three days of those ages) against domains that were ranked alike, and new entrants by how rare these are at their depth. rank_listings(domain, day), where known, says on which days a domain was listed.

    A quarter's move counts while the last month doesn't give it back; both together count more; deep ranks less. An entrant that has been listed for few days, or off and on, counts less, one without listings a little less."""
    from ..operators.cohorts import entrant_rate

    r = tables["ranks"]
    lists = r.agg(F.max("list_day").alias("newest"), F.collect_set("list_day").alias("days"))  # one row, a day a list
    age = F.datediff("newest", "list_day")
    near = lambda d, n: F.datediff("newest", d).between(n - 3, n + 3)
    wide = r.crossJoin(F.broadcast(lists)).groupBy("domain").agg(
        F.min(F.when(age == 0, F.col("rank"))).alias("now"), F.min(F.when(near("list_day", 30), F.col("rank"))).alias("r30"), F.min(F.when(near("list_day", 90), F.col("rank"))).alias("r90"), F.count(F.when(age > 0, 1)).alias("older"),
        F.max("newest").alias("day"), F.max(F.exists("days", lambda d: near(d, 30))).alias("has30"),
    ).filter("now IS NOT NULL")
    wide = cut_lineage(wide, "ranks")
    month, quarter = _material(wide, "r30", fixed.LEAST_RATIO[30]).toDF("domain", "s30", "q30"), _material(wide, "r90", fixed.LEAST_RATIO[90]).toDF("domain", "s90", "q90")
    held = ~F.col("has30") | F.coalesce(F.col("r30") >= F.col("now"), F.lit(False))
    moved = wide.filter("older > 0").join(month, "domain", "left").join(quarter, "domain", "left")
    s30, s90 = F.coalesce("s30", F.lit(0.0)), F.when(held, F.coalesce(F.col("s90") * fixed.STALE_WINDOW, F.lit(0.0))).otherwise(0.0)
    moved = moved.withColumn("a", s30).withColumn("b", s90)
    best = F.greatest("a", "b") + F.when((F.col("a") > 0) & (F.col("b") > 0), fixed.SUSTAINED_MOVE).otherwise(0.0)
    s = F.least(best * X.interp(F.col("now"), fixed.DEPTH_ANCHORS), F.lit(fixed.MOST_MOVE))
    is_move = (F.col("a") > 0) | (F.col("b") > 0)
    value = F.when(is_move, F.when(F.col("a") >= F.col("b"), F.col("q30")).otherwise(F.col("q90"))).otherwise(F.col("r30") / F.col("now"))
    moves = made(moved, "tranco_rank", F.when(is_move, "tranco_rank_move").otherwise("tranco_rank_present"), "domain", "day", value, F.when(is_move, s).otherwise(0.0))
    rated = entrant_rate(wide.withColumn("fresh", F.col("older") == 0), "now", "fresh", "domain", fixed.COHORT_BAND, fixed.COHORT_MIN, fixed.COHORT_MAX).filter("fresh")
    known = X.ladder(*[(F.col("now") <= k, F.lit(v)) for k, v in fixed.ENTRANT_RATES], otherwise=F.lit(fixed.ENTRANT_RATE_DEEP))
    rarity = X.interp(F.log10(F.greatest(F.coalesce("rate", known), F.lit(1e-4))), fixed.ENTRANT_ANCHORS)
    if "rank_listings" in tables:
        seen = tables["rank_listings"].withColumnRenamed("day", "seen").crossJoin(F.broadcast(lists.select("newest"))).filter(F.datediff("newest", "seen").between(0, 29))
        rated = rated.join(seen.groupBy("domain").agg(F.countDistinct("seen").alias("listed"), (F.max(F.datediff("newest", "seen")) + 1).alias("span")), "domain", "left")
    else:
        rated = rated.withColumns({"listed": F.lit(None).cast("long"), "span": F.lit(None).cast("int")})
    stay = F.when(F.col("listed").isNull(), fixed.UNDATED_ENTRY).otherwise((0.6 + 0.4 * F.least(F.lit(1.0), F.col("listed") / F.col("span"))) * X.interp(F.col("listed"), fixed.YOUTH_ANCHORS))
    return moves.unionByName(made(rated, "tranco_rank", F.lit("tranco_new_entrant"), "domain", "day", F.col("now"), X.clamp(rarity * stay, 0.15, fixed.MOST_ENTRANT)))


@source("domain_footprint", "traffic", "enrich")
def domain_footprint(tables: Mapping[str, DataFrame], asof: Column) -> DataFrame:
    """certificates(domain, host, issued, expires): hosts first certified of late weigh more than the inventory."""
    c = tables["certificates"].groupBy("domain", "host").agg(F.min("issued").alias("issued"), F.min_by("expires", F.struct("issued", "expires")).alias("expires"))
    fresh = F.datediff(asof, "issued") <= F.least(F.lit(30.0), F.datediff("expires", "issued") / 3) - 2
    d = c.withColumn("fresh", fresh).groupBy("domain").agg(F.count(F.when(F.col("fresh"), 1)).alias("n_fresh"), F.count(F.lit(1)).alias("n"), F.max("issued").alias("day"))
    s = F.when(F.col("n_fresh") > 0, 0.3 + 0.5 * X.squash(F.col("n_fresh"), 1.5)).otherwise(0.15 + 0.15 * X.squash(F.col("n"), 3))
    return made(d, "domain_footprint", F.when(F.col("n_fresh") > 0, "ct_new_subdomains").otherwise("ct_subdomains"), "domain", "day", F.col("n"), s)


@source("research_affil", "research")
def research_affil(tables: Mapping[str, DataFrame], asof: Column) -> DataFrame:
    """papers(company, title, day, complete): one paper a title, the earliest; the company's first is claimed only if its history is whole."""
    one = top_per(tables["papers"].withColumn("key", X.normalize_name(F.col("title"))), ["company", "key"], [F.col("day"), F.col("title")])
    f = history.first_flag(one, ["company"], [F.col("day"), F.col("key")], F.col("complete"))
    first = F.coalesce(F.col("is_first"), F.lit(False))
    return made(f, "research_affil", F.when(first, "company_first_paper").otherwise("company_papers"), "company", "day", F.lit(1.0), F.when(first, 0.6).otherwise(0.35))


@source("faa_uas", "regulatory")
def faa_uas(tables: Mapping[str, DataFrame], asof: Column) -> DataFrame:
    """declarations(maker, series, day, status): makers with new declarations; more if all series are new."""
    d = tables["declarations"].groupBy("maker", "series").agg(F.min("day").alias("first_day"), F.max("day").alias("day"), F.count(F.when(F.col("status") == "accepted", 1)).alias("accepted"))
    d = d.withColumn("key", X.normalize_name(F.col("maker")))
    series = d.groupBy("key", "series").agg(F.min("first_day").alias("first_day"), F.max("day").alias("day"), F.sum("accepted").alias("accepted"))
    m = series.withColumn("fresh", F.datediff(asof, "first_day") <= 90).groupBy("key").agg(F.max("day").alias("day"), F.sum("accepted").alias("accepted"), F.bool_and("fresh").alias("all_new"), F.count(F.when(F.col("fresh"), 1)).alias("n_new"))
    s = 0.35 + F.when(F.col("all_new"), 0.3).otherwise(0.0) + 0.15 * X.squash(F.col("n_new"), 2)
    return made(m.filter("n_new > 0"), "faa_uas", F.lit("faa_remote_id_doc"), "key", "day", F.col("accepted"), X.clamp(s, 0.15, 0.95))


@source("nrc_adams", "regulatory")
def nrc_adams(tables: Mapping[str, DataFrame], asof: Column) -> DataFrame:
    """papers_filed(docket, party, day, kind, package): one of a package, one of a kind and day; a docket's first makes it opened; two of a kind and four of a company at most."""
    p = top_per(tables["papers_filed"], ["package"], [F.col("day"), F.col("kind"), F.col("docket"), F.col("party")])
    p = top_per(p, ["docket", "kind", "day"], [F.col("package"), F.col("party")])
    f = history.first_flag(p, ["docket"], [F.col("day"), F.col("package")])
    age = F.datediff(asof, "day")
    fade = X.ladder((age <= 90, F.lit(1.0)), (age <= 180, F.lit(0.85)), otherwise=F.lit(0.7))
    scored = f.withColumn("s", F.when(F.col("is_first"), 0.85).otherwise(0.4 * fade))
    kept = top_per(top_per(scored, ["party", "kind"], [F.desc("s"), F.desc("day"), F.col("package")], 2), ["party"], [F.desc("s"), F.desc("day"), F.col("package")], 4)
    return made(kept, "nrc_adams", F.when(F.col("is_first"), "nrc_preapp_docket_opened").otherwise("nrc_preapp_activity"), "party", "day", F.lit(1.0), F.col("s"))


@source("hn_hiring", "hiring")
def hn_hiring(tables: Mapping[str, DataFrame], asof: Column) -> DataFrame:
    """hiring_posts(company, thread, day, team_size, fit, complete): the earliest post of a company and thread; a first one counts most, small teams more."""
    one = top_per(tables["hiring_posts"], ["company", "thread"], [F.col("day"), F.col("team_size").asc_nulls_last(), F.desc("fit"), F.col("complete")])
    h = history.prior_counts(one, ["company"], "day")
    first = (F.col("prior") == 0) & F.col("complete")
    s = 0.15 + X.ladder((first, F.lit(0.36)), (F.col("prior") <= 2, F.lit(0.20)), otherwise=F.lit(0.0)) + 0.30 * (1 - X.squash(F.col("team_size"), 15)) * F.col("team_size").isNotNull().cast("int") + 0.1 * F.col("fit")
    return made(h, "hn_hiring", F.lit("hn_hiring_post"), "company", "day", F.col("prior"), X.clamp(s, 0.0, 0.95))


@source("yc_directory", "launch")
def yc_directory(tables: Mapping[str, DataFrame], asof: Column) -> DataFrame:
    """launches(company, day, votes): ordinal of the launch, and how its votes stand among those of the same month."""
    from ..operators.ranking import share_below

    nth = cut_lineage(history.ordinal(tables["launches"], ["company"], "day"), "launches")
    ranked = share_below(nth.withColumn("month", F.trunc("day", "month")), ["month"], "votes")
    s = X.interp(F.log1p("votes"), [(0.0, 0.15), (3.0, 0.4), (5.0, 0.7), (7.0, 0.9)]) * F.when(F.col("nth") > 1, 0.7).otherwise(1.0) + 0.05 * F.col("share_below")
    return made(ranked, "yc_directory", F.lit("yc_launch"), "company", "day", F.col("votes"), s)


@source("web_presence", "traffic", "enrich")
def web_presence(tables: Mapping[str, DataFrame], asof: Column) -> DataFrame:
    """pages_read(entity, name, url, title, site_name, h1, copyright, day): the one site of an entity whose page speaks for it; a baseline of strength 0."""
    from ..operators.matching import accepted, site_score

    p = tables["pages_read"].withColumn("host", X.host_of(F.col("url")))
    key = X.normalize_name(F.col("name"))
    says = lambda c: F.coalesce(X.normalize_name(F.col(c)).contains(key), F.lit(False))
    slots = says("title").cast("int") + says("site_name").cast("int") + says("h1").cast("int")
    label = F.substring_index("host", ".", 1)
    domain = X.ladder((label == F.replace(key, F.lit(" "), F.lit("")), F.lit(2)), (X.owns_domain(F.col("name"), F.col("host")), F.lit(1)), otherwise=F.lit(0))
    score = site_score(says("site_name"), slots, says("copyright"), domain, says("title"), F.lit(0))
    found = accepted(p, "entity", "host", score, F.when(F.length(key) < 5, 0.85).otherwise(0.75)).join(p.groupBy("entity", "host").agg(F.max("day").alias("day")), ["entity", "host"])
    return made(found, "web_presence", F.lit("website_verified"), "entity", "day", F.col("score"), F.lit(0.0))
