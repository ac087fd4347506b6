"""Sources whose kinds have scales of their own, and further kinds of the other sources: each a job over a landed table, with what its rows are worth."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import fixed
from ..operators import history
from ..operators.ranking import top_per
from ..operators.resolve import hard_links
from .jobs import JOBS, Job, made, named, source

Tables = Mapping[str, DataFrame]


def kind(slug: str, name: str) -> Callable[[Job], Job]:
    """A further kind of a source, run with its stage."""

    def add(f: Job) -> Job:
        JOBS[f"{slug}/{name}"] = (*JOBS[slug][:2], f)
        return f

    return add


def given(df: DataFrame, **kinds: str) -> DataFrame:
    """df with the named columns; those that it lacks are null."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items() if c not in df.columns})


def either(c: Column, yes: float, no: float = 0.0) -> Column:
    return F.when(F.coalesce(c, F.lit(False)), F.lit(yes)).otherwise(F.lit(no))


def upto(x: Column, steps: list[tuple[float, float]], beyond: float) -> Column:
    """The value of the first step that x doesn't pass."""
    return X.ladder(*[(x <= k, F.lit(v)) for k, v in steps], otherwise=F.lit(beyond))


def grant_strength(prior: Column, whole: Column, employees: Column, fit: Column, order: Column) -> Column:
    """A firm's first award counts most, more for a small team; where its history isn't whole, less is claimed; title fit beyond or short of one keyword moves it by a tenth at most, and a small open order counts less."""
    first = whole & (prior == 0)
    team = F.when(employees.isNull(), 0.0).otherwise(upto(employees, fixed.SBIR_TEAM, fixed.SBIR_LARGE_TEAM))
    repeat = upto(prior, fixed.SBIR_REPEAT, fixed.SBIR_MANY) + either(employees > 250, fixed.SBIR_LARGE_REPEAT)
    base = X.ladder((~whole, F.lit(fixed.SBIR_UNCLEAR)), (first, fixed.SBIR_FIRST + team), otherwise=repeat)
    gap = fit - F.lit(fixed.SBIR_ONE_KEYWORD)
    moved = F.when(fit.isNotNull(), X.clamp(gap * F.when(gap >= 0, 0.33).otherwise(0.6), -0.10, 0.10)).otherwise(0.0)
    return X.clamp(base + moved + either(order, fixed.SBIR_ORDER), 0.15, 0.97)


@source("sbir_awards", "capital")
def sbir_awards(tables: Tables, asof: Column) -> DataFrame:
    """grants(firm, day, amount, complete, and where known employees, fit): a firm's first award counts most, the more the smaller its team; where its history isn't whole, less is claimed."""
    h = history.prior_counts(given(tables["grants"], employees="int", fit="double"), ["firm"], "day")
    return made(h, "sbir_awards", F.lit("sbir_phase1"), "firm", "day", F.col("amount"), grant_strength(F.col("prior"), F.col("complete"), F.col("employees"), F.col("fit"), F.lit(False)))


@kind("sbir_awards", "afwerx_order")
def afwerx_order(tables: Tables, asof: Column) -> DataFrame:
    """small_orders(firm, day, amount, complete, employees, fit): open-topic orders, worth what a grant is, less a little."""
    h = history.prior_counts(tables["small_orders"], ["firm"], "day")
    s = grant_strength(F.col("prior"), F.col("complete"), F.col("employees"), F.col("fit"), F.lit(True))
    return made(h, "sbir_awards", F.lit("afwerx_order"), "firm", "day", F.col("amount"), s)


def energy_strength(program: Column, prior: Column, amount: Column, event: Column) -> Column:
    """Grants by program and history; projects of the energy agency by what happened, their size and whether they are the firm's first."""
    nsf = fixed.NSF_BASE + either(program.contains("fast_track"), fixed.NSF_FAST_TRACK) + X.ladder((prior == 0, F.lit(fixed.NSF_FIRST)), (prior >= 3, F.lit(fixed.NSF_REPEAT)), otherwise=F.lit(0.0))
    told = event == "announced earlier"
    first = F.when(told, fixed.ARPA_FIRST_EARLIER).otherwise(fixed.ARPA_FIRST)
    base = F.coalesce(*[F.when(event == k, F.lit(v)) for k, v in fixed.ARPA_BASE.items()])
    arpa = base + fixed.ARPA_SIZE * X.squash(amount, fixed.ARPA_HALF) + X.ladder((prior == 0, first), (prior >= 2, F.lit(fixed.ARPA_REPEAT)), otherwise=F.lit(0.0))
    return F.when(program == "arpa_e_project", X.clamp(arpa, 0.15, 0.95)).otherwise(nsf)


@source("energy_grants", "capital")
def energy_grants(tables: Tables, asof: Column) -> DataFrame:
    """energy_awards(firm, day, released, amount, program, and where known event, award): what another award list already has is dropped (other_contracts(contract)); dated when both award and release are known; prior ones are the firm's of the same program."""
    e = given(tables["energy_awards"], event="string", award="string").withColumn("contract", X.contract_key(F.col("award")))
    if "other_contracts" in tables:
        e = e.join(tables["other_contracts"].select(X.contract_key(F.col("contract")).alias("contract")), "contract", "left_anti")
    h = history.prior_counts(e.withColumn("seen", F.greatest("day", F.coalesce("released", "day"))), ["firm", "program"], "seen")
    return made(h, "energy_grants", F.col("program"), "firm", "seen", F.col("amount"), energy_strength(F.col("program"), F.col("prior"), F.col("amount"), F.coalesce("event", F.lit("selected"))))


def filing_strength(sta: Column, granted: Column, extension: Column, title: Column, units: Column, signs: Column, filings: Column, fit: Column, on_thesis: Column, routine: Column) -> Column:
    """A new licence that is still pending says most, a short test least; who files, how many units, and `signs` (how many of: own design, government contract, thesis type) add to it, several filings of an applicant take away. Routine devices are held down, and what has no thesis evidence is scaled down."""
    base = F.when(sta, F.when(granted | extension, fixed.FILING_STA).otherwise(fixed.FILING_STA_PENDING)).otherwise(F.when(granted, fixed.FILING_GRANTED).otherwise(fixed.FILING_PENDING))
    many = X.ladder(((filings <= 1) & ~extension, F.lit(fixed.FILING_ONLY)), (filings >= 4, F.lit(fixed.FILING_MANY)), (filings >= 2, F.lit(fixed.FILING_SOME)), otherwise=F.lit(0.0))
    s = base + either(title.rlike(fixed.SENIOR_TITLE), fixed.FILING_SENIOR) + fixed.FILING_UNITS * X.squash(units, fixed.FILING_UNITS_HALF) + fixed.FILING_SIGN * signs + many
    held = X.ladder((routine, F.least(s, F.lit(fixed.FILING_ROUTINE))), ((fit < 0.3) & ~on_thesis, s * fixed.FILING_OFF_THESIS), otherwise=s)
    return X.clamp(held, 0.15, 0.95)


@source("fcc_els", "regulatory")
def fcc_els(tables: Tables, asof: Column) -> DataFrame:
    """licences(applicant, day, status, kind, units, and where known title, fit, callsign, own_design, gov_contract, on_thesis, routine): three of an applicant and kind at most, the newest."""
    flags = ("own_design", "gov_contract", "on_thesis", "routine")
    a = given(tables["licences"], title="string", fit="double", callsign="string", **{c: "boolean" for c in flags})
    names = named(a, "applicant", X.loose_name)
    a = a.withColumns({c: F.coalesce(c, F.lit(False)) for c in flags}).join(names.drop("n"), "applicant")
    many = names.groupBy("key").agg(F.sum("n").alias("filings"))
    rows = top_per(a, ["key", "kind"], [F.desc("day"), F.desc("units"), F.col("status"), F.col("applicant"), F.col("title"), F.desc("fit")], 3).join(many, "key")
    sta, granted = F.col("kind") == "sta", F.col("status") == "granted"
    signs = sum((F.col(c).cast("int") for c in flags[:3]), F.lit(0))
    s = filing_strength(sta, granted, sta & ~granted & F.col("callsign").isNotNull(), F.coalesce("title", F.lit("")), F.col("units"), signs, F.col("filings"), F.coalesce("fit", F.lit(1.0)), F.col("on_thesis"), F.col("routine"))
    return made(rows, "fcc_els", F.when(sta, "fcc_sta").otherwise(F.concat(F.lit("fcc_"), F.col("kind"), F.lit("_"), F.col("status"))), "applicant", "day", F.col("units"), s)


@kind("faa_uas", "faa_part107_waiver")
def faa_part107_waiver(tables: Tables, asof: Column) -> DataFrame:
    """waivers(holder, day, until, beyond_sight, many_aircraft, over_people, cue, service, maker): what a waiver allows, less for a short term, for a holder of several and for names that don't say aviation (cue 0 or 1)."""
    w = tables["waivers"]
    names = named(w, "holder", X.normalize_name)
    held = names.join(names.groupBy("key").agg((F.sum("n") - 1).alias("others")), "key").select("holder", "key", "others")
    sight, many = F.col("beyond_sight"), F.col("many_aircraft")
    base = X.ladder((sight & many, F.lit(fixed.WAIVER_BOTH)), (sight, F.lit(fixed.WAIVER_SIGHT)), (many, F.lit(fixed.WAIVER_MANY)), otherwise=F.lit(fixed.WAIVER_OTHER))
    s = base + either(F.col("over_people") & (sight | many), 0.05) - either(F.datediff("until", "day") < 90, 0.1) - 0.06 * X.squash(F.col("others"), 3.0) + either(F.col("maker"), 0.05)
    most = X.ladder((F.col("service") | (F.col("cue") == 0), F.lit(0.3)), (F.col("cue") == 1, F.lit(0.5)), otherwise=F.lit(0.8))
    return made(w.join(held, "holder"), "faa_uas", F.lit("faa_part107_waiver"), "key", "day", F.col("others") + 1, X.clamp(F.least(s, most), 0.15, 0.8))


def owner_history(marks: DataFrame, since: Column) -> DataFrame:
    """Of each owner: all filings, those before a day, the first day, and brands since then (distinct word marks in any case, and one more for design marks)."""
    new = F.col("day") >= since
    brands = F.countDistinct(F.when(new, F.lower("mark"))) + F.coalesce(F.max(F.when(new & F.col("mark").isNull(), 1)), F.lit(0))
    return marks.groupBy("owner").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~new, 1)).alias("before"), F.min("day").alias("first_day"), brands.alias("brands"))


@source("uspto_trademarks", "regulatory")
def uspto_trademarks(tables: Tables, asof: Column) -> DataFrame:
    """filings_of_marks(owner, day, mark, basis, scope, fit): one signal an owner of the last 180 days, of its newest filing: in use, intended, or neither known (trademark_filing)."""
    m, since = tables["filings_of_marks"], F.date_sub(asof, 180)
    new = m.filter(F.col("day") >= since)
    order = [F.desc("day"), F.col("mark").asc_nulls_last(), F.col("basis").asc_nulls_last(), F.col("scope"), F.desc("fit")]
    lead = top_per(new, ["owner"], order).select("owner", "day", "basis")
    scope = F.coalesce(*[F.max(F.when(F.col("scope") == k, F.lit(v))) for k, v in fixed.TRADEMARK_SCOPE.items()])
    batch = new.groupBy("owner").agg(F.bool_or(F.coalesce(F.col("basis") == "1b", F.lit(False))).alias("intended"), F.avg(F.coalesce((F.col("basis") == "1b").cast("double"), F.lit(0.0))).alias("share"), scope.alias("scope"), F.max(F.when(F.col("scope") == "goods", 1)).alias("goods"), F.max("fit").alias("fit"), F.bool_or(F.coalesce(F.col("basis").isin("44d", "44e", "66a"), F.lit(False))).alias("foreign"))
    h = lead.join(batch, "owner").join(owner_history(m, since), "owner")
    first = F.col("before") == 0
    family = first & (F.col("share") > 0.5) & (F.col("goods") == 1) & (F.col("brands") >= 3) & ~F.col("foreign")
    s = 0.12 + either(F.col("intended"), 0.07) + X.ladder((first, F.lit(0.09)), ((F.datediff(asof, "first_day") <= 3 * 365) & (F.col("before") <= 5), F.lit(0.04)), otherwise=F.lit(0.0)) + F.col("scope")
    s = s + 0.24 * X.squash(F.col("brands") - 1, 2.0) + 0.10 * (F.col("fit") - 0.3) / 0.7 + either(family, 0.14) - either(F.col("foreign"), 0.08) - 0.20 * X.squash(F.col("before"), 8)
    name = X.ladder((F.col("basis") == "1b", "trademark_intent_to_use"), (F.col("basis") == "1a", "trademark_in_use"), otherwise="trademark_filing")
    return made(h, "uspto_trademarks", name, "owner", "day", F.col("brands"), X.clamp(s, 0.15, 0.97))


@kind("github_velocity", "new_org_repo")
def new_org_repo(tables: Tables, asof: Column) -> DataFrame:
    """repos(owner, repo, org_created, created, contributors, stars, own_domain, mail_on_domain, has_handle, repos): the earliest repository of a young organisation with a domain of its own and two committers or more."""
    r = tables["repos"].filter((F.datediff("created", "org_created") <= 365) & F.col("own_domain") & (F.col("contributors") >= 2))
    first = top_per(r, ["owner"], [F.col("created"), F.col("repo")])
    age = F.datediff(asof, "org_created")
    s = 0.25 + 0.20 * X.squash(F.col("contributors") - 1, 4) + 0.20 * X.squash(F.col("stars"), 400) + either(age <= 180, 0.06) + either(F.col("has_handle"), 0.03) + either(F.col("mail_on_domain"), 0.03) + either(F.col("repos") >= 3, 0.04) + 0.03
    return made(first, "github_velocity", F.lit("new_org_repo"), "owner", "created", F.col("contributors"), X.clamp(s, 0.2, 0.92))


@source("hn_launch", "launch")
def hn_launch(tables: Tables, asof: Column) -> DataFrame:
    """stories(entity, day, url, points, comments, is_launch, prior): reposts of one page are one story, its best, and say how often it was posted; launches and shows are told apart, and a first story that lands counts more."""
    p = tables["stories"].withColumn("page", X.url_key(F.col("url")))
    n = p.groupBy("entity", "page").agg(F.count(F.lit(1)).alias("posted"))
    best = top_per(p, ["entity", "page"], [F.desc("points"), F.col("day"), F.desc("comments"), F.col("url")]).join(n, ["entity", "page"])
    s = 0.15 + 0.75 * X.squash(F.col("points") + 0.5 * F.col("comments"), fixed.LAUNCH_HALF)
    s = F.when(F.col("is_launch"), F.greatest(s + fixed.LAUNCH_BONUS, F.lit(fixed.LAUNCH_FLOOR))).otherwise(s) + either((F.col("prior") == 0) & (F.col("points") >= fixed.FIRST_STORY_POINTS), fixed.FIRST_STORY)
    return made(best, "hn_launch", F.when(F.col("is_launch"), "launch_hn").otherwise("show_hn"), "entity", "day", F.col("posted"), F.least(s, F.lit(0.97)))


@kind("yc_directory", "yc_batch")
def yc_batch(tables: Tables, asof: Column) -> DataFrame:
    """listings(company, day, fit, area, hard, tags, own_words): a new listing; how squarely it is on thesis and under which labels. area: thesis, industrials or other; without own words it stays routine."""
    s = 0.13 + 0.2 * F.col("fit") + X.ladder((F.col("area") == "thesis", F.lit(0.12)), (F.col("area") == "industrials", F.lit(0.06)), otherwise=F.lit(0.0)) + either(F.col("hard"), 0.1) + 0.03 * F.least("tags", F.lit(3))
    one = top_per(tables["listings"], ["company"], [F.col("day"), F.desc("fit"), F.desc("tags"), F.col("area"), F.col("hard")])
    return made(one, "yc_directory", F.lit("yc_batch"), "company", "day", F.col("tags"), F.when(F.col("own_words"), F.least(s, F.lit(0.64))).otherwise(0.15 + 0.1 * F.col("fit")))


def listing_strength(program: Column, fit: Column, labels: Column, hard: Column, founded: Column, cohort_year: Column, day: Column, asof: Column) -> Column:
    """Speedrun and hax listings by their own scales; one that comes two years after its cohort is back-filled and routine."""
    year, fit = F.year(day), F.coalesce(fit, F.lit(0.0))
    run = X.clamp(0.02 + 0.46 * fit + 0.05 * F.least(F.coalesce(labels, F.lit(0)), F.lit(2)) + either(hard, 0.07) + either(founded >= F.year(asof) - 1, 0.03), 0.15, 0.72)
    hax = F.least(0.22 + 0.28 * fit + either(cohort_year == year, 0.08) + either(founded >= year - 2, 0.04), F.lit(0.7))
    late = F.coalesce(year - cohort_year >= 2, F.lit(False))
    return F.when(program == "speedrun", run).otherwise(F.when(late, F.least(hax, F.lit(fixed.BACK_FILLED))).otherwise(hax))


@source("accelerators", "launch")
def accelerators(tables: Tables, asof: Column) -> DataFrame:
    """cohort_posts(post, portal_id, slug, day, founded, and where known program, fit, labels, hard, cohort_year): posts with one portal id or slug are one company, of which the earliest tells, the latest names; too old companies go. The value is how often it was posted."""
    p = given(tables["cohort_posts"], program="string", fit="double", labels="int", hard="boolean", cohort_year="int")
    c = p.join(hard_links(p, "post", ["portal_id", "slug"]), "post")
    about = c.groupBy("component").agg(F.max_by("slug", F.struct("day", "post")).alias("name"), F.min("founded").alias("oldest"), F.count("*").alias("n"))
    lead = top_per(c, ["component"], [F.col("day"), F.desc("fit"), F.desc("labels"), F.col("hard"), F.col("founded"), F.col("cohort_year"), F.col("post")])
    young = lead.join(about, "component").filter(F.col("oldest").isNull() | (F.year(asof) - F.col("oldest") <= 8))
    s = listing_strength(*[F.col(x) for x in ("program", "fit", "labels", "hard", "founded", "cohort_year", "day")], asof)
    return made(young, "accelerators", F.when(F.col("program") == "speedrun", "speedrun_cohort").otherwise("hax_company"), "name", "day", F.col("n"), s)


@kind("domain_footprint", "records")
def domain_records(tables: Tables, asof: Column) -> DataFrame:
    """registrations(domain, registered, project), dns(domain, mail, dns, sender: on a government cloud) and dns_tools(domain, tool, weight, telling): a domain registered in the last 60 days, one on a government cloud, and one whose records name tools, one of them telling."""
    r = tables["registrations"].groupBy("domain").agg(F.min("registered").alias("registered"), F.bool_and("project").alias("project"))
    age = F.datediff(asof, "registered")
    new = made(r.filter(age.between(0, 60)), "domain_footprint", F.lit("domain_registered"), "domain", "registered", age, F.when(F.col("project"), fixed.REGISTERED_PROJECT).otherwise(fixed.REGISTERED))
    d = tables["dns"].groupBy("domain").agg(*[F.bool_or(c).alias(c) for c in ("mail", "dns", "sender")]).join(r, "domain", "left").withColumn("day", asof)
    g = fixed.GOVCLOUD
    s = X.ladder((F.col("mail") & F.col("dns"), F.lit(g["mail and dns"])), (F.col("mail"), F.lit(g["mail"])), (F.col("dns"), F.lit(g["dns"])), (F.col("sender"), F.lit(g["sender"])), otherwise=None)
    cloud = made(d.filter(s.isNotNull()), "domain_footprint", F.lit("dns_govcloud"), "domain", "day", F.lit(None), s + either(age <= 5 * 365, fixed.YOUNG_DOMAIN))
    t = tables["dns_tools"].groupBy("domain", "tool").agg(F.max("weight").alias("weight"), F.bool_or("telling").alias("telling"))
    t = t.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"), F.bool_or("telling").alias("telling")).filter("telling").withColumn("day", asof)
    return new.unionByName(cloud).unionByName(made(t, "domain_footprint", F.lit("dns_tooling"), "domain", "day", F.col("n"), 0.15 + 0.15 * X.squash(F.col("weight"), 2.0)))


@kind("research_affil", "hf_paper_with_org")
def hf_paper_with_org(tables: Tables, asof: Column) -> DataFrame:
    """claimed_papers(org, title, day, upvotes, stars, fit): papers that a company claims, squarely on thesis; one a title, by what readers gave it."""
    p = tables["claimed_papers"].filter((F.col("fit") >= 0.55) & (F.col("day") <= asof)).withColumn("key", X.normalize_name(F.col("title")))
    one = top_per(p, ["org", "key"], [F.desc("upvotes"), F.desc("stars"), F.col("day"), F.col("title")])
    return made(one, "research_affil", F.lit("hf_paper_with_org"), "org", "day", F.col("upvotes"), F.least(0.18 + 0.5 * X.squash(F.col("upvotes"), 60) + 0.2 * X.squash(F.col("stars"), 400), F.lit(0.8)))


@kind("web_presence", "website_described")
def website_described(tables: Tables, asof: Column) -> DataFrame:
    """descriptions(entity, url, day, said, known): a site's own words for an entity that has none yet, the longest of its pages; a baseline of strength 0."""
    d = tables["descriptions"].filter(F.col("known").isNull() & (F.length(F.trim("said")) >= 20))
    one = top_per(d, ["entity"], [F.desc(F.length("said")), F.col("url"), F.desc("day")])
    return made(one, "web_presence", F.lit("website_described"), "entity", "day", F.length("said"), F.lit(0.0))
