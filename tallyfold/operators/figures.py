"""Figures of boards, series, papers, certificates and careers: each one or two aggregations over what a party has, never its rows gathered."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from .history import previous
from .lineage import cut_lineage
from .ranking import running_total, top_per


def _count(c: Column) -> Column:
    return F.count(F.when(c, 1))


# --- history


def tiered_history(awards: DataFrame, row: str, unit: str, number: str, name: str, day: str) -> DataFrame:
    """awards with prior_hard, prior_soft, prior_legacy, standing and prior: what a firm had on strictly earlier days under its unit id or its older number (hard), and under its name alone (soft; legacy if that row has no unit id).

    standing is repeat with anything hard, else unclear with anything soft, else first; prior counts what is hard and, for a repeat, what is legacy. A null id or name meets nothing; `row` tells rows apart.

    Rows that share a name but neither id can't be met by one key, so counts of key combinations are added and taken off: each row asks for nine counts, all of them running totals of one table of a row a key and day."""
    keys = {"u": [unit], "d": [number], "ud": [unit, number], "n": [name], "nu": [name, unit], "nd": [name, number], "nud": [name, unit, number]}
    legacy = {"ln": [name], "lnd": [name, number]}

    def entry(kind: str, columns: Sequence[str], counts: Column) -> Column:
        whole = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in columns])
        key = F.to_json(F.array(*[F.col(c).cast("string") for c in columns]))
        return F.when(whole, F.struct(F.lit(kind).alias("_kind"), key.alias("_key"), counts.cast("long").alias("_one")))

    entries = [entry(k, c, F.lit(1)) for k, c in keys.items()] + [entry(k, c, F.col(unit).isNull().cast("int")) for k, c in legacy.items()]
    asked = awards.select(F.col(row).alias("_row"), F.col(day).alias("_day"), F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("_e")).select("_row", "_day", "_e.*")
    daily = asked.groupBy("_kind", "_key", "_day").agg(F.sum("_one").alias("_n"))
    before = running_total(daily, ["_kind", "_key"], [F.col("_day")], "_n", "_before").select("_kind", "_key", "_day", "_before")
    met = asked.join(before, (asked["_kind"] == before["_kind"]) & (asked["_key"] == before["_key"]) & asked["_day"].eqNullSafe(before["_day"]))
    n = {k: F.coalesce(F.sum(F.when(asked["_kind"] == k, F.col("_before"))), F.lit(0)) for k in [*keys, *legacy]}
    hard = n["u"] + n["d"] - n["ud"]
    soft = n["n"] - n["nu"] - n["nd"] + n["nud"]
    counts = met.groupBy("_row").agg(hard.alias("prior_hard"), soft.alias("prior_soft"), (n["ln"] - n["lnd"]).alias("prior_legacy"))
    out = awards.join(counts.withColumnRenamed("_row", row), row, "left").fillna(0, ["prior_hard", "prior_soft", "prior_legacy"])
    repeat = F.col("prior_hard") > 0
    standing = F.when(repeat, "repeat").when(F.col("prior_soft") > 0, "unclear").otherwise("first")
    return out.withColumn("standing", standing).withColumn("prior", F.col("prior_hard") + F.when(repeat, F.col("prior_legacy")).otherwise(0))


def amendment_baseline(filings: DataFrame, row: str, keys: Sequence[str], order: Sequence[Column], pointer: str, amount: str) -> DataFrame:
    """filings with baseline (the row that an amendment is measured by), raised (its amount less the baseline's) and how: the row just before it under the same keys, or, for one without keys or without a row before, the row it points to. A pointer that leads nowhere, or to itself, gives none.

    Rows of a key are ordered by `order`, then `row`. A pointer is followed once, by a join."""
    whole = reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys])
    lag = previous(filings.filter(whole), keys, [*order, F.col(row)], {"_before_row": row, "_before_amount": amount}).filter(F.col("_before_row").isNotNull())
    lag = lag.select(F.col(row).alias("_row"), F.struct(F.col("_before_row").alias("r"), F.col("_before_amount").alias("a")).alias("_before"))
    told = filings.select(F.col(row).alias("_at"), F.struct(F.col(row).alias("r"), F.col(amount).alias("a")).alias("_told"))
    out = filings.join(lag, filings[row] == lag["_row"], "left").join(told, (filings[pointer] == told["_at"]) & (filings[pointer] != filings[row]), "left")
    base = F.coalesce("_before", "_told")
    how = F.when(F.col("_before").isNotNull(), "before").when(F.col("_told").isNotNull(), "pointer")
    return out.select(*[filings[c] for c in filings.columns], base["r"].alias("baseline"), (filings[amount] - base["a"]).alias("raised"), how.alias("how"))


# --- boards and series


def board_stats(roles: DataFrame, board: str, title: str, place: str, posted: str, function: str, evergreen: Column, notable: Column, asof: Column, after: Column | None = None) -> DataFrame:
    """A row a board, of the roles open at asof: open_roles, evergreen_roles, dated_roles, oldest, newest, function_mix (roles of each function), hardware_share, gtm_roles, n_locations, founding_roles, new_14d, new_30d and prev_30d (all dated ones), distinct_new_30d and distinct_prev_30d (titles
    and places of real ones), notable_new, sole_gtm, prior_known, bulk_day and bulk_share.

    Roles posted after asof are left out, and if there are any on the board, those without a day too. Roles up to `after` (a board's first batch) count in no window, and while the 30 days before the last 30 still meet it prior_known is false. A bulk day is the one from which most new roles were posted within three days (the later of
    equals), if these are half of at least four. Days are counted before any window runs, so a board's rows meet nowhere."""
    r = roles.select(F.col(board).alias("_b"), F.col(title).alias("_t"), F.col(place).alias("_p"), F.col(posted).alias("_d"), F.col(function).alias("_f"), F.coalesce(evergreen, F.lit(False)).alias("_e"), F.coalesce(notable, F.lit(False)).alias("_n"), (after if after is not None else F.lit(None)).cast("date").alias("_after"))
    last = r.groupBy("_b").agg(F.max("_d").alias("_last"), F.max("_after").alias("_first"))
    live = cut_lineage(r.drop("_after").join(last, "_b").filter((F.col("_d") <= asof) | (F.col("_d").isNull() & (F.coalesce("_last", asof) <= asof))), "roles")
    real, age = ~F.col("_e"), F.datediff(asof, "_d")
    counts = F.col("_d").isNotNull() & (F.col("_first").isNull() | (F.col("_d") > F.col("_first")))
    new, prev = counts & (age < fixed.NEW_DAYS), counts & age.between(fixed.NEW_DAYS, 2 * fixed.NEW_DAYS - 1)
    key = F.struct(F.lower(F.trim("_t")), F.lower(F.trim(F.coalesce("_p", F.lit("")))))
    gtm = real & (F.col("_f") == "gtm")
    hard = F.avg(F.when(real, F.coalesce(F.col("_f").isin(*fixed.PHYSICAL_FUNCTIONS), F.lit(False)).cast("double")))
    stats = live.groupBy("_b").agg(
        F.count("*").alias("open_roles"), _count(~real).alias("evergreen_roles"), _count(real & F.col("_d").isNotNull()).alias("dated_roles"), F.min(F.when(real, F.col("_d"))).alias("oldest"), F.max(F.when(real, F.col("_d"))).alias("newest"),
        F.coalesce(F.round(hard, 2), F.lit(0.0)).alias("hardware_share"), _count(gtm).alias("gtm_roles"), F.countDistinct(F.when(real & (F.col("_p") != ""), F.col("_p"))).alias("n_locations"), _count(real & F.col("_t").rlike(r"(?i)\bfounding\b")).alias("founding_roles"),
        _count(counts & (age < fixed.NEW_SHORT_DAYS)).alias("new_14d"), _count(new).alias("new_30d"), _count(prev).alias("prev_30d"), F.countDistinct(F.when(new & real, key)).alias("distinct_new_30d"), F.countDistinct(F.when(prev & real, key)).alias("distinct_prev_30d"),
        _count(new & real & F.col("_n")).alias("notable_new"), _count(new & gtm).alias("_new_gtm"), _count(real).alias("_real"), _count(new & real).alias("_new"), F.max("_first").alias("_first"),
    )
    mix = live.filter(real & F.col("_f").isNotNull()).groupBy("_b", "_f").agg(F.count("*").alias("_n")).groupBy("_b").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_f", "_n")))).alias("function_mix"))
    daily = live.filter(new & real).groupBy("_b", "_d").agg(F.count("*").alias("_n"))
    days = Window.partitionBy("_b").orderBy(F.unix_date("_d")).rangeBetween(0, fixed.BULK_WINDOW_DAYS - 1)
    bulk = daily.withColumn("_in", F.sum("_n").over(days)).groupBy("_b").agg(F.max(F.struct("_in", "_d")).alias("_bulk"))
    out = stats.join(mix, "_b", "left").join(bulk, "_b", "left")
    share = F.col("_bulk._in") / F.col("_new")
    is_bulk = (F.col("_new") >= fixed.BULK_MIN_ROLES) & (F.col("_bulk._in") >= fixed.BULK_MIN_ROLES) & (share >= fixed.BULK_SHARE)
    known = F.col("_first").isNull() | (F.datediff(asof, "_first") >= 2 * fixed.NEW_DAYS)
    sole = (F.col("gtm_roles") == 1) & (F.col("_new_gtm") == 1) & (F.col("_real") >= 3)
    return out.select(F.col("_b").alias(board), *[c for c in stats.columns if not c.startswith("_")], "function_mix", sole.alias("sole_gtm"), known.alias("prior_known"), F.when(is_bulk, F.col("_bulk._d")).alias("bulk_day"), F.when(is_bulk, F.round(share, 2)).alias("bulk_share"))


def velocity_stats(daily: DataFrame, key: str, day: str, n: str, asof: Column, total: Column | None = None) -> DataFrame:
    """A row a key, of its counts per day up to asof: n_7d, prev_7d, n_30d, prev_30d, accel_7d, accel_30d, total, share_30d (of all), sustained_weeks (of the last eight those of ten or more), peak_day and peak_date (of the last 30 days, the earliest of equals), peak_date_7d, burstiness (the peak's part of the 30
    days), first_active and last_active. `total` is what the source says of all (later days are taken off it); without, the sum of the days."""
    d = daily.groupBy(F.col(key).alias("_k"), F.col(day).alias("_d")).agg(F.sum(n).alias("_n"), F.max(total if total is not None else F.lit(None).cast("long")).alias("_all")).withColumn("_age", F.datediff(asof, "_d"))
    past, age = F.col("_age") >= 0, F.col("_age")
    within = lambda a, b: F.coalesce(F.sum(F.when((age >= a) & (age < b), F.col("_n"))), F.lit(0))
    weeks = [within(7 * w, 7 * w + 7) for w in range(fixed.WEEKS_LOOKED_AT)]
    best = lambda days: F.max(F.when(past & (age < days) & (F.col("_n") > 0), F.struct(F.col("_n").alias("n"), age.alias("a"), F.col("_d").alias("d"))))
    active = F.when(past & (F.col("_n") > 0), F.col("_d"))
    a = d.groupBy("_k").agg(
        within(0, 7).alias("n_7d"), within(7, 14).alias("prev_7d"), within(0, 30).alias("n_30d"), within(30, 60).alias("prev_30d"), F.coalesce(F.sum(F.when(past, F.col("_n"))), F.lit(0)).alias("_past"), F.coalesce(F.sum(F.when(~past, F.col("_n"))), F.lit(0)).alias("_later"), F.max("_all").alias("_all"),
        reduce(lambda x, y: x + y, [(w >= fixed.SUSTAINED_WEEK).cast("int") for w in weeks]).alias("sustained_weeks"), best(30).alias("_p30"), best(7).alias("_p7"), F.min(active).alias("first_active"), F.max(active).alias("last_active"),
    )
    whole = F.coalesce(F.greatest(F.col("_all") - F.col("_later"), F.lit(0)), F.col("_past"))
    now = F.col("n_30d")
    ratio = lambda x, y: F.round((F.col(x) + 1) / (F.col(y) + 1), 2)
    return a.select(
        F.col("_k").alias(key), "n_7d", "prev_7d", "n_30d", "prev_30d", ratio("n_7d", "prev_7d").alias("accel_7d"), ratio("n_30d", "prev_30d").alias("accel_30d"), whole.alias("total"), F.round(F.least(now / F.greatest(whole, now, F.lit(1)), F.lit(1.0)), 3).alias("share_30d"), "sustained_weeks",
        F.coalesce(F.col("_p30.n"), F.lit(0)).alias("peak_day"), F.col("_p30.d").alias("peak_date"), F.col("_p7.d").alias("peak_date_7d"), F.when(now > 0, F.round(F.coalesce(F.col("_p30.n"), F.lit(0)) / now, 3)).otherwise(0.0).alias("burstiness"), "first_active", "last_active",
    )


# --- papers, certificates, careers


def company_papers(mentions: DataFrame, company: str, printed: str, place: str, paper: str, title_key: Column, day: str, order: Sequence[Column] = ()) -> tuple[DataFrame, DataFrame]:
    """(company, name, aliases, place, papers, duplicates, first_day, last_day) of each company, and its series (company, day, papers so far). mentions has a row for each paper and form of the name.

    name is the printed form of most mentions, the longest of equals, then the first by alphabet; place the one of most mentions, of equals the first by alphabet. Papers of one title are one, the earliest (then by `order`, then paper). Papers are counted per day before they are added up."""
    m = mentions.select(F.col(company).alias("_c"), F.col(printed).alias("_n"), F.col(place).alias("_p"), F.col(paper).alias("_id"), title_key.alias("_t"), F.col(day).alias("_d"), *[o.alias(f"_o{k}") for k, o in enumerate(order)])
    m = m.filter("_c IS NOT NULL")
    most = lambda c, ties: top_per(m.filter(F.col(c).isNotNull() & (F.col(c) != "")).groupBy("_c", c).agg(F.count("*").alias("_k")), ["_c"], [F.desc("_k"), *ties]).select("_c", c)
    names = most("_n", [F.desc(F.length("_n")), F.col("_n")])
    places = most("_p", [F.col("_p")])
    best = F.struct(F.col("_d"), *[F.col(f"_o{k}") for k in range(len(order))], F.col("_id"))
    titles = cut_lineage(m.groupBy("_c", "_t").agg(F.min(best).alias("_first"), F.countDistinct("_id").alias("_ids")).select("_c", F.col("_first._d").alias("_d"), "_ids"), "titles")
    aliases = m.select("_c", "_n").distinct().join(names.withColumnRenamed("_n", "_best"), "_c").filter(F.col("_n") != F.col("_best"))
    # At most twelve, the first by alphabet: a company isn't gathered whole.
    aliases = top_per(aliases, ["_c"], [F.col("_n")], fixed.MOST_ALIASES).groupBy("_c").agg(F.array_sort(F.collect_list("_n")).alias("aliases"))
    summed = titles.groupBy("_c").agg(F.count("*").alias("papers"), (F.sum("_ids") - F.count("*")).alias("duplicates"), F.min("_d").alias("first_day"), F.max("_d").alias("last_day"))
    out = summed.join(names, "_c", "left").join(places, "_c", "left").join(aliases, "_c", "left")
    daily = titles.groupBy("_c", "_d").agg(F.count("*").alias("_k"))
    series = daily.select(F.col("_c").alias(company), F.col("_d").alias("day"), F.sum("_k").over(Window.partitionBy("_c").orderBy("_d")).alias("papers"))
    return out.select(F.col("_c").alias(company), F.col("_n").alias("name"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), F.col("_p").alias("place"), "papers", "duplicates", "first_day", "last_day"), series


def certificate_names(certificates: DataFrame, domain: str, label: str, issued: str, expires: str, since: Column, asof: Column) -> DataFrame:
    """(domain, label, issued, lifetime, n, fresh, nested) of each label whose earliest certificate is of the window from since to asof. fresh: younger than thirty days or a third of its lifetime, less two days (never with an unknown lifetime). nested: the label without its first part is of the window too.

    Certificates after asof are left out; of equal days the shorter lifetime counts."""
    c = certificates.filter(F.col(issued) <= asof).select(F.col(domain).alias("_d"), F.lower(F.rtrim(F.col(label))).alias("_l"), F.col(issued).alias("_i"), F.when(F.col(expires) > F.col(issued), F.datediff(expires, issued)).alias("_life"))
    own = c.groupBy("_d", "_l").agg(F.min("_i").alias("_i"), F.min_by("_life", F.struct("_i", F.coalesce("_life", F.lit(1 << 30)))).alias("_life"), F.count("*").alias("n")).filter(F.col("_i") >= since)
    own = cut_lineage(own, "labels")
    parent = F.when(F.instr("_l", ".") > 0, F.expr("substr(_l, instr(_l, '.') + 1)"))
    above = own.select(F.col("_d").alias("_pd"), F.col("_l").alias("_pl"), F.lit(True).alias("nested"))
    met = own.withColumn("_parent", parent).join(above, (F.col("_d") == F.col("_pd")) & (F.col("_parent") == F.col("_pl")), "left")
    bar = F.when(F.col("_life").isNotNull(), F.least(F.lit(fixed.FRESH_DAYS), F.floor(F.col("_life") / 3)) - fixed.RENEWAL_MARGIN)
    return met.select(F.col("_d").alias(domain), F.col("_l").alias(label), F.col("_i").alias("issued"), F.col("_life").alias("lifetime"), "n", F.coalesce(F.datediff(asof, "_i") <= bar, F.lit(False)).alias("fresh"), F.coalesce("nested", F.lit(False)).alias("nested"))


def merged_profiles(stays: DataFrame, topics: DataFrame, person: str, place: str, country: str, year: str, topic: str, n: str, fields: Sequence[str]) -> DataFrame:
    """(person, solid, overlap, share, verdict) of each person of either table. stays: a row for each place and year. A stay of three years or more is solid; two solid ones in different countries that share two years or more are two careers. share is the part of topic counts that lies in `fields`.

    verdict, the first that holds: too many stays (more than six solid), two careers, other field (a share under a half, or no topics), trusted. Stays meet in pairs only for persons with at most six solid ones."""
    s = stays.select(F.col(person).alias("_p"), F.col(place).alias("_at"), F.col(country).alias("_c"), F.col(year).alias("_y")).filter(F.col("_at").isNotNull() & F.col("_y").isNotNull()).distinct()
    long = s.groupBy("_p", "_at").agg(F.countDistinct("_y").alias("_years")).filter(F.col("_years") >= fixed.SOLID_YEARS)
    solid = long.groupBy("_p").agg(F.count("*").alias("solid"))
    # Beyond the most that a person may have the verdict is known, and the stays needn't meet.
    few = s.join(long.select("_p", "_at"), ["_p", "_at"]).join(solid.filter(F.col("solid") <= fixed.MOST_SOLID).select("_p"), "_p").filter(F.col("_c").isNotNull())
    a, b = few.select("_p", F.col("_at").alias("_a"), F.col("_c").alias("_ca"), "_y"), few.select("_p", F.col("_at").alias("_b"), F.col("_c").alias("_cb"), "_y")
    shared = a.join(b, ["_p", "_y"]).filter((F.col("_a") < F.col("_b")) & (F.col("_ca") != F.col("_cb"))).groupBy("_p", "_a", "_b").agg(F.countDistinct("_y").alias("_n")).groupBy("_p").agg(F.max("_n").alias("overlap"))
    t = topics.select(F.col(person).alias("_p"), F.col(topic).alias("_t"), F.col(n).alias("_n"))
    share = t.groupBy("_p").agg((F.sum(F.when(F.col("_t").isin(*fields), F.col("_n")).otherwise(0)) / F.nullif(F.sum("_n"), F.lit(0))).alias("share"))
    out = s.select("_p").union(t.select("_p")).distinct().join(solid, "_p", "left").join(shared, "_p", "left").join(share, "_p", "left").fillna(0, ["solid", "overlap"])
    verdict = F.when(F.col("solid") > fixed.MOST_SOLID, "too many stays").when(F.col("overlap") >= fixed.SHARED_YEARS, "two careers").when(F.coalesce(F.col("share"), F.lit(0.0)) < 0.5, "other field").otherwise("trusted")
    return out.select(F.col("_p").alias(person), "solid", "overlap", "share", verdict.alias("verdict"))


def unannounced(signals: DataFrame, announced: DataFrame, key: str, day: str, strength: str, asof: Column, least: Mapping[str, float]) -> DataFrame:
    """(key, first_signal, days, n, strongest) of what has signals but no announcement up to asof: how long it has shown, how often, and its strongest signal; with least["n"] signals and a strongest of least["strength"] or more."""
    known = announced.filter(F.col(day) <= asof).select(key).distinct()
    s = signals.filter(F.col(day) <= asof).join(known, key, "left_anti").groupBy(key).agg(F.min(day).alias("first_signal"), F.count("*").alias("n"), F.max(strength).alias("strongest"))
    return s.filter((F.col("n") >= least.get("n", 1)) & (F.col("strongest") >= least.get("strength", 0.0))).select(key, "first_signal", F.datediff(asof, "first_signal").alias("days"), "n", "strongest")
