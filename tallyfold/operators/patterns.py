"""Patterns over histories: listings that open and close, events near each other in time, moves between homes, ladders, breakouts, slopes, recurring persons, telling words.

No operator gathers a party's rows: they are counted a day or a label first, so what is left of a party is as long as the calendar at most."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .history import previous
from .lineage import cut_lineage
from .ranking import running_total


# --- listings


def listing_spans(listings: DataFrame, keys: Sequence[str], snapshot: str, gap: int = 0) -> DataFrame:
    """(keys, opened, last_seen, closed, is_open) of each unbroken stretch in which an item was listed, from numbered snapshots of which each shows what is open.

    An item that is missing in more than `gap` snapshots in a row has closed, in the first of them; one still listed within `gap` of the newest snapshot is open (closed is null). A snapshot in which nothing at
    all was listed can't be told from one that wasn't taken, so the numbers of snapshots must be whole. Repeated rows count once; rows without a snapshot are left out."""
    one = listings.filter(F.col(snapshot).isNotNull()).select(*keys, F.col(snapshot).alias("_at")).distinct()
    own = Window.partitionBy(*keys).orderBy("_at")
    starts = F.coalesce((F.col("_at") - F.lag("_at").over(own) > gap + 1).cast("int"), F.lit(1))
    runs = one.withColumn("_new", starts).withColumn("_run", F.sum("_new").over(own)).groupBy(*keys, "_run").agg(F.min("_at").alias("opened"), F.max("_at").alias("last_seen")).drop("_run")
    newest = one.agg(F.max("_at").alias("_newest"))
    is_open = F.col("last_seen") + gap >= F.col("_newest")
    return runs.crossJoin(F.broadcast(newest)).withColumn("is_open", is_open).withColumn("closed", F.when(~is_open, F.col("last_seen") + 1)).drop("_newest")


def net_changes(spans: DataFrame, board: Sequence[str], since: int, until: int) -> DataFrame:
    """(board, adds, closes, net, open_now) between two snapshots (both counted). What the first snapshot of all shows counts as added in it."""
    within = lambda c: F.count(F.when(F.col(c).between(since, until), 1))
    n = spans.groupBy(*board).agg(within("opened").alias("adds"), within("closed").alias("closes"), F.count(F.when((F.col("opened") <= until) & (F.col("closed").isNull() | (F.col("closed") > until)), 1)).alias("open_now"))
    return n.select(*board, "adds", "closes", (F.col("adds") - F.col("closes")).alias("net"), "open_now")


def half_life(spans: DataFrame, board: Sequence[str], newest: Column) -> DataFrame:
    """(board, n, n_closed, half_life): the least number of snapshots after which half of a board's listings or more have closed, by the product of what survives at each age. Open listings count as surviving to their age; half_life is null if fewer than half close.

    Spans are counted by age first, so the windows run over ages."""
    age = F.coalesce(F.col("closed"), newest + 1) - F.col("opened")
    ages = spans.groupBy(*board, age.alias("age")).agg(F.count("*").alias("_n"), F.count("closed").alias("_closed"))
    from_age = Window.partitionBy(*board).orderBy(F.desc("age"))
    at_risk = ages.withColumn("_risk", F.sum("_n").over(from_age))
    left = F.when(F.col("_closed") == F.col("_risk"), F.lit(float("-inf"))).otherwise(F.log(1 - F.col("_closed") / F.col("_risk")))
    alive = at_risk.withColumn("_alive", F.sum(left).over(Window.partitionBy(*board).orderBy("age")))
    # Sums of logarithms of halves may miss a half by their last bits.
    return alive.groupBy(*board).agg(F.sum("_n").alias("n"), F.sum("_closed").alias("n_closed"), F.min(F.when(F.col("_alive") <= F.log(F.lit(0.5)) + 1e-9, F.col("age"))).alias("half_life"))


# --- near each other in time


def near_in_time(left: DataFrame, right: DataFrame, keys: Sequence[str], left_day: str, right_day: str, days: int) -> DataFrame:
    """left with n_near (rows of the same party on the right within `days` days, either way), gap (days from the left row to the nearest of them, the later of two as near) or null.

    Both sides become a row a party and day; right days go into bins as wide as the band and into both neighbours, left days into their own, and pairs of a bin are tested exactly. So a party that has a third of all rows meets at most as many
    days as a band has, a bin a task. Rows without party or day are near to nothing."""
    bin_of = lambda c: F.floor(F.unix_date(F.col(c)) / days)
    ours = left.select(*keys, F.col(left_day).alias("_day")).distinct().withColumn("_bin", bin_of("_day"))
    theirs = right.groupBy(*keys, F.col(right_day).alias("_other")).agg(F.count("*").alias("_n"))
    theirs = theirs.withColumn("_bin", F.explode(F.array(*[bin_of("_other") + k for k in (-1, 0, 1)])))
    gap = F.datediff("_other", "_day")
    met = ours.join(theirs, [*keys, "_bin"]).withColumn("_gap", gap).filter(F.abs("_gap") <= days)
    near = met.groupBy(*keys, "_day").agg(F.sum("_n").alias("_n_near"), F.min_by("_gap", F.struct(F.abs("_gap"), -F.col("_gap"))).alias("gap"))
    out = left.join(near.withColumnRenamed("_day", left_day), [*keys, left_day], "left")
    return out.withColumn("n_near", F.coalesce("_n_near", F.lit(0))).drop("_n_near")


# --- ordered histories


def transitions(works: DataFrame, person: str, home: str, day: str, is_new: Column, least: int = 2) -> DataFrame:
    """(person, moved_on, old_home, n_before, n_after, n_old_after, how) of persons who come to a new home: the day of their first work there; the home that most earlier works name (of equals the one named last, then the first by name), which at
    least `least` works must; and how: a full move if no later work names the old home, else dual.

    is_new marks works at a new home; works of the day itself count as later; works without a day or home are left out. Works are counted a person and home, never gathered."""
    w = works.filter(F.col(day).isNotNull() & F.col(home).isNotNull()).select(F.col(person).alias("_p"), F.col(home).alias("_h"), F.col(day).alias("_d"), F.coalesce(is_new, F.lit(False)).alias("_new"))
    first = w.filter("_new").groupBy("_p").agg(F.min("_d").alias("_on"))
    told = w.join(first, "_p")
    before = F.col("_d") < F.col("_on")
    homes = told.groupBy("_p", "_on", "_h", "_new").agg(F.count(F.when(before, 1)).alias("_b"), F.count(F.when(~before, 1)).alias("_a"), F.max(F.when(before, F.col("_d"))).alias("_last"))
    old = ~F.col("_new") & (F.col("_b") > 0)
    most = F.when(old, F.struct(-F.col("_b"), -F.unix_date("_last"), F.col("_h")))
    out = homes.groupBy("_p", "_on").agg(F.min_by(F.struct("_h", "_b", "_a"), most).alias("_o"), F.sum(F.when(F.col("_new"), F.col("_a")).otherwise(0)).alias("n_after"))
    how = F.when(F.col("_o._a") > 0, "dual").otherwise("full move")
    return out.filter(F.col("_o._b") >= least).select(F.col("_p").alias(person), F.col("_on").alias("moved_on"), F.col("_o._h").alias("old_home"), F.col("_o._b").alias("n_before"), "n_after", F.col("_o._a").alias("n_old_after"), how.alias("how"))


def ladder_days(events: DataFrame, keys: Sequence[str], rung: str, day: str, rungs: Sequence[str]) -> DataFrame:
    """(keys, reached, days: of each rung the day, waits: days since the rung before) of an ordered funnel: a rung counts on its first day after the rung before. Rungs beyond `reached` are null; parties that never reach the first are left out.

    One pass: a party's distinct days of each rung are gathered (as many as the calendar has), and walked rung by rung."""
    number = F.coalesce(*[F.when(F.col(rung) == r, F.lit(k)) for k, r in enumerate(rungs)])
    marked = events.withColumn("_k", number).filter(F.col("_k").isNotNull() & F.col(day).isNotNull())
    party = marked.groupBy(*keys).agg(F.collect_set(F.struct("_k", F.col(day).alias("_d"))).alias("_all"))
    none = F.array().cast("array<date>")

    def climb(days: Column, k: Column) -> Column:
        last = F.element_at(days, -1)
        own = F.transform(F.filter("_all", lambda x: (x["_k"] == k) & ((k == 0) | (x["_d"] > last))), lambda x: x["_d"])
        return F.concat(days, F.array(F.when((k == 0) | last.isNotNull(), F.array_min(own))))

    first = F.array(F.array_min(F.transform(F.filter("_all", lambda x: x["_k"] == 0), lambda x: x["_d"])))
    climbed = party.withColumn("days", F.aggregate(F.array(*[F.lit(k) for k in range(1, len(rungs))]) if len(rungs) > 1 else F.array().cast("array<int>"), F.concat(none, first), climb))
    waits = F.transform("days", lambda d, i: F.when(i > 0, F.datediff(d, F.get("days", i - 1))))
    return climbed.filter(F.element_at("days", 1).isNotNull()).select(*keys, F.size(F.filter("days", lambda d: d.isNotNull())).alias("reached"), "days", waits.alias("waits"))


def running_deviation(values: Column) -> Column:
    """The population deviation of an array, by means that run along it (Welford's). Where a figure is compared with a threshold that it may meet exactly, the last bits decide, so each step is rounded as SQL engines do that take row by row; Spark's own stddev_pop rounds otherwise."""
    none = F.struct(F.lit(0.0).alias("k"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("squares"))

    def step(s: Column, x: Column) -> Column:
        mean = s["mean"] + (x - s["mean"]) / (s["k"] + 1)
        return F.struct((s["k"] + 1).alias("k"), mean.alias("mean"), (s["squares"] + (x - mean) * (x - s["mean"])).alias("squares"))

    return F.aggregate(F.transform(values, lambda x: x.cast("double")), none, step, lambda s: F.when(s["k"] > 0, F.sqrt(s["squares"] / s["k"])))


def breakouts(df: DataFrame, keys: Sequence[str], day: str, asof: Column, step: int = 7, back: int = 12, z: float = 3.0, least: int = 5) -> DataFrame:
    """(keys, period, n, mean, deviation, z, breaks) of each whole period of `step` days up to asof (period 0 is the latest): its rows against the mean and the deviation of the `back` periods before it. Periods without rows are zeros, from a key's first period on; a period with
    fewer than `back` before it has no figures. It breaks out with `least` rows or more and z or more deviations above the mean; where the deviation is 0, with any rows above the mean. The calendar is filled, so a key has as many rows as it has periods."""
    period = F.floor(F.datediff(asof, F.col(day)) / step).cast("int")
    counts = df.withColumn("_p", period).filter(F.col("_p") >= 0).groupBy(*keys, "_p").agg(F.count("*").alias("n"))
    spans = counts.groupBy(*keys).agg(F.max("_p").alias("_first"))
    filled = spans.select(*keys, F.explode(F.sequence(F.lit(0), F.col("_first"))).alias("_p")).join(counts, [*keys, "_p"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.partitionBy(*keys).orderBy(F.desc("_p")).rowsBetween(-back, -1)
    stats = filled.withColumn("_whole", F.count("*").over(w) == back).withColumn("mean", F.when(F.col("_whole"), F.avg("n").over(w))).withColumn("deviation", F.when(F.col("_whole"), running_deviation(F.collect_list("n").over(w))))
    score = F.when(F.col("deviation") > 0, (F.col("n") - F.col("mean")) / F.col("deviation"))
    breaks = F.coalesce((F.col("n") >= least) & ((score >= z) | ((F.col("deviation") == 0) & (F.col("n") > F.col("mean")))), F.lit(False))
    return stats.select(*keys, F.col("_p").alias("period"), "n", "mean", "deviation", score.alias("z"), breaks.alias("breaks"))


def ranks_within(df: DataFrame, groups: Sequence[str], value: str, rank: str = "rank") -> DataFrame:
    """df with each row's rank within its groups, the highest value first, equal ones alike; by counts of distinct values, summed in order, so no task ranks a whole group."""
    counts = df.groupBy(*groups, value).agg(F.count("*").alias("_n"))
    above = running_total(counts, groups, [F.desc(value)], "_n", "_higher").select(*groups, value, (F.col("_higher") + 1).alias(rank))
    return df.join(above, [*groups, value])


def rank_slopes(ranks: DataFrame, keys: Sequence[str], period: str, rank: str, stretch: int, least: int = 3) -> DataFrame:
    """(keys, velocity, before, acceleration): the least-squares slope of log10 of the rank over the latest `stretch` periods (0 is the latest) and over as many before, a period; below 0 it climbs. A stretch with fewer than `least` points has no slope. Sums that merge, so no key's ranks are gathered."""
    x, y = -F.col(period).cast("double"), F.log10(rank)
    now, before = F.col(period) < stretch, (F.col(period) >= stretch) & (F.col(period) < 2 * stretch)

    def slope(which: Column) -> Column:
        return F.when(F.count(F.when(which, y)) >= least, F.regr_slope(F.when(which, y), F.when(which, x)))

    s = ranks.filter(F.col(period) >= 0).groupBy(*keys).agg(slope(now).alias("velocity"), slope(before).alias("before"))
    return s.select(*keys, "velocity", "before", (F.col("velocity") - F.col("before")).alias("acceleration"))


def round_steps(rounds: DataFrame, party: str, day: str, amount: str, asof: Column) -> DataFrame:
    """(party, rounds, first_day, last_day, days_between, step_up, last_step, per_year) of each party's rounds: the mean wait between rounds, the geometric mean of how they grow and the latest of these, and rounds a year since the first. Rounds of a day are one, their amounts together; without a second round waits and steps are null, as are steps from or to nothing.

    Rounds meet the one before them by ranges, so no party's rounds are in one task."""
    r = rounds.filter(F.col(party).isNotNull() & (F.col(day) <= asof)).groupBy(F.col(party).alias("_p"), F.col(day).alias("_d")).agg(F.sum(amount).alias("_a"))
    r = previous(r, ["_p"], [F.col("_d")], {"_was": "_a", "_on": "_d"})
    step = F.when((F.col("_a") > 0) & (F.col("_was") > 0), F.col("_a") / F.col("_was"))
    years = F.greatest(F.datediff(asof, F.min("_d")), F.lit(1)) / 365.25
    out = r.groupBy("_p").agg(F.count("*").alias("rounds"), F.min("_d").alias("first_day"), F.max("_d").alias("last_day"), F.avg(F.datediff("_d", "_on")).alias("days_between"), F.exp(F.avg(F.log(step))).alias("step_up"), F.max_by(step, "_d").alias("last_step"), (F.count("*") / years).alias("per_year"))
    return out.withColumnRenamed("_p", party)


def award_profile(awards: DataFrame, raised: DataFrame, party: str, office: str, day: str, ceiling: str, obligated: str, asof: Column, mill: int = 20) -> DataFrame:
    """A row a party, of its awards up to asof: lifetime, offices (how many different ones awarded), new_90 and prev_90 (awards of the last 90 days and of those before), acceleration, is_novel (none older than a year), is_mill (more than `mill` awards, and never in `raised`), ceiling_ratio (what may be ordered by what is obligated; null without obligations)."""
    age = F.datediff(asof, day)
    a = awards.filter((age >= 0) & F.col(party).isNotNull())
    within = lambda x, y: F.count(F.when((age >= x) & (age < y), 1))
    out = a.groupBy(party).agg(
        F.count("*").alias("lifetime"), F.countDistinct(office).alias("offices"), within(0, 90).alias("new_90"), within(90, 180).alias("prev_90"), F.max(age).alias("_oldest"),
        (F.sum(ceiling) / F.nullif(F.sum(obligated), F.lit(0))).alias("ceiling_ratio"),
    ).join(raised.select(F.col(party), F.lit(True).alias("_raised")).distinct(), party, "left")
    is_mill = (F.col("lifetime") > mill) & F.col("_raised").isNull()
    return out.select(party, "lifetime", "offices", "new_90", "prev_90", ((F.col("new_90") + 1) / (F.col("prev_90") + 1)).alias("acceleration"), (F.col("_oldest") <= 365).alias("is_novel"), is_mill.alias("is_mill"), "ceiling_ratio")


def new_directors(filings: DataFrame, party: str, filing: str, day: str, directors: str, officers: str) -> DataFrame:
    """(party, filing, day, director): who sits on a party's board by a filing, runs nothing there, and wasn't named in the filing before. A party's first filing tells no one new. Filings of a day go by `filing`; null lists are empty.

    A filing meets only the one before it, by ranges."""
    none = F.array().cast("array<string>")
    f = filings.filter(F.col(party).isNotNull()).select(F.col(party), F.col(filing), F.col(day), F.coalesce(directors, none).alias("_d"), F.coalesce(officers, none).alias("_o")).withColumn("_named", F.array_union("_d", "_o"))
    f = previous(f, [party], [F.col(day), F.col(filing)], {"_before": "_named"}).filter(F.col("_before").isNotNull())
    return f.select(party, filing, day, F.explode(F.array_except(F.array_except("_d", "_o"), "_before")).alias("director"))


def surfaces(launches: DataFrame, party: str, surface: str, day: str, within: int) -> DataFrame:
    """(party, first_day, surfaces, named) of each party: on how many surfaces it launched within so many days of its first launch, and which, in order of name (their number is a surface list's, not a party's rows')."""
    seen = launches.filter(F.col(party).isNotNull() & F.col(surface).isNotNull() & F.col(day).isNotNull()).groupBy(F.col(party).alias("_p"), F.col(surface).alias("_s")).agg(F.min(day).alias("_d"))
    first = seen.groupBy("_p").agg(F.min("_d").alias("first_day"))
    out = seen.join(first, "_p").filter(F.datediff("_d", "first_day") <= within).groupBy("_p", "first_day").agg(F.count("*").alias("surfaces"), F.array_sort(F.collect_list("_s")).alias("named"))
    return out.withColumnRenamed("_p", party)


# --- persons and words


def merged_by_initials(names: DataFrame, group: str, given: Column, family: Column) -> DataFrame:
    """(group, family, given, person, joins) of each distinct name within its group: person is the given name it goes by. An initial goes by the one given name of its family that begins with it; one that fits several joins none of them, and one that fits none stays.

    given is the first given name or initial and family the last word, both in lower case; names without either are left out. Given names of a family are counted by first letter, so names never meet in pairs."""
    n = names.select(F.col(group).alias("_g"), given.alias("_n"), family.alias("_f")).filter((F.length("_n") > 0) & (F.length("_f") > 0)).distinct()
    letter, is_initial = F.substring("_n", 1, 1), F.length("_n") == 1
    full = n.filter(~is_initial).groupBy(F.col("_g").alias("_fg"), F.col("_f").alias("_ff"), letter.alias("_fi")).agg(F.count("*").alias("_fits"), F.min("_n").alias("_full"))
    met = n.join(full, F.col("_g").eqNullSafe(F.col("_fg")) & (F.col("_f") == F.col("_ff")) & (letter == F.col("_fi")), "left")
    one = is_initial & (F.coalesce("_fits", F.lit(0)) == 1)
    joins = F.when(~is_initial, "full").when(one, "joined").when(F.col("_fits") > 1, "ambiguous").otherwise("alone")
    return met.select(F.col("_g").alias(group), F.col("_f").alias("family"), F.col("_n").alias("given"), F.when(one, F.col("_full")).otherwise(F.col("_n")).alias("person"), joins.alias("joins"))


def recurring_persons(people: DataFrame, party: str, name: str, fact: str, alone: float) -> DataFrame:
    """(name, fact, parties, first_party, last_party, weight) of persons who are in two parties or more. A name's weight is the logarithm of the parties to those that have it; a rare name (weight of `alone` or more) links parties by itself (fact is null); a common one only
    with a fact that both have, if the weights of name and fact together are enough.

    Persons are counted by name and by name and fact; parties of a common name never meet. Rows without party or name are left out."""
    p = cut_lineage(people.select(F.col(party).alias("_p"), F.col(name).alias("_n"), F.col(fact).alias("_f")).filter("_p IS NOT NULL AND _n IS NOT NULL").distinct(), "people")
    all_ = p.agg(F.countDistinct("_p").alias("_all"))
    of_name = p.groupBy("_n").agg(F.countDistinct("_p").alias("_of_name"))
    of_fact = p.filter("_f IS NOT NULL").groupBy("_f").agg(F.countDistinct("_p").alias("_of_fact"))
    weighed = p.join(of_name, "_n").join(of_fact, "_f", "left").crossJoin(F.broadcast(all_))
    by_name = F.log(F.col("_all") / F.col("_of_name"))
    with_fact = by_name + F.log(F.col("_all") / F.col("_of_fact"))
    rare = by_name >= alone
    linked = weighed.filter(rare | (with_fact >= alone)).select("_p", "_n", F.when(~rare, F.col("_f")).alias("_f"), F.when(rare, by_name).otherwise(with_fact).alias("_w"))
    out = linked.groupBy("_n", "_f").agg(F.countDistinct("_p").alias("parties"), F.min("_p").alias("first_party"), F.max("_p").alias("last_party"), F.max("_w").alias("weight"))
    return out.filter("parties > 1").select(F.col("_n").alias(name), F.col("_f").alias(fact), "parties", "first_party", "last_party", "weight")


def telling_words(texts: DataFrame, text: str, is_new: str, least: int = 5, smooth: float = 0.5) -> DataFrame:
    """(word, new, rest, score) of words that newcomers' texts have more often than the rest's: in how many texts of each a word stands, and the log-likelihood ratio of a word's two rates, both smoothed, against one rate for all.

    Words are runs of letters and digits in lower case, each counted once a text, in at least `least` texts; a null text has none, a null flag is the rest's. One shuffle by word; the two numbers of texts are one row."""
    t = texts.select(F.coalesce(F.col(text), F.lit("")).alias("_t"), F.coalesce(F.col(is_new).cast("boolean"), F.lit(False)).alias("_new"))
    word = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("_t"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))))
    seen = t.select("_new", word.alias("word")).groupBy("word").agg(F.count(F.when(F.col("_new"), 1)).alias("new"), F.count(F.when(~F.col("_new"), 1)).alias("rest")).filter(F.col("new") + F.col("rest") >= least)
    sizes = t.agg(F.count(F.when(F.col("_new"), 1)).alias("_m"), F.count(F.when(~F.col("_new"), 1)).alias("_o"))
    a, b, m, o = F.col("new") + smooth, F.col("rest") + smooth, F.col("_m") + 2 * smooth, F.col("_o") + 2 * smooth
    part = lambda x, n: x * F.log(x / n) + (n - x) * F.log((n - x) / n)
    score = 2 * (part(a, m) + part(b, o) - part(a + b, m + o))
    return seen.crossJoin(F.broadcast(sizes)).filter(a / m > b / o).select("word", "new", "rest", score.alias("score"))
