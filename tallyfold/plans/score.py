"""Scores: live strength as of a date, families, momentum, consensus, team and edge, now and as of past weeks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.exprs import clamp, decay, half_life, ladder, noisy_or, noisy_or_agg, over_floor, squash, tier


def strength_asof(strength: Column, family: Column, occurred: Column, asof: Column, public: Column | None = None) -> Column:
    """Strength on a date: 0 before it can be seen (a day of slack), then halved each half-life of its family."""
    when = occurred if public is None else F.coalesce(public, occurred)
    age = F.datediff(asof, when)
    return F.when(age < -1, F.lit(0.0)).otherwise(decay(strength, age, half_life(family)))


def series_strength(series: Column, family: Column, asof: Column) -> Column:
    """Strength of a continuous signal on a date: that of its latest point by then (with a day of slack), decayed from that point; 0 before its first. `series` is an array of structs with t (a date) and s (its strength, null for points without one)."""
    known = F.filter(series, lambda p: p["s"].isNotNull() & p["t"].isNotNull() & (p["t"] <= F.date_add(asof, 1)))
    last = F.array_max(F.transform(known, lambda p: F.struct(p["t"].alias("t"), p["s"].cast("double").alias("s"))))
    return F.coalesce(decay(last["s"], F.datediff(asof, last["t"]), half_life(family)), F.lit(0.0))


def live_strength(signals: DataFrame, asof: Column) -> Column:
    """Strength of a signal on a date, from the columns it has: strength, family and occurred_at, and, where the table has them, public_at (when it could first be seen) and series (measured points, which then say all)."""
    public = F.col("public_at") if "public_at" in signals.columns else None
    point = strength_asof(F.col("strength"), F.col("family"), F.col("occurred_at"), asof, public)
    if "series" not in signals.columns:
        return point
    measured = F.exists(F.coalesce(F.col("series"), F.expr("array()")), lambda p: p["s"].isNotNull() & p["t"].isNotNull())
    return F.when(measured, series_strength(F.col("series"), F.col("family"), asof)).otherwise(point)


def counted_once(signals: DataFrame, award_key: str, strength: str, keys: Sequence[str]) -> DataFrame:
    """Signals of one award count once, at their greatest strength; those without an award stay."""
    keyed = signals.filter(F.col(award_key).isNotNull()).groupBy(*keys, award_key).agg(F.max(strength).alias(strength))
    return signals.filter(F.col(award_key).isNull()).select(*keys, award_key, strength).unionByName(keyed)


def family_strengths(signals: DataFrame, asofs: Mapping[str, Column], entity: str = "entity_id") -> DataFrame:
    """A row per entity, with a column `<name>_<family>` for each date and family: noisy-OR of the live strengths.

    All dates are columns of one aggregation: one shuffle of partial products, and no row is repeated for a date. Where signals
    have an award_key, those of one award and family count once, at the greatest live strength of each date."""
    lives = {name: live_strength(signals, asof).alias(f"_live_{name}") for name, asof in asofs.items()}
    rows = signals.select(entity, "family", *[F.col(c) for c in ["award_key"] if c in signals.columns], *lives.values())
    names = [f"_live_{name}" for name in asofs]
    if "award_key" in signals.columns:
        once = rows.filter(F.col("award_key").isNotNull()).groupBy(entity, "family", "award_key").agg(*[F.max(c).alias(c) for c in names])
        rows = rows.filter(F.col("award_key").isNull()).select(entity, "family", *names).unionByName(once.select(entity, "family", *names))
    aggs = []
    for name, c in zip(asofs, names, strict=True):
        for f in fixed.FAMILIES:
            here = F.when((F.col("family") == f) & (F.col(c) > fixed.LIVE), F.col(c)).otherwise(F.lit(0.0))
            aggs.append(F.round(noisy_or_agg(here), 4).alias(f"{name}_{f}"))
    return rows.groupBy(entity).agg(*aggs)


def momentum(families: Mapping[str, Column]) -> Column:
    """Families held to their caps, combined by noisy-OR."""
    return F.round(noisy_or(*[F.least(F.lit(fixed.FAMILY_CAP), F.lit(fixed.WEIGHT[f] * fixed.FAMILY_GAIN) * c) for f, c in families.items()]), 4)


def convergence(families: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, [(c >= fixed.FIRING).cast("int") for c in families])


def edge(momentum: Column, fit: Column, earliness: Column, team: Column, families: Column) -> Column:
    lone = F.when(families < 2, F.lit(fixed.UNCORROBORATED)).otherwise(F.lit(1.0))
    return F.round(100.0 * momentum * (0.25 + 0.75 * fit) * (0.4 + 0.6 * earliness) * (0.85 + 0.15 * team) * lone, 2)


def consensus_parts(m: Mapping[str, Column], founded: Column | None = None, asof: Column | None = None, stage: Column | None = None) -> dict[str, Column]:
    """How widely known an entity is, by part. m: measured columns by name (null: not measured)."""
    get = lambda k: m.get(k, F.lit(None).cast("double"))
    years = F.greatest(F.datediff(asof, founded) / 365.25, F.lit(0.0)) if founded is not None else F.lit(None).cast("double")
    years = F.greatest(years, get("domain_age_days") / 365.25)
    parts = {
        "stars": over_floor(get("stars_total"), 500, 8000),
        "press": over_floor(get("hn_mentions_total"), 5, 120),
        "traffic": tier(get("tranco_rank"), fixed.TRAFFIC_TIERS),
        "headcount": F.greatest(over_floor(get("open_roles"), 10, 80), over_floor(get("team_size"), 25, 200)),
        "capital": over_floor(F.coalesce(get("amount_sold"), get("amount_usd")), 15_000_000, 100_000_000),
        "age": 0.7 * over_floor(years, 3, 4),
        "awards": 0.7 * over_floor(get("sbir_prior_awards"), 3, 20),
    }
    stage = F.lit(None).cast("string") if stage is None else stage
    parts["stage"] = ladder(*[(stage == k, F.lit(v)) for k, v in fixed.STAGE_CONSENSUS.items()], otherwise=F.lit(0.0))
    # No press count at all is a measurement of nothing, so a 0 there doesn't count as taken.
    taken = [get(k).isNotNull() & ((get(k) != 0) if k == "hn_mentions_total" else F.lit(True)) for k in fixed.FOOTPRINT]
    parts["unmeasured"] = F.when(stage.isNull() & ~reduce(lambda a, b: a | b, taken), F.lit(fixed.UNMEASURED)).otherwise(F.lit(0.0))
    return parts


def consensus(parts: Mapping[str, Column]) -> Column:
    return F.round(noisy_or(*parts.values()), 4)


def team_parts(tier_one: Column, other: Column, h_index: Column, followers: Column, repeat: Column) -> Column:
    """One person's share in the team score: up to three known organisations, papers, followers, an earlier company."""
    firsts = F.least(tier_one, F.lit(3))
    others = F.least(other, F.lit(3) - firsts)
    left = F.pow(F.lit(1 - 0.55), firsts) * F.pow(F.lit(1 - 0.3), others)
    return 1 - left * (1 - 0.6 * squash(h_index, 25)) * (1 - 0.3 * squash(followers, 3000)) * (1 - F.when(repeat, F.lit(0.45)).otherwise(F.lit(0.0)))


#: What an entity's edge is made of besides its signals, and what stands for it where nothing is known.
FACTORS = {"fit": 1.0, "earliness": 1.0, "team": 1.0}


def factors(entity: str, fits: DataFrame | None = None, metrics: DataFrame | None = None, people: DataFrame | None = None, asof: Column | None = None) -> DataFrame:
    """(entity, fit, earliness, team): what is written about an entity (fits: entity, fit), what was measured of it (metrics: entity, and
    columns as consensus_parts has them, with founded and stage) and who is in it (people: entity, tier_one, other, h_index, followers, repeat), each
    of which may lack an entity or be missing. An entity without measures is as early as its unmeasured footprint says."""
    out = None
    if fits is not None:
        out = fits.select(entity, "fit")
    if metrics is not None:
        has = {c: F.col(c) for c in metrics.columns}
        parts = consensus_parts({k: v for k, v in has.items() if k not in (entity, "founded", "stage")}, has.get("founded"), asof, has.get("stage"))
        known = metrics.select(entity, (1 - consensus(parts)).alias("earliness"))
        out = known if out is None else out.join(known, entity, "full_outer")
    if people is not None:
        one = team_parts(*[F.col(c) for c in ("tier_one", "other", "h_index", "followers", "repeat")])
        team = people.groupBy(entity).agg(F.round(noisy_or_agg(one), 4).alias("team"))
        out = team if out is None else out.join(team, entity, "full_outer")
    return out


def score_entities(signals: DataFrame, asof: str, weeks: int = 13, entity: str = "entity_id", known: DataFrame | None = None, defaults: Mapping[str, float] = FACTORS) -> DataFrame:
    """Families, momentum, convergence, fit, earliness, team and edge as of a date, and `history`, the edge of each of the last weeks, oldest first.

    `known` has an entity's factors (see `factors`); `defaults` stand for those that it lacks. Past edges take today's factors."""
    dates = {f"w{k}": F.date_sub(F.to_date(F.lit(asof)), 7 * k) for k in range(weeks)}
    wide = family_strengths(signals, dates, entity)
    if known is not None:
        wide = wide.join(known, entity, "left")
    own_factors = {k: F.coalesce(F.col(k), F.lit(v)) if known is not None and k in known.columns else F.lit(v) for k, v in defaults.items()}

    def at(name: str) -> tuple[Column, Column, Column]:
        own = {f: F.col(f"{name}_{f}") for f in fixed.FAMILIES}
        m, n = momentum(own), convergence(list(own.values()))
        return m, n, edge(m, own_factors["fit"], own_factors["earliness"], own_factors["team"], n)

    m, n, e = at("w0")
    history = F.array(*[F.struct(d.alias("t"), at(name)[2].alias("edge")) for name, d in reversed(dates.items())])
    return wide.select(entity, *[F.col(f"w0_{f}").alias(f) for f in fixed.FAMILIES], m.alias("momentum"), n.alias("convergence"), *[c.alias(k) for k, c in own_factors.items()], e.alias("edge"), history.alias("history"))


def velocity_strength(s7: Column, p7: Column, s30: Column, p30: Column, sustained: Column) -> Column:
    """Strength of a repository's daily counts: volume, and acceleration weighted by volume."""
    log2 = lambda a, b, low: clamp(F.log2((a + 1) / (b + 1)), low, 4.0)
    x = 0.12 + 0.85 * (0.55 * squash(s7, 120) + 0.45 * squash(s30, 500)) + squash(s7, 80) * 0.045 * log2(s7, p7, -3.0) + squash(s30, 300) * 0.03 * log2(s30, p30, -2.0) + 0.015 * sustained
    return clamp(x, 0.05, 0.98)
