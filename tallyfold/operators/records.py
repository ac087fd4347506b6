"""Records read from semi-structured text: goods of marks, headers of hiring posts, affiliation lines; and discounts of what is measured."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import clamp, ladder, squash


def goods_shares(goods: DataFrame, mark: str, class_: str, thesis: Column, consumer: Column) -> DataFrame:
    """(mark, share, best_class_share, consumer_share, verdict) of a mark's goods: thesis goods need a tenth overall and three tenths of one class; more than a quarter of consumer goods drops it."""
    per = goods.groupBy(mark, class_).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(thesis, 1)).alias("t"), F.count(F.when(consumer, 1)).alias("c"))
    m = per.groupBy(mark).agg((F.sum("t") / F.sum("n")).alias("share"), F.max(F.col("t") / F.col("n")).alias("best_class_share"), (F.sum("c") / F.sum("n")).alias("consumer_share"))
    verdict = ladder((F.col("consumer_share") > 0.25, F.lit("consumer")), ((F.col("share") >= 0.1) & (F.col("best_class_share") >= 0.3), F.lit("kept")), otherwise=F.lit("off thesis"))
    return m.withColumn("verdict", verdict)


def header_fields(post: Column) -> Column:
    """(name, role, place, remote, team_size) of a hiring post whose first line is fields between bars; null fields where they are missing."""
    line = F.substring_index(post, "\n", 1)
    parts = F.filter(F.transform(F.split(line, r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    rest = F.slice(parts, 2, 50)
    remote = F.exists(rest, lambda x: F.lower(x).rlike(r"\bremote\b"))
    place = F.filter(rest, lambda x: x.rlike(r"^\p{Lu}[\p{L} .]+, ?\p{Lu}") | F.lower(x).rlike(r"\bonsite\b"))
    role = F.filter(rest, lambda x: F.lower(x).rlike(r"\b(engineer|developer|designer|scientist|technician|manager)s?\b"))
    size = F.nullif(F.regexp_extract(post, r"(?i)\bteam of (\d{1,4})\b", 1), F.lit("")).cast("int")
    return F.struct(F.get(parts, F.lit(0)).alias("name"), F.get(role, F.lit(0)).alias("role"), F.get(place, F.lit(0)).alias("place"), remote.alias("remote"), size.alias("team_size"))


#: Fixed value: words of an affiliation line that say it is no company.
NO_COMPANY = r"(?i)\b(university|universit[àäé]t?|universidad|institute of technology|college|school|academy|national lab(oratory)?|hospital|ministry)\b"


def affiliation(line: Column) -> Column:
    """(company, place, is_company) of a raw affiliation line: the first field that isn't a department, the last one as place."""
    parts = F.filter(F.transform(F.split(line, "[,;]"), lambda x: F.trim(x)), lambda x: (x != "") & ~F.lower(x).rlike(r"^(dept|department|division|faculty)\b"))
    company = F.get(parts, F.lit(0))
    return F.struct(company.alias("company"), F.when(F.size(parts) > 1, F.element_at(parts, -1)).alias("place"), (~line.rlike(NO_COMPANY) & company.isNotNull()).alias("is_company"))


def discounted(strength: Column, young_share: Column, board_size: Column, familiar: Column) -> Column:
    """Strength after what makes it less sure: many young actors, a very large board, an entity long talked about."""
    quality = F.when(young_share > 0.2, F.greatest(F.lit(0.4), 1 - 2 * (young_share - 0.2))).otherwise(1.0)
    taper = 1 - 0.4 * squash(board_size - 100, 400)
    return clamp(strength * quality * taper * (1 - 0.6 * squash(familiar - 50, 400)), 0.0, 1.0)


def fallback_percentile(ratio: Column, known: Sequence[tuple[float, float]]) -> Column:
    """A percentile from a few known ones, straight lines over the logarithm of the ratio; beyond the last it nears 99.9. known: (ratio, percentile) rising."""
    lg = F.log(ratio)
    (r0, p0), *rest = known
    rules, (pr, pp) = [(ratio <= r0, F.lit(float(p0)) * ratio / r0)], (r0, p0)
    for r, p in rest:
        slope = (p - pp) / (F.log(F.lit(float(r))) - F.log(F.lit(float(pr))))
        rules.append((ratio <= r, pp + (lg - F.log(F.lit(float(pr)))) * slope))
        pr, pp = r, p
    return ladder(*rules, otherwise=F.least(F.lit(99.9), pp + (lg - F.log(F.lit(float(pr)))) * (99.9 - pp) / 2))


def merged_maps(df: DataFrame, keys: Sequence[str], column: str, order: Sequence[Column]) -> DataFrame:
    """One map a key: of each entry the first value that isn't null, by order. Entries are grouped, not maps gathered."""
    rank = F.struct(*order)
    entries = df.select(*keys, rank.alias("_o"), F.explode(column).alias("_k", "_v")).filter(F.col("_v").isNotNull())
    best = entries.groupBy(*keys, "_k").agg(F.min_by("_v", "_o").alias("_v"))
    return best.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_v")))).alias(column))
