"""Gates: validation with quarantine, ordered rejection funnels, windows with deferral, and predicates over measured columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.exprs import ladder


def reject_reason(rules: Sequence[tuple[Column, str]]) -> Column:
    """The reason of the first rule that holds (a null condition doesn't), else null."""
    return ladder(*[(F.coalesce(c, F.lit(False)), F.lit(reason)) for c, reason in rules])


def split_rejects(df: DataFrame, rules: Sequence[tuple[Column, str]]) -> tuple[DataFrame, DataFrame]:
    """Rows that no rule rejects, and the others with their reject_reason."""
    marked = df.withColumn("reject_reason", reject_reason(rules))
    return marked.filter(F.col("reject_reason").isNull()).drop("reject_reason"), marked.filter(F.col("reject_reason").isNotNull())


def funnel(df: DataFrame, rules: Sequence[tuple[Column, str]]) -> DataFrame:
    """(reason, n): how many rows each rule rejects in order, and how many are kept. One pass."""
    return df.groupBy(F.coalesce(reject_reason(rules), F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def signal_rules() -> list[tuple[Column, str]]:
    """What every signal must have: a known family, a link, a name, a strength from 0 to 1."""
    return [
        (~F.coalesce(F.col("family").isin(fixed.FAMILIES), F.lit(False)), "unknown family"),
        (~F.coalesce(F.col("url").rlike("^https?://"), F.lit(False)), "no url"),
        (F.trim(F.coalesce("name", F.lit(""))) == "", "no name"),
        (~F.coalesce(F.col("strength").between(0.0, 1.0), F.lit(False)), "strength out of range"),
    ]


def window_class(day: Column, today: Column, lookback: int) -> Column:
    """in, deferred (after today: it waits for the run that contains it) or old."""
    return ladder((day > today, F.lit("deferred")), (day >= F.date_sub(today, lookback), F.lit("in")), otherwise=F.lit("old"))


def settle_clock(df: DataFrame, day: str, today: Column) -> DataFrame:
    """A day ahead is today; further ahead is dropped."""
    ahead = F.datediff(F.col(day), today)
    return df.filter(ahead <= 1).withColumn(day, F.when(ahead == 1, today).otherwise(F.col(day)))


def board_bucket(excluded: Column, portfolio: Column, fit: Column, momentum: Column, reviewed: Column, any_review: Column) -> Column:
    """excluded, portfolio, below (the bar), awaiting (reviews exist, but not of this row) or board."""
    return ladder(
        (F.coalesce(excluded, F.lit(False)), F.lit("excluded")), (F.coalesce(portfolio, F.lit(False)), F.lit("portfolio")),
        ((fit < 0.3) | (momentum < 0.04), F.lit("below")), (any_review & ~reviewed, F.lit("awaiting")), otherwise=F.lit("board"),
    )


def moves(org: Column, age_days: Column, n7: Column, n30: Column, accel7: Column, accel30: Column) -> Column:
    """Does an owner's repository move: young ones by counts, older ones by acceleration too."""
    young = age_days <= 365
    return F.when(young & org, (n30 >= 20) | (n7 >= 10)).when(young, n30 >= 20).otherwise(((accel30 >= 1.5) & (n30 >= 30)) | ((accel7 >= 2) & (n7 >= 20)))


def rises(n4: Column, authors: Column, lift: Column) -> Column:
    """Two mentions of two authors in four weeks, and a rate that grew by half or has nothing before it."""
    return (n4 >= 2) & (authors >= 2) & (lift.isNull() | (lift >= 1.5))


def bought(young_share: Column, blank_share: Column, median_age: Column) -> Column:
    """Activity that looks bought: over half of the actors under 90 days old, or many young ones that nobody follows."""
    return (young_share > 0.5) | ((young_share >= 0.3) & (blank_share >= 0.7) & (median_age < 365))


def real_contributors(df: DataFrame, repo: str, login: str, n: str, bots: str = r"(?i)(\[bot\]|-bot$|^dependabot)") -> DataFrame:
    """The three largest human contributors of each repository, those with three commits or more and ten of them or a twentieth of the lead's."""
    people = df.filter(~F.col(login).rlike(bots))
    order = Window.partitionBy(repo).orderBy(F.desc(n), login)
    ranked = people.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= 3)
    lead = F.max(n).over(Window.partitionBy(repo))
    return ranked.withColumn("lead", lead).filter((F.col(n) >= 3) & ((F.col(n) >= 10) | (F.col(n) >= 0.05 * F.col("lead")))).drop("lead")


def held_terms(text: Column, terms: Sequence[str]) -> Column:
    low = F.lower(text)
    return F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: low.contains(t))
