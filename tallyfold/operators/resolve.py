"""Entity resolution: connected components by joins, hard keys, cautious name merges, golden records, reviews, people."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut_lineage
from .ranking import top_per


def components(members: DataFrame, member: str, key: str) -> DataFrame:
    """(member, component): members that share a key, directly or by others, get the least member among them.

    A key's least member and a member's least key-mate are aggregates that spread by joins until nothing changes;
    each round also takes the label of its label, so long chains halve. Hot keys are split by adaptive joins."""
    edges = cut_lineage(members.select(F.col(member).alias("m"), F.col(key).alias("k")).filter("m IS NOT NULL AND k IS NOT NULL").distinct(), "edges")
    alone = members.select(F.col(member).alias("m")).filter("m IS NOT NULL").distinct()
    labels = cut_lineage(alone.select("m", F.col("m").alias("c")), "labels")
    while True:
        of_key = edges.join(labels, "m").groupBy("k").agg(F.min("c").alias("kc"))
        near = edges.join(of_key, "k").groupBy("m").agg(F.min("kc").alias("nc"))
        step = labels.join(near, "m", "left").select("m", "c", F.least("c", F.coalesce("nc", "c")).alias("n"))
        jump = labels.select(F.col("m").alias("n"), F.col("c").alias("j"))
        now = cut_lineage(step.join(jump, "n").select("m", F.least("n", "j").alias("n"), "c"), "labels")
        labels = now.select("m", F.col("n").alias("c"))
        if now.filter(F.col("n") != F.col("c")).isEmpty():
            return labels.select(F.col("m").alias(member), F.col("c").alias("component"))


def hard_links(signals: DataFrame, row: str, keys: Sequence[str]) -> DataFrame:
    """Rows that share a domain, login or registry number are one cluster; a key counts with its kind. Rows of the same keys are one member (the least of them) while labels spread."""
    pairs = F.filter(F.array(*[F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{k}:"), F.col(k).cast("string"))) for k in keys]), lambda x: x.isNotNull())
    rows = cut_lineage(signals.filter(F.col(row).isNotNull()).select(F.col(row).alias("m"), pairs.alias("keys")).distinct(), "rows")
    sets = cut_lineage(rows.filter(F.size("keys") > 0).groupBy("keys").agg(F.min("m").alias("least")), "sets")
    # A row of several key sets ties them together, as a key does.
    several = rows.groupBy("m").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("m")
    ties = rows.join(several, "m", "left_semi").join(sets, "keys").select("least", F.concat(F.lit(":"), F.col("m").cast("string")).alias("key"))
    found = components(sets.select("least", F.explode("keys").alias("key")).unionByName(ties), "least", "key")
    of = rows.join(sets, "keys", "left").join(found, "least", "left")
    return of.groupBy(F.col("m").alias(row)).agg(F.min(F.coalesce("component", "m")).alias("component"))


def merge_soft(clusters: DataFrame, names: DataFrame, cluster: str = "cluster", domain: str = "domain", name: str = "name", rank: str = "rank") -> DataFrame:
    """(cluster, component) after clusters that share a name merge where it is safe. clusters: cluster, domain (may be null); names: cluster, name, rank (the order in which names are tried).

    In each round every component without a domain proposes its first eligible name only: if the components of that
    name hold one domain together, all merge; if they hold several, those without a domain merge with each other.
    Domains are counted anew each round, so two domains never meet. A rank is one name's alone."""
    now = cut_lineage(clusters.select(cluster, F.col(cluster).alias("component")), "soft")
    own = clusters.filter(F.col(domain).isNotNull()).select(cluster, domain)
    while True:
        domains = now.join(own, cluster).select("component", domain).distinct()
        bare = now.select("component").distinct().join(domains.select("component"), "component", "left_anti").withColumn("bare", F.lit(True))
        held = names.join(now, cluster).select("component", name, rank).distinct().join(bare, "component", "left").withColumn("bare", F.coalesce("bare", F.lit(False)))
        by_name = held.groupBy(name).agg(F.countDistinct("component").alias("n"), F.count(F.when(F.col("bare"), 1)).alias("n_bare"))
        n_domains = held.join(domains, "component").groupBy(name).agg(F.countDistinct(domain).alias("n_domains"))
        state = by_name.join(n_domains, name, "left").withColumn("n_domains", F.coalesce("n_domains", F.lit(0)))
        able = state.filter((F.col("n") > 1) & (((F.col("n_domains") <= 1)) | (F.col("n_bare") > 1)))
        proposals = top_per(held.filter("bare").join(able, name), ["component"], [F.col(rank), F.col(name)])
        with_one = held.filter("NOT bare").join(able.filter("n_domains = 1").select(name), name).groupBy(name).agg(F.min("component").alias("owner"))
        # Components that have the one domain of a name are one company already by that domain.
        least = proposals.groupBy(name).agg(F.min("component").alias("least"))
        target = proposals.join(with_one, name, "left").join(least, name).withColumn("to", F.coalesce("owner", "least"))
        moves = target.filter(F.col("to") != F.col("component")).select("component", "to")
        if moves.isEmpty():
            return now
        now = cut_lineage(now.join(moves, "component", "left").select(cluster, F.coalesce("to", "component").alias("component")), "soft")


def golden_record(members: DataFrame, cluster: str, order: Sequence[Column], first: Sequence[str], longest: Sequence[str] = (), least: Sequence[str] = (), gathered: Sequence[str] = (), most: int = 12) -> DataFrame:
    """One record a cluster: of `first` columns the first value that isn't null by order, of `longest` the longest text, of `least` the least, of `gathered` up to `most` distinct values, sorted and comma-joined."""
    rank = F.struct(*order)
    aggs = [F.min_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c) for c in first]
    aggs += [F.max_by(c, F.struct(F.length(c), F.col(c))).alias(c) for c in longest]
    aggs += [F.min(c).alias(c) for c in least]
    out = members.groupBy(cluster).agg(*aggs) if aggs else members.select(cluster).distinct()
    for c in gathered:
        # The first `most` distinct values only: a large cluster isn't gathered whole.
        kept = top_per(members.filter(F.col(c).isNotNull()).select(cluster, c).distinct(), [cluster], [F.col(c)], most)
        out = out.join(kept.groupBy(cluster).agg(F.array_join(F.array_sort(F.collect_list(c)), ",").alias(c)), cluster, "left")
    return out


def carry_reviews(reviews: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(slug, key): reviews that apply to each current entity. An own review wins; one whose slug is gone follows the one entity that has it as an alias; of two claimants neither gets it."""
    slugs = entities.select("slug")
    own = reviews.join(slugs, "slug", "left_semi").select("slug", F.col("slug").alias("key"))
    gone = reviews.join(slugs, "slug", "left_anti").select(F.col("slug").alias("key"))
    claims = gone.join(aliases.select("slug", F.col("alias").alias("key")), "key").distinct()
    single = claims.join(claims.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("key"), "key", "left_semi")
    free = single.join(own.select("slug"), "slug", "left_anti")
    return own.unionByName(top_per(free, ["slug"], [F.col("key")]).select("slug", "key"))


def merge_people(people: DataFrame, entity: str, key: Column, order: Sequence[Column], first: Sequence[str], most: Sequence[str]) -> DataFrame:
    """Persons of one entity with one name key as one: first non-null values by order, greatest numbers."""
    rank = F.struct(*order)
    return people.withColumn("person", key).groupBy(entity, "person").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c) for c in first], *[F.max(c).alias(c) for c in most], F.count(F.lit(1)).alias("records"))
