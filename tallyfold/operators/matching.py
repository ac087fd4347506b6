"""Matching records of different sources: keys in order of trust, scored candidates, overlaps and agreement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import ladder
from .ranking import top_per


def first_key_match(left: DataFrame, left_id: str, left_keys: Column, right: DataFrame, right_id: str, right_keys: Column) -> DataFrame:
    """(left_id, right_id, key): matches by the strongest key that any right row has; a key that several right rows claim matches none of them.

    Keys are arrays, strongest first; one equi-join on the exploded keys does all kinds at once."""
    a = left.select(left_id, F.posexplode(left_keys).alias("trust", "key"))
    b = right.select(right_id, F.explode(right_keys).alias("key")).distinct()
    owned = b.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(right_id).alias(right_id)).filter("n = 1").drop("n")
    return top_per(a.join(owned, "key"), [left_id], [F.col("trust"), F.col("key")]).select(left_id, right_id, "key")


def accepted(candidates: DataFrame, entity: str, site: str, score: Column, bar: Column) -> DataFrame:
    """Candidates at the bar or above, for entities with one accepted site only: two different ones mean neither is known."""
    good = candidates.withColumn("score", F.round(score, 4)).filter(F.col("score") >= bar)
    best = good.groupBy(entity, site).agg(F.max("score").alias("score"))
    lone = best.groupBy(entity).agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select(entity)
    return best.join(lone, entity, "left_semi")


def site_score(exact: Column, slots: Column, copyright_: Column, domain: Column, full_name: Column, shared: Column) -> Column:
    """Confidence that a page is an entity's: a base and what speaks for it. domain: 2 equal, 1 related, 0 neither; shared: facts in common."""
    yes = lambda c, w: F.when(c, F.lit(w)).otherwise(F.lit(0.0))
    return F.lit(0.40) + yes(exact, 0.20) + yes(slots >= 2, 0.10) + yes(copyright_, 0.10) + ladder((domain == 2, F.lit(0.20)), (domain == 1, F.lit(0.10)), otherwise=F.lit(0.0)) + yes(full_name, 0.05) + F.least(shared * 0.05, F.lit(0.20))


def trusted_profiles(people: DataFrame, profiles: DataFrame, person: str, same_name: Column, same_orcid: Column, own: str, homes: str) -> DataFrame:
    """people with `trusted`: a profile counts if names agree, and its registry id does or an affiliation is one of its homes."""
    joined = people.join(profiles, person, "left")
    return joined.withColumn("trusted", F.coalesce(same_name & (F.coalesce(same_orcid, F.lit(False)) | F.coalesce(F.arrays_overlap(own, homes), F.lit(False))), F.lit(False)))


def loose_links(a: DataFrame, a_key: str, a_loose: str, b: DataFrame, b_key: str, b_loose: str) -> DataFrame:
    """(a_key, b_key) equal, or equal when one side drops its describing word: three equi-joins."""
    left, right = a.select(a_key, a_loose).distinct(), b.select(b_key, b_loose).distinct()
    pairs = [(a_key, b_key), (a_loose, b_key), (a_key, b_loose)]
    out = None
    for x, y in pairs:
        met = left.join(right, F.col(x) == F.col(y)).select(a_key, b_key)
        out = met if out is None else out.unionByName(met)
    return out.distinct()


def attributed(documents: DataFrame, dockets: str, parties: str, regulator: Column, addressees: str, most: int = 3) -> DataFrame:
    """A row per docket and party of a document: of up to `most` dockets; the regulator's own documents go to their addressees."""
    few = documents.filter(F.size(dockets) <= most)
    return few.withColumn("party", F.explode(F.when(regulator, F.col(addressees)).otherwise(F.col(parties)))).withColumn("docket", F.explode(dockets))


def merged_team(people: DataFrame, brief: DataFrame, entity: str, key: str, name: str, background: str) -> DataFrame:
    """People of an entity with those of its brief: missing ones added (in_brief only), missing backgrounds filled."""
    a = people.select(entity, key, F.col(name).alias("_n"), F.col(background).alias("_b"))
    b = brief.select(entity, key, F.col(name).alias("_bn"), F.col(background).alias("_bb"))
    return a.join(b, [entity, key], "full_outer").select(entity, key, F.coalesce("_n", "_bn").alias(name), F.coalesce("_b", "_bb").alias(background), F.col("_n").isNull().alias("added"))


def same_post(domain: Column, name: Column, opening: Column, author: Column) -> Column:
    """same, doubt or none, of two posts: equal site or name and opening words; one weaker sign leaves doubt. Columns are nullable booleans."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    no = lambda c: F.coalesce(~c, F.lit(False))
    return ladder((yes(domain), "same"), (no(domain), "none"), (yes(name) & (yes(opening) | yes(author)), "same"), (yes(name) | (yes(opening) & yes(author)), "doubt"), otherwise="none")


def variant_clusters(names: DataFrame, group: str, name: str, n: str, legal: Column, share: float = 0.2) -> DataFrame:
    """(group, name, uses) of each group's heaviest cluster of names. Two names of a group are related if one's words begin the other's, or if they share a first word of five letters or more.

    Clusters grow greedily, names in order of their uses: a name joins the first cluster whose founder it is related to, else it founds one. A name's
    founder is therefore the related one of most uses among founders, which rounds of joins within the group find: in each, names with no
    related name of more uses left found clusters, and those related to them leave. A legal form is preferred as the cluster's name if it
    has two uses or more and a fifth of the cluster's top."""
    from .lineage import cut_lineage

    own = names.groupBy(group, name).agg(F.sum(n).alias("_n"), F.max(legal.cast("int")).alias("_legal"))
    words = F.split(F.lower(F.trim(F.col(name))), r"\s+")
    own = cut_lineage(own.withColumn("_words", words).withColumn("_first", F.element_at("_words", 1)).withColumn("_rank", F.struct((-F.col("_n")).alias("a"), F.col(name).alias("b"))), "names")
    # Related names share their first word: if it is short, one must begin the other.
    a, b = own.select(group, "_first", F.col(name).alias("_a"), F.col("_words").alias("_wa"), F.col("_rank").alias("_ra")), own.select(group, "_first", F.col(name).alias("_b"), F.col("_words").alias("_wb"), F.col("_rank").alias("_rb"))
    fewer = F.least(F.size("_wa"), F.size("_wb"))
    related = (F.length("_first") >= 5) | (F.slice("_wa", F.lit(1), fewer) == F.slice("_wb", F.lit(1), fewer))
    pairs = cut_lineage(a.join(b, [group, "_first"]).filter((F.col("_rb") < F.col("_ra")) & related).select(group, "_a", "_b", "_rb"), "related")
    left = own.select(group, F.col(name).alias("_a"))
    clusters = None
    while True:
        blocked = pairs.join(left.withColumnRenamed("_a", "_b"), [group, "_b"], "left_semi").select(group, "_a").distinct()
        founders = cut_lineage(left.join(blocked, [group, "_a"], "left_anti"), "founders")
        followers = pairs.join(left, [group, "_a"], "left_semi").join(founders.withColumnRenamed("_a", "_b"), [group, "_b"], "left_semi").groupBy(group, "_a").agg(F.min_by("_b", "_rb").alias("_f"))
        made = cut_lineage(founders.select(group, "_a", F.col("_a").alias("_f")).unionByName(followers), "joined")
        clusters = made if clusters is None else clusters.unionByName(made)
        left = cut_lineage(left.join(made, [group, "_a"], "left_anti"), "left")
        if left.isEmpty():
            break
    placed = own.join(clusters.withColumnRenamed("_a", name), [group, name])
    heavy = placed.groupBy(group, "_f").agg(F.sum("_n").alias("uses"), F.max("_n").alias("_top"))
    best = top_per(heavy, [group], [F.desc("uses"), F.col("_f")])
    good = (F.col("_legal") == 1) & (F.col("_n") >= F.greatest(F.lit(2), F.col("_top") * share))
    return top_per(placed.join(best, [group, "_f"]), [group], [F.desc(good.cast("int")), F.desc("_n"), F.col(name)]).select(group, name, "uses")


def overlapping(spans: DataFrame, keys: Sequence[str], item: str, first: str, last: str, least: int = 1) -> DataFrame:
    """Pairs of a key's spans (each with its first and last day) that share `least` days or more: item_a before item_b, and the days shared. An equi-join on the key; a key's spans are few (roles, stays, grants)."""
    a, b = (spans.select(*keys, F.col(item).alias(f"{item}_{x}"), F.col(first).alias(f"_first_{x}"), F.col(last).alias(f"_last_{x}")) for x in "ab")
    days = F.datediff(F.least("_last_a", "_last_b"), F.greatest("_first_a", "_first_b")) + 1
    return a.join(b, list(keys)).filter(F.col(f"{item}_a") < F.col(f"{item}_b")).withColumn("days", days).filter(F.col("days") >= least).select(*keys, f"{item}_a", f"{item}_b", "days")


def newest_batches(batches: DataFrame, key: str, begun: Column, members: str, n: int, least: int = 10) -> DataFrame:
    """The n newest batches; one that hasn't begun and is small is a placeholder."""
    return batches.filter(begun | (F.col(members) >= least)).orderBy(F.desc(key)).limit(n)


def firmer(people: DataFrame, keys: Sequence[str], weight: Column, kept: Sequence[str], filled: Sequence[str]) -> DataFrame:
    """Two records of a person as one: the firmer keeps its name and role, the other fills what is missing."""
    rank = F.struct((-weight).alias("w"), *[F.col(c) for c in kept])
    return people.groupBy(*keys).agg(*[F.min_by(c, rank).alias(c) for c in kept], *[F.min_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c) for c in filled])
