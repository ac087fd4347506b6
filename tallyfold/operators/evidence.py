"""Evidence in texts: where people come from, who speaks as a maker, which hosts a text names, whether a hit is real, whether one text backs another, and what an entity's own accounts did."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import clean_domain, host_of, ladder, normalize_name, owns_domain
from .ranking import top_per

# A text part longer than this is a sentence, in which an organisation needs one of these words before it or behind it.
SENTENCE = 90
BEFORE = r"(?i:\b(?:at|from|ex|former|formerly|previously|joined|left|alum of)\b|\bex-)"
BEHIND = r"(?i:\b(?:alum|alumn\w+|engineer|researcher|scientist|veteran|dropout|phd|grad\w*|postdoc|fellow|intern|lead|director|founder|co-founder)\b)"


def pedigree(text: Column, orgs: Sequence[tuple[str, int, Sequence[str]]]) -> Column:
    """The organisations (name, tier, aliases) that a text says a person comes from, as structs of tier and org, best tier first.

    Parts stand between " ; ". Names keep their capitals and have edges of their own; in a sentence they need a word of employment before them (within 40 characters of the same
    clause) or behind them (within 6)."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), " ; "), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    edge, far = "[^A-Za-z0-9]", r"(?:[^.;]{0,39}[^A-Za-z0-9.;])?"

    def stated(alias: str):
        a = re.escape(alias)
        bare, before, behind = f"(^|{edge}){a}($|{edge})", f"{BEFORE}{far}{a}($|{edge})", rf"(^|{edge}){a}(?:{edge}[^.;]{{0,5}})?{BEHIND}"
        return lambda p: p.rlike(bare) & ((F.length(p) <= SENTENCE) | p.rlike(before) | p.rlike(behind))

    found = []
    for org, tier, aliases in orgs:
        names = sorted({org, *aliases}, key=lambda x: (-len(x), x))
        hit = reduce(lambda a, b: a | b, [F.exists(parts, stated(x)) for x in names if len(x) >= 3])
        found.append(F.when(hit, F.struct(F.lit(tier).alias("tier"), F.lit(org).alias("org"))))
    return F.array_sort(F.filter(F.array(*found), lambda x: x.isNotNull()))


def speaks_as_maker(text: Column) -> Column:
    """Does a text speak in the first person?"""
    return F.coalesce(F.lower(text).rlike("(^|[^a-z])(i|we|my|our) "), F.lit(False))


def same_handle(a: Column, b: Column) -> Column:
    """Do two names of accounts go together: one squeezed name within the other (four letters or more), or the same words in any order?"""
    squeezed = lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]", "")
    words = lambda x: F.array_sort(F.array_distinct(F.split(F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " ")), " ")))
    x, y = squeezed(a), squeezed(b)
    within = (F.least(F.length(x), F.length(y)) >= 4) & (x.contains(y) | y.contains(x))
    return F.coalesce(within | ((x != "") & (words(a) == words(b))), F.lit(False))


def host_mentions(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, host, n): how often each text names a company's host, in links and mail addresses."""
    links = F.regexp_extract_all(F.lower(text), F.lit(r"https?://([^\s\"'<>/?#]+)"), F.lit(1))
    mails = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9._%+-]+@([a-z0-9-]+(?:\.[a-z0-9-]+)+)"), F.lit(1))
    named = df.select(key, F.explode(F.concat(links, mails)).alias("u")).select(key, clean_domain(F.col("u")).alias("host"))
    return named.filter(F.col("host").isNotNull()).groupBy(key, "host").agg(F.count(F.lit(1)).alias("n"))


def own_host(df: DataFrame, key: str, name: str, text: str) -> DataFrame:
    """(key, host): of the hosts that a text names the one that carries the name, the most often named first; a name whose hosts say nothing has none."""
    hosts = host_mentions(df, key, text).join(df.select(key, name), key)
    return top_per(hosts.filter(owns_domain(F.col(name), F.col("host"))), [key], [F.desc("n"), F.col("host")]).select(key, "host")


def hit_pattern(kind: Column, value: Column) -> Column:
    """The pattern that a key must match in a text, for `verified`: a host on a host's edges, a name with each word capitalised (case counts)."""
    quoted = F.regexp_replace(value, r"([.\\+*?()\[\]{}|^$])", r"\\$1")
    host = F.concat(F.lit("(?i)(^|[^a-z0-9.-])"), quoted, F.lit("($|[^a-z0-9.-]|[.]($|[^a-z0-9]))"))
    words = F.array_join(F.transform(F.split(normalize_name(value), " "), lambda w: F.initcap(w)), "[ -]")
    return F.when(kind == "host", host).otherwise(F.concat(F.lit("(^|[^A-Za-z0-9])"), words, F.lit("($|[^A-Za-z0-9])")))


def verified(hits: DataFrame, text: str, kind: str, value: str) -> DataFrame:
    """Hits (a text, and the key that a search found it by) whose text bears the key out."""
    return hits.filter(F.col(text).isNotNull() & F.regexp_like(F.col(text), hit_pattern(F.col(kind), F.col(value))))


def split_attention(mentions: DataFrame, keys: Sequence[str], author: str, own: Column) -> DataFrame:
    """Of each key the mentions by others and by own accounts, and the different authors of both."""
    count = lambda c: F.count(F.when(c, 1))
    people = lambda c: F.countDistinct(F.when(c, F.col(author)))
    return mentions.groupBy(*keys).agg(count(~own).alias("attention"), people(~own).alias("authors"), count(own).alias("own"), people(own).alias("own_authors"))


def backed(fit: Column, sure: Column, second: Column, least: float = 0.3, alone: float = 0.465) -> Column:
    """The fit that a text may claim: its own if it is sure or well above one keyword; with a second text on thesis that of one keyword at most; else null."""
    return ladder((sure & (fit >= least), fit), (fit > alone, fit), ((fit > 0) & (second >= least), F.least(F.greatest(fit, F.lit(least)), F.lit(alone))))


def thesis_verdict(own: Column, sure: Column, labels: Column, off: Column, least: float = 0.3, alone: float = 0.465) -> Column:
    """A source's gate as a struct (on, basis, fit): own words on thesis, surely or by more than one keyword; own words that a registry's labels back; labels alone, which don't open the gate; a word of the source's list of lookalikes shuts it unless a sure term stands beside it."""
    off = F.coalesce(off, F.lit(False)) & ~F.coalesce(sure, F.lit(False))
    basis = ladder((off, "lookalike"), ((own >= least) & (F.coalesce(sure, F.lit(False)) | (own > alone)), "own words"), ((own > 0) & (labels >= least), "backed"), (labels >= least, "labels only"), otherwise="nothing")
    fit = ladder((basis == "own words", own), (basis == "backed", F.least(F.greatest(own, F.lit(least)), F.lit(alone))), otherwise=F.lit(0.0))
    return F.struct(basis.isin("own words", "backed").alias("on"), basis.alias("basis"), fit.alias("fit"))


def identity(candidates: DataFrame, left: str, right: str, evidence: Mapping[str, Column], clash: Column) -> DataFrame:
    """(left, right, evidence): of each left the candidate with the strongest evidence that holds, by the order given (least right on ties); candidates that clash on the strongest kind are out."""
    grade = F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(i)) for i, c in enumerate(evidence.values())])
    held = candidates.withColumn("_grade", grade).filter(F.col("_grade").isNotNull() & ~F.coalesce(clash, F.lit(False)))
    best = top_per(held, [left], [F.col("_grade"), F.col(right)])
    return best.select(left, right, F.element_at(F.array(*[F.lit(k) for k in evidence]), F.col("_grade") + 1).alias("evidence"))


def peak_day(daily: DataFrame, keys: Sequence[str], day: str, n: str, first: Column, last: Column) -> DataFrame:
    """Each key's day of most rows, the earliest of equals, held between two days. `daily`: keys, day, n."""
    peak = F.max_by(day, F.struct(F.col(n), -F.unix_date(day)))
    return daily.groupBy(*keys).agg(F.least(F.greatest(peak, first), last).alias("dated"))


def role_weight(role: Column, weights: Mapping[str, float], pedigrees: Column, h_index: Column, has_bio: Column, edge: Column) -> Column:
    """How much a person counts in the people table: the company's edge by role, known organisations (three at most), papers (sixty at most) and a biography."""
    w = ladder(*[(role == k, F.lit(v)) for k, v in weights.items()], otherwise=F.lit(1.0))
    return edge * w * (1 + 0.6 * F.least(pedigrees, F.lit(3)) + F.least(h_index, F.lit(60)) / 60 + 0.15 * has_bio.cast("int"))


def shown_links(links: Column, order: Sequence[str], review_source: str) -> Column:
    """Kinds of a map of links that are shown: web addresses but not the reviewer's, in a fixed order, others behind by name."""
    kept = F.filter(F.map_entries(links), lambda e: e["value"].rlike("^https?://") & (host_of(e["value"]) != review_source))
    rank = F.array(*[F.lit(x) for x in order])
    placed = F.transform(kept, lambda e: F.struct(F.when(F.array_contains(rank, e["key"]), F.array_position(rank, e["key"]).cast("int")).otherwise(len(order) + 1).alias("at"), e["key"].alias("kind")))
    return F.transform(F.array_sort(placed), lambda x: x["kind"])


def adds_to(every: Column, shown: Column) -> Column:
    """Does a full list have more than what is shown of it?"""
    return F.size(F.array_except(every, shown)) > 0


def deferred(rows: DataFrame, day: str, today: Column) -> tuple[DataFrame, DataFrame]:
    """Rows up to today and the holding table of those that lie ahead, which a later run takes in (`released`)."""
    ahead = F.coalesce(F.col(day) > today, F.lit(False))
    return rows.filter(~ahead), rows.filter(ahead)


def released(held: DataFrame, day: str, today: Column) -> tuple[DataFrame, DataFrame]:
    """Of a holding table the rows whose day has come, and those that stay."""
    return deferred(held, day, today)


def repo_hint(name: Column, owner: Column, homepage: Column, owner_site: Column) -> Column:
    """What a repository says of the company behind it: the owner as name and login, and the site that carries the owner's name."""
    site = lambda u: F.when(owns_domain(owner, clean_domain(u)), clean_domain(u))
    return F.struct(owner.alias("name"), F.lower(owner).alias("login"), F.coalesce(site(owner_site), site(homepage)).alias("domain"), F.concat(F.lower(owner), F.lit("/"), F.lower(name)).alias("repo"))


def post_hint(title: Column, url: Column) -> Column:
    """What a launch post says of the product: the name before a dash or colon, the rest as its description, and the site it links to; a repository link names its owner."""
    said = F.regexp_replace(F.trim(title), r"^(?i:(show|launch|tell) hn):\s*", "")
    name = F.trim(F.regexp_extract(said, r"^(.{1,60}?)\s*(?:[:\u2013\u2014]|\s-\s|\(|$)", 1))
    rest = F.trim(F.regexp_replace(said, r"^.{1,60}?\s*(?:[:\u2013\u2014]|\s-\s)\s*", ""))
    login = F.regexp_extract(F.lower(url), r"^https?://(?:www\.)?github\.com/([a-z0-9-]+)", 1)
    return F.struct(name.alias("name"), F.when(rest != said, rest).alias("about"), clean_domain(url).alias("domain"), F.when(login != "", login).alias("login"))
