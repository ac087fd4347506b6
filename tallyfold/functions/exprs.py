"""Column builders: numbers, dates, names, hosts and URLs. Built-in functions only; null in, null out unless said otherwise."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ladder(*rules: tuple[Column, object], otherwise=None) -> Column:
    """The value of the first condition that holds."""
    made = reduce(lambda acc, r: acc.when(*r), rules[1:], F.when(*rules[0]))
    return made.otherwise(otherwise)


# --- numbers


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def squash(x: Column, half: float) -> Column:
    """x / (x + half); 0 for null and for what isn't above 0."""
    return F.when(x > 0, x / (x + F.lit(float(half)))).otherwise(F.lit(0.0))


def over_floor(x: Column, floor: float, half: float) -> Column:
    return squash(F.greatest(F.coalesce(x, F.lit(0.0)) - F.lit(float(floor)), F.lit(0.0)), half)


def noisy_or(*xs: Column) -> Column:
    """1 - the product of what is left by each of several columns, each held within 0 and 1; null counts as 0."""
    return F.lit(1.0) - reduce(lambda a, b: a * b, [F.lit(1.0) - clamp(F.coalesce(x, F.lit(0.0)), 0.0, 1.0) for x in xs])


def noisy_or_agg(x: Column) -> Column:
    """The same over a group's rows, as an aggregate."""
    return F.lit(1.0) - F.product(F.lit(1.0) - clamp(x, 0.0, 1.0))


def interp(x: Column, anchors: Sequence[tuple[float, float]]) -> Column:
    """Straight lines between anchors, flat beyond the ends."""
    (x0, y0), *rest = anchors
    rules, (px, py) = [(x <= x0, F.lit(float(y0)))], (x0, y0)
    for ax, ay in rest:
        rules.append((x <= ax, F.lit(float(py)) + (x - px) * (float(ay - py) / (ax - px))))
        px, py = ax, ay
    return F.when(x.isNotNull(), ladder(*rules, otherwise=F.lit(float(py))))


def half_life(family: Column) -> Column:
    return ladder(*[(family == k, F.lit(v)) for k, v in fixed.HALF_LIFE.items()], otherwise=F.lit(fixed.OTHER_HALF_LIFE))


def decay(strength: Column, age_days: Column, half: Column) -> Column:
    """Strength halved each half-life; an age below 0 counts as 0."""
    return strength * F.pow(F.lit(0.5), F.greatest(age_days, F.lit(0)) / half)


def tier(x: Column, tiers: Sequence[tuple[float, float]], beyond: float = 0.0) -> Column:
    return F.when(x.isNull(), F.lit(beyond)).otherwise(ladder(*[(x <= k, F.lit(v)) for k, v in tiers], otherwise=F.lit(beyond)))


def compact(x: Column) -> Column:
    """1234 as 1.2K, 5600000 as 5.6M."""
    short = lambda d, unit: F.concat(F.regexp_replace(F.format_string("%.1f", F.floor(x / d * 10 + 0.5) / 10), r"\.0$", ""), F.lit(unit))
    return ladder((x >= 1e9, short(1e9, "B")), (x >= 1e6, short(1e6, "M")), (x >= 1e3, short(1e3, "K")), otherwise=F.floor(x + 0.5).cast("string"))


# --- dates


#: A day, or a moment of it with any fraction and zone; its date is the one that is written, whatever the zone.
_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:?\d{2}(:?\d{2}([.,]\d+)?)?)?(Z|[+-]\d{2}(:?\d{2}(:?\d{2})?)?)?)?$"


def parse_date(s: Column) -> Column:
    """The first of the known formats that fits, else the date of an ISO moment; null if none does."""
    s = F.trim(s)
    iso = F.when(s.rlike(_ISO), F.try_to_timestamp(F.substring(s, 1, 10), F.lit("yyyy-MM-dd")).cast("date"))
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)).cast("date") for f in fixed.DATE_FORMATS], iso)


def public_date(signed: Column, entered: Column, today: Column, embargo_days: int = 90) -> Column:
    """When a record could first be seen: after the embargo, not before it was entered, not after today."""
    return F.least(F.greatest(F.date_add(signed, embargo_days), entered), today)


def date_code(award: Column, year: Column) -> Column:
    """An undated award falls to 1 October of the year before its award year."""
    return F.coalesce(award, F.make_date(year - 1, F.lit(10), F.lit(1)))


def season_key(batch: Column) -> Column:
    """'Summer 2026' as 202602, so that batches sort; null if it isn't one."""
    season = F.regexp_extract(batch, r"^(Winter|Spring|Summer|Fall) \d{4}$", 1)
    order = ladder((season == "Winter", 0), (season == "Spring", 1), (season == "Summer", 2), (season == "Fall", 3))
    return F.when(season != "", F.regexp_extract(batch, r"(\d{4})$", 1).cast("int") * 100 + order)


def ago(d: Column, asof: Column) -> Column:
    n = F.datediff(asof, d)
    return ladder((n <= 0, F.lit("today")), (n == 1, F.lit("yesterday")), (n < 14, F.concat(n.cast("string"), F.lit(" days ago"))), (n < 60, F.concat(F.floor(n / 7).cast("string"), F.lit(" weeks ago"))), otherwise=F.concat(F.floor(n / 30).cast("string"), F.lit(" months ago")))


# --- names


def _without_forms(name: Column) -> Column:
    a_pass = rf"(?:[\s,]+(?:{fixed.LEGAL_CAPITALS})\.?)?(?:[\s,]+(?i:{fixed.LEGAL})\.?)?[ ,]*"
    # Forms begin where a word ends; told first, as the passes are dear to try at every letter of a long text.
    return F.regexp_replace(name, rf"(?<=[^\s,])(?=[\s,]|$)(?:{a_pass}){{1,3}}$", "")


def strip_legal(name: Column) -> Column:
    """Trailing legal forms off, in three passes of one form of any case and one in capitals before it, and '(dba ...)' or '(formerly ...)'; something always stays."""
    return _without_forms(F.regexp_replace(F.trim(name), r"(?i)\s*\((?:d/?b/?a|formerly)[^)]*\)", ""))


def normalize_name(name: Column) -> Column:
    low = lambda s: F.translate(F.lower(s), "’'`", "")
    # Most names have no parentheses, and need no patterns for them.
    s = F.when(name.contains("("), F.regexp_replace(low(strip_legal(name)), r"\(.*?\)", " ")).otherwise(low(_without_forms(F.trim(name))))
    return F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))


def loose_name(name: Column) -> Column:
    """normalize_name without one trailing descriptive word, before which a word stays."""
    return F.regexp_replace(normalize_name(name), "(?i)" + fixed.DESCRIPTIVE, "")


def firm_key(name: Column) -> Column:
    """Dots vanish, a leading 'the' goes, the rest as normalize_name."""
    return F.regexp_replace(normalize_name(F.replace(name, F.lit("."), F.lit(""))), "^the ", "")


def contract_key(s: Column) -> Column:
    return F.regexp_replace(F.upper(s), "[^A-Z0-9]", "")


def person_key(name: Column) -> Column:
    """Words in sorted order, so 'Lee, Ann' is 'ann lee'."""
    words = F.split(F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " ")), " ")
    return F.array_join(F.array_sort(words), " ")


def slugify(name: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 60)


def aliases(name: Column) -> Column:
    """Names inside a name: after d/b/a, or in '(formerly ...)'."""
    dba = F.regexp_extract(name, r"(?i)\bd/?b/?a:?\s+([^,()]+)", 1)
    former = F.regexp_extract(name, r"(?i)\(formerly ([^)]+)\)", 1)
    return F.filter(F.array(F.trim(dba), F.trim(former)), lambda x: x != "")


def initials_match(a: Column, b: Column) -> Column:
    """'A. Herrmann' and 'Albrecht Herrmann': same last word, and one first word begins the other."""
    wa, wb = (F.split(F.regexp_replace(F.lower(x), r"\.", ""), " ") for x in (a, b))
    fa, fb = F.element_at(wa, 1), F.element_at(wb, 1)
    return (F.element_at(wa, -1) == F.element_at(wb, -1)) & (fa.startswith(fb) | fb.startswith(fa))


# --- hosts and URLs


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and 'www.'."""
    s = F.lower(F.trim(url))
    host = F.regexp_extract(F.when(s.contains("://"), s).otherwise(F.concat(F.lit("http://"), s)), r"^[^/?#]*?://([^/?#]*)", 1)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":.*$", ""), r"^www\.", "")


def clean_domain(url: Column) -> Column:
    """The host, or null if there is none or it says nothing about a company (shared platforms, schools, governments)."""
    host = host_of(url)
    quote = lambda words: "|".join(w.replace(".", r"\.") for w in words)
    none = (host == "") | ~host.contains(".") | host.contains(" ") | host.rlike(f"({quote(fixed.NON_COMPANY_SUFFIXES)})$") | host.rlike(rf"(^|\.)({quote(fixed.GENERIC_HOSTS)})$")
    return F.when(~none, host)


def url_key(url: Column) -> Column:
    """One key for reposts of a page: no scheme, 'www.', fragment, trailing slash or tracking parameters; the other parameters sorted."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(url), r"(?i)^https?://(www\.)?", ""), "#.*$", ""), r"/+(\?|$)", "$1")
    path = F.substring_index(bare, "?", 1)
    params = F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(fixed.TRACKING))
    query = F.array_join(F.array_sort(params), "&")
    return F.lower(F.when(query == "", path).otherwise(F.concat(path, F.lit("?"), query)))


def owns_domain(name: Column, domain: Column) -> Column:
    """Does the domain's first label carry the name: equal to it squeezed, to its initials, or to one of its words of five letters or more."""
    label = F.element_at(F.split(domain, r"\."), 1)
    words = F.split(normalize_name(name), " ")
    initials = F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")
    return (label == F.array_join(words, "")) | ((F.size(words) > 1) & (label == initials)) | F.exists(words, lambda w: (F.length(w) >= 5) & label.contains(w))


# --- text by rules


def by_rules(text: Column, rules: Sequence[tuple[str, str]], otherwise: str) -> Column:
    """The label of the first pattern that the lower-cased text has."""
    low = F.lower(text)
    return ladder(*[(low.rlike(p), F.lit(label)) for p, label in rules], otherwise=F.lit(otherwise))


def inverted_text(index: Column) -> Column:
    """Text from a map of words to their positions."""
    placed = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(placed), lambda x: x["w"]), " ")
