"""Names for SQL users: temporary SQL functions and a table function."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import fixed


class ExplodeSeries:
    """The last point of a series on or before each of several days (with a day of slack)."""

    def eval(self, series: list, days: list):
        for day in days or []:
            known = [p for p in series or [] if p["t"] <= day + dt.timedelta(days=1)]
            if known:
                last = max(known, key=lambda p: p["t"])
                yield day, last["v"]


def register(spark: SparkSession) -> None:
    """squash, over_floor, decay, noisy_or, clean_domain, normalize_name and classify as SQL functions of the session, explode_series as a table function.

    All but the last are expressions that run in the JVM. noisy_or takes the sum of left_of(x), as in
    noisy_or(sum(left_of(x))), so Spark aggregates it in parts; classify takes a text and an array of rules (pattern, label)."""
    host = "regexp_replace(regexp_replace(regexp_replace(regexp_extract(CASE WHEN contains(u, '://') THEN lower(trim(u)) ELSE concat('http://', lower(trim(u))) END, '^[^/?#]*?://([^/?#]*)', 1), '^.*@', ''), ':.*$', ''), '^www\\\\.', '')"
    shared = "|".join(w.replace(".", "[.]") for w in fixed.GENERIC_HOSTS)
    ends = "|".join(w.replace(".", "[.]") for w in fixed.NON_COMPANY_SUFFIXES)
    caps, forms = fixed.LEGAL_CAPITALS.replace("\\.", "[.]"), fixed.LEGAL.replace("\\.", "[.]").replace("\\s", "[ \t]")
    a_pass = f"(?:[ \t,]+(?:{caps})[.]?)?(?:[ \t,]+(?i:{forms})[.]?)?[ ,]*"
    bare = f"regexp_replace(regexp_replace(trim(n), '(?i)[ \t]*[(](?:d/?b/?a|formerly)[^)]*[)]', ''), '(?<=[^ \t,])(?:{a_pass}){{1,3}}$', '')"
    for ddl in (
        "squash(x DOUBLE, half DOUBLE) RETURNS DOUBLE RETURN CASE WHEN x > 0 THEN x / (x + half) ELSE 0.0D END",
        "over_floor(x DOUBLE, floor DOUBLE, half DOUBLE) RETURNS DOUBLE RETURN CASE WHEN coalesce(x, 0.0D) > floor THEN (x - floor) / (x - floor + half) ELSE 0.0D END",
        "decay(strength DOUBLE, age INT, half_life DOUBLE) RETURNS DOUBLE RETURN strength * pow(0.5D, greatest(age, 0) / half_life)",
        # The logarithm of what is left of 1; that of nothing is so low that its sum stays nothing.
        "left_of(x DOUBLE) RETURNS DOUBLE RETURN CASE WHEN coalesce(x, 0.0D) >= 1 THEN -1e6D ELSE ln(1 - greatest(coalesce(x, 0.0D), 0.0D)) END",
        "noisy_or(total DOUBLE) RETURNS DOUBLE RETURN 1 - exp(coalesce(total, 0.0D))",
        f"clean_domain(u STRING) RETURNS STRING RETURN CASE WHEN {host} NOT LIKE '%.%' OR {host} LIKE '% %' OR regexp_like({host}, '({ends})$') OR regexp_like({host}, '(^|[.])({shared})$') THEN NULL ELSE {host} END",
        f"normalize_name(n STRING) RETURNS STRING RETURN trim(regexp_replace(regexp_replace(regexp_replace(lower({bare}), '[’\\'`]', ''), '[(].*?[)]', ' '), '[^a-z0-9]+', ' '))",
        "classify(said STRING, rules ARRAY<STRUCT<pattern: STRING, label: STRING>>, otherwise STRING) RETURNS STRING RETURN coalesce(get(filter(rules, r -> regexp_like(lower(said), r.pattern)), 0).label, otherwise)",
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {ddl}")
    spark.udtf.register("explode_series", F.udtf(ExplodeSeries, returnType="day date, v double"))
