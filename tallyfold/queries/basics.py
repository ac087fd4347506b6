"""Gates, scalar functions and scores."""

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import exprs as X
from ..functions import fixed
from ..operators import quality
from ..operators.ranking import ranked_top
from ..plans import score
from ..sources.views import ASOF, asof_day, awards, measured, signals, table
from .sqltext import AW, CONVERGENCE, MOMENTUM, SIG, families, live, over, scored, sq
from .sqltext import measured as all_signals


@query("m0_board", f"{all_signals(1)} SELECT entity_id, momentum, CAST(convergence AS INTEGER) AS convergence, edge, CAST(row_number() OVER (ORDER BY edge DESC, entity_id) AS INTEGER) AS rank FROM edges ORDER BY edge DESC, entity_id LIMIT 20")
def m0_board(spark, sf):
    s = score.score_entities(measured(spark, sf), ASOF, weeks=1)
    return ranked_top(s.select("entity_id", "momentum", "convergence", "edge"), [F.desc("edge"), F.col("entity_id")], 20)


@query("b1_validate", """
SELECT coalesce(CASE WHEN family IS NULL THEN 'unknown family' WHEN NOT regexp_matches(url, '^https?://') THEN 'no url'
  WHEN trim(name) = '' THEN 'no name' WHEN NOT strength BETWEEN 0 AND 1 THEN 'strength out of range' END, 'kept') AS reason, count(*) AS n
FROM (SELECT CASE event_type WHEN 'purchase' THEN 'capital' WHEN 'signup' THEN 'regulatory' WHEN 'error' THEN 'github' WHEN 'click' THEN 'social' END AS family,
  CASE WHEN user_id % 10 = 3 THEN 'ftp://e' ELSE 'https://e' END AS url, CASE WHEN event_id % 7 = 0 THEN ' ' ELSE 'n' END AS name, value / 200 AS strength FROM events) GROUP BY 1""")
def b1_validate(spark, sf):
    e = table(spark, sf, "events")
    rows = e.select(
        X.ladder((F.col("event_type") == "purchase", "capital"), (F.col("event_type") == "signup", "regulatory"), (F.col("event_type") == "error", "github"), (F.col("event_type") == "click", "social")).alias("family"),
        F.when(F.col("user_id") % 10 == 3, "ftp://e").otherwise("https://e").alias("url"), F.when(F.col("event_id") % 7 == 0, " ").otherwise("n").alias("name"), (F.col("value") / 200).alias("strength"),
    )
    return quality.funnel(rows, quality.signal_rules())


@query("b2_funnel", f"{AW} SELECT CASE WHEN status = 'P' THEN 'pending' WHEN amount < 50000 THEN 'small' WHEN day < DATE '1996-01-01' THEN 'old' WHEN priority = '5-LOW' THEN 'low' ELSE 'kept' END AS reason, count(*) AS n FROM awards GROUP BY 1")
def b2_funnel(spark, sf):
    return quality.funnel(awards(spark, sf), [(F.col("status") == "P", "pending"), (F.col("amount") < 50000, "small"), (F.col("day") < "1996-01-01", "old"), (F.col("priority") == "5-LOW", "low")])


@query("b3_window", f"{SIG} SELECT CASE WHEN occurred_at > DATE '2024-01-25' THEN 'deferred' WHEN occurred_at >= DATE '2024-01-11' THEN 'in' ELSE 'old' END AS class, count(*) AS n FROM signals GROUP BY 1")
def b3_window(spark, sf):
    return signals(spark, sf).groupBy(quality.window_class(F.col("occurred_at"), F.to_date(F.lit("2024-01-25")), 14).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("b5_gate", f"{SIG}, {scored()} SELECT CASE WHEN entity_id % 17 = 0 THEN 'excluded' WHEN entity_id % 13 = 0 THEN 'portfolio' WHEN momentum < 0.04 THEN 'below' WHEN entity_id % 3 = 0 THEN 'awaiting' ELSE 'board' END AS bucket, count(*) AS n, round(max(edge), 2) AS best FROM scored GROUP BY 1")
def b5_gate(spark, sf):
    s, e = score.score_entities(signals(spark, sf), ASOF, weeks=1), F.col("entity_id")
    bucket = quality.board_bucket(e % 17 == 0, e % 13 == 0, F.lit(1.0), F.col("momentum"), e % 3 != 0, F.lit(True))
    return s.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.max("edge"), 2).alias("best"))


@query("b7_stop_list", "SELECT p_brand, count(*) AS n FROM part WHERE NOT regexp_matches(p_name, '(^| )(widget|gizmo)( |$)') GROUP BY 1")
def b7_stop_list(spark, sf):
    return table(spark, sf, "part").filter(~F.col("p_name").rlike("(^| )(widget|gizmo)( |$)")).groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


@query("b11_faceted", f"{SIG}, {families()} SELECT entity_id, {MOMENTUM} AS momentum FROM fam WHERE capital >= 0.12 AND social >= 0.12 AND entity_id % 4 = 1")
def b11_faceted(spark, sf):
    s = score.score_entities(signals(spark, sf), ASOF, weeks=1)
    return s.filter((F.col("capital") >= fixed.FIRING) & (F.col("social") >= fixed.FIRING) & (F.col("entity_id") % 4 == 1)).select("entity_id", "momentum")


@query("b12_stage", "SELECT view, count(*) AS n FROM (SELECT CASE WHEN status IN ('P') THEN 'growth' ELSE 'young' END AS view FROM (SELECT nullif(o_orderstatus, 'F') AS status FROM orders)) GROUP BY 1")
def b12_stage(spark, sf):
    stage = F.nullif(F.col("o_orderstatus"), F.lit("F"))
    return table(spark, sf, "orders").groupBy(F.when(F.coalesce(stage.isin("P"), F.lit(False)), "growth").otherwise("young").alias("view")).agg(F.count(F.lit(1)).alias("n"))


@query("b13_state_news", f"{SIG} SELECT CASE WHEN subject % 9 = 0 OR strength <= 0 THEN 'state' WHEN strength <= 0.18 THEN 'faint' ELSE 'news' END AS class, count(*) AS n FROM signals GROUP BY 1")
def b13_state_news(spark, sf):
    c = X.ladder(((F.col("subject") % 9 == 0) | (F.col("strength") <= 0), F.lit("state")), (F.col("strength") <= 0.18, F.lit("faint")), otherwise=F.lit("news"))
    return signals(spark, sf).groupBy(c.alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("b14_distinctive", "SELECT source, count(*) AS n, round(avg(CAST(starts_with(text, upper(left(text, 1))) AS DOUBLE)), 6) AS share FROM documents GROUP BY 1 HAVING avg(CAST(starts_with(text, upper(left(text, 1))) AS DOUBLE)) >= 0.8")
def b14_distinctive(spark, sf):
    capital = F.col("text").startswith(F.upper(F.substring("text", 1, 1))).cast("double")
    return table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(capital), 6).alias("share"), F.avg(capital).alias("s")).filter("s >= 0.8").drop("s")


@query("b16_established", "SELECT o_custkey AS firm, count(*) AS n_awards, CAST(min(CAST(o_orderdate AS DATE)) AS VARCHAR) AS first_day FROM orders GROUP BY 1 HAVING count(*) >= 16 OR min(CAST(o_orderdate AS DATE)) < DATE '1995-01-20'")
def b16_established(spark, sf):
    return awards(spark, sf).groupBy("firm").agg(F.count(F.lit(1)).alias("n_awards"), F.min("day").alias("first_day")).filter((F.col("n_awards") >= 16) | (F.col("first_day") < "1995-01-20")).withColumn("first_day", F.col("first_day").cast("string"))


@query("b18_contributors", """
WITH c AS (SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS repo, CASE WHEN user_id % 20 = 0 THEN 'x[bot]' ELSE 'u' || user_id END AS login, count(*) AS n FROM events GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY n DESC, login) AS nth FROM c WHERE NOT login LIKE '%[bot]')
SELECT repo, login, n, CAST(nth AS INTEGER) AS nth FROM (SELECT *, max(n) OVER (PARTITION BY repo) AS lead FROM r WHERE nth <= 3) WHERE n >= 3 AND (n >= 10 OR n >= 0.05 * lead)""")
def b18_contributors(spark, sf):
    login = F.when(F.col("user_id") % 20 == 0, "x[bot]").otherwise(F.concat(F.lit("u"), F.col("user_id").cast("string")))
    c = table(spark, sf, "events").groupBy(F.get_json_object("props", "$.k").cast("int").alias("repo"), login.alias("login")).agg(F.count(F.lit(1)).alias("n"))
    return quality.real_contributors(c, "repo", "login", "n")


@query("b20_clock", f"{SIG} SELECT CAST(least(occurred_at, DATE '2024-01-20') AS VARCHAR) AS day, count(*) AS n FROM signals WHERE occurred_at <= DATE '2024-01-21' GROUP BY 1")
def b20_clock(spark, sf):
    today = F.to_date(F.lit("2024-01-20"))
    return quality.settle_clock(signals(spark, sf), "occurred_at", today).groupBy(F.col("occurred_at").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))


# --- scalar functions

_HOST = r"regexp_replace(regexp_replace(lower(url), '^[a-z]+://([^/?#]*).*$', '\1'), '^www\.', '')"


@query("s1_clean_domain", f"SELECT host AS domain, count(*) AS n FROM (SELECT {_HOST} AS host FROM pages) WHERE NOT regexp_matches(host, '\\.(edu|gov|mil)$') GROUP BY 1")
def s1_clean_domain(spark, sf):
    return table(spark, sf, "pages").groupBy(X.clean_domain(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("domain").isNotNull())


def _name():
    end = X.ladder((F.col("p_size") % 4 == 0, F.lit(", Inc.")), (F.col("p_size") % 4 == 1, F.lit(" Robotics LLC")), (F.col("p_size") % 4 == 2, F.lit(" Labs (formerly Acme) GmbH")), (F.col("p_size") % 8 == 3, F.lit(" Inc LLC, Ltd. Corp")), otherwise=F.lit(" SA Inc AG, "))
    return F.concat(F.initcap("p_name"), end)


_NAME_SQL = """array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || x[2:]), ' ') ||
  CASE WHEN p_size % 4 = 0 THEN ', Inc.' WHEN p_size % 4 = 1 THEN ' Robotics LLC' WHEN p_size % 4 = 2 THEN ' Labs (formerly Acme) GmbH'
    WHEN p_size % 8 = 3 THEN ' Inc LLC, Ltd. Corp' ELSE ' SA Inc AG, ' END"""
_BARE_SQL = r"regexp_replace(trim(name), '\s*\(formerly[^)]*\)', '', 'gi')"
for _ in range(3):
    _BARE_SQL = rf"rtrim(regexp_replace(regexp_replace({_BARE_SQL}, '(?i)[\s,]+(inc|llc|gmbh|ltd|corp)\.?$', ''), '[\s,]+(SA|AG)\.?$', ''), ' ,')"


@query("s2_strip_legal", f"SELECT {_BARE_SQL} AS bare, count(*) AS n FROM (SELECT {_NAME_SQL} AS name FROM part) GROUP BY 1")
def s2_strip_legal(spark, sf):
    return table(spark, sf, "part").groupBy(X.strip_legal(_name()).alias("bare")).agg(F.count(F.lit(1)).alias("n"))


@query("s3_normalize_name", f"SELECT lower({_BARE_SQL}) AS key, count(*) AS n FROM (SELECT {_NAME_SQL} AS name FROM part) GROUP BY 1")
def s3_normalize_name(spark, sf):
    return table(spark, sf, "part").groupBy(X.normalize_name(_name()).alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query("s4_loose_name", rf"SELECT regexp_replace(lower({_BARE_SQL}), '\s+(robotics|labs)$', '') AS key, count(*) AS n FROM (SELECT {_NAME_SQL} AS name FROM part) GROUP BY 1")
def s4_loose_name(spark, sf):
    return table(spark, sf, "part").groupBy(X.loose_name(_name()).alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query("s5_person_key", "SELECT array_to_string(list_sort(string_split(lower(p_name), ' ')), ' ') AS key, count(*) AS n, max(regexp_replace(upper(p_brand), '[^A-Z0-9]', '', 'g')) AS brand FROM part GROUP BY 1")
def s5_person_key(spark, sf):
    return table(spark, sf, "part").groupBy(X.person_key(F.col("p_name")).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.max(X.contract_key(F.col("p_brand"))).alias("brand"))


@query("s7_slugs", "SELECT p_partkey, CASE WHEN nth = 1 THEN slug ELSE slug || '-' || nth END AS slug FROM (SELECT p_partkey, replace(p_name, ' ', '-') AS slug, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS nth FROM part)")
def s7_slugs(spark, sf):
    from pyspark.sql import Window

    p = table(spark, sf, "part").select("p_partkey", X.slugify(F.col("p_name")).alias("slug"))
    nth = F.row_number().over(Window.partitionBy("slug").orderBy("p_partkey"))
    return p.withColumn("nth", nth).select("p_partkey", F.when(F.col("nth") == 1, F.col("slug")).otherwise(F.concat("slug", F.lit("-"), F.col("nth").cast("string"))).alias("slug"))


_SAID = ["yyyy-MM-dd", "MM/dd/yyyy", "MMMM d, yyyy", "yyyyMMdd", "MMM d yyyy", "MMMM d yyyy", "MMM d, yyyy", "M-d-yyyy", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T22:00:00+02:00'"]


@query("s8_parse_date", f"SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, count(*) AS n FROM orders WHERE o_orderkey % {len(_SAID) + 1} <> {len(_SAID)} GROUP BY 1")
def s8_parse_date(spark, sf):
    """Order dates written in each of the known ways, and a text that is no date."""
    d, k = F.to_timestamp("o_orderdate"), F.col("o_orderkey") % (len(_SAID) + 1)
    said = X.ladder(*[(k == i, F.date_format(d, f)) for i, f in enumerate(_SAID)], otherwise=F.lit("some day"))
    return table(spark, sf, "orders").groupBy(X.parse_date(said).cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("day").isNotNull())


@query("s9_date_code", f"{AW} SELECT CASE WHEN status = 'P' THEN make_date(year(day) - 1, 10, 1) ELSE day END::VARCHAR AS code, count(*) AS n FROM awards GROUP BY 1")
def s9_date_code(spark, sf):
    return awards(spark, sf).groupBy(X.date_code(F.when(F.col("status") != "P", F.col("day")), F.year("day")).cast("string").alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query("s10_public_date", "SELECT least(greatest(CAST(o_orderdate AS DATE) + 90, CAST(l_shipdate AS DATE)), DATE '2001-06-01')::VARCHAR AS public_at, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def s10_public_date(spark, sf):
    o, li = table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), table(spark, sf, "lineitem").select("l_orderkey", "l_shipdate")
    at = X.public_date(F.to_date("o_orderdate"), F.to_date("l_shipdate"), F.to_date(F.lit("2001-06-01")))
    return o.join(li, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(at.cast("string").alias("public_at")).agg(F.count(F.lit(1)).alias("n"))


@query("s11_release_lag", "SELECT l_returnflag, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS lag_days, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def s11_release_lag(spark, sf):
    o, li = table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), table(spark, sf, "lineitem").select("l_orderkey", "l_shipdate", "l_returnflag")
    return o.join(li, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_returnflag", F.datediff("l_shipdate", "o_orderdate").cast("long").alias("lag_days")).agg(F.count(F.lit(1)).alias("n"))


@query("s12_squash", f"SELECT event_type, round(avg({sq('value', 100)}), 6) AS mean, round(avg({over('value', 50, 200)}), 6) AS mean_over FROM events GROUP BY 1")
def s12_squash(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.avg(X.squash(v, 100)), 6).alias("mean"), F.round(F.avg(X.over_floor(v, 50, 200)), 6).alias("mean_over"))


@query("s13_noisy_or", f"{SIG} SELECT entity_id, round(1 - product(1 - strength), 6) AS p FROM signals GROUP BY 1")
def s13_noisy_or(spark, sf):
    return signals(spark, sf).groupBy("entity_id").agg(F.round(X.noisy_or_agg(F.col("strength")), 6).alias("p"))


@query("s14_interp", "SELECT o_orderpriority, round(avg(CASE WHEN x <= 4 THEN 0.1 WHEN x <= 5 THEN 0.1 + (x - 4) * 0.5 WHEN x <= 5.5 THEN 0.6 + (x - 5) * 0.6 ELSE 0.9 END), 6) AS weight FROM (SELECT o_orderpriority, log10(o_totalprice) AS x FROM orders) GROUP BY 1")
def s14_interp(spark, sf):
    w = X.interp(F.log10("o_totalprice"), [(4, 0.1), (5, 0.6), (5.5, 0.9)])
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.round(F.avg(w), 6).alias("weight"))


@query("s15_decay", f"{SIG} SELECT entity_id, family, round(sum({live()}), 6) AS live FROM signals GROUP BY ALL")
def s15_decay(spark, sf):
    s = score.strength_asof(F.col("strength"), F.col("family"), F.col("occurred_at"), asof_day())
    return signals(spark, sf).groupBy("entity_id", "family").agg(F.round(F.sum(s), 6).alias("live"))


@query("s16_tiers", "SELECT CASE WHEN o_totalprice <= 100000 THEN 0.85 WHEN o_totalprice <= 400000 THEN 0.5 WHEN o_totalprice <= 1000000 THEN 0.25 WHEN o_totalprice <= 2000000 THEN 0.08 ELSE 0.0 END::DOUBLE AS traffic, count(*) AS n FROM orders GROUP BY 1")
def s16_tiers(spark, sf):
    return table(spark, sf, "orders").groupBy(X.tier(F.col("o_totalprice"), fixed.TRAFFIC_TIERS).alias("traffic")).agg(F.count(F.lit(1)).alias("n"))


_ROLES = [(r"\b(bolt|gear)\b", "hardware"), (r"\b(ring|plate)\b", "material"), ("widget|gizmo", "software")]


@query("s17_role_class", r"SELECT CASE WHEN regexp_matches(lower(p_name), '\b(bolt|gear)\b') THEN 'hardware' WHEN regexp_matches(lower(p_name), '\b(ring|plate)\b') THEN 'material' WHEN regexp_matches(lower(p_name), 'widget|gizmo') THEN 'software' ELSE 'other' END AS function, count(*) AS n FROM part GROUP BY 1")
def s17_role_class(spark, sf):
    return table(spark, sf, "part").groupBy(X.by_rules(F.col("p_name"), _ROLES, "other").alias("function")).agg(F.count(F.lit(1)).alias("n"))


@query("s18_role_group", "SELECT CASE WHEN role = 'user' THEN 'founder' WHEN role = 'assistant' THEN 'researcher' ELSE 'other' END AS role_group, round(sum(CASE WHEN role = 'user' THEN 1.35 WHEN role = 'assistant' THEN 1.1 ELSE 1.0 END), 6) AS weight FROM conversations GROUP BY 1")
def s18_role_group(spark, sf):
    group = X.by_rules(F.col("role"), [("^user$", "founder"), ("^assistant$", "researcher")], "other")
    weight = X.ladder((group == "founder", F.lit(1.35)), (group == "researcher", F.lit(1.1)), otherwise=F.lit(1.0))
    return table(spark, sf, "conversations").groupBy(group.alias("role_group")).agg(F.round(F.sum(weight), 6).alias("weight"))


_URL_SQL = r"""(SELECT page_id, lower(path || CASE WHEN q = '' THEN '' ELSE '?' || q END) AS key FROM (
  SELECT page_id, string_split(bare, '?')[1] AS path, array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT string_split(p, '=')[1] IN ('utm_source', 'ref'))), '&') AS q FROM (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^https?://(www\.)?', ''), '#.*$', ''), '/+(\?|$)', '\1') AS bare FROM pages)))"""


@query("s19_url_key", f"SELECT key, count(*) AS n FROM {_URL_SQL} GROUP BY 1")
def s19_url_key(spark, sf):
    return table(spark, sf, "pages").groupBy(X.url_key(F.col("url")).alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query("s20_arrays", f"{SIG} SELECT entity_id, array_to_string(list_sort(list_distinct(list(kind))), ';') AS kinds, array_to_string(list_sort(list(DISTINCT subject))[1:3], ';') AS first_subjects FROM signals GROUP BY 1")
def s20_arrays(spark, sf):
    return signals(spark, sf).groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_set("kind")), ";").alias("kinds"), F.array_join(F.slice(F.array_sort(F.collect_set("subject")), 1, 3), ";").alias("first_subjects"))


@query("s24_own_domain", rf"SELECT count(*) AS n, count(*) FILTER (WHERE contains(label, lower(word)) AND length(word) >= 5 OR label = lower(word)) AS own FROM (SELECT string_split({_HOST}, '.')[1] AS label, regexp_extract(html, '<title>([A-Za-z]+)', 1) AS word FROM pages) WHERE word <> ''")
def s24_own_domain(spark, sf):
    p = table(spark, sf, "pages").select(X.host_of(F.col("url")).alias("host"), F.regexp_extract("html", "<title>([A-Za-z]+)", 1).alias("word")).filter("word <> ''")
    return p.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(X.owns_domain(F.col("word"), F.col("host")), 1)).alias("own"))


@query("s26_compact", "SELECT CASE WHEN x >= 1e6 THEN regexp_replace(format('{:.1f}', floor(x / 1e6 * 10 + 0.5) / 10), '\\.0$', '') || 'M' WHEN x >= 1e3 THEN regexp_replace(format('{:.1f}', floor(x / 1e3 * 10 + 0.5) / 10), '\\.0$', '') || 'K' ELSE CAST(CAST(floor(x + 0.5) AS BIGINT) AS VARCHAR) END AS shown, count(*) AS n FROM (SELECT o_totalprice AS x FROM orders) GROUP BY 1")
def s26_compact(spark, sf):
    return table(spark, sf, "orders").groupBy(X.compact(F.col("o_totalprice")).alias("shown")).agg(F.count(F.lit(1)).alias("n"))


@query("s29_aliases", r"SELECT alias, count(*) AS n FROM (SELECT unnest([trim(regexp_extract(name, '(?i)\bd/?b/?a:?\s+([^,()]+)', 1)), trim(regexp_extract(name, '(?i)\(formerly ([^)]+)\)', 1))]) AS alias FROM (SELECT CASE WHEN p_size % 2 = 0 THEN p_brand || ' d/b/a ' || p_name ELSE p_brand || ' (formerly ' || p_name || ')' END AS name FROM part)) WHERE alias <> '' GROUP BY 1")
def s29_aliases(spark, sf):
    name = F.when(F.col("p_size") % 2 == 0, F.concat("p_brand", F.lit(" d/b/a "), "p_name")).otherwise(F.concat("p_brand", F.lit(" (formerly "), "p_name", F.lit(")")))
    return table(spark, sf, "part").select(F.explode(X.aliases(name)).alias("alias")).groupBy("alias").agg(F.count(F.lit(1)).alias("n"))


@query("s31_inverted_index", "SELECT doc_id, text FROM (SELECT doc_id, array_to_string(string_split(text, ' '), ' ') AS text FROM documents)")
def s31_inverted_index(spark, sf):
    """Words to positions and back: the text is the same."""
    words = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", " ", -1)).alias("p", "w"))
    index = words.groupBy("doc_id", "w").agg(F.collect_list("p").alias("ps")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("index"))
    return index.select("doc_id", X.inverted_text(F.col("index")).alias("text"))


@query("s32_season", f"{AW} SELECT CAST(year(day) * 100 + CASE WHEN month(day) <= 3 THEN 0 WHEN month(day) <= 6 THEN 1 WHEN month(day) <= 9 THEN 2 ELSE 3 END AS INTEGER) AS season, count(*) AS n FROM awards GROUP BY 1")
def s32_season(spark, sf):
    named = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("Winter", "Spring", "Summer", "Fall")]), F.quarter("day")), F.lit(" "), F.year("day").cast("string"))
    return awards(spark, sf).groupBy(X.season_key(named).alias("season")).agg(F.count(F.lit(1)).alias("n"))


# --- scores


@query("g1_family_strength", f"{SIG}, {families()} SELECT entity_id, capital, regulatory, github, social, hiring FROM fam")
def g1_family_strength(spark, sf):
    wide = score.family_strengths(signals(spark, sf), {"now": asof_day()})
    return wide.select("entity_id", *[F.col(f"now_{f}").alias(f) for f in ("capital", "regulatory", "github", "social", "hiring")])


@query("g2_metric_fold", "SELECT user_id AS entity_id, max(value) AS top_value, min(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS best_rank FROM events GROUP BY 1")
def g2_metric_fold(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("entity_id")).agg(F.max("value").alias("top_value"), F.min(F.get_json_object("props", "$.k").cast("int")).alias("best_rank"))


@query("g3_momentum", f"{SIG}, {families()} SELECT entity_id, {MOMENTUM} AS momentum, CAST({CONVERGENCE} AS INTEGER) AS convergence FROM fam")
def g3_momentum(spark, sf):
    return score.score_entities(signals(spark, sf), ASOF, weeks=1).select("entity_id", "momentum", "convergence")


@query("t4_backcast", f"{all_signals(13)} SELECT entity_id, CAST(d AS VARCHAR) AS t, edge FROM edges")
def t4_backcast(spark, sf):
    """The edge of each of the last thirteen weeks, from single and continuous signals."""
    s = score.score_entities(measured(spark, sf), ASOF)
    return s.select("entity_id", F.explode("history").alias("h")).select("entity_id", F.col("h.t").cast("string").alias("t"), "h.edge")


@query("j10_awards_once", f"{SIG} SELECT entity_id, family, round(1 - product(1 - strength), 6) AS p FROM (SELECT entity_id, family, max(strength) AS strength FROM signals GROUP BY entity_id, family, subject) GROUP BY ALL")
def j10_awards_once(spark, sf):
    once = score.counted_once(signals(spark, sf), "subject", "strength", ["entity_id", "family"])
    return once.groupBy("entity_id", "family").agg(F.round(X.noisy_or_agg(F.col("strength")), 6).alias("p"))


_P1 = " * ".join(f"(1 - {p})" for p in (
    over("n * 100", 500, 8000), over("n", 5, 120),
    "(CASE WHEN best <= 100000 THEN 0.85 WHEN best <= 400000 THEN 0.5 WHEN best <= 1000000 THEN 0.25 WHEN best <= 2000000 THEN 0.08 ELSE 0.0 END)",
    over("total * 100", 15000000, 100000000), "0.7 * " + over("date_diff('day', first_day, DATE '2001-08-01') / 365.25", 3, 4), "(CASE WHEN status = 'P' THEN 0.6 ELSE 0.2 END)"))


@query("p1_consensus", f"{AW}, f AS (SELECT firm, count(*) AS n, min(amount) AS best, sum(amount) AS total, min(day) AS first_day, max(status) AS status FROM awards GROUP BY 1) SELECT firm, round(round(1 - {_P1}, 4), 3) AS consensus FROM f")
def p1_consensus(spark, sf):
    f = awards(spark, sf).groupBy("firm").agg(F.count(F.lit(1)).alias("n"), F.min("amount").alias("best"), F.sum("amount").alias("total"), F.min("day").alias("first_day"), F.max("status").alias("status"))
    parts = score.consensus_parts({"stars_total": F.col("n") * 100.0, "hn_mentions_total": F.col("n").cast("double"), "tranco_rank": F.col("best"), "amount_usd": F.col("total") * 100}, F.col("first_day"), F.to_date(F.lit("2001-08-01")), F.when(F.col("status") == "P", "growth").otherwise("early"))
    return f.select("firm", F.round(score.consensus(parts), 3).alias("consensus"))


@query("p3_edge", f"{SIG}, {scored()} SELECT entity_id, edge FROM scored")
def p3_edge(spark, sf):
    return score.score_entities(signals(spark, sf), ASOF, weeks=1).select("entity_id", "edge")


@query("p11_explain", f"{SIG}, {scored()} SELECT entity_id, CASE WHEN convergence < 2 THEN 0.85 ELSE 1.0 END::DOUBLE AS lone, concat_ws(',', " + ", ".join(f"CASE WHEN {f} >= 0.12 THEN '{f}' END" for f in fixed.FAMILIES) + ") AS firing FROM scored")
def p11_explain(spark, sf):
    s = score.score_entities(signals(spark, sf), ASOF, weeks=1)
    return s.select("entity_id", F.when(F.col("convergence") < 2, F.lit(fixed.UNCORROBORATED)).otherwise(F.lit(1.0)).alias("lone"), F.concat_ws(",", *[F.when(F.col(f) >= fixed.FIRING, f) for f in fixed.FAMILIES]).alias("firing"))


@query("p13_profile", f"{SIG} SELECT kind AS source, count(*) AS n, count(*) FILTER (WHERE strength >= 0.3) AS strong, count(DISTINCT entity_id) AS entities FROM signals GROUP BY 1")
def p13_profile(spark, sf):
    return signals(spark, sf).groupBy(F.col("kind").alias("source")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("strength") >= 0.3, 1)).alias("strong"), F.countDistinct("entity_id").alias("entities"))
