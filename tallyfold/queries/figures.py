"""Histories by several ids, boards, series, papers, certificates and careers, each over whole tables. A stand-in says which column plays which part."""

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import figures
from ..sources.views import awards, n_rows, table
from .sqltext import AW

_NOW = "DATE '2001-07-01'"


def _now():
    return F.to_date(F.lit("2001-07-01"))


def _days(df, *names):
    return df.withColumns({n: F.col(n).cast("string") for n in names})


_KEYED = "x AS (SELECT award_id, day, CASE WHEN award_id % 3 > 0 THEN 'u' || firm END AS u, CASE WHEN award_id % 4 > 0 THEN 'd' || firm % 700 END AS d, 'n' || firm % 500 AS n FROM awards)"


@query("j5_tiered_history", f"""{AW}, {_KEYED},
p AS (SELECT a.award_id, b.award_id AS other FROM x a JOIN x b ON a.u = b.u AND b.day < a.day UNION SELECT a.award_id, b.award_id FROM x a JOIN x b ON a.d = b.d AND b.day < a.day UNION SELECT a.award_id, b.award_id FROM x a JOIN x b ON a.n = b.n AND b.day < a.day),
h AS (SELECT p.award_id, coalesce(a.u = b.u, false) OR coalesce(a.d = b.d, false) AS hard, b.u IS NULL AS legacy FROM p JOIN x a ON a.award_id = p.award_id JOIN x b ON b.award_id = other),
c AS (SELECT award_id, count(*) FILTER (WHERE hard) AS h, count(*) FILTER (WHERE NOT hard) AS s, count(*) FILTER (WHERE NOT hard AND legacy) AS l FROM h GROUP BY 1),
n AS (SELECT x.award_id, coalesce(h, 0) AS h, coalesce(s, 0) AS s, coalesce(l, 0) AS l FROM x LEFT JOIN c USING (award_id))
SELECT award_id, h AS prior_hard, s AS prior_soft, l AS prior_legacy, CASE WHEN h > 0 THEN 'repeat' WHEN s > 0 THEN 'unclear' ELSE 'first' END AS standing, h + CASE WHEN h > 0 THEN l ELSE 0 END AS prior FROM n""")
def j5_tiered_history(spark, sf):
    """Awards of firms that have a unit id, an older number and a name, not all of them known."""
    k, f = F.col("award_id"), F.col("firm")
    a = awards(spark, sf).select("award_id", "day", F.when(k % 3 > 0, F.concat(F.lit("u"), f)).alias("u"), F.when(k % 4 > 0, F.concat(F.lit("d"), f % 700)).alias("d"), F.concat(F.lit("n"), f % 500).alias("n"))
    return figures.tiered_history(a, "award_id", "u", "d", "n", "day").select("award_id", "prior_hard", "prior_soft", "prior_legacy", "standing", "prior")


@query("j6_pointer_baseline", f"""{AW}, x AS (SELECT award_id, amount, day, CASE WHEN award_id % 5 > 0 THEN firm || priority END AS file, CASE WHEN award_id % 2 = 0 THEN award_id - 3 END AS pointer FROM awards),
l AS (SELECT award_id, lag((award_id, amount)) OVER (PARTITION BY file ORDER BY day, award_id) AS b FROM x WHERE file IS NOT NULL)
SELECT x.award_id, coalesce(b[1], t.award_id) AS baseline, round(x.amount - coalesce(b[2], t.amount), 2) AS raised, CASE WHEN b[1] IS NOT NULL THEN 'before' WHEN t.award_id IS NOT NULL THEN 'pointer' END AS how FROM x LEFT JOIN l ON l.award_id = x.award_id LEFT JOIN x t ON t.award_id = x.pointer""")
def j6_pointer_baseline(spark, sf):
    """Awards as filings: a firm's awards of one priority are one file; every fifth has no file number, every other a pointer."""
    k = F.col("award_id")
    x = awards(spark, sf).select("award_id", "amount", "day", F.when(k % 5 > 0, F.concat("firm", "priority")).alias("file"), F.when(k % 2 == 0, k - 3).alias("pointer"))
    return figures.amendment_baseline(x, "award_id", ["file"], [F.col("day")], "pointer", "amount").select("award_id", "baseline", F.round("raised", 2).alias("raised"), "how")


_FUNCTIONS = ["hardware", "gtm", "software", "manufacturing"]
_ROLES = f"""{AW}, r AS (SELECT firm % 60 AS board, CASE WHEN award_id % 37 = 0 THEN 'Founding ' ELSE '' END || priority AS title, CASE WHEN award_id % 6 > 0 THEN 'p' || award_id % 6 END AS place,
  CASE WHEN award_id % 10 > 0 THEN DATE '2001-04-10' + CAST(award_id % 11 * (firm % 9 + 1) AS INTEGER) END AS posted, (['hardware', 'gtm', 'software', 'manufacturing'])[award_id % 5 + 1] AS fn, award_id % 13 = 0 AS evergreen, award_id % 17 = 0 AS notable,
  CASE WHEN firm % 60 % 3 = 0 THEN DATE '2001-04-15' END AS after FROM awards),
b AS (SELECT board, max(posted) AS last, max(after) AS after FROM r GROUP BY 1),
l AS (SELECT r.* EXCLUDE (after), b.after, NOT evergreen AS real, date_diff('day', posted, {_NOW}) AS age, posted IS NOT NULL AND (b.after IS NULL OR posted > b.after) AS counts FROM r JOIN b USING (board) WHERE posted <= {_NOW} OR (posted IS NULL AND coalesce(b.last, {_NOW}) <= {_NOW})),
s AS (SELECT board, count(*) AS open_roles, count(*) FILTER (WHERE evergreen) AS evergreen_roles, count(*) FILTER (WHERE real AND posted IS NOT NULL) AS dated_roles, min(posted) FILTER (WHERE real) AS oldest, max(posted) FILTER (WHERE real) AS newest,
  coalesce(round(avg(CASE WHEN fn IN ('hardware', 'controls_embedded', 'manufacturing') THEN 1.0 ELSE 0.0 END) FILTER (WHERE real), 2), 0) AS hardware_share, count(*) FILTER (WHERE real AND fn = 'gtm') AS gtm_roles, count(DISTINCT place) FILTER (WHERE real AND place <> '') AS n_locations,
  count(*) FILTER (WHERE real AND title LIKE '%Founding%') AS founding_roles, count(*) FILTER (WHERE counts AND age < 14) AS new_14d, count(*) FILTER (WHERE counts AND age < 30) AS new_30d, count(*) FILTER (WHERE counts AND age BETWEEN 30 AND 59) AS prev_30d,
  count(DISTINCT (lower(title), coalesce(place, ''))) FILTER (WHERE counts AND age < 30 AND real) AS distinct_new_30d, count(DISTINCT (lower(title), coalesce(place, ''))) FILTER (WHERE counts AND age BETWEEN 30 AND 59 AND real) AS distinct_prev_30d,
  count(*) FILTER (WHERE counts AND age < 30 AND real AND notable) AS notable_new, count(*) FILTER (WHERE counts AND age < 30 AND real AND fn = 'gtm') AS new_gtm, count(*) FILTER (WHERE real) AS n_real, count(*) FILTER (WHERE counts AND age < 30 AND real) AS n_new, max(after) AS after FROM l GROUP BY 1),
m AS (SELECT board, string_agg(fn || ':' || n, ',' ORDER BY fn) AS mix FROM (SELECT board, fn, count(*) AS n FROM l WHERE real AND fn IS NOT NULL GROUP BY ALL) GROUP BY 1),
d AS (SELECT board, posted, count(*) AS n FROM l WHERE counts AND age < 30 AND real GROUP BY ALL),
w AS (SELECT board, posted, sum(n) OVER (PARTITION BY board ORDER BY posted RANGE BETWEEN CURRENT ROW AND INTERVAL 2 DAY FOLLOWING) AS n FROM d), k AS (SELECT board, max((n, posted)) AS top FROM w GROUP BY 1) """


@query("g7_board_figures", _ROLES + f"""SELECT s.board, open_roles, evergreen_roles, dated_roles, CAST(oldest AS VARCHAR) AS oldest, CAST(newest AS VARCHAR) AS newest, hardware_share, gtm_roles, n_locations, founding_roles, new_14d, new_30d, prev_30d, distinct_new_30d, distinct_prev_30d, notable_new, mix AS function_mix,
  gtm_roles = 1 AND new_gtm = 1 AND n_real >= 3 AS sole_gtm, after IS NULL OR date_diff('day', after, {_NOW}) >= 60 AS prior_known, CASE WHEN coalesce(n_new >= 4 AND top[1] >= 4 AND top[1] / n_new >= 0.5, false) THEN CAST(top[2] AS VARCHAR) END AS bulk_day,
  CASE WHEN coalesce(n_new >= 4 AND top[1] >= 4 AND top[1] / n_new >= 0.5, false) THEN round(top[1] / n_new, 2) END AS bulk_share FROM s LEFT JOIN m USING (board) LEFT JOIN k USING (board)""")
def g7_board_figures(spark, sf):
    """Awards as roles of sixty boards, of which every third appeared with a first batch."""
    k, f = F.col("award_id"), F.col("firm")
    posted = F.when(k % 10 > 0, F.date_add(F.to_date(F.lit("2001-04-10")), (k % 11 * (f % 9 + 1)).cast("int")))
    r = awards(spark, sf).select(
        (f % 60).alias("board"), F.concat(F.when(k % 37 == 0, "Founding ").otherwise(""), "priority").alias("title"), F.when(k % 6 > 0, F.concat(F.lit("p"), k % 6)).alias("place"), posted.alias("posted"),
        F.get(F.array(*[F.lit(x) for x in _FUNCTIONS]), (k % 5).cast("int")).alias("fn"), (k % 13 == 0).alias("evergreen"), (k % 17 == 0).alias("notable"), F.when(f % 60 % 3 == 0, F.to_date(F.lit("2001-04-15"))).alias("after"),
    )
    s = figures.board_stats(r, "board", "title", "place", "posted", "fn", F.col("evergreen"), F.col("notable"), _now(), F.col("after"))
    mix = F.array_join(F.transform(F.map_entries("function_mix"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return _days(s.withColumn("function_mix", mix), "oldest", "newest", "bulk_day")


_VELOCITY_DAY = "DATE '2024-01-25'"
_W = lambda a, b: f"coalesce(sum(n) FILTER (WHERE age >= {a} AND age < {b}), 0)"
_WEEKS = " + ".join(f"CAST({_W(7 * w, 7 * w + 7)} >= 10 AS INTEGER)" for w in range(8))
_BEST = lambda days: f"max((n, age, day)) FILTER (WHERE age BETWEEN 0 AND {days - 1} AND n > 0)"


@query("g6_velocity_stats", f"""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, date_diff('day', CAST(ts AS DATE), {_VELOCITY_DAY}) AS age FROM events GROUP BY ALL),
a AS (SELECT user_id, {_W(0, 7)} AS n_7d, {_W(7, 14)} AS prev_7d, {_W(0, 30)} AS n_30d, {_W(30, 60)} AS prev_30d, greatest(user_id % 50 + 60 - coalesce(sum(n) FILTER (WHERE age < 0), 0), 0) AS total, {_WEEKS} AS sustained_weeks, {_BEST(30)} AS p30, {_BEST(7)} AS p7, min(day) FILTER (WHERE age >= 0) AS a, max(day) FILTER (WHERE age >= 0) AS z FROM d GROUP BY 1)
SELECT user_id, CAST(n_7d AS BIGINT) AS n_7d, CAST(prev_7d AS BIGINT) AS prev_7d, CAST(n_30d AS BIGINT) AS n_30d, CAST(prev_30d AS BIGINT) AS prev_30d, round((n_7d + 1) / (prev_7d + 1), 2) AS accel_7d, round((n_30d + 1) / (prev_30d + 1), 2) AS accel_30d, CAST(total AS BIGINT) AS total, round(least(n_30d / greatest(total, n_30d, 1), 1), 3) AS share_30d, sustained_weeks,
  coalesce(p30[1], 0) AS peak_day, CAST(p30[3] AS VARCHAR) AS peak_date, CAST(p7[3] AS VARCHAR) AS peak_date_7d, CASE WHEN n_30d > 0 THEN round(coalesce(p30[1], 0) / n_30d, 3) ELSE 0 END AS burstiness, CAST(a AS VARCHAR) AS first_active, CAST(z AS VARCHAR) AS last_active FROM a""")
def g6_velocity_stats(spark, sf):
    """Users' events as stars, five days before the last ones; what the source says of all stars goes by the user's number."""
    e = table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(n_rows().alias("n"))
    s = figures.velocity_stats(e, "user_id", "day", "n", F.to_date(F.lit("2024-01-25")), F.col("user_id") % 50 + 60)
    return _days(s, "peak_date", "peak_date_7d", "first_active", "last_active")


_PAPERS = """WITH w AS (SELECT doc_id, source, lang, regexp_extract_all(text, '[A-Za-z]+') AS w FROM documents), m AS (SELECT source AS company, w[1] AS printed, lang AS place, doc_id AS paper, lower(array_to_string(w[1:3], ' ')) AS t, DATE '2024-01-01' + CAST(doc_id % 28 AS INTEGER) AS day FROM w WHERE source IS NOT NULL),
t AS (SELECT company, t, min(day) AS day, count(DISTINCT paper) AS ids FROM m GROUP BY ALL) """


@query("g14_company_papers", _PAPERS + """, n AS (SELECT company, printed, row_number() OVER (PARTITION BY company ORDER BY k DESC, length(printed) DESC, printed) AS x FROM (SELECT company, printed, count(*) AS k FROM m WHERE printed <> '' GROUP BY ALL)),
p AS (SELECT company, place, row_number() OVER (PARTITION BY company ORDER BY k DESC, place) AS x FROM (SELECT company, place, count(*) AS k FROM m WHERE place <> '' GROUP BY ALL)),
a AS (SELECT company, string_agg(printed, ',' ORDER BY printed) AS aliases FROM (SELECT company, printed, row_number() OVER (PARTITION BY company ORDER BY printed) AS y FROM n WHERE x > 1) WHERE y <= 12 GROUP BY 1),
s AS (SELECT company, count(*) AS papers, CAST(sum(ids) - count(*) AS BIGINT) AS duplicates, CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) AS last_day FROM t GROUP BY 1)
SELECT s.*, n.printed AS name, coalesce(aliases, '') AS aliases, p.place FROM s LEFT JOIN n ON n.company = s.company AND n.x = 1 LEFT JOIN p ON p.company = s.company AND p.x = 1 LEFT JOIN a ON a.company = s.company""")
def g14_company_papers(spark, sf):
    """Documents as papers of their source: the first word is how the name is printed, the first three the title, the language the place."""
    papers, _ = _papers(spark, sf)
    return _days(papers.withColumn("aliases", F.array_join("aliases", ",")), "first_day", "last_day")


@query("g14_paper_series", _PAPERS + "SELECT company, CAST(day AS VARCHAR) AS day, CAST(sum(count(*)) OVER (PARTITION BY company ORDER BY t.day) AS BIGINT) AS papers FROM t GROUP BY company, t.day")
def g14_paper_series(spark, sf):
    return _days(_papers(spark, sf)[1], "day")


def _papers(spark, sf):
    w = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
    m = table(spark, sf, "documents").withColumn("w", w).withColumn("printed", F.get("w", 0)).withColumn("day", F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("doc_id") % 28).cast("int")))
    return figures.company_papers(m.withColumnRenamed("source", "company"), "company", "printed", "lang", "doc_id", F.lower(F.array_join(F.slice("w", 1, 3), " ")), "day")


@query("g13_certificate_names", """WITH c AS (SELECT l_suppkey AS domain, CASE WHEN l_partkey % 3 = 0 THEN 'a.h' || l_partkey // 3 % 50 ELSE 'h' || l_partkey % 50 END AS label, CAST(l_shipdate AS DATE) AS issued, l_orderkey % 400 - 10 AS life FROM lineitem WHERE CAST(l_shipdate AS DATE) <= DATE '1996-06-01'),
m AS (SELECT domain, label, min(issued) AS issued, count(*) AS n FROM c GROUP BY ALL HAVING min(issued) >= DATE '1996-01-01'), f AS (SELECT m.domain, m.label, m.issued, m.n, min(CASE WHEN life > 0 THEN life END) AS lifetime FROM m JOIN c ON c.domain = m.domain AND c.label = m.label AND c.issued = m.issued GROUP BY ALL)
SELECT f.domain, f.label, CAST(f.issued AS VARCHAR) AS issued, f.lifetime, f.n, coalesce(f.lifetime IS NOT NULL AND date_diff('day', f.issued, DATE '1996-06-01') <= least(30, f.lifetime // 3) - 2, false) AS fresh, p.label IS NOT NULL AS nested FROM f LEFT JOIN m p ON p.domain = f.domain AND contains(f.label, '.') AND p.label = substr(f.label, strpos(f.label, '.') + 1)""")
def g13_certificate_names(spark, sf):
    """Lines as certificates of their supplier's domain: the part makes the label, the order how long it runs."""
    k = F.col("l_partkey")
    label = F.when(k % 3 == 0, F.concat(F.lit("a.h"), F.floor(k / 3) % 50)).otherwise(F.concat(F.lit("h"), k % 50))
    c = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("domain"), label.alias("label"), F.to_date("l_shipdate").alias("issued"), F.date_add(F.to_date("l_shipdate"), (F.col("l_orderkey") % 400 - 10).cast("int")).alias("expires"))
    day = lambda d: F.to_date(F.lit(d))
    return _days(figures.certificate_names(c, "domain", "label", "issued", "expires", day("1996-01-01"), day("1996-06-01")), "issued")


@query("j26_merged_profiles", """WITH s AS (SELECT DISTINCT o_custkey AS p, o_orderpriority AS place, o_orderpriority < '3' AS c, year(o_orderdate) AS y FROM orders), l AS (SELECT p, place, c FROM s GROUP BY ALL HAVING count(*) >= 3),
d AS (SELECT p, count(*) AS solid FROM l GROUP BY 1), o AS (SELECT a.p, max(n) AS overlap FROM (SELECT a.p, a.place, b.place, count(*) AS n FROM s a JOIN s b ON a.p = b.p AND a.y = b.y AND a.place < b.place AND a.c <> b.c JOIN l x ON x.p = a.p AND x.place = a.place JOIN l z ON z.p = b.p AND z.place = b.place GROUP BY ALL) a GROUP BY 1),
t AS (SELECT o_custkey AS p, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS share FROM orders GROUP BY 1)
SELECT t.p AS person, coalesce(solid, 0) AS solid, coalesce(overlap, 0) AS overlap, round(share, 6) AS share, CASE WHEN solid > 6 THEN 'too many stays' WHEN overlap >= 2 THEN 'two careers' WHEN share < 0.5 THEN 'other field' ELSE 'trusted' END AS verdict FROM t LEFT JOIN d ON d.p = t.p LEFT JOIN o ON o.p = t.p""")
def j26_merged_profiles(spark, sf):
    """Customers as authors: a priority is a place, its first two are in one country, a status a topic."""
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "person")
    stays = o.select("person", F.col("o_orderpriority").alias("place"), (F.col("o_orderpriority") < "3").alias("country"), F.year("o_orderdate").alias("year"))
    topics = o.select("person", F.col("o_orderstatus").alias("topic"), F.lit(1).alias("n"))
    return figures.merged_profiles(stays, topics, "person", "place", "country", "year", "topic", "n", ["F"]).withColumn("share", F.round("share", 6))


@query("p8_unannounced", f"""{AW}, k AS (SELECT DISTINCT firm FROM awards WHERE status = 'P' AND day <= {_NOW})
SELECT firm, CAST(min(day) AS VARCHAR) AS first_signal, date_diff('day', min(day), {_NOW}) AS days, count(*) AS n, round(max(amount / (amount + 90000)), 6) AS strongest FROM awards WHERE day <= {_NOW} AND firm NOT IN (SELECT firm FROM k) GROUP BY 1 HAVING count(*) >= 2 AND max(amount / (amount + 90000)) >= 0.5""")
def p8_unannounced(spark, sf):
    """Firms with awards but without one of status P, which stands for an announcement."""
    a = awards(spark, sf).withColumn("strength", F.col("amount") / (F.col("amount") + 90_000))
    u = figures.unannounced(a, a.filter("status = 'P'"), "firm", "day", "strength", _now(), {"n": 2, "strength": 0.5})
    return _days(u, "first_signal").withColumn("strongest", F.round("strongest", 6))
