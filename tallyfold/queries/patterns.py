"""Keyed state, lateness, and patterns over histories, each over whole tables."""

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import cohorts, patterns
from ..operators.lineage import shared_place
from ..sources.views import ASOF, asof_day, awards, n_rows, table
from ..streaming import keyed, stream
from .serving import _events_stream
from .sqltext import AW, DAY
from .sqltext import cohorts as cohorts_sql


@query("t8_keyed_first", "SELECT user_id, event_type, CAST(CAST(min(ts) AS DATE) AS VARCHAR) AS first_day FROM events GROUP BY ALL HAVING min(ts) <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def t8_keyed_first(spark, sf):
    """Each user's first event of a type, told once the watermark (a day behind) has passed it."""
    first = keyed.sightings(_events_stream(spark, sf), ["user_id", "event_type"], "ts")
    return stream.drained(first, "append").select("user_id", "event_type", F.to_date("first_seen").cast("string").alias("first_day"))


@query("t8_keyed_latest", "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL")
def t8_keyed_latest(spark, sf):
    """The latest of the readings that keyed state told."""
    told = stream.drained(keyed.latest(_events_stream(spark, sf), ["user_id", "event_type"], "ts", ["event_id"]), "append")
    return told.groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


#: Events come in six lots of five days, not in order.
_LOTS = [1, 0, 3, 2, 5, 4]
_ALLOWED = {"view": 2, "click": 9}


@query("t6_stream_lateness", f"""WITH e AS (SELECT *, list_position({_LOTS}, CAST(least(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 5, 5) AS INTEGER)) AS lot, CASE event_type WHEN 'view' THEN 2 WHEN 'click' THEN 9 ELSE 4 END AS allowed FROM events),
m AS (SELECT event_type, lot, max(ts) FILTER (WHERE ts <= TIMESTAMP '{ASOF}') AS latest FROM e GROUP BY ALL),
b AS (SELECT event_type, lot, max(latest) OVER (PARTITION BY event_type ORDER BY lot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM m)
SELECT event_type, CASE WHEN ts > TIMESTAMP '{ASOF}' THEN 'held' WHEN coalesce(ts < before - to_days(allowed), false) THEN 'late' ELSE 'on time' END AS arrival, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM e JOIN b USING (event_type, lot) GROUP BY ALL""")
def t6_stream_lateness(spark, sf):
    """Events written in lots that aren't in order, streamed lot by lot: on time, late by their type's own watermark, or ahead of the clock."""
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    landed = shared_place(spark, "lots")
    lot = F.least(F.floor(F.datediff("ts", F.to_date(F.lit("2024-01-01"))) / 5), F.lit(5))
    for k in _LOTS:
        e.filter(lot == k).coalesce(1).write.mode("append").parquet(landed)
    lots = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(landed)
    sorted_ = keyed.sorted_by_lateness(lots, "event_type", "ts", _ALLOWED, 4, F.lit(ASOF).cast("timestamp"))
    return sorted_.groupBy("event_type", "arrival").agg(n_rows().alias("n"), F.sum("event_id").alias("ids"))


@query("w3_cohort_share", f"WITH {cohorts_sql('c', 'orders', 'o_orderkey', 'o_totalprice', 'o_custkey % 97')}" + " SELECT e.k, e.high - e.low AS cohort, round(CASE WHEN e.high - e.low >= 200 THEN count(*) FILTER (WHERE b.q < e.q) / (e.high - e.low) END, 6) AS share FROM c_e e JOIN c_p b ON b.i >= e.low AND b.i < e.high GROUP BY e.k, e.low, e.high")
def w3_cohort_share(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("r"), (F.col("o_custkey") % 97).alias("q"))
    return cohorts.cohort_share(o, "r", "q", "k").select("k", "cohort", F.round("share", 6).alias("share"))


@query("w4_entrant_rate", "WITH " + cohorts_sql("c", "orders", "o_orderkey", "o_totalprice", "CAST(o_orderdate >= TIMESTAMP '2001-01-01' AS INTEGER)") + ", s AS (SELECT i, sum(q) OVER (ORDER BY i) AS upto FROM c_p) SELECT e.k, high - low AS cohort, round(CASE WHEN high - low >= 200 THEN (h.upto - coalesce(l.upto, 0)) / (high - low) END, 6) AS rate FROM c_e e JOIN s h ON h.i = e.high - 1 LEFT JOIN s l ON l.i = e.low - 1")
def w4_entrant_rate(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("r"), (F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp")).alias("fresh"))
    return cohorts.entrant_rate(o, "r", "fresh", "k").select("k", "cohort", F.round("rate", 6).alias("rate"))


@query("r9_initials", """WITH w AS (SELECT doc_id, source AS g, regexp_extract_all(text, '[A-Za-z]+') AS w FROM documents),
n AS (SELECT DISTINCT g, CASE WHEN doc_id % 3 = 0 THEN left(lower(w[1]), 1) ELSE lower(w[1]) END AS n, lower(w[2]) AS f FROM w WHERE len(w) > 1),
k AS (SELECT g, f, left(n, 1) AS i, count(*) AS fits, min(n) AS whole FROM n WHERE length(n) > 1 GROUP BY ALL)
SELECT n.g AS source, n.f AS family, n.n AS given, CASE WHEN length(n) = 1 AND fits = 1 THEN whole ELSE n END AS person, CASE WHEN length(n) > 1 THEN 'full' WHEN fits = 1 THEN 'joined' WHEN fits > 1 THEN 'ambiguous' ELSE 'alone' END AS joins
FROM n LEFT JOIN k ON k.g IS NOT DISTINCT FROM n.g AND k.f = n.f AND k.i = left(n.n, 1)""")
def r9_initials(spark, sf):
    """The first two words of each document as a name of its source's people; every third has its given name as an initial."""
    w = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
    d = table(spark, sf, "documents").withColumn("w", F.transform(w, F.lower))
    given = F.when(F.col("doc_id") % 3 == 0, F.substring(F.get("w", 0), 1, 1)).otherwise(F.get("w", 0))
    return patterns.merged_by_initials(d, "source", given, F.get("w", 1))


_LISTED = """WITH s AS (SELECT DISTINCT o_custkey % 15 AS board, o_custkey % 300 AS role, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INTEGER) AS t FROM orders),
m AS (SELECT max(t) AS newest FROM s), g AS (SELECT *, t - row_number() OVER (PARTITION BY board, role ORDER BY t) AS x FROM s),
r AS (SELECT board, role, min(t) AS opened, max(t) AS last_seen, newest, CASE WHEN max(t) < newest THEN max(t) + 1 END AS closed FROM g, m GROUP BY board, role, x, newest) """


def _spans(spark, sf):
    k = F.col("o_custkey")
    s = table(spark, sf, "orders").select((k % 15).alias("board"), (k % 300).alias("role"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("t"))
    return s, patterns.listing_spans(s, ["board", "role"], "t")


@query("x14_net_adds", _LISTED + "SELECT board, count(*) FILTER (WHERE opened > newest - 6) AS adds, count(*) FILTER (WHERE closed > newest - 6) AS closes, count(*) FILTER (WHERE opened > newest - 6) - count(*) FILTER (WHERE closed > newest - 6) AS net, count(*) FILTER (WHERE closed IS NULL) AS open_now FROM r GROUP BY 1")
def x14_net_adds(spark, sf):
    """Orders as listings: a customer's number is a role, a month a snapshot; what opened and closed in the last half-year."""
    s, spans = _spans(spark, sf)
    newest = s.agg(F.max("t")).first()[0] or 0
    return patterns.net_changes(spans, ["board"], newest - 5, newest)


@query("x14_half_life", _LISTED + """, a AS (SELECT board, coalesce(closed, newest + 1) - opened AS age, count(*) AS n, count(closed) AS c FROM r GROUP BY ALL),
k AS (SELECT *, sum(n) OVER (PARTITION BY board ORDER BY age DESC) AS risk FROM a), v AS (SELECT *, sum(CASE WHEN c = risk THEN CAST('-inf' AS DOUBLE) ELSE ln(1 - c / risk) END) OVER (PARTITION BY board ORDER BY age) AS alive FROM k)
SELECT board, CAST(sum(n) AS BIGINT) AS n, CAST(sum(c) AS BIGINT) AS n_closed, min(age) FILTER (WHERE alive <= ln(0.5) + 1e-9) AS half_life FROM v GROUP BY 1""")
def x14_half_life(spark, sf):
    s, spans = _spans(spark, sf)
    return patterns.half_life(spans, ["board"], F.lit(s.agg(F.max("t")).first()[0]))


@query("x14_capital_customer", f"""{AW}, c AS (SELECT o_custkey AS firm, CAST(l_shipdate AS DATE) AS day FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R'),
m AS (SELECT award_id, count(c.firm) AS n_near, arg_min(date_diff('day', a.day, c.day), (abs(date_diff('day', a.day, c.day)), -date_diff('day', a.day, c.day))) FILTER (WHERE c.firm IS NOT NULL) AS gap FROM awards a LEFT JOIN c ON c.firm = a.firm AND abs(date_diff('day', a.day, c.day)) <= 183 WHERE a.status = 'F' GROUP BY 1)
SELECT award_id, n_near, CAST(gap AS INTEGER) AS gap FROM m""")
def x14_capital_customer(spark, sf):
    """Awards that are through, with their firm's shipments within six months."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("firm"))
    shipped = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("firm", F.to_date("l_shipdate").alias("shipped"))
    return patterns.near_in_time(awards(spark, sf).filter("status = 'F'"), shipped, ["firm"], "day", "shipped", 183).select("award_id", "n_near", "gap")


@query("x14_transitions", f"""{AW}, t AS (SELECT firm, min(day) AS moved_on FROM awards WHERE priority = '1-URGENT' GROUP BY 1), w AS (SELECT a.firm, priority, moved_on, a.day < moved_on AS before, a.day FROM awards a JOIN t USING (firm)),
h AS (SELECT firm, moved_on, priority, count(*) FILTER (WHERE before) AS b, count(*) FILTER (WHERE NOT before) AS a, max(day) FILTER (WHERE before) AS last FROM w GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY firm ORDER BY b DESC, last DESC, priority) AS x FROM h WHERE priority <> '1-URGENT' AND b > 0)
SELECT o.firm, CAST(o.moved_on AS VARCHAR) AS moved_on, o.priority AS old_home, o.b AS n_before, n.a AS n_after, o.a AS n_old_after, CASE WHEN o.a > 0 THEN 'dual' ELSE 'full move' END AS how FROM o JOIN h n ON n.firm = o.firm AND n.priority = '1-URGENT' WHERE x = 1 AND o.b >= 2""")
def x14_transitions(spark, sf):
    """A firm's priorities as homes: from which one it came to the urgent one."""
    moved = patterns.transitions(awards(spark, sf), "firm", "priority", "day", F.col("priority") == "1-URGENT")
    return moved.withColumn("moved_on", F.col("moved_on").cast("string"))


_RUNGS = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]
_CLIMB = f"t0 AS (SELECT firm, min(day) AS d FROM awards WHERE priority = '{_RUNGS[0]}' GROUP BY 1), " + ", ".join(
    f"t{k} AS (SELECT t{k - 1}.firm, min(a.day) AS d FROM t{k - 1} LEFT JOIN awards a ON a.firm = t{k - 1}.firm AND a.priority = '{r}' AND a.day > t{k - 1}.d GROUP BY 1)" for k, r in enumerate(_RUNGS) if k
)


@query("x14_award_ladder", f"{AW}, {_CLIMB} SELECT t0.firm, CAST(1 + CAST(t1.d IS NOT NULL AS INTEGER) + CAST(t2.d IS NOT NULL AS INTEGER) + CAST(t3.d IS NOT NULL AS INTEGER) + CAST(t4.d IS NOT NULL AS INTEGER) AS INTEGER) AS reached, concat_ws(',', t0.d, t1.d, t2.d, t3.d, t4.d) AS days, concat_ws(',', t1.d - t0.d, t2.d - t1.d, t3.d - t2.d, t4.d - t3.d) AS waits FROM t0 JOIN t1 USING (firm) JOIN t2 USING (firm) JOIN t3 USING (firm) JOIN t4 USING (firm)")
def x14_award_ladder(spark, sf):
    """Firms that climb from the lowest priority to the highest, rung by rung."""
    climbed = patterns.ladder_days(awards(spark, sf), ["firm"], "priority", "day", _RUNGS)
    return climbed.select("firm", "reached", F.concat_ws(",", F.col("days").cast("array<string>")).alias("days"), F.concat_ws(",", F.col("waits").cast("array<string>")).alias("waits"))


@query("x14_breakouts", f"""WITH c AS (SELECT user_id, date_diff('day', CAST(ts AS DATE), {DAY}) AS p, count(*) AS n FROM events WHERE CAST(ts AS DATE) <= {DAY} GROUP BY ALL), f AS (SELECT user_id, unnest(range(0, max(p) + 1)) AS p FROM c GROUP BY 1),
s AS (SELECT user_id, p, coalesce(n, 0) AS n FROM f LEFT JOIN c USING (user_id, p)), w AS (SELECT *, count(*) OVER v AS k, avg(n) OVER v AS mean, stddev_pop(n) OVER v AS deviation FROM s WINDOW v AS (PARTITION BY user_id ORDER BY p DESC ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)),
z AS (SELECT *, CASE WHEN k = 12 AND deviation > 0 THEN (n - mean) / deviation END AS z FROM w)
SELECT user_id, CAST(p AS INTEGER) AS period, n, round(CASE WHEN k = 12 THEN mean END, 6) AS mean, round(z, 6) AS z, coalesce(n >= 5 AND (z >= 3 OR (k = 12 AND deviation = 0 AND n > mean)), false) AS breaks FROM z""")
def x14_breakouts(spark, sf):
    """Each user's days against the twelve days before (the events span a month, so a period is a day)."""
    b = patterns.breakouts(table(spark, sf, "events").withColumn("day", F.to_date("ts")), ["user_id"], "day", asof_day(), step=1)
    return b.select("user_id", "period", "n", F.round("mean", 6).alias("mean"), F.round("z", 6).alias("z"), "breaks")


@query("x14_rank_slopes", f"""WITH c AS (SELECT user_id, date_diff('day', CAST(ts AS DATE), {DAY}) AS p, count(*) AS n FROM events WHERE CAST(ts AS DATE) <= {DAY} GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY p ORDER BY n DESC) AS rank FROM c),
s AS (SELECT user_id, CASE WHEN count(*) FILTER (WHERE p < 10) >= 3 THEN regr_slope(log10(rank), -p) FILTER (WHERE p < 10) END AS velocity, CASE WHEN count(*) FILTER (WHERE p BETWEEN 10 AND 19) >= 3 THEN regr_slope(log10(rank), -p) FILTER (WHERE p BETWEEN 10 AND 19) END AS before FROM r GROUP BY 1)
SELECT user_id, round(velocity, 6) AS velocity, round(before, 6) AS before, round(velocity - before, 6) AS acceleration FROM s""")
def x14_rank_slopes(spark, sf):
    """Users ranked by their events each day; how their rank moves over ten days and the ten before."""
    days = table(spark, sf, "events").groupBy("user_id", F.datediff(asof_day(), F.to_date("ts")).alias("p")).agg(n_rows().alias("n")).filter("p >= 0")
    s = patterns.rank_slopes(patterns.ranks_within(days, ["p"], "n"), ["user_id"], "p", "rank", 10)
    return s.select("user_id", *[F.round(c, 6).alias(c) for c in ("velocity", "before", "acceleration")])


@query("x14_repeat_founders", """WITH w AS (SELECT conv_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM conversations), p AS (SELECT DISTINCT conv_id, lower(w[1]) AS name, lower(w[2]) AS fact FROM w WHERE len(w) > 0),
t AS (SELECT count(DISTINCT conv_id) AS every FROM p), a AS (SELECT name, count(DISTINCT conv_id) AS n FROM p GROUP BY 1), b AS (SELECT fact, count(DISTINCT conv_id) AS n FROM p WHERE fact IS NOT NULL GROUP BY 1),
x AS (SELECT conv_id, name, fact, ln(every / a.n) AS own, ln(every / a.n) + ln(every / b.n) AS two FROM p JOIN a USING (name) LEFT JOIN b USING (fact), t),
l AS (SELECT conv_id, name, CASE WHEN own < 4.5 THEN fact END AS fact, CASE WHEN own >= 4.5 THEN own ELSE two END AS w FROM x WHERE own >= 4.5 OR two >= 4.5)
SELECT name, fact, count(DISTINCT conv_id) AS parties, min(conv_id) AS first_party, max(conv_id) AS last_party, round(max(w), 6) AS weight FROM l GROUP BY ALL HAVING count(DISTINCT conv_id) > 1""")
def x14_repeat_founders(spark, sf):
    """The first word of a turn as a name, the second as a fact of the person: who is in several conversations."""
    w = F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), F.lower)
    people = table(spark, sf, "conversations").withColumn("w", w).select("conv_id", F.get("w", 0).alias("name"), F.get("w", 1).alias("fact"))
    return patterns.recurring_persons(people, "conv_id", "name", "fact", 4.5).withColumn("weight", F.round("weight", 6))


@query("x14_new_words", r"""WITH t AS (SELECT doc_id, source = 'src3' AS fresh, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM documents), z AS (SELECT count(*) FILTER (WHERE fresh) AS m, count(*) FILTER (WHERE NOT coalesce(fresh, false)) AS o FROM t),
c AS (SELECT word, count(*) FILTER (WHERE fresh) AS new, count(*) FILTER (WHERE NOT coalesce(fresh, false)) AS rest FROM (SELECT fresh, unnest(w) AS word FROM t) GROUP BY 1 HAVING count(*) >= 5),
r AS (SELECT word, new, rest, new + 0.5::DOUBLE AS a, rest + 0.5::DOUBLE AS b, m + 1.0::DOUBLE AS m, o + 1.0::DOUBLE AS o FROM c, z)
SELECT word, new, rest, round(2 * (a * ln(a / m) + (m - a) * ln((m - a) / m) + b * ln(b / o) + (o - b) * ln((o - b) / o) - (a + b) * ln((a + b) / (m + o)) - (m + o - a - b) * ln((m + o - a - b) / (m + o))), 4) AS score FROM r WHERE a / m > b / o""")
def x14_new_words(spark, sf):
    """Words that the documents of one source have more often than the others'."""
    d = table(spark, sf, "documents").withColumn("fresh", F.col("source") == "src3")
    return patterns.telling_words(d, "text", "fresh").withColumn("score", F.round("score", 4))


@query("x14_round_steps", f"""{AW}, r AS (SELECT firm, day, sum(amount) AS a FROM awards WHERE day <= DATE '2001-07-01' GROUP BY ALL), s AS (SELECT *, a / lag(a) OVER w AS step, date_diff('day', lag(day) OVER w, day) AS wait FROM r WINDOW w AS (PARTITION BY firm ORDER BY day))
SELECT firm, count(*) AS rounds, CAST(max(day) AS VARCHAR) AS last_day, round(avg(wait), 4) AS days_between, round(exp(avg(ln(step))), 4) AS step_up, round(arg_max(step, day), 4) AS last_step, round(count(*) / (greatest(date_diff('day', min(day), DATE '2001-07-01'), 1) / 365.25), 4) AS per_year FROM s GROUP BY 1""")
def x14_round_steps(spark, sf):
    """Awards as rounds: how fast a firm raises, and how its rounds grow."""
    r = patterns.round_steps(awards(spark, sf), "firm", "day", "amount", F.to_date(F.lit("2001-07-01")))
    return r.select("firm", "rounds", F.col("last_day").cast("string").alias("last_day"), *[F.round(c, 4).alias(c) for c in ("days_between", "step_up", "last_step", "per_year")])


@query("x14_launch_surfaces", f"{AW}, s AS (SELECT firm, priority, min(day) AS d FROM awards GROUP BY ALL), f AS (SELECT firm, min(d) AS first_day FROM s GROUP BY 1) SELECT s.firm, CAST(first_day AS VARCHAR) AS first_day, count(*) AS surfaces, string_agg(priority, ',' ORDER BY priority) AS named FROM s JOIN f USING (firm) WHERE date_diff('day', first_day, d) <= 365 GROUP BY ALL")
def x14_launch_surfaces(spark, sf):
    """Priorities as surfaces: on how many of them a firm was within a year of its first award."""
    s = patterns.surfaces(awards(spark, sf), "firm", "priority", "day", 365)
    return s.select("firm", F.col("first_day").cast("string").alias("first_day"), "surfaces", F.array_join("named", ",").alias("named"))


@query("u2_stream_buckets", "SELECT user_id || '|' || event_type AS fingerprint, max(event_id) AS run_id, arg_max(value, event_id) AS value, CAST(CAST(min(ts) AS DATE) AS VARCHAR) AS first_day FROM events GROUP BY ALL")
def u2_stream_buckets(spark, sf):
    """Events merged into a store of buckets, one row a user and type: the latest event's value, the earliest time."""
    e = _events_stream(spark, sf).select(F.concat_ws("|", "user_id", "event_type").alias("fingerprint"), F.col("event_id").alias("run_id"), "value", F.col("ts").alias("observed_at"))
    store = shared_place(spark, "store")
    stream.upsert_buckets(e, store, buckets=16)
    return stream.stored(spark, store, e.schema).select("fingerprint", "run_id", "value", F.to_date("observed_at").cast("string").alias("first_day"))


@query("x14_award_profile", f"""{AW}, r AS (SELECT DISTINCT firm FROM awards WHERE status = 'P')
SELECT firm, count(*) AS lifetime, count(DISTINCT priority) AS offices, count(*) FILTER (WHERE a < 90) AS new_90, count(*) FILTER (WHERE a BETWEEN 90 AND 179) AS prev_90, round((count(*) FILTER (WHERE a < 90) + 1) / (count(*) FILTER (WHERE a BETWEEN 90 AND 179) + 1), 6) AS acceleration, max(a) <= 365 AS is_novel,
  count(*) > 12 AND firm NOT IN (FROM r) AS is_mill, round(sum(amount * (1 + award_id % 4)) / nullif(sum(amount), 0), 6) AS ceiling_ratio FROM (SELECT *, date_diff('day', day, DATE '2001-07-01') AS a FROM awards) WHERE a >= 0 GROUP BY 1""")
def x14_award_profile(spark, sf):
    """Priorities as offices; a firm with an award of status P has raised capital; the ceiling is up to four times the amount."""
    a = awards(spark, sf).withColumn("ceiling", F.col("amount") * (1 + F.col("award_id") % 4))
    p = patterns.award_profile(a, a.filter("status = 'P'"), "firm", "priority", "day", "ceiling", "amount", F.to_date(F.lit("2001-07-01")), mill=12)
    return p.withColumns({c: F.round(c, 6) for c in ("acceleration", "ceiling_ratio")})


@query("x14_new_directors", f"""{AW}, f AS (SELECT firm, award_id, day, [priority, 'd' || award_id % 3] AS d, CASE WHEN award_id % 5 = 0 THEN [priority] ELSE [status] END AS o FROM awards), p AS (SELECT *, lag(list_concat(d, o)) OVER (PARTITION BY firm ORDER BY day, award_id) AS before FROM f),
x AS (SELECT firm, award_id, unnest(list_distinct(list_filter(d, lambda v: NOT list_contains(o, v) AND NOT list_contains(before, v)))) AS director FROM p WHERE before IS NOT NULL) SELECT firm, award_id, director FROM x""")
def x14_new_directors(spark, sf):
    """Awards as filings: the priority and a third of the number sit on the board, the status runs the firm (in every fifth the priority does)."""
    k = F.col("award_id")
    f = awards(spark, sf).select("firm", "award_id", "day", F.array("priority", F.concat(F.lit("d"), k % 3)).alias("d"), F.when(k % 5 == 0, F.array("priority")).otherwise(F.array("status")).alias("o"))
    return patterns.new_directors(f, "firm", "award_id", "day", "d", "o").select("firm", "award_id", "director")
