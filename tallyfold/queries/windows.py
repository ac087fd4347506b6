"""History, windows, ranks and cuts."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import history, ranking
from ..plans import score
from ..sources.views import ASOF, asof_day, awards, n_rows, signals, table
from .sqltext import AW, DAY, SIG, scored


@query("j5_prior_history", f"{AW}, h AS (SELECT *, (SELECT 0) AS z, count(*) OVER (PARTITION BY firm ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING) AS prior FROM awards) SELECT CASE WHEN prior = 0 THEN 'first' WHEN prior <= 2 THEN 'early' ELSE 'repeat' END AS status, count(*) AS n, round(avg(amount), 2) AS mean FROM h GROUP BY 1")
def j5_prior_history(spark, sf):
    h = history.prior_counts(awards(spark, sf), ["firm"], "day")
    status = F.when(F.col("prior") == 0, "first").when(F.col("prior") <= 2, "early").otherwise("repeat")
    return h.groupBy(status.alias("status")).agg(n_rows().alias("n"), F.round(F.avg("amount"), 2).alias("mean"))


@query("j6_baseline", f"{AW} SELECT award_id, round(amount - lag(amount) OVER (PARTITION BY firm, priority ORDER BY day, award_id), 2) AS raised FROM awards")
def j6_baseline(spark, sf):
    b = history.previous(awards(spark, sf), ["firm", "priority"], [F.col("day"), F.col("award_id")], {"was": "amount"})
    return b.select("award_id", F.round(F.col("amount") - F.col("was"), 2).alias("raised"))


@query("j7_asof_series", f"{SIG} SELECT entity_id, arg_max(value, (ts, signal_id)) AS value FROM signals WHERE occurred_at <= DATE '2024-01-16' GROUP BY 1")
def j7_asof_series(spark, sf):
    s = signals(spark, sf).filter(F.col("occurred_at") <= F.date_add(F.to_date(F.lit("2024-01-15")), 1))
    return s.groupBy("entity_id").agg(F.max_by("value", F.struct("ts", "signal_id")).alias("value"))


@query("j19_pair_snapshots", "WITH w AS (SELECT user_id, CAST(floor(date_diff('day', CAST(ts AS DATE), DATE '2024-01-30') / 7) AS INTEGER) AS week, count(*) AS n FROM events GROUP BY ALL) SELECT a.user_id, a.n AS now, b.n AS week_ago, c.n AS three_ago FROM w a LEFT JOIN w b ON a.user_id = b.user_id AND b.week = 1 LEFT JOIN w c ON a.user_id = c.user_id AND c.week = 3 WHERE a.week = 0")
def j19_pair_snapshots(spark, sf):
    """The three weeks side by side by one aggregation instead of two joins."""
    w = history.trailing(table(spark, sf, "events").withColumn("day", F.to_date("ts")), ["user_id"], "day", asof_day(), {"now": (0, 7), "week_ago": (7, 14), "three_ago": (21, 28)})
    return w.filter("now > 0").select("user_id", "now", *[F.when(F.col(c) > 0, F.col(c)).alias(c) for c in ("week_ago", "three_ago")])


@query("j20_nearest_snapshot", f"{SIG}, t AS (SELECT DISTINCT occurred_at AS d FROM signals WHERE day(occurred_at) % 5 = 0), s AS (SELECT DISTINCT occurred_at AS d FROM signals WHERE day(occurred_at) % 3 = 1) SELECT CAST(t AS VARCHAR) AS target, CAST(s AS VARCHAR) AS snapshot, CAST(off_ AS INTEGER) AS off FROM (SELECT t.d AS t, s.d AS s, date_diff('day', t.d, s.d) AS off_, row_number() OVER (PARTITION BY t.d ORDER BY abs(date_diff('day', t.d, s.d)), date_diff('day', t.d, s.d)) AS nth FROM t JOIN s ON abs(date_diff('day', t.d, s.d)) <= 3) WHERE nth = 1")
def j20_nearest_snapshot(spark, sf):
    days = signals(spark, sf).select(F.col("occurred_at").alias("d")).distinct()
    got = history.nearest_snapshot(days.filter(F.dayofmonth("d") % 5 == 0), "d", days.filter(F.dayofmonth("d") % 3 == 1), "d")
    return got.select(F.col("d").cast("string").alias("target"), F.col("snapshot").cast("string").alias("snapshot"), "off")


@query("w1_global_rank", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders")
def w1_global_rank(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return ranking.global_rank(o, "o_totalprice", "o_orderkey").select("o_orderkey", F.col("rank").cast("long").alias("rank"))


@query("w2_rank_move", f"{SIG}, {scored(DAY, 'now')}, {scored(f'({DAY} - 7)', 'was')}, a AS (SELECT entity_id, row_number() OVER (ORDER BY edge DESC, entity_id) AS rank FROM now ORDER BY edge DESC, entity_id LIMIT 50), b AS (SELECT entity_id, row_number() OVER (ORDER BY edge DESC, entity_id) AS rank FROM was WHERE edge > 0) SELECT a.entity_id, a.rank, b.rank AS rank_before FROM a LEFT JOIN b USING (entity_id)")
def w2_rank_move(spark, sf):
    s = score.score_entities(signals(spark, sf), ASOF, weeks=2).select("entity_id", "edge", F.element_at("history", -2)["edge"].alias("was"))
    now = ranking.ranked_top(s, [F.desc("edge"), F.col("entity_id")], 50).select("entity_id", F.col("rank").cast("long").alias("rank"))
    before = ranking.global_rank(s.filter("was > 0"), "was", "entity_id", "rank_before").select("entity_id", F.col("rank_before").cast("long").alias("rank_before"))
    return now.join(before, "entity_id", "left")


@query("w6_peers", f"{AW} SELECT award_id, round((rank() OVER (PARTITION BY priority ORDER BY amount) - 1) / count(*) OVER (PARTITION BY priority), 6) AS share_below FROM awards")
def w6_peers(spark, sf):
    return ranking.share_below(awards(spark, sf), ["priority"], "amount").select("award_id", F.round("share_below", 6).alias("share_below"))


@query("w7_ordinal", f"{AW} SELECT award_id, CAST(dense_rank() OVER (PARTITION BY firm ORDER BY day) AS INTEGER) AS nth FROM awards")
def w7_ordinal(spark, sf):
    return history.ordinal(awards(spark, sf), ["firm"], "day").select("award_id", "nth")


@query("w8_first_ever", f"{AW} SELECT award_id, CASE WHEN firm % 7 <> 0 THEN row_number() OVER (PARTITION BY firm ORDER BY day, award_id) = 1 END AS is_first FROM awards")
def w8_first_ever(spark, sf):
    return history.first_flag(awards(spark, sf), ["firm"], [F.col("day"), F.col("award_id")], F.col("firm") % 7 != 0).select("award_id", "is_first")


@query("w9_islands", f"{SIG}, d AS (SELECT DISTINCT entity_id, occurred_at AS d FROM signals), r AS (SELECT *, d - CAST(row_number() OVER (PARTITION BY entity_id ORDER BY d) AS INTEGER) AS run FROM d) SELECT entity_id, CAST(min(d) AS VARCHAR) AS first_day, CAST(max(d) AS VARCHAR) AS last_day, count(*) AS n_days FROM r GROUP BY entity_id, run")
def w9_islands(spark, sf):
    r = history.islands(signals(spark, sf), ["entity_id"], "occurred_at")
    return r.select("entity_id", F.col("first_day").cast("string").alias("first_day"), F.col("last_day").cast("string").alias("last_day"), "n_days")


@query("w10_best_row", f"{SIG} SELECT entity_id, signal_id, value FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY value DESC, signal_id) AS nth FROM signals) WHERE nth = 1")
def w10_best_row(spark, sf):
    return ranking.top_per(signals(spark, sf), ["entity_id"], [F.desc("value"), F.col("signal_id")]).select("entity_id", "signal_id", "value")


@query("w11_two_caps", f"{SIG}, a AS (SELECT *, row_number() OVER (PARTITION BY entity_id, kind ORDER BY strength DESC, signal_id) AS x FROM signals), b AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY strength DESC, signal_id) AS y FROM a WHERE x <= 2) SELECT entity_id, kind, signal_id FROM b WHERE y <= 4")
def w11_two_caps(spark, sf):
    return ranking.capped(signals(spark, sf), ["entity_id"], ["kind"], [F.desc("strength"), F.col("signal_id")], 2, 4).select("entity_id", "kind", "signal_id")


@query("w12_interleave", f"{SIG}, r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY strength DESC, signal_id) AS nth FROM signals) SELECT signal_id, family, CAST(nth AS INTEGER) AS nth, CAST(ceil(nth / (CASE WHEN family = 'social' THEN 2 ELSE 1 END)) AS BIGINT) AS round FROM r ORDER BY 4, 2, 3 LIMIT 100")
def w12_interleave(spark, sf):
    picks = F.when(F.col("family") == "social", 2).otherwise(1)
    return ranking.interleaved(signals(spark, sf), "family", [F.desc("strength"), F.col("signal_id")], picks, 100).select("signal_id", "family", "nth", "round")


@query("w13_weekly_windows", f"{SIG}, w AS (SELECT unnest([0, 1, 2]) AS k) SELECT entity_id, CAST(k AS INTEGER) AS k, count(*) FILTER (WHERE a >= 0 AND a < 7) AS n7, count(*) FILTER (WHERE a >= 7 AND a < 14) AS p7 FROM (SELECT entity_id, k, date_diff('day', occurred_at, {DAY}) - 7 * k AS a FROM signals, w) GROUP BY ALL")
def w13_weekly_windows(spark, sf):
    """Windows at three week ends, as columns of one aggregation, unpivoted afterwards."""
    windows = {f"{name}_{k}": (a + 7 * k, b + 7 * k) for k in range(3) for name, (a, b) in {"n7": (0, 7), "p7": (7, 14)}.items()}
    wide = history.trailing(signals(spark, sf), ["entity_id"], "occurred_at", asof_day(), windows)
    return wide.select("entity_id", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"n7_{k}").alias("n7"), F.col(f"p7_{k}").alias("p7")) for k in range(3)])).alias("x")).select("entity_id", "x.k", "x.n7", "x.p7")


@query("w14_neighbours", f"{SIG}, {scored()}, b AS (SELECT entity_id, row_number() OVER (ORDER BY edge DESC, entity_id) AS rank FROM scored ORDER BY edge DESC, entity_id LIMIT 30) SELECT entity_id, lag(entity_id) OVER (ORDER BY rank) AS before, lead(entity_id) OVER (ORDER BY rank) AS after FROM b")
def w14_neighbours(spark, sf):
    b = ranking.ranked_top(score.score_entities(signals(spark, sf), ASOF, weeks=1).select("entity_id", "edge"), [F.desc("edge"), F.col("entity_id")], 30)
    w = Window.orderBy("rank")  # thirty rows
    return b.select("entity_id", F.lag("entity_id").over(w).alias("before"), F.lead("entity_id").over(w).alias("after"))


@query("w15_rising", f"{SIG} SELECT entity_id, count(*) FILTER (WHERE rising) AS n_rising FROM (SELECT entity_id, value > lag(value, 2) OVER (PARTITION BY entity_id ORDER BY ts, signal_id) AS rising FROM signals) GROUP BY 1")
def w15_rising(spark, sf):
    w = Window.partitionBy("entity_id").orderBy("ts", "signal_id")
    rising = signals(spark, sf).withColumn("rising", F.col("value") > F.lag("value", 2).over(w))
    return rising.groupBy("entity_id").agg(F.count(F.when(F.col("rising"), 1)).alias("n_rising"))


@query("w16_densest", f"{AW}, d AS (SELECT firm, day, count(*) AS n FROM awards GROUP BY ALL), w AS (SELECT firm, day, sum(n) OVER (PARTITION BY firm ORDER BY day RANGE BETWEEN CURRENT ROW AND INTERVAL 29 DAY FOLLOWING) AS k FROM d) SELECT firm, CAST(max(k) AS BIGINT) AS densest, CAST(arg_min(day, (-k, day)) AS VARCHAR) AS from_day FROM w GROUP BY 1")
def w16_densest(spark, sf):
    return history.densest(awards(spark, sf), ["firm"], "day", 30).withColumn("from_day", F.col("from_day").cast("string"))


@query("w17_primary", f"{AW}, b AS (SELECT firm, priority, max(day) AS newest, count(*) AS n FROM awards GROUP BY ALL), f AS (SELECT *, max(newest) OVER (PARTITION BY firm) AS freshest FROM b) SELECT firm, priority, n FROM (SELECT *, row_number() OVER (PARTITION BY firm ORDER BY newest DESC, n DESC, priority) AS nth FROM f WHERE date_diff('day', newest, freshest) <= 90) WHERE nth = 1")
def w17_primary(spark, sf):
    b = awards(spark, sf).groupBy("firm", "priority").agg(F.max("day").alias("newest"), n_rows().alias("n"))
    fresh = b.withColumn("freshest", F.max("newest").over(Window.partitionBy("firm"))).filter(F.datediff("freshest", "newest") <= 90)
    return ranking.top_per(fresh, ["firm"], [F.desc("newest"), F.desc("n"), F.col("priority")]).select("firm", "priority", "n")


@query("w18_later_of_two", "SELECT o_orderkey, CAST(greatest(CAST(o_orderdate AS DATE), first_ship) AS VARCHAR) AS event_day, first_ship > CAST(o_orderdate AS DATE) AS announced_earlier FROM orders JOIN (SELECT l_orderkey, min(CAST(l_shipdate AS DATE)) AS first_ship FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def w18_later_of_two(spark, sf):
    ship = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.to_date(F.min("l_shipdate")).alias("first_ship"))
    o = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    return o.join(ship, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", F.greatest("d", "first_ship").cast("string").alias("event_day"), (F.col("first_ship") > F.col("d")).alias("announced_earlier"))


@query("k1_top_per_entity", f"{SIG} SELECT entity_id, signal_id FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY strength DESC, signal_id) AS nth FROM signals) WHERE nth <= 5")
def k1_top_per_entity(spark, sf):
    return ranking.top_per(signals(spark, sf), ["entity_id"], [F.desc("strength"), F.col("signal_id")], 5).select("entity_id", "signal_id")


@query("k3_why_now", f"{SIG}, a AS (SELECT *, row_number() OVER (PARTITION BY entity_id, family ORDER BY strength DESC, signal_id) AS x FROM signals WHERE strength > 0.02), b AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY strength DESC, signal_id) AS y FROM a WHERE x = 1) SELECT entity_id, family, signal_id, CAST(y AS INTEGER) AS nth FROM b WHERE y <= 3")
def k3_why_now(spark, sf):
    order = [F.desc("strength"), F.col("signal_id")]
    one = ranking.top_per(signals(spark, sf).filter("strength > 0.02"), ["entity_id", "family"], order)
    return ranking.top_per(one, ["entity_id"], order, 3, nth="nth").select("entity_id", "family", "signal_id", "nth")


@query("k4_leads", f"{SIG}, {scored()}, c AS (SELECT entity_id, edge, entity_id % 5 AS sector FROM scored WHERE convergence >= 2), r AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY edge DESC, entity_id) AS nth FROM c) SELECT entity_id, sector FROM r ORDER BY CASE WHEN nth > 1 THEN 1 ELSE 0 END, edge DESC, entity_id LIMIT 3")
def k4_leads(spark, sf):
    s = score.score_entities(signals(spark, sf), ASOF, weeks=1).filter("convergence >= 2").select("entity_id", "edge", (F.col("entity_id") % 5).alias("sector"))
    nth = F.row_number().over(Window.partitionBy("sector").orderBy(F.desc("edge"), "entity_id"))
    return s.withColumn("nth", nth).orderBy(F.col("nth") > 1, F.desc("edge"), "entity_id").limit(3).select("entity_id", "sector")


@query("k5_day_groups", f"{SIG} SELECT CAST(occurred_at AS VARCHAR) AS day, count(*) AS n, string_agg(CAST(signal_id AS VARCHAR), ',' ORDER BY strength DESC, signal_id) FILTER (WHERE nth <= 3) AS top FROM (SELECT *, row_number() OVER (PARTITION BY occurred_at ORDER BY strength DESC, signal_id) AS nth FROM signals) GROUP BY 1")
def k5_day_groups(spark, sf):
    s = signals(spark, sf)
    top = ranking.top_per(s, ["occurred_at"], [F.desc("strength"), F.col("signal_id")], 3, nth="nth").groupBy("occurred_at").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "signal_id"))), lambda x: x["signal_id"].cast("string")), ",").alias("top"))
    return s.groupBy("occurred_at").agg(n_rows().alias("n")).join(top, "occurred_at").select(F.col("occurred_at").cast("string").alias("day"), "n", "top")


@query("k6_budget", f"{SIG} SELECT entity_id, round((1 + sum(strength)) * (1 + 0.5 * (count(DISTINCT kind) - 1)), 6) AS prelim FROM signals GROUP BY 1 ORDER BY round((1 + sum(strength)) * (1 + 0.5 * (count(DISTINCT kind) - 1)), 6) DESC, entity_id LIMIT 25")
def k6_budget(spark, sf):
    prelim = F.round((1 + F.sum("strength")) * (1 + 0.5 * (F.countDistinct("kind") - 1)), 6)
    return signals(spark, sf).groupBy("entity_id").agg(prelim.alias("prelim")).orderBy(F.desc("prelim"), "entity_id").limit(25)
