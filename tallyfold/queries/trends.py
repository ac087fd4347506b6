"""Aggregations and trends: trailing windows, facets, rollups, batches, velocity."""

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import history, quality
from ..plans import score
from ..operators.ranking import top_per
from ..sources.views import ASOF, asof_day, awards, n_rows, signals, table
from .sqltext import AW, DAY, SIG, sq


def _if(c):
    return F.count(F.when(c, 1))


@query("g4_facets", f"{SIG} SELECT count(*) FILTER (WHERE family = 'social' AND subject < 50) AS social, count(*) FILTER (WHERE family = 'capital' AND subject < 50) AS capital, count(*) FILTER (WHERE subject < 50) AS low, count(*) FILTER (WHERE subject >= 50) AS high FROM signals")
def g4_facets(spark, sf):
    """Each facet counted with the other facets' filters applied, in one pass."""
    low, f = F.col("subject") < 50, F.col("family")
    return signals(spark, sf).agg(_if((f == "social") & low).alias("social"), _if((f == "capital") & low).alias("capital"), _if(low).alias("low"), _if(~low).alias("high"))


@query("g5_rollup", f"{SIG} SELECT family, kind, count(*) AS n, count(DISTINCT entity_id) AS entities FROM signals GROUP BY ROLLUP (family, kind)")
def g5_rollup(spark, sf):
    return signals(spark, sf).rollup("family", "kind").agg(n_rows().alias("n"), F.countDistinct("entity_id").alias("entities"))


@query("g5_cube", f"{AW} SELECT status, priority, count(*) AS n, round(sum(amount), 2) AS total FROM awards GROUP BY CUBE (status, priority)")
def g5_cube(spark, sf):
    return awards(spark, sf).cube("status", "priority").agg(n_rows().alias("n"), F.round(F.sum("amount"), 2).alias("total"))


_TR = "count(*) FILTER (WHERE a >= 0 AND a < 7) AS n7, count(*) FILTER (WHERE a >= 7 AND a < 14) AS p7, count(*) FILTER (WHERE a >= 0 AND a < 30) AS n30"


@query("g6_trailing", f"WITH t AS (SELECT user_id, {_TR} FROM (SELECT user_id, date_diff('day', CAST(ts AS DATE), {DAY}) AS a FROM events) GROUP BY 1) SELECT *, round((n7 + 1) / (p7 + 1), 6) AS accel FROM t")
def g6_trailing(spark, sf):
    t = history.trailing(table(spark, sf, "events").withColumn("d", F.to_date("ts")), ["user_id"], "d", asof_day(), {"n7": (0, 7), "p7": (7, 14), "n30": (0, 30)})
    return t.withColumn("accel", F.round(history.acceleration(F.col("n7"), F.col("p7")), 6))


@query("g6_peak_day", "WITH d AS (SELECT user_id, CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, max(n) AS peak, CAST(arg_max(d, (n, -date_diff('day', DATE '1970-01-01', d))) AS VARCHAR) AS peak_day, count(*) AS active_days FROM d GROUP BY 1")
def g6_peak_day(spark, sf):
    d = table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("d")).agg(n_rows().alias("n"))
    return d.groupBy("user_id").agg(F.max("n").alias("peak"), F.max_by("d", F.struct(F.col("n"), -history.days("d"))).cast("string").alias("peak_day"), n_rows().alias("active_days"))


@query("g7_board_stats", f"{AW} SELECT firm, count(*) AS open, count(*) FILTER (WHERE status = 'O') AS dated, count(*) FILTER (WHERE a BETWEEN 0 AND 364) AS new_year, count(DISTINCT (priority, status)) AS pairs FROM (SELECT *, date_diff('day', day, DATE '2001-08-01') AS a FROM awards) GROUP BY 1")
def g7_board_stats(spark, sf):
    age = F.datediff(F.to_date(F.lit("2001-08-01")), F.col("day"))
    return awards(spark, sf).groupBy("firm").agg(n_rows().alias("open"), _if(F.col("status") == "O").alias("dated"), _if(age.between(0, 364)).alias("new_year"), F.countDistinct("priority", "status").alias("pairs"))


@query("g8_first_batch", f"{AW}, s AS (SELECT *, min(day) OVER (PARTITION BY firm) AS first FROM awards), g AS (SELECT firm, count(*) AS n, count(*) FILTER (WHERE date_diff('day', first, day) <= 200) AS n_first FROM s GROUP BY 1) SELECT firm, n, n_first, (n_first = n AND n_first >= 3) OR (n_first >= 5 AND n_first >= 0.5 * n) OR (n_first >= 10 AND n_first >= 0.3 * n) AS is_birth FROM g")
def g8_first_batch(spark, sf):
    return history.first_batch(awards(spark, sf), ["firm"], "day", gap=200).drop("first_day")


@query("g9_actor_quality", "WITH a AS (SELECT DISTINCT CAST(json_extract_string(props, '$.k') AS INTEGER) AS repo, user_id FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY user_id DESC) AS nth FROM a), g AS (SELECT repo, count(*) AS n, avg(CAST(user_id % 400 < 90 AS INTEGER)) AS young, avg(CAST(user_id % 3 = 0 AS INTEGER)) AS blank, list_sort(list(user_id % 400))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS median FROM r WHERE nth <= 30 GROUP BY 1 HAVING count(*) >= 15) SELECT repo, n, round(young, 6) AS young, median, young > 0.5 OR (young >= 0.3 AND blank >= 0.7 AND median < 365) AS bought FROM g")
def g9_actor_quality(spark, sf):
    a = table(spark, sf, "events").select(F.get_json_object("props", "$.k").cast("int").alias("repo"), "user_id").distinct()
    newest = top_per(a, ["repo"], [F.desc("user_id")], 30).withColumn("age", F.col("user_id") % 400)
    g = newest.groupBy("repo").agg(n_rows().alias("n"), F.avg((F.col("age") < 90).cast("int")).alias("young"), F.avg((F.col("user_id") % 3 == 0).cast("int")).alias("blank"), F.array_sort(F.collect_list("age")).alias("ages")).filter("n >= 15")
    g = g.withColumn("median", F.element_at("ages", (F.floor(F.col("n") / 2) + 1).cast("int")))
    return g.select("repo", "n", F.round("young", 6).alias("young"), "median", quality.bought(F.col("young"), F.col("blank"), F.col("median")).alias("bought"))


_ME = f"SELECT subject, count(*) FILTER (WHERE a < 14) AS n4, count(*) FILTER (WHERE a >= 14) AS n8, count(DISTINCT CASE WHEN a < 14 THEN entity_id END) AS authors FROM (SELECT *, date_diff('day', occurred_at, {DAY}) AS a FROM signals) GROUP BY 1"


@query("g10_b9_mentions", f"{SIG}, m AS ({_ME}), l AS (SELECT *, CASE WHEN n8 > 0 THEN n4 / (n8 / 2) END AS lift FROM m) SELECT subject, n4, n8, authors, round(lift, 6) AS lift, n4 >= 2 AND authors >= 2 AND (lift IS NULL OR lift >= 1.5) AS rise FROM l")
def g10_b9_mentions(spark, sf):
    age = F.datediff(asof_day(), F.col("occurred_at"))
    m = signals(spark, sf).groupBy("subject").agg(_if(age < 14).alias("n4"), _if(age >= 14).alias("n8"), F.countDistinct(F.when(age < 14, F.col("entity_id"))).alias("authors"))
    lift = F.when(F.col("n8") > 0, F.col("n4") / (F.col("n8") / 2))
    return m.select("subject", "n4", "n8", "authors", F.round(lift, 6).alias("lift"), quality.rises(F.col("n4"), F.col("authors"), lift).alias("rise"))


@query("g12_makers", f"{AW}, f AS (SELECT firm, priority, count(*) AS n, bool_and(status = 'F') AS fresh, max(day) AS latest FROM awards GROUP BY ALL) SELECT firm, count(*) AS families, bool_and(fresh) AS all_new, CAST(sum(n) AS BIGINT) AS n, CAST(max(latest) AS VARCHAR) AS latest FROM f GROUP BY 1")
def g12_makers(spark, sf):
    f = awards(spark, sf).groupBy("firm", "priority").agg(n_rows().alias("n"), F.bool_and(F.col("status") == "F").alias("fresh"), F.max("day").alias("latest"))
    return f.groupBy("firm").agg(n_rows().alias("families"), F.bool_and("fresh").alias("all_new"), F.sum("n").alias("n"), F.max("latest").cast("string").alias("latest"))


@query("g13_certificates", "SELECT l_partkey AS host, count(*) AS n, CAST(min(CAST(l_shipdate AS DATE)) AS VARCHAR) AS earliest, arg_min(l_orderkey, (l_shipdate, l_orderkey, l_linenumber)) AS issued_for, date_diff('day', min(CAST(l_shipdate AS DATE)), DATE '2001-06-01') <= 300 AS fresh FROM lineitem GROUP BY 1")
def g13_certificates(spark, sf):
    first = F.min_by("l_orderkey", F.struct("l_shipdate", "l_orderkey", "l_linenumber"))
    day = F.to_date(F.min("l_shipdate"))
    return table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("host")).agg(n_rows().alias("n"), day.cast("string").alias("earliest"), first.alias("issued_for"), (F.datediff(F.to_date(F.lit("2001-06-01")), day) <= 300).alias("fresh"))


@query("g14_papers", "WITH p AS (SELECT *, row_number() OVER (PARTITION BY source, lower(string_split(text, chr(10))[1]) ORDER BY doc_id) AS nth FROM documents) SELECT source, count(*) AS papers, count(*) FILTER (WHERE nth > 1) AS repeats FROM p GROUP BY 1")
def g14_papers(spark, sf):
    title = F.lower(F.substring_index("text", "\n", 1))
    per = table(spark, sf, "documents").groupBy("source", title.alias("title")).agg(n_rows().alias("n"))
    return per.groupBy("source").agg(F.sum("n").alias("papers"), F.sum(F.col("n") - 1).alias("repeats"))


@query("g15_prelim", f"{SIG} SELECT entity_id, round((1 + sum(strength)) * (1 + 0.5 * (count(DISTINCT kind) - 1)), 6) AS prelim FROM signals GROUP BY 1")
def g15_prelim(spark, sf):
    return signals(spark, sf).groupBy("entity_id").agg(F.round((1 + F.sum("strength")) * (1 + 0.5 * (F.countDistinct("kind") - 1)), 6).alias("prelim"))


@query("g16_family_cells", f"{SIG} SELECT entity_id, family, CAST(max(c) AS BIGINT) AS n, string_agg(CAST(signal_id AS VARCHAR), ',' ORDER BY nth) AS top FROM (SELECT *, count(*) OVER (PARTITION BY entity_id, family) AS c, row_number() OVER (PARTITION BY entity_id, family ORDER BY strength DESC, signal_id) AS nth FROM signals) WHERE nth <= 2 GROUP BY ALL")
def g16_family_cells(spark, sf):
    s = top_per(signals(spark, sf), ["entity_id", "family"], [F.desc("strength"), F.col("signal_id")], 2, nth="nth")
    n = signals(spark, sf).groupBy("entity_id", "family").agg(n_rows().alias("n"))
    top = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "signal_id"))), lambda x: x["signal_id"].cast("string")), ",")
    t = s.groupBy(F.col("entity_id").alias("e"), F.col("family").alias("f")).agg(top.alias("top"))
    return n.join(t, F.col("entity_id").eqNullSafe(F.col("e")) & F.col("family").eqNullSafe(F.col("f"))).drop("e", "f")


@query("g18_novelty", f"{AW}, d AS (SELECT firm, count(DISTINCT priority) AS kinds FROM awards GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY firm, priority ORDER BY day, award_id) AS nth FROM awards) SELECT kinds, count(*) AS emitted FROM r JOIN d USING (firm) WHERE nth <= 3 GROUP BY 1")
def g18_novelty(spark, sf):
    a = awards(spark, sf)
    kinds = a.groupBy("firm").agg(F.countDistinct("priority").alias("kinds"))
    return top_per(a, ["firm", "priority"], [F.col("day"), F.col("award_id")], 3).join(kinds, "firm").groupBy("kinds").agg(n_rows().alias("emitted"))


@query("g19_owner_max", f"{SIG} SELECT signal_id, max(value) OVER (PARTITION BY entity_id) AS owner_max FROM signals")
def g19_owner_max(spark, sf):
    s = signals(spark, sf).select("signal_id", "entity_id", "value")
    return s.join(s.groupBy("entity_id").agg(F.max("value").alias("owner_max")), "entity_id").select("signal_id", "owner_max")


@query("g21_share_drop", "SELECT l_suppkey, round(avg(CAST(l_returnflag = 'R' AS INTEGER)), 6) AS share FROM lineitem GROUP BY 1 HAVING avg(CAST(l_returnflag = 'R' AS INTEGER)) < 0.34")
def g21_share_drop(spark, sf):
    share = F.avg((F.col("l_returnflag") == "R").cast("int"))
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(share.alias("s")).filter("s < 0.34").select("l_suppkey", F.round("s", 6).alias("share"))


@query("g22_merged_facets", "SELECT name, count(*) AS n FROM (SELECT unnest([o_orderstatus, left(o_orderpriority, 1)]) AS name FROM orders) GROUP BY 1")
def g22_merged_facets(spark, sf):
    return table(spark, sf, "orders").select(F.explode(F.array("o_orderstatus", F.substring("o_orderpriority", 1, 1))).alias("name")).groupBy("name").agg(n_rows().alias("n"))


@query("t1_weekly", f"{SIG} SELECT entity_id, CAST(floor(date_diff('day', occurred_at, {DAY}) / 7) AS INTEGER) AS week, count(*) AS n FROM signals WHERE date_diff('day', occurred_at, {DAY}) < 28 GROUP BY ALL")
def t1_weekly(spark, sf):
    return history.weekly_counts(signals(spark, sf), ["entity_id"], "occurred_at", asof_day(), 4)


@query("t2_sliding", "SELECT CAST(d AS VARCHAR) AS start, kind, count(*) AS n FROM (SELECT unnest([CAST(ts AS DATE) - 1, CAST(ts AS DATE)]) AS d, event_type AS kind FROM events) GROUP BY ALL")
def t2_sliding(spark, sf):
    w = table(spark, sf, "events").groupBy(F.window("ts", "2 days", "1 day").alias("w"), F.col("event_type").alias("kind")).agg(n_rows().alias("n"))
    return w.select(F.to_date("w.start").cast("string").alias("start"), "kind", "n")


@query("t3_day_arrays", f"{SIG} SELECT CAST(occurred_at AS VARCHAR) AS day, count(*) AS n FROM signals GROUP BY 1")
def t3_day_arrays(spark, sf):
    """Weekly arrays of seven daily counts, taken apart to days again."""
    s = signals(spark, sf).withColumn("week", F.date_sub(F.col("occurred_at"), F.dayofweek("occurred_at") - 1)).withColumn("k", F.dayofweek("occurred_at") - 1)
    arrays = s.groupBy("week").agg(F.array(*[F.count(F.when(F.col("k") == i, 1)) for i in range(7)]).alias("days"))
    return arrays.select("week", F.posexplode("days").alias("i", "n")).filter("n > 0").select(F.date_add("week", F.col("i")).cast("string").alias("day"), "n")


@query("t5_available", "WITH p AS (SELECT l_orderkey, min(CAST(l_shipdate AS DATE)) AS public_at FROM lineitem GROUP BY 1), s AS (SELECT o_orderstatus, date_diff('day', coalesce(public_at, CAST(o_orderdate AS DATE)), DATE '1999-01-01') AS age FROM orders LEFT JOIN p ON l_orderkey = o_orderkey) SELECT o_orderstatus, count(*) AS n, round(sum(CASE WHEN age < -1 THEN 0.0 ELSE pow(0.5, greatest(age, 0) / 45.0) END), 6) AS live FROM s GROUP BY 1")
def t5_available(spark, sf):
    p = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.to_date(F.min("l_shipdate")).alias("public_at"))
    o = table(spark, sf, "orders").join(p, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    live = score.strength_asof(F.lit(1.0), F.lit("capital"), F.to_date("o_orderdate"), F.to_date(F.lit("1999-01-01")), F.col("public_at"))
    return o.groupBy("o_orderstatus").agg(n_rows().alias("n"), F.round(F.sum(live), 6).alias("live"))


_V = f"0.12 + 0.85 * (0.55 * {sq('n7', 120)} + 0.45 * {sq('n30', 500)}) + {sq('n7', 80)} * 0.045 * greatest(-3.0, least(4.0, log2((n7 + 1) / (p7 + 1)))) + {sq('n30', 300)} * 0.03 * greatest(-2.0, least(4.0, log2((n30 + 1) / 1.0)))"


@query("t10_velocity", f"WITH t AS (SELECT user_id, {_TR} FROM (SELECT user_id, date_diff('day', CAST(ts AS DATE), {DAY}) AS a FROM events) GROUP BY 1) SELECT user_id, round(greatest(0.05, least(0.98, {_V})), 6) AS strength FROM t")
def t10_velocity(spark, sf):
    t = history.trailing(table(spark, sf, "events").withColumn("d", F.to_date("ts")), ["user_id"], "d", asof_day(), {"n7": (0, 7), "p7": (7, 14), "n30": (0, 30)})
    return t.select("user_id", F.round(score.velocity_strength(F.col("n7"), F.col("p7"), F.col("n30"), F.lit(0), F.lit(0)), 6).alias("strength"))


@query("b8_movement", f"WITH t AS (SELECT user_id, {_TR} FROM (SELECT user_id, date_diff('day', CAST(ts AS DATE), {DAY}) AS a FROM events) GROUP BY 1) SELECT user_id, CASE WHEN user_id % 3 = 0 THEN n30 >= 20 OR n7 >= 10 WHEN user_id % 3 = 1 THEN n30 >= 20 ELSE (n30 + 1 >= 1.5 AND n30 >= 30) OR ((n7 + 1) / (p7 + 1) >= 2 AND n7 >= 20) END AS moves FROM t")
def b8_movement(spark, sf):
    t = history.trailing(table(spark, sf, "events").withColumn("d", F.to_date("ts")), ["user_id"], "d", asof_day(), {"n7": (0, 7), "p7": (7, 14), "n30": (0, 30)})
    k = F.col("user_id") % 3
    m = quality.moves(k == 0, F.when(k == 2, 900).otherwise(100), F.col("n7"), F.col("n30"), history.acceleration(F.col("n7"), F.col("p7")), history.acceleration(F.col("n30"), F.lit(0)))
    return t.select("user_id", m.alias("moves"))
