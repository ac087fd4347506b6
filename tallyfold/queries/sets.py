"""Set operations, the store, and joins between tables."""

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import store
from ..operators.ranking import top_per
from ..sources.views import awards, n_rows, signals, table
from .sqltext import AW, SIG


@query("u1_fingerprint", f"{SIG} SELECT signal_id, left(sha256(CASE WHEN subject % 5 = 0 THEN concat_ws('|', 'events', kind, entity_id, subject) ELSE concat_ws('|', 'events', kind, entity_id, 'http://e/' || subject, occurred_at) END), 32) AS fingerprint FROM signals")
def u1_fingerprint(spark, sf):
    fp = store.fingerprint(F.lit("events"), F.col("kind"), F.col("entity_id"), F.concat(F.lit("http://e/"), F.col("subject").cast("string")), F.col("occurred_at"), F.col("subject"), F.col("subject") % 5 == 0)
    return signals(spark, sf).select("signal_id", fp.alias("fingerprint"))


def _batches(spark, sf):
    s = signals(spark, sf).withColumn("fingerprint", F.concat_ws("|", F.col("entity_id").cast("string"), F.col("kind"), F.col("subject").cast("string")))
    s = s.select("fingerprint", "strength", F.col("signal_id").alias("run_id"), F.unix_timestamp("ts").alias("observed_at"))
    return s.filter(F.col("run_id") % 2 == 0), s.filter(F.col("run_id") % 2 == 1)


_UP = f"{SIG}, b AS (SELECT concat_ws('|', entity_id, kind, subject) AS fingerprint, strength, signal_id AS run_id, CAST(floor(epoch(ts)) AS BIGINT) AS observed_at FROM signals)"


@query("u2_upsert", f"{_UP} SELECT fingerprint, arg_max(strength, run_id) AS strength, max(run_id) AS run_id, min(observed_at) AS observed_at FROM b GROUP BY 1")
def u2_upsert(spark, sf):
    return store.upsert(*_batches(spark, sf))


@query("u2_upsert_counts", f"{_UP} SELECT count(*) AS emitted, count(DISTINCT fingerprint) FILTER (WHERE NOT fingerprint IN (SELECT fingerprint FROM b WHERE run_id % 2 = 0)) AS inserted FROM b WHERE run_id % 2 = 1")
def u2_upsert_counts(spark, sf):
    return store.upsert_counts(*_batches(spark, sf))


@query("u3_prune", f"{SIG} SELECT signal_id FROM signals WHERE subject % 4 <> 0 UNION ALL SELECT max(signal_id) AS signal_id FROM signals WHERE subject % 4 = 0 GROUP BY entity_id, kind, subject")
def u3_prune(spark, sf):
    return store.prune_superseded(signals(spark, sf), ["entity_id", "kind", "subject"], F.col("subject") % 4 == 0, [F.desc("signal_id")]).select("signal_id")


@query("u4_dedupe", f"{SIG} SELECT signal_id FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, family, occurred_at ORDER BY strength DESC, signal_id) AS nth FROM signals) WHERE nth = 1")
def u4_dedupe(spark, sf):
    return store.dedupe(signals(spark, sf), ["entity_id", "family", "occurred_at"], [F.desc("strength"), F.col("signal_id")]).select("signal_id")


@query("u5_pages_union", "WITH a AS (SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderkey % 3 < 2), b AS (SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderkey % 3 > 0) SELECT (SELECT count(*) FROM a) + (SELECT count(*) FROM b) AS walked, (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS kept")
def u5_pages_union(spark, sf):
    o = table(spark, sf, "orders")
    both = o.filter("o_orderkey % 3 < 2").select("o_custkey", "o_orderpriority").unionByName(o.filter("o_orderkey % 3 > 0").select("o_custkey", "o_orderpriority"))
    return both.groupBy("o_custkey", "o_orderpriority").agg(n_rows().alias("n")).agg(F.sum("n").alias("walked"), n_rows().alias("kept"))


@query("u6_snapshot_diff", "WITH a AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1) SELECT o_custkey, CASE WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'removed' ELSE 'updated' END AS change FROM a FULL JOIN b USING (o_custkey) WHERE a.n IS DISTINCT FROM b.n")
def u6_snapshot_diff(spark, sf):
    o = table(spark, sf, "orders")
    a = o.filter("o_orderkey % 2 = 0").groupBy("o_custkey").agg(n_rows().alias("n"))
    b = o.filter("o_orderkey % 2 = 1").groupBy("o_custkey").agg(n_rows().alias("n"))
    return store.snapshot_diff(a, b, "o_custkey", ["n"])


@query("u8_merged_feeds", f"{AW} SELECT firm, award_id FROM (SELECT *, row_number() OVER (PARTITION BY firm ORDER BY award_id DESC) AS nth FROM awards) WHERE nth = 1")
def u8_merged_feeds(spark, sf):
    a = awards(spark, sf)
    return store.merged_feeds(a.filter("award_id % 5 < 2"), a.filter("award_id % 5 >= 2"), key="firm", moment="award_id").select("firm", "award_id")


@query("u9_array_sets", f"{SIG}, a AS (SELECT entity_id, list(DISTINCT kind) FILTER (WHERE occurred_at < DATE '2024-01-16') AS x, list(DISTINCT kind) FILTER (WHERE occurred_at >= DATE '2024-01-16') AS y FROM signals GROUP BY 1) SELECT entity_id, len(list_intersect(coalesce(x, []), coalesce(y, []))) AS both, len(list_distinct(list_concat(coalesce(x, []), coalesce(y, [])))) AS either FROM a")
def u9_array_sets(spark, sf):
    early = F.col("occurred_at") < "2024-01-16"
    a = signals(spark, sf).groupBy("entity_id").agg(F.collect_set(F.when(early, F.col("kind"))).alias("x"), F.collect_set(F.when(~early, F.col("kind"))).alias("y"))
    return a.select("entity_id", F.size(F.array_intersect("x", "y")).cast("long").alias("both"), F.size(F.array_union("x", "y")).cast("long").alias("either"))


@query("u9_except", "SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P' EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def u9_except(spark, sf):
    o = table(spark, sf, "orders")
    return o.filter("o_orderstatus = 'P'").select("o_custkey").subtract(o.filter("o_orderpriority = '1-URGENT'").select("o_custkey"))


@query("u10_chain_dedupe", f"{AW}, a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY firm, day ORDER BY award_id) AS x FROM awards) WHERE x = 1), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY firm, priority, status ORDER BY day, award_id) AS y FROM a) WHERE y = 1) SELECT award_id FROM b")
def u10_chain_dedupe(spark, sf):
    one = top_per(awards(spark, sf), ["firm", "day"], [F.col("award_id")])
    return top_per(one, ["firm", "priority", "status"], [F.col("day"), F.col("award_id")]).select("award_id")


@query("u12_since_last", f"{SIG} SELECT entity_id, CAST(max(occurred_at) AS VARCHAR) AS last_day FROM signals GROUP BY 1 HAVING max(occurred_at) > DATE '2024-01-27'")
def u12_since_last(spark, sf):
    return signals(spark, sf).groupBy("entity_id").agg(F.max("occurred_at").alias("d")).filter("d > DATE '2024-01-27'").select("entity_id", F.col("d").cast("string").alias("last_day"))


_BITS = "flatten(list_transform(range(1, length(c_name) + 1), lambda i: list_transform(range(0, 8), lambda k: CAST((ord(c_name[i]) >> k) & 1 AS BIGINT))))"
_CRC32 = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {_BITS}), lambda a, b: CASE WHEN xor(a, b) & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END), 4294967295::BIGINT)"


@query("u13_hash_sample", f"SELECT c_custkey, c_name FROM customer WHERE {_CRC32} % 16 = 0")
def u13_hash_sample(spark, sf):
    return store.hash_sample(table(spark, sf, "customer"), "c_name", 16).select("c_custkey", "c_name")


@query("j3_wanted", "SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7) GROUP BY 1")
def j3_wanted(spark, sf):
    wanted = table(spark, sf, "part").filter("p_size = 7").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, sf, "lineitem").join(wanted, "l_partkey", "left_semi").groupBy("l_suppkey").agg(n_rows().alias("n"))


@query("j4_new_entrants", "SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= DATE '2001-01-01' AND NOT o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate >= DATE '2000-01-01' AND o_orderdate < DATE '2000-07-01') AND NOT o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate < DATE '1995-07-01')")
def j4_new_entrants(spark, sf):
    a = awards(spark, sf).select(F.col("firm").alias("o_custkey"), "day")
    new = a.filter("day >= DATE '2001-01-01'").select("o_custkey").distinct()
    for condition in ("day >= DATE '2000-01-01' AND day < DATE '2000-07-01'", "day < DATE '1995-07-01'"):
        new = new.join(a.filter(condition).select("o_custkey"), "o_custkey", "left_anti")
    return new


@query("j14_overlap", "WITH s AS (SELECT l_orderkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1), p AS (SELECT a.l_orderkey AS x, b.l_orderkey AS y, count(DISTINCT a.l_partkey) AS k FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND b.l_orderkey = a.l_orderkey + 1 GROUP BY ALL) SELECT x, y, round(k / n, 6) AS share FROM p JOIN s ON s.l_orderkey = x")
def j14_overlap(spark, sf):
    """Share of an order's parts that the order after it has too: neighbours join on the part and the number."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").distinct()
    n = li.groupBy("l_orderkey").agg(n_rows().alias("n"))
    after = li.select((F.col("l_orderkey") - 1).alias("l_orderkey"), "l_partkey", F.col("l_orderkey").alias("y"))
    k = li.join(after, ["l_orderkey", "l_partkey"]).groupBy("l_orderkey", "y").agg(n_rows().alias("k"))
    return k.join(n, "l_orderkey").select(F.col("l_orderkey").alias("x"), "y", F.round(F.col("k") / F.col("n"), 6).alias("share"))


@query("j16_p8_lead_time", "WITH s AS (SELECT l_orderkey, min(CAST(l_shipdate AS DATE)) AS first_seen FROM lineitem GROUP BY 1) SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), first_seen) AS lead_days FROM orders JOIN s ON l_orderkey = o_orderkey")
def j16_p8_lead_time(spark, sf):
    s = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("first_seen"))
    return table(spark, sf, "orders").join(s, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", F.datediff("first_seen", "o_orderdate").cast("long").alias("lead_days"))


@query("j23_second_source_date", "WITH s AS (SELECT l_orderkey, min(CAST(l_shipdate AS DATE)) AS d FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) SELECT o_custkey, count(*) AS n FROM (SELECT o_custkey, coalesce(d, CAST(o_orderdate AS DATE)) AS day FROM orders LEFT JOIN s ON l_orderkey = o_orderkey) WHERE day BETWEEN DATE '1998-01-01' AND DATE '1999-12-31' GROUP BY 1")
def j23_second_source_date(spark, sf):
    s = table(spark, sf, "lineitem").filter("l_linenumber = 1").groupBy("l_orderkey").agg(F.to_date(F.min("l_shipdate")).alias("d"))
    o = table(spark, sf, "orders").join(s, F.col("l_orderkey") == F.col("o_orderkey"), "left").withColumn("day", F.coalesce("d", F.to_date("o_orderdate")))
    return o.filter("day BETWEEN DATE '1998-01-01' AND DATE '1999-12-31'").groupBy("o_custkey").agg(n_rows().alias("n"))


@query("j24_agreement", "WITH t AS (SELECT l_orderkey, sum(l_extendedprice) AS total, max(l_linestatus) AS status FROM lineitem GROUP BY 1) SELECT CASE WHEN l_orderkey IS NULL THEN 'missing' WHEN status <> o_orderstatus THEN 'status' WHEN abs(total - o_totalprice) > 100000 THEN 'amount' ELSE 'agrees' END AS verdict, count(*) AS n FROM orders LEFT JOIN t ON l_orderkey = o_orderkey GROUP BY 1")
def j24_agreement(spark, sf):
    t = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("total"), F.max("l_linestatus").alias("status"))
    o = table(spark, sf, "orders").join(t, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    verdict = F.when(F.col("l_orderkey").isNull(), "missing").when(F.col("status") != F.col("o_orderstatus"), "status").when(F.abs(F.col("total") - F.col("o_totalprice")) > 100000, "amount").otherwise("agrees")
    return o.groupBy(verdict.alias("verdict")).agg(n_rows().alias("n"))


@query("j26_interval_overlap", "WITH p AS (SELECT o_custkey AS firm, o_orderpriority AS role, min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS b FROM orders GROUP BY ALL) SELECT x.firm, x.role AS role_a, y.role AS role_b, date_diff('day', greatest(x.a, y.a), least(x.b, y.b)) + 1 AS days FROM p x JOIN p y ON x.firm = y.firm AND x.role < y.role WHERE date_diff('day', greatest(x.a, y.a), least(x.b, y.b)) >= 365")
def j26_interval_overlap(spark, sf):
    """Pairs of a firm's roles, from a role's first to its last award, that ran side by side for a year or more."""
    from ..operators.matching import overlapping

    p = awards(spark, sf).groupBy("firm", F.col("priority").alias("role")).agg(F.min("day").alias("a"), F.max("day").alias("b"))
    return overlapping(p, ["firm"], "role", "a", "b", 366).select("firm", "role_a", "role_b", F.col("days").cast("long").alias("days"))


@query("j21_registry", "SELECT c_custkey, n_name, CASE WHEN r_name = 'EUROPE' THEN 'same place' ELSE 'elsewhere' END AS place FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE c_acctbal < 0")
def j21_registry(spark, sf):
    c = table(spark, sf, "customer").filter("c_acctbal < 0")
    place = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return c.join(place, F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", "n_name", F.when(F.col("r_name") == "EUROPE", "same place").otherwise("elsewhere").alias("place"))


@query("j12_drop_lists", f"{SIG} SELECT signal_id FROM signals WHERE NOT subject IN (SELECT p_size FROM part WHERE p_size % 10 = 0)")
def j12_drop_lists(spark, sf):
    drop = table(spark, sf, "part").filter("p_size % 10 = 0").select(F.col("p_size").cast("int").alias("subject")).distinct()
    return signals(spark, sf).join(drop, "subject", "left_anti").select("signal_id")
