"""Records read from text, and discounts."""

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import records
from ..sources.views import awards, n_rows, signals, table
from .sqltext import AW, SIG, sq


@query("d6_goods", f"{AW}, p AS (SELECT firm, priority, count(*) AS n, count(*) FILTER (WHERE status = 'F') AS t, count(*) FILTER (WHERE award_id % 6 = 0) AS c FROM awards GROUP BY ALL), m AS (SELECT firm, sum(t) / sum(n) AS share, max(t / n) AS best, sum(c) / sum(n) AS consumer FROM p GROUP BY 1) SELECT CASE WHEN consumer > 0.25 THEN 'consumer' WHEN share >= 0.1 AND best >= 0.3 THEN 'kept' ELSE 'off thesis' END AS verdict, count(*) AS n, round(avg(share), 6) AS share FROM m GROUP BY 1")
def d6_goods(spark, sf):
    g = records.goods_shares(awards(spark, sf), "firm", "priority", F.col("status") == "F", F.col("award_id") % 6 == 0)
    return g.groupBy("verdict").agg(n_rows().alias("n"), F.round(F.avg("share"), 6).alias("share"))


@query("d8_headers", r"SELECT doc_id, trim(string_split(line, '|')[1]) AS name, len(list_filter(string_split(line, '|'), lambda x: trim(x) <> '')) AS fields FROM (SELECT doc_id, string_split(text, chr(10))[1] AS line FROM documents) WHERE contains(line, '|') AND trim(string_split(line, '|')[1]) <> ''")
def d8_headers(spark, sf):
    line = F.substring_index("text", "\n", 1)
    d = table(spark, sf, "documents").filter(line.contains("|") & (F.trim(F.substring_index(line, "|", 1)) != ""))
    fields = F.size(F.filter(F.split(line, r"\|"), lambda x: F.trim(x) != "")).cast("long")
    return d.select("doc_id", records.header_fields(F.col("text"))["name"].alias("name"), fields.alias("fields"))


@query("d9_affiliations", "SELECT n_name AS place, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 3 <> 0 GROUP BY 1")
def d9_affiliations(spark, sf):
    """Lines made of a customer, a department and a nation; those of a university are no companies."""
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    line = F.concat(F.lit("Dept. of Things, "), F.when(F.col("c_custkey") % 3 == 0, "University of X").otherwise(F.col("c_name")), F.lit("; "), F.col("n_name"))
    a = c.select(records.affiliation(line).alias("a")).select("a.*").filter("is_company")
    return a.groupBy("place").agg(n_rows().alias("n"))


@query("t11_discounts", f"{SIG} SELECT entity_id, round(sum(least(greatest(strength * (CASE WHEN y > 0.2 THEN greatest(0.4, 1 - 2 * (y - 0.2)) ELSE 1 END) * (1 - 0.4 * {sq('b - 100', 400)}) * (1 - 0.6 * {sq('f - 50', 400)}), 0), 1)), 6) AS strength FROM (SELECT *, subject / 100.0::DOUBLE AS y, value AS b, subject * 3 AS f FROM signals) GROUP BY 1")
def t11_discounts(spark, sf):
    d = records.discounted(F.col("strength"), F.col("subject") / 100, F.col("value"), F.col("subject") * 3)
    return signals(spark, sf).groupBy("entity_id").agg(F.round(F.sum(d), 6).alias("strength"))


@query("w5_fallback", "SELECT l_returnflag, round(avg(CASE WHEN x <= 0.99 THEN 50 * x / 0.99 WHEN x <= 1.29 THEN 50 + (ln(x) - ln(0.99)) * 40 / (ln(1.29) - ln(0.99)) WHEN x <= 3.09 THEN 90 + (ln(x) - ln(1.29)) * 9 / (ln(3.09) - ln(1.29)) ELSE least(99.9, 99 + (ln(x) - ln(3.09)) * 0.9 / 2) END), 4) AS percentile FROM (SELECT l_returnflag, l_quantity / 10 AS x FROM lineitem) GROUP BY 1")
def w5_fallback(spark, sf):
    p = records.fallback_percentile(F.col("l_quantity") / 10, [(0.99, 50), (1.29, 90), (3.09, 99)])
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg(p), 4).alias("percentile"))


@query("s21_merged_maps", "SELECT firm, string_agg(k || '=' || v, ';' ORDER BY k) AS links FROM (SELECT o_custkey AS firm, o_orderpriority AS k, min(o_orderkey) AS v FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL) GROUP BY 1")
def s21_merged_maps(spark, sf):
    a = awards(spark, sf).select("firm", "award_id", F.create_map("priority", F.when(F.col("status") != "P", F.col("award_id"))).alias("links"))
    m = records.merged_maps(a, ["firm"], "links", [F.col("award_id")])
    return m.select("firm", F.array_join(F.transform(F.map_entries("links"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";").alias("links"))
