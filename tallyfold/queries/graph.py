"""Entity resolution."""

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import exprs as X
from ..operators import resolve
from ..operators.ranking import top_per
from ..sources.views import awards, n_rows, table
from .sqltext import AW


@query("r1_components", """
WITH RECURSIVE host AS (SELECT page_id AS id, regexp_replace(regexp_extract(url, '://([^/?#]*)', 1), '^www\\.', '') AS k FROM pages),
links AS (SELECT id, 'h' || k AS k FROM host UNION SELECT id, 'g' || (id // 10) AS k FROM host WHERE id % 10 < 2),
e AS (SELECT DISTINCT a.id AS a, b.id AS b FROM links a JOIN links b USING (k)),
reach AS (SELECT a AS id, a AS r FROM e UNION SELECT reach.id, e.b AS r FROM reach JOIN e ON e.a = reach.r)
SELECT id AS page_id, min(r) AS component FROM reach GROUP BY 1""")
def r1_components(spark, sf):
    p = table(spark, sf, "pages").select("page_id", X.host_of(F.col("url")).alias("host"), F.when(F.col("page_id") % 10 < 2, F.floor(F.col("page_id") / 10)).alias("pair"))
    return resolve.hard_links(p, "page_id", ["host", "pair"])


@query("r3_golden_record", "SELECT source, arg_min(lang, doc_id) FILTER (WHERE lang IS NOT NULL) AS lang, arg_max(text, (length(text), text)) AS name, min(n_chars) AS n_chars, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM documents GROUP BY 1")
def r3_golden_record(spark, sf):
    d = table(spark, sf, "documents").select("source", "doc_id", "lang", F.col("lang").alias("langs"), F.col("text").alias("name"), "n_chars")
    return resolve.golden_record(d, "source", [F.col("doc_id")], first=["lang"], longest=["name"], least=["n_chars"], gathered=["langs"])


@query("r4_merge_into", "WITH m AS (SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 AND p_partkey > 0 THEN p_partkey - 1 ELSE p_partkey END AS entity FROM part) SELECT entity, count(*) AS n, min(p_brand) AS brand FROM part JOIN m USING (p_partkey) GROUP BY 1 HAVING count(*) > 1")
def r4_merge_into(spark, sf):
    p = table(spark, sf, "part")
    into = p.filter("p_partkey % 50 = 0 AND p_partkey > 0").select("p_partkey", (F.col("p_partkey") - 1).alias("into"))
    merged = p.join(into, "p_partkey", "left").withColumn("entity", F.coalesce("into", "p_partkey"))
    return merged.groupBy("entity").agg(n_rows().alias("n"), F.min("p_brand").alias("brand")).filter("n > 1")


@query("r5_record_groups")
def r5_record_groups(spark, sf):
    """Awards that share a firm, or a day and priority, are one group. All of them: what SQL's recursion can't do in time is tested on a small table."""
    a = awards(spark, sf).withColumn("slot", F.concat(F.col("day").cast("string"), F.col("priority")))
    c = resolve.hard_links(a, "award_id", ["firm", "slot"])
    return c.join(a, "award_id").groupBy("component").agg(n_rows().alias("n"), F.min("day").cast("string").alias("first_day"))


@query("r7_people", "SELECT conv_id, role AS person, arg_min(text, turn) AS first_text, max(length(text)) AS longest, count(*) AS records FROM conversations GROUP BY ALL")
def r7_people(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.col("text").alias("first_text"), F.length("text").cast("long").alias("longest"))
    return resolve.merge_people(c, "conv_id", F.col("role"), [F.col("turn")], ["first_text"], ["longest"])


@query("r2_soft_merge")
def r2_soft_merge(spark, sf):
    """Firms as clusters, with a domain for some; names from their order priorities and status: merges never join two domains."""
    a = awards(spark, sf)
    firms = a.groupBy("firm").agg(F.min("award_id").alias("rank"))
    clusters = firms.select(F.col("firm").alias("cluster"), F.when(F.col("firm") % 4 == 0, F.concat(F.lit("d"), F.col("firm").cast("string"))).alias("domain"))
    names = firms.select(F.col("firm").alias("cluster"), F.explode(F.array(F.concat(F.lit("n"), F.floor(F.col("firm") / 3).cast("string")), F.concat(F.lit("m"), F.floor((F.col("firm") + 1) / 5).cast("string")))).alias("name"))
    ranked = names.join(names.groupBy("name").agg(F.min("cluster").alias("rank")), "name").select("cluster", "name", F.concat_ws(":", F.lpad(F.col("rank").cast("string"), 12, "0"), "name").alias("rank"))
    return resolve.merge_soft(clusters, ranked)


@query("j11_reviews", "WITH e AS (SELECT 'p' || p_partkey AS slug FROM part WHERE p_partkey % 3 <> 0), r AS (SELECT 'p' || p_partkey AS slug FROM part WHERE p_partkey % 5 = 0), a AS (SELECT 'p' || (p_partkey + 1) AS slug, 'p' || p_partkey AS alias FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT 'p' || (p_partkey + 2), 'p' || p_partkey FROM part WHERE p_partkey % 6 = 0), own AS (SELECT slug, slug AS key FROM r WHERE slug IN (SELECT slug FROM e)), c AS (SELECT a.slug, r.slug AS key FROM r JOIN a ON a.alias = r.slug WHERE NOT r.slug IN (SELECT slug FROM e)), s AS (SELECT * FROM c WHERE key IN (SELECT key FROM c GROUP BY 1 HAVING count(*) = 1) AND NOT slug IN (SELECT slug FROM own)) SELECT slug, key FROM own UNION ALL SELECT slug, min(key) FROM s GROUP BY 1")
def j11_reviews(spark, sf):
    k = table(spark, sf, "part").select(F.col("p_partkey").alias("k"))
    slug = lambda n: F.concat(F.lit("p"), n.cast("string"))
    e = k.filter("k % 3 <> 0").select(slug(F.col("k")).alias("slug"))
    r = k.filter("k % 5 = 0").select(slug(F.col("k")).alias("slug"))
    a = k.filter("k % 3 = 0").select(slug(F.col("k") + 1).alias("slug"), slug(F.col("k")).alias("alias")).unionByName(k.filter("k % 6 = 0").select(slug(F.col("k") + 2).alias("slug"), slug(F.col("k")).alias("alias")))
    return resolve.carry_reviews(r, e, a)


@query("r10_settled_domain", f"{AW} SELECT firm, last(priority ORDER BY day, award_id) FILTER (WHERE status <> 'P') AS settled FROM awards GROUP BY 1")
def r10_settled_domain(spark, sf):
    newest = top_per(awards(spark, sf).filter("status <> 'P'"), ["firm"], [F.desc("day"), F.desc("award_id")]).select("firm", F.col("priority").alias("settled"))
    return awards(spark, sf).select("firm").distinct().join(newest, "firm", "left")
