"""Matches between sources, hosts, pages and wording."""

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import exprs as X
from ..functions import hosts, wording
from ..operators import evidence, matching
from ..operators.ranking import top_per
from ..sources.views import awards, n_rows, signals, table
from .sqltext import AW, SIG


@query("j2_key_match", "WITH a AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'k' || (c_custkey // 3) END AS strong, 'n' || (c_custkey % 50) AS weak FROM customer), b AS (SELECT s_suppkey, 'k' || s_suppkey AS k FROM supplier UNION SELECT s_suppkey, 'n' || s_suppkey AS k FROM supplier), o AS (SELECT k, min(s_suppkey) AS s_suppkey FROM b GROUP BY 1 HAVING count(*) = 1) SELECT c_custkey, coalesce(x.s_suppkey, y.s_suppkey) AS s_suppkey, coalesce(x.k, y.k) AS key FROM a LEFT JOIN o x ON x.k = strong LEFT JOIN o y ON y.k = weak WHERE coalesce(x.k, y.k) IS NOT NULL")
def j2_key_match(spark, sf):
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    k = F.col("c_custkey")
    strong = F.when(k % 3 == 0, F.concat(F.lit("k"), F.floor(k / 3).cast("string")))
    keys = F.filter(F.array(strong, F.concat(F.lit("n"), (k % 50).cast("string"))), lambda x: x.isNotNull())
    own = F.array(*[F.concat(F.lit(p), F.col("s_suppkey").cast("string")) for p in "kn"])
    return matching.first_key_match(c, "c_custkey", keys, s, "s_suppkey", own)


@query("j9_verified_sites", r"WITH p AS (SELECT page_id % 40 AS entity, regexp_replace(regexp_extract(url, '://([^/?#]*)', 1), '^www\.', '') AS site, 0.4 + CASE WHEN page_id % 3 = 0 THEN 0.2 ELSE 0 END + CASE WHEN page_id % 4 >= 2 THEN 0.1 ELSE 0 END + CASE WHEN page_id % 5 = 0 THEN 0.1 ELSE 0 END + CASE page_id % 7 WHEN 2 THEN 0.2 WHEN 1 THEN 0.1 ELSE 0 END + least((page_id % 6) * 0.05, 0.2) AS score FROM pages), b AS (SELECT entity, site, max(round(score, 4)) AS score FROM p WHERE round(score, 4) >= 0.75 GROUP BY ALL) SELECT entity, site, score FROM b WHERE entity IN (SELECT entity FROM b GROUP BY 1 HAVING count(*) = 1)")
def j9_verified_sites(spark, sf):
    k = F.col("page_id")
    p = table(spark, sf, "pages").select(k, (k % 40).alias("entity"), X.host_of(F.col("url")).alias("site"))
    s = matching.site_score(k % 3 == 0, k % 4, k % 5 == 0, k % 7, F.lit(False), k % 6)
    return matching.accepted(p, "entity", "site", s, F.lit(0.75))


@query("j15_loose_makers", "WITH a AS (SELECT DISTINCT p_name AS x, regexp_replace(p_name, ' (ring|bolt)$', '') AS xl FROM part), b AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS y FROM part) SELECT DISTINCT x, y FROM a, b WHERE x = y OR xl = y")
def j15_loose_makers(spark, sf):
    a = table(spark, sf, "part").select(F.col("p_name").alias("x"), F.regexp_replace("p_name", " (ring|bolt)$", "").alias("xl"))
    b = table(spark, sf, "part").select(F.substring_index("p_name", " ", 1).alias("y")).withColumn("yl", F.col("y"))
    return matching.loose_links(a, "x", "xl", b, "y", "yl")


@query("j17_dockets", "SELECT docket, count(*) AS n FROM (SELECT unnest(list_distinct(list(l_suppkey))) AS docket, l_orderkey FROM lineitem GROUP BY l_orderkey HAVING len(list_distinct(list(l_suppkey))) <= 3) GROUP BY 1")
def j17_dockets(spark, sf):
    d = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("dockets")).withColumn("parties", F.array(F.lit(1)))
    return matching.attributed(d, "dockets", "parties", F.lit(False), "parties").groupBy("docket").agg(n_rows().alias("n"))


@query("j18_brief_team", "WITH p AS (SELECT conv_id, role, max(CASE WHEN turn % 3 = 0 THEN text END) AS bio, true AS present FROM conversations WHERE role <> 'system' GROUP BY ALL), b AS (SELECT conv_id, role, max(text) AS bio FROM conversations WHERE turn % 2 = 1 OR role = 'system' GROUP BY ALL) SELECT conv_id, role, coalesce(p.bio, b.bio) AS bio, p.present IS NULL AS added FROM p FULL JOIN b USING (conv_id, role)")
def j18_brief_team(spark, sf):
    c = table(spark, sf, "conversations")
    p = c.filter("role <> 'system'").groupBy("conv_id", "role").agg(F.max(F.when(F.col("turn") % 3 == 0, F.col("text"))).alias("bio")).withColumn("name", F.col("role"))
    b = c.filter("turn % 2 = 1 OR role = 'system'").groupBy("conv_id", "role").agg(F.max("text").alias("bio")).withColumn("name", F.col("role"))
    return matching.merged_team(p, b, "conv_id", "role", "name", "bio").drop("name")


_POSTS = """SELECT conv_id, turn, role, lower(w[1]) AS name, lower(array_to_string(w[2:3], ' ')) AS opening, nullif(regexp_extract(text, 'https?://([A-Za-z0-9.-]+)', 1), '') AS site FROM (SELECT *, regexp_extract_all(text, '[A-Za-z]+') AS w FROM conversations)"""


@query("j25_same_posts", f"""WITH a AS ({_POSTS}), m AS (SELECT x.site = y.site AS site, x.name = y.name AS name, x.opening = y.opening AS opening, x.role = y.role AS author FROM a x JOIN a y ON x.conv_id = y.conv_id AND y.turn IN (x.turn + 1, x.turn + 2))
SELECT CASE WHEN site THEN 'same' WHEN NOT site THEN 'none' WHEN name AND (coalesce(opening, false) OR coalesce(author, false)) THEN 'same' WHEN coalesce(name, false) OR (opening AND author) THEN 'doubt' ELSE 'none' END AS verdict, count(*) AS n FROM m GROUP BY 1""")
def j25_same_posts(spark, sf):
    """Turns as posts: the first word is the name in their header, the next two open them, the role is the author, a link's host the site. Each meets the next two of its conversation."""
    w = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
    a = table(spark, sf, "conversations").withColumn("w", w).select("conv_id", "turn", "role", F.lower(F.get("w", 0)).alias("name"), F.lower(F.array_join(F.slice("w", 2, 2), " ")).alias("opening"), F.nullif(F.regexp_extract("text", "https?://([A-Za-z0-9.-]+)", 1), F.lit("")).alias("site"))
    b = a.select("conv_id", F.explode(F.array(F.col("turn") - 1, F.col("turn") - 2)).alias("turn"), *[F.col(c).alias(f"other_{c}") for c in ("role", "name", "opening", "site")])
    same = lambda c: F.col(c) == F.col(f"other_{c}")
    verdict = matching.same_post(same("site"), same("name"), same("opening"), same("role"))
    return a.join(b, ["conv_id", "turn"]).groupBy(verdict.alias("verdict")).agg(n_rows().alias("n"))


@query("r6_name_variants", f"{AW}, n AS (SELECT firm % 100 AS docket, string_split(p, ' ')[1] AS f, p AS name, count(*) AS n FROM (SELECT firm, priority || ' x' || (award_id % 3) AS p FROM awards) GROUP BY ALL), h AS (SELECT docket, f, sum(n) AS uses, row_number() OVER (PARTITION BY docket ORDER BY sum(n) DESC, f) AS x FROM n GROUP BY docket, f), o AS (SELECT n.*, CAST(h.uses AS BIGINT) AS uses, max(n.n) OVER (PARTITION BY n.docket) AS top FROM n JOIN h ON n.docket = h.docket AND n.f = h.f AND x = 1), r AS (SELECT *, row_number() OVER (PARTITION BY docket ORDER BY CASE WHEN name LIKE '%x1' AND n >= greatest(2, top * 0.2) THEN 1 ELSE 0 END DESC, n DESC, name) AS y FROM o) SELECT docket, name, uses FROM r WHERE y = 1")
def r6_name_variants(spark, sf):
    n = awards(spark, sf).groupBy((F.col("firm") % 100).alias("docket"), F.concat("priority", F.lit(" x"), (F.col("award_id") % 3).cast("string")).alias("name")).agg(n_rows().alias("n"))
    return matching.variant_clusters(n, "docket", "name", "n", F.col("name").endswith("x1"))


@query("r8_firmer_person", "SELECT conv_id % 50 AS entity, arg_min(role, (CASE WHEN role = 'user' THEN -1.35 ELSE -1 END, role)) AS role, min(turn) AS first_turn FROM conversations GROUP BY 1")
def r8_firmer_person(spark, sf):
    c = table(spark, sf, "conversations").select((F.col("conv_id") % 50).alias("entity"), "role", "turn")
    f = matching.firmer(c, ["entity"], F.when(F.col("role") == "user", 1.35).otherwise(1.0), ["role"], [])
    return f.join(c.groupBy("entity").agg(F.min("turn").alias("first_turn")), "entity")


@query("k7_newest_batches", f"{AW} SELECT CAST(year(day) * 100 + quarter(day) - 1 AS INTEGER) AS batch, count(*) AS members FROM awards GROUP BY 1 HAVING count(*) >= 10 ORDER BY 1 DESC LIMIT 4")
def k7_newest_batches(spark, sf):
    b = awards(spark, sf).groupBy((F.year("day") * 100 + F.quarter("day") - 1).alias("batch")).agg(n_rows().alias("members"))
    return matching.newest_batches(b, "batch", F.lit(False), "members", 4)


@query("k2_multi_sort", f"{SIG} SELECT entity_id, round(max(value), 2) AS top, min(subject) AS low FROM signals GROUP BY 1 ORDER BY round(max(value), 2) DESC, min(subject) NULLS FIRST, entity_id LIMIT 40")
def k2_multi_sort(spark, sf):
    s = signals(spark, sf).groupBy("entity_id").agg(F.round(F.max("value"), 2).alias("top"), F.min("subject").alias("low"))
    return s.orderBy(F.desc("top"), F.asc_nulls_first("low"), "entity_id").limit(40)


@query("s6_display_name", "SELECT array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || x[2:]), ' ') AS shown, count(*) AS n FROM part GROUP BY 1")
def s6_display_name(spark, sf):
    return table(spark, sf, "part").groupBy(wording.display_name(F.upper(F.concat("p_name", F.lit(", INC.")))).alias("shown")).agg(n_rows().alias("n"))


@query("s27_first_sentence", r"SELECT doc_id, CASE WHEN regexp_extract(t, '^(.*?[.!?])(\s|$)', 1) = '' THEN t ELSE regexp_extract(t, '^(.*?[.!?])(\s|$)', 1) END AS sentence FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)")
def s27_first_sentence(spark, sf):
    return table(spark, sf, "documents").select("doc_id", wording.first_sentence(F.col("text")).alias("sentence"))


@query("s28_page_facts")
def s28_page_facts(spark, sf):
    return wording.read_pages(table(spark, sf, "pages"), "page_id", "html")


@query("s22_dns", "SELECT c_nationkey, CASE c_nationkey % 3 WHEN 0 THEN 'google' WHEN 1 THEN 'microsoft' ELSE 'other' END AS provider, c_nationkey % 4 = 1 AS gov, count(*) AS n FROM customer GROUP BY ALL")
def s22_dns(spark, sf):
    k = F.col("c_nationkey")
    mx = F.array(X.ladder((k % 3 == 0, F.lit("aspmx.l.google.com")), (k % 3 == 1, F.lit("x.mail.protection.outlook.com")), otherwise=F.lit("mx.own.io")))
    txt = F.array(F.when(k % 4 == 1, "v=spf1 include:spf.protection.office365.us -all").otherwise("v=spf1 include:sendgrid.net ~all"))
    ns = F.array(F.lit("ns1.dns.io"))
    return table(spark, sf, "customer").groupBy("c_nationkey", hosts.mail_provider(mx).alias("provider"), hosts.on_gov_cloud(mx, ns, txt).alias("gov")).agg(n_rows().alias("n"))


@query("s25_mail_domain", "SELECT CASE WHEN s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 3 = 1 THEN 'supplier' || s_suppkey || '.io' END AS domain, count(*) AS n FROM supplier GROUP BY 1")
def s25_mail_domain(spark, sf):
    k = F.col("s_suppkey")
    mail = X.ladder((k % 3 == 0, F.lit("a@gmail.com")), (k % 3 == 1, F.concat(F.lit("Bo.B@Supplier"), k.cast("string"), F.lit(".io"))), otherwise=F.lit("x@elsewhere.org"))
    return table(spark, sf, "supplier").groupBy(hosts.company_mail_domain(mail, F.regexp_replace("s_name", "#", " ")).alias("domain")).agg(n_rows().alias("n"))


@query("s30_search_keys", r"SELECT key, count(*) AS n FROM (SELECT unnest(['domain:' || regexp_replace(regexp_extract(lower(url), '://([^/?#]*)', 1), '^www\.', ''), CASE WHEN page_id % 5 = 0 THEN 'github:u' || page_id END]) AS key FROM pages) WHERE key IS NOT NULL GROUP BY 1")
def s30_search_keys(spark, sf):
    login = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("U"), F.col("page_id").cast("string")))
    keys = hosts.search_keys(F.col("url"), login, F.lit("One"))
    return table(spark, sf, "pages").select(F.explode(keys).alias("key")).groupBy("key").agg(n_rows().alias("n"))


@query("s23_shown_labels", r"SELECT label, count(*) AS n FROM (SELECT string_split(regexp_extract(url, '://([^/?#]*)', 1), '.')[1] AS label FROM pages) WHERE label IN ('blog', 'm', 'www') GROUP BY 1")
def s23_shown_labels(spark, sf):
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    domain = F.regexp_extract(host, r"^(?:blog|m|www)\.(.*)$", 1)
    p = table(spark, sf, "pages").select(host.alias("h"), F.when(domain == "", host).otherwise(domain).alias("d"))
    return p.select(hosts.shown_label(F.col("h"), F.col("d"), ["blog", "m", "www"]).alias("label")).filter("label IS NOT NULL").groupBy("label").agg(n_rows().alias("n"))


@query("s33_name_kind", "SELECT CASE WHEN c_custkey % 3 = 0 THEN 'company' WHEN c_custkey % 3 = 1 THEN 'person' ELSE 'service' END AS kind, count(*) AS n FROM customer GROUP BY 1")
def s33_name_kind(spark, sf):
    k = F.col("c_custkey") % 3
    name = X.ladder((k == 0, F.concat("c_name", F.lit(" LLC"))), (k == 1, F.lit("Ann B. Lee")), otherwise=F.concat("c_name", F.lit(" Roofing")))
    return table(spark, sf, "customer").groupBy(wording.name_kind(name).alias("kind")).agg(n_rows().alias("n"))


@query("s33_name_cues", "SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS cue, c_custkey % 6 = 2 AS service, c_custkey % 6 IN (3, 4) AS individual FROM customer")
def s33_name_cues(spark, sf):
    """Customers' names made into six kinds: of aviation, of technology, of a business for hire, a person's own, a login, and a company's without a cue."""
    k, nth = F.col("c_custkey") % 6, F.regexp_extract("c_name", "([0-9]+)$", 1)
    name = X.ladder((k == 0, F.concat(F.lit("Skydrone "), nth)), (k == 1, F.concat(nth, F.lit(" Dynamics"))), (k == 2, F.concat(F.lit("Acme Services "), nth)), (k == 3, F.lit("J. Burke Jr.")), (k == 4, F.lit("pburke")), otherwise=F.concat(F.lit("Acme "), nth, F.lit(" Holdings")))
    return table(spark, sf, "customer").select("c_custkey", wording.name_cue(name).alias("cue"), wording.is_service(name).alias("service"), wording.looks_individual(name, F.lit("Peter Burke")).alias("individual"))


@query("d10_maker_evidence", r"SELECT role, count(*) FILTER (WHERE regexp_matches(lower(text), '(^|[^a-z])(i|we|my|our) ')) AS n, role IN ('user') AS own FROM conversations GROUP BY ALL")
def d10_maker_evidence(spark, sf):
    """Texts in the first person by role, and which role is the account "The User"."""
    own = evidence.same_handle(F.col("role"), F.lit("The User"))
    return table(spark, sf, "conversations").groupBy("role", own.alias("own")).agg(F.count(F.when(evidence.speaks_as_maker(F.col("text")), 1)).alias("n"))


@query("t9_sessions", f"{SIG}, g AS (SELECT entity_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY entity_id ORDER BY ts) >= INTERVAL 3 DAY OR lag(ts) OVER (PARTITION BY entity_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS start FROM signals), s AS (SELECT *, sum(start) OVER (PARTITION BY entity_id ORDER BY ts) AS k FROM g) SELECT entity_id, CAST(CAST(min(ts) AS DATE) AS VARCHAR) AS first_day, count(*) AS n FROM s GROUP BY entity_id, k")
def t9_sessions(spark, sf):
    s = signals(spark, sf).groupBy("entity_id", F.session_window(F.col("ts").cast("timestamp"), "3 days").alias("w")).agg(n_rows().alias("n"), F.min("ts").alias("first"))
    return s.select("entity_id", F.to_date("first").cast("string").alias("first_day"), "n")


@query("t12_peak_dated", f"{SIG}, d AS (SELECT entity_id, occurred_at AS d, count(*) AS n FROM signals GROUP BY ALL) SELECT entity_id, CAST(least(greatest(arg_max(d, (n, -date_diff('day', DATE '1970-01-01', d))), DATE '2024-01-05'), DATE '2024-01-25') AS VARCHAR) AS dated FROM d GROUP BY 1")
def t12_peak_dated(spark, sf):
    d = signals(spark, sf).groupBy("entity_id", F.col("occurred_at").alias("d")).agg(n_rows().alias("n"))
    dated = evidence.peak_day(d, ["entity_id"], "d", "n", F.to_date(F.lit("2024-01-05")), F.to_date(F.lit("2024-01-25")))
    return dated.select("entity_id", F.col("dated").cast("string").alias("dated"))


@query("j8_identity_ladder", f"{AW}, a AS (SELECT firm, priority, count(*) AS n, max(status) AS status FROM awards GROUP BY ALL) SELECT firm, priority, CASE WHEN n % 7 = 0 THEN 'website' WHEN status = 'P' THEN 'registry' ELSE 'name' END AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY firm ORDER BY CASE WHEN n % 7 = 0 THEN 0 WHEN status = 'P' THEN 1 ELSE 2 END, priority) AS x FROM a WHERE n % 5 <> 0) WHERE x = 1")
def j8_identity_ladder(spark, sf):
    """Candidates by the strongest evidence that holds; a clash on the strongest rule (here n divisible by 5) rules one out."""
    a = awards(spark, sf).groupBy("firm", "priority").agg(n_rows().alias("n"), F.max("status").alias("status"))
    return evidence.identity(a, "firm", "priority", {"website": F.col("n") % 7 == 0, "registry": F.col("status") == "P", "name": F.lit(True)}, F.col("n") % 5 == 0)


@query("j13_trusted_profiles", f"{AW}, p AS (SELECT firm AS person, count(*) AS papers, list(DISTINCT priority) AS own FROM awards GROUP BY 1), h AS (SELECT firm AS person, list(DISTINCT priority) AS homes, max(award_id) AS orcid FROM awards WHERE status = 'P' GROUP BY 1) SELECT p.person, coalesce(p.person % 7 > 0 AND (orcid % 3 = 0 OR len(list_intersect(own, homes)) > 0), false) AS trusted FROM p LEFT JOIN h USING (person)")
def j13_trusted_profiles(spark, sf):
    """Firms as people: their priorities as affiliations, those of pending awards as a profile's homes."""
    a = awards(spark, sf)
    people = a.groupBy(F.col("firm").alias("person")).agg(F.collect_set("priority").alias("own"))
    profiles = a.filter("status = 'P'").groupBy(F.col("firm").alias("person")).agg(F.collect_set("priority").alias("homes"), F.max("award_id").alias("orcid"))
    t = matching.trusted_profiles(people, profiles, "person", F.col("person") % 7 > 0, F.col("orcid") % 3 == 0, "own", "homes")
    return t.select("person", "trusted")


@query("t6_holding_table", f"{AW} SELECT CASE WHEN day <= DATE '2000-01-01' THEN 'now' WHEN day <= DATE '2001-01-01' THEN 'released' ELSE 'held' END AS state, count(*) AS n FROM awards GROUP BY 1")
def t6_holding_table(spark, sf):
    """Rows that lie ahead wait in a holding table, from which a later run takes those whose day has come."""
    now, held = evidence.deferred(awards(spark, sf), "day", F.to_date(F.lit("2000-01-01")))
    come, stay = evidence.released(held, "day", F.to_date(F.lit("2001-01-01")))
    state = lambda df, name: df.select(F.lit(name).alias("state"))
    return state(now, "now").unionByName(state(come, "released")).unionByName(state(stay, "held")).groupBy("state").agg(n_rows().alias("n"))


@query("s34_hints", r"SELECT page_id, coalesce(nullif(trim(regexp_extract(title, '^(.{1,60}?)\s*(?:[:\x{2013}\x{2014}]|\s-\s|\(|$)', 1)), ''), '') AS name, CASE WHEN regexp_matches(host, '\.(edu|gov|mil)$') THEN NULL ELSE host END AS domain FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)', 1) AS title, regexp_replace(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '^www\.', '') AS host FROM pages)")
def s34_hints(spark, sf):
    """Pages read as posts: the name and the site that title and address give."""
    p = table(spark, sf, "pages").select("page_id", evidence.post_hint(F.regexp_extract("html", "<title>([^<]*)", 1), F.col("url")).alias("h"))
    return p.select("page_id", "h.name", "h.domain")
