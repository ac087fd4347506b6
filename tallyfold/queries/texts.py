"""Classification and dictionary matching of texts."""

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import evidence
from ..operators import text as X
from ..operators.quality import held_terms
from ..operators.ranking import top_per
from ..sources.views import table

#: A dictionary in the words of the given corpus; the operator takes any.
DICTIONARY = {"alpha": {"strong": ["then", "there", "heat"], "context": ["with", "this"]}, "beta": {"strong": ["worthless", "trash", "eines"], "context": ["from", "that"]}, "gamma": {"strong": ["para", "avec"], "context": ["pour", "mit"]}}
FRIENDS, SURE = ["this was", "to be"], ["heat", "para"]


def classify_ctes(source: str) -> str:
    """CTEs up to `c`, the rows of a source with sector and fit."""
    terms = [(s, t, w) for s, g in DICTIONARY.items() for kind, w in (("strong", X.STRONG), ("context", X.CONTEXT)) for t in g[kind]]
    hits = ", ".join(f"regexp_matches(low, '{X.term_pattern(t)}') AS t{i}" for i, (_, t, _) in enumerate(terms))
    sums = ", ".join(f"({' + '.join(f'CASE WHEN t{i} THEN {w} ELSE 0.0 END' for i, (x, _, w) in enumerate(terms) if x == s)}) AS s_{s}" for s in DICTIONARY)
    count = " + ".join(f"CAST(t{i} AS INTEGER)" for i in range(len(terms)))
    sure = " OR ".join(f"t{i}" for i, (_, t, _) in enumerate(terms) if t in SURE)
    every = ", ".join(f"s_{s}" for s in DICTIONARY)
    pick = " ".join(f"WHEN s_{s} > 0 AND s_{s} = greatest({every}) THEN '{s}'" for s in DICTIONARY)
    fit = f"1 - exp(-(greatest({every}) + {X.OTHERS} * ({' + '.join(f's_{s}' for s in DICTIONARY)} - greatest({every}))) / {X.SCALE})"
    return f"""l AS (SELECT *, regexp_replace(lower(text), 'this was|to be', ' ', 'g') AS low FROM {source}),
h AS (SELECT *, {hits} FROM l), s AS (SELECT *, {sums}, {count} AS n, ({sure}) AS sure FROM h),
c AS (SELECT *, CASE {pick} END AS sector, round(CASE WHEN n = 1 AND NOT sure THEN least({fit}, {X.LONE_CAP}) ELSE {fit} END, 3) AS fit FROM s)"""


def _classify_sql(source: str) -> str:
    return f"WITH {classify_ctes(source)}"


@query("d1_classify", f"{_classify_sql('documents')} SELECT doc_id, sector, fit FROM c")
def d1_classify(spark, sf):
    return X.classify(table(spark, sf, "documents").select("doc_id", "text"), "text", DICTIONARY, FRIENDS, SURE).select("doc_id", "sector", "fit")


@query("d3_company_class", _classify_sql("(SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY 1)") + " SELECT conv_id, sector, fit FROM c")
def d3_company_class(spark, sf):
    return X.classify_groups(table(spark, sf, "conversations"), ["conv_id"], "text", DICTIONARY, FRIENDS, SURE).select("conv_id", "sector", "fit")


@query("b4_thesis_gate", f"{_classify_sql('documents')} SELECT sector, count(*) AS n FROM c WHERE fit >= 0.3 GROUP BY 1")
def b4_thesis_gate(spark, sf):
    c = X.classify(table(spark, sf, "documents").select("doc_id", "text"), "text", DICTIONARY, FRIENDS, SURE)
    return c.filter("fit >= 0.3").groupBy("sector").agg(F.count(F.lit(1)).alias("n"))


@query("d4_longest_matches")
def d4_longest_matches(spark, sf):
    return X.longest_matches(table(spark, sf, "documents"), "doc_id", "text", ["the", "to the", "of the", "worthless", "and the"])


ORGS = [("The", 2, []), ("Than", 1, ["Thth"]), ("Heat", 1, [])]


def _stated_sql(alias: str) -> str:
    e, far = "[^A-Za-z0-9]", "(?:[^.;]{0,39}[^A-Za-z0-9.;])?"
    bare, before, behind = f"(^|{e}){alias}($|{e})", f"{evidence.BEFORE}{far}{alias}($|{e})", f"(^|{e}){alias}(?:{e}[^.;]{{0,5}})?{evidence.BEHIND}"
    return f"(regexp_matches(p, '{bare}') AND (length(p) <= {evidence.SENTENCE} OR regexp_matches(p, '{before}') OR regexp_matches(p, '{behind}')))"


_ORG_HITS = ", ".join(f"coalesce(bool_or({' OR '.join(_stated_sql(x) for x in [org, *others])}), false) AS has_{org}" for org, _, others in ORGS)
_ORG_LIST = " || ".join(f"CASE WHEN has_{org} THEN '{tier}:{org};' ELSE '' END" for org, tier, _ in sorted(ORGS, key=lambda o: (o[1], o[0])))


@query("d5_pedigree", f"WITH parts AS (SELECT conv_id, turn, unnest(string_split(text, ' ; ')) AS raw FROM conversations), h AS (SELECT conv_id, turn, {_ORG_HITS} FROM (SELECT conv_id, turn, trim(regexp_replace(raw, '[ \\t\\n\\r\\f]+', ' ', 'g')) AS p FROM parts) GROUP BY ALL) SELECT conv_id, turn, {_ORG_LIST} AS orgs FROM h WHERE {' OR '.join(f'has_{o}' for o, _, _ in ORGS)}")
def d5_pedigree(spark, sf):
    """Organisations stated in what people say, best tier first."""
    found = evidence.pedigree(F.col("text"), ORGS)
    c = table(spark, sf, "conversations").select("conv_id", "turn", found.alias("found")).filter(F.size("found") > 0)
    return c.select("conv_id", "turn", F.array_join(F.transform("found", lambda x: F.concat(x["tier"].cast("string"), F.lit(":"), x["org"], F.lit(";"))), "").alias("orgs"))


@query("d7_document_kind", "SELECT CASE WHEN regexp_matches(lower(text), '@|password') THEN 'contact' WHEN regexp_matches(lower(text), '[0-9]{4}') THEN 'numbers' WHEN contains(text, '|') THEN 'list' ELSE 'prose' END AS kind, count(*) AS n FROM documents GROUP BY 1")
def d7_document_kind(spark, sf):
    from ..functions.exprs import by_rules

    kind = by_rules(F.col("text"), [("@|password", "contact"), ("[0-9]{4}", "numbers"), (r"\|", "list")], "prose")
    return table(spark, sf, "documents").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("d12_hosts", r"""WITH named AS (SELECT page_id, unnest(list_concat(regexp_extract_all(x, 'https?://([^\s"''<>/?#]+)', 1), regexp_extract_all(x, '[a-z0-9._%+-]+@([a-z0-9-]+(?:\.[a-z0-9-]+)+)', 1))) AS u FROM (SELECT page_id, lower(url || ' ' || html) AS x FROM pages)),
h AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(u, '^.*@', ''), ':.*$', ''), '^www\.', '') AS host FROM named)
SELECT page_id, host, count(*) AS n FROM h WHERE contains(host, '.') AND NOT regexp_matches(host, '\.(edu|gov|mil)$') GROUP BY ALL""")
def d12_hosts(spark, sf):
    """How often a page, with its address, names each host."""
    p = table(spark, sf, "pages").select("page_id", F.concat_ws(" ", "url", "html").alias("x"))
    return evidence.host_mentions(p, "page_id", "x")


@query("d14_modal_label", "SELECT source, lang FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS nth FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang)) WHERE nth = 1")
def d14_modal_label(spark, sf):
    n = table(spark, sf, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    return top_per(n, ["source"], [F.desc("n"), F.col("lang")]).select("source", "lang")


_HEAD = "(SELECT doc_id, string_split(text, chr(10))[1] AS text FROM documents)"
_REST = "(SELECT doc_id, substr(text, length(string_split(text, chr(10))[1]) + 1) AS text FROM documents)"


@query("d13_backing", f"WITH a AS ({_classify_sql(_HEAD)} SELECT * FROM c), b AS ({_classify_sql(_REST)} SELECT * FROM c) SELECT a.doc_id, CASE WHEN a.sure AND a.fit >= 0.3 THEN a.fit WHEN a.fit > 0.465 THEN a.fit WHEN a.fit > 0 AND b.fit >= 0.3 THEN least(greatest(a.fit, 0.3), 0.465) END AS fit FROM a JOIN b USING (doc_id)")
def d13_backing(spark, sf):
    """The fit that a document's first line may claim, backed by the rest of it."""
    d = table(spark, sf, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("head"), F.expr("substring(text, length(substring_index(text, '\n', 1)) + 1)").alias("rest"))
    own = X.classify(d, "head", DICTIONARY, FRIENDS, SURE).withColumnRenamed("fit", "own_fit").withColumnRenamed("terms", "own_terms").drop("sector")
    both = X.classify(own, "rest", DICTIONARY, FRIENDS, SURE)
    sure = F.arrays_overlap(F.split("own_terms", ","), F.array(*[F.lit(x) for x in SURE]))
    return both.select("doc_id", evidence.backed(F.col("own_fit"), sure, F.col("fit")).alias("fit"))


@query("d11_gates", f"WITH a AS ({_classify_sql(_HEAD)} SELECT * FROM c), b AS ({_classify_sql(_REST)} SELECT * FROM c), v AS (SELECT a.doc_id, a.fit, CASE WHEN regexp_matches(a.low, '[0-9]') AND NOT a.sure THEN 'lookalike' WHEN a.fit >= 0.3 AND (a.sure OR a.fit > 0.465) THEN 'own words' WHEN a.fit > 0 AND b.fit >= 0.3 THEN 'backed' WHEN b.fit >= 0.3 THEN 'labels only' ELSE 'nothing' END AS basis FROM a JOIN b USING (doc_id)) SELECT basis, count(*) AS n, round(sum(CASE basis WHEN 'own words' THEN fit WHEN 'backed' THEN least(greatest(fit, 0.3), 0.465) ELSE 0 END), 6) AS fit FROM v GROUP BY 1")
def d11_gates(spark, sf):
    """Documents through a source's gate: their first line as own words, the rest as labels, digits in the first line as lookalikes."""
    d = table(spark, sf, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("head"), F.expr("substring(text, length(substring_index(text, '\n', 1)) + 1)").alias("rest"))
    own = X.classify(d, "head", DICTIONARY, FRIENDS, SURE).withColumnRenamed("fit", "own_fit").withColumnRenamed("terms", "own_terms").drop("sector")
    both = X.classify(own, "rest", DICTIONARY, FRIENDS, SURE)
    sure = F.arrays_overlap(F.split("own_terms", ","), F.array(*[F.lit(x) for x in SURE]))
    v = both.select(evidence.thesis_verdict(F.col("own_fit"), sure, F.col("fit"), F.col("head").rlike("[0-9]")).alias("v"))
    return v.groupBy("v.basis").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v.fit"), 6).alias("fit"))


@query("b10_search", "SELECT doc_id FROM documents WHERE contains(lower(text), 'worthless') OR contains(lower(source), 'src7')")
def b10_search(spark, sf):
    return table(spark, sf, "documents").filter(F.lower("text").contains("worthless") | F.lower("source").contains("src7")).select("doc_id")


@query("b17_verified_hits", r"SELECT value, source, count(*) AS n FROM (SELECT 'example.com' AS value, source FROM documents WHERE regexp_matches(text, '(?i)(^|[^a-z0-9.-])example\.com($|[^a-z0-9.-]|[.]($|[^a-z0-9]))') UNION ALL SELECT 'the heat', source FROM documents WHERE regexp_matches(text, '(^|[^A-Za-z0-9])The[ -]Heat($|[^A-Za-z0-9])') UNION ALL SELECT 'than', source FROM documents WHERE regexp_matches(text, '(^|[^A-Za-z0-9])Than($|[^A-Za-z0-9])')) GROUP BY ALL")
def b17_verified_hits(spark, sf):
    """Texts that a search for three keys found, kept if they bear the key out."""
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v).alias("value")) for k, v in (("host", "example.com"), ("name", "the heat"), ("name", "than"))]))
    hits = table(spark, sf, "documents").select("source", "text", keys.alias("key")).select("source", "text", "key.*")
    return evidence.verified(hits, "text", "kind", "value").groupBy("value", "source").agg(F.count(F.lit(1)).alias("n"))


@query("b19_own_activity", "SELECT conv_id, count(*) FILTER (WHERE role <> 'assistant') AS attention, count(DISTINCT role) FILTER (WHERE role <> 'assistant') AS authors, count(*) FILTER (WHERE role = 'assistant') AS own, count(DISTINCT role) FILTER (WHERE role = 'assistant') AS own_authors FROM conversations GROUP BY 1")
def b19_own_activity(spark, sf):
    """Of each conversation what others said, and what the account whose name is the handle "Assistant" said."""
    own = evidence.same_handle(F.col("role"), F.lit("Assistant"))
    return evidence.split_attention(table(spark, sf, "conversations"), ["conv_id"], "role", own)


@query("b6_terms_held", "SELECT doc_id, array_to_string(list_filter(['idiot', 'trash', 'scum', 'clown'], lambda t: contains(lower(text), t)), ',') AS held FROM documents WHERE regexp_matches(lower(text), 'idiot|trash|scum|clown')")
def b6_terms_held(spark, sf):
    held = held_terms(F.col("text"), ["idiot", "trash", "scum", "clown"])
    return table(spark, sf, "documents").select("doc_id", F.array_join(held, ",").alias("held")).filter("held <> ''")


_PAD = r"' ' || trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g')) || ' '"


@query("j22_phrase_join", f"WITH p AS (SELECT DISTINCT text AS phrase FROM benchmark), n AS (SELECT phrase, {_PAD.format('phrase')} AS words FROM p), d AS (SELECT doc_id, {_PAD.format('text')} AS words FROM documents) SELECT doc_id, phrase FROM d, n WHERE trim(n.words) <> '' AND contains(d.words, n.words)")
def j22_phrase_join(spark, sf):
    """Whole benchmark texts that stand in a document."""
    return X.phrase_hits(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "benchmark").select(F.col("text").alias("phrase")), "phrase")
