"""Operators on small tables of our own: the cases that matter for a merge, a score or a gate."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyfold.functions import exprs as X
from tallyfold.functions import fixed
from tallyfold.operators import history, quality, ranking, resolve, store, text
from tallyfold.plans import score


def values(spark, column, *inputs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r.y for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_domains(spark):
    got = values(spark, X.clean_domain, "https://user@www.Acme.io:80/x?y", "acme.io", "github.com/a", "docs.google.com", "mit.edu", "", None, "no dots", "http://foo.github.io")
    assert got == ["acme.io", "acme.io", None, None, None, None, None, None, None]


def test_names(spark):
    assert values(spark, X.strip_legal, "Salem Robotics, Inc.", "Foo LLC Ltd.", "Bar (d/b/a Baz) Corp", "Inc", "Nord AB", "Cab") == ["Salem Robotics", "Foo", "Bar", "Inc", "Nord", "Cab"]
    assert values(spark, X.normalize_name, "SALEM ROBOTICS INC", "Salem Robotics, Inc.", "O’Neil's (old) Shop") == ["salem robotics", "salem robotics", "oneils shop"]
    assert values(spark, X.loose_name, "Anduril Industries", "Robotics") == ["anduril", "robotics"]
    assert values(spark, X.person_key, "Lee, Ann", "Ann Lee") == ["ann lee", "ann lee"]
    assert values(spark, X.slugify, " Acme & Co. ", "--x--") == ["acme-co", "x"]
    pairs = spark.createDataFrame([("A. Herrmann", "Albrecht Herrmann"), ("A. Herrmann", "Bert Herrmann"), ("A. Meier", "Albrecht Herrmann")], "a string, b string")
    assert [r.y for r in pairs.select(X.initials_match(F.col("a"), F.col("b")).alias("y")).collect()] == [True, False, False]


def test_urls(spark):
    a, b = values(spark, X.url_key, "https://www.Acme.io/a/?utm_source=x&b=2&a=1#top", "http://acme.io/a?a=1&b=2")
    assert a == b == "acme.io/a?a=1&b=2"


def test_dates(spark):
    day = dt.date(2026, 3, 4)
    assert values(spark, X.parse_date, "2026-03-04", "03/04/2026", "20260304", "March 4, 2026", "Mar 4, 2026", "2026-03-04T10:00:00Z", "soon", "", None) == [day] * 6 + [None] * 3
    assert values(spark, X.season_key, "Summer 2026", "Winter 2025", "x") == [202602, 202500, None]


def test_numbers(spark):
    assert values(spark, lambda x: X.squash(x, 10), 10.0, 0.0, -5.0, None, kind="double") == [0.5, 0.0, 0.0, 0.0]
    assert values(spark, lambda x: X.interp(x, [(0, 0), (10, 1)]), -1.0, 5.0, 20.0, None, kind="double") == [0.0, 0.5, 1.0, None]
    assert values(spark, X.compact, 12.0, 1234.0, 5.6e6, 2e9, kind="double") == ["12", "1.2K", "5.6M", "2B"]


def test_decay_and_embargo(spark):
    s = spark.createDataFrame([("capital", "2024-01-01", None), ("capital", "2024-02-15", "2024-03-01"), ("capital", "2024-02-16", None), ("social", "2024-02-01", None)], "family string, d string, p string")
    at = lambda day: score.strength_asof(F.lit(1.0), F.col("family"), F.to_date("d"), F.to_date(F.lit(day)), F.to_date("p"))
    got = [r.y for r in s.select(at("2024-02-15").alias("y")).collect()]
    assert got == pytest.approx([0.5, 0.0, 1.0, 0.5])  # one half-life, not public yet, a day ahead, one short half-life


def momentum_of(spark, **families):
    df = spark.createDataFrame([tuple(float(families.get(f, 0)) for f in fixed.FAMILIES)], ", ".join(f"{f} double" for f in fixed.FAMILIES))
    cols = {f: F.col(f) for f in fixed.FAMILIES}
    m, n = score.momentum(cols), score.convergence(list(cols.values()))
    one = F.lit(1.0)
    return df.select(m.alias("m"), n.alias("n"), score.edge(m, one, one, one, n).alias("edge")).first()


def test_three_families_beat_one_loud_one(spark):
    loud, several = momentum_of(spark, capital=1.0), momentum_of(spark, capital=0.5, github=0.5, hiring=0.5)
    assert several.edge > loud.edge and loud.m <= fixed.FAMILY_CAP and (loud.n, several.n) == (1, 3)
    more = momentum_of(spark, capital=0.5, github=0.5, hiring=0.5, social=0.4)
    assert more.m >= several.m and momentum_of(spark, **{f: 1.0 for f in fixed.FAMILIES}).edge <= 100


def test_consensus(spark):
    df = spark.createDataFrame([(None, 0.0), (None, 3.0), (20_000.0, 0.0)], "stars double, press double")
    got = [r.c for r in df.select(score.consensus(score.consensus_parts({"stars_total": F.col("stars"), "hn_mentions_total": F.col("press")})).alias("c")).collect()]
    assert got[0] == 0.2 and got[1] == 0.0 and got[2] > 0.6  # nothing measured, measured and small, known


def test_upsert_is_idempotent_and_prune_keeps_subjects(spark):
    batch = spark.createDataFrame([("a", 1, 10, 0.5), ("b", 1, 11, 0.2)], "fingerprint string, run_id int, observed_at int, strength double")
    once = store.upsert(batch.limit(0), batch)
    again = store.upsert(once, batch.withColumn("observed_at", F.col("observed_at") + 5).withColumn("run_id", F.lit(2)))
    assert store.upsert_counts(once, batch).first().inserted == 0
    assert sorted((r.fingerprint, r.run_id, r.observed_at) for r in again.collect()) == [("a", 2, 10), ("b", 2, 11)]
    readings = spark.createDataFrame([(1, 7, "x", 1, True), (2, 7, "x", 2, True), (3, 7, "y", 1, True), (4, 7, "x", 1, False)], "id int, entity int, subject string, run_id int, rolling boolean")
    prune = lambda df: store.prune_superseded(df, ["entity", "subject"], F.col("rolling"), [F.desc("run_id"), F.desc("id")])
    assert sorted(r.id for r in prune(readings).collect()) == [2, 3, 4] == sorted(r.id for r in prune(prune(readings)).collect())


def test_fingerprints(spark):
    df = spark.createDataFrame([("u", "2024-01-01", "s", False), ("u", "2024-01-02", "s", False), ("u", "2024-01-01", "s", True), ("v", "2024-01-02", "s", True)], "url string, day string, subject string, rolling boolean")
    fp = store.fingerprint(F.lit("src"), F.lit("k"), F.lit("acme.io"), F.col("url"), F.col("day"), F.col("subject"), F.col("rolling"))
    a, b, c, d = [r.f for r in df.select(fp.alias("f")).collect()]
    assert a != b and c == d and len(a) == 32


def test_hard_links_and_chains(spark):
    rows = spark.createDataFrame([(1, "a.io", None), (2, "a.io", "gh"), (3, None, "gh"), (4, "b.io", None), (5, None, None)] + [(i, f"c{i // 2}", f"d{(i + 1) // 2}") for i in range(10, 40)], "id int, domain string, github string")
    got = {r.id: r.component for r in resolve.hard_links(rows, "id", ["domain", "github"]).collect()}
    assert [got[i] for i in range(1, 6)] == [1, 1, 1, 4, 5] and {got[i] for i in range(10, 40)} == {10}


def test_hard_links_of_rows_with_several_key_sets(spark):
    rows = [(5, "a", None), (3, "a", None), (9, "b", "x"), (3, "b", "x"), (7, None, None), (9, None, None), (2, None, "y"), (4, "c", "y"), (None, "a", "z"), (8, "d", "z"), (8, "d", "z")]
    got = resolve.hard_links(spark.createDataFrame(rows, "id long, domain string, github string"), "id", ["domain", "github"]).collect()
    assert sorted((r.id, r.component) for r in got) == [(2, 2), (3, 3), (4, 2), (5, 3), (7, 7), (8, 8), (9, 3)]


def test_soft_merge_never_joins_two_domains(spark):
    clusters = spark.createDataFrame([("bare", None), ("one", "1.io"), ("two", "2.io"), ("x", None), ("y", None), ("z", "z.io"), ("w", "w.io"), ("v", None)], "cluster string, domain string")
    names = spark.createDataFrame([("bare", "A", 1), ("bare", "B", 2), ("one", "A", 1), ("two", "B", 2), ("x", "C", 3), ("y", "C", 3), ("z", "D", 4), ("w", "D", 4), ("v", "E", 5)], "cluster string, name string, rank int")
    got = {r.cluster: r.component for r in resolve.merge_soft(clusters, names).collect()}
    assert got["bare"] == got["one"] != got["two"]
    assert got["x"] == got["y"] and got["z"] != got["w"] and got["v"] == "v"


def test_golden_record(spark):
    m = spark.createDataFrame([("c", 2, None, "short", 2021, "b"), ("c", 1, None, "a longer one", 2019, "a"), ("c", 3, "late.io", None, None, "a")], "cluster string, o int, domain string, about string, founded int, alias string")
    r = resolve.golden_record(m, "cluster", [F.col("o")], ["domain"], ["about"], ["founded"], ["alias"]).first()
    assert (r.domain, r.about, r.founded, r.alias) == ("late.io", "a longer one", 2019, "a,b")


def test_reviews_follow_renames(spark):
    frame = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    entities = frame([("new",), ("p",), ("q",), ("own",)], "slug string")
    reviews = frame([("old",), ("shared",), ("own",), ("former-own",)], "slug string")
    aliases = frame([("new", "old"), ("p", "shared"), ("q", "shared"), ("own", "former-own")], "slug string, alias string")
    assert {(r.slug, r.key) for r in resolve.carry_reviews(reviews, entities, aliases).collect()} == {("new", "old"), ("own", "own")}


def test_funnel_order_and_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (9, "b"), (None, "c")], "n int, s string")
    rules = [(F.col("n") > 5, "large"), (F.col("s").isNull(), "no s"), (F.col("n") > 0, "positive")]
    assert {r.reason: r.n for r in quality.funnel(df, rules).collect()} == {"large": 1, "no s": 1, "positive": 1, "kept": 1}
    good, bad = quality.split_rejects(df, rules)
    assert good.count() == 1 and bad.count() == 3


def test_global_rank_equals_one_window(spark):
    df = spark.range(500).select("id", ((F.col("id") * 37) % 11).cast("double").alias("s"))
    got = {r.id: r["rank"] for r in ranking.global_rank(df, "s", "id").collect()}
    want = sorted(range(500), key=lambda i: (-(i * 37 % 11), i))
    assert got == {k: i + 1 for i, k in enumerate(want)}


def test_history_helpers(spark):
    d = [dt.date(2024, 1, x) for x in (1, 2, 3, 7, 8, 20)]
    df = spark.createDataFrame([("a", x) for x in [*d, d[0]]], "k string, d date")
    assert {(r.first_day.day, r.n_days) for r in history.islands(df, ["k"], "d").collect()} == {(1, 3), (7, 2), (20, 1)}
    r = history.densest(df, ["k"], "d", 3).first()
    assert (r.densest, r.from_day.day) == (4, 1)
    b = history.first_batch(df, ["k"], "d").first()
    assert (b.n, b.n_first, b.is_birth) == (7, 4, False)
    assert sorted(x.prior for x in history.prior_counts(df, ["k"], "d").collect()) == [0, 0, 2, 3, 4, 5, 6]


def test_classifier(spark):
    words = {"robotics": {"strong": ["robot", "sim-to-real"], "context": ["servo", "battery"]}, "energy": {"strong": ["fusion"], "context": []}}
    texts = ["Two robots and a servo.", "a servo", "sensor fusion only", "Sim to real, fusion", "batteries", None, "robotics-free robot"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: (r.sector, r.fit, r.terms) for r in text.classify(df, "t", words, ["sensor fusion"], ["robot"]).collect()}
    assert got[0] == ("robotics", pytest.approx(0.596), "robot,servo") and got[1][0] == "robotics" and got[1][1] == pytest.approx(0.245)
    assert got[2] == (None, 0.0, "") and got[3][:2] == ("robotics", pytest.approx(0.57)) and got[4][2] == "battery" and got[5][0] is None and got[6][1] == pytest.approx(0.465)


def test_longest_matches_and_phrases(spark):
    df = spark.createDataFrame([(1, "the end of the line"), (2, None)], "id int, t string")
    assert {(r.term, r.start) for r in text.longest_matches(df, "id", "t", ["the", "of the", "end"]).collect()} == {("of the", 8), ("end", 4), ("the", 0)}
    phrases = spark.createDataFrame([("end of",), ("the line!",), ("line the",), ("",)], "p string")
    assert {(r.id, r.p) for r in text.phrase_hits(df, "id", "t", phrases, "p").collect()} == {(1, "end of"), (1, "the line!")}


def test_contributors_and_clock(spark):
    c = spark.createDataFrame([("r", "lead", 100), ("r", "x[bot]", 500), ("r", "b", 12), ("r", "c", 4), ("r", "d", 11)], "repo string, login string, n int")
    assert sorted(r.login for r in quality.real_contributors(c, "repo", "login", "n").collect()) == ["b", "d", "lead"]
    days = spark.createDataFrame([(dt.date(2024, 1, x),) for x in (1, 2, 3, 4)], "d date")
    assert sorted(r.d.day for r in quality.settle_clock(days, "d", F.to_date(F.lit("2024-01-02"))).collect()) == [1, 2, 2]


def test_record_readers(spark):
    from tallyfold.operators import records

    posts = spark.createDataFrame([("Acme | Robotics Engineer | Austin, TX | REMOTE\nWe are a team of 12.",), ("no bars",), ("",), (None,)], "p string")
    got = [r.h for r in posts.select(records.header_fields(F.col("p")).alias("h")).collect()]
    assert got[0][:] == ("Acme", "Robotics Engineer", "Austin, TX", True, 12) and got[1].name == "no bars" and got[2].name is None
    lines = spark.createDataFrame([("Dept. of X, Acme GmbH, Berlin",), ("ETH, Zurich University",), (None,)], "l string")
    got = [r.a for r in lines.select(records.affiliation(F.col("l")).alias("a")).collect()]
    assert got[0][:] == ("Acme GmbH", "Berlin", True) and got[1].is_company is False and got[2].company is None
    maps = spark.createDataFrame([("k", 2, {"a": "late", "b": "x"}), ("k", 1, {"a": "first", "b": None})], "k string, o int, m map<string,string>")
    assert records.merged_maps(maps, ["k"], "m", [F.col("o")]).first().m == {"a": "first", "b": "x"}


def brute_clusters(names, share=0.2):
    """Greedy: names by uses, each to the first founder it is related to."""
    first = lambda x: x.lower().split()[0]

    def related(a, b):
        x, y = a.lower().split(), b.lower().split()
        k = min(len(x), len(y))
        return x[:k] == y[:k] or (first(a) == first(b) and len(first(a)) >= 5)

    founders = []
    for n, (uses, legal) in sorted(names.items(), key=lambda r: (-r[1][0], r[0])):
        own = next((f for f in founders if related(f[0], n)), None)
        if own is None:
            founders.append([n, [(n, uses, legal)]])
        else:
            own[1].append((n, uses, legal))
    _, best = min(founders, key=lambda f: (-sum(u for _, u, _ in f[1]), f[0]))
    top = max(u for _, u, _ in best)
    name = min(best, key=lambda r: (-(r[2] and r[1] >= max(2, top * share)), -r[1], r[0]))[0]
    return name, sum(u for _, u, _ in best)


def test_variant_clusters_are_greedy(spark):
    import random

    from tallyfold.operators import matching

    rng = random.Random(3)
    words = ["US", "Steel", "Nuclear", "Acme", "Orbital", "Works", "Inc"]
    rows, want = [], {}
    for docket in range(40):
        names = {}
        for _ in range(rng.randrange(1, 9)):
            names[" ".join(rng.choice(words) for _ in range(rng.randrange(1, 4)))] = rng.randrange(1, 6)
        rows += [(docket, n, u) for n, u in names.items()]
        want[docket] = brute_clusters({n: (u, n.endswith("Inc")) for n, u in names.items()})
    table = spark.createDataFrame(rows, "docket long, name string, n long")
    got = matching.variant_clusters(table, "docket", "name", "n", F.col("name").endswith("Inc")).collect()
    assert {r.docket: (r.name, r.uses) for r in got} == want
    assert brute_clusters({"US Steel": (3, False), "US Nuclear": (2, False)}) == ("US Steel", 3)


def test_record_groups_against_union_find(spark):
    from tallyfold.operators import resolve

    rows = [(k, k * 7 % 23 if k % 3 else None, k * 5 % 31 if k % 2 else None) for k in range(120)]
    table = spark.createDataFrame(rows, "id long, firm long, slot long")
    label = {k: k for k, _, _ in rows}
    while True:
        least = {}
        for k, *keys in rows:
            for key in enumerate(keys):
                if key[1] is not None:
                    least[key] = min(least.get(key, k), label[k])
        now = {k: min([label[k], *[least[x] for x in enumerate(keys) if x[1] is not None]]) for k, *keys in rows}
        if now == label:
            break
        label = now
    assert {r.id: r.component for r in resolve.hard_links(table, "id", ["firm", "slot"]).collect()} == label


def test_series_strength(spark):
    day = lambda x: dt.date.fromisoformat(x)
    rows = [(1, "github", day("2026-10-01"), 0.9, None, [(day("2026-09-01"), 5.0, 0.2), (day("2026-09-29"), 90.0, 0.9), (day("2026-09-30"), 1.0, None)]),
            (2, "capital", day("2026-06-01"), 0.8, day("2026-08-30"), None), (3, "capital", day("2026-09-01"), 0.8, None, [])]
    table = spark.createDataFrame(rows, "entity_id long, family string, occurred_at date, strength double, public_at date, series array<struct<t: date, v: double, s: double>>")
    at = lambda d: [round(r.x, 4) for r in table.select("entity_id", score.live_strength(table, F.to_date(F.lit(d))).alias("x")).orderBy("entity_id").collect()]
    assert at("2026-09-01") == [0.2, round(0.8 * 0.5 ** (2 / 45), 4), 0.8]
    assert at("2026-08-01") == [0.0, 0.0, 0.0] and at("2026-10-02")[0] == round(0.9 * 0.5 ** (3 / 21), 4)
    assert at("2026-08-30")[1] == 0.8 and at("2026-10-16")[2] == 0.4


def test_awards_count_once_and_factors_join(spark):
    day = dt.date(2026, 9, 1)
    rows = [(1, "capital", day, 0.5, "a"), (1, "capital", day, 0.4, "a"), (1, "capital", day, 0.5, None), (1, "social", day, 0.4, "a"), (2, "capital", day, 0.5, None)]
    table = spark.createDataFrame(rows, "entity_id long, family string, occurred_at date, strength double, award_key string")
    known = score.factors("entity_id", spark.createDataFrame([(1, 0.5)], "entity_id long, fit double"), people=spark.createDataFrame([(1, 1, 0, 0, 0, False)], "entity_id long, tier_one int, other int, h_index int, followers int, repeat boolean"))
    got = {r.entity_id: r for r in score.score_entities(table, "2026-09-01", weeks=2, known=known, defaults={"fit": 0.0, "earliness": 0.8, "team": 0.0}).collect()}
    assert (got[1].capital, got[1].social, got[1].fit, got[1].team) == (0.75, 0.4, 0.5, 0.55) and (got[2].fit, got[2].team, got[2].earliness) == (0.0, 0.0, 0.8)
    m = got[1].momentum
    assert got[1].edge == round(100 * m * (0.25 + 0.75 * 0.5) * (0.4 + 0.6 * 0.8) * (0.85 + 0.15 * 0.55), 2) and got[2].history[0].edge == 0


def test_terms_are_found_as_their_patterns_match(spark):
    import random
    import re

    rng = random.Random(4)
    terms = ["drone", "launch vehicle", "sim-to-real", "power supply", "battery", "ai", "counter-uas radar"]
    parts = ["drone", "drones", "launch", "vehicles", "sim", "to", "real", "power", "supplies", "supply", "battery", "batteries", "ai", "said", "counter", "uas", "radar", "radars", "é", ",", ".", "-", " ", " ", "  ", "\n", "simto", "-real", "counteruas"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(1500)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").withColumn("s", F.lower("x"))
    for r in df.select("x", *[text.said(F.col("s"), t).alias(f"t{k}") for k, t in enumerate(terms)]).collect():
        assert [r[f"t{k}"] for k in range(len(terms))] == [bool(re.search(text.term_pattern(t), r.x)) for t in terms], r.x


def test_phrases_are_found_whichever_way_they_travel(spark):
    texts = spark.createDataFrame([(1, "The quick, brown fox"), (2, "quick brown dogs"), (3, None), (4, ""), (5, "brown quick brown")], "k long, x string")
    phrases = spark.createDataFrame([("Quick brown",), ("fox",), ("own fox",), ("!!",), (None,), ("brown",)], "p string")
    want = {(1, "Quick brown"), (1, "fox"), (2, "Quick brown"), (5, "Quick brown"), (1, "brown"), (2, "brown"), (5, "brown")}
    for sent in (0, 1 << 20):
        assert {tuple(r) for r in text.phrase_hits(texts, "k", "x", phrases, "p", sent).collect()} == want


def test_histories_of_nulls_and_hot_parties(spark):
    rows = [("a", d) for d in (3, 1, 1, 2, None, 5, 5, 5)] + [(None, d) for d in (2, 1, None)] + [("b", 1)]
    table = spark.createDataFrame([(k, None if d is None else dt.date(2024, 1, d)) for k, d in rows], "k string, d date")
    key = lambda r: (r.k or "", r.d is not None, r.d.day if r.d else 0)
    got = sorted(history.prior_counts(table, ["k"], "d").collect(), key=key)
    assert [r.prior for r in got] == [0, 1, 2, 0, 1, 1, 3, 4, 5, 5, 5, 0]
    got = sorted(history.ordinal(table, ["k"], "d").collect(), key=key)
    assert [r.nth for r in got] == [1, 2, 3, 1, 2, 2, 3, 4, 5, 5, 5, 1]


def test_longest_matches_against_trying_all(spark):
    import random
    import re

    rng = random.Random(5)
    terms = ["a", "a b", "b a", "a b c", "b", "c a b", "ab"]
    texts = ["".join(rng.choice("aAbc  .x1") for _ in range(rng.randrange(30))) for _ in range(400)] + [None, ""]
    want = set()
    for k, x in enumerate(texts):
        low, taken = (x or "").lower(), []
        for t in sorted(terms, key=lambda t: (-len(t), t)):
            for i in range(len(low)):
                if re.compile(r"(?<![a-z0-9])" + re.escape(t) + r"(?![a-z0-9])").match(low, i) and all(i + len(t) <= a or i >= b for a, b in taken):
                    taken.append((i, i + len(t)))
                    want.add((k, t, i))
    table = spark.createDataFrame(list(enumerate(texts)), "k long, x string")
    assert {tuple(r) for r in text.longest_matches(table, "k", "x", terms).collect()} == want
    assert text.longest_matches(table, "k", "x", []).count() == 0


def test_where_people_come_from(spark):
    from tallyfold.operators import evidence

    orgs = [("SpaceX", 1, ["Space Exploration"]), ("Figure", 1, []), ("DARPA", 2, []), ("MIT", 2, ["M.I.T."])]
    said = {
        "SpaceX": ["SpaceX"],
        "Previously led avionics at SpaceX and built two companies before that, one of which was acquired in 2021.": ["SpaceX"],
        "Built a six figure content business and won a hackathon with $17M in DARPA sponsorship behind the lab's research programme.": [],
        "MIT ; Space Exploration": ["SpaceX", "MIT"],
        "She grew up in a small town, wrote compilers for a decade and is an ex-Figure founder of a company that builds arms": ["Figure"],
        "A long sentence that goes on and on about many other things and only then names DARPA. At least it is over": [],
        "A long sentence that goes on and on about many other things, by a MIT-trained postdoc, who then built something": [],
        "A long sentence that goes on and on about many other things, by an MIT postdoc, who then built something else": ["MIT"],
        "MITX and xSpaceX": [],
        None: [],
    }
    df = spark.createDataFrame(list(enumerate(said)), "i int, x string")
    got = {r.i: [x.org for x in r.p] for r in df.select("i", evidence.pedigree(F.col("x"), orgs).alias("p")).collect()}
    assert [got[i] for i in range(len(said))] == list(said.values())


def test_handles_hosts_links_and_hints(spark):
    from tallyfold.operators import evidence

    pairs = [("acme-robotics", "AcmeRobotics", True), ("Robotics Acme", "acme robotics", True), ("acme", "acmehq", True), ("abc", "abcd", False), ("", "", False), (None, "x", False), ("bob", "alice", False)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string").orderBy("i")
    assert [r.s for r in df.select(evidence.same_handle(F.col("a"), F.col("b")).alias("s")).collect()] == [x for _, _, x in pairs]
    posts = spark.createDataFrame([(1, "Acme Robotics", "see https://www.acmerobotics.com/x and https://github.com/y, mail jobs@acmerobotics.com or a@gmail.com http://other.io"), (2, "Beta", "nothing")], "k int, name string, x string")
    assert {(r.k, r.host, r.n) for r in evidence.host_mentions(posts, "k", "x").collect()} == {(1, "acmerobotics.com", 2), (1, "other.io", 1)}
    assert [tuple(r) for r in evidence.own_host(posts, "k", "name", "x").collect()] == [(1, "acmerobotics.com")]
    titles = [("Show HN: Acme – robots for farms", "https://acme.io/x", ("Acme", "robots for farms", "acme.io", None)), ("Launch HN: Beta (YC S24)", "https://github.com/Beta-Labs/beta", ("Beta", None, None, "beta-labs"))]
    df = spark.createDataFrame([(t, u) for t, u, _ in titles], "t string, u string")
    assert [tuple(r.h) for r in df.select(evidence.post_hint(F.col("t"), F.col("u")).alias("h")).collect()] == [h for *_, h in titles]
    repo = spark.createDataFrame([("Arm", "Acme", "https://arm.dev", "https://acme.io")], "n string, o string, h string, s string")
    assert tuple(repo.select(evidence.repo_hint(*[F.col(c) for c in "nohs"]).alias("h")).first().h) == ("Acme", "acme", "acme.io", "acme/arm")
    links = spark.createDataFrame([({"x": "https://x.com", "site": "https://a.io", "review": "https://rev.io/a", "bad": "ftp://b", "blog": "http://c.io"},)], "m map<string,string>")
    assert links.select(evidence.shown_links(F.col("m"), ["site", "x"], "rev.io").alias("l")).first().l == ["site", "x", "blog"]


def test_backing_and_verified_hits(spark):
    from tallyfold.operators import evidence

    rows = [(0.3, True, 0.0, 0.3), (0.5, False, 0.0, 0.5), (0.28, False, 0.4, 0.3), (0.28, False, 0.1, None), (0.0, False, 0.9, None), (0.4, False, 0.9, 0.4)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, f double, s boolean, o double, w double").orderBy("i")
    assert all(r.g == r.w for r in df.select("w", evidence.backed(F.col("f"), F.col("s"), F.col("o")).alias("g")).collect())
    hits = [("see acme.io/x", "host", "acme.io", 1), ("see notacme.io", "host", "acme.io", 0), ("acme.io.evil.com", "host", "acme.io", 0), ("on acme.io.", "host", "acme.io", 1), ("At Acme Robotics we", "name", "Acme Robotics", 1), ("acme robotics", "name", "Acme Robotics", 0), (None, "host", "acme.io", 0)]
    df = spark.createDataFrame(hits, "x string, kind string, value string, want int")
    assert {(r.x, r.value) for r in evidence.verified(df, "x", "kind", "value").collect()} == {(x, v) for x, _, v, w in hits if w}
