"""Readers on small files of our own, the sinks, the job registry and the streams."""

import datetime as dt
import json

from pyspark.sql import functions as F

from tallyfold.sources import jobs, kinds, readers
from tallyfold.streaming import stream


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_award_file(spark, tmp_path):
    header = "Company,Award Title,Agency,Branch,Phase,Program,Contract,Agency Tracking Number,Proposal Award Date,Award Year,Award Amount,UEI,Duns,Number Employees,Company Website,PI Email\n"
    p = put(tmp_path / "a.csv", header + '"Acme, Inc.","A ""fine"" title",DOD,,Phase I,SBIR,C1,T1,03/04/2024,2024,"$1,234.50",U,,12,acme.io,a@acme.io\nB,x,,,,,,,soon,2023,n/a,,,,,\n')
    rows = readers.read_awards(spark, p).collect()
    assert (rows[0].Company, rows[0]["Award Title"], rows[0].amount, rows[0].day) == ("Acme, Inc.", 'A "fine" title', 1234.5, dt.date(2024, 3, 4))
    assert rows[1].amount is None and rows[1].day is None
    assert readers.missing_columns(readers.read_awards(spark, p), ["Company", "Gone"]) == ["Gone"]


def test_rank_list(spark, tmp_path):
    p = put(tmp_path / "r.csv", "".join(f"{i},d{i}.io\n" for i in range(1, 101)))
    ranks = readers.read_rank_list(spark, p)
    assert readers.rank_list_faults(ranks, 100) == []
    assert len(readers.rank_list_faults(ranks.filter("rank > 40"), 100)) == 3


def test_form_index(spark, tmp_path):
    text = "Form Type   Company Name\n-----------\nD           Acme Robotics, Inc.        1234567     20240304    edgar/data/1234567/0001234567-24-000001.txt\nD/A         Beta LLC                   99          2024-03-05  edgar/data/99/0000000099-24-000002.txt\nDEF 14A     Gamma                      98          20240305    edgar/data/98/0000000098-24-000003.txt\n"
    rows = readers.read_form_index(spark, put(tmp_path / "f.idx", text)).collect()
    assert [(r.form, r.company, r.cik, r.accession) for r in rows] == [("D", "Acme Robotics, Inc.", "1234567", "0001234567-24-000001"), ("D/A", "Beta LLC", "99", "0000000099-24-000002")]


def test_xml_and_feeds(spark, tmp_path):
    p = put(tmp_path / "f.xml", "<feed><entry><id>1</id><title>T &amp; U</title><author><name>A</name></author><author><name>B</name></author></entry><entry><id>2</id></entry></feed>")
    rows = readers.read_xml(spark, p, "entry", "id string, title string, author array<struct<name: string>>").orderBy("id").collect()
    assert [x.name for x in rows[0].author] == ["A", "B"] and rows[0].title == "T & U" and rows[1].title is None


def test_json_dumps(spark, tmp_path):
    hits = {"hits": [{"objectID": "1", "author": "a", "created_at_i": 86400, "_tags": ["story"]}, {"objectID": "2", "created_at_i": 0, "_tags": ["comment"]}]}
    rows = readers.read_hits(spark, put(tmp_path / "h.json", json.dumps(hits))).orderBy("objectID").collect()
    assert [r.kind for r in rows] == ["story", "comment"] and rows[0]["at"] == dt.datetime(1970, 1, 2)
    lines = [{"id": "1", "type": "WatchEvent", "actor": {"login": "x"}, "repo": {"name": "a/b"}, "created_at": "2024-01-01T00:00:00Z"}, {"id": "2", "type": "PushEvent"}]
    assert readers.read_archive(spark, put(tmp_path / "e.jsonl", "\n".join(map(json.dumps, lines)))).count() == 1


def test_roles_of_three_layouts(spark, tmp_path):
    g = put(tmp_path / "g.json", json.dumps({"jobs": [{"title": "Engineer", "location": {"name": "NY"}, "first_published": "2024-01-02T00:00:00Z", "departments": [{"name": "HW"}], "absolute_url": "u"}]}))
    v = put(tmp_path / "l.json", json.dumps([{"id": "1", "text": "Welder", "createdAt": 1704153600000, "categories": {"location": "LA", "team": "Shop"}, "hostedUrl": "v"}]))
    a = put(tmp_path / "a.json", json.dumps({"jobs": [{"title": "Buyer", "location": "SF", "publishedAt": "2024-01-02", "department": "Ops", "jobUrl": "w"}]}))
    rows = readers.read_roles(spark, g, v, a).collect()
    assert {(r.title, r.location, r.department) for r in rows} == {("Engineer", "NY", "HW"), ("Welder", "LA", "Shop"), ("Buyer", "SF", "Ops")} and {r.posted for r in rows} == {dt.date(2024, 1, 2)}


def test_briefs_and_sinks(spark, tmp_path):
    (tmp_path / "b").mkdir()
    for slug, summary in (("a", "text"), ("b", " ")):
        put(tmp_path / "b" / f"{slug}.json", json.dumps({"slug": slug, "summary": summary, "sources": [{"title": "t", "url": "u"}]}))
    assert [r.slug for r in readers.read_briefs(spark, str(tmp_path / "b")).collect()] == ["a"]
    df = spark.createDataFrame([('say "hi", twice', ["x", "y"])], "name string, tags array<string>")
    readers.write_csv(df.coalesce(1), str(tmp_path / "csv"), ["tags"])
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("part-*"))
    assert text.splitlines() == ["name,tags", '"say ""hi"", twice",x; y']
    assert json.loads(readers.documents_of(df, "name").first().document)["tags"] == ["x", "y"]
    log = spark.createDataFrame([("s", 1, 5), ("s", 2, 6)], "source string, run_id int, emitted int")
    assert [(r.run_id, r.emitted) for r in readers.carried_forward(log, F.lit(3)).collect()] == [(3, 6)]


def test_a_failing_job_does_not_stop_the_others(spark):
    grants = spark.createDataFrame([("f", dt.date(2024, 1, 1), 10.0, True), ("f", dt.date(2024, 2, 1), 10.0, True), ("g", dt.date(2024, 2, 1), 10.0, False)], "firm string, day date, amount double, complete boolean")
    out, errors = jobs.run(spark, {"grants": grants}, F.to_date(F.lit("2024-03-01")))
    assert {(r.entity, r.strength) for r in out.collect()} == {("f", 0.7), ("f", 0.5), ("g", 0.42)}
    assert "sbir_awards" not in errors and "sec_form_d" in errors


def test_jobs_run_side_by_side(spark, monkeypatch):
    """Two jobs that wait for one another, and one that fails; signals come in the registry's order."""
    import threading

    both = threading.Barrier(2, timeout=30)

    def waits(tables, asof):
        both.wait()
        return tables["rows"]

    monkeypatch.setattr(jobs, "JOBS", {"a": ("f", "discover", waits), "bad": ("f", "discover", lambda tables, asof: tables["none"]), "b": ("f", "discover", waits), "late": ("f", "enrich", waits)})
    rows = spark.createDataFrame([("s", "f", "k", "e", dt.date(2024, 1, 1), 1.0, 0.5)], "source string, family string, kind string, entity string, occurred_at date, value double, strength double")
    out, errors = jobs.run(spark, {"rows": rows}, F.to_date(F.lit("2024-03-01")))
    assert out.count() == 2 and errors == {"bad": "KeyError: 'none'"}


def test_mentions(spark):
    rows = [("new", dt.date(2024, 3, 1), "a", 10), ("rise", dt.date(2024, 1, 10), "a", 1), ("rise", dt.date(2024, 3, 1), "a", 5), ("rise", dt.date(2024, 3, 2), "b", 5), ("flat", dt.date(2024, 1, 10), "a", 1), ("flat", dt.date(2024, 3, 1), "a", 1)]
    m = spark.createDataFrame(rows, "entity string, day date, author string, points int")
    got = {r.entity: r for r in jobs.hn_attention({"mentions": m}, F.to_date(F.lit("2024-03-05"))).collect()}
    assert {k: r.kind for k, r in got.items()} == {"new": "hn_first_mention", "rise": "hn_attention", "flat": "hn_baseline"} and got["flat"].strength == 0


def test_streams_equal_their_batch(spark, tmp_path):
    rows = [("a", dt.datetime(2024, 1, 1, 1), 1), ("a", dt.datetime(2024, 1, 1, 2), 2), ("b", dt.datetime(2024, 1, 2), 3), ("a", dt.datetime(2024, 1, 1, 1), 1)]
    df = spark.createDataFrame(rows, "k string, at timestamp, v int")
    for i in range(2):
        df.filter(F.col("v") % 2 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert {(r.k, r.v) for r in stream.drained(stream.latest_reading(read(), ["k"], "at", ["v"])).collect()} == {("a", 2), ("b", 3)}
    assert stream.drained(stream.ingested_once(read(), "v", "at"), "append").count() == 3
    assert {(r.k, r.n) for r in stream.drained(stream.windowed_counts(read(), "at", ["k"], "1 day")).collect()} == {("a", 3), ("b", 1)}
    keyed = read().select(F.col("k").alias("fingerprint"), F.col("v").alias("run_id"), F.col("at").alias("observed_at"))
    stream.upsert_stream(keyed, str(tmp_path / "store"))
    last = sorted((tmp_path / "store").iterdir())[-1]
    assert {(r.fingerprint, r.run_id) for r in spark.read.parquet(str(last)).collect()} == {("a", 2), ("b", 3)}


def test_dockets_cohorts_and_sites(spark):
    day = lambda m, d=1: dt.date(2024, m, d)
    filed = spark.createDataFrame([(1, "a", day(1), "plan", 1), (1, "a", day(1), "plan", 2), (1, "a", day(2), "letter", 3), (1, "a", day(2), "letter", 3)], "docket int, party string, day date, kind string, package int")
    got = sorted((r.kind, r.strength) for r in jobs.nrc_adams({"papers_filed": filed}, F.to_date(F.lit("2024-03-01"))).collect())
    assert got == [("nrc_preapp_activity", 0.4), ("nrc_preapp_docket_opened", 0.85)]
    posts = spark.createDataFrame([(1, 5, "acme", day(1), 2022), (2, 5, "acme-inc", day(2), None), (3, None, "acme-inc", day(3), 2021), (4, None, "old", day(3), 1990)], "post int, portal_id int, slug string, day date, founded int")
    got = kinds.accelerators({"cohort_posts": posts}, F.to_date(F.lit("2024-03-01"))).collect()
    assert [(r.entity, r.value, r.occurred_at) for r in got] == [("acme-inc", 3.0, day(1))]
    pages = spark.createDataFrame([("e", "Acme Robotics", "https://acmerobotics.com", "Acme Robotics", "Acme Robotics", "Acme Robotics", None, day(1)), ("e", "Acme Robotics", "https://elsewhere.com", "News", None, None, None, day(1)), ("f", "Bolt Works", "https://boltworks.com", "Bolt Works", "Bolt Works", None, None, day(1)), ("f", "Bolt Works", "https://bolt-works.io", "Bolt Works", "Bolt Works", "Bolt Works", "Bolt Works", day(1))], "entity string, name string, url string, title string, site_name string, h1 string, copyright string, day date")
    assert [r.entity for r in jobs.web_presence({"pages_read": pages}, F.to_date(F.lit("2024-03-01"))).collect()] == ["e"]


def test_pages_and_hosts(spark):
    from tallyfold.functions import hosts, wording

    raw = '<html><head><title>Acme &amp; Co</title><meta property="og:site_name" content="Acme"><script>var x = "<p>no</p>"</script></head><body><h1>Hello <b>you</b></h1><p>Text.</p><a href="/x">link</a><p>© 2024 Acme Inc. All rights</p></body></html>'
    df = spark.createDataFrame([(1, raw), (2, None), (3, "<p>open <b>")], "id int, html string")
    a, b, c = wording.read_pages(df, "id", "html").orderBy("id").collect()
    assert (a.title, a.site_name, a.h1, a.copyright, a.links) == ("Acme & Co", "Acme", "Hello you", "Acme Inc", ["/x"]) and "no" not in a.text
    assert b.text == "" and c.text == "open"
    names = spark.createDataFrame([("ACME ROBOTICS OF TEXAS LLC",), ("DRONENX",), ("Mixed Case Inc",), ("US UAV II CORP",)], "n string")
    assert [r.s for r in names.select(wording.display_name(F.col("n")).alias("s")).collect()] == ["Acme Robotics of Texas", "DRONENX", "Mixed Case", "US UAV II"]
    h = spark.createDataFrame([("api.eu.acme.io", "acme.io"), ("secret-project.api.acme.io", "acme.io"), ("x.other.io", "acme.io")], "h string, d string")
    assert [r.s for r in h.select(hosts.shown_label(F.col("h"), F.col("d"), ["api", "eu"]).alias("s")).collect()] == ["api.eu", "api", None]
    m = spark.createDataFrame([("a@acme.io", "Acme Robotics, Inc."), ("a@gmail.com", "Acme"), ("a@else.io", "Acme")], "m string, c string")
    assert [r.s for r in m.select(hosts.company_mail_domain(F.col("m"), F.col("c")).alias("s")).collect()] == ["acme.io", None, None]


def test_registered_sql_names(spark):
    from tallyfold.functions.register import register

    register(spark)
    assert spark.sql("SELECT squash(10D, 10D), over_floor(15D, 5D, 10D), decay(1D, 30, 30D)").first()[:] == (0.5, 0.5, 0.5)
    got = spark.sql("SELECT * FROM explode_series(array(named_struct('t', DATE '2024-01-01', 'v', 1.0D), named_struct('t', DATE '2024-01-10', 'v', 2.0D)), array(DATE '2024-01-05', DATE '2024-01-09', DATE '2023-01-01'))").collect()
    assert [r.v for r in got] == [1.0, 2.0]
    assert spark.sql("SELECT noisy_or(sum(left_of(x))) FROM VALUES (0.5D), (0.5D), (NULL) AS t(x)").first()[0] == 0.75
    assert spark.sql("SELECT noisy_or(sum(left_of(x))) FROM VALUES (0.5D), (1D) AS t(x)").first()[0] == 1.0
    names = ["Acme Robotics, Inc.", "Terra Innovatum s.r.l", "Advanced Float Co., Ltd", "Acme Inc LLC Ltd Corp", "X (d/b/a Y) AG", "O'Neil’s (old) Ltd", "The Boring Company"]
    urls = ["https://www.acme.io/x", "http://foo.github.io", "user@host.com:80/x", "mit.edu", "localhost", "https://Blog.Example.org/?q"]
    from tallyfold.functions import exprs as X

    n, u = spark.createDataFrame([(x,) for x in names], "x string"), spark.createDataFrame([(x,) for x in urls], "x string")
    assert all(a == b for a, b in n.select(X.normalize_name(F.col("x")), F.expr("normalize_name(x)")).collect())
    assert all(a == b for a, b in u.select(X.clean_domain(F.col("x")), F.expr("clean_domain(x)")).collect())


def test_dates_and_legal_forms(spark):
    from tallyfold.functions import exprs as X

    said = ["2026-09-18T12:00:00Z", "09/18/2026", "Jun 18 2026", "June 18 2026", "2026-09-18T12:00:00+02:00", "2026-09-18 12:00:00", "2026-09-18T23:59:59.123456Z", "20260918", "Sep 18, 2026", "9/8/2026", "soon", "2026-13-45", ""]
    got = [str(r.d) for r in spark.createDataFrame([(x,) for x in said], "x string").select(X.parse_date(F.col("x")).alias("d")).collect()]
    assert got == ["2026-09-18", "2026-09-18", "2026-06-18", "2026-06-18", "2026-09-18", "2026-09-18", "2026-09-18", "2026-09-18", "2026-09-18", "2026-09-08", "None", "None", "None"]
    names = {"Acme Inc LLC Ltd Corp": "Acme Inc", "Acme Robotics, Inc.": "Acme Robotics", "X AG Inc": "X", "Inc": "Inc", "Acme ,": "Acme", "Advanced Float Co., Ltd": "Advanced Float", "NV": "NV", "Foo SA AG SE NV": "Foo SA"}
    rows = spark.createDataFrame([(x,) for x in names], "x string").select("x", X.strip_legal(F.col("x")).alias("s")).collect()
    assert {r.x: r.s for r in rows} == names


def test_every_kind_is_in_one_registry():
    for name, (family, stage, job) in jobs.JOBS.items():
        assert family and stage in ("discover", "enrich") and job.__doc__ and "(" in job.__doc__, name
        assert name.split("/")[0] in jobs.JOBS


def test_linked_posts_go_by_their_program(spark):
    day = lambda m: dt.date(2024, m, 1)
    rows = [(1, 5, "a", day(1), 2023, "speedrun", 0.5, 3, True, 2024), (2, 5, "a2", day(2), None, "hax", 0.9, 1, False, None), (3, None, "h", day(3), 2023, "hax", 0.5, 1, False, 2024), (4, None, "late", day(3), None, "hax", 1.0, 1, False, 2021), (5, None, "bare", day(3), None, None, None, None, None, None)]
    posts = spark.createDataFrame(rows, "post int, portal_id int, slug string, day date, founded int, program string, fit double, labels int, hard boolean, cohort_year int")
    got = {r.entity: (r.kind, r.strength, r.value) for r in kinds.accelerators({"cohort_posts": posts}, F.to_date(F.lit("2024-06-01"))).collect()}
    assert got == {"a2": ("speedrun_cohort", 0.45, 2.0), "h": ("hax_company", 0.48, 1.0), "late": ("hax_company", 0.3, 1.0), "bare": ("hax_company", 0.22, 1.0)}


def _ranked(spark, moves, entrants=(), at=(0, 30)):
    """A newest list and one a month older: 1,000 domains that stay, those that move (name, was, now), and entrants (name, now)."""
    newest = dt.date(2024, 6, 1)
    rows = [(newest - dt.timedelta(days=d), f"s{k}", 10_000 + k) for k in range(1000) for d in at]
    rows += [x for n, was, now in moves for x in ((newest, n, now), (newest - dt.timedelta(days=at[1]), n, was))] + [(newest, n, now) for n, now in entrants]
    return spark.createDataFrame(rows, "list_day date, domain string, rank int")


def test_rank_moves_by_rarity(spark):
    got = {r.entity: (r.kind, r.strength) for r in jobs.tranco_rank({"ranks": _ranked(spark, [("up", 10_500, 5_000), ("little", 10_500, 9_900)], [("in", 10_400)])}, F.lit(None)).collect()}
    assert got["up"][0] == "tranco_rank_move" and abs(got["up"][1] - 0.78) < 1e-3 and got["little"] == ("tranco_rank_present", 0.0) and got["s3"] == ("tranco_rank_present", 0.0)
    kind, s = got["in"]
    assert kind == "tranco_new_entrant" and s == round(0.85 * 0.9, 6)
    quarter = {r.entity: (r.kind, r.strength) for r in jobs.tranco_rank({"ranks": _ranked(spark, [("up", 10_500, 5_000)], at=(0, 90))}, F.lit(None)).collect()}
    assert quarter["up"][0] == "tranco_rank_move" and abs(quarter["up"][1] - 0.78 * 0.9) < 1e-3


def test_entrants_by_their_listings(spark):
    newest = dt.date(2024, 6, 1)
    listings = spark.createDataFrame([("young", newest)] + [("steady", newest - dt.timedelta(days=k)) for k in range(10)] + [("gaps", newest - dt.timedelta(days=k)) for k in (0, 9)], "domain string, day date")
    got = {r.entity: r.strength for r in jobs.tranco_rank({"ranks": _ranked(spark, [], [("young", 10_400), ("steady", 10_401), ("gaps", 10_402), ("bare", 10_403)]), "rank_listings": listings}, F.lit(None)).collect()}
    assert (got["steady"], got["young"], got["bare"]) == (0.85, round(0.85 * 0.85, 6), round(0.85 * 0.9, 6)) and got["gaps"] < got["young"]


def test_velocity_by_repository_and_sample(spark):
    asof = dt.date(2024, 6, 30)
    stars = [(o, r, asof - dt.timedelta(days=k % 20)) for o, r, n in (("a", "x", 60), ("a", "y", 90), ("b", "x", 60), ("c", "x", 60), ("c", "y", 5), ("d", "x", 3)) for k in range(n)]
    samples = [("b", "x", 0.4, 0.1, 900.0), ("c", "y", 0.6, 0.1, 900.0)]
    tables = {"stars": spark.createDataFrame(stars, "owner string, repo string, day date"), "star_samples": spark.createDataFrame(samples, "owner string, repo string, young double, blank double, median_age double")}
    got = {r.entity: (r.value, r.strength) for r in jobs.github_velocity(tables, F.lit(asof)).collect()}
    assert set(got) == {"a", "b"} and got["a"][0] == 90.0
    plain = {r.entity: r.strength for r in jobs.github_velocity({"stars": tables["stars"]}, F.lit(asof)).collect()}
    assert set(plain) == {"a", "b", "c"} and abs(got["b"][1] - plain["b"] * 0.6) < 1e-5
    at = spark.createDataFrame([("a", "x", dt.datetime(2024, 6, 30, 5))] * 25, "owner string, repo string, at timestamp")
    (row,) = jobs.github_velocity({"stars": at}, F.lit(asof)).collect()
    assert row.occurred_at == dt.date(2024, 6, 29)  # still the day before by Pacific time
