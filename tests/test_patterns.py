"""Patterns over histories, cohorts and keyed state against plain code."""

import datetime as dt
import math
import random
from collections import Counter, defaultdict
from statistics import mean, pstdev

import pytest
from pyspark.sql import functions as F

from tallyfold.operators import cohorts, patterns
from tallyfold.streaming import keyed, stream

D0 = dt.date(2024, 1, 1)


def day(n):
    return D0 + dt.timedelta(days=n)


# --- cohorts


def _stretch(rows, r, band, nearest):
    below = sum(x * band < r for _, x, _ in rows)
    upto, mid = sum(x <= r * band for _, x, _ in rows), sum(x < r for _, x, _ in rows)
    return (below, upto) if nearest is None else (max(below, mid - nearest // 2), min(upto, mid + nearest // 2))


@pytest.mark.parametrize("nearest", [None, 4000, 16, 6])
@pytest.mark.parametrize("n", [1, 7, 150])
def test_cohorts_against_all_pairs(spark, n, nearest):
    rng = random.Random(n)
    rows = [(k, float(rng.randrange(1, 60)), rng.randrange(2)) for k in range(n)]
    table = spark.createDataFrame([*rows, (-1, None, 1)], "k long, r double, q long")
    share = {r.k: (r.cohort, r.below) for r in cohorts.cohort_share(table, "r", "q", "k", least=1, nearest=nearest).collect()}
    rate = {r.k: (r.cohort, r.new, r.rate) for r in cohorts.entrant_rate(table, "r", "q", "k", least=5, nearest=nearest).collect()}
    assert set(share) == set(rate) == set(range(n))
    ordered = sorted(rows, key=lambda x: (x[1], x[2], x[0]))
    for k, r, q in rows:
        low, high = _stretch(rows, r, 1.5, nearest)
        near = [y for _, _, y in ordered[low:high]]
        assert share[k] == (len(near), sum(y < q for y in near))
        assert rate[k] == (len(near), sum(near), sum(near) / len(near) if len(near) >= 5 else None)


def test_cohort_is_capped_to_the_nearest(spark):
    table = spark.range(10_000).select(F.col("id").alias("k"), (100_000 + F.col("id")).alias("r"), F.lit(1).alias("q"))
    assert cohorts.cohort_share(table, "r", "q", "k").filter("k = 5000").first().cohort == 4000


def test_cohorts_by_pieces_of_the_list(spark, monkeypatch):
    """Small pieces, each asked by several tasks; ranks that many rows have; ratios that are null or no number."""
    monkeypatch.setattr(cohorts, "PIECE", 8)
    monkeypatch.setattr(cohorts, "ASKED", 5)
    rng = random.Random(2)
    rows = [(k, float(rng.choice([3, 4, rng.randrange(1, 60)])), rng.choice([None, float("nan"), 0.5, 1.5, 2.5, 3.5])) for k in range(120)]
    size = lambda q: (0, 0) if q is None else (2, 0) if math.isnan(q) else (1, q)
    ordered = sorted(rows, key=lambda x: (x[1], size(x[2]), x[0]))
    got = {r.k: (r.cohort, r.below) for r in cohorts.cohort_share(spark.createDataFrame(rows, "k long, r double, q double"), "r", "q", "k", least=1, nearest=20).collect()}
    for k, r, q in rows:
        low, high = _stretch(rows, r, 1.5, 20)
        assert got[k] == (high - low, sum(size(y) < size(q) for _, _, y in ordered[low:high]))


def test_a_cohort_sends_a_row_a_few_times(spark, monkeypatch):
    sent, running_total = [], cohorts.running_total

    def counted(df, *args):
        sent.append(df.count())
        return running_total(df, *args)

    monkeypatch.setattr(cohorts, "running_total", counted)
    table = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") + 100).alias("r"), (F.col("id") * 7 % 101).alias("q"))
    assert cohorts.cohort_share(table, "r", "q", "k").count() == 3000
    assert sum(sent) <= 8 * 3000


def test_entrant_rate_of_an_even_list(spark):
    table = spark.range(1000).select(F.col("id").alias("k"), (10_000 + F.col("id")).alias("r"), ((F.col("id") % 4 == 0) & (F.col("id") % 8 > 0)).alias("new_one"))
    assert {(r.cohort, r.rate) for r in cohorts.entrant_rate(table, "r", "new_one", "k").collect()} == {(1000, 0.125)}


def test_cohorts_of_nothing(spark):
    table = spark.createDataFrame([], "k long, r double, q long")
    assert cohorts.cohort_share(table, "r", "q", "k").count() == cohorts.entrant_rate(table, "r", "q", "k").count() == 0


# --- listings


@pytest.mark.parametrize("gap", [0, 2])
def test_listings_open_and_close(spark, gap):
    rng = random.Random(gap)
    seen = {(b, r): sorted(t for t in range(30) if rng.random() < 0.7) for b in "xy" for r in range(12)}
    rows = [(b, r, t) for (b, r), ts in seen.items() for t in ts] * 2 + [("x", 1, None)]
    newest = max(t for *_, t in rows if t is not None)
    spans = patterns.listing_spans(spark.createDataFrame(rows, "board string, role int, t int"), ["board", "role"], "t", gap)
    want = []
    for (b, r), ts in seen.items():
        start = before = None
        for t in [*ts, None]:
            if start is not None and (t is None or t - before > gap + 1):
                is_open = before + gap >= newest
                want.append((b, r, start, before, None if is_open else before + 1, is_open))
                start = None
            start, before = t if start is None else start, t
    key = lambda r: tuple(-1 if x is None else x for x in r)
    got = [(r.board, r.role, r.opened, r.last_seen, r.closed, r.is_open) for r in spans.collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    for b, adds, closes, net, open_now in patterns.net_changes(spans, ["board"], 10, 20).collect():
        own = [w for w in want if w[0] == b]
        assert adds == sum(10 <= w[2] <= 20 for w in own) and closes == sum(w[4] is not None and 10 <= w[4] <= 20 for w in own)
        assert net == adds - closes and open_now == sum(w[2] <= 20 and (w[4] is None or w[4] > 20) for w in own)
    for r in patterns.half_life(spans, ["board"], F.lit(newest)).collect():
        own = [((w[4] if w[4] is not None else newest + 1) - w[2], w[4] is not None) for w in want if w[0] == r.board]
        alive, half = 1.0, None
        for age in sorted({a for a, _ in own}):
            alive *= 1 - sum(c for a, c in own if a == age) / sum(a >= age for a, _ in own)
            half = age if half is None and alive <= 0.5 + 1e-9 else half
        assert (r.n, r.n_closed, r.half_life) == (len(own), sum(c for _, c in own), half)


def test_half_life_of_listings_that_stay(spark):
    rows = [("x", r, t) for r in range(3) for t in range(5)] + [("y", 1, 0), ("y", 2, 0), ("y", 2, 1)]
    spans = patterns.listing_spans(spark.createDataFrame(rows, "board string, role int, t int"), ["board", "role"], "t")
    assert {r.board: r.half_life for r in patterns.half_life(spans, ["board"], F.lit(4)).collect()} == {"x": None, "y": 1}


# --- near in time


def test_near_in_time_against_all_pairs(spark):
    rng = random.Random(1)
    left = [(k, rng.choice("abh"), day(rng.randrange(400))) for k in range(120)] + [(500, None, day(1)), (501, "a", None)]
    right = [(rng.choice("abhh"), day(rng.randrange(400))) for _ in range(300)] + [(None, day(1)), ("a", None)]
    got = patterns.near_in_time(spark.createDataFrame(left, "k int, p string, d date"), spark.createDataFrame(right, "p string, e date"), ["p"], "d", "e", 30).collect()
    assert len(got) == len(left)
    for r in got:
        gaps = [(e - r.d).days for p, e in right if p is not None and p == r.p and e and r.d and abs((e - r.d).days) <= 30]
        assert (r.n_near, r.gap) == (len(gaps), min(gaps, key=lambda g: (abs(g), -g)) if gaps else None)


def test_a_hot_party_meets_days_not_rows(spark):
    """A party with all rows: the pairs are of days within the band, however many rows a day has."""
    left = spark.range(20_000).select(F.lit("hot").alias("p"), F.expr("date_add(DATE '2024-01-01', CAST(id % 50 AS INT))").alias("d"))
    right = left.withColumnRenamed("d", "e")
    near = patterns.near_in_time(left, right, ["p"], "d", "e", 3)
    assert near.filter("d = DATE '2024-01-20'").select("n_near").distinct().first().n_near == 7 * 400


# --- histories


def test_transitions_of_plain_histories(spark):
    rng = random.Random(2)
    works = [(p, rng.choice(["uni", "lab", "mill", "new", "newer"]), day(rng.randrange(60))) for p in range(60) for _ in range(rng.randrange(1, 9))]
    got = {r.p: r for r in patterns.transitions(spark.createDataFrame([*works, (1, None, day(0)), (2, "uni", None)], "p int, h string, d date"), "p", "h", "d", F.col("h").startswith("new")).collect()}
    for p in range(60):
        own = [(h, d) for q, h, d in works if q == p]
        moved = min((d for h, d in own if h.startswith("new")), default=None)
        before = [(h, d) for h, d in own if moved and d < moved]
        n = Counter(h for h, _ in before)
        old = min(n, key=lambda h: (-n[h], -max(d for g, d in before if g == h).toordinal(), h), default=None)
        if old is None or n[old] < 2:
            assert p not in got
            continue
        after = [h for h, d in own if d >= moved]
        r = got[p]
        assert (r.moved_on, r.old_home, r.n_before, r.n_after, r.n_old_after) == (moved, old, n[old], sum(h.startswith("new") for h in after), after.count(old))
        assert r.how == ("dual" if old in after else "full move")


def test_ladders_climb_in_order(spark):
    rng = random.Random(3)
    events = [(p, rng.choice("abcx"), day(rng.randrange(12))) for p in range(80) for _ in range(rng.randrange(1, 7))] + [(99, "a", None), (98, None, day(1))]
    got = {r.p: r for r in patterns.ladder_days(spark.createDataFrame(events, "p int, r string, d date"), ["p"], "r", "d", list("abc")).collect()}
    for p in range(100):
        days, last = [], None
        for k, rung in enumerate("abc"):
            last = min((d for q, r, d in events if q == p and r == rung and d and (k == 0 or (last and d > last))), default=None)
            days.append(last)
        if days[0] is None:
            assert p not in got
        else:
            assert got[p].days == days and got[p].reached == sum(d is not None for d in days)
            assert got[p].waits == [None] + [(b - a).days if a and b else None for a, b in zip(days, days[1:])]


def test_breakouts_against_plain_weeks(spark):
    rng = random.Random(4)
    asof = day(200)
    rows = [(k, day(rng.randrange(200))) for k in "ab" for _ in range(150)] + [("a", day(198))] * 30 + [("c", day(100))] + [("d", day(150))] * 9 + [("e", day(205))]
    got = {(r.k, r.period): r for r in patterns.breakouts(spark.createDataFrame(rows, "k string, d date"), ["k"], "d", F.lit(asof)).collect()}
    counts = Counter((k, (asof - d).days // 7) for k, d in rows if d <= asof)
    assert got["a", 0].breaks and ("e", 0) not in got
    for k in "abcd":
        first = max(p for q, p in counts if q == k)
        for p in range(first + 1):
            before = [counts[k, q] for q in range(p + 1, min(p + 13, first + 1))]
            r = got[k, p]
            n = counts[k, p]
            assert r.n == n
            if len(before) < 12:
                assert r.mean is None and r.z is None and not r.breaks
                continue
            m, s = mean(before), pstdev(before)
            assert math.isclose(r.mean, m) and math.isclose(r.deviation, s, abs_tol=1e-12)
            assert r.breaks == (n >= 5 and (n > m if s == 0 else (n - m) / s >= 3))


def test_breakouts_at_just_three_deviations_fall_as_in_sql(spark, tmp_path):
    """Twelve days of mean 2 and deviation 1 in many orders, then a day of 5: z is 3 but for the last bits."""
    import duckdb

    import tallyfold.queries  # noqa: F401  registers the queries
    from tallyfold.catalog import QUERIES, SQL

    rng = random.Random(5)
    events = []
    for user in range(150):
        past = [1, 3] * 6 if user % 2 else [2, 2, 2, 2, 2, 2, 2, 2, 1, 1, 1, 5]
        rng.shuffle(past)
        events += [(user, dt.datetime(2024, 1, 18 + d)) for d, n in enumerate([*past, 5]) for _ in range(n)]
    spark.createDataFrame(events, "user_id long, ts timestamp_ntz").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = {(u, p): (n, m, breaks) for u, p, n, m, _, breaks in c.execute(SQL["x14_breakouts"]).fetchall()}
    got = {(r.user_id, r.period): (r.n, r["mean"], r.breaks) for r in QUERIES["x14_breakouts"](spark, str(tmp_path)).collect()}
    assert got == want and len(got) == 150 * 13


def test_rank_slopes_against_least_squares(spark):
    rng = random.Random(5)
    counts = [(k, p, rng.randrange(1, 20)) for k in range(9) for p in range(14) if rng.random() < 0.8]
    ranks = patterns.ranks_within(spark.createDataFrame(counts, "k int, p int, n int"), ["p"], "n")
    rank = {(k, p): 1 + sum(q == p and m > n for _, q, m in counts) for k, p, n in counts}
    assert {(r.k, r.p): r["rank"] for r in ranks.collect()} == rank

    def slope(points):
        if len(points) < 3:
            return None
        mx, my = mean(x for x, _ in points), mean(y for _, y in points)
        return sum((x - mx) * (y - my) for x, y in points) / sum((x - mx) ** 2 for x, _ in points)

    for r in patterns.rank_slopes(ranks, ["k"], "p", "rank", 5).collect():
        now, before = (slope([(-p, math.log10(v)) for (k, p), v in rank.items() if k == r.k and a <= p < a + 5]) for a in (0, 5))
        for got, want in ((r.velocity, now), (r.before, before), (r.acceleration, now - before if now is not None and before is not None else None)):
            assert (got is None) == (want is None) and (got is None or math.isclose(got, want, abs_tol=1e-9))


def test_rounds_and_their_steps(spark):
    rng = random.Random(8)
    rounds = [(p, day(rng.randrange(300)), rng.choice([0.0, 1.0, 2.5, 9.0, None])) for p in range(12) for _ in range(rng.randrange(1, 7))] + [(None, day(1), 1.0), (1, day(500), 1.0)]
    got = {r.p: r for r in patterns.round_steps(spark.createDataFrame(rounds, "p int, d date, a double"), "p", "d", "a", F.lit(day(400))).collect()}
    for p in range(12):
        daily = {}
        for q, d, a in rounds:
            if q == p and d <= day(400):
                daily.setdefault(d, []).append(a)
        days = sorted(daily)
        amounts = [sum(x for x in daily[d] if x is not None) if any(x is not None for x in daily[d]) else None for d in days]
        steps = [(b / a if a and b else None) for a, b in zip(amounts, amounts[1:])]
        r, known = got[p], [s for s in steps if s is not None]
        assert (r.rounds, r.first_day, r.last_day) == (len(days), days[0], days[-1])
        assert r.days_between == (pytest.approx(mean((b - a).days for a, b in zip(days, days[1:]))) if steps else None)
        assert r.step_up == (pytest.approx(math.exp(mean(map(math.log, known)))) if known else None)
        assert r.per_year == pytest.approx(len(days) / ((day(400) - days[0]).days / 365.25))


def test_profiles_of_awards(spark):
    asof = day(400)
    rows = [("a", f"o{k % 3}", day(400 - 20 * k), 10.0, 5.0) for k in range(12)] + [("b", "o", day(0), 4.0, None), ("b", "o", day(401), 4.0, 1.0), (None, "o", day(1), 1.0, 1.0), ("c", None, day(390), None, 0.0)]
    table = spark.createDataFrame(rows, "p string, o string, d date, c double, n double")
    got = {r.p: tuple(r)[1:] for r in patterns.award_profile(table, table.filter("p = 'b'"), "p", "o", "d", "c", "n", F.lit(asof), mill=10).collect()}
    assert got == {"a": (12, 3, 5, 4, 6 / 5, True, True, 2.0), "b": (1, 1, 0, 0, 1.0, False, False, None), "c": (1, 0, 1, 0, 2.0, True, False, None)}


def test_new_directors(spark):
    rows = [("a", 1, day(1), ["x", "y"], ["z"]), ("a", 2, day(5), ["x", "w", "z", "v"], ["v"]), ("a", 3, day(5), ["w", "y"], None), ("b", 4, day(1), ["n"], []), ("b", 5, day(2), None, ["n"]), ("b", 6, day(3), ["m", "m"], []), (None, 7, day(1), ["q"], [])]
    table = spark.createDataFrame(rows, "p string, f int, d date, b array<string>, o array<string>")
    assert {(r.p, r.f, r.director) for r in patterns.new_directors(table, "p", "f", "d", "b", "o").collect()} == {("a", 2, "w"), ("a", 3, "y"), ("b", 6, "m")}


def test_launch_surfaces(spark):
    rows = [("a", "hn", day(5)), ("a", "ph", day(9)), ("a", "hn", day(1)), ("a", "yc", day(60)), ("b", "ph", day(3)), ("b", None, day(1)), (None, "ph", day(1)), ("c", "ph", None)]
    got = {tuple(r)[0]: (r.first_day, r.surfaces, r.named) for r in patterns.surfaces(spark.createDataFrame(rows, "p string, s string, d date"), "p", "s", "d", 30).collect()}
    assert got == {"a": (day(1), 2, ["hn", "ph"]), "b": (day(3), 1, ["ph"])}


# --- persons and words


def test_initials_join_one_name_only(spark):
    names = [("x", "j", "smith"), ("x", "john", "smith"), ("x", "a", "wu"), ("x", "anna", "wu"), ("x", "alan", "wu"), ("x", "b", "wu"), ("y", "j", "smith"), ("x", "john", "smith"), ("x", "", "smith"), ("x", None, "wu"), (None, "m", "li"), (None, "mei", "li")]
    got = patterns.merged_by_initials(spark.createDataFrame(names, "c string, g string, f string"), "c", F.col("g"), F.col("f")).collect()
    assert {(r.c, r.given, r.family): (r.person, r.joins) for r in got} == {
        ("x", "j", "smith"): ("john", "joined"), ("x", "john", "smith"): ("john", "full"), ("x", "a", "wu"): ("a", "ambiguous"), ("x", "anna", "wu"): ("anna", "full"), ("x", "alan", "wu"): ("alan", "full"),
        ("x", "b", "wu"): ("b", "alone"), ("y", "j", "smith"): ("j", "alone"), (None, "m", "li"): ("mei", "joined"), (None, "mei", "li"): ("mei", "full"),
    }


def test_recurring_persons_by_rarity(spark):
    rng = random.Random(6)
    people = [(p, "lee", f"s{rng.randrange(12)}") for p in range(60)] + [(p, f"n{p}", "s1") for p in range(60)] + [(3, "rare", None), (40, "rare", "s2"), (40, "rare", "s2"), (None, "rare", "s2")]
    got = {(r.n, r.f): (r.parties, r.first_party, r.last_party) for r in patterns.recurring_persons(spark.createDataFrame(people, "p int, n string, f string"), "p", "n", "f", 2.0).collect()}
    facts = defaultdict(set)
    parties = defaultdict(set)
    for p, n, f in people:
        if p is not None:
            facts[f].add(p)
            if n == "lee":
                parties[f].add(p)
    want = {("rare", None): (2, 3, 40)} | {("lee", f): (len(ps), min(ps), max(ps)) for f, ps in parties.items() if len(ps) > 1 and math.log(60 / len(facts[f])) >= 2.0}
    assert got == want and len(got) > 1


def test_telling_words(spark):
    rows = [(1, "Robot arm robot", True)] * 6 + [(2, "arm and leg", False)] * 9 + [(3, None, True), (4, "robot", None), (5, "ünï-ïnü ünï", True)]
    got = {r.word: r for r in patterns.telling_words(spark.createDataFrame(rows, "k int, t string, n boolean"), "t", "n", least=1).collect()}
    assert {w: (r.new, r.rest) for w, r in got.items()} == {"robot": (6, 1), "ünï": (1, 0), "ïnü": (1, 0)}
    a, b, m, o = 6.5, 1.5, 9.0, 11.0
    part = lambda x, n: x * math.log(x / n) + (n - x) * math.log((n - x) / n)
    assert math.isclose(got["robot"].score, 2 * (part(a, m) + part(b, o) - part(a + b, m + o)))


# --- keyed state


def _write(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def _at(hours):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours)


SCHEMA = "k int, ts timestamp, v int"


def _run(spark, frame, checkpoint, out):
    q = frame.writeStream.foreachBatch(lambda b, e: b.write.mode("overwrite").parquet(f"{out}/epoch={e}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.option("basePath", out).schema(frame.schema).parquet(f"{out}/epoch=*").collect()


def _lots(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def test_first_sightings_are_told_once_across_a_restart(spark, tmp_path):
    path, progress, out = (str(tmp_path / x) for x in ("in", "progress", "out"))
    _write(spark, path, [(1, _at(30), 0), (2, _at(31), 0)], SCHEMA)
    _write(spark, path, [(1, _at(20), 0), (3, _at(40), 0)], SCHEMA)  # key 1 is earlier than its first lot said
    told = lambda: _run(spark, keyed.sightings(_lots(spark, path), ["k"], "ts", "12 hours"), progress, out)
    assert {(r.k, r.first_seen) for r in told()} == {(1, _at(20))}
    _write(spark, path, [(1, _at(70), 0), (4, _at(90), 0), (3, _at(60), 0)], SCHEMA)  # a new run from the same checkpoint
    rows = told()
    assert sorted((r.k, r.first_seen) for r in rows) == [(1, _at(20)), (2, _at(31)), (3, _at(40))]


def test_idle_keys_are_dropped_and_told_anew(spark, tmp_path):
    path, progress, out = (str(tmp_path / x) for x in ("in", "progress", "out"))
    for rows in ([(1, _at(1), 0), (2, _at(1), 0)], [(2, _at(30), 0)], [(2, _at(50), 0)], [(1, _at(80), 0)], [(2, _at(120), 0), (1, _at(120), 0)]):
        _write(spark, path, rows, SCHEMA)
    hour = 3_600_000
    rows = _run(spark, keyed.sightings(_lots(spark, path), ["k"], "ts", "1 hour", idle=24 * hour), progress, out)
    assert sorted((r.k, r.first_seen) for r in rows if r.k == 1) == [(1, _at(1)), (1, _at(80))]
    assert (2, _at(1)) in {(r.k, r.first_seen) for r in rows}


def test_latest_reading_whatever_the_order(spark, tmp_path):
    rng = random.Random(7)
    rows = [(rng.randrange(5), _at(rng.randrange(40)), n) for n in range(80)]
    path = str(tmp_path / "in")
    for k in range(0, 80, 20):
        _write(spark, path, rows[k : k + 20], SCHEMA)
    told = _run(spark, keyed.latest(_lots(spark, path), ["k"], "ts", ["v"], "100 hours"), str(tmp_path / "progress"), str(tmp_path / "out"))
    last = {}
    for r in told:
        last[r.k] = max(last.get(r.k, (r.ts, r.v)), (r.ts, r.v))
    assert last == {k: max((t, v) for q, t, v in rows if q == k) for k in {r[0] for r in rows}}


@pytest.mark.parametrize("seed", [None, 1, 2])
def test_no_row_is_lost_by_lateness(spark, tmp_path, seed):
    rows = [(k % 3, _at(8 * k), k) for k in range(60)] + [(None, _at(1), 60), (1, None, 61)]
    if seed is not None:
        random.Random(seed).shuffle(rows)
    path = str(tmp_path / "in")
    lots = [rows[k : k + 16] for k in range(0, 62, 16)]
    for lot in lots:
        _write(spark, path, lot, SCHEMA)
    clock = _at(8 * 50)
    got = keyed.sorted_by_lateness(_lots(spark, path), "k", "ts", {0: 2}, 5, F.lit(clock)).collect()
    latest, want = {}, {}
    for lot in lots:
        for k, t, v in lot:
            late = k is None or t is None or (t <= clock and k in latest and t < latest[k] - dt.timedelta(days=2 if k == 0 else 5))
            want[v] = "late" if late else "held" if t > clock else "on time"
        for k, t, v in lot:
            if k is not None and t is not None and t <= clock:
                latest[k] = max(latest.get(k, t), t)
    assert {r.v: r.arrival for r in got} == want and len(got) == 62
    if seed is None:
        assert Counter(want.values())["late"] == 2


def test_an_empty_stream(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    assert keyed.sorted_by_lateness(_lots(spark, path), "k", "ts", {}, 5, F.lit(_at(0))).count() == 0
    assert stream.drained(keyed.sightings(_lots(spark, path), ["k"], "ts"), "append").count() == 0


def test_a_store_rewrites_only_what_a_batch_touches(spark, tmp_path):
    schema = "fingerprint string, run_id int, v int, observed_at timestamp"
    path, store, progress = (str(tmp_path / x) for x in ("in", "store", "progress"))
    lots = [[(f"k{k}", 1, k, _at(k)) for k in range(40)], [("k1", 2, 100, _at(0)), ("k1", 2, 90, _at(9))], [("k2", 3, 7, _at(50)), ("new", 3, 1, _at(3))], [("k1", 1, -5, _at(70))]]
    schema_of = spark.createDataFrame([], schema).schema
    for n, lot in enumerate(lots):
        _write(spark, path, lot, schema)
        if n in (1, 3):  # two runs, the second from the checkpoint of the first
            frame = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
            stream.upsert_buckets(frame, store, buckets=8, progress=progress)
    got = {r.fingerprint: (r.run_id, r.v, r.observed_at) for r in stream.stored(spark, store, schema_of).collect()}
    want = {f"k{k}": (1, k, _at(k)) for k in range(40)} | {"k1": (2, 100, _at(0)), "k2": (3, 7, _at(2)), "new": (3, 1, _at(3))}
    assert got == want
    written = {v.name: len([b for b in v.iterdir() if b.name.startswith("_bucket")]) for v in (tmp_path / "store" / "data").iterdir()}
    assert written["v00000003"] == 1 and written["v00000002"] <= 2
    assert len(list((tmp_path / "store" / "versions").iterdir())) == 2
    assert stream.stored(spark, str(tmp_path / "none"), schema_of).count() == 0
