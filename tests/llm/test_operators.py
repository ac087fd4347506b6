"""The training-data operators against brute force, and their edge cases."""

import functools
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tallyfold.llm import chat_format, decontaminate, kneser_ney, language, license_scan, linear, media_gif, near_copies, packing, quality, simhash, toxicity
from tallyfold.llm.common import documents, flat
from tallyfold.llm.components import components

ODD = [(1, None), (2, ""), (3, "   \n\t"), (4, "Ça va? CC-BY 4.0, All rights reserved."), (4, "Ça va? CC-BY 4.0, All rights reserved."), (None, "no id"), (7, "x"), (8, "word " * 3000)]
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(x):
    return (x or "").encode().lower().decode()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and other columns with clashing names."""
    return spark.createDataFrame([(i, x, "en", 1.0, 2.0, "k", 3) for i, x in ODD], "doc_id long, text string, lang string, score double, labels double, kept string, n_words int")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return documents(spark, sf)


# --- 1 and 5: classifiers


def test_ftrl_learns_a_sparse_rule():
    rng = np.random.default_rng(1)
    model = linear.Ftrl(bits=8, alpha=0.5, l1=0.5)
    for _ in range(2000):
        at = np.unique(rng.integers(1, 200, 12))
        model.update(at, np.ones(len(at)), float(7 in at or 9 in at))
    w = model.weights()
    assert min(w[7], w[9]) > 1 and np.abs(np.delete(w, [7, 9])).max() < min(w[7], w[9])


KINDS = (quality.KIND, toxicity.KIND)


def test_dot_is_the_sum_over_distinct_or_counted_features(monkeypatch):
    texts = ["a b a", None, "!! B ###", "", "Ab, ab; xyzxyz " * 40 + "  \n end"]
    raw, offs = flat(pa.array(texts, pa.string()))
    for kind in KINDS:
        w = np.random.default_rng(0).normal(size=1 << kind.bits).astype(np.float32)
        slow = [float(w[at].astype(float) @ x) for at, x in linear.examples(raw, offs, kind)]
        assert np.allclose(linear.dot(raw, offs, kind, w), slow)
        # Long texts in pieces are the same texts.
        for piece in (1, 9, 100):
            monkeypatch.setattr(linear, "LONG", 2)
            monkeypatch.setattr(linear, "PIECE", piece)
            pieces = [x for i in range(len(texts)) for x in linear.examples(raw[offs[i] : offs[i + 1]], np.array([0, offs[i + 1] - offs[i]]), kind)]
            monkeypatch.undo()
            for (at, x), (at2, x2) in zip(linear.examples(raw, offs, kind), pieces, strict=True):
                assert at.tolist() == at2.tolist() and np.allclose(x, x2)


def test_memory_of_a_long_text_and_of_many_empty_ones():
    import tracemalloc

    text = "Some words, AND more of them; " * 1_000_000  # 30 MB
    raw, offs = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)])
    some = [lambda k=kind: linear.dot(raw, offs, k, np.ones(1 << k.bits, np.float32)) for kind in KINDS]
    some.append(lambda: toxicity.Voters(np.array([1], np.uint64), np.array([0])).votes(raw, offs))
    for f in some:
        tracemalloc.start()
        f()
        _, peak = tracemalloc.get_traced_memory()
        tracemalloc.stop()
        assert peak < 160 << 20
    batch = pa.RecordBatch.from_pydict({"text": pa.array([None, ""] * 200, pa.string())})
    sizes = [t.num_rows for t in linear.chunks(iter([batch] * 2500))]  # a million texts
    assert sum(sizes) == 1_000_000 and max(sizes) <= 20_400


def naive_weights(rows, kind, l1, alpha, epochs):
    """Shards, passes and coordinates one by one, weights in a dictionary."""
    total, mean = 0, defaultdict(float)
    shards = defaultdict(list)
    for doc_id, text, y, shard in rows:
        (at, x), = linear.examples(*flat(pa.array([text])), kind)
        shards[shard].append((doc_id, y, dict(zip(at.tolist(), x.tolist(), strict=True))))
    for data in shards.values():
        data.sort(key=lambda r: r[0])
        z, n = defaultdict(float), defaultdict(float)
        penalty = l1 * len(data) / 1000
        w = lambda k: 0.0 if abs(z[k]) <= penalty else (math.copysign(penalty, z[k]) - z[k]) / ((1 + math.sqrt(n[k])) / alpha + 1e-3)  # noqa: E731, B023
        dealt = np.random.default_rng(7)
        for _ in range(epochs):
            for i in dealt.permutation(len(data)):
                _, y, x = data[i]
                now = {k: w(k) for k in x}
                p = 1 / (1 + math.exp(-max(-30, min(30, sum(now[k] * v for k, v in x.items())))))
                for k, v in x.items():
                    g = (p - y) * v
                    z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / alpha * now[k]
                    n[k] += g * g
        for k in list(z):
            mean[k] += w(k) * len(data)
        total += len(data)
    return {k: v / total for k, v in mean.items() if v}


def test_weights_against_naive_updates(spark, docs):
    from pyspark.sql import functions as F

    rows = docs.filter("text IS NOT NULL").select("doc_id", "text", (F.col("doc_id") % 3 == 0).cast("double").alias("y"))
    for kind, l1, epochs in ((quality.KIND, 0.05, 3), (toxicity.KIND, 4.0, 4)):
        want = naive_weights([tuple(r) for r in rows.withColumn("s", F.pmod(F.xxhash64(F.lit("shard"), "doc_id"), F.lit(linear.SHARDS))).collect()], kind, l1, 1.0, epochs)
        got = linear.fit(rows, kind, l1=l1, alpha=1.0, epochs=epochs)
        assert set(np.flatnonzero(got).tolist()) <= set(want) and want
        assert np.allclose(got[list(want)], list(want.values()), rtol=1e-4, atol=1e-6)


def test_quality_on_held_out_rows(spark, sf):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = quality.held_out(documents(spark, d), labels).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.97 * len(got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def test_toxicity_label_model_and_classifier(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.held_out(documents(spark, d), labels).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.toxic for r in got) >= 0.97 * len(got)
    assert sum(r.predicted for r in got if r.toxic) >= 0.75 * sum(r.toxic for r in got)


def some_votes(n=4000):
    rng = np.random.default_rng(3)
    y = rng.random(n) < 0.2
    votes = np.zeros((n, 5), np.int8)
    for j, (hit, false) in enumerate([(0.7, 0.01), (0.6, 0.02), (0.5, 0.01), (0.5, 0.01)]):
        votes[:, j] = rng.random(n) < np.where(y, hit, false)
    votes[:, 4] = votes[:, 3]  # a copy of a voter
    return y, votes


def test_label_model_finds_accuracies_and_correlations():
    y, votes = some_votes()
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = toxicity.LabelModel.fit(patterns, counts.astype(float))
    assert ((model.posterior(votes) >= 0.5) == y).mean() > 0.93
    # The copy hangs on what it copies, and its vote tells nothing more; chances are found as they were made.
    assert {model.parent[3], model.parent[4]} & {3, 4}
    assert np.allclose(model.vote[1, :3, 1, 2], [0.7, 0.6, 0.5], atol=0.1) and abs(model.prior - 0.2) < 0.05
    alone = toxicity.LabelModel.fit(*np.unique(votes[:, :4], axis=0, return_counts=True))
    assert np.abs(model.posterior(votes) - alone.posterior(votes[:, :4])).mean() < 0.02


def test_label_model_against_naive_maximisation():
    """Row by row in dictionaries, with the forest as given."""
    _, votes = some_votes(300)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = toxicity.LabelModel.fit(patterns, counts.astype(float), rounds=13)
    index = {p.tobytes(): i for i, p in enumerate(patterns)}
    parent, half = model.parent.tolist(), toxicity.LabelModel.fit(patterns, counts.astype(float), rounds=10)
    q = [half.posterior(patterns)[index[v.tobytes()]] for v in votes]
    assert parent == toxicity.forest(np.stack([patterns == v for v in (-1, 0, 1)], 2).astype(float), counts.astype(float), half.posterior(patterns)).tolist()
    for _ in range(3):
        single, joint, mass = Counter(), Counter(), Counter()
        for v, p in zip(votes.tolist(), q, strict=True):
            for c, w in ((0, 1 - p), (1, p)):
                mass[c] += w
                for j, x in enumerate(v):
                    single[c, j, x] += w
                    if parent[j] >= 0:
                        joint[c, j, v[parent[j]], x] += w
                        joint[c, j, v[parent[j]]] += w
        own = lambda c, j, x: (single[c, j, x] + toxicity.WORTH * toxicity.EXPECTED[c][x + 1]) / (mass[c] + toxicity.WORTH)  # noqa: E731, B023
        def given(c, j, u, x):
            both = (sum(joint[k, j, u, x] for k in (0, 1)) + 1 / 3) / (sum(joint[k, j, u] for k in (0, 1)) + 1)  # noqa: B023
            return (joint[c, j, u, x] + toxicity.POOLED * both) / (joint[c, j, u] + toxicity.POOLED)  # noqa: B023

        prior = (mass[1] + toxicity.PRIOR * toxicity.WORTH) / (len(votes) + toxicity.WORTH)
        q = []
        for v in votes.tolist():
            p = [1 - prior, prior]
            for c in (0, 1):
                for j, x in enumerate(v):
                    p[c] *= own(c, j, x) if parent[j] < 0 else given(c, j, v[parent[j]], x)
            q.append(p[1] / (p[0] + p[1]))
    assert np.allclose(model.posterior(votes), q)


def test_labels_come_back_from_no_voter_that_was_read_off_them(spark):
    """With shuffled labels the grown lexicons have nothing to say of other rows than their own, and the fixed ones decide."""
    from pyspark.sql import functions as F

    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    shuffled = labels.select("doc_id", (F.xxhash64("doc_id") % 8 == 0).cast("int").alias("toxic"))
    got = toxicity.held_out(documents(spark, d), shuffled).join(labels, "doc_id").filter("held_out").collect()
    false = [r.predicted for r in got if not r.toxic]
    assert sum(false) <= 0.05 * len(false)


def test_classifiers_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1, 0), (7, 0, 1), (7, 0, 1), (8, None, None), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    empty = labels.limit(0)
    for module in (quality, toxicity):
        for held in (labels, empty):
            got = module.held_out(odd, held).collect()
            assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
        assert module.held_out(none, labels).count() == 0
    assert quality.keep_good(odd, empty).columns == odd.columns and quality.keep_good(odd, empty).count() == len(ODD)
    assert toxicity.keep_clean(odd, empty).columns == odd.columns and toxicity.keep_clean(odd, empty).count() == len(ODD)
    d = "/root/testdata/sf0.01"
    clean = toxicity.keep_clean(documents(spark, d), empty)
    gold = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    kept = {r.doc_id for r in clean.collect()}
    assert sum(gold[i] == 0 and i not in kept for i in gold) <= 0.01 * len(gold)


def test_sketches_tell_copies():
    raw, offs = flat(pa.array(["a b c d e f", "a b c d e f", "g h i j k", "a", "a", None]))
    s = linear.sketches(raw, offs)
    assert s[0] == s[1] != s[2] and s[3] == s[4] and s[5] == 0


# --- 2: decontamination


def brute_hits(texts, items, width=10):
    windows = defaultdict(set)
    for i, x in items:
        ws = WORD.findall(low(x))
        for k in range(max(1, len(ws) - width + 1) if ws else 0):
            windows[tuple(ws[k : k + width])].add(i)
    out = []
    for x in texts:
        ws = WORD.findall(low(x))
        hit, found = set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(ws) - n + 1):
                if tuple(ws[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(ws[k : k + n])]
        out.append((len(ws), sorted(hit), sorted(found)))
    return out


def test_index_search_against_brute_force():
    rng = random.Random(3)
    for _ in range(150):
        letters = ["a", "B", "ç", "dd", "e9", "f"][: rng.choice([2, 3, 6])]
        items = [(str(i), " ".join(rng.choice([*letters, "zz"]) for _ in range(rng.choice([0, 1, 3, 9, 10, 11, 14])))) for i in range(rng.randrange(5))]
        texts = [None if rng.random() < 0.1 else " ".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(rng.randrange(1, 6))]
        windows = decontaminate.Windows.of(items)
        found = decontaminate.search(*flat(pa.array(texts, pa.string())), windows)
        text, first, after, n_hit = decontaminate.merged(found, len(texts))
        hits = [sorted({w - int(found.cuts[t]) for t, a, b in zip(text, first, after, strict=True) if t == i for w in range(a, b)}) for i in range(len(texts))]
        own = [sorted({x for t, w in zip(found.text, found.window, strict=True) if t == i for x in windows.items_of(w)}) for i in range(len(texts))]
        assert [(int(n), h, o) for n, h, o in zip(np.diff(found.cuts), hits, own, strict=True)] == brute_hits(texts, items)
        assert n_hit.tolist() == [len(h) for h in hits]


def test_decontamination_of_a_table(spark, sf, docs, odd, none, monkeypatch):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [(str(r.item_id), r.text) for r in bench.collect()]
    rows = docs.select("doc_id", "text").collect()
    want = {r.doc_id: b for r, b in zip(rows, brute_hits([r.text for r in rows], items), strict=True)}

    def check():
        for r in decontaminate.report(docs, bench).collect():
            n, hit, found = want[r.doc_id]
            assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, len(hit), len(found), bool(hit))
            assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()

    check()
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 2000)  # several blocks give the same
    check()
    clean = decontaminate.clean(docs, bench)
    assert decontaminate.report(clean, bench).filter("contaminated").count() == 0
    kept = {r.doc_id: r.text for r in clean.collect()}
    assert all(kept[r.doc_id] == r.text for r in rows if not want[r.doc_id][1]) and len(kept) == len(rows)
    odd_bench = spark.createDataFrame([(1, None, 9), (1, "", 9), (2, "Ça va", 9), (None, "word", 9)], "item_id long, text string, score int")
    got = decontaminate.find(odd, odd_bench).orderBy("doc_id", "text").collect()
    assert len(got) == len(ODD) and sum(r.n_hit == 2 for r in got) == 2 and all(r.kept == "k" for r in got)
    assert decontaminate.find(odd, odd_bench.limit(0)).filter("n_hit > 0").count() == 0
    assert decontaminate.clean(none, odd_bench).count() == 0


def test_cutting_goes_on_until_nothing_is_left(spark):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x a a b c b c y")], "doc_id long, text string")
    assert decontaminate.clean(docs, bench).first().text.split() == ["x", "y"]


# --- 3: language model


def brute_model(tokens, train, order):
    """The probability of the last of some words, by plain counting."""
    counts = [Counter() for _ in range(order + 1)]
    for i in train:
        padded = ["<s>"] * (order - 1) + tokens[i]
        counts[order].update(tuple(padded[k : k + order]) for k in range(len(tokens[i])))
    for n in range(order - 1, 0, -1):
        counts[n].update(g[1:] for g in counts[n + 1])
    of = [Counter(c.values()) for c in counts]
    cuts = [None, *[kneser_ney.discounts(*[of[n][k] for k in (1, 2, 3, 4)]) for n in range(1, order + 1)]]
    followed = [defaultdict(list) for _ in range(order + 1)]
    for n in range(1, order + 1):
        for g, c in counts[n].items():
            followed[n][g[:-1]].append(c)
    v = len({t for i in train for t in tokens[i]})

    @functools.cache
    def context(n, before):
        after = followed[n].get(before, [])
        return sum(after), sum(cuts[n][min(x, 3) - 1] for x in after)

    @functools.cache
    def p(gram):
        n = len(gram)
        if not n:
            return 1 / (v + 1)
        total, left = context(n, gram[:-1])
        if not total:
            return p(gram[1:])
        c = counts[n][gram]
        return (max(c - cuts[n][min(c, 3) - 1], 0) if c else 0) / total + left / total * p(gram[1:])

    return p


@pytest.mark.parametrize("order", [2, 3, 4])
def test_model_against_brute_force(spark, docs, monkeypatch, order):
    monkeypatch.setattr(kneser_ney, "CHUNK_TEXT", 1 << 16)
    monkeypatch.setattr(kneser_ney, "LEAST_BUCKETS", 4)
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(-5, None), (-6, ""), (-7, "Zz qq  zz")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in kneser_ney.held_out(table, order).collect()}
    tokens = {i: [*low(x).split(), "</s>"] for i, x in rows}
    train = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 != 2}
    one = Counter(t for i in train for t in tokens[i])
    n, v = sum(one.values()), len(one)
    p = brute_model(tokens, train, order)
    context = ("<s>",) * (order - 2) + ("the",)
    assert math.isclose(sum(p((*context, w)) for w in one) + p((*context, "<never>")), 1)
    for i, ts in tokens.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ts), sum(one[t] > 0 for t in ts), n, i not in train)
        assert math.isclose(r.base_score, sum(math.log10((one[t] + 1) / (n + v + 1)) for t in ts), rel_tol=1e-9)
        padded = ["<s>"] * (order - 1) + ts
        assert math.isclose(r.score, sum(math.log10(p(tuple(padded[k : k + order]))) for k in range(len(ts))), rel_tol=1e-9)


@pytest.mark.parametrize("order", [2, 3])
def test_a_stored_model_scores_other_tables(spark, docs, monkeypatch, order):
    """What a second table gets from the files alone is what it gets along with the counting; the files are what the arrays are mapped from."""
    import os

    monkeypatch.setattr(kneser_ney, "CHUNK_TEXT", 1 << 18)
    from pyspark.sql import functions as F

    trained = F.col("doc_id") % 3 != 1
    both = {r.doc_id: r for r in kneser_ney.train_and_score(docs, trained, order).collect()}
    folder = kneser_ney.train(docs, trained, order).folder
    model = kneser_ney.Model.load(folder)
    keys = kneser_ney.mapped(kneser_ney._file(folder, order, 0, "keys"), "<u8")
    assert isinstance(keys, np.memmap) and len(keys) and (np.diff(keys) > 0).all() and os.path.exists(keys.filename)
    other = docs.filter(~trained).repartition(2)
    got = kneser_ney.score(other, model).collect()
    assert len(got) == other.count() and all((r.score, r.base_score, r.n_known) == (both[r.doc_id].score, both[r.doc_id].base_score, both[r.doc_id].n_known) for r in got)
    assert kneser_ney.score(docs.limit(0), model).count() == 0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("tallyfold")]


def test_model_on_odd_rows(spark, odd, none):
    from pyspark.sql import functions as F

    assert kneser_ney.held_out(odd).count() == len(ODD)
    assert kneser_ney.held_out(none).count() == 0
    untrained = kneser_ney.train_and_score(odd, F.lit(False)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.score == 0 for r in untrained)


def test_packed_arrays_come_back():
    rng = np.random.default_rng(5)
    for values in (np.zeros(0, np.uint64), np.array([0, 0], np.uint64), rng.integers(0, 1 << 63, 1000).astype(np.uint64)):
        assert (kneser_ney.unpacked(kneser_ney.packed(values)) == values).all()
        assert (kneser_ney.unpacked_sorted(kneser_ney.packed_sorted(np.sort(values))) == np.sort(values)).all()


# --- 4: GIF


def test_lzw_round_trips():
    rng = random.Random(1)
    for n in (0, 1, 2, 5, 300, 3000, 30000):
        for data in (bytes(rng.randrange(256) for _ in range(n)), bytes([3]) * n, bytes(rng.choice([1, 2]) for _ in range(n))):
            assert media_gif.lzw_decode(media_gif.lzw_encode(data), 8, n) == data
            small = bytes(x & 3 for x in data)
            assert media_gif.lzw_decode(media_gif.lzw_encode(small, 2), 2, n) == small


def gif_of(frames, size=(2, 2), palette=((0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255))):
    out = b"GIF89a" + bytes([size[0], 0, size[1], 0, 0x81, 0, 0]) + bytes(v for c in palette for v in c)
    for x, y, w, h, pixels, disposal, clear, delay, interlaced in frames:
        out += bytes([0x21, 0xF9, 4, disposal << 2 | (clear is not None), delay, 0, clear or 0, 0])
        out += bytes([0x2C, x, 0, y, 0, w, 0, h, 0, 0x40 * interlaced, 2]) + media_gif._blocks(media_gif.lzw_encode(bytes(pixels), 2))
    return out + b"\x3b"


def test_disposal_and_transparency():
    frames = list(media_gif.read_gif(gif_of([
        (0, 0, 2, 2, [1, 1, 1, 1], 1, None, 5, 0),
        (0, 0, 2, 1, [2, 3], 3, 3, 6, 0),  # blue is transparent; put back afterwards
        (1, 1, 1, 1, [3], 2, None, 7, 0),  # its rectangle cleared afterwards
        (0, 0, 1, 1, [2], 0, None, 8, 0),
    ])))
    seen = [[tuple(p) for p in f.canvas.reshape(-1, 3).tolist()] for f in frames]
    k, r, g, b = (0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255)
    assert seen == [[r, r, r, r], [g, r, r, r], [r, r, r, b], [g, r, r, k]]
    assert [f.delay for f in frames] == [5, 6, 7, 8]


def test_interlaced_rows_and_histogram():
    frame = next(iter(media_gif.read_gif(gif_of([(0, 0, 1, 9, [0, 1, 2, 3, 0, 1, 2, 3, 0], 0, None, 0, 1)], (1, 9)))))
    assert frame.samples[[0, 8, 4, 2, 6, 1, 3, 5, 7], 0].tolist() == [0, 1, 2, 3, 0, 1, 2, 3, 0]
    assert media_gif.histogram(frame.canvas, 2).sum() == 9


def test_written_forms_come_back():
    payload = ("Ça va? " * 400).encode()
    payload += b"\xff" * (-len(payload) % 576)
    for disposal in (0, 1, 2, 3):
        for transparent in (None, 255, 7):
            for interlaced in (False, True):
                frames = list(media_gif.read_gif(media_gif.write_gif(payload, disposal=disposal, transparent=transparent, interlaced=interlaced)))
                assert b"".join(f.samples.tobytes() for f in frames) == payload and {f.disposal for f in frames} == {disposal}
    (_, first, counts), = media_gif.timed_frames(media_gif.write_gif(payload))
    seen = [tuple(int(payload[i]) >> k & m for k, m in ((5, 7), (2, 7), (0, 3))) for i in range(len(payload)) if payload[i] != 255]
    slow = Counter((r * 255 // 7 * 4 >> 8) * 16 + (g * 255 // 7 * 4 >> 8) * 4 + (b * 255 // 3 * 4 >> 8) for r, g, b in seen)
    slow[0] += payload.count(255)  # transparent padding shows the empty screen
    assert dict(slow) == {i: int(n) for i, n in enumerate(counts) if n}


def test_stored_texts(spark, docs, odd, none):
    rows = {r.doc_id: r.text for r in docs.collect()}
    for r in media_gif.digests(media_gif.gif_columns(docs)).collect():
        raw = rows[r.doc_id].encode()
        whole = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-32:]))
    got = media_gif.gif_columns(odd, keep_media=True).collect()
    assert [r.payload_bytes for r in got if r.doc_id in (1, 2)] == [576, 576] and all(hashlib.sha256(r.media).hexdigest() == r.media_sha256 for r in got)
    assert media_gif.gif_columns(none).count() == 0
    media = spark.createDataFrame([(1, bytes(got[-1].media), "x"), (2, b"nonsense", "y"), (3, None, "z")], "id long, media binary, error string")
    frames = media_gif.frame_rows(media).collect()
    assert [r.start_cs for r in frames if r.id == 1] == [4 * k for k in range(got[-1].n_frames)] and {r.id for r in frames if r.error} == {2, 3}


# --- 6: SimHash


def brute_classes(rows, distance):
    fps = defaultdict(list)
    for i, x in rows:
        fps[simhash.fingerprint(x)].append(i)
    keys = sorted(fps)
    every = np.array(keys, np.uint64)
    root = list(range(len(keys)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(keys)):
        for j in np.flatnonzero(np.bitwise_count(every[i + 1 :] ^ every[i]) <= distance):
            root[find(i)] = find(i + 1 + int(j))
    least = {}
    for i, k in enumerate(keys):
        least[find(i)] = min([least.get(find(i), math.inf), *fps[k]])
    return {d: (f"{k:016x}", least[find(i)]) for i, k in enumerate(keys) for d in fps[k]}


def test_fingerprints_bit_by_bit():
    from xxhash import xxh64_intdigest

    for text in ("", None, "One", "one TWO", "a b c", "a b c d a b c É é", "x " * 50):
        words = low(text).split()
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
        assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_classes_against_brute_force(spark):
    d = documents(spark, "/root/testdata/sf0.01")
    rows = [(r.doc_id, r.text) for r in d.collect()]
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.report(d).collect()} == brute_classes(rows, 3)
    for distance in (3, 7):
        kept = {r.doc_id for r in simhash.dedup(d, distance=distance).collect()}
        assert kept == {c for _, c in brute_classes(rows, distance).values()}


def test_crowded_keys_are_refined(spark):
    rng = random.Random(2)
    centres = [rng.getrandbits(64) for _ in range(3)]
    found = set()
    for _ in range(700):
        x = rng.choice(centres)
        for _ in range(rng.randrange(7)):
            x ^= 1 << rng.randrange(64)
        found.add(x)
    keys = sorted(simhash.signed(x) for x in found)
    every = np.array(keys, np.int64).view(np.uint64)
    label = np.arange(len(keys))
    near = [np.flatnonzero(np.bitwise_count(every ^ x) <= 3) for x in every]
    while True:
        now = np.array([label[n].min() for n in near])
        if (now == label).all():
            break
        label = now
    nodes = spark.createDataFrame([(k,) for k in keys], "fp long")
    got = {r.node: r.root for r in components(simhash.links(nodes, bucket=32)).collect()}
    assert all(got.get(k, k) == keys[at] for k, at in zip(keys, label, strict=True))


def test_thresholds_add_up():
    sample = np.random.default_rng(1).integers(0, 1 << 62, 500).astype(np.uint64)
    for n in (10, 10**6, 10**10):
        masks = simhash.plan(sample, n)
        rng = random.Random(n)
        for _ in range(300):
            diff = sum(1 << b for b in rng.sample(range(64), 3))
            assert any(not diff & m for m in masks)
    assert len(simhash.plan(sample, 10**10)) > len(simhash.plan(sample, 1000))


def test_simhash_on_odd_rows(odd, none):
    got = simhash.report(odd).collect()
    assert len(got) == len(ODD) and {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1}
    kept = simhash.dedup(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 7, 8]
    assert simhash.report(none).count() == 0 and simhash.dedup(none).count() == 0


@pytest.mark.parametrize("distance", [None, 3])
def test_repeated_ids_lose_no_text(spark, distance):
    long = lambda w: " ".join(f"{w}{k}" for k in range(60))
    rows = [(0, long("beta")), (1, long("beta")), (1, long("zulu")), (2, long("zulu")), (3, long("a")), (3, long("b")), (3, long("b")), (4, long("b")), (None, long("c")), (None, long("c")), (None, long("d")), (5, long("d")), (None, None), (None, "")]
    table = spark.createDataFrame([(*r, {"k": 1}) for r in rows], "doc_id long, text string, tags map<string,int>")
    got = sorted((r.text or "", -1 if r.doc_id is None else r.doc_id) for r in simhash.dedup(table, distance=distance).collect())
    assert got == sorted([("", -1), (long("beta"), 0), (long("zulu"), 1), (long("a"), 3), (long("b"), 3), (long("c"), -1), (long("d"), 5)])
    with pytest.raises(ValueError):
        simhash.links(table.selectExpr("doc_id AS fp"), distance=3, bucket=4)


def five_word_sets(text):
    words = low(text).split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_a_shared_template_is_no_copy(spark):
    rng = random.Random(5)
    own = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    rows = []
    for k in range(20):
        line = own(9)
        rows += [(2 * k + j, " ".join([line] * 20) + " " + own(100)) for j in (0, 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert simhash.dedup(table, distance=7).count() < 40
    assert simhash.dedup(table).count() == 40


@pytest.mark.parametrize(("small", "rows", "columns"), [(16, 1000, 8192), (2, 50, 64)])
def test_near_copies_against_brute_force(spark, monkeypatch, small, rows, columns):
    monkeypatch.setattr(near_copies, "SMALL", small)
    monkeypatch.setattr(near_copies, "BLOCK_ROWS", rows)
    monkeypatch.setattr(near_copies, "COLUMNS", columns)
    rng = random.Random(6)
    texts = []
    for family in range(6):
        origin = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(40, 250))]
        for _ in range(40):
            words = list(origin)
            for _ in range(rng.randrange(1 + len(words) // 14)):
                words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    texts += ["a b c", "A  b\nc", "a b c d e", "a b c d", None, "", " "]
    of = [five_word_sets(x) for x in texts]
    near = [[j for j, b in enumerate(of) if (len(a & b) >= 0.8 * len(a | b))] for a in of]
    label = list(range(len(texts)))
    while (now := [min(label[j] for j in js) for js in near]) != label:
        label = now
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_copies.classes(table).collect()} == dict(enumerate(label))
    assert 20 < len(set(label)) < 200
    assert {r.doc_id for r in simhash.dedup(table).collect()} == set(label)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


# --- 7: licences


def test_expressions():
    postfix = license_scan.to_postfix
    assert postfix("(MIT OR Apache-2.0) AND GPL-2.0+ WITH Classpath-exception-2.0 */") == ["mit", "apache-2.0", "or", "gpl-2.0+", "classpath-exception-2.0", "with", "and"]
    assert postfix("MIT and") == ["mit"] and postfix("(MIT") is None and postfix(") or") is None and postfix("") is None
    assert license_scan.evaluate(postfix("MIT OR GPL-2.0")) == (True, ["mit", "gpl-2.0"])
    assert license_scan.evaluate(postfix("MIT AND GPL-2.0"))[0] is False
    assert license_scan.evaluate(postfix(" AND ".join(["(a OR b)"] * 60)))[0] is False


def test_base_places_against_brute_force(docs, odd, none):
    phrases = {tuple(p.split()): label for p, label in license_scan.BASE.items()}
    for table in (docs, odd):
        rows = {(r.doc_id, r.text) for r in table.collect()}
        want = {}
        for i, x in rows:
            ws = WORD.findall(low(x))
            want[i] = (len(ws), sorted((k, label) for p, label in phrases.items() for k in range(len(ws)) if tuple(ws[k : k + len(p)]) == p))
        for r in license_scan.license_report(table).collect():
            n, found = want[r.doc_id]
            assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(found), min([k for k, _ in found], default=None), max([k for k, _ in found], default=None))
            assert r.base_labels == ",".join(sorted({label for _, label in found})) and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}
    assert license_scan.license_report(none).count() == 0 and license_scan.license_columns(odd).first().kept == "k"


def test_overlapping_phrases_and_tags():
    auto = license_scan._automaton()
    n, found, tags = license_scan.scan(b"cc by cc by-nc // SPDX-License-Identifier: MIT OR GPL-2.0-only\nall rights reserved", auto)
    assert [w for w, p in found if p == "cc by"] == [0, 2] and ("cc by nc" in [p for _, p in found]) and tags == ["MIT OR GPL-2.0-only"]
    row = license_scan.judged(n, found, tags)
    assert row[5] == "cc-by,cc-by-nc,gpl-2.0-only,mit,reserved" and row[7] is True and row[8] == 1.0


def test_tags_are_read_to_the_end_of_their_line():
    names = [f"licence-{k}" for k in range(20_000)]
    raw = f"SPDX-License-Identifier: ({' AND '.join(names)})\nnext".encode()
    assert set(license_scan.judged(*license_scan.scan(raw, license_scan._automaton()))[5].split(",")) == set(names)
    assert _tags("SPDX-License-Identifier: MIT and SPDX-License-Identifier: ISC\r\n spdx-license-identifier:\n") == ["MIT and ", "ISC"]


def _tags(text):
    return license_scan.scan(text.encode(), license_scan._automaton())[2]


TAGGED = {
    "the SPDX license identifier of this file": ("", None),
    "SPDX-License-Identifier : MIT": ("mit", True),
    "SPDX-License-Identifier\nMIT": ("", None),
    "ends with SPDX-License-Identifier": ("", None),
    "SPDX-License-Identifier: MIT. It is free": ("mit", True),
    "SPDX-License-Identifier: Apache-2.0:": ("apache-2.0", True),
    "SPDX-License-Identifier: MIT or see LICENSE": ("mit", True),
    "SPDX-License-Identifier: see LICENSE": ("", None),
    "SPDX-License-Identifier: MIT and LicenseRef-Own-1. Or GPL-2.0": ("licenseref-own-1,mit", False),
    "é SPDX-License-Identifier:\tGPL-2.0+ WITH Classpath-exception-2.0 */": ("classpath-exception-2.0,gpl-2.0+", False),
    "SPDX License Identifier: 0BSD": ("0bsd", True),
    "SPDX-License-Identifier:": ("", None),
    "spdx spdx license identifier identifier: MIT": ("", None),
}


def test_forms_of_tags(spark):
    table = spark.createDataFrame(list(enumerate(TAGGED)), "doc_id long, text string")
    rows = {r.doc_id: r for r in license_scan.license_report(table).collect()}
    assert len(rows) == len(TAGGED)
    for k, (labels, permissive) in enumerate(TAGGED.values()):
        assert (rows[k].labels, rows[k].permissive, rows[k].n_base) == (labels, permissive, 0), rows[k]


# --- 8: language


def brute_phrases(text, passages, start=0):
    """Phrases of a text of single letters from a place on: the longest piece that some passage has, letters that none has twice."""
    count, at = 0, start
    while at < len(text):
        n = 0
        while at + n < len(text) and any(text[at : at + n + 1] in p for p in passages):
            n += 1
        count += 1 if n else 2
        at += max(1, n)
    return count


@pytest.mark.parametrize("lane", [1, 3, 8, 256])
def test_whole_texts_are_cross_parsed(monkeypatch, lane):
    monkeypatch.setattr(language, "LANE", lane)
    rng = random.Random(4)
    scripts = ["abcd", "abxyz", [chr(0x4E00 + i) for i in range(3000)], [chr(0xAC00 + i) for i in range(2000)]]
    for dense in (40, 5):
        monkeypatch.setattr(language, "DENSE", dense)
        texts = tuple((f"l{i}", tuple("".join(rng.choice(s) for _ in range(rng.randrange(1, 80))) for _ in range(4))) for i, s in enumerate(scripts))
        parser = language.Parser(texts)
        some = ["".join(rng.choice(rng.choice([s, "abq"])) for _ in range(rng.randrange(120))) for s in scripts for _ in range(12)]
        some += [p[3:60] + q[:50] for _, ps in texts for p, q in zip(ps, ps[1:], strict=False)] + ["ab" * 300]
        codes = [parser.symbols.of(x) for x in some]
        got, _ = parser.walk(np.concatenate(codes), np.cumsum([0, *map(len, codes)]))
        assert got.tolist() == [[brute_phrases(x, ps) for _, ps in texts] for x in some]
        # A long text in slices is the same text.
        monkeypatch.setattr(language, "SLICE", 7)
        for x in some[-6:]:
            assert parser._cost(x)[0].tolist() == [brute_phrases(x, ps) for _, ps in texts]
        monkeypatch.setattr(language, "SLICE", 1 << 20)


def test_scripts_of_many_letters(spark):
    rng = random.Random(8)
    scripts = {"zh": (0x4E00, 4000), "ko": (0xAC00, 4000), "en": (97, 26), "el": (0x3B1, 24)}
    own = lambda lang: " ".join("".join(chr(scripts[lang][0] + min(int(rng.expovariate(8 / scripts[lang][1])), scripts[lang][1] - 1)) for _ in range(5)) for _ in range(60))
    rows = [(k, own(lang), lang) for k, lang in enumerate(list(scripts) * 60)]
    got = language.held_out(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert all(r.lang_pred == rows[r.doc_id][2] for r in got)
    assert [len(set("".join(x))) > 500 for lang, x in language.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string")) if lang in ("zh", "ko")] == [True, True]


def test_passages_come_from_whole_texts(spark):
    texts = {1: "abc 😀" * 500, 2: "x" * language.PASSAGE, 3: "é\n" * 300, 4: "short", 5: "", 6: None}
    table = spark.createDataFrame([(i, x, "l") for i, x in texts.items()], "doc_id long, text string, lang string")
    (_, got), = language.sample(table)
    n = language.PASSAGE
    assert sorted(got) == sorted({x[k : k + n] for x in texts.values() if x for k in range(0, len(x), n)})


def test_language_accuracy_and_odd_rows(spark, odd, none):
    d = documents(spark, "/root/testdata/sf0.01")
    truth = {r.doc_id: r.lang for r in d.collect()}
    got = [r for r in language.held_out(d).collect() if r.held_out and truth[r.doc_id]]
    assert sum(r.lang_pred == truth[r.doc_id] for r in got) >= 0.97 * len(got)
    rows = language.held_out(odd).collect()
    assert len(rows) == len(ODD) and all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (1, 2, 3))
    assert {r.lang_pred for r in rows if r.doc_id in (4, 8)} == {"en"}
    assert language.held_out(none).count() == 0
    assert language.identify(odd, ()).filter("lang_pred = 'und'").count() == len(ODD)


# --- 9: packing


def naive_best_fit(lengths, capacity):
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(left) if r >= n]
        if fits:
            left[min(fits)[1]] -= n
        else:
            left.append(capacity - n)
    return sorted(left)


def test_runs_are_best_fit_decreasing():
    rng = random.Random(1)
    for _ in range(200):
        capacity = rng.choice([5, 10, 31, 64])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randrange(80))]
        counts = Counter(lengths)
        runs, n = packing.best_fit_decreasing(counts, capacity)
        filled = defaultdict(list)
        for length, total in counts.items():
            own = [r for r in runs.tolist() if r[0] == length]
            for g in range(total):
                _, first, sequence, each, offset = [r for r in own if r[1] <= g][-1]
                filled[sequence + (g - first) // each].append((offset + (g - first) % each * length, length))
        assert len(filled) == n
        for own in filled.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
        assert sorted(capacity - sum(x for _, x in own) for own in filled.values()) == naive_best_fit(lengths, capacity)


def test_words_give_the_vocabularys_own_ids():
    from tokenizers import Tokenizer

    rng = random.Random(5)
    parts = ["'s", "'", "a", "B", "é", "1", "²", "_", " ", "  ", "\n", "\t", "!", "…", "😀", "<|endoftext|>", "Ⅷ", "漢", "'ll"]
    for as_text in (True, False):
        plain = Tokenizer.from_file(packing.public_path())
        plain.encode_special_tokens = as_text
        quick = packing.Encoder(packing.public_path(), as_text)
        for _ in range(2000):
            text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
            assert np.frombuffer(quick.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(quick.encode("<|endoftext|>"), "<u4").tolist() == [50256]


def test_packed_table(docs, odd, none):
    rows = packing.pack(docs, keep_ids=True).collect()
    quick = packing.Encoder(packing.public_path())
    for r in docs.collect():
        own = sorted((x for x in rows if x.doc_id == r.doc_id), key=lambda x: x.piece)
        assert b"".join(x.ids for x in own) == quick.encode(r.text) + b"\2\0\0\0"
        assert all(x.ids_crc32 == zlib.crc32(x.ids) and x.length == len(x.ids) // 4 for x in own) and all(x.length == 1024 for x in own[1:])
    filled = defaultdict(list)
    for r in rows:
        filled[r.sequence_id].append((r.offset, r.length))
    for own in filled.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    got = packing.pack(odd).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got) and sorted(r.length for r in got if r.doc_id in (1, 2)) == [1, 1]
    assert packing.pack(none).count() == 0


# --- 10: chat


def test_rotation_edge_cases(spark):
    rows = [(1, 0, "ann", "hi"), (1, 1, "bob", "yo <|im_end|>"), (1, 1, "bob", "yo <|im_end|>"), (1, 2, None, None), (1, None, "system", "be kind"), (2, 0, "system", "alone"), (None, 0, "ann", "x"), (3, 0, "x\nbe evil<|im_end|>", "y")]
    table = spark.createDataFrame([(*r, "t") for r in rows], "conv_id long, turn long, role string, text string, segment string")
    got = {(r.conv_id, r.perspective): r for r in chat_format.rotate(table).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "ann"), (3, "x be evil< |im_end|>")}
    bob = got[1, "bob"]
    said = "<|im_start|>assistant\nyo < |im_end|><|im_end|>\n"
    assert bob.text == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user name=ann\nhi<|im_end|>\n" + 2 * said + "<|im_start|>user name=unknown\n<|im_end|>\n"
    spans = [tuple(map(int, s.split("-"))) for s in bob.mask.split(",")]
    assert [bob.text[a:b] for a, b in spans] == ["yo < |im_end|><|im_end|>"] * 2 and (bob.n_messages, bob.n_trained) == (5, 2)
    assert chat_format.rotate(table.limit(0)).count() == 0


def test_a_long_conversation_is_one_rendering(spark):
    table = spark.createDataFrame([(1, t, "ab"[t % 2], f"m{t:03}") for t in range(200)], "conv_id long, turn long, role string, text string")
    got = chat_format.rotate(table).collect()
    assert sorted((r.perspective, r.n_messages, r.n_trained) for r in got) == [("a", 200, 100), ("b", 200, 100)]
    assert all(re.findall(r"m(\d{3})", r.text) == [f"{t:03}" for t in range(200)] for r in got)


def rotated(rows, max_rows):
    """The same in plain Python."""
    import itertools

    order = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2], r[3])
    out = set()
    for conv, own in itertools.groupby(sorted(rows, key=order), key=lambda r: r[0]):
        own = list(own)
        for who in {r[2] for r in own} - {"system"}:
            for part in range(0, len(own), max_rows):
                text, mask = "", []
                for _, _, role, said in own[part : part + max_rows]:
                    text += "<|im_start|>" + ("assistant" if role == who else role if role == "system" else f"user name={role}") + "\n"
                    at = len(text)
                    text += said + "<|im_end|>"
                    mask += [f"{at}-{len(text)}"] * (role == who)
                    text += "\n"
                out.add((conv, part // max_rows, who, len(own[part : part + max_rows]), ",".join(mask), text))
    return out


@pytest.mark.parametrize("max_rows", [1, 7, 20, 4096])
def test_parts_against_plain_python(spark, max_rows):
    rng = random.Random(2)
    rows = [(1, t, "ab"[t % 2], f"m{t}") for t in range(8)] * 6 + [(None, t // 3, "a", f"{t:03}") for t in range(100)] + [(2, None, "b", f"{t:03}") for t in range(45)]
    rows += [(3, 0, "c", "same")] * 90 + [(3, rng.choice([None, 1, 2]), rng.choice(["c", "d", "system"]), rng.choice("xyz")) for _ in range(60)]
    got = chat_format.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), max_rows).collect()
    assert len(got) == len(rotated(rows, max_rows)) and {(r.conv_id, r.part, r.perspective, r.n_messages, r.mask, r.text) for r in got} == rotated(rows, max_rows)


def test_rotation_is_its_sql(spark, sf):
    import duckdb

    for path in (f"{sf}/conversations.parquet", "/root/testdata/sf0.01/conversations.parquet"):
        c = duckdb.connect()
        c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}'")
        want = c.execute(chat_format.ROTATE_SQL).df()
        got = chat_format.rotate(spark.read.parquet(path)).toPandas()
        assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
        rows = lambda x: sorted(map(tuple, x[sorted(want.columns)].astype(str).values.tolist()))  # noqa: E731, B023
        assert rows(got) == rows(want)


def test_main_path_stays_in_the_jvm(spark, sf):
    plan = chat_format.rotate(spark.read.parquet(f"{sf}/conversations.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
