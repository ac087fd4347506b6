"""Piece encoding, phrase collocations and centroid clustering against the library, plain counting and whole-number arithmetic."""

import hashlib
import random
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tallyfold.llm import centroids, collocations, queries, sentence_pieces
from tallyfold.llm.common import documents

DOCS = "doc_id long, text string, lang string, source string"
ODD_TEXTS = [None, "", " ", "   ", "\n", "a", "▁", "▁▁ a▁b", "\x00", "a\x00b", "漢字 かな", "é", "😀 ok", "x" * 3000, "ab " * 2000, "no,space.here;or:there", "\t tab\tbed", "�", "  two  spaces  ", "A a\nA a"]


# --- pieces


@pytest.fixture(scope="module")
def library():
    return sentence_pieces.library_of(sentence_pieces.public_path())


@pytest.fixture(scope="module")
def model():
    return sentence_pieces.PieceModel(sentence_pieces.public_path())


def _split(encoded):
    flat, offs, same = encoded
    return [flat[a:z].tolist() for a, z in zip(offs, offs[1:])], same


def test_pieces_of_odd_texts(model, library):
    ids, same = _split(model.encode([t or "" for t in ODD_TEXTS], library))
    assert ids == library.encode([t or "" for t in ODD_TEXTS]) and same.all()
    assert [model.decode(i) for i in ids] == library.decode(ids)


@pytest.mark.parametrize("letters", [" ab\n▁é漢0\x00", "the of and ▁  ing", "".join(map(chr, [*range(0x250), *range(0x4E00, 0x4E40), 0x1F600, 0x3000]))])
def test_pieces_of_random_texts(model, library, letters):
    rng = random.Random(5)
    texts = ["".join(rng.choices(letters, k=rng.choice([0, 1, 4, 30, 90]))) for _ in range(600)]
    ids, same = _split(model.encode(texts, library))
    assert ids == library.encode(texts) and same.all()


def test_both_agendas_agree(model):
    rng = random.Random(6)
    cuts = ["".join(rng.choices("▁aehinrst", k=rng.randint(1, 40))) for _ in range(800)]
    assert [np.frombuffer(x, "<i4").tolist() for x in model.merged_together(cuts)] == [model.merged(c) for c in cuts]


def test_any_ids_decode(model, library):
    rng = random.Random(7)
    for _ in range(4000):
        ids = [rng.choice([rng.randrange(len(model.text)), rng.randrange(262), rng.choice([0, 1, 2])]) for _ in range(rng.randrange(8))]
        assert model.decode(ids) == library.decode(ids)


def test_a_wrong_cut_is_told(library):
    wrong = sentence_pieces.PieceModel(sentence_pieces.public_path())
    wrong.pairs = wrong.pairs[:0]  # nothing merges
    _, _, same = wrong.encode(["something here", "", "a"], library)
    assert same.tolist() == [False, True, False]


def test_memory_of_cuts_is_bounded(model, monkeypatch):
    monkeypatch.setattr(sentence_pieces, "REMEMBERED_BYTES", 20_000)
    small = sentence_pieces.PieceModel(sentence_pieces.public_path())
    texts = [f"w{k} v{k * 7}" for k in range(500)] * 2
    assert _split(small.encode(texts))[0] == _split(model.encode(texts))[0]
    for k in range(0, len(texts), 50):
        small.encode(texts[k : k + 50])
    assert len(small.remembered) + len(small.aside) < 400


def test_other_models_are_refused(tmp_path):
    bad = tmp_path / "unigram.model"
    bad.write_bytes(b"\x0a\x08\x0a\x01a\x15\x00\x00\x00\x00\x12\x02\x18\x01")
    with pytest.raises(ValueError):
        sentence_pieces.PieceModel(str(bad))


def test_encode_table(spark, library):
    docs = spark.createDataFrame([Row(k, t, "en", "s") for k, t in enumerate(ODD_TEXTS)] + [Row(None, "again", None, None)] * 2, DOCS).withColumn("ids", F.lit(1)).withColumn("decoded", F.lit("x"))
    rows = sentence_pieces.encode(docs, check="texts").collect()
    assert len(rows) == len(ODD_TEXTS) + 2 and all(r.agrees for r in rows)
    by_id = {r.doc_id: r for r in rows}
    assert all(by_id[k].ids == library.encode(t or "") for k, t in enumerate(ODD_TEXTS))
    back = {r.doc_id: r.text for r in sentence_pieces.decode(sentence_pieces.encode(docs)).collect()}
    assert all(back[k] == by_id[k].decoded for k in by_id)
    assert sentence_pieces.encode(docs.limit(0)).count() == 0
    assert {r.agrees for r in sentence_pieces.encode(docs, check=None).collect()} == {None}


def test_op11_whole_table(spark, sf, library):
    texts = {r.doc_id: r.text or "" for r in documents(spark, sf).collect()}
    rows = queries.op11_sentencepiece(spark, sf).collect()
    assert len(rows) == len(texts) and all(r.agrees for r in rows)
    for r in rows:
        ids = library.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


# --- collocations


def _plain(rows, longest=3, least=10, share=50, top=2000):
    """What `mine` says, by counting everything."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for c in ".,;:!?\n\x0b\x0c\r":
            low = low.replace(c, "\n")
        for piece in low.split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    found = [(lang, p, a) for (lang, p), a in f.items() if len(p) > 1 and a >= least]
    longer = Counter()
    for lang, p, a in found:
        for x in (p[:-1], p[1:]):
            longer[lang, x] = max(longer[lang, x], a)
    out = {}
    for lang, p, a in found:
        if 100 * longer[lang, p] >= share * a:
            continue
        cuts = [(Fraction(10**6 * a * a, f[lang, p[:k]] * f[lang, p[k:]]).__floor__(), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], k))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s, k) for lang, x in out.items() for i, (s, a, p, l, r, k) in enumerate(sorted(x)[:top]))


def _mined(docs, **how):
    return sorted(tuple(r) for r in collocations.mine(docs, **how).collect())


WORDS = ["the", "The", "of", "a", "\x01b", "é", "漢", "x-y", "“q”", "\x00"]


def _random_docs(spark, n, seed=3):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        words = rng.choices(WORDS, weights=[9, 2, 6, 5, 1, 2, 1, 1, 1, 1], k=rng.choice([0, 1, 2, 12, 60]))
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", "\n", ". ", "\r", "\x0b"]) for w in words)
        rows.append((k, rng.choice([text, text, text, None]), rng.choice(["en", "en", "de", None, "und"]), "s"))
    return rows, spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("how", [{}, {"longest": 4, "least": 3, "top": 50}, {"longest": 2, "least": 1, "top": 30}])
def test_collocations_against_counting(spark, how, monkeypatch):
    rows, docs = _random_docs(spark, 400)
    assert _mined(docs.withColumn("phrase", F.lit("p")).withColumn("f", F.lit(1)), **how) == _plain([(r[1], r[2]) for r in rows], **{k: how[k] for k in how})


def test_streams_cut_within_a_word(spark, monkeypatch):
    """Many parts, so that cuts fall within one first word: parts must stand alone."""
    rng = random.Random(4)
    rows = [(k, " ".join("hot " + rng.choice("abcdefghij") + " " + rng.choice("klmnopqrst") for _ in range(40)), "en", "s") for k in range(150)]
    docs = spark.createDataFrame(rows, DOCS)
    monkeypatch.setattr(collocations, "PART_ROWS", 8)
    assert _mined(docs, least=5) == _plain([(r[1], r[2]) for r in rows], least=5)


def test_crowded_bitmap_only_counts_more(spark, monkeypatch):
    rows, docs = _random_docs(spark, 200, seed=8)
    want = _mined(docs)
    monkeypatch.setattr(collocations, "MOST_BITS", 64)
    monkeypatch.setattr(collocations, "CHUNK_TEXT", 500)
    assert _mined(docs) == want == _plain([(r[1], r[2]) for r in rows])


def test_collocations_of_nothing(spark):
    docs = spark.createDataFrame([(1, None, "en", "s"), (2, "", None, None), (3, "..., !", "en", "s")], DOCS)
    assert _mined(docs) == [] and _mined(docs.limit(0)) == []


def test_large_counts_stay_exact(spark):
    """Products beyond 64 bits."""
    a = 3_037_000_500_123
    levels = spark.createDataFrame([("en", "x", a + 7), ("en", "y", a + 9), ("en", "x y", a)], "lang string, phrase string, f long")
    totals = spark.createDataFrame([("en", 3 * a)], "lang string, n long")
    real = collocations.counts
    try:
        collocations.counts = lambda *_: (levels, totals)
        (row,) = collocations.mine(spark.createDataFrame([], DOCS)).collect()
    finally:
        collocations.counts = real
    assert row.score == 10**6 * a * a // ((a + 7) * (a + 9))


def test_op12_whole_table(spark, sf):
    rows = [(r.text, r.lang) for r in documents(spark, sf).collect()]
    assert sorted(tuple(r) for r in queries.op12_collocations(spark, sf).collect()) == _plain(rows)


# --- centroids


def _clusters(rows, k=16, dims=64, rounds=3, scale=64):
    kept = [(i, [x.__floor__() for x in (Fraction(v) * scale for v in vec)]) for i, vec in rows if vec is not None and len(vec) == dims and all(v is not None and np.isfinite(v) for v in vec)]
    seeds = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]
    centres = [list(v) for _, v in seeds]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(near(v)[1], []).append(v)
        centres = [[sum(x) // len(x) for x in zip(*own[j])] if j in own else c for j, c in enumerate(centres)]
    out = [(i, j, d) for i, v in kept for d, j in [near(v)]]
    sums = Counter()
    for _, j, d in out:
        sums[j] += d
    fits = lambda x: x if x < 1 << 63 else None
    return sorted((i if i is not None else -1, j, fits(d), fits(sums[j]), fits(sum(sums.values())), hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()) for i, j, d in out)


def _table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cluster", F.lit("x")).withColumn("distance", F.lit(None).cast("string"))


def _clustered(df, **how):
    key = lambda r: tuple(-1 if x is None else x for x in r)
    return sorted(((-1 if r[0] is None else r[0], *r[1:]) for r in centroids.cluster(df, **how).collect()), key=key)


def test_centroids_with_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(k, [float(np.float32(x)) for x in rng.normal(0, 0.4, 6)]) for k in range(300)]
    nan, inf = float("nan"), float("inf")
    rows += [(900, None), (901, []), (902, [1.0] * 5), (903, [1.0] * 7), (904, [nan, *[0.0] * 5]), (905, [inf, *[0.0] * 5]), (906, [-inf, *[0.0] * 5]), (907, [None, *[0.0] * 5])]
    rows += [(908, [-0.0] * 6), (909, [0.0] * 6), (5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1])] + [(910 + k, [0.25] * 6) for k in range(50)]
    assert _clustered(_table(spark, rows), k=7, dims=6) == _clusters(rows, 7, 6)


def test_ties_favour_the_smaller_number():
    pairs = centroids.Bisectors([[0, 0], [2, 0], [0, 2], [0, 0]])
    best, distance = pairs.nearest(np.array([[1, 0], [1, 1], [0, 1], [0, 0], [2, 2]]))
    assert best.tolist() == [0, 0, 0, 0, 1] and distance.tolist() == [1, 2, 1, 0, 4]


def test_tournament_against_all_distances():
    rng = np.random.default_rng(3)
    for wide in (1, 1 << 40):
        cs = rng.integers(-4, 5, (12, 5)) * wide
        vs = rng.integers(-4, 5, (400, 5)) * wide
        kind = object if wide > 1 else np.int64
        best, distance = centroids.Bisectors(cs.tolist()).nearest(vs.astype(kind))
        d = ((vs[:, None].astype(object) - cs[None].astype(object)) ** 2).sum(2)
        assert best.tolist() == [min(range(12), key=lambda j: (row[j], j)) for row in d] and [int(x) for x in distance] == [min(row) for row in d]


def test_huge_components_stay_exact(spark):
    rows = [(k, [float(np.float32(x)) for x in v]) for k, v in enumerate([[1e30, 1.0], [1e30, 2.0], [3e38, -3e38], [1e6, -1e6], [0.1, 0.2], [0.1, -0.2], [5.0, 5.0]])]
    assert _clustered(_table(spark, rows), k=3, dims=2) == sorted(_clusters(rows, 3, 2), key=lambda r: tuple(-1 if x is None else x for x in r))


def test_few_and_no_vectors(spark):
    rows = [(1, [0.5, 0.5]), (2, [0.5, 0.5])]
    assert _clustered(_table(spark, rows), k=5, dims=2) == _clusters(rows, 5, 2)
    empty = centroids.cluster(_table(spark, [(1, [0.5])]), dims=2)
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert centroids.fit(_table(spark, []), dims=2) == []


def test_op13_whole_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op13_centroids(spark, sf).collect()) == _clusters(rows)


@pytest.mark.parametrize("name", ["op12_collocations", "op13_centroids"])
def test_sql_says_the_same(spark, sf, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rows = getattr(queries, name)(spark, sf)
    said = db.sql(queries.oracle_sql()[name])
    assert said.columns == rows.columns and sorted(map(tuple, rows.collect())) == sorted(said.fetchall())


# --- media that is cut or broken


def _gif():
    from tallyfold.llm import media_gif

    return media_gif.write_gif(media_gif.payload_of("some text " * 90)[1])


def test_a_gif_cut_at_every_byte_has_one_row(spark):
    from tallyfold.llm import media_gif

    gif = _gif()
    cuts = [(k, gif[:k]) for k in [*range(0, 900), *range(900, len(gif), 7), len(gif)]]
    assert media_gif.fault(gif) is None and all(media_gif.fault(g) for k, g in cuts if k < len(gif))
    rows = media_gif.frame_rows(spark.createDataFrame(cuts[:40] + cuts[-3:], "k int, media binary")).select("k", "frame", "error").collect()
    assert sorted(r.k for r in rows if r.error) == sorted(k for k, _ in cuts[:40] + cuts[-3:-1]) and [r.k for r in rows if r.frame == 0] == [len(gif)]


def test_broken_and_huge_gifs_have_an_error():
    import struct

    from tallyfold.llm import media_gif

    gif = _gif()
    head = b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0x80, 0, 0) + bytes(6)
    odd = {
        "huge screen": head + b";",
        "huge frame": b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0x80, 0, 0) + bytes(6) + b"," + struct.pack("<HHHHB", 0, 0, 65535, 65535, 0) + b"\x02\x00;",
        "no frames": b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0x80, 0, 0) + bytes(6) + b";",
        "half a palette": gif[:100],
        "third of a colour": gif[:101],
        "nothing": b"",
        "text": b"GIF, it says",
    }
    assert all(media_gif.fault(g) for g in odd.values())
    rng = random.Random(9)
    for _ in range(300):
        broken = bytearray(gif)
        broken[rng.randrange(len(gif))] = rng.randrange(256)
        media_gif.fault(bytes(broken))  # an error or other pictures, never an exception
