"""The pipeline's stages in a row, on a small table with planted cases."""

import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from tallyfold.llm import decontaminate, near_copies
from tallyfold.llm.common import documents, written


def test_stages(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    docs = documents(spark, sf)
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = written(stage(spark, docs, sf), f"test-{name}")
        seen[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "packing":
            assert docs.columns == columns
        if name == "decontaminate":
            assert decontaminate.report(docs, bench).filter("contaminated").count() == 0
            assert docs.count() == before.count()
    bad = {i for i, r in labels.items() if r.quality == 0}
    fine = {i for i, r in labels.items() if r.quality == 1}
    assert len(bad & seen["quality"]) <= 0.05 * len(bad) and len(fine & seen["quality"]) >= 0.98 * len(fine)
    assert seen["packing"] == seen["decontaminate"] == seen["simhash"] < seen["toxicity"] < seen["quality"]


def test_run_is_its_stages(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.count() > 0


def test_stages_against_brute_force(spark, sf):
    """Each stage on what the one before kept: near copies by all pairs of texts, passages by all windows, packed tokens by the vocabulary itself."""
    from collections import defaultdict

    import numpy as np
    from tokenizers import Tokenizer

    from tallyfold.llm import packing

    from .test_operators import brute_hits, five_word_sets, naive_best_fit

    stages = dict(corpus_pipeline.STAGES)
    docs = written(stages["toxicity"](spark, written(stages["quality"](spark, documents(spark, sf), sf), "q"), sf), "t")
    rows = {r.doc_id: r.text for r in docs.collect()}
    of = {i: five_word_sets(x) for i, x in rows.items()}
    label = {i: i for i in rows}
    near = {i: [j for j, b in of.items() if len(a & b) >= 0.8 * len(a | b)] for i, a in of.items()}
    while (now := {i: min(label[j] for j in js) for i, js in near.items()}) != label:
        label = now
    kept = written(stages["simhash"](spark, docs, sf), "s")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(label.values()))
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = written(stages["decontaminate"](spark, kept, sf), "d")
    texts = {r.doc_id: r.text for r in clean.collect()}
    hit = {i: h for i, (_, h, _) in zip(set(label.values()), brute_hits([rows[i] for i in set(label.values())], items), strict=True)}
    assert all((texts[i] == rows[i]) == (not hit[i]) for i in texts) and not any(h for _, h, _ in brute_hits(list(texts.values()), items))
    plain = Tokenizer.from_file(packing.public_path())
    plain.encode_special_tokens = True
    pieces = defaultdict(list)
    for r in stages["packing"](spark, clean, sf).collect():
        pieces[r.sequence_id].append(r.length)
    lengths = [n for x in texts.values() for _, n in packing.cut(len(plain.encode(x, add_special_tokens=False).ids) + 1)]
    assert sorted(x for own in pieces.values() for x in own) == sorted(lengths) and max(map(sum, pieces.values())) <= 1024
    assert len(pieces) == len(naive_best_fit(lengths, 1024)) >= np.ceil(sum(lengths) / 1024)


def low_copies(n: int) -> list[str]:
    """Texts and near copies of them, just over a similarity of 0.8; the least have four shingles and five."""
    rng = random.Random(9)
    texts = []
    for k in range(n):
        words = [f"w{rng.randrange(10**6)}" for _ in range(100 if k % 2 else 9)]
        copy = list(words) if k % 2 else words[:-1]
        for at in (30, 70) if k % 2 else ():
            copy[at] = f"e{k}"
        texts += [" ".join(words), " ".join(copy)]
    return texts


def test_fingerprints_are_simhash():
    for s in near_copies.sets(pa.array([*low_copies(4), " ".join(f"v{k}" for k in range(900))])):
        got = int.from_bytes(near_copies.fingerprint(s, 3).tobytes(), "little")
        every = [int(x) for x in s] + [int(near_copies._COMMON)]
        seeds = near_copies.mix(np.arange(1, 4, dtype=np.uint64))
        hashes = [int.from_bytes(near_copies.mix(np.array([x], np.uint64) ^ seeds).tobytes(), "little") for x in every]
        assert got == sum(1 << b for b in range(192) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        bits, n = 5, 30
        cut = [got >> bits * k & (1 << bits) - 1 for k in range(n)]
        assert near_copies.keys(near_copies.fingerprint(s, 3), bits, n).tolist() == [k << 32 | x for k, x in enumerate(cut)]


@pytest.mark.parametrize("block", [near_copies.KEY_BLOCK, 25])
def test_near_copies_come_from_simhash(spark, sf, monkeypatch, block):
    """The stage's candidates are fingerprints few bits apart, also where a key is cut into blocks; without them only equal sets go."""
    monkeypatch.setattr(near_copies, "KEY_BLOCK", block)
    texts = [*low_copies(60), "a b c", "A  b\nc"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    distinct = dict(corpus_pipeline.STAGES)["simhash"]
    assert {r.doc_id for r in distinct(spark, table, sf).collect()} == set(range(0, 122, 2))
    knots = near_copies.knots
    monkeypatch.setattr(near_copies, "knots", lambda nodes: knots(nodes, -1))
    assert {r.doc_id for r in distinct(spark, table, sf).collect()} == set(range(121))
