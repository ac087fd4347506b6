"""Hashed logistic regression trained with follow-the-regularised-leader updates, and scored as sparse dot products.

Rows of a bounded sample are dealt by a hash of their id into SHARDS shards; each shard is one task that
makes passes over its rows' features, and the shards' weights are averaged. The weights have a fixed size, 2**bits,
and go to the scoring tasks with their closure. A text of more than LONG bytes is counted in pieces that are cut
at white space, so the memory it takes is its own bytes and the pieces', whatever its length."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, LOWER, NOT_SPACE, chunks, flat, mix, pair, small_batches, spans, word_hashes

#: Makes features: (bytes, offsets of texts, bits) -> text of each feature, its index from 1, and the number of tokens of each text.
Features = Callable[[np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray, np.ndarray]]
#: Shards whose weights are averaged, whatever the sample's size.
SHARDS = 2
#: Bytes of a text from which on it is counted in pieces of about PIECE bytes.
LONG, PIECE = 4 << 20, 1 << 20


@dataclass
class Ftrl:
    """Per-coordinate follow-the-regularised-leader (proximal) for logistic loss."""

    bits: int = 18
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.5
    l2: float = 1e-3
    epochs: int = 3
    z: np.ndarray = field(init=False)
    n: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.z = np.zeros(1 << self.bits)
        self.n = np.zeros(1 << self.bits)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def update(self, at: np.ndarray, x: np.ndarray, y: float, weight: float = 1.0) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
        g = (p - y) * weight * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


@dataclass(frozen=True)
class Kind:
    """How texts become vectors: their features, whether each counts once or as often as it stands, and the sum that a text's token features are scaled to (None: not scaled)."""

    features: Features
    bits: int = 18
    binary: bool = False
    share: float | None = None

    def scale(self, n: np.ndarray) -> np.ndarray:
        return np.ones(len(n)) if self.share is None else self.share / np.maximum(n, 1)


def pieces(raw: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A long text's pieces, each with the word before it in front, and that word alone."""
    at, before = 0, 0
    while at < len(raw):
        to, reach = min(at + PIECE, len(raw)), PIECE
        while to < len(raw):
            space = np.flatnonzero(~NOT_SPACE[raw[to : to + reach]])
            if len(space):
                to += int(space[0])
                break
            to, reach = min(to + reach, len(raw)), 2 * reach
        yield raw[before:to], raw[before:at]
        inside = np.flatnonzero(NOT_SPACE[raw[at:to]])
        if len(inside):
            last = at + int(inside[-1])
            space = np.flatnonzero(~NOT_SPACE[raw[at:last]])
            before = at + (int(space[-1]) + 1 if len(space) else 0)
        at = to


def long_counts(raw: np.ndarray, kind: Kind) -> tuple[np.ndarray, int]:
    """How often each index stands in a long text, and its number of tokens."""
    counts, n = np.zeros(1 << kind.bits, np.int64), 0
    for piece, before in pieces(raw):
        for part, sign in ((piece, 1), (before, -1)):
            _, index, tokens = kind.features(part, np.array([0, len(part)]), kind.bits)
            counts += sign * np.bincount(index, minlength=len(counts))
            n += sign * int(tokens[0])
    return counts, n


def examples(raw: np.ndarray, offs: np.ndarray, kind: Kind) -> list[tuple[np.ndarray, np.ndarray]]:
    """Indices and values of each text; index 0 is the constant."""
    if len(raw) > LONG and len(offs) > 2:
        return [e for a, b in zip(offs[:-1], offs[1:], strict=True) for e in examples(raw[a:b], np.array([0, b - a]), kind)]
    if len(raw) > LONG:
        dense, n = long_counts(raw, kind)
        found = [(np.flatnonzero(dense), dense[dense > 0])]
        scale = kind.scale(np.array([n]))
    else:
        text, index, n = kind.features(raw, offs, kind.bits)
        keys, counts = np.unique(text.astype(np.int64) << kind.bits | index, return_counts=True)
        cuts = np.searchsorted(keys, np.arange(len(offs)) << kind.bits)
        found = [(keys[a:b] & (1 << kind.bits) - 1, counts[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        scale = kind.scale(n)
    return [(np.append(at, 0), np.append((np.ones(len(c)) if kind.binary else c.astype(float)) * s, 1.0)) for (at, c), s in zip(found, scale, strict=True)]


def fit(rows: DataFrame, kind: Kind, l1: float = 1.0, **params) -> np.ndarray:
    """Weights learned from rows (doc_id, text, y), which must be a bounded sample: the mean of the weights of SHARDS shards; zeros for no rows. `l1` is the penalty at a thousand rows a shard, and goes with a shard's rows.

    Texts become sparse vectors where they lie; only those are dealt to the shards."""
    rows = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("y").cast("double").alias("y"), F.pmod(F.xxhash64(F.lit("shard"), "doc_id"), F.lit(SHARDS)).alias("shard"))
    small_batches(rows.sparkSession)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches):
            made = examples(*flat(table.column("text")), kind)
            at = pa.array([a.astype("<i4").tobytes() for a, _ in made], pa.binary())
            x = pa.array([x.astype("<f4").tobytes() for _, x in made], pa.binary())
            yield from table.drop_columns(["text"]).append_column("at", at).append_column("x", x).combine_chunks().to_batches()

    def one(table: pa.Table) -> pa.Table:
        # In order of ids and rows, so that a task that runs again learns the same. Vectors stay where Arrow has them: no object a row.
        table = table.sort_by([("doc_id", "ascending"), ("y", "ascending"), ("at", "ascending"), ("x", "ascending")])
        y = table.column("y").to_numpy()
        (at, cuts), (x, _) = (flat(table.column(c)) for c in ("at", "x"))
        del table
        at, x, cuts = at.view("<i4"), x.view("<f4"), cuts // 4
        model = Ftrl(bits=kind.bits, l1=l1 * len(y) / 1000, **params)
        dealt = np.random.default_rng(7)
        for _ in range(model.epochs):
            for i in dealt.permutation(len(y)):
                own = slice(cuts[i], cuts[i + 1])
                model.update(at[own], x[own].astype(float), y[i])
        out = pa.table({"n": [len(y)], "w": [model.weights().astype(np.float32).tobytes()]})
        del at, x, model
        pa.default_memory_pool().release_unused()
        return out

    schema = T.StructType([f for f in rows.schema.fields if f.name != "text"]).add("at", "binary").add("x", "binary")
    # SHARDS rows of 2**bits weights.
    found = rows.mapInArrow(vectors, schema).groupBy("shard").applyInArrow(one, "n long, w binary").collect()
    total = sum(r["n"] for r in found)
    mean = np.zeros(1 << kind.bits)
    for r in sorted(found, key=lambda r: r["w"]):
        mean += np.frombuffer(r["w"], np.float32) * (r["n"] / total)
    return mean.astype(np.float32)


def dot(raw: np.ndarray, offs: np.ndarray, kind: Kind, weights: np.ndarray) -> np.ndarray:
    """The linear score of each text."""
    if len(raw) > LONG:
        return np.array([float(weights[at].astype(float) @ x) for at, x in examples(raw, offs, kind)])
    text, index, n = kind.features(raw, offs, kind.bits)
    w = weights[index]
    text, index, w = text[w != 0], index[w != 0], w[w != 0]
    if kind.binary:
        _, first = np.unique(text.astype(np.int64) << kind.bits | index, return_index=True)
        text, w = text[first], w[first]
    return np.bincount(text, weights=w, minlength=len(offs) - 1) * kind.scale(n) + float(weights[0])


def score(docs: DataFrame, kind: Kind, weights: np.ndarray, name: str = "score") -> DataFrame:
    """docs (any columns, with text) and their score, 0 to 1. One pass, no shuffle. A column of that name is replaced."""
    docs = docs.drop(name)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches):
            z = dot(*flat(table.column("text")), kind, weights)
            out = table.append_column(name, pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
            yield from out.combine_chunks().to_batches()

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return docs.mapInArrow(run, schema)


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """ids, which must be a bounded table, with `text`: of documents that share an id the text that comes first, so that no id brings more than a row."""
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy(*ids.columns).agg(F.min("text").alias("text"))


def labelled(docs: DataFrame, labels: DataFrame, label: str, keep: Column, most: int) -> DataFrame:
    """(doc_id, text, y): at most `most` labels of those that `keep` (over doc_id) lets through, those whose hashed ids come first. Null labels and ids don't count; repeated ones count once."""
    ids = (
        labels.select("doc_id", F.col(label).cast("double").alias("y"))
        .filter(F.col("y").isNotNull() & F.col("doc_id").isNotNull())
        .filter(keep)
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id", "y")
        .limit(most)
    )
    return _texts_of(docs, ids).select("doc_id", "text", "y")


def unlabelled(docs: DataFrame, keep: Column, most: int) -> DataFrame:
    """(doc_id, text, y) of at most `most` documents, whatever their labels, those whose hashed ids come first; y is null."""
    ids = docs.select("doc_id").filter(F.col("doc_id").isNotNull()).filter(keep).orderBy(F.xxhash64(F.lit("any"), "doc_id"), "doc_id").limit(most).distinct()
    return _texts_of(docs, ids).select("doc_id", "text", F.lit(None).cast("double").alias("y"))


def sketches(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Two least hashes of a text's three-word shingles as one number; texts that are nearly the same mostly share it, others hardly."""
    low = LOWER[raw]
    starts, ends, cuts = spans(low, offs, ALNUM)
    h = word_hashes(low, starts, ends)
    n = np.diff(cuts)
    whole = np.arange(len(h)) + 2 < np.repeat(cuts[1:], n)
    short = np.repeat(n < 3, n)
    h = np.where(whole, pair(pair(h, np.roll(h, -1)), np.roll(h, -2)), np.where(short, h, np.uint64(0xFFFFFFFFFFFFFFFF)))
    out = np.zeros(len(offs) - 1, np.uint64)
    own = cuts[:-1] < cuts[1:]
    if own.any():
        at = cuts[:-1][own]
        out[own] = pair(np.minimum.reduceat(h, at), np.minimum.reduceat(mix(h ^ np.uint64(5)), at))
    return out


def varied(rows: DataFrame) -> DataFrame:
    """Of the sample rows with the same sketch and label only the one with the smallest id, so that a group of copies counts once and its chance words aren't learned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches):
            yield from table.append_column("sketch", pa.array(sketches(*flat(table.column("text"))).view(np.int64))).combine_chunks().to_batches()

    small_batches(rows.sparkSession)
    marked = rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("sketch", T.LongType())]))
    return marked.groupBy("sketch", "y").agg(F.min(F.struct(*rows.columns)).alias("row")).select("row.*")
