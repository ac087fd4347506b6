"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model that estimates their
accuracies and correlations from their votes alone, and a linear classifier trained on its posterior labels.

Voters are fixed lexicons, lexicons of words and of word beginnings that mark toxic rows of a bounded labelled
sample, and patterns of writing; each votes toxic, clean or not at all. The sample is halved: the lexicons
grown on the labels of one half vote on the other half only, and on unlabelled documents, so no label comes
back from a voter that was read off it. The label model has two classes; within each a voter's vote depends on
the vote of one other voter (or on none), the forest of these dependencies being that of the greatest conditional
information; it is fitted by expectation maximisation on counts of vote patterns. The classifier
sees the words and word beginnings of a text, each once, and learns from the posteriors of all voted rows.

Cases: null and empty texts have the constant feature only; null labels are left out; repeated label rows count
once, and of documents that share an id the text that comes first is learned from; with no labels the fixed
lexicons and the patterns vote alone, and with no documents to learn from every score is PRIOR, so that
`keep_clean` then keeps all; other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import linear
from .common import ALNUM, LOWER, chunks, flat, fold, mix, small_batches, spans, unused, word_hashes, written

#: At most so many labelled documents, and documents of any kind, are learned from.
MOST_LABELLED = 12_000
MOST_UNLABELLED = 12_000
#: Lengths in bytes of the word beginnings that are features.
STEMS = (4, 5, 6)
BITS = 20
#: The chance of toxic when nothing is known.
PRIOR = 0.05

# English lexicons.
LEXICONS = {
    "insult": "idiot moron stupid dumb fool imbecile clown loser jerk dimwit halfwit",
    "contempt": "scum trash garbage worthless pathetic disgusting filth vermin pig rat",
    "threat": "kill hurt destroy hang shoot burn beat crush",
}
#: Lexicons that are grown on labels: words that many toxic texts have, rarer ones that no other text has, rarer ones that some others have, and word beginnings of each length.
GROWN = ["common words", "rare words", "doubtful words", *[f"beginnings of {k}" for k in STEMS]]
#: Share of toxic texts from which a word is common.
COMMON = 0.05
PATTERNS = ["shouting", "several", "none"]


def _hash_words(words: list[str]) -> np.ndarray:
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends, _ = spans(raw, np.array([0, len(raw)]), ALNUM)
    return word_hashes(raw, starts, ends)


def hashed(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """The text of each word; hashes of the words, then of their beginnings of each length (0 for a word that isn't longer); each text's number of words."""
    low = LOWER[raw]
    starts, ends, cuts = spans(low, offs, ALNUM)
    n = np.diff(cuts)
    text = np.repeat(np.arange(len(n)), n)
    kinds = [word_hashes(low, starts, ends)]
    for k in STEMS:
        h = mix(word_hashes(low, starts, np.minimum(starts + k, ends)) ^ np.uint64(k))
        kinds.append(np.where(ends - starts > k, h, np.uint64(0)))
    return text, kinds, n


def features(raw: np.ndarray, offs: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    text, kinds, n = hashed(raw, offs)
    where = np.concatenate([text[k != 0] for k in kinds])
    index = (np.concatenate([k[k != 0] for k in kinds]) & np.uint64((1 << bits) - 1)).astype(np.int64)
    return where, np.maximum(index, 1), n


KIND = linear.Kind(features, BITS, binary=True)


def names() -> list[str]:
    return [*LEXICONS, *GROWN, *PATTERNS]


@dataclass
class Voters:
    """What the lexicon voters look for: sorted hashes with the voter each belongs to."""

    hashes: np.ndarray
    group: np.ndarray

    def hits(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """A row per text: how often each lexicon's words stand in it."""
        if len(raw) > linear.LONG and len(offs) == 2:
            return sum(self.hits(piece[len(before) :], np.array([0, len(piece) - len(before)])) for piece, before in linear.pieces(raw))
        text, kinds, _ = hashed(raw, offs)
        hits = np.zeros((len(offs) - 1, len(LEXICONS) + len(GROWN)), np.int64)
        for h in kinds if len(self.hashes) else ():
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            found = np.flatnonzero(self.hashes[at] == h)
            np.add.at(hits, (text[found], self.group[at[found]]), 1)
        return hits

    def votes(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """A row per text, a column per voter: 1 toxic, -1 clean, 0 no vote."""
        hits = self.hits(raw, offs)
        words = hits[:, : len(LEXICONS) + 3].sum(1)
        share = self._capitals(raw, offs) / np.maximum(np.diff(offs), 1)
        patterns = [(share > 0.4) & (words > 0), words >= 3, -1 * (hits.sum(1) == 0)]
        return np.column_stack([hits > 0, *patterns]).astype(np.int8)


    @staticmethod
    def _capitals(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        if len(offs) == 2:
            parts = (raw[at : at + linear.PIECE] for at in range(0, len(raw), linear.PIECE))
            return np.array([sum(int(((p >= 65) & (p <= 90)).sum()) for p in parts)])
        capitals = np.zeros(len(raw) + 1, np.int32)
        np.cumsum((raw >= 65) & (raw <= 90), out=capitals[1:])
        return capitals[offs[1:]] - capitals[offs[:-1]]


def _distinct(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and kind (0 a word, then beginnings by length) of all that stands in each text, once a text."""
    text, kinds, _ = hashed(raw, offs)
    out = []
    for kind, h in enumerate(kinds):
        order = np.lexsort((text, h))
        hs, ts = h[order], text[order]
        fresh = np.ones(len(hs), bool)
        fresh[1:] = (hs[1:] != hs[:-1]) | (ts[1:] != ts[:-1])
        fresh &= hs != 0
        out.append((hs[fresh], np.full(fresh.sum(), kind)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


#: Grown words at most, and what they need: toxic texts that have them, and log odds of toxic against other texts.
MOST_MARKS, LEAST_TEXTS, LEAST_ODDS = 4_000, 4, 3.0


def grown(rows: DataFrame) -> Voters:
    """Lexicon voters: the fixed ones and those grown on rows (doc_id, text, y) of the bounded sample, whose labels count."""

    def marks(batches):
        # Only what stands in a toxic text can be a mark; rows of one batch are counted before they are sent.
        for table in chunks(batches):
            for toxic in (True, False):
                part = table.filter(pa.compute.equal(pa.compute.greater_equal(table.column("y"), 0.5), toxic))
                if part.num_rows:
                    h, kind = _distinct(*flat(part.column("text")))
                    keys, first, n = np.unique(h, return_index=True, return_counts=True)
                    yield pa.RecordBatch.from_pydict({"h": keys.view(np.int64), "kind": kind[first].astype(np.int32), "toxic": n * toxic, "other": n * (not toxic)})

    small_batches(rows.sparkSession)
    totals = rows.agg(F.sum((F.col("y") >= 0.5).cast("long")), F.count(F.lit(1))).first()
    toxic, other = totals[0] or 0, (totals[1] or 0) - (totals[0] or 0)
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("other") + 0.5) / (other + 1))
    # MOST_MARKS short rows at most.
    found = (
        rows.select(F.coalesce("text", F.lit("")).alias("text"), "y")
        .mapInArrow(marks, "h long, kind int, toxic long, other long")
        .groupBy("h", "kind")
        .agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
        .filter((F.col("toxic") >= LEAST_TEXTS) & (odds >= LEAST_ODDS))
        .orderBy(odds.desc(), "h")
        .limit(MOST_MARKS)
        .collect()
    )
    groups: dict[int, int] = {}
    for r in found:
        kind = 2 + r["kind"] if r["kind"] else 0 if r["toxic"] >= COMMON * toxic else 2 if r["other"] else 1
        groups[r["h"] % (1 << 64)] = len(LEXICONS) + kind
    for g, words in enumerate(LEXICONS.values()):
        for h in _hash_words(words.split()):
            groups[int(h)] = g
    order = sorted(groups)
    return Voters(np.array(order, np.uint64), np.array([groups[h] for h in order], np.int64))


#: Rows that the prior on votes is worth, rows that what both classes say is worth for a dependent vote, and the chances of votes -1, 0 and 1 that it expects in clean and toxic texts.
WORTH, POOLED = 30.0, 5.0
EXPECTED = np.array([[0.3, 0.69, 0.01], [0.01, 0.69, 0.3]])
#: Conditional information from which on two voters count as dependent: in nats a row, and twice that over all rows (a chance in a thousand for independent voters).
LEAST_INFORMATION, LEAST_EVIDENCE = 1e-3, 18.5


@dataclass
class LabelModel:
    """Two classes and a forest: parent[j] is the voter that j's vote depends on within a class, or -1; vote[c, j, u, v] is j's chance of vote v - 1 in class c when its parent votes u - 1 (the same for all u without a parent)."""

    prior: float
    vote: np.ndarray
    parent: np.ndarray

    @classmethod
    def fit(cls, patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> LabelModel:
        """Expectation maximisation over distinct vote patterns, from the balance of the votes that were cast; no label is used. The forest is looked for anew every ten rounds, and is empty in the first ten. A prior worth WORTH rows says that voters are better than chance."""
        shown = np.stack([patterns == v for v in (-1, 0, 1)], 2).astype(float)
        says = (patterns > 0).sum(1) - (patterns < 0).sum(1)
        q = np.clip(1 / (1 + np.exp(-2.0 * says)), 0.02, 0.98)
        parent = np.full(patterns.shape[1], -1)
        for step in range(rounds):
            if step and step % 10 == 0:
                parent = forest(shown, counts, q)
            model = cls._maximised(shown, counts, q, parent)
            q = model.posterior(patterns)
        return model

    @classmethod
    def _maximised(cls, shown: np.ndarray, counts: np.ndarray, q: np.ndarray, parent: np.ndarray) -> LabelModel:
        m = shown.shape[1]
        vote = np.empty((2, m, 3, 3))
        for j in range(m):
            for c, p in ((0, (1 - q) * counts), (1, q * counts)):
                vote[c, j] = (np.einsum("i,iv->v", p, shown[:, j]) + WORTH * EXPECTED[c]) / (p.sum() + WORTH)
            if parent[j] >= 0:
                # Few rows of a class with a parent's vote are drawn to what both classes say, so that a copy of a voter tells nothing.
                joint = [np.einsum("i,iu,iv->uv", p, shown[:, parent[j]], shown[:, j]) for p in ((1 - q) * counts, q * counts)]
                both = (joint[0] + joint[1] + 1 / 3) / (joint[0] + joint[1] + 1 / 3).sum(1, keepdims=True)
                for c in (0, 1):
                    vote[c, j] = (joint[c] + POOLED * both) / (joint[c].sum(1, keepdims=True) + POOLED)
        prior = (q * counts).sum() + PRIOR * WORTH
        return cls(float(prior / (counts.sum() + WORTH)), vote, parent)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        ratio = np.log(self.vote[1] / self.vote[0])
        at = patterns.astype(int) + 1
        z = np.full(len(patterns), np.log(self.prior / (1 - self.prior)))
        for j, u in enumerate(self.parent):
            z += ratio[j, at[:, u] if u >= 0 else 0, at[:, j]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def forest(shown: np.ndarray, counts: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The parents in the forest of greatest conditional information between voters, given the class (Chow and Liu's tree within classes)."""
    n, m = max(counts.sum(), 1), shown.shape[1]
    information = np.zeros((m, m))
    for p in ((1 - q) * counts, q * counts):
        if p.sum() < 1:
            continue
        joint = np.einsum("i,iju,ikv->jkuv", p, shown, shown, optimize=True) / p.sum()
        own = np.einsum("i,ijv->jv", p, shown) / p.sum()
        apart = own[:, None, :, None] * own[None, :, None, :]
        terms = np.where(joint > 0, joint * np.log(np.maximum(joint, 1e-300) / np.maximum(apart, 1e-300)), 0)
        information += p.sum() / n * terms.sum((2, 3))
    parent, linked = np.full(m, -1), {0}
    while len(linked) < m:
        j, u = max(((j, u) for j in range(m) if j not in linked for u in linked), key=lambda x: (information[x], -x[0], -x[1]))
        if information[j, u] >= max(LEAST_INFORMATION, LEAST_EVIDENCE / (2 * n)):
            parent[j] = u
        linked.add(j)
    return parent


def voted(rows: DataFrame, panels: list[Voters]) -> DataFrame:
    """rows (doc_id, text, y, half) with `votes` of the panel of the other half."""

    def cast(batches):
        for table in chunks(batches):
            raw, offs = flat(table.column("text"))
            half = table.column("half").to_numpy()
            both = [panel.votes(raw, offs) for panel in panels]
            votes = np.where((half == 0)[:, None], both[1], both[0])
            yield from table.append_column("votes", pa.array([v.tobytes() for v in votes], pa.binary())).combine_chunks().to_batches()

    small_batches(rows.sparkSession)
    return rows.mapInArrow(cast, T.StructType([*rows.schema.fields, T.StructField("votes", T.BinaryType())]))


def train(docs: DataFrame, labels: DataFrame, keep: Column | None = None, most: int = MOST_LABELLED, more: int = MOST_UNLABELLED) -> np.ndarray:
    """Weights of the classifier; `keep` is a condition on doc_id for all that is learned from."""
    keep = F.lit(True) if keep is None else keep
    sample = linear.labelled(docs, labels, "toxic", keep, most).unionByName(linear.unlabelled(docs, keep, more))
    # A document that is in both samples counts once, with its label.
    sample = sample.groupBy("doc_id", "text").agg(F.max("y").alias("y"))
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)).cast("int").alias("half")
    rows = written(linear.varied(sample).select("doc_id", "text", "y", half), "toxic-sample")
    panels = [grown(rows.filter((F.col("half") == h) & F.col("y").isNotNull())) for h in (0, 1)]
    ballots = written(voted(rows, panels).select("doc_id", "text", "votes"), "toxic-votes")
    # One row per pattern that occurs in the sample, so at most as many as the sample has rows.
    seen = ballots.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).orderBy("votes").collect()
    if not seen:
        weights = np.zeros(1 << BITS, np.float32)
        weights[0] = np.log(PRIOR / (1 - PRIOR))
        return weights
    patterns = np.array([np.frombuffer(r["votes"], np.int8) for r in seen])
    model = LabelModel.fit(patterns, np.array([r["n"] for r in seen], float))
    chance = docs.sparkSession.createDataFrame([(bytes(r["votes"]), float(p)) for r, p in zip(seen, model.posterior(patterns), strict=True)], "votes binary, y double")
    return linear.fit(ballots.join(F.broadcast(chance), "votes"), KIND, alpha=1.0, l1=2.0, epochs=4)


def score(docs: DataFrame, weights: np.ndarray, name: str = "score") -> DataFrame:
    """docs and the probability that a text is toxic."""
    return linear.score(docs, KIND, weights, name=name)


def held_out(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, learned from rows whose crc32(doc_id) mod 5 isn't 0."""
    weights = train(docs, labels, fold(F.col("doc_id"), 5) != 0)
    return score(docs.select("doc_id", "text"), weights).select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that the classifier doesn't reject, their columns as they are."""
    name = unused(docs, "toxicity_score")
    return score(docs, train(docs, labels), name=name).filter(F.col(name) < threshold).drop(name)
