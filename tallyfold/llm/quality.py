"""Quality classifier: hashed word n-gram logistic regression with follow-the-regularised-leader updates.

A text is read as two streams of tokens, the words as they are and their shapes (lower, Title, CAPS,
or the punctuation itself); features are the hashed one- and two-token grams of both, a repeated token
standing as "same". A feature's value is its share of the text's tokens.

Cases: null and empty texts have the constant feature only; a null label is left out; repeated label rows
count once, and of documents that share an id the text that comes first is learned from; with no labels at all
every score is 0.5 and `keep_good` keeps all; other columns pass through.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linear
from .common import ALNUM, LOWER, NOT_SPACE, fold, mix, pair, spans, unused, word_hashes

#: At most so many labelled documents are learned from.
MOST_LABELLED = 12_000
_CAPS = np.zeros(256, np.int32)
_CAPS[65:91] = 1
_LOWER_CASE = np.zeros(256, np.int32)
_LOWER_CASE[97:123] = 1


def tokens(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words and of punctuation runs in order of place, which are words, and the text of each."""
    ws, we, _ = spans(raw, offs, ALNUM)
    ps, pe, _ = spans(raw, offs, NOT_SPACE & ~ALNUM)
    starts, ends = np.concatenate([ws, ps]), np.concatenate([we, pe])
    word = np.arange(len(starts)) < len(ws)
    order = np.argsort(starts, kind="stable")
    starts, ends, word = starts[order], ends[order], word[order]
    return starts, ends, word, np.searchsorted(offs, starts, side="right") - 1


def grams(raw: np.ndarray, offs: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, word, text = tokens(raw, offs)
    n = np.bincount(text, minlength=len(offs) - 1)
    own = word_hashes(LOWER[raw], starts, ends)
    caps, low = np.zeros(len(raw) + 1, np.int32), np.zeros(len(raw) + 1, np.int32)
    np.cumsum(_CAPS[raw], out=caps[1:])
    np.cumsum(_LOWER_CASE[raw], out=low[1:])
    n_caps, n_low = caps[ends] - caps[starts], low[ends] - low[starts]
    shape = np.where(n_low > 0, np.where(n_caps > 0, 2, 1), np.where(n_caps > 1, 4, 3)).astype(np.uint64)
    shape = np.where(word, mix(shape), own)
    inner = text[1:] == text[:-1]
    same = own[1:] == own[:-1]
    parts = [
        (text, mix(own ^ np.uint64(0x11))),
        (text, mix(shape ^ np.uint64(0x22))),
        (text[1:][inner], np.where(same, np.uint64(0x33), pair(own[:-1], own[1:]))[inner]),
        (text[1:][inner], pair(shape[:-1], shape[1:] ^ np.uint64(0x44))[inner]),
    ]
    where = np.concatenate([t for t, _ in parts])
    index = (mix(np.concatenate([h for _, h in parts])) & np.uint64((1 << bits) - 1)).astype(np.int64)
    return where, np.maximum(index, 1), n


KIND = linear.Kind(grams, share=4.0)


def train(docs: DataFrame, labels: DataFrame, keep=None, most: int = MOST_LABELLED) -> np.ndarray:
    """Weights learned from at most `most` labelled documents; `keep` is a condition on doc_id."""
    rows = linear.labelled(docs, labels, "quality", F.lit(True) if keep is None else keep, most)
    return linear.fit(rows, KIND, alpha=1.0, l1=0.05)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """docs and the probability that label 1 (good) holds, as `score`."""
    return linear.score(docs, KIND, weights)


def held_out(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, learned from rows whose crc32(doc_id) mod 3 isn't 1."""
    weights = train(docs, labels, fold(F.col("doc_id"), 3) != 1)
    return score(docs.select("doc_id", "text"), weights).select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that the classifier doesn't reject, their columns as they are."""
    name = unused(docs, "quality_score")
    return linear.score(docs, KIND, train(docs, labels), name=name).filter(F.col(name) >= threshold).drop(name)
