"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over labelled text. A text is cut into the longest pieces
that occur in a language's sample; the fewer such phrases, times the logarithm of the sample's length, the
better the language explains the text, and the least wins (the first by name on ties). A letter that the
sample doesn't have is a phrase of its own and counts twice, as it must be spelled out besides.

The sample are passages from all over the learned texts: of each language SAMPLE_DOCS documents, whose hashed
ids come first, cut into passages of PASSAGE characters, of which those whose hashes come first are learned.
Letters are lower-cased, and every letter of the samples is told apart; runs of anything else are one space.
A text is parsed as a whole: it is cut into lanes that walk the automata in step, and where a phrase
reaches over the end of a lane, the next lane is parsed again from the phrase's end until both parses agree.

Memory goes with the number of languages, about 8 MB each at LANGUAGE_CHARS.

Cases: null texts and texts without a letter are "und" with score 0.0; rows without lang, id or text aren't learned
from; of documents that share an id the text that comes first is learned from; repeated rows give repeated rows;
with nothing to learn from every text is "und"; a single language gets score 1.0; other columns pass through, but a
column lang_pred or score is replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, fold, small_batches

#: Documents of a language that passages are drawn from, characters of a passage, and of a language's sample.
SAMPLE_DOCS, PASSAGE, LANGUAGE_CHARS = 256, 400, 32_000
#: Symbols that walk one lane.
LANE = 256
#: Characters of a long text that are parsed at once.
SLICE = 1 << 20
#: 0 is a break (never matched), 1 a space, 2 a letter that no sample has, then the samples' letters, most frequent first. Symbols below DENSE have columns of their own in the transition table, the others are looked up by state and symbol.
BREAK, SPACE, UNKNOWN, FIRST, DENSE = 0, 1, 2, 3, 40

Samples = tuple[tuple[str, tuple[str, ...]], ...]


def sample(docs: DataFrame, keep: Column | None = None) -> Samples:
    """The passages of each language that are learned from."""
    ids = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    ids = (ids if keep is None else ids.filter(keep)).select(F.col("doc_id").alias("id"), F.col("lang").alias("of")).distinct()
    first = Window.partitionBy("of").orderBy(F.xxhash64("id"), "id")
    # SAMPLE_DOCS short rows a language.
    ids = ids.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= SAMPLE_DOCS)
    texts = docs.join(F.broadcast(ids), (F.col("doc_id") == F.col("id")) & (F.col("lang") == F.col("of"))).groupBy("of", "id").agg(F.min("text").alias("t"))
    # Split in one pass over a text; counted from its beginning, the passages of a long one would take the square of its length.
    cut = texts.filter(F.length("t") > 0).select("of", "id", F.posexplode(F.regexp_extract_all("t", F.lit(f"(?s).{{1,{PASSAGE}}}"), F.lit(0))).alias("k", "text"))
    passages = cut.groupBy("of", "text").agg(F.min(F.xxhash64("id", "k")).alias("h"))
    chosen = passages.withColumn("n", F.row_number().over(Window.partitionBy("of").orderBy("h", "text"))).filter(F.col("n") <= LANGUAGE_CHARS // PASSAGE)
    out: dict[str, list[str]] = {}
    # LANGUAGE_CHARS characters a language.
    for r in chosen.orderBy("of", "n").collect():
        out.setdefault(r["of"], []).append(r["text"])
    return tuple((lang, tuple(texts)) for lang, texts in sorted(out.items()))


class Symbols:
    """Characters to symbols: a table for the basic plane, looked up one by one beyond it."""

    def __init__(self, texts: list[str]) -> None:
        seen = Counter(c for x in texts for c in x.lower() if c.isalpha())
        self.rank = {c: i + FIRST for i, (c, _) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0])))}
        self.size = FIRST + len(self.rank)
        self.table = np.array([self.one(chr(c)) if not 0xD800 <= c < 0xE000 else SPACE for c in range(1 << 16)], np.int32)

    def one(self, c: str) -> int:
        return self.rank.get(c.lower(), UNKNOWN) if c.isalpha() else SPACE

    def of(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        out = self.table[np.minimum(points, 0xFFFF)]
        for i in np.flatnonzero(points > 0xFFFF):
            out[i] = self.one(chr(points[i]))
        return out


def _squeezed(codes: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Which symbols stay when runs of spaces become one; `fresh` marks the first symbol of each text."""
    space = codes == SPACE
    return ~space | np.concatenate([[True], ~space[:-1]])[: len(codes)] | fresh


def suffix_automaton(codes: np.ndarray) -> list[dict[int, int]]:
    """The transitions of the automaton of all substrings. State 0 is the start; a break cuts the text."""
    nxt: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0

    def clone_of(p: int, q: int, c: int) -> int:
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = clone
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        return clone

    for c in codes.tolist():
        if c == BREAK:
            last = 0
            continue
        if c in nxt[last]:  # after a cut the text so far may already go on like this
            q = nxt[last][c]
            last = q if length[q] == length[last] + 1 else clone_of(last, q, c)
            continue
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else clone_of(p, q, c)
        last = cur
    return nxt


class Parser:
    """The automata of all languages in one table: state 0 is the one between phrases, from which nothing goes on."""

    def __init__(self, texts: Samples) -> None:
        self.langs = [lang for lang, _ in texts]
        self.symbols = Symbols([x for _, xs in texts for x in xs])
        rows, cols, to, roots, self.log = [], [], [], [], []
        at = 1
        for _, xs in texts:
            parts = []
            for x in xs:
                own = self.symbols.of(x)
                parts += [own[_squeezed(own, np.zeros(len(own), bool))], np.zeros(1, np.int32)]
            codes = np.concatenate(parts)
            automaton = suffix_automaton(codes)
            for state, out in enumerate(automaton):
                rows += [at + state] * len(out)
                cols += out
                to += [at + s for s in out.values()]
            roots.append(at)
            self.log.append(np.log2(max(2, len(codes))))
            at += len(automaton)
        rows, cols, to = (np.array(x, np.int64) for x in (rows, cols, to))
        dense = cols < DENSE
        self.dense = np.full((at, DENSE + 1), -1, np.int32)  # the last column stands for all other symbols
        self.dense[rows[dense], cols[dense]] = to[dense]
        self.dense = self.dense.ravel()
        keys = rows[~dense] * self.symbols.size + cols[~dense]
        order = np.argsort(keys)
        self.keys, self.to = keys[order], to[~dense][order]
        # The state that a phrase which begins with each symbol is in; 0 for a letter that the language doesn't have.
        self.root = np.zeros((len(roots), self.symbols.size), np.int64)
        for lang, r in enumerate(roots):
            self.root[lang] = np.maximum(self._step(np.full(self.symbols.size, r), np.arange(self.symbols.size)), 0)

    def _step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The state after each symbol, -1 where none follows."""
        out = self.dense[state * (DENSE + 1) + np.minimum(symbol, DENSE)].astype(np.int64)
        if len(self.keys):
            far = np.nonzero(np.broadcast_to(symbol >= DENSE, out.shape))
            if len(far[0]):
                key = state[far] * self.symbols.size + np.broadcast_to(symbol, out.shape)[far]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                out[far] = np.where(self.keys[at] == key, self.to[at], -1)
        return out

    def walk(self, codes: np.ndarray, offs: np.ndarray, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text in each language, letters unknown to the language twice, and the state of each language after the last text. `before` are the states that the first text goes on from."""
        n_langs, size = len(self.langs), np.diff(offs)
        if not len(codes):
            return np.zeros((len(size), n_langs)), np.zeros(n_langs, np.int64) if before is None else before
        lanes = -(-size // LANE)
        text = np.repeat(np.arange(len(size)), lanes)
        start = np.repeat(offs[:-1], lanes) + (np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * LANE
        end = np.minimum(start + LANE, offs[1:][text])
        # begins[l, i]: a phrase of language l begins at symbol i, if one begins at its lane's start.
        begins = np.zeros((n_langs, len(codes)), bool)
        order = np.argsort(start - end, kind="stable")
        first, width = start[order], (end - start)[order]
        active = np.searchsorted(-width, -np.arange(LANE), side="left")  # lanes longer than each step
        state = np.zeros((n_langs, len(text)), np.int64)
        for step in range(int(width[0])):
            k = int(active[step])
            c = codes[first[:k] + step].astype(np.int64)
            to = self._step(state[:, :k], c)
            failed = to < 0
            state[:, :k] = np.where(failed, self.root[:, c], to)
            begins[:, first[:k] + step] = failed
        # A lane whose predecessor's last phrase goes on into it is parsed again from that phrase's end, until a phrase of both parses begins at one place.
        inner = np.empty(len(text), np.int64)
        inner[order] = np.arange(len(text))
        carried = np.zeros((n_langs, len(text)), np.int64)
        carried[:, 1:] = state[:, inner][:, :-1]
        carried[:, 1:][:, text[1:] != text[:-1]] = 0
        if before is not None:
            carried[:, 0] = before
        after = state[:, inner[-1]].copy()
        lang, lane = np.nonzero(carried)
        at, now = start[lane], carried[lang, lane]
        while len(lane):
            c = codes[at].astype(np.int64)
            to = self._step(now, c)
            failed = to < 0
            # Where the parse that goes on also begins a phrase, both are one from here on.
            agreed = failed & begins[lang, at]
            begins[lang, at] = failed
            now = np.where(failed, self.root[lang, c], to)
            at += 1
            # A lane that is parsed again to its end is followed by the next one, which gets its state instead.
            over = ~agreed & (at == end[lane])
            last = over & ((lane + 1 == len(text)) | (text[np.minimum(lane + 1, len(text) - 1)] != text[lane]))
            after[lang[last & (lane + 1 == len(text))]] = now[last & (lane + 1 == len(text))]
            lane = lane + (over & ~last)
            going = ~agreed & ~last
            lang, lane, at, now = lang[going], lane[going], at[going], now[going]
        out = np.zeros((len(size), n_langs))
        for i in range(n_langs):
            sums = np.concatenate([[0], np.cumsum(begins[i] * (1 + (self.root[i, codes] == 0)))])
            out[:, i] = sums[offs[1:]] - sums[offs[:-1]]
        return out, after


    def _cost(self, text: str) -> tuple[np.ndarray, bool]:
        """The phrases of one long text, slice by slice, and whether it has letters."""
        total, state, before, known = np.zeros(len(self.langs)), np.zeros(len(self.langs), np.int64), -1, False
        for at in range(0, len(text), SLICE):
            codes = self.symbols.of(text[at : at + SLICE])
            stay = _squeezed(codes, np.zeros(len(codes), bool))
            stay[0] = codes[0] != SPACE or before != SPACE
            before = int(codes[-1])
            known |= bool((codes != SPACE).any())
            codes = codes[stay]
            if len(codes):
                n, state = self.walk(codes, np.array([0, len(codes)]), state)
                total += n[0]
        return total, known

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        texts = [x or "" for x in texts]
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        short = [x if len(x) <= 2 * SLICE else "" for x in texts]
        lengths = np.array([len(x) for x in short], np.int64)
        offs = np.concatenate([[0], np.cumsum(lengths)])
        codes = self.symbols.of("".join(short))
        fresh = np.zeros(len(codes), bool)
        fresh[offs[:-1][lengths > 0]] = True
        stay = _squeezed(codes, fresh)
        sums = np.concatenate([[0], np.cumsum(stay)])
        letters = np.concatenate([[0], np.cumsum(codes != SPACE)])
        known = letters[offs[1:]] > letters[offs[:-1]]
        cost = self.walk(codes[stay], sums[offs])[0]
        for i, x in enumerate(texts):
            if len(x) > 2 * SLICE:
                cost[i], known[i] = self._cost(x)
        cost *= np.array(self.log)
        best = cost.argmin(1)
        least = cost[np.arange(len(texts)), best]
        if len(self.langs) > 1:
            second = np.partition(cost, 1, axis=1)[:, 1]
            score = 1 - least / np.maximum(second, 1e-9)
        else:
            score = np.ones(len(texts))
        return [self.langs[b] if k else "und" for b, k in zip(best, known, strict=True)], np.where(known, np.clip(score, 0, 1), 0.0).tolist()


@lru_cache(1)
def parser_of(texts: Samples) -> Parser:
    """The parser, built once in a Python worker."""
    return Parser(texts)


def identify(docs: DataFrame, texts: Samples) -> DataFrame:
    """docs (any columns, with text) and lang_pred and score. One pass, no shuffle."""
    docs = docs.drop("lang_pred", "score")
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = parser_of(texts)
        for table in chunks(batches):
            langs, scores = parser.predict(table.column("text").to_pylist())
            yield from table.append_column("lang_pred", pa.array(langs, pa.string())).append_column("score", pa.array(scores, pa.float64())).combine_chunks().to_batches()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def held_out(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document, learned from rows whose crc32(doc_id) mod 5 isn't 0."""
    texts = sample(docs, fold(F.col("doc_id"), 5) != 0)
    return identify(docs.select("doc_id", "text"), texts).select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")
