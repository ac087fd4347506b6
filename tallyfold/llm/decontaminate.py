"""Benchmark decontamination: an FM-index per shard of documents, searched backwards for benchmark windows.

A shard is a chunk of documents in a task. Its words become numbers in the benchmark's vocabulary; words
outside of it can be part of no window, so only runs of known words as long as the shortest window are
indexed. The index is the Burrows-Wheeler transform of these runs in a wavelet matrix, with every SAMPLE-th
suffix position and every run's start kept; windows are searched through the matrix's ranks from their last
word to their first, occurrences are located by walking to a kept position, and overlapping ones merge to
spans that can be removed.

The benchmark is made into blocks of about BLOCK_BYTES of text by Spark, each written to the shared folder; the driver
knows their paths only, and a worker loads one after another in the same pass over the documents.

Cases: null and empty texts have no words and no hits; items without words have no window, and items with a
null id are left out; items that repeat an id count as one; repeated documents give repeated rows; with an
empty benchmark nothing is hit; other columns pass through, and a column with one of the output names is replaced.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, CHUNK_BYTES, LOWER, chunks, flat, mapped, put, shared_path, small_batches, spans, word_hashes

WINDOW = 10
SAMPLE = 16
BLOCK_BYTES = 4 << 20


class WaveletMatrix:
    """Symbols of a sequence by their bits, highest first, with running counts of ones."""

    def __init__(self, symbols: np.ndarray, n_symbols: int) -> None:
        self.levels = []
        for bit in range(max(1, int(n_symbols - 1).bit_length()) - 1, -1, -1):
            ones = symbols >> bit & 1
            counts = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(ones, out=counts[1:])
            self.levels.append((bit, counts, len(symbols) - int(counts[-1])))
            symbols = np.concatenate([symbols[ones == 0], symbols[ones == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        start = np.zeros_like(at)
        for bit, counts, zeros in self.levels:
            one = (symbol >> bit & 1).astype(bool)
            at = np.where(one, zeros + counts[at], at - counts[at])
            start = np.where(one, zeros + counts[start], start - counts[start])
        return at - start


def suffix_array(ranks: np.ndarray) -> np.ndarray:
    """Places of the suffixes in sorted order, by prefix doubling."""
    n = len(ranks)
    ranks = np.unique(ranks, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[:-step] = ranks[step:] + 1 if step < n else 0
        key = ranks * (n + 1) + after
        order = np.argsort(key, kind="stable")
        fresh = np.ones(n, np.int64)
        fresh[1:] = key[order][1:] != key[order][:-1]
        ranks[order] = np.cumsum(fresh) - 1
        if ranks[order[-1]] == n - 1 or step >= n:
            return order
        step *= 2


class FmIndex:
    """Of runs of symbols 1..n-1, each followed by a 0."""

    def __init__(self, symbols: np.ndarray, n_symbols: int) -> None:
        gaps = np.flatnonzero(symbols == 0)
        # Every gap sorts by its place, so common beginnings end with a run.
        ranks = symbols.astype(np.int64) + len(gaps)
        ranks[gaps] = np.arange(len(gaps))
        suffixes = suffix_array(ranks)
        self.last = symbols[suffixes - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=n_symbols))])
        self.matrix = WaveletMatrix(self.last, n_symbols)
        begins = np.zeros(len(symbols), bool)
        begins[0] = True
        begins[gaps[:-1] + 1] = True
        self.kept = (suffixes % SAMPLE == 0) | begins[suffixes]
        self.number = np.cumsum(self.kept) - 1
        self.places = suffixes[self.kept]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of each pattern that occurs: pattern, first row, row after the last. Patterns end at the last column."""
        alive = np.arange(len(patterns))
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), len(self.last), np.int64)
        for column in range(patterns.shape[1] - 1, -1, -1):
            moving = lengths[alive] >= patterns.shape[1] - column
            if not moving.any():
                break
            c = patterns[alive, column]
            ranks = self.matrix.rank(np.concatenate([c, c]), np.concatenate([low, high]))
            low = np.where(moving, self.first[c] + ranks[: len(c)], low)
            high = np.where(moving, self.first[c] + ranks[len(c) :], high)
            found = low < high
            alive, low, high = alive[found], low[found], high[found]
        return alive, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place in the sequence that each row's suffix begins at."""
        out = np.zeros(len(rows), np.int64)
        walked = np.zeros(len(rows), np.int64)
        open_ = np.arange(len(rows))
        rows = rows.copy()
        while len(open_):
            ready = self.kept[rows[open_]]
            done = open_[ready]
            out[done] = self.places[self.number[rows[done]]] + walked[done]
            open_ = open_[~ready]
            c = self.last[rows[open_]]
            rows[open_] = self.first[c] + self.matrix.rank(c, rows[open_])
            walked[open_] += 1
        return out


@dataclass
class Windows:
    """The windows of benchmark items: vocabulary (sorted word hashes), patterns of word numbers from 1 set to the right, and the items of each: window w has items[at[w] : at[w + 1]], numbers in `ids`."""

    words: np.ndarray
    patterns: np.ndarray
    lengths: np.ndarray
    ids: np.ndarray
    items: np.ndarray
    at: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[str, str | None]], width: int = WINDOW) -> Windows:
        raw, offs = flat(pa.array([x for _, x in rows], pa.string()))
        low = LOWER[raw]
        starts, ends, cuts = spans(low, offs, ALNUM)
        words, number = np.unique(word_hashes(low, starts, ends), return_inverse=True)
        ids, item_of = np.unique(np.array([i for i, _ in rows], object), return_inverse=True) if rows else (np.zeros(0, object), np.zeros(0, np.int64))
        found: dict[tuple[int, ...], set[int]] = {}
        for item, a, b in zip(item_of.tolist(), cuts[:-1], cuts[1:], strict=True):
            own = (number[a:b] + 1).tolist()
            for i in range(max(1, len(own) - width + 1) if own else 0):
                found.setdefault(tuple(own[i : i + width]), set()).add(item)
        patterns = np.zeros((len(found), width), np.int32)
        for i, p in enumerate(found):
            patterns[i, width - len(p) :] = p
        n = np.array([len(x) for x in found.values()], np.int64)
        return cls(words, patterns, np.array([len(p) for p in found], np.int64), ids, np.array([x for own in found.values() for x in sorted(own)], np.int64), np.concatenate([[0], np.cumsum(n)]))

    def items_of(self, window: int) -> list[str]:
        return self.ids[self.items[self.at[window] : self.at[window + 1]]].tolist()

    def save(self, path: str) -> None:
        parts = [pa.array(x) for x in (self.words, self.patterns.ravel(), self.lengths, self.ids.astype(str), self.items, self.at)]
        out = io.BytesIO()
        with pa.ipc.new_file(out, pa.schema([(f"c{i}", pa.list_(x.type)) for i, x in enumerate(parts)])) as f:
            f.write_batch(pa.RecordBatch.from_arrays([pa.array([x], pa.list_(x.type)) for x in parts], [f"c{i}" for i in range(len(parts))]))
        put(path, out.getvalue())


@lru_cache(1)
def load(path: str) -> Windows:
    """A stored block; a worker keeps one."""
    row = pa.ipc.open_file(pa.BufferReader(mapped(path, "u1"))).get_batch(0)
    words, patterns, lengths, ids, items, at = (row.column(i).flatten() for i in range(6))
    return Windows(words.to_numpy(), patterns.to_numpy().reshape(len(lengths), -1), lengths.to_numpy(), np.array(ids.to_pylist(), object), items.to_numpy(), at.to_numpy())


@dataclass
class Found:
    """Occurrences in a chunk of texts: text, first and one past the last word in the chunk, window; and the words themselves."""

    text: np.ndarray
    first: np.ndarray
    after: np.ndarray
    window: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    cuts: np.ndarray


def search(raw: np.ndarray, offs: np.ndarray, windows: Windows) -> Found:
    low = LOWER[raw]
    starts, ends, cuts = spans(low, offs, ALNUM)
    none = np.zeros(0, np.int64)
    nothing = Found(none, none, none, none, starts, ends, cuts)
    if not len(windows.lengths) or not len(starts):
        return nothing
    h = word_hashes(low, starts, ends)
    at = np.minimum(np.searchsorted(windows.words, h), len(windows.words) - 1)
    symbols = np.where(windows.words[at] == h, at + 1, 0)
    # Runs of known words within a text.
    inside = symbols > 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first_words = cuts[:-1][cuts[:-1] < len(symbols)]
    begins[first_words] = inside[first_words]
    run_start = np.flatnonzero(begins)
    if not len(run_start):
        return nothing
    stops = np.flatnonzero(~inside)
    limit = np.concatenate([stops, [len(symbols)]])[np.searchsorted(stops, run_start)]
    text_of = np.searchsorted(cuts, run_start, side="right") - 1
    run_end = np.minimum(limit, cuts[text_of + 1])
    long = run_end - run_start >= windows.lengths.min()
    run_start, run_end = run_start[long], run_end[long]
    if not len(run_start):
        return nothing
    size = run_end - run_start + 1  # and a gap
    base = np.cumsum(size) - size
    place = np.arange(size.sum()) - np.repeat(base - run_start, size)
    gap = base + size - 1
    sequence = symbols[np.minimum(place, len(symbols) - 1)]
    sequence[gap] = 0
    index = FmIndex(sequence, len(windows.words) + 1)
    window, lo, hi = index.search(windows.patterns, windows.lengths)
    n = hi - lo
    rows = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
    first = place[index.locate(rows)]
    window = np.repeat(window, n)
    return Found(np.searchsorted(cuts, first, side="right") - 1, first, first + windows.lengths[window], window, starts, ends, cuts)


def merged(found: Found, n_texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and one past the last of the spans that overlapping or touching occurrences make, and each text's words that are hit."""
    cover = np.zeros(len(found.starts) + 1, np.int64)
    np.add.at(cover, found.first, 1)
    np.add.at(cover, found.after, -1)
    hit = np.cumsum(cover)[:-1] > 0
    begins, ends = hit.copy(), hit.copy()
    begins[1:] &= ~hit[:-1]
    ends[:-1] &= ~hit[1:]
    edges = found.cuts[1:-1][(found.cuts[1:-1] > 0) & (found.cuts[1:-1] < len(hit))]
    begins[edges] = hit[edges]
    ends[edges - 1] = hit[edges - 1]
    first, after = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    sums = np.concatenate([[0], np.cumsum(hit)])
    return np.searchsorted(found.cuts, first, side="right") - 1, first, after, sums[found.cuts[1:]] - sums[found.cuts[:-1]]


def blocks(benchmark: DataFrame) -> list[str]:
    """The benchmark's windows in blocks of about BLOCK_BYTES of text: the paths that they were written to."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").filter(F.col("item").isNotNull())
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    folder = shared_path(benchmark.sparkSession, "benchmark")

    def one(table: pa.Table) -> pa.Table:
        path = f"{folder}/{table.column('block')[0].as_py():08d}.arrow"
        table = table.sort_by([("item", "ascending"), ("text", "ascending")])
        Windows.of(list(zip(table.column("item").to_pylist(), table.column("text").to_pylist(), strict=True))).save(path)
        return pa.table({"path": [path]})

    dealt = items.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(-(-size // BLOCK_BYTES) or 1)))
    # One path a block.
    return sorted(r["path"] for r in dealt.groupBy("block").applyInArrow(one, "path string").collect())


def shard(parts: list[str]) -> int:
    """Bytes of text of a shard: larger where several blocks are loaded for each."""
    return CHUNK_BYTES * max(1, min(16, len(parts)))


_SPAN = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("after", T.LongType())]))
_PA_SPAN = pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with n_words, n_hit, spans (word numbers, `after` excluded) and items (ids as sorted strings) of what occurs in each text. One pass, no shuffle."""
    docs = docs.drop("n_words", "n_hit", "spans", "items")
    small_batches(docs.sparkSession)
    parts = blocks(benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, shard(parts)):
            raw, offs = flat(table.column("text"))
            items: list[set[str]] = [set() for _ in range(table.num_rows)]
            f = search(raw, offs, Windows.of([]))
            for path in parts:
                w = load(path)
                found = search(raw, offs, w)
                for text, window in np.unique(np.stack([found.text, found.window], 1), axis=0).tolist():
                    items[text].update(w.items_of(window))
                f.first, f.after = np.concatenate([f.first, found.first]), np.concatenate([f.after, found.after])
            text, first, after, n_hit = merged(f, table.num_rows)
            own: list[list] = [[] for _ in range(table.num_rows)]
            for t, a, b in zip(text.tolist(), (first - f.cuts[text]).tolist(), (after - f.cuts[text]).tolist(), strict=True):
                own[t].append({"first": a, "after": b})
            out = table.append_column("n_words", pa.array(np.diff(f.cuts))).append_column("n_hit", pa.array(n_hit))
            out = out.append_column("spans", pa.array(own, _PA_SPAN)).append_column("items", pa.array([sorted(x) for x in items], pa.list_(pa.string())))
            yield from out.combine_chunks().to_batches()

    extra = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("spans", _SPAN), T.StructField("items", T.ArrayType(T.StringType()))]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *extra]))


def cut(text: str, spans_: list[tuple[int, int]]) -> str:
    """The text without these spans of bytes, a line break in the place of each."""
    raw = text.encode()
    parts, at = [], 0
    for a, b in spans_:
        parts.append(raw[at:a])
        at = b
    return b"\n".join([*parts, raw[at:]]).decode()


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with the spans removed from their texts (and n_chars, where there is one, counted anew); again until nothing occurs, as what a cut joins can be a window too. Texts without a hit stay as they are."""
    small_batches(docs.sparkSession)
    parts = blocks(benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, shard(parts)):
            texts = None
            open_ = np.arange(table.num_rows)
            now = table.column("text")
            while len(open_):
                raw, offs = flat(now)
                f = search(raw, offs, Windows.of([]))
                for path in parts:
                    found = search(raw, offs, load(path))
                    f.first, f.after = np.concatenate([f.first, found.first]), np.concatenate([f.after, found.after])
                if not len(f.first):
                    break
                text, first, after, _ = merged(f, len(open_))
                texts = table.column("text").to_pylist() if texts is None else texts
                own: dict[int, list[tuple[int, int]]] = {}
                for t, a, b in zip(text.tolist(), f.starts[first].tolist(), f.ends[after - 1].tolist(), strict=True):
                    own.setdefault(t, []).append((a - int(offs[t]), b - int(offs[t])))
                for t, spans_ in own.items():
                    texts[open_[t]] = cut(texts[open_[t]], spans_)
                open_ = open_[list(own)]
                now = pa.chunked_array([pa.array([texts[i] for i in open_], pa.string())])
            if texts is not None:
                table = table.set_column(table.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))
            yield from table.combine_chunks().to_batches()

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest of `find` for each document."""
    found = find(docs.select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
