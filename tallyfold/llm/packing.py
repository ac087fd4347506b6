"""Best-fit packing: tokenised documents into sequences of fixed length, best fit decreasing, with a segment
tree over remaining capacities that finds the tightest open sequence in logarithmic time.

Equal lengths are interchangeable, so the packing is decided on the number of pieces of each length alone
(as many numbers as a sequence has tokens): it gives for each length runs of pieces and the sequences they go
to. Pieces are numbered within their length by their task's offset, and look up their place in the runs.

Cases: null text is empty, and a document without tokens still has its end token; repeated documents are packed
as often as they stand; ties between equal lengths go by task and row; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, written

CAPACITY = 1024
END_ID = 2
#: Distinct words whose ids a worker remembers; beyond that it starts anew.
REMEMBERED = 500_000


class Encoder:
    """Ids of texts as little-endian 32-bit numbers. A byte-level vocabulary is asked once for each distinct word that its own splitting rule gives."""

    # Fixed value: the splitting rule of byte-level vocabularies.
    RULE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str, special_as_text: bool = True) -> None:
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.special = [] if special_as_text else [t["content"] for t in said.get("added_tokens", [])]
        before = said.get("pre_tokenizer") or {}
        self.by_words = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not said.get("normalizer")
        self.words = regex.compile(self.RULE).findall
        self.model = self.tokenizer.model
        # Byte-level vocabularies write each byte as a letter of its own: printable Latin-1 as it is, the others from U+0100 on.
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        self.letters = {b: b for b in plain} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        self.known: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        known, tokenize = self.known, self.model.tokenize
        for w in words:
            if w not in known:
                known[w] = np.array([t.id for t in tokenize(w.encode().decode("latin-1").translate(self.letters))], "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not self.by_words or any(x in text for x in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = self.words(text)
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            self._learn(words)
            return b"".join(map(self.known.__getitem__, words))


@lru_cache(2)
def encoder_of(path: str, special_as_text: bool = True) -> Encoder:
    return Encoder(path, special_as_text)


def public_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole capacities, a shorter first one before them."""
    first = n % capacity or capacity
    return [(0, first), *[(s, capacity) for s in range(first, n, capacity)]]


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False, special_as_text: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece, with task and its number among the task's pieces of its length, and on request its ids as bytes."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "number", *["ids"] * keep_ids]
    docs = docs.select("doc_id", "text")
    small_batches(docs.sparkSession)
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_of(vocabulary or public_path(), special_as_text).encode
        task = TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        for batch in batches:
            rows, own = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = encode(text or "") + end
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + length)]
                    rows.append((k, start, length, zlib.crc32(part), task, seen[length], part))
                    own.append(i)
                    seen[length] += 1
            cols = [pa.array([r[j] for r in rows], t) for j, t in enumerate([pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * keep_ids])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(own, pa.int64())), *cols], names)

    kinds = [T.IntegerType(), T.LongType(), T.LongType(), T.LongType(), T.IntegerType(), T.LongType(), *[T.BinaryType()] * keep_ids]
    return docs.mapInArrow(run, T.StructType([docs.schema["doc_id"], *[T.StructField(n, k) for n, k in zip(names[1:], kinds, strict=True)]]))


class CapacityTree:
    """A segment tree over remaining capacities 0..capacity: which ones have open sequences."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.size)

    def set(self, capacity: int, n: int) -> None:
        at = capacity + self.size
        self.open[at] = n
        while at > 1:
            at >>= 1
            self.open[at] = self.open[2 * at] + self.open[2 * at + 1]

    def tightest(self, need: int) -> int | None:
        """The least remaining capacity of `need` or more that an open sequence has."""
        at = need + self.size
        if self.open[at]:
            return need
        while at > 1:
            if not at & 1 and self.open[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Runs (length, first piece, first sequence, pieces a sequence, offset in the first of them) in order, and the number of sequences, exactly as packing piece by piece would."""
    tree = CapacityTree(capacity)
    open_: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by remaining capacity: ranges of sequences

    def put(left: int, first: int, n: int) -> None:
        if n and left:
            open_[left].append((first, n))
            tree.set(left, len(open_[left]))

    runs, sequences = [], 0
    for length in sorted(counts, reverse=True):
        done, n = 0, counts[length]
        while n:
            left = tree.tightest(length)
            if left is None:
                left, first = capacity, sequences
                each = capacity // length
                there = -(-n // each)
                sequences += there
            else:
                first, there = open_[left].pop()
                tree.set(left, len(open_[left]))
                each = left // length
            m = min(n, there * each)
            full, rest = divmod(m, each)
            runs.append((length, done, first, each, capacity - left))
            put(left - each * length, first, full)
            put(left - rest * length, first + full, 1 if rest else 0)
            put(left, first + full + (rest > 0), there - full - (rest > 0))
            done += m
            n -= m
    return np.array(runs, np.int64).reshape(-1, 5), sequences


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False, special_as_text: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece (and its ids on request). The pieces are written once to the shared folder.

    A special token's string in a text is text, as the public vocabularies' own notes have it, so that no text can end a document; without `special_as_text` it is the token."""
    cut_up = written(pieces(docs, vocabulary, capacity, keep_ids, special_as_text), "pieces")
    by_task = cut_up.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    # At most `capacity` rows.
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, _ = best_fit_decreasing(counts, capacity)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    offsets = by_task.select("length", "task", F.coalesce(before, F.lit(0)).alias("before"))
    numbered = cut_up.join(offsets, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("number")).alias("number"), *["ids"] * keep_ids)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    keys = runs[:, 0] << 48 | runs[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            run = runs[np.searchsorted(keys, length << 48 | number, side="right") - 1]
            nth, within = np.divmod(number - run[:, 1], run[:, 3])
            at = batch.schema.get_field_index("number")
            rest = [n for n in batch.schema.names if n != "number"]
            yield pa.RecordBatch.from_arrays([*[c for i, c in enumerate(batch.columns) if i != at], pa.array(run[:, 2] + nth), pa.array(run[:, 4] + within * length)], [*rest, "sequence_id", "offset"])

    fields = [f for f in numbered.schema.fields if f.name != "number"]
    return numbered.mapInArrow(place, T.StructType([*fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
