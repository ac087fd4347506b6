"""LM scoring: an interpolated modified Kneser-Ney model of any order from 2, counted in Spark, stored as sorted hash
arrays that workers memory-map.

Documents become chunks (rows of one table, dealt by chunk): their distinct word hashes and each token's number
among them. Level by level, from the longest n-grams to words, a chunk sends its distinct n-grams' hashes and figures to buckets by
range of the hash; a bucket adds them up, writes the sorted arrays to the shared folder, maps them, and answers every chunk
with the figures of its n-grams, marking in one of the chunks that each n-gram is counted there. From these marks chunks
tell, for the level below, how many n-grams begin and end with each shorter one. With all answers a chunk scores its documents.
Another table is scored by the stored model alone: chunks ask, and buckets answer from the mapped files. All
arrays travel sorted, as compressed differences, and nothing larger than a chunk or bucket meets in a task. A chunk sends
to a bucket only what it has of it, so there are never more messages than distinct n-grams of chunks.

Figures of an n-gram: its count (of the highest order) or the number of different words before it (of the others); of the
shorter ones besides how many n-grams go on from it that have such a figure of one, two and more, and these figures' sum; of words
besides how often they stand. A document begins with as many marks of its own as the order needs.

Tokens are words between white space with A-Z lower-cased, then one end a document. Words are told apart by 64-bit hashes.

Cases: null and empty texts are one end token; without training documents all counts are zero and every token is
an unknown one among V + 1 = 1; repeated rows count as often as they stand; a null id counts as empty text for
the fold; an empty table gives no rows; other columns are ignored. Files are written under another name and then renamed, so
a task that runs again, or twice, leaves the same files.
"""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, NOT_SPACE, chunks, flat, fold, local_path, mapped, pair, put, shared_path, small_batches, spans, word_hashes, written

#: Bytes of text of a chunk, and tokens of the input for each bucket.
CHUNK_TEXT, BUCKET_TOKENS, LEAST_BUCKETS = 8 << 20, 3_000_000, 16
ORDER = 2
END, BEGIN = np.uint64(0x5BD1E9955BD1E995), np.uint64(0x27D4EB2F165667C5)


def packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0, byte by byte of their places, compressed."""
    import zstandard

    planes = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)
    used = [k for k in range(8) if planes[:, k].any()] if len(values) else []
    body = b"".join(np.ascontiguousarray(planes[:, k]).tobytes() for k in used)
    return struct.pack("<QB", len(values), sum(1 << k for k in used)) + zstandard.ZstdCompressor(level=1).compress(body)


def unpacked(data: bytes) -> np.ndarray:
    import zstandard

    n, used = struct.unpack_from("<QB", data)
    out = np.zeros((n, 8), np.uint8)
    body = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[9:]), np.uint8).reshape(-1, n) if n and used else []
    for row, k in zip(body, [k for k in range(8) if used >> k & 1], strict=True):
        out[:, k] = row
    return out.reshape(-1).view("<u8")


def packed_sorted(values: np.ndarray) -> bytes:
    return packed(np.diff(values, prepend=np.uint64(0)))


def unpacked_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data), dtype=np.uint64)


def _figures(level: int, order: int) -> int:
    """How many figures an n-gram of a level has."""
    return 1 if level == order else 6 if level == 1 else 5


def _file(folder: str, level: int, bucket: int, kind: str) -> str:
    return f"{folder}/level{level}/{bucket:08d}.{kind}"


def _lookup(folder: str, level: int, order: int, bucket: int) -> Callable[[np.ndarray], np.ndarray]:
    """The stored figures of hashes, a column each, zeros for what isn't stored."""
    m = _figures(level, order)
    keys = mapped(_file(folder, level, bucket, "keys"), "<u8")
    path = _file(folder, level, bucket, "figures")
    values = mapped(path, f"<u{mapped(path, 'u1')[-1]}", 1).reshape(m, -1)

    def found(hashes: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros((m, len(hashes)), np.int64)
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return np.where(keys[at] == hashes, values[:, at], 0).astype(np.int64)

    return found


def _narrow(figures: np.ndarray) -> bytes:
    """Figures in as few bytes each as the largest needs, and that number as a last byte."""
    width = next(w for w in (1, 2, 4, 8) if not figures.size or int(figures.max()) < 1 << 8 * w)
    return np.ascontiguousarray(figures, f"<u{width}").tobytes() + bytes([width])


@dataclass
class Model:
    """What scoring needs besides the stored arrays in `folder`."""

    folder: str
    order: int
    bits: int  #: buckets are ranges of so many of the hashes' highest bits
    train_tokens: int
    distinct: int
    kinds: int  #: two-grams
    left_over: float  #: the share of probability that words leave to unknown ones
    cuts: list[list[float]]  #: the three discounts of each level, from words on

    def save(self) -> None:
        put(f"{self.folder}/model.json", json.dumps(asdict(self)).encode())

    @classmethod
    def load(cls, folder: str) -> Model:
        return cls(**json.loads(mapped(f"{folder}/model.json", "u1").tobytes()))


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per chunk: its documents, distinct word hashes and tokens."""
    task, number = TaskContext.get().partitionId(), 0
    parts: list[tuple] = []
    size = n_rows = 0

    def made() -> pa.RecordBatch:
        nonlocal number
        vocabulary, tokens = np.unique(np.concatenate([p[2] for p in parts]), return_inverse=True)
        row = {
            "chunk": pa.array([task << 24 | number]),
            "doc_ids": pa.array([sum((p[0].to_pylist() for p in parts), [])], pa.list_(parts[0][0].type)),
            "held": pa.array([sum((p[1].to_pylist() for p in parts), [])], pa.list_(pa.bool_())),
            "sizes": pa.array([packed(np.concatenate([p[3] for p in parts]).astype(np.uint64))], pa.binary()),
            "words": pa.array([packed_sorted(vocabulary)], pa.binary()),
            "tokens": pa.array([packed(tokens.astype(np.uint64))], pa.binary()),
        }
        number += 1
        return pa.RecordBatch.from_arrays(list(row.values()), list(row))

    for table in chunks(batches):
        raw, offs = flat(table.column("text"))
        low = LOWER[raw]
        starts, ends, cuts = spans(low, offs, NOT_SPACE)
        n = np.diff(cuts)
        stream = np.full(len(starts) + len(n), END, np.uint64)
        stream[np.arange(len(starts)) + np.repeat(np.arange(len(n)), n)] = word_hashes(low, starts, ends)
        parts.append((table.column("doc_id").combine_chunks(), table.column("held").combine_chunks(), stream, n + 1))
        size += len(raw)
        n_rows += table.num_rows
        if size >= CHUNK_TEXT or n_rows >= CHUNK_TEXT >> 5:
            yield made()
            parts, size, n_rows = [], 0, 0
    if parts:
        yield made()


class Chunk:
    """A chunk row read back, with its distinct n-grams of each level in order of their hashes. Each document has a place for its beginning before its tokens' places."""

    def __init__(self, row: dict, order: int) -> None:
        self.doc_ids, held = row["doc_ids"], np.array(row["held"], bool)
        self.sizes = unpacked(row["sizes"]).astype(np.int64)
        words = unpacked_sorted(row["words"])
        tokens = unpacked(row["tokens"]).astype(np.int64)
        first = np.cumsum(self.sizes + 1) - self.sizes - 1
        self.token = np.ones(len(tokens) + len(first), bool)
        self.token[first] = False
        own = np.full(len(self.token), BEGIN, np.uint64)
        own[self.token] = words[tokens]
        trained = np.repeat(~held, self.sizes + 1) & self.token
        self.hashes: dict[int, np.ndarray] = {}
        self.left: dict[int, np.ndarray] = {}
        self.right: dict[int, np.ndarray] = {}
        now, at, begin = own, None, BEGIN
        for level in range(1, order + 1):
            if level > 1:
                longer = np.empty_like(own)
                longer[1:] = pair(now[:-1], own[1:])
                begin = pair(np.array([begin]), np.array([BEGIN]))[0]
                longer[first] = begin
                now = longer
            before = at
            self.hashes[level], where, at = np.unique(now, return_index=True, return_inverse=True)
            if level == 1:
                self.raw = np.bincount(at[trained], minlength=len(self.hashes[1]))
            else:
                # The n-gram of a document's beginning is none that goes on from another; it has no count, so its left end says nothing.
                self.left[level] = before[np.maximum(where - 1, 0)]
                self.right[level] = before[where]
        self.at = at[self.token]
        self.counts = np.bincount(at[trained], minlength=len(self.hashes[order]))
        self.words_at = np.searchsorted(self.hashes[1], own[self.token])

    def figures(self, level: int, order: int, above: np.ndarray | None = None) -> np.ndarray:
        """The chunk's share in the figures of its n-grams of a level, from the answer for the level above, whose last row marks what is counted here."""
        if level == order:
            return self.counts[None, :]
        n, left, right = len(self.hashes[level]), self.left[level + 1], self.right[level + 1]
        value, mine = above[0], above[-1].astype(bool)
        tell = lambda at, when: np.bincount(at[mine & when], minlength=n)
        rows = [tell(right, True), *[tell(left, when) for when in (value == 1, value == 2, value > 2)]]
        rows.append(np.bincount(left[mine], weights=value[mine], minlength=n).astype(np.int64))
        return np.stack([*rows, *[self.raw] * (level == 1)])

    def scored(self, model: Model, answers: dict[int, np.ndarray], kind: pa.DataType) -> pa.Table:
        word = answers[1]
        known = word[0] > 0
        p = np.maximum(word[0] - np.where(known, np.array(model.cuts[0])[np.clip(word[0], 1, 3) - 1], 0), 0) / max(model.kinds, 1) + model.left_over / (model.distinct + 1)
        for level in range(2, model.order + 1):
            value, context = answers[level][0], answers[level - 1][:, self.left[level]]
            d = np.array(model.cuts[level - 1])
            total = np.maximum(context[4], 1)
            more = np.where(context[4] > 0, (d[0] * context[1] + d[1] * context[2] + d[2] * context[3]) / total, 1.0)
            own = np.where(context[4] > 0, np.maximum(value - np.where(value > 0, d[np.clip(value, 1, 3) - 1], 0), 0) / total, 0.0)
            p = own + more * p[self.right[level]]
        raw = word[5]
        base = np.log10((raw + 1) / (model.train_tokens + 1 * (model.distinct + 1)))
        first = np.cumsum(self.sizes) - self.sizes
        sums = lambda x: np.add.reduceat(x, first)
        return pa.table({
            "doc_id": pa.array(self.doc_ids, kind), "n_tokens": self.sizes, "n_known": sums((raw > 0)[self.words_at].astype(np.int64)),
            "train_tokens": np.full(len(self.sizes), model.train_tokens), "base_score": sums(base[self.words_at]), "score": sums(np.log10(p)[self.at]),
        })


def _slices(hashes: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of sorted hashes by their highest bits."""
    edges = np.searchsorted(hashes >> np.uint64(64 - bits), np.arange((1 << bits) + 1)) if bits else np.array([0, len(hashes)])
    return [(b, int(a), int(z)) for b, (a, z) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if a < z]


def _merged(hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All hashes of several sorted arrays in one order, the first place of each distinct one in it, and each element's array."""
    every = np.concatenate(hashes)
    order = np.argsort(every, kind="stable")
    every = every[order]
    fresh = np.ones(len(every), bool)
    fresh[1:] = every[1:] != every[:-1]
    return order, np.flatnonzero(fresh), every


_SENT = "level int, bucket int, chunk long, a binary, b binary"
_OUT = "kind int, level int, bucket int, chunk long, b binary, n array<long>"


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["level", "bucket", "chunk", "a", "b"])


def _told(rows: list[tuple]) -> pa.Table:
    """Rows as _OUT has them: kind 0 answers a chunk, kind 2 has a bucket's sums."""
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["kind", "level", "bucket", "chunk", "b", "n"])


def _messages(c: Chunk, chunk: int, level: int, bits: int, figures: np.ndarray | None) -> list[tuple]:
    hashes = c.hashes[level]
    return [(level, b, chunk, packed_sorted(hashes[i:j]), None if figures is None else packed(np.ascontiguousarray(figures[:, i:j]).ravel().astype(np.uint64))) for b, i, j in _slices(hashes, bits)]


def _bucket(folder: str, order: int) -> Callable[[pa.Table], pa.Table]:
    """Adds up the chunks' figures of a bucket's n-grams, stores the sorted arrays, and answers the chunks from them."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        level, bucket = table.column("level")[0].as_py(), table.column("bucket")[0].as_py()
        ids = table.column("chunk").to_pylist()
        hashes = [unpacked_sorted(x) for x in table.column("a").to_pylist()]
        figures = np.concatenate([unpacked(x).reshape(_figures(level, order), -1) for x in table.column("b").to_pylist()], axis=1).astype(np.int64)
        ordered, first, every = _merged(hashes)
        figures = figures[:, ordered]
        totals = np.add.reduceat(figures, first, axis=1)
        # The first chunk whose figure isn't 0 is the one that counts an n-gram for the level below.
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(every))))
        has = np.flatnonzero(figures[0] > 0)
        _, where = np.unique(group[has], return_index=True)
        owner = np.zeros(len(every), np.int64)
        owner[ordered[has[where]]] = 1
        stored = (totals > 0).any(0)
        put(_file(folder, level, bucket, "keys"), every[first][stored].astype("<u8").tobytes())
        put(_file(folder, level, bucket, "figures"), _narrow(totals[:, stored]))
        value = totals[0]
        sums = [value.sum(), *[(value == k).sum() for k in (1, 2, 3, 4)], (value > 2).sum(), *([totals[5].sum(), (totals[5] > 0).sum()] if level == 1 else [0, 0])]
        del every, group, figures, totals
        look = _lookup(folder, level, order, bucket)
        rows, at = [], 0
        for chunk, own in zip(ids, hashes, strict=True):
            answer = look(own)
            answer[0] = answer[0] << 1 | owner[at : at + len(own)]
            rows.append((0, level, bucket, chunk, packed(answer.ravel().astype(np.uint64)), None))
            at += len(own)
        rows.append((2, level, bucket, None, None, [int(x) for x in sums]))
        return _told(rows)

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Chen and Goodman's three discounts; halves where the counts of counts don't give them."""
    if not (n1 and n2):
        return np.array([0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.5]
    return np.clip(d, 0.05, [1.0, 2.0, 3.0])


def _answers(replies: pa.Table, level: int, rows: int, marked: bool) -> np.ndarray:
    """A chunk's answers for a level, buckets in order; the marks, which travel in the lowest bit of the first figure, as a last row."""
    own = replies.filter(pa.compute.equal(replies.column("level"), level)).sort_by("bucket")
    found = np.concatenate([unpacked(x).reshape(rows, -1) for x in own.column("b").to_pylist()], axis=1).astype(np.int64)
    if not marked:
        return found
    marks = found[0] & 1
    found[0] >>= 1
    return np.concatenate([found, marks[None, :]])


def table_of_chunks(docs: DataFrame, trained: Column) -> DataFrame:
    """The chunks of docs, written as a table that is dealt by chunk, so that answers join it where it lies. `trained` says which documents are learned from."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (~trained).alias("held"))
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("doc_ids", T.ArrayType(kind)), T.StructField("held", T.ArrayType(T.BooleanType())), *[T.StructField(n, T.BinaryType()) for n in ("sizes", "words", "tokens")]])
    path = shared_path(spark, "chunks")
    name = "tallyfold_" + path.rsplit("/", 1)[1].replace("-", "_")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 12)
    rows.mapInArrow(_chunk_rows, schema).write.format("parquet").option("path", path).bucketBy(buckets, "chunk").saveAsTable(name)
    table = spark.table(name)
    # The plan has what it needs; the files stay, the name needn't.
    spark.sql(f"DROP TABLE {name}")
    return table


def _counted(held: DataFrame, order: int) -> tuple[Model, DataFrame]:
    """The model of a table of chunks, its arrays stored, and the answers for the chunks: (level, bucket, chunk, b)."""
    if order < 2:
        raise ValueError("the order is 2 or more")
    spark = held.sparkSession
    folder = shared_path(spark, "kneser-ney")
    tokens = held.select(F.sum(F.length("tokens"))).first()[0] or 0  # about a byte or two a token
    bits = int(max(LEAST_BUCKETS, tokens / 1.5 / BUCKET_TOKENS) - 1).bit_length()

    def longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                c = Chunk(row, order)
                for message in _messages(c, row["chunk"], order, bits, c.figures(order, order)):
                    yield _sent([message])

    def shorter(level: int):
        def run(key: tuple, own: pa.Table, replies: pa.Table) -> pa.Table:
            above = _answers(replies, level + 1, _figures(level + 1, order), True)
            rows = []
            for row in own.to_pylist():
                c = Chunk(row, order)
                rows += _messages(c, row["chunk"], level, bits, c.figures(level, order, above))
            return pa.Table.from_batches([_sent(rows)])

        return run

    told = []
    for level in range(order, 0, -1):
        sent = held.mapInArrow(longest, _SENT) if level == order else held.groupBy("chunk").cogroup(told[-1].filter("kind = 0").select("chunk", "level", "bucket", "b").groupBy("chunk")).applyInArrow(shorter(level), _SENT)
        told.append(written(sent.groupBy("level", "bucket").applyInArrow(_bucket(folder, order), _OUT), f"level{level}"))
    # One short row a bucket and level, summed by Spark.
    sums = [[x or 0 for x in t.filter("kind = 2").agg(*[F.sum(F.col("n")[k]) for k in range(8)]).first()] for t in reversed(told)]
    cuts = [discounts(*s[1:5]).tolist() for s in sums]
    kinds, m1, m2, _, _, more, train_tokens, distinct = sums[0]
    left_over = (cuts[0][0] * m1 + cuts[0][1] * m2 + cuts[0][2] * more) / kinds if kinds else 1.0
    model = Model(folder, order, bits, train_tokens, distinct, kinds, left_over, cuts)
    model.save()
    answers = told[0]
    for t in told[1:]:
        answers = answers.union(t)
    return model, answers.filter("kind = 0").select("chunk", "level", "bucket", "b")


def _scored(held: DataFrame, model: Model, answers: DataFrame, marked: bool) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity) of a table of chunks and its answers; `marked` ones carry marks besides."""
    kind = held.schema["doc_ids"].dataType.elementType

    def run(key: tuple, own: pa.Table, replies: pa.Table) -> pa.Table:
        of = own.schema.field("doc_ids").type.value_type
        found = {level: _answers(replies, level, _figures(level, model.order), marked) for level in range(1, model.order + 1)}
        return pa.concat_tables([Chunk(row, model.order).scored(model, found, of) for row in own.to_pylist()])

    schema = T.StructType([T.StructField("doc_id", kind), *[T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known", "train_tokens")], T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    out = held.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def train(docs: DataFrame, trained: Column | None = None, order: int = ORDER) -> Model:
    """A model of the documents that `trained` holds for, stored in the shared folder; `Model.load` reads it again from its `folder`."""
    return _counted(table_of_chunks(docs, F.lit(True) if trained is None else trained), order)[0]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The scores of any table by a stored model: chunks ask buckets, whose workers map the stored arrays."""
    held = table_of_chunks(docs, F.lit(False))
    folder, order, bits = model.folder, model.order, model.bits

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                c = Chunk(row, order)
                for level in range(1, order + 1):
                    for message in _messages(c, row["chunk"], level, bits, None):
                        yield _sent([message])

    def answer(table: pa.Table) -> pa.Table:
        level, bucket = table.column("level")[0].as_py(), table.column("bucket")[0].as_py()
        none = local_path(_file(folder, level, bucket, "keys"))
        # A bucket that no chunk sent anything to has no file.
        look = _lookup(folder, level, order, bucket) if none is None or os.path.exists(none) else lambda h: np.zeros((_figures(level, order), len(h)), np.int64)
        return _told([(0, level, bucket, chunk, packed(look(unpacked_sorted(a)).ravel().astype(np.uint64)), None) for chunk, a in zip(table.column("chunk").to_pylist(), table.column("a").to_pylist(), strict=True)])

    answers = held.mapInArrow(asked, _SENT).groupBy("level", "bucket").applyInArrow(answer, _OUT)
    return _scored(held, model, answers.select("chunk", "level", "bucket", "b"), marked=False)


def train_and_score(docs: DataFrame, trained: Column, order: int = ORDER) -> DataFrame:
    """The scores of all documents by a model of those that `trained` holds for; the buckets answer while they count, so nothing is asked twice."""
    held = table_of_chunks(docs, trained)
    model, answers = _counted(held, order)
    return _scored(held, model, answers, marked=True)


def held_out(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """`train_and_score` with the documents whose crc32(doc_id) mod 7 isn't 2 as training documents, and held_out."""
    return train_and_score(docs, fold(F.col("doc_id"), 7) != 2, order).withColumn("held_out", fold(F.col("doc_id"), 7) == 2)
