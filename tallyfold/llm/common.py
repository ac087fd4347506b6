"""What the training-data operators share: written intermediate tables, Arrow batches as flat byte
buffers, and word boundaries and word hashes computed for a whole buffer at once."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task looks at together, and texts; one longer text makes a larger buffer of its own.
CHUNK_BYTES, CHUNK_ROWS = 1 << 20, 20_000
#: Rows that Spark puts in an Arrow batch for the operators here.
BATCH_ROWS = 400

_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)


_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, else the warehouse. On a cluster the warehouse counts only if it isn't a local folder, as that is another one on each machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.conf.get("spark.sql.warehouse.dir")
        if at.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return at.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, which `clear` removes."""
    path = f"{shared_dir(spark)}/tallyfold/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_path(path: str) -> str | None:
    """A path that the machine can open, if the shared folder is one."""
    parsed = urlparse(path)
    return unquote(parsed.path) if parsed.scheme in ("", "file") else None


def put(path: str, data: bytes) -> None:
    """Writes a file of the shared folder, whole or not at all."""
    aside = f"{path}.{uuid.uuid4().hex}"
    if (at := local_path(aside)) is not None:
        os.makedirs(os.path.dirname(at), exist_ok=True)
        with open(at, "wb") as f:
            f.write(data)
        os.replace(at, local_path(path))
        return
    fs, at = pa.fs.FileSystem.from_uri(aside)
    fs.create_dir(os.path.dirname(at))
    with fs.open_output_stream(at) as f:
        f.write(data)
    fs.move(at, pa.fs.FileSystem.from_uri(path)[1])


def mapped(path: str, dtype: str, tail: int = 0) -> np.ndarray:
    """A stored array without the last `tail` bytes, memory-mapped; from a store that can't be mapped it is read (so it must be bounded)."""
    if (at := local_path(path)) is not None:
        n = (os.path.getsize(at) - tail) // np.dtype(dtype).itemsize
        return np.memmap(at, dtype, "r", shape=(n,)) if n else np.zeros(0, dtype)
    fs, at = pa.fs.FileSystem.from_uri(path)
    with fs.open_input_stream(at) as f:
        data = f.read()
        return np.frombuffer(data[: len(data) - tail], dtype)


def clear(spark: SparkSession) -> None:
    """Removes what `written` has left so far. Results that are still to be computed from it are lost, so it is for the end of a job."""
    jvm = spark.sparkContext._jvm
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keeps Arrow batches small, so that a batch of long texts fits a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES, column: str = "text", most: int = CHUNK_ROWS) -> Iterator[pa.Table]:
    """Batches put together, or cut between rows, so that each has about `limit` bytes of text and at most about `most` rows (a batch more)."""
    held: list[pa.RecordBatch] = []
    size = n = 0
    for batch in batches:
        at = 0
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(lengths, dtype=np.int64)
        while at < batch.num_rows:
            base = int(total[at - 1]) if at else 0
            to = int(np.searchsorted(total, base + max(limit - size, 0), side="right"))
            to = max(to, at if held else at + 1)
            if to > at:
                held.append(batch.slice(at, to - at))
                size += int(total[to - 1]) - base
                n += to - at
            if to < batch.num_rows or size >= limit or n >= most:
                yield pa.Table.from_batches(held)
                held, size, n = [], 0, 0
            at = to
    if held:
        yield pa.Table.from_batches(held)
    held.clear()
    pa.default_memory_pool().release_unused()


def flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts after one another, and the offset of each text; null counts as empty."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.chunk(0) if arr.num_chunks else pa.array([], pa.string())
    arr = pa.compute.fill_null(arr.cast(pa.large_binary()), b"")
    _, offsets, data = arr.buffers()
    offs = np.frombuffer(offsets, np.int64)[arr.offset : arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def byte_table(chars: bytes | range, lower: bool = True) -> np.ndarray:
    table = np.zeros(256, bool)
    table[np.frombuffer(bytes(chars), np.uint8)] = True
    if lower:
        table[65:91] |= table[97:123]
    return table


#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text; all bytes of a non-ASCII character belong to words.
ALNUM = byte_table([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: Words `[^\x20\x09-\x0D]+`.
NOT_SPACE = byte_table([b for b in range(256) if b != 0x20 and not 9 <= b <= 13])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def spans(raw: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in the buffer, and for each text the number of its first word (and one more)."""
    inside = table[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    at = offs[:-1][offs[:-1] < offs[1:]]
    first[at] = inside[at]
    last[offs[1:][offs[:-1] < offs[1:]] - 1] = inside[offs[1:][offs[:-1] < offs[1:]] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


#: Bytes that are hashed at once.
_BLOCK = 1 << 18


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


_UP, _DOWN = _powers(_MULT, _BLOCK), _powers(_INV, _BLOCK)


def mix(h: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _long_hash(word: np.ndarray) -> np.uint64:
    total = 0
    for at in range(0, len(word), _BLOCK):
        part = word[at : at + _BLOCK].astype(np.uint64) + np.uint64(1)
        total += int((part * _UP[: len(part)]).sum(dtype=np.uint64)) * pow(_MULT, at, 1 << 64)
    return np.uint64(total % (1 << 64))


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes (spans in order of their starts): a polynomial over blocks of the buffer, differences of its prefix sums, scrambled. The memory it takes goes with the spans, not with the buffer."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        to = int(np.searchsorted(starts, base + _BLOCK))
        to = at + int(np.searchsorted(np.maximum.accumulate(ends[at:to]), base + _BLOCK, side="right"))
        if to == at:
            out[at] = _long_hash(raw[base : int(ends[at])])
            at += 1
            continue
        a, z = starts[at:to] - base, ends[at:to] - base
        part = raw[base : base + int(z.max())].astype(np.uint64) + np.uint64(1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * _UP[: len(part)], out=sums[1:])
        out[at:to] = (sums[z] - sums[a]) * _DOWN[a]
        at = to
    return mix(out)


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in order."""
    return mix(a * np.uint64(0x9DDFEA08EB382D69) + b)
