"""SimHash near-duplicates by generalised pigeonhole.

The 64 bits of a fingerprint are grouped into partitions of bits that go together; thresholds that add up to
distance + 1 (each plus one) are allotted to the partitions by dynamic programming over estimated candidate
counts. Fingerprints within the distance agree on some partition up to its threshold, that is on one of its
keys with so many bits masked; keys are grouped, and what shares one is verified.

Only distinct fingerprints are compared. A key that more than BUCKET of them share is refined by pieces of the
bits it leaves free (within distance d one of d + 1 pieces agrees), until its groups are small, so nothing large is
gathered and no group is compared pair by pair beyond BUCKET; a group reports a tree of its links, no pairs.

Cases: null and empty texts have fingerprint zero and are linked like any other; repeated rows and equal texts
share a fingerprint; rows with a null id take part, but no component is named after them; different texts under one
id are documents of their own; an empty table gives no rows; `dedup` keeps one row of every component, whatever ids its rows
have, and its columns as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import near_copies
from .common import chunks, small_batches, unused, written
from .components import components, joined

BITS = 64
SHINGLE, DISTANCE, SEED = 3, 3, 42
#: Fingerprints that are compared with one another at once.
BUCKET = 1024
#: Links of a batch that are held before they join their trees.
LINKS_HELD = 1 << 17
#: Distinct fingerprints that correlations and candidate counts are estimated from.
SAMPLE = 16_000
#: What a compared pair costs, of a key that is sent.
PAIR_COST = 0.005
_ALL = (1 << BITS) - 1


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> BITS - 1 else x


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """A bit is 1 if set in over half the XXH64 of the text's shingles, repeats included."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        return xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: len(words) - width].tolist()]
    hashes = np.array([xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of each row; fp is the fingerprint as a signed long."""
    docs = docs.select("doc_id", "text")
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(x, width) for x in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return docs.mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("fp", T.LongType())]))


def grouped_bits(bits: np.ndarray, m: int) -> list[list[int]]:
    """m groups of bits of (nearly) equal size, each grown by the bit that correlates most with it. `bits`: a row per fingerprint."""
    x = bits - bits.mean(0) if len(bits) else np.zeros((1, BITS))
    s = np.sqrt((x * x).sum(0))
    c = np.abs(x.T @ x) / np.maximum(np.outer(s, s), 1e-9)
    np.fill_diagonal(c, 0)
    left, out = set(range(BITS)), []
    for k in range(m):
        size = BITS // m + (k >= m - BITS % m)
        group = [max(left, key=lambda b: (c[b, list(left)].sum(), -b))]
        left.remove(group[0])
        while len(group) < size:
            best = max(left, key=lambda b: (c[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        out.append(sorted(group))
    return out


def masks_of(group: list[int], threshold: int) -> list[int]:
    """Keys under which fingerprints meet that differ in up to `threshold` bits of the group: the group's bits without each so many."""
    return [sum(1 << b for b in group if b not in out) for out in combinations(group, threshold)]


def estimated(sample: np.ndarray, group: list[int], threshold: int, n: int) -> float:
    """Keys sent and pairs compared for a partition with a threshold: pairs that meet in the sample, carried to n fingerprints, but no fewer than chance gives."""
    masks = masks_of(group, threshold)
    chance = n * n / 2 / 2 ** (len(group) - threshold)
    pairs = chance * len(masks)
    if threshold < 2 and len(sample):
        met = 0
        for mask in masks:
            _, counts = np.unique(sample & np.uint64(mask), return_counts=True)
            met += (counts * (counts - 1) // 2).sum()
        pairs = max(pairs, met * (n / len(sample)) ** 2)
    return n * len(masks) + PAIR_COST * pairs


def allotted(costs: list[list[float]], distance: int) -> tuple[float, list[int]]:
    """Thresholds from -1 (not used), each plus one adding up to distance + 1, of least cost, by dynamic programming. costs[i][t]."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for t in range(-1, len(cost)):
                at = used + t + 1
                if at <= distance + 1:
                    total = c + (cost[t] if t >= 0 else 0.0)
                    if at not in step or total < step[at][0]:
                        step[at] = (total, [*ts, t])
        best = step
    return best[distance + 1]


def plan(sample: np.ndarray, n: int, distance: int = DISTANCE) -> list[int]:
    """The masks of all keys, for the number of partitions and thresholds of least estimated cost."""
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float) if len(sample) else np.zeros((0, BITS))
    choices = []
    for m in range(1 + (distance > 0), distance + 2):
        groups = grouped_bits(bits, m)
        cost, ts = allotted([[estimated(sample, g, t, n) for t in range(min(distance, 2) + 1)] for g in groups], distance) if m * 3 >= distance + 1 else (float("inf"), [])
        if ts:
            choices.append((cost, m, [mask for g, t in zip(groups, ts, strict=True) if t >= 0 for mask in masks_of(g, t)]))
    return min(choices)[2]


def refined(mask: int, pieces: int) -> list[int]:
    """The mask with each of so many pieces of the bits it leaves free."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    return [mask | sum(1 << b for b in free[k::pieces]) for k in range(min(pieces, len(free)))]


def trees(groups: list[np.ndarray], distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each group of fingerprints the links of a forest that joins what links within the distance join: (fingerprint, the least of its tree)."""
    fp = np.concatenate(groups)
    size = np.array([len(g) for g in groups])
    group = np.repeat(np.arange(len(groups)), size)
    rank = np.concatenate([np.argsort(np.argsort(g, kind="stable")) for g in groups]) + np.repeat(np.cumsum(size) - size, size)
    order = np.argsort(rank)
    fp, group = fp[order], group[order]
    label = np.arange(len(fp))
    held: list[np.ndarray] = []
    size_held = 0
    for d in range(1, int(size.max())):
        near = np.flatnonzero((group[d:] == group[:-d]) & (np.bitwise_count(fp[d:] ^ fp[:-d]) <= distance))
        held.append(np.stack([near, near + d]))
        size_held += len(near)
        if size_held > LINKS_HELD:
            label = joined(label, np.concatenate(held, axis=1))
            held, size_held = [], 0
    if held:
        label = joined(label, np.concatenate(held, axis=1))
    moved = label != np.arange(len(fp))
    return fp[moved], fp[label[moved]]


def links(nodes: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links between distinct fingerprints `fp` within the distance, as trees that join all that such links join. A bucket holds 2**distance or more, so that refined keys have pieces left to agree on."""
    if bucket < 1 << distance:
        raise ValueError(f"a bucket of {bucket} is too small for a distance of {distance}")
    spark = nodes.sparkSession
    n = nodes.count()
    picked = nodes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()
    masks = plan(np.array([r["fp"] for r in picked], np.int64).view(np.uint64), n, distance)
    small_batches(spark)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups, work = [], 0
            for row in batch.column("fps"):
                groups.append(row.values.to_numpy(zero_copy_only=False).view(np.uint64))
                work += len(groups[-1]) ** 2
                if work > 1 << 21:
                    yield made(groups)
                    groups, work = [], 0
            if groups:
                yield made(groups)

    def made(groups: list[np.ndarray]) -> pa.RecordBatch:
        a, b = trees(groups, distance)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    keyed = lambda df, of: df.join(F.broadcast(spark.createDataFrame([(signed(m), signed(s)) for m in of for s in of[m]], "mask long, sub long")), "mask").select(F.col("sub").alias("mask"), F.col("fp").bitwiseAND(F.col("sub")).alias("key"), "fp")
    level = nodes.select(F.explode(F.array(*[F.lit(signed(m)) for m in masks])).alias("mask"), "fp").select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    found = []
    while True:
        counts = written(level.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1), "keys")
        small, large = counts.filter(F.col("n") <= bucket), counts.filter(F.col("n") > bucket)
        found.append(level.join(small, ["mask", "key"], "left_semi").groupBy("mask", "key").agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(verify, "a long, b long"))
        crowded = [r["mask"] & _ALL for r in large.select("mask").distinct().collect()]
        if not crowded:
            break
        masks = {m: refined(m, distance + 1) for m in crowded}
        level = keyed(level.join(large, ["mask", "key"], "left_semi").select("mask", "fp"), masks)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def classes(docs: DataFrame, width: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, root, component_id) of each row: its fingerprint, the least fingerprint and the least doc_id that links reach."""
    own = written(fingerprints(docs, width), "fingerprints")
    nodes = written(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = components(links(nodes, distance))
    named = written(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "roots")
    # Written, so that the joins stand on plain shuffles: a root that many fingerprints have can then be split.
    least = written(named.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    of = written(named.join(least, "root").select("fp", "root", "component_id"), "classes")
    return own.join(of, "fp").select("doc_id", "fp", "root", "component_id")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def report(docs: DataFrame) -> DataFrame:
    return classes(docs).select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def dedup(docs: DataFrame, width: int = SHINGLE, distance: int | None = None) -> DataFrame:
    """One document of each component: the one with the least id, and of rows that share this id the one whose text comes first.

    Components are those of near copies by their texts (`near_copies`); with a distance, those of fingerprints, by bits alone."""
    found = written(near_copies.classes(docs) if distance is None else classes(docs, width, distance).withColumnRenamed("fp", "node"), "found")
    # Of each component the row with the least id, a null id last, and its node.
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")
    kept = found.groupBy("root").agg(F.min(order).alias("k")).select(F.col("k.doc_id").alias("kept_id"), F.col("k.node").alias("kept_node"))
    kept = written(kept, "kept")
    # Ids that say which row is meant, and the others: ids of several rows, and rows without one.
    many = written(found.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select(F.col("doc_id").alias("many_id")), "many")
    sure = kept.filter(F.col("kept_id").isNotNull()).join(many, F.col("kept_id") == F.col("many_id"), "left_anti")
    out = docs.join(sure, F.col("doc_id") == F.col("kept_id"), "left_semi")
    rest = docs.filter(F.col("doc_id").isNull()).unionByName(docs.join(many, F.col("doc_id") == F.col("many_id"), "left_semi"))
    # Their nodes are told anew from their texts; equal rows by id and node are one.
    node, row = unused(docs, "node"), unused(docs, "row")
    known = with_node(rest, node, None if distance is None else width)
    once = known.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col(node) == F.col("kept_node")), "left_semi")
    # The text alone decides; rows that share id and text may be any of them.
    first = once.groupBy("doc_id", node).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.coalesce("text", F.lit(""))).alias(row))
    return out.unionByName(first.select(f"{row}.*"))


def with_node(docs: DataFrame, name: str, width: int | None) -> DataFrame:
    """docs and the node of each row: its set's, or with a width its fingerprint."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches):
            column = table.column("text")
            nodes = near_copies.nodes_of(column) if width is None else np.array([fingerprint(x, width) for x in column.to_pylist()], np.uint64)
            yield from table.append_column(name, pa.array(nodes.view(np.int64))).combine_chunks().to_batches()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))
