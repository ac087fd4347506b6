"""Centroid clustering in exact integers. The nearest centroid is found by a bisector tournament: for each pair of
centroids an integer normal and a threshold are prepared, the sign of one linear form says which of the two is
farther, and k-1 such tests leave one; zero favours the smaller number. Only the winner's distance is computed.

Each round is one pass: tasks add up the vectors of each cluster, Spark adds their sums, and the driver gets k sums
of as many components as a vector has. Sums are added in limbs, so they are exact whatever their size.

Cases: vectors that are null, of another length, or with a null or non-finite component are left out; equal vectors
get equal rows; repeated and null vec_ids are kept, each row for itself (a null one hashes as empty text; ties of the
starting hash go by the components); with fewer vectors than centroids there are as many centroids as vectors; an
empty table gives no rows; a distance or inertia beyond 64 bits is null; of the table only vec_id and embedding are
read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

#: Components below this keep every form and distance of up to 2^8 of them in 64 bits; others are counted in whole numbers of any size.
_NARROW = 1 << 26
#: Vectors that are compared at once.
_ROWS = 4096
_LIMB = 40
_COUNT, _INERTIA = -1, -2


def usable(vectors: DataFrame, dims: int) -> DataFrame:
    """vec_id and embedding (of doubles) of the vectors that count."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.select("vec_id", x.alias("embedding")).filter((F.size("embedding") == dims) & fine)


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite doubles: 64-bit numbers where they are narrow, else Python's. The scale is a power of two, so the product is exact."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * float(scale))
    if (np.abs(scaled) < _NARROW).all():
        return scaled.astype(np.int64)
    whole = [int(x) * scale if abs(x) >= 1 << 53 else math.floor(x * scale) for x in values.ravel().tolist()]
    return np.array(whole, object).reshape(values.shape)


class Bisectors:
    """Normals 2(c_j - c_i) and thresholds |c_j|^2 - |c_i|^2 of all pairs i < j: v is nearer to c_j if its product with the normal is over the threshold."""

    def __init__(self, centroids: list[list[int]]) -> None:
        narrow = all(abs(x) < _NARROW for c in centroids for x in c) and len(centroids[0]) <= 256
        self.kind = np.int64 if narrow else object
        self.centroids = c = np.array(centroids, self.kind)
        square = (c * c).sum(1)
        self.normals, self.thresholds = 2 * (c[None] - c[:, None]), square[None] - square[:, None]

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid and the squared distance to it, of each vector."""
        if vectors.dtype != self.kind:
            wide = Bisectors.__new__(Bisectors)
            wide.kind = object
            wide.centroids, wide.normals, wide.thresholds = (x.astype(object) for x in (self.centroids, self.normals, self.thresholds))
            return (wide if self.kind != object else self)._nearest(vectors.astype(object))
        return self._nearest(vectors)

    def _nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        best = np.zeros(len(vectors), np.int64)
        for j in range(1, len(self.centroids)):
            form = (vectors * self.normals[best, j]).sum(1)
            best = np.where((form > self.thresholds[best, j]).astype(bool), j, best)
        return best, ((vectors - self.centroids[best]) ** 2).sum(1)


def _blocks(batches: Iterator[pa.RecordBatch], dims: int, scale: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            part = batch.slice(at, _ROWS)
            yield part.column("vec_id"), integers(part.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims), scale)


def _sums(rows: DataFrame) -> dict[tuple[int, int], int]:
    """By cluster and component. At most k times (components and two) times few limbs come to the driver."""
    out: dict[tuple[int, int], int] = {}
    for r in rows.groupBy("cluster", "part", "limb").agg(F.sum("value").alias("value")).collect():
        key = r["cluster"], r["part"]
        out[key] = out.get(key, 0) + (r["value"] << _LIMB * r["limb"])
    return out


_SUMS = "cluster int, part int, limb int, value long"


def _limbs(totals: dict[tuple[int, int], int]) -> pa.RecordBatch:
    rows = []
    for (cluster, part), total in totals.items():
        sign, left, limb = (1 if total >= 0 else -1), abs(total), 0
        while left:
            rows.append((cluster, part, limb, sign * (left & (1 << _LIMB) - 1)))
            left >>= _LIMB
            limb += 1
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["cluster", "part", "limb", "value"])


def starts(vectors: DataFrame, k: int, scale: int) -> list[list[int]]:
    """The k usable vectors whose ids hash lowest."""
    hashed = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(hashed.alias("hash"), "embedding").orderBy("hash", "embedding").limit(k).collect()
    return [[int(x) for x in integers(np.array(r["embedding"]), scale)] for r in rows]


def moved(vectors: DataFrame, centroids: list[list[int]], scale: int) -> list[list[int]]:
    """Centroids after a round: floors of the means of their vectors; one without vectors stays."""
    dims, pairs = len(centroids[0]), Bisectors(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], int] = {}
        for _, block in _blocks(batches, dims, scale):
            best, _ = pairs.nearest(block)
            for c in np.unique(best).tolist():
                own = block[best == c]
                for part, x in [(_COUNT, len(own)), *enumerate(own.sum(0).tolist())]:
                    totals[c, part] = totals.get((c, part), 0) + int(x)
        yield _limbs(totals)

    sums = _sums(vectors.mapInArrow(run, _SUMS))
    return [[sums.get((c, part), 0) // n for part in range(dims)] if (n := sums.get((c, _COUNT), 0)) else old for c, old in enumerate(centroids)]


def assigned(vectors: DataFrame, centroids: list[list[int]], scale: int) -> DataFrame:
    """vec_id, cluster, distance (squared; null beyond 64 bits) and its high part, by which inertias stay exact."""
    dims, pairs = len(centroids[0]), Bisectors(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for vec_id, block in _blocks(batches, dims, scale):
            best, distance = pairs.nearest(block)
            whole = [int(d) for d in distance.tolist()]
            near = pa.array([d if d < 1 << 63 else None for d in whole], pa.int64())
            digits = pa.array([None if d < 1 << 63 else str(d) for d in whole], pa.string())
            yield pa.RecordBatch.from_arrays([vec_id, pa.array(best, pa.int32()), near, digits], ["vec_id", "cluster", "distance", "beyond"])

    fields = [T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType()), T.StructField("beyond", T.StringType())]
    return vectors.mapInArrow(run, T.StructType([vectors.schema["vec_id"], *fields]))


def fit(vectors: DataFrame, k: int = 16, dims: int = 64, rounds: int = 3, scale: int = 64) -> list[list[int]]:
    """The centroids after `rounds` rounds, as integers; none if no vector counts."""
    kept = usable(vectors, dims)
    centroids = starts(kept, k, scale)
    for _ in range(rounds if centroids else 0):
        centroids = moved(kept, centroids, scale)
    return centroids


def cluster(vectors: DataFrame, k: int = 16, dims: int = 64, rounds: int = 3, scale: int = 64) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each usable vector. The last assignment is written to the shared folder."""
    spark = vectors.sparkSession
    centroids = fit(vectors, k, dims, rounds, scale)
    kept = usable(vectors, dims)
    if not centroids:
        return kept.select("vec_id", *(F.lit(None).cast(t).alias(n) for n, t in [("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string")])).filter(F.lit(False))
    rows = written(assigned(kept, centroids, scale), "assigned")
    # Distances beyond 64 bits make their cluster's inertia null, as it can't be smaller.
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"), F.max("beyond").isNotNull().alias("beyond"))
    found = {r["cluster"]: None if r["beyond"] else int(r["total"]) for r in sums.collect()}  # a row for each centroid at most
    whole = None if None in found.values() else sum(found.values())
    fits = lambda x: x if x is not None and x < 1 << 63 else None
    table = [(c, fits(x), fits(whole), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, x in found.items()]
    about = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def cluster_sql(k: int = 16, dims: int = 64, rounds: int = 3, scale: int = 64) -> str:
    """What `cluster` gives, in DuckDB's SQL over the table embeddings."""
    floored = "CAST((s - ((s % n) + n) % n) // n AS HUGEINT)"
    steps = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, [CAST(floor({scale} * x) AS HUGEINT) FOR x IN list_transform(embedding, lambda x: CAST(x AS DOUBLE))] AS v
            FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS c, v FROM kept
            QUALIFY row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) <= {k})""",
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""a{i} AS MATERIALIZED (SELECT id, vec_id, kept.v, c, list_sum([(kept.v[i] - c{i}.v[i]) * (kept.v[i] - c{i}.v[i]) FOR i IN range(1, {dims + 1})]) AS d FROM kept, c{i}
            QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, c) = 1)"""
        )
        if i < rounds:
            steps += [
                f"p{i} AS MATERIALIZED (SELECT c, i, sum(v[i]) AS s, count(*) AS n FROM a{i}, range(1, {dims + 1}) AS r(i) GROUP BY c, i)",
                f"m{i} AS MATERIALIZED (SELECT c, list({floored} ORDER BY i) AS v FROM p{i} GROUP BY c)",
                f"c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} USING (c))",
            ]
    return f"""WITH {", ".join(steps)}
        SELECT vec_id, CAST(a{rounds}.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a{rounds}.c) AS BIGINT) AS cluster_inertia,
            CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} USING (c)"""
