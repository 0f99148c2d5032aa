"""Centroid clustering on bit planes: dot products and distances are weighted popcounts of packed words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import bound_batches, ship, written

LONG = (1 << 63) - 1
EDGE = 9.2e18  # components beyond it count as it: the largest double that is safe as a long
MASK = (1 << 64) - 1
ROWS = 4_096
ADDERS = 16


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)`` in double precision, held inside the range of a long."""
    with np.errstate(over="ignore"):
        return np.floor(np.clip(scale * x.astype(np.float64), -EDGE, EDGE)).astype(np.int64)


def planes_for(low: int, high: int) -> int:
    """Bits of two's complement that hold every integer from ``low`` to ``high``."""
    return max(high.bit_length(), (-low - 1).bit_length() if low < 0 else 0) + 1


def pack(values: np.ndarray, bits: int) -> np.ndarray:
    """``(rows, components)`` integers as ``(rows, bits, words)``: bit ``c % 64`` of word ``c // 64`` is component ``c``."""
    words = -(-values.shape[1] // 64)
    wide = np.zeros((len(values), words * 64), dtype=np.int64)
    wide[:, : values.shape[1]] = values
    out = np.empty((len(values), bits, words), dtype="<u8")
    for i in range(bits):
        bit = ((wide >> i) & 1).astype(np.uint8)
        out[:, i] = np.packbits(bit, axis=1, bitorder="little").view("<u8")
    return out


def unpack_plane(plane: np.ndarray) -> np.ndarray:
    """``(rows, words)`` of one plane as zeros and ones by component."""
    return np.unpackbits(np.ascontiguousarray(plane).view(np.uint8), axis=1, bitorder="little")


def weight(i: int, bits: int) -> int:
    """What a set bit of plane ``i`` is worth; the last plane is the sign."""
    return -(1 << i) if i == bits - 1 else 1 << i


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of packed rows, modulo ``2 ** 64``; leading axes follow numpy's broadcasting."""
    bits = a.shape[-2]
    total = np.zeros(np.broadcast_shapes(a.shape[:-2], b.shape[:-2]), dtype=np.uint64)
    for i in range(bits):
        for j in range(bits):
            shared = np.bitwise_count(a[..., i, :] & b[..., j, :]).sum(axis=-1, dtype=np.uint64)
            total += shared * np.uint64((weight(i, bits) * weight(j, bits)) & MASK)
    return total


def rough(planes: np.ndarray) -> np.ndarray:
    """The components of packed rows as doubles."""
    bits = planes.shape[1]
    return sum(weight(i, bits) * unpack_plane(planes[:, i]).astype(np.float64) for i in range(bits))


def distances(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances ``(rows, centroids)``: exact, or the largest long where they exceed it."""
    own, theirs = dots(rows, rows), dots(centroids, centroids)
    cross = dots(rows[:, None], centroids[None])
    out = (own[:, None] + theirs[None, :] - cross - cross).view(np.int64)
    if 2 * rows.shape[1] + (64 * rows.shape[2]).bit_length() > 62:
        with np.errstate(over="ignore"):
            near = ((rough(rows)[:, None] - rough(centroids)[None]) ** 2).sum(axis=2)
        out = np.where((near >= float(1 << 63)) | (out < 0), LONG, out)
    return out


def _planes(column: pa.Array, bits: int, words: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).view("<u8").reshape(-1, bits, words)


def _assigned(planes: np.ndarray, centroids: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    for s in range(0, len(planes), ROWS):
        d = distances(planes[s : s + ROWS], centroids)
        cluster = d.argmin(axis=1)
        yield slice(s, s + len(d)), cluster, d[np.arange(len(d)), cluster]


class CountPlanes:
    """Per cluster the rows assigned to it and how many of them have each bit of each plane set."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids = centroids

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, bits, words = self.centroids.shape
        rows, counts = np.zeros(k, dtype=np.int64), np.zeros((k, bits, words * 64), dtype=np.int64)
        for batch in batches:
            planes = _planes(batch.column("planes"), bits, words)
            for at, cluster, _ in _assigned(planes, self.centroids):
                rows += np.bincount(cluster, minlength=k)
                for i in range(bits):
                    set_bits = unpack_plane(planes[at, i])
                    for c in range(k):
                        counts[c, i] += set_bits[cluster == c].sum(axis=0, dtype=np.int64)
        yield _counted(rows, counts.reshape(k, -1))


def _counted(rows: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * counts.shape[1], pa.int32()), pa.array(counts.ravel()))
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows)), pa.int32()), pa.array(rows), lists], ["cluster", "n", "counts"])


def add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of many partial counts, cluster by cluster."""
    rows: dict[int, list] = {}
    for batch in batches:
        for cluster, n, counts in zip(batch.column("cluster").to_pylist(), batch.column("n").to_pylist(), batch.column("counts"), strict=True):
            held = rows.setdefault(cluster, [0, 0])
            held[0] += n
            held[1] = held[1] + counts.values.to_numpy()
    if rows:
        order = sorted(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(order, pa.int32()), pa.array([rows[c][0] for c in order], pa.int64()), pa.array([rows[c][1] for c in order], pa.list_(pa.int64()))],
            ["cluster", "n", "counts"],
        )


def _packer(key: str, scale: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            planes = pack(integers(x, scale), bits)
            flat = planes.reshape(len(planes), -1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * flat.shape[1], pa.int32()), pa.array(flat.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(key), lists], [key, "planes"])

    return run


def _assigner(key: str, centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, bits, words = centroids.shape
        for batch in batches:
            parts = list(_assigned(_planes(batch.column("planes"), bits, words), centroids))
            if parts:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key), pa.array(np.concatenate([c for _, c, _ in parts]), pa.int32()), pa.array(np.concatenate([d for _, _, d in parts]))],
                    [key, "cluster", "distance"],
                )

    return run


def kept_vectors(vectors: DataFrame, dims: int, key: str, vector: str) -> DataFrame:
    """Rows of exactly ``dims`` finite components, as ``key`` and ``v``."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where((F.size(vector) == dims) & F.coalesce(finite, F.lit(False))).select(F.col(key), F.col(vector).alias("v"))


def bitplane_clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, dims: int = 64, key: str = "vec_id",
                      vector: str = "embedding", start: Column | None = None) -> DataFrame:
    """Lloyd's rounds on integer components: ``key, cluster, distance, cluster_inertia, inertia, centroid_sha256``.

    Vectors of exactly ``dims`` finite components take part, each component as ``floor(scale * x)``; all others are
    left out. Every bit plane of 64 components is one word, written once; a round reads the words alone. The
    ``k`` rows of least ``start`` (default: the hash of ``3:<key>``) are the first centroids, ties by their components; fewer rows
    make fewer clusters. A round assigns each row to its nearest centroid (ties: the smaller number) and replaces the centroid
    by the floor of the mean of its rows, from exact counts of set bits per plane, added up in tasks before the driver sees
    them: ``k`` arrays from each of ``ADDERS``. Rows of a null key take part and start last; repeated rows count as
    often as they occur. Components beyond 9.2e18 count as that, sums and distances beyond a long as the largest long. Other
    columns, whatever their names, are not read; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = kept_vectors(vectors, dims, key, vector)
    span = rows.agg(F.min(F.array_min("v")).alias("low"), F.max(F.array_max("v")).alias("high")).first()
    low, high = (int(integers(np.array([x or 0.0]), scale)[0]) for x in (span["low"], span["high"]))
    bits, words = planes_for(low, high), -(-dims // 64)
    kind = rows.schema[key].dataType.simpleString()
    shown = F.concat(F.lit("3:"), F.col(key).cast("string"))
    begin = F.sha2(shown.cast("binary"), 256) if start is None else start
    first = rows.select(begin.alias("b"), "v").orderBy(F.asc_nulls_last("b"), "v").limit(k).collect()
    if not first:
        return spark.createDataFrame([], f"{key} {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    centroids = integers(np.array([r["v"] for r in first]), scale)
    packed = written(rows.mapInArrow(_packer(key, scale, bits), f"{key} {kind}, planes array<bigint>"), "planes")
    weights = np.array([weight(i, bits) for i in range(bits)], dtype=object)[:, None]
    for _ in range(rounds):
        partial = packed.mapInArrow(CountPlanes(pack(centroids, bits)), "cluster int, n bigint, counts array<bigint>")
        spread = partial.repartition(ADDERS, F.spark_partition_id(), "cluster")
        total = next(add_counts(iter(pa.table(spread.mapInArrow(add_counts, partial.schema).toArrow()).to_batches())), None)
        for cluster, n, counts in zip(*(total.column(c) for c in ("cluster", "n", "counts")), strict=True):
            if n.as_py():
                by_plane = counts.values.to_numpy().reshape(bits, -1)[:, :dims].astype(object)
                centroids[cluster.as_py()] = [int(s) // n.as_py() for s in (weights * by_plane).sum(axis=0)]
    done = written(packed.mapInArrow(_assigner(key, pack(centroids, bits)), f"{key} {kind}, cluster int, distance bigint"), "clusters")
    sums = {r["cluster"]: int(r["s"]) for r in done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    facts = [
        (c, min(s, LONG), min(sum(sums.values()), LONG), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
        for c, s in sums.items()
    ]
    named = spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    # One row per cluster, k at most.
    return done.join(F.broadcast(named), "cluster").select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


ship(__name__)
