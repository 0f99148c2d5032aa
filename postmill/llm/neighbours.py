"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postmill.llm.common import bound_batches, ship, written

TABLES = 12
PROBES = 6
BUCKET = 4_000
BLOCK = 4_000
RECALL = 0.95  # of the sampled queries; leaves room for the sample's error above 0.9
SAMPLE = 200
SEED = 20_240_101


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the width is a power of two."""
    y, h = x.copy(), 1
    while h < y.shape[1]:
        y = y.reshape(len(x), -1, 2, h)
        y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), -1)
        h *= 2
    return y / math.sqrt(y.shape[1])


def rotated(x: np.ndarray, table: int, part: int) -> np.ndarray:
    """A pseudo-rotation: three rounds of random signs and a Hadamard transform."""
    width = 1 << max(0, x.shape[1] - 1).bit_length()
    y = np.zeros((len(x), width))
    y[:, : x.shape[1]] = x
    rng = np.random.default_rng([SEED, table, part])
    for _ in range(3):
        y = hadamard(y * rng.choice([-1.0, 1.0], size=width))
    return y


def polytopes(dims: int, bits: int) -> list[int]:
    """Axes used of each pseudo-rotation for ``2 ** bits`` buckets: whole cross-polytopes, the last one of fewer axes.

    Each further bit doubles the buckets, so their number can follow the data in small steps.
    """
    whole = max(1, dims - 1).bit_length() + (dims > 1)
    width = 1 << (whole - 1)
    rest = bits % whole
    return [width] * (bits // whole) + ([1 << (rest - 1)] if rest else [])


def own_buckets(x: np.ndarray, table: int, bits: int) -> np.ndarray:
    """The nearest signed axis of each polytope, as one number."""
    out = np.zeros(len(x), dtype=np.int64)
    for part, axes in enumerate(polytopes(x.shape[1], bits)):
        y = rotated(x, table, part)[:, :axes]
        axis = np.abs(y).argmax(axis=1)
        out = out * (2 * axes) + 2 * axis + (y[np.arange(len(y)), axis] < 0)
    return out


def probe_buckets(x: np.ndarray, table: int, bits: int, probes: int) -> np.ndarray:
    """Per row the ``probes`` buckets of least total distance to its rotations, its own first."""
    total, codes = np.zeros((len(x), 1)), np.zeros((len(x), 1), dtype=np.int64)
    for part, axes in enumerate(polytopes(x.shape[1], bits)):
        y = rotated(x, table, part)[:, :axes]
        signed = np.concatenate([y, -y], axis=1)
        best = np.argsort(-signed, axis=1, kind="stable")[:, :probes]
        code = np.where(best < axes, 2 * best, 2 * (best - axes) + 1)
        near = np.take_along_axis(signed, best, axis=1)
        total = (total[:, :, None] + near[:, None, :]).reshape(len(x), -1)
        codes = (codes[:, :, None] * (2 * axes) + code[:, None, :]).reshape(len(x), -1)
        keep = np.argsort(-total, axis=1, kind="stable")[:, :probes]
        total, codes = np.take_along_axis(total, keep, axis=1), np.take_along_axis(codes, keep, axis=1)
    return codes


def even(x: np.ndarray) -> np.ndarray:
    """Rows brought to a largest magnitude from 0.5 to 1 by a power of two, which changes no cosine: their squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length one."""
    y = even(x)
    return y / np.linalg.norm(y, axis=1, keepdims=True)


def cosines(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Cosines of all pairs of rows in double precision."""
    queries, vectors = even(queries), even(vectors)
    qq, vv = np.einsum("ij,ij->i", queries, queries), np.einsum("ij,ij->i", vectors, vectors)
    return (queries @ vectors.T) / np.sqrt(qq[:, None] * vv[None, :])


def matrix(column: pd.Series) -> np.ndarray:
    return np.array([np.asarray(v, dtype=np.float64) for v in column])


class BestOfBuckets:
    """Scores the queries of each bucket against its vectors as sorted rows stream by."""

    def __init__(self, k: int) -> None:
        self.k = k

    def one(self, group: pd.DataFrame) -> pd.DataFrame:
        queries, vectors = group[group["side"] == 1], group[group["side"] == 0]
        out = []
        if len(queries) and len(vectors):
            v, ids, least = matrix(vectors["embedding"]), vectors["vkey"].to_numpy(), vectors["least"].to_numpy()
            by_id = np.argsort(least, kind="stable")
            for s in range(0, len(queries), 256):
                part = queries.iloc[s : s + 256]
                sims = cosines(matrix(part["embedding"]), v)[:, by_id]
                k = min(self.k, len(v))
                top = np.argsort(-sims, axis=1, kind="stable")[:, :k]
                out.append(pd.DataFrame({
                    "qkey": np.repeat(part["vkey"].to_numpy(), k), "vkey": ids[by_id][top].ravel(), "least": least[by_id][top].ravel(),
                    "score": np.take_along_axis(sims, top, axis=1).ravel(),
                }))
        return pd.concat(out) if out else pd.DataFrame({"qkey": [], "vkey": [], "least": [], "score": []})

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        names = ["tab", "bucket", "salt"]
        for b in batches:
            b = b if held is None else pd.concat([held, b])
            groups = [g for _, g in b.groupby(names, sort=False)]
            held = groups.pop() if groups else None
            for g in groups:
                yield self.one(g).astype({"qkey": "int64", "vkey": "int64", "least": "int64", "score": "float64"})
        if held is not None:
            yield self.one(held).astype({"qkey": "int64", "vkey": "int64", "least": "int64", "score": "float64"})


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows whose vector has a direction: ``id`` and ``embedding``."""
    sound = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.select(F.col(key).alias("id"), F.col(vector).alias("embedding")).where(
        F.col("id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(sound, F.lit(False))
        & F.exists("embedding", lambda x: x != 0)
    )


def nearest(vectors: DataFrame, is_query, k: int = 5, key: str = "vec_id", vector: str = "embedding", tables: int = TABLES,
            probes: int = PROBES, bucket: int = BUCKET) -> DataFrame:
    """The ``k`` nearest vectors by cosine of each row where ``is_query`` holds: ``query_id, rank, vec_id, score``.

    Equal vectors are hashed once, with their ``k + 1`` smallest ids, so copies make no hot bucket; equal rows count once. Each
    vector enters one bucket of each table; a query probes ``probes`` buckets per table. Buckets of more
    than ``BLOCK`` vectors are split and the query sent to each part. Scores are exact; ties go to the smaller id;
    rows of the query's own id are no neighbours of it. A query that finds fewer than ``k`` is compared with all vectors, in
    blocks. The number of buckets follows that of vectors, about ``bucket`` in each, but only as far as the true
    neighbours of a sample of the queries are found: probes grow up to four times ``probes``, then buckets become
    coarser, until ``RECALL`` of them share a bucket with their query. Null ids and vectors that are null, empty, zero or not finite take no part; rows of one id and several
    vectors count as several rows. Vectors of another length than the query's meet none of its buckets.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = usable(vectors, key, vector)
    queries = usable(vectors.where(is_query), key, vector)
    per = W.partitionBy("embedding").orderBy("id")
    distinct = (
        rows.withColumn("rn", F.dense_rank().over(per)).where(F.col("rn") <= k + 1)
        .groupBy("embedding").agg(F.sort_array(F.collect_set("id")).alias("ids"))
        .select(F.monotonically_increasing_id().alias("vkey"), F.element_at("ids", 1).alias("least"), "ids", "embedding")
    )
    distinct = written(distinct, "vectors")
    asked = written(queries.join(distinct.select("vkey", "embedding"), "embedding").select("id", "vkey").distinct(), "queries")
    # A query of an id with several vectors may find all of those first.
    own = asked.groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    searched = distinct.join(asked.select("vkey").distinct(), "vkey", "left_semi")
    size = distinct.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d")).first()
    n, dims = size["n"], max(1, size["d"] or 1)
    bits = max(max(0, dims - 1).bit_length() + 1, round(math.log2(max(1, n / bucket))))
    bits, probes = fitted(_sample_pairs(distinct, searched, k), bits, tables, probes)
    enter = _entries(distinct, 0, bits, tables, 1)
    probe = _entries(searched, 1, bits, tables, probes)
    heavy = enter.groupBy("tab", "bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK).select(
        "tab", "bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("salts")
    )

    def salted(df: DataFrame) -> DataFrame:
        return df.join(heavy, ["tab", "bucket"], "left").withColumn("salts", F.coalesce("salts", F.lit(1)))

    entered = salted(enter).withColumn("salt", F.pmod(F.xxhash64("vkey"), F.col("salts")).cast("int"))
    probed = salted(probe).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    found = _scored(entered.drop("salts").unionByName(probed.drop("salts")), k + own)
    best = _ranked(found, distinct, asked, k)
    short = asked.join(best.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), F.col("query_id") == F.col("id"), "left").where(
        F.coalesce("n", F.lit(0)) < k
    ).select("id", "vkey")
    best, short = written(best, "neighbours"), written(short, "short")
    if not short.isEmpty() and n > 1:
        asked_again = distinct.join(short.select("vkey").distinct(), "vkey", "left_semi")
        blocks = [r[0] for r in asked_again.select(F.pmod(F.xxhash64("vkey"), F.lit(16)).alias("bucket")).distinct().collect()]  # 16 at most
        block = F.pmod(F.xxhash64("vkey"), F.lit(16))
        parts_of = max(1, -(-n // BLOCK))
        part = F.pmod(F.xxhash64("vkey", F.lit(1)), F.lit(parts_of)).cast("int")
        every = distinct.select(
            F.lit(0).alias("side"), F.lit(0).alias("tab"), F.explode(F.array(*[F.lit(x) for x in blocks])).alias("bucket"), part.alias("salt"), "vkey", "least", "embedding"
        ).toDF("side", "tab", "bucket", "salt", "vkey", "least", "embedding")
        sought = asked_again.select(
            F.lit(1).alias("side"), F.lit(0).alias("tab"), block.alias("bucket"),
            F.explode(F.sequence(F.lit(0), F.lit(parts_of - 1))).alias("salt"), "vkey", F.col("vkey").alias("least"), "embedding",
        )
        again = _ranked(_scored(every.unionByName(sought), k + own), distinct, short, k)
        best = best.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(again)
    return best


def fitted(pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]], bits: int, tables: int, probes: int) -> tuple[int, int]:
    """The most bits, up to ``bits``, and the fewest probes with which ``RECALL`` of the pairs meet in a bucket.

    ``pairs`` are queries, vectors and the query's number of each vector, per length. With one bit two probes
    are all there is, so the search ends with everything found.
    """
    total = sum(len(of) for _, _, of in pairs)
    if not total:
        return bits, probes
    most = 4 * max(2, probes)
    for b in range(bits, 0, -1):
        least = []
        for queries, vectors, of in pairs:
            rank = np.full(len(of), most)
            for tab in range(tables):
                same = probe_buckets(queries, tab, b, most)[of] == own_buckets(vectors, tab, b)[:, None]
                rank = np.minimum(rank, np.where(same.any(axis=1), same.argmax(axis=1), most))
            least.append(rank)
        rank = np.concatenate(least)
        for p in (probes, 2 * probes, most):
            if (rank < p).sum() >= RECALL * total:
                return b, p
    return 1, most


def _sample_pairs(distinct: DataFrame, searched: DataFrame, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Up to ``SAMPLE`` queries, drawn by hash, with their ``k`` nearest other vectors by comparison with all."""
    m = searched.count()
    share = F.pmod(F.xxhash64("vkey", F.lit(SEED)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 2 * SAMPLE / max(1, m)))
    drawn = sorted(searched.where(share).select(F.xxhash64("vkey", F.lit(SEED)).alias("h"), "vkey", "embedding").collect())[:SAMPLE]
    by: dict[int, list] = {}
    for r in drawn:
        by.setdefault(len(r.embedding), []).append(r)
    asked = {d: (np.array([r.vkey for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)) for d, rows in by.items()}

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            for d, g in b.groupby(b["embedding"].map(len)):
                if d not in asked:
                    continue
                keys, queries = asked[d]
                sims, vkeys = cosines(queries, matrix(g["embedding"])), g["vkey"].to_numpy()
                sims[keys[:, None] == vkeys[None, :]] = -np.inf
                top = np.argsort(-sims, axis=1, kind="stable")[:, :k]
                new = pd.DataFrame({
                    "qkey": np.repeat(keys, top.shape[1]), "vkey": vkeys[top].ravel(), "score": np.take_along_axis(sims, top, axis=1).ravel(),
                })
                held = new if held is None else pd.concat([held, new])
                held = held.sort_values("score", ascending=False, kind="stable").groupby("qkey").head(k)
        if held is not None:
            yield held[held["score"] > -np.inf]

    order = W.partitionBy("qkey").orderBy(F.desc("score"), "vkey")
    found = distinct.select("vkey", "embedding").mapInPandas(best, "qkey bigint, vkey bigint, score double")
    found = found.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k).join(distinct.select("vkey", "embedding"), "vkey")
    out = []
    near = found.select("qkey", "vkey", "embedding").collect() if asked else []
    for keys, queries in asked.values():
        at = {key: i for i, key in enumerate(keys.tolist())}
        mine = [r for r in near if r.qkey in at]
        if mine:
            vectors = np.array([r.embedding for r in mine], dtype=np.float64)
            out.append((units(queries), units(vectors), np.array([at[r.qkey] for r in mine])))
    return out


def _entries(vectors: DataFrame, side: int, bits: int, tables: int, probes: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, g in b.groupby(b["embedding"].map(len)):
                x = units(matrix(g["embedding"]))
                for tab in range(tables):
                    codes = own_buckets(x, tab, bits)[:, None] if side == 0 else probe_buckets(x, tab, bits, probes)
                    for p in range(codes.shape[1]):
                        yield pd.DataFrame({
                            "side": side, "tab": tab, "bucket": codes[:, p] * 65_536 + x.shape[1], "vkey": g["vkey"].to_numpy(),
                            "least": g["least"].to_numpy(), "embedding": g["embedding"].to_numpy(),
                        })

    kind = dict(vectors.dtypes)["embedding"]
    return vectors.select("vkey", "least", "embedding").mapInPandas(
        run, f"side int, tab int, bucket bigint, vkey bigint, least bigint, embedding {kind}"
    )


def _scored(entries: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each query in each bucket: buckets are whole in one task and at most ``BLOCK`` vectors long."""
    dealt = entries.repartition("tab", "bucket", "salt").sortWithinPartitions("tab", "bucket", "salt", "side")
    found = dealt.mapInPandas(BestOfBuckets(k), "qkey bigint, vkey bigint, least bigint, score double")
    each = found.groupBy("qkey", "vkey", "least").agg(F.max("score").alias("score"))
    top = W.partitionBy("qkey").orderBy(F.desc("score"), "least", "vkey")
    return each.withColumn("rn", F.row_number().over(top)).where(F.col("rn") <= k).drop("rn")


def _ranked(found: DataFrame, distinct: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Back from distinct vectors to rows: the first ``k`` whose id is not the query's own."""
    ids = found.join(distinct.select("vkey", "ids"), "vkey").select("qkey", "score", F.explode("ids").alias("vec_id"))
    top = W.partitionBy("query_id", "qkey").orderBy(F.desc("score"), "vec_id")
    others = asked.select(F.col("id").alias("query_id"), F.col("vkey").alias("qkey")).join(ids, "qkey").where("vec_id <> query_id")
    ranked = others.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


ship(__name__)
