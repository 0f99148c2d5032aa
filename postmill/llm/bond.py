"""Hard negatives by a vertical scan: columns are read dimension by dimension and candidates leave by their bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postmill.llm.common import bound_batches, ship, written

BLOCK_ROWS = 16_384
SLICE_ANCHORS = 65_536
STEP = 8  # dimensions read between two looks at the bounds
EDGE = 9.2e18
LONG = (1 << 63) - 1


class Columns:
    """The rows of one length of one block, by dimension, with the least and greatest value of each dimension."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels = ids[order], labels[order]
        self.by_dim = np.ascontiguousarray(values[order].T)
        self.low, self.high = self.by_dim.min(axis=1), self.by_dim.max(axis=1)

    def scan(self, anchor: np.ndarray, alive: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray]:
        """Rows that ``keep`` leaves alive, with their exact inner products.

        Dimensions are read in order of the anchor's descending magnitude. ``keep`` gets the least and the greatest
        score that each living row can still reach and returns the bitmap of those that stay.
        """
        wide = _needs_objects(anchor, self.low, self.high)
        a = anchor.astype(object) if wide else anchor
        order = np.argsort(-np.abs(anchor.astype(np.float64)), kind="stable")
        ends = np.stack([a * self.low, a * self.high])[:, order]
        rest = np.zeros((2, len(a) + 1), dtype=ends.dtype)
        rest[0, :-1] = ends.min(axis=0)[::-1].cumsum()[::-1]
        rest[1, :-1] = ends.max(axis=0)[::-1].cumsum()[::-1]
        scores = np.zeros(len(alive), dtype=a.dtype)
        for s in range(0, len(a), STEP):
            if not len(alive):
                break
            dims = order[s : s + STEP]
            for d in dims:
                read = self.by_dim[d, alive]
                scores = scores + a[d] * (read.astype(object) if wide else read)
            done = s + len(dims)
            stay = keep(alive, scores + rest[0, done], scores + rest[1, done])
            if not stay.all():
                alive, scores = alive[stay], scores[stay]
        return alive, scores


def _needs_objects(anchor: np.ndarray, low: np.ndarray, high: np.ndarray) -> bool:
    """Whether sums of products could leave the range of a long."""
    reach = np.maximum(np.abs(low.astype(np.float64)), np.abs(high.astype(np.float64)))
    return float((np.abs(anchor.astype(np.float64)) * reach).sum()) >= 2.0**61


def kth_largest(values: np.ndarray, k: int):
    return np.sort(values)[-k] if values.dtype == object else np.partition(values, len(values) - k)[len(values) - k]


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The first ``k`` by descending score and ascending id; ids come ascending."""
    top = np.argsort(-scores, kind="stable")[:k]
    return [(int(ids[i]), max(-LONG - 1, min(LONG, int(scores[i])))) for i in top]


def scan_positives(block: Columns, anchor_id: int, label: int, anchor: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The ``k`` best rows of the anchor's label in this block."""

    def keep(alive: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return high >= kth_largest(low, k) if len(low) > k else np.ones(len(low), dtype=bool)

    alive, scores = block.scan(anchor, np.flatnonzero((block.labels == label) & (block.ids != anchor_id)), keep)
    return best(block.ids[alive], scores, k)


def window(score: int, low_pct: int, high_pct: int) -> tuple[int, int]:
    """Least and greatest integer ``n`` with ``low_pct * score <= 100 * n <= high_pct * score``."""
    return -(-low_pct * score // 100), high_pct * score // 100


def scan_negatives(block: Columns, label: int, anchor: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[list[tuple[int, int]]]:
    """Per window the ``k`` best rows of other labels whose score lies in it."""

    def keep(alive: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        stay = np.zeros(len(low), dtype=bool)
        for least, most in windows:
            if least <= most:
                sure = low[(low >= least) & (high <= most)]
                least = max(least, kth_largest(sure, k)) if len(sure) >= k else least
                stay |= (high >= least) & (low <= most)
        return stay

    alive, scores = block.scan(anchor, np.flatnonzero(block.labels != label), keep)
    ids, out = block.ids[alive], []
    for least, most in windows:
        inside = (scores >= least) & (scores <= most)
        out.append(best(ids[inside], scores[inside], k))
    return out


def _vectors(column: pa.Array) -> list[np.ndarray]:
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[s:e] for s, e in zip(ends[:-1], ends[1:], strict=True)]


class Blocks:
    """Holds the rows of one block and passes the anchors that follow them, one by one, to ``each``."""

    def __init__(self, each) -> None:
        self.each = each

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, columns = None, [], {}
        for batch in batches:
            found = []
            lists = zip(
                batch.column("block").to_pylist(), batch.column("slice").to_pylist(), batch.column("side").to_pylist(), batch.column("id").to_pylist(),
                batch.column("label").to_pylist(), _vectors(batch.column("v")), batch.column("positives").to_pylist(), strict=True,
            )
            for block, part, side, i, label, v, positives in lists:
                if (block, part) != at:
                    at, rows, columns = (block, part), [], {}
                if side == 0:
                    rows.append((i, label, v.copy()))
                    continue
                if rows:
                    columns, rows = _columns(rows), []
                if len(v) in columns:
                    found += self.each(columns[len(v)], i, label, v, positives)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["anchor_id", "positive_id", "row_id", "positive_score", "score"])


def _columns(rows: list) -> dict[int, Columns]:
    by: dict[int, list] = {}
    for row in rows:
        by.setdefault(len(row[2]), []).append(row)
    return {
        d: Columns(np.array([r[0] for r in same]), np.array([r[1] for r in same]), np.array([r[2] for r in same]).reshape(len(same), d))
        for d, same in by.items()
    }


def _meet(rows: DataFrame, anchors: DataFrame, blocks: int, slices: int, each) -> DataFrame:
    """Every anchor with every block of rows: a task holds one block and streams one slice of the anchors."""
    spread = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    part = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(slices)).cast("int")
    held = rows.select(spread.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(0).alias("side"), "id", "label", "v",
                       F.lit(None).cast("array<struct<id:bigint,score:bigint>>").alias("positives"))
    asked = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), part.alias("slice"), F.lit(1).alias("side"), "id", "label", "v", "positives")
    dealt = held.unionByName(asked).repartition(min(blocks * slices, 20_000), "block", "slice").sortWithinPartitions("block", "slice", "side")
    return dealt.mapInArrow(Blocks(each), "anchor_id bigint, positive_id bigint, row_id bigint, positive_score bigint, score bigint")


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = W.partitionBy(*keys).orderBy(F.desc("score"), "row_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def usable(vectors: DataFrame, is_anchor: Column, label: Column, scale: int, key: str, vector: str) -> DataFrame:
    """Rows with an id, a label and finite components, as ``id, label, v, anchor``; of rows of one id the least."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(EDGE)), F.lit(-EDGE))))
    rows = vectors.where(F.coalesce(finite, F.lit(False)) & F.col(key).isNotNull()).select(
        F.col(key).cast("bigint").alias("id"), label.cast("bigint").alias("label"), whole.alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor")
    )
    return rows.where("label IS NOT NULL").groupBy("id").agg(F.min(F.struct("label", "v", "anchor")).alias("r")).select("id", "r.label", "r.v", "r.anchor")


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 3, low_pct: int = 50, high_pct: int = 95,
                   scale: int = 256, key: str = "vec_id", vector: str = "embedding", block_rows: int = BLOCK_ROWS,
                   slice_anchors: int = SLICE_ANCHORS) -> DataFrame:
    """For each anchor and each of its first positives the first negatives in the score window below it.

    ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``. Components are ``floor(scale * x)``, a score is
    their exact inner product. ``is_anchor`` is a condition on the table. Positives are the first ``positives`` rows of
    the anchor's label, negatives the first ``negatives`` rows of other labels with ``low_pct * p <= 100 * n <= high_pct * p``; higher
    scores come first, ties by smaller id. All rows meet all anchors, in blocks of about ``block_rows`` rows by dimension: a task holds
    one block and streams at most about ``slice_anchors`` anchors past it. A row leaves a block's bitmap once the
    part of its score that was read, with the greatest and least that the unread dimensions can add, puts it outside every window or below
    ``negatives`` rows that are surely inside; what stays to the last dimension has its exact score.

    Rows without id, label or vector and with a component that is null or not finite take no part; of several rows of one id
    only the least ``(label, vector)`` counts. Vectors meet those of their own length. Empty vectors score 0. Components beyond
    9.2e18 count as that; scores are exact in a block but leave it as the nearest long. Other columns are not read.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = written(usable(vectors, is_anchor, label, scale, key, vector), "rows")
    anchors = rows.where("anchor")
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("anchor").alias("a")).first()
    blocks, slices = max(1, -(-counts["n"] // block_rows)), max(1, -(-counts["a"] // slice_anchors))

    def near(block: Columns, i: int, own: int, v: np.ndarray, _) -> list[tuple]:
        return [(i, i, row, 0, score) for row, score in scan_positives(block, i, own, v, positives)]

    def far(block: Columns, i: int, own: int, v: np.ndarray, known: list) -> list[tuple]:
        windows = [window(p["score"], low_pct, high_pct) for p in known]
        found = scan_negatives(block, own, v, windows, negatives)
        return [(i, p["id"], row, p["score"], score) for p, hits in zip(known, found, strict=True) for row, score in hits]

    none = F.lit(None).cast("array<struct<id:bigint,score:bigint>>")
    matched = _first(_meet(rows, anchors.withColumn("positives", none), blocks, slices, near), ["anchor_id"], positives)
    # At most ``positives`` entries an anchor.
    per_anchor = matched.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct(F.col("row_id").alias("id"), "score")).alias("positives"))
    known = written(anchors.join(per_anchor, "id"), "anchors")
    mined = _first(_meet(rows, known, blocks, slices, far), ["anchor_id", "positive_id"], negatives)
    return mined.select("anchor_id", "positive_id", F.col("rank").cast("int"), F.col("row_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


ship(__name__)
