"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from postmill.llm.common import ship, written

EDGES_AT_ONCE = 200_000


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of some edges and the least node that it reaches by them."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    least = np.arange(len(nodes))
    while len(x):
        x, y = least[x], least[y]
        apart = x != y
        x, y = x[apart], y[apart]
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while (least[least] != least).any():
            least = least[least]
    return nodes, nodes[least]


def _contracted(edges: DataFrame) -> DataFrame:
    """Stars with the components of ``edges``, as far as a task sees them in blocks of its own edges: rounds between tasks are left."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def stars() -> pd.DataFrame:
            node, least = least_reached(*(np.concatenate([h[c].to_numpy() for h in held]) for c in "ab"))
            return pd.DataFrame({"a": node, "b": least})[node != least]

        held: list[pd.DataFrame] = []
        for b in batches:
            held.append(b)
            if sum(map(len, held)) >= EDGES_AT_ONCE:
                yield stars()
                held = []
        if held:
            yield stars()

    return edges.mapInPandas(run, "a bigint, b bigint")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Connect the neighbours of each node, greater ones or smaller ones, to the least of its neighbourhood."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    side = both if large else both.where("b < a")
    least = side.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = side.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("x"), F.col("m").alias("y"))
    else:
        out = joined.select(F.col("b").alias("x"), F.col("m").alias("y")).unionAll(least.select(F.col("a").alias("x"), F.col("m").alias("y")))
    return out.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def _state(edges: DataFrame) -> Row:
    """Number and sum of hashes of edges."""
    return edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of every node of ``edges`` (``a, b``): the least node that it reaches.

    Each task first contracts its own edges, so few rounds are left; their number is logarithmic in the longest path, and each is
    written to the shared folder. Nodes without edges do not appear; null ends and loops are ignored.
    """
    own = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(
        F.greatest("a", "b").cast("bigint").alias("a"), F.least("a", "b").cast("bigint").alias("b")
    )
    now = written(_contracted(own.distinct()), "edges")
    state = _state(now)
    while True:
        now = written(_star(_star(now, True), False), "edges")
        new = _state(now)
        if new == state:
            break
        state = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


ship(__name__)
