"""Packing of token sequences by patterns whose repeats solve a non-negative least squares problem."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.bpe import byte_letters
from postmill.llm.common import bound_batches, once, place_in_spans, ranks_in_groups, ship, written

SEPARATOR = 0
LONG_TEXT = 1_000_000


def tokenizer(path: str):
    """The tokenizer of a file, read once in a Python process."""
    return once(("packing", path), lambda: read_tokenizer(path))


def read_tokenizer(path: str):
    """A function from text to ids. The merge ranks of the file are run by the faster of two libraries with
    the same pattern and vocabulary; very long texts go to the library of the file's format itself."""
    import json

    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte_of = {c: b for b, c in enumerate(byte_letters())}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    # Fixed value: the pattern of byte-level pre-tokenizers.
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    plain = Tokenizer.from_file(path)

    def ids(text: str) -> np.ndarray:
        if len(text) > LONG_TEXT:
            return np.array(plain.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        allowed = "all" if "<|" in text else set()
        return np.asarray(fast.encode_to_numpy(text, allowed_special=allowed, disallowed_special=()), dtype=np.uint32)

    return ids


def pieces_of(docs: DataFrame, path: str, window: int, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Each document's ids with a separator, cut into pieces of ``window`` ids; the first may be shorter.

    Null and empty texts are one piece, the separator. Texts are taken whole; repeated rows stay.
    """
    bound_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[key]
    more = ", ids array<int>" if with_ids else ""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, t in zip(b[key], b[text]):
                ids = np.append(tokenizer(path)(t) if isinstance(t, str) else np.empty(0, np.uint32), np.uint32(SEPARATOR)).astype("<u4")
                starts = [0, *range((len(ids) - 1) % window + 1, len(ids), window)]
                for piece, (low, high) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                    part = ids[low:high]
                    rows.append((doc, piece, low, high - low, zlib.crc32(part.tobytes()), *([part.astype(np.int32)] if with_ids else [])))
            names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
            yield pd.DataFrame(rows, columns=names)

    # Ids travel as text: pandas would turn whole numbers beside nulls into fractions.
    cut = docs.select(F.col(f"`{key}`").cast("string").alias(key), F.col(f"`{text}`")).mapInPandas(
        run, f"doc_id string, piece int, start bigint, length bigint, ids_crc32 bigint{more}"
    )
    return cut.withColumn("doc_id", F.col("doc_id").cast(kind))


def full_patterns(lengths: np.ndarray, window: int) -> np.ndarray:
    """All patterns of one, two or three of the lengths that fill ``window`` exactly; 0 stands for no document."""
    present = np.zeros(window + 1, dtype=bool)
    present[lengths] = True
    out = [np.array([[window, 0, 0]])] if present[window] else []
    a = np.arange(window - 1, (window - 1) // 2, -1)
    b = window - a
    ok = present[a] & present[b]
    out.append(np.stack([a[ok], b[ok], np.zeros(ok.sum(), int)], axis=1))
    for first in range(window - 2, -(-window // 3) - 1, -1):
        if not present[first]:
            continue
        second = np.arange(min(first, window - first - 1), (window - first - 1) // 2, -1)
        third = window - first - second
        ok = present[second] & present[third] & (third > 0)
        out.append(np.stack([np.full(ok.sum(), first), second[ok], third[ok]], axis=1))
    return np.concatenate(out) if out else np.empty((0, 3), int)


def fit_repeats(patterns: np.ndarray, histogram: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Non-negative repeats that fit the histogram by weighted least squares: accelerated projected gradient.

    Errors in short lengths weigh less: what is left of them fills gaps with ease. ``histogram[0]`` is unused. The
    step is the inverse of a bound on the largest eigenvalue of the normal matrix, by power iteration.
    """
    weight = np.minimum(1.0, (2.0 * np.arange(len(histogram)) / (len(histogram) - 1)) ** 2)
    weight[0] = 0
    h = histogram * weight

    def use(x: np.ndarray) -> np.ndarray:
        return weight * sum(np.bincount(patterns[:, j], weights=x, minlength=len(h)) for j in range(patterns.shape[1]))

    def back(r: np.ndarray) -> np.ndarray:
        return (weight * r)[patterns].sum(axis=1)

    v = np.ones(len(patterns))
    bound = 1.0
    for _ in range(12):
        v = back(use(v))
        bound = np.linalg.norm(v)
        v /= bound
    x = z = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, z + back(h - use(z)) / (1.1 * bound))
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / after * (new - x)
        x, t = new, after
    return x


def rounded(patterns: np.ndarray, repeats: np.ndarray, histogram: np.ndarray) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """Whole repeats within what the histogram holds, and the residual counts.

    Running totals of the real repeats are cut at whole numbers, so thin repeats of like patterns add up.
    """
    left = histogram.copy()
    wanted = np.diff(np.floor(np.concatenate([[0.0], np.cumsum(repeats)]) + 1e-9)).astype(int)
    chosen = []
    for i in np.flatnonzero(wanted):
        need = Counter(int(p) for p in patterns[i] if p)
        n = min(int(wanted[i]), *(int(left[p]) // c for p, c in need.items()))
        if n > 0:
            for p, c in need.items():
                left[p] -= n * c
            chosen.append((tuple(sorted(need.elements(), reverse=True)), n))
    return chosen, left


def best_fit(counts: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: sequences of one content are kept as one entry with a number."""
    by_room: dict[int, Counter] = {}
    rooms: list[int] = []

    def put(room: int, content: tuple[int, ...], n: int) -> None:
        if room not in by_room:
            by_room[room] = Counter()
            insort(rooms, room)
        by_room[room][content] += n

    for length in range(window, 0, -1):
        left = int(counts[length])
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = window // length
                full, rest = divmod(left, each)
                if full:
                    put(window - each * length, (length,) * each, full)
                if rest:
                    put(window - rest * length, (length,) * rest, 1)
                break
            room = rooms[at]
            content, n = next(iter(by_room[room].items()))
            each = min(room // length, left)
            taken = min(n, left // each)
            by_room[room][content] -= taken
            if not by_room[room][content]:
                del by_room[room][content]
            if not by_room[room]:
                del by_room[room]
                rooms.pop(at)
            put(room - each * length, content + (length,) * each, taken)
            left -= taken * each
    return [(content, n) for group in by_room.values() for content, n in group.items()]


def plan(histogram: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns with their repeats that use the histogram up. Its size depends on ``window`` alone."""
    patterns = full_patterns(np.flatnonzero(histogram), window)
    chosen, left = [], histogram
    if len(patterns):
        chosen, left = rounded(patterns, fit_repeats(patterns, histogram), histogram)
    return chosen + best_fit(left, window)


def spans_of(plan_rows: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """Which ranks of a length go where: ``(length, low, high, first sequence, offset)``."""
    used: Counter = Counter()
    out, sequence = [], 0
    for content, n in plan_rows:
        offset = 0
        for length in content:
            out.append((length, used[length], used[length] + n, sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    return out


def pack(pieces: DataFrame, window: int) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` of 1 to ``window``.

    Only the histogram of lengths, ``window`` numbers, reaches the driver; pieces are matched to places by
    their rank within their length, in slices. ``pieces`` is read twice: give a written table. Equal rows
    may trade places; an empty table stays empty; columns named as the results are replaced.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    histogram = np.zeros(window + 1, dtype=np.int64)
    for length, n in counts.items():
        histogram[length] = n
    spans = spark.createDataFrame(spans_of(plan(histogram, window)), "length bigint, __low bigint, __high bigint, __seq bigint, __offset bigint")
    ranked = ranks_in_groups(pieces, "length", counts, [F.col("doc_id"), F.col("piece")])
    return place_in_spans(ranked, "length", spans).select(
        *[f"`{c}`" for c in pieces.columns], (F.col("__seq") + F.col("__rank") - F.col("__low")).alias("sequence_id"),
        F.col("__offset").alias("offset"),
    )


def pack_documents(docs: DataFrame, path: str, window: int = 2048, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack ``docs``: one row per piece. The pieces are written to the shared folder first."""
    return pack(written(pieces_of(docs, path, window, key, text, with_ids), "pieces"), window)


ship(__name__)
