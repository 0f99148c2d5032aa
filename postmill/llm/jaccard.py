"""N-gram Jaccard join with adaptive prefixes that must share several tokens, down to components of similar documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import bound_batches, ship, written
from postmill.llm.components import components

WORDS = 5
PERCENT = 75
COUNTERS = 22  # bits of the frequency sketch: 16 MB, whatever the input
LEVELS = 4
CHECK_COST = 4.0  # of verifying one candidate, in list entries
BLOCK_BYTES = 1_000_000
HOT = 20_000  # entries of a token's list from which it is split
FAN = 512  # entries of a list for which one stands first
MEET = 2_000  # entries of a list among which each looks for the nearest
SHORT = 64  # entries of a list up to which those without a partner are left out
MARK_BITS = 512
ID_BITS = 25  # of the map of wanted ids: 4 MB, whatever the input
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64)
_BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _ODD
    return h ^ (h >> np.uint64(32))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and hash of each word of a text in bytes; ASCII letters are lower-cased."""
    lower = data + np.where((data >= 65) & (data <= 90), np.uint8(32), np.uint8(0))
    letter = ~_BLANK[data]
    start = np.flatnonzero(letter & np.concatenate([[True], ~letter[:-1]])) if len(data) else np.zeros(0, int)
    if not len(start):
        return start, np.zeros(0, np.uint64)
    stop = np.flatnonzero(letter & np.concatenate([~letter[1:], [True]])) + 1
    size = stop - start
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size.max() - 1, _ODD | np.uint64(1))]).astype(np.uint64))
    value = _BYTE[lower[letter]] * power[place]
    return start, mixed(np.add.reduceat(value, np.cumsum(size) - size) ^ size.astype(np.uint64))


def shingle_sets(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every distinct shingle, in order of both. A shorter text is one shingle; one without words has none."""
    data = np.frombuffer(b" ".join(texts), dtype=np.uint8)
    begin = np.cumsum([0] + [len(t) + 1 for t in texts])
    at, h = word_hashes(data)
    row = np.searchsorted(begin, at, side="right") - 1
    count = np.bincount(row, minlength=len(texts))
    first = np.cumsum(count) - count
    take = np.where(count == 0, 0, np.maximum(1, count - words + 1))
    owner = np.repeat(np.arange(len(texts)), take)
    start = np.repeat(first - (np.cumsum(take) - take), take) + np.arange(take.sum())
    total = np.minimum(count[owner], words).astype(np.uint64)
    places = np.arange(1, words + 1, dtype=np.uint64) * _ODD
    for j in range(words):
        here = np.minimum(start + j, len(h) - 1) if len(h) else start
        part = mixed(h[here] + places[j]) if len(h) else np.zeros(0, np.uint64)
        total = mixed(total * _MIX + np.where(j < count[owner], part, np.uint64(0)))
    order = np.lexsort((total, owner))
    owner, total = owner[order], total[order]
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (total[1:] != total[:-1])]) if len(owner) else np.zeros(0, bool)
    return owner[new], total[new]


def in_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Ids and texts of blocks of bounded size; rows without id are left out."""
    ids, texts, held = [], [], 0
    for b in batches:
        for d, t in zip(b["doc"], b["text"]):
            data = t.encode() if isinstance(t, str) else b""
            ids.append(d)
            texts.append(data)
            held += len(data) + 1
            if held >= BLOCK_BYTES:
                yield np.array(ids, dtype=np.int64), texts
                ids, texts, held = [], [], 0
    if ids:
        yield np.array(ids, dtype=np.int64), texts


def set_keys(row: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and 128 bits of content of each set, whatever the order of its members."""
    n = np.bincount(row, minlength=rows)
    out = [np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)]
    some = np.flatnonzero(n)
    if len(h):
        edges = (np.cumsum(n) - n)[some]
        for o, salt in zip(out, (np.uint64(1), np.uint64(2))):
            o[some] = np.add.reduceat(mixed(h + salt), edges)
    return n, out[0].view(np.int64), out[1].view(np.int64)


def parity_marks(row: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Per set ``MARK_BITS`` bits, and as many bits as it has members at least: whether an odd number of members falls on each.

    Both are powers of two; the low bits of a hash say which bit it falls on, so more bits fold to fewer ones.
    """
    bits = np.left_shift(1, np.ceil(np.log2(np.maximum(n, MARK_BITS))).astype(np.int64))
    begin = np.cumsum(bits) - bits
    odd = np.bincount(begin[row] + (h & (bits[row] - 1).astype(np.uint64)).astype(np.int64), minlength=int(bits.sum())) & 1
    packed = np.packbits(odd.astype(np.uint8))
    chunks = packed.reshape(-1, MARK_BITS // 8)
    short = np.bitwise_xor.reduceat(chunks, begin // MARK_BITS, axis=0) if len(n) else chunks
    whole = packed.tobytes()
    return [r.tobytes() for r in short], [whole[a : a + b] for a, b in zip((begin // 8).tolist(), (bits // 8).tolist())]


def folded(mark: bytes, size: int) -> bytes:
    return np.bitwise_xor.reduce(np.frombuffer(mark, np.uint8).reshape(-1, size), axis=0).tobytes()


def id_slot(ids: str) -> Column:
    """Where an id falls in a map of ids, from 1."""
    return F.shiftrightunsigned(F.xxhash64(ids), 64 - ID_BITS) + 1


def near_marks(odd: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets whose marks differ in ``odd`` bits can be similar: every bit that differs has a member of one set alone."""
    return odd * (100 + percent) <= (100 - percent) * (size_a + size_b)


def prefix_length(n: np.ndarray, level: np.ndarray | int, percent: int) -> np.ndarray:
    return np.minimum(n, n + (-n * percent) // 100 + level)


def adaptive_levels(row: np.ndarray, place: np.ndarray, freq: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Per set the number of shared prefix tokens to ask for: the one with the least estimated cost.

    A longer prefix costs list entries, one for each of its tokens and the estimated length of their lists; asking for
    more shared tokens leaves fewer candidates to verify.
    """
    best, level = np.full(len(n), np.inf), np.ones(len(n), dtype=np.int64)
    for asked in range(1, LEVELS + 1):
        inside = place < prefix_length(n, asked, percent)[row]
        lists = np.bincount(row[inside], weights=freq[inside], minlength=len(n))
        tokens = np.bincount(row[inside], minlength=len(n))
        cost = tokens + 0.01 * lists + CHECK_COST * lists / (tokens + 1) / 4.0 ** (asked - 1)
        better = cost < best
        best, level = np.where(better, cost, best), np.where(better, asked, level)
    return np.minimum(level, np.maximum(1, n))


def block_postings(ids: np.ndarray, texts: list[bytes], sketch: np.ndarray, shards: int, words: int, percent: int) -> pd.DataFrame:
    """Prefix tokens of one block's distinct sets, compressed by shard."""
    row, h = shingle_sets(texts, words)
    n, k1, k2 = set_keys(row, h, len(ids))
    # One of equal sets stands for all: they are linked by their keys elsewhere.
    order = np.lexsort((ids, k2, k1, n))
    same = np.concatenate([[False], (n[order][1:] == n[order][:-1]) & (k1[order][1:] == k1[order][:-1]) & (k2[order][1:] == k2[order][:-1])]) if len(ids) else np.zeros(0, bool)
    chosen = np.ones(len(ids), dtype=bool)
    chosen[order[same]] = False
    chosen &= n > 0
    row, h = row[chosen[row]], h[chosen[row]]
    freq = sketch[(h >> np.uint64(64 - COUNTERS)).astype(np.int64)]
    by = np.lexsort((h, freq, row))
    row, h, freq = row[by], h[by], freq[by]
    first = np.cumsum(np.bincount(row, minlength=len(ids))) - np.bincount(row, minlength=len(ids))
    place = np.arange(len(row)) - first[row]
    noise = float(np.median(sketch)) if len(sketch) else 0.0
    level = adaptive_levels(row, place, np.maximum(freq - noise, 0.0), n, percent)
    keep = place < prefix_length(n, level, percent)[row]
    row, h, freq, place = row[keep], h[keep], freq[keep], place[keep]
    salts = np.maximum(1, freq // HOT).astype(np.uint64)
    salt = mixed(ids[row].view(np.uint64)) % salts
    shard = (mixed(h + salt * _ODD) % np.uint64(shards)).astype(np.int64)
    by = np.lexsort((row, shard))
    row, h, place, shard, salts = row[by], h[by], place[by], shard[by], salts[by]
    packer, out = zstandard.ZstdCompressor(level=1), []
    for part in np.split(np.arange(len(row)), np.flatnonzero(np.diff(shard)) + 1):
        if len(part):
            r = row[part]
            planes = [np.diff(ids[r], prepend=0), h[part].view(np.int64), place[part], n[r], level[r], salts[part].astype(np.int64)]
            raw = b"".join(np.frombuffer(a.astype("<i8").tobytes(), np.uint8).reshape(-1, 8).T.tobytes() for a in planes)
            out.append((int(shard[part[0]]), len(part).to_bytes(8, "little") + packer.compress(raw)))
    return pd.DataFrame(out, columns=["shard", "data"])


def opened(blob: bytes) -> list[np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    raw = zstandard.ZstdDecompressor().decompress(blob[8:])
    fields = [np.frombuffer(raw, np.uint8, 8 * n, 8 * n * i).reshape(8, n).T.copy().view("<i8").ravel() for i in range(6)]
    fields[0] = np.cumsum(fields[0])
    return fields


ENTRY = ["token", "node", "size", "place", "level"]


def live_postings(blobs: list[bytes]) -> pd.DataFrame:
    """The list entries of one shard whose token is shared, with the length of the list."""
    node, token, place, size, level, salts = (np.concatenate(f) for f in zip(*map(opened, blobs)))
    order = np.lexsort((node, size, token))
    token = token[order]
    new = np.concatenate([[True], token[1:] != token[:-1]])
    edges = np.append(np.flatnonzero(new), len(token))
    entries = np.diff(edges)[np.cumsum(new) - 1]
    keep = (entries > 1) | (salts[order] > 1)
    order, entries = order[keep], entries[keep]
    return pd.DataFrame({
        "token": token[keep], "node": node[order], "size": size[order], "place": place[order], "level": level[order], "salts": salts[order],
        "entries": entries,
    })


def may_be_similar(size_a, size_b, place_a, place_b, asked, percent: int) -> np.ndarray:
    """Whether a list can be one of the first ``asked`` that a similar pair meets in.

    The j-th shared token, in the common order, has at most ``j - 1`` shared ones before it and no more behind it than either
    set has left, so a similar pair passes in its first ``asked`` lists.
    """
    need = -(-percent * (size_a + size_b) // (100 + percent))
    left = np.minimum(size_a - place_a, size_b - place_b)
    return (100 * np.minimum(size_a, size_b) >= percent * np.maximum(size_a, size_b)) & (left + asked - 1 >= need)


def with_partner(live: pd.DataFrame, percent: int) -> np.ndarray:
    """Which entries may be similar to another one of their list. Of long lists and parts of lists all entries stay."""
    token, size, place, level, entries, salts = (live[c].to_numpy() for c in ("token", "size", "place", "level", "entries", "salts"))
    stays = (entries > SHORT) | (salts > 1)
    first = np.flatnonzero(~stays)
    for gap in range(1, SHORT):
        first = first[first + gap < len(live)]
        first = first[token[first] == token[first + gap]]
        if not len(first):
            break
        i, j = first, first + gap
        near = may_be_similar(size[i], size[j], place[i], place[j], np.minimum(level[i], level[j]), percent)
        stays[i[near]] = True
        stays[j[near]] = True
    return stays


def star_pairs(live: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Each entry of a list with the head of its part, and the heads with the first of them.

    A head is the entry with the least hash of id among those of like size, so lists with much the same entries have
    mostly the same heads. Long lists have a part for every ``FAN`` entries, by hash of id, which bounds the pairs of a head.
    Sizes are classed twice, half a class apart: sizes on a border of one classing are together in the other.
    """
    token, node, size, place, level, entries = (live[c].to_numpy() for c in ("token", "node", "size", "place", "level", "entries"))
    h = mixed(node.view(np.uint64))
    bits = np.ceil(np.log2(np.maximum(1, entries / FAN))).astype(np.uint64)
    part = h & ((np.uint64(1) << bits) - np.uint64(1))
    step = max(np.log(100 / percent), 0.01)
    out = [np.zeros((0, 2), np.int64)]
    for shift in (0.0, 0.5):
        kind = np.floor(np.log(size) / step + shift).astype(np.int64)
        order = np.lexsort((h, part, kind, token))
        t, k, q = token[order], kind[order], part[order]
        top = np.concatenate([[True], (t[1:] != t[:-1]) | (k[1:] != k[:-1])]) if len(t) else np.zeros(0, bool)
        head = top | np.concatenate([[True], q[1:] != q[:-1]]) if len(t) else top
        to_head = order[np.maximum.accumulate(np.where(head, np.arange(len(t)), 0))]
        to_top = order[np.maximum.accumulate(np.where(top, np.arange(len(t)), 0))]
        i, j = np.concatenate([order, order[head]]), np.concatenate([to_head, to_top[head]])
        near = (i != j) & may_be_similar(size[i], size[j], place[i], place[j], np.minimum(level[i], level[j]), percent)
        out.append(np.stack([node[i[near]], node[j[near]]], axis=1))
    pairs = np.concatenate(out)
    pairs = np.unique(np.sort(pairs[pairs[:, 0] != pairs[:, 1]], axis=1), axis=0)
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


PAIRS_AT_ONCE = 500_000


def close_pairs(rows: pd.DataFrame, percent: int, nearest: bool = False) -> Iterator[pd.DataFrame]:
    """Pairs within lists, of different components, that size, place in the prefix and marks do not rule out.

    ``rows`` are whole lists, or parts of lists that meet, one after the other. A similar pair passes in as many lists
    as shared tokens are asked of it, and is counted in each of them. With ``nearest`` only the pair of each entry
    whose marks differ least for its sizes.
    """
    names = ("token", "lo", "hi", "node", "size", "place", "level", "component", "side")
    if not len(rows):
        return
    token, lo, hi, node, size, place, level, comp, side = (rows[c].to_numpy() for c in names)
    marks = np.frombuffer(b"".join(rows["mark"]), dtype=np.uint64).reshape(len(rows), -1)
    least, partner = np.full(len(rows), np.inf), np.full(len(rows), -1)
    new = np.concatenate([[True], (token[1:] != token[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
    last = np.append(np.flatnonzero(new)[1:], len(rows))[np.cumsum(new) - 1]
    after = last - np.arange(len(rows)) - 1
    total = np.cumsum(after)
    begin = 0
    while begin < len(rows):
        base = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, base + PAIRS_AT_ONCE, side="right")))
        many = after[begin:end]
        i = np.repeat(np.arange(begin, end), many)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
        begin = end
        ok = (comp[i] != comp[j]) & ((side[i] != side[j]) | (side[i] == 2)) & (node[i] != node[j])
        i, j = i[ok], j[ok]
        asked = np.minimum(level[i], level[j])
        ok = may_be_similar(size[i], size[j], place[i], place[j], asked, percent)
        i, j, asked = i[ok], j[ok], asked[ok]
        odd = np.zeros(len(i), dtype=np.int64)
        for word in range(marks.shape[1]):
            odd += np.bitwise_count(marks[i, word] ^ marks[j, word])
        ok = near_marks(odd, size[i], size[j], percent)
        i, j, asked, odd = i[ok], j[ok], asked[ok], odd[ok]
        if not len(i):
            continue
        if not nearest:
            yield pd.DataFrame({"a": np.minimum(node[i], node[j]), "b": np.maximum(node[i], node[j]), "asked": asked})
            continue
        one, two, far = np.concatenate([i, j]), np.concatenate([j, i]), np.tile(odd / (size[i] + size[j]), 2)
        order = np.lexsort((far, one))
        one, two, far = one[order], two[order], far[order]
        top = np.concatenate([[True], one[1:] != one[:-1]])
        one, two, far = one[top], two[top], far[top]
        better = far < least[one]
        least[one[better]], partner[one[better]] = far[better], two[better]
    i = np.flatnonzero(partner >= 0)
    if len(i):
        pairs = np.unique(np.sort(np.stack([node[i], node[partner[i]]], axis=1), axis=1), axis=0)
        yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1], "asked": 1})


class Join:
    """One similarity join over ``docs`` (``doc``, ``text``)."""

    def __init__(self, docs: DataFrame, words: int, percent: int) -> None:
        self.spark, self.words, self.percent = docs.sparkSession, words, percent
        self.docs = docs
        self.shards = int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def summary(self) -> tuple[DataFrame, np.ndarray]:
        """Size, key and marks of every set, written; and how often tokens fall on each counter of the sketch."""
        words = self.words

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            counts = np.zeros(1 << COUNTERS, dtype=np.uint32)
            for ids, texts in in_blocks(batches):
                row, h = shingle_sets(texts, words)
                n, k1, k2 = set_keys(row, h, len(ids))
                np.add.at(counts, (h >> np.uint64(64 - COUNTERS)).astype(np.int64), np.uint32(1))
                mark, marks = parity_marks(row, h, n)
                out = pd.DataFrame({"doc": ids, "n": n, "k1": k1, "k2": k2, "data": None, "mark": mark, "marks": marks})
                # Repeated rows need their marks once.
                out.loc[out.duplicated(["doc", "n", "k1", "k2"]) | (out["n"] == 0), ["mark", "marks"]] = None
                yield out
            if counts.any():
                yield pd.DataFrame({
                    "doc": range(64), "n": -1, "k1": 0, "k2": 0, "data": [zstandard.compress(p.tobytes(), 1) for p in np.split(counts, 64)],
                    "mark": None, "marks": None,
                })

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            total = sum(np.frombuffer(zstandard.decompress(d), dtype=np.uint32).astype(np.uint64) for d in pdf["data"])
            return pd.DataFrame({"doc": pdf["doc"].iloc[:1], "data": [zstandard.compress(np.minimum(total, 2**32 - 1).astype("<u4").tobytes(), 1)]})

        both = written(self.docs.mapInPandas(run, "doc bigint, n bigint, k1 bigint, k2 bigint, data binary, mark binary, marks binary"), "sets")
        self.marked = both.where("mark IS NOT NULL").select("doc", "n", "mark", "marks")
        parts = both.where("n < 0").groupBy("doc").applyInPandas(add, "doc bigint, data binary").collect()  # 64 rows, 16 MB in all
        sketch = np.zeros(1 << COUNTERS, dtype=np.uint32)
        for r in parts:
            part = np.frombuffer(zstandard.decompress(r["data"]), dtype="<u4")
            sketch[r["doc"] * len(part) : (r["doc"] + 1) * len(part)] = part
        return both.where("n >= 0").drop("data", "mark", "marks"), sketch

    def postings(self, sketch: np.ndarray) -> DataFrame:
        """Entries of shared tokens that have a partner, and the stars of their lists (``star``: pairs of ``node`` and ``other``), written."""
        held = self.spark.sparkContext.broadcast(sketch)
        shards, words, percent = self.shards, self.words, self.percent

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for ids, texts in in_blocks(batches):
                yield block_postings(ids, texts, held.value, shards, words, percent)

        def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            blobs: list[bytes] = []
            current = -1

            def flush() -> Iterator[pd.DataFrame]:
                live = live_postings(blobs)
                yield live.loc[with_partner(live, percent), ENTRY].assign(other=0, star=False)
                pairs = star_pairs(live, percent)
                yield pd.DataFrame({**{c: 0 for c in ENTRY}, "node": pairs["a"], "other": pairs["b"], "star": True})

            for b in batches:
                for shard, data in zip(b["shard"], b["data"]):
                    if shard != current and blobs:
                        yield from flush()
                        blobs = []
                    current = shard
                    blobs.append(bytes(data))
            if blobs:
                yield from flush()

        schema = ", ".join(f"{c} bigint" for c in [*ENTRY, "other"]) + ", star boolean"
        dealt = self.docs.mapInPandas(run, "shard int, data binary").repartition(shards, "shard").sortWithinPartitions("shard")
        return written(dealt.mapInPandas(gather, schema), "postings")

    def among(self, nodes: DataFrame) -> DataFrame:
        """The documents of ``nodes`` and a few more: a map of their ids keeps most other texts from any shuffle."""
        node, doc = id_slot("node"), id_slot("doc")
        marked = nodes.groupBy(F.bitmap_bucket_number(node).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(node)).alias("bits"))
        at = F.bitmap_bit_position(doc)
        byte = F.conv(F.hex(F.substring("bits", F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        is_wanted = F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1
        return self.docs.join(F.broadcast(marked), (F.bitmap_bucket_number(doc) == F.col("bucket")) & is_wanted, "left_semi")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (``a``, ``b``) whose whole sets are similar enough. Only texts of pairs that their marks leave move, compressed."""
        words, percent = self.words, self.percent

        def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                odd = np.zeros(len(b), dtype=np.int64)
                for i, (x, y) in enumerate(zip(b["marks_a"], b["marks_b"])):
                    size = min(len(x), len(y))
                    x, y = folded(x, size), folded(y, size)
                    odd[i] = (int.from_bytes(x) ^ int.from_bytes(y)).bit_count()
                yield b.loc[near_marks(odd, b["n_a"].to_numpy(), b["n_b"].to_numpy(), percent), ["a", "b"]]

        left, right = (self.marked.select(F.col("doc").alias(c), F.col("n").alias(f"n_{c}"), F.col("marks").alias(f"marks_{c}")) for c in "ab")
        marked = pairs.select("a", "b").distinct().join(left, "a").join(right, "b")
        pairs = written(marked.select("a", "b", "n_a", "n_b", "marks_a", "marks_b").mapInPandas(near, "a bigint, b bigint").distinct(), "candidates")
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        needed = self.among(nodes).join(nodes.withColumnRenamed("node", "doc"), "doc", "left_semi").select("doc", "text")

        def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            packer = zstandard.ZstdCompressor(level=3)
            for b in batches:
                bodies = [packer.compress(t.encode() if isinstance(t, str) else b"") for t in b["text"]]
                yield pd.DataFrame({"node": b["doc"], "body": bodies})

        def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            opener = zstandard.ZstdDecompressor()
            for b in batches:
                for low in range(0, len(b), 200):
                    part = b.iloc[low : low + 200]
                    texts = [opener.decompress(x) for x in [*part["body_a"], *part["body_b"]]]
                    row, h = shingle_sets(texts, words)
                    n = np.bincount(row, minlength=len(texts))
                    # Equal (pair, hash) entries of both sides are the intersection.
                    pair = row % len(part)
                    order = np.lexsort((h, pair))
                    p, v = pair[order], h[order]
                    twice = (p[1:] == p[:-1]) & (v[1:] == v[:-1]) if len(p) else np.zeros(0, bool)
                    shared = np.bincount(p[1:][twice], minlength=len(part))
                    union = n[: len(part)] + n[len(part) :] - shared
                    ok = (100 * shared >= percent * union) & (union > 0)
                    yield part.loc[ok, ["a", "b"]]

        bodies = written(needed.mapInPandas(pack, "node bigint, body binary"), "bodies")
        both = pairs.join(bodies.select(F.col("node").alias("a"), F.col("body").alias("body_a")), "a").join(
            bodies.select(F.col("node").alias("b"), F.col("body").alias("body_b")), "b"
        )
        return written(both.select("a", "b", "body_a", "body_b").mapInPandas(check, "a bigint, b bigint"), "links")

    def open_lists(self, live: DataFrame, component: DataFrame) -> DataFrame:
        """Entries of lists that more than one component shares; ``rows`` is the list's length."""
        placed = live.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
        placed = written(placed.select(*ENTRY, "component"), "placed")
        per = placed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("rows"))
        return placed.drop("component").join(per.where("lo <> hi").select("token", "rows"), "token")

    def met(self, entries: DataFrame, component: DataFrame, nearest: bool) -> DataFrame:
        """Pairs of different components that meet in lists, once for each list.

        With ``nearest`` a long list is cut into parts of ``MEET`` entries, each for itself, and an entry has the pair whose
        marks are nearest; else parts of long lists meet pairwise and every pair that can be similar is among them.
        """
        percent = self.percent
        marks = self.marked.select(F.col("doc").alias("node"), F.col("n").alias("size"), "mark")
        rows = entries.join(component, "node", "left").withColumn("component", F.coalesce("component", "node")).join(marks, ["node", "size"])
        rows = rows.withColumn("parts", F.ceil(F.col("rows") / (MEET if nearest else HOT)).cast("int"))
        rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        if nearest:
            rows = rows.withColumn("other", F.col("own"))
        else:
            rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        spread = rows.select(
            "token", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "node", "size", "place", "level", "component",
            F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"), "mark",
        )

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: pd.DataFrame | None = None
            for b in batches:
                b = b if held is None else pd.concat([held, b], ignore_index=True)
                key = b[["token", "lo", "hi"]].to_numpy()
                cut = np.flatnonzero((key[1:] != key[:-1]).any(axis=1))
                # The last list may go on in the next batch; lists are cut into parts of bounded length before.
                whole = int(cut[-1]) + 1 if len(cut) else 0
                yield from close_pairs(b.iloc[:whole], percent, nearest)
                held = b.iloc[whole:]
            if held is not None and len(held):
                yield from close_pairs(held, percent, nearest)

        dealt = spread.repartition("token", "lo", "hi").sortWithinPartitions("token", "lo", "hi")
        return dealt.mapInPandas(run, "a bigint, b bigint, asked bigint")

    def remaining(self, entries: DataFrame, component: DataFrame) -> DataFrame:
        """Candidates between different components, from lists that more than one component shares."""
        found = self.met(entries, component, nearest=False)
        return found.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.max("asked").alias("asked")).where("shared >= asked")


def similar_components(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row: documents linked by a Jaccard similarity of ``percent`` or more.

    Equal sets are linked by their keys and count once from there on. Tokens are ordered by a frequency sketch over all
    documents, rare first. Each set lists a prefix long enough that similar sets share ``level`` of its tokens; the level
    grows where lists are long. Stars of the lists are verified first, then of each entry the nearest one of another component, then
    all pairs of components still apart that share as many prefix tokens as asked. Parity marks of the sets leave out pairs that
    cannot be similar before their texts are fetched. Texts without words are linked with nothing.
    Rows without id have no component; rows of one id are one document.
    """
    bound_batches(docs.sparkSession)
    named = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc"), F.col(f"`{text}`").alias("text"))
    join = Join(named.where("doc IS NOT NULL"), words, percent)
    sets, sketch = join.summary()
    least = sets.where("n > 0").groupBy("n", "k1", "k2").agg(F.min("doc").alias("rep"))
    classes = written(sets.join(least, ["n", "k1", "k2"], "left").select("doc", "n", F.coalesce("rep", "doc").alias("rep")), "classes")
    postings = join.postings(sketch)
    first = join.verified(postings.where("star").select(F.col("node").alias("a"), F.col("other").alias("b")))
    of = classes.select(F.col("doc").alias("node"), "rep").groupBy("node").agg(F.min("rep").alias("rep"))

    def between_classes(links: DataFrame) -> DataFrame:
        left, right = of.select(F.col("node").alias("a"), F.col("rep").alias("ra")), of.select(F.col("node").alias("b"), F.col("rep").alias("rb"))
        return links.join(left, "a").join(right, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))

    def components_of(links: DataFrame) -> DataFrame:
        found = components(between_classes(links)).select(F.col("node").alias("rep"), "component")
        return of.join(found, "rep", "left").select("node", F.coalesce("component", "rep").alias("component"))

    now = components_of(first)
    entries = written(join.open_lists(postings.where("NOT star").drop("other", "star"), now), "open")
    linked = first.union(join.verified(join.met(entries, now, nearest=True)))
    rest = join.verified(join.remaining(entries, components_of(linked)))
    final = components_of(linked.union(rest))
    sizes = sets.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles")).join(final.withColumnRenamed("node", "doc_id"), "doc_id").select(
        "doc_id", "n_shingles", F.col("component").alias("component_id")
    )
    return sizes.unionAll(_without_id(named, words))


def _without_id(named: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            row, _ = shingle_sets([t.encode() if isinstance(t, str) else b"" for t in b["text"]], words)
            yield pd.DataFrame({"n_shingles": np.bincount(row, minlength=len(b))})

    rows = named.where("doc IS NULL").select("text").mapInPandas(run, "n_shingles bigint")
    return rows.select(F.lit(None).cast("bigint").alias("doc_id"), "n_shingles", F.lit(None).cast("bigint").alias("component_id"))


ship(__name__)
