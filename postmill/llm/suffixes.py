"""Removal of repeated byte strings by suffix sorting in shards: external induced sorting with disk-backed bucket queues."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from functools import reduce
from itertools import chain, groupby

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import bound_batches, ship, written

SPAN = 50
GRAM = 12
BLOCK_BYTES = 1_000_000
SORT_BYTES = 500_000
QUEUE_TUPLES = 8_000_000
HOT_SPANS = 2_000_000
TURNS = 2
NO_ID = np.iinfo(np.int64).max
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


# ---- suffix sorting of one shard -------------------------------------------------------------------


class BucketQueue:
    """A priority queue of suffixes: one first-in-first-out queue per first symbol, spilled to a scratch file.

    Induction meets the suffixes of one bucket in their final order, so the order of arrival is the order within
    the bucket and the symbol is the priority. At most ``limit`` suffixes wait in memory.
    """

    def __init__(self, symbols: int, limit: int = QUEUE_TUPLES) -> None:
        self.waiting: list[list] = [[] for _ in range(symbols)]
        self.limit, self.held = limit, 0
        self.file = None

    def push(self, symbols: np.ndarray, suffixes: np.ndarray) -> None:
        """Append suffixes, in order, each to the queue of its symbol."""
        if not len(suffixes):
            return
        order = np.argsort(symbols, kind="stable")
        sorted_symbols, sorted_suffixes = symbols[order], suffixes[order]
        cuts = np.flatnonzero(sorted_symbols[1:] != sorted_symbols[:-1]) + 1
        for part, symbol in zip(np.split(sorted_suffixes, cuts), sorted_symbols[np.concatenate([[0], cuts])]):
            self.waiting[symbol].append(part)
        self.held += len(suffixes)
        if self.held > self.limit:
            self.spill()

    def spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for queue in self.waiting:
            for i, part in enumerate(queue):
                if isinstance(part, np.ndarray):
                    queue[i] = (self.file.tell(), len(part))
                    self.file.write(part.tobytes())
        self.held = 0

    def pop(self, symbol: int, newest: bool = False) -> np.ndarray | None:
        """The oldest suffixes of one queue, or the newest, in order: all that wait, up to about ``limit``."""
        queue, size, n = self.waiting[symbol], 0, 0
        for part in reversed(queue) if newest else queue:
            if n and size >= self.limit:
                break
            size, n = size + (part[1] if isinstance(part, tuple) else len(part)), n + 1
        if not n:
            return None
        taken = queue[len(queue) - n :] if newest else queue[:n]
        self.waiting[symbol] = queue[: len(queue) - n] if newest else queue[n:]
        parts = []
        for part in taken:
            if isinstance(part, tuple):
                self.file.seek(part[0])
                part = np.frombuffer(self.file.read(8 * part[1]), dtype=np.int64)
            else:
                self.held -= len(part)
            parts.append(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def words_at(text: np.ndarray, offset: int = 0) -> np.ndarray:
    """The eight bytes from each place on as one number, a view without a copy; ``text`` ends with eight bytes to spare."""
    return np.ndarray((len(text) - 8 - offset,), dtype=">u8", buffer=text, offset=offset, strides=(1,))


def suffix_types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is less than its successor; the empty one is the least of all."""
    rise = np.sign(text[1:].astype(np.int16) - text[:-1].astype(np.int16))
    at = np.where(rise != 0, np.arange(len(rise)), len(rise))
    at = np.minimum.accumulate(at[::-1])[::-1]
    return np.append(np.append(rise, -1)[at] > 0, False)


def sort_by_prefix(text: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """``starts`` in order of their first ``depth`` bytes, eight bytes at a time; only ties are looked at again."""
    order = starts.copy()
    low, high = np.array([0]), np.array([len(order)])
    last = len(text) - 9
    for offset in range(0, depth, 8):
        if not len(low):
            break
        sizes = high - low
        places = np.repeat(low - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        group = np.repeat(np.arange(len(low)), sizes)
        members = order[places]
        keys = words_at(text)[np.minimum(members + offset, last)].astype(np.uint64)
        by = np.lexsort((keys, group))
        order[places] = members[by]
        keys, group = keys[by], group[by]
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (group[1:] != group[:-1])])
        edges = np.append(np.flatnonzero(new), len(keys))
        many = np.diff(edges) > 1
        low, high = places[edges[:-1][many]], places[edges[:-1][many]] + np.diff(edges)[many]
    return order


def induced_order(body: np.ndarray, depth: int = SPAN, limit: int = QUEUE_TUPLES) -> np.ndarray:
    """All suffixes of ``body`` in order of their first ``depth`` bytes at least, largest first.

    Suffixes less than their successor but not their predecessor's are sorted directly; from them the others are
    induced, first upwards, then downwards, through bucket queues. ``body`` may be a memory map.
    """
    n = len(body)
    text = np.concatenate([body, np.zeros(16, np.uint8)])
    small = suffix_types(body)
    starts = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    seeds = BucketQueue(256, limit)
    ordered = sort_by_prefix(text, starts.astype(np.int64), depth + 8)
    seeds.push(body[ordered], ordered)
    rising, large = BucketQueue(256, limit), BucketQueue(256, limit)
    def induce(queue: BucketQueue, suffixes: np.ndarray, keep) -> None:
        before = suffixes[suffixes > 0] - 1
        symbols = body[before]
        chosen = keep(before, symbols)
        queue.push(symbols[chosen], before[chosen])

    # The last suffix is induced by the empty one, before all others.
    rising.push(body[n - 1 :], np.array([n - 1], dtype=np.int64))
    for symbol in range(256):
        while (part := rising.pop(symbol)) is not None:
            large.push(np.full(len(part), symbol), part)
            induce(rising, part, lambda before, symbols: ~small[before])
        while (part := seeds.pop(symbol)) is not None:
            induce(rising, part, lambda before, symbols: ~small[before])
    falling = BucketQueue(256, limit)
    out: list[np.ndarray] = []
    for symbol in range(255, -1, -1):
        while (part := falling.pop(symbol)) is not None:
            out.append(part)
            induce(falling, part, lambda before, symbols: small[before])
        while (part := large.pop(symbol, newest=True)) is not None:
            out.append(part[::-1])
            induce(falling, part[::-1], lambda before, symbols: small[before])
    return np.concatenate(out)


def equal_runs(text: np.ndarray, order: np.ndarray, span: int) -> np.ndarray:
    """Number of the class of equal ``span``-byte prefixes of each suffix in ``order``; ``text`` has bytes to spare."""
    same = np.ones(max(0, len(order) - 1), dtype=bool)
    words = words_at(text)
    for offset in [*range(0, span - 7, 8), span - 8]:
        at = np.flatnonzero(same)
        same[at] = words[order[at] + offset] == words[order[at + 1] + offset]
    return np.concatenate([[0], np.cumsum(~same)]) if len(order) else np.zeros(0, int)


# ---- pieces of documents ---------------------------------------------------------------------------


def gram_hashes(text: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from each place on; ``text`` ends with bytes to spare."""
    n = len(text) - 16
    h = words_at(text)[:n].astype(np.uint64) * _MIX[0]
    h ^= words_at(text, GRAM - 8)[:n].astype(np.uint64) * _MIX[1]
    h ^= h >> np.uint64(31)
    h *= _MIX[2]
    h ^= h >> np.uint64(29)
    return h


def least_of(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    out, reach = h, 1
    while reach * 2 <= width:
        out = np.minimum(out[:-reach], out[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def cut_pieces(text: np.ndarray, ends: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and least gram hashes of the runs of ``span``-byte strings with one least gram hash.

    ``ends`` are the ends of the documents within ``text``; no piece crosses one. Equal strings have equal
    least hashes, so they meet in one shard.
    """
    n = len(text) - 16
    if n < span:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.uint64)
    least = least_of(gram_hashes(text)[: n - GRAM + 1], span - GRAM + 1)
    room = np.ones(len(least), dtype=bool)
    for end in ends:
        room[max(0, end - span + 1) : end] = False
    edge = np.ones(len(least), dtype=bool)
    edge[1:] = (least[1:] != least[:-1]) | ~room[:-1]
    first = np.flatnonzero(edge & room)
    stop = np.append(np.flatnonzero(edge | ~room), len(least))
    after = stop[np.searchsorted(stop, first, side="right")]
    return first, after - first + span - 1, least[first]


def sides_of(text: np.ndarray, starts: np.ndarray, lengths: np.ndarray, least: np.ndarray, grams: np.ndarray, span: int) -> np.ndarray:
    """Per piece a hash of its least gram with half of a span before it, and one with half a span after it.

    A ``span`` that two pieces share holds their least gram and at least half of the rest on one side of it, so they agree
    in that side's hash. 0 stands for a side that the piece has not got; 1 for a piece with its least gram in several places.
    """
    half = (span - GRAM + 1) // 2
    count = lengths - GRAM + 1
    owner = np.repeat(np.arange(len(starts)), count)
    places = np.repeat(starts - (np.cumsum(count) - count), count) + np.arange(count.sum())
    hit = grams[places] == least[owner]
    owner, places = owner[hit], places[hit]
    many = np.bincount(owner, minlength=len(starts))
    at = places[np.cumsum(many) - many]
    words = words_at(text)
    out = np.zeros((len(starts), 2), dtype=np.uint64)
    for side, low in enumerate((at - half, at)):
        whole = (low >= starts) & (low + half + GRAM <= starts + lengths)
        begin = low[whole]
        h = np.full(len(begin), side, dtype=np.uint64)
        for offset in [*range(0, half + GRAM - 7, 8), half + GRAM - 8]:
            h = (h ^ words[begin + offset].astype(np.uint64)) * _MIX[0]
            h ^= h >> np.uint64(29)
        out[whole, side] = np.maximum(h, np.uint64(2))
    out[many > 1] = 1
    return out


def gather(text: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all pieces in a row, and where each begins."""
    begin = np.concatenate([[0], np.cumsum(lengths)])
    places = np.repeat(starts - begin[:-1], lengths) + np.arange(begin[-1])
    return text[places], begin[:-1]


def piece_keys(text: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """128 bits of content per piece as two numbers: sums of mixed grams, weighted by their distance from its start."""
    size = len(text) - 16
    grams = gram_hashes(text)
    out = np.empty((len(starts), 2), dtype=np.uint64)

    def powers(factor: int) -> np.ndarray:
        weight = np.full(size + 1, np.uint64(factor), dtype=np.uint64)
        weight[0] = 1
        return np.multiply.accumulate(weight)

    for j, factor in enumerate((int(_MIX[0]), int(_MIX[2]))):
        total = np.concatenate([[np.uint64(0)], np.cumsum(grams[:size] * powers(factor)[:size], dtype=np.uint64)])
        whole = total[starts + lengths - GRAM + 1] - total[starts]
        out[:, j] = whole * powers(pow(factor, -1, 1 << 64))[starts] + lengths.astype(np.uint64)
    return out


def same_pieces(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of equal pieces, and whether an equal piece is in a document with a smaller id."""
    order = np.lexsort((docs, keys[:, 1], keys[:, 0]))
    k = keys[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]).any(axis=1)]) if len(k) else np.zeros(0, bool)
    number = np.cumsum(new) - 1
    least = docs[order][np.flatnonzero(new)][number] if len(k) else docs[:0]
    classes, later = np.empty(len(k), dtype=np.int64), np.empty(len(k), dtype=bool)
    classes[order], later[order] = number, docs[order] > least
    return classes, later


def joined_spans(docs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each document with overlapping and touching ones joined."""
    if not len(docs):
        return docs, starts, ends
    order = np.lexsort((starts, docs))
    d, s, e = docs[order], starts[order], ends[order]
    first = np.concatenate([[True], d[1:] != d[:-1]])
    base = np.cumsum(first) * (np.int64(1) << 40)
    reach = np.maximum.accumulate(e + base)
    new = np.concatenate([[True], (s + base)[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    stop = np.append(at[1:], len(d)) - 1
    return d[at], s[at], (reach - base)[stop]


def span_frame(docs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pd.DataFrame:
    d, s, e = joined_spans(docs, starts.astype(np.int64), ends.astype(np.int64))
    return pd.DataFrame({"shard": -1, "doc": d, "start": s, "end": e, "data": None})


def block_pieces(docs: list[int], texts: list[bytes], shards: int, span: int, turn: int = 0, turns: int = 1) -> Iterator[pd.DataFrame]:
    """Of one block of documents: spans already known to repeat, and the distinct pieces by shard, compressed.

    Each of the ``turns`` has ``shards`` of its own; only the pieces of ``turn`` are returned.
    """
    if not docs:
        return
    text = np.frombuffer(b"".join(texts) + bytes(16), dtype=np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    starts, lengths, least = cut_pieces(text, ends, span)
    shard = (least >> np.uint64(20)) % np.uint64(shards * turns)
    mine = shard // np.uint64(shards) == turn
    starts, lengths, shard = starts[mine], lengths[mine], (shard[mine] % np.uint64(shards)).astype(int)
    if not len(starts):
        return
    row = np.searchsorted(ends, starts, side="right")
    doc, place = np.array(docs, dtype=np.int64)[row], starts - (ends - [len(t) for t in texts])[row]
    _, later = same_pieces(piece_keys(text, starts, lengths), doc)
    yield span_frame(doc[later], place[later], (place + lengths)[later])
    keep = np.flatnonzero(~later)
    keep = keep[np.lexsort((place[keep], doc[keep], shard[keep]))]
    cuts = np.flatnonzero(np.diff(shard[keep])) + 1
    packer = zstandard.ZstdCompressor(level=3)
    rows = []
    for part in np.split(keep, cuts):
        if len(part):
            data, _ = gather(text, starts[part], lengths[part])
            head = [np.diff(a, prepend=0).astype("<i8") for a in (doc[part], place[part])] + [lengths[part].astype("<i8")]
            planes = b"".join(np.frombuffer(a.tobytes(), np.uint8).reshape(-1, 8).T.tobytes() for a in head)
            rows.append((int(shard[part[0]]), len(part).to_bytes(8, "little") + packer.compress(planes + data.tobytes())))
    out = pd.DataFrame(rows, columns=["shard", "data"])
    yield pd.DataFrame({"shard": out["shard"], "doc": 0, "start": 0, "end": 0, "data": out["data"]})


def opened(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    n = int.from_bytes(blob[:8], "little")
    raw = zstandard.ZstdDecompressor().decompress(blob[8:])
    fields = [np.frombuffer(raw, np.uint8, 8 * n, 8 * n * i).reshape(8, n).T.copy().view("<i8").ravel() for i in range(3)]
    return np.cumsum(fields[0]), np.cumsum(fields[1]), fields[2], raw[24 * n :]


def shard_spans(blobs: Iterator[bytes], span: int, limit: int = QUEUE_TUPLES) -> Iterator[pd.DataFrame]:
    """Spans of one shard that repeat a string of a document with a smaller id.

    Pieces are spooled to a scratch file; in memory stay their keys. Whole repeats of pieces are settled first. Of the
    rest only pieces that share their least gram and a side of it with another are suffix-sorted, in portions of about ``SORT_BYTES``:
    equal strings share the least gram, so a portion holds all pieces of its grams. A gram with more bytes than that is
    settled by the keys of its strings instead, in passes of about ``HOT_SPANS`` strings.
    """
    known: list[tuple] = []
    held = 0
    with tempfile.TemporaryFile() as spool:
        for blob in blobs:
            doc, place, length, data = opened(blob)
            start = np.cumsum(length) - length
            text = np.frombuffer(data + bytes(16), dtype=np.uint8)
            bounds = np.stack([start, start + length - GRAM + 1], axis=1).ravel()
            grams = gram_hashes(text)
            least = np.minimum.reduceat(grams, bounds)[::2]
            sides = sides_of(text, start, length, least, grams, span)
            known.append((doc, place, length, least, piece_keys(text, start, length), start + held, sides))
            held += spool.write(data)
        spool.write(bytes(16))
        spool.flush()
        doc, place, length, least, keys, start, sides = (np.concatenate(f) for f in zip(*known))
        del known
        classes, later = same_pieces(keys, doc)
        yield span_frame(doc[later], place[later], (place + length)[later])
        kept = np.flatnonzero(~later)
        # One text per class; every place of it in its first document shares the outcome.
        _, first, member = np.unique(classes[kept], return_index=True, return_inverse=True)
        lone = kept[first]
        _, shared, count = np.unique(least[lone], return_inverse=True, return_counts=True)
        # Only pieces that agree with another one beside their least gram can share a span with it.
        likely = (sides[lone] == 1).any(axis=1)
        likely = likely | (np.bincount(shared[likely], minlength=len(count)) > 0)[shared]
        for side in range(2):
            _, same, n = np.unique(sides[lone, side], return_inverse=True, return_counts=True)
            likely |= (n[same] > 1) & (sides[lone, side] != 0)
        by_class = np.argsort(member, kind="stable")
        members = member[by_class]
        chosen = np.flatnonzero((count[shared] > 1) & likely)
        chosen = chosen[np.argsort(shared[chosen], kind="stable")]

        def of_members(part: np.ndarray, number: np.ndarray, s: np.ndarray, e: np.ndarray) -> pd.DataFrame:
            low, high = np.searchsorted(members, part[number], side="left"), np.searchsorted(members, part[number], side="right")
            many = high - low
            at = by_class[np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())]
            target = kept[at]
            return span_frame(doc[target], place[target] + np.repeat(s, many), place[target] + np.repeat(e, many))

        hot = np.bincount(shared[chosen], weights=length[lone[chosen]], minlength=len(count)) > SORT_BYTES
        for gram in np.flatnonzero(hot):
            part = chosen[shared[chosen] == gram]
            piece = lone[part]
            for found in _repeats_of_gram(spool, start[piece], length[piece], doc[piece], least[piece[0]], span):
                yield of_members(part, *found)
        chosen = chosen[~hot[shared[chosen]]]
        grams = shared[chosen]
        portion = np.cumsum(length[lone[chosen]]) // SORT_BYTES
        # A gram's pieces all go to the portion in which the first of them is.
        _, begin = np.unique(grams, return_index=True)
        portion = portion[begin][np.searchsorted(grams[begin], grams)] if len(grams) else portion
        for part in np.split(chosen, np.flatnonzero(np.diff(portion)) + 1):
            if not len(part):
                continue
            piece = lone[part]
            yield of_members(part, *_repeats_among(spool, start[piece], length[piece], doc[piece], span, limit))


def _repeats_among(spool, start: np.ndarray, size: np.ndarray, doc: np.ndarray, span: int, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``piece, start, end`` of what the pieces at ``start`` of the scratch file repeat of pieces of smaller documents."""
    text = np.memmap(spool, dtype=np.uint8, mode="r")
    body, begin = gather(text, start, size + 1)
    del text
    body[begin + size] = 0
    number = np.repeat(np.arange(len(size)), size + 1)
    inside = np.arange(len(body)) - begin[number]
    order = induced_order(body, span, limit)
    order = order[inside[order] + span <= size[number[order]]]
    group = equal_runs(np.concatenate([body, np.zeros(16, np.uint8)]), order, span)
    if not len(group):
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, int)
    edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    owner = doc[number[order]]
    hit = order[owner > np.minimum.reduceat(owner, edges)[group]]
    return joined_spans(number[hit], inside[hit], inside[hit] + span)


def string_keys(text: np.ndarray, starts: np.ndarray, span: int) -> np.ndarray:
    """128 bits of content of the ``span`` bytes from each start on, as two numbers; ``text`` ends with bytes to spare."""
    words = words_at(text)
    out = np.empty((len(starts), 2), dtype=np.uint64)
    for j, factor in enumerate((_MIX[0], _MIX[2])):
        h = np.full(len(starts), _MIX[1], dtype=np.uint64)
        for offset in [*range(0, span - 7, 8), span - 8]:
            h = (h ^ words[starts + offset].astype(np.uint64)) * factor
            h ^= h >> np.uint64(29)
        out[:, j] = h
    return out


def _strings_of_gram(spool, start: np.ndarray, size: np.ndarray, least: np.uint64, span: int) -> Iterator[tuple]:
    """In portions of about ``SORT_BYTES``: bytes, starts of all ``span``-byte strings, their piece, start within it, and where
    in the string its first least gram is. Equal strings have it in one place."""
    for part in np.split(np.arange(len(size)), np.flatnonzero(np.diff(np.cumsum(size) // SORT_BYTES)) + 1):
        text = np.memmap(spool, dtype=np.uint8, mode="r")
        body, begin = gather(text, start[part], size[part])
        del text
        number = np.repeat(np.arange(len(part)), size[part])
        inside = np.arange(len(number)) - begin[number]
        body = np.concatenate([body, np.zeros(16, np.uint8)])
        hits = np.flatnonzero((gram_hashes(body) == least) & (inside + GRAM <= size[part][number]))
        first = np.flatnonzero(inside + span <= size[part][number])
        yield body, first, part[number[first]], inside[first], hits[np.searchsorted(hits, first)] - first


def _repeats_of_gram(spool, start: np.ndarray, size: np.ndarray, doc: np.ndarray, least: np.uint64, span: int) -> Iterator[tuple]:
    """As ``_repeats_among``, of the pieces of one gram, however many: strings are grouped by key, pass by pass.

    A pass has the strings with their first least gram in some of the places, or a share of the keys of one place.
    """
    counts = np.zeros(span - GRAM + 1, dtype=np.int64)
    for *_, where in _strings_of_gram(spool, start, size, least, span):
        counts += np.bincount(where, minlength=len(counts))
    passes: list[tuple[int, int, int, int]] = []
    low = 0
    while low < len(counts):
        high = low + 1
        while high < len(counts) and counts[low : high + 1].sum() <= HOT_SPANS:
            high += 1
        shares = int(max(1, -(-counts[low:high].sum() // HOT_SPANS)))
        passes += [(low, high, share, shares) for share in range(shares)]
        low = high
    for low, high, share, shares in passes:
        found = []
        for body, first, piece, inside, where in _strings_of_gram(spool, start, size, least, span):
            mine = (where >= low) & (where < high)
            keys = string_keys(body, first[mine], span)
            own = keys[:, 0] % np.uint64(shares) == share
            found.append((keys[own], piece[mine][own], inside[mine][own]))
        keys, piece, inside = (np.concatenate(f) for f in zip(*found))
        del found
        _, later = same_pieces(keys, doc[piece])
        yield joined_spans(piece[later], inside[later], inside[later] + span)


SPAN_SCHEMA = "shard int, doc bigint, start bigint, end bigint, data binary"


def repeated_spans(docs: DataFrame, span: int = SPAN, key: str = "doc_id", text: str = "text", limit: int = QUEUE_TUPLES) -> DataFrame:
    """``doc, start, end``: byte spans of each document covered by ``span``-byte strings that start in one with a smaller id.

    Strings are dealt by hash to ``TURNS`` turns, so that at any time only one turn's pieces lie in shuffle files.
    """
    found = [written(_spans_of_turn(docs, span, key, text, limit, turn), "spans", release=True) for turn in range(TURNS)]
    return reduce(DataFrame.unionAll, found)


def _spans_of_turn(docs: DataFrame, span: int, key: str, text: str, limit: int, turn: int) -> DataFrame:
    spark = docs.sparkSession
    bound_batches(spark)
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, texts, held = [], [], 0
        for b in batches:
            for d, t in zip(b["doc"], b["text"]):
                if isinstance(t, str) and t:
                    data = t.encode()
                    ids.append(int(d))
                    texts.append(data)
                    held += len(data)
                if held >= BLOCK_BYTES:
                    yield from block_pieces(ids, texts, shards, span, turn, TURNS)
                    ids, texts, held = [], [], 0
        yield from block_pieces(ids, texts, shards, span, turn, TURNS)

    lean = docs.select(F.coalesce(F.col(f"`{key}`").cast("bigint"), F.lit(int(NO_ID))).alias("doc"), F.col(f"`{text}`").alias("text"))
    pieces = lean.mapInPandas(cut, SPAN_SCHEMA)
    # Spans found within a block pass through beside the pieces, dealt by document.
    dealt = pieces.withColumn("to", F.when(F.col("shard") >= 0, F.col("shard")).otherwise(F.pmod(F.col("doc"), F.lit(shards)).cast("int")))
    dealt = dealt.repartition(shards, "to").sortWithinPartitions("shard")

    def sort(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = []
        for b in batches:
            known = b[b["shard"] < 0]
            if len(known):
                yield known[["doc", "start", "end"]]
            if len(known) < len(b):
                first.append(b[b["shard"] >= 0])
                break
        # Rows are sorted by shard: from here on all are pieces, spooled as they come.
        rows = (r for b in chain(first, batches) for r in zip(b["shard"], b["data"]))
        for _, own in groupby(rows, key=lambda r: r[0]):
            yield from (f[["doc", "start", "end"]] for f in shard_spans((bytes(data) for _, data in own), span, limit))

    return dealt.select("shard", "doc", "start", "end", "data").mapInPandas(sort, "doc bigint, start bigint, end bigint")


def remove_repeats(docs: DataFrame, span: int = SPAN, key: str = "doc_id", text: str = "text", limit: int = QUEUE_TUPLES,
                   as_text: bool = False) -> DataFrame:
    """Every row with ``kept`` (the bytes that stay), ``n_bytes``, ``n_removed`` and ``n_spans``.

    With ``as_text`` ``kept`` is text; of a character that is cut in two nothing stays.

    A byte goes if a ``span``-byte string that covers it also starts in a document with a smaller id; strings are
    judged on the input and never cross documents. Null texts are empty. Rows of one id are one document to each
    other and should be equal; rows without id come after all others. Other columns pass through.
    """
    spans = repeated_spans(docs, span, key, text, limit)
    by_doc = spans.groupBy(F.col("doc").alias("__d")).agg(F.collect_list(F.struct("start", "end")).alias("__spans"))

    shape = "string" if as_text else "binary"

    @F.pandas_udf(f"kept {shape}, n_bytes bigint, n_removed bigint, n_spans bigint")
    def cut(texts: pd.Series, lists: pd.Series) -> pd.DataFrame:
        rows = []
        for t, found in zip(texts, lists):
            data = t.encode() if isinstance(t, str) else b""
            if found is None or not len(found):
                rows.append((data, len(data), 0, 0))
                continue
            s = np.array([x["start"] for x in found], dtype=np.int64)
            e = np.array([x["end"] for x in found], dtype=np.int64)
            _, s, e = joined_spans(np.zeros(len(s), np.int64), s, e)
            edges = [0, *np.stack([s, e], axis=1).ravel().tolist(), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
            rows.append((kept, len(data), len(data) - len(kept), len(s)))
        out = pd.DataFrame(rows, columns=["kept", "n_bytes", "n_removed", "n_spans"])
        if as_text:
            out["kept"] = pd.Series([k.decode("utf-8", "ignore") for k in out["kept"]], dtype=object)
        return out

    names = ["kept", "n_bytes", "n_removed", "n_spans"]
    own = docs.drop(*names)
    joined = own.withColumn("__doc", F.coalesce(F.col(f"`{key}`").cast("bigint"), F.lit(int(NO_ID)))).join(
        by_doc, F.col("__doc") == F.col("__d"), "left"
    )
    return joined.withColumn("__r", cut(F.col(f"`{text}`"), F.col("__spans"))).select(
        *[own[f"`{c}`"] for c in own.columns], *[f"__r.{n}" for n in names]
    )


ship(__name__)
