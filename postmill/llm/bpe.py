"""BPE encoding by a segment tree over the ranks of adjacent pairs, and decoding."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import bound_batches, once, ship

CACHED_WORDS = 400_000
LONG_WORD = 128
_NONE = np.iinfo(np.int64).max
# The pre-tokenizer's pattern, with its white space spelt out, and its form for ASCII.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t\n\x0b\x0c\r a-z0-9]+")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Vocabulary:
    """A word-end BPE vocabulary: first ids of bytes, merges by rank, token texts."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        end = spec["model"]["end_of_word_suffix"]
        letters = byte_letters()
        self.first = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.last = np.array([vocab[c + end] for c in letters], dtype=np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in merges]
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.rank_of = {int(k): int(r) for k, r in zip(self.keys, self.ranks)}
        self.tokens = [b""] * (max([*vocab.values(), *[t["id"] for t in spec["added_tokens"]]]) + 1)
        for t, i in vocab.items():
            self.tokens[i] = t.encode()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for t, i in self.special.items():
            self.tokens[i] = t.encode()
        self.splitter = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of merging each pair; ``_NONE`` where no merge exists."""
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], _NONE)

    def encode_many(self, words: list[str]) -> Iterator[tuple[str, bytes, bytes]]:
        """Each word with its ids and token texts. Words of like length share one array of segment trees."""
        groups: dict[int, list[tuple[str, bytes]]] = {}
        for word in words:
            raw = word.encode("utf-8", "surrogatepass")
            if len(raw) > LONG_WORD:
                ids = self.encode_long(raw)
                yield word, ids.astype("<u4").tobytes(), b" ".join([self.tokens[i] for i in ids.tolist()])
            else:
                groups.setdefault(max(2, 1 << (len(raw) - 1).bit_length()), []).append((word, raw))
        for width, members in groups.items():
            for start in range(0, len(members), 20_000):
                part = members[start : start + 20_000]
                ids, alive = self._merge_rows([raw for _, raw in part], width)
                flat = ids[alive]
                data, shown = flat.astype("<u4").tobytes(), [self.tokens[i] for i in flat.tolist()]
                low = 0
                for (word, _), high in zip(part, np.cumsum(alive.sum(axis=1)).tolist()):
                    yield word, data[4 * low : 4 * high], b" ".join(shown[low:high])
                    low = high

    def _merge_rows(self, words: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """One segment tree per row: leaf p holds ``rank * width + p`` of the pair that starts at p, the root the least."""
        n = len(words)
        lengths = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(n, width)
        ids = np.full((n, width + 1), -1, dtype=np.int64)
        places = np.arange(width)
        ids[:, :width] = np.where(places < lengths[:, None], self.first[raw], -1)
        ids[np.arange(n), lengths - 1] = self.last[raw[np.arange(n), lengths - 1]]
        after = np.minimum(np.broadcast_to(np.arange(1, width + 2), (n, width + 1)), width).copy()
        before = np.broadcast_to(np.arange(-1, width), (n, width + 1)).copy()
        alive = ids[:, :width] >= 0
        tree = np.full((n, 2 * width), _NONE, dtype=np.int64)

        def leaf(ranks: np.ndarray, at: np.ndarray) -> np.ndarray:
            return np.where(ranks == _NONE, _NONE, ranks * width + at)

        ranks = self.pair_ranks(ids[:, :width].ravel(), ids[:, 1:].ravel()).reshape(n, width)
        tree[:, width:] = np.where(ranks == _NONE, _NONE, np.where(ranks == _NONE, 0, ranks) * width + places)
        for node in range(width - 1, 0, -1):
            np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])

        def put(rows: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
            node = at + width
            tree[rows, node] = value
            while node[0] > 1:
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        rows = np.flatnonzero(tree[:, 1] != _NONE)
        while len(rows):
            rank, at = np.divmod(tree[rows, 1], width)
            gone = after[rows, at]
            new, far = self.made[rank], after[rows, gone]
            ids[rows, at] = new
            after[rows, at] = far
            before[rows, far] = at
            alive[rows, gone] = False
            put(rows, gone, np.full(len(rows), _NONE))
            put(rows, at, _scaled(self.pair_ranks(new, ids[rows, far]), width, at))
            prior = before[rows, at]
            some = np.flatnonzero(prior >= 0)
            if len(some):
                r, p = rows[some], prior[some]
                put(r, p, _scaled(self.pair_ranks(ids[r, p], new[some]), width, p))
            rows = rows[tree[rows, 1] != _NONE]
        return ids[:, :width], alive

    def encode_long(self, word: bytes) -> np.ndarray:
        """The same tree for one long word: logarithmic updates in plain lists."""
        n = len(word)
        ids = self.first[np.frombuffer(word, dtype=np.uint8)].tolist()
        ids[-1] = int(self.last[word[-1]])
        width = 1 << (n - 1).bit_length()
        get, made = self.rank_of.get, self.made
        none = _NONE
        tree = [none] * (2 * width)
        for p in range(n - 1):
            r = get(ids[p] << 20 | ids[p + 1])
            if r is not None:
                tree[width + p] = r * width + p
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(b"\1" * n)

        def put(p: int, value: int) -> None:
            node = p + width
            tree[node] = value
            while node > 1:
                node >>= 1
                a, b = tree[2 * node], tree[2 * node + 1]
                least = a if a < b else b
                if tree[node] == least:
                    break
                tree[node] = least

        while tree[1] != none:
            rank, p = divmod(tree[1], width)
            q = after[p]
            far = after[q]
            ids[p], after[p], alive[q] = int(made[rank]), far, 0
            put(q, none)
            r = get(ids[p] << 20 | ids[far]) if far < n else None
            put(p, none if r is None else r * width + p)
            if far < n:
                before[far] = p
            b = before[p]
            if b >= 0:
                r = get(ids[b] << 20 | ids[p])
                put(b, none if r is None else r * width + b)
        return np.array([ids[p] for p in range(n) if alive[p]], dtype=np.int64)


def _scaled(ranks: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    none = ranks == _NONE
    return np.where(none, _NONE, np.where(none, 0, ranks) * width + at)


def lowered(text: str) -> str:
    """Lower case letter by letter: the final sigma is not special."""
    return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)


class Encoder:
    """Texts to ids and back, with a bounded store of the words met so far."""

    def __init__(self, path: str) -> None:
        self.vocab = Vocabulary(path)
        self.ids: dict[str, bytes] = {}
        self.shown: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        """The words of a text; special tokens stand for themselves."""
        if "<|" in text and any(t in text for t in self.vocab.special):
            out = []
            for part in self.vocab.splitter.split(text):
                out += [part] if part in self.vocab.special else self.words(part)
            return out
        if text.isascii():
            return ASCII_WORDS.findall(text.lower())
        return WORDS.findall(lowered(unicodedata.normalize("NFC", text)))

    def learn(self, texts: list[list[str]]) -> None:
        new: set[str] = set().union(*texts) - self.ids.keys()
        if len(self.ids) + len(new) > CACHED_WORDS:
            # Short words come back most; should they alone fill half the store, all go.
            keep = [w for w in self.ids if len(w) <= 8]
            keep = keep if 2 * len(keep) < CACHED_WORDS else []
            self.ids, self.shown = {w: self.ids[w] for w in keep}, {w: self.shown[w] for w in keep}
            new = set().union(*texts) - self.ids.keys()
        for w, ids, shown in self.vocab.encode_many([w for w in new if w not in self.vocab.special]):
            self.ids[w], self.shown[w] = ids, shown
        for w in new & self.vocab.special.keys():
            self.ids[w] = np.array([self.vocab.special[w]], "<u4").tobytes()
            self.shown[w] = w.encode()

    def encode(self, texts: list[str | None]) -> Iterator[tuple[bytes, bytes]]:
        """Per text its ids, little-endian unsigned 32-bit, and the decoded text in UTF-8."""
        step, i = 0, 0
        while i < len(texts):
            step, size = i, 0
            while i < len(texts) and (i == step or size < 1_000_000):
                size += len(texts[i] or "")
                i += 1
            split = [self.words(t or "") for t in texts[step:i]]
            self.learn(split)
            for words in split:
                yield b"".join(map(self.ids.__getitem__, words)), b" ".join(map(self.shown.__getitem__, words))


def encoder(path: str) -> Encoder:
    return once(("bpe", path), lambda: Encoder(path))


def encode_documents(docs: DataFrame, path: str, with_ids: bool = True, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document ``n_tokens``, digests of ids and decoded text, and with ``with_ids`` both in full.

    The vocabulary is read on the workers from ``path``. Null and empty texts have no tokens and decode
    to the empty text. Repeated rows and null keys stay; other columns of ``docs`` are not read. Texts
    are taken whole; work stays in the partitions of the scan, without any shuffle.
    """
    bound_batches(docs.sparkSession)
    more = ", ids array<bigint>, decoded string" if with_ids else ""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t if isinstance(t, str) else None for t in b[text]]
            n, ids_sha, decoded_sha, ids_all, decoded_all = [], [], [], [], []
            for ids, shown in encoder(path).encode(texts):
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                decoded_sha.append(hashlib.sha256(shown).hexdigest())
                if with_ids:
                    ids_all.append(np.frombuffer(ids, "<u4").astype(np.int64))
                    decoded_all.append(shown.decode())
            out = pd.DataFrame({key: b[key], "n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": decoded_sha})
            if with_ids:
                out["ids"], out["decoded"] = pd.Series(ids_all, dtype=object), pd.Series(decoded_all, dtype=object)
            yield out

    kind = dict(docs.dtypes)[key]
    # Ids travel as text: pandas would turn whole numbers beside nulls into fractions.
    lean = docs.select(F.col(f"`{key}`").cast("string").alias(key), F.col(f"`{text}`"))
    out = lean.mapInPandas(run, f"`{key}` string, n_tokens bigint, ids_sha256 string, decoded_sha256 string{more}")
    return out.withColumn(key, F.col(f"`{key}`").cast(kind))


ship(__name__)
