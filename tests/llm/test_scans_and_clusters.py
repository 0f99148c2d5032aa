"""Hard negatives, license scans and bit-plane clusters against plain readings of their contracts, on odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from postmill.llm import bitplanes, bond, licenses

VECTORS = "vec_id bigint, embedding array<double>, label int, v string, id string, block string"


def vectors(seed, n, dims, spread=0.2):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(4, dims))
    x = centers[rng.integers(0, 4, n)] + spread * rng.normal(size=(n, dims))
    x[n // 2 : n // 2 + 5] = x[0]
    return [(i, [float(c) for c in x[i]], int(rng.integers(0, 3)), "v", "i", "b") for i in range(n)]


def odd_vectors(dims):
    return [
        (1000, None, 1, "v", "i", "b"), (1050, [float("nan")] + [1.0] * (dims - 1), 1, "v", "i", "b"), (1100, [None] + [1.0] * (dims - 1), 1, "v", "i", "b"),
        (1150, [float("-inf")] * dims, 1, "v", "i", "b"), (1200, [1.0, 2.0, 3.0], 1, "v", "i", "b"), (1201, [1.0, 2.0, 2.0], 1, "v", "i", "b"), (1250, [], 0, "v", "i", "b"),
        (1300, [1.0] * dims, None, "v", "i", "b"), (None, [1.0] * dims, 1, "v", "i", "b"), (1202, [2.0, 1.0, 0.0], 2, "v", "i", "b"),
    ]


def plain_negatives(rows):
    whole = {}
    for i, v, label, *_ in sorted((r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None), key=lambda r: r[0]):
        if all(c is not None and np.isfinite(c) for c in v):
            label = (label + 1) % 10 if i % 7 == 0 else label
            candidate = (label, [int(np.floor(256 * c)) for c in v])
            whole[i] = min(whole.get(i, candidate), candidate)
    out = set()
    for a, (label, v) in whole.items():
        if a % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, own) for i, (own, w) in whole.items() if i != a and len(w) == len(v))
        for score, p, own in [s for s in scored if s[2] == label][:5]:
            inside = [(n, i) for n, i, o in scored if o != label and 50 * -score <= 100 * -n <= 95 * -score][:3]
            out |= {(a, p, rank, i, -score, -n) for rank, (n, i) in enumerate(inside, 1)}
    return out


@pytest.mark.parametrize("block_rows,slice_anchors", [(16_384, 65_536), (37, 3)])
def test_hard_negatives(spark, block_rows, slice_anchors):
    rows = vectors(3, 300, 19) + odd_vectors(19)
    rows += rows[50:60] + [(100, [0.5] * 19, 0, "v", "i", "b")]
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = bond.hard_negatives(df, F.col("vec_id") % 50 == 0, label, block_rows=block_rows, slice_anchors=slice_anchors).collect()
    want = plain_negatives(rows)
    assert len(got) == len(want) and {tuple(r) for r in got} == want and len(want) > 20
    assert bond.hard_negatives(df.limit(0), F.col("vec_id") % 50 == 0, label).count() == 0


def test_hard_negatives_of_large_components(spark):
    rows = [(0, [1e9, 1.0], 1), (1, [1e9, 2.0], 1), (2, [0.7e9, 5.0], 2), (3, [1e300, 0.0], 2), (4, [0.6e9, 0.0], 2)]
    got = bond.hard_negatives(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"), F.col("vec_id") == 0, F.col("label")).collect()
    # 2 ** 63 is passed by all scores here: each leaves its block as the largest long, so none is below its positive.
    assert got == []
    rows = [(0, [1e7, 1.0], 1), (1, [1e7, 2.0], 1), (2, [0.7e7, 5.0], 2), (3, [1e300, 0.0], 2), (4, [0.6e7, 0.0], 2)]
    got = bond.hard_negatives(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"), F.col("vec_id") == 0, F.col("label")).collect()
    exact = [2560000000**2 + 256 * 512, 2560000000 * 1792000000 + 256 * 1280, 2560000000 * 1536000000]
    assert [tuple(r) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1, 1, 2, exact[0], exact[1]), (0, 1, 2, 4, exact[0], exact[2])]


def test_bitmap_shrinks_before_the_last_dimension():
    rng = np.random.default_rng(5)
    x = rng.integers(-300, 300, size=(2000, 64))
    x[:, :6] *= 20
    block = bond.Columns(np.arange(2000), np.zeros(2000, dtype=np.int64), x)
    seen = []

    def keep(alive, low, high):
        seen.append(len(alive))
        return high >= bond.kth_largest(low, 5) if len(low) > 5 else np.ones(len(low), dtype=bool)

    alive, scores = block.scan(x[7], np.arange(2000), keep)
    exact = x @ x[7]
    assert np.array_equal(scores, exact[alive]) and set(np.argsort(-exact)[:5]) <= set(alive.tolist())
    assert seen[0] == 2000 and seen[2] < 1000 and seen[-1] < 100


def plain_clusters(rows, k=8, rounds=10, scale=1024, dims=64):
    kept = [(i, [int(np.floor(scale * c)) for c in v]) for i, v, *_ in rows if v is not None and len(v) == dims and all(c is not None and np.isfinite(c) for c in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]
    centroids = [list(v) for _, v in first]

    def assign():
        ds = [[sum((x - y) ** 2 for x, y in zip(v, c)) for c in centroids] for _, v in kept]
        return [(d.index(min(d)), min(d)) for d in ds]

    for _ in range(rounds):
        of = assign()
        for c in range(len(centroids)):
            mine = [v for (_, v), (own, _) in zip(kept, of) if own == c]
            if mine:
                centroids[c] = [sum(col) // len(mine) for col in zip(*mine)]
    of = assign()
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    total = sum(d for _, d in of)
    return [(i, c, d, sum(e for o, e in of if o == c), total, shas[c]) for (i, _), (c, d) in zip(kept, of)]


@pytest.mark.parametrize("n,dims", [(120, 64), (5, 64), (80, 70)])
def test_bitplane_clusters(spark, n, dims):
    rows = vectors(n, n, dims) + odd_vectors(dims)
    rows += rows[2:6]
    got = bitplanes.bitplane_clusters(spark.createDataFrame(rows, VECTORS).repartition(4), dims=dims).collect()
    want = plain_clusters(rows, dims=dims)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_bitplane_clusters_at_the_edges(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert bitplanes.bitplane_clusters(empty).count() == 0
    same = spark.createDataFrame([(i, [0.0] * 64) for i in range(9)], "vec_id bigint, embedding array<float>")
    assert {(r.cluster, r.distance, r.inertia) for r in bitplanes.bitplane_clusters(same).collect()} == {(0, 0, 0)}
    # A component of 2 ** 31 / 1024: distances just below 2 ** 63 stay exact.
    rows = [(0, [2.0**21] + [0.0] * 63), (1, [-(2.0**20)] + [0.0] * 63), (2, [1e300] * 64)]
    got = {r.vec_id: r for r in bitplanes.bitplane_clusters(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), k=1, rounds=0).collect()}
    first = min(rows, key=lambda r: hashlib.sha256(f"3:{r[0]}".encode()).hexdigest())[0]
    want = {i: sum((int(np.floor(min(1024 * x, 9.2e18))) - int(np.floor(min(1024 * y, 9.2e18)))) ** 2 for x, y in zip(v, rows[first][1])) for i, v in rows}
    assert {i: r.distance for i, r in got.items()} == {i: min(d, 2**63 - 1) for i, d in want.items()}


def test_planes_hold_every_integer():
    rng = np.random.default_rng(1)
    for low, high in ((0, 0), (-1, 0), (-8, 7), (-9, 7), (-8, 8), (-(2**40), 2**20)):
        bits = bitplanes.planes_for(low, high)
        x = np.array([[low, high] * 32, rng.integers(low, high, 64, endpoint=True).tolist()])
        planes = bitplanes.pack(x, bits)
        assert np.array_equal(bitplanes.rough(planes), x.astype(float))
        if high < 2**20 and low > -(2**20):
            assert np.array_equal(bitplanes.dots(planes[:, None], planes[None]).view(np.int64), x @ x.T)


def plain_words(text):
    low = (text or "").translate({c: c + 32 for c in range(0x41, 0x5B)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def license_texts():
    rng = random.Random(2)
    notices = {label: text for label, text in licenses.NOTICES}
    changed = notices["mit"].split()
    changed[20:20] = ["quite", "new"]
    del changed[50:53]
    shuffled = notices["bsd-3"].split()
    rng.shuffle(shuffled)
    return [
        None, "", " \n", "under the MIT-license", "UNDER THE MIT LICENSE, under the mit license under the mit", "Apache License, Version 2.0", "cc by nc cc-BY-NC 4.0 cc by",
        "under the mitlicense", "ünder the mit license", "under the mit licensé", notices["mit"], " ".join(changed), " ".join(shuffled),
        "x " * 500 + notices["apache-2"] + " y" * 500 + notices["apache-2"], "Licensed under the GNU General Public License, version 3 now",
        "Licensed under the new GNU General Public License, version 3", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "a" * 600_000 + " under the mit license " + "é" * 300_000, "under the mit license " * 3000, "under\x00the\x7fmit`license", " under the mit license",
        "a under the mit license", "under the mit",
    ]


def test_license_scan_finds_all_phrases(spark):
    texts = license_texts()
    rows = [(i if i != 7 else None, t, 1, "s", "d") for i, t in enumerate(texts)] + [(4, texts[4], 1, "s", "d"), (4, "cc by nc", 1, "s", "d")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_words int, label string, digest string").repartition(4)
    got = licenses.scan_licenses(df).collect()
    want = []
    for i, t, *_ in rows:
        words, places = plain_words(t), []
        for label, phrase in licenses.PHRASES:
            p = phrase.split()
            places += [(s, label) for s in range(len(words) - len(p) + 1) if words[s : s + len(p)] == p]
        at = [s for s, _ in places]
        want.append((i, len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))))
    assert sorted(map(str, [tuple(r)[:6] for r in got])) == sorted(map(str, want))
    by = {r.doc_id: r for r in got if r.doc_id != 4}
    assert all(set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1 for r in got)
    assert by[10].labels == "mit" and by[10].score == 1 and by[11].labels == "mit" and 0.75 <= by[11].score < 1
    assert by[12].labels == "" and by[12].score == 0 and by[13].labels == "apache-2"
    assert by[14].labels == by[15].labels == "gpl-3" and by[14].score == 1
    assert "cc-by-nc" in by[16].labels.split(",")
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_word_hashes_in_blocks(monkeypatch):
    rng = random.Random(6)
    text = "".join(rng.choice(["ab", " ", "É", "Zz9", "\n", "漢"]) for _ in range(5000)).encode()
    whole = licenses.word_hashes(text, licenses.Powers())
    for size in (1, 7, 64):
        monkeypatch.setattr(licenses, "BLOCK", size)
        parts = licenses.word_hashes(text, licenses.Powers())
        assert np.array_equal(whole[0], parts[0]) and np.array_equal(whole[1], parts[1])
    words = plain_words(text.decode())
    assert len(words) == len(whole[0]) and len(set(words)) == len(set(whole[0].tolist()))


def test_templates_shorter_than_a_gram_are_refused():
    with pytest.raises(ValueError):
        licenses.template_rows([("x", "two words", True)], 3)
