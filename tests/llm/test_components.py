"""Components of an edge table in few rounds."""

import random

import numpy as np

from postmill.llm import components as stars


def plain(edges):
    least = {x: x for e in edges for x in e}
    for _ in least:
        old = dict(least)
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
        if old == least:
            break
    return least


def test_a_small_graph_needs_one_round(spark, monkeypatch):
    rng = random.Random(3)
    names = rng.sample(range(10_000), 400)
    edges = [*zip(names[:150], names[1:151]), *((rng.choice(names[200:]), rng.choice(names[200:])) for _ in range(150)), (names[0], names[0])]
    writes = []
    monkeypatch.setattr(stars, "written", lambda df, name, write=stars.written: writes.append(name) or write(df, name))
    df = spark.createDataFrame([*edges, (None, 5)], "a bigint, b bigint")
    got = {r.node: r.component for r in stars.components(df).collect()}
    want = plain([e for e in edges if e[0] != e[1]])
    assert got == want
    assert len(writes) == 2


def test_blocks_of_edges_leave_rounds_but_no_link(spark, monkeypatch):
    monkeypatch.setattr(stars, "EDGES_AT_ONCE", 7)
    names = list(range(500, 900))
    random.Random(4).shuffle(names)
    edges = list(zip(names, names[1:]))
    df = spark.createDataFrame(edges, "a bigint, b bigint").repartition(5)
    assert {r.node: r.component for r in stars.components(df).collect()} == dict.fromkeys(names, 500)


def test_least_reached():
    node, least = stars.least_reached(np.array([9, 7, 5, 2]), np.array([7, 5, 4, 1]))
    assert dict(zip(node.tolist(), least.tolist())) == {9: 4, 7: 4, 5: 4, 4: 4, 2: 1, 1: 1}
