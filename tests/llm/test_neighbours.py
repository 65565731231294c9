"""Nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mainstreet.llm import graphs, neighbours, queries


def brute(rows, asked, k=20):
    """(query id, rank, id, score) by comparing all vectors of a length; equal rows are one."""
    rows = {(i, repr(v)): (i, v) for i, v in rows}.values()
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    wanted = [(i, np.array(v, np.float64)) for i, v in asked if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = []
    for i, v in wanted:
        near = sorted((-float(np.dot(v, w)), j) for j, w in good if j != i and len(w) == len(v))
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(near[:k])]
    return out


def lists(rows):
    out = {}
    for q, rank, i, score in sorted(rows, key=lambda r: (r[0], r[1])):
        assert rank == len(out.setdefault(q, [])) + 1
        out[q].append((i, score))
    return out


def recall(got, expected):
    """The share of the expected scores that were reached, so that ties count alike."""
    got, expected = lists(got), lists(expected)
    assert got.keys() == expected.keys()
    return np.mean([g[1] >= e[1] - 1e-9 for q in expected for g, e in zip(got[q] + [(0, -9e9)] * 20, expected[q])])


def test_the_query(spark):
    sf = "/root/testdata/sf0.1"
    table = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = [tuple(r) for r in queries.QUERIES["op13_neighbours"](spark, sf).collect()]
    asked = [r for r in table if r[0] % 20 == 0]
    assert len(got) == 20 * len(asked)
    vectors = {i: np.array(v, np.float64) for i, v in table}
    for q, _, i, score in got:
        assert q != i and score == pytest.approx(float(vectors[q] @ vectors[i]), abs=1e-12)
    for found in lists(got).values():
        assert found == sorted(found, key=lambda p: (-p[1], p[0])) and len({i for i, _ in found}) == 20
    assert recall(got, brute(table, asked)) >= 0.95


def spread(kind, n=4000, d=24):
    draw = np.random.default_rng(5)
    if kind == "lengths":  # a large inner product goes to long vectors
        return draw.normal(size=(n, d)) * draw.lognormal(sigma=1, size=(n, 1))
    if kind == "clusters":  # far apart, and of very different sizes
        at = np.minimum(draw.geometric(0.3, n), 12)
        return 30 * draw.normal(size=(13, d))[at] + draw.normal(size=(n, d))
    if kind == "near copies":  # half of all are nearly one vector
        out = draw.normal(size=(n, d))
        out[::2] = out[0] + 0.01 * draw.normal(size=(len(out[::2]), d))
        return out
    return draw.normal(size=(n, d))


@pytest.mark.parametrize("kind", ["even", "lengths", "clusters", "near copies"])
def test_graph(kind):
    vectors = spread(kind)
    graph = graphs.build(graphs.lengthened(vectors))
    asked = vectors[::20]
    found, _ = graph.search(graphs.asking(asked), neighbours.WIDTH)
    true = asked @ vectors.T
    limit = np.sort(true, axis=1)[:, -20]
    reached = np.sort(np.where(found >= 0, np.take_along_axis(true, found, 1), -np.inf), axis=1)[:, -20:]
    assert (reached >= limit[:, None] - 1e-9 * np.abs(limit[:, None])).mean() >= 0.95
    for layer, links in enumerate(graph.layers):
        present = [row[row >= 0] for row in links]
        assert all(len(set(p)) == len(p) and i not in p for i, p in enumerate(present))
        assert all(len(p) for p in present) or len(links) == 1


def test_many_equal_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 7)
    monkeypatch.setattr(neighbours, "CHUNK_BLOCKS", 2)
    draw = np.random.default_rng(1)
    few = draw.normal(size=(30, 5)).round(1)
    rows = [(i, [float(x) for x in few[0 if i % 3 == 0 else i % 30]]) for i in range(600)]
    df = spark.createDataFrame(rows + rows[:1] * 50, "vec_id long, embedding array<double>").repartition(5)
    asked = [r for r in rows if r[0] % 20 == 0]
    got = neighbours.search(neighbours.fit(df), df.where("vec_id % 20 = 0").distinct()).collect()
    expected = lists(brute(rows, asked))
    found = lists(map(tuple, got))
    assert {q: [i for i, _ in v] for q, v in found.items()} == {q: [i for i, _ in v] for q, v in expected.items()}
    small = neighbours.search(neighbours.fit(df, most=3), df.where("vec_id % 20 = 0").distinct(), k=3).collect()
    assert {q: [i for i, _ in v] for q, v in lists(map(tuple, small)).items()} == {q: [i for i, _ in v[:3]] for q, v in expected.items()}
    with pytest.raises(ValueError):
        neighbours.search(neighbours.fit(df, most=3), df, k=4)


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 0.0]), (20, [0.5, 0.5]), (20, [-0.0, 2.0]), (40, None), (60, []), (80, [0.0, 0.0]), (100, [float("nan"), 1.0]),
        (120, [float("inf"), 1.0]), (140, [None, 1.0]), (160, [1.0, 2.0, 3.0]), (180, [1e30, 1e30]), (None, [9.0, 9.0]), (1, [0.0, 2.0]), (2, [0.0, 2.0]),
        (2, [0.0, 2.0]), (3, [1e-30, 0.0]),
    ]
    schema = "vec_id long, embedding array<float>, score string, dim string, id string, key string"
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], schema)
    made = neighbours.search(neighbours.fit(df), df.where("vec_id % 20 = 0"))
    assert made.columns == ["query_id", "rank", "vec_id", "score"]
    got = made.collect()
    asked = [r for r in rows if r[0] is not None and r[0] % 20 == 0]
    as_float = [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    expected = brute(as_float, [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in asked])
    assert sorted((r[0], r[1], r[2], round(r[3], 6)) for r in got) == sorted((q, n, i, round(s, 6)) for q, n, i, s in expected)
    assert not [r for r in got if r[0] == 160]
    assert neighbours.search(neighbours.fit(df.limit(0)), df).count() == 0
    assert neighbours.search(neighbours.fit(df), df.limit(0)).count() == 0
