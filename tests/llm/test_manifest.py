"""The manifest against a plain tree."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from mainstreet.llm import manifest, queries


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes, fanout):
    """The root of the nodes and for each one the siblings (left, right) of all levels."""
    paths, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, at in enumerate(places):
            first = at - at % fanout
            paths[i].append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + fanout])))
            places[i] = at // fanout
        nodes = [sha("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
    return nodes[0], paths


def plainly(rows, fanout=2):
    """(id, group, leaf) -> (id, group, leaf, path, subroot, root), sorted."""
    def first_null(v):
        return (v is not None, v.encode() if isinstance(v, str) else v or 0)

    groups = {}
    for r in sorted(rows, key=lambda r: (first_null(r[0]), r[2])):
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=first_null)
    trees = {g: plain_tree([r[2] for r in groups[g]], fanout) for g in names}
    if not names:
        return []
    root, over = plain_tree([trees[g][0] for g in names], fanout)
    return sorted(
        (repr((*r, path + up, trees[g][0], root)) for g, up in zip(names, over) for r, path in zip(groups[g], trees[g][1])),
    )


def built(df, fanout=2):
    rows = manifest.build(df, fanout).collect()
    return sorted(repr((r["id"], r["group"], r["leaf"], [tuple(s) for s in r["path"]], r["subroot"], r["root"])) for r in rows)


@pytest.mark.parametrize("fanout, levels", [(2, 2), (3, 4), (2, 8)])
def test_trees_of_all_sizes(spark, monkeypatch, fanout, levels):
    monkeypatch.setattr(manifest, "LEVELS", levels)
    draw = random.Random(fanout)
    sizes = {"a": 1, "b": 2, None: 7, "é": 16, "z": 17, "": 45}
    rows = [(draw.randrange(60) if draw.random() < 0.9 else None, g, sha(str(draw.randrange(99)))) for g, n in sizes.items() for _ in range(n)]
    assert built(spark.createDataFrame(rows, "id long, group string, leaf string").repartition(4), fanout) == plainly(rows, fanout)


def test_the_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = {r["doc_id"]: r for r in queries.QUERIES["op12_manifest"](spark, sf).collect()}
    leaves = [(d[0], d[2], plain_leaf(*d)) for d in docs]
    assert len(got) == len(docs)
    expected = {eval(r)[0]: eval(r) for r in plainly(leaves)}
    touched = 0
    for d, (i, _, made) in zip(docs, leaves):
        r, (_, _, _, path, subroot, root) = got[i], expected[i]
        assert (r["leaf"], r["subroot"], r["root"]) == (made, subroot, root)
        assert r["proof_sha256"] == sha("".join(a + b for a, b in path))
        n = d[3] + 1 if d[3] is not None and zlib.crc32(str(i).encode()) % 7 == 0 else d[3]
        node = plain_leaf(i, d[1], d[2], n, d[4])
        for a, b in path:
            node = sha(a + node + b)
        assert (r["folded_root"], r["verified"]) == (node, node == root)
        assert r["verified"] == (n == d[3])
        touched += n != d[3]
    assert 0 < touched < len(docs)


def test_odd_rows(odd, nothing):
    tree = manifest.documents(odd, "score", "size", F.col("kept").alias("root"))
    assert tree.columns == ["id", "group", "leaf", "score", "size", "path", "subroot", "root"]
    rows = tree.collect()
    leaves = [(r["doc_id"], r["lang"], plain_leaf(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"])) for r in odd.collect()]
    got = sorted(repr((r["id"], r["group"], r["leaf"], [tuple(s) for s in r["path"]], r["subroot"], r["root"])) for r in rows)
    assert got == plainly(leaves)
    assert {r["score"] for r in rows} == {"x"}
    assert manifest.documents(nothing).count() == 0


def test_one_row(odd):
    row = manifest.documents(odd.where("doc_id = 9")).withColumn("f", manifest.fold(F.col("leaf"))).first()
    assert row["path"] == [] and row["leaf"] == row["subroot"] == row["root"] == row["f"]
