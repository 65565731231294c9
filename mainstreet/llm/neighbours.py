"""Approximate nearest neighbours by inner product: a small-world graph per shard, and the shards' answers merged.

Vectors are dealt to shards by a hash of their components, so equal vectors share a shard; they are
one node of its graph. Of each of them the ``most + 1`` smallest ids are kept, which is all that a
list of ``most`` neighbours without the asking row can name. A shard's index is one row: vectors,
ids and, per layer, the flat array of neighbours. Queries are packed into blocks, every block meets
every shard, and the best of all shards are ranked by the exact product in double precision.

A shard has about ``SHARD_ROWS`` vectors, so building takes memory that does not depend on the
input and time in proportion to it. Every query asks every shard: nothing else keeps the recall when
vectors have no clusters, and its cost is queries times shards.
"""

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mainstreet.llm import graphs
from mainstreet.llm.blocks import mix
from mainstreet.operators.shuffles import first_rows
from mainstreet.plans.workspace import materialise

SHARD_ROWS = 16_384  # vectors to a shard
LEAST_SHARDS = 8  # also of small tables, so that no task has all rows
WIDTH = 192  # of the list of candidates in a shard; recall of 0.95 or more in a full shard of vectors without clusters
BLOCK = 4096  # queries to a row
CHUNK_BLOCKS = 16  # blocks that meet a shard in one task


@dataclass
class Index:
    rows: DataFrame  # one per dimension and shard
    shards: int
    most: int
    kind: str  # of the components: float or double


def usable(df, vector_col="embedding", id_col="vec_id"):
    """Rows with an id and a vector of finite components that are not all 0."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(F.col(id_col).isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))


def _kind(df, vector_col):
    element = df.schema[vector_col].dataType.elementType.typeName()
    return "float" if element == "float" else "double"


def _selected(df, vector_col, id_col, kind):
    slim = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{kind}>").alias("v"))
    return usable(slim, "v", "id").withColumn("dim", F.size("v"))


def _matrix(column, dim):
    return column.flatten().to_numpy().reshape(-1, dim)


def _build(key, table):
    import pyarrow as pa

    dim, shard = (k.as_py() for k in key)
    ids = table.column("id").to_numpy()
    vectors = _matrix(table.column("v").combine_chunks(), dim) + 0  # -0 becomes 0
    raw = np.ascontiguousarray(vectors).view(f"V{vectors.itemsize * dim}").ravel()
    # rows of one vector side by side, their ids ascending
    _, code = np.unique(raw, return_inverse=True)
    order = np.lexsort((ids, code))
    ids, code, vectors = ids[order], code[order], vectors[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    ends = np.append(first, len(ids))
    # nodes in an order that only the smallest ids decide
    turn = np.argsort(mix(ids[first].astype(np.uint64)), kind="stable")
    flat = np.concatenate([np.arange(ends[i], ends[i + 1]) for i in turn])
    sizes = np.diff(ends)[turn]
    vectors = vectors[first][turn]
    graph = graphs.build(graphs.lengthened(vectors))
    return pa.table({
        "dim": pa.array([dim], pa.int32()), "shard": pa.array([shard], pa.int32()), "nodes": pa.array([len(vectors)]),
        "vectors": pa.array([vectors.tobytes()], pa.binary()), "ids": pa.array([ids[flat].tobytes()], pa.binary()),
        "sizes": pa.array([sizes.astype(np.int64).tobytes()], pa.binary()),
        "links": pa.array([[l.astype(np.int32).tobytes() for l in graph.layers]], pa.list_(pa.binary())),
    })


def fit(df, most=20, id_col="vec_id", vector_col="embedding"):
    """Index every usable row for lists of up to ``most`` neighbours; stored, one row per dimension and shard.

    Rows without id, and vectors that are null, empty, zero or hold null or non-finite components,
    are left out. Vectors of different lengths are kept apart. Equal rows are one. No rows give an
    index that finds nothing. Other columns are not looked at.
    """
    kind = _kind(df, vector_col)
    rows = _selected(df, vector_col, id_col, kind)
    shards = max(LEAST_SHARDS, -(-rows.count() // SHARD_ROWS))
    rows = rows.dropDuplicates(["id", "v"])
    # the limit works before the shuffle, so a vector that many rows share does not meet in one task
    kept = first_rows(rows, ["dim", "v"], ["id"], most + 1)
    dealt = kept.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"))
    built = dealt.groupBy("dim", "shard").applyInArrow(
        _build, "dim int, shard int, nodes long, vectors binary, ids binary, sizes binary, links array<binary>"
    )
    return Index(materialise(built), shards, most, kind)


def _pack(batches):
    """Blocks of queries of one dimension: their keys, ids and vectors as bytes."""
    import pyarrow as pa

    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims):
            of = batch.filter(pa.array(dims == dim))
            for low in range(0, len(of), BLOCK):
                part = of.slice(low, BLOCK)
                keys = part.column("key").to_numpy()
                columns = [pa.array([dim], pa.int32()), pa.array([int(keys[0])])]
                columns += [pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for v in (
                    keys, part.column("id").to_numpy(), _matrix(part.column("v"), dim)
                )]
                yield pa.RecordBatch.from_arrays(columns, ["dim", "block", "keys", "ids", "vectors"])


def _search(kind, k, width):
    float_type = np.float32 if kind == "float" else np.float64

    def block(row, vectors, graph, ids, sizes):
        keys, own = np.frombuffer(row["keys"], np.int64), np.frombuffer(row["ids"], np.int64)
        asked = np.frombuffer(row["vectors"], float_type).reshape(len(keys), -1)
        found, _ = graph.search(graphs.asking(asked), min(max(width, 2 * k), len(vectors)))
        r, place = np.nonzero(found >= 0)
        node = found[r, place]
        score = np.einsum("ij,ij->i", asked[r].astype(np.float64), vectors[node].astype(np.float64))
        # the k best nodes and those as good as the last of them can name all of the k best rows but for the own one
        order = np.lexsort((-score, r))
        r, node, score = r[order], node[order], score[order]
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        limit = np.full(len(keys), -np.inf)
        limit[r[rank == k]] = score[rank == k]
        kept = score >= limit[r]
        r, node, score = r[kept], node[kept], score[kept]
        # every id of a node
        ends = np.cumsum(sizes)
        many = sizes[node]
        at = np.repeat(ends[node] - many, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        r, score, other = np.repeat(r, many), np.repeat(score, many), ids[at]
        foreign = other != own[r]
        r, score, other = r[foreign], score[foreign], other[foreign]
        order = np.lexsort((other, -score, r))
        r, score, other = r[order], score[order], other[order]
        best = np.arange(len(r)) - np.searchsorted(r, r) < k
        return keys[r[best]], own[r[best]], other[best], score[best]

    def run(key, asked, index):
        import pyarrow as pa

        parts = []
        for entry in index.select(["nodes", "vectors", "ids", "sizes", "links"]).to_pylist():
            vectors = np.frombuffer(entry["vectors"], float_type).reshape(entry["nodes"], -1)
            layers = [np.frombuffer(l, np.int32) for l in entry["links"]]
            layers = [l.reshape(n, -1) for l, n in zip(layers, graphs.layer_sizes(entry["nodes"]))]
            graph = graphs.Graph(graphs.lengthened(vectors), layers)
            ids, sizes = np.frombuffer(entry["ids"], np.int64), np.frombuffer(entry["sizes"], np.int64)
            for batch in asked.to_batches(max_chunksize=1):
                for row in batch.to_pylist():
                    parts.append(block(row, vectors, graph, ids, sizes))
        columns = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, t) for i, t in enumerate((np.int64, np.int64, np.int64, np.float64))]
        return pa.table(dict(zip(("key", "query_id", "vec_id", "score"), map(pa.array, columns))))

    return run


def search(index, queries, k=20, id_col="vec_id", vector_col="embedding", width=WIDTH):
    """The ``k`` nearest indexed rows of each query: query_id, rank, vec_id, score.

    Rows with the query's own id are no answers to it. The score is the inner product of the
    original vectors in double precision; equal scores rank by the smaller id. Each row of
    ``queries`` is a query, so a repeated one is answered as often. Rows that ``fit`` would leave
    out ask nothing.
    """
    if k > index.most:
        raise ValueError(f"The index holds ids for lists of {index.most}, not {k}")
    asked = materialise(_selected(queries, vector_col, id_col, index.kind)).withColumn("key", F.monotonically_increasing_id())
    packed = materialise(asked.mapInArrow(_pack, "dim int, block long, keys binary, ids binary, vectors binary"))
    chunks = max(1, -(-packed.count() // CHUNK_BLOCKS))
    dealt = packed.withColumn("chunk", F.pmod(F.xxhash64("block"), F.lit(chunks)).cast("int"))
    dealt = dealt.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(index.shards - 1))))
    # a shard is copied for every chunk of queries, so that no task has more than one of each
    copied = index.rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    by = ["dim", "shard", "chunk"]
    found = dealt.groupBy(*by).cogroup(copied.groupBy(*by)).applyInArrow(
        _search(index.kind, k, width), "key long, query_id long, vec_id long, score double"
    )
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.col("score").desc(), F.col("vec_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
