"""Connected components of a graph of links, without collecting links or groups."""

from pyspark.sql import functions as F

from mainstreet.plans.workspace import materialise


SMALL = 100_000  # links that one task may work on


def _state(edges):
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links, a="a", b="b"):
    """Rows (``id``, ``component``) for every id in a link; the component is the smallest id reachable.

    Links to itself are ignored. Alternately every node hangs its larger neighbours, and then its
    smaller ones, on the smallest it knows; both keep the components, and stars remain. Smallest
    neighbours are found with partial aggregates, so a node with many links costs no task more than
    its share of the links. Each round is stored in the shared folder. Up to ``SMALL`` links are
    left in one task, where rounds need no shuffles.
    """
    u, v = F.col(a), F.col(b)
    links = links.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()
    edges = materialise(links)
    before = None
    while before != (now := _state(edges)):
        before = now
        if not now[0]:
            break
        if now[0] <= SMALL:
            edges = edges.coalesce(1)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        larger = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        larger = materialise(larger.where("u != v"))
        least = larger.groupBy("u").agg(F.min("v").alias("m"))
        moved = larger.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = least.select("u", F.col("m").alias("v"))
        edges = materialise(moved.unionByName(own).distinct())
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
