"""Merkle manifest: a hash tree over the rows of every group, and one over the groups.

Leaves of a group stand in order of the id; every ``fanout`` consecutive nodes become one of the
next level until one is left. The groups' roots, in order of the group, are hashed alike.

A tree is built in tiers of ``LEVELS`` levels. A tier divides the nodes of a group into aligned
blocks of ``fanout ** LEVELS``, which no run of siblings crosses, so one shuffle by (group, block)
serves all levels of the tier however large a group is. Within a block the node of a level stands
on the row of its first leaf, so its siblings are a fixed number of rows before and after it: lag
and lead columns with the offsets ``d * fanout ** level``, masked by the slot of the node and by
the length of its run, supply them, and the rows of first children hash the parents. The roots of
the blocks are the nodes of the next tier. On the way back a row takes its parent's path by lag
from the row of the first child, and the path of its block by a join on (group, block).
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from mainstreet.operators.shuffles import fits, global_rank
from mainstreet.plans.workspace import materialise

LEVELS = 8  # of a tier, with a fan-out of 2; a block is a window partition of at most 256 rows

_SIBLINGS = "array<struct<left:string,right:string>>"


def digest(*parts):
    """Lowercase hex SHA-256 of the parts one after the other."""
    return F.sha2(F.concat(*parts), 256)


def encoded(column):
    """``-`` for null, else byte count, colon and value, so that no two rows have the same bytes."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns):
    return digest(*[encoded(c) for c in columns])


def _levels(fanout, largest):
    """Levels of a tier: as many as the largest group needs, but no larger blocks than with a fan-out of 2."""
    levels = 1
    while fanout**levels < largest and fanout ** (levels + 1) <= 2**LEVELS:
        levels += 1
    return levels


def _joined(parts):
    """The present ones among the parts, one after the other."""
    return F.concat_ws("", *parts) if parts else F.lit("")


def _tier(nodes, fanout, levels):
    """One tier over rows (_group, _at, _count, _node, ...): adds _block, _top and _path.

    ``_top`` is the block's root, on its first row. ``_path`` holds, for every level of the tier at
    which the group has several nodes, the digests left and right of the row's ancestor.
    """
    block = fanout**levels
    window = Window.partitionBy("_group", "_block").orderBy("_at")
    rows = nodes.withColumn("_block", F.floor(F.col("_at") / F.lit(block))).withColumn("_n0", F.col("_node"))
    at = F.col("_at")
    for level in range(levels):
        step, node = fanout**level, F.col(f"_n{level}")
        here = at % step == 0
        left = F.ceil(F.col("_count") / F.lit(step))  # nodes of the group at this level
        place = F.floor(at / F.lit(step))
        slot = place % fanout
        run = F.least(F.lit(fanout), left - (place - slot))
        before = [F.when(slot >= d, F.lag(node, d * step).over(window)) for d in range(fanout - 1, 0, -1)]
        after = [F.when(slot + d < run, F.lead(node, d * step).over(window)) for d in range(1, fanout)]
        rows = rows.withColumns({"_before": _joined(before), "_after": _joined(after)})
        several = here & (left > 1)
        parent = F.when(several, digest(node, F.col("_after"))).otherwise(node)
        rows = rows.withColumns({
            f"_s{level}": F.when(several, F.struct(F.col("_before").alias("left"), F.col("_after").alias("right"))),
            f"_slot{level}": F.when(here, slot),
            f"_n{level + 1}": F.when(here & (slot == 0), parent),
        }).drop("_before", "_after")
    rows = rows.withColumn("_path", F.when(at % block == 0, F.array().cast(_SIBLINGS)))
    for level in range(levels - 1, -1, -1):
        slot, own = F.col(f"_slot{level}"), F.col(f"_s{level}")
        above = F.when(slot == 0, F.col("_path"))
        for d in range(1, fanout):
            above = above.when(slot == d, F.lag("_path", d * fanout**level).over(window))
        rows = rows.withColumn("_above", above)
        none = F.array().cast(_SIBLINGS)
        rows = rows.withColumn("_path", F.concat(F.when(own.isNotNull(), F.array(own)).otherwise(none), F.col("_above")))
    return rows.select(*nodes.columns, "_block", F.col(f"_n{levels}").alias("_top"), "_path")


def _tree(nodes, fanout):
    """Rows (_group, _at, _count, _node) with the whole ``_path`` of each and ``_root``, the root of its group."""
    largest = nodes.agg(F.max("_count")).first()[0] or 0
    levels = _levels(fanout, largest)
    block = fanout**levels
    tier = _tier(nodes, fanout, levels)
    tops = tier.where(F.col("_at") % block == 0).select(
        F.col("_group").alias("_g"), F.col("_block").alias("_b"), F.ceil(F.col("_count") / F.lit(block)).alias("_c"), "_top"
    )
    tops = materialise(tops)
    if largest > block:
        above = _tree(tops.toDF("_group", "_at", "_count", "_node"), fanout).select(
            F.col("_group").alias("_g"), F.col("_at").alias("_b"), F.col("_path").alias("_upper"), "_root"
        )
    else:
        above = tops.select("_g", "_b", F.array().cast(_SIBLINGS).alias("_upper"), F.col("_top").alias("_root"))
    # the rows are already dealt by group and block, which are of one block each and so not heavy
    joined = tier.join(above, F.col("_group").eqNullSafe(F.col("_g")) & (F.col("_block") == F.col("_b")))
    return joined.select(*nodes.columns, F.concat("_path", "_upper").alias("_path"), "_root")


def fold(start, path="path"):
    """The root that a leaf leads to with the siblings of ``path``."""
    return F.aggregate(path, start, lambda node, s: digest(s["left"], node, s["right"]))


def proof_digest(path="path"):
    """The hash of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def build(rows, fanout=2):
    """The trees over ``rows`` (id, group, leaf, and further columns): adds path, subroot and root.

    Leaves of a group ascend by id, nulls first, then by leaf, so repeated ids and rows have a fixed
    result, too. Groups ascend bytewise, null first; null is a group. ``path`` has one entry (left,
    right) for every level of the group's tree and then of the tree over the groups; both are empty
    where a run has one node. No rows give no rows. Further columns stay; those named path, subroot
    or root are replaced.
    """
    kept = [c for c in rows.columns if c not in ("id", "group", "leaf", "path", "subroot", "root")]
    slim = rows.select("id", "group", "leaf", F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_more") if kept else F.lit(0).alias("_more"))
    order = [F.col("group").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("leaf").asc_nulls_first()]
    ranked = global_rank(slim, order, "_place")
    # one row per group
    groups = ranked.groupBy(F.col("group").alias("_g")).agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_count"))
    groups = materialise(groups)
    few = fits(groups)
    placed = ranked.join(F.broadcast(groups) if few else groups, F.col("group").eqNullSafe(F.col("_g")))
    nodes = placed.select(
        "id", "group", "leaf", "_more", F.col("group").alias("_group"), (F.col("_place") - F.col("_first")).alias("_at"), "_count", F.col("leaf").alias("_node")
    )
    tree = _tree(nodes, fanout)
    tops = materialise(tree.where(F.col("_at") == 0).select("_group", "_root"))
    numbered = global_rank(tops, [F.col("_group").asc_nulls_first()], "_no")
    over = _tree(
        numbered.select(
            F.col("_group").alias("_name"), F.lit(0).alias("_group"), (F.col("_no") - 1).alias("_at"), F.lit(tops.count()).alias("_count"), F.col("_root").alias("_node")
        ),
        fanout,
    )
    over = materialise(over.select("_name", F.col("_path").alias("_upper"), F.col("_root").alias("root")))
    joined = tree.join(F.broadcast(over) if few else over, F.col("_group").eqNullSafe(F.col("_name")))
    return joined.select(
        "id", "group", "leaf", *[F.col("_more")[c].alias(c) for c in kept], F.concat("_path", "_upper").alias("path"),
        F.col("_root").alias("subroot"), "root",
    )


def documents(docs, *carried):
    """The tree over documents: one group per lang, leaves over doc_id, source, lang, n_chars and text.

    ``carried`` are further columns (expressions) that come along. Texts are hashed where they are
    read and not shuffled.
    """
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    return build(docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("group"), leaf(fields).alias("leaf"), *carried))
