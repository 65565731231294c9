"""Sharding by sampled splitters: near-equal bytes, equal texts side by side.

The order of records is (hash of the text, hash of the id). A sample that takes a record with a
probability in proportion to its bytes gives quantiles of the text hash; they cut the order into
many small ranges. A text that fills several quantiles gets a range of its own. Ranges that come
out overfull when their bytes are summed exactly are subdivided: by the text, or by the id if the
range is one text. Runs of ranges with equal bytes become the shards.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from mainstreet.plans.workspace import materialise

_SEED = 7
_UNIT = float(2**53)


def _uniform(*parts):
    """A number in [0, 1) that depends on the values only."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(_SEED), *parts), 11) / F.lit(_UNIT)


def _range_of(key, splitters):
    """How many splitters are not above the key: binary search in a sorted constant array."""
    steps, step = [], 1
    while step <= len(splitters):
        steps.insert(0, step)
        step *= 2
    if not steps:
        return F.lit(0)
    marks = F.array(*[F.lit(s).cast("long") for s in splitters])
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, s: F.when(
            (at + s <= F.lit(len(splitters))) & (F.get(marks, at + s - 1) <= key), at + s
        ).otherwise(at),
    )


def splitters(records, total, count, ranges, sample):
    """Quantiles of ``_key`` in a size-weighted sample of about ``ranges * sample`` records.

    The result is a Python list of at most ``2 * ranges`` integers, whatever the number of records.
    """
    if not count or not total:
        return []
    rate = F.col("_size") * F.lit(ranges * sample / total)
    chosen = records.where(_uniform("_key", "_sub", F.lit("sample")) < rate)
    cuts = [i / ranges for i in range(1, ranges)]
    marks = chosen.agg(F.percentile_approx("_key", cuts, 100 * ranges)).first()[0] or []
    heavy = {a for a, b in zip(marks, marks[1:]) if a == b}
    return sorted({*marks, *(k + 1 for k in heavy)})


def place(docs, shards=8, ranges_per_shard=512, sample=32, rows_per_range=500_000, id_col="doc_id", text_col="text"):
    """One row per document: id, size (bytes of the text plus 1), CRC, shard and slot within the shard.

    A null text has no bytes and lies with the empty ones. Repeated rows and null ids are records of
    their own. Other columns are not looked at. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    records = materialise(
        docs.select(
            F.col(id_col).alias("_id"),
            (F.octet_length(text) + 1).cast("long").alias("_size"),
            F.crc32(text.cast("binary")).alias("_crc"),
            # 53 bits, which the quantiles keep exactly
            F.shiftrightunsigned(F.xxhash64(text), 11).alias("_key"),
            F.xxhash64(F.lit(_SEED), F.col(id_col)).alias("_sub"),
        )
    )
    count, total = records.agg(F.count(F.lit(1)), F.sum("_size")).first()
    total = total or 0
    ranges = max(shards * ranges_per_shard, -(-count // rows_per_range))
    marks = splitters(records, total, count, ranges, sample)
    ranged = records.withColumn("_range", _range_of(F.col("_key"), marks))
    # pieces of each range: one row per range, so at most 2 * ranges rows
    mean = max(1.0, total / ranges)
    pieces = ranged.groupBy("_range").agg(
        F.when(F.sum("_size") > 2 * mean, F.ceil(F.sum("_size") / mean)).otherwise(1).cast("long").alias("_pieces"),
        (F.min("_key") == F.max("_key")).alias("_one"),
    )
    spot = F.when(F.col("_one"), _uniform("_sub")).otherwise(_uniform("_key"))
    cut = ranged.join(F.broadcast(pieces), "_range").withColumn("_piece", F.floor(spot * F.col("_pieces")))
    # exact bytes and records per piece: at most 4 * ranges rows
    units = cut.groupBy("_range", "_piece").agg(F.sum("_size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_range", "_piece").rowsBetween(Window.unboundedPreceding, -1)
    middle = F.coalesce(F.sum("_bytes").over(before), F.lit(0)) + F.col("_bytes") / 2
    units = units.withColumn("shard", F.least(F.floor(middle * shards / F.lit(max(1, total))), F.lit(shards - 1)).cast("int"))
    within = Window.partitionBy("shard").orderBy("_range", "_piece").rowsBetween(Window.unboundedPreceding, -1)
    units = units.withColumn("_offset", F.coalesce(F.sum("_rows").over(within), F.lit(0))).drop("_bytes", "_rows")
    place_in = Window.partitionBy("_range", "_piece").orderBy("_key", "_sub", "_id", "_size")
    return (
        cut.join(F.broadcast(units), ["_range", "_piece"])
        .withColumn("slot", F.col("_offset") + F.row_number().over(place_in) - 1)
        .select(
            F.col("_id").alias(id_col),
            F.col("_size").alias("size"),
            F.col("_crc").alias("text_crc32"),
            "shard",
            F.col("slot").cast("long").alias("slot"),
        )
    )


def write_shards(docs, path, shards=8, id_col="doc_id", text_col="text"):
    """Write the documents as Parquet, one folder ``shard=N`` per shard, in the order of the slots.

    The id must be unique here, as it says which document takes which slot.
    """
    placed = place(docs, shards, id_col=id_col, text_col=text_col).select(id_col, "shard", "slot")
    out = docs.drop("shard", "slot").join(placed, id_col)
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
