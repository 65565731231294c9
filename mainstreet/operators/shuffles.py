"""Joins, ranks and choices that stay balanced when one key holds much of the data."""

from pyspark.errors import AnalysisException
from pyspark.sql import Window
from pyspark.sql import functions as F

from mainstreet.plans.workspace import materialise

# A key is heavy above this share of all rows, so there are fewer than 1000 heavy keys.
HEAVY_SHARE = 0.001

# Places among which the rows of a heavy key are divided.
SPREAD = 64

# A table up to this size may be sent to every task.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024

_ROW_BITS = 33


def _heavy_keys(counts, n):
    total = counts.agg(F.sum(n)).scalar()
    return counts.where(F.col(n) > F.greatest(total * F.lit(HEAVY_SHARE), F.lit(1)))


def _bytes(table):
    text = F.to_json(F.struct(*table.columns))
    return table.agg(F.sum(F.octet_length(text))).first()[0] or 0


def fits(stored):
    """Whether a stored table is small enough to be sent to every task; rows are counted before bytes."""
    return stored.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS and _bytes(stored) <= BROADCAST_BYTES


def checked_broadcast(table):
    """The table, stored once, with a broadcast hint if its size allows it."""
    stored = materialise(table)
    return F.broadcast(stored) if fits(stored) else stored


def _told(df, keys):
    """Columns by which null is a key like others: a flag and the value, or any value in place of null."""
    return {
        name: column
        for i, key in enumerate(keys)
        for name, column in (
            (f"_null{i}", F.col(key).isNull()),
            (f"_key{i}", F.coalesce(F.col(key), F.lit("0").cast(df.schema[key].dataType))),
        )
    }


def null_safe_lookup(facts, table, keys, spread, counted=None):
    """:func:`lookup` where null equals null in the keys, which are numbers or texts."""
    flagged = [n for i in range(len(keys)) for n in (f"_null{i}", f"_key{i}")]
    found = lookup(
        facts.withColumns(_told(facts, keys)), table.withColumns(_told(table, keys)).drop(*keys), flagged, spread, counted
    )
    return found.drop(*flagged)


def lookup(facts, table, keys, spread, counted=None):
    """Left join ``facts`` to ``table``, which has one row per ``keys``.

    The table is stored once and measured. If it fits, it is broadcast and ``facts`` is not
    shuffled at all. Otherwise heavy keys of ``facts`` are served by a broadcast of fewer than
    1000 table rows, and their fact rows are spread over all tasks by a hash of ``spread``
    instead of meeting in one. If these rows are too wide to be broadcast, they are copied and
    their fact rows divided among the copies. ``counted`` names a column of ``table`` that already holds the
    number of fact rows (or a bound in proportion to it); without it the keys are counted here.
    """
    stored = materialise(table)
    if fits(stored):
        return facts.join(F.broadcast(stored), keys, "left").select(
            *facts.columns, *[v for v in table.columns if v not in keys]
        )
    return _spread_lookup(facts, stored, keys, spread, counted)


def _spread_lookup(facts, table, keys, spread, counted):
    values = [v for v in table.columns if v not in keys]
    if counted:
        heavy = _heavy_keys(table, counted)
    else:
        counts = facts.where(_all_set(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows_of_key"))
        # the heavy keys, fewer than 1000, pick their rows out of the table
        heavy = table.join(F.broadcast(_heavy_keys(counts, "_rows_of_key").drop("_rows_of_key")), keys, "inner")
    heavy = materialise(heavy.select(*keys, F.struct(*values).alias("_heavy")))
    if _bytes(heavy) > BROADCAST_BYTES:
        return _copied_lookup(facts, table, heavy.select(*keys), keys, spread)
    # light rows meet their table row by the key; heavy ones are already served and go anywhere
    by_key = F.xxhash64(*keys)
    route = F.when(F.col("_heavy").isNull() & _all_set(keys), by_key).otherwise(F.xxhash64(*spread))
    tagged = facts.join(F.broadcast(heavy), keys, "left").withColumn("_route", route)
    light = table.select(*keys, F.struct(*values).alias("_light"), by_key.alias("_route"))
    joined = tagged.join(light, [*keys, "_route"], "left")
    picked = F.coalesce("_heavy", "_light")
    return joined.select(*facts.columns, *[picked[v].alias(v) for v in values])


def _copied_lookup(facts, table, heavy, keys, spread):
    """For heavy rows too wide to be sent everywhere: each has ``SPREAD`` copies, among which its facts are divided."""
    heavy = F.broadcast(heavy.withColumn("_heavy", F.lit(True)))
    place = F.pmod(F.xxhash64(*spread), F.lit(SPREAD)).cast("int")
    # facts without a whole key meet nothing, so they may go anywhere
    place = F.when(F.col("_heavy"), place).when(_all_set(keys), 0).otherwise(-1 - place)
    divided = facts.join(heavy, keys, "left").withColumn("_place", place)
    copies = F.when(F.col("_heavy"), F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))
    copied = table.join(heavy, keys, "left").withColumn("_place", F.explode(copies)).drop("_heavy")
    joined = divided.join(copied, [*keys, "_place"], "left")
    return joined.select(*facts.columns, *[v for v in table.columns if v not in keys])


def _all_set(keys):
    out = F.lit(True)
    for key in keys:
        out = out & F.col(key).isNotNull()
    return out


def first_rows(df, by, order, k=1):
    """The first ``k`` rows per key. The limit runs in every map task, so at most ``k`` rows per
    key and task are shuffled."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_rn", rank).where(F.col("_rn") <= k).drop("_rn")


def _placed(df):
    return df.withColumn("_mid", F.monotonically_increasing_id())


def _number(placed, name):
    """Consecutive numbers from 1: the position in the partition plus the sizes of the partitions before it."""
    part = F.shiftright("_mid", _ROW_BITS)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition of the input, whatever the number of rows
    offsets = (
        placed.groupBy(part.alias("_part"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    within = F.col("_mid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    numbered = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return numbered.withColumn(name, F.col("_offset") + within + 1).drop("_mid", "_part", "_offset")


def number_rows(df, name="row_idx"):
    """Number the rows of a file scan in input order: files by their path, rows as they stand in the file.

    ``df`` is a scan with projections on top. A row is addressed by its file, the byte at which its
    part of the file begins, and its place within that part, so the numbers do not depend on how
    parts are packed into tasks or how large they are. Rows that do not come from files are numbered
    partition by partition.
    """
    try:
        placed = _placed(df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")))
    except AnalysisException:  # not a scan of files
        return _number(_placed(df), name)
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    # one row per part of a file
    parts = placed.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    offsets = parts.select("_file", "_start", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    numbered = placed.join(F.broadcast(offsets), ["_file", "_start"])
    return numbered.withColumn(name, F.col("_offset") + F.col("_mid") - F.col("_first") + 1).select(*df.columns, name)


def global_rank(df, order, name):
    """ROW_NUMBER over the whole table. ``order`` must be unique; give only the columns that matter.

    A window without keys would put all rows into one task. A global sort is split by ranges of
    the key instead. Its result is stored with each row's place, because a second run of the sort
    may choose other ranges. The sizes of the ranges are then counted from those places.
    """
    return _number(materialise(_placed(df.orderBy(*order))), name)
