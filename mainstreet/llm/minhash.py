"""MinHash near-dedup with min-max hashing.

Every permutation of the shingles gives two values, the smallest and the largest, so half as many
permutations make a signature of the same length. Bands of smallest and bands of largest values
bring texts together; links are confirmed on the full sets.

Texts with the same set are one class. Within a band's bucket, every class is first compared with
the bucket's first class only. Buckets that still hold classes of different components go on with
further leaders, more each round, until all classes of a bucket are compared with each other or
known to be connected. So a bucket of copies is never expanded into all of its pairs.

Sets are fetched only for pairs that pass three tests within the join. The sizes must allow the
similarity. The parities of the sets' elements in ``PARITIES`` places must not differ in more
places than the sets may have elements that are not in both; that loses no pair. And one bit of
every signature value must agree about as often as at the threshold, within four deviations.
"""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mainstreet.llm import blocks
from mainstreet.llm.components import components
from mainstreet.operators.shuffles import checked_broadcast, lookup
from mainstreet.plans.workspace import materialise

PERMUTATIONS = 120
RECALL = 0.9999  # of pairs just at the threshold, by the bands
MORE_LEADERS = 64  # times the leaders of a bucket in each round
PARITIES = 1024
DEVIATIONS = 4

_rng = np.random.default_rng(29)
_TIMES = _rng.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def shingles(offsets, data, width=3):
    """Row and hash of the distinct shingles of every text, sorted by both.

    Words are runs other than white space, in lower-case ASCII. With fewer words than ``width`` the
    whole sequence is one shingle; without words there is none.
    """
    data = blocks.LOWER_ASCII[data]
    starts, ends, row = blocks.words(offsets, data)
    word = blocks.span_hashes(data, starts, ends)
    n = len(offsets) - 1
    last = len(word) - width + 1
    if last > 0:
        whole = row[:last] == row[width - 1 :]
        total = np.zeros(last, np.uint64)
        for i in range(width):
            total = total * np.uint64(0x9E3779B97F4A7C15) + word[i : i + last]
        at, rows = blocks.mix(total[whole]), row[:last][whole]
    else:
        at, rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    cut = blocks.row_ranges(row, n)
    count = np.diff(cut)
    short = np.flatnonzero((count > 0) & (count < width))
    few = np.zeros(len(short), np.uint64)
    for i, r in enumerate(short):
        with np.errstate(over="ignore"):
            value = np.uint64(count[r])
            for w in word[cut[r] : cut[r + 1]]:
                value = value * np.uint64(0x9E3779B97F4A7C15) + w
        few[i] = value
    at, rows = np.concatenate([at, blocks.mix(few ^ np.uint64(0x5DEECE66D))]), np.concatenate([rows, short])
    order = np.lexsort((at, rows))
    at, rows = at[order], rows[order]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (rows[1:] != rows[:-1])
    return rows[new], at[new]


def band_width(percent):
    """Values in a band: the most at which pairs with this similarity still share a band with RECALL."""
    goal = percent / 100
    for width in range(16, 1, -1):
        if 1 - (1 - goal**width) ** (2 * PERMUTATIONS // width) >= RECALL:
            return width
    return 1


def signatures(offsets, data, width, band):
    """Per text: size of its set, two hashes of the whole set, a bit of each value, parities, and its band values."""
    n = len(offsets) - 1
    rows, at = shingles(offsets, data, width)
    size = np.bincount(rows, minlength=n)
    some = np.flatnonzero(size)
    first = blocks.row_ranges(rows, n)[some]
    sums = np.zeros((2, n), np.uint64)
    values = np.zeros((2 * PERMUTATIONS, n), np.uint64)
    if len(some):
        sums[0, some] = np.add.reduceat(blocks.mix(at + np.uint64(1)), first)
        sums[1, some] = np.add.reduceat(blocks.mix(at ^ np.uint64(0xA5A5A5A5A5A5A5A5)), first)
        for p in range(PERMUTATIONS):
            order = at * _TIMES[p] + _PLUS[p]
            values[p, some] = np.minimum.reduceat(order, first)
            values[PERMUTATIONS + p, some] = np.maximum.reduceat(order, first)
    bands = np.zeros((n, 2 * PERMUTATIONS // band), np.uint64)
    for b in range(bands.shape[1]):
        key = np.full(n, b + 1, np.uint64)
        for v in values[b * band : (b + 1) * band]:
            key = blocks.mix(key * np.uint64(0x9E3779B97F4A7C15) + v)
        bands[:, b] = key
    bits = np.zeros((n, 256), np.uint8)
    bits[:, : 2 * PERMUTATIONS] = (values.T >> np.uint64(20)).astype(np.uint8) & 1
    place = rows * PARITIES + (at >> np.uint64(12)).astype(np.int64) % PARITIES
    odd = np.bincount(place, minlength=n * PARITIES).astype(np.uint8).reshape(n, PARITIES) & 1
    bits = np.packbits(np.hstack([bits, odd]), axis=1).view(np.int64)
    sums = sums.view(np.int64)
    return [size, sums[0], sums[1], *bits.T, [r.tobytes() for r in bands]]


def _unpacked(binary):
    """The 8-byte numbers of a band column, hashed to longs."""
    each = F.sequence(F.lit(0), F.floor(F.octet_length(binary) / 8).cast("int") - 1)
    return F.transform(each, lambda i: F.xxhash64(F.substring(binary, i * 8 + 1, F.lit(8))))


def _overlaps(left, right, width):
    """Per row of two text columns: shingles in both, and in either."""
    both, either = [], []
    for first, offsets, data in blocks.text_blocks(left, blocks.BLOCK_BYTES // 2):
        n = len(offsets) - 1
        rows_a, a = shingles(offsets, data, width)
        other, bytes_b = blocks.string_buffers(right.slice(first, n))
        rows_b, b = shingles(other - other[0], bytes_b[other[0] : other[-1]], width)
        rows, at = np.concatenate([rows_a, rows_b]), np.concatenate([a, b])
        order = np.lexsort((at, rows))
        rows, at = rows[order], at[order]
        same = np.bincount(rows[1:][(rows[1:] == rows[:-1]) & (at[1:] == at[:-1])], minlength=n)
        both.append(same)
        either.append(np.bincount(rows, minlength=n) - same)
    return np.concatenate(both or [np.zeros(0, int)]), np.concatenate(either or [np.zeros(0, int)])


def _confirm(pairs, texts, percent, width):
    """The pairs (a, b) whose full sets are similar enough."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            both, either = _overlaps(batch.column(1), batch.column(3), width)
            good = pa.array((either > 0) & (100 * both >= percent * either))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(2).filter(good)], ["a", "b"])

    schema = T.StructType([T.StructField(c, pairs.schema[c].dataType) for c in ("a", "b")])
    named = lambda side: texts.select(F.col("_id").alias(side), F.col("_text").alias(f"text_{side}"))
    joined = pairs.join(named("b"), "b").join(named("a"), "a").select("a", "text_a", "b", "text_b")
    return joined.mapInArrow(run, schema)


def near_duplicates(docs, percent=85, width=3, id_col="doc_id", text_col="text"):
    """One row per document: id, n_shingles, component_id and kept.

    Documents whose sets of shingles have a Jaccard similarity of ``percent`` or more are linked.
    Texts without words (null, empty or white space) have no shingles and no links. A row without id
    is a component of its own, with a null component, and is kept. Repeated rows get equal results;
    two texts under one id are not expected. Other columns are not looked at, and an empty table
    gives an empty result.
    """
    band = band_width(percent)
    words = [f"_b{i}" for i in range(4 + PARITIES // 64)]
    fields = [T.StructField(f, T.LongType()) for f in ("_n", "_s1", "_s2", *words)]
    fields.append(T.StructField("_bands", T.BinaryType()))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    signed = blocks.append_columns(texts, "_text", fields, lambda o, d: signatures(o, d, width, band)).drop("_text")
    signed = materialise(signed)
    sets = ["_s1", "_s2", "_n"]
    usable = signed.where((F.col("_n") > 0) & F.col("_id").isNotNull())
    classes = usable.groupBy(*sets).agg(
        F.min("_id").alias("_rep"), F.count(F.lit(1)).alias("_rows"), *[F.first(c).alias(c) for c in (*words, "_bands")]
    )
    classes = materialise(classes)
    bands = classes.select(F.col("_rep").alias("r"), F.explode(_unpacked(F.col("_bands"))).alias("key"))
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("_many")).where("_many > 1").drop("_many")
    about = classes.select(F.col("_rep").alias("r"), F.col("_n").alias("n"), *words)
    # most classes share no bucket, so their sketches are added to the rest only
    members = materialise(bands.join(shared, "key").join(about, "r").withColumn("c", F.col("r")))
    # the texts of all classes that share a bucket with another
    asked = checked_broadcast(members.select(F.col("r").alias("_id")).distinct())
    own = texts.join(asked, "_id", "left_semi")
    if not usable.groupBy("_id").count().where("count > 1").isEmpty():
        own = own.dropDuplicates(["_id"])
    own = materialise(own)
    apart = (1 - percent / 100) / 2
    most_apart = int(2 * PERMUTATIONS * apart + DEVIATIONS * (2 * PERMUTATIONS * apart * (1 - apart)) ** 0.5)
    differing = lambda some: sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"a{w}"))) for w in some), F.lit(0))
    similar = 100 * F.least("n", "na") >= percent * F.greatest("n", "na")
    similar &= differing(words[4:]) * (100 + percent) <= (F.col("n") + F.col("na")) * (100 - percent)
    similar &= differing(words[:4]) <= most_apart
    links, known, leaders = None, None, 1
    while not members.isEmpty():
        # the first classes of each bucket lead it; Spark limits them in every task before the shuffle
        rank = F.row_number().over(Window.partitionBy("key").orderBy("r"))
        lead = members.withColumn("_rank", rank).where(F.col("_rank") <= leaders)
        lead = lead.select("key", F.col("r").alias("a"), F.col("c").alias("ca"), F.col("n").alias("na"), *[F.col(w).alias(f"a{w}") for w in words])
        lead = materialise(lead)
        pairs = members.withColumnRenamed("r", "b").join(lead, "key").where((F.col("b") > F.col("a")) & (F.col("c") != F.col("ca")) & similar)
        pairs = materialise(pairs.select("a", "b").distinct())
        found = None
        if not pairs.isEmpty():
            found = materialise(_confirm(pairs, own, percent, width))
        if found is not None and not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            known = materialise(components(links).select(F.col("id").alias("r"), F.col("component").alias("_c")))
        rest = members.join(lead.select("key", F.col("a").alias("r")), ["key", "r"], "left_anti")
        if known is not None:
            rest = rest.join(known, "r", "left").withColumn("c", F.coalesce("_c", "c")).drop("_c")
        open_keys = rest.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low != high")
        members = materialise(rest.join(open_keys.select("key"), "key"))
        leaders *= MORE_LEADERS
    grouped = classes.drop("_bands", *words).withColumn("component_id", F.col("_rep"))
    if known is not None:
        known = known.select(F.col("r").alias("_rep"), "_c")
        grouped = grouped.drop("component_id").join(known, "_rep", "left")
        grouped = grouped.withColumn("component_id", F.coalesce("_c", "_rep")).drop("_c")
    grouped = grouped.drop("_rep")
    out = lookup(signed.drop("_bands", *words), grouped, sets, ["_id"], counted="_rows").drop("_rows")
    own = F.when(F.col("_id").isNotNull(), F.coalesce("component_id", "_id")).alias("component_id")
    return out.select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), own).withColumn(
        "kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))
    )


def deduplicated(docs, percent=80, width=5, id_col="doc_id", text_col="text"):
    """The documents with their columns, one of each group of near duplicates: the one with the smallest id.

    Of repeated rows of one id, one stays; rows without id all stay.
    """
    verdict = materialise(near_duplicates(docs, percent, width, id_col, text_col).select(id_col, "kept"))
    # as long as the ids can be sent to every task, the texts stay where they are
    gone = checked_broadcast(verdict.where(~F.col("kept")).select(id_col).distinct())
    left = docs.join(gone, id_col, "left_anti")
    again = verdict.where(F.col("kept") & F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1")
    again = materialise(again.select(id_col))
    if again.isEmpty():
        return left
    repeated = left.join(again, id_col, "left_semi").dropDuplicates([id_col])
    return left.join(again, id_col, "left_anti").unionByName(repeated)
