"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source gets a target in words. Its documents, in an order permuted by a hash, form a line
that is read until the target is met, from the start again if the target is above the source's
size; a document longer than what is still missing is passed over. The reading is cut into blocks. A tree halves the output shards again and again; at each
node the left half draws its exact number of blocks without replacement, so its quotas follow the
multivariate hypergeometric law. At the leaves every shard has a block quota per source and takes
that many of the source's permuted blocks, disjoint from all other shards'. Within a shard the
documents are shuffled by a hash. Everything is Column work.
"""

from math import lgamma

from pyspark.sql import Window
from pyspark.sql import functions as F

from mainstreet.plans.workspace import materialise

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
_END = 2**63 - 1  # behind every place of a line
_SEED = 3
_PRIME = 1_000_003  # above any number of blocks of a source, so multiplying by it permutes them


def word_count(text):
    """Words of a text: runs other than space and tab to carriage return; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _uniform(*parts):
    return F.shiftrightunsigned(F.xxhash64(F.lit(_SEED), *parts), 11) / F.lit(float(2**53))


def targets(sizes, weights=WEIGHTS, most=MOST_REPEATS):
    """Add ``target`` to one row per source (``_null``, ``_source``, ``source_size``).

    Sources by code point, null last, weigh 5, 2, 1 and so on; together they get the sum of all
    sizes. None gets more than ``most`` times its size; what is over goes to the others by weight.
    The level at which that ends is found in the order of size per weight. One row per source is
    all that meets in a task here.
    """
    whole = Window.partitionBy()
    ranked = sizes.withColumn("_ix", F.row_number().over(Window.orderBy("_null", "_source")) - 1)
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("_ix") % len(weights))
    ranked = ranked.withColumn("_weight", weight).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    before = Window.orderBy(F.col("_cap") / F.col("_weight"), "_ix").rowsBetween(Window.unboundedPreceding, -1)
    total, weigh = F.sum("source_size").over(whole), F.sum("_weight").over(whole)
    level = (total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (
        weigh - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))
    )
    ranked = ranked.withColumn("_full", F.col("_cap") <= level * F.col("_weight"))
    spare = total - F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0.0)).over(whole)
    open_weight = F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col("_weight"))).over(whole)
    share = F.when(F.col("_full"), F.col("_cap")).otherwise(spare * F.col("_weight") / open_weight)
    return ranked.withColumn("target", share).drop("_weight", "_cap", "_full")


def _ln_factorial(n):
    small = F.array(*[F.lit(lgamma(i + 1)) for i in range(10)])
    x = F.greatest(n, F.lit(10)).cast("double")
    series = x * F.log(x) - x + F.log(x * 6.283185307179586) / 2 + 1 / (12 * x) - 1 / (360 * x * x * x)
    return F.when(n < 10, F.get(small, n.cast("int"))).otherwise(series)


def _ln_choose(n, k):
    return _ln_factorial(n) - _ln_factorial(k) - _ln_factorial(n - k)


def _hypergeometric(population, marked, draws, u):
    """Marked ones among ``draws`` of ``population`` without replacement, by the inverse of the distribution at ``u``."""
    least = F.greatest(F.lit(0), draws - (population - marked))
    most = F.least(marked, draws)
    first = (
        _ln_choose(marked, least) + _ln_choose(population - marked, draws - least) - _ln_choose(population, draws)
    )

    def step(state, x):
        below = state["below"] + F.exp(state["ln"])
        up = (marked - x) * (draws - x) / ((x + 1) * (population - marked - draws + x + 1))
        return F.struct(
            F.when(up > 0, state["ln"] + F.log(up)).otherwise(F.lit(-1e300)).alias("ln"),
            below.alias("below"),
            F.when((state["x"] < 0) & (u < below), x).otherwise(state["x"]).alias("x"),
        )

    start = F.struct(first.alias("ln"), F.lit(0.0).alias("below"), F.lit(-1).cast("long").alias("x"))
    found = F.aggregate(F.sequence(least, most), start, step, lambda s: s["x"])
    return F.when(found < 0, most).otherwise(found)


def _draw_left(quotas, draws, low, high):
    """The block counts per source of the left half of a node."""

    def step(state, q):
        u = _uniform(low, high, q["ix"], F.lit("tree"))
        x = _hypergeometric(state["population"], q["n"], state["draws"], u)
        return F.struct(
            (state["population"] - q["n"]).alias("population"),
            (state["draws"] - x).alias("draws"),
            F.concat(state["out"], F.array(F.struct(q["ix"].alias("ix"), x.alias("n")))).alias("out"),
        )

    population = F.aggregate(quotas, F.lit(0).cast("long"), lambda s, q: s + q["n"])
    empty = F.array().cast("array<struct<ix:int,n:bigint>>")
    start = F.struct(population.alias("population"), draws.cast("long").alias("draws"), empty.alias("out"))
    return F.aggregate(quotas, start, step, lambda s: s["out"])


def split_tree(blocks, shards):
    """Rows (``_ix``, ``_ends``): for each source, the end of each shard's run among its permuted blocks.

    ``blocks`` has one row per source: ``_ix`` and ``_blocks``. All shards get the same number of
    blocks, give or take one. Rows are sources and tree nodes, not documents.
    """
    ends = lambda shard, total: F.floor(shard * total / F.lit(shards))
    quota = F.struct(F.col("_ix").cast("int").alias("ix"), F.col("_blocks").cast("long").alias("n"))
    nodes = blocks.agg(F.array_sort(F.collect_list(quota)).alias("q"), F.sum("_blocks").alias("total"))
    nodes = nodes.select("q", "total", F.lit(0).alias("low"), F.lit(shards).alias("high"))
    width = shards
    while width > 1:
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        draws = ends(middle, F.col("total")) - ends(F.col("low"), F.col("total"))
        split = F.col("high") - F.col("low") > 1
        # the halves are rows of a generator, so the draw is not worked out again further down
        nodes = nodes.select(
            "total", "q", "low", "high", middle.alias("middle"),
            F.when(split, _draw_left(F.col("q"), draws, F.col("low"), F.col("high"))).alias("left"),
        )
        rest = F.zip_with("q", "left", lambda a, b: F.struct(a["ix"].alias("ix"), (a["n"] - b["n"]).alias("n")))
        half = lambda q, low, high: F.struct(q.alias("q"), low.alias("low"), high.alias("high"))
        both = F.array(half(F.col("left"), F.col("low"), F.col("middle")), half(rest, F.col("middle"), F.col("high")))
        alone = F.array(half(F.col("q"), F.col("low"), F.col("high")))
        nodes = nodes.select("total", F.explode(F.when(F.col("left").isNotNull(), both).otherwise(alone)).alias("h"))
        nodes = nodes.select("total", "h.q", "h.low", "h.high")
        width = -(-width // 2)
    quotas = nodes.select(F.col("low").alias("shard"), F.explode("q").alias("q"))
    runs = quotas.groupBy(F.col("q.ix").alias("_ix")).agg(
        F.array_sort(F.collect_list(F.struct("shard", F.col("q.n").alias("n")))).alias("runs")
    )
    sums = F.aggregate(
        "runs",
        F.array().cast("array<bigint>"),
        lambda s, r: F.concat(s, F.array(F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0)) + r["n"])),
    )
    return runs.select("_ix", sums.alias("_ends"))


def _line_uses(placed, most):
    """Candidates of the open sources: one row per use that lies behind ``_at`` and fits ``_gap``."""
    fits = placed.where((F.col("_size") > 0) & (F.col("_size") <= F.col("_gap")))
    place = lambda p: p * F.col("source_size") + F.col("_start")
    uses = F.filter(F.sequence(F.lit(0), F.lit(most - 1)), lambda p: place(p) > F.col("_at"))
    fits = fits.select("_ix", "_part", "_size", "_gap", "_start", "source_size", F.explode(uses).alias("_pass"))
    return fits.withColumn("_place", place(F.col("_pass"))).drop("_start", "source_size")


def _steps(placed, most):
    """The reading of each source as steps (``at``, ``gap``): a use before ``at`` and not before an earlier step's is
    taken if its size is at most ``gap``.

    A step ends at the first use that does not fit what is still missing. That one is passed over, and so is
    every later one that is as long, so the next step reads on behind it among the uses that fit, until none does.
    What is missing falls below the size of the use passed over, so steps are about as many as the logarithm of
    the longest size. A step finds the part in which it ends from the sums of the parts and its place within that part.
    """
    place = lambda p: p * F.col("source_size") + F.col("_start")
    over = F.filter(
        F.sequence(F.lit(0), F.lit(most - 1)),
        lambda p: (F.col("_size") > 0) & (place(p) + F.col("_size") > F.col("target")),
    )
    state = placed.groupBy("_ix").agg(F.first("target").alias("_gap"), F.min(F.get(F.transform(over, place), 0)).alias("_at"))
    step = lambda at, gap: F.struct(at.cast("long").alias("at"), gap.alias("gap"))
    end = F.lit(_END)
    state = state.select(
        "_ix",
        F.array(step(F.coalesce("_at", end), F.col("_gap"))).alias("_steps"),
        F.coalesce(F.col("_gap") - F.col("_at"), F.lit(0.0)).alias("_gap"),
        F.coalesce("_at", end).alias("_at"),
    )
    state = materialise(state)
    while not state.where(F.col("_at") < end).isEmpty():
        now = state.where(F.col("_at") < end).select("_ix", "_gap", "_at")  # one row per source
        uses = _line_uses(placed.join(F.broadcast(now), "_ix"), most)
        sums = uses.groupBy("_ix", "_pass", "_part").agg(F.first("_gap").alias("_gap"), F.sum("_size").alias("_words"))
        before = Window.partitionBy("_ix").orderBy("_pass", "_part").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("_before", F.coalesce(F.sum("_words").over(before), F.lit(0)))
        last = sums.where((F.col("_before") <= F.col("_gap")) & (F.col("_before") + F.col("_words") > F.col("_gap")))
        within = Window.partitionBy("_ix").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
        ends = uses.join(F.broadcast(last.select("_ix", "_pass", "_part", "_before")), ["_ix", "_pass", "_part"])
        read = F.col("_before") + F.coalesce(F.sum("_size").over(within), F.lit(0))
        ends = ends.withColumn("_read", read).where(F.col("_read") + F.col("_size") > F.col("_gap"))
        ends = ends.groupBy("_ix").agg(F.min(F.struct("_place", "_read")).alias("_next"))
        known = state.join(F.broadcast(ends), "_ix", "left")
        at = F.coalesce("_next._place", end)
        live = F.col("_at") < end
        state = materialise(known.select(
            "_ix",
            F.when(live, F.concat("_steps", F.array(step(at, F.col("_gap"))))).otherwise(F.col("_steps")).alias("_steps"),
            F.when(live, F.col("_gap") - F.coalesce("_next._read", F.lit(0))).otherwise(F.col("_gap")).alias("_gap"),
            F.when(live, at).otherwise(end).alias("_at"),
        ))
    return state.select("_ix", "_steps")


def _fitted(placed, most):
    """One more use, for each source, of the document whose size fits best what the source still lacks.

    All others that fit are used, so this one is longer than the gap, and less than twice as long.
    """
    gaps = placed.groupBy("_ix").agg((F.first("target") - F.sum(F.col("_uses") * F.col("_size"))).alias("_gap"))
    fit = F.abs(F.col("_size") - F.col("_gap"))
    free = (F.col("_size") > 0) & (F.col("_uses") < most) & (fit < F.col("_gap"))
    fits = placed.select("_ix", "_size", "_uses", "_order", "_row").join(F.broadcast(gaps), "_ix").where(free)
    best = fits.groupBy("_ix").agg(F.min(F.struct(fit.alias("fit"), "_order", "_row"))["_row"].alias("_row"))
    # one row per source on the broadcast side
    out = placed.join(F.broadcast(best.withColumn("_extra", F.lit(1))), ["_ix", "_row"], "left")
    return out.withColumn("_uses", F.col("_uses") + F.coalesce("_extra", F.lit(0))).drop("_extra")


def mix(docs, shards=8, blocks_per_shard=256, rows_per_part=50_000, weights=WEIGHTS, most=MOST_REPEATS,
        id_col="doc_id", text_col="text", source_col="source"):
    """One row per document: id, size, source_size, target, taken and ``draws``, one (pass, shard, order) per use.

    A document is used as often as the reading of its source comes to it while it fits what is still
    missing, so no use is left over that would fit; then the document whose size fits best what the
    source still lacks is used once more, if that brings the source nearer to its target. ``order`` is the document's place in the local shuffle of its shard. A null text has no words; a null source is a source.
    Documents without words are not drawn. Repeated rows and null ids are documents of their own.
    An empty table gives an empty result.

    The line of a source is laid out in two steps, parts by a hash and documents within a part, so
    that no task gets a whole source: words before a part come from the sums of the parts.
    """
    source = F.col(source_col)
    lines = materialise(
        docs.select(
            F.col(id_col).alias("_id"),
            source.isNull().alias("_null"),
            F.coalesce(source.cast("string"), F.lit("")).alias("_source"),
            word_count(F.col(text_col)).alias("_size"),
            F.xxhash64(F.lit(_SEED), F.col(id_col)).alias("_order"),
            F.monotonically_increasing_id().alias("_row"),
        )
    )
    parts = max(1, -(-lines.count() // rows_per_part))
    lines = lines.withColumn("_part", F.pmod(F.xxhash64("_order"), F.lit(parts)))
    sums = materialise(lines.groupBy("_null", "_source", "_part").agg(F.sum("_size").alias("_words")))
    sized = sums.groupBy("_null", "_source").agg(F.sum("_words").alias("source_size"))
    plan = targets(sized, weights, most)
    every = F.greatest(F.sum("target").over(Window.partitionBy()), F.lit(1.0))
    blocks = F.when(F.col("target") > 0, F.greatest(F.lit(1), F.round(F.col("target") / every * shards * blocks_per_shard)))
    plan = plan.withColumn("_blocks", F.coalesce(blocks, F.lit(0)).cast("long"))
    plan = materialise(plan)  # one row per source
    plan = plan.join(split_tree(plan.select("_ix", "_blocks"), shards), "_ix")
    keys = ["_null", "_source", "_part"]
    before = Window.partitionBy("_null", "_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_before", F.coalesce(F.sum("_words").over(before), F.lit(0))).drop("_words")
    offsets = offsets.join(plan, ["_null", "_source"])
    within = Window.partitionBy(*keys).orderBy("_order", "_id", "_size", "_row").rowsBetween(Window.unboundedPreceding, -1)
    placed = lines.withColumn("_within", F.coalesce(F.sum("_size").over(within), F.lit(0))).join(offsets, keys)
    placed = placed.withColumn("_start", F.col("_before") + F.col("_within"))
    placed = materialise(placed.drop("_before", "_within"))
    place = lambda p: p * F.col("source_size") + F.col("_start")
    gap = lambda p: F.get(F.filter("_steps", lambda s: place(p) < s["at"]), 0)["gap"]
    passes = F.filter(F.sequence(F.lit(0), F.lit(most - 1)), lambda p: (F.col("_size") > 0) & (F.col("_size") <= gap(p)))
    placed = placed.join(F.broadcast(_steps(placed, most)), "_ix").withColumn("_uses", F.size(passes)).drop("_steps")
    placed = materialise(_fitted(placed, most))
    # words that are read before each use: pass by pass, part by part, then within the part
    read = [F.when(F.col("_uses") > p, F.col("_size")).otherwise(0) for p in range(most)]
    sums = placed.groupBy("_ix", "_part").agg(F.array(*[F.sum(r) for r in read]).alias("_words"))
    sums = sums.select("_ix", "_part", F.posexplode("_words").alias("_pass", "_words"))
    before = Window.partitionBy("_ix").orderBy("_pass", "_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_words").over(before), F.lit(0)))
    sums = sums.groupBy("_ix", "_part").agg(F.array_sort(F.collect_list(F.struct("_pass", "_before"))).alias("_before"))
    within = Window.partitionBy("_ix", "_part").orderBy("_start", "_row").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_within", F.array(*[F.coalesce(F.sum(r).over(within), F.lit(0)) for r in read]))
    placed = placed.join(sums, ["_ix", "_part"])

    def use(p):
        at = F.least((F.get("_before", p)["_before"] + F.get("_within", p)) / F.col("target"), F.lit(1.0))
        block = F.least(F.floor(at * F.col("_blocks")), F.col("_blocks") - 1)
        permuted = (block * _PRIME + F.pmod(F.xxhash64("_ix"), F.col("_blocks"))) % F.col("_blocks")
        shard = F.size(F.filter("_ends", lambda e: e <= permuted))
        order = F.xxhash64(F.lit(_SEED), F.col("_order"), p)
        return F.struct(p.alias("pass"), shard.alias("shard"), order.alias("order"))

    draws = F.when(F.col("_uses") > 0, F.transform(F.sequence(F.lit(0), F.col("_uses") - 1), use))
    none = F.array().cast("array<struct<pass:int,shard:int,order:bigint>>")
    return placed.select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        "source_size",
        "target",
        (F.col("_uses") * F.col("_size")).cast("long").alias("taken"),
        F.coalesce(draws, none).alias("draws"),
    )


def mixed_rows(docs, shards=8, id_col="doc_id", **options):
    """The mix itself: the documents with all their columns, once per use, with ``shard`` and ``order``.

    The id must be unique here. Columns of the documents with these names are replaced.
    """
    plan = mix(docs, shards, id_col=id_col, **options).select(id_col, F.explode("draws").alias("_draw"))
    rows = docs.drop("shard", "order").join(plan, id_col)
    return rows.select(*[c for c in docs.columns if c not in ("shard", "order")], "_draw.shard", "_draw.order")
