"""Embedding near-dedup by collision counting over sorted one-dimensional projections.

Every vector, scaled to length one, is projected on many random directions. It stands far out on
the directions where its own projections are largest, so crowded middles are not compared. The
vectors that stand far out on a direction are sorted by their projections on two companions of it,
and a window centred on each of them says with which others it collides. Collisions are counted per
pair, and pairs that reach a count are verified by their cosine in double precision. The width of
the windows and the count are calibrated together: of all widths at which simulated pairs just at
the threshold still reach a count with the wanted recall, the one that costs least is taken.

With more vectors than single directions can tell apart, those that stand far out on the same two
(or three) directions are sorted together, so that what a vector is compared with does not grow.
"""

from itertools import combinations
from math import comb, erf, exp, factorial, sqrt

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mainstreet.llm.components import components
from mainstreet.operators.shuffles import lookup
from mainstreet.plans.workspace import materialise

TOP = 20  # directions kept for each vector
MOST_DIRECTIONS = 65536
RECALL = 0.999  # of simulated pairs
VERIFY = 30  # what verifying a pair costs, in collisions
_SEED = 41
_CHUNK = 2048  # directions drawn at a time
_LEAST_DIRECTIONS = 256


def _directions(dims, first, n):
    """``n`` Gaussian directions from number ``first`` on; ``first`` is a multiple of the chunk."""
    return np.random.default_rng([_SEED, dims, first]).standard_normal((dims, n), np.float32)


def _farthest(unit, n_directions):
    """Per row: the ``TOP`` directions with the largest projections in ascending order, and the projections on their companions.

    The companions of a direction are those whose number differs in the last bit, or the last but one.
    """
    best_at, best = np.zeros((len(unit), 0), np.int64), np.zeros((len(unit), 0, 3), np.float32)
    for first in range(0, n_directions, _CHUNK):
        n = min(_CHUNK, n_directions - first)
        values = unit.astype(np.float32) @ _directions(unit.shape[1], first, n)
        at = np.argpartition(-values, TOP - 1, axis=1)[:, :TOP]
        found = np.stack([np.take_along_axis(values, at ^ flip, 1) for flip in (0, 1, 2)], 2)
        best_at, best = np.hstack([best_at, at + first]), np.hstack([best, found])
        if best_at.shape[1] > TOP:
            keep = np.argpartition(-best[:, :, 0], TOP - 1, axis=1)[:, :TOP]
            best_at, best = np.take_along_axis(best_at, keep, 1), np.take_along_axis(best, keep[:, :, None], 1)
    order = np.argsort(best_at, 1)
    return np.take_along_axis(best_at, order, 1), np.take_along_axis(best[:, :, 1:], order[:, :, None], 1)


def _cells(unit, n_directions, together):
    """Per row: the numbers of its sets of ``together`` directions, and two projections to sort and window each by."""
    at, companions = _farthest(unit, n_directions)
    chosen = np.array(list(combinations(range(TOP), together)))
    number = np.zeros((len(unit), len(chosen)), np.int64)
    for column in chosen.T:
        number = number * n_directions + at[:, column]
    first, last = chosen[:, 0], chosen[:, -1]
    return number, companions[:, first, 0], companions[:, last, 1]


def scheme(n, directions_per_vector=0.33, most=MOST_DIRECTIONS):
    """How many directions to draw for ``n`` vectors, and how many of them are taken together.

    Two or three are taken together when there would have to be more than ``most`` directions. Then
    a vector meets about as many others by chance, before windows, as it has sets.
    """
    def rounded(wanted):
        return 1 << max(_LEAST_DIRECTIONS.bit_length() - 1, int(np.ceil(np.log2(max(1, wanted)))))

    if rounded(n * directions_per_vector) <= most:
        return rounded(n * directions_per_vector), 1
    for together in (2, 3):
        wanted = rounded((n * comb(TOP, together) * factorial(together)) ** (1 / together))
        if wanted <= most:
            break
    return min(most, wanted), together


def _by_chance(expected, least):
    """How likely a Poisson number with this mean is to reach ``least``."""
    term, below = exp(-expected), 0.0
    for k in range(least):
        below += term
        term *= expected / (k + 1)
    return max(0.0, 1 - below)


def simulated(cosine, dims, n_directions, together, pairs, seed):
    """For pairs with exactly this cosine: how far apart their projections are in each cell that they share."""
    rng = np.random.default_rng(seed)
    differences = []
    for _ in range(0, pairs, 500):
        a = _unit(rng.standard_normal((500, dims)))
        b = rng.standard_normal((500, dims))
        b -= (a * b).sum(1, keepdims=True) * a
        norm = np.linalg.norm(b, axis=1, keepdims=True)
        b = cosine * a + np.sqrt(max(0.0, 1 - cosine**2)) * b / np.where(norm > 0, norm, 1)
        (at_a, *va), (at_b, *vb) = _cells(a, n_directions, together), _cells(b, n_directions, together)
        for i in range(500):
            _, in_a, in_b = np.intersect1d(at_a[i], at_b[i], assume_unique=True, return_indices=True)
            # a collision needs both projections inside the window
            differences.append(np.max([np.abs(x[i, in_a] - y[i, in_b]) for x, y in zip(va, vb)], 0, initial=0))
    return differences


def calibrated(cosine, dims, n_directions, together=1, recall=RECALL, pairs=4000):
    """Half the width of a window, and the number of collisions that a pair must reach; None if no count has the recall.

    Simulated pairs with exactly this cosine give, for every width, the largest count that they reach
    often enough. What a width costs is worked out for pairs without relation, whose projections
    differ by twice the variance of one.
    """
    differences = simulated(cosine, dims, n_directions, together, pairs, _SEED + 1)
    spread = sqrt(2 * (1 - cosine))
    shared = comb(TOP, together) ** 2 * factorial(together) / n_directions**together
    choices = []
    for deviations in (1, 1.25, 1.5, 1.75, 2, 2.25, 2.5, 3, 3.5, 4, 6):
        half = max(deviations * spread, 1e-3)
        count = [int((d <= half).sum()) for d in differences]
        least = int(np.quantile(count, 1 - recall, method="lower"))
        met = shared * erf(half / 2) ** 2
        cost = shared * min(1.0, 1.5 * erf(half / 2)) / 5 + met + VERIFY * _by_chance(met, least)
        if least >= 1:
            choices.append((cost, half, least))
    return min(choices)[1:] if choices else None


def _plan(n, cosine, dims, most):
    """Directions, how many of them are taken together, half a window and the count for ``n`` vectors."""
    n_directions, together = scheme(n, most=most)
    while True:
        found = calibrated(cosine, dims, n_directions, together)
        if found:
            return n_directions, together, *found
        # fewer directions are shared more often; below the least number single ones are
        if n_directions > _LEAST_DIRECTIONS:
            n_directions //= 2
        elif together > 1:
            together -= 1
        else:
            raise ValueError(f"collisions cannot find pairs at a cosine of {cosine} in {dims} dimensions")


def _matrix(column):
    """The rows of an Arrow list column of equally long vectors, as a matrix of doubles."""
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    return flat.reshape(len(column), -1)


def _unit(x):
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _projected(n_directions, together):
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        step = max(32, 1024 // comb(TOP, together) * TOP)
        for batch in batches:
            lengths = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for dims in np.unique(lengths):
                part = batch.filter(pa.array(lengths == dims))
                for low in range(0, len(part), step):
                    some = part.slice(low, step)
                    number, x, y = _cells(_unit(_matrix(some.column(1))), n_directions, together)
                    row = pa.array(np.repeat(np.arange(len(some)), number.shape[1]))
                    yield pa.RecordBatch.from_arrays(
                        [
                            some.column(0).take(row), pa.array(np.full(number.size, dims, np.int32)), pa.array(number.ravel()),
                            pa.array(x.ravel().astype(np.float64)), pa.array(y.ravel().astype(np.float64)),
                        ],
                        ["c", "dims", "cell", "x", "y"],
                    )

    return run


def _verified(cosine):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keep = []
            for low in range(0, len(batch), 8192):
                some = batch.slice(low, 8192)
                a, b = (
                    np.split(np.asarray(c.flatten().to_numpy(zero_copy_only=False), np.float64), c.offsets.to_numpy()[1:-1] - c.offsets[0].as_py())
                    for c in (some.column(1), some.column(3))
                )
                sizes = {len(v) for v in a}
                if len(sizes) == 1:
                    x, y = _unit(np.stack(a)), _unit(np.stack(b))
                    keep.append((x * y).sum(1) >= cosine)
                else:
                    keep.append(np.array([(_unit(x[None]) * _unit(y[None])).sum() >= cosine for x, y in zip(a, b)], bool))
            good = pa.array(np.concatenate(keep) if keep else np.zeros(0, bool))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(2).filter(good)], ["a", "b"])

    return run


def usable(vector):
    """Whether a vector has a direction: not null or empty, all components finite, not all zero."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def collisions(cells, half):
    """Rows (a, b), a < b, one for each cell in which the two are in each other's window.

    Within a cell the rows are ordered into stretches as long as half a window, so that a row is
    compared with its own stretch and the next one only.
    """
    placed = cells.withColumn("stretch", F.floor(F.col("x") / half))
    left = placed.select(
        F.col("c").alias("a"), "dims", "cell", F.col("x").alias("xa"), F.col("y").alias("ya"),
        F.posexplode(F.array("stretch", F.col("stretch") + 1)).alias("next", "stretch"),
    )
    right = placed.select(F.col("c").alias("b"), "dims", "cell", "stretch", F.col("x").alias("xb"), F.col("y").alias("yb"))
    near = left.join(right, ["dims", "cell", "stretch"]).where(
        ((F.col("next") == 1) | (F.col("a") < F.col("b")))
        & (F.abs(F.col("xa") - F.col("xb")) <= half)
        & (F.abs(F.col("ya") - F.col("yb")) <= half)
    )
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def links(vectors, cosine, id_col, vector_col, most=MOST_DIRECTIONS):
    """The classes of equal vectors (``c``, the smallest id, and ``rows``) and the pairs (a, b) of classes that are linked."""
    known = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull())
    known = known.select(F.col(id_col).alias("c"), _plain(F.col(vector_col)).alias("v"))
    classes = materialise(known.groupBy("v").agg(F.min("c").alias("c"), F.count(F.lit(1)).alias("rows")))
    n, dims = classes.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    n_directions, together, half, least = _plan(n or 0, cosine, dims or 1, most)
    kind = classes.schema["c"].dataType
    schema = T.StructType([
        T.StructField("c", kind), T.StructField("dims", T.IntegerType()), T.StructField("cell", T.LongType()),
        T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()),
    ])
    cells = materialise(classes.select("c", "v").mapInArrow(_projected(n_directions, together), schema))
    counted = collisions(cells, half).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).drop("n")
    named = lambda side: classes.select(F.col("c").alias(side), F.col("v").alias(f"v{side}"))
    pairs = counted.join(named("a"), "a").join(named("b"), "b").select("a", "va", "b", "vb")
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])
    return classes, materialise(pairs.mapInArrow(_verified(cosine), schema))


def _plain(vector):
    """Doubles; minus zero equals zero."""
    return F.transform(vector.cast("array<double>"), lambda x: x + F.lit(0.0))


def _digest(vector):
    """Two hashes that stand for a vector."""
    return {"_one": F.xxhash64(vector), "_two": F.xxhash64(F.lit(_SEED), vector)}


def near_duplicates(vectors, cosine=0.9, id_col="vec_id", vector_col="embedding", most=MOST_DIRECTIONS):
    """One row per vector: id, n_links, component_id and kept. Other columns are neither read nor returned.

    Vectors are linked if their cosine, in double precision, is at least ``cosine``. Equal vectors
    are one class and are linked with each other without being paired. A vector that is null, empty,
    zero or has null or non-finite components is linked with nothing; so is one without id, whose
    component is null and which is kept. Vectors of different lengths are not compared. Repeated
    rows are vectors of their own. An empty table gives an empty result.
    """
    classes, found = links(vectors, cosine, id_col, vector_col, most)
    size = classes.select("c", "rows")
    both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.join(size.withColumnRenamed("c", "b"), "b").groupBy(F.col("a").alias("c")).agg(F.sum("rows").alias("others"))
    groups = components(found).withColumnRenamed("id", "c")
    told = classes.select("c", "rows", *[k.alias(n) for n, k in _digest(F.col("v")).items()])
    told = told.join(degree, "c", "left").join(groups, "c", "left").select(
        "_one", "_two",
        (F.col("rows") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "c").alias("component_id"),
        "rows",
    )
    has = usable(F.col(vector_col)) & F.col(id_col).isNotNull()
    digest = _digest(_plain(F.col(vector_col)))
    own = vectors.select(F.col(id_col).alias("_id"), *[F.when(has, k).alias(n) for n, k in digest.items()])
    out = lookup(own, told, ["_one", "_two"], ["_id"], counted="rows")
    component = F.when(F.col("_id").isNotNull(), F.coalesce("component_id", "_id"))
    return out.select(
        F.col("_id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("_id") == component, F.lit(True)).alias("kept"),
    )
