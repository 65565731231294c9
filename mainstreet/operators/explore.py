"""Exploratory figures over a business table; each is one pass or a small grouping."""

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from mainstreet.functions import scores

c = F.col


def column_completeness(df):
    """Share of non-null values and number of missing ones, one row per column."""
    counts = [F.struct(F.lit(n).alias("field"), F.count(n).alias("present")) for n in df.columns]
    return (
        df.agg(scores.n_rows().alias("n"), F.array(*counts).alias("fields"))
        .select("n", F.inline("fields"))
        .select(
            "field",
            F.round(F.try_divide(c("present") * F.lit(100.0), c("n")), 2).alias("completeness_pct"),
            (c("n") - c("present")).alias("missing_count"),
        )
    )


def band_completeness(df):
    pct = c("completeness_pct")
    return df.withColumn("band", scores.label([(pct >= 90, "high"), (pct >= 70, "medium")], "low"))


def content_ready(df):
    names = ["business_id", "name", "category", "city", "state"]
    ready = F.count_if(reduce(lambda a, b: a & b, [c(n).isNotNull() for n in names]))
    return df.agg(
        ready.alias("ready"), scores.n_rows().alias("total"),
        F.round(F.try_divide(ready * F.lit(100.0), scores.n_rows()), 1).alias("ready_pct"),
    )


def value_counts(df, col, k=None):
    counts = (
        df.where(c(col).isNotNull()).groupBy(c(col).alias("value")).agg(scores.n_rows().alias("n")).orderBy(c("n").desc(), "value")
    )
    return counts if k is None else counts.limit(k)


def histograms(df, bins):
    """Counts in equal parts of each field's range; the last part includes the maximum.

    ``bins`` maps field to number of parts. One pass finds all ranges, one counts all parts.
    """
    limits = df.agg(
        F.struct(
            *[f(c(n).cast("double")).alias(f"{f.__name__}_{n}") for n in bins for f in (F.min, F.max)]
        ).alias("limits")
    ).scalar()
    fields = [
        F.struct(
            F.lit(n).alias("field"), c(n).cast("double").alias("x"), F.lit(parts).alias("parts"),
            c("limits")[f"min_{n}"].alias("lo"), c("limits")[f"max_{n}"].alias("hi"),
        )
        for n, parts in bins.items()
    ]
    values = df.select(*bins).withColumn("limits", limits).select(F.inline(F.array(*fields))).where(c("x").isNotNull())
    part = F.coalesce(F.try_divide((c("x") - c("lo")) * c("parts").cast("double"), c("hi") - c("lo")), F.lit(0.0))
    return (
        values.groupBy("field", F.least(F.floor(part), c("parts") - 1).cast("int").alias("bin"), "lo", "hi", "parts")
        .agg(scores.n_rows().alias("n"))
        .select("field", "bin", (c("lo") + c("bin") * (c("hi") - c("lo")) / c("parts").cast("double")).alias("bin_start"), "n")
    )


def histogram(df, col, bins):
    """:func:`histograms` of one field."""
    return histograms(df, {col: bins}).drop("field")


def summary_stats(df):
    """Distinct categories and cities, range and mean of ratings and reviews, from (category, city) cells."""
    cells = df.groupBy("category", "city").agg(
        *[f(n).alias(f"{f.__name__}_{n}") for n in ("rating", "review_count") for f in (F.sum, F.count, F.min, F.max)]
    )
    out = [F.count_distinct("category").alias("unique_categories"), F.count_distinct("city").alias("unique_cities")]
    for n in ("rating", "review_count"):
        out += [
            F.try_divide(F.sum(f"sum_{n}").cast("double"), F.sum(f"count_{n}")).alias(f"mean_{n}"),
            F.min(f"min_{n}").alias(f"min_{n}"),
            F.max(f"max_{n}").alias(f"max_{n}"),
        ]
    return cells.agg(*out)


def eda_priority(df):
    return df.withColumn("priority_score", scores.eda_score())


def priority_bins(df):
    """Rows per score band and their share of all rows; scores outside the bands are not listed."""
    band = scores.eda_band(scores.eda_score())
    # at most five bands meet in one task; the share is taken before scores outside the bands go
    counts = df.groupBy(band.alias("priority_category")).agg(scores.n_rows().alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return (
        counts.withColumn("pct", F.round(F.try_divide(c("n") * F.lit(100.0), total), 1))
        .where(c("priority_category").isNotNull())
        .orderBy(c("n").desc(), "priority_category")
    )


def top_candidates(df, k=10, row_key="business_id"):
    """Largest scores; equal ones in input order, which ``row_key`` gives."""
    return (
        eda_priority(df)
        .orderBy(c("priority_score").desc(), c(row_key))
        .limit(k)
        .select(row_key, "name", "category", "city", "priority_score")
    )


def keyword_combos(df):
    return (
        df.where(c("city").isNotNull() & c("category").isNotNull())
        .groupBy("city", "category")
        .agg(scores.n_rows().alias("n"))
        .withColumn("keyword", F.concat(c("category"), F.lit(" in "), c("city")))
    )


def unique_markets(df, k=5):
    """Number of markets with one business and the first ``k`` of them."""
    single = keyword_combos(df).where(c("n") == 1)
    return _examples(single, [c("city"), c("category")], k)


def competitive_markets(df, k=3):
    """Number of markets with three or more businesses and the ``k`` largest of them."""
    return _examples(keyword_combos(df).where(c("n") >= 3), [c("n").desc(), c("city"), c("category")], k)


def _examples(markets, order, k):
    return markets.orderBy(*order).limit(k).select(
        "keyword", "n", markets.agg(scores.n_rows()).scalar().alias("markets")
    )


def complexity_estimate(df):
    simple = F.count_if(F.length("description") > 100)
    return df.agg(
        simple.alias("simple"), (scores.n_rows() - simple).alias("moderate"), (scores.n_rows() * 1000).alias("estimated_words")
    )


def recommended_batch(df):
    score = scores.eda_score()
    return df.agg(
        F.least(F.count_if(score >= 70), F.lit(25)).alias("recommended_batch"), F.avg(score).alias("mean_score")
    )
