"""Profiles of a business table: completeness, places, categories, ratings, anomalies, priorities."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from mainstreet.functions import scores
from mainstreet.operators.shuffles import null_safe_lookup

c = F.col


def percent(part, whole):
    return F.round(F.try_divide(part * F.lit(100.0), whole), 2)


def _all_rows(b):
    """Row count as a scalar subquery; on Parquet files it reads footers only."""
    return b.agg(scores.n_rows()).scalar()


def share_of_all(name):
    """Percentage of the column's own total, for results of a few fixed bands: they meet in one task."""
    return percent(c(name), F.sum(name).over(Window.partitionBy()))


def data_summary(b):
    """Row and id counts and the share of usable values per required field.

    Ids are counted after grouping by id, so each is sent once per task and none meets in one place.
    """
    usable = dict(zip(["name", "category", "address", "city", "state", "zip"], scores.essentials()))
    per_id = b.groupBy("business_id").agg(
        scores.n_rows().alias("n"), *[F.count_if(rule).alias(f"{name}_ok") for name, rule in usable.items()]
    )
    total = F.sum("n")
    return per_id.agg(
        total.alias("total_records"),
        F.count("business_id").alias("unique_businesses"),
        *[percent(F.sum(f"{name}_ok"), total).alias(f"{name}_completeness_pct") for name in usable],
    )


def contact_completeness(b):
    both = c("phone").isNotNull() & c("website").isNotNull()
    return b.agg(
        scores.n_rows().alias("total_businesses"),
        *[F.count(n).alias(f"has_{n}") for n in ("phone", "website", "email")],
        *[percent(F.count(n), scores.n_rows()).alias(f"{n}_completeness_pct") for n in ("phone", "website", "email")],
        F.count_if(both).alias("has_phone_and_website"),
        F.count_if(both & c("email").isNotNull()).alias("has_all_contact_info"),
    )


def _distinct_of(name):
    """Distinct non-null values seen by a second grouping; nulls carry no set."""
    return F.count_distinct(name)


def by_state(b, k=20):
    """Largest states. Rows are first reduced to (state, city, category) counts."""
    cells = b.where(c("state").isNotNull()).groupBy("state", "city", "category").agg(scores.n_rows().alias("n"))
    grouped = cells.groupBy("state").agg(
        F.sum("n").alias("business_count"),
        _distinct_of("city").alias("unique_cities"),
        _distinct_of("category").alias("unique_categories"),
    )
    return (
        grouped.orderBy(c("business_count").desc(), "state")
        .limit(k)
        .withColumn("percentage", percent(c("business_count"), _all_rows(b)))
    )


def by_city(b, k=25):
    """Largest cities with the sorted list of their categories; lists are built for those only."""
    cells = (
        b.where(c("city").isNotNull() & c("state").isNotNull())
        .groupBy("city", "state", "category")
        .agg(scores.n_rows().alias("n"))
    )
    largest = (
        cells.groupBy("city", "state")
        .agg(F.sum("n").alias("business_count"), F.count("category").alias("unique_categories"))
        .orderBy(c("business_count").desc(), "city", "state")
        .limit(k)
    )
    # at most k rows
    lists = (
        cells.join(F.broadcast(largest.select("city", "state")), ["city", "state"])
        .groupBy("city", "state")
        .agg(F.nullif(F.array_join(F.sort_array(F.collect_set("category")), ", "), F.lit("")).alias("categories_list"))
    )
    return (
        lists.join(F.broadcast(largest), ["city", "state"])
        .withColumn("percentage", percent(c("business_count"), _all_rows(b)))
        .orderBy(c("business_count").desc(), "city", "state")
    )


def by_category(b):
    cells = (
        b.where(c("category").isNotNull())
        .groupBy("category", "city", "state")
        .agg(scores.n_rows().alias("n"), F.sum("rating").alias("rating_sum"), F.count("rating").alias("rated"))
    )
    return (
        cells.groupBy("category")
        .agg(
            F.sum("n").alias("business_count"),
            percent(F.sum("n"), _all_rows(b)).alias("percentage"),
            _distinct_of("city").alias("cities_served"),
            _distinct_of("state").alias("states_served"),
            F.try_divide(F.sum("rating_sum"), F.sum("rated")).alias("avg_rating"),
            F.sum("rated").alias("businesses_with_ratings"),
        )
        .orderBy(c("business_count").desc(), "category")
    )


def category_by_state(b, min_n=2):
    """Categories per state; shares are taken over the groups that reach ``min_n``."""
    groups = (
        b.where(c("state").isNotNull() & c("category").isNotNull())
        .groupBy("state", "category")
        .agg(scores.n_rows().alias("business_count"))
        .where(c("business_count") >= min_n)
    )
    in_state = F.sum("business_count").over(Window.partitionBy("state"))
    return groups.withColumn("pct_of_state", percent(c("business_count"), in_state)).orderBy(
        "state", c("business_count").desc(), "category"
    )


def content_readiness(b):
    contact = c("phone").isNotNull() | c("website").isNotNull() | c("email").isNotNull()
    return (
        b.groupBy(
            scores.label([(scores.all_essentials(), "READY")], "INCOMPLETE").alias("content_ready_status"),
            scores.label([(contact, "HAS_CONTACT")], "NO_CONTACT").alias("contact_status"),
            scores.label([(scores.filled("description", 20), "HAS_DESCRIPTION")], "NEEDS_DESCRIPTION").alias(
                "description_status"
            ),
        )
        .agg(scores.n_rows().alias("business_count"))
        .withColumn("percentage", share_of_all("business_count"))
        .orderBy(c("business_count").desc(), "content_ready_status", "contact_status", "description_status")
    )


def competition(b):
    n = c("business_count")
    level = scores.label(
        [(n == 1, "UNIQUE_OPPORTUNITY"), (n <= 3, "LOW_COMPETITION"), (n <= 7, "MEDIUM_COMPETITION")],
        "HIGH_COMPETITION",
    )
    return (
        b.where(c("city").isNotNull() & c("state").isNotNull() & c("category").isNotNull())
        .groupBy("city", "state", "category")
        .agg(scores.n_rows().alias("business_count"), F.avg("rating").alias("avg_rating"),
             F.count("rating").alias("rated_businesses"))
        .withColumn("competition_level", level)
        .orderBy(n.desc(), "city", "category", "state")
    )


# Rating bands, best first, with the text shown for each.
_RATING_BANDS = [
    (4.5, "EXCELLENT (4.5+)"),
    (4.0, "VERY_GOOD (4.0-4.4)"),
    (3.5, "GOOD (3.5-3.9)"),
    (3.0, "AVERAGE (3.0-3.4)"),
    (float("-inf"), "BELOW_AVERAGE (<3.0)"),
]


def rating_distribution(b):
    band = scores.steps(c("rating"), [(low, 5 - i) for i, (low, _) in enumerate(_RATING_BANDS)])
    names = scores.label([(c("band") == 5 - i, text) for i, (_, text) in enumerate(_RATING_BANDS)], "NO_RATING")
    reviews = F.avg(F.when(c("rating").isNotNull(), c("review_count")))
    return (
        b.groupBy(band.alias("band"))
        .agg(scores.n_rows().alias("business_count"), reviews.alias("avg_review_count"))
        .select(
            "band",
            names.alias("rating_category"),
            "business_count",
            share_of_all("business_count").alias("percentage"),
            "avg_review_count",
        )
        .orderBy(c("band").desc())
        .drop("band")
    )


def top_rated(b, k=5):
    """Businesses of rank ``k`` or better per category, ties kept.

    Ranks are found on the counts of equal (category, rating, reviews), of which only the best
    ``k`` per category leave a task, and at most ``k`` of them per category come back to the rows.
    """
    rated = b.where(c("rating").isNotNull() & c("category").isNotNull())
    order = [c("rating").desc(), c("review_count").desc_nulls_last()]
    values = rated.groupBy("category", "rating", "review_count").agg(scores.n_rows().alias("n"))
    in_order = Window.partitionBy("category").orderBy(*order)
    best = values.withColumn("_pos", F.row_number().over(in_order)).where(c("_pos") <= k)
    better = F.sum("n").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    ranked = (
        best.withColumn("category_rank", F.coalesce(better, F.lit(0)) + 1)
        .where(c("category_rank") <= k)
        .select("category", "rating", "review_count", "category_rank", "n")
    )
    # many rows may share one of these values, so they are looked up and not joined on their key alone
    shown = rated.select("category", "name", "city", "state", "rating", "review_count")
    found = null_safe_lookup(shown, ranked, ["category", "rating", "review_count"], ["name", "city", "state"], counted="n")
    return found.where(c("category_rank").isNotNull()).drop("n")


def anomalies(b):
    """Repeated (name, city, state), zip codes of odd length, states that are not two letters."""
    size = F.length(F.trim(c("zip_code")))
    n = scores.n_rows().alias("occurrence_count")
    repeated = (
        b.where(c("name").isNotNull()).groupBy("name", "city", "state").agg(n).where(c("occurrence_count") > 1)
    )
    zips = (
        b.where(c("zip_code").isNotNull() & ~size.isin(5, 10)).groupBy("zip_code", "city", "state").agg(n)
    )
    states = b.where(c("state").isNotNull() & (F.length(F.trim(c("state"))) != 2)).groupBy("state").agg(n)

    def shaped(df, issue, value, city, state):
        return df.select(
            F.lit(issue).alias("issue_type"), value.alias("name"), city.alias("city"), state.alias("state"),
            "occurrence_count",
        )

    blank = F.lit("")
    return (
        shaped(repeated, "DUPLICATE_NAMES", c("name"), c("city"), c("state"))
        .unionAll(shaped(zips, "SUSPICIOUS_ZIP_CODES", c("zip_code"), c("city"), c("state")))
        .unionAll(shaped(states, "INCONSISTENT_STATE_FORMAT", c("state"), blank, blank))
        .orderBy("issue_type", c("occurrence_count").desc())
    )


def scored(b):
    """Three part scores, their total and its level for every business."""
    keep = [c(n) for n in ("business_id", "name", "category", "city", "state")]
    return (
        b.select(
            *keep,
            scores.completeness_score().alias("completeness_score"),
            scores.quality_score().alias("quality_score"),
            scores.seo_potential_score().alias("seo_potential_score"),
            "rating",
            "review_count",
        )
        .withColumn("total_score", c("completeness_score") + c("quality_score") + c("seo_potential_score"))
        .withColumn("priority_level", scores.priority_level(c("total_score")))
    )


def priority_scores(b, k=100):
    return (
        scored(b).orderBy(c("total_score").desc(), c("rating").desc_nulls_last(), "business_id").limit(k)
    )


def candidates_over(scored_rows, score=70):
    return scored_rows.where(c("total_score") >= score).orderBy(c("total_score").desc(), "business_id")


def market_gaps(b, max_n=3):
    """Markets with at most ``max_n`` businesses."""
    return b.groupBy("city", "category").agg(scores.n_rows().alias("competition")).where(c("competition") <= max_n)
