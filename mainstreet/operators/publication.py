"""The publication list: candidates, scores, market context, related businesses, ranks and batches."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from mainstreet.functions import scores, text
from mainstreet.operators.shuffles import global_rank, lookup
from mainstreet.plans.workspace import materialise
from mainstreet.schemas import BUSINESS_COLUMNS

c = F.col
_MARKET = ["city", "state"]


def _by_score(*more):
    return [c("priority_score").desc(), c("rating").desc_nulls_last(), *more, c("business_id").asc_nulls_last()]


def candidates(b):
    named = b.where(
        c("name").isNotNull() & c("category").isNotNull() & c("city").isNotNull() & c("state").isNotNull()
    )
    return named.select(*[n for n in BUSINESS_COLUMNS if n in b.columns])


def _entry():
    """``name|category|id``; null when one of the parts is null."""
    return F.concat(c("name"), F.lit("|"), c("category"), F.lit("|"), c("business_id"))


def market_cells(b):
    """Businesses per city, state and category, with those of the whole city and its listed ones."""
    cells = (
        b.where(c("city").isNotNull() & c("state").isNotNull())
        .groupBy(*_MARKET, "category")
        .agg(scores.n_rows().alias("n"), F.count(_entry()).alias("listed"))
    )
    # the rows of a city are its categories here
    city = Window.partitionBy(*_MARKET)
    return cells.withColumns(
        {"city_business_count": F.sum("n").over(city), "listed": F.sum("listed").over(city)}
    )


def with_market(df, b):
    """Add ``local_competition``, ``city_business_count`` and ``related_count``, by one lookup.

    ``related_count`` says how many others of the city and state have an entry in
    :func:`market_members`; these are the business's related businesses.
    """
    cells = market_cells(b).where(c("category").isNotNull())
    found = lookup(df, cells, [*_MARKET, "category"], ["business_id"], counted="n")
    own = F.when(_entry().isNotNull(), 1).otherwise(0)
    return found.withColumns(
        {
            "local_competition": F.coalesce("n", F.lit(0)),
            "city_business_count": F.coalesce("city_business_count", F.lit(0)),
            "related_count": F.when(c("business_id").isNull(), 0).otherwise(F.coalesce(c("listed") - own, F.lit(0))),
        }
    ).drop("n", "listed")


def local_competition(df, b):
    """Businesses of the same city, state and category, the row itself included."""
    return with_market(df, b).drop("city_business_count", "related_count")


def city_business_count(df, b):
    """Businesses of the same city and state, for rows with a category."""
    return with_market(df, b).drop("local_competition", "related_count")


def related_businesses(df, b):
    """How many related businesses each row has; the market of its city and state lists them."""
    return with_market(df, b).drop("local_competition", "city_business_count")


def market_members(b):
    """The entries of every market, one row each: city, state, business_id and ``name|category|id``.

    A business is related to every entry of its city and state but its own. One row per member, so
    a market of any size is a plain set of rows; repeating the list in each business would make as
    many entries as there are pairs.
    """
    return b.select(*_MARKET, "business_id", _entry().alias("entry")).dropna().distinct()


def publication_rank(df, name="publication_rank"):
    return global_rank(df, _by_score(c("review_count").desc_nulls_last()), name)


# Last rank of each batch.
_BATCHES = [(25, "BATCH_1_HIGH_PRIORITY"), (75, "BATCH_2_MEDIUM_PRIORITY"), (150, "BATCH_3_STANDARD")]
_LAST_BATCH = "BATCH_4_FUTURE"


def processing_batch(df, key=None):
    """Batch by score and rating. Only the first 150 rows need a rank; all others are in the last batch.

    ``key`` names a column that tells all rows apart. Without one the rows are stored to give each a
    place, because ids may be null or stand in several rows.
    """
    if key is None:
        return processing_batch(materialise(df.withColumn("_at", F.monotonically_increasing_id())), "_at").drop("_at")
    order = _by_score() + [c("review_count").desc_nulls_last(), c(key)]
    first = df.select(key, "business_id", "priority_score", "rating", "review_count").orderBy(*order).limit(_BATCHES[-1][0])
    place = F.row_number().over(Window.orderBy(*order))  # of 150 rows
    batch = scores.label([(c("place") <= last, name) for last, name in _BATCHES], _LAST_BATCH)
    named = first.withColumn("place", place).select(key, batch.alias("processing_batch"))
    # 150 rows
    found = df.join(F.broadcast(named), key, "left")
    return found.withColumn("processing_batch", F.coalesce("processing_batch", F.lit(_LAST_BATCH)))


def suggestions():
    return {
        "suggested_title": scores.suggested_title(),
        "suggested_meta_description": scores.suggested_meta(),
        "suggested_h1": scores.suggested_h1(),
        "target_word_count": scores.target_word_count(),
        "suggested_keywords": scores.suggested_keywords(),
    }


def with_scores(df):
    return df.withColumns(
        {
            "suggested_slug": text.compact_slug(c("name"), c("category"), c("city")),
            "priority_score": scores.publication_score(),
            "content_category": scores.content_category(c("category")),
            "generation_complexity": scores.complexity(),
            "data_completeness": scores.completeness_flag(),
        }
    )


def publish_list(b, min_score=30.0, market=None):
    """Complete candidates that reach ``min_score``, with context, suggestions, rank and batch, in order of rank.

    The score filter comes before all joins, so market context is looked up for listed rows only.
    Ranks are found on the sort keys and a hash of the row, so rows with the same id, or without
    one, have ranks of their own. ``market`` is the table over which market
    context is taken, ``b`` itself unless given; it needs id, name, category, city and state.
    """
    market = b if market is None else market
    listed = with_scores(candidates(b)).where(
        (c("data_completeness") == "COMPLETE") & (c("priority_score") >= min_score)
    )
    # ids may be null or repeated, so a row is told from others by a hash of all it holds
    names = listed.columns
    listed = listed.withColumns({"_row": F.xxhash64(*names), "_row2": F.xxhash64(F.lit(2), *names)})
    slim = listed.select("_row", "_row2", "business_id", "priority_score", "rating", "review_count")
    order = [*_by_score(c("review_count").desc_nulls_last()), c("_row"), c("_row2")]
    ranked = processing_batch(global_rank(slim, order, "publication_rank"), "publication_rank")
    ranked = ranked.select("_row", "_row2", "publication_rank", "processing_batch")
    # rows that are alike in everything are one here; each of them has its rank
    distinct = listed.dropDuplicates(["_row", "_row2"])
    return (
        with_market(ranked.join(distinct, ["_row", "_row2"]), market)
        .select(*names, "local_competition", "city_business_count", "related_count", "publication_rank", "processing_batch")
        .withColumns(
            {**suggestions(), "priority_score": F.round("priority_score", 2), "query_generated_at": F.current_timestamp()}
        )
        .orderBy("publication_rank")
    )


def _scored_candidates(b):
    return candidates(b).select(
        "city", "state", "category", "rating", "website", scores.publication_score().alias("priority_score")
    )


def publication_stats(b):
    """One row of totals. Rows are first reduced to (location, category) cells, which carry the counts."""
    score = c("priority_score")
    cells = (
        _scored_candidates(b)
        .groupBy(F.concat(c("city"), F.lit(","), c("state")).alias("location"), "category")
        .agg(
            scores.n_rows().alias("n"),
            F.count_if(score >= 70).alias("high"),
            F.count_if((score >= 50) & (score < 70)).alias("medium"),
            F.count_if(score < 50).alias("low"),
            F.sum("priority_score").alias("score_sum"),
            F.count("rating").alias("rated"),
            F.count("website").alias("sites"),
        )
    )
    return cells.agg(
        F.lit("PUBLICATION_STATS").alias("metric_type"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_candidates"),
        F.coalesce(F.sum("high"), F.lit(0)).alias("high_priority_count"),
        F.coalesce(F.sum("medium"), F.lit(0)).alias("medium_priority_count"),
        F.coalesce(F.sum("low"), F.lit(0)).alias("low_priority_count"),
        F.count_distinct("location").alias("unique_locations"),
        F.count_distinct("category").alias("unique_categories"),
        F.try_divide(F.sum("score_sum"), F.sum("n")).alias("avg_priority_score"),
        F.coalesce(F.sum("rated"), F.lit(0)).alias("businesses_with_ratings"),
        F.coalesce(F.sum("sites"), F.lit(0)).alias("businesses_with_websites"),
    )


def category_plan(b):
    cells = (
        _scored_candidates(b)
        .groupBy(
            scores.content_category(c("category")).alias("content_category"),
            F.concat(c("city"), F.lit(","), c("state")).alias("location"),
        )
        .agg(
            scores.n_rows().alias("n"),
            F.sum("priority_score").alias("score_sum"),
            F.count_if(c("priority_score") >= 70).alias("high"),
        )
    )
    return (
        cells.groupBy("content_category")
        .agg(
            F.sum("n").alias("business_count"),
            F.try_divide(F.sum("score_sum"), F.sum("n")).alias("avg_priority"),
            F.sum("high").alias("high_priority_count"),
            F.count("location").alias("unique_locations"),
        )
        .orderBy(c("business_count").desc(), "content_category")
    )
