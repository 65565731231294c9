"""Profiles and exploratory figures."""


from pyspark.sql import functions as F

from catalog import fixtures
from catalog.registry import over, query
from mainstreet.operators import explore, profiling

c = F.col


def _listings(spark, sf, description=False):
    return fixtures.businesses(spark, sf, description)


def _six(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def _filled(name, above=0):
    return f"({name} IS NOT NULL AND length(trim({name})) > {above})"


ESSENTIALS = [("name", 0), ("category", 0), ("address", 5), ("city", 0), ("state", 1), ("zip_code", 4)]
READY = " AND ".join(_filled(n, a) for n, a in ESSENTIALS)


@query(
    "data_summary",
    over(
        "SELECT count(*) AS total_records, count(DISTINCT business_id) AS unique_businesses, "
        + ", ".join(
            f"round(100.0 * count(*) FILTER ({_filled(n, a)}) / count(*), 2) AS {n.replace('_code', '')}_completeness_pct"
            for n, a in ESSENTIALS
        )
        + " FROM business_core",
        "business_core",
    ),
)
def data_summary(spark, sf):
    return profiling.data_summary(_listings(spark, sf))


@query(
    "contact_completeness",
    over(
        "SELECT count(*) AS total_businesses, count(phone) AS has_phone, count(website) AS has_website, count(email) AS has_email,"
        " round(100.0 * count(phone) / count(*), 2) AS phone_completeness_pct,"
        " round(100.0 * count(website) / count(*), 2) AS website_completeness_pct,"
        " round(100.0 * count(email) / count(*), 2) AS email_completeness_pct,"
        " count(*) FILTER (phone IS NOT NULL AND website IS NOT NULL) AS has_phone_and_website,"
        " count(*) FILTER (phone IS NOT NULL AND website IS NOT NULL AND email IS NOT NULL) AS has_all_contact_info FROM business_core",
        "business_core",
    ),
)
def contact_completeness(spark, sf):
    return profiling.contact_completeness(_listings(spark, sf))


_SHARE = "round(100.0 * count(*) / (SELECT count(*) FROM business_core), 2) AS percentage"


@query(
    "by_state",
    over(
        f"SELECT state, count(*) AS business_count, {_SHARE}, count(DISTINCT city) AS unique_cities,"
        " count(DISTINCT category) AS unique_categories FROM business_core WHERE state IS NOT NULL GROUP BY state"
        " ORDER BY business_count DESC, state LIMIT 20",
        "business_core",
    ),
)
def by_state(spark, sf):
    return profiling.by_state(_listings(spark, sf))


@query(
    "by_city",
    over(
        f"SELECT city, state, count(*) AS business_count, {_SHARE}, count(DISTINCT category) AS unique_categories,"
        " string_agg(DISTINCT category, ', ' ORDER BY category) AS categories_list FROM business_core"
        " WHERE city IS NOT NULL AND state IS NOT NULL GROUP BY city, state ORDER BY business_count DESC, city, state LIMIT 25",
        "business_core",
    ),
)
def by_city(spark, sf):
    return profiling.by_city(_listings(spark, sf))


@query(
    "by_category",
    over(
        f"SELECT category, count(*) AS business_count, {_SHARE}, count(DISTINCT city) AS cities_served,"
        " count(DISTINCT state) AS states_served, round(avg(rating), 6) AS avg_rating, count(rating) AS businesses_with_ratings"
        " FROM business_core WHERE category IS NOT NULL GROUP BY category",
        "business_core",
    ),
)
def by_category(spark, sf):
    return _six(profiling.by_category(_listings(spark, sf)), "avg_rating")


@query(
    "category_by_state",
    over(
        "SELECT state, category, count(*) AS business_count,"
        " round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY state), 2) AS pct_of_state"
        " FROM business_core WHERE state IS NOT NULL AND category IS NOT NULL GROUP BY state, category HAVING count(*) >= 2",
        "business_core",
    ),
)
def category_by_state(spark, sf):
    return profiling.category_by_state(_listings(spark, sf))


@query(
    "content_readiness",
    over(
        f"SELECT CASE WHEN {READY} THEN 'READY' ELSE 'INCOMPLETE' END AS content_ready_status,"
        " CASE WHEN phone IS NOT NULL OR website IS NOT NULL OR email IS NOT NULL THEN 'HAS_CONTACT' ELSE 'NO_CONTACT' END AS contact_status,"
        f" CASE WHEN {_filled('description', 20)} THEN 'HAS_DESCRIPTION' ELSE 'NEEDS_DESCRIPTION' END AS description_status,"
        " count(*) AS business_count, round(100.0 * count(*) / (SELECT count(*) FROM businesses), 2) AS percentage"
        " FROM businesses GROUP BY 1, 2, 3",
        "businesses",
    ),
)
def content_readiness(spark, sf):
    return profiling.content_readiness(_listings(spark, sf, True))


@query(
    "competition",
    over(
        "SELECT city, state, category, count(*) AS business_count, CASE WHEN count(*) = 1 THEN 'UNIQUE_OPPORTUNITY'"
        " WHEN count(*) <= 3 THEN 'LOW_COMPETITION' WHEN count(*) <= 7 THEN 'MEDIUM_COMPETITION' ELSE 'HIGH_COMPETITION' END AS competition_level,"
        " round(avg(rating), 6) AS avg_rating, count(rating) AS rated_businesses FROM business_core"
        " WHERE city IS NOT NULL AND state IS NOT NULL AND category IS NOT NULL GROUP BY city, state, category",
        "business_core",
    ),
)
def competition(spark, sf):
    return _six(profiling.competition(_listings(spark, sf)), "avg_rating")


@query(
    "rating_distribution",
    over(
        "SELECT CASE WHEN rating IS NULL THEN 'NO_RATING' WHEN rating >= 4.5 THEN 'EXCELLENT (4.5+)'"
        " WHEN rating >= 4.0 THEN 'VERY_GOOD (4.0-4.4)' WHEN rating >= 3.5 THEN 'GOOD (3.5-3.9)'"
        " WHEN rating >= 3.0 THEN 'AVERAGE (3.0-3.4)' ELSE 'BELOW_AVERAGE (<3.0)' END AS rating_category,"
        f" count(*) AS business_count, {_SHARE},"
        " round(avg(CASE WHEN rating IS NOT NULL THEN review_count END), 6) AS avg_review_count FROM business_core GROUP BY 1",
        "business_core",
    ),
)
def rating_distribution(spark, sf):
    return _six(profiling.rating_distribution(_listings(spark, sf)), "avg_review_count")


@query(
    "top_rated",
    over(
        "SELECT category, name, city, state, rating, review_count, category_rank FROM (SELECT *, rank() OVER (PARTITION BY category"
        " ORDER BY rating DESC, review_count DESC NULLS LAST) AS category_rank FROM business_core"
        " WHERE rating IS NOT NULL AND category IS NOT NULL) t WHERE category_rank <= 5",
        "business_core",
    ),
)
def top_rated(spark, sf):
    return profiling.top_rated(_listings(spark, sf))


@query(
    "anomalies",
    over(
        "SELECT 'DUPLICATE_NAMES' AS issue_type, name, city, state, count(*) AS occurrence_count FROM business_core"
        " WHERE name IS NOT NULL GROUP BY name, city, state HAVING count(*) > 1"
        " UNION ALL SELECT 'SUSPICIOUS_ZIP_CODES', zip_code, city, state, count(*) FROM business_core WHERE zip_code IS NOT NULL"
        " AND length(trim(zip_code)) <> 5 AND length(trim(zip_code)) <> 10 GROUP BY zip_code, city, state"
        " UNION ALL SELECT 'INCONSISTENT_STATE_FORMAT', state, '', '', count(*) FROM business_core WHERE state IS NOT NULL"
        " AND length(trim(state)) <> 2 GROUP BY state",
        "business_core",
    ),
)
def anomalies(spark, sf):
    return profiling.anomalies(_listings(spark, sf))


SCORED = (
    "SELECT business_id, name, category, city, state, "
    + " + ".join(f"CASE WHEN {_filled(n, a)} THEN 5 ELSE 0 END" for n, a in ESSENTIALS)
    + " + CASE WHEN phone IS NOT NULL THEN 5 ELSE 0 END + CASE WHEN website IS NOT NULL OR email IS NOT NULL THEN 5 ELSE 0 END AS completeness_score,"
    " CASE WHEN rating >= 4.0 THEN 15 WHEN rating >= 3.5 THEN 10 WHEN rating IS NOT NULL THEN 5 ELSE 0 END"
    " + CASE WHEN review_count >= 50 THEN 10 WHEN review_count >= 10 THEN 5 ELSE 0 END"
    f" + CASE WHEN {_filled('description', 50)} THEN 5 ELSE 0 END AS quality_score,"
    " CASE WHEN website IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN email IS NOT NULL THEN 5 ELSE 0 END + 15 AS seo_potential_score,"
    " rating, review_count FROM businesses"
)
TOTALLED = (
    "SELECT *, CASE WHEN total_score >= 80 THEN 'HIGH_PRIORITY' WHEN total_score >= 60 THEN 'MEDIUM_PRIORITY'"
    " WHEN total_score >= 40 THEN 'LOW_PRIORITY' ELSE 'REVIEW_NEEDED' END AS priority_level FROM"
    " (SELECT *, completeness_score + quality_score + seo_potential_score AS total_score FROM scored) t"
)


@query(
    "priority_scores",
    over(
        "SELECT * FROM totalled ORDER BY total_score DESC, rating DESC NULLS LAST, business_id LIMIT 100",
        "businesses", scored=SCORED, totalled=TOTALLED,
    ),
)
def priority_scores(spark, sf):
    return profiling.priority_scores(_listings(spark, sf, True))


@query(
    "candidates_over",
    over("SELECT * FROM totalled WHERE total_score >= 70", "businesses", scored=SCORED, totalled=TOTALLED),
)
def candidates_over(spark, sf):
    return profiling.candidates_over(profiling.scored(_listings(spark, sf, True)), 70)


@query(
    "market_gaps",
    over(
        "SELECT city, category, count(*) AS competition FROM business_core GROUP BY city, category HAVING count(*) <= 3",
        "business_core",
    ),
)
def market_gaps(spark, sf):
    return profiling.market_gaps(_listings(spark, sf), 3)


_COLUMNS = (
    "business_id name category address city state zip_code phone website email description rating review_count".split()
)
_COMPLETENESS = " UNION ALL ".join(
    f"SELECT '{n}' AS field, round(100.0 * count({n}) / count(*), 2) AS completeness_pct, count(*) - count({n}) AS missing_count FROM businesses"
    for n in _COLUMNS
)


@query("column_completeness", over(_COMPLETENESS, "businesses"))
def column_completeness(spark, sf):
    return explore.column_completeness(_listings(spark, sf, True).select(*_COLUMNS))


@query(
    "completeness_bands",
    over(
        "SELECT field, completeness_pct, missing_count, CASE WHEN completeness_pct >= 90 THEN 'high'"
        f" WHEN completeness_pct >= 70 THEN 'medium' ELSE 'low' END AS band FROM ({_COMPLETENESS}) t",
        "businesses",
    ),
)
def completeness_bands(spark, sf):
    return explore.band_completeness(explore.column_completeness(_listings(spark, sf, True).select(*_COLUMNS)))


_NAMED = "name IS NOT NULL AND category IS NOT NULL AND city IS NOT NULL AND state IS NOT NULL"


@query(
    "content_ready",
    over(
        f"SELECT count(*) FILTER ({_NAMED}) AS ready, count(*) AS total,"
        f" round(100.0 * count(*) FILTER ({_NAMED}) / count(*), 1) AS ready_pct FROM business_core",
        "business_core",
    ),
)
def content_ready(spark, sf):
    return explore.content_ready(_listings(spark, sf))


@query(
    "value_counts",
    over(
        "SELECT 'category' AS field, category AS value, count(*) AS n FROM business_core WHERE category IS NOT NULL GROUP BY category"
        " UNION ALL SELECT * FROM (SELECT 'city', city, count(*) AS n FROM business_core WHERE city IS NOT NULL GROUP BY city"
        " ORDER BY n DESC, city LIMIT 10) t",
        "business_core",
    ),
)
def value_counts(spark, sf):
    b = _listings(spark, sf)
    categories = explore.value_counts(b, "category").select(F.lit("category").alias("field"), "value", "n")
    return categories.unionAll(explore.value_counts(b, "city", 10).select(F.lit("city").alias("field"), "value", "n"))


EDA = (
    f"SELECT *, CAST(least(CASE WHEN {_NAMED} THEN 20 ELSE 0 END"
    + "".join(f" + CASE WHEN {n} IS NOT NULL THEN 4 ELSE 0 END" for n in ("address", "zip_code", "phone", "website", "email"))
    + " + CASE WHEN rating >= 4.5 THEN 15 WHEN rating >= 4.0 THEN 10 WHEN rating >= 3.5 THEN 5 ELSE 0 END"
    " + CASE WHEN review_count >= 100 THEN 15 WHEN review_count >= 50 THEN 10 WHEN review_count >= 20 THEN 5 ELSE 0 END"
    " + CASE WHEN website IS NOT NULL THEN 15 ELSE 0 END + CASE WHEN length(description) > 50 THEN 15 ELSE 0 END, 100) AS DOUBLE)"
    " AS priority_score FROM businesses"
)


def _histogram_sql(field, bins):
    return (
        f"SELECT '{field}' AS field, bin, round(lo + bin * (hi - lo) / {bins}.0, 6) AS bin_start, count(*) AS n FROM"
        f" (SELECT lo, hi, CAST(least(floor((x - lo) * {bins}.0 / (hi - lo)), {bins - 1}) AS INTEGER) AS bin FROM"
        f" (SELECT CAST({field} AS DOUBLE) AS x, min(CAST({field} AS DOUBLE)) OVER () AS lo, max(CAST({field} AS DOUBLE)) OVER () AS hi"
        f" FROM eda WHERE {field} IS NOT NULL) v) w GROUP BY bin, lo, hi"
    )


_HISTOGRAMS = [("rating", 20), ("review_count", 15), ("priority_score", 20)]


@query("histogram", over(" UNION ALL ".join(_histogram_sql(f, n) for f, n in _HISTOGRAMS), "businesses", eda=EDA))
def histogram(spark, sf):
    counted = explore.histograms(explore.eda_priority(_listings(spark, sf, True)), dict(_HISTOGRAMS))
    return counted.withColumn("bin_start", F.round("bin_start", 6))


@query(
    "summary_stats",
    over(
        "SELECT count(DISTINCT category) AS unique_categories, count(DISTINCT city) AS unique_cities,"
        " round(avg(rating), 6) AS mean_rating, min(rating) AS min_rating, max(rating) AS max_rating,"
        " round(avg(review_count), 6) AS mean_review_count, min(review_count) AS min_review_count, max(review_count) AS max_review_count"
        " FROM business_core",
        "business_core",
    ),
)
def summary_stats(spark, sf):
    return _six(explore.summary_stats(_listings(spark, sf)), "mean_rating", "mean_review_count")


@query("eda_priority", over("SELECT business_id, priority_score FROM eda", "businesses", eda=EDA))
def eda_priority(spark, sf):
    return explore.eda_priority(_listings(spark, sf, True)).select("business_id", "priority_score")


@query(
    "priority_bins",
    over(
        "SELECT CASE WHEN priority_score <= 40 THEN 'Low' WHEN priority_score <= 70 THEN 'Medium' WHEN priority_score <= 85 THEN 'High'"
        " ELSE 'Premium' END AS priority_category, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM eda), 1) AS pct"
        " FROM eda WHERE priority_score > 0 GROUP BY 1",
        "businesses", eda=EDA,
    ),
)
def priority_bins(spark, sf):
    return explore.priority_bins(_listings(spark, sf, True))


@query(
    "top_candidates",
    over(
        "SELECT business_id, name, category, city, priority_score FROM eda ORDER BY priority_score DESC, business_id LIMIT 10",
        "businesses", eda=EDA,
    ),
)
def top_candidates(spark, sf):
    return explore.top_candidates(_listings(spark, sf, True))


COMBOS = (
    "SELECT city, category, count(*) AS n, category || ' in ' || city AS keyword FROM business_core"
    " WHERE city IS NOT NULL AND category IS NOT NULL GROUP BY city, category"
)


@query("keyword_combos", over("SELECT * FROM combos", "business_core", combos=COMBOS))
def keyword_combos(spark, sf):
    return explore.keyword_combos(_listings(spark, sf))


@query(
    "unique_markets",
    over(
        "SELECT keyword, n, (SELECT count(*) FROM combos WHERE n = 1) AS markets FROM combos WHERE n = 1 ORDER BY city, category LIMIT 5",
        "business_core", combos=COMBOS,
    ),
)
def unique_markets(spark, sf):
    return explore.unique_markets(_listings(spark, sf))


@query(
    "competitive_markets",
    over(
        "SELECT keyword, n, (SELECT count(*) FROM combos WHERE n >= 3) AS markets FROM combos WHERE n >= 3"
        " ORDER BY n DESC, city, category LIMIT 3",
        "business_core", combos=COMBOS,
    ),
)
def competitive_markets(spark, sf):
    return explore.competitive_markets(_listings(spark, sf))


@query(
    "complexity_estimate",
    over(
        "SELECT count(*) FILTER (length(description) > 100) AS simple, count(*) - count(*) FILTER (length(description) > 100) AS moderate,"
        " count(*) * 1000 AS estimated_words FROM businesses",
        "businesses",
    ),
)
def complexity_estimate(spark, sf):
    return explore.complexity_estimate(_listings(spark, sf, True))


@query(
    "recommended_batch",
    over(
        "SELECT least(count(*) FILTER (priority_score >= 70), 25) AS recommended_batch, round(avg(priority_score), 6) AS mean_score FROM eda",
        "businesses", eda=EDA,
    ),
)
def recommended_batch(spark, sf):
    return _six(explore.recommended_batch(_listings(spark, sf, True)), "mean_score")
