"""Publication list, related links and prompts."""

from pyspark.sql import functions as F

from catalog import fixtures
from catalog.profile_queries import ESSENTIALS, _filled
from catalog.registry import over, query
from mainstreet.functions import fixed, scores, text
from mainstreet.operators import linking, publication

c = F.col


def _listings(spark, sf, description=True):
    return fixtures.businesses(spark, sf, description)


_PRESENT = "name IS NOT NULL AND category IS NOT NULL AND city IS NOT NULL AND state IS NOT NULL"
SCORE = (
    "round((" + " + ".join(f"CASE WHEN {_filled(n, a)} THEN 5 ELSE 0 END" for n, a in ESSENTIALS) + ")::DOUBLE * 0.4::DOUBLE"
    " + (CASE WHEN phone IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN website IS NOT NULL THEN 10 ELSE 0 END"
    " + CASE WHEN email IS NOT NULL THEN 5 ELSE 0 END)::DOUBLE * 0.2::DOUBLE"
    " + (CASE WHEN rating >= 4.0 THEN 15 WHEN rating >= 3.5 THEN 10 WHEN rating IS NOT NULL THEN 5 ELSE 0 END"
    " + CASE WHEN review_count >= 20 THEN 10 WHEN review_count >= 5 THEN 5 ELSE 0 END)::DOUBLE * 0.25::DOUBLE"
    f" + (CASE WHEN {_filled('description', 30)} THEN 10 ELSE 0 END + CASE WHEN website IS NOT NULL THEN 10 ELSE 0 END)::DOUBLE * 0.15::DOUBLE, 6)"
)
SLUG = (
    r"lower(regexp_replace(regexp_replace(name || '-' || category || '-' || city, '[^a-zA-Z0-9\s]', '', 'g'), '\s+', '-', 'g'))"
)


def _ladder(groups, default, column="category"):
    cases = " ".join(
        "WHEN " + " OR ".join(f"{column} ILIKE '%{t}%'" for t in terms) + f" THEN '{key}'" for key, terms in groups
    )
    return f"CASE {cases} ELSE '{default}' END"


CONTENT_CATEGORY = _ladder(fixed.CONTENT_CATEGORIES, fixed.DEFAULT_CONTENT_CATEGORY)
COMPLEXITY = (
    f"CASE WHEN {_filled('description', 100)} THEN 'LOW' WHEN rating IS NOT NULL AND review_count > 10 THEN 'MEDIUM' ELSE 'HIGH' END"
)
COMPLETENESS = (
    "CASE WHEN " + " AND ".join(f"{n} IS NOT NULL" for n in ("name", "category", "address", "city", "state", "zip_code"))
    + " THEN 'COMPLETE' ELSE 'PARTIAL' END"
)
LOCAL = "(SELECT count(*) FROM businesses x WHERE x.city = b.city AND x.state = b.state AND x.category = b.category)"
CITY = "(SELECT count(*) FROM businesses x WHERE x.city = b.city AND x.state = b.state)"
CANDIDATES = (
    f"SELECT b.*, {SLUG} AS suggested_slug, {SCORE} AS priority_score, {CONTENT_CATEGORY} AS content_category,"
    f" {COMPLEXITY} AS generation_complexity, {COMPLETENESS} AS data_completeness FROM businesses b WHERE {_PRESENT}"
)
RELATED = (
    "(SELECT count(DISTINCT r.name || '|' || r.category || '|' || r.business_id) FROM businesses r"
    " WHERE r.city = b.city AND r.state = b.state AND r.category IS NOT NULL AND r.business_id <> b.business_id)"
)
TITLE = (
    "CASE WHEN length(name || ' - ' || category || ' in ' || city || ', ' || state) <= 70"
    " THEN name || ' - ' || category || ' in ' || city || ', ' || state ELSE name || ' - ' || category || ' in ' || city END"
)
META = (
    "CASE WHEN description IS NOT NULL AND length(trim(description)) > 0 THEN CASE WHEN length(trim(description)) <= 160 THEN trim(description)"
    " ELSE left(trim(description), 157) || '...' END ELSE left('Professional ' || lower(category) || ' services in ' || city || ', ' || state"
    " || '. Contact us today for quality service and exceptional customer experience.', 160) END"
)
H1 = (
    "CASE WHEN length(name || ' - ' || category) <= 70 THEN name || ' - ' || category WHEN length(name) <= 70 THEN name"
    " ELSE left(name, 67) || '...' END"
)
WORDS = (
    f"CASE WHEN {_filled('description', 200)} THEN 800 WHEN rating IS NOT NULL AND review_count > 20 THEN 900 ELSE 1000 END"
)
KEYWORDS = (
    "lower(category) || ', ' || lower(city) || ' ' || lower(category) || ', ' || lower(category) || ' in ' || lower(city)"
    " || ', local ' || lower(category)"
)
RANK = "row_number() OVER (ORDER BY priority_score DESC, rating DESC NULLS LAST, review_count DESC NULLS LAST, business_id)"
_PLACE = "row_number() OVER (ORDER BY priority_score DESC, rating DESC NULLS LAST, business_id)"
BATCH = (
    f"CASE WHEN {_PLACE} <= 25 THEN 'BATCH_1_HIGH_PRIORITY' WHEN {_PLACE} <= 75 THEN 'BATCH_2_MEDIUM_PRIORITY'"
    f" WHEN {_PLACE} <= 150 THEN 'BATCH_3_STANDARD' ELSE 'BATCH_4_FUTURE' END"
)


def _candidates(spark, sf):
    return publication.candidates(_listings(spark, sf))


@query(
    "pub_candidates",
    over("SELECT * EXCLUDE (k) FROM businesses WHERE " + _PRESENT, "businesses"),
)
def pub_candidates(spark, sf):
    return _candidates(spark, sf)


def _expression(name, column, sql, expression):
    """A query of one expression per candidate."""

    @query(name, over(f"SELECT business_id, {sql} AS {column} FROM businesses WHERE {_PRESENT}", "businesses"))
    def run(spark, sf):
        return _candidates(spark, sf).select("business_id", expression().alias(column))

    return run


_expression("sql_slug", "suggested_slug", SLUG, lambda: text.compact_slug(c("name"), c("category"), c("city")))
_expression("pub_score", "priority_score", SCORE, scores.publication_score)
_expression("content_category", "content_category", CONTENT_CATEGORY, lambda: scores.content_category(c("category")))
_expression("complexity", "generation_complexity", COMPLEXITY, scores.complexity)
_expression("completeness_flag", "data_completeness", COMPLETENESS, scores.completeness_flag)
_expression("suggest_title", "suggested_title", TITLE, scores.suggested_title)
_expression("suggest_meta", "suggested_meta_description", META, scores.suggested_meta)
_expression("suggest_h1", "suggested_h1", H1, scores.suggested_h1)
_expression("target_words", "target_word_count", WORDS, scores.target_word_count)
_expression("suggest_keywords", "suggested_keywords", KEYWORDS, scores.suggested_keywords)


@query(
    "local_competition",
    over(f"SELECT business_id, {LOCAL} AS local_competition FROM businesses b WHERE {_PRESENT}", businesses=fixtures.business_sql(False)),
)
def local_competition(spark, sf):
    b = _listings(spark, sf, False)
    return publication.local_competition(publication.candidates(b), b).select("business_id", "local_competition")


@query(
    "city_count",
    over(f"SELECT business_id, {CITY} AS city_business_count FROM businesses b WHERE {_PRESENT}", businesses=fixtures.business_sql(False)),
)
def city_count(spark, sf):
    b = _listings(spark, sf, False)
    return publication.city_business_count(publication.candidates(b), b).select("business_id", "city_business_count")


@query(
    "related_agg",
    over(f"SELECT business_id, {RELATED} AS related_count FROM businesses b WHERE {_PRESENT}", businesses=fixtures.business_sql(False)),
)
def related_agg(spark, sf):
    b = _listings(spark, sf, False)
    return publication.related_businesses(publication.candidates(b), b).select("business_id", "related_count")


@query(
    "related_members",
    over(
        "SELECT DISTINCT city, state, business_id, name || '|' || category || '|' || business_id AS entry FROM businesses"
        f" WHERE {_PRESENT} AND business_id IS NOT NULL",
        businesses=fixtures.business_sql(False),
    ),
)
def related_members(spark, sf):
    return publication.market_members(_listings(spark, sf, False))


_SCORED = f"SELECT *, {SCORE} AS priority_score FROM businesses WHERE {_PRESENT}"


def _scored(spark, sf):
    return _candidates(spark, sf).withColumn("priority_score", scores.publication_score())


@query("pub_rank", over(f"SELECT business_id, {RANK} AS publication_rank FROM s", "businesses", s=_SCORED))
def pub_rank(spark, sf):
    ranked = publication.publication_rank(_scored(spark, sf).select("business_id", "priority_score", "rating", "review_count"))
    return ranked.select("business_id", "publication_rank")


@query("pub_batch", over(f"SELECT business_id, {BATCH} AS processing_batch FROM s", "businesses", s=_SCORED))
def pub_batch(spark, sf):
    return publication.processing_batch(_scored(spark, sf)).select("business_id", "processing_batch")


@query("query_time", over(f"SELECT business_id, TRUE AS stamped FROM businesses WHERE {_PRESENT}", businesses=fixtures.business_sql(False)))
def query_time(spark, sf):
    """Every candidate gets the time of the query."""
    stamped = publication.candidates(_listings(spark, sf, False)).withColumn("query_generated_at", F.current_timestamp())
    return stamped.select("business_id", (c("query_generated_at") <= F.now()).alias("stamped"))


def _publish_sql(min_score):
    return over(
        "SELECT b.* EXCLUDE (k, priority_score), round(priority_score, 2) AS priority_score,"
        f" {LOCAL} AS local_competition, {CITY} AS city_business_count, {RELATED} AS related_count,"
        f" {TITLE} AS suggested_title, {META} AS suggested_meta_description, {H1} AS suggested_h1, {WORDS} AS target_word_count,"
        f" {KEYWORDS} AS suggested_keywords FROM listed b ORDER BY publication_rank",
        "businesses",
        candidates=CANDIDATES,
        listed=f"SELECT *, {RANK} AS publication_rank, {BATCH} AS processing_batch FROM candidates"
        f" WHERE data_completeness = 'COMPLETE' AND priority_score >= {min_score}",
    )


def _published(spark, sf, **options):
    # the market is the same listings without their descriptions, so their texts are read once
    out = publication.publish_list(_listings(spark, sf), market=_listings(spark, sf, False), **options)
    return out.drop("query_generated_at")


# Listings with ids that stand in two rows, and with rows without id.
_REPEATED = (
    "SELECT k, CASE WHEN k % 11 = 0 THEN NULL ELSE business_id END AS business_id, * EXCLUDE (k, business_id) FROM businesses"
    " UNION ALL SELECT k, business_id, * EXCLUDE (k, business_id) REPLACE (round(5.0 - coalesce(rating, 2.0) / 2, 1) AS rating) FROM businesses WHERE k % 3 = 0"
    " UNION ALL SELECT k, business_id, * EXCLUDE (k, business_id) FROM businesses WHERE k % 5 = 0"
)
_ALL_RANKS = (
    "SELECT business_id, rating, review_count, round(priority_score, 2) AS priority_score,"
    " row_number() OVER (ORDER BY priority_score DESC, rating DESC NULLS LAST, review_count DESC NULLS LAST, business_id NULLS LAST) AS publication_rank,"
    " row_number() OVER (ORDER BY priority_score DESC, rating DESC NULLS LAST, business_id NULLS LAST, review_count DESC NULLS LAST) AS place"
    f" FROM (SELECT *, {SCORE} AS priority_score, {COMPLETENESS} AS data_completeness FROM many WHERE {_PRESENT}) t"
    " WHERE data_completeness = 'COMPLETE' AND priority_score >= 15"
)


@query(
    "publish_list_repeated",
    over(
        "SELECT * EXCLUDE (place), CASE WHEN place <= 25 THEN 'BATCH_1_HIGH_PRIORITY' WHEN place <= 75 THEN 'BATCH_2_MEDIUM_PRIORITY'"
        " WHEN place <= 150 THEN 'BATCH_3_STANDARD' ELSE 'BATCH_4_FUTURE' END AS processing_batch FROM ranks",
        "businesses", many=_REPEATED, ranks=_ALL_RANKS,
    ),
)
def publish_list_repeated(spark, sf):
    """Every listed row has a rank and a batch of its own, whether its id is repeated or null."""
    b = _listings(spark, sf)
    without = b.withColumn("business_id", F.when(c("pos") % 11 != 0, c("business_id")))
    other = b.where("pos % 3 = 0").withColumn("rating", F.round(5.0 - F.coalesce("rating", F.lit(2.0)) / 2, 1))
    many = without.unionByName(other).unionByName(b.where("pos % 5 = 0"))
    listed = publication.publish_list(many, min_score=15.0, market=_listings(spark, sf, False))
    return listed.select("business_id", "rating", "review_count", "priority_score", "publication_rank", "processing_batch")


@query("publish_list", _publish_sql(30))
def publish_list(spark, sf):
    return _published(spark, sf)


@query("publish_list_15", _publish_sql(15))
def publish_list_15(spark, sf):
    return _published(spark, sf, min_score=15.0)


@query(
    "publication_stats",
    over(
        "SELECT 'PUBLICATION_STATS' AS metric_type, count(*) AS total_candidates, count(*) FILTER (priority_score >= 70) AS high_priority_count,"
        " count(*) FILTER (priority_score >= 50 AND priority_score < 70) AS medium_priority_count,"
        " count(*) FILTER (priority_score < 50) AS low_priority_count, count(DISTINCT city || ',' || state) AS unique_locations,"
        " count(DISTINCT category) AS unique_categories, round(avg(priority_score), 6) AS avg_priority_score,"
        " count(rating) AS businesses_with_ratings, count(website) AS businesses_with_websites FROM s",
        "businesses", s=_SCORED,
    ),
)
def publication_stats(spark, sf):
    return publication.publication_stats(_listings(spark, sf)).withColumn(
        "avg_priority_score", F.round("avg_priority_score", 6)
    )


@query(
    "category_plan",
    over(
        f"SELECT {CONTENT_CATEGORY} AS content_category, count(*) AS business_count, round(avg(priority_score), 6) AS avg_priority,"
        " count(*) FILTER (priority_score >= 70) AS high_priority_count, count(DISTINCT city || ',' || state) AS unique_locations"
        " FROM s GROUP BY 1",
        "businesses", s=_SCORED,
    ),
)
def category_plan(spark, sf):
    return publication.category_plan(_listings(spark, sf)).withColumn("avg_priority", F.round("avg_priority", 6))


def _links_sql(pool):
    return over(
        "SELECT b.business_id, coalesce(r.ids, '') AS related FROM business_core b LEFT JOIN (SELECT business_id,"
        " string_agg(other, ',' ORDER BY pos) AS ids FROM (SELECT b.business_id, p.business_id AS other, p.k AS pos,"
        " row_number() OVER (PARTITION BY b.business_id ORDER BY p.k) AS rn FROM business_core b JOIN pool p"
        " ON p.business_id <> b.business_id AND (lower(p.city) = lower(b.city)) <> (lower(p.category) = lower(b.category))) t"
        " WHERE rn <= 3 GROUP BY business_id) r ON r.business_id = b.business_id",
        "business_core",
        pool=f"SELECT * FROM business_core {pool}",
    )


def _ids():
    return F.array_join(F.transform("related", lambda m: m.business_id), ",").alias("related")


@query("related_links", _links_sql(""))
def related_links(spark, sf):
    return linking.related_links(_listings(spark, sf, False)).select("business_id", _ids())


@query("related_links_all", _links_sql(""))
def related_links_all(spark, sf):
    return linking.related_links(_listings(spark, sf, False), pool=None).select("business_id", _ids())


_CONTEXT = _ladder(fixed.CONTEXT_TERMS, fixed.DEFAULT_CONTEXT)
_GUIDANCE = " UNION ALL ".join(
    f"SELECT '{key}' AS context_key, '{','.join(areas)}' AS focus_areas, '{','.join(words)}' AS context_keywords"
    for key, areas, words in fixed.CATEGORY_GUIDANCE
)


@query(
    "category_context",
    over(
        f"SELECT business_id, g.* FROM (SELECT *, {_CONTEXT} AS ck FROM business_core) b JOIN guidance g ON g.context_key = b.ck",
        "business_core", guidance=_GUIDANCE,
    ),
)
def category_context(spark, sf):
    return linking.category_context(_listings(spark, sf, False)).select(
        "business_id", "context_key", F.array_join("focus_areas", ",").alias("focus_areas"),
        F.array_join("context_keywords", ",").alias("context_keywords"),
    )


def _or_blank(name):
    return f"coalesce({name}, '')"


_PLACE_TEXT = f"{_or_blank('city')} || ', ' || {_or_blank('state')}"
_HEAD = (
    f"'Write a web page about: ' || {_or_blank('name')} || ' in ' || {_PLACE_TEXT} || chr(10) || 'Id: ' || business_id || chr(10)"
    f" || 'Trade: ' || {_or_blank('category')} || chr(10) || 'Address: ' || {_or_blank('address')} || ', ' || {_PLACE_TEXT} || ' '"
    f" || {_or_blank('zip_code')} || chr(10) || 'Phone: ' || coalesce(phone, {_or_blank('zip_code')} || '123') || chr(10)"
    " || 'Website: ' || coalesce(website, 'https://example.com') || chr(10)"
)
_TAIL = "'Answer with one JSON object: business, seo, content, jsonld, internal_links. No other text.'"


@query("build_prompts", over(f"SELECT business_id, {_HEAD} || {_TAIL} AS prompt FROM business_core", "business_core"))
def build_prompts(spark, sf):
    return linking.build_prompts(_listings(spark, sf, False)).select("business_id", "prompt")


@query(
    "build_prompts_full",
    over(
        f"SELECT business_id, {_HEAD} || 'About: ' || coalesce(nullif(description, ''), 'Professional ' || lower({_or_blank('category')})"
        " || ' services') || chr(10) || 'Limits: title 10-70, description 50-160, heading 10-70 characters; 800 words or more of main text.'"
        f" || chr(10) || {_TAIL} AS prompt FROM businesses",
        "businesses",
    ),
)
def build_prompts_full(spark, sf):
    return linking.build_prompts(_listings(spark, sf), "full").select("business_id", "prompt")


_N_WORDS = r"len(regexp_extract_all(main_content, '\S+'))"
_QC_TAIL = "'Answer with JSON: quality_score 0-1, passed_checks, failed_checks, suggestions, needs_regeneration.'"


@query(
    "qc_prompts",
    over(
        "SELECT page_pos, 'Review the page of: ' || coalesce(name, '') || chr(10) || 'Title: ' || length(title) || ' characters' || chr(10)"
        " || 'Description: ' || length(meta_description) || ' characters' || chr(10) || 'Heading: ' || length(h1) || ' characters'"
        f" || chr(10) || 'Main text: ' || {_N_WORDS} || ' words' || chr(10) || {_QC_TAIL} AS qc_prompt FROM page_specs",
        "page_specs",
    ),
)
def qc_prompts(spark, sf):
    return linking.build_qc_prompts(fixtures.page_specs(spark, sf)).select("page_pos", "qc_prompt")


@query(
    "qc_prompts_full",
    over(
        "SELECT page_pos, 'Review the page of: ' || coalesce(name, '') || chr(10) || 'Title: ' || title || ' - ' || length(title) || ' characters'"
        " || chr(10) || 'Description: ' || meta_description || ' - ' || length(meta_description) || ' characters' || chr(10)"
        " || 'Heading: ' || h1 || ' - ' || length(h1) || ' characters' || chr(10)"
        f" || 'Main text: ' || {_N_WORDS} || ' words' || chr(10) || 'Address: ' || slug || chr(10) || 'Main text: ' || main_content"
        f" || chr(10) || 'Introduction: ' || introduction || chr(10) || 'Conclusion: ' || conclusion || chr(10) || {_QC_TAIL} AS qc_prompt"
        " FROM page_specs",
        "page_specs",
    ),
)
def qc_prompts_full(spark, sf):
    return linking.build_qc_prompts(fixtures.page_specs(spark, sf), "full").select("page_pos", "qc_prompt")
