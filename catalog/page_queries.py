"""Content rules, quality control, model responses."""

from pyspark.sql import functions as F

from catalog import fixtures
from catalog.ingest_queries import SPEC_ERRORS, broken_fields
from catalog.publish_queries import H1, META, TITLE
from catalog.registry import over, query
from mainstreet.functions import checks, fixed, text
from mainstreet.operators import content, quality, responses

c = F.col

_STOPS = "|".join(fixed.STOP_WORDS)
_KEYWORDS = "string_split(keyword_csv, ',')"
_FULL = "lower(introduction || ' ' || main_content || ' ' || conclusion)"


def _n_words(name):
    return rf"len(regexp_extract_all({name}, '\S+'))"


def _has(name):
    return f"coalesce(contains({_FULL}, lower({name})), false)"


_FLOW = (
    "(" + " OR ".join(
        f"regexp_matches(lower({n}), '{'|'.join(fixed.TRANSITION_WORDS)}')" for n in ("introduction", "main_content", "conclusion")
    )
    + ") AND len(string_split(main_content, chr(10) || chr(10))) >= 3 AND coalesce((SELECT max(n) // 10 > min(n) // 10 FROM"
    f" (SELECT {_n_words('p')} AS n FROM (SELECT unnest(string_split(main_content, chr(10) || chr(10))) AS p) u) v WHERE n > 0), false)"
)
_VARIETY = (
    "coalesce((SELECT count(*) >= 5 AND min(n) < avg(n) * 0.7 AND max(n) > avg(n) * 1.3 FROM"
    f" (SELECT {_n_words('p')} AS n FROM (SELECT unnest(regexp_split_to_array(main_content, '[.!?]+')) AS p) u) v WHERE n > 0), false)"
)


def _repetition(pattern):
    return (
        "coalesce((SELECT max(n) FROM (SELECT count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(w) - 1),"
        " lambda i: CASE WHEN f[i] OR f[i + 1] OR f[i + 2] THEN NULL ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END)) AS phrase FROM"
        f" (SELECT w, list_transform(w, lambda x: regexp_matches(x, '{pattern}')) AS f FROM"
        r" (SELECT regexp_extract_all(lower(main_content), '\S+') AS w) a) b) t WHERE phrase IS NOT NULL GROUP BY phrase) g), 0) <= 2"
    )


# Query key, check name and SQL of every check.
CHECKS = [
    ("title_length", "title_length", "length(title) BETWEEN 10 AND 70"),
    ("title_capitalized", "title_capitalized", r"regexp_matches(title, '^\p{Lu}')"),
    ("title_not_all_caps", "title_not_all_caps", r"NOT (regexp_matches(title, '\p{Lu}') AND NOT regexp_matches(title, '[\p{Ll}\p{Lt}]'))"),
    ("meta_length", "meta_length", "length(meta_description) BETWEEN 50 AND 160"),
    ("meta_compelling", "meta_compelling", "contains(meta_description, '!') OR contains(meta_description, '?')"),
    ("h1_length", "h1_length", "length(h1) BETWEEN 10 AND 70"),
    ("h1_different", "h1_different_from_title", "lower(h1) <> lower(title)"),
    ("slug_format", "slug_format", "regexp_full_match(slug, '[a-z0-9-]+')"),
    ("slug_short", "slug_not_too_long", "length(slug) <= 60"),
    (
        "slug_has_keywords", "slug_has_keywords",
        f"len(list_filter({_KEYWORDS}[1:3], lambda x: contains(slug, replace(lower(x), ' ', '-')))) > 0",
    ),
    ("has_keywords", "has_keywords", f"len({_KEYWORDS}) >= 3"),
    ("keyword_variety", "keyword_variety", f"len(list_distinct({_KEYWORDS})) = len({_KEYWORDS})"),
    ("word_count", "word_count", f"{_n_words('main_content')} >= 800"),
    ("has_introduction", "has_introduction", "length(introduction) >= 100"),
    ("has_conclusion", "has_conclusion", "length(conclusion) >= 100"),
    ("content_flows", "content_flows", _FLOW),
    ("mentions_name", "mentions_business_name", _has("name")),
    ("mentions_category", "mentions_category", _has("category")),
    ("mentions_location", "mentions_location", f"{_has('city')} OR {_has('state')}"),
    ("sentence_variety", "varied_sentence_length", _VARIETY),
    ("no_repetition", "no_repetitive_phrases", _repetition(_STOPS)),
    (
        "includes_address", "includes_address",
        f"{_has('city')} OR {_has('state')} OR coalesce(contains({_FULL}, zip_code), false)",
    ),
]
_SEO, _CONTENT = CHECKS[:12], CHECKS[12:]


def _register_check(key, name, sql):
    @query(key, over(f"SELECT page_pos, {sql} AS passed FROM page_specs", "page_specs"))
    def run(spark, sf):
        return content.check_columns(fixtures.page_specs(spark, sf), [name]).select("page_pos", c(name).alias("passed"))


for _row in CHECKS:
    _register_check(*_row)


@query(
    "no_repetition_token",
    over(f"SELECT page_pos, {_repetition('^(' + _STOPS + ')$')} AS passed FROM page_specs", "page_specs"),
)
def no_repetition_token(spark, sf):
    pages = content.check_columns(fixtures.page_specs(spark, sf), ["no_repetitive_phrases"], stop_match="token")
    return pages.withColumnRenamed("no_repetitive_phrases", "passed")


# One boolean column per check, named as in the results.
CHECKED = "SELECT *, " + ", ".join(f"({sql}) AS c_{name}" for _, name, sql in CHECKS) + " FROM page_specs"


@query(
    "generate_slug",
    over(
        "SELECT business_id, CASE WHEN length(s) > 60 THEN left(s, 57) || '...' ELSE s END AS slug FROM (SELECT business_id,"
        r" trim(regexp_replace(regexp_replace(regexp_replace(lower(name || '-' || category || '-' || city || coalesce('-' || address, '')),"
        r" '[^a-z0-9\s-]', '', 'g'), '\s+', '-', 'g'), '-+', '-', 'g'), '-') AS s FROM business_core) t",
        "business_core",
    ),
)
def generate_slug(spark, sf):
    # the address behind the city makes some slugs longer than the limit
    place = F.concat(c("city"), F.coalesce(F.concat(F.lit("-"), c("address")), F.lit("")))
    return fixtures.businesses(spark, sf, False).select(
        "business_id", text.page_slug(c("name"), c("category"), place).alias("slug")
    )


def _density(keyword, body):
    return (
        f"CASE WHEN {_n_words(body)} = 0 THEN 0.0 ELSE ((length(lower({body})) - length(replace(lower({body}), lower({keyword}), '')))"
        f" // length({keyword}))::DOUBLE / {_n_words(body)} END"
    )


@query(
    "keyword_density",
    over(
        f"SELECT page_pos, kw AS keyword, round({_density('kw', 'body')}, 9) AS density FROM (SELECT page_pos,"
        f" unnest({_KEYWORDS}) AS kw, introduction || ' ' || main_content || ' ' || conclusion AS body FROM page_specs) t",
        "page_specs",
    ),
)
def keyword_density(spark, sf):
    pages = fixtures.page_specs(spark, sf).select(
        "page_pos", F.explode("seo.keywords").alias("keyword"), checks.joined_content().alias("body")
    )
    return pages.select(
        "page_pos", "keyword", F.round(text.keyword_density(c("body"), c("keyword")), 9).alias("density")
    )


_LONG_STOPS = ", ".join(f"'{w}'" for w in sorted({w for w in fixed.STOP_WORDS if len(w) >= 4}))


@query(
    "meta_keywords",
    over(
        "SELECT p.page_pos, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:8], ',') AS meta_keywords FROM (SELECT p.page_pos,"
        " list_filter([lower(category), lower(city), lower(category) || ' ' || lower(city), lower(city) || ' ' || lower(category)]"
        " || coalesce(f.frequent, []), lambda x: x IS NOT NULL AND length(x) >= 3) AS l FROM page_specs p LEFT JOIN frequent f ON f.page_pos = p.page_pos) p",
        "page_specs",
        tokens="SELECT page_pos, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM"
        r" (SELECT page_pos, regexp_extract_all(lower(main_content), '[\p{L}\p{N}_]+') AS t FROM page_specs) x",
        counted="SELECT page_pos, w, count(*) AS n, min(i) AS i FROM tokens WHERE regexp_full_match(w, '[a-z]{4,}')"
        f" AND w NOT IN ({_LONG_STOPS}) GROUP BY page_pos, w",
        frequent="SELECT page_pos, list(w ORDER BY rn) AS frequent FROM (SELECT *, row_number() OVER (PARTITION BY page_pos ORDER BY n DESC, i) AS rn"
        " FROM counted) t WHERE rn <= 5 AND n >= 3 GROUP BY page_pos",
    ),
)
def meta_keywords(spark, sf):
    return content.meta_keywords(fixtures.page_specs(spark, sf)).select(
        "page_pos", F.array_join("meta_keywords", ",").alias("meta_keywords")
    )


def _failed(kind, rows):
    return [f"CASE WHEN NOT c_{name} THEN '{kind} failed: {name}' END" for _, name, _ in rows]


_DENSE = (
    "list_filter(list_transform(list_transform(" + _KEYWORDS + "[1:3], lambda k: {'k': k, 'd': CASE WHEN nw = 0 THEN 0.0 ELSE"
    " ((length(body) - length(replace(body, lower(k), ''))) // length(k))::DOUBLE / nw END}),"
    " lambda e: CASE WHEN e.d > 0.03 THEN 'Keyword ''' || e.k || ''' density too high: ' || printf('%.1f%%', e.d * 100)"
    " WHEN e.d < 0.005 THEN 'Keyword ''' || e.k || ''' density too low: ' || printf('%.1f%%', e.d * 100) END), lambda x: x IS NOT NULL)"
)
_PLAIN = (
    "list_filter([" + ", ".join(_failed("SEO metadata", _SEO) + _failed("Content", _CONTENT))
    + ", CASE WHEN NOT has_jsonld THEN 'Missing schema.org markup' END, CASE WHEN n_links = 0 THEN 'No internal links found' END],"
    " lambda x: x IS NOT NULL)"
)
# Pages with their violations as a list.
JUDGED = (
    f"SELECT *, {_PLAIN} || {_DENSE} AS violations FROM (SELECT *, {_FULL} AS body, {_n_words(_FULL)} AS nw FROM checked) t"
)


@query(
    "seo_compliance",
    over(
        "SELECT page_pos, array_to_string(violations, '; ') AS violations, len(violations) AS n FROM judged",
        "page_specs", checked=CHECKED, judged=JUDGED,
    ),
)
def seo_compliance(spark, sf):
    return content.seo_compliance(fixtures.page_specs(spark, sf)).select(
        "page_pos", F.array_join("violations", "; ").alias("violations"), F.size("violations").alias("n")
    )


_ADVICE = "concat_ws('; ', " + ", ".join(
    f"CASE WHEN NOT c_{name} THEN '{message}' END" for name, message in fixed.METADATA_ADVICE + fixed.CONTENT_ADVICE
) + ")"


@query("suggest_improvements", over(f"SELECT page_pos, {_ADVICE} AS advice FROM checked", "page_specs", checked=CHECKED))
def suggest_improvements(spark, sf):
    return content.improvement_advice(fixtures.page_specs(spark, sf)).select(
        "page_pos", F.array_join("advice", "; ").alias("advice")
    )


@query(
    "checks_table",
    over(
        " UNION ALL ".join(f"SELECT page_pos, '{name}' AS \"check\", c_{name} AS passed FROM checked" for _, name, _ in CHECKS),
        "page_specs", checked=CHECKED,
    ),
)
def checks_table(spark, sf):
    return content.checks_table(fixtures.page_specs(spark, sf))


@query(
    "check_rates",
    over(
        " UNION ALL ".join(
            f"SELECT '{name}' AS \"check\", count(*) AS pages, count(*) FILTER (c_{name}) AS passed,"
            f" round(count(*) FILTER (c_{name})::DOUBLE / count(*), 4) AS pass_rate FROM checked"
            for _, name, _ in CHECKS
        ),
        "page_specs", checked=CHECKED,
    ),
)
def check_rates(spark, sf):
    return content.check_rates(fixtures.page_specs(spark, sf))


# First page per business.
FIRST = (
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY page_pos) AS rn FROM page_specs) t WHERE rn = 1"
)


@query("qc_dedupe", over(f"SELECT page_pos, business_id, slug FROM ({FIRST}) f", "page_specs"))
def qc_dedupe(spark, sf):
    return quality.qc_dedupe(fixtures.page_specs(spark, sf)).select("page_pos", "business_id", c("seo.slug").alias("slug"))


_QC_TABLES = dict(
    first_pages=FIRST,
    checked=CHECKED.replace("FROM page_specs", "FROM first_pages"),
    judged=JUDGED,
    reviewed="SELECT *, string_split(failed_csv, ',') || list_transform(violations, lambda v: 'SEO: ' || v) AS failed,"
    " len(violations) AS nv, greatest(0.0, round(qs - least(len(violations) * 0.1::DOUBLE, 0.4::DOUBLE), 6)) AS score FROM (SELECT j.*,"
    " round(f.quality_score, 3) AS qs, f.failed_csv, f.passed_csv, f.suggestion_csv, f.needs_regeneration AS flag,"
    f" f.quality_score BETWEEN 0 AND 1 AS valid, {SPEC_ERRORS} AS spec_errors FROM judged j LEFT JOIN feedback f ON f.page_pos = j.page_pos) t",
    routed="SELECT *, CASE WHEN NOT generation_successful THEN 'generation_failed' WHEN NOT has_spec THEN 'no_page_spec'"
    " WHEN spec_errors <> '' THEN 'qc_setup_failed' WHEN qs IS NULL THEN 'qc_failed' WHEN NOT valid THEN 'qc_validation_failed' END AS reason,"
    " score < 0.7 OR flag OR nv > 2 OR len(failed) > 5 AS again FROM reviewed",
    qc="SELECT *, reason IS NULL AS qc_successful, CASE WHEN reason IS NULL THEN score < 0.7 OR again OR nv > 2 END AS needs FROM routed",
)


def _qc(sql):
    return over(sql, "page_specs", "feedback", **_QC_TABLES)


def _route(spark, sf):
    return quality.qc_route(fixtures.page_specs(spark, sf), fixtures.feedback(spark, sf), on=("page_pos",))


@query("qc_route", _qc("SELECT business_id, page_pos, reason, qc_successful, needs AS needs_regeneration FROM qc"))
def qc_route(spark, sf):
    return _route(spark, sf).select("business_id", "page_pos", "reason", "qc_successful", "needs_regeneration")


@query(
    "combine_assessments",
    over(
        "SELECT page_pos, score AS quality_score, passed_csv AS passed_checks, array_to_string(failed, '; ') AS failed_checks,"
        " array_to_string([suggestion_csv] || list_transform(violations[1:3], lambda v: 'Fix SEO violation: ' || v), '; ') AS suggestions,"
        " again AS needs_regeneration FROM routed WHERE qs IS NOT NULL",
        "page_specs", "feedback",
        **{**_QC_TABLES, "first_pages": "SELECT * FROM page_specs"},
    ),
)
def combine_assessments(spark, sf):
    reviews = fixtures.feedback(spark, sf)
    review = F.struct(*[n for n in reviews.columns if n != "page_pos"]).alias("review")
    rounded = reviews.withColumn("quality_score", F.round("quality_score", 3)).select("page_pos", review)
    judged = content.seo_compliance(fixtures.page_specs(spark, sf)).join(rounded, "page_pos")
    out = quality.combine_assessments(c("review"), c("violations"))
    return judged.select("page_pos", out.alias("f")).select(
        "page_pos",
        "f.quality_score",
        F.array_join("f.passed_checks", ",").alias("passed_checks"),
        F.array_join("f.failed_checks", "; ").alias("failed_checks"),
        F.array_join("f.suggestions", "; ").alias("suggestions"),
        "f.needs_regeneration",
    )


@query(
    "needs_regeneration",
    _qc("SELECT count(*) FILTER (qc_successful) AS reviewed, count(*) FILTER (qc_successful AND needs) AS regenerate FROM qc"),
)
def needs_regeneration(spark, sf):
    return quality.needs_regeneration(_route(spark, sf))


@query(
    "qc_summary",
    _qc(
        "SELECT count(*) AS total_pages, count(*) FILTER (qc_successful) AS successful_qc, count(*) FILTER (NOT qc_successful) AS failed_qc,"
        " count(*) FILTER (needs) AS pages_needing_regeneration FROM qc"
    ),
)
def qc_summary(spark, sf):
    return quality.qc_summary(_route(spark, sf))


_DISTINCT_KW = f"list_filter({_KEYWORDS}, lambda x, i: list_position({_KEYWORDS}, x) = i)"
_METRICS = (
    f"SELECT *, {_n_words('main_content')} AS word_count, length(title) AS title_length, length(meta_description) AS meta_length,"
    f" length(h1) AS h1_length, len({_KEYWORDS}) AS keyword_count,"
    f" list_transform({_DISTINCT_KW}, lambda k: {{'k': k, 'd': CASE WHEN {_n_words('main_content')} = 0 THEN 0.0 ELSE"
    " round(((length(lower(main_content)) - length(replace(lower(main_content), lower(k), ''))) // length(k))::DOUBLE"
    f" / {_n_words('main_content')} * 100, 2) END}}) AS dens FROM page_specs"
)


@query(
    "content_metrics",
    over(
        "SELECT page_pos, word_count, title_length, meta_length, h1_length, keyword_count, n_links AS link_count,"
        " array_to_string(list_transform(dens, lambda e: e.k || '=' || CAST(e.d AS VARCHAR)), ',') AS keyword_density FROM metrics",
        "page_specs", metrics=_METRICS,
    ),
)
def content_metrics(spark, sf):
    shown = F.transform(F.map_entries("keyword_density"), lambda e: F.concat(e.key, F.lit("="), e.value.cast("string")))
    return quality.content_metrics(fixtures.page_specs(spark, sf)).select(
        "page_pos", "word_count", "title_length", "meta_length", "h1_length", "keyword_count", "link_count",
        F.array_join(shown, ",").alias("keyword_density"),
    )


_SUGGESTIONS = (
    "list_filter([CASE WHEN title_length > 70 THEN 'Shorten the page title to 70 characters or less'"
    " WHEN title_length < 10 THEN 'Expand the page title to at least 10 characters' END,"
    " CASE WHEN meta_length > 160 THEN 'Shorten the meta description to 160 characters or less'"
    " WHEN meta_length < 50 THEN 'Expand the meta description to at least 50 characters' END,"
    " CASE WHEN word_count < 800 THEN 'Add approximately ' || (800 - word_count) || ' more words to reach minimum content length' END]"
    " || list_transform(dens, lambda e: CASE WHEN e.d > 3.0 THEN 'Reduce keyword density for ''' || e.k || ''' (currently ' || CAST(e.d AS VARCHAR) || '%)'"
    " WHEN e.d < 0.5 THEN 'Increase keyword usage for ''' || e.k || ''' (currently ' || CAST(e.d AS VARCHAR) || '%)' END)"
    " || [CASE WHEN n_links = 0 THEN 'Add 1-3 internal links to related pages'"
    " WHEN n_links > 5 THEN 'Reduce number of internal links to 3-5 maximum' END], lambda x: x IS NOT NULL)[1:5]"
)


@query(
    "improvement_suggestions",
    over(f"SELECT page_pos, array_to_string({_SUGGESTIONS}, '; ') AS suggestions FROM metrics", "page_specs", metrics=_METRICS),
)
def improvement_suggestions(spark, sf):
    metrics = quality.content_metrics(fixtures.page_specs(spark, sf))
    return metrics.select("page_pos", F.array_join(quality.improvement_suggestions(), "; ").alias("suggestions"))


def _sum(names):
    return "(" + " + ".join(f"c_{n}::INT" for n in names) + ")"


@query(
    "weighted_quality",
    over(
        "SELECT page_pos, round(" + _sum(["title_length", "meta_length", "h1_length", "word_count", "slug_format"]) + " / 5.0::DOUBLE * 0.3::DOUBLE"
        " + " + _sum(["mentions_category", "content_flows", "varied_sentence_length", "has_keywords"]) + " / 4.0::DOUBLE * 0.4::DOUBLE"
        " + " + _sum(["mentions_location", "includes_address"]) + " / 3.0::DOUBLE * 0.3::DOUBLE, 3) AS quality FROM checked",
        "page_specs", checked=CHECKED,
    ),
)
def weighted_quality(spark, sf):
    checked = content.with_checks(fixtures.page_specs(spark, sf))
    # no check stands for the service area, so it counts as failed
    named = {"relevance": "mentions_category", "structure": "content_flows", "writing_quality": "varied_sentence_length",
             "local_elements": "mentions_location", "geographic_relevance": "includes_address"}
    extra = [part for key, name in named.items() for part in (F.lit(key), c("content_results")[name])]
    results = F.map_concat(
        "seo_results", F.create_map(F.lit("word_count"), c("content_results")["word_count"], *extra,
                                    F.lit("keywords"), c("seo_results")["has_keywords"])
    )
    return checked.select("page_pos", checks.weighted_quality(results).alias("quality"))


_BODY = (
    r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(response, chr(10) || ' '), '^```json', ''), '```$', ''),"
    r" '^\s+|\s+$', '', 'g'), '[\x00-\x1F\x7F-\x{9F}]', ' ', 'g'))"
)


@query(
    "parse_responses",
    over(
        "SELECT page_pos, e AS error, CASE WHEN e IS NULL THEN json_extract_string(b, '$.slug') END AS slug,"
        " CASE WHEN e IS NULL THEN CAST(json_extract_string(b, '$.n') AS BIGINT) END AS n,"
        " CASE WHEN e IS NULL THEN json_extract_string(b, '$.title') END AS title FROM"
        r" (SELECT *, CASE WHEN NOT regexp_matches(b, '[}\]]$') THEN 'truncated' WHEN NOT json_valid(b) THEN 'not_json' END AS e FROM"
        f" (SELECT page_pos, regexp_replace({_BODY}, '\\s+', ' ', 'g') AS b FROM raw_responses) t) u",
        "raw_responses",
    ),
)
def parse_responses(spark, sf):
    parsed = responses.parse_responses(fixtures.raw_responses(spark, sf), "slug string, n long, title string")
    return parsed.select("page_pos", "error", "parsed.slug", "parsed.n", "parsed.title")


@query(
    "clean_control_chars",
    r"SELECT doc_id, regexp_replace(regexp_replace(text || chr(7) || chr(9) || lang, '[\x00-\x1F\x7F-\x{9F}]', ' ', 'g'), '\s+', ' ', 'g') AS cleaned"
    " FROM documents",
)
def clean_control_chars(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    raw = F.concat(c("text"), F.lit("\x07\t"), c("lang"))
    return documents.select("doc_id", text.clean_control_chars(raw).alias("cleaned"))


_GENERATED_ERRORS = (
    "concat_ws(', ', nullif(" + broken_fields("business.", ", ") + ", ''), CASE WHEN title_text IS NULL THEN 'seo.title' END,"
    " CASE WHEN meta_text IS NULL THEN 'seo.meta_description' END, CASE WHEN h1_text IS NULL THEN 'seo.h1' END,"
    " CASE WHEN name IS NULL OR category IS NULL OR city IS NULL THEN 'seo.slug' END, CASE WHEN name IS NULL THEN 'jsonld.name' END)"
)
_GENERATED = f"SELECT *, {TITLE} AS title_text, {META} AS meta_text, {H1} AS h1_text FROM businesses"
_LOWERED = (
    "lower(category) || ',' || lower(city) || ' ' || lower(category) || ',' || lower(category) || ' in ' || lower(city)"
    " || ',local ' || lower(category)"
)


@query(
    "generate_pages",
    over(
        "SELECT k AS page_pos, business_id, e = '' AS generation_successful, CASE WHEN e <> '' THEN 'Generated content validation failed: ' || e"
        f" END AS error, regexp_replace(trim(title_text), ' +', ' ', 'g') AS title, {_LOWERED} AS keywords"
        f" FROM (SELECT *, {_GENERATED_ERRORS} AS e FROM ({_GENERATED}) a) b",
        "businesses",
    ),
)
def generate_pages(spark, sf):
    pages = responses.generate_pages(fixtures.businesses(spark, sf))
    return pages.select(
        "page_pos", "business_id", "generation_successful", "error", c("seo.title").alias("title"),
        F.array_join("seo.keywords", ",").alias("keywords"),
    )


_MODEL_PLACE = (
    "CASE model_name WHEN 'claude-3-haiku' THEN 1 WHEN 'claude-3-5-sonnet' THEN 2 WHEN 'claude-3-sonnet' THEN 3 ELSE 4 END"
)


@query(
    "fallback_rollup",
    over(
        "SELECT u.request_id, max(won) IS NOT NULL AS succeeded,"
        " coalesce(max(CASE WHEN place = won THEN model_name END), 'claude-3-haiku') AS model_name,"
        " CAST(sum(retry_count) AS BIGINT) AS retry_count, CAST(sum(generation_time_ms) AS BIGINT) AS generation_time_ms,"
        " concat_ws('; ', string_agg(nullif(concat_ws('; ', error_text, CASE WHEN NOT success THEN 'Model ' || model_name"
        " || ' failed after 4 attempts' END), ''), '; ' ORDER BY place), CASE WHEN max(won) IS NULL THEN 'All fallback models exhausted' END) AS errors"
        " FROM (SELECT p.*, w.won FROM placed p JOIN (SELECT request_id, min(CASE WHEN success THEN place END) AS won FROM placed GROUP BY 1) w"
        " ON w.request_id = p.request_id) u WHERE won IS NULL OR place <= won GROUP BY u.request_id",
        "attempts", placed=f"SELECT *, {_MODEL_PLACE} AS place FROM attempts",
    ),
)
def fallback_rollup(spark, sf):
    rolled = responses.fallback_rollup(fixtures.attempts(spark, sf), preferred="claude-3-haiku")
    return rolled.withColumn("errors", F.array_join("errors", "; "))


_PRICES = " UNION ALL ".join(
    f"SELECT '{m}' AS model_name, {i}::DOUBLE AS pin, {o}::DOUBLE AS pout" for m, i, o in fixed.MODEL_PRICES
)


@query(
    "estimate_cost",
    over(
        "SELECT a.event_id, coalesce(round(abs(coalesce(token_count, 0)) * 4 / 1000.0::DOUBLE * pin"
        " + abs(generation_time_ms) * 4 / 1000.0::DOUBLE * pout, 6), 0) AS cost"
        " FROM (SELECT *, CASE WHEN event_id % 13 = 0 THEN 'other' ELSE model_name END AS m FROM attempts) a LEFT JOIN prices p ON p.model_name = a.m",
        "attempts", prices=_PRICES,
    ),
)
def estimate_cost(spark, sf):
    used = fixtures.attempts(spark, sf).select(
        "event_id",
        F.when(c("event_id") % 13 == 0, "other").otherwise(c("model_name")).alias("model_name"),
        # multiples of four keep costs away from half a millionth, which the two engines round differently
        (F.abs(F.coalesce("token_count", F.lit(0))) * 4).alias("input_tokens"),
        (F.abs("generation_time_ms") * 4).alias("output_tokens"),
    )
    return responses.estimate_cost(used).select("event_id", "cost")


@query(
    "batch_cost",
    "SELECT count(*) AS businesses, round(count(*) * 0.0249::DOUBLE, 4) AS total_cost FROM customer",
)
def batch_cost(spark, sf):
    return responses.batch_cost(fixtures.businesses(spark, sf, False))


@query(
    "trace_stats",
    over(
        "SELECT model_name, count(*) AS runs, count(error_text) AS error_count, round(avg(generation_time_ms), 6) AS avg_time_ms,"
        " CAST(sum(token_count) AS BIGINT) AS tokens, CAST(sum(retry_count) AS BIGINT) AS retries FROM attempts GROUP BY model_name",
        "attempts",
    ),
)
def trace_stats(spark, sf):
    return responses.trace_stats(fixtures.attempts(spark, sf)).withColumn("avg_time_ms", F.round("avg_time_ms", 6))
