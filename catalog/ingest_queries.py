"""Sources, sinks, cleaning and validation."""

from pyspark.sql import functions as F

from catalog import fixtures
from catalog.registry import over, query
from mainstreet import schemas
from mainstreet.functions import contact, fixed, text
from mainstreet.operators import cleaning
from mainstreet.plans.workspace import new_path
from mainstreet.sources import stores, tables

c = F.col
TEXT = schemas.BUSINESS_COLUMNS
_TOKENS = ", ".join(f"'{t}'" for t in fixed.NA_TOKENS)


def _texts(b):
    """Listings as a file would hold them: every value a text."""
    return tables.conform(b)


@query(
    "scan_businesses_csv",
    over(
        "SELECT " + ", ".join(f"nullif(CAST({n} AS VARCHAR), '') AS {n}" for n in TEXT) + " FROM businesses",
        "businesses",
    ),
)
def scan_businesses_csv(spark, sf):
    path = tables.write_businesses_csv(fixtures.businesses(spark, sf), new_path(spark, "listings"))
    return tables.read_businesses(spark, path, multi_line=True, fmt="csv")


@query(
    "required_columns",
    over("SELECT business_id, name, category, address, city, state, zip_code FROM business_core", "business_core"),
)
def required_columns(spark, sf):
    return tables.require_columns(fixtures.businesses(spark, sf, False)).select(*schemas.REQUIRED_COLUMNS)


@query(
    "scan_json_docs",
    over(
        "SELECT CASE WHEN page_pos % 7 <> 0 THEN page_pos END AS page_pos, CASE WHEN page_pos % 7 <> 0 THEN slug END AS slug,"
        " page_pos % 7 = 0 AS malformed FROM page_specs",
        "page_specs",
    ),
)
def scan_json_docs(spark, sf):
    doc = F.to_json(F.struct("page_pos", "slug"))
    cut = F.when(c("page_pos") % 7 == 0, F.left(doc, F.length(doc) - 1)).otherwise(doc)
    path = new_path(spark, "docs")
    fixtures.flat_pages(spark, sf).select(cut.alias("value")).write.text(path)
    docs = tables.read_docs(spark, path, "page_pos long, slug string", multi_line=False)
    return docs.select("page_pos", "slug", c("_corrupt").isNotNull().alias("malformed"))


@query(
    "sink_json_docs",
    over(
        "SELECT page_pos, slug, strftime(to_timestamp(1704067200 + page_pos * 3600) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.%f') AS generated_at,"
        " length(main_content) AS n FROM page_specs",
        "page_specs",
    ),
)
def sink_json_docs(spark, sf):
    pages = fixtures.page_specs(spark, sf).select("page_pos", "seo.slug", "generated_at", "content.main_content")
    path = tables.write_docs(pages, new_path(spark, "specs"))
    back = tables.read_docs(
        spark, path, "page_pos long, slug string, generated_at string, main_content string", multi_line=False
    )
    return back.select("page_pos", "slug", "generated_at", F.length("main_content").alias("n"))


@query(
    "sink_page_specs",
    over(
        "SELECT gen_date, business_id, page_pos, slug FROM (SELECT *, row_number() OVER (PARTITION BY gen_date, business_id"
        " ORDER BY page_pos DESC) AS rn FROM dated) t WHERE rn = 1",
        "page_specs",
        dated="SELECT *, strftime(to_timestamp(1704067200 + page_pos * 3600) AT TIME ZONE 'UTC', '%Y%m%d') AS gen_date FROM page_specs",
    ),
)
def sink_page_specs(spark, sf):
    path = stores.write_page_specs(fixtures.page_specs(spark, sf), new_path(spark, "page_specs"))
    return stores.read_page_specs(spark, path).select("gen_date", "business_id", "page_pos", c("seo.slug").alias("slug"))


_DATED = "SELECT *, strftime(to_timestamp(1704067200 + page_pos * 3600) AT TIME ZONE 'UTC', '%Y%m%d') AS gen_date FROM page_specs"


@query(
    "sink_page_specs_again",
    over(
        "SELECT gen_date, business_id, page_pos, slug FROM (SELECT *, row_number() OVER (PARTITION BY gen_date, business_id"
        " ORDER BY turn DESC, page_pos DESC) AS rn FROM written) t WHERE rn = 1",
        "page_specs",
        dated=_DATED,
        written="SELECT 1 AS turn, gen_date, business_id, page_pos, slug FROM dated WHERE page_pos % 3 < 2 UNION ALL"
        " SELECT 2, gen_date, business_id, page_pos, slug || '-again' FROM dated WHERE page_pos % 3 > 0 AND page_pos % 48 < 24",
    ),
)
def sink_page_specs_again(spark, sf):
    """A second write that brings specs of every other day, some of them for a second time."""
    pages, path = fixtures.page_specs(spark, sf), new_path(spark, "page_specs")
    stores.write_page_specs(pages.where("page_pos % 3 < 2"), path)
    renamed = pages.withColumn("seo", c("seo").withField("slug", F.concat("seo.slug", F.lit("-again"))))
    stores.write_page_specs(renamed.where("page_pos % 3 > 0 AND page_pos % 48 < 24"), path)
    return stores.read_page_specs(spark, path).select("gen_date", "business_id", "page_pos", c("seo.slug").alias("slug"))


@query(
    "sink_traces",
    "WITH attempts AS (" + fixtures.attempts_sql() + ") SELECT strftime(ts, '%Y%m%d') AS trace_date, count(*) * 2 AS n FROM attempts GROUP BY 1",
)
def sink_traces(spark, sf):
    traces = fixtures.attempts(spark, sf).withColumn("created_at", c("ts")).drop("ts")
    path = new_path(spark, "traces")
    tables.append_traces(traces, path)
    tables.append_traces(traces, path)
    log = spark.read.schema("trace_date string, business_id string").json(path)
    return log.groupBy("trace_date").agg(F.count("business_id").alias("n"))


@query(
    "upsert_status",
    over(
        "SELECT execution_id, stage, stage_no, processed_businesses, successful_pages FROM (SELECT *, row_number() OVER ("
        "PARTITION BY execution_id ORDER BY updated_at DESC, stage_no DESC) AS rn FROM status_log) t WHERE rn = 1",
        "status_log",
    ),
)
def upsert_status(spark, sf):
    return stores.latest_status(fixtures.status_log(spark, sf)).drop("updated_at")


@query(
    "status_compaction",
    over(
        "SELECT execution_id, stage, stage_no, processed_businesses, successful_pages FROM (SELECT *, row_number() OVER ("
        "PARTITION BY execution_id ORDER BY updated_at DESC, stage_no DESC) AS rn FROM status_log) t WHERE rn = 1",
        "status_log",
    ),
)
def status_compaction(spark, sf):
    """Two writes, a compaction, a third write, a compaction, a fourth write, and a read."""
    log, path = fixtures.status_log(spark, sf), new_path(spark, "status")
    for turn in range(4):
        stores.append_status(log.where(c("stage_no") % 4 == turn), path)
        if turn in (1, 2):
            stores.compact_status(spark, path)
    return stores.read_status(spark, path).drop("updated_at")


@query(
    "latest_page_specs",
    over(
        "SELECT gen_date, business_id, page_pos FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gen_date,"
        " business_id ORDER BY page_pos DESC) AS rn FROM dated) t WHERE rn = 1 ORDER BY gen_date DESC, business_id DESC LIMIT 100) u"
        " WHERE page_pos % 9 <> 0",
        "page_specs",
        dated="SELECT *, strftime(to_timestamp(1704067200 + page_pos * 3600) AT TIME ZONE 'UTC', '%Y%m%d') AS gen_date FROM page_specs",
    ),
)
def latest_page_specs(spark, sf):
    specs = fixtures.page_specs(spark, sf).select("page_pos", "business_id", "generated_at")
    marked = specs.withColumn("_corrupt", F.when(c("page_pos") % 9 == 0, F.lit("{")))
    path = stores.write_page_specs(marked, new_path(spark, "page_specs"))
    return stores.latest_page_specs(spark, path).select("gen_date", "business_id", "page_pos")


@query(
    "register_table",
    over("SELECT category, count(*) AS n FROM business_core GROUP BY category", "business_core"),
)
def register_table(spark, sf):
    path = tables.save_result(fixtures.businesses(spark, sf, False), new_path(spark, "raw"))
    stores.register(spark, "listings", path)
    return spark.sql("SELECT category, count(*) AS n FROM listings GROUP BY category")


@query(
    "register_table_grown",
    over(
        "SELECT category, count(*) AS n, count(rating) AS rated, sum(review_count) AS reviews FROM (SELECT category, rating,"
        " CASE WHEN k % 2 = 1 THEN review_count END AS review_count FROM business_core) b GROUP BY category",
        "business_core",
    ),
)
def register_table_grown(spark, sf):
    """Later files bring a column that the first ones lack; it shows up through the name."""
    b, path = fixtures.businesses(spark, sf, False), new_path(spark, "raw")
    b.where("pos % 2 = 0").drop("review_count").write.parquet(path)
    stores.register(spark, "grown_listings", path)
    b.where("pos % 2 = 1").write.mode("append").parquet(path)
    stores.register(spark, "grown_listings", path)
    return spark.sql(
        "SELECT category, count(*) AS n, count(rating) AS rated, sum(review_count) AS reviews FROM grown_listings GROUP BY category"
    )


@query(
    "query_result_sink",
    over(
        "SELECT city, category, count(*) AS competition FROM business_core GROUP BY city, category HAVING count(*) <= 3",
        "business_core",
    ),
)
def query_result_sink(spark, sf):
    from mainstreet.operators import profiling

    path = tables.save_result(profiling.market_gaps(fixtures.businesses(spark, sf, False)), new_path(spark, "result"))
    return spark.read.parquet(path)


@query(
    "explode_envelope",
    over("SELECT k // 100 AS batch, business_id, city, k % 100 AS pos FROM business_core", "business_core"),
)
def explode_envelope(spark, sf):
    rows = fixtures.businesses(spark, sf, False).select(
        F.floor(c("pos") / 100).alias("batch"), F.struct("pos", "business_id", "city").alias("row")
    )
    # envelopes of one hundred rows
    envelopes = rows.groupBy("batch").agg(F.sort_array(F.collect_list("row")).alias("businesses"))
    trimmed = envelopes.withColumn(
        "businesses", F.transform("businesses", lambda r: F.struct(r.business_id.alias("business_id"), r.city.alias("city")))
    )
    return tables.explode_rows(trimmed, "businesses", keep=["batch"])


@query(
    "split_envelope",
    over("SELECT '2024-06-01' AS day, k AS pos, business_id, city, state FROM business_core", "business_core"),
)
def split_envelope(spark, sf):
    """All listings as one envelope of lines, read in parts."""
    rows = fixtures.businesses(spark, sf, False).select("pos", "business_id", "city", "state")
    path = tables.write_envelope(rows, new_path(spark, "envelope"), {"day": "2024-06-01", "total": 1})
    return tables.read_envelope(spark, path, "business_id string, city string, state string", "day string")


@query(
    "stage_summary",
    over(
        "SELECT count(*) AS total, count(*) FILTER (generation_successful) AS successful,"
        " count(*) FILTER (NOT generation_successful) AS failed FROM page_specs",
        "page_specs",
    ),
)
def stage_summary(spark, sf):
    return tables.stage_summary(fixtures.flat_pages(spark, sf), c("generation_successful"))


def _strip(name):
    return rf"regexp_replace({name}, '^\s+|\s+$', '', 'g')"


@query(
    "trim_stringify",
    over(
        f"SELECT business_id, {_strip('name')} AS name, {_strip('address')} AS address, {_strip('description')} AS description FROM businesses",
        "businesses",
    ),
)
def trim_stringify(spark, sf):
    cols = ["business_id", "name", "address", "description"]
    return cleaning.clean_text(fixtures.businesses(spark, sf).select(*cols))


_NULLED = f"CASE WHEN {{0}} IN ({_TOKENS}) THEN NULL ELSE {{0}} END"


@query(
    "null_normalise",
    over(
        "SELECT business_id, " + _NULLED.format("state") + " AS state, "
        + _NULLED.format(_strip("description")) + " AS description FROM businesses",
        "businesses",
    ),
)
def null_normalise(spark, sf):
    return cleaning.nullify(cleaning.clean_text(fixtures.businesses(spark, sf).select("business_id", "state", "description")))


_RAW_NUMBERS = """
SELECT k, business_id,
  CASE WHEN k % 17 = 0 THEN 'four' ELSE CAST(rating AS VARCHAR) END AS rating,
  CASE WHEN k % 19 = 0 THEN 'many' WHEN k % 5 = 0 THEN CAST(review_count AS VARCHAR) || '.75' ELSE CAST(review_count AS VARCHAR) END AS review_count
FROM business_core"""


@query(
    "cast_numeric",
    over(
        "SELECT business_id, TRY_CAST(rating AS DOUBLE) AS rating, CAST(trunc(TRY_CAST(review_count AS DOUBLE)) AS INTEGER) AS review_count,"
        " concat_ws(',', CASE WHEN rating IS NOT NULL AND TRY_CAST(rating AS DOUBLE) IS NULL THEN 'rating' END,"
        " CASE WHEN review_count IS NOT NULL AND TRY_CAST(review_count AS DOUBLE) IS NULL THEN 'review_count' END) AS bad FROM raw",
        "business_core",
        raw=_RAW_NUMBERS,
    ),
)
def cast_numeric(spark, sf):
    k = c("pos")
    raw = fixtures.businesses(spark, sf, False).select(
        "business_id",
        F.when(k % 17 == 0, "four").otherwise(c("rating").cast("string")).alias("rating"),
        F.when(k % 19 == 0, "many")
        .when(k % 5 == 0, F.concat(c("review_count").cast("string"), F.lit(".75")))
        .otherwise(c("review_count").cast("string"))
        .alias("review_count"),
    )
    return cleaning.cast_numeric(raw).select(
        "business_id", "rating", "review_count", F.array_join("bad_numbers", ",").alias("bad")
    )


def _title(name):
    return (
        rf"array_to_string(list_transform(regexp_extract_all({_strip(name)}, '\p{{L}}+|\P{{L}}+'),"
        " lambda x: upper(x[1:1]) || lower(x[2:])), '')"
    )


@query(
    "title_case",
    over(
        "SELECT business_id, " + ", ".join(f"{_title(n)} AS {n}" for n in ("name", "category", "city", "state")) + " FROM business_core",
        "business_core",
    ),
)
def title_case(spark, sf):
    return fixtures.businesses(spark, sf, False).select(
        "business_id", *[text.title_case(c(n)).alias(n) for n in ("name", "category", "city", "state")]
    )


@query("strip_address", over(f"SELECT business_id, {_strip('address')} AS address FROM business_core", "business_core"))
def strip_address(spark, sf):
    return fixtures.businesses(spark, sf, False).select("business_id", text.strip(c("address")).alias("address"))


BUSINESS_RULES = [
    ("name", "name IS NULL OR length(name) NOT BETWEEN 1 AND 200"),
    ("category", "category IS NULL OR length(category) NOT BETWEEN 1 AND 100"),
    ("address", "address IS NULL OR length(address) NOT BETWEEN 5 AND 500"),
    ("city", "city IS NULL OR length(city) NOT BETWEEN 1 AND 100"),
    ("state", "state IS NULL OR length(state) NOT BETWEEN 2 AND 50"),
    ("zip_code", r"zip_code IS NULL OR NOT regexp_full_match(zip_code, '\d{5}(-\d{4})?')"),
    ("website", r"website IS NOT NULL AND NOT regexp_matches(website, '^https?://[^\s/]+')"),
    ("email", r"email IS NOT NULL AND NOT regexp_full_match(email, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}')"),
    ("description", "length(description) > 1000"),
    ("rating", "rating IS NOT NULL AND rating NOT BETWEEN 0 AND 5"),
    ("review_count", "review_count < 0"),
]


def broken_fields(prefix="", mark=","):
    cases = ", ".join(f"CASE WHEN {rule} THEN '{prefix}{name}' END" for name, rule in BUSINESS_RULES)
    return f"concat_ws('{mark}', {cases})"


@query("validate_business", over(f"SELECT business_id, {broken_fields()} AS errors FROM businesses", "businesses"))
def validate_business(spark, sf):
    return cleaning.validate_businesses(fixtures.businesses(spark, sf)).select(
        "business_id", F.array_join("errors", ",").alias("errors")
    )


@query(
    "split_valid",
    over(
        f"SELECT business_id, CASE WHEN e = '' THEN {_title('name')} ELSE name END AS name, e = '' AS accepted"
        f" FROM (SELECT *, {broken_fields()} AS e FROM businesses) t",
        "businesses",
    ),
)
def split_valid(spark, sf):
    checked = cleaning.validate_businesses(fixtures.businesses(spark, sf))
    return cleaning.with_acceptance(checked).select("business_id", "name", "accepted")


@query(
    "error_sample",
    over(
        "SELECT k + 1 AS row_idx, 'Row ' || CAST(k + 1 AS VARCHAR) || ' validation error: ' || e AS message FROM"
        f" (SELECT *, {broken_fields(mark=', ')} AS e FROM businesses) t WHERE e <> '' ORDER BY k LIMIT 10",
        "businesses",
    ),
)
def error_sample(spark, sf):
    rows = fixtures.businesses(spark, sf).withColumn("row_idx", c("pos") + 1)
    _, bad = cleaning.split_valid(cleaning.validate_businesses(rows))
    return cleaning.first_errors(bad)


@query(
    "zip_plus4",
    over(
        "SELECT business_id, CASE WHEN length(zip_code) = 9 AND NOT contains(zip_code, '-') THEN zip_code[1:5] || '-' || zip_code[6:9]"
        " ELSE zip_code END AS zip_code FROM business_core",
        "business_core",
    ),
)
def zip_plus4(spark, sf):
    return fixtures.businesses(spark, sf, False).select("business_id", contact.norm_zip(c("zip_code")).alias("zip_code"))


@query(
    "norm_phone",
    over(
        "SELECT business_id, CASE WHEN length(d) = 10 THEN d[1:3] || '-' || d[4:6] || '-' || d[7:10]"
        " WHEN length(d) = 11 AND d[1:1] = '1' THEN d[2:4] || '-' || d[5:7] || '-' || d[8:11] ELSE phone END AS phone"
        r" FROM (SELECT *, regexp_replace(phone, '\D', '', 'g') AS d FROM business_core) t",
        "business_core",
    ),
)
def norm_phone(spark, sf):
    return fixtures.businesses(spark, sf, False).select("business_id", contact.norm_phone(c("phone")).alias("phone"))


@query(
    "norm_phone_paren",
    over(
        "SELECT business_id, CASE WHEN length(d) = 10 THEN '(' || d[1:3] || ') ' || d[4:6] || '-' || d[7:10] ELSE d END AS phone"
        r" FROM (SELECT *, regexp_replace(phone, '[()\-. ]', '', 'g') AS d FROM business_core) t",
        "business_core",
    ),
)
def norm_phone_paren(spark, sf):
    return fixtures.businesses(spark, sf, False).select(
        "business_id", contact.norm_phone(c("phone"), "paren").alias("phone")
    )


@query(
    "norm_website",
    over(
        "SELECT business_id, CASE WHEN website LIKE 'http://%' OR website LIKE 'https://%' THEN website"
        " ELSE 'https://' || website END AS website FROM business_core",
        "business_core",
    ),
)
def norm_website(spark, sf):
    return fixtures.businesses(spark, sf, False).select("business_id", contact.norm_url(c("website")).alias("website"))


@query(
    "email_filter",
    over(
        r"SELECT business_id, email FROM business_core WHERE regexp_full_match(email, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}')",
        "business_core",
    ),
)
def email_filter(spark, sf):
    return fixtures.businesses(spark, sf, False).where(contact.valid_email(c("email"))).select("business_id", "email")


_COLLAPSED = r"regexp_replace(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')"


@query(
    "collapse_ws",
    over(
        "SELECT page_pos, " + ", ".join(f"{_COLLAPSED.format(n)} AS {n}" for n in ("title", "meta_description", "h1")) + " FROM page_specs",
        "page_specs",
    ),
)
def collapse_ws(spark, sf):
    seo = fixtures.page_specs(spark, sf)
    return seo.select("page_pos", *[text.collapse_ws(c(f"seo.{n}")).alias(n) for n in ("title", "meta_description", "h1")])


@query(
    "clean_keywords",
    over(
        "SELECT page_pos, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS keywords FROM ("
        "SELECT page_pos, list_filter(list_transform(string_split(keyword_csv || ', ,' || upper(keyword_csv) || ' , Local Shop', ','),"
        " lambda x: lower(trim(x))), lambda x: x <> '') AS l FROM page_specs) t",
        "page_specs",
    ),
)
def clean_keywords(spark, sf):
    csv = c("keyword_csv")
    messy = F.split(F.concat(csv, F.lit(", ,"), F.upper(csv), F.lit(" , Local Shop")), ",")
    return fixtures.flat_pages(spark, sf).select(
        "page_pos", F.array_join(text.clean_keywords(messy), ",").alias("keywords")
    )


LINK_CASES = (
    "CASE WHEN n_links > 5 THEN 'too_many_links' END, CASE WHEN n_links > 0 AND length(anchor_text) < 2 THEN 'anchor_text' END,"
    " CASE WHEN n_links > 0 AND self_link THEN 'self_link' END"
)


@query("valid_links", over(f"SELECT page_pos, concat_ws(',', {LINK_CASES}) AS link_errors FROM page_specs", "page_specs"))
def valid_links(spark, sf):
    return cleaning.validate_links(fixtures.page_specs(spark, sf)).select(
        "page_pos", F.array_join("link_errors", ",").alias("link_errors")
    )


SPEC_ERRORS = (
    "concat_ws(',', nullif(" + broken_fields("business.") + ", ''), CASE WHEN NOT has_jsonld OR name IS NULL THEN 'jsonld.name' END,"
    f" CASE WHEN NOT has_jsonld THEN 'jsonld.address' END, {LINK_CASES},"
    " CASE WHEN spec_score NOT BETWEEN 0 AND 1 THEN 'quality_score' END)"
)


@query("valid_page_spec", over(f"SELECT page_pos, {SPEC_ERRORS} AS spec_errors FROM page_specs", "page_specs"))
def valid_page_spec(spark, sf):
    return cleaning.validate_page_specs(fixtures.page_specs(spark, sf)).select(
        "page_pos", F.array_join("spec_errors", ",").alias("spec_errors")
    )


@query(
    "valid_trace",
    over(
        "SELECT event_id, concat_ws(',', CASE WHEN generation_time_ms < 0 THEN 'generation_time_ms' END,"
        " CASE WHEN token_count < 0 THEN 'token_count' END) AS errors_found FROM attempts",
        "attempts",
    ),
)
def valid_trace(spark, sf):
    return cleaning.validate_traces(fixtures.attempts(spark, sf)).select(
        "event_id", F.array_join("errors_found", ",").alias("errors_found")
    )


@query(
    "round_feedback",
    over(
        "SELECT page_pos, round(quality_score, 3) AS quality_score, quality_score BETWEEN 0 AND 1 AS feedback_valid FROM feedback",
        "feedback",
    ),
)
def round_feedback(spark, sf):
    return cleaning.validate_feedback(fixtures.feedback(spark, sf)).select("page_pos", "quality_score", "feedback_valid")


@query(
    "success_rate",
    over(
        "SELECT stage_no, CASE WHEN processed_businesses = 0 THEN 0.0 ELSE round(CAST(successful_pages AS DOUBLE) / processed_businesses, 3)"
        " END AS success_rate FROM status_log",
        "status_log",
    ),
)
def success_rate(spark, sf):
    return cleaning.success_rate(fixtures.status_log(spark, sf)).select("stage_no", "success_rate")
