"""Business and page tables derived from the driver's tables.

Each table is one SQL text that Spark and DuckDB both read, so the two engines start from the
same rows. Every row of the source tables takes part. A sixth of all businesses share one city
and state, and a tenth of all pages share one business, so heavy keys are part of every check.
"""

from pyspark.sql import functions as F

from mainstreet import schemas
from mainstreet.operators.shuffles import lookup

c = F.col

_BUSINESS_FIELDS = """
  'biz_' || lpad(CAST(k AS STRING), 12, '0') AS business_id,
  CASE WHEN k % 29 = 0 THEN NULL WHEN k % 7 = 0 THEN '  shop ' || CAST(k % 97 AS STRING) || ' '
       ELSE 'Mario''s Shop ' || CAST(k % 97 AS STRING) END AS name,
  CASE WHEN k % 31 = 0 THEN NULL WHEN seg = 'AUTOMOBILE' THEN 'Family Restaurant'
       WHEN seg = 'MACHINERY' THEN 'Auto Repair' WHEN seg = 'HOUSEHOLD' THEN 'Retail Store'
       WHEN seg = 'BUILDING' THEN 'Legal Consulting' ELSE 'Furniture' END AS category,
  CASE WHEN k % 41 = 0 THEN NULL WHEN k % 37 = 0 THEN '1 A'
       ELSE CAST(k % 900 + 100 AS STRING) || ' Main Street' END AS address,
  CASE WHEN k % 61 = 0 THEN NULL WHEN k % 3 = 0 THEN 'City 0'
       ELSE 'City ' || CAST(1 + CAST(floor(k / 60) AS BIGINT) AS STRING) END AS city,
  CASE WHEN k % 43 = 0 THEN 'California' WHEN k % 67 = 0 THEN NULL WHEN k % 6 = 0 THEN 'CA'
       WHEN k % 3 = 0 THEN chr(CAST(65 + nation AS INT)) || 'A'
       ELSE chr(CAST(65 + nation % 3 AS INT)) || 'A' END AS state,
  CASE WHEN k % 71 = 0 THEN NULL WHEN k % 53 = 0 THEN lpad(CAST((k * 7919) % 1000000000 AS STRING), 9, '1')
       WHEN k % 47 = 0 THEN '9021'
       WHEN k % 5 = 0 THEN lpad(CAST((k * 7919) % 100000 AS STRING), 5, '0') || '-1234'
       ELSE lpad(CAST((k * 7919) % 100000 AS STRING), 5, '0') END AS zip_code,
  CASE WHEN k % 6 = 0 THEN NULL WHEN k % 6 = 1 THEN '(555) 123-' || lpad(CAST(k % 10000 AS STRING), 4, '0')
       WHEN k % 6 = 2 THEN '1555123' || lpad(CAST(k % 10000 AS STRING), 4, '0')
       WHEN k % 6 = 3 THEN '555.123.' || lpad(CAST(k % 10000 AS STRING), 4, '0') ELSE '555-12' END AS phone,
  CASE WHEN k % 4 = 0 THEN NULL WHEN k % 9 = 0 THEN 'shop' || CAST(k AS STRING) || '.example.com'
       ELSE 'https://shop' || CAST(k AS STRING) || '.example.com' END AS website,
  CASE WHEN k % 5 = 0 THEN NULL WHEN k % 59 = 0 THEN 'not-an-email'
       ELSE 'info@shop' || CAST(k AS STRING) || '.com' END AS email,
  {description} AS description,
  CASE WHEN k % 11 = 0 THEN NULL ELSE 1.0e0 + CAST((k * 13) % 41 AS DOUBLE) / 10.0e0 END AS rating,
  CAST(CASE WHEN k % 13 = 0 THEN NULL ELSE (k * 17) % 300 END AS INT) AS review_count
"""


def business_sql(description=True):
    """Listings: one per customer; the description is the text of the document with the same number."""
    if description:
        source = (
            "SELECT c_custkey AS k, c_mktsegment AS seg, c_nationkey AS nation, d.text AS about "
            "FROM customer LEFT JOIN documents d ON d.doc_id = c_custkey"
        )
    else:
        source = "SELECT c_custkey AS k, c_mktsegment AS seg, c_nationkey AS nation FROM customer"
    description_text = "CASE WHEN k % 8 = 0 THEN NULL ELSE about END" if description else "CAST(NULL AS STRING)"
    fields = _BUSINESS_FIELDS.format(description=description_text)
    return f"SELECT k, {fields} FROM ({source}) s"


_PAGE_FIELDS = """
  x AS page_pos, b.*,
  CASE x % 5
    WHEN 0 THEN coalesce(name, 'Shop') || ' - ' || coalesce(category, 'Service') || ' in ' || coalesce(city, 'Town')
    WHEN 1 THEN upper(coalesce(name, 'Shop')) WHEN 2 THEN substr(text, 1, 9)
    WHEN 3 THEN lower(substr(text, 1, 90)) ELSE substr(text, 1, 50) END AS title,
  CASE WHEN x % 4 = 0 THEN coalesce(name, 'Shop') || ' - Home' ELSE substr(text, 1, 50) END AS h1,
  substr(text, 1, CAST((x * 31) % 220 AS INT)) || CASE WHEN x % 3 = 0 THEN '!' ELSE '' END AS meta_description,
  CASE WHEN x % 6 = 0 THEN 'Bad_Slug' WHEN x % 10 = 1 THEN 'page-' || repeat('long-', 12) || CAST(x AS STRING)
       ELSE 'page-' || replace(lower(coalesce(category, 'none')), ' ', '-') || '-' || CAST(x AS STRING) END AS slug,
  CASE x % 4 WHEN 0 THEN 'the,of,and' WHEN 1 THEN lower(coalesce(category, 'none')) || ',the,zzz'
       WHEN 2 THEN 'the,the,of,in' ELSE 'zzz' END AS keyword_csv,
  CASE WHEN x % 3 = 0 THEN split_part(text, chr(10), 1) ELSE split_part(text, '.', 1) END AS introduction,
  CASE WHEN x % 2 = 0 THEN replace(text, chr(10), chr(10) || chr(10)) || ' However, visit ' || coalesce(name, 'us')
            || ' ' || coalesce(category, '') || ' in ' || coalesce(city, 'town') || '.'
       ELSE text END AS main_content,
  split_part(text, '.', 2) || CASE WHEN x % 4 = 0 THEN split_part(text, '.', 3) ELSE '' END AS conclusion,
  CASE WHEN x % 3 = 0 THEN 'Services & prices of ' || coalesce(name, 'us') END AS services_section,
  CASE WHEN x % 5 = 0 THEN 'Find us in <' || coalesce(city, 'town') || '>' END AS location_section,
  x % 17 <> 0 AS generation_successful,
  x % 23 <> 0 AS has_spec,
  x % 12 <> 0 AS has_jsonld,
  CAST(CASE WHEN x % 3 = 0 THEN 0 WHEN x % 7 = 0 THEN 6 ELSE x % 4 END AS INT) AS n_links,
  x % 11 = 0 AS self_link,
  CASE WHEN x % 13 = 0 THEN 'x' ELSE 'Related shop' END AS anchor_text,
  CASE WHEN x % 19 = 0 THEN NULL WHEN x % 29 = 0 THEN 1.2e0 ELSE CAST((x * 37) % 101 AS DOUBLE) / 100.0e0 END AS spec_score
"""


# Documents with the number of their business.
KEYED_SQL = (
    "SELECT doc_id AS x, text, CASE WHEN doc_id % 10 = 0 THEN CAST(1 AS BIGINT) "
    "ELSE CAST(floor(doc_id / 2) AS BIGINT) END AS bk FROM documents"
)


def page_sql():
    """Pages: one per document, two or more per business; every tenth page belongs to business 1."""
    return f"SELECT {_PAGE_FIELDS} FROM ({KEYED_SQL}) d JOIN (SELECT * FROM business_core) b ON b.k = d.bk"


def rendered_sql():
    """Rendered rows of the pages with scores that include nulls and zeros."""
    return """
SELECT x AS page_pos, 'biz_' || lpad(CAST(x AS STRING), 12, '0') AS business_id,
  (x % 17 <> 0) AND (x % 19 <> 0) AS render_successful,
  CASE WHEN x % 6 = 0 THEN 'slug-' || CAST(x AS STRING) WHEN x % 31 = 0 THEN NULL ELSE 'page-' || CAST(x AS STRING) END AS slug,
  'Title ' || CAST(n_chars AS STRING) AS title,
  'pages/page-' || CAST(x AS STRING) || '.html' AS html_file,
  CASE WHEN x % 13 = 0 THEN NULL WHEN x % 23 = 0 THEN 0.0e0 ELSE CAST((x * 37) % 101 AS DOUBLE) / 100.0e0 END AS quality_score,
  CAST(NULL AS STRING) AS day
FROM (SELECT doc_id AS x, n_chars FROM documents) d"""


def feedback_sql():
    """Reviews from the labels; one row per labelled page, some with a score out of range."""
    return """
SELECT doc_id AS page_pos,
  CASE WHEN doc_id % 9 = 4 THEN 1.5e0
       ELSE (CASE WHEN quality = 1 THEN 0.9567e0 ELSE 0.6123e0 END) - (CASE WHEN toxic = 1 THEN 0.2e0 ELSE 0.0e0 END) END
    AS quality_score,
  'tone,facts' AS passed_csv,
  CASE WHEN quality = 1 THEN 'length' ELSE 'length,depth,links' END AS failed_csv,
  'shorter sentences' AS suggestion_csv,
  toxic = 1 AS needs_regeneration
FROM labels"""


def attempts_sql():
    """Model attempts: four events make one request, one per model."""
    return """
SELECT CAST(floor(event_id / 4) AS BIGINT) AS request_id,
  CASE event_id % 4 WHEN 0 THEN 'claude-3-haiku' WHEN 1 THEN 'claude-3-sonnet' WHEN 2 THEN 'claude-instant'
    ELSE 'claude-3-5-sonnet' END AS model_name,
  event_type IN ('purchase', 'signup') AS success,
  CAST(user_id % 4 AS INT) AS retry_count,
  CAST(floor(value * 10) AS BIGINT) - CASE WHEN event_id % 97 = 0 THEN 10000 ELSE 0 END AS generation_time_ms,
  CAST(CASE WHEN event_id % 5 = 0 THEN NULL ELSE user_id * 7 - CASE WHEN event_id % 89 = 0 THEN 5000 ELSE 0 END END AS BIGINT) AS token_count,
  CASE WHEN event_type = 'error' THEN 'model error ' || CAST(user_id AS STRING) ELSE NULL END AS error_text,
  event_id, 'biz_' || lpad(CAST(user_id AS STRING), 12, '0') AS business_id, ts
FROM events"""


def status_sql():
    """Status log: stages of a run in time order; each user id is one execution."""
    return """
SELECT 'run-' || CAST(user_id AS STRING) AS execution_id, event_type AS stage, CAST(event_id AS BIGINT) AS stage_no,
  ts AS updated_at, CAST(floor(value) AS BIGINT) AS processed_businesses,
  CAST(floor(value * 0.75e0) AS BIGINT) AS successful_pages
FROM events"""


def responses_sql():
    """Model answers: JSON in a code fence, some cut short, some with a control character, some not JSON."""
    return """
SELECT x AS page_pos,
  CASE WHEN x % 7 = 0 THEN substr(body, 1, length(body) - 1) WHEN x % 9 = 0 THEN body || chr(10) || '```'
       WHEN x % 10 = 3 THEN '[not json}' ELSE '```json' || chr(10) || body || chr(10) || '```' END AS response
FROM (SELECT x, '{"slug": "s-' || CAST(x AS STRING) || '", "n":' || CASE WHEN x % 11 = 0 THEN chr(1) ELSE ' ' END
        || CAST(n_chars AS STRING) || ', "title": "T' || chr(9) || lang || '"}' AS body
      FROM (SELECT doc_id AS x, n_chars, lang FROM documents) d) r"""


def _views(spark, sf_dir, *names):
    """Name source tables."""
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def businesses(spark, sf_dir, description=True):
    """Listings with their input position; leave out the description where a query has no use for it."""
    _views(spark, sf_dir, "customer", *(["documents"] if description else []))
    return spark.sql(business_sql(description)).withColumn("pos", c("k")).drop("k")


def _divided(pages, documents):
    """Pages dealt out by their number to at least as many tasks as can run, and to four for each part of the documents' scan.

    One task reads a whole row group, so the texts of a small file would all be worked on by one core; of a larger
    table, a join leaves little more than one task per core, the last of which the others would wait for.
    """
    cores, parts = documents.sparkSession.sparkContext.defaultParallelism, documents.rdd.getNumPartitions()
    return pages.repartition(max(cores, 4 * parts), "x")


def flat_pages(spark, sf_dir):
    _views(spark, sf_dir, "customer", "documents")
    spark.sql(business_sql(False)).createOrReplaceTempView("business_core")
    # ``page_sql`` with its join made by a lookup, since one business may hold much of all pages
    core = spark.table("business_core")
    found = lookup(spark.sql(KEYED_SQL), core.withColumn("bk", c("k")), ["bk"], spread=["x"]).where("k IS NOT NULL")
    _divided(found, spark.table("documents")).createOrReplaceTempView("page_businesses")
    fields = _PAGE_FIELDS.replace("b.*", ", ".join(f"b.{n}" for n in core.columns))
    return spark.sql(f"SELECT {fields} FROM page_businesses b").drop("k")


def page_specs(spark, sf_dir):
    """Pages with the nested parts of a page spec."""
    flat = flat_pages(spark, sf_dir)
    business = F.struct(*[c(n) for n in schemas.BUSINESS_COLUMNS])
    seo = F.struct(
        "title", "meta_description", "h1", "slug", F.lit(None).cast("string").alias("canonical_url"),
        F.split("keyword_csv", ",").alias("keywords"),
    )
    content = F.struct(
        "introduction", "main_content", "services_section", "location_section", "conclusion",
    )
    none = F.lit(None).cast("string")
    markup = F.struct(
        F.lit("https://schema.org").alias("@context"), F.lit("LocalBusiness").alias("@type"), "name",
        none.alias("description"), F.create_map(F.lit("addressLocality"), c("city")).alias("address"),
        c("phone").alias("telephone"), c("website").alias("url"), c("email"), none.alias("priceRange"),
        F.lit(None).cast(schemas.RATING_BLOCK).alias("aggregateRating"),
    )
    link = F.struct(
        F.lit("/pages/related.html").alias("url"),
        c("anchor_text"),
        F.when(c("self_link"), c("business_id")).otherwise(F.lit("biz_other")).alias("target_business_id"),
    )
    return flat.select(
        "page_pos",
        "business_id",
        "generation_successful",
        "has_spec",
        business.alias("business"),
        seo.alias("seo"),
        content.alias("content"),
        F.when(c("has_jsonld"), markup).alias("jsonld"),
        F.array_repeat(link, c("n_links")).alias("internal_links"),
        F.timestamp_seconds(F.lit(1704067200) + c("page_pos") * 3600).alias("generated_at"),
        c("spec_score").alias("quality_score"),
    )


def _table(spark, sf_dir, source, sql):
    _views(spark, sf_dir, source)
    return spark.sql(sql)


def rendered(spark, sf_dir):
    return _table(spark, sf_dir, "documents", rendered_sql()).drop("day")


def _csv(name):
    return F.split(c(name), ",")


def feedback(spark, sf_dir):
    return _table(spark, sf_dir, "labels", feedback_sql()).select(
        "page_pos",
        "quality_score",
        _csv("passed_csv").alias("passed_checks"),
        _csv("failed_csv").alias("failed_checks"),
        _csv("suggestion_csv").alias("suggestions"),
        F.lit(0).alias("retry_count"),
        "needs_regeneration",
    )


def attempts(spark, sf_dir):
    return _table(spark, sf_dir, "events", attempts_sql()).withColumn(
        "errors", F.array_compact(F.array("error_text"))
    )


def status_log(spark, sf_dir):
    return _table(spark, sf_dir, "events", status_sql())


def raw_responses(spark, sf_dir):
    return _table(spark, sf_dir, "documents", responses_sql())
