"""Model responses, generated pages, attempts, costs and traces."""

from pyspark.sql import functions as F

from mainstreet import schemas
from mainstreet.functions import fixed, scores, text
from mainstreet.operators import answers, cleaning, linking

c = F.col


def parse_responses(df, schema, col="response"):
    """Take the JSON out of a code fence and read it; ``error`` says why there is none."""
    body = text.strip(
        F.regexp_replace(F.regexp_replace(text.strip(c(col)), r"^```json", ""), r"```$", "")
    )
    read = df.withColumn("body", text.clean_control_chars(body))
    parsed = F.from_json("body", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    error = (
        F.when(~F.coalesce(c("body").rlike(r"[}\]]$"), F.lit(False)), "truncated")
        .when(F.try_parse_json("body").isNull(), "not_json")
    )
    return read.withColumn("error", error).withColumn("parsed", F.when(c("error").isNull(), parsed)).drop("body")


def template_page():
    """Stand-in for a model: a plain page from the suggested fields, as a page spec of columns."""

    def shown(name):
        return F.coalesce(c(name).cast("string"), F.lit(""))

    def said(*parts):
        return F.concat(*[F.lit(part) if isinstance(part, str) else part for part in parts])

    name, category = shown("name"), shown("category")
    where = said(shown("city"), ", ", shown("state"))
    intro = said(name, " is a ", category, " business in ", where, ". ")
    about = F.coalesce(
        F.nullif(c("description"), F.lit("")), said("Professional ", F.lower(category), " services in ", where, ".")
    )
    business = F.struct(*[c(f.name).cast(f.dataType).alias(f.name) for f in schemas.BUSINESS.fields])
    seo = F.struct(
        c("suggested_title").alias("title"),
        c("suggested_meta_description").alias("meta_description"),
        c("suggested_h1").alias("h1"),
        c("page_slug").alias("slug"),
        F.lit(None).cast("string").alias("canonical_url"),
        F.split("suggested_keywords", ", ").alias("keywords"),
    )
    content = F.struct(
        said(intro, "You find it at ", shown("address"), ".").alias("introduction"),
        said(intro, about, "\n\nHowever far you travel, ", where, " is the place to visit.").alias("main_content"),
        said("What ", name, " does: ", F.lower(category), ".").alias("services_section"),
        said("Where to find ", name, ": ", shown("address"), ", ", where, ".").alias("location_section"),
        said("Contact ", name, " in ", where, " and ask for an appointment.").alias("conclusion"),
    )
    address = F.create_map(F.lit("streetAddress"), c("address"), F.lit("addressLocality"), c("city"))
    known = {"name": c("name"), "address": address}
    jsonld = F.struct(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.JSONLD.fields])
    links = F.transform(
        "related",
        lambda r: F.struct(
            said("/pages/", r.business_id, ".html").alias("url"), r["name"].alias("anchor_text"), r.business_id.alias("target_business_id")
        ),
    )
    return F.struct(
        business.alias("business"), seo.alias("seo"), content.alias("content"), jsonld.alias("jsonld"),
        links.alias("internal_links"), F.lit(None).cast("timestamp").alias("generated_at"), F.lit(None).cast("double").alias("quality_score"),
    )


def normalised_seo(seo="seo"):
    """The search fields of a page spec as they are kept: single spaces, and clean keywords."""
    part = c(seo)
    clean = {n: text.collapse_ws(part[n]) for n in ("title", "meta_description", "h1")}
    return part.withField("title", clean["title"]).withField("meta_description", clean["meta_description"]).withField(
        "h1", clean["h1"]
    ).withField("keywords", text.clean_keywords(part["keywords"]))


def generate_pages(b, fn=None, callers=None, log=None):
    """A page spec for every business: by ``template_page`` in columns, or by calling ``fn``.

    ``fn`` stands for a model. It gets one row as a dict, with the ``prompt`` of the business, and
    returns JSON text or None; an exception counts as a failure of that row. Batches come through
    Arrow, and all checks of the answers run as columns. ``callers`` is the number of tasks that
    call at the same time; rows are small and calls are slow, so it does not follow the size of the
    input but, unless given, the session's number of shuffle partitions. ``log`` names a folder for
    the answers of this execution; with it, a task or a run that starts again asks nobody a second
    time (see ``answers``).
    """
    ready = b.withColumns(
        {
            "suggested_title": scores.suggested_title(),
            "suggested_meta_description": scores.suggested_meta(),
            "suggested_h1": scores.suggested_h1(),
            "suggested_keywords": scores.suggested_keywords(),
            "page_slug": text.page_slug(c("name"), c("category"), c("city")),
        }
    )
    if "related" not in ready.columns:
        ready = ready.withColumn(
            "related", F.array().cast("array<struct<business_id:string,name:string,category:string,city:string>>")
        )
    if fn is None:
        answered = ready.select("pos", "business_id", F.lit(None).cast("string").alias("problem"), template_page().alias("spec"))
    else:
        callers = callers or int(b.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        said = answers.answers(linking.build_prompts(ready, "full"), fn, callers, log)
        answered = parse_responses(said, schemas.PAGE_SPEC).select("pos", "business_id", "problem", c("parsed").alias("spec"))
    found = answered.select("pos", "business_id", "problem", "spec.*", c("spec").isNotNull().alias("has_spec"))
    found = found.withColumn("seo", F.when(c("seo").isNotNull(), normalised_seo()))
    broken = cleaning.page_spec_errors()
    failure = (
        F.when(~c("has_spec"), F.concat(F.lit("Content generation failed for "), c("business_id")))
        .when(F.size(broken) > 0, F.concat(F.lit("Generated content validation failed: "), F.array_join(broken, ", ")))
    )
    return found.withColumn("failure", failure).select(
        c("pos").alias("page_pos"),
        "business_id",
        c("failure").isNull().alias("generation_successful"),
        c("failure").isNull().alias("has_spec"),
        F.coalesce("problem", "failure").alias("error"),
        *[f.name for f in schemas.PAGE_SPEC.fields],
    )


# Order in which models are tried.
MODEL_ORDER = [name for name, _, _ in fixed.MODEL_PRICES]


def fallback_rollup(attempts, preferred="claude-3-5-sonnet", tries=4):
    """One row per request: the model that answered first, and the cost of all tries up to it.

    ``attempts`` has one row per request and model (request_id, model_name, success, retry_count,
    generation_time_ms, errors). The preferred model comes first, then the fixed order; models
    outside of it are not tried. Repeated rows of a request and model are reduced to one before the
    rows of a request come together, so these are at most as many as there are models.
    """
    order = [preferred] + [m for m in MODEL_ORDER if m != preferred] if preferred in MODEL_ORDER else MODEL_ORDER
    place = F.array_position(F.array(*map(F.lit, order)), c("model_name"))
    one = F.struct(
        "place", "model_name", "success", "retry_count", "generation_time_ms", F.coalesce("errors", F.array().cast("array<string>")).alias("errors")
    )
    grouped = (
        attempts.withColumn("place", place)
        .where(c("place") > 0)
        .groupBy("request_id", "place")
        .agg(F.min(one).alias("one"))
        .groupBy("request_id")
        .agg(
            F.sort_array(F.collect_list("one")).alias("tried"),
            F.min(F.when(c("one.success"), c("place"))).alias("won"),
        )
    )
    used = grouped.withColumn("used", F.filter("tried", lambda t: c("won").isNull() | (t.place <= c("won"))))

    def added(field):
        return F.aggregate("used", F.lit(0).cast("long"), lambda a, t: a + t[field])

    said = F.flatten(
        F.transform(
            "used",
            lambda t: F.concat(
                t.errors,
                F.when(t.success, F.array().cast("array<string>")).otherwise(
                    F.array(F.concat(F.lit("Model "), t.model_name, F.lit(f" failed after {tries} attempts")))
                ),
            ),
        )
    )
    exhausted = F.when(c("won").isNull(), F.array(F.lit("All fallback models exhausted"))).otherwise(
        F.array().cast("array<string>")
    )
    winner = F.get(F.filter("used", lambda t: t.place == c("won")), F.lit(0))["model_name"]
    return used.select(
        "request_id",
        c("won").isNotNull().alias("succeeded"),
        F.coalesce(winner, F.lit(preferred)).alias("model_name"),
        added("retry_count").alias("retry_count"),
        added("generation_time_ms").alias("generation_time_ms"),
        F.concat(said, exhausted).alias("errors"),
    )


def price_table(spark):
    return spark.createDataFrame(fixed.MODEL_PRICES, "model_name string, input_price double, output_price double")


def estimate_cost(df, prices=None):
    """Cost in USD per row from its token counts; 0 for a model without a price."""
    known = price_table(df.sparkSession) if prices is None else prices
    cost = (
        c("input_tokens") / F.lit(1000.0) * c("input_price") + c("output_tokens") / F.lit(1000.0) * c("output_price")
    )
    # one row per model
    return (
        df.join(F.broadcast(known), "model_name", "left")
        .withColumn("cost", F.coalesce(F.round(cost, 6), F.lit(0.0)))
        .drop("input_price", "output_price")
    )


def batch_cost(b, model="claude-3-sonnet"):
    """Cost of a page for every business at typical token counts."""
    price = {name: (i, o) for name, i, o in fixed.MODEL_PRICES}[model]
    tokens_in, tokens_out = fixed.TYPICAL_TOKENS
    each = round(tokens_in / 1000 * price[0] + tokens_out / 1000 * price[1], 6)
    n = F.count(F.lit(1))
    return b.agg(n.alias("businesses"), F.round(n * F.lit(each), 4).alias("total_cost"))


def trace_stats(traces):
    """Runs, errors, time, tokens and retries per model."""
    return traces.groupBy("model_name").agg(
        F.count(F.lit(1)).alias("runs"),
        F.sum(F.coalesce(F.size("errors"), F.lit(0))).alias("error_count"),
        F.avg("generation_time_ms").alias("avg_time_ms"),
        F.sum("token_count").alias("tokens"),
        F.sum("retry_count").alias("retries"),
    )
