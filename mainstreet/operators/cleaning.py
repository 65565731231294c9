"""Cleaning and validation of listings, page specs, traces and feedback."""

from pyspark.sql import functions as F

from mainstreet import schemas
from mainstreet.functions import contact, fixed, text

c = F.col


def clean_text(df):
    """Strip every text column."""
    kinds = dict(df.dtypes)
    return df.select(*[text.strip(c(n)).alias(n) if kinds[n] == "string" else c(n) for n in df.columns])


def nullify(df, tokens=fixed.NA_TOKENS):
    """Texts that stand for a missing value become null."""
    kinds = dict(df.dtypes)
    return df.select(
        *[F.when(~c(n).isin(*tokens), c(n)).alias(n) if kinds[n] == "string" else c(n) for n in df.columns]
    )


def cast_numeric(df):
    """Rating as double, review count as integer cut towards zero; ``bad_numbers`` lists texts that are neither."""
    rating = c("rating").try_cast("double")
    reviews = c("review_count").try_cast("double").try_cast("int")
    bad = text.present(
        F.when(c("rating").isNotNull() & rating.isNull(), F.lit("rating")),
        F.when(c("review_count").isNotNull() & reviews.isNull(), F.lit("review_count")),
    )
    return df.withColumns({"bad_numbers": bad, "rating": rating, "review_count": reviews})


def normalise(df):
    """Zip, phone and web address formats."""
    return df.withColumns(
        {
            "zip_code": contact.norm_zip(c("zip_code")),
            "phone": contact.norm_phone(c("phone")),
            "website": contact.norm_url(c("website")),
        }
    )


def business_errors(p=""):
    """Names of the business fields that break a rule, as an array."""

    def f(name):
        return c(f"{p}{name}")

    def outside(name, low, high):
        return F.when(~F.coalesce(F.length(f(name)).between(low, high), F.lit(False)), F.lit(name))

    def broken(name, rule):
        return F.when(f(name).isNotNull() & ~rule, F.lit(name))

    rules = [
        F.when(f("business_id").isNull(), F.lit("business_id")),
        outside("name", 1, 200),
        outside("category", 1, 100),
        outside("address", 5, 500),
        outside("city", 1, 100),
        outside("state", 2, 50),
        F.when(~F.coalesce(f("zip_code").rlike(fixed.ZIP_FORMAT), F.lit(False)), F.lit("zip_code")),
        broken("website", f("website").rlike(r"^https?://[^\s/]+")),
        broken("email", contact.valid_email(f("email"))),
        broken("description", F.length(f("description")) <= 1000),
        broken("rating", f("rating").between(0.0, 5.0)),
        broken("review_count", f("review_count") >= 0),
    ]
    return text.present(*rules)


def validate_businesses(df):
    """Add the broken fields of each row as ``errors``."""
    found = business_errors()
    if "bad_numbers" in df.columns:
        found = F.array_distinct(F.concat(found, "bad_numbers"))
        df = df.withColumn("errors", found).drop("bad_numbers")
        return df
    return df.withColumn("errors", found)


def with_acceptance(df):
    """Add ``accepted``; accepted rows get cased names and plain web addresses, rejected ones stay as they are."""
    ok = F.size("errors") == 0
    cased = {n: text.title_case(c(n)) for n in ("name", "category", "city", "state")}
    kept = {"address": text.strip(c("address")), "website": contact.canonical_url(c("website"))}
    changed = {n: F.when(c("accepted"), value).otherwise(c(n)) for n, value in {**cased, **kept}.items()}
    return df.withColumn("accepted", ok).withColumns(changed)


def split_valid(df):
    """Accepted rows and rejected rows with their errors. Both read ``df``: store it, or use :func:`with_acceptance`."""
    judged = with_acceptance(df)
    return judged.where("accepted").drop("errors", "accepted"), judged.where("NOT accepted").drop("accepted")


def first_errors(bad, n=10):
    """The first ``n`` rejected rows in input order as messages."""
    message = F.concat(
        F.lit("Row "), c("row_idx").cast("string"), F.lit(" validation error: "), F.array_join("errors", ", ")
    )
    return bad.orderBy("row_idx").limit(n).select("row_idx", message.alias("message"))


def link_errors(p=""):
    links = F.coalesce(c(f"{p}internal_links"), F.array().cast(schemas.PAGE_SPEC["internal_links"].dataType))
    own = c(f"{p}business.business_id")
    anchors = F.forall(links, lambda k: F.coalesce(F.length(k.anchor_text).between(2, 100), F.lit(False)))
    to_self = F.exists(links, lambda k: F.coalesce(k.target_business_id == own, F.lit(False)))
    return text.present(
        F.when(F.size(links) > 5, F.lit("too_many_links")),
        F.when(~anchors, F.lit("anchor_text")),
        F.when(to_self, F.lit("self_link")),
    )


def validate_links(df):
    return df.withColumn("link_errors", link_errors())


def page_spec_errors(p=""):
    """Broken parts of a nested page spec as dotted names."""
    required = [
        "seo.title", "seo.meta_description", "seo.h1", "seo.slug",
        "content.introduction", "content.main_content", "content.conclusion", "jsonld.name", "jsonld.address",
    ]
    missing = [F.when(c(f"{p}{n}").isNull(), F.lit(n)) for n in required]
    score = c(f"{p}quality_score")
    return F.concat(
        F.transform(business_errors(f"{p}business."), lambda e: F.concat(F.lit("business."), e)),
        text.present(*missing),
        link_errors(p),
        text.present(F.when(score.isNotNull() & ~score.between(0.0, 1.0), F.lit("quality_score"))),
    )


def validate_page_specs(df):
    return df.withColumn("spec_errors", page_spec_errors())


def validate_traces(df):
    """Negative or missing counters of a trace."""
    return df.withColumn(
        "errors_found",
        text.present(
            F.when(c("business_id").isNull(), F.lit("business_id")),
            F.when(c("model_name").isNull(), F.lit("model_name")),
            F.when(~F.coalesce(c("generation_time_ms") >= 0, F.lit(False)), F.lit("generation_time_ms")),
            F.when(c("token_count") < 0, F.lit("token_count")),
            F.when(c("retry_count") < 0, F.lit("retry_count")),
        ),
    )


def validate_feedback(df):
    """Round the score to three places and mark rows whose score lies outside 0 to 1."""
    score = c("quality_score")
    return df.withColumns(
        {
            "quality_score": F.round(score, 3),
            "feedback_valid": F.coalesce(score.between(0.0, 1.0), F.lit(False)),
        }
    )


def success_rate(df):
    """Share of successful pages in processed ones, three places, 0 when none were processed."""
    share = F.try_divide(c("successful_pages").cast("double"), c("processed_businesses").cast("double"))
    return df.withColumn("success_rate", F.coalesce(F.round(share, 3), F.lit(0.0)))


def ingest(raw):
    """Null, strip, cast, normalise and check raw text rows.

    Missing-value texts are those of whole cells as they stand in the file; after stripping, only
    an empty text and ``nan`` still count as missing.
    """
    return validate_businesses(normalise(cast_numeric(nullify(clean_text(nullify(raw)), ["", "nan"]))))
