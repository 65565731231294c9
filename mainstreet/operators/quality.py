"""Quality control of generated pages: routing, combined scores, metrics and suggestions."""

from pyspark.sql import functions as F

from mainstreet import schemas
from mainstreet.functions import text
from mainstreet.operators import cleaning
from mainstreet.operators.content import seo_compliance
from mainstreet.operators.shuffles import first_rows, fits
from mainstreet.plans.workspace import materialise

c = F.col
_EMPTY = "array<string>"


def _list(col):
    return F.coalesce(col, F.array().cast(_EMPTY))


def qc_dedupe(pages, body=lambda firsts: firsts):
    """``body`` of the first page of each business in input order; ``body`` keeps ``page_pos`` and works row by row.

    The first pages are found on keys alone. If these can be sent to every task, other pages are
    left out before ``body``; otherwise its results are joined, and no text is moved either way.
    """
    firsts = materialise(first_rows(pages.select("business_id", "page_pos"), ["business_id"], [c("page_pos")]))
    if fits(firsts):
        return body(pages.join(F.broadcast(firsts.select("page_pos")), "page_pos", "left_semi"))
    return body(pages).join(firsts.select("page_pos"), "page_pos")


def combine_assessments(feedback, violations):
    """Review feedback joined with rule violations, as a struct.

    Each violation costs 0.1, at most 0.4; the first three become suggestions.
    """
    n = F.size(violations)
    failed = F.concat(_list(feedback["failed_checks"]), F.transform(violations, lambda v: F.concat(F.lit("SEO: "), v)))
    score = F.greatest(F.lit(0.0), F.round(feedback["quality_score"] - F.least(n * F.lit(0.1), F.lit(0.4)), 6))
    advice = F.transform(F.slice(violations, 1, 3), lambda v: F.concat(F.lit("Fix SEO violation: "), v))
    again = (
        F.coalesce(feedback["needs_regeneration"], F.lit(False)) | (score < 0.7) | (n > 2) | (F.size(failed) > 5)
    )
    return F.struct(
        score.alias("quality_score"),
        _list(feedback["passed_checks"]).alias("passed_checks"),
        failed.alias("failed_checks"),
        F.concat(_list(feedback["suggestions"]), advice).alias("suggestions"),
        F.coalesce(feedback["retry_count"], F.lit(0)).alias("retry_count"),
        again.alias("needs_regeneration"),
    )


_JUDGED = ("violations", "spec_errors")


def judged_pages(pages):
    """What the checks and rules say about every page, without its texts; ``qc_route`` takes these rows as pages."""
    found = seo_compliance(pages).withColumn("spec_errors", cleaning.page_spec_errors())
    return found.select(
        "page_pos", "business_id", "generation_successful", "has_spec", "seo_results", "content_results", *_JUDGED
    )


def qc_route(pages, feedback, on=("business_id",)):
    """One quality row per business: reason for failure, or the combined feedback.

    ``pages`` holds generated pages with the page spec as columns, or is their :func:`judged_pages`; ``has_spec``
    is false where the spec is missing. ``feedback`` has one row per ``on``.
    """
    rounded = cleaning.validate_feedback(feedback)
    review = F.struct(*[f.name for f in schemas.FEEDBACK.fields if f.name in feedback.columns]).alias("review")
    reviews = rounded.select(*on, review, "feedback_valid")
    known = list(dict.fromkeys(["page_pos", "business_id", *on]))

    def judged(firsts):
        found = firsts
        if not set(_JUDGED) <= set(pages.columns):
            found = seo_compliance(firsts).withColumn("spec_errors", cleaning.page_spec_errors())
        return found.select(*known, "generation_successful", "has_spec", *_JUDGED)

    first = qc_dedupe(pages, judged)
    # one page per business and one review per page: both sides of the join are free of heavy keys
    joined = first.join(reviews, list(on), "left")
    reason = (
        F.when(~F.coalesce(c("generation_successful"), F.lit(False)), "generation_failed")
        .when(~c("has_spec"), "no_page_spec")
        .when(F.size("spec_errors") > 0, "qc_setup_failed")
        .when(c("review").isNull(), "qc_failed")
        .when(~c("feedback_valid"), "qc_validation_failed")
    )
    routed = joined.withColumn("reason", reason).withColumn("qc_successful", c("reason").isNull())
    combined = F.when(c("qc_successful"), combine_assessments(c("review"), c("violations")))
    return routed.withColumn("quality_feedback", combined).select(
        "page_pos",
        "business_id",
        "qc_successful",
        "reason",
        "quality_feedback",
        F.when(c("qc_successful"), c("violations")).alias("seo_violations"),
        F.when(c("qc_successful"), _again()).alias("needs_regeneration"),
    )


def _again():
    f = c("quality_feedback")
    return (f["quality_score"] < 0.7) | f["needs_regeneration"] | (F.size("violations") > 2)


def needs_regeneration(qc):
    """Successful rows and those of them to generate again."""
    ok = F.count_if("qc_successful")
    again = F.count_if(c("qc_successful") & c("needs_regeneration"))
    return qc.agg(ok.alias("reviewed"), again.alias("regenerate"))


def qc_summary(qc):
    rows, ok = F.count(F.lit(1)), F.count_if("qc_successful")
    return qc.agg(
        rows.alias("total_pages"),
        ok.alias("successful_qc"),
        (rows - ok).alias("failed_qc"),
        F.count_if(F.coalesce(c("needs_regeneration"), F.lit(False))).alias("pages_needing_regeneration"),
    )


def content_metrics(pages):
    """Lengths, counts and the density of every keyword in the main text, in percent."""
    main = F.coalesce(c("content.main_content"), F.lit(""))
    keywords = _list(c("seo.keywords"))
    density = text.keyword_densities(
        F.lower(main),
        text.word_count(main),
        F.array_distinct(keywords),
        lambda k, d: F.struct(k.alias("key"), F.round(d * 100, 2).alias("value")),
    )
    return pages.withColumns(
        {
            "word_count": text.word_count(main),
            "title_length": F.coalesce(F.length("seo.title"), F.lit(0)),
            "meta_length": F.coalesce(F.length("seo.meta_description"), F.lit(0)),
            "h1_length": F.coalesce(F.length("seo.h1"), F.lit(0)),
            "keyword_count": F.size(keywords),
            "keyword_density": F.map_from_entries(density),
            "link_count": F.coalesce(F.size("internal_links"), F.lit(0)),
        }
    )


def improvement_suggestions(k=5):
    """Ordered messages from the columns of :func:`content_metrics`, the first ``k``."""

    def sized(name, low, high, what):
        return (
            F.when(c(name) > high, F.lit(f"Shorten the {what} to {high} characters or less"))
            .when(c(name) < low, F.lit(f"Expand the {what} to at least {low} characters"))
        )

    words = F.concat(
        F.lit("Add approximately "), (F.lit(800) - c("word_count")).cast("string"),
        F.lit(" more words to reach minimum content length"),
    )

    def density(e):
        tail = F.concat(e.key, F.lit("' (currently "), e.value.cast("string"), F.lit("%)"))
        return (
            F.when(e.value > 3.0, F.concat(F.lit("Reduce keyword density for '"), tail))
            .when(e.value < 0.5, F.concat(F.lit("Increase keyword usage for '"), tail))
        )

    links = (
        F.when(c("link_count") == 0, F.lit("Add 1-3 internal links to related pages"))
        .when(c("link_count") > 5, F.lit("Reduce number of internal links to 3-5 maximum"))
    )
    messages = F.concat(
        F.array(
            sized("title_length", 10, 70, "page title"),
            sized("meta_length", 50, 160, "meta description"),
            F.when(c("word_count") < 800, words),
        ),
        F.transform(F.map_entries("keyword_density"), density),
        F.array(links),
    )
    return F.slice(F.array_compact(messages), 1, k)
