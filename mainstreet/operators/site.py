"""Page markup, sitemaps, index cards and site reports."""

from pyspark.sql import functions as F

from mainstreet.functions import contact, fixed, scores, text
from mainstreet.operators.shuffles import global_rank, lookup

c = F.col


def join_qc(pages, qc):
    """Add the quality score of the last review of each business."""
    last = qc.groupBy("business_id").agg(F.max_by("quality_feedback.quality_score", "qc_pos").alias("quality_score"))
    return lookup(pages, last, ["business_id"], ["page_pos"])


def render_route(pages, uploaded=None):
    """Rendered rows with the reason for those that are not; counts follow from them.

    ``uploaded`` is a boolean column that tells whether a page could be stored.
    """
    stored = F.lit(True) if uploaded is None else F.coalesce(uploaded, F.lit(False))
    reason = (
        F.when(~F.coalesce(c("generation_successful"), F.lit(False)), "generation_failed")
        .when(~c("has_spec"), "no_page_spec")
        .when(c("seo.slug").isNull(), "render_error")
        .when(~stored, "upload_failed")
    )
    ok = c("reason").isNull()
    return pages.withColumn("reason", reason).select(
        "page_pos",
        "business_id",
        ok.alias("render_successful"),
        "reason",
        F.when(ok, page_path(c("seo.slug"))).alias("html_file"),
        F.when(ok, c("seo.slug")).alias("slug"),
        F.when(ok, c("seo.title")).alias("title"),
        F.when(ok, c("quality_score")).alias("quality_score"),
    )


def page_path(slug):
    return F.concat(F.lit("pages/"), slug, F.lit(".html"))


def _element(tag, body, attributes=""):
    """Markup around ``body``; nothing when ``body`` is null."""
    return F.concat(F.lit(f"<{tag}{attributes}>"), body, F.lit(f"</{tag}>"))


def _safe(name):
    return text.escape_html(F.nullif(c(name).cast("string"), F.lit("")))


def quality_badge(score):
    """Badge text and colour; no badge without a score."""
    colour = scores.label([(score >= 0.8, "green"), (score >= 0.6, "orange")], "red")
    return F.when(
        score != 0,
        F.concat(
            F.lit('<span class="badge '), colour, F.lit('">Quality: '),
            F.format_string("%.1f%%", score * 100), F.lit("</span>"),
        ),
    )


def _canonical(base_url, p=""):
    """The page's own address, unless another one is given."""
    own = F.concat(F.lit(f"{base_url}/"), page_path(c(f"{p}seo.slug")))
    return F.coalesce(F.nullif(c(f"{p}seo.canonical_url"), F.lit("")), own)


def _share_links(base_url, p=""):
    """Addresses that share the page, by service."""
    link = F.url_encode(F.concat(F.lit(f"{base_url}/"), page_path(c(f"{p}seo.slug"))))
    title = F.url_encode(c(f"{p}seo.title"))
    return {
        "facebook": F.concat(F.lit("https://www.facebook.com/sharer/sharer.php?u="), link),
        "twitter": F.concat(F.lit("https://twitter.com/intent/tweet?url="), link, F.lit("&text="), title),
        "linkedin": F.concat(F.lit("https://www.linkedin.com/sharing/share-offsite/?url="), link),
    }


def _link(href, label):
    return F.concat(F.lit('<a href="'), href, F.lit('">'), label, F.lit("</a>"))


def _crumb_trail(b):
    """Home, category, city and the business itself as links."""

    def shown(crumb):
        label = text.escape_html(crumb["label"])
        return F.coalesce(_link(text.escape_html(crumb["link"]), label), label)

    return F.array_join(F.array_compact(F.transform(breadcrumbs(b), shown)), " &gt; ")


def page_html(p="", base_url="https://example.com"):
    """The whole page as one text; parts without a value are left out."""
    b = f"{p}business."
    place = F.concat_ws(", ", _safe(f"{b}address"), _safe(f"{b}city"), F.concat_ws(" ", _safe(f"{b}state"), _safe(f"{b}zip_code")))
    site, mail, phone = _safe(f"{b}website"), _safe(f"{b}email"), _safe(f"{b}phone")
    reviews = F.when(c(f"{b}review_count") > 0, F.concat(F.lit(" ("), c(f"{b}review_count").cast("string"), F.lit(" reviews)")))
    rating = F.when(
        c(f"{b}rating") > 0,
        F.concat(c(f"{b}rating").cast("string"), F.lit("/5.0"), F.coalesce(reviews, F.lit(""))),
    )
    stars = F.array_join(F.transform(star_flags(c(f"{b}rating")), lambda on: F.when(on, "\u2605").otherwise("\u2606")), "")
    contact_rows = F.concat_ws(
        "",
        _element("li", place, ' class="address"'),
        _element("li", F.concat(F.lit('<a href="tel:'), contact.tel_link(phone), F.lit('">'), phone, F.lit("</a>"))),
        _element("li", F.concat(F.lit('<a href="'), site, F.lit('">'), site, F.lit("</a>"))),
        _element("li", F.concat(F.lit('<a href="mailto:'), mail, F.lit('">'), mail, F.lit("</a>"))),
        _element("li", F.concat(stars, F.lit(" "), rating), ' class="rating"'),
    )
    shared = F.concat_ws(
        " ", *[_link(text.escape_html(href), F.lit(name)) for name, href in _share_links(base_url, p).items()]
    )
    paragraphs = F.replace(
        F.concat(F.lit("<p>"), F.replace(_safe(f"{p}content.main_content"), F.lit("\n"), F.lit("</p><p>")), F.lit("</p>")),
        F.lit("<p></p>"),
        F.lit(""),
    )
    links = F.array_join(
        F.transform(
            F.coalesce(c(f"{p}internal_links"), F.array().cast("array<struct<url:string,anchor_text:string,target_business_id:string>>")),
            lambda k: F.concat(
                F.lit('<a href="'), text.escape_html(k.url), F.lit('">'), text.escape_html(k.anchor_text), F.lit("</a>")
            ),
        ),
        " ",
    )
    head = F.concat_ws(
        "",
        _element("title", _safe(f"{p}seo.title")),
        F.concat(F.lit('<meta name="description" content="'), _safe(f"{p}seo.meta_description"), F.lit('">')),
        F.concat(F.lit('<meta name="keywords" content="'), text.escape_html(F.array_join(f"{p}seo.keywords", ", ")), F.lit('">')),
        F.concat(F.lit('<link rel="canonical" href="'), text.escape_html(_canonical(base_url, p)), F.lit('">')),
        # a closing tag inside the data must not end the script
        _element(
            "script", F.replace(F.to_json(f"{p}jsonld"), F.lit("</"), F.lit("<\\/")), ' type="application/ld+json"'
        ),
    )
    body = F.concat_ws(
        "",
        _element("nav", _crumb_trail(b), ' class="breadcrumbs"'),
        _element("header", F.concat_ws("", _element("h1", _safe(f"{p}seo.h1")), quality_badge(c(f"{p}quality_score")))),
        _element("h2", _safe(f"{b}name")),
        _element("ul", contact_rows),
        _element("p", _safe(f"{p}content.introduction"), ' class="introduction"'),
        _element("main", paragraphs),
        _element("section", _safe(f"{p}content.services_section"), ' class="services"'),
        _element("section", _safe(f"{p}content.location_section"), ' class="location"'),
        _element("nav", F.nullif(links, F.lit("")), ' class="related"'),
        _element("p", _safe(f"{p}content.conclusion"), ' class="conclusion"'),
        _element("footer", F.nullif(shared, F.lit("")), ' class="share"'),
    )
    return F.concat(F.lit('<!DOCTYPE html><html lang="en"><head><meta charset="utf-8">'), head, F.lit("</head><body>"), body, F.lit("</body></html>"))


def render_pages(pages, base_url="https://example.com"):
    return pages.withColumn("html", page_html(base_url=base_url))


def jsonld(meta=None):
    """schema.org text of a business; fields without a value are left out, reviews default to 1."""
    fallback = F.lit(None).cast("string") if meta is None else meta
    address = F.struct(
        F.lit("PostalAddress").alias("@type"),
        c("address").alias("streetAddress"),
        c("city").alias("addressLocality"),
        c("state").alias("addressRegion"),
        c("zip_code").alias("postalCode"),
        F.lit("US").alias("addressCountry"),
    )
    reviews = F.coalesce(F.nullif(c("review_count"), F.lit(0)), F.lit(1)).cast("string")
    rating = F.when(
        c("rating") > 0,
        F.struct(
            F.lit("AggregateRating").alias("@type"),
            c("rating").cast("string").alias("ratingValue"),
            reviews.alias("reviewCount"),
            F.lit("5").alias("bestRating"),
            F.lit("1").alias("worstRating"),
        ),
    )
    hours = F.struct(
        F.lit("OpeningHoursSpecification").alias("@type"),
        F.array(*map(F.lit, ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday"])).alias("dayOfWeek"),
        F.lit("09:00").alias("opens"),
        F.lit("17:00").alias("closes"),
    )
    return F.to_json(
        F.struct(
            F.lit("https://schema.org").alias("@context"),
            F.lit("LocalBusiness").alias("@type"),
            c("name").alias("name"),
            F.coalesce(F.nullif(c("description"), F.lit("")), fallback).alias("description"),
            c("website").alias("url"),
            c("phone").alias("telephone"),
            c("email").alias("email"),
            address.alias("address"),
            rating.alias("aggregateRating"),
            F.lit("$$").alias("priceRange"),
            F.array(hours).alias("openingHoursSpecification"),
        )
    )


def breadcrumbs(p=""):
    """Home, category, city and the business itself, each with its link."""

    def crumb(label, link):
        return F.struct(label.alias("label"), link.alias("link"))

    def section(name):
        return crumb(c(f"{p}{name}"), F.concat(F.lit("/#"), text.anchor(c(f"{p}{name}"))))

    return F.array(
        crumb(F.lit("Home"), F.lit("/")), section("category"), section("city"), crumb(c(f"{p}name"), F.lit(None).cast("string"))
    )


def star_flags(rating):
    """Five flags, set below the rounded rating; halves go to the even number."""
    return F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: i < F.bround(rating, 0))


def _entries(df, loc, day, freq, priority):
    return df.select(
        loc.alias("loc"), day.cast("string").alias("lastmod"), F.lit(freq).cast("string").alias("changefreq"),
        F.lit(priority).alias("priority"),
    )


def sitemap_basic(rendered, base_url, day):
    """Home page and every rendered page with a slug."""
    home = rendered.sparkSession.range(1)
    shown = rendered.where(c("render_successful") & (F.length("slug") > 0))
    return _entries(home, F.lit(f"{base_url}/"), F.lit(day), None, 1.0).unionAll(
        _entries(shown, F.concat(F.lit(f"{base_url}/"), c("slug")), F.lit(day), None, 0.8)
    )


def sitemap_full(pages, b, base_url, day):
    """Home, pages, distinct categories and locations, and static pages."""
    spark = pages.sparkSession
    today = F.lit(day)
    written = F.coalesce(F.date_format("generated_at", "yyyy-MM-dd"), today)
    parts = [
        _entries(spark.range(1), F.lit(base_url), today, "weekly", 1.0),
        _entries(pages, F.concat(F.lit(f"{base_url}/"), page_path(c("slug"))), written, "monthly", 0.8),
    ]
    for kind, name in (("category", "category"), ("location", "city")):
        keys = b.where(c(name).isNotNull()).select(text.anchor(c(name)).alias("key")).distinct()
        parts.append(_entries(keys, F.concat(F.lit(f"{base_url}/{kind}/"), c("key"), F.lit(".html")), today, "weekly", 0.7))
    # Static pages with their change frequency and priority.
    for name, freq, priority in (("about", "monthly", 0.5), ("privacy", "yearly", 0.3), ("terms", "yearly", 0.3)):
        parts.append(_entries(spark.range(1), F.lit(f"{base_url}/{name}.html"), today, freq, priority))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def sitemap_files(entries, per_file=50000):
    """Sitemap documents of at most ``per_file`` addresses each, in order of address."""
    unique = entries.groupBy("loc").agg(F.max_by(F.struct("lastmod", "changefreq", "priority"), "priority").alias("e"))
    ranked = global_rank(unique.select("loc", "e.*"), [c("loc")], "n")

    def tag(name, value):
        return _element(name, text.escape_html(value.cast("string")))

    url = F.concat_ws("", F.lit("<url>"), tag("loc", c("loc")), tag("lastmod", c("lastmod")),
                      tag("changefreq", c("changefreq")), tag("priority", c("priority")), F.lit("</url>"))
    body = F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct("n", "url"))), lambda e: e.url), "\n"
    )
    return (
        ranked.withColumn("url", url)
        .groupBy(F.floor((c("n") - 1) / F.lit(per_file)).alias("file_no"))
        .agg(
            scores.n_rows().alias("urls"),
            F.concat(
                F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n'),
                body,
                F.lit("\n</urlset>"),
            ).alias("xml"),
        )
    )


def index_cards(rendered):
    """Rendered pages with their score in percent, and how many there are."""
    shown = rendered.where("render_successful")
    return shown.select(
        "page_pos",
        "slug",
        "title",
        F.round(F.nullif(c("quality_score"), F.lit(0.0)) * 100, 1).alias("score_pct"),
        shown.agg(scores.n_rows()).scalar().alias("total_pages"),
    )


def page_meta(pages, base_url="https://example.com"):
    """Page title, canonical address, keyword text and share links."""
    b = {n: c(f"business.{n}") for n in ("name", "category", "city", "state")}
    return pages.select(
        "page_pos",
        F.concat(b["name"], F.lit(" - "), b["category"], F.lit(" in "), b["city"], F.lit(", "), b["state"]).alias("page_title"),
        _canonical(base_url).alias("canonical"),
        F.array_join("seo.keywords", ", ").alias("keywords_text"),
        *[link.alias(f"share_{name}") for name, link in _share_links(base_url).items()],
    )


def _score():
    """Scores that count: of successful pages, without nulls and zeros."""
    return F.when(c("render_successful") & (c("quality_score") != 0), c("quality_score"))


def _totals():
    ok = F.count_if("render_successful")
    return scores.n_rows(), ok, scores.n_rows() - ok


def site_metadata(rendered):
    s = _score()
    rows, ok, failed = _totals()
    return rendered.agg(
        rows.alias("total_pages"),
        ok.alias("successful_pages"),
        failed.alias("failed_pages"),
        F.coalesce(F.round(F.avg(s), 3), F.lit(0.0)).alias("average_quality_score"),
        F.count_if(s >= 0.8).alias("high_quality_pages"),
        F.count_if((s >= 0.6) & (s < 0.8)).alias("medium_quality_pages"),
        F.count_if(s < 0.6).alias("low_quality_pages"),
    )


def page_list(rendered):
    return rendered.select("business_id", "slug", "title", "html_file", "quality_score", "render_successful")


def _step_text(value, ladder):
    out = F
    for low, message in ladder[:-1]:
        out = out.when(value >= low, F.lit(message))
    return out.otherwise(F.lit(ladder[-1][1]))


# Score bands of the report.
_BANDS = [
    ("excellent_90_100", 0.9, float("inf")),
    ("good_80_89", 0.8, 0.9),
    ("average_70_79", 0.7, 0.8),
    ("below_average_60_69", 0.6, 0.7),
    ("poor_below_60", float("-inf"), 0.6),
]


def _figures(rendered):
    """All figures of the reports in one pass."""
    s = _score()
    rows, ok, failed = _totals()
    return rendered.agg(
        rows.alias("rows"),
        ok.alias("ok"),
        failed.alias("failed"),
        F.count(s).alias("total_pages_analyzed"),
        F.avg(s).alias("mean"),
        F.round(F.avg(s), 3).alias("average_quality"),
        F.round(F.max(s), 3).alias("highest_quality"),
        F.round(F.min(s), 3).alias("lowest_quality"),
        *[F.count_if((s >= low) & (s < high)).alias(name) for name, low, high in _BANDS],
    )


def _analysis():
    some = c("total_pages_analyzed") > 0
    return [
        c("total_pages_analyzed"),
        c("average_quality"),
        c("highest_quality"),
        c("lowest_quality"),
        *[c(name) for name, _, _ in _BANDS],
        F.when(some, _step_text(c("average_quality"), fixed.QUALITY_ADVICE)).alias("recommendation"),
        F.when(~some, F.lit(fixed.NO_SCORES_MESSAGE)).alias("message"),
    ]


def _advice():
    low = F.concat(
        F.lit("Review and potentially regenerate "), c("poor_below_60").cast("string"), F.lit(" low-quality pages.")
    )
    return text.present(
        _step_text(_rate(), fixed.SUCCESS_ADVICE),
        F.when(c("mean") < 0.7, F.lit(fixed.LOW_MEAN_ADVICE)),
        F.when(c("poor_below_60") > 0, low),
        F.when(c("failed") > 0, F.lit(fixed.FAILED_ADVICE)),
        *map(F.lit, fixed.STANDING_ADVICE),
    )


def _rate():
    return F.coalesce(F.try_divide(c("ok") * F.lit(100.0), c("rows")), F.lit(0.0))


def quality_analysis(rendered):
    """Counts, range and bands of the scores with one piece of advice; a message when there are none."""
    return _figures(rendered).select(*_analysis())


def recommendations(rendered):
    """Ordered advice from success rate, mean score, low scores and failures."""
    return _figures(rendered).select(_advice().alias("recommendations"))


def execution_report(rendered, execution_id="run"):
    """One row: status, counts and success rate with the quality analysis and the advice inside."""
    status = scores.label([(c("failed") == 0, "success"), (c("ok") > 0, "partial_success")], "failed")
    return _figures(rendered).select(
        F.lit(execution_id).alias("execution_id"),
        status.alias("overall_status"),
        c("rows").alias("total_businesses_processed"),
        c("ok").alias("successful_pages_generated"),
        c("failed").alias("failed_page_generations"),
        F.round(_rate(), 1).alias("success_rate"),
        F.struct(*_analysis()).alias("quality_analysis"),
        _advice().alias("recommendations"),
    )
