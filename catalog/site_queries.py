"""Rendering, sitemaps, reports and the whole run."""

from pyspark.sql import functions as F

from catalog import fixtures
from catalog.ingest_queries import _NULLED, _strip, _title, broken_fields
from catalog.page_queries import CHECKED, CHECKS, JUDGED
from catalog.publish_queries import H1, META, TITLE
from catalog.registry import over, query
from mainstreet import schemas
from mainstreet.functions import contact, fixed
from mainstreet.operators import site
from mainstreet.plans import stages
from mainstreet.plans.workspace import new_path
from mainstreet.sources import tables

c = F.col
_URL = "https://example.com"
_DAY = "2024-06-01"


def _qc_rows(spark, sf):
    """Reviews as quality rows of the business that each page belongs to."""
    owners = fixtures.page_specs(spark, sf).select("page_pos", "business_id")
    reviews = fixtures.feedback(spark, sf).select("page_pos", F.struct("quality_score").alias("quality_feedback"))
    return owners.join(reviews, "page_pos").withColumnRenamed("page_pos", "qc_pos")


def _reviewed(spark, sf):
    return site.join_qc(fixtures.page_specs(spark, sf).drop("quality_score"), _qc_rows(spark, sf))


_LAST = (
    "SELECT business_id, arg_max(f.quality_score, p.page_pos) AS quality_score FROM page_specs p JOIN feedback f"
    " ON f.page_pos = p.page_pos GROUP BY business_id"
)
_SCORED = "SELECT p.*, l.quality_score FROM page_specs p LEFT JOIN last_review l ON l.business_id = p.business_id"


@query(
    "join_qc",
    over("SELECT page_pos, business_id, quality_score FROM scored", "page_specs", "feedback", last_review=_LAST, scored=_SCORED),
)
def join_qc(spark, sf):
    return _reviewed(spark, sf).select("page_pos", "business_id", "quality_score")


@query(
    "render_route",
    over(
        "SELECT page_pos, business_id, reason IS NULL AS render_successful, reason, CASE WHEN reason IS NULL THEN 'pages/' || slug || '.html' END AS html_file,"
        " CASE WHEN reason IS NULL THEN slug END AS slug, CASE WHEN reason IS NULL THEN title END AS title,"
        " CASE WHEN reason IS NULL THEN quality_score END AS quality_score FROM (SELECT *, CASE WHEN NOT generation_successful THEN 'generation_failed'"
        " WHEN NOT has_spec THEN 'no_page_spec' WHEN page_pos % 19 = 0 THEN 'upload_failed' END AS reason FROM scored) t",
        "page_specs", "feedback", last_review=_LAST, scored=_SCORED,
    ),
)
def render_route(spark, sf):
    return site.render_route(_reviewed(spark, sf), uploaded=c("page_pos") % 19 != 0)


def _escaped(value):
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("''", "&#39;")):
        value = f"replace({value}, '{sign}', '{entity}')"
    return value


def _tag(tag, value, attributes=""):
    return f"'<{tag}{attributes}>' || {value} || '</{tag}>'"


def _shown(name):
    return _escaped(f"nullif(CAST({name} AS VARCHAR), '')")


def _link(href, label):
    return f"'<a href=\"' || {href} || '\">' || {label} || '</a>'"


def _encoded(value):
    # form encoding: a space is a plus sign, and an asterisk stays as it is
    return f"replace(replace(replace(url_encode({value}), '%20', '+'), '%2A', '*'), '~', '%7E')"


_OWN = f"'{_URL}/pages/' || slug || '.html'"
_SHARE = {
    "facebook": f"'https://www.facebook.com/sharer/sharer.php?u=' || {_encoded(_OWN)}",
    "twitter": f"'https://twitter.com/intent/tweet?url=' || {_encoded(_OWN)} || '&text=' || {_encoded('title')}",
    "linkedin": f"'https://www.linkedin.com/sharing/share-offsite/?url=' || {_encoded(_OWN)}",
}
_PLACE = f"concat_ws(', ', {_shown('address')}, {_shown('city')}, concat_ws(' ', {_shown('state')}, {_shown('zip_code')}))"
_FULL_STARS = "CAST(greatest(0, least(5, round_even(rating, 0))) AS INT)"
_STARS = f"repeat('★', {_FULL_STARS}) || repeat('☆', 5 - {_FULL_STARS})"
_RATING = (
    f"CASE WHEN rating > 0 THEN {_STARS} || ' ' || CAST(rating AS VARCHAR) || '/5.0'"
    " || CASE WHEN review_count > 0 THEN ' (' || CAST(review_count AS VARCHAR) || ' reviews)' ELSE '' END END"
)
_PHONE, _SITE, _MAIL = _shown("phone"), _shown("website"), _shown("email")
_TEL = f"'tel:' || regexp_replace({_PHONE}, '[ ()-]', '', 'g')"
_CONTACTS = [
    _tag("li", _PLACE, ' class="address"'),
    _tag("li", _link(_TEL, _PHONE)),
    _tag("li", _link(_SITE, _SITE)),
    _tag("li", _link(f"'mailto:' || {_MAIL}", _MAIL)),
    _tag("li", _RATING, ' class="rating"'),
]


def _crumb(name):
    anchor = f"'/#' || replace(lower({name}), ' ', '-')"
    return _link(_escaped(anchor), _escaped(name))


_CRUMBS = ", ".join([_link("'/'", "'Home'"), _crumb("category"), _crumb("city"), _escaped("name")])
_RELATED = _link("'/pages/related.html'", _escaped("anchor_text"))
_LINKS = f"CASE WHEN n_links > 0 THEN array_to_string(list_transform(range(0, n_links), lambda i: {_RELATED}), ' ') END"
_PARAGRAPHS = f"replace('<p>' || replace({_shown('main_content')}, chr(10), '</p><p>') || '</p>', '<p></p>', '')"
_BADGE = (
    "CASE WHEN quality_score <> 0 THEN '<span class=\"badge ' || CASE WHEN quality_score >= 0.8 THEN 'green' WHEN quality_score >= 0.6"
    " THEN 'orange' ELSE 'red' END || '\">Quality: ' || printf('%.1f%%', quality_score * 100) || '</span>' END"
)
_COMMAS = "replace(keyword_csv, ',', ', ')"
_HEAD = [
    _tag("title", _shown("title")),
    f"'<meta name=\"description\" content=\"' || {_shown('meta_description')} || '\">'",
    f"'<meta name=\"keywords\" content=\"' || {_escaped(_COMMAS)} || '\">'",
    f"'<link rel=\"canonical\" href=\"' || {_escaped(_OWN)} || '\">'",
]


def _joined(parts, mark=""):
    return f"concat_ws('{mark}', {', '.join(parts)})"


_BODY = [
    _tag("nav", f"concat_ws(' &gt; ', {_CRUMBS})", ' class="breadcrumbs"'),
    _tag("header", _joined([_tag("h1", _shown("h1")), _BADGE])),
    _tag("h2", _shown("name")),
    _tag("ul", _joined(_CONTACTS)),
    _tag("p", _shown("introduction"), ' class="introduction"'),
    _tag("main", _PARAGRAPHS),
    _tag("section", _shown("services_section"), ' class="services"'),
    _tag("section", _shown("location_section"), ' class="location"'),
    _tag("nav", _LINKS, ' class="related"'),
    _tag("p", _shown("conclusion"), ' class="conclusion"'),
    _tag("footer", _joined([_link(_escaped(v), f"'{n}'") for n, v in _SHARE.items()], " "), ' class="share"'),
]
# The markup without its data script, whose fields are checked by themselves.
_HTML = (
    f"'<!DOCTYPE html><html lang=\"en\"><head><meta charset=\"utf-8\">' || {_joined(_HEAD)}"
    f" || '</head><body>' || {_joined(_BODY)} || '</body></html>'"
)
_SCRIPT = r'<script type="application/ld\+json">(.*)</script></head>'


def _page_rows(html):
    """Markup without its data script, and fields of the script."""
    data = F.nullif(F.regexp_extract(html, _SCRIPT, 1), F.lit(""))
    fields = {"data_name": "name", "data_city": "address.addressLocality", "data_phone": "telephone"}
    return {
        "html": F.regexp_replace(html, _SCRIPT, "</head>"),
        **{name: F.get_json_object(data, f"$.{path}") for name, path in fields.items()},
    }


@query(
    "render_pages",
    over(
        f"SELECT page_pos, {_HTML} AS html, CASE WHEN has_jsonld THEN name END AS data_name, CASE WHEN has_jsonld THEN city END AS data_city,"
        " CASE WHEN has_jsonld THEN phone END AS data_phone FROM scored",
        "page_specs", "feedback", last_review=_LAST, scored=_SCORED,
    ),
)
def render_pages(spark, sf):
    shown = site.render_pages(_reviewed(spark, sf), _URL)
    return shown.select("page_pos", *[v.alias(n) for n, v in _page_rows(c("html")).items()])


@query(
    "sink_text_pages",
    over(
        f"SELECT 'pages/' || slug || '-' || CAST(page_pos AS VARCHAR) || '.html' AS path, {_HTML} AS html FROM scored",
        "page_specs", "feedback", last_review=_LAST, scored=_SCORED,
    ),
)
def sink_text_pages(spark, sf):
    pages = site.render_pages(_reviewed(spark, sf), _URL).select(
        site.page_path(F.concat(c("seo.slug"), F.lit("-"), c("page_pos").cast("string"))).alias("path"), c("html").alias("body")
    )
    path = tables.write_pages(pages, new_path(spark, "html"), buckets=8)
    back = spark.read.text(path).select(F.from_json("value", "path string, body string").alias("page"))
    return back.select("page.path", _page_rows(c("page.body"))["html"].alias("html"))


_MARKUP = {
    "name": "name", "description": "nullif(description, '')", "url": "website", "telephone": "phone", "email": "email",
    "address.streetAddress": "address", "address.addressLocality": "city", "address.addressRegion": "state",
    "address.postalCode": "zip_code", "address.addressCountry": "'US'",
    "aggregateRating.ratingValue": "CASE WHEN rating > 0 THEN CAST(rating AS VARCHAR) END",
    "aggregateRating.reviewCount": "CASE WHEN rating > 0 THEN CAST(coalesce(nullif(review_count, 0), 1) AS VARCHAR) END",
    "aggregateRating.bestRating": "CASE WHEN rating > 0 THEN '5' END", "priceRange": "'$$'",
    "openingHoursSpecification[0].opens": "'09:00'", "openingHoursSpecification[0].closes": "'17:00'",
    "openingHoursSpecification[0].dayOfWeek[4]": "'Friday'",
}
_MARKUP_SQL = ", ".join(f"{value} AS f{i}" for i, value in enumerate(_MARKUP.values()))


@query("jsonld", over(f"SELECT business_id, {_MARKUP_SQL} FROM businesses", "businesses"))
def jsonld(spark, sf):
    made = fixtures.businesses(spark, sf).select("business_id", site.jsonld().alias("jsonld"))
    read = [F.get_json_object("jsonld", f"$.{path}").alias(f"f{i}") for i, path in enumerate(_MARKUP)]
    return made.select("business_id", *read)


@query(
    "breadcrumbs",
    over(
        "SELECT business_id, concat_ws(' > ', 'Home=/', category || '=/#' || replace(lower(category), ' ', '-'),"
        " city || '=/#' || replace(lower(city), ' ', '-'), name) AS crumbs FROM business_core",
        "business_core",
    ),
)
def breadcrumbs(spark, sf):
    shown = F.transform(site.breadcrumbs(), lambda s: F.when(s.link.isNull(), s.label).otherwise(F.concat(s.label, F.lit("="), s.link)))
    return fixtures.businesses(spark, sf, False).select("business_id", F.array_join(shown, " > ").alias("crumbs"))


@query(
    "star_flags",
    over(
        "SELECT business_id, array_to_string(list_transform(range(0, 5), lambda i: CASE WHEN i < round_even(rating, 0) THEN '1' ELSE '0' END), '') AS stars"
        " FROM business_core WHERE rating IS NOT NULL",
        "business_core",
    ),
)
def star_flags(spark, sf):
    rated = fixtures.businesses(spark, sf, False).where(c("rating").isNotNull())
    return rated.select(
        "business_id", F.array_join(F.transform(site.star_flags(c("rating")), lambda on: on.cast("int").cast("string")), "").alias("stars")
    )


@query(
    "tel_link",
    over("SELECT business_id, regexp_replace(phone, '[ ()-]', '', 'g') AS tel FROM business_core", "business_core"),
)
def tel_link(spark, sf):
    return fixtures.businesses(spark, sf, False).select("business_id", contact.tel_link(c("phone")).alias("tel"))


_BASIC = (
    f"SELECT '{_URL}/' AS loc, '{_DAY}' AS lastmod, CAST(NULL AS VARCHAR) AS changefreq, 1.0::DOUBLE AS priority"
    f" UNION ALL SELECT '{_URL}/' || slug, '{_DAY}', NULL, 0.8 FROM rendered WHERE render_successful AND length(slug) > 0"
)


@query("sitemap_basic", over(_BASIC, "rendered"))
def sitemap_basic(spark, sf):
    return site.sitemap_basic(fixtures.rendered(spark, sf), _URL, _DAY)


@query(
    "sitemap_files",
    over(
        "SELECT (rn - 1) // 100 AS file_no, count(*) AS urls, '<?xml version=\"1.0\" encoding=\"UTF-8\"?>' || chr(10)"
        " || '<urlset xmlns=\"http://www.sitemaps.org/schemas/sitemap/0.9\">' || chr(10) || string_agg('<url><loc>' || loc || '</loc><lastmod>'"
        " || lastmod || '</lastmod><priority>' || CAST(priority AS VARCHAR) || '</priority></url>', chr(10) ORDER BY rn) || chr(10) || '</urlset>' AS xml"
        " FROM (SELECT *, row_number() OVER (ORDER BY loc) AS rn FROM (SELECT loc, max(lastmod) AS lastmod, max(priority) AS priority FROM entries GROUP BY loc) e) t"
        " GROUP BY 1",
        "rendered", entries=_BASIC,
    ),
)
def sitemap_files(spark, sf):
    return site.sitemap_files(site.sitemap_basic(fixtures.rendered(spark, sf), _URL, _DAY), per_file=100)


def _keys(kind, name):
    return (
        f"SELECT '{_URL}/{kind}/' || a || '.html', '{_DAY}', 'weekly', 0.7 FROM (SELECT DISTINCT replace(lower({name}), ' ', '-') AS a"
        f" FROM business_core WHERE {name} IS NOT NULL) t"
    )


@query(
    "sitemap_full",
    over(
        f"SELECT '{_URL}' AS loc, '{_DAY}' AS lastmod, 'weekly' AS changefreq, 1.0::DOUBLE AS priority"
        f" UNION ALL SELECT '{_URL}/pages/' || slug || '.html', CASE WHEN page_pos % 5 = 0 THEN '{_DAY}' ELSE"
        " strftime(to_timestamp(1704067200 + page_pos * 3600) AT TIME ZONE 'UTC', '%Y-%m-%d') END, 'monthly', 0.8 FROM page_specs"
        f" UNION ALL {_keys('category', 'category')} UNION ALL {_keys('location', 'city')}"
        f" UNION ALL SELECT '{_URL}/about.html', '{_DAY}', 'monthly', 0.5 UNION ALL SELECT '{_URL}/privacy.html', '{_DAY}', 'yearly', 0.3"
        f" UNION ALL SELECT '{_URL}/terms.html', '{_DAY}', 'yearly', 0.3",
        "page_specs",
    ),
)
def sitemap_full(spark, sf):
    pages = fixtures.page_specs(spark, sf).select(
        c("seo.slug").alias("slug"), F.when(c("page_pos") % 5 != 0, c("generated_at")).alias("generated_at")
    )
    return site.sitemap_full(pages, fixtures.businesses(spark, sf, False), _URL, _DAY)


@query(
    "index_cards",
    over(
        "SELECT page_pos, slug, title, round(nullif(quality_score, 0) * 100, 1) AS score_pct,"
        " (SELECT count(*) FROM rendered WHERE render_successful) AS total_pages FROM rendered WHERE render_successful",
        "rendered",
    ),
)
def index_cards(spark, sf):
    return site.index_cards(fixtures.rendered(spark, sf))


@query(
    "page_meta",
    over(
        "SELECT page_pos, name || ' - ' || category || ' in ' || city || ', ' || state AS page_title,"
        f" '{_URL}/pages/' || slug || '.html' AS canonical, replace(keyword_csv, ',', ', ') AS keywords_text FROM page_specs",
        "page_specs",
    ),
)
def page_meta(spark, sf):
    return site.page_meta(fixtures.page_specs(spark, sf)).select("page_pos", "page_title", "canonical", "keywords_text")


_SHARE_SQL = ", ".join(f"{value} AS share_{name}" for name, value in _SHARE.items())


@query("share_links", over(f"SELECT page_pos, {_SHARE_SQL} FROM page_specs", "page_specs"))
def share_links(spark, sf):
    return site.page_meta(fixtures.page_specs(spark, sf)).select(
        "page_pos", "share_facebook", "share_twitter", "share_linkedin"
    )


# Scores that count in the reports.
_COUNTED = (
    "SELECT *, CASE WHEN render_successful AND quality_score <> 0 THEN quality_score END AS s FROM rendered"
)


@query(
    "site_metadata",
    over(
        "SELECT count(*) AS total_pages, count(*) FILTER (render_successful) AS successful_pages,"
        " count(*) FILTER (NOT render_successful) AS failed_pages, coalesce(round(avg(s), 3), 0) AS average_quality_score,"
        " count(*) FILTER (s >= 0.8) AS high_quality_pages, count(*) FILTER (s >= 0.6 AND s < 0.8) AS medium_quality_pages,"
        " count(*) FILTER (s < 0.6) AS low_quality_pages FROM counted",
        "rendered", counted=_COUNTED,
    ),
)
def site_metadata(spark, sf):
    return site.site_metadata(fixtures.rendered(spark, sf))


@query(
    "page_list",
    over("SELECT business_id, slug, title, html_file, quality_score, render_successful FROM rendered", "rendered"),
)
def page_list(spark, sf):
    return site.page_list(fixtures.rendered(spark, sf))


def _steps(value, ladder):
    cases = " ".join(f"WHEN {value} >= {low} THEN '{message}'" for low, message in ladder[:-1])
    return f"CASE {cases} ELSE '{ladder[-1][1]}' END"


_FIGURES = (
    "SELECT count(s) AS total_pages_analyzed, round(avg(s), 3) AS average_quality, round(max(s), 3) AS highest_quality,"
    " round(min(s), 3) AS lowest_quality, count(*) FILTER (s >= 0.9) AS excellent_90_100,"
    " count(*) FILTER (s >= 0.8 AND s < 0.9) AS good_80_89, count(*) FILTER (s >= 0.7 AND s < 0.8) AS average_70_79,"
    " count(*) FILTER (s >= 0.6 AND s < 0.7) AS below_average_60_69, count(*) FILTER (s < 0.6) AS poor_below_60,"
    " avg(s) AS mean, count(*) AS n, count(*) FILTER (render_successful) AS ok FROM counted"
)
_ADVICE = (
    f"concat_ws(' | ', {_steps('100.0 * ok / n', fixed.SUCCESS_ADVICE)}, CASE WHEN mean < 0.7 THEN '{fixed.LOW_MEAN_ADVICE}' END,"
    " CASE WHEN poor_below_60 > 0 THEN 'Review and potentially regenerate ' || poor_below_60 || ' low-quality pages.' END,"
    f" CASE WHEN n > ok THEN '{fixed.FAILED_ADVICE}' END, " + ", ".join(f"'{m}'" for m in fixed.STANDING_ADVICE) + ")"
)


@query(
    "quality_analysis",
    over(
        f"SELECT * EXCLUDE (mean, n, ok), {_steps('average_quality', fixed.QUALITY_ADVICE)} AS recommendation, CAST(NULL AS VARCHAR) AS message FROM figures",
        "rendered", counted=_COUNTED, figures=_FIGURES,
    ),
)
def quality_analysis(spark, sf):
    return site.quality_analysis(fixtures.rendered(spark, sf))


@query(
    "recommendations",
    over(f"SELECT {_ADVICE} AS recommendations FROM figures", "rendered", counted=_COUNTED, figures=_FIGURES),
)
def recommendations(spark, sf):
    return site.recommendations(fixtures.rendered(spark, sf)).withColumn(
        "recommendations", F.array_join("recommendations", " | ")
    )


@query(
    "execution_report",
    over(
        "SELECT 'run' AS execution_id, CASE WHEN n = ok THEN 'success' WHEN ok > 0 THEN 'partial_success' ELSE 'failed' END AS overall_status,"
        " n AS total_businesses_processed, ok AS successful_pages_generated, n - ok AS failed_page_generations,"
        f" round(100.0 * ok / n, 1) AS success_rate, average_quality, {_ADVICE} AS recommendations FROM figures",
        "rendered", counted=_COUNTED, figures=_FIGURES,
    ),
)
def execution_report(spark, sf):
    return site.execution_report(fixtures.rendered(spark, sf)).withColumns(
        {"average_quality": c("quality_analysis.average_quality"), "recommendations": F.array_join("recommendations", " | ")}
    ).drop("quality_analysis")


# The run in SQL: cells as they are read, cleaned rows, accepted rows, their pages, and the reviews of these.
_CELLS = ", ".join(
    f"nullif(nullif({_strip(_NULLED.format(n))}, ''), 'nan') AS {n}" for n in schemas.BUSINESS_COLUMNS[:-2]
)
_PHONE_10 = (
    "CASE WHEN length(d) = 10 THEN d[1:3] || '-' || d[4:6] || '-' || d[7:10] WHEN length(d) = 11 AND d[1:1] = '1'"
    " THEN d[2:4] || '-' || d[5:7] || '-' || d[8:11] ELSE phone END"
)
_CLEANED = (
    "SELECT * EXCLUDE (zip_code, phone, website, d), CASE WHEN length(zip_code) = 9 AND NOT contains(zip_code, '-')"
    f" THEN zip_code[1:5] || '-' || zip_code[6:9] ELSE zip_code END AS zip_code, {_PHONE_10} AS phone,"
    " CASE WHEN website LIKE 'http://%' OR website LIKE 'https://%' THEN website ELSE 'https://' || website END AS website"
    r" FROM (SELECT *, regexp_replace(phone, '\D', '', 'g') AS d FROM cells) t"
)
_TITLED = ", ".join(f"{_title(n)} AS {n}" for n in ("name", "category", "city", "state"))
_ACCEPTED = (
    f"SELECT * EXCLUDE (name, category, city, state), {_TITLED} FROM cleaned WHERE {broken_fields()} = ''"
)
_WHERE = "city || ', ' || state"
_INTRO = f"name || ' is a ' || category || ' business in ' || {_WHERE} || '. '"
_ONE_SPACE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_RUN_SLUG = (
    r"trim(regexp_replace(regexp_replace(regexp_replace(lower(name || '-' || category || '-' || city), '[^a-z0-9\s-]', '', 'g'),"
    r" '\s+', '-', 'g'), '-+', '-', 'g'), '-')"
)
_RUN_PAGES = (
    f"SELECT *, {_ONE_SPACE.format(TITLE)} AS title, {_ONE_SPACE.format(META)} AS meta_description, {_ONE_SPACE.format(H1)} AS h1,"
    f" CASE WHEN length({_RUN_SLUG}) > 60 THEN left({_RUN_SLUG}, 57) || '...' ELSE {_RUN_SLUG} END AS slug,"
    " lower(category) || ',' || lower(city) || ' ' || lower(category) || ',' || lower(category) || ' in ' || lower(city) || ',local '"
    f" || lower(category) AS keyword_csv, {_INTRO} || 'You find it at ' || address || '.' AS introduction,"
    f" {_INTRO} || coalesce(nullif(description, ''), 'Professional ' || lower(category) || ' services in ' || {_WHERE} || '.') || chr(10)"
    f" || chr(10) || 'However far you travel, ' || {_WHERE} || ' is the place to visit.' AS main_content,"
    f" 'Contact ' || name || ' in ' || {_WHERE} || ' and ask for an appointment.' AS conclusion, TRUE AS has_jsonld,"
    " (SELECT count(*) FROM accepted o WHERE o.business_id <> b.business_id"
    " AND (lower(o.city) = lower(b.city)) <> (lower(o.category) = lower(b.category))) AS n_links FROM accepted b"
)
_SHARE_PASSED = "(" + " + ".join(f"CAST(c_{name} AS INT)" for _, name, _ in CHECKS) + f") / {len(CHECKS)}.0::DOUBLE"


@query(
    "site_run",
    over(
        "SELECT business_id, TRUE AS render_successful, CAST(NULL AS VARCHAR) AS reason, 'pages/' || slug || '.html' AS html_file,"
        f" greatest(0.0, round(round({_SHARE_PASSED}, 3) - least(len(violations) * 0.1::DOUBLE, 0.4::DOUBLE), 6)) AS quality_score FROM judged",
        "businesses",
        cells=f"SELECT {_CELLS}, rating, review_count FROM businesses",
        cleaned=_CLEANED,
        accepted=_ACCEPTED,
        page_specs=_RUN_PAGES,
        checked=CHECKED,
        judged=JUDGED,
    ),
)
def site_run(spark, sf):
    """All stages over the listings; the rendered rows are the result."""
    listings = tables.write_businesses_csv(fixtures.businesses(spark, sf), new_path(spark, "listings"))
    out = stages.run_stages(spark, listings, new_path(spark, "run"), "run-1", day=_DAY, multi_line=True)
    return out["rendered_pages"].select("business_id", "render_successful", "reason", "html_file", "quality_score")
