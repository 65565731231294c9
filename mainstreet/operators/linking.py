"""Related links between businesses, category guidance and prompt texts."""

from pyspark.sql import functions as F

from mainstreet.functions import fixed, scores, text
from mainstreet.operators.shuffles import first_rows, lookup

c = F.col
_PARTS = ("pos", "business_id", "name", "category", "city")


def _folded(b):
    return b.withColumns({"_city": F.lower("city"), "_cat": F.lower("category")})


def _member():
    return F.struct(*_PARTS, "_city", "_cat").alias("m")


def _picked(pool, k):
    """First ``k`` members of ``pool`` that share either the city or the category, but not both."""

    def either(m):
        return (m.business_id != c("business_id")) & ((m._city == c("_city")) != (m._cat == c("_cat")))

    chosen = F.slice(F.filter(pool, lambda m: F.coalesce(either(m), F.lit(False))), 1, k)
    return F.transform(chosen, lambda m: F.struct(*[m[n].alias(n) for n in _PARTS if n != "pos"]))


def related_links(b, pool=None, k=3):
    """Up to ``k`` related businesses per row, in input order, from the whole table.

    Per city, three rows of each category and six in all are enough to leave ``k`` of another
    category, and likewise per category, so the tables that are looked up stay at six entries per
    key. ``pool`` limits the choice to that many first rows of the input, as one small array.
    """
    rows = _folded(b)
    if pool is not None:
        # `pool` rows in one array
        members = rows.orderBy("pos").limit(pool).select(_member()).agg(F.sort_array(F.collect_list("m"))).scalar()
        return rows.withColumn("_pool", members).withColumn("related", _picked(c("_pool"), k)).drop(
            "_pool", "_city", "_cat"
        )

    def nearest(key, other):
        few = first_rows(rows.where(c(key).isNotNull() & c(other).isNotNull()), [key, other], [c("pos")], k)
        few = first_rows(few, [key], [c("pos")], 2 * k)
        return few.groupBy(key).agg(F.sort_array(F.collect_list(_member())).alias(f"_near{key}"))

    near = lookup(rows, nearest("_city", "_cat"), ["_city"], ["business_id"])
    near = lookup(near, nearest("_cat", "_city"), ["_cat"], ["business_id"])
    empty = F.array().cast(near.schema["_near_city"].dataType)
    both = F.sort_array(F.concat(F.coalesce("_near_city", empty), F.coalesce("_near_cat", empty)))
    return near.withColumn("_pool", both).withColumn("related", _picked(c("_pool"), k)).drop(
        "_pool", "_near_city", "_near_cat", "_city", "_cat"
    )


def category_context(df):
    """Focus areas and keywords of the category; the guidance is a five-row table."""
    guidance = df.sparkSession.createDataFrame(
        fixed.CATEGORY_GUIDANCE, "context_key string, focus_areas array<string>, context_keywords array<string>"
    )
    keyed = df.withColumn("context_key", scores.context_key(c("category")))
    return keyed.join(F.broadcast(guidance), "context_key", "left")


def _shown(name):
    return F.coalesce(c(name).cast("string"), F.lit(""))


def _lines(*parts):
    return F.concat_ws("\n", *parts)


def _pair(title, *values):
    return F.concat(F.lit(f"{title}: "), *values)


def build_prompts(df, style="compact", related=5):
    """Generation prompt per business; ``full`` adds the description, related businesses and page limits."""
    place = F.concat(_shown("city"), F.lit(", "), _shown("state"))
    phone = F.coalesce(F.nullif(c("phone"), F.lit("")), F.concat(_shown("zip_code"), F.lit("123")))
    head = [
        _pair("Write a web page about", _shown("name"), F.lit(" in "), place),
        _pair("Id", _shown("business_id")),
        _pair("Trade", _shown("category")),
        _pair("Address", _shown("address"), F.lit(", "), place, F.lit(" "), _shown("zip_code")),
        _pair("Phone", phone),
        _pair("Website", F.coalesce(F.nullif(c("website"), F.lit("")), F.lit("https://example.com"))),
    ]
    if style == "full":
        about = F.coalesce(
            F.nullif(c("description"), F.lit("")),
            F.concat(F.lit("Professional "), F.lower(_shown("category")), F.lit(" services")),
        )
        head.append(_pair("About", about))
        if "related" in df.columns:
            listed = F.transform(
                F.slice("related", 1, related),
                lambda m: F.concat(F.lit("* "), m["name"], F.lit(" ("), m["category"], F.lit("), id "), m["business_id"]),
            )
            head.append(F.when(F.size("related") > 0, _lines(F.lit("Link to some of:"), F.array_join(listed, "\n"))))
        head.append(
            F.lit(
                "Limits: title 10-70, description 50-160, heading 10-70 characters; 800 words or more of main text."
            )
        )
    head.append(
        F.lit("Answer with one JSON object: business, seo, content, jsonld, internal_links. No other text.")
    )
    return df.withColumn("prompt", _lines(*head))


def build_qc_prompts(pages, style="compact", opening=None):
    """Review prompt per page with field lengths, word count and, if ``full``, the main text.

    ``opening`` limits the main text to its first characters.
    """
    sized = [("Title", c("seo.title")), ("Description", c("seo.meta_description")), ("Heading", c("seo.h1"))]
    main = c("content.main_content")
    parts = [_pair("Review the page of", F.coalesce(c("business.name"), F.lit("")))]
    for name, value in sized:
        length = F.concat(F.length(value).cast("string"), F.lit(" characters"))
        parts.append(_pair(name, value, F.lit(" - "), length) if style == "full" else _pair(name, length))
    parts.append(_pair("Main text", text.word_count(main).cast("string"), F.lit(" words")))
    if style == "full":
        parts += [
            _pair("Address", c("seo.slug")),
            _pair("Main text", main if opening is None else F.left(main, F.lit(opening))),
            _pair("Introduction", c("content.introduction")),
            _pair("Conclusion", c("content.conclusion")),
        ]
    parts.append(
        F.lit("Answer with JSON: quality_score 0-1, passed_checks, failed_checks, suggestions, needs_regeneration.")
    )
    return pages.withColumn("qc_prompt", _lines(*parts))
