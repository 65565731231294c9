"""Scores, levels and suggestions computed from one business row."""

from functools import reduce
from operator import add

from pyspark.sql import functions as F

from mainstreet.functions import fixed, text

c = F.col


def filled(name, above=0):
    """The field is there and longer than ``above`` characters once trimmed; false for null."""
    return F.coalesce(F.length(F.trim(c(name))) > above, F.lit(False))


def points(condition, n, otherwise=0):
    return F.when(condition, F.lit(n)).otherwise(F.lit(otherwise))


def steps(col, ladder):
    """Points of the first step whose lower limit the value reaches, 0 when below all or null."""
    out = F
    for limit, n in ladder:
        out = out.when(col >= limit, F.lit(n))
    return out.otherwise(F.lit(0))


def label(ladder, default):
    """First label whose condition holds."""
    out = F
    for condition, name in ladder:
        out = out.when(condition, F.lit(name))
    return out.otherwise(F.lit(default))


def total(*parts):
    return reduce(add, parts)


# Required fields and the length each must exceed.
_ESSENTIAL = [("name", 0), ("category", 0), ("address", 5), ("city", 0), ("state", 1), ("zip_code", 4)]


def essentials():
    return [filled(name, above) for name, above in _ESSENTIAL]


def all_essentials():
    out = F.lit(True)
    for rule in essentials():
        out = out & rule
    return out


def completeness_score():
    fields = essentials() + [c("phone").isNotNull(), c("website").isNotNull() | c("email").isNotNull()]
    return total(*[points(rule, 5) for rule in fields])


def quality_score():
    return total(
        steps(c("rating"), [(4.0, 15), (3.5, 10), (float("-inf"), 5)]),
        steps(c("review_count"), [(50, 10), (10, 5)]),
        points(filled("description", 50), 5),
    )


def seo_potential_score():
    return total(points(c("website").isNotNull(), 10), points(c("email").isNotNull(), 5), F.lit(15))


def priority_level(score):
    return label(
        [(score >= 80, "HIGH_PRIORITY"), (score >= 60, "MEDIUM_PRIORITY"), (score >= 40, "LOW_PRIORITY")],
        "REVIEW_NEEDED",
    )


def publication_score():
    """Weighted score of the publication list, rounded so that comparisons do not depend on addition order."""
    basics = total(*[points(rule, 5) for rule in essentials()])
    contact = total(
        points(c("phone").isNotNull(), 10), points(c("website").isNotNull(), 10), points(c("email").isNotNull(), 5)
    )
    quality = total(
        steps(c("rating"), [(4.0, 15), (3.5, 10), (float("-inf"), 5)]),
        steps(c("review_count"), [(20, 10), (5, 5)]),
    )
    reach = total(points(filled("description", 30), 10), points(c("website").isNotNull(), 10))
    weighted = [(basics, 0.4), (contact, 0.2), (quality, 0.25), (reach, 0.15)]
    return F.round(total(*[part.cast("double") * weight for part, weight in weighted]), 6)


def ladder_match(col, ladder, default):
    """Key of the first group with a term inside the lower-cased text."""
    lowered = F.lower(col)
    out = F
    for key, terms in ladder:
        out = out.when(text.holds_any(lowered, terms), F.lit(key))
    return out.otherwise(F.lit(default))


def content_category(col):
    return ladder_match(col, fixed.CONTENT_CATEGORIES, fixed.DEFAULT_CONTENT_CATEGORY)


def context_key(col):
    return ladder_match(col, fixed.CONTEXT_TERMS, fixed.DEFAULT_CONTEXT)


def complexity():
    return label(
        [
            (filled("description", 100), "LOW"),
            (c("rating").isNotNull() & (c("review_count") > 10), "MEDIUM"),
        ],
        "HIGH",
    )


def completeness_flag():
    names = ["name", "category", "address", "city", "state", "zip_code"]
    whole = F.lit(True)
    for name in names:
        whole = whole & c(name).isNotNull()
    return label([(whole, "COMPLETE")], "PARTIAL")


def suggested_title():
    short = F.concat(c("name"), F.lit(" - "), c("category"), F.lit(" in "), c("city"))
    full = F.concat(short, F.lit(", "), c("state"))
    return F.when(F.length(full) <= 70, full).otherwise(short)


def suggested_meta():
    about = F.trim(c("description"))
    sentence = F.concat(
        F.lit("Professional "), F.lower(c("category")), F.lit(" services in "), c("city"), F.lit(", "), c("state"),
        # Fixed value: closing sentence of the fallback description.
        F.lit(". Contact us today for quality service and exceptional customer experience."),
    )
    return (
        F.when(F.length(about).between(1, 160), about)
        .when(F.length(about) > 160, F.concat(F.left(about, F.lit(157)), F.lit("...")))
        .otherwise(F.left(sentence, F.lit(160)))
    )


def suggested_h1():
    pair = F.concat(c("name"), F.lit(" - "), c("category"))
    return (
        F.when(F.length(pair) <= 70, pair)
        .when(F.length(c("name")) <= 70, c("name"))
        .otherwise(F.concat(F.left(c("name"), F.lit(67)), F.lit("...")))
    )


def target_word_count():
    return (
        F.when(filled("description", 200), F.lit(800))
        .when(c("rating").isNotNull() & (c("review_count") > 20), F.lit(900))
        .otherwise(F.lit(1000))
    )


def suggested_keywords():
    cat, city = F.lower(c("category")), F.lower(c("city"))
    return F.concat(
        cat, F.lit(", "), city, F.lit(" "), cat, F.lit(", "), cat, F.lit(" in "), city, F.lit(", local "), cat
    )


def eda_score():
    """Exploratory priority score, 0 to 100."""
    base = [c(n).isNotNull() for n in ("name", "category", "city", "state")]
    extra = [c(n).isNotNull() for n in ("address", "zip_code", "phone", "website", "email")]
    everything = base[0] & base[1] & base[2] & base[3]
    parts = [points(everything, 20)] + [points(rule, 4) for rule in extra]
    parts += [
        steps(c("rating"), [(4.5, 15), (4.0, 10), (3.5, 5)]),
        steps(c("review_count"), [(100, 15), (50, 10), (20, 5)]),
        points(c("website").isNotNull(), 15),
        points(F.coalesce(F.length(c("description")) > 50, F.lit(False)), 15),
    ]
    return F.least(total(*parts), F.lit(100)).cast("double")


def eda_band(score):
    """Right-closed bins (0,40], (40,70], (70,85], (85,100]; null outside."""
    return (
        F.when((score <= 0) | (score > 100), F.lit(None))
        .when(score <= 40, "Low")
        .when(score <= 70, "Medium")
        .when(score <= 85, "High")
        .otherwise("Premium")
    )


def n_rows():
    return F.count(F.lit(1))
