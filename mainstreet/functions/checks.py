"""Page checks: booleans over the ``seo``, ``content`` and ``business`` parts of a page.

Checks read columns by dotted name, so Spark reads only the nested fields they touch. A check
on a missing value is false.
"""

from pyspark.sql import functions as F

from mainstreet.functions import fixed, text

c = F.col

# Names of the checks in report order, for callers that need no rules: building those takes seconds.
METADATA_CHECKS = (
    "title_length", "title_capitalized", "title_not_all_caps", "meta_length", "meta_compelling", "h1_length",
    "h1_different_from_title", "slug_format", "slug_not_too_long", "slug_has_keywords", "has_keywords", "keyword_variety",
)
CONTENT_CHECKS = (
    "word_count", "has_introduction", "has_conclusion", "content_flows", "mentions_business_name", "mentions_category",
    "mentions_location", "varied_sentence_length", "no_repetitive_phrases", "includes_address",
)


def _known(rule):
    return F.coalesce(rule, F.lit(False))


def metadata_checks(p=""):
    """Name and rule of each metadata check in report order; ``p`` prefixes the column path."""
    title, meta, h1 = c(f"{p}seo.title"), c(f"{p}seo.meta_description"), c(f"{p}seo.h1")
    slug, keywords = c(f"{p}seo.slug"), F.coalesce(c(f"{p}seo.keywords"), F.array().cast("array<string>"))
    shouting = title.rlike(r"\p{Lu}") & ~title.rlike(r"[\p{Ll}\p{Lt}]")
    rules = {
        "title_length": F.length(title).between(*fixed.TITLE_LENGTH),
        "title_capitalized": title.rlike(r"^\p{Lu}"),
        "title_not_all_caps": ~shouting,
        "meta_length": F.length(meta).between(*fixed.META_LENGTH),
        "meta_compelling": meta.rlike("[!?]"),
        "h1_length": F.length(h1).between(*fixed.H1_LENGTH),
        "h1_different_from_title": F.lower(h1) != F.lower(title),
        "slug_format": slug.rlike(fixed.SLUG_FORMAT),
        "slug_not_too_long": F.length(slug) <= fixed.MAX_SLUG,
        "slug_has_keywords": F.exists(
            F.slice(keywords, 1, 3), lambda k: F.contains(slug, F.replace(F.lower(k), F.lit(" "), F.lit("-")))
        ),
        "has_keywords": F.size(keywords) >= 3,
        "keyword_variety": F.size(F.array_distinct(keywords)) == F.size(keywords),
    }
    return {name: _known(rule) for name, rule in rules.items()}


def joined_content(p=""):
    parts = [F.coalesce(c(f"{p}content.{n}"), F.lit("")) for n in ("introduction", "main_content", "conclusion")]
    return F.concat_ws(" ", *parts)


def content_parts(p=""):
    """Texts that several checks share: the main text with single spaces, and all sections in lower case.

    Add them as columns before the checks, so that each is made once per page.
    """
    return {
        "_main": text.collapse_ws(c(f"{p}content.main_content")),
        "_full": F.lower(joined_content(p)),
    }


def full_word_count(p="", main="_main"):
    """Words of all sections together."""
    sections = [text.word_count(c(f"{p}content.{n}")) for n in ("introduction", "conclusion")]
    return sections[0] + text.collapsed_count(c(main)) + sections[1]


def content_flow(p=""):
    """A transition word, three or more paragraphs, and paragraph lengths in more than one bucket of ten words."""
    linked = F.lit(False)
    for name in ("introduction", "main_content", "conclusion"):
        linked = linked | _known(text.holds_any(F.lower(c(f"{p}content.{name}")), fixed.TRANSITION_WORDS))

    def varied(paragraphs):
        lengths = F.filter(F.transform(paragraphs, text.word_count), lambda n: n > 0)
        return (F.size(paragraphs) >= 3) & text.let(
            lengths, lambda n: F.floor(F.array_max(n) / 10) > F.floor(F.array_min(n) / 10)
        )

    paragraphs = F.split(c(f"{p}content.main_content"), "\n\n")
    return linked & _known(text.let(paragraphs, varied))


def sentence_variety(col):
    """Five or more sentences, one clearly shorter and one clearly longer than the mean.

    ``col`` has single spaces, as :func:`content_parts` makes them.
    """
    sentences = F.split(col, "[.!?]+")
    lengths = F.transform(sentences, lambda s: F.size(F.array_remove(F.split(s, " "), "")))

    def varied(n):
        mean = F.aggregate(n, F.lit(0).cast("long"), lambda a, x: a + x).cast("double") / F.size(n)
        return (F.array_min(n) < mean * 0.7) & (F.array_max(n) > mean * 1.3)

    # the mean of an empty list is never asked for: it would divide by zero
    return _known(
        text.let(F.filter(lengths, lambda n: n > 0), lambda n: F.when(F.size(n) >= 5, varied(n)))
    )


def no_repetition(col, stop_match="substring"):
    """No three-word phrase occurs more than twice. ``col`` has single spaces.

    A phrase counts only if it is free of stop words: found anywhere inside it (``substring``)
    or as one of its words (``token``). The hashes of the phrases of one text are sorted within its row; a
    phrase with three copies then equals the entry two places on, so no shuffle is needed.
    """
    stops = fixed.STOP_WORDS
    # a stop word that holds another one adds nothing to a search for either
    shortest = [w for w in stops if not any(other != w and other in w for other in stops)]

    def plain(w):
        return ~text.holds_any(w, shortest) if stop_match == "substring" else ~w.isin(*stops)

    tokens = F.transform(F.split(F.lower(col), " "), lambda w: F.when((w != "") & plain(w), F.xxhash64(w)))

    def phrase(ws, w, i):
        # 64-bit hashes of the words; most words are null here, so the others are looked at only after them
        second, third = F.get(ws, i + 1), F.get(ws, i + 2)
        return F.when(w.isNotNull(), F.when(second.isNotNull(), F.when(third.isNotNull(), F.xxhash64(w, second, third))))

    def phrases(ws):
        return F.sort_array(F.array_compact(F.transform(ws, lambda w, i: phrase(ws, w, i))))

    def repeated(s):
        return F.exists(F.transform(s, lambda x, i: _known(x == F.get(s, i + 2))), lambda hit: hit)

    return ~_known(text.let(text.let(tokens, phrases), repeated))


def content_checks(p="", stop_match="substring"):
    """Name and rule of each content check in report order; needs the columns of :func:`content_parts`."""
    main, full = c("_main"), c("_full")

    def mentions(name):
        return _known(F.contains(full, F.lower(c(f"{p}business.{name}"))))

    rules = {
        "word_count": text.collapsed_count(main) >= fixed.MIN_WORDS,
        "has_introduction": F.length(c(f"{p}content.introduction")) >= fixed.MIN_SECTION_CHARS,
        "has_conclusion": F.length(c(f"{p}content.conclusion")) >= fixed.MIN_SECTION_CHARS,
        "content_flows": content_flow(p),
        "mentions_business_name": mentions("name"),
        "mentions_category": mentions("category"),
        "mentions_location": mentions("city") | mentions("state"),
        "varied_sentence_length": sentence_variety(main),
        "no_repetitive_phrases": no_repetition(main, stop_match),
        "includes_address": mentions("city")
        | mentions("state")
        | _known(F.contains(full, c(f"{p}business.zip_code"))),
    }
    return {name: _known(rule) for name, rule in rules.items()}


def percent_text(share):
    return F.format_string("%.1f%%", F.bround(share * 100, 1))


def suggest_improvements(seo, content):
    """Advice for failed checks; ``seo`` and ``content`` are maps from check name to result."""
    rules = [
        F.when(~_known(F.try_element_at(results, F.lit(name))), F.lit(message))
        for results, advice in ((seo, fixed.METADATA_ADVICE), (content, fixed.CONTENT_ADVICE))
        for name, message in advice
    ]
    return text.present(*rules)


def weighted_quality(checks):
    """Three group means (technical, writing, local) weighted 0.3, 0.4, 0.3; missing checks count as failed."""
    # Groups of checks and their weights.
    groups = [
        (["title_length", "meta_length", "h1_length", "word_count", "slug_format"], 0.3),
        (["relevance", "structure", "writing_quality", "keywords"], 0.4),
        (["local_elements", "geographic_relevance", "service_area"], 0.3),
    ]
    out = F.lit(0.0)
    for names, weight in groups:
        passed = F.lit(0)
        for name in names:
            passed = passed + _known(F.try_element_at(checks, F.lit(name))).cast("int")
        out = out + passed / F.lit(float(len(names))) * F.lit(weight)
    return F.round(out, 3)
