"""Check results, keywords and violations of page documents."""

from pyspark.sql import functions as F

from mainstreet.functions import checks, fixed, text

c = F.col


def _rules(stop_match="substring"):
    return {**checks.metadata_checks(), **checks.content_checks(stop_match=stop_match)}


def _as_map(names):
    return F.create_map(*[part for name in names for part in (F.lit(name), c(f"_ok_{name}"))])


def _prepared(pages):
    return pages.withColumns(checks.content_parts())


def with_checks(pages, stop_match="substring"):
    """Add the metadata and content check results as maps, each check computed once per page."""
    return _as_maps(_checked(_prepared(pages), stop_match)).drop("_main", "_full")


def _checked(prepared, stop_match):
    """One boolean column per check, named ``_ok_`` and the check."""
    return prepared.withColumns({f"_ok_{name}": rule for name, rule in _rules(stop_match).items()})


def _as_maps(checked):
    maps = {"seo_results": _as_map(checks.METADATA_CHECKS), "content_results": _as_map(checks.CONTENT_CHECKS)}
    return checked.withColumns(maps).drop(*[f"_ok_{name}" for name in (*checks.METADATA_CHECKS, *checks.CONTENT_CHECKS)])


def check_columns(pages, names=None, stop_match="substring"):
    """One boolean column per check, for the named checks only; the others are not computed."""
    rules = _rules(stop_match)
    return _prepared(pages).select("page_pos", *[rules[n].alias(n) for n in (names or rules)])


def checks_table(pages):
    """Long form: page, check, result."""
    rows = F.array(*[F.struct(F.lit(n).alias("check"), rule.alias("passed")) for n, rule in _rules().items()])
    return _prepared(pages).select("page_pos", F.inline(rows))


def check_rates(pages):
    """Pages, passes and pass rate per check. One pass of counts, turned into rows at the end."""
    counts = F.array(
        *[F.struct(F.lit(n).alias("check"), F.count_if(rule).alias("passed")) for n, rule in _rules().items()]
    )
    return (
        _prepared(pages)
        .agg(F.count(F.lit(1)).alias("pages"), counts.alias("counts"))
        .select("pages", F.inline("counts"))
        .withColumn("pass_rate", F.round(F.try_divide(c("passed").cast("double"), c("pages")), 4))
    )


def frequent_words(col, k=5, least=3):
    """Most frequent words of four or more ASCII letters, ties by first occurrence, those below ``least`` left out.

    The words' 64-bit hashes are sorted inside the row, so equal words form runs. Only runs of ``least``
    and more are measured, by their first and last places; the words themselves are fetched for
    the ``k`` longest runs. Nothing is shuffled.
    """
    found = F.filter(
        F.regexp_extract_all(F.lower(col), F.lit(r"(?U)\b[a-z]{4,}\b"), F.lit(0)),
        lambda w: ~w.isin(*[s for s in fixed.STOP_WORDS if len(s) >= 4]),
    )

    def top(words, hashes):
        def runs(s):
            def differs(x, i):
                return ~F.coalesce(x == F.get(s, i), F.lit(False))

            def same(x, i):
                return x == F.get(s, i)

            firsts = F.transform(s, lambda x, j: F.when(same(x, j + (least - 1)) & differs(x, j - 1), F.struct(j.alias("j"), x.alias("x"))))
            lasts = F.transform(s, lambda x, j: F.when(same(x, j - (least - 1)) & differs(x, j + 1), j))
            # the first places and the last ones of long runs are in the same order
            return F.arrays_zip(F.array_compact(firsts).alias("a"), F.array_compact(lasts).alias("z"))

        long_runs = F.transform(
            text.let(F.sort_array(hashes), runs), lambda r: F.struct((r.a.j - r.z).alias("minus"), F.array_position(hashes, r.a.x).alias("i"))
        )
        return F.transform(F.slice(F.sort_array(long_runs), 1, k), lambda r: F.element_at(words, r.i.cast("int")))

    return text.let(found, lambda ws: text.let(F.transform(ws, lambda w: F.xxhash64(w)), lambda hs: top(ws, hs)))


def meta_keywords(pages, k=8):
    """Keywords from category, city and the frequent words of the main text."""
    cat, city = F.lower("business.category"), F.lower("business.city")
    fixed_part = F.array(cat, city, F.concat(cat, F.lit(" "), city), F.concat(city, F.lit(" "), cat))
    everything = F.concat(F.array_compact(fixed_part), frequent_words(c("content.main_content")))
    usable = F.array_distinct(F.filter(everything, lambda w: F.length(w) >= 3))
    return pages.withColumn("meta_keywords", F.slice(usable, 1, k))


def _violations():
    """Ordered texts for failed checks, missing markup and links, and keyword density out of range."""
    rules = []
    for kind, names in (("SEO metadata", checks.METADATA_CHECKS), ("Content", checks.CONTENT_CHECKS)):
        rules += [F.when(~c(f"_ok_{name}"), F.lit(f"{kind} failed: {name}")) for name in names]
    rules += [
        F.when(c("jsonld").isNull(), F.lit("Missing schema.org markup")),
        F.when(F.coalesce(F.size("internal_links"), F.lit(0)) <= 0, F.lit("No internal links found")),
    ]
    keywords = F.slice(F.coalesce(c("seo.keywords"), F.array().cast("array<string>")), 1, 3)

    def judged(keyword, density):
        def said(word):
            return F.concat(
                F.lit("Keyword '"), keyword, F.lit(f"' density too {word}: "), checks.percent_text(density)
            )

        return F.when(density > fixed.MAX_DENSITY, said("high")).when(density < fixed.MIN_DENSITY, said("low"))

    dense = text.keyword_densities(c("_full"), checks.full_word_count(), keywords, judged)
    return F.concat(text.present(*rules), F.array_compact(dense))


def seo_compliance(pages, stop_match="substring"):
    """Add check results, as maps, and the list of violations, which is made from the plain results."""
    checked = _checked(_prepared(pages), stop_match)
    return _as_maps(checked.withColumn("violations", _violations())).drop("_main", "_full")


def improvement_advice(pages):
    checked = pages if "seo_results" in pages.columns else with_checks(pages)
    return checked.withColumn(
        "advice", checks.suggest_improvements(c("seo_results"), c("content_results"))
    )
