"""Text expressions: whitespace, casing, words, counts and slugs."""

from functools import reduce
from operator import or_

from pyspark.sql import functions as F

# Every character that counts as white space in a Python string.
_SPACE_CODES = [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SPACE_CHARS = "".join(map(chr, _SPACE_CODES))
_CONTROL_CHARS = "".join(map(chr, [*range(0x00, 0x20), *range(0x7F, 0xA0)]))


def let(value, body):
    """Evaluate ``value`` once per row and hand it to ``body`` as a variable."""
    return F.transform(F.array(value), body).getItem(0)


def _spaced(col, chars=SPACE_CHARS):
    """Plain spaces in place of all ``chars``. Much cheaper than a pattern of character ranges."""
    return F.translate(col, chars, " " * len(chars))


def strip(col):
    return F.btrim(col, F.lit(SPACE_CHARS))


def words(col):
    return F.array_remove(F.split(_spaced(col), " "), "")


def word_count(col):
    return F.coalesce(F.when(col.isNotNull(), F.size(words(col))), F.lit(0))


def collapse_ws(col):
    return F.array_join(words(col), " ")


def collapsed_count(col):
    """Words of a text that :func:`collapse_ws` made."""
    spaces = F.octet_length(col) - F.octet_length(F.replace(col, F.lit(" "), F.lit("")))
    return F.coalesce(F.when(col != "", spaces + 1), F.lit(0))


def title_case(col):
    """Upper-case the first letter of every run of letters, lower-case the rest."""
    pieces = F.split(strip(col), r"(?<=\P{L})(?=\p{L})")
    return F.array_join(
        F.transform(pieces, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.lower(F.substr(p, F.lit(2))))), ""
    )


def occurrences(text, needle):
    """Count non-overlapping matches of ``needle``; an empty needle matches between all characters.

    Lengths are taken in bytes, which are known without reading the text.
    """
    removed = F.octet_length(text) - F.octet_length(F.replace(text, needle, F.lit("")))
    hits = (removed / F.octet_length(needle)).cast("long")
    return F.when(needle == "", F.length(text).cast("long") + 1).otherwise(hits)


def density(lowered, n_words, keyword):
    """Matches of the keyword per word of a lower-cased text, 0 for text without words."""
    hits = occurrences(lowered, F.lower(keyword)).cast("double")
    return F.coalesce(F.try_divide(hits, n_words), F.lit(0.0))


def holds_any(col, needles):
    """Any of the texts occurs; plain searches are several times faster than one pattern of alternatives."""
    return reduce(or_, [F.contains(col, F.lit(n)) for n in needles])


def keyword_density(text, keyword):
    return density(F.lower(text), word_count(text), keyword)


def keyword_densities(lowered, n_words, keywords, body):
    """``body(keyword, density)`` for each keyword of a lower-cased text and its number of words."""
    return let(
        F.struct(lowered.alias("t"), n_words.alias("n")),
        lambda v: F.transform(keywords, lambda k: let(density(v.t, v.n, k), lambda d: body(k, d))),
    )


def clean_keywords(col):
    """Strip, lower-case, drop blanks, keep the first of equal entries."""
    return F.array_distinct(F.filter(F.transform(col, lambda k: F.lower(strip(k))), lambda k: k != ""))


def clean_control_chars(col):
    """Turn control characters into spaces and collapse white space, so that the text parses as JSON."""
    both = "".join(dict.fromkeys(_CONTROL_CHARS + SPACE_CHARS))
    return F.regexp_replace(_spaced(col, both), " +", " ")


def compact_slug(name, category, city):
    """Slug of the publication list: the joining hyphens are removed with the other signs."""
    joined = F.concat(name, F.lit("-"), category, F.lit("-"), city)
    return F.lower(F.regexp_replace(F.regexp_replace(joined, r"[^a-zA-Z0-9\s]", ""), r"\s+", "-"))


def page_slug(name, category, city):
    """Slug of a page address: hyphens stay; long ones end in dots."""
    s = F.lower(F.concat(name, F.lit("-"), category, F.lit("-"), city))
    s = F.regexp_replace(_spaced(s), "[^a-z0-9 -]", "")
    s = F.regexp_replace(s, "[ -]+", "-")
    s = F.btrim(s, F.lit("-"))
    return let(s, lambda v: F.when(F.length(v) > 60, F.concat(F.left(v, F.lit(57)), F.lit("..."))).otherwise(v))


def anchor(col):
    return F.replace(F.lower(col), F.lit(" "), F.lit("-"))


def escape_html(col):
    out = col
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(sign), F.lit(entity))
    return out


def present(*rules):
    """Keep the non-null entries of a list of optional messages, in order."""
    return F.array_compact(F.array(*rules))
