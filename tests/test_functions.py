"""Expressions on small inputs with known results."""

import pytest
from pyspark.sql import functions as F

from mainstreet.functions import checks, contact, scores, text
from mainstreet.operators import cleaning, content, site

c = F.col


def value(spark, make, *args):
    names = [f"a{i}" for i in range(len(args))]
    df = spark.createDataFrame([tuple(args)], ", ".join(f"{n} {_type(v)}" for n, v in zip(names, args)))
    return df.select(make(*[c(n) for n in names]).alias("out")).first().out


def _type(v):
    if isinstance(v, list):
        return "array<string>"
    if isinstance(v, dict):
        return "map<string,boolean>"
    return {float: "double", int: "int"}.get(type(v), "string")


@pytest.mark.parametrize(
    "raw, cased",
    [("  test city  ", "Test City"), ("  ca  ", "Ca"), ("mario's o-neil 3com CA", "Mario'S O-Neil 3Com Ca"), ("", ""), (None, None)],
)
def test_title_case(spark, raw, cased):
    assert value(spark, text.title_case, raw) == cased


SAMPLES = ["", "   ", "one", " a\tb\n\nc  ", "x y z w v　u", "é è\x1cê\x85ü", "​not a space"]


@pytest.mark.parametrize("raw", SAMPLES)
def test_words_as_in_python(spark, raw):
    assert value(spark, text.words, raw) == raw.split()
    assert value(spark, text.word_count, raw) == len(raw.split())
    assert value(spark, text.strip, raw) == raw.strip()
    assert value(spark, text.collapse_ws, raw) == " ".join(raw.split())


def test_word_count_of_null(spark):
    assert value(spark, text.word_count, None) == 0


@pytest.mark.parametrize("hay, needle", [("aaaa", "aa"), ("abcabc", "c"), ("", "x"), ("abc", ""), ("x", "xyz")])
def test_occurrences_as_in_python(spark, hay, needle):
    assert value(spark, text.occurrences, hay, needle) == hay.count(needle)


def test_keyword_density(spark):
    body = "This is a pizza restaurant. The pizza here is great. We serve pizza and more food."
    assert value(spark, text.keyword_density, body, "Pizza") == pytest.approx(body.count("pizza") / len(body.split()))
    assert value(spark, text.keyword_density, body, "sushi") == 0
    assert value(spark, text.keyword_density, "", "pizza") == 0


def test_slugs(spark):
    made = value(spark, text.page_slug, "Mario's Pizza & Pasta", "Restaurant", "San Francisco")
    assert made == "marios-pizza-pasta-restaurant-san-francisco"
    assert value(spark, text.compact_slug, "Mario's pizza", "Pizza", "Rome") == "marios-pizzapizzarome"
    long = value(spark, text.page_slug, "A" * 50, "Restaurant", "San Francisco")
    assert len(long) == 60 and long.endswith("...")
    assert value(spark, text.page_slug, "--A  -- b--", "C", "d e") == "a-b-c-d-e"


def test_clean_keywords(spark):
    assert value(spark, text.clean_keywords, ["test", "TEST", "Test", "other", " test ", "  "]) == ["test", "other"]


def test_control_chars(spark):
    assert value(spark, text.clean_control_chars, "a\x07\tb\x85 \x9f c") == "a b c"


@pytest.mark.parametrize(
    "raw, dash, paren",
    [
        ("(555) 123-4567", "555-123-4567", "(555) 123-4567"),
        ("15551234567", "555-123-4567", "15551234567"),
        ("555.123.4567", "555-123-4567", "(555) 123-4567"),
        ("555-12", "555-12", "55512"),
        (None, None, None),
    ],
)
def test_phone(spark, raw, dash, paren):
    assert value(spark, contact.norm_phone, raw) == dash
    assert value(spark, lambda p: contact.norm_phone(p, "paren"), raw) == paren


def test_zip_and_url(spark):
    assert value(spark, contact.norm_zip, "902101234") == "90210-1234"
    assert value(spark, contact.norm_zip, "90210") == "90210"
    assert value(spark, contact.norm_url, "x.com") == "https://x.com"
    assert value(spark, contact.norm_url, "http://x.com") == "http://x.com"
    assert value(spark, contact.norm_url, "https://") is None
    assert value(spark, contact.canonical_url, "HTTPS://X.com") == "https://x.com/"
    assert value(spark, contact.canonical_url, "https://x.com/A?b") == "https://x.com/A?b"


@pytest.mark.parametrize(
    "field, raw, good",
    [("zip_code", z, True) for z in ("90210", "90210-1234")]
    + [("zip_code", z, False) for z in ("9021", "90210-123", "abcde", "", None)]
    + [("rating", r, True) for r in (0.0, 2.5, 5.0, None)]
    + [("rating", r, False) for r in (-1.0, 5.1, 10.0)]
    + [("email", "a@b.co", True), ("email", "a@b", False), ("email", None, True)]
    + [("website", "https://x.com", True), ("website", "x.com", False)]
    + [("state", "C", False), ("name", "", False), ("name", None, False), ("address", "1 A", False)],
)
def test_business_rules(spark, field, raw, good):
    row = dict(business_id="b", name="Shop", category="Retail", address="12 Main Street", city="Rome", state="CA",
               zip_code="90210", phone=None, website=None, email=None, description=None, rating=4.0, review_count=3)
    row[field] = raw
    schema = ", ".join(f"{n} {'double' if n == 'rating' else 'int' if n == 'review_count' else 'string'}" for n in row)
    df = spark.createDataFrame([tuple(row.values())], schema)
    assert cleaning.validate_businesses(df).first().errors == ([] if good else [field])


def test_ingest_keeps_what_only_looks_missing(spark):
    names = ["business_id", "name", "category", "address", "city", "state", "zip_code", "phone", "website", "email",
             "description", "rating", "review_count"]
    rows = [
        ("1", " joe's ", "retail", "12 Main Street", "rome", "NY", "902101234", "15551234567", "X.com", None, "n/a", "4.5", "12.9"),
        ("2", "joe", "retail", "12 Main Street", "rome", "NA", "01234", None, None, None, " nan ", "four", None),
        ("3", "joe", "retail", "12 Main Street", "rome", " NA ", "01234", None, None, None, "", None, "-1"),
    ]
    out = cleaning.ingest(spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names)))
    ok, bad = cleaning.split_valid(out)
    first = ok.first()
    assert (first.name, first.city, first.state, first.zip_code) == ("Joe'S", "Rome", "Ny", "90210-1234")
    assert (first.phone, first.website, first.description) == ("555-123-4567", "https://x.com/", None)
    assert (first.rating, first.review_count) == (4.5, 12)
    errors = {r.business_id: r.errors for r in bad.collect()}
    assert errors == {"2": ["state", "rating"], "3": ["review_count"]}


STOPS = "a an and are as at be by for from has he in is it its of on that the to was will with this but they have had what said each which she do how their".split()


def _repeats(body, token):
    ws, seen = body.lower().split(), {}
    for i in range(len(ws) - 2):
        trio = ws[i : i + 3]
        phrase = " ".join(trio)
        if any((s in trio) if token else (s in phrase) for s in STOPS):
            continue
        seen[phrase] = seen.get(phrase, 0) + 1
    return max(seen.values(), default=0) <= 2


@pytest.mark.parametrize(
    "body",
    ["", "one", "one two", "good buy now " * 3, "good buy now " * 2, "bgd kyz mnp " * 3, "bgd kyz mnp " * 2 + "bgd kyz",
     "the best pizza " * 5, "xx yy zz xx yy zz q xx yy zz", "zz zz zz zz zz"],
)
def test_repetition(spark, body):
    for mode in ("substring", "token"):
        got = value(spark, lambda b: checks.no_repetition(text.collapse_ws(b), mode), body)
        assert got == _repeats(body, mode == "token"), mode


@pytest.mark.parametrize(
    "body, varied",
    [("", False), ("One. Two. Three. Four.", False), ("A b. A b. A b. A b. A b.", False),
     ("Hi. One two three. One two three. Hi there you. " + "word " * 20 + ".", True)],
)
def test_sentences(spark, body, varied):
    assert value(spark, lambda b: checks.sentence_variety(text.collapse_ws(b)), body) is varied


def _frequent(body):
    import re

    seen = {}
    for w in re.findall(r"\b[a-zA-Z]{4,}\b", body.lower()):
        if w not in STOPS:
            seen[w] = seen.get(w, 0) + 1
    top = sorted(seen.items(), key=lambda x: x[1], reverse=True)[:5]
    return [w for w, n in top if n >= 3]


@pytest.mark.parametrize(
    "body",
    ["", "pizza", "pizza " * 3, "pasta pizza pasta pizza pasta pizza wine wine", "their this that " * 9,
     "alpha beta gamma delta omega sigma " * 4 + "sigma", "éabcd abcdé abcd abcd abcd x_abcd", "b2b four4 fours fours fours"],
)
def test_frequent_words(spark, body):
    assert value(spark, content.frequent_words, body) == _frequent(body)


def test_advice_counts_missing_results_as_failed(spark):
    out = value(spark, checks.suggest_improvements, {"title_length": False, "meta_length": True}, {"word_count": True})
    assert "Adjust title length to 10-70 characters" in out
    assert "Adjust meta description to 50-160 characters" not in out
    assert len(out) == 8


def test_weighted_quality(spark):
    assert value(spark, checks.weighted_quality, {"title_length": True, "relevance": True, "service_area": False}) == 0.16
    everything = "title_length meta_length h1_length word_count slug_format relevance structure writing_quality keywords local_elements geographic_relevance service_area"
    assert value(spark, checks.weighted_quality, dict.fromkeys(everything.split(), True)) == 1.0


def test_percent_text(spark):
    for share in (0.0025, 0.0, 0.05, 0.12345, 0.0075):
        assert value(spark, checks.percent_text, share) == f"{share:.1%}"


def test_category_ladders_take_the_first_match(spark):
    assert value(spark, scores.content_category, "Healthcare") == "automotive"
    assert value(spark, scores.content_category, "Furniture") == "general"
    assert value(spark, scores.context_key, "Barber Shop") == "restaurant"
    assert value(spark, scores.context_key, "Florist") == "professional_services"


def test_stars(spark):
    for rating in (0.4, 2.5, 3.5, 4.9):
        assert value(spark, site.star_flags, rating) == [i < round(rating) for i in range(5)]


def test_escape(spark):
    assert value(spark, text.escape_html, "<a href=\"x\">'&'</a>") == "&lt;a href=&#34;x&#34;&gt;&#39;&amp;&#39;&lt;/a&gt;"


def test_names_of_checks_are_in_report_order(spark):
    assert tuple(checks.metadata_checks()) == checks.METADATA_CHECKS
    assert tuple(checks.content_checks()) == checks.CONTENT_CHECKS
