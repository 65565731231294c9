"""Expected outcomes with the values written out, so that a wrong fixed value cannot pass on both sides of a check."""

import pytest
from pyspark.sql import functions as F

from mainstreet.functions import checks, scores, text
from mainstreet.operators import cleaning, linking, responses

c = F.col


def _one(spark, column, **values):
    kinds = {str: "string", int: "int", float: "double", bool: "boolean", list: "array<string>"}
    schema = ", ".join(f"{n} {kinds[type(v)]}" for n, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "category, expected",
    [
        ("Italian Restaurant", "restaurant"), ("Fine Dining", "restaurant"), ("Auto Parts", "automotive"), ("Car Wash", "automotive"),
        ("Dental Clinic", "healthcare"), ("Book Shop", "retail"), ("Law Firm", "professional_services"),
        ("Tax Accountant", "professional_services"), ("Florist", "general"), ("Health Food Store", "restaurant"),
    ],
)
def test_content_category(spark, category, expected):
    assert _one(spark, scores.content_category(c("category")), category=category) == expected


@pytest.mark.parametrize(
    "category, expected",
    [("Pizza Bar", "restaurant"), ("Mechanic", "automotive"), ("Pharmacy", "healthcare"), ("Grocery", "retail"), ("Plumber", "professional_services")],
)
def test_guidance(spark, category, expected):
    row = linking.category_context(spark.createDataFrame([(category,)], "category string")).first()
    assert row.context_key == expected
    if expected == "retail":
        assert row.focus_areas == ["product selection", "customer service", "store hours", "location"]
        assert row.context_keywords == ["shop", "store", "retail", "products", "shopping", "local"]


@pytest.mark.parametrize("token", ["", "#N/A", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null", "<NA>", "-nan", "1.#IND", "#NA"])
def test_missing_texts(spark, token):
    frame = spark.createDataFrame([(token, "none")], "a string, b string")
    assert tuple(cleaning.nullify(frame).first()) == (None, "none")


@pytest.mark.parametrize(
    "model, expected",
    [("claude-3-5-sonnet", 0.0249), ("claude-3-sonnet", 0.0249), ("claude-3-haiku", 0.002075), ("claude-instant", 0.00424), ("other", 0.0)],
)
def test_prices(spark, model, expected):
    used = spark.createDataFrame([(model, 800, 1500)], "model_name string, input_tokens long, output_tokens long")
    assert responses.estimate_cost(used).first().cost == expected


def test_models_are_tried_in_order(spark):
    names = ["claude-instant", "claude-3-haiku", "claude-3-sonnet", "claude-3-5-sonnet"]
    rows = [(1, n, n == "claude-instant", 1, 10, ["e"]) for n in names] + [(1, "claude-3-haiku", False, 1, 10, ["e"])]
    tried = spark.createDataFrame(rows, "request_id long, model_name string, success boolean, retry_count int, generation_time_ms long, errors array<string>")
    row = responses.fallback_rollup(tried).first()
    assert (row.model_name, row.retry_count, row.generation_time_ms) == ("claude-instant", 4, 40)
    failed = [e for e in row.errors if e.startswith("Model")]
    assert failed == [f"Model claude-3-{n} failed after 4 attempts" for n in ("5-sonnet", "sonnet", "haiku")]
    # only the last model answered, and a repeated row counts once
    row = responses.fallback_rollup(tried.where("model_name != 'claude-instant'")).first()
    assert not row.succeeded and row.errors[-1] == "All fallback models exhausted"


def test_advice(spark):
    none = F.create_map(F.lit("x"), F.lit(True))
    assert _one(spark, checks.suggest_improvements(none, none), a=1) == [
        "Adjust title length to 10-70 characters",
        "Adjust meta description to 50-160 characters",
        "Adjust H1 length to 10-70 characters",
        "Fix slug format - use only lowercase letters, numbers, and hyphens",
        "Add more relevant keywords (minimum 3)",
        "Increase main content to at least 800 words",
        "Include business name more prominently in content",
        "Add more location-specific information",
        "Include address or location details in content",
        "Vary sentence length for better readability",
    ]


@pytest.mark.parametrize(
    "phrase, repeated",
    [("alpha beta gamma", True), ("alpha the gamma", False), ("alpha beta she", False), ("bread oven flour", True)],
)
def test_repetition_counts_phrases_without_stop_words(spark, phrase, repeated):
    body = " x ".join([phrase] * 3)
    assert _one(spark, checks.no_repetition(c("t"), "token"), t=body) == (not repeated)


@pytest.mark.parametrize("word", ["However", "moreover", "furthermore", "Additionally", "also", "therefore", "consequently"])
def test_transition_words(spark, word):
    paragraphs = ["one two", "word " * 25, f"{word} three"]
    content = F.struct(F.lit("").alias("introduction"), c("t").alias("main_content"), F.lit("").alias("conclusion")).alias("content")
    rows = spark.createDataFrame([("\n\n".join(paragraphs),), ("\n\n".join(["one two", "word " * 25, "three"]),)], "t string").select(content)
    assert [r.x for r in rows.select(checks.content_flow().alias("x")).collect()] == [True, False]


def test_page_limits(spark):
    seo = "struct<title:string,meta_description:string,h1:string,slug:string,keywords:array<string>>"

    def result(name, **changed):
        fields = {"title": "T" + "a" * 20, "meta_description": "m" * 60, "h1": "H" * 20, "slug": "a-b", "keywords": ["a", "b", "c"], **changed}
        frame = spark.createDataFrame([(tuple(fields.values()),)], f"seo {seo}")
        return frame.select(checks.metadata_checks()[name].alias("x")).first().x

    for name, field, low, high in (
        ("title_length", "title", 10, 70), ("meta_length", "meta_description", 50, 160), ("h1_length", "h1", 10, 70),
    ):
        assert [result(name, **{field: "x" * n}) for n in (low - 1, low, high, high + 1)] == [False, True, True, False]
    assert [result("slug_not_too_long", slug="x" * n) for n in (60, 61)] == [True, False]
    assert [result("slug_format", slug=s) for s in ("a-1", "A-1", "a_1")] == [True, False, False]
    assert [result("has_keywords", keywords=k) for k in (["a", "b"], ["a", "b", "c"])] == [False, True]


def test_generator_gets_its_prompt_and_pages_are_normalised(spark):
    rows = [("b1", "Joe  Bakery", "Bakery", "12 Main Street", "Rome", "NY", "01234", None, None, None, None, None, None, 1)]
    names = "business_id name category address city state zip_code phone website email description".split()
    schema = ", ".join(f"{n} string" for n in names) + ", rating double, review_count int, pos long"
    b = spark.createDataFrame(rows, schema)
    page = responses.generate_pages(b).first()
    assert page.generation_successful and page.seo.title == "Joe Bakery - Bakery in Rome, NY"
    assert page.seo.keywords == ["bakery", "rome bakery", "bakery in rome", "local bakery"]

    def model(row):
        assert "Joe" in row["prompt"] and row["prompt"].endswith("No other text.")
        return '{"seo": {"title": " A   b ", "keywords": [" X", "x", ""]}, "content": {}}'

    page = responses.generate_pages(b, model).first()
    assert page.seo.title == "A b" and page.seo.keywords == ["x"] and not page.generation_successful


def test_slug_and_density(spark):
    assert _one(spark, text.page_slug(c("a"), c("b"), c("d")), a="Mario's Shop", b="Auto Repair", d="New York") == "marios-shop-auto-repair-new-york"
    assert _one(spark, F.round(text.keyword_density(c("t"), F.lit("auto")), 3), t="Auto repair and auto parts") == 0.4
