"""Row types shared by sources, operators and stage plans."""

from pyspark.sql import types as T

REQUIRED_COLUMNS = ["business_id", "name", "category", "address", "city", "state", "zip_code"]
OPTIONAL_COLUMNS = ["phone", "website", "email", "description", "rating", "review_count"]
BUSINESS_COLUMNS = REQUIRED_COLUMNS + OPTIONAL_COLUMNS

_s, _b = T.StringType(), T.BooleanType()


def _struct(**fields):
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields.items()])


BUSINESS = T.StructType(
    [T.StructField(c, _s, True) for c in BUSINESS_COLUMNS[:11]]
    + [T.StructField("rating", T.DoubleType(), True), T.StructField("review_count", T.IntegerType(), True)]
)
SEO = _struct(
    title=_s, meta_description=_s, h1=_s, slug=_s, canonical_url=_s, keywords=T.ArrayType(_s)
)
CONTENT = _struct(
    introduction=_s, main_content=_s, services_section=_s, location_section=_s, conclusion=_s
)
RATING_BLOCK = _struct(ratingValue=T.DoubleType(), reviewCount=T.IntegerType())
JSONLD = T.StructType(
    [
        T.StructField("@context", _s, True),
        T.StructField("@type", _s, True),
        T.StructField("name", _s, True),
        T.StructField("description", _s, True),
        T.StructField("address", T.MapType(_s, _s), True),
        T.StructField("telephone", _s, True),
        T.StructField("url", _s, True),
        T.StructField("email", _s, True),
        T.StructField("priceRange", _s, True),
        T.StructField("aggregateRating", RATING_BLOCK, True),
    ]
)
LINK = _struct(url=_s, anchor_text=_s, target_business_id=_s)
PAGE_SPEC = _struct(
    business=BUSINESS,
    seo=SEO,
    content=CONTENT,
    jsonld=JSONLD,
    internal_links=T.ArrayType(LINK),
    generated_at=T.TimestampType(),
    quality_score=T.DoubleType(),
)
FEEDBACK = _struct(
    quality_score=T.DoubleType(),
    passed_checks=T.ArrayType(_s),
    failed_checks=T.ArrayType(_s),
    suggestions=T.ArrayType(_s),
    retry_count=T.IntegerType(),
    needs_regeneration=_b,
)
