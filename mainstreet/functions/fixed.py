"""Lists, limits and message texts that results depend on."""

# Limits for page fields.
TITLE_LENGTH = (10, 70)
META_LENGTH = (50, 160)
H1_LENGTH = (10, 70)
MAX_SLUG = 60
MIN_WORDS = 800
MIN_SECTION_CHARS = 100
MAX_DENSITY = 0.03
MIN_DENSITY = 0.005

# Words that carry no topic.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from",
    "has", "he", "in", "is", "it", "its", "of", "on", "that", "the",
    "to", "was", "will", "with", "this", "but", "they", "have", "had", "what",
    "said", "each", "which", "she", "do", "how", "their",
]

# Words that link one section to the next.
TRANSITION_WORDS = [
    "however", "moreover", "furthermore", "additionally", "also", "therefore", "consequently",
]

# SQL category ladder, first match wins.
CONTENT_CATEGORIES = [
    ("restaurant", ["restaurant", "food", "dining"]),
    ("automotive", ["auto", "car", "repair"]),
    ("healthcare", ["medical", "health", "dental"]),
    ("retail", ["retail", "shop", "store"]),
    ("professional_services", ["law", "legal", "account", "consult"]),
]
DEFAULT_CONTENT_CATEGORY = "general"

# Prompt category ladder, first match wins.
CONTEXT_TERMS = [
    ("restaurant", ["restaurant", "food", "dining", "cafe", "bar", "pizza"]),
    ("automotive", ["auto", "car", "automotive", "mechanic", "repair"]),
    ("healthcare", ["medical", "health", "doctor", "clinic", "dental", "pharmacy"]),
    ("retail", ["retail", "store", "shop", "clothing", "electronics", "grocery"]),
    ("professional_services", ["law", "accounting", "consulting", "real estate", "insurance"]),
]
DEFAULT_CONTEXT = "professional_services"

# Guidance per prompt category (key, focus areas, keywords).
CATEGORY_GUIDANCE = [
    ("restaurant",
     ["menu highlights", "dining atmosphere", "local ingredients", "catering services"],
     ["restaurant", "dining", "food", "menu", "reservations", "takeout"]),
    ("automotive",
     ["repair services", "maintenance", "parts availability", "warranty"],
     ["auto repair", "car service", "mechanic", "maintenance", "parts"]),
    ("healthcare",
     ["services offered", "patient care", "insurance accepted", "appointments"],
     ["medical", "healthcare", "doctor", "clinic", "treatment", "care"]),
    ("retail",
     ["product selection", "customer service", "store hours", "location"],
     ["shop", "store", "retail", "products", "shopping", "local"]),
    ("professional_services",
     ["expertise", "consultation process", "client results", "credentials"],
     ["professional", "services", "consultation", "expert", "business"]),
]

# Text that a CSV reader takes as missing.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# E-mail and zip formats.
EMAIL_FORMAT = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
ZIP_FORMAT = r"^\d{5}(-\d{4})?$"
SLUG_FORMAT = r"^[a-z0-9-]+$"

# Advice per failed check, in report order.
METADATA_ADVICE = [
    ("title_length", "Adjust title length to 10-70 characters"),
    ("meta_length", "Adjust meta description to 50-160 characters"),
    ("h1_length", "Adjust H1 length to 10-70 characters"),
    ("slug_format", "Fix slug format - use only lowercase letters, numbers, and hyphens"),
    ("has_keywords", "Add more relevant keywords (minimum 3)"),
]
CONTENT_ADVICE = [
    ("word_count", "Increase main content to at least 800 words"),
    ("mentions_business_name", "Include business name more prominently in content"),
    ("mentions_location", "Add more location-specific information"),
    ("includes_address", "Include address or location details in content"),
    ("varied_sentence_length", "Vary sentence length for better readability"),
]

# Advice by mean quality, best first.
QUALITY_ADVICE = [
    (0.85, "Excellent quality! Consider this as a template for future generations."),
    (0.75, "Good quality overall. Minor improvements could enhance SEO performance."),
    (0.65, "Average quality. Consider reviewing content generation prompts."),
    (None, "Below average quality. Recommend regenerating content with improved prompts."),
]
NO_SCORES_MESSAGE = "No quality scores available for analysis"

# Advice by success rate in percent, best first.
SUCCESS_ADVICE = [
    (95, "Excellent pipeline performance! Consider scaling to more businesses."),
    (80, "Good pipeline performance. Review failed cases for improvement opportunities."),
    (60, "Moderate success rate. Consider reviewing data quality and generation prompts."),
    (None, "Low success rate. Investigate data quality, prompts, and system configuration."),
]
LOW_MEAN_ADVICE = "Consider refining content generation prompts to improve quality scores."
FAILED_ADVICE = "Check CloudWatch logs for detailed error analysis of failed generations."
STANDING_ADVICE = [
    "Set up monitoring for website performance and SEO metrics.",
    "Consider A/B testing different content templates for optimization.",
    "Plan regular content updates to maintain freshness and relevance.",
]

# USD per 1000 tokens (model, input, output).
MODEL_PRICES = [
    ("claude-3-5-sonnet", 0.003, 0.015),
    ("claude-3-sonnet", 0.003, 0.015),
    ("claude-3-haiku", 0.00025, 0.00125),
    ("claude-instant", 0.0008, 0.0024),
]

# Token sizes assumed for a cost estimate before a run.
TYPICAL_TOKENS = (800, 1500)
