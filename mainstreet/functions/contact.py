"""Contact fields: zip codes, phones, web and mail addresses."""

from pyspark.sql import functions as F

from mainstreet.functions import fixed


def norm_zip(col):
    """Nine characters without a hyphen become zip+4."""
    bare = (F.length(col) == 9) & ~F.contains(col, F.lit("-"))
    return F.when(bare, F.concat_ws("-", F.substring(col, 1, 5), F.substring(col, 6, 4))).otherwise(col)


def _groups(digits, pattern):
    return F.regexp_replace(digits, r"^(\d{3})(\d{3})(\d{4})$", pattern)


def norm_phone(col, style="dash"):
    """Format ten-digit numbers; other text stays (``dash``) or loses its signs (``paren``)."""
    if style == "paren":
        bare = F.translate(col, "()-. ", "")
        shown = F.when(
            F.length(bare) == 10,
            F.concat(F.lit("("), F.left(bare, F.lit(3)), F.lit(") "), F.substring(bare, 4, 3), F.lit("-"),
                     F.substring(bare, 7, 4)),
        ).otherwise(bare)
        return F.nullif(shown, F.lit(""))
    digits = F.regexp_replace(col, r"\D", "")
    local = F.regexp_replace(digits, r"^1(\d{10})$", "$1")
    shown = F.when(F.length(local) == 10, _groups(local, "$1-$2-$3")).otherwise(col)
    return F.nullif(shown, F.lit(""))


def norm_url(col):
    full = F.when(col.rlike("^https?://"), col).otherwise(F.concat(F.lit("https://"), col))
    return F.nullif(full, F.lit("https://"))


def canonical_url(col):
    """Scheme and host in lower case, with a slash after a bare host."""
    lowered = F.concat(F.lower(F.regexp_extract(col, r"^([^/]*//[^/?#]*)", 1)), F.regexp_replace(col, r"^[^/]*//[^/?#]*", ""))
    return F.when(lowered.rlike(r"^https?://[^/?#]+$"), F.concat(lowered, F.lit("/"))).otherwise(lowered)


def valid_email(col):
    return col.rlike(fixed.EMAIL_FORMAT)


def tel_link(col):
    return F.translate(col, " ()-", "")
