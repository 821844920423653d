"""Normalisation of semi-structured model output, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import ErrorCode

# Accepted categories and types.
NSFW_CATEGORIES = ("adult", "violence", "hate", "self-harm", "drugs")
WATERMARK_TYPES = ("stock", "logo", "text", "copyright", "unknown")

#: What a model's answer looks like; unknown keys are ignored, numbers may come as text.
RESPONSE = (
    "altText string, altTextConfidence double, longDescription string, longDescriptionConfidence double, suggestedTitle string, titleConfidence double, "
    "tags array<struct<tag: string, confidence: string>>, extractedText array<string>, faceCount int, containsPeople boolean, containsPeopleConfidence string, "
    "nsfwScore string, nsfwConfidence string, nsfwCategories array<struct<category: string, confidence: string>>, hasWatermark boolean, watermarkConfidence string, watermarkType string, "
    "watermarkDetails struct<stockProvider: string>, containsBrandLogoConfidence string, detectedBrands array<struct<brand: string, name: string, confidence: string>>, "
    "focalPointX string, focalPointY string, focalPointConfidence string, siteContent map<string, struct<altText: string, suggestedTitle: string, altTextConfidence: string, titleConfidence: string>>"
)


def clamp(v: Column, default: float | None = None) -> Column:
    """Into 0..1; text that isn't a number is 0."""
    n = F.when(v.isNotNull(), F.coalesce(v.cast("string").try_cast("double"), F.lit(0.0)))
    n = n if default is None else F.coalesce(n, F.lit(default))
    return F.when(n.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), n)))


def strip_fences(text: Column) -> Column:
    """Without a Markdown code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def safe_json(text: Column, schema: str = RESPONSE) -> Column:
    """Null where it can't be read, also without control characters."""
    options = {"mode": "PERMISSIVE", "allowUnquotedControlChars": "false"}
    clean = F.regexp_replace(text, r"[\x00-\x1F\x7F]", "")
    valid = F.when(F.try_parse_json(text).isNotNull(), text).when(F.try_parse_json(clean).isNotNull(), clean)
    return F.from_json(valid, schema, options)


def normalize_tag(tag: Column) -> Column:
    return F.lower(F.trim(tag))


def normalize_tags(tags: Column) -> Column:
    """Lower-cased, trimmed, without blanks, confidence in 0..1 (0.5 if missing), most confident first."""
    kept = F.filter(F.coalesce(tags, F.array()), lambda t: F.coalesce(F.trim(t["tag"]), F.lit("")) != "")
    return sort_by_score(F.transform(kept, lambda t: F.struct(normalize_tag(t["tag"]).alias("tag"), clamp(t["confidence"], 0.5).alias("confidence"))))


def sort_by_score(items: Column, score: str = "confidence") -> Column:
    """Descending; equal scores keep their order."""
    placed = F.transform(items, lambda x, i: F.struct((-x[score]).alias("k"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(placed, lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(a["i"] - b["i"])), lambda y: y["x"])


def unknown_categories(categories: Column) -> Column:
    """Categories outside the accepted ones: a row that has any is refused."""
    return F.filter(F.transform(F.coalesce(categories, F.array()), lambda c: F.lower(F.trim(c["category"]))), lambda c: ~F.coalesce(c.isin(*NSFW_CATEGORIES), F.lit(False)))


def normalize_categories(categories: Column) -> Column:
    items = F.transform(F.coalesce(categories, F.array()), lambda c: F.struct(F.lower(F.trim(c["category"])).alias("category"), clamp(c["confidence"], 0.5).alias("confidence")))
    return sort_by_score(items)


def normalize_brands(brands: Column) -> Column:
    """From `brand` or `name`; blanks go, confidence is 0.5 if missing."""
    named = F.transform(F.coalesce(brands, F.array()), lambda b: F.struct(F.trim(F.coalesce(b["brand"], b["name"])).alias("brand"), clamp(b["confidence"], 0.5).alias("confidence")))
    return F.filter(named, lambda b: F.coalesce(b["brand"], F.lit("")) != "")


def normalize_regions(regions: Column, most: int = 50) -> Column:
    """Trimmed, non-empty, first of equal ones, `most` at the most."""
    return F.slice(F.array_distinct(F.filter(F.transform(F.coalesce(regions, F.array()), lambda r: F.trim(r)), lambda r: F.coalesce(r, F.lit("")) != "")), 1, most)


def normalize_watermark_type(kind: Column) -> Column:
    k = F.lower(F.trim(kind))
    return F.when(kind.isNotNull(), F.when(k.isin(*WATERMARK_TYPES), k).otherwise("unknown"))


def normalize_watermark_details(details: Column) -> Column:
    name = F.trim(details["stockProvider"])
    return F.when(F.coalesce(name, F.lit("")) != "", F.struct(name.alias("stockProvider")))


def site_content(content: Column) -> Column:
    """Entries with a title or an alternative text."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    return F.map_filter(content, lambda k, e: ~(blank(e["altText"]) & blank(e["suggestedTitle"])))


def fix_language_mixing(value: Column, content: Column, field: str) -> Column:
    """Blank if a translation has the same text: then the model answered in the wrong language."""
    same = F.exists(F.map_values(content), lambda e: (F.coalesce(e[field], F.lit("")) != "") & (F.lower(e[field]) == F.lower(value)))
    return F.when((value != "") & F.coalesce(same, F.lit(False)), "").otherwise(F.coalesce(value, F.lit("")))


def parse_response(text: Column) -> Column:
    """A model's answer as a struct of normalised values; null where it isn't JSON.

    The parsed answer is bound to a variable, of an array of one element: Catalyst would put a copy of the parser into every field else.
    """
    return F.get(F.transform(F.array(safe_json(strip_fences(text))), _normalized), F.lit(0))


def _normalized(d: Column) -> Column:
    brands = normalize_brands(d["detectedBrands"])
    content = d["siteContent"]
    parts = {
        "altText": fix_language_mixing(d["altText"], content, "altText"), "altTextConfidence": F.coalesce(d["altTextConfidence"], F.lit(0.0)),
        "longDescription": F.coalesce(d["longDescription"], F.lit("")), "longDescriptionConfidence": F.coalesce(d["longDescriptionConfidence"], F.lit(0.0)),
        "suggestedTitle": fix_language_mixing(d["suggestedTitle"], content, "suggestedTitle"), "titleConfidence": F.coalesce(d["titleConfidence"], F.lit(0.0)),
        "tags": normalize_tags(d["tags"]), "extractedText": normalize_regions(d["extractedText"]), "faceCount": F.coalesce(d["faceCount"], F.lit(0)),
        "containsPeople": F.coalesce(d["containsPeople"], F.lit(False)), "containsPeopleConfidence": clamp(d["containsPeopleConfidence"], 0.0),
        "nsfwScore": clamp(d["nsfwScore"], 0.0), "nsfwConfidence": clamp(d["nsfwConfidence"], 0.0), "nsfwCategories": normalize_categories(d["nsfwCategories"]),
        "hasWatermark": F.coalesce(d["hasWatermark"], F.lit(False)), "watermarkConfidence": clamp(d["watermarkConfidence"], 0.0),
        "watermarkType": normalize_watermark_type(d["watermarkType"]), "watermarkDetails": normalize_watermark_details(d["watermarkDetails"]),
        "containsBrandLogo": F.size(brands) > 0, "containsBrandLogoConfidence": clamp(d["containsBrandLogoConfidence"], 0.0), "detectedBrands": brands,
        "focalPointX": clamp(d["focalPointX"]), "focalPointY": clamp(d["focalPointY"]), "focalPointConfidence": clamp(d["focalPointConfidence"]), "siteContent": site_content(content),
    }
    return F.when(d.isNotNull(), F.struct(*[c.alias(k) for k, c in parts.items()]))


def redact(message: Column) -> Column:
    """The first 500 characters, without keys."""
    m = F.substring(message, 1, 500)
    # Patterns of keys.
    for pattern, new in ((r"\bsk-[a-zA-Z0-9]{20,}\b", "[REDACTED]"), (r"\bAIza[a-zA-Z0-9_-]{30,}\b", "[REDACTED]"), (r"[?&](key|api_key|apikey)=[^&\s]+", "$1=[REDACTED]")):
        m = F.regexp_replace(m, pattern, new)
    return m


def error_code(status: Column, message: Column) -> Column:
    """From the HTTP status if there is one, else from the message."""
    m = F.lower(F.coalesce(message, F.lit("")))
    by_status = F.when(status == 401, ErrorCode.INVALID_API_KEY).when(status == 403, ErrorCode.ACCESS_DENIED).when(status == 404, ErrorCode.MODEL_NOT_FOUND).when(status == 413, ErrorCode.FILE_TOO_LARGE).when(status == 429, ErrorCode.RATE_LIMIT).when(status.isin(500, 502, 503), ErrorCode.PROVIDER_UNAVAILABLE).otherwise(ErrorCode.UNKNOWN)
    by_text = F.when(m.contains("timed out") | m.contains("timeout"), ErrorCode.TIMEOUT).when(m.contains("connection failed") | m.contains("could not resolve") | m.contains("connection refused"), ErrorCode.CONNECTION_FAILED).otherwise(ErrorCode.UNKNOWN)
    return F.when(status.isNotNull(), by_status).otherwise(by_text)


def retry_delay(attempt: int, retry_after: str | None = None, most: int = 30) -> int:
    """Seconds before attempt `attempt` + 1: what the server asks for, bounded, else 2, 4, ..."""
    if retry_after and retry_after.strip().replace(".", "", 1).isdigit():
        return min(int(float(retry_after)), most)
    return 2 ** (attempt + 1)


RETRYABLE = frozenset({429, 500, 502, 503})


def clean_text(value: Column, most: int) -> Column:
    """Trimmed; a longer text is an error."""
    t = F.trim(value)
    return F.when(F.char_length(t) > most, F.raise_error(F.lit(f"longer than {most} characters")).cast("string")).otherwise(t)


def clean_int(value: Column, least: int = 0) -> Column:
    return F.greatest(F.lit(least), F.coalesce(value.cast("string").try_cast("int"), F.lit(least)))
