"""Column predicates of the filters, each with its rule for NULL and for boundaries."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C


def dec(x) -> Column:
    return F.lit(Decimal(str(x)))


def in_list(column: Column, values: Sequence) -> Column:
    """An empty list matches nothing."""
    return column.isin(list(values)) if values else F.lit(False)


def status_is(values: str | Sequence[str]) -> Column:
    values = [values] if isinstance(values, str) else list(values)
    return in_list(F.col("status"), ["completed" if v == "analyzed" else v for v in values])


def unprocessed(analysis_id: str = "analysisId") -> Column:
    """After a left join: no analysis, or one that is pending or failed."""
    return F.col(analysis_id).isNull() | F.col("status").isin(*C.UNPROCESSED)


def nsfw_flagged(flag: bool) -> Column:
    hit = F.coalesce(F.col("nsfwScore") >= dec(C.NSFW_FLAG), F.lit(False))
    return hit if flag else ~hit


def at_least(column: str, v) -> Column:
    return F.col(column) >= dec(v)


def at_most(column: str, v) -> Column:
    return F.col(column) <= dec(v)


def below(column: str, v) -> Column:
    return F.col(column).isNotNull() & (F.col(column) < dec(v))


def face_preset(preset: str) -> Column:
    """`0` asks for images without people, not for a count; an unknown preset filters nothing."""
    n = F.col("faceCount")
    return {"0": ~F.col("containsPeople"), "1": n == 1, "2-5": n.between(2, 5), "6+": n >= 6}.get(preset, F.lit(True))


def processed_between(start=None, end=None) -> Column:
    """From `start` on, to the end of the day that begins at `end`."""
    out = F.lit(True)
    if start is not None:
        out &= F.col("processedAt") >= F.lit(start)
    if end is not None:
        out &= F.col("processedAt") < F.lit(end) + F.expr("INTERVAL 1 DAY")
    return out


def size_between_mib(low=None, high=None) -> Column:
    out = F.lit(True)
    if low is not None:
        out &= F.col("size") >= round(float(low) * C.MIB)
    if high is not None:
        out &= F.col("size") <= round(float(high) * C.MIB)
    return out


def detected_brand(name: str) -> Column:
    return F.coalesce(F.exists("detectedBrands", lambda b: b["brand"] == name), F.lit(False))


def stock_provider(names: Sequence[str]) -> Column:
    return in_list(F.lower(F.col("watermarkDetails.stockProvider")), [n.lower() for n in names])


def text_contains(q: str) -> Column:
    """Within any region of extracted text."""
    return F.coalesce(F.exists("extractedTextAi", lambda x: x.contains(q)), F.lit(False))


def has_text(flag: bool) -> Column:
    some = F.coalesce(F.size("extractedTextAi"), F.lit(0)) > 0
    return some if flag else ~some


def exposure_issue(flag: bool) -> Column:
    e = F.col("exposureScore")
    return (e < dec(C.EXPOSURE_LOW)) | (e > dec(C.EXPOSURE_HIGH)) if flag else e.between(dec(C.EXPOSURE_LOW), dec(C.EXPOSURE_HIGH))


#: Quality issues by name.
QUALITY = {
    "blurry": lambda: below("sharpnessScore", C.BLURRY),
    "tooDark": lambda: below("exposureScore", C.DARK_MEDIAN) & (F.col("shadowClipRatio") > dec(C.SHADOW_CLIP)),
    "tooBright": lambda: (F.col("exposureScore") > dec(C.BRIGHT_MEDIAN)) & (F.col("highlightClipRatio") > dec(C.HIGHLIGHT_CLIP)),
    "lowContrast": lambda: below("noiseScore", C.CONTRAST_LOW),
}


def any_quality_issue(names: Sequence[str]) -> Column:
    """One of the issues or more; names that aren't issues match nothing."""
    out = F.lit(False)
    for n in names:
        if n in QUALITY:
            out |= F.coalesce(QUALITY[n](), F.lit(False))
    return out


def too_large() -> Column:
    return F.col("size") >= C.TOO_LARGE_BYTES


def has_focal_point(flag: bool) -> Column:
    return F.col("focalPoint").isNotNull() if flag else F.col("focalPoint").isNull()


def missing_alt(flag: bool) -> Column:
    none = F.coalesce(F.col("alt"), F.lit("")) == ""
    return none if flag else ~none


def edited(value: Column, ai: Column) -> Column:
    """A value that was changed after the model gave one; null equals an empty text, no model value is no edit."""
    return ai.isNotNull() & (F.coalesce(value.cast("string"), F.lit("")) != F.coalesce(ai.cast("string"), F.lit("")))


def edited_focal_point() -> Column:
    """X and Y share one state; here a missing model value does count as different."""
    pair = [F.col("focalPointX"), F.col("focalPointY")], [F.col("focalPointXAi"), F.col("focalPointYAi")]
    return ~(pair[0][0].eqNullSafe(pair[1][0]) & pair[0][1].eqNullSafe(pair[1][1]))


def number_matches(column: Column, op: str, value, high=None) -> Column:
    """Operators of number rules: =, !=, <, <=, >, >=, between."""
    v = dec(value)
    return {
        "=": lambda: column == v, "!=": lambda: column != v, "<": lambda: column < v, "<=": lambda: column <= v, ">": lambda: column > v, ">=": lambda: column >= v,
        "between": lambda: column.between(v, dec(high)),
    }[op]()
