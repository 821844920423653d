"""Labels and verdicts shown to people."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C
from ..operators.predicates import dec


# The texts, colours and verdicts that these functions give are those that people and other programs read.


def _s(c: Column) -> Column:
    return c.cast("string")


def duration_text(seconds: Column) -> Column:
    """`45s`, `3m 5s`, `2h 10m`; zero parts at the end are left out."""
    s = seconds.cast("long")
    m, h = F.floor(s / 60), F.floor(s / 3600)
    tail = lambda n, unit: F.when(n > 0, F.concat(F.lit(" "), _s(n), F.lit(unit))).otherwise("")
    return F.when(s < 60, F.concat(_s(s), F.lit("s"))).when(m < 60, F.concat(_s(m), F.lit("m"), tail(s % 60, "s"))).otherwise(F.concat(_s(h), F.lit("h"), tail(m % 60, "m")))


def time_ago(ts: Column, now: datetime) -> Column:
    """In whole days, hours or minutes."""
    s = F.abs(F.unix_timestamp(F.lit(now)) - F.unix_timestamp(ts))
    d, h, m = F.floor(s / 86400), F.floor(s / 3600), F.floor(s / 60)
    say = lambda n, one, many: F.when(n == 1, f"1 {one} ago").otherwise(F.concat(_s(n), F.lit(f" {many} ago")))
    return F.when(d > 0, say(d, "day", "days")).when(h > 0, say(h, "hour", "hours")).when(m > 0, say(m, "min", "mins")).otherwise("just now")


def file_size_text(size: Column) -> Column:
    """Megabytes with one decimal (none if it is 0), else kilobytes. Halves round up; counted in whole numbers, so that ties are exact."""
    n = size.cast("long")
    tenths = F.floor((n + 50_000) / 100_000)
    mb = F.regexp_replace(F.concat(_s(F.floor(tenths / 10)), F.lit("."), _s(tenths % 10)), r"\.0$", "")
    return F.when(size >= C.TOO_LARGE_BYTES, F.concat(mb, F.lit("MB"))).otherwise(F.concat(_s(F.floor((n + 500) / 1000)), F.lit("KB")))


def nsfw_label(score: Column) -> Column:
    """Percentage and colour; null without a score."""
    color = F.when(score >= dec(C.NSFW_RED), "red").when(score >= dec(C.NSFW_FLAG), "orange").otherwise("gray")
    return F.when(score.isNotNull(), F.struct(F.concat(_s(F.round(score * 100).cast("int")), F.lit("%")).alias("text"), color.alias("color")))


def people_label(contains: Column, faces: Column) -> Column:
    n = F.coalesce(faces, F.lit(0))
    return F.when(~F.coalesce(contains, F.lit(False)), "No people").when(n == 0, "People, no visible faces").when(n == 1, "1 person").when(n == 2, "2 people").when(n <= 5, "3-5 people").otherwise("6+ people")


def watermark_label(has: Column, kind: Column, provider: Column) -> Column:
    known = kind.isin([str(t) for t in C.WatermarkType])
    name = F.when(known, F.initcap(kind)).otherwise("Detected")
    suffix = F.when((kind == "stock") & (F.coalesce(provider, F.lit("")) != ""), F.concat(F.lit(" ("), provider, F.lit(")"))).otherwise("")
    return F.when(has, F.concat(name, suffix)).otherwise("")


def status_label(status: Column) -> Column:
    color = F.when(status == "completed", "green").when(status.isin("pending", "processing"), "blue").when(status == "failed", "red").otherwise("gray")
    return F.struct(F.coalesce(F.initcap(status), F.lit("Not analyzed")).alias("text"), color.alias("color"))


def provider_label(provider: Column, model: Column) -> Column:
    name = F.coalesce(*[F.when(provider == k, v) for k, v in C.PROVIDER_LABELS.items()], provider)
    return F.when(provider.isNull(), "").when(F.coalesce(model, F.lit("")) == "", name).otherwise(F.concat(name, F.lit(" / "), model))


def duplicates_label(n: Column) -> Column:
    return F.when(F.coalesce(n, F.lit(0)) == 0, "").when(n == 1, "1 duplicate").otherwise(F.concat(_s(n), F.lit(" duplicates")))


def extension(filename: Column) -> Column:
    return F.lower(F.regexp_extract(filename, r"\.([^.]+)$", 1))


#: Fixed value: what a file name gains when the name was taken.
_CONFLICT = r"_\d{4}-\d{2}-\d{2}-\d{6}_[a-zA-Z0-9]{4}(_\d{1,2})?$"


def title_is_automatic(title: Column, filename: Column) -> Column:
    """Whether a title is empty or comes from the file name, as it is or made readable, with or without a conflict suffix."""
    stem = F.regexp_replace(filename, r"\.[^.]*$", "")

    def same(s: Column) -> Column:
        readable = F.trim(F.regexp_replace(F.regexp_replace(s, r"[-_.]+", " "), r"\s+", " "))
        return (F.lower(title) == F.lower(s)) | (F.lower(title) == F.lower(readable))

    return (F.coalesce(title, F.lit("")) == "") | same(stem) | same(F.regexp_replace(stem, _CONFLICT, ""))


def _check(name: str, status: Column, verdict: Column) -> Column:
    return F.when(status.isNotNull(), F.struct(F.lit(name).alias("name"), status.alias("status"), verdict.alias("verdict")))


def readiness(size: Column, width: Column, filename: Column) -> Column:
    """Checks of file size, resolution and format as (name, status, verdict); overall is the worst of them."""
    ext = extension(filename)
    sized = F.coalesce(size, F.lit(0)) > 0
    size_status = F.when(sized & (size >= C.VERY_LARGE_BYTES), "error").when(sized & (size >= C.TOO_LARGE_BYTES), "warning").when(sized, "pass")
    size_verdict = F.when(size >= C.VERY_LARGE_BYTES, "Very large").when(size >= C.TOO_LARGE_BYTES, "Large").otherwise("Good")
    wide = (F.coalesce(width, F.lit(0)) > 0) & (ext != "svg")
    out_of = (width < C.MIN_WIDTH) | (width > C.MAX_WIDTH)
    res_status = F.when(wide & out_of, "warning").when(wide, "pass")
    res_verdict = F.when(width < C.MIN_WIDTH, "Small").when(width > C.MAX_WIDTH, "Oversized").otherwise("Good")
    plain = ext.isin("jpg", "jpeg", "jfif", "png", "gif", "svg")
    modern = ext.isin("webp", "avif")
    tiff = ext.isin("tiff", "tif")
    fmt_status = F.when(tiff, "error").when(plain | modern, "pass").otherwise("warning")
    fmt_verdict = F.when(tiff, "Unsupported").when(plain, "Widely supported").when(modern, "Modern format").otherwise("Check compatibility")
    return F.filter(F.array(_check("fileSize", size_status, size_verdict), _check("resolution", res_status, res_verdict), _check("format", fmt_status, fmt_verdict)), lambda x: x.isNotNull())


def overall(checks: Column) -> Column:
    return F.when(F.exists(checks, lambda c: c["status"] == "error"), "error").when(F.exists(checks, lambda c: c["status"] == "warning"), "warning").otherwise("pass")


def quality_checks() -> Column:
    """Verdicts on sharpness, brightness, contrast, compression and colour profile; those without a value are left out."""
    s, e, c, q, prof = (F.col(x) for x in ("sharpnessScore", "exposureScore", "noiseScore", "compressionQuality", "colorProfile"))
    dark = (e < dec(C.DARK_MEDIAN)) & (F.coalesce("shadowClipRatio", F.lit(0)) > dec(C.SHADOW_CLIP))
    bright = (e > dec(C.BRIGHT_MEDIAN)) & (F.coalesce("highlightClipRatio", F.lit(0)) > dec(C.HIGHLIGHT_CLIP))
    rows = [
        _check("sharpness", F.when(s < dec(C.SOFT), "warning").when(s.isNotNull(), "pass"), F.when(s < dec(C.BLURRY), "Blurry").when(s < dec(C.SOFT), "Soft").otherwise("Sharp")),
        _check("brightness", F.when(dark | bright, "warning").when(e.isNotNull(), "pass"), F.when(dark, "Too dark").when(bright, "Too bright").otherwise("Good")),
        _check("contrast", F.when(c < dec(C.CONTRAST_LOW), "warning").when(c.isNotNull(), "pass"), F.when(c < dec(C.CONTRAST_FLAT), "Very low contrast").when(c < dec(C.CONTRAST_LOW), "Low contrast").otherwise("Good")),
        _check("compression", F.when(q < C.COMPRESSION_VISIBLE, "warning"), F.lit("Low quality")),
        _check("colorProfile", F.when(prof.isin("srgb", "grayscale"), "pass").when(prof.isNotNull(), "warning"), F.when(prof == "cmyk", "Not web-ready").when(prof.isin("srgb", "grayscale"), "Good").otherwise("Colors may shift")),
    ]
    return F.filter(F.array(*rows), lambda x: x.isNotNull())


def skip_reason(kind: Column, mime: Column, filename: Column, size: Column, width: Column, height: Column, most: int = 1568) -> Column:
    """Why an image isn't prepared before it is sent; null if it is."""
    # Formats that are sent as they are.
    mimes, exts = ["image/svg+xml", "image/gif", "application/pdf"], ["svg", "cr2", "nef", "dng", "arw", "rw2", "orf", "crw", "raf"]
    small = (width > 0) & (height > 0) & (F.greatest(width, height) <= most) & (size <= 500_000)
    return F.when(kind != "image", "not_image").when(mime.isin(mimes), "mime_unsupported").when(extension(filename).isin(exts), "raw_format_unsupported").when(F.coalesce(size, F.lit(0)) == 0, "empty_file").when(small, "already_small")


def truncated(text: Column, n: int = 200) -> Column:
    return F.when(F.char_length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)
