"""Settings, enumerations and constants."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime
from decimal import Decimal
from enum import StrEnum


class AnalysisStatus(StrEnum):
    PENDING = "pending"
    PROCESSING = "processing"
    COMPLETED = "completed"
    FAILED = "failed"


UNPROCESSED = (AnalysisStatus.PENDING, AnalysisStatus.FAILED)
TERMINAL = (AnalysisStatus.COMPLETED, AnalysisStatus.FAILED)


class WatermarkType(StrEnum):
    STOCK = "stock"
    LOGO = "logo"
    TEXT = "text"
    COPYRIGHT = "copyright"
    AI = "ai"
    UNKNOWN = "unknown"


class DuplicateResolution(StrEnum):
    KEPT = "kept"
    DELETED = "deleted"
    IGNORED = "ignored"


class ErrorCode(StrEnum):
    FILE_TOO_LARGE = "file_too_large"
    RATE_LIMIT = "rate_limit"
    INVALID_API_KEY = "invalid_api_key"
    ACCESS_DENIED = "access_denied"
    MODEL_NOT_FOUND = "model_not_found"
    PROVIDER_UNAVAILABLE = "provider_unavailable"
    TIMEOUT = "timeout"
    CONNECTION_FAILED = "connection_failed"
    INVALID_RESPONSE = "invalid_response"
    ASSET_NOT_READABLE = "asset_not_readable"
    MISSING_API_KEY = "missing_api_key"
    MISSING_CONFIG_FIELD = "missing_config_field"
    PROVIDER_NOT_REGISTERED = "provider_not_registered"
    UNKNOWN = "unknown"


class LogLevel(StrEnum):
    INFO = "info"
    WARNING = "warning"
    ERROR = "error"
    CRITICAL = "critical"


def options(kind: type[StrEnum]) -> list[dict[str, str]]:
    """Value and label of every member, for option lists."""
    return [{"value": m.value, "label": m.value.replace("_", " ").capitalize()} for m in kind]


# Thresholds of image quality.
BLURRY, SOFT = Decimal("0.3"), Decimal("0.6")
EXPOSURE_LOW, EXPOSURE_HIGH = Decimal("0.3"), Decimal("0.7")
DARK_MEDIAN, BRIGHT_MEDIAN = Decimal("0.22"), Decimal("0.85")
SHADOW_CLIP, HIGHLIGHT_CLIP = Decimal("0.40"), Decimal("0.40")
CONTRAST_FLAT, CONTRAST_LOW = Decimal("0.25"), Decimal("0.45")
COMPRESSION_VISIBLE = 50
NSFW_FLAG, NSFW_RED = Decimal("0.5"), Decimal("0.8")
#: "Too large" and readiness count decimal megabytes, range filters binary ones.
TOO_LARGE_BYTES, VERY_LARGE_BYTES, MIB = 1_000_000, 3_000_000, 1_048_576
MIN_WIDTH, MAX_WIDTH = 1200, 4096

# Weights of the search index by field, BM25's k1 (b is 0), result caps.
FIELD_WEIGHTS = {
    "tag": Decimal("1.50"), "title": Decimal("1.30"), "suggestedTitle": Decimal("1.20"), "altText": Decimal("1.10"), "alt": Decimal("1.10"), "siteTitle": Decimal("1.00"),
    "suggestedTitleAi": Decimal("0.90"), "siteAltText": Decimal("0.90"), "altTextAi": Decimal("0.85"), "longDescription": Decimal("0.80"), "extractedTextAi": Decimal("0.70"), "longDescriptionAi": Decimal("0.60"),
}
BM25_K1 = 1.2
RANK_CAP, NATIVE_CAP = 500, 500
PAGE_SIZE, PAGE_MAX = 50, 100

# Perceptual hashes.
HASH_BITS, HAMMING_THRESHOLD = 256, 10

# Dollars for a million tokens in and out, and tokens of a usual image, by model.
PRICING = [
    ("openai", "gpt-5.4", "2.50", "15.00", 3284, 1075),
    ("openai", "gpt-5.4-mini", "0.75", "4.50", 3603, 992),
    ("openai", "gpt-5.4-nano", "0.20", "1.25", 3888, 1027),
    ("gemini", "gemini-2.5-flash", "0.30", "2.50", 2564, 1233),
    ("gemini", "gemini-2.5-flash-lite", "0.10", "0.40", 2564, 1181),
    ("gemini", "gemini-2.5-pro", "1.25", "10.00", 2564, 1165),
    ("claude", "claude-sonnet-4-6", "3.00", "15.00", 3183, 1156),
    ("claude", "claude-opus-4-6", "5.00", "25.00", 2965, 1057),
    ("claude", "claude-haiku-4-5-20251001", "1.00", "5.00", 3025, 1211),
]
PROVIDER_LABELS = {"openai": "OpenAI", "gemini": "Gemini", "claude": "Claude"}
#: Bytes that a provider takes for an image, and the most that is decoded.
PROVIDER_MAX_BYTES = {"openai": 15 * MIB, "gemini": 15 * MIB, "claude": 3 * MIB}
DECODE_MAX_BYTES = 30 * MIB

# Seconds a bulk session lives, and shows as complete; minutes until a row counts as stuck.
SESSION_TTL, COMPLETE_WINDOW = 3600, 300
STUCK_MINUTES = {"pending": 10, "processing": 30}
LOG_RETENTION_DAYS = 30


@dataclass(frozen=True)
class EngineConfig:
    """What the installation can do, which volumes and languages it covers, and the time that counts as now."""

    pro: bool = True
    has_quality: bool = True
    has_duplicates: bool = True
    volumes: tuple[int, ...] | None = None
    languages: tuple[str, ...] = ("en", "fr", "de", "es")
    primary_site: int = 1
    now: datetime = field(default_factory=lambda: datetime(2026, 1, 1))

    def feature_available(self, feature: str) -> bool:
        """Whether a feature's edition and image library are there; unknown features are."""
        needs = {
            "quality": self.has_quality, "duplicates": self.pro and self.has_duplicates, "tags": self.pro, "status": self.pro,
            "stock_provider": self.pro, "text_search": self.pro, "similar": self.pro and self.has_duplicates,
        }
        return needs.get(feature, True)

    def setup_problems(self, provider: str | None, api_key: str | None) -> list[dict[str, str]]:
        """What stands in the way of analyses, the most severe first."""
        out = []
        if not provider:
            out.append({"severity": "critical", "problem": "no provider"})
        elif not api_key:
            out.append({"severity": "critical", "problem": "no API key"})
        if self.volumes is not None and not self.volumes:
            out.append({"severity": "critical", "problem": "no enabled volume"})
        if not self.has_quality:
            out.append({"severity": "warning", "problem": "no image library for quality"})
        if not self.has_duplicates:
            out.append({"severity": "warning", "problem": "no image library for duplicates"})
        return out
