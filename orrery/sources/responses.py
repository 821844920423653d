"""Model responses as an input table. Providers are a registry of how each wraps its answer; nothing is called from a query."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PROVIDER_MAX_BYTES
from ..functions.normalize import parse_response, unknown_categories, safe_json, strip_fences


@dataclass(frozen=True)
class Provider:
    """Columns that take the text, token counts and the cut-off flag out of a raw response."""

    content: Callable[[Column], Column]
    tokens_in: Callable[[Column], Column]
    tokens_out: Callable[[Column], Column]
    truncated: Callable[[Column], Column]
    max_bytes: int


def _at(path: str, kind: str = "string") -> Callable[[Column], Column]:
    return lambda raw: F.get_json_object(raw, path).try_cast(kind)


PROVIDERS: dict[str, Provider] = {
    "openai": Provider(_at("$.choices[0].message.content"), _at("$.usage.prompt_tokens", "int"), _at("$.usage.completion_tokens", "int"), lambda r: F.get_json_object(r, "$.choices[0].finish_reason") == "length", PROVIDER_MAX_BYTES["openai"]),
    "gemini": Provider(_at("$.candidates[0].content.parts[0].text"), _at("$.usageMetadata.promptTokenCount", "int"), _at("$.usageMetadata.candidatesTokenCount", "int"), lambda r: F.get_json_object(r, "$.candidates[0].finishReason") == "MAX_TOKENS", PROVIDER_MAX_BYTES["gemini"]),
    "claude": Provider(_at("$.content[0].text"), _at("$.usage.input_tokens", "int"), _at("$.usage.output_tokens", "int"), lambda r: F.get_json_object(r, "$.stop_reason") == "max_tokens", PROVIDER_MAX_BYTES["claude"]),
}


def register_provider(name: str, provider: Provider) -> None:
    PROVIDERS[name] = provider


def parse_responses(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (assetId, provider, response): parsed rows, and refused ones with an error code and message."""
    pick = lambda f: F.coalesce(*[F.when(F.col("provider") == n, getattr(p, f)(F.col("response"))) for n, p in PROVIDERS.items()])
    df = raw.withColumns({"_text": pick("content"), "inputTokens": F.coalesce(pick("tokens_in"), F.lit(0)), "outputTokens": F.coalesce(pick("tokens_out"), F.lit(0)), "_cut": F.coalesce(pick("truncated"), F.lit(False))})
    df = df.withColumn("result", parse_response(F.col("_text"))).withColumn("_bad", unknown_categories(safe_json(strip_fences(F.col("_text")))["nsfwCategories"]))
    code = F.when(~F.col("provider").isin(list(PROVIDERS)), "provider_not_registered").when(F.col("_cut") | F.col("result").isNull() | (F.size("_bad") > 0), "invalid_response")
    df = df.withColumn("errorCode", code)
    message = F.when(F.col("_cut"), "the response was cut off").when(F.size("_bad") > 0, F.concat(F.lit("unknown categories: "), F.array_join("_bad", ", "))).otherwise("the response can't be read")
    good = df.where(F.col("errorCode").isNull()).select("assetId", "provider", "inputTokens", "outputTokens", "result.*")
    return good, df.where(F.col("errorCode").isNotNull()).select("assetId", "provider", "errorCode", message.alias("errorMessage"))
