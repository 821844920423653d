"""The inverted index and BM25 search.

Postings are rows of (assetId, field, token, tf, fieldWeight). Query terms are few, so they are broadcast as
literals; scoring is a semi join, one count by token and a sum by asset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.text import base_language, stem, stem_udf, tokenize
from .predicates import edited

POSTING = ["assetId", "analysisId", "token", "tokenRaw", "field", "fieldWeight", "tf", "language"]


def field_rows(analyses: DataFrame, assets: DataFrame | None = None, language: str = "en") -> DataFrame:
    """assetId, analysisId, field, value, language of every text that is indexed; only analyses that were processed."""
    a = analyses.where(F.col("processedAt").isNotNull())
    plain = {"altText": "altText", "suggestedTitle": "suggestedTitle", "longDescription": "longDescription"}
    cells = [F.struct(F.lit(f).alias("field"), F.col(c).alias("value")) for f, c in plain.items()]
    cells += [F.struct(F.lit(f"{c}Ai").alias("field"), F.when(edited(F.col(c), F.col(f"{c}Ai")), F.col(f"{c}Ai")).alias("value")) for c in plain if f"{c}Ai" in a.columns]
    cells.append(F.struct(F.lit("extractedTextAi").alias("field"), F.array_join("extractedTextAi", "\n").alias("value")))
    rows = a.select("assetId", F.col("id").alias("analysisId"), F.explode(F.array(*cells)).alias("c")).select("assetId", "analysisId", "c.field", "c.value")
    if assets is not None:
        own = a.select("assetId", F.col("id").alias("analysisId")).join(assets.select(F.col("id").alias("assetId"), "title", "alt"), "assetId")
        native = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("title", "alt")])
        rows = rows.unionByName(own.select("assetId", "analysisId", F.explode(native).alias("c")).select("assetId", "analysisId", "c.field", "c.value"))
    return rows.where(F.coalesce(F.col("value"), F.lit("")) != "").withColumn("language", F.lit(language))


def site_rows(content: DataFrame, analyses: DataFrame) -> DataFrame:
    """Translations as fields `siteTitle:xx` and `siteAltText:xx`, with the model's own where edited."""
    j = content.join(analyses.select(F.col("id").alias("analysisId"), "assetId"), "analysisId")
    lang = base_language(F.col("language"))
    cell = lambda f, v: F.struct(F.concat(F.lit(f + ":"), lang).alias("field"), v.alias("value"))
    cells = []
    for field, c in (("siteTitle", "suggestedTitle"), ("siteAltText", "altText")):
        cells += [cell(field, F.col(c)), cell(field, F.when(edited(F.col(c), F.col(f"{c}Ai")), F.col(f"{c}Ai")))]
    out = j.select("assetId", "analysisId", lang.alias("language"), F.explode(F.array(*cells)).alias("c"))
    return out.select("assetId", "analysisId", "c.field", "c.value", "language").where(F.coalesce(F.col("value"), F.lit("")) != "")


def weight(field: Column) -> Column:
    base = F.split_part(field, F.lit(":"), F.lit(1))
    return F.coalesce(*[F.when(base == f, F.lit(w)) for f, w in C.FIELD_WEIGHTS.items()], F.lit(1).cast("decimal(3,2)")).cast("decimal(3,2)")


def postings(rows: DataFrame, group: Sequence[str] = ("assetId", "analysisId", "field", "language"), stemmed: bool = True) -> DataFrame:
    """Counts, for each stem of a field, the distinct words that have it; tokenRaw is the first of them."""
    words = rows.select(*group, F.posexplode(tokenize(F.col("value"))).alias("pos", "tokenRaw"))
    token = stem_udf("tokenRaw", "language") if stemmed else F.col("tokenRaw")
    if stemmed:
        known = words.select("tokenRaw", "language").distinct().withColumn("token", token)
        words = words.join(known, ["tokenRaw", "language"])
    else:
        words = words.withColumn("token", token)
    out = words.groupBy(*group, "token").agg(F.count("*").cast("int").alias("tf"), F.min_by("tokenRaw", "pos").alias("tokenRaw"))
    return out.withColumn("fieldWeight", weight(F.col("field")))


def tag_postings(tags: DataFrame, language: str = "en", stemmed: bool = True) -> DataFrame:
    """Each tag is indexed by itself, so that a token may come in several rows with tf 1."""
    rows = tags.select("assetId", "analysisId", F.lit("tag").alias("field"), F.lit(language).alias("language"), F.col("tag").alias("value"))
    out = postings(rows.withColumn("tagKey", F.lower("value")), ("assetId", "analysisId", "field", "language", "tagKey"), stemmed)
    return out.drop("tagKey")


def build_index(analyses: DataFrame, tags: DataFrame, assets: DataFrame | None = None, content: DataFrame | None = None, stemmed: bool = True, language: str = "en") -> DataFrame:
    rows = field_rows(analyses, assets, language)
    if content is not None:
        rows = rows.unionByName(site_rows(content, analyses))
    done = analyses.where(F.col("processedAt").isNotNull()).select(F.col("id").alias("analysisId"))
    return postings(rows, stemmed=stemmed).unionByName(tag_postings(tags.join(done, "analysisId", "left_semi"), language, stemmed)).select(*POSTING)


def by_token(index: DataFrame) -> DataFrame:
    return index.repartitionByRange("token", "assetId").sortWithinPartitions("token", "assetId")


def write_index(index: DataFrame, path: str) -> None:
    """Replaces the stored index and its totals. Rows are sorted by token within files, so that a term reads few row groups; a frequent token takes several files."""
    spark = index.sparkSession
    by_token(index).write.mode("overwrite").parquet(path)
    totals(spark.read.schema(index.schema).parquet(path)).write.mode("overwrite").parquet(_totals_path(path))


def _totals_path(path: str) -> str:
    return path.rstrip("/") + ".totals"


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The stored postings and their totals. A filter on token reaches the files' statistics."""
    return spark.read.parquet(path), spark.read.parquet(_totals_path(path))


def totals(index: DataFrame) -> DataFrame:
    """One row: the number of assets that have a posting, 1 at least."""
    return index.agg(F.greatest(F.countDistinct("assetId"), F.lit(1)).alias("n_assets"))


def term_postings(index: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Postings of some tokens: the tokens of one query, so that the filter is pushed into the scan."""
    return index.where(F.col("token").isin(list(terms)))


def reindex(index: DataFrame, fresh: DataFrame, keys: Sequence[str] = ("assetId", "field"), gone: DataFrame | None = None) -> DataFrame:
    """Rows of the changed assets (or fields of them) give way to new ones; `gone` names further keys to delete."""
    changed = fresh.select(*keys).distinct()
    if gone is not None:
        changed = changed.unionByName(gone.select(*keys).distinct()).distinct()
    return index.join(changed, list(keys), "left_anti").unionByName(fresh.select(*index.columns))


def search_terms(query: str) -> list[str]:
    """Words of a query of two bytes or more, each once."""
    return list(dict.fromkeys(t for t in query.lower().split() if len(t.encode()) >= 2))


def expand(terms: Sequence[str], languages: Sequence[str], stemmed: bool = True) -> dict[str, list[str]]:
    """Variants of each term: the term, then its stem in every language."""
    return {t: list(dict.fromkeys([t, *(stem(t, x[:2].lower()) for x in languages)] if stemmed else [t])) for t in terms}


def _literal(spark: SparkSession, variants: dict[str, list[str]]) -> DataFrame:
    rows = [(t, v, i) for t, vs in variants.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "term string, variant string, ord int")


def prefix_matches(tokens: DataFrame, prefix: Column) -> Column:
    return F.startswith("token", prefix)


def near_token(variant: Column) -> Column:
    """One edit away or none, four letters or more, the same first two."""
    n = F.char_length(variant)
    return (n >= 4) & (F.substring("token", 1, 2) == F.substring(variant, 1, 2)) & F.char_length("token").between(n - 1, n + 1) & (F.levenshtein(F.col("token"), variant, 1) >= 0)


def match_tokens(index: DataFrame, variants: dict[str, list[str]]) -> DataFrame:
    """term and token: exact variants; a term none of whose variants is there falls back to prefixes, and then to near words.

    In the fallback the first variant with a hit counts. The terms of one query are few, so they are broadcast. Exact hits are looked up
    by equality; only if a term is missed are the words with the same first letter compared.
    """
    spark = index.sparkSession
    if not variants:
        return spark.createDataFrame([], "term string, token string")
    terms = _literal(spark, variants)
    exact = term_postings(index, [v for vs in variants.values() for v in vs]).select("token").distinct().join(F.broadcast(terms), F.col("token") == F.col("variant")).select("term", "token")
    missed = F.broadcast(terms.join(exact, "term", "left_anti"))
    first = F.substring("token", 1, 1) == F.substring("variant", 1, 1)
    near = index.select("token").distinct().join(missed, first & (F.startswith("token", F.col("variant")) | near_token(F.col("variant"))))
    # The variant's order first, then a prefix before a near word.
    graded = near.select("term", "token", (F.col("ord") * 2 + F.when(F.startswith("token", F.col("variant")), 0).otherwise(1)).alias("rank"))
    best = graded.groupBy("term").agg(F.min("rank").alias("best"))
    return exact.unionByName(graded.join(F.broadcast(best), "term").where(F.col("rank") == F.col("best")).select("term", "token")).distinct()


def bm25(index: DataFrame, matched: DataFrame, k1: float = C.BM25_K1, total: DataFrame | None = None) -> DataFrame:
    """assetId and score. N counts assets with a posting (`total`, if it is stored), df those with the token; length isn't normalised."""
    total = totals(index) if total is None else total
    hits = index.join(matched.select("token").distinct(), "token", "left_semi")  # a short prefix may match very many
    df = hits.groupBy("token").agg(F.countDistinct("assetId").alias("df"))
    idf = F.log((F.col("n_assets") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * (F.col("tf") * (k1 + 1)) / (F.col("tf") + k1) * F.col("fieldWeight").cast("double")
    scored = hits.join(df, "token").crossJoin(F.broadcast(total))  # one row
    return scored.groupBy("assetId").agg(F.sum(part).alias("score"))


def _best_first() -> list[Column]:
    """Scores are compared to nine digits, so that the order of additions doesn't decide."""
    return [F.round("score", 9).desc(), F.col("assetId").asc()]


def top_k(scores: DataFrame, k: int = C.RANK_CAP) -> DataFrame:
    return scores.orderBy(*_best_first()).limit(k)


def search(index: DataFrame, query: str, languages: Sequence[str] = ("en",), k: int = C.RANK_CAP, stemmed: bool = True, total: DataFrame | None = None) -> DataFrame:
    """The best assets for a query, with their rank from 1."""
    found = bm25(index, match_tokens(index, expand(search_terms(query), languages, stemmed)), total=total)
    # At most k rows remain before the window.
    return top_k(found, k).withColumn("rank", F.row_number().over(Window.orderBy(*_best_first())))


def native_hits(assets: DataFrame, query: str) -> DataFrame:
    """The assets whose title, file name or alternative text holds every word of the query."""
    hay = F.lower(F.concat_ws(" ", "title", "filename", "alt"))
    cond = F.lit(True)
    for t in query.lower().split():
        cond &= hay.contains(t)
    return assets.where(cond)


def native_ids(assets: DataFrame, query: str, cap: int = C.NATIVE_CAP) -> DataFrame:
    """Of the assets given, already those in scope, the first `cap` that hold every word of the query."""
    return native_hits(assets, query).select(F.col("id").alias("assetId")).orderBy("assetId").limit(cap)


def merge_scores(native: DataFrame, ranked: DataFrame) -> DataFrame:
    """Scores brought to 0..100 by their greatest, as whole numbers, and merged by the greater one. `native`: assetId, score."""
    top = ranked.agg(F.max("score").alias("top"))
    scaled = ranked.crossJoin(F.broadcast(top)).select("assetId", F.when(F.col("top") > 0, F.round(F.col("score") / F.col("top") * 100)).otherwise(0).cast("long").alias("bm25"))
    both = native.join(scaled, "assetId", "full_outer")
    return both.select("assetId", F.greatest(F.coalesce(F.col("score").cast("long"), F.lit(0)), F.coalesce("bm25", F.lit(0))).alias("score"))


def union_first_wins(*ranked: DataFrame) -> DataFrame:
    """Ordered union of tables (assetId, rank): each asset keeps its place in the first table that has it."""
    out = None
    for i, df in enumerate(ranked):
        df = df.select("assetId", F.lit(i).alias("src"), "rank")
        out = df if out is None else out.unionByName(df)
    return out.groupBy("assetId").agg(F.min(F.struct("src", "rank")).alias("o")).select("assetId", "o.src", "o.rank")
