"""Language identification by Bayesian fusion of text, declared markup, address suffix and host.

Text likelihoods are hashed byte-trigram multinomials by language, counted over all documents that
declare one, with a flat background for text of no known language. Priors are counts smoothed
from the corpus to the address suffix to the host.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.pandas.types import to_arrow_schema

from . import textcore as T
from .storage import store

RESULT = S.StructType([S.StructField("detected_lang", S.StringType()), S.StructField("confidence", S.DoubleType()), S.StructField("text_lang", S.StringType()), S.StructField("accepted", S.BooleanType())])
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
#: Nats by which a text may fall short of the floor, so that a few odd trigrams do not reject a short one.
_SLACK = 20.0


def base_code(declared: Column) -> Column:
    """`en-GB` and ` EN` give `en`; what isn't a language code gives null."""
    code = F.regexp_extract(F.lower(F.trim(declared)), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    return F.when(code != "", code)


def address_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def markup_lang(html: Column) -> Column:
    return F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z_-]+)", 1)


@dataclass
class LanguageModel:
    """`weights`: log likelihoods by language and trigram bucket; `priors`: log priors by host for hosts of a bounded number."""

    languages: list[str]
    weights: np.ndarray
    floor: float
    declared_trust: float
    overall: np.ndarray
    priors: dict[str, np.ndarray] | None = field(default_factory=dict)


def trigrams(values: list, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all trigrams that hold a letter, and where each text's begin (with a last entry)."""
    t = T.join_texts(values)
    low = T.LOWER[t.buf]
    low = np.where(T.NON_SPACE[low], low, np.uint8(0x20))
    x = low.astype(np.uint32)
    ids = (x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(32 - buckets.bit_length() + 1)
    letter = _LETTER[low]
    at = np.flatnonzero(letter[1:-1])
    return ids[at].astype(np.int64), np.append(np.searchsorted(at, t.starts - 1), len(at))


def fit_languages(
    docs: DataFrame, *, declared: Column, host: Column | None = None, suffix: Column | None = None, buckets: int = 1 << 14, dense: int = 64, max_hosts: int = 100_000, strength: float = 20.0, declared_trust: float = 0.9, floor: float = -0.6
) -> tuple[LanguageModel, DataFrame | None]:
    """The model, and a table (host, prior) if there are more than `max_hosts` hosts (fewer with more than 64 languages).

    Languages are all that are declared; the pattern of codes bounds their number (18 252), and the model takes 64 KB for
    each. Trigrams of the `dense` languages declared most are summed up in a task, those of others by text. All counts
    are over all documents. `floor`: how far, per trigram, a text may fall below its language's own mean
    before the background explains it better, as a share of the distance between the two.
    """
    spark = docs.sparkSession
    host = F.lit(None).cast("string") if host is None else host
    has_suffix = suffix is not None
    rows = docs.select(base_code(declared).alias("lang"), host.alias("host"), (suffix if has_suffix else F.lit(None).cast("string")).alias("suffix"), "text")
    # Counted once; all priors come from it.
    seen = store(spark, rows.groupBy("host", "suffix", "lang").count(), "declared")
    counts = seen.where(F.col("lang").isNotNull())
    # The grouped counts are few against the texts; languages are bounded by the pattern.
    top = counts.groupBy("lang").agg(F.sum("count").alias("n")).orderBy(F.desc("n"), "lang").collect()
    languages = sorted(r["lang"] for r in top)
    common = {r["lang"]: i for i, r in enumerate(top[:dense])}
    if not languages:
        return LanguageModel([], np.zeros((0, buckets)), 0.0, declared_trust, np.zeros(0)), None
    total = {r["lang"]: r["n"] for r in top}
    overall = np.array([total[x] + 1.0 for x in languages])
    overall /= overall.sum()

    names = ["l", "b", "n"]

    def count(batches):
        out = np.zeros((len(common), buckets), np.int64)
        place = {x: i for i, x in enumerate(languages)}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            values = T.column_bytes(batch.column(1))
            for a, b in T.slices(values):
                ids, first = trigrams(values[a:b], buckets)
                own = np.repeat(np.array([common.get(x, -1) for x in langs[a:b]], np.int64), np.diff(first))
                ok = own >= 0
                out += np.bincount(own[ok] * buckets + ids[ok], minlength=out.size).reshape(out.shape)
                if len(common) < len(languages):
                    own = np.repeat(np.array([-1 if x in common else place.get(x, -1) for x in langs[a:b]], np.int64), np.diff(first))
                    ok = own >= 0
                    key, n = np.unique(own[ok] * buckets + ids[ok], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array((key // buckets).astype(np.int32)), pa.array((key % buckets).astype(np.int32)), pa.array(n.astype(np.int64))], names=names)
        for x, i in common.items():
            at = np.flatnonzero(out[i])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), place[x], np.int32)), pa.array(at.astype(np.int32)), pa.array(out[i][at])], names=names)

    grams = np.full((len(languages), buckets), 0.5)
    # At most one row for each language and bucket.
    for r in rows.select("lang", "text").mapInArrow(count, "l int, b int, n long").groupBy("l", "b").agg(F.sum("n").alias("n")).toLocalIterator():
        grams[r["l"], r["b"]] += r["n"]
    # Language by language, so that many of them take no copies of the whole.
    weights, means = np.empty(grams.shape, np.float32), np.empty(len(languages))
    for i, n in enumerate(grams):
        p = n / n.sum()
        own = np.log(p)
        weights[i], means[i] = own, (p * own).sum()
    own_mean = float(means.mean())
    flat = -np.log(buckets)
    model = LanguageModel(languages, weights, own_mean + floor * (own_mean - flat), declared_trust, overall)

    # Corpus -> suffix -> host, each smoothed by the one above; counts of languages lie in a map, however many there are.
    corpus = F.array(*[F.lit(float(x)) for x in overall])
    place = F.array_position(F.array(*[F.lit(x) for x in languages]), F.col("lang"))

    def smoothed(rows: DataFrame, key: str, parent: DataFrame | None, above: Column) -> DataFrame:
        by = rows.groupBy(key, "lang").agg(F.sum("count").alias("n"), F.min("suffix").alias("_s"))
        entry = F.when(F.col("lang").isNotNull(), F.struct(place.alias("l"), F.col("n")))
        # collect_list leaves nulls out.
        by = by.groupBy(key).agg(F.map_from_entries(F.collect_list(entry)).alias("_n"), F.coalesce(F.sum(F.when(F.col("lang").isNotNull(), F.col("n"))), F.lit(0)).alias("_t"), F.min("_s").alias("_s"))
        if parent is not None:
            by = by.join(parent, F.col("_s").eqNullSafe(F.col("s")), "left")
        one = lambda x, i: (F.coalesce(F.try_element_at("_n", (i + 1).cast("long")), F.lit(0)) + F.lit(strength) * x) / (F.col("_t") + F.lit(strength))
        return by.select(key, F.transform(above, one).alias("p"))

    # A host that declares no language has the prior of its suffix; where there are no suffixes, that of the corpus.
    by_suffix = smoothed(counts, "suffix", None, corpus).select(F.col("suffix").alias("s"), F.col("p").alias("above")) if has_suffix else None
    by_host = smoothed(seen.where(F.col("host").isNotNull()), "host", by_suffix, F.coalesce("above", corpus) if has_suffix else corpus)
    by_host = by_host.select("host", F.transform("p", lambda x: F.log(x)).alias("prior"))
    max_hosts = max(1, min(max_hosts, max_hosts * 64 // len(languages)))
    few = by_host.limit(max_hosts + 1).collect()
    if len(few) > max_hosts:
        model.priors = None
        return model, by_host
    model.priors = {r["host"]: np.array(r["prior"]) for r in few}
    return model, None


def identify(docs: DataFrame, model: LanguageModel, *, declared: Column | None, host: Column | None, priors: DataFrame | None = None, least: float = 0.5) -> DataFrame:
    """Adds detected_lang, confidence (its posterior), text_lang (the text's own best, null if none) and accepted.

    A document is accepted if its language's posterior is `least` or more and the text isn't better
    explained by the background. Null and empty texts, and those without letters, get `und`, confidence
    0 and are not accepted. Evidence that is null or unknown counts for nothing. Ties go to the language
    first in the alphabet. Rows are judged one by one; columns of the result's names in the input give way.
    """
    docs = docs.drop(*[c for c in docs.columns if c in RESULT.names or c.startswith("_x_")])
    names = docs.columns
    schema = S.StructType([*docs.schema.fields, *RESULT.fields])
    arrow = to_arrow_schema(schema)
    nothing = F.lit(None).cast("string")
    given = docs.withColumns({"_x_declared": nothing if declared is None else base_code(declared), "_x_host": nothing if host is None else host})
    if priors is not None:
        given = given.join(priors.select(F.col("host").alias("_x_host"), F.col("prior").alias("_x_prior")), "_x_host", "left").select(*names, "_x_declared", "_x_host", "_x_prior")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        k = len(m.languages)
        place = {x: i for i, x in enumerate(m.languages)}
        other = np.log((1 - m.declared_trust) / max(1, k - 1)) if k > 1 else np.log(0.5)
        overall = np.log(m.overall)
        for batch in batches:
            values = T.column_bytes(batch.column(batch.schema.get_field_index("text")))
            said = batch.column(batch.schema.get_field_index("_x_declared")).to_pylist()
            hosts = batch.column(batch.schema.get_field_index("_x_host")).to_pylist()
            prior = batch.column(batch.schema.get_field_index("_x_prior")).to_pylist() if m.priors is None else None
            for a, b in T.slices(values):
                n = b - a
                if k:
                    ids, first = trigrams(values[a:b], m.weights.shape[1])
                    size = np.diff(first)
                    text = np.empty((n, k))
                    for j in range(k):
                        total = np.zeros(len(ids) + 1)
                        np.cumsum(m.weights[j][ids], out=total[1:])
                        text[:, j] = np.diff(total[first])
                    post = text.copy()
                    for i in range(n):
                        post[i] += overall if (p := prior[a + i] if prior is not None else m.priors.get(hosts[a + i])) is None else p
                        if (at := place.get(said[a + i])) is not None:
                            post[i] += other
                            post[i, at] += np.log(m.declared_trust) - other
                    post = np.round(post, 6)
                    best = post.argmax(axis=1)
                    sure = 1 / np.exp(post - post.max(axis=1, keepdims=True)).sum(axis=1)
                    some = size > 0
                    known = some & (text[np.arange(n), best] >= m.floor * size - _SLACK)
                    own = np.round(text, 6).argmax(axis=1)
                    new = [
                        [m.languages[i] if ok else "und" for i, ok in zip(best.tolist(), known.tolist(), strict=True)],
                        np.where(known, np.round(sure, 9), 0.0),
                        [m.languages[i] if ok else None for i, ok in zip(own.tolist(), some.tolist(), strict=True)],
                        known & (sure >= least),
                    ]
                else:
                    new = [["und"] * n, np.zeros(n), [None] * n, np.zeros(n, bool)]
                part = batch.slice(a, n)
                yield pa.RecordBatch.from_arrays([*(T.as_type(x, f.type) for x, f in zip(part.columns[: len(names)], arrow, strict=False)), *(pa.array(x, f.type) for x, f in zip(new, list(arrow)[len(names) :], strict=True))], schema=arrow)

    return given.mapInArrow(run, schema)


def identify_documents(docs: DataFrame, *, declared: str = "lang", host: str = "source") -> DataFrame:
    """Fits on `docs` and identifies them; the source of a document stands for its host."""
    model, priors = fit_languages(docs, declared=F.col(declared), host=F.col(host))
    return identify(docs, model, declared=F.col(declared), host=F.col(host), priors=priors)


def identify_pages(pages: DataFrame, text: Column, save: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Pages with their extracted `text`: markup declares the language, the address gives host and suffix.

    `save` writes the table and returns it as read, so that `text` is made once for the model and the pages.
    """
    h = address_host(F.col("url"))
    given = pages.withColumn("text", text).withColumns({"_p_declared": markup_lang(F.col("html")), "_p_host": h, "_p_suffix": F.regexp_extract(h, r"([^.]+)$", 1)})
    if save:
        given = save(given)
    kw = {"declared": F.col("_p_declared"), "host": F.col("_p_host")}
    model, priors = fit_languages(given, **kw, suffix=F.col("_p_suffix"))
    return identify(given, model, **kw, priors=priors).drop("_p_declared", "_p_host", "_p_suffix")
