"""Quality rules: log-likelihood ratio of hashed n-grams between trusted and raw text.

Two multinomials over `buckets` hashed words and word pairs are counted over all documents: one
of every text, one of the texts labelled good (a bounded sample of labels). A text's score is the
mean log ratio of its n-grams; a document is kept if the score reaches a threshold that depends on
the labelled sample only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.pandas.types import to_arrow_schema

from . import textcore as T

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_PAIR = np.uint64(0xC2B2AE3D27D4EB4F)

RESULT = S.StructType(
    [S.StructField(n, S.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [S.StructField("base_failed", S.BooleanType()), S.StructField("score", S.DoubleType()), S.StructField("kept", S.BooleanType())]
)


def _repeated(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which entries are equal to another one of the same text."""
    keys = T.mix(h ^ T.mix(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys)
    s = keys[order]
    same = s[1:] == s[:-1]
    out = np.zeros(len(h), bool)
    out[order] = np.append(same, False)[: len(h)] | np.append(False, same)[: len(h)]
    return out


def _per_text(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[first])


class Counted:
    """Counts of some texts that the rules need."""

    def __init__(self, values: list, repeat_width: int = 8):
        t = self.texts = T.join_texts(values)
        w = self.words = T.find_words(t)
        self.hashes = T.range_hashes(t.buf, w.starts, w.ends)
        chars = T.code_points(t.buf)
        self.n_words = w.counts
        self.word_chars = _per_text(chars[w.ends] - chars[w.starts], w.first)
        total = np.zeros(len(t.buf) + 1, np.int64)
        np.cumsum(_SYMBOL[t.buf], out=total[1:])
        self.n_symbols = total[t.ends] - total[t.starts]
        doc = w.text_of()
        win = T.window_hashes(T.mix(self.hashes), repeat_width)
        at = np.flatnonzero(T.within(w.counts, w.first, repeat_width))
        again = np.zeros(len(win), bool)
        again[at] = _repeated(doc[at], win[at]) if len(at) else False
        self.n_repeat_words = _per_text(T.covered(again, repeat_width, len(w)), w.first)
        self.n_dup_lines = self._dup_lines(t, w)

    @staticmethod
    def _dup_lines(t: T.Texts, w: T.Words) -> np.ndarray:
        cut = t.buf == 0x0A
        cut[t.ends] = True
        ends = np.flatnonzero(cut)
        starts = np.append(t.starts[:1], ends[:-1] + 1)
        doc = np.searchsorted(t.ends, ends)
        starts = np.maximum(starts, t.starts[doc]) if len(ends) else starts
        some = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
        starts, ends, doc = starts[some], ends[some], doc[some]
        keys = T.mix(T.range_hashes(t.buf, starts, ends) ^ T.mix(doc.astype(np.uint64) + np.uint64(1)))
        _, lead = np.unique(keys, return_index=True)
        extra = np.ones(len(keys), np.int64)
        extra[lead] = 0
        return np.bincount(doc, extra, minlength=len(t)).astype(np.int64)

    def features(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of all words, then of each pair that starts at a word (-1: none)."""
        n = np.uint64(buckets)
        words = (T.mix(self.hashes) % n).astype(np.int64)
        pairs = np.full(len(words), -1, np.int64)
        at = np.flatnonzero(T.within(self.words.counts, self.words.first, 2))
        pairs[at] = (T.mix(self.hashes[at] * _PAIR + self.hashes[at + 1]) % n).astype(np.int64)
        return words, pairs


@dataclass
class QualityModel:
    """`weights`: log ratio by bucket; `threshold`: of the mean."""

    weights: np.ndarray
    threshold: float

    def scores(self, c: Counted) -> np.ndarray:
        words, pairs = c.features(len(self.weights))
        pad = np.append(self.weights, 0.0)
        total = np.zeros(len(words) + 1)
        np.cumsum(pad[words] + pad[pairs], out=total[1:])
        n = 2 * c.n_words - (c.n_words > 0)
        # Rounded, so that the order of additions within a batch doesn't show.
        return np.round(np.diff(total[c.words.first]) / np.maximum(n, 1), 9)


def choose_threshold(good: np.ndarray, bad: np.ndarray) -> float:
    """The middle of the gap that separates the labelled scores best; without both kinds, just below the good ones."""
    if not len(good):
        return 0.0
    if not len(bad):
        return float(good.min()) - 0.1
    edges = np.unique(np.concatenate([good, bad]))
    kept_good = 1 - np.searchsorted(np.sort(good), edges, "left") / len(good)
    kept_bad = 1 - np.searchsorted(np.sort(bad), edges, "left") / len(bad)
    i = int(np.argmax(np.round(kept_good - kept_bad, 12)))
    return float((edges[i] + edges[i - 1]) / 2) if i else float(edges[0]) - 0.1


def fit_quality(docs: DataFrame, labels: DataFrame, *, buckets: int = 1 << 16, max_labels: int = 20_000, smoothing: float = 1.0) -> QualityModel:
    """Counts are over all texts. `max_labels` bounds the labels of either kind that are used: those of smallest hash.

    A document that is labelled both ways counts as good; of rows of one doc_id the least score counts for the threshold. Null ids have no label.
    """

    def sample(quality: int) -> np.ndarray:
        own = labels.where((F.col("quality") == quality) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long")).distinct()
        return np.sort(np.array([r[0] for r in own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels).collect()], np.int64))

    good, bad = sample(1), sample(0)
    bad = np.setdiff1d(bad, good)

    def count(batches):
        raw, target = np.zeros(buckets + 1, np.int64), np.zeros(buckets + 1, np.int64)
        for batch in batches:
            values = T.column_bytes(batch.column(1))
            trusted = np.isin(batch.column(0).cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False), good) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for a, b in T.slices(values):
                c = Counted.__new__(Counted)
                t = T.join_texts(values[a:b])
                c.words = T.find_words(t)
                c.hashes = T.range_hashes(t.buf, c.words.starts, c.words.ends)
                own = np.repeat(trusted[a:b], c.words.counts)
                for f in c.features(buckets):
                    raw += np.bincount(f + 1, minlength=buckets + 1)
                    target += np.bincount(f[own] + 1, minlength=buckets + 1)
        at = np.flatnonzero(raw[1:])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[1:][at]), pa.array(target[1:][at])], names=["bucket", "raw", "target"])

    pairs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = pairs.mapInArrow(count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect()
    raw, target = np.full(buckets, smoothing), np.full(buckets, smoothing)
    for b, r, g in rows:
        raw[b] += r
        target[b] += g
    model = QualityModel(np.log(target / target.sum()) - np.log(raw / raw.sum()), 0.0)
    ids = docs.sparkSession.createDataFrame([(int(i), int(k)) for k, x in ((1, good), (0, bad)) for i in x], "doc_id long, good int")
    schema = "doc_id long, good int, score double"

    def score(batches):
        for batch in batches:
            values = T.column_bytes(batch.column(2))
            for a, b in T.slices(values):
                c = Counted(values[a:b])
                ok = pa.array(~_base_failed(c))
                yield pa.RecordBatch.from_arrays([*(batch.column(k)[a:b].filter(ok) for k in (0, 1)), pa.array(model.scores(c)).filter(ok)], names=["doc_id", "good", "score"])

    # One row for each label, however often its document is there: at most 2 * max_labels rows come back.
    labelled = pairs.join(F.broadcast(ids), "doc_id").select("doc_id", "good", "text").mapInArrow(score, schema).groupBy("doc_id", "good").agg(F.min("score").alias("score")).collect()
    model.threshold = choose_threshold(*(np.array([r["score"] for r in labelled if r["good"] == k]) for k in (1, 0)))
    return model


def _base_failed(c: Counted, least: int = 20, most_repeated: int = 30) -> np.ndarray:
    return (c.n_words < least) | (100 * c.n_repeat_words > most_repeated * c.n_words)


def apply_rules(docs: DataFrame, model: QualityModel, *, min_words: int = 20, max_repeated_percent: int = 30) -> DataFrame:
    """Adds counts, base_failed, the score and kept to `docs`; columns of these names in the input give way.

    n_dup_lines counts lines with a word that equal an earlier line; n_repeat_words words in
    8-word windows found twice or more in the text, the first included. base_failed: fewer than
    `min_words` words, or more than `max_repeated_percent` percent of them repeated. kept: not base_failed
    and a score of at least the model's threshold. A null or empty text has no words, fails and scores 0. Rows
    are judged one by one, so repeated rows, ties and null ids get equal verdicts.
    """
    docs = docs.drop(*[c for c in docs.columns if c in RESULT.names])
    schema = S.StructType([*docs.schema.fields, *RESULT.fields])
    arrow = to_arrow_schema(schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            values = T.column_bytes(batch.column(batch.schema.get_field_index("text")))
            for a, b in T.slices(values):
                c = Counted(values[a:b])
                failed = _base_failed(c, min_words, max_repeated_percent)
                score = shared.value.scores(c)
                new = [c.n_words, c.word_chars, c.n_symbols, c.n_dup_lines, c.n_repeat_words, failed, score, ~failed & (score >= shared.value.threshold)]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(T.as_type(x, f.type) for x, f in zip(part.columns, arrow, strict=False)), *map(pa.array, new)], schema=arrow)

    return docs.mapInArrow(run, schema)
