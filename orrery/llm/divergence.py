"""How sources of a language differ in their words: distances of all pairs of sources, and the terms that stand out in each.

1. **Sketch.** Every task counts in how many of its documents a (language, term) occurs, in a count-min sketch of fixed size. Sketches are merged slice by slice; an estimate is never below
   the right number, as counts are only ever shared with other terms. Of the merged sketch one bit for each cell is kept: whether it reached the least number of documents.
2. **Exact counts.** A second pass counts terms again, but only those whose bits are all set; the others can't be frequent enough and never enter a shuffle. The tables that the tasks
   have are summed by (language, source, term), and terms that the sketch let through without reason go by their exact number.
3. **Sparse joins.** Most terms don't occur in most sources. With the probability z of a term that a source lacks, the distance of sources g and h is
   V |z_g - z_h|, plus the terms of g and those of h as if the other lacked them, plus a correction for those both have: only the last needs a join of terms. The middle one is a
   sum over the distinct counts of a source, which are few.

The broadcast has `depth * width / 8` bytes at any size of the input (2 MB as set). When very many terms fill the sketch it discards less, and results stay right.

**Defined results.** Null text, lang and source are empty text. Rows of one id are documents each. A group without terms has V terms with the count 0. A language with one source has no
pairs. An empty table gives no rows. Other columns don't matter. Numbers are whole; products are taken with 38 digits.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import store

#: A term is a run of letters A-Z, taken as small ones, and of characters beyond ASCII, whose bytes are all 128 or more: everything else becomes a space.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_SLICE = 1 << 16
_SCALE, _PRIOR = 1_000_000_000, 5
_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("n_docs", pa.int64())])


def terms_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_BYTES).split()


def _cells(lang: str, terms: list[bytes], width: int, depth: int) -> np.ndarray:
    """The cell of each term in each row of the sketch: depth rows, double hashing of 128 bits."""
    prefix = lang.encode() + b"\x00"
    h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(prefix + t) for t in terms), np.uint64).reshape(-1, 2)
    return np.stack([(h[:, 0] + np.uint64(i) * (h[:, 1] | np.uint64(1))) % np.uint64(width) for i in range(depth)]).astype(np.int64)


def document_sketch(docs: DataFrame, least: int, width: int, depth: int) -> list[bytes]:
    """For each row of the merged sketch the bits of the cells with at least `least` documents. `docs`: text, lang, source."""
    slices = width // _SLICE

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Cells saturate at `least`: no more is asked of them.
        table, seen = np.zeros((depth, width), np.uint8), defaultdict(Counter)

        def pour() -> None:
            for lang, found in seen.items():
                terms = list(found)
                n = np.fromiter(found.values(), np.int64, len(terms))
                for row, at in zip(table, _cells(lang, terms, width, depth), strict=True):
                    add = np.bincount(at, n, minlength=width)
                    np.minimum(row + np.minimum(add, least), least, out=add)
                    row[:] = add
            seen.clear()

        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                if (text := text.as_py()):
                    seen[lang.as_py()].update(set(terms_of(text)))
            if sum(map(len, seen.values())) > 1 << 19:
                pour()
        pour()
        for d in range(depth):
            for s in range(slices):
                part = table[d, s * _SLICE : (s + 1) * _SLICE]
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([d * slices + s], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["slice", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task has few slices, each a fixed number of cells, whatever the number of sketches.
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(zlib.decompress(counts.as_py()), np.uint8)
                sums[s] = np.minimum(sums[s] + part.astype(np.int64), least) if s in sums else part.astype(np.int64)
        for s, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([np.packbits(total >= least).tobytes()], pa.binary())], names=["slice", "bits"])

    parts = docs.select("text", "lang").mapInArrow(count, "slice int, counts binary")
    merged = parts.repartition("slice").mapInArrow(merge, "slice int, bits binary").collect()  # depth * width / 8 bytes at most
    bits = [bytearray(width // 8) for _ in range(depth)]
    for r in merged:
        d, s = divmod(r["slice"], slices)
        bits[d][s * _SLICE // 8 : (s + 1) * _SLICE // 8] = r["bits"]
    return [bytes(b) for b in bits]


def count_terms(docs: DataFrame, least: int = 30, width: int = 1 << 22, depth: int = 4) -> DataFrame:
    """lang, source, term, n (occurrences) and n_docs of every term that at least `least` documents of its language may have. `docs`: text, lang, source without nulls."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(document_sketch(docs, least, width, depth))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, dict[bytes, bool]] = defaultdict(dict)
        bits = [np.frombuffer(b, np.uint8) for b in shared.value]
        n, held = defaultdict(Counter), defaultdict(Counter)

        def may_be_kept(lang: str, terms: list[bytes]) -> None:
            at = _cells(lang, terms, width, depth)
            ok = np.ones(len(terms), bool)
            for row, cell in zip(bits, at, strict=True):
                ok &= (row[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)
            kept[lang].update(zip(terms, ok.tolist(), strict=True))

        def poured() -> Iterator[pa.RecordBatch]:
            for (lang, source), found in n.items():
                known, docs_of = kept[lang], held[lang, source]
                if new := [t for t in found if t not in known]:
                    may_be_kept(lang, new)
                terms = [t for t in found if known[t]]
                for i in range(0, len(terms), 1 << 16):
                    own = terms[i : i + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own)), pa.array([source] * len(own)), pa.array(own, pa.binary()).cast(pa.string()), pa.array([found[t] for t in own], pa.int64()), pa.array([docs_of[t] for t in own], pa.int64())], schema=_COUNTED)
            n.clear()
            held.clear()
            kept.clear()

        for batch in batches:
            for text, lang, source in zip(*(batch.column(i) for i in range(3)), strict=True):
                if (text := text.as_py()):
                    key, terms = (lang.as_py(), source.as_py()), terms_of(text)
                    n[key].update(terms)
                    held[key].update(set(terms))
            if sum(map(len, n.values())) > 1 << 19:
                yield from poured()
        yield from poured()

    counted = docs.select("text", "lang", "source").mapInArrow(count, "lang string, source string, term string, n long, n_docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def smoothed(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 terms)), in whole numbers; 1 where a language has no terms."""
    wide = lambda c: c.cast("decimal(20,0)")
    share = F.call_function("div", wide(count + _PRIOR) * F.lit(_SCALE).cast("decimal(10,0)"), F.nullif(wide(total + _PRIOR * terms), F.lit(0)))
    return F.lit(1).cast("long") + F.coalesce(share, F.lit(0))


def _pair_distances(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, other and value of all pairs of a language's sources, each in both directions."""
    z = groups.select("lang", "source", "terms", smoothed(F.lit(0).cast("long"), F.col("total"), F.col("terms")).alias("z"))
    a, b = z.select("lang", F.col("source").alias("g"), F.col("z").alias("zg"), "terms"), z.select("lang", F.col("source").alias("h"), F.col("z").alias("zh"))
    pairs = a.join(b, "lang").where("g < h")
    # What the terms of one source would give if the other lacked them, by its distinct counts.
    levels = counts.groupBy("lang", "source", "p").agg(F.count("*").alias("m"))
    lone = lambda side, other, zo: (
        levels.select("lang", F.col("source").alias(side), "p", "m").join(z.select("lang", F.col("source").alias(other), F.col("z").alias(zo)), "lang").where(F.col(side) != F.col(other))
        .groupBy("lang", side, other).agg(F.sum(F.col("m") * F.abs(F.col("p") - F.col(zo))).alias("lone"), F.sum("m").alias("own"))
    )
    left = lone("g", "h", "zh").select("lang", "g", "h", F.col("lone").alias("lone_g"), F.col("own").alias("own_g"))
    right = lone("h", "g", "zg").select("lang", "g", "h", F.col("lone").alias("lone_h"), F.col("own").alias("own_h"))
    with_z = counts.join(z.select("lang", "source", "z"), ["lang", "source"]).select("lang", "term", "source", "p", "z")
    x = with_z.select("lang", "term", F.col("source").alias("g"), F.col("p").alias("pg"), F.col("z").alias("zx"))
    y = with_z.select("lang", "term", F.col("source").alias("h"), F.col("p").alias("ph"), F.col("z").alias("zy"))
    fix = F.abs(F.col("pg") - F.col("ph")) - F.abs(F.col("pg") - F.col("zy")) - F.abs(F.col("ph") - F.col("zx"))
    both = x.join(y, ["lang", "term"]).where("g < h").groupBy("lang", "g", "h").agg(F.sum(fix).alias("fix"), F.count("*").alias("common"))
    key, none = ["lang", "g", "h"], F.lit(0).cast("long")
    all_ = pairs.join(left, key, "left").join(right, key, "left").join(both, key, "left")
    zero = lambda c: F.coalesce(F.col(c), none)
    # Terms that neither has: all, less those of either, those of both being counted twice.
    neither = F.col("terms") - zero("own_g") - zero("own_h") + zero("common")
    value = neither * F.abs(F.col("zg") - F.col("zh")) + zero("lone_g") + zero("lone_h") + zero("fix")
    one = all_.select("lang", "g", "h", value.alias("value"))
    return one.toDF("lang", "source", "item", "value").unionByName(one.select("lang", F.col("h").alias("source"), F.col("g").alias("item"), "value"))


def audit_sources(docs: DataFrame, least: int = 30, top: int = 50, width: int = 1 << 22, depth: int = 4) -> DataFrame:
    """lang, source, part, item, value, rank: distances to the other sources of the language (`pair`), and the `top` terms that are more frequent than in the language (`term`)."""
    spark = docs.sparkSession
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    docs = docs.select(text("text"), text("lang"), text("source"))
    counted = store(spark, count_terms(docs, least, width, depth), "term-counts")
    in_lang = counted.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("n_docs").alias("_docs")).where(F.col("_docs") >= least).drop("_docs")
    in_lang = store(spark, in_lang, "language-terms")
    langs = in_lang.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    kept = store(spark, counted.join(in_lang, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "kept-terms")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = store(spark, groups.select("lang", "source", zero("total"), zero("terms"), zero("lang_total")), "groups")
    with_p = kept.join(groups, ["lang", "source"])
    with_p = store(spark, with_p.select("lang", "source", "term", smoothed(F.col("n"), F.col("total"), F.col("terms")).alias("p"), smoothed(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q")), "probabilities")
    pairs = _pair_distances(with_p, groups).withColumn("part", F.lit("pair"))
    terms = with_p.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order).alias("rank")
    out = pairs.select("lang", "source", "part", "item", "value", rank)
    return out.unionByName(terms.select("lang", "source", "part", "item", "value", rank).where(F.col("rank") <= top))
