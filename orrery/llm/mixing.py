"""Mixing sources to target weights: equal blocks of words, apportioned by Sainte-Laguë, chosen by a seed.

1. Each source gets its share of the words of the mix by its weight; no share exceeds `most` times what the source has, and what is above goes to the others by weight.
2. The mix has a fixed number of blocks of `block_words` words. They go one by one to the source of the highest quotient share / (2 k + 1), k being what it has already, and those of
   a source likewise to its shards, by their words. Nobody ranks all blocks: divisors on either side of the right one bound each number of blocks to a small range,
   and only the quotients in it are ranked.
3. Documents lie on the line of their shard in the order of a seeded hash, and the line is cut in blocks. A quota of q of n blocks takes the whole line q div n times, and
   q mod n blocks more, evenly spaced from a seeded offset on: since the order is random, this is a random choice, and which parts of a document it hits follows from where it lies.

All of it is DataFrame functions. Texts don't move: what is shuffled is a row of numbers for each document, equal documents in one row with their number.

**Defined results.** A null text has no words; a document without words takes nothing. Null sources are one source, the last. Rows of one id are documents each; equal
rows count each and may get different parts. An empty table gives no rows. Other columns don't matter. The same rows give the same mix, whatever their order and partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import numbered
from .storage import store

WORD = r"[^\x20\x09-\x0D]+"
_KEY = ["doc_id", "source", "mark", "size"]


def _number(*parts) -> Column:
    """32 bits of a hash of a seed and columns, as a number."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")


def _div(a: Column, b: Column) -> Column:
    """Whole quotient of whole numbers that aren't negative, 0 by 0."""
    return F.when(b == 0, F.lit(0)).otherwise(F.call_function("div", a, b)).cast("long")


def apportion(cells: DataFrame, group: list[str], order: list, seats: str, votes: str, most: str) -> DataFrame:
    """`cells` with `quota`: how many of its group's `seats` each gets by the highest quotients votes / (2 k + 1), and no more than `most`.

    With n cells, all seats M and all votes T, the seats at a divisor T / (M - n / 2) are never too many, those at T / (M + n / 2) never too few. `order` settles equal quotients.
    """
    stats = cells.groupBy(*group).agg(F.sum(votes).alias("_t"), F.count("*").alias("_n"))
    joined = _join(cells, stats, group)
    at = lambda m: F.when(F.col("_t") > 0, F.floor(F.col(votes) * m / F.col("_t") + 0.5)).otherwise(0).cast("long")
    low = F.least(at(F.greatest(F.lit(0.0), F.col(seats) - F.col("_n") / 2)), F.col(most))
    high = F.least(at(F.col(seats) + F.col("_n") / 2) + 1, F.col(most))
    bounds = store(cells.sparkSession, joined.withColumns({"_low": low, "_high": high}), "quotas")
    left = bounds.groupBy(*group).agg((F.max(seats) - F.sum("_low")).alias("_left"))
    tried = bounds.where("_high > _low").withColumn("_k", F.explode(F.sequence(F.col("_low"), F.col("_high") - 1)))
    ranked = numbered(tried.withColumn("_q", F.col(votes) / (2 * F.col("_k") + 1)), group, [F.desc("_q"), *order, "_k"], "_rank")
    won = _join(ranked, left, group).where("_rank <= _left")
    keys = [*group, *[c for c in order if isinstance(c, str)]]
    more = won.groupBy(*keys).agg(F.count("*").alias("_more"))
    return _join(bounds, more, keys, "left").withColumn("quota", F.col("_low") + F.coalesce("_more", F.lit(0))).select(*cells.columns, "quota")


def _join(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """On keys that may be null."""
    b = b.select(*[F.col(k).alias(f"_on{i}") for i, k in enumerate(keys)], *[c for c in b.columns if c not in keys])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & a[k].eqNullSafe(b[f"_on{i}"])
    return a.join(b, same, how).drop(*[f"_on{i}" for i in range(len(keys))])


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: tuple[int, int], most: int) -> tuple[DataFrame, int]:
    """`sizes` (source, source_size) with `target`, the words it should give; and all words of all sources.

    Rounds settle who is at its limit: each is a sum over the table of sources, and one that is at the limit stays there.
    """
    spark = sizes.sparkSession
    n = numbered(sizes, [], [F.col("source").asc_nulls_last()], "_i")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("_i") - 1) % len(weights) + 1).cast("int"))
    given = store(spark, n.withColumn("weight", weight.cast("long")).drop("_i"), "sources")
    total = given.agg(F.sum("source_size")).first()[0] or 0
    words = share[0] * total / share[1]
    limit = most * F.col("source_size")
    level, before = None, -1
    while True:
        full = F.lit(False) if level is None else limit * level[1] < level[0] * F.col("weight")
        at, held, free = given.agg(F.count_if(full), F.sum(F.when(full, limit)), F.sum(F.when(~full, F.col("weight")))).first()
        if at == before or not free:
            break
        level, before = (words - (held or 0), free), at
    if level is None or not total:
        return given.withColumn("target", F.lit(0.0)), total
    full = limit * level[1] < level[0] * F.col("weight")
    return given.withColumn("target", F.when(full, limit.cast("double")).otherwise(F.lit(float(level[0])) * F.col("weight") / F.lit(float(level[1])))), total


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: tuple[int, int] = (3, 2), most: int = 2, block_words: int = 64, shard_words: int = 1 << 18, seed: str = "mix") -> DataFrame:
    """For each document (doc_id, text, source): doc_id, source, mark, size, source_size, target, passes and spans.

    The mix takes the whole document `passes` times and beside it the words of `spans` (`from` and `upto`, counted from 0). `share` is the size of the mix against all words, as a fraction,
    `weights` go to the sources in the order of their names, again and again. `mark` tells texts of one id apart.
    """
    spark = docs.sparkSession
    counted = docs.select("doc_id", "source", F.xxhash64("text").alias("mark"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    rows = store(spark, counted.groupBy(*_KEY).agg(F.count("*").alias("copies")), "mix-documents")
    sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    sources, total = source_targets(sizes, weights, share, most)
    blocks = (2 * share[0] * total + share[1] * block_words) // (2 * share[1] * block_words)
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words))
    placed = _join(rows, sources.select("source", shards.cast("long").alias("_shards")), ["source"])
    placed = store(spark, placed.withColumn("_at", F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string")))).withColumn("shard", F.pmod(F.conv(F.substring("_at", 9, 8), 16, 10).cast("long"), F.col("_shards"))), "mix-shards")
    cells = placed.groupBy("source", "shard").agg(F.sum(F.col("size") * F.col("copies")).alias("words"))
    cells = store(spark, cells.withColumn("blocks", _div(F.col("words") + block_words - 1, F.lit(block_words))), "mix-cells")
    room = cells.groupBy("source").agg((most * F.sum("blocks")).alias("most"))
    of_source = apportion(_join(sources, room, ["source"]).withColumn("seats", F.lit(blocks)), [], ["source"], "seats", "target", "most")
    given = _join(cells, of_source.select("source", F.col("quota").alias("seats")), ["source"]).withColumn("most", most * F.col("blocks"))
    quotas = apportion(given, ["source"], ["shard"], "seats", "words", "most")
    quotas = quotas.withColumn("_offset", F.when(F.col("blocks") > 0, _number(F.lit(seed), F.coalesce("source", F.lit("")), F.col("shard").cast("string")) % F.col("blocks")).otherwise(0))
    line = Window.partitionBy("source", "shard").orderBy("_at", "doc_id", "mark", "size")
    on_line = placed.withColumn("_start", F.sum(F.col("size") * F.col("copies")).over(line) - F.col("size") * F.col("copies"))
    cut = _join(on_line, quotas.select("source", "shard", F.col("blocks").alias("_blocks"), F.col("quota").alias("_quota"), "_offset"), ["source", "shard"])
    cut = cut.withColumns({"passes": _div(F.col("_quota"), F.col("_blocks")), "_more": F.when(F.col("_blocks") > 0, F.col("_quota") % F.col("_blocks")).otherwise(0)})
    cut = cut.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).withColumn("_from", F.col("_start") + F.col("_copy") * F.col("size"))
    end, width = F.col("_from") + F.col("size"), F.lit(block_words)
    before = lambda j: F.call_function("div", j * F.col("_more") + F.col("_offset"), F.col("_blocks"))
    own = F.filter(F.sequence(_div(F.col("_from"), width), _div(end - 1, width)), lambda j: before(j + 1) > before(j))
    spans = F.transform(own, lambda j: F.struct((F.greatest(j * width, F.col("_from")) - F.col("_from")).alias("from"), (F.least((j + 1) * width, end) - F.col("_from")).alias("upto")))
    none = F.array().cast("array<struct<from:bigint,upto:bigint>>")
    mixed = cut.withColumn("spans", F.when((F.col("size") > 0) & (F.col("_more") > 0), spans).otherwise(none))
    return _join(mixed.select(*_KEY, "passes", "spans"), sources.select("source", "source_size", "target"), ["source"]).select(*_KEY, "source_size", "target", "passes", "spans")


def taken_words() -> Column:
    """How many words a document gives, from passes and spans."""
    return F.col("passes") * F.col("size") + F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["upto"] - s["from"])


def mixed_texts(docs: DataFrame, mix: DataFrame) -> DataFrame:
    """doc_id, source and text of every passage of the mix, its words joined by single spaces: a document as often as it passes, and each of its spans."""
    texts = docs.select("doc_id", "source", "text", F.xxhash64("text").alias("mark")).dropDuplicates(["doc_id", "source", "mark"])
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    both = _join(mix, texts, ["doc_id", "source", "mark"]).withColumn("_words", words)
    whole = F.transform(F.array_repeat(F.lit(0), F.col("passes").cast("int")), lambda _: F.array_join("_words", " "))
    parts = F.transform("spans", lambda s: F.array_join(F.slice("_words", (s["from"] + 1).cast("int"), (s["upto"] - s["from"]).cast("int")), " "))
    return both.select("doc_id", "source", F.explode(F.concat(whole, parts)).alias("text")).where("text <> ''")
