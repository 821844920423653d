"""Stored structures of search: a dictionary of tokens, an index of substrings, postings with bounds, and an index that takes changes as additions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..segments import Segments
from .search_index import near_token, top_k, totals


def _sorted(df: DataFrame, *keys: str) -> DataFrame:
    """In the order of its keys, so that a filter on the first reaches the statistics of few row groups."""
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def _dealt(df: DataFrame, *keys: str) -> DataFrame:
    """By its keys, before they are grouped: in a split of a stored index, many millions of short rows, hardly two have the same keys, and a task that groups them first holds them all."""
    return df.repartition(*keys)


def _less_one(word: Column) -> Column:
    """The word and all it becomes less one letter after the second. Two words with the same first two letters that are one edit apart share one of these."""
    n = F.char_length(word)
    cut = F.transform(F.when(n > 2, F.sequence(F.lit(3), n)).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1)))
    return F.array_distinct(F.array_append(cut, word))


class Dictionary:
    """Tokens with their number of assets, in order, and each token of four letters or more under what it becomes less one letter: an edit is an equality, a prefix a range.

    Found without postings: a term that is missed costs reads of a few row groups. Null tokens are left out; an empty index has an empty dictionary.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def write(self, index: DataFrame) -> None:
        held = index.where(F.col("token").isNotNull()).select("token", "assetId")
        tokens = _dealt(held, "token", "assetId").distinct().groupBy("token").agg(F.count("assetId").alias("df"))
        _sorted(tokens, "token").write.mode("overwrite").parquet(f"{self.folder}/tokens")
        near = self.tokens().where(F.char_length("token") >= 3).select(F.explode(_less_one(F.col("token"))).alias("less"), "token")
        _sorted(near, "less", "token").write.mode("overwrite").parquet(f"{self.folder}/near")

    def tokens(self) -> DataFrame:
        return self.spark.read.schema("token string, df long").parquet(f"{self.folder}/tokens")

    def near(self) -> DataFrame:
        return self.spark.read.schema("less string, token string").parquet(f"{self.folder}/near")

    def near_words(self, words: DataFrame) -> DataFrame:
        """word and token: the tokens within one edit of each word of four letters or more (`word`), for tables of any size."""
        given = words.where(F.char_length("word") >= 4).select("word").distinct().select("word", F.explode(_less_one(F.col("word"))).alias("less"))
        return given.join(self.near(), "less").where(near_token(F.col("word"))).select("word", "token").distinct()

    def match(self, variants: dict[str, list[str]]) -> DataFrame:
        """term and token: exact variants; a term none of whose variants is there has the tokens that its first variant with a hit begins, or else those near it.

        The same as comparing with every token, as `match_tokens` does. The terms of one query are few.
        """
        rows = [(t, v, i) for t, vs in variants.items() for i, v in enumerate(vs)]
        if not rows:
            return self.spark.createDataFrame([], "term string, token string")
        terms = F.broadcast(self.spark.createDataFrame(rows, "term string, variant string, ord int"))  # a query's
        words = list({v for _, v, _ in rows})
        exact = self.tokens().where(F.col("token").isin(words)).join(terms, F.col("token") == F.col("variant")).select("term", "token")
        begun = F.lit(False)
        for w in words:
            begun |= F.startswith("token", F.lit(w))
        prefixed = self.tokens().where(begun).join(terms, F.startswith("token", F.col("variant"))).select("term", "token", (F.col("ord") * 2).alias("rank"))
        less = list({w[:i] + w[i + 1 :] for w in words if len(w) >= 4 for i in range(2, len(w))} | {w for w in words if len(w) >= 4})
        keyed = terms.select("term", "variant", "ord", F.explode(_less_one(F.col("variant"))).alias("less"))
        near = self.near().where(F.col("less").isin(less)).join(F.broadcast(keyed), "less").where(near_token(F.col("variant"))).select("term", "token", (F.col("ord") * 2 + 1).alias("rank"))
        graded = prefixed.unionByName(near).join(exact.select("term").distinct(), "term", "left_anti")
        best = graded.groupBy("term").agg(F.min("rank").alias("best"))
        return exact.unionByName(graded.join(best, "term").where(F.col("rank") == F.col("best")).select("term", "token")).distinct()


class SubstringIndex:
    """Which of many texts (id, text) hold words anywhere: postings of three letters, the rarest of a query intersected, then the texts themselves asked.

    Texts lie in folders by blocks of ids, so that only those of candidates are read. Words of fewer than three letters alone are looked for in all texts. Case doesn't matter. Null texts hold nothing.
    """

    SIZE = 3

    def __init__(self, spark: SparkSession, folder: str, block: int = 1 << 16):
        self.spark, self.folder, self.block = spark, folder.rstrip("/"), block

    def write(self, texts: DataFrame) -> None:
        own = texts.where(F.col("text").isNotNull()).select(F.col("id").cast("long"), F.lower("text").alias("text")).withColumn("block", F.floor(F.col("id") / self.block))
        own.repartitionByRange("block", "id").write.mode("overwrite").partitionBy("block").parquet(f"{self.folder}/texts")
        n = F.char_length("text")
        grams = F.array_distinct(F.transform(F.when(n >= self.SIZE, F.sequence(F.lit(1), n - (self.SIZE - 1))).otherwise(F.array().cast("array<int>")), lambda i: F.substr("text", i, F.lit(self.SIZE))))
        _sorted(self._texts().select(F.explode(grams).alias("gram"), "id", "block").distinct(), "gram", "id").write.mode("overwrite").parquet(f"{self.folder}/grams")
        sizes = self._grams().groupBy("gram").agg(F.count("*").alias("n"))
        _sorted(sizes, "gram").write.mode("overwrite").parquet(f"{self.folder}/sizes")

    def _texts(self) -> DataFrame:
        return self.spark.read.schema("id long, text string, block long").parquet(f"{self.folder}/texts")

    def _grams(self) -> DataFrame:
        return self.spark.read.schema("gram string, id long, block long").parquet(f"{self.folder}/grams")

    def candidates(self, words: Sequence[str], rarest: int = 3) -> DataFrame | None:
        """id and block of the texts that hold the rarest parts of all words; None if no word is long enough to have any."""
        parts = {w[i : i + self.SIZE] for w in words for i in range(len(w) - self.SIZE + 1)}
        if not parts:
            return None
        sizes = self.spark.read.schema("gram string, n long").parquet(f"{self.folder}/sizes").where(F.col("gram").isin(list(parts)))
        known = {r["gram"]: r["n"] for r in sizes.collect()}  # a query's
        chosen = sorted(parts, key=lambda g: (known.get(g, 0), g))[:rarest]
        hits = self._grams().where(F.col("gram").isin(chosen)).groupBy("id", "block").agg(F.count("*").alias("n"))
        return hits.where(F.col("n") == len(chosen)).select("id", "block")

    def search(self, query: str) -> DataFrame:
        """The ids of texts that hold every word of the query."""
        words = query.lower().split()
        found, holds = self.candidates(words), F.lit(True)
        for w in words:
            holds &= F.contains("text", F.lit(w))
        texts = self._texts() if found is None else self._texts().join(found, ["block", "id"], "left_semi")
        return texts.where(holds).select("id").distinct()


class BoundedPostings:
    """Postings by token and block of assets, with the greatest part of a score that an asset of the block has by the token, so that the best k need not be found among all.

    The assets of a query's rarest tokens give a score that k assets reach. A block whose greatest parts together don't reach it holds none of the best k, and isn't read.
    """

    def __init__(self, spark: SparkSession, folder: str, block: int = 4096, k1: float = C.BM25_K1):
        self.spark, self.folder, self.block, self.k1 = spark, folder.rstrip("/"), block, k1

    def write(self, index: DataFrame) -> None:
        part = F.col("tf") * (self.k1 + 1) / (F.col("tf") + self.k1) * F.col("fieldWeight").cast("double")
        own = _dealt(index.where(F.col("token").isNotNull()), "token", "assetId").groupBy("token", "assetId").agg(F.sum(part).alias("part")).withColumn("block", F.floor(F.col("assetId") / self.block))
        _sorted(own.select("token", "block", "assetId", "part"), "token", "block", "assetId").write.mode("overwrite").parquet(f"{self.folder}/postings")
        heads = self.postings().groupBy("token", "block").agg(F.max("part").alias("top"), F.count("*").alias("n"))
        _sorted(heads, "token", "block").write.mode("overwrite").parquet(f"{self.folder}/heads")
        totals(index).write.mode("overwrite").parquet(f"{self.folder}/totals")

    def postings(self) -> DataFrame:
        return self.spark.read.schema("token string, block long, assetId long, part double").parquet(f"{self.folder}/postings")

    def heads(self) -> DataFrame:
        return self.spark.read.schema("token string, block long, top double, n long").parquet(f"{self.folder}/heads")

    def _idf(self, tokens: Sequence[str]) -> tuple[dict[str, int], Column]:
        n = self.spark.read.parquet(f"{self.folder}/totals").first()["n_assets"]
        df = {r["token"]: r["df"] for r in self.heads().where(F.col("token").isin(list(tokens))).groupBy("token").agg(F.sum("n").alias("df")).collect()}  # a query's
        idf = F.lit(None).cast("double")
        for t, d in df.items():
            idf = F.when(F.col("token") == t, F.log((F.lit(n) - F.lit(d) + 0.5) / (F.lit(d) + 0.5) + 1)).otherwise(idf)
        return df, idf

    def read_for(self, tokens: Sequence[str], k: int) -> DataFrame:
        """The postings, with `score`, that can matter for the best k."""
        df, idf = self._idf(tokens)
        own = self.postings().where(F.col("token").isin(list(df))).withColumn("score", F.col("part") * idf)
        rare, held = [], 0
        for t in sorted(df, key=lambda t: (df[t], t)):
            if held >= k:
                break
            rare.append(t)
            held += df[t]
        if len(rare) == len(df):
            return own
        reached = own.where(F.col("token").isin(rare)).groupBy("assetId").agg(F.sum("score").alias("score")).orderBy(F.desc("score")).limit(k).agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
        if reached["n"] < k:
            return own
        bound = self.heads().where(F.col("token").isin(list(df))).groupBy("block").agg(F.sum(F.col("top") * idf).alias("bound"))
        # Scores are compared to nine digits.
        return own.join(bound.where(F.col("bound") >= reached["least"] - 1e-8).select("block"), "block", "left_semi")

    def search(self, tokens: Sequence[str], k: int = C.RANK_CAP) -> DataFrame:
        """assetId and score of the best k."""
        return top_k(self.read_for(tokens, k).groupBy("assetId").agg(F.sum("score").alias("score")), k)


class IndexSegments:
    """A search index that takes changes as additions: the new postings of changed fields, and a mark for each changed or deleted field, which hides its postings in earlier ones.

    Reading merges; compaction by size writes one base. An addition counts once its marks are written, so readers see all of it or nothing, and one that broke off can be repeated under its number.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str = "assetId long, field string, token string, tf int, fieldWeight decimal(3,2)"):
        self.spark = spark
        self.postings = Segments(spark, f"{folder}/postings", schema, ["assetId", "field"])
        self.marks = Segments(spark, f"{folder}/marks", "assetId long, field string", ["assetId", "field"])

    def start(self, index: DataFrame) -> None:
        self.postings.add(index, 0)
        self.marks.add(index.select("assetId", "field").limit(0), 0)

    def update(self, fresh: DataFrame, number: int, gone: DataFrame | None = None) -> bool:
        """New postings of some fields; `gone` (assetId, field) names fields that have none any more. Only rows of these fields are written. False if the number is there already."""
        last = self.marks.last()
        if last is not None and number <= last:
            return False
        self.postings.add(fresh, number)
        changed = fresh.select("assetId", "field")
        return self.marks.add((changed if gone is None else changed.unionByName(gone.select("assetId", "field"))).distinct(), number)

    def delete_assets(self, assets: DataFrame, number: int) -> bool:
        """Hides all fields of some assets (assetId)."""
        fields = self.read().join(assets.select("assetId").distinct(), "assetId", "left_semi").select("assetId", "field").distinct()
        return self.update(self.read().limit(0), number, fields)

    def read(self, tokens: Sequence[str] | None = None, numbers: bool = False) -> DataFrame:
        """The postings that count, all or those of some tokens: the filter reaches the files before marks are joined."""
        end = self.marks.last()
        rows = self.postings.rows(-1 if end is None else end)
        if tokens is not None:
            rows = rows.where(F.col("token").isin(list(tokens)))
        marks = self.marks.rows(-1 if end is None else end).groupBy("assetId", "field").agg(F.max("number").alias("_at"))
        live = rows.join(marks, ["assetId", "field"], "left").where(F.col("_at").isNull() | (F.col("number") >= F.col("_at")))
        return live.select(*self.postings.schema.names, *(["number"] if numbers else []))

    def compact(self, share: float = 0.0) -> bool:
        """Writes a new base, if what came since the last is at least this share of it; marks up to there are no longer needed."""
        sizes = {tuple(k.split("=")): v for k, v in self.postings.sizes().items()}
        at = max((int(n) for kind, n in sizes if kind == "base"), default=None)
        base = sizes.get(("number", "0"), 0) if at is None else sizes["base", str(at)]
        since = sum(v for (kind, n), v in sizes.items() if kind == "number" and int(n) > (at or 0))
        if since < share * base:
            return False
        live = self.read(numbers=True)
        end = self.marks.last()
        self.postings.compact(rows=live, upto=end)
        self.marks.compact(rows=self.marks.rows().limit(0), upto=end)
        return True


__all__ = ["BoundedPostings", "Dictionary", "IndexSegments", "SubstringIndex"]
