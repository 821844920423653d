"""Perceptual hashes kept with their near ones, so that a scan compares what is new with what is stored and nothing else."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..segments import Segments
from .duplicates import _bands, bands_are_selective, bits_to_limbs, close_to_new, hamming, packed, similarity


class HashStore:
    """Hashes (texts of 0 and 1) by asset, below `folder`.

    What is near is a matter of hashes, not of assets: the bands and the close pairs of each distinct hash are written once, when it first comes, and never change. An asset that changes its hash, or goes,
    changes its own row only. Two hashes within `threshold` bits share `together` of `threshold + together` bands; more together make bands more selective, and more rows for each hash.
    Where these bands would give more candidates than there is work in comparing all (short hashes, large thresholds), none are kept: new hashes are compared with all in blocks.
    An addition counts once its rows of assets are written, so one that broke off can be repeated under its number. Null hashes are no hashes; an asset with one has none any more.
    """

    def __init__(self, spark: SparkSession, folder: str, bits: int = C.HASH_BITS, threshold: int = C.HAMMING_THRESHOLD, together: int = 2):
        if not 1 <= together <= bits - threshold:
            raise ValueError("bands need a bit each")
        self.spark, self.bits, self.threshold, self.together = spark, bits, threshold, together
        self.banded = bands_are_selective(threshold, bits, together)
        self.members = Segments(spark, f"{folder}/members", "assetId long, hash string, deleted boolean", ["assetId"])
        self.hashes = Segments(spark, f"{folder}/hashes", "hash string", ["hash"])
        self.bands = Segments(spark, f"{folder}/bands", "band int, value string, hash string", ["hash"])
        self.close = Segments(spark, f"{folder}/close", "x binary, y binary, hammingDistance int", ["x", "y"])

    def _banded(self, hashes: DataFrame) -> DataFrame:
        parts = _bands(bits_to_limbs(F.col("hash"), self.bits), self.bits, self.threshold + self.together, self.together)
        return hashes.select("hash", F.explode(parts).alias("b")).select(F.col("b.band").alias("band"), F.col("b.value").alias("value"), "hash")

    def _distance(self, x: Column, y: Column) -> Column:
        return hamming(bits_to_limbs(x, self.bits), bits_to_limbs(y, self.bits), self.bits)

    def _near(self, left: DataFrame, right: DataFrame, ordered: bool) -> DataFrame:
        """Distinct close pairs of two banded tables; of one table with itself, `ordered` gives each once."""
        a, b = left.withColumnRenamed("hash", "x"), right.withColumnRenamed("hash", "y")
        d = self._distance(F.col("x"), F.col("y"))
        found = a.join(b, ["band", "value"]).where((F.col("x") < F.col("y")) if ordered else (F.col("x") != F.col("y"))).where(d <= self.threshold)
        found = found.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), d.alias("hammingDistance")).distinct()
        return found.select(packed(F.col("x"), self.bits).alias("x"), packed(F.col("y"), self.bits).alias("y"), "hammingDistance")

    def update(self, assets: DataFrame, number: int, gone: DataFrame | None = None) -> bool:
        """Takes in new and changed hashes (assetId, hash) and assets that are gone (assetId). False if the number is there already."""
        last = self.members.last()
        if last is not None and number <= last:
            return False
        own = assets.groupBy("assetId").agg(F.max("hash").alias("hash")).select("assetId", "hash", F.col("hash").isNull().alias("deleted"))
        if gone is not None:
            dead = gone.select("assetId").distinct().join(own.select("assetId"), "assetId", "left_anti")
            own = own.unionByName(dead.select("assetId", F.lit(None).cast("string").alias("hash"), F.lit(True).alias("deleted")))
        before = -1 if last is None else last
        fresh = own.where("hash IS NOT NULL").select("hash").distinct().join(self.hashes.rows(before).select("hash"), "hash", "left_anti")
        self.hashes.add(fresh, number)
        known = self.hashes.rows(number)
        new, old = known.where(F.col("number") == number), known.where(F.col("number") < number)
        if self.banded:
            self.bands.add(self._banded(new).repartitionByRange("band", "value").sortWithinPartitions("band", "value"), number)
            banded = self.bands.rows(number)
            new = banded.where(F.col("number") == number).drop("number")
            old = banded.where(F.col("number") < number).drop("number")
            self.close.add(self._near(new, old, False).unionByName(self._near(new, new, True)), number)
        else:
            self.close.add(close_to_new(new, old, self.threshold, self.bits), number)
        return self.members.add(own, number)

    def current(self) -> DataFrame:
        return self.members.latest().select("assetId", "hash")

    def pairs(self) -> DataFrame:
        """canonicalAssetId, duplicateAssetId, hammingDistance, similarity of representatives, the smallest asset of each hash, and of each copy with its own: what a scan of all gives that doesn't list copies."""
        now = self.current()
        rep = now.groupBy("hash").agg(F.min("assetId").alias("rep"))
        key = packed(F.col("hash"), self.bits)
        known = self.close.rows(self.members.last()).select("x", "y", "hammingDistance")
        near = known.join(rep.select(key.alias("x"), F.col("rep").alias("a")), "x").join(rep.select(key.alias("y"), F.col("rep").alias("b")), "y")
        near = near.select(F.least("a", "b").alias("canonicalAssetId"), F.greatest("a", "b").alias("duplicateAssetId"), "hammingDistance")
        copies = now.join(rep, "hash").where("rep <> assetId").select(F.col("rep").alias("canonicalAssetId"), F.col("assetId").alias("duplicateAssetId"), F.lit(0).alias("hammingDistance"))
        return near.unionByName(copies).withColumn("similarity", similarity(F.col("hammingDistance"), self.bits))

    def near_hash(self, bits: str) -> DataFrame:
        """assetId and hammingDistance of the assets near any hash, stored or not: only its own bands are read, or all distinct hashes where no bands are kept."""
        d = self._distance(F.col("hash"), F.lit(bits))
        if not self.banded:
            found = self.hashes.rows(self.members.last()).where(d <= self.threshold).select("hash", d.alias("hammingDistance"))
            return self.current().join(found, "hash").select("assetId", "hammingDistance")
        one = self.spark.createDataFrame([(bits,)], "hash string")
        keys = self._banded(one).select("band", "value").collect()  # of one hash
        wanted = F.lit(False)
        for band in sorted({k["band"] for k in keys}):
            wanted |= (F.col("band") == band) & F.col("value").isin([k["value"] for k in keys if k["band"] == band])
        found = self.bands.rows(self.members.last()).where(wanted).select("hash").distinct().where(d <= self.threshold).withColumn("hammingDistance", d)
        return self.current().join(found, "hash").select("assetId", "hammingDistance")

    def compact(self) -> None:
        """One base for each table. Hashes that no asset has any more stay, as they may come again."""
        end = self.members.last()
        for table in (self.hashes, self.close, *([self.bands] if self.banded else [])):
            table.compact(merged=False, upto=end)
        self.members.compact(upto=end)


def scan(store: HashStore, assets: DataFrame, number: int, known: DataFrame, save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Takes in hashes and gives the pairs that the store has now and `known` (canonicalAssetId, duplicateAssetId) hasn't, resolved or not."""
    store.update(assets, number)
    return save(store.pairs().join(known.select("canonicalAssetId", "duplicateAssetId"), ["canonicalAssetId", "duplicateAssetId"], "left_anti"))
