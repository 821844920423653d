"""Near duplicates by perceptual hash: distances, a banded similarity join, pairs and clusters."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import config as C
from ..graph import connected_components
from .pairs import endpoints, neighbours, unresolved

_LIMB = 8  # hex digits in 32 bits


def hash_limbs(hex_hash: Column, bits: int = C.HASH_BITS) -> Column:
    """A hexadecimal hash as an array of 32-bit numbers."""
    return F.array(*[F.conv(F.substring(hex_hash, 1 + i * _LIMB, _LIMB), 16, 10).cast("long") for i in range(-(-bits // 32))])


def hamming(a: Column, b: Column, bits: int = C.HASH_BITS) -> Column:
    """Differing bits of two arrays of limbs."""
    return sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(-(-bits // 32))), F.lit(0)).cast("int")


def hamming_hex(a: Column, b: Column) -> Column:
    """Differing bits of two hexadecimal hashes; unequal lengths are an error."""
    digits = F.aggregate(F.sequence(F.lit(1), F.length(a)), F.lit(0), lambda n, i: n + F.bit_count(F.conv(F.substr(a, i, F.lit(1)), 16, 10).cast("long").bitwiseXOR(F.conv(F.substr(b, i, F.lit(1)), 16, 10).cast("long"))))
    return F.when(F.length(a) == F.length(b), digits).otherwise(F.raise_error(F.lit("hashes of unequal length")).cast("int"))


def similarity(distance: Column, bits: int = C.HASH_BITS) -> Column:
    return (1 - distance / F.lit(bits)).cast("decimal(5,4)")


def average_hash(values: Column) -> Column:
    """Bits of an array: whether each value reaches the mean, as a string of 0 and 1."""
    mean = F.aggregate(values, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(values)
    return F.array_join(F.transform(values, lambda x: F.when(x.cast("double") >= mean, "1").otherwise("0")), "")


def bits_to_limbs(bits: Column, n: int) -> Column:
    return F.array(*[F.conv(F.substring(bits, 1 + 32 * i, 32), 2, 10).cast("long") for i in range(-(-n // 32))])


@F.pandas_udf(StringType())
def raster_hash(rasters: pd.Series, sides: pd.Series) -> pd.Series:
    """aHash of square grey rasters (values row by row): averaged to 16 by 16, 256 bits as 64 hex digits."""

    def one(v, side: int) -> str | None:
        if v is None or len(v) != side * side or side < 16:
            return None
        a = np.asarray(v, float).reshape(side, side)
        edge = np.linspace(0, side, 17).astype(int)
        small = np.add.reduceat(np.add.reduceat(a, edge[:-1], 0), edge[:-1], 1) / np.outer(np.diff(edge), np.diff(edge))
        return np.packbits(small.ravel() >= small.mean()).tobytes().hex()

    return pd.Series([one(v, int(s)) for v, s in zip(rasters, sides, strict=True)])


def _bands(limbs: Column, bits: int, n: int, together: int = 1) -> Column:
    """Keys of `together` of `n` disjoint bit ranges each, as (number, value): two hashes that differ in at most `n - together` bits share one."""
    text = F.array_join(F.transform(limbs, lambda x: F.lpad(F.bin(x), 32, "0")), "")
    cuts = [i * bits // n for i in range(n + 1)]
    part = [F.substring(text, a + 1, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return F.array(*[F.struct(F.lit(i).alias("band"), F.concat(*[part[k] for k in own]).alias("value")) for i, own in enumerate(combinations(range(n), together))])


def bands_together(n: int, threshold: int, bits: int) -> int:
    """How many bands make a key for `n` distinct hashes, by the rows and candidates that this gives; 0 if comparing all in blocks is less work."""
    cost = {0: n * n / 100}  # blocks compare many pairs at once
    for k in range(1, 4):
        if threshold + k <= bits:
            keys = comb(threshold + k, k)
            cost[k] = 4.0 * n * keys + n * n / 2 * keys / 2.0 ** (k * bits / (threshold + k))
    return min(cost, key=cost.get)


def representatives(hashes: DataFrame) -> DataFrame:
    """rep, limbs: the smallest asset of each distinct hash. What a large group of copies shares is merged before it is joined."""
    return hashes.groupBy("limbs").agg(F.min("assetId").alias("rep")).select("rep", "limbs")


def _close_by_bands(rep: DataFrame, threshold: int, bits: int, together: int) -> DataFrame:
    banded = rep.select("rep", "limbs", F.explode(_bands(F.col("limbs"), bits, threshold + together, together)).alias("b")).select("rep", "limbs", "b.band", "b.value")
    left = banded.select("band", "value", F.col("rep").alias("a"), F.col("limbs").alias("la"))
    right = banded.select("band", "value", F.col("rep").alias("b"), F.col("limbs").alias("lb"))
    d = hamming(F.col("la"), F.col("lb"), bits)
    near = left.join(right, (left.band == right.band) & (left.value == right.value) & (F.col("a") < F.col("b")) & (d <= threshold))
    return near.select("a", "b", d.alias("hammingDistance")).distinct()


def _close_by_blocks(rep: DataFrame, threshold: int, n: int, block: int) -> DataFrame:
    """Each pair of blocks is compared as a matrix; only close pairs leave it."""
    blocks = max(1, -(-n // block))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("hammingDistance", pa.int32())])

    def run(table: pa.Table) -> pa.Table:
        i, j, own = table.column("i")[0].as_py(), table.column("j")[0].as_py(), table.column("own").to_numpy()
        ids, limbs = table.column("rep").to_numpy(), np.array(table.column("limbs").to_pylist(), np.uint64).reshape(table.num_rows, -1)
        x, y = own == i, own == j
        d = np.zeros((int(x.sum()), int(y.sum())), np.int32)
        for k in range(limbs.shape[1]):
            d += np.bitwise_count(limbs[x, k][:, None] ^ limbs[y, k][None, :])
        at, to = np.nonzero(d <= threshold)
        a, b, d = ids[x][at], ids[y][to], d[at, to]
        ok = a < b if i == j else np.ones(len(a), bool)
        a, b, d = a[ok], b[ok], d[ok]
        return pa.Table.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(d)], schema=schema)

    dealt = rep.withColumn("own", F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("o")
    dealt = dealt.select("*", other).select("rep", "limbs", "own", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"))
    return dealt.groupBy("i", "j").applyInArrow(run, "a long, b long, hammingDistance int")


def packed(bits: Column, n: int) -> Column:
    """A text of 0 and 1 as bytes, four for each 32 bits."""
    return F.unhex(F.array_join(F.transform(bits_to_limbs(bits, n), lambda x: F.lpad(F.hex(x), _LIMB, "0")), ""))


def bands_are_selective(threshold: int, bits: int, together: int) -> bool:
    """Whether keys of bands give fewer candidates than comparing all pairs in blocks costs, as in `bands_together`; the number of hashes doesn't matter."""
    return comb(threshold + together, together) / 2.0 ** (together * bits / (threshold + together)) <= 1 / 50


def close_to_new(new: DataFrame, old: DataFrame, threshold: int, bits: int, block: int = 8192) -> DataFrame:
    """x, y (packed) and hammingDistance: close pairs, each once, of which one at least is new. `new`, `old`: hash, distinct texts of 0 and 1.

    Hashes are dealt to blocks of a fixed size, a row of bytes each; every pair of blocks is compared by itself, so that a task holds two blocks and close pairs leave it as they are found.
    """
    n, m = -(-new.count() // block), -(-old.count() // block)
    width, words = 4 * -(-bits // 32), np.dtype(">u4" if -(-bits // 32) % 2 else ">u8")
    schema = pa.schema([("x", pa.binary()), ("y", pa.binary()), ("hammingDistance", pa.int32())])

    def run(batches):
        for batch in batches:
            for i, j, left, right in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                x, y = (np.frombuffer(b, words).astype(words.newbyteorder("=")).reshape(-1, width // words.itemsize) for b in (left, right))
                raw = [np.frombuffer(b, f"V{width}") for b in (left, right)]
                step = max(1, (1 << 18) // len(y))
                for at in range(0, len(x), step):
                    d = np.bitwise_count(x[at : at + step, 0][:, None] ^ y[:, 0][None, :]).astype(np.uint16 if bits > 255 else np.uint8, copy=False)
                    for k in range(1, x.shape[1]):
                        d += np.bitwise_count(x[at : at + step, k][:, None] ^ y[:, k][None, :])
                    p, q = np.nonzero(d <= threshold)
                    if i == j:
                        p, q = p[p + at < q], q[p + at < q]
                    if len(p):
                        sides = [pa.Array.from_buffers(pa.binary(width), len(p), [None, pa.py_buffer(r.tobytes())]).cast(pa.binary()) for r in (raw[0][p + at], raw[1][q])]
                        yield pa.RecordBatch.from_arrays([*sides, pa.array(d[p, q].astype(np.int32))], schema=schema)

    def blobs(hashes: DataFrame, count: int, first: int) -> DataFrame:
        dealt = hashes.select(F.hex(packed(F.col("hash"), bits)).alias("h"), (first + F.pmod(F.xxhash64("hash"), F.lit(max(1, count)))).cast("int").alias("j"))
        return dealt.groupBy("j").agg(F.unhex(F.array_join(F.collect_list("h"), "")).alias("blob"))

    # A hash that is new lies in blocks 0 to n - 1; each of these meets the new ones from itself on, and all old ones.
    own = blobs(new, n, 0)
    left = own.select(F.col("j").alias("i"), F.explode(F.sequence("j", F.lit(n + m - 1))).alias("j"), F.col("blob").alias("left"))
    later = own.select(F.explode(F.sequence(F.lit(0), F.col("j"))).alias("i"), "j", F.col("blob").alias("right"))
    stored = blobs(old, m, n).select(F.explode(F.sequence(F.lit(0), F.lit(max(0, n - 1)))).alias("i"), "j", F.col("blob").alias("right"))
    both = left.join(later.unionByName(stored), ["i", "j"]).select("i", "j", "left", "right")
    return both.repartition(max(1, n * (n + 1) // 2 + n * m), "i", "j").mapInArrow(run, "x binary, y binary, hammingDistance int")


def close_representatives(rep: DataFrame, threshold: int, bits: int, block: int = 2048) -> DataFrame:
    """Pairs (a < b) of distinct hashes within `threshold` bits: by keys of as many bands as make them selective, or all in blocks where none do."""
    n = rep.count()
    together = bands_together(n, threshold, bits)
    return _close_by_bands(rep, threshold, bits, together) if together else _close_by_blocks(rep, threshold, n, block)


def hamming_pairs(hashes: DataFrame, threshold: int = C.HAMMING_THRESHOLD, bits: int = C.HASH_BITS, expand: bool = True) -> DataFrame:
    """All pairs (canonicalAssetId < duplicateAssetId) within `threshold` bits. `hashes`: assetId, limbs.

    Equal hashes are first merged to one row. The distinct ones are matched on bands: at most `threshold` differences
    leave k of threshold + k bands untouched. With `expand` every pair of copies is listed, as the pair table has
    it; without, pairs are those of representatives and of each copy with its own, which grow with the rows only
    and have the same clusters and the same assets.
    """
    rep = representatives(hashes)
    close = close_representatives(rep, threshold, bits)
    member = hashes.join(rep.withColumnRenamed("limbs", "l"), hashes.limbs == F.col("l")).select("rep", "assetId")
    if not expand:
        star = member.where("rep <> assetId").select(F.col("rep").alias("canonicalAssetId"), F.col("assetId").alias("duplicateAssetId"), F.lit(0).alias("hammingDistance"))
        return close.toDF("canonicalAssetId", "duplicateAssetId", "hammingDistance").unionByName(star).withColumn("similarity", similarity(F.col("hammingDistance"), bits))
    wide = close.join(member.select(F.col("rep").alias("a"), F.col("assetId").alias("x")), "a").join(member.select(F.col("rep").alias("b"), F.col("assetId").alias("y")), "b").select("x", "y", "hammingDistance")
    same = member.alias("p").join(member.alias("q"), "rep").where("p.assetId < q.assetId").select(F.col("p.assetId").alias("x"), F.col("q.assetId").alias("y"), F.lit(0).alias("hammingDistance"))
    return wide.unionByName(same).select(F.least("x", "y").alias("canonicalAssetId"), F.greatest("x", "y").alias("duplicateAssetId"), "hammingDistance", similarity(F.col("hammingDistance"), bits).alias("similarity"))


def close_counts(hashes: DataFrame, threshold: int = C.HAMMING_THRESHOLD, bits: int = C.HASH_BITS) -> DataFrame:
    """assetId and n_pairs: in how many pairs each asset is, of those that are in any, without listing pairs of copies."""
    rep = representatives(hashes)
    close = close_representatives(rep, threshold, bits)
    size = hashes.groupBy("limbs").agg(F.min("assetId").alias("rep"), F.count("*").alias("size")).select("rep", "size", "limbs")
    ends = close.select(F.explode(F.array(F.struct(F.col("a").alias("rep"), F.col("b").alias("other")), F.struct(F.col("b").alias("rep"), F.col("a").alias("other")))).alias("e")).select("e.*")
    near = ends.join(size.select(F.col("rep").alias("other"), "size"), "other").groupBy("rep").agg(F.sum("size").alias("near"))
    total = size.join(near, "rep", "left").select("limbs", (F.coalesce("near", F.lit(0)) + F.col("size") - 1).alias("n_pairs")).where("n_pairs > 0")
    return hashes.join(total, "limbs").select("assetId", "n_pairs")


def hamming_pairs_naive(hashes: DataFrame, threshold: int, bits: int) -> DataFrame:
    """Every pair compared: for hashes too short for selective bands, and tables known to be small."""
    a, b = hashes.select(F.col("assetId").alias("canonicalAssetId"), F.col("limbs").alias("la")), hashes.select(F.col("assetId").alias("duplicateAssetId"), F.col("limbs").alias("lb"))
    d = hamming(F.col("la"), F.col("lb"), bits)
    out = a.join(b, (F.col("canonicalAssetId") < F.col("duplicateAssetId")) & (d <= threshold))
    return out.select("canonicalAssetId", "duplicateAssetId", d.alias("hammingDistance"), similarity(d, bits).alias("similarity"))


def find_for_asset(hashes: DataFrame, asset: int, threshold: int = C.HAMMING_THRESHOLD, bits: int = C.HASH_BITS) -> DataFrame:
    """One asset against all, nearest first."""
    one = F.broadcast(hashes.where(F.col("assetId") == asset).select(F.col("limbs").alias("l0")).limit(1))
    d = hamming(F.col("limbs"), F.col("l0"), bits)
    return hashes.where(F.col("assetId") != asset).crossJoin(one).select("assetId", d.alias("hammingDistance"), similarity(d, bits).alias("similarity")).where(F.col("hammingDistance") <= threshold).orderBy("hammingDistance", "assetId")


def find_among(hashes: DataFrame, ids: DataFrame, threshold: int = C.HAMMING_THRESHOLD, bits: int = C.HASH_BITS) -> DataFrame:
    return hamming_pairs(hashes.join(ids, "assetId", "left_semi"), threshold, bits)


def new_pairs(found: DataFrame, existing: DataFrame) -> DataFrame:
    """Pairs that aren't known yet, resolved or not."""
    return found.join(existing.select("canonicalAssetId", "duplicateAssetId"), ["canonicalAssetId", "duplicateAssetId"], "left_anti")


def cluster(pairs: DataFrame, save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pairs with clusterKey: the smallest asset of the component that unresolved pairs form; null for resolved ones."""
    labels = connected_components(unresolved(pairs), save, src="canonicalAssetId", dst="duplicateAssetId")
    out = pairs.drop("clusterKey").join(labels, pairs.canonicalAssetId == labels.node, "left")
    return out.withColumn("clusterKey", F.when(F.col("resolution").isNull(), F.col("component"))).drop("node", "component").select(*pairs.columns, *[c for c in ("clusterKey",) if c not in pairs.columns])


def recluster(pairs: DataFrame, seeds: DataFrame, save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """id and clusterKey of the rows whose key changes by edits near some assets (`seeds`: assetId): new pairs, which have no key yet, and pairs that were resolved or removed.

    Stored clusters that hold a seed are taken apart, as they may have split; their pairs and those without a key are loose. All other stored clusters are one node each, by
    their key, so that the graph has no more edges than loose pairs, however large the clusters are that they join. Components that hold a seed, or come of a cluster taken
    apart, are written; the key of a component is its smallest asset, since the key of a cluster is its smallest.
    """
    ids, live = seeds.select("assetId").where("assetId IS NOT NULL").distinct(), unresolved(pairs).select("id", "canonicalAssetId", "duplicateAssetId", "clusterKey")
    ends = endpoints(live)
    apart = save(ends.join(ids, "assetId", "left_semi").where(F.col("clusterKey").isNotNull()).select("clusterKey").distinct())
    marked = live.join(apart.withColumn("_apart", F.lit(True)), "clusterKey", "left")
    loose = save(marked.where(F.col("clusterKey").isNull() | F.col("_apart")).select("id", "canonicalAssetId", "duplicateAssetId", "clusterKey"))
    at = endpoints(loose).select("assetId").distinct()
    # An asset of a loose pair that a stored cluster holds stands for it; two keys of one asset are an edge between them.
    held = ends.where(F.col("clusterKey").isNotNull()).join(apart, "clusterKey", "left_anti").join(at, "assetId", "left_semi").select("assetId", "clusterKey").distinct()
    held = save(held)
    node = held.groupBy("assetId").agg(F.min("clusterKey").alias("node"))
    named = lambda side: node.select(F.col("assetId").alias(side), F.col("node").alias(f"_{side}"))
    joined = loose.join(named("canonicalAssetId"), "canonicalAssetId", "left").join(named("duplicateAssetId"), "duplicateAssetId", "left")
    joined = save(joined.select("id", "clusterKey", F.coalesce("_canonicalAssetId", "canonicalAssetId").alias("a"), F.coalesce("_duplicateAssetId", "duplicateAssetId").alias("b")))
    edges = joined.select("a", "b").unionByName(held.join(node, "assetId").where("clusterKey <> node").select(F.col("node").alias("a"), F.col("clusterKey").alias("b")))
    labels = save(connected_components(edges, save, src="a", dst="b"))
    of_seed = ids.join(node, "assetId", "left").select(F.coalesce("node", "assetId").alias("node"))
    of_apart = joined.where(F.col("clusterKey").isNotNull()).select(F.col("a").alias("node"))
    written = labels.join(of_seed.unionByName(of_apart).distinct(), "node", "left_semi").select("component").distinct()
    new = save(labels.join(written, "component", "left_semi"))
    rows = joined.join(new, joined.a == new.node).select("id", F.col("component").alias("key"), "clusterKey")
    moved = new.where("node <> component").join(held.select(F.col("clusterKey").alias("node")).distinct(), "node", "left_semi")
    rows = rows.unionByName(live.join(moved, live.clusterKey == moved.node).join(loose.select("id"), "id", "left_anti").select("id", F.col("component").alias("key"), "clusterKey"))
    rows = rows.where(~F.col("key").eqNullSafe(F.col("clusterKey"))).select("id", F.col("key").alias("clusterKey"))
    resolved = pairs.where(F.col("resolution").isNotNull() & F.col("clusterKey").isNotNull()).select("id", F.lit(None).cast("long").alias("clusterKey"))
    return rows.unionByName(resolved)


def cluster_around(pairs: DataFrame, seeds: DataFrame, save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The pairs with the keys that `recluster` gives; other rows stay as they are."""
    new = recluster(pairs, seeds, save).select(F.col("id").alias("_id"), F.col("clusterKey").alias("_key"))
    out = pairs.join(new, pairs.id == F.col("_id"), "left")
    return out.withColumn("clusterKey", F.when(F.col("_id").isNotNull(), F.col("_key")).otherwise(F.col("clusterKey"))).select(*pairs.columns)


def resolve(pairs: DataFrame, pair_id: int, resolution: str, at, save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Marks one pair as resolved and clusters what it joined, which may split. Pairs that have no stored keys are all clustered."""
    if resolution not in set(C.DuplicateResolution):
        raise ValueError(f"no such resolution: {resolution}")
    hit = (F.col("id") == pair_id) & F.col("resolution").isNull()
    kept = pairs.withColumns({"resolution": F.when(hit, F.lit(resolution)).otherwise(F.col("resolution")), "resolvedAt": F.when(hit, F.lit(at)).otherwise(F.col("resolvedAt")) if "resolvedAt" in pairs.columns else F.when(hit, F.lit(at))})
    if "clusterKey" not in pairs.columns:
        return cluster(kept, save)
    return cluster_around(kept, endpoints(pairs.where(F.col("id") == pair_id)).select("assetId"), save)


def without_assets(pairs: DataFrame, gone: DataFrame, save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Drops the pairs of deleted assets, or of assets whose hash changed, and clusters what they joined; all the rest where pairs have no stored keys."""
    ids = gone.select("assetId").distinct()
    left = pairs.join(ids.withColumnRenamed("assetId", "canonicalAssetId"), "canonicalAssetId", "left_anti").join(ids.withColumnRenamed("assetId", "duplicateAssetId"), "duplicateAssetId", "left_anti")
    if "clusterKey" not in pairs.columns:
        return cluster(left.select(*pairs.columns), save)
    # Every part that is left of a cluster holds a neighbour of a deleted asset.
    near = endpoints(pairs).join(ids, "assetId", "left_semi").select(F.col("otherId").alias("assetId"))
    return cluster_around(left.select(*pairs.columns), near, save)


def similar_ranked(pairs: DataFrame, asset: int, limit: int | None = None) -> DataFrame:
    out = neighbours(pairs, asset).orderBy(F.desc("similarity"), "assetId")
    return out.limit(limit) if limit else out


def unresolved_page(pairs: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    return unresolved(pairs).orderBy("hammingDistance", "id").offset(offset).limit(limit)


def affected_assets(pairs: DataFrame) -> DataFrame:
    """Distinct assets on either side of an unresolved pair."""
    return endpoints(unresolved(pairs)).select("assetId").distinct()
