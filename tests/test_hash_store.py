"""The store of hashes after any additions against a scan of all hashes."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from orrery.operators import duplicates as D
from orrery.operators.hash_store import HashStore, scan
from orrery.storage import store


@pytest.mark.parametrize("bits,threshold,together", [(64, 6, 2), (32, 4, 1)])
def test_increments_equal_a_full_scan(spark, tmp_path, bits, threshold, together):
    rng = random.Random(bits)
    seeds = ["".join(rng.choice("01") for _ in range(bits)) for _ in range(12)]

    def near(text: str) -> str:
        flip = set(rng.sample(range(bits), rng.randrange(0, 2 * threshold)))
        return "".join(("10"[int(c)] if i in flip else c) for i, c in enumerate(text))

    kept, state = HashStore(spark, str(tmp_path / "h"), bits, threshold, together), {}
    for number in range(1, 5):
        new = {a: rng.choice([rng.choice(seeds), near(rng.choice(seeds)), None if number > 1 else seeds[0]]) for a in rng.sample(range(90), 30)}
        gone = rng.sample(sorted(state), min(len(state), 4))
        df = spark.createDataFrame(list(new.items()), "assetId long, hash string")
        dead = spark.createDataFrame([(g,) for g in gone], "assetId long")
        if number == 3:  # broke off before the assets were written
            add, kept.members.add = kept.members.add, lambda *_: (_ for _ in ()).throw(OSError("lost"))
            with pytest.raises(OSError):
                kept.update(df, number, dead)
            kept.members.add = add
            kept.compact()
        assert kept.update(df, number, dead) and not kept.update(df, number, dead)
        state = {a: h for a, h in ({a: h for a, h in state.items() if a not in gone} | new).items() if h}
    assert {r.assetId: r.hash for r in kept.current().collect()} == state
    limbs = spark.createDataFrame(list(state.items()), "assetId long, hash string").select("assetId", D.bits_to_limbs(F.col("hash"), bits).alias("limbs"))
    columns = ["canonicalAssetId", "duplicateAssetId", "hammingDistance", "similarity"]
    want = D.hamming_pairs(limbs, threshold, bits, expand=False).select(columns).collect()
    assert sorted(kept.pairs().select(columns).collect()) == sorted(want) and len(want) > 20
    probe = near(seeds[1])
    found = {r.assetId: r.hammingDistance for r in kept.near_hash(probe).collect()}
    assert found == {a: d for a, h in state.items() if (d := sum(x != y for x, y in zip(h, probe, strict=True))) <= threshold}
    more = scan(kept, spark.createDataFrame([(500, seeds[2])], "assetId long, hash string"), 9, kept.pairs(), lambda df: store(spark, df, "test"))
    assert {r.duplicateAssetId for r in more.collect()} | {r.canonicalAssetId for r in more.collect()} >= {500} and more.count() == 1


def test_empty(spark, tmp_path):
    kept = HashStore(spark, str(tmp_path / "h"), 64, 4)
    assert kept.update(spark.createDataFrame([], "assetId long, hash string"), 1) and kept.pairs().collect() == []
    with pytest.raises(ValueError):
        HashStore(spark, str(tmp_path / "h"), 8, 8)


def test_bands_that_select_nothing_are_not_joined(spark, tmp_path):
    """64 bits within 20: bands of six bits gave 231 rows a hash and more candidates than there are pairs."""
    rng = random.Random(5)
    rows = [(i, format(rng.getrandbits(64), "064b")) for i in range(400)]
    df = spark.createDataFrame(rows, "assetId long, hash string")
    kept = HashStore(spark, str(tmp_path / "h"), 64, 20)
    assert not kept.banded and HashStore(spark, str(tmp_path / "i"), 256, 10).banded
    for number in (1, 2):
        kept.update(df.where(F.col("assetId") % 2 == number - 1), number)
    assert kept.bands.last() is None
    found = sorted((r.canonicalAssetId, r.duplicateAssetId, r.hammingDistance) for r in kept.pairs().collect())
    want = [(a, b, d) for a, h in rows for b, g in rows if a < b and (d := (int(h, 2) ^ int(g, 2)).bit_count()) <= 20]
    assert found == sorted(want) and len(want) > 50
    small = D.close_to_new(df.where("assetId < 150").select("hash"), df.where("assetId >= 150").select("hash"), 20, 64, block=32)
    assert small.count() == sum(a < 150 for a, _, _ in want) == small.distinct().count()


def test_blocks_of_odd_widths(spark):
    rng = random.Random(6)
    for bits, threshold in ((32, 9), (96, 36), (256, 110)):
        hashes = sorted({format(rng.getrandbits(bits), f"0{bits}b") for _ in range(120)})
        df = spark.createDataFrame([(h,) for h in hashes], "hash string")
        found = sorted((*sorted((bytes(r.x).hex(), bytes(r.y).hex())), r.hammingDistance) for r in D.close_to_new(df, df.limit(0), threshold, bits, 50).collect())
        want = [(*sorted((format(int(h, 2), f"0{bits // 4}x"), format(int(g, 2), f"0{bits // 4}x"))), d) for i, h in enumerate(hashes) for g in hashes[i + 1 :] if (d := (int(h, 2) ^ int(g, 2)).bit_count()) <= threshold]
        assert found == sorted(want) and want
