"""Batch entry points: python -m orrery.cli FOLDER COMMAND. Each works on the tables stored in FOLDER."""

from __future__ import annotations

import argparse
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .catalog import open_catalog, remove_old_versions
from .operators import bulk as B
from .operators import duplicates as D
from .operators import ingest as G
from .operators import statistics as ST


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("folder")
    p.add_argument("command", choices=["stats", "volumes", "scan-duplicates", "rebuild-index", "cleanup-stuck", "retry-failed", "remove-old"])
    p.add_argument("--threshold", type=int, default=10)
    p.add_argument("--all-pairs", action="store_true", help="list every pair of copies, not only each copy with its first")
    p.add_argument("--status", choices=["pending", "processing"], default="pending")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName(f"orrery {a.command}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    c, now = open_catalog(spark, a.folder), datetime.now(UTC).replace(tzinfo=None)
    if a.command == "stats":
        B.bulk_stats(c.assets, c.analyses).show()
        ST.overview(c.analyses).show()
    elif a.command == "volumes":
        c.assets.where("kind = 'image'").join(c.analyses.select(F.col("assetId").alias("id"), "status"), "id", "left").groupBy("volumeId").agg(F.count("*").alias("images"), F.count_if(F.col("status") == "completed").alias("analysed")).orderBy("volumeId").show(1000)
    elif a.command == "scan-duplicates":
        hashes = c.analyses.where("perceptualHash IS NOT NULL").select("assetId", D.hash_limbs(F.col("perceptualHash")).alias("limbs"))
        found = D.new_pairs(D.hamming_pairs(hashes, a.threshold, expand=a.all_pairs), c.duplicate_groups).withColumn("id", F.xxhash64("canonicalAssetId", "duplicateAssetId"))
        from .queries import shared_save

        merged = D.cluster(c.duplicate_groups.unionByName(found, allowMissingColumns=True), shared_save(spark))
        G.write_tables({"duplicate_groups": merged}, a.folder)
    elif a.command == "rebuild-index":
        print(G.rebuild_index(c, a.folder))
    elif a.command == "cleanup-stuck":
        G.write_tables({"analyses": B.reset_stuck(c.analyses, now, a.status)}, a.folder)
    elif a.command == "retry-failed":
        G.write_tables({"analyses": B.retry_failed(c.analyses)}, a.folder)
    elif a.command == "remove-old":
        remove_old_versions(spark, a.folder)


if __name__ == "__main__":
    main()
