"""The stored index: a pass over texts tokenises each once, and grouping starts from rows dealt by their keys."""

from pyspark.sql import functions as F

from orrery.functions.text import tokenize
from orrery.operators import search_index as SIX
from orrery.operators import search_store as SS
from orrery.queries import made_doc_index


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_tokenised_once(spark, sf, tmp_path):
    index = made_doc_index(spark, sf)
    assert plan(index).count("\\p{L}") == 1
    SIX.write_index(index, f"{tmp_path}/index")
    stored, total = SIX.read_index(spark, f"{tmp_path}/index")
    assert sorted(stored.collect()) == sorted(index.collect())
    assert total.first()["n_assets"] == index.select("assetId").distinct().count()


def test_tokens_of_odd_texts(spark):
    texts = ["", None, " ", "\n\tAb  ab\x0bcd", "a1bb-CC_dd", "x" * 40 + " " + "y" * 41, "Straße ÉTÉ été 日本語 𝒜𝒷 éé İstanbul", " no break line"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    words = F.split(F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\s]", " ")), r"\s+")
    before = F.array_distinct(F.filter(words, lambda x: F.char_length(x).between(2, 40)))
    rows = df.select(before.alias("a"), tokenize(F.col("text")).alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows]


def test_postings_are_dealt_before_they_are_grouped(spark, tmp_path):
    rows = [(a, f, t, a % 3 + 1) for a in range(60) for f in ("x", "y") for t in ("the", f"w{a % 7}")] + [(1, "x", None, 1)]
    index = spark.createDataFrame(rows, "assetId long, field string, token string, tf int").withColumn("fieldWeight", F.lit(1).cast("decimal(3,2)"))
    dealt = SS._dealt(index, "token", "assetId").groupBy("token", "assetId").agg(F.sum("tf"))
    assert plan(dealt).count("Exchange") == 1
    made = SS.Dictionary(spark, f"{tmp_path}/d")
    made.write(index)
    assert {r.token: r.df for r in made.tokens().collect()} == {"the": 60} | {f"w{k}": len(range(k, 60, 7)) for k in range(7)}
