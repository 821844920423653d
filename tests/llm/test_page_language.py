"""Pages: evidence of markup, address suffix and host."""

from __future__ import annotations

import random

from pyspark.sql import functions as F


def test_markup_suffix_and_host_tell_the_language(spark):
    from orrery.llm.language_id import identify_pages

    en, de = "the house and the garden were there with them in the other room".split(), "der hund und die katze sind nicht mit dem haus verbunden worden".split()
    rng = random.Random(3)
    rows = []
    for i in range(200):
        lang, words, end = ("en", en, "uk") if i % 2 else ("de", de, "at")
        rows.append((i, f"http://h{i % 4}.example.{end}/a", f"<html lang='{lang}'>", " ".join(rng.sample(words, 8))))
    same = "zz"  # in neither language
    rows += [(900, "http://new.example.at/x", "<html>", same), (901, "http://new.example.uk/x", "<html>", same), (902, None, "<html lang='de-AT'>", same), (903, None, '<html class=x lang="en">', same), (904, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = identify_pages(df, F.col("text"))
    got = {r.page_id: r for r in out.collect()}
    assert out.columns[:4] == ["page_id", "url", "html", "text"] and len(got) == len(rows)
    assert all(got[i].detected_lang == ("en" if i % 2 else "de") for i in range(200))
    assert [got[i].detected_lang for i in range(900, 905)] == ["de", "en", "de", "en", "und"]
    # Suffix alone moves the prior from the corpus' one half; the text is the same.
    assert got[900].text_lang == got[901].text_lang and min(got[900].confidence, got[901].confidence) > 0.5


def test_query_covers_the_pages(spark, sf):
    from orrery.llm.queries import QUERIES

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    out = QUERIES["op8_page_language"](spark, sf)
    assert sorted(r.page_id for r in out.select("page_id").collect()) == sorted(r.page_id for r in pages.select("page_id").collect())
    assert {"de", "en"} <= {r.detected_lang for r in out.where("kept").select("detected_lang").collect()}
