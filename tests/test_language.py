"""Language profiles: accuracy on documents that were not learned from, ties and odd texts."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from tidewatch.functions import language as LG
from tidewatch.operators.normalize import normalize

SF = "/root/testdata/sf0.01"


def test_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null")
    held = F.col("doc_id") % 3 == 0
    profiles = LG.collected(LG.language_profiles(docs.where(~held)))
    assert set(profiles) == {"de", "en", "es", "fr"} and all(sorted(p.values()) == list(range(LG.PROFILE)) for p in profiles.values())
    got = docs.where(held).where(F.length("text") >= 20).select((LG.language_of("text", profiles) == F.col("lang")).alias("ok")).agg(F.avg(F.col("ok").cast("int")), F.count("*")).first()
    assert got[0] > 0.97 and got[1] > 250


def test_odd_texts_and_ties(spark):
    profiles = LG.collected(LG.language_profiles(spark.createDataFrame([("aa bb", "x"), ("aa bb", "y"), ("zz", None), (None, "y"), ("qqq " * 9, "z")], "text string, lang string")))
    assert set(profiles) == {"x", "y", "z"}
    df = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "AA bb"), (5, "qqq"), (6, "aa " * 50_000)], "i int, text string")
    assert {r["i"]: r["l"] for r in df.select("i", LG.language_of("text", profiles).alias("l")).collect()} == {1: None, 2: None, 3: None, 4: "x", 5: "z", 6: "x"}
    assert {r["l"] for r in df.select(LG.language_of("text", {}).alias("l")).collect()} == {None}
    assert LG.grams("ab AB, c1") == {" a": 2, "a": 2, "b": 2, "ab": 2, "b ": 2, " ab": 2, "ab ": 2, " c": 1, "c": 1, "c ": 1, " c ": 1}


def test_normalizer_takes_the_nearest_profile(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang is not null and length(text) > 100")
    profiles = LG.collected(LG.language_profiles(docs))
    some = docs.groupBy("lang").agg(F.min_by("text", "doc_id").alias("text")).collect()
    recs = [(json.dumps({"id": i, "text": r["text"], "lang": "en", "annotations": {"flood_probability": 0.5}}),) for i, r in enumerate(some)]
    recs.append((json.dumps({"id": 99, "text": "123", "lang": "fr", "annotations": {"flood_probability": 0.5}}),))
    ok, _ = normalize(spark.createDataFrame(recs, "raw string"), now=datetime(2024, 1, 1), profiles=profiles)
    assert {r["tweetid"]: r["lang"] for r in ok.collect()} == {**{str(i): r["lang"] for i, r in enumerate(some)}, "99": "fr"}


def test_grams_of_words_that_come_several_times():
    """Numbers and ranking, gram by gram."""
    from collections import Counter

    for text in ("Aa aa AA b b ccc", "x" * 90 + " xx xx", "ß ß ßß 12 é", "", None, "one"):
        want = Counter()
        for word in LG._WORDS.findall((text or "").lower()):
            padded = f" {word} "
            want.update(padded[i:i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1))
        want.pop(" ", None)
        assert LG.grams(text) == want
        assert LG.ranked(LG.grams(text)) == [g for g, _ in sorted(want.items(), key=lambda x: (-x[1], x[0]))[:LG.PROFILE]]
        codes, _ = LG._coded(text)
        assert [LG._gram(c) for c in codes.tolist()] == sorted(want) and [LG._code(g) for g in sorted(want)] == codes.tolist()
    assert LG._summed([LG._coded("aa b"), LG._coded(None), LG._coded("b")])[1].tolist() == LG._coded("aa b b")[1].tolist()
