import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    import tidewatch  # noqa: F401  (registers the package for shipping to workers)

    s = (SparkSession.builder.master("local[*]").appName("tidewatch-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tw-test-ckpt-", dir="/tmp"))
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def fixture_posts(spark):
    """Ten normalized posts: texts, places and tokens of our own around fixed values."""
    from tidewatch.schema import POST_SCHEMA
    from tidewatch.sources.ingest import conform

    # Id, time, coordinates, probability, country, representative.
    fixed = [
        ("10", "2018-06-23T13:31:38", 35.22709, -80.84313, 0.988, "USA", True),
        ("11", "2018-06-23T14:53:11", 40.43085, -95.42809, 0.999, "USA", True),
        ("12", "2018-06-23T08:14:16", 42.49604, -96.39066, 0.991, "USA", True),
        ("13", "2018-06-23T18:33:05", 26.145053, -97.941707, 0.801, "USA", True),
        ("14", "2018-06-24T10:14:25", 26.167650, -97.916853, 0.945, "USA", True),
        ("15", "2018-06-23T19:19:51", 26.162797, -97.887043, 0.876, "USA", False),
        ("16", "2018-06-23T05:17:21", 53.478878, -2.238560, 0.881, "UK", True),
        ("17", "2018-06-24T11:14:11", -25.999180, 28.126293, 0.865, "SA", True),
        ("18", "2018-06-23T23:32:36", 42.00027, -93.50049, 0.418, "USA", True),
        ("19", "2018-06-23T20:04:53", 26.167157, -97.894937, 0.505, "USA", False),
    ]
    shelter = "After the creek rose in Texas, extensive damage left our home no longer suitable for living"
    words = {
        "10": ("Eastfield", "Creek gauge two is above its banks, flood watch from the county office https://t.example/a1"),
        "11": ("Millbridge", "Flood watch at Millbridge now lasts until 9:40 PM, stay off the low road"),
        "12": ("Stonequay", "Blocked drains make each flood in town deeper, says the harbour board @boardnews"),
        "13": ("Palm Flats", f"{shelter} https://t.example/b2"),
        "14": ("Palm Flats", "Neighbours in Texas, please share: a flood took the home of four families, they need beds tonight @aidline"),
        "15": ("Palm Flats", f"RT @creekside: {shelter}."),
        "16": ("Northgate", "#MarketDay and snow in June. \nA flood of tears over the cancelled parade https://t.example/c3"),
        "17": ("Hillcrest", "A broken main in #BlockNine sent a flood into the yards, nobody came to close it"),
        "18": ("Grainport", "RT @railwatch: tank cars left the track and oil reached the flood water of the river"),
        "19": ("Palm Flats", f"RT @creekside: {shelter}."),
    }
    rows = [(*r, *words[r[0]]) for r in fixed]
    tokens = {i: sorted({w for w in text.lower().split() if w.isalpha() and len(w) > 3}) for i, (_, text) in words.items()}
    data = [
        {"tweetid": r[0], "created_at": r[1], "location": {"lat": r[2], "lon": r[3]},
         "flood_probability": r[4], "country": r[5], "representative": r[6], "place": r[7], "text": r[8], "lang": "en", "tokens": tokens[r[0]]}
        for r in rows
    ]
    df = spark.createDataFrame(data, "tweetid string, created_at string, location struct<lat:double,lon:double>, "
                                     "flood_probability double, country string, representative boolean, place string, "
                                     "text string, lang string, tokens array<string>")
    from pyspark.sql import functions as F

    df = df.withColumn("created_at", F.to_timestamp("created_at"))
    return conform(df, POST_SCHEMA).cache()
