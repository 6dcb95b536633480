"""Mergeable sketches stay inside their error bounds, whatever the order of the micro-batches."""

import datetime as dt
import random
from collections import Counter

from pyspark.sql import functions as F

from tidewatch.streaming import sketches as S


def test_merged_sketches_against_exact_counts(spark):
    rnd, day = random.Random(17), dt.datetime(2024, 1, 1)
    rows = [(day + dt.timedelta(days=rnd.randrange(3), seconds=rnd.randrange(86_400)), rnd.randrange(9_000), rnd.random() ** 2,
             f"c{min(int(rnd.expovariate(0.15)), 60)}") for _ in range(60_000)] + [(day, None, None, None)]
    df = spark.createDataFrame(rows, "created_at timestamp, user_id long, flood_probability double, country string").repartition(6).cache()
    parts = [df.where(F.pmod(F.xxhash64("user_id", "created_at"), F.lit(5)) == i) for i in range(5)]
    per = [S.sketch_partials(p) for p in parts]
    forward, backward = per[0], per[-1]
    for i in range(1, 5):
        forward, backward = forward.unionByName(per[i]), backward.unionByName(per[-1 - i])
    for merged in (S.merge_sketches(forward), S.merge_sketches(backward)):
        got = {r["key"].day: r for r in S.estimates(merged, 5).collect()}
        for d in (1, 2, 3):
            mine = [r for r in rows if r[0].day == d and r[1] is not None]
            exact, values = len({r[1] for r in mine}), sorted(r[2] for r in mine)
            assert got[d]["n"] == len(mine) + (d == 1)
            assert abs(got[d]["n_distinct"] - exact) <= 0.03 * exact
            for rank, name in ((0.5, "quantile_50"), (0.9, "quantile_90")):
                at = sum(v <= got[d][name] for v in values) / len(values)
                assert abs(at - rank) <= 0.02
            counts = Counter(r[3] for r in mine)
            assert [(x["item"], x["count"]) for x in got[d]["top"]] == sorted(counts.items(), key=lambda x: -x[1])[:5]
    df.unpersist()


def test_no_rows_no_sketches(spark):
    none = spark.createDataFrame([], "created_at timestamp, user_id long, flood_probability double, country string")
    assert S.estimates(S.merge_sketches(S.sketch_partials(none))).collect() == []
