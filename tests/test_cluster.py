"""Representative split: hand-derived goldens and a brute-force comparison."""

import math
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tidewatch.functions.similarity import lcs_length, similarities, similarity
from tidewatch.operators import cluster as C


def dp_lcs(a, b):
    prev = [0] * (len(b) + 1)
    for ca in a:
        cur = [0]
        for j, cb in enumerate(b, 1):
            cur.append(prev[j - 1] + 1 if ca == cb else max(cur[j - 1], prev[j]))
        prev = cur
    return prev[-1]


@given(st.text(alphabet="abcé ", max_size=40), st.text(alphabet="abcé ", max_size=40))
@settings(max_examples=300, deadline=None)
def test_lcs_matches_dp(a, b):
    assert lcs_length(a, b) == dp_lcs(a, b)


def test_similarity_goldens():
    assert similarity("flood warning", "flood warnings") == pytest.approx(26 / 27)
    assert similarity("ab", "ba") == 0.5
    assert similarity("", "") == 1.0
    assert similarity("abc", "") == 0.0


def brute(docs, thr=0.8):
    """Direct restatement of the split over one cluster: docs = [(id, normalized text)]."""
    out = {}
    for i, ti in docs:
        sims = [(j, similarity(ti, tj)) for j, tj in docs]
        mult = max(1, sum(1 for j, s in sims if j > i and s > thr))
        dup = any(j < i and s > thr for j, s in sims)
        cent = 0.0 if dup else 2 * sum(s for _, s in sims)
        out[i] = (mult, round(cent, 6), cent > 0, mult * math.floor(round(cent, 9)))
    return out


def run(spark, rows, normalize=False):
    df = spark.createDataFrame(rows, "g string, id long, text string")
    res = C.categorize(df, ["g"], "id", "text", normalize=normalize).collect()
    return {(r["g"], r["id"]): (r["multiplicity"], round(r["centrality"], 6), r["representative"], r["rank_key"]) for r in res}


def test_goldens(spark):
    got = run(spark, [("a", 1, "abcd"), ("a", 2, "abcd"), ("a", 3, "wxyz")])
    assert {k[1]: v[:3] for k, v in got.items()} == {1: (1, 4.0, True), 2: (1, 0.0, False), 3: (1, 2.0, True)}
    got = run(spark, [("a", 1, "same"), ("a", 2, "same"), ("a", 3, "same")])
    assert {k[1]: (v[0], v[1], v[3]) for k, v in got.items()} == {1: (2, 6.0, 12), 2: (1, 0.0, 0), 3: (1, 0.0, 0)}
    rep, non = C.split_lists(C.categorize(spark.createDataFrame(
        [(1, "abcd"), (2, "abcd"), (3, "wxyz")], "id long, text string"), [], "id", "text", normalize=False), [], "id")
    assert [r["id"] for r in rep.collect()] == [1, 3] and [r["id"] for r in non.collect()] == [2]


def test_against_brute_force(spark):
    rnd = random.Random(7)
    words = ["flood", "river", "rain", "storm", "home", "texas", "warning"]
    rows = []
    for g in "xyz":
        base = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 5))) for _ in range(6)]
        for i in range(rnd.randint(3, 25)):
            t = rnd.choice(base)
            if rnd.random() < 0.4:
                t = t + rnd.choice(["", "s", " now", "!"])
            rows.append((g, rnd.randint(1, 10_000) * 10 + i, t))
    got = run(spark, rows)
    for g in "xyz":
        docs = [(i, t) for gg, i, t in rows if gg == g]
        for i, v in brute(docs).items():
            assert got[(g, i)] == v, (g, i)


def test_small_blocks_equal_single_block(spark):
    rows = [("a", i, f"text {i % 7} {'x' * (i % 3)}") for i in range(1, 60)]
    df = spark.createDataFrame(rows, "g string, id long, text string")
    one = {r["id"]: (r["multiplicity"], r["centrality"]) for r in C.categorize(df, ["g"], "id", "text").collect()}
    many = {r["id"]: (r["multiplicity"], r["centrality"]) for r in C.categorize(df, ["g"], "id", "text", block=3).collect()}
    assert one == many


def test_count_greater_of_sparse_and_negative_ids(spark):
    ids = [-(1 << 62), -5, -1, 0, 3, 5, 1 << 17, (1 << 33) + 1, (1 << 33) + 7, (1 << 62) + 1, (1 << 62) + 9]
    q = spark.createDataFrame([("a", i) for i in ids], "k string, id long")
    members = q.unionByName(spark.createDataFrame([("a", 5), ("b", 6)], "k string, id long"))
    for bits in (16, 32):
        got = {r["id"]: r["n_greater"] for r in C.count_greater(q, members, ["k"], bits=bits).collect()}
        assert got == {i: sum(1 for j in [*ids, 5] if j > i) for i in ids}


def test_sparse_ids_and_one_text_many_times(spark):
    rnd = random.Random(3)
    texts = ["river over the road"] * 60 + ["river over the roads"] * 25 + ["river over a road"] * 3 + ["dry", "", "x" * 300]
    ids = rnd.sample(range(1 << 60), len(texts))
    rows = [("a", i, t) for i, t in zip(ids, texts)]
    got = run(spark, rows)
    for i, v in brute([(i, t) for _, i, t in rows]).items():
        assert got[("a", i)] == v


def test_rejects_and_null_texts(spark):
    df = spark.createDataFrame([("1", None), ("x2", "t"), (None, "t"), ("3", "")], "tweetid string, text string")
    assert sorted((r["tweetid"], r["multiplicity"], r["centrality"]) for r in C.categorize(df).collect()) == [
        ("1", 1, 4.0), ("3", 1, 0.0)]
    assert sorted(str(r["tweetid"]) for r in C.categorize_rejects(df).collect()) == ["None", "x2"]
    assert C.categorize(df.limit(0)).collect() == []


@given(st.lists(st.text(alphabet="abcé ", max_size=90), min_size=1, max_size=6), st.lists(st.text(alphabet="abcé ", max_size=300), min_size=1, max_size=6))
@settings(max_examples=100, deadline=None)
def test_similarities_match_pairs(a, b):
    got = similarities(a, b)
    assert [[round(float(x), 12) for x in r] for r in got] == [[round(similarity(x, y), 12) for y in b] for x in a]


def test_conversations_against_brute_force(spark):
    """The registered conversations query (whole texts, rows-only in the driver check)."""
    from tidewatch.functions.text import normalize_aggressive
    from tidewatch.plans.q_cluster import categorize_conversations

    sf = "/root/testdata/sf0.001"
    got = {(r["conv_id"], r["turn"]): (r["multiplicity"], r["centrality"], r["representative"], r["rank_key"])
           for r in categorize_conversations(spark, sf).collect()}
    conv = spark.read.parquet(f"{sf}/conversations.parquet").select(
        "conv_id", "turn", normalize_aggressive("text").alias("nt")).collect()
    by = {}
    for r in conv:
        by.setdefault(r["conv_id"], []).append((r["turn"], r["nt"]))
    for cid, docs in by.items():
        for i, v in brute(docs).items():
            assert got[(cid, i)] == v


def test_segments_time_level(spark):
    from datetime import datetime

    rows = [("x", datetime(2024, 1, 1, 0, m)) for m in (0, 1, 2, 3, 4, 6, 7)] + [("y", datetime(2024, 1, 1, 0, 0))]
    df = spark.createDataFrame(rows, "country string, created_at timestamp")
    seg = C.cluster_segments(df, ["country", "created_at"], interval="5m", min_entries=2).collect()
    assert [(r["country"], r["created_at"], r["doc_count"]) for r in seg] == [("x", datetime(2024, 1, 1, 0, 0), 5),
                                                                              ("x", datetime(2024, 1, 1, 0, 5), 2)]


def test_categorize_clusters_geo_membership(spark):
    from tidewatch.plans.flows import categorize_clusters
    from tidewatch.sources.tables import posts

    p = posts(spark, "/root/testdata/sf0.001").withColumn("text", F.concat_ws(" ", "country", "props"))
    res = categorize_clusters(p, ["location", "country"], precision=3)
    per_seg = {(r["seg_cell"], r["seg_value"]): r["n"] for r in
               res.groupBy("seg_cell", "seg_value").agg(F.count(F.lit(1)).alias("n")).collect()}
    segs = {(r["cell"], r["value"]): r["doc_count"] for r in C.geo_cluster_segments(p, ["country"], precision=3).collect()}
    assert per_seg == segs and all(n >= 5 for n in segs.values())


def test_segments_null_and_array_children(spark):
    rows = [("A", None, None)] * 7 + [("A", "en", ["x", "y"])] + [("B", "en", ["x"])] * 5
    df = spark.createDataFrame(rows, "country string, lang string, tokens array<string>")
    top = lambda terms: [tuple(r) for r in C.cluster_segments(df, terms, size=1, min_entries=1).collect()]
    assert top(["country", "lang"]) == [("A", "en", 1)]
    assert top(["country", "tokens"]) == [("A", "x", 1)]
    few = spark.createDataFrame([("A", ["p", "q", "r", "s", "t"])] * 2 + [("B", ["p"])] * 4, "country string, tokens array<string>")
    assert [tuple(r) for r in C.cluster_segments(few, ["country", "tokens"], size=1, min_entries=1).collect()] == [("B", "p", 4)]
    assert sorted(tuple(r) for r in C.cluster_segments(few, ["tokens", "country"], size=2, min_entries=1).collect()) == [
        ("p", "A", 2), ("p", "B", 4), ("q", "A", 2)]


def geo_docs(spark):
    rows = [(str(i), (10.0, 20.0), "A", ["x", "y"], "same text") for i in range(5)]
    rows += [("9", (10.0005, 20.0), "A", ["x"], "near text"), ("8", None, "A", ["x"], "no place")]
    return spark.createDataFrame(rows, "tweetid string, location struct<lat:double,lon:double>, country string, "
                                       "tokens array<string>, text string")


def test_geo_segments_of_array_terms(spark):
    from tidewatch.plans.flows import categorize_clusters

    df = geo_docs(spark)
    seg = C.geo_cluster_segments(df, ["tokens"], precision=5)
    assert sorted((r["value"], r["doc_count"]) for r in seg.collect()) == [("x", 6), ("y", 5)]
    res = categorize_clusters(df, ["location", "tokens"], precision=5)
    assert sorted((r["seg_value"], r["n"]) for r in res.groupBy("seg_value").agg(F.count(F.lit(1)).alias("n")).collect()) == [
        ("x", 6), ("y", 5)]


def test_geo_box_membership(spark):
    df = geo_docs(spark)
    fine = C.geo_cluster_segments(df, ["country"], precision=9)  # the five equal points: a degenerate box
    assert [r["doc_count"] for r in fine.collect()] == [5]
    ids = lambda how: sorted(r["tweetid"] for r in C.assign_geo_clusters(df, fine, ["country"], 9, how).collect())
    assert ids("cell") == ["0", "1", "2", "3", "4"]
    assert ids("box") == ["0", "1", "2", "3", "4", "9"]


def test_items_of_many_copies_meet_in_blocks(spark, monkeypatch):
    """Texts cut into items of a few ids each, repeated ids included, give the split of whole texts."""
    monkeypatch.setattr(C, "SLICE", 3)
    rnd = random.Random(11)
    texts = ["river over the road"] * 20 + ["river over the roads"] * 9 + ["", ""] + ["dry"] * 5 + ["river over a road"]
    ids = rnd.sample(range(-500, 500), len(texts))
    rows = [("a", i, t) for i, t in zip(ids, texts)]
    df = spark.createDataFrame(rows, "g string, id long, text string")
    for block in (4, 256):
        got = {r["id"]: (r["multiplicity"], round(r["centrality"], 6)) for r in C.categorize(df, ["g"], "id", "text", normalize=False, block=block).collect()}
        assert got == {i: v[:2] for i, v in brute([(i, t) for _, i, t in rows]).items()}
    twice = C.categorize(df.unionByName(df), ["g"], "id", "text", normalize=False, block=4).collect()
    assert len(twice) == 2 * len(rows)
    assert {r["id"]: r["multiplicity"] for r in twice} == {
        i: max(1, 2 * sum(1 for j, u in zip(ids, texts) if j > i and similarity(t, u) > 0.8)) for i, t in zip(ids, texts)}


def test_near_texts_of_many_copies_leave_no_links(spark):
    """100 near texts of 10 copies: what the compared blocks return grows with the ids, not with texts or ids times near texts."""
    from tidewatch.session import scratch_tables

    found, kept = [], C.written
    df = spark.createDataFrame([("a", i, f"a long text about flood {i % 100:02d}") for i in range(1000)], "g string, id long, text string")
    with pytest.MonkeyPatch.context() as m, scratch_tables(spark):
        m.setattr(C, "written", lambda t, name: found.append((name, kept(t, name))) or found[-1][1])
        out = {r["id"]: r["multiplicity"] for r in C.categorize(df, ["g"], "id", "text").collect()}
        assert [t.count() for name, t in found if name == "categorize-blocks"] == [100]
    assert out == {i: max(1, 999 - i) for i in range(1000)}
