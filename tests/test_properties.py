"""Property tests (SURVEY §5 (c)): categorize invariants, histogram totals."""

from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings, strategies as st

from tidewatch.functions.similarity import similarity
from tidewatch.operators import aggs as A
from tidewatch.operators import cluster as C

texts = st.lists(st.tuples(st.integers(1, 50), st.sampled_from(["flood", "floods", "river flood", "rain", "storm now", "x"])),
                 min_size=1, max_size=12, unique_by=lambda t: t[0])


@given(texts)
@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_categorize_invariants(spark, docs):
    df = spark.createDataFrame([(i, t) for i, t in docs], "id long, text string")
    rows = {r["id"]: r for r in C.categorize(df, [], "id", "text", normalize=False).collect()}
    assert set(rows) == {i for i, _ in docs}                       # every row in exactly one list
    by_id = dict(docs)
    for i, r in rows.items():
        older_dup = any(j < i and similarity(by_id[i], by_id[j]) > 0.8 for j in by_id)
        assert r["representative"] == (not older_dup)               # representative iff no older near-duplicate
        assert r["multiplicity"] >= 1 and (r["centrality"] == 0) == older_dup
    oldest = min(by_id)
    assert rows[oldest]["representative"]                            # the oldest post is always representative


@given(st.lists(st.integers(0, 5 * 24 * 3600), min_size=1, max_size=40), st.sampled_from(["10m", "1h", "1d", "7m"]))
@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_histogram_counts_sum_to_rows(spark, secs, interval):
    base = datetime(2024, 1, 1)
    df = spark.createDataFrame([(base + timedelta(seconds=s),) for s in secs], "created_at timestamp")
    h = A.time_histogram(df, interval).collect()
    assert sum(r["doc_count"] for r in h) == len(secs)
    keys = [r["key"] for r in h]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)
    assert h[0]["doc_count"] > 0 and h[-1]["doc_count"] > 0        # gap filling only between non-empty ends
