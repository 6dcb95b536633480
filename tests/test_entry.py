"""Driver contract: entry(), queries() and oracle_sql(); a sample of oracles at sf0.001."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["key", "doc_count", "lat", "lon"]
    assert df.count() > 0


def test_registry_shape():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 50


def test_registry_without_a_session():
    """The registry is read by processes that have no Spark session yet."""
    code = ("import __spark_entry__ as E; q, o = E.queries(), E.oracle_sql(); "
            "from pyspark.sql import SparkSession; assert SparkSession.getActiveSession() is None; print(len(q), len(o))")
    root = os.path.dirname(os.path.abspath(E.__file__))
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]
    n_queries, n_sql = map(int, out.stdout.split())
    assert n_queries >= 50 and n_sql >= 50


def norm(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", ["hotspots_p4", "prob_histogram_box_day", "categorize_parts", "search_documents",
                                  "country_of_posts", "upsert_merged", "segments_orders", "stream_histogram_1h"])
def test_oracle_sample(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    sdf = E.queries()[name](spark, SF)
    cols = sorted(sdf.columns)
    srows = sorted((tuple(norm(r[c]) for c in cols) for r in sdf.collect()), key=repr)
    cur = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(dcols) == cols
    drows = sorted((tuple(norm(r[dcols.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    assert srows == drows
