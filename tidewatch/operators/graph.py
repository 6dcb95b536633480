"""Term co-occurrence graph around a term (J5 doc-term self-join, A12 sizes).

children(term): docs whose tokens contain the term and whose probability is in (0.6, 1]; all
of them, or with `top_docs` those ranked highest by relevance of the term on `tokens` (ties by
id); every other token of those docs is a child with size = its corpus-wide frequency; size
desc, name asc.
graph(term): the children, and the children of each child (computed for all children
at once as one keyed join - no driver loop).

Top-k per parent uses `row_number() <= k`, which Spark plans with a partial
WindowGroupLimit before the shuffle, so a very common term never ships all its docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidewatch.operators.filters import probability_gate
from tidewatch.operators.search import B, K1, term_stats
from tidewatch.session import written


def _postings(df: DataFrame, key: str, tokens: str) -> DataFrame:
    return df.select(F.col(key).alias("_k"), F.explode(F.array_distinct(F.col(tokens))).alias("name"))


def _top_docs(df: DataFrame, parents: DataFrame, key: str, tokens: str, top_docs: int | None,
              lo: float, hi: float) -> DataFrame:
    """(parent, _k) for the top docs of each parent term, scored by BM25 of the term on tokens."""
    base = df.select(F.col(key).alias("_k"), F.size(F.col(tokens)).alias("dl"), F.col("flood_probability"))
    stats = base.filter(F.col("dl") > 0).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    n_docs, avgdl = stats.select("n").scalar(), stats.select("avgdl").scalar()
    if isinstance(parents, (list, tuple)):  # literal terms: a filter, not a join with literals
        post = _postings(df, key, tokens).filter(F.col("name").isin([p.lower() for p in parents]))
    else:
        post = _postings(df, key, tokens).join(parents.select(F.col("parent").alias("name")).distinct(), "name")
    dfreq = post.groupBy("name").agg(F.count(F.lit(1)).alias("df"))
    gated = base.filter(probability_gate(lo, hi))
    cand = post.join(gated, "_k").join(dfreq, "name")
    idf = F.log(F.lit(1.0) + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tfn = F.lit(K1 + 1) / (F.lit(1.0) + K1 * (1 - B + B * F.col("dl") / avgdl))
    cand = cand.select(F.col("name").alias("parent"), "_k", (idf * tfn).alias("score"))
    if top_docs:
        w = Window.partitionBy("parent").orderBy(F.desc("score"), F.asc("_k"))
        cand = cand.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= top_docs).drop("_rn")
    return cand.select("parent", "_k")


def term_children(df: DataFrame, parents: DataFrame, key: str = "tweetid", tokens: str = "tokens",
                  top_docs: int | None = None, lo: float = 0.6, hi: float = 1.0,
                  sizes: DataFrame | None = None) -> DataFrame:
    """G1 for every term in `parents` (a DataFrame(parent) or a list of terms) at once
    -> (parent, name, size)."""
    df = df.select(key, tokens, "flood_probability")
    if sizes is None:
        df = written(df, "term-children")
    if isinstance(parents, (list, tuple)) and not top_docs:  # all documents of given terms: found and read in one pass
        wanted = F.array(*[F.lit(p.lower()) for p in parents])
        docs = df.filter(probability_gate(lo, hi)).select(F.array_intersect(tokens, wanted).alias("in"), F.col(tokens).alias("t")).where(F.size("in") > 0)
        kids = docs.select(F.explode("in").alias("parent"), "t").select("parent", F.explode("t").alias("name")).distinct()
    else:
        top = _top_docs(df, parents, key, tokens, top_docs, lo, hi)
        kids = top.join(_postings(df, key, tokens), "_k").select("parent", "name").distinct()
    kids = kids.filter(F.col("name") != F.col("parent"))
    sizes = sizes if sizes is not None else term_stats(df.select(tokens), tokens)
    return kids.join(sizes, "name").select("parent", "name", "size")


def term_graph(df: DataFrame, term: str, key: str = "tweetid", tokens: str = "tokens",
               top_docs: int | None = None) -> DataFrame:
    """Edges (level, parent, name, size); level 1 = children of `term`, level 2 =
    children of each level-1 child (which may contain the root again). Without `top_docs` the
    second level holds every pair of tokens that share a document: as large as the corpus'
    co-occurrence table."""
    # tokens are computed once and shared by postings, sizes and both levels
    df = written(df.select(key, tokens, "flood_probability"), "term-graph")
    sizes = term_stats(df.select(tokens), tokens)
    lvl1 = term_children(df, [term], key, tokens, top_docs, sizes=sizes)
    lvl2 = term_children(df, lvl1.select(F.col("name").alias("parent")), key, tokens, top_docs, sizes=sizes)
    return lvl1.select(F.lit(1).alias("level"), "parent", "name", "size").unionByName(
        lvl2.select(F.lit(2).alias("level"), "parent", "name", "size"))


def graph_json(edges: DataFrame) -> DataFrame:
    """The nested graph as JSON, one row (name, size, json) per level-1 child, where
    json = {"name", "size", "children": [{"name", "size"}, ...]}, children by size desc, name asc.

    A child's list holds each token once, at most the vocabulary of its documents; the level-1
    list is never gathered into a single row or task (`write_graph` writes it as one document).
    """
    l2 = edges.filter("level = 2").groupBy("parent").agg(
        F.array_sort(F.collect_list(F.struct(F.negative("size").alias("_o"), "name", "size"))).alias("kids"))
    l2 = l2.select(F.col("parent").alias("name"),
                   F.transform("kids", lambda k: F.struct(k["name"].alias("name"), k["size"].alias("size"))).alias("children"))
    l1 = edges.filter("level = 1").select("name", "size").join(l2, "name", "left")
    doc = F.struct("name", "size", F.coalesce("children", F.array().cast("array<struct<name:string,size:bigint>>")).alias("children"))
    return l1.select(F.col("name"), F.col("size"), F.to_json(doc).alias("json"))


def write_graph(edges: DataFrame, path: str) -> None:
    """Write the graph as text files which, joined in name order, are one JSON array ordered by
    size desc, name asc (a range-partitioned sort, no single-task gather)."""
    from tidewatch.sources.ingest import write_json_list

    write_json_list(graph_json(edges), "json", [F.negative("size"), F.col("name")], path)
