"""F8 multi-field relevance search (BM25) and A12 term statistics.

Scoring follows the search engine's defaults: per field, BM25 with k1=1.2, b=0.75,
idf = ln(1 + (N - df + 0.5) / (df + 0.5)), tf-norm = tf (k1+1) / (tf + k1 (1 - b + b dl/avgdl));
query words are OR-ed (summed within a field); a row's score is its best field.

Plan: all fields are analyzed in one pass over the rows, which leaves their lengths and the
query's words in them; only occurrences of the query's words are exploded and shuffled; corpus
statistics are one aggregate, a row per field.
"""

from __future__ import annotations

import regex

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import schema
from tidewatch.functions.text import WORD_PATTERN, analyzed_words
from tidewatch.session import written

K1, B = 1.2, 0.75
_WORD_RE = regex.compile(WORD_PATTERN)


def query_words(query: str) -> list[str]:
    """Analyze the query string like the fields (lower-case words), distinct, in order."""
    seen: list[str] = []
    for w in _WORD_RE.findall(query.lower()):
        if w not in seen:
            seen.append(w)
    return seen


def _field_words(df: DataFrame, field: str) -> Column:
    """The field's analyzed words; elements of an array are analyzed together, as no word crosses a space."""
    dtype = dict(df.dtypes)[field]
    return analyzed_words(F.array_join(field, " ") if dtype.startswith("array") else F.col(field))


def search(df: DataFrame, query: str, fields=schema.SEARCH_FIELDS, key: str = "tweetid",
           k1: float = K1, b: float = B, where: Column | None = None) -> DataFrame:
    """Rows matching any query word in any field, with `score` (best field's BM25).

    Corpus statistics come from all of `df`; `where` (unscored filters) only selects rows.
    """
    words = query_words(query)
    fields = [f for f in fields if f in df.columns]
    if not words or not fields:
        return df.limit(0).withColumn("score", F.lit(0.0))
    wlit = F.array(*[F.lit(w) for w in words])
    # one pass: per field its words, kept as their number and the query words among them
    fw = df.select(F.col(key).alias("_k"), *[_field_words(df, f).alias(f"_w{i}") for i, f in enumerate(fields)])
    small = fw.select("_k", F.array(*[F.struct(F.lit(i).alias("field"), F.size(f"_w{i}").alias("dl"), F.filter(
        f"_w{i}", lambda w: F.array_contains(wlit, w)).alias("hw")) for i in range(len(fields))]).alias("_f"))
    small = written(small, "search").select("_k", F.explode("_f").alias("f")).select("_k", "f.*").where("dl > 0")
    stats = small.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    hits = small.where(F.size("hw") > 0).select("_k", "field", "dl", F.explode("hw").alias("word")) \
        .groupBy("_k", "field", "dl", "word").agg(F.count(F.lit(1)).alias("tf"))
    dfreq = hits.groupBy("field", "word").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(F.lit(1.0) + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tfn = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = hits.join(F.broadcast(dfreq.join(stats, "field")), ["field", "word"])  # a row per field and query word
    best = scored.groupBy("_k", "field").agg(F.sum(idf * tfn).alias("score")).groupBy("_k").agg(F.max("score").alias("score"))
    rows = df if where is None else df.filter(where)
    return rows.join(best.withColumnRenamed("_k", key), key)


def term_stats(df: DataFrame, field: str = "tokens") -> DataFrame:
    """Corpus-wide occurrences of each term of an (array) field -> (name, size)."""
    return df.select(F.explode(_field_words(df, field)).alias("name")).groupBy("name").agg(
        F.count(F.lit(1)).alias("size"))
