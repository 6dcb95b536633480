"""Registered text, search and graph queries over `documents` (whole texts)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch import schema
from tidewatch.functions import language as LG
from tidewatch.functions import text as TX
from tidewatch.functions.stemming import STOP_EN
from tidewatch.operators import graph as G
from tidewatch.operators.search import search, term_stats
from tidewatch.plans.catalog import register
from tidewatch.plans.query import QuerySpec
from tidewatch.plans.stem_sql import analyzed_sql
from tidewatch.sources.tables import doc_posts, table

R = 6
WORD_SQL = r"[\p{L}\p{M}\p{N}_]+(?:[.''\x{2019}][\p{L}\p{M}\p{N}_]+)*"
BANNED_SQL = "[" + ", ".join(f"'{w}'" for w in TX.NOT_ALLOWED_TOKENS) + "]"

CLEAN_SQL = (
    r"regexp_replace(list_reduce(list_concat(regexp_extract_all(text, '(https?://[^\s]+)', 1), "
    r"list_transform(regexp_extract_all(text, '(?i)@([a-z0-9_]+)', 1), lambda n: '@' || n)), "
    r"lambda acc, w: replace(acc, w, ''), text), '^\s+|\s+$', '', 'g')"
)
WORDS_SQL = f"regexp_extract_all(lower({CLEAN_SQL}), '{WORD_SQL}')"
STOP_SQL = "[" + ", ".join(f"'{w}'" for w in sorted(STOP_EN)) + "]"
PLAIN_TOKENS_SQL = f"list_filter(list_distinct(CASE WHEN lang = 'en' THEN list_filter({WORDS_SQL}, lambda w: NOT list_contains({STOP_SQL}, w)) ELSE {WORDS_SQL} END), lambda w: NOT list_contains({BANNED_SQL}, w) AND length(trim(w)) > 1)"
ANALYZED_SQL = analyzed_sql(WORDS_SQL, BANNED_SQL)
_POST_SQL = """(SELECT CAST(doc_id AS VARCHAR) AS tweetid, doc_id, text, lang, source, {tokens} AS tokens,
        CAST((doc_id * 37) % 101 AS DOUBLE) / CAST(100.0 AS DOUBLE) AS flood_probability FROM {source})"""
DOCPOSTS_SQL = _POST_SQL.format(tokens="tokens", source=ANALYZED_SQL)
PLAINPOSTS_SQL = _POST_SQL.format(tokens=PLAIN_TOKENS_SQL, source="documents")


@register("tokenize_documents", f"SELECT doc_id, list_sort(tokens) AS tokens FROM {ANALYZED_SQL}")
def tokenize_documents(spark: SparkSession, sf: str) -> DataFrame:
    """X3 (+X2, X20, A15): tokens of every whole document, stemmed by its language, as a sorted set."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.array_sort(TX.tokenize(F.col("text"), F.col("lang"))).alias("tokens"))


@register("clean_documents", f"SELECT doc_id, {CLEAN_SQL} AS clean FROM documents")
def clean_documents(spark: SparkSession, sf: str) -> DataFrame:
    """URLs and @names removed (plain replace of what was found), trimmed."""
    return table(spark, sf, "documents").select("doc_id", TX.clean_post("text").alias("clean"))


@register(
    "hashtags_documents",
    r"""SELECT doc_id, list_transform(list_filter(regexp_split_to_array(text, '\s+'),
               lambda w: starts_with(w, '#') AND length(w) < 256),
               lambda w: regexp_replace(w, '^[#.,\-"''&*^!]+|[#.,\-"''&*^!]+$', '', 'g')) AS hashtags
FROM documents""",
)
def hashtags_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Hashtags of every document in text order (empty where there is none)."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", TX.hashtags("text").alias("hashtags"))


# the steps of the normalization with Unicode classes spelled out for RE2
_W, _S = r"\p{L}\p{M}\p{N}\p{Pc}", r"\s\v\x{85}\p{Z}\x{1c}-\x{1f}"
_NORMALIZE_RE2 = (
    (rf"[{_S}]+&amp;?[{_S}]+", " and "), (r"@[A-Za-z0-9_]+\b", "_USER_ "), (rf"(?i)\b\p{{Nd}}\p{{Nd}}?:\p{{Nd}}\p{{Nd}}[{_S}]*[ap]\.?m\.?\b", "_TIME_"),
    (rf"(?i)\b\p{{Nd}}\p{{Nd}}?[{_S}]*[ap]\.?m\.?\b", "_TIME_"), (r"(?i)\b\p{Nd}\p{Nd}?:\p{Nd}\p{Nd}:\p{Nd}\p{Nd}\b", "_TIME_"),
    (r"(?i)\b\p{Nd}\p{Nd}?:\p{Nd}\p{Nd}\b", "_TIME_"), (rf"(?i)\bhttps?:[^{_S}]+", " _URL_ "), (rf"(?i)[{_S}]+https?$", " _URL_"),
    (rf"[^{_W}{_S}:'\",.()#@?!/\x{{2019}}_]+", ""), (r"\n", " "), (rf"[{_S}]{{2,}}", " "), (rf"^[{_S}]+|[{_S}]+$", ""))


def _normalize_sql(expr: str) -> str:
    for pattern, repl in _NORMALIZE_RE2:
        expr = f"regexp_replace({expr}, '{pattern.replace(chr(39), chr(39) * 2)}', '{repl}', 'g')"
    return expr


@register("normalize_documents", f"SELECT doc_id, {_normalize_sql('text')} AS normalized FROM documents")
def normalize_documents(spark: SparkSession, sf: str) -> DataFrame:
    """X1 over whole documents (Unicode regex semantics; checked against Python `re` in tests)."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", TX.normalize_aggressive("text").alias("normalized"))


@register("language_documents", f"""
WITH w AS (SELECT doc_id, lang, ' ' || unnest(regexp_extract_all(lower(coalesce(text, '')), '\\p{{L}}+')) || ' ' AS w FROM documents),
u AS (SELECT doc_id, lang, w, count(*) AS times FROM w GROUP BY ALL),
g AS (SELECT doc_id, lang, substr(w, CAST(i AS INT), CAST(o AS INT)) AS gram, times FROM (
        SELECT doc_id, lang, w, times, o, unnest(range(1, length(w) - o + 2)) AS i FROM u, (VALUES (1), (2), (3)) x(o))),
c AS (SELECT doc_id, lang, gram, sum(times) AS n FROM g WHERE gram <> ' ' GROUP BY ALL),
own AS (SELECT * FROM (SELECT doc_id, gram, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, encode(gram)) - 1 AS r FROM c) WHERE r < {LG.PROFILE}),
p AS (SELECT * FROM (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY n DESC, encode(gram)) - 1 AS r FROM (
        SELECT lang, gram, sum(n) AS n FROM c WHERE lang IS NOT NULL AND doc_id % 3 <> 0 GROUP BY 1, 2)) WHERE r < {LG.PROFILE}),
d AS (SELECT o.doc_id, l.lang, CAST(sum(CASE WHEN p.r IS NULL THEN {LG.PROFILE} ELSE abs(p.r - o.r) END) AS BIGINT) AS far
      FROM own o CROSS JOIN (SELECT DISTINCT lang FROM p) l LEFT JOIN p ON p.lang = l.lang AND p.gram = o.gram GROUP BY 1, 2)
SELECT documents.doc_id, (SELECT arg_min(d.lang, (d.far, d.lang)) FROM d WHERE d.doc_id = documents.doc_id) AS lang_pred FROM documents""")
def language_documents(spark: SparkSession, sf: str) -> DataFrame:
    """the nearest language profile of every whole document, learned from those whose id is no multiple of three."""
    d = table(spark, sf, "documents")
    profiles = LG.collected(LG.language_profiles(d.where(F.col("doc_id") % 3 != 0)))
    return d.select("doc_id", LG.language_of("text", profiles).alias("lang_pred"))


@register(
    "slug_parts",
    r"SELECT p_partkey, regexp_replace(p_name || ' ' || p_type, '[^\p{L}\p{M}\p{N}_]+', '_', 'g') AS slug FROM part",
)
def slug_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Non-word runs -> '_'."""
    p = table(spark, sf, "part")
    return p.select("p_partkey", TX.slug(F.concat_ws(" ", "p_name", "p_type")).alias("slug"))


def _bm25_sql(words: list[str], fields: list[str], source: str) -> str:
    wl = "[" + ", ".join(f"'{w}'" for w in words) + "]"
    parts = []
    for f in fields:
        fw = f"regexp_extract_all(lower({f}), '{WORD_SQL}')" if f != "tokens" else \
            f"flatten(list_transform(tokens, lambda x: regexp_extract_all(lower(x), '{WORD_SQL}')))"
        parts.append(f"""
fw_{f} AS (SELECT tweetid, {fw} AS w FROM {source} s),
st_{f} AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM fw_{f} WHERE len(w) > 0),
h_{f} AS (SELECT tweetid, len(w) AS dl, word, count(*) AS tf FROM (SELECT tweetid, w, unnest(w) AS word FROM fw_{f}) x
          WHERE list_contains({wl}, word) GROUP BY tweetid, len(w), word),
df_{f} AS (SELECT word, count(*) AS df FROM h_{f} GROUP BY word),
s_{f} AS (SELECT tweetid, sum(ln(1 + (st.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / st.avgdl))) AS score
          FROM h_{f} JOIN df_{f} USING (word), st_{f} st GROUP BY tweetid)""")
    union = " UNION ALL ".join(f"SELECT * FROM s_{f}" for f in fields)
    return "WITH " + ",".join(parts) + f""",
best AS (SELECT tweetid, max(score) AS score FROM ({union}) u GROUP BY tweetid)"""


SEARCH_Q = "river der water que flood"


@register(
    "search_documents",
    _bm25_sql(["river", "der", "water", "que", "flood"], ["text", "tokens"], DOCPOSTS_SQL)
    + "\nSELECT tweetid, round(score, 6) AS score FROM best",
)
def search_documents(spark: SparkSession, sf: str) -> DataFrame:
    """F8 (+X20, P12): BM25 multi-field search over whole texts and tokens; every match."""
    hits = search(doc_posts(spark, sf), SEARCH_Q, ["text", "tokens"])
    return hits.select("tweetid", F.round("score", R).alias("score"))


@register(
    "search_query_top",
    _bm25_sql(["ouen", "thes", "ation"], ["text", "tokens"], DOCPOSTS_SQL)
    + """
SELECT d.tweetid, d.lang, round(best.score, 6) AS score FROM best JOIN """ + DOCPOSTS_SQL + """ d USING (tweetid)
WHERE d.flood_probability >= 0.2 ORDER BY best.score DESC, d.tweetid LIMIT 20""",
)
def search_query_top(spark: SparkSession, sf: str) -> DataFrame:
    """Q1 with search (F9, L3, L4): unscored filter, then relevance order only (the
    requested order_by is ignored when searching), size 20."""
    from tidewatch.operators.filters import lookup_filter

    spec = QuerySpec.from_params({"search": "ouen thes ation", "size": "20", "order_by": "-flood_probability"})
    hits = search(doc_posts(spark, sf), spec.search, ["text", "tokens"], where=lookup_filter("flood_probability", "gte", 0.2))
    rows = hits.orderBy(*spec.sort_columns()).limit(spec.size)
    return rows.select("tweetid", "lang", F.round("score", R).alias("score"))


@register(
    "term_stats_tokens",
    f"SELECT name, count(*) AS size FROM (SELECT unnest(tokens) AS name FROM {DOCPOSTS_SQL} d) x GROUP BY name",
)
def term_stats_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Corpus-wide frequency of every token."""
    return term_stats(doc_posts(spark, sf), "tokens")


def _children_sql(term: str, source: str = PLAINPOSTS_SQL) -> str:
    return f"""
WITH d AS (SELECT tweetid, flood_probability, tokens FROM {source} s),
names AS (SELECT DISTINCT unnest(tokens) AS name FROM d
          WHERE list_contains(tokens, '{term}') AND flood_probability > 0.6 AND flood_probability <= 1.0),
ttf AS (SELECT unnest(tokens) AS name, count(*) AS size FROM d GROUP BY 1)
SELECT '{term}' AS parent, names.name AS name, ttf.size AS size FROM names JOIN ttf USING (name) WHERE names.name <> '{term}'
"""


def _graph_sql(term: str, k: int, source: str = PLAINPOSTS_SQL) -> str:
    """CTEs up to e(level, parent, name, size): both levels over the k most relevant documents of each parent."""
    return f"""
WITH d AS MATERIALIZED (SELECT tweetid, flood_probability AS p, tokens, len(tokens) AS dl FROM {source} s),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM d WHERE dl > 0),
post AS MATERIALIZED (SELECT tweetid, p, dl, unnest(tokens) AS name FROM d),
dfc AS (SELECT name, count(*) AS df FROM post GROUP BY 1),
ranked AS MATERIALIZED (SELECT name AS parent, tweetid, row_number() OVER (PARTITION BY name ORDER BY
             ln(1 + (st.n - df + 0.5) / (df + 0.5)) * 2.2 / (1 + 1.2 * (1 - 0.75 + 0.75 * dl / st.avgdl)) DESC, tweetid) AS rn
           FROM post JOIN dfc USING (name), st WHERE p > 0.6 AND p <= 1.0),
edges AS MATERIALIZED (SELECT DISTINCT parent, name FROM ranked JOIN post USING (tweetid) WHERE rn <= {k} AND name <> parent),
e AS (SELECT 1 AS level, parent, name, df AS size FROM edges JOIN dfc USING (name) WHERE parent = '{term}'
      UNION ALL SELECT 2, parent, name, df FROM edges JOIN dfc USING (name)
      WHERE parent IN (SELECT name FROM edges WHERE parent = '{term}'))"""


@register("term_children_que", _children_sql("que"))
def term_children_que(spark: SparkSession, sf: str) -> DataFrame:
    """G1 (+J5, A12, F11, L9): words co-occurring with 'que' in any of its documents (words without English stop words; no stems, as it is a stop word of two languages)."""
    return G.term_children(doc_posts(spark, sf, stemmed=False), ["que"])


@register("term_children_stem", _children_sql("ther", DOCPOSTS_SQL))
def term_children_stem(spark: SparkSession, sf: str) -> DataFrame:
    """G1 on stemmed tokens: those of documents with the stem 'ther'."""
    return G.term_children(doc_posts(spark, sf), ["ther"])


@register("term_graph_der", _graph_sql("der", schema.GRAPH_TOP_DOCS) + " SELECT level, parent, name, size FROM e")
def term_graph_der(spark: SparkSession, sf: str) -> DataFrame:
    """Two-level graph around 'der' over the ten most relevant documents of each term
    (level 2 for every child in one keyed join)."""
    return G.term_graph(doc_posts(spark, sf, stemmed=False), "der", top_docs=schema.GRAPH_TOP_DOCS)


@register("term_graph_json", _graph_sql("que", schema.GRAPH_TOP_DOCS) + """,
kids AS (SELECT parent, string_agg('{"name":' || to_json(name) || ',"size":' || size || '}', ',' ORDER BY size DESC, name) AS js
         FROM e WHERE level = 2 GROUP BY parent)
SELECT e.name, e.size, '{"name":' || to_json(e.name) || ',"size":' || e.size || ',"children":[' || coalesce(js, '') || ']}' AS json
FROM e LEFT JOIN kids ON kids.parent = e.name WHERE level = 1""")
def term_graph_json(spark: SparkSession, sf: str) -> DataFrame:
    """The graph around 'que' as nested JSON, one object per child."""
    return G.graph_json(G.term_graph(doc_posts(spark, sf, stemmed=False), "que", top_docs=schema.GRAPH_TOP_DOCS))


@register(
    "page_links",
    r"""SELECT page_id, list_sort(list_distinct(regexp_extract_all(html, '(?i)<a[^>]*\shref="([^"]*)"', 1))) AS links,
       list_sort(list_distinct(regexp_extract_all(html, '(?i)<img[^>]*\ssrc="([^"]*)"', 1))) AS media FROM pages""",
)
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    """X6 over raw pages: distinct link targets and image sources of every page."""
    p = table(spark, sf, "pages")
    return p.select("page_id", F.array_sort(TX.links("html")).alias("links"), F.array_sort(TX.media_links("html")).alias("media"))
