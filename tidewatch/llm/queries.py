"""The queries of this package: one per operator, over the whole of its table."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import bpe, chat, decontam, divergence, langid, lines, minmax, mixing, periodic, quality, tokens, vectors, wrapper
from tidewatch.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


#: Of op1: a target that natural shares miss and a limit on repeats under the budget, so that both bind.
MIX = {"entropy": 0.9999, "max_repeats": 2.0, "budget": 1.5}
_HASH32 = "CAST(('0x' || substr(md5({}), 1, 8)) AS BIGINT)"
#: The mixture of a relation d(doc_id, source, text), as DuckDB SQL.
MIX_SQL = f"""
r AS (SELECT doc_id, coalesce(source, '') AS source,
             CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens FROM d),
n AS (SELECT * FROM r WHERE tokens > 0),
s AS (SELECT source, count(*) AS docs, CAST(sum(tokens) AS BIGINT) AS tokens,
             CAST(sum(tokens) AS DOUBLE) / (SELECT sum(tokens) FROM n) AS share FROM n GROUP BY source),
coarse AS (SELECT k, (ln(z) - pl / z) / ln(greatest(m, 2)) AS entropy, top / z AS repeats, m FROM (
    SELECT k, sum(p) AS z, sum(p * ln(p)) AS pl, max(p / share) AS top, count(*) AS m FROM (
        SELECT k * 1024 AS k, share, pow(share, k * 1024 / CAST({mixing.GRID} AS DOUBLE)) AS p FROM s, range(0, 1025) t(k)) GROUP BY k)),
near AS (SELECT coalesce(max(k) FILTER (WHERE entropy >= {MIX['entropy']} OR m < 2), 0) AS e,
              coalesce(min(k) FILTER (WHERE repeats * {MIX['budget']} <= {MIX['max_repeats']}), {mixing.GRID}) AS q FROM coarse),
fine AS (SELECT j, side, (ln(z) - pl / z) / ln(greatest(m, 2)) AS entropy, top / z AS repeats, m FROM (
    SELECT j, side, sum(p) AS z, sum(p * ln(p)) AS pl, max(p / share) AS top, count(*) AS m FROM (
        SELECT j, side, share, pow(share, j / CAST({mixing.GRID} AS DOUBLE)) AS p FROM s, (
            SELECT e + k AS j, 'e' AS side FROM near, range(0, 1025) t(k) WHERE e + k <= {mixing.GRID}
            UNION ALL SELECT q - k, 'q' FROM near, range(0, 1025) t(k) WHERE q - k >= 0)) GROUP BY j, side)),
a AS (SELECT greatest(coalesce(max(j) FILTER (WHERE side = 'e' AND (entropy >= {MIX['entropy']} OR m < 2)), 0),
                      coalesce(min(j) FILTER (WHERE side = 'q' AND repeats * {MIX['budget']} <= {MIX['max_repeats']}), {mixing.GRID}))
             / CAST({mixing.GRID} AS DOUBLE) AS alpha FROM fine),
w AS (SELECT s.*, pow(share, alpha) / (SELECT sum(pow(share, alpha)) FROM s, a) AS weight FROM s, a),
b AS (SELECT *, CAST(floor(weight * (SELECT sum(tokens) FROM n) * CAST({MIX['budget']} AS DOUBLE)) AS BIGINT) AS quota FROM w),
q AS (SELECT *, quota // tokens AS passes, quota % tokens AS rest FROM b),
dealt AS (SELECT n.doc_id, n.source, n.tokens AS n_tokens, q.passes, q.rest,
                 {_HASH32.format(f"'{mixing.SEED}|' || doc_id")} % CAST(ceil(q.docs / CAST({mixing.BLOCK_DOCS} AS DOUBLE)) AS BIGINT) AS block
          FROM n JOIN q USING (source)),
last_ AS (SELECT *, passes AS epoch, {_HASH32.format(f"'{mixing.SEED}|block|' || source || '|' || passes || '|' || block")} AS block_key,
                 {_HASH32.format(f"'{mixing.SEED}|doc|' || passes || '|' || doc_id")} AS doc_key FROM dealt WHERE rest > 0),
blocks AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY block_key, block ROWS UNBOUNDED PRECEDING) - size AS before
           FROM (SELECT source, block, block_key, rest, sum(n_tokens) AS size FROM last_ GROUP BY ALL)),
part AS (SELECT l.*, before, sum(n_tokens) OVER (PARTITION BY l.source, l.block ORDER BY doc_key, doc_id ROWS UNBOUNDED PRECEDING) - n_tokens AS upto
         FROM last_ l JOIN blocks b USING (source, block)),
picked AS (SELECT doc_id, source, epoch, block, n_tokens FROM part WHERE before + upto < rest
           UNION ALL SELECT doc_id, source, unnest(range(passes)) AS epoch, block, n_tokens FROM dealt)
SELECT doc_id, source, CAST(epoch AS BIGINT) AS epoch, block,
       {_HASH32.format(f"'{mixing.SEED}|block|' || source || '|' || epoch || '|' || block")} AS block_key,
       {_HASH32.format(f"'{mixing.SEED}|doc|' || epoch || '|' || doc_id")} AS doc_key, n_tokens FROM picked
"""


@query("WITH d AS (SELECT doc_id, source, text FROM documents)," + MIX_SQL)
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of all documents by source: one and a half times their tokens, nearly uniform, at most two passes."""
    return mixing.mix(table(spark, sf_dir, "documents"), **MIX)


_ESCAPED = "replace(replace(replace(replace(replace(coalesce({}, ''), '\\', '\\\\'), '<s>', '<\\s>'), '</s>', '<\\/s>'), '[INST]', '[\\INST]'), '[/INST]', '[\\/INST]')"


@query(f"""
WITH t AS (SELECT conv_id, turn, role, text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
u AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r0, text AS t0 FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')}) + 7
                + CASE WHEN role = 'assistant' THEN 7 ELSE 6 END) AS BIGINT) AS formatted_chars
FROM u GROUP BY conv_id""")
def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the control-string case -7, formatted on token ids and read back."""
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    case = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.conversation_digests(chat.format_conversations(conv.unionByName(case))).drop("n_tokens")


@query()
def op3_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return minmax.near_duplicates(table(spark, sf_dir, "documents"))


@query("""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x != 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id != b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT m.vec_id, (SELECT count(*) FROM l WHERE l.a = m.vec_id) AS n_links, coalesce(c.c, m.vec_id) AS component_id,
       coalesce(c.c, m.vec_id) = m.vec_id AS kept
FROM embeddings m LEFT JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) c ON c.a = m.vec_id""")
def op4_int8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.95."""
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


@query()
def op5_template_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the benchmark items found in them."""
    return decontam.flag_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op6_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return wrapper.extract_text(table(spark, sf_dir, "pages"))


@query()
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return tokens.token_counts(table(spark, sf_dir, "documents"))


@query()
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned from labels whose crc32(doc_id) mod 5 is not 0."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    out = quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn_from=fold != 0)
    return out.select("doc_id", (fold == 0).alias("held_out"), "score", "predicted")


@query(f"""
WITH p AS (SELECT doc_id, coalesce(source, '') AS host, text, string_split(text, chr(10)) AS ls FROM documents),
h AS (SELECT host, count(*) AS n FROM p GROUP BY host),
u AS (SELECT host, line, count(*) AS k FROM (SELECT host, unnest(list_distinct(list_filter(ls, lambda x: trim(x, ' ') != ''))) AS line FROM p) GROUP BY host, line),
z AS (SELECT host, list(line) AS bad FROM u JOIN h USING (host) WHERE k >= {lines.LEAST_PAGES} AND k > {lines.RATIO}::DOUBLE * n GROUP BY host),
k AS (SELECT p.doc_id, p.text, ls, CASE WHEN bad IS NULL THEN ls ELSE list_filter(ls, lambda x: NOT list_contains(bad, x)) END AS kept FROM p LEFT JOIN z USING (host))
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE array_to_string(kept, chr(10)) END AS text,
       CAST(coalesce(len(ls) - len(kept), 0) AS BIGINT) AS lines_dropped FROM k""")
def op9_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without their site's boilerplate lines."""
    return lines.drop_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "text", "lines_dropped")


@query()
def op10_ecoc_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learned from those whose crc32(doc_id) mod 4 is not 2."""
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = langid.fit(docs.where(fold != 2))
    out = langid.predict(docs, model)
    return out.select("doc_id", (fold == 2).alias("held_out"), "lang_pred", "score", "ambiguous")


def plant_tail(doc_id: int | None, n_words: int) -> tuple[int, int] | None:
    """The contract's planted case: of every tenth id (by its crc32) the words from a on repeat with period p."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10:
        return None
    g = h // 10
    a = g % n_words
    return a, 1 + (n_words - a) // (3 + g % 8)


_CRC_STEP = "list_reduce([{}] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
#: A run has at least 12 words and twice its period, so it holds at least six neighbouring pairs of equal words.
_RUNS_SQL = f"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                  xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)),
                                  lambda c, b: {_CRC_STEP.format("xor(c, b)")}), 4294967295) AS h FROM documents),
g AS (SELECT doc_id, w, len(w) AS n, h, h // 10 AS g FROM t),
p AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM g),
d AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
             THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END])
             ELSE w END AS w FROM p),
u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM d),
six AS (SELECT doc_id, i, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS s,
               count(*) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS k FROM u),
m AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM six x JOIN six y ON x.doc_id = y.doc_id AND x.s = y.s AND y.i > x.i WHERE x.k = 6 AND y.k = 6),
z AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m),
st AS (SELECT doc_id, q, min(i) AS start, count(*) + 5 + q AS length FROM z GROUP BY doc_id, q, island),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM st WHERE length >= greatest(12, 2 * q) GROUP BY doc_id, start, length),
top AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) = 1),
said AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS s FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
left_ AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS s FROM u ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
       sha256(coalesce(said.s, '')) AS runs_sha256, sha256(coalesce(left_.s, '')) AS collapsed_sha256
FROM d LEFT JOIN said USING (doc_id) LEFT JOIN top USING (doc_id) LEFT JOIN left_ USING (doc_id)"""


@query(_RUNS_SQL)
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of the words of all documents, with the contract's planted tails."""
    return periodic.run_digests(periodic.periodic_runs(table(spark, sf_dir, "documents"), rewrite=plant_tail))


@query()
def op12_rank_queue_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded to token ids and decoded again."""
    return bpe.round_trip_digests(bpe.decode(bpe.encode(table(spark, sf_dir, "documents"))))


@query("""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'),
                                 lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents),
u AS (SELECT lang, source, unnest(w) AS term FROM d),
held AS (SELECT lang, unnest(list_distinct(w)) AS term FROM d),
kept AS (SELECT lang, term FROM held GROUP BY lang, term HAVING count(*) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM u SEMI JOIN kept USING (lang, term) GROUP BY ALL),
cl AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
gn AS (SELECT g.lang, g.source, CAST(coalesce(sum(n), 0) AS HUGEINT) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
ln_ AS (SELECT lang, CAST(sum(n) AS HUGEINT) AS n FROM cl GROUP BY lang),
p AS (SELECT gn.lang, gn.source, kept.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * CAST(coalesce(c.n, 0) + 2 AS HUGEINT)) // (gn.n + 2 * v.v) AS p
      FROM gn JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = kept.term),
q AS (SELECT lang, cl.term, 1 + (1000000000 * CAST(cl.n + 2 AS HUGEINT)) // (ln_.n + 2 * v.v) AS q FROM cl JOIN ln_ USING (lang) JOIN v USING (lang)),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source != b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT p.lang, p.source, p.term AS item, (p.p - q.q) * (p.p - q.q) // (p.p + q.q) AS value
          FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q),
r AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS rank FROM pairs
      UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS rank FROM terms) WHERE rank <= 10)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM r""")
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of all documents' sources from each other and from their language."""
    return divergence.divergence(table(spark, sf_dir, "documents"))
