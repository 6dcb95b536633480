"""Periodic runs, rank-queue BPE and source divergence: brute force, the tokenizer library, DuckDB and odd inputs."""

import base64
import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F
from tests_llm_data import ODD, docs_frame

from tidewatch.llm import bpe, divergence, periodic, queries

SF = "/root/testdata/sf0.001"


def against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    df = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.ORACLES[name])
    assert sorted(d[0] for d in cur.description) == sorted(df.columns)
    want = [dict(zip([d[0] for d in cur.description], r)) for r in cur.fetchall()]
    key = lambda r: repr([r[c] for c in sorted(df.columns)])
    assert sorted((r.asDict() for r in df.collect()), key=key) == sorted(want, key=key)


# --- op11 -----------------------------------------------------------------------------------------


def runs_by_definition(x, least):
    found = {}
    for q in range(1, len(x)):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_equal_their_definition():
    rnd = random.Random(11)
    for _ in range(700):
        n = rnd.randint(0, 90)
        x = [rnd.randrange(rnd.choice([1, 2, 3, 5])) for _ in range(n)]
        for _ in range(rnd.randint(0, 3)):  # planted repetitions, also overlapping ones
            a = rnd.randrange(n + 1)
            p = 1 + rnd.randrange(max(1, (n - a) // 2))
            for i in range(a + p, rnd.randint(a, n)):
                x[i] = x[i - p]
        least = rnd.choice([2, 5, 12])
        got = [tuple(r) for r in periodic.find_runs(np.array(x, np.int64), least).tolist()]
        assert got == runs_by_definition(x, least), (x, least)


@pytest.mark.parametrize("x", ["ab" * 20 + "ba" * 20, "a" * 50, "aab" * 9 + "aab" * 2 + "b" * 30, "abaab" * 8 + "abaab"[:3]])
def test_runs_of_progressions_that_meet(x):
    x = [ord(c) for c in x]
    for least in (2, 12):
        assert [tuple(r) for r in periodic.find_runs(np.array(x), least).tolist()] == runs_by_definition(x, least)


def test_runs_of_fibonacci_words_and_long_texts():
    f, g = [0], [0, 1]
    while len(g) < 400:
        f, g = g, g + f
    assert [tuple(r) for r in periodic.find_runs(np.array(g), 12).tolist()] == runs_by_definition(g, 12)
    assert periodic.find_runs(np.zeros(300_000, np.int64)).tolist() == [[0, 300_000, 1]]
    tail = np.concatenate((np.arange(100_000), np.tile(np.arange(7_000), 20)))
    assert [93_000 + 7_000, 140_000, 7_000] in periodic.find_runs(tail).tolist()


def test_runs_of_odd_documents(spark):
    got = periodic.periodic_runs(docs_frame(spark))
    assert got.columns == ["doc_id", "n_words", "runs", "collapsed"]
    rows = got.collect()
    assert len(rows) == len(ODD)
    by_id = {r["doc_id"]: r for r in rows}
    for i in (1, 2, 3):
        assert (by_id[i]["n_words"], by_id[i]["runs"], by_id[i]["collapsed"]) == (0, [], "")
    assert [tuple(r) for r in by_id[8]["runs"]] == [(0, 60_000, 1)] and by_id[8]["collapsed"] == "word"
    assert by_id[None]["n_words"] == 4 and by_id[9]["n_words"] == 1
    told = {r["doc_id"]: r for r in periodic.run_digests(got).collect()}
    assert told[2]["start"] is None and told[2]["exponent_milli"] is None and told[2]["n_runs"] == 0
    assert told[2]["runs_sha256"] == told[2]["collapsed_sha256"] == hashlib.sha256(b"").hexdigest()
    assert told[8]["runs_sha256"] == hashlib.sha256(b"0,60000,1\n").hexdigest() and told[8]["exponent_milli"] == 60_000_000
    assert periodic.periodic_runs(docs_frame(spark).limit(0)).count() == 0


def test_runs_do_not_cross_documents(spark):
    docs = spark.createDataFrame([(i, "a b c d e f") for i in range(40)], "doc_id long, text string").coalesce(1)
    assert periodic.periodic_runs(docs).where("size(runs) > 0").count() == 0


def test_ids_beyond_double_precision_stay_whole(spark):
    docs = spark.createDataFrame([(None, "x"), (2**53 + 1, "x")], "doc_id long, text string").coalesce(1)
    assert {r["doc_id"] for r in periodic.periodic_runs(docs).collect()} == {None, 2**53 + 1}
    assert {r["doc_id"] for r in bpe.encode(docs).collect()} == {None, 2**53 + 1}


def test_op11_equals_sql(spark):
    against_sql(spark, "op11_periodic_runs")


# --- op12 -----------------------------------------------------------------------------------------


def library(ranks=None, pattern=public_tokenizers.PATTERN):
    if ranks is None:
        with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_op12_equals_the_library(spark):
    enc = library()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.QUERIES["op12_rank_queue_bpe"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]]
        ids = enc.encode_ordinary(text)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def ids_of(v, texts):
    return [np.frombuffer(ids, np.int32).tolist() for ids in v.encode(texts)]


def test_bpe_of_random_and_long_texts():
    v = bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    enc, rnd = library(), random.Random(12)
    parts = ["a", "aa", "th", "e", " ", "  ", "\n", "\r\n", "\t", "é", "ß", "日", "😀", "'s", "'LL", "12", "!!", "\x00", "　", "<|endoftext|>"]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 50))) for _ in range(500)]
    texts += ["a" * 4_000, "ab" * 3_000, " " * 3_000, "日本" * 900, "".join(rnd.choices("etaoinshrdlu", k=30_000)), ""]
    assert ids_of(v, texts) == [enc.encode_ordinary(t) for t in texts]
    for t in texts:
        assert v.decode(np.array(ids_of(v, [t])[0], np.int64)).tobytes() == t.encode()
    long = "".join(rnd.choices("etaoinshrdlu", k=1_000_000))  # one pre-token: linear work
    assert v.decode(np.array(ids_of(v, [long])[0])).tobytes() == long.encode()


def test_bpe_when_a_merge_brings_up_a_lower_rank(tmp_path, monkeypatch):
    # ranks where longer entries come first: bytes take the middle ranks
    rnd = random.Random(5)
    for trial in range(30):
        more = {"".join(rnd.choices("abc", k=rnd.randint(2, 5))).encode() for _ in range(40)}
        entries = [bytes([i]) for i in range(256)] + sorted(more)
        order = list(range(len(entries)))
        rnd.shuffle(order)
        ranks = dict(zip(entries, order))
        path = tmp_path / f"v{trial}"
        path.write_bytes(b"".join(base64.b64encode(b) + b" %d\n" % r for b, r in ranks.items()))
        v, enc = bpe.Vocabulary(str(path), r"\S+|\s+"), library(ranks, r"\S+|\s+")
        for _ in range(40):
            t = "".join(rnd.choices("abcd ", k=rnd.randint(1, 60)))
            assert ids_of(v, [t]) == [enc.encode_ordinary(t)], (trial, t)


def test_pattern_cuts_like_the_library():
    enc, pat = library(), regex.compile(public_tokenizers.PATTERN)
    v = bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for cp in [*range(0x300), *range(0x1680, 0x16FF), *range(0x2000, 0x2100), *range(0x3000, 0x3010), 0xFEFF, 0x1F600, 0x10FFFF]:
        t = f"a{chr(cp)}b {chr(cp)}{chr(cp)} 1{chr(cp)}!{chr(cp)}"
        assert "".join(pat.findall(t)) == t and ids_of(v, [t])[0] == enc.encode_ordinary(t), hex(cp)


def test_bpe_of_odd_documents(spark):
    encoded = bpe.encode(docs_frame(spark))
    back = bpe.decode(encoded).collect()
    assert len(back) == len(ODD) and encoded.columns == ["doc_id", "ids"]
    assert sorted((repr(r["doc_id"]), bytes(r["decoded"]).decode()) for r in back) == sorted((repr(i), t or "") for i, t in ODD)
    assert [r["ids"] for r in back if r["doc_id"] in (1, 2)] == [[], []]
    assert bpe.encode(docs_frame(spark).limit(0)).count() == 0
    ids = spark.createDataFrame([(1, None, "x"), (2, [], "y"), (3, [72, 73], "z")], "doc_id long, ids array<int>, decoded2 string")
    got = {r["doc_id"]: r for r in bpe.decode(ids).collect()}
    assert got[1]["decoded"] is None and bytes(got[2]["decoded"]) == b"" and got[3]["decoded2"] == "z"
    with pytest.raises(ValueError):
        bpe.decode(ids, out_col="decoded2")
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(ids.select(F.lit(1).alias("doc_id"), F.array(F.lit(99_999)).alias("ids"))).collect()


def test_queue_finds_the_lowest_rank():
    rnd, q, held = random.Random(1), bpe.RankQueue(60_000), defaultdict(list)
    for step in range(4_000):
        if rnd.random() < 0.6 or not held:
            r = rnd.choice([rnd.randrange(60_000), rnd.randrange(70)])
            q.push(r, [step])
            held[r].append(step)
        else:
            r = q.lowest()
            assert r == min(held) and q.take(r) == held.pop(r)
    while held:
        assert q.lowest() == min(held) and q.take(q.lowest()) == held.pop(min(held))
    assert q.lowest() == -1


# --- op13 -----------------------------------------------------------------------------------------


def divergence_by_definition(rows, min_docs, top):
    term = regex.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = {c: c + 32 for c in range(65, 91)}
    uses, held, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        words = [w.translate(lower) for w in term.findall(text or "")]
        uses[lang, source].update(words)
        held[lang].update(set(words))
        groups.add((lang, source))
    out = set()
    for lang, source in groups:
        kept = [t for t, n in held[lang].items() if n >= min_docs]
        sources = sorted(s for a, s in groups if a == lang)

        def shares(counts):
            total = sum(counts[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // total for t in kept}

        of = {s: shares(uses[lang, s]) for s in sources}
        q = shares(sum((uses[lang, s] for s in sources), Counter()))
        p = of[source]
        value = lambda a, b: (a - b) ** 2 // (a + b)
        pairs = sorted((-sum(value(p[t], of[s][t]) for t in kept), s.encode()) for s in sources if s != source)
        best = sorted((-value(p[t], q[t]), t.encode()) for t in kept if uses[lang, source][t] and p[t] > q[t])[:top]
        for part, found in (("pair", pairs), ("term", best)):
            out |= {(lang, source, part, item.decode(), -v, k) for k, (v, item) in enumerate(found, 1)}
    return out


def corpus(seed, n, sources, langs=("en", "", None, "de")):
    rnd = random.Random(seed)
    words = ["The", "the", "ÄB", "äb", "x1y", "日本", "é-e", "zz", "a", "b"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)]
    return [(rnd.choice(langs), rnd.choice([*(f"s{i}" for i in range(sources)), None]),
             rnd.choice([None, "", " ".join(rnd.choices(words, weights=[1 / (i + 1) for i in range(len(words))], k=rnd.randint(1, 40)))])) for _ in range(n)]


@pytest.mark.parametrize("tile, min_docs", [(256, 10), (2, 3), (3, 1), (1, 10_000)])
def test_divergence_equals_its_definition(spark, monkeypatch, tile, min_docs):
    rows = corpus(tile, 260, 5)
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "lang string, source string, text string, term string, n string").repartition(3)
    got = [tuple(r) for r in divergence.divergence(docs, min_docs=min_docs, top=4, tile=tile).collect()]
    want = divergence_by_definition(rows, min_docs, 4)
    assert len(got) == len(set(got)) == len(want) and set(got) == want


def test_divergence_of_odd_tables(spark):
    schema = "lang string, source string, text string"
    assert divergence.divergence(spark.createDataFrame([], schema)).count() == 0
    one = spark.createDataFrame([("en", "s", "a b")] * 12, schema)
    assert divergence.divergence(one).collect() == []  # one source: no pairs, no share above the language's
    long = [("en", "s", "word " * 50_000 + "x" * 100_000)] * 10 + [("en", "t", None), (None, None, "word")]
    got = {tuple(r) for r in divergence.divergence(spark.createDataFrame(long, schema)).collect()}
    assert got == divergence_by_definition(long, 10, 10)


def test_skyband_keeps_what_few_dominate(spark):
    rnd = random.Random(9)
    rows = [("en", rnd.choice("ab"), f"{i:05d}", rnd.randrange(1, 60), rnd.randrange(60, 90)) for i in range(1_500)]
    df = spark.createDataFrame(rows, "lang string, source string, term string, n long, lang_n long").coalesce(1).sortWithinPartitions("term")
    want = {r for r in rows if sum(o[1] == r[1] and o[3] >= r[3] and o[4] <= r[4] and o[2] < r[2] for o in rows) < 3}
    assert {tuple(r) for r in divergence.skyband(df, 3).collect()} == want


def test_op13_equals_sql(spark):
    against_sql(spark, "op13_source_divergence")
