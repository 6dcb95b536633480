"""The learned operators computed again in plain Python, and odd inputs of earlier operators."""

import math
import zlib
from collections import Counter, defaultdict
from itertools import product

import regex
from pyspark.sql import functions as F

from tidewatch.llm import chat, langid, lines, mixing, quality, queries, vectors
from tidewatch.sources.tables import table

SF = "/root/testdata/sf0.001"
SPACE = "[ \t\n\x0b\f\r]"


def statistics_by_hand(text):
    t = text or ""
    words = [w for w in regex.split(f"{SPACE}+", t) if w]
    rows = [x for x in t.split("\n") if x.strip(" ")]
    n, nw, nl = max(len(t), 1), max(len(words), 1), max(len(rows), 1)
    count = lambda p: len(regex.findall(p, t))
    return {
        "chars": math.log1p(len(t)), "words": math.log1p(len(words)), "word_len": sum(map(len, words)) / nw, "distinct_words": len(set(words)) / nw,
        "symbols": count("[^\\p{L}\\p{N}\\p{M} \t\n\x0b\f\r.,;:'!?()\"-]") / n, "upper": count("\\p{Lu}") / n, "digits": count("[0-9]") / n, "marks": count("[!?]") / n,
        "lines": math.log1p(len(rows)), "distinct_lines": len(set(rows)) / nl, "line_words": math.log1p(len(words) / nl),
        "long_words": count("[^ \t\n\x0b\f\r]{14,}") / nw,
        "letters": sum(1 <= len(w) <= 3 and all("a" <= c <= "z" or "ß" <= c <= "ÿ" for c in w) for w in words) / nw}


def test_op8_scores_follow_from_its_rules(spark):
    docs = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").select("doc_id", "text").collect()}
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    labels = table(spark, SF, "labels")
    learned = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    rules = quality.fit(quality.with_statistics(table(spark, SF, "documents")), learned)
    assert 0 < len(rules.weighted) < 200
    got = {r["doc_id"]: r for r in queries.QUERIES["op8_quality_rules"](spark, SF).collect()}
    assert set(got) == set(docs)
    for i, text in docs.items():
        stats = statistics_by_hand(text)
        total = rules.intercept
        for rule, weight in rules.weighted:
            if all(stats[s] <= v if op == "<=" else stats[s] > v for s, op, v in rule):
                total += weight
        score = 1 / (1 + math.exp(-total))
        assert abs(got[i]["score"] - score) < 1e-9, i
        assert got[i]["predicted"] == int(score >= 0.3) and got[i]["held_out"] == (fold(i) == 0)


def ngrams_by_hand(text):
    """Letter n-grams as buckets, with integers modulo 2**64."""
    mod, a = 1 << 64, 0x9E3779B97F4A7C15
    c = [ord(x) if x.isalpha() else 0 for x in f" {(text or '').lower()} "]
    c = [x for k, x in enumerate(c) if x or k == 0 or c[k - 1]]
    out = []
    for k, order in enumerate(langid.ORDERS):
        for i in range(len(c) - order + 1):
            if order == 1 and not c[i] or not any(c):
                continue
            h = c[i] * a % mod
            for j in range(1, order):
                h = ((h ^ h >> 29) * a + c[i + j]) % mod
            out.append(((h ^ h >> 31) * a % mod >> 64 - langid.BITS) + (k << langid.BITS))
    return out


def test_op10_counts_bits_and_decoding(spark):
    rows = table(spark, SF, "documents").select("doc_id", "text", "lang").collect()
    fold = lambda i: zlib.crc32(str(i).encode()) % 4
    counts = defaultdict(Counter)
    grams = {r["doc_id"]: ngrams_by_hand(r["text"]) for r in rows}
    for r in rows:
        if r["lang"] is not None and fold(r["doc_id"]) != 2:
            counts[r["lang"]].update(grams[r["doc_id"]])
    langs = sorted(counts)
    totals = {(x, k): sum(n for b, n in counts[x].items() if b >> langid.BITS == k) + 0.5 * (1 << langid.BITS) for x in langs for k in range(3)}
    share = lambda x, b: (counts[x][b] + 0.5) / totals[x, b >> langid.BITS]
    bits = [c for c in product((1, -1), repeat=len(langs)) if c[0] == 1 and -1 in c]
    known = {}

    def weight(bit, b):
        if (bit, b) not in known:
            pos, neg = ([share(x, b) for x, s in zip(langs, bit) if s == side] for side in (1, -1))
            known[bit, b] = math.log(sum(pos) / len(pos)) - math.log(sum(neg) / len(neg))
        return known[bit, b]

    got = {r["doc_id"]: r for r in queries.QUERIES["op10_ecoc_language"](spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        if len(grams[r["doc_id"]]) > 6_000:
            continue
        margins = [sum(weight(bit, b) for b in grams[r["doc_id"]]) for bit in bits]
        loss = [2 / len(bits) * sum(max(0, -bit[k] * m) + math.log1p(math.exp(-abs(m))) for bit, m in zip(bits, margins)) for k in range(len(langs))]
        p = [math.exp(min(loss) - x) for x in loss]
        best = max(range(len(langs)), key=lambda k: p[k])
        g = got[r["doc_id"]]
        assert g["held_out"] == (fold(r["doc_id"]) == 2)
        if not grams[r["doc_id"]]:
            assert (g["lang_pred"], g["score"]) == ("und", 0.0)
            continue
        assert abs(g["score"] - p[best] / sum(p)) < 1e-3
        if p[best] / sum(p) > 0.51:
            assert g["lang_pred"] == langs[best]


# --- odd inputs --------------------------------------------------------------------------------------


def test_mixture_of_ties_repeated_ids_and_long_texts(spark):
    rows = [(1, "s", "a b c"), (1, "s", "a b c"), (2, "s", "a b c"), (3, "t", "w " * 150_000), (None, "t", "x y"), (None, "t", "x y")] + [(10 + i, "u", "k l") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({c: F.lit("clash") for c in ("tokens", "epoch", "block", "weight")})
    for budget in (1.0, 2.5):
        got = mixing.mix(df, entropy=0.5, max_repeats=9.0, budget=budget, block_docs=4).collect()
        plan = {r["source"]: r["quota"] for r in mixing.source_budgets(df.select("source", mixing.word_count("text").alias("tokens")), 0.5, 9.0, budget).collect()}
        taken = Counter()
        for r in got:
            taken[r["source"]] += r["n_tokens"]
        assert plan["t"] <= taken["t"] < plan["t"] + 150_000 and plan["u"] <= taken["u"] < plan["u"] + 2 and plan["s"] <= taken["s"] < plan["s"] + 3
        assert mixing.mix(df, entropy=0.5, max_repeats=9.0, budget=budget, block_docs=4).count() == len(got)


def test_very_long_conversations(spark):
    turns = [(1, i, "user" if i % 2 == 0 else "assistant", f"say {i}") for i in range(3_000)] + [(2, 0, "assistant", "</s> long " * 60_000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.conversation_digests(chat.format_conversations(df)).collect()}
    assert got[1]["n_turns"] == 3_000 and got[1]["loss_chars"] == sum(len(t[3]) for t in turns[1:3_000:2]) and got[2]["loss_chars"] == 600_000


def test_vectors_with_clashing_columns(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (3, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in ("id", "u", "q", "m", "block", "links", "h1", "scale")})
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(df).collect()) == [
        (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (3, 0, 3, True)]


def test_site_lines_of_repeated_rows_and_long_texts(spark):
    rows = [(i, f"own {i}\nfooter", "s") for i in range(30)] + [(0, "own 0\nfooter", "s")] + [(99, "line " * 100_000 + "\nfooter\n" + "\n".join(map(str, range(20_000))), "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("line", F.lit("clash"))
    got = lines.drop_boilerplate(df).collect()
    assert len(got) == len(rows) and all("footer" not in r["text"] for r in got)
    assert {r["text"] for r in got if r["doc_id"] == 0} == {"own 0"} and [r["lines_dropped"] for r in got if r["doc_id"] == 99] == [1]
