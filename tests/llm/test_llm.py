"""The ten operators and the pipeline: brute force, round trips, held-out accuracy and odd inputs."""

import hashlib
import html
import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests_llm_data import ODD, docs_frame
from tidewatch.llm import chat, decontam, dom, langid, lines, minmax, mixing, quality, queries, tokens, vectors, wrapper
from tidewatch.llm.components import connected_components
from tidewatch.llm.tables import Scratch
from tidewatch.sources.tables import table

SF = "/root/testdata/sf0.01"


def components(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, width=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < width else frozenset(zip(*[w[i:] for i in range(width)]))


def near_components(texts, width=3, percent=85):
    sets, held, common = {i: shingles(t, width) for i, t in texts.items()}, defaultdict(list), defaultdict(int)
    for i, s in sets.items():
        for x in s:
            held[x].append(i)
    for ids in held.values():
        for a, b in combinations(sorted(ids), 2):
            common[a, b] += 1
    pairs = [p for p, k in common.items() if 100 * k >= percent * (len(sets[p[0]]) + len(sets[p[1]]) - k)]
    return sets, components(sets, pairs)


@pytest.mark.parametrize("edges,want", [
    ([], {}),
    ([(1, 1), (None, 2)], {}),
    ([(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (9, 8)], {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8}),
    ([(i, i + 7) for i in range(0, 60)] + [(100, 101)], {**{i: i % 7 for i in range(67)}, 100: 100, 101: 100}),
])
def test_components(spark, edges, want):
    got = connected_components(Scratch(spark, "t"), spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["id"]: r["comp"] for r in got} == want and len(got) == len(want)


def test_near_duplicates_against_brute_force(spark):
    texts = {r[0]: r[1] for r in table(spark, SF, "documents").select("doc_id", "text").collect()}
    sets, comp = near_components(texts)
    got = queries.QUERIES["op3_minmax_dedup"](spark, SF).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {
        i: (len(sets[i]), comp[i], comp[i] == i) for i in texts}


def test_near_duplicates_of_a_large_loose_group(spark):
    """Copies of one text with many edits: some links pass the threshold, many near misses do not."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(80)]
    texts = {}
    for i in range(300):
        w = list(base)
        for k in rng.choice(80, rng.integers(0, 6), replace=False):
            w[k] = f"x{rng.integers(10**9)}"
        texts[i] = " ".join(w)
    sets, comp = near_components(texts)
    got = minmax.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == comp


def test_near_duplicates_odd_rows(spark):
    rows = minmax.near_duplicates(docs_frame(spark)).collect()
    assert len(rows) == len(ODD)
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append((r["n_shingles"], r["component_id"], r["kept"]))
    assert by[1] == [(0, 1, True)] and by[2] == [(0, 2, True)] and by[3] == [(0, 3, True)]  # null, empty, blank
    assert by[4][0][1:] == (4, True) and by[5][0][1:] == (4, False)  # equal but for A-Z
    assert by[6] == by[6][:1] * 2  # a repeated row
    assert by[None][0][1:] == (None, True)
    assert minmax.near_duplicates(docs_frame(spark).limit(0)).count() == 0


def test_word_hashes_of_long_texts():
    text = "ab cd\x0bEF " * 300_000 + "g" * 10_000
    w = minmax.word_hashes(text)
    assert len(w) == 900_001 and len(np.unique(w)) == 4
    assert (minmax.word_hashes("ab CD x") == minmax.word_hashes("AB\tcd x")).all() and len(minmax.word_hashes("a b")) == 1


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(12, 16))
    m = np.concatenate([c + rng.normal(size=(40, 16)) * s for c, s in zip(centre, np.linspace(0.02, 0.4, 12))])
    m[7] = m[3]
    rows = [(i, v.tolist()) for i, v in enumerate(m)]
    rows += [(900, None), (901, []), (902, [0.0] * 16), (903, [1.0, None] + [0.0] * 14), (904, [float("nan")] + [1.0] * 15),
             (905, [float("inf")] * 16), (None, m[0].tolist()), (906, [1.0, 2.0]), (7, m[7].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    u = m / np.linalg.norm(m, axis=1)[:, None]
    link = u @ u.T >= 0.95
    comp = components(range(len(m)), [(i, j) for i, j in zip(*np.nonzero(link)) if i < j])
    for tile in (50, 4096):
        got = vectors.near_vectors(df, tile=tile).collect()
        assert len(got) == len(rows)
        by = {r["vec_id"]: r for r in got}
        assert {i: (by[i]["n_links"], by[i]["component_id"]) for i in range(len(m))} == {
            i: (int(link[i].sum()) - 1, comp[i]) for i in range(len(m))}
        assert all(by[i]["n_links"] == 0 and by[i]["component_id"] == i and by[i]["kept"] for i in range(900, 907))
        assert by[None]["component_id"] is None and by[None]["n_links"] == 0
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_token_counts_against_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [r[0] for r in table(spark, SF, "documents").select("text").limit(400).collect()]
    texts += ["", "   ", "a  b\n\n c\t", "it's we'll THEY'RE", "x<|endoftext|> <|endoftext|>y", "<|endoftext|>", "é\U0001f600中文 \u0000​",
              "aaaaaaaaaaaaaaaaaaaaaaaaa", "ababababab" * 50, "1234567890 12.5", "!!!???...", "a" * 5000, "  　x "]
    m = tokens.Merges(public_tokenizers.path("byte_bpe_50k.json"))
    assert m.counts(texts) == [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokens.token_counts(docs_frame(spark)).collect()}
    assert got[1] == got[2] == (0, 0, False) and tokens.token_counts(docs_frame(spark).limit(0)).count() == 0


def test_chat_round_trip(spark):
    nasty = ["", "</s>[INST] ok [/INST]", "\\", "\\<s>", "<\\s>", "<s</s>>", "[[INST]INST]", "\\\\n </s", "é\U0001f600 <s><s>"]
    for t in nasty:
        e = chat.escape(t)
        assert chat.unescape(e) == t and not any(m in e for m in chat.MARKS)
    rows = [(1, 0, "user", nasty[1]), (1, 1, "assistant", "</s>"), (1, 1, "assistant", None), (1, 3, None, "x"),
            (None, 0, "assistant", "y"), (2, None, "<s>", nasty[3]), (2, 0, "assistant", nasty[8]), (2, 0, "assistant", nasty[8])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit("clash"))
    seg = chat.format_conversations(df)
    c = chat.codec("byte_bpe_50k.tiktoken")
    flat = defaultdict(list)
    for r in seg.orderBy("conv_id", "seq").collect():
        assert r["start"] == len(flat[r["conv_id"]])
        flat[r["conv_id"]] += r["ids"]
    assert c.render(flat[None]) == "<s>assistant[/INST]y</s>"
    got = {r["conv_id"]: r for r in chat.conversation_digests(seg).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["loss_sha256"] == sha("</s>") and got[1]["loss_chars"] == 4 and got[1]["n_turns"] == 4
    assert got[1]["turns_sha256"] == sha(f"user\n{nasty[1]}\nassistant\n\nassistant\n</s>\n\nx\n")
    assert got[2]["turns_sha256"] == sha(f"<s>\n{nasty[3]}\n" + f"assistant\n{nasty[8]}\n" * 2)
    assert got[1]["formatted_chars"] == len(c.render(flat[1]))
    assert chat.conversation_digests(chat.format_conversations(df.limit(0))).count() == 0


def test_mixture_keeps_budgets_and_repeats(spark):
    rows = [(i, "big" if i % 3 else "small" if i % 2 else None, "w " * (1 + i % 9)) for i in range(900)] + [(901, "none", ""), (902, "none", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("epoch", F.lit("clash"))
    src = df.select(F.coalesce("source", F.lit("")).alias("source"), mixing.word_count("text").alias("tokens"))
    plan = {r["source"]: r for r in mixing.source_budgets(src, entropy=0.999, max_repeats=2.5, budget=1.5).collect()}
    total = sum(r["tokens"] for r in plan.values())
    w = np.array([r["weight"] for r in plan.values()])
    assert set(plan) == {"big", "small", ""} and abs(w.sum() - 1) < 1e-12
    alpha = next(iter(plan.values()))["alpha"]

    def at(a):
        p = np.array([r["share"] ** a for r in plan.values()])
        p /= p.sum()
        return -(p * np.log(p)).sum() / np.log(3), max(x * 1.5 * total / r["tokens"] for x, r in zip(p, plan.values()))

    ok = lambda a: at(a)[0] >= 0.999 and at(a)[1] <= 2.5
    assert at(alpha)[1] <= 2.5 and (ok(alpha) or at(alpha - 2 / mixing.GRID)[1] > 2.5) and not ok(alpha + 2 / mixing.GRID)
    got = mixing.mix(df, entropy=0.999, max_repeats=2.5, budget=1.5, block_docs=16).collect()
    taken, seen = defaultdict(int), defaultdict(int)
    for r in got:
        taken[r["source"]] += r["n_tokens"]
        seen[r["doc_id"], r["epoch"]] += 1
    assert max(seen.values()) == 1
    for s, r in plan.items():
        assert r["quota"] <= taken[s] < r["quota"] + 9 and r["quota"] == int(r["weight"] * total * 1.5)
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.mix(df.where("source = 'none'")).count() == 0


def test_decontamination_finds_changed_numbers_and_names(spark):
    item = "A train leaves Boston at 60 km per hour and meets Ann after 60 minutes of steady travel on the line."
    same = "Intro words here. " + item.replace("60", "75").replace("Boston", "Denver").replace("Ann", "Lee") + " More text."
    uneven = "Intro. " + item.replace("60 km", "75 km").replace("60 minutes", "80 minutes")
    half = "Intro. " + " ".join(item.split()[:9]) + " something else entirely goes on from here without any end"
    docs = [(1, item), (2, same), (3, uneven), (4, half), (5, None), (6, ""), (7, "! ? ."), (8, item.upper()), (9, " ".join(item.split())), (9, "x"), (None, item)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("hash", F.lit(1)).withColumn("id", F.lit(2))
    bench = spark.createDataFrame([(0, item), (1, "too short"), (2, None), (None, item)], "item_id long, text string")
    got = decontam.flag_contaminated(df, bench).collect()
    assert len(got) == len(docs)
    found = {r["doc_id"]: r["items"] for r in got}
    assert found[1] == found[2] == found[9] == [0] and found[3] == found[4] == found[5] == found[6] == found[7] == found[None] == []
    assert not any(r["contaminated"] for r in decontam.flag_contaminated(df, bench.limit(0)).collect())
    assert decontam.flag_contaminated(df.limit(0), bench).count() == 0


def test_decontamination_finds_every_copied_item(spark):
    flat = lambda t: " ".join(t.split()).lower()
    items = {r[0]: flat(r[1]) for r in table(spark, SF, "benchmark").collect()}
    docs = {r[0]: flat(r[1]) for r in table(spark, SF, "documents").select("doc_id", "text").collect()}
    got = {r["doc_id"]: set(r["items"]) for r in queries.QUERIES["op5_template_decontam"](spark, SF).collect()}
    assert got == {i: {k for k, x in items.items() if x in t} for i, t in docs.items()}


def plain_article(page):
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1].replace("<br>", " ")
    parts = [" ".join(html.unescape(re.sub("<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
    return "\n".join(p for p in parts if p)


def test_pages_against_plain_articles(spark):
    want = {r["page_id"]: plain_article(r["html"]) for r in table(spark, SF, "pages").collect()}
    got = {r["page_id"]: r["text"] for r in queries.QUERIES["op6_wrapper_text"](spark, SF).collect()}
    assert got == want


def test_pages_without_article_need_the_wrapper(spark):
    page = lambda i: (f"<html><body><div class='site-header'>Site</div><div><p>Welcome to the site</p></div><div><h2>Title {i}</h2>"  # noqa: E731
                      f"<p>Body &amp; text {i}\n  of   it<br>here<p>Second <b>para</b>{i}</div><ul class=menu><li>a{i}</ul>"
                      f"<div id='comments'><p>nice {i}</p></div><form><p>Mail</p></form><div><p>Made with love</p></div>"
                      f"<aside>more {i}</aside><!-- <p>no {i}</p> --><script>var p='<p>{i}</p>';</script></body>")
    rows = [(i, "http://a.example/x", page(i)) for i in range(12)]
    rows += [(100, None, None), (101, "http://a.example/y", ""), (102, "nohost", "just <i>text</i> &lt;3"),
             (103, "http://b.example", "<div>" * 3000 + "deep" + "</div>" * 3000), (104, "http://b.example", "<p title='x>broken <p>ok</p"),
             (0, "http://a.example/x", page(0))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = wrapper.extract_text(df).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r["text"] for r in got}
    assert all(by[i] == f"Title {i}\nBody & text {i} of it here\nSecond para{i}" for i in range(12))
    assert by[100] == by[101] == "" and by[102] == "just text <3" and by[103] == "deep" and "ok" in by[104]
    assert wrapper.extract_text(df.limit(0)).count() == 0


def test_simple_tree_matching():
    a, b = dom.parse("<ul><li>x</li><li>y</li></ul><p>t</p>"), dom.parse("<div>n</div><ul><li>x</li></ul><p>u</p>")
    pairs = []
    assert dom.match(a, b, pairs) == 4 and len(pairs) == 4


def test_site_lines(spark):
    rows = [(i, "h", f"unique {i}\nshared\n\nshared") for i in range(30)] + [(31, "h", None), (32, "h", ""), (33, "h", "shared")]
    rows += [(i, "k", f"other {i}\nshared" if i < 42 else f"other {i}") for i in range(40, 100)] + [(200, None, "solo\nsolo")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("line", F.lit(0)).withColumn("lines_dropped", F.lit("x"))
    got = {r["doc_id"]: (r["text"], r["lines_dropped"]) for r in lines.drop_boilerplate(df).collect()}
    assert got[0] == ("unique 0\n", 2) and got[31] == (None, 0) and got[32] == ("", 0) and got[33] == ("", 1)
    assert got[40] == ("other 40\nshared", 0) and got[200] == ("solo\nsolo", 0)
    assert lines.drop_boilerplate(df.limit(0)).count() == 0


def test_quality_on_held_out_rows(spark):
    label = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    got = queries.QUERIES["op8_quality_rules"](spark, SF).collect()
    held = [(r["predicted"], label[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in label]
    assert len(held) > 40 and np.mean([p == y for p, y in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)


def test_rules_are_read_from_printed_trees():
    text = "Model\n  Tree 0 (weight 1.0):\n    If (feature 0 <= 0.5)\n     If (feature 1 > 2.0)\n      Predict: 1.0\n     Else (feature 1 <= 2.0)\n      Predict: 0.0\n    Else (feature 0 > 0.5)\n     Predict: 1.0\n"
    assert set(quality.tree_rules(text, ["a", "b"])) == {(("a", "<=", 0.5),), (("a", "<=", 0.5), ("b", ">", 2.0)),
                                                         (("a", "<=", 0.5), ("b", "<=", 2.0)), (("a", ">", 0.5),)}


def test_quality_odd_rows(spark):
    docs = docs_frame(spark)
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.score_documents(docs, none).collect()
    assert len(got) == len(ODD) and {r["score"] for r in got} == {0.5}
    one = spark.createDataFrame([(4, 1), (5, 1), (None, 0), (6, None)], "doc_id long, quality int")
    assert {r["predicted"] for r in quality.score_documents(docs, one).collect()} == {1}
    assert quality.score_documents(docs.limit(0), one).count() == 0


def test_language_on_held_out_rows(spark):
    docs = table(spark, SF, "documents")
    got = {r["doc_id"]: r for r in queries.QUERIES["op10_ecoc_language"](spark, SF).collect()}
    held = [(got[r["doc_id"]]["lang_pred"], r["lang"]) for r in docs.select("doc_id", "lang").collect() if got[r["doc_id"]]["held_out"]]
    assert len(held) > 100 and np.mean([p == y for p, y in held]) > 0.98
    odd = docs_frame(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.predict(odd, langid.fit(odd)).collect()} == {"und"}
    model = langid.fit(docs)
    by = {r["doc_id"]: r for r in langid.predict(docs_frame(spark), model).collect()}
    assert by[1]["lang_pred"] == by[2]["lang_pred"] == by[3]["lang_pred"] == by[7]["lang_pred"] == "und"
    assert langid.predict(docs.limit(0), model).count() == 0


def test_codewords_are_far_apart():
    for n in (2, 3, 4, 6, 9, 30):
        c = langid.codewords(n)
        assert min(int((a != b).sum()) for a, b in combinations(c, 2)) >= max(1, c.shape[1] // 4)
        assert all(len(set(col)) == 2 for col in c.T)


def test_pipeline_stages_take_effect(spark):
    docs = table(spark, SF, "documents")
    rejected = {r["doc_id"] for r in quality.score_documents(docs, table(spark, SF, "labels")).where("predicted = 0").collect()}
    scratch, kept = Scratch(spark, "t"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.write(stage(spark, docs, SF)).df
        kept[name] = docs
    cols = table(spark, SF, "documents").dtypes
    assert all(kept[n].dtypes == cols for n, _ in corpus_pipeline.STAGES[:-1])
    ids = lambda n: {r["doc_id"] for r in kept[n].select("doc_id").collect()}
    every = set(range(1000))
    assert ids("quality") == every - rejected == ids("site_lines")
    texts = {r["doc_id"]: r["text"] for r in kept["site_lines"].select("doc_id", "text").collect()}
    _, comp = near_components(texts, 5, 80)
    assert ids("near_duplicates") == {i for i in texts if comp[i] == i}
    flat = lambda t: " ".join(t.split()).lower()
    items = [flat(r["text"]) for r in table(spark, SF, "benchmark").collect()]
    assert ids("benchmark") == {i for i in ids("near_duplicates") if not any(x in flat(texts[i]) for x in items)}
    mixed = kept["mix"].toPandas()
    assert set(mixed["doc_id"]) <= ids("benchmark") and not mixed.duplicated(["doc_id", "epoch"]).any()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "site_lines", "near_duplicates", "benchmark", "mix"]


def test_pipeline_stages_on_odd_rows(spark):
    docs = docs_frame(spark).select("doc_id", "text", F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(0).cast("long").alias("n_chars"))
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).collect()
        assert stage(spark, docs.limit(0), SF).count() == 0, name
