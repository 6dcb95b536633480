"""Cases of the third review of the earlier operators: each failed before its repair."""

import math
import random
import time

import numpy as np
import pandas as pd

from tidewatch.llm import decontam, dom, vectors, wrapper


def found(spark, bench, docs):
    b = spark.createDataFrame(list(enumerate(bench)), "item_id long, text string")
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r["doc_id"]: r["items"] for r in decontam.flag_contaminated(d, b).collect()}
    return [got[i] for i in range(len(docs))]


def test_runs_of_placeholders_are_no_template(spark):
    numbers, sums = "3 5 7 9 11 13 17 19", "Compute 12 + 7 * 3 - 4 / 2 + 8 * 5 - 6"
    names, other = "Who Was Elected President After Abraham Lincoln Died", "Guests: John Smith Mary Jones Ann Lee Paul Young"
    docs = ["Scores of the day: 10 22 31 45 52 60 71 83 94 12 33", "Call 555 0100 or 555 0101 or 555 0102 555 0103 555 0104 555 0105 555 0106 555 0107 555", other,
            "List 3 5 7 9 11 13 17 19 end", "He asked: compute 12 + 7 * 3 - 4 / 2 + 8 * 5 - 6.", "So who was elected president after Abraham Lincoln died?"]
    assert found(spark, [numbers, sums, names], docs) == [[], [], [], [0], [1], [2]]


def test_slots_agree_over_all_alignments(spark):
    item = "A train leaves Boston at 60 km per hour and meets Ann after 60 minutes of steady travel on the line."
    uneven = item.replace("60 km per", "75 km each and per").replace("60 minutes", "80 minutes")
    even = uneven.replace("80 minutes", "75 minutes")
    apart = item.replace("60 km", "75 km").replace("and meets", "and then, in the early evening light of that day, meets").replace("60 minutes", "80 minutes")
    again = " ".join([item.replace("60", "75").replace("Ann", "Lee"), "Later.", item.replace("60", "90").replace("Ann", "Tom")])
    long = " ".join(["We know that on most days of the year", item, "Find how far the train has gone by then and give the answer in full."])
    one_word = long.replace("60 km", "75 km").replace("and meets", "and now meets").replace("60 minutes", "{} minutes")
    docs = [uneven, apart, again, one_word.format(80), one_word.format(75), long.replace("60", "33"),
            long.replace("60 km", "75 km").replace("60 minutes", "80 minutes")]
    got = found(spark, [item, long], docs)
    assert got == [[], [], [0], [], [1], [0, 1], []]
    assert found(spark, [even], [even.replace("75", "41")]) == [[0]]


def test_very_long_texts_and_items(spark):
    item = "The old mill by the river grinds 40 sacks of wheat a day for the bakers of the town."
    long = "filler words and more of them " * 20_000 + item.replace("40", "55") + " tail words" * 20_000
    assert found(spark, [item, " ".join(f"w{i}" for i in range(3_000))], [long, None, " ".join(f"w{i}" for i in range(3_000))]) == [[0], [], [1]]


def texts_of(spark, pages, copies=()):
    rows = [(i, "http://a.example/x", p) for i, p in enumerate(pages)] + [(i, "http://a.example/x", pages[i]) for i in copies]
    got = wrapper.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    by = {(r["page_id"], r["text"]) for r in got}
    assert len(by) == len(pages)
    return [t for _, t in sorted(by)]


def test_repeated_rows_change_no_text(spark):
    pages = [f"<body><div>Site</div><article><h1>Title {i}</h1><p>Text {i} of this page</p></article></body>" for i in range(4)]
    want = [f"Title {i}\nText {i} of this page" for i in range(4)]
    assert texts_of(spark, pages) == want
    for i in range(4):  # one of them is the reference
        assert texts_of(spark, pages, [i] * 7) == want


def test_shared_headings_inside_an_article_stay(spark):
    page = lambda i: (f"<body><article><h2>Summary</h2><p>Short {i}</p><h2>Details</h2><p>Long {i}</p><p>See also the glossary.</p>"  # noqa: E731
                      f"<div class='advert'><p>Buy our book</p></div><p><a href=x>All offers</a></p><div>Rate <select></select></div>"
                      f"<h3>References</h3><ul><li>Ref {i}</li></ul><p>All rights are ours</p></article></body>")
    assert texts_of(spark, [page(i) for i in range(9)]) == [
        f"Summary\nShort {i}\nDetails\nLong {i}\nSee also the glossary.\nReferences\nRef {i}" for i in range(9)]


def test_large_and_broken_pages_take_seconds(spark):
    began = time.process_time()
    for text in ("<a " * 350_000, "<script>" + "</script " * 100_000, "<p>x" + "<b '" * 200_000, "<!" * 400_000):
        dom.parse(text)
    assert dom.blocks(dom.parse("<p>one</p><a <a <!-- gone <b")) == ["one", "<a <a"]
    one, other = ("<body>" + "".join(f"<p>{w} {i} <b>bold {w} {i}</b> and <a href=x>more</a></p>" for i in range(5_000)) + "</body>" for w in "ab")
    pairs = []
    assert dom.match(dom.parse(one), dom.parse(other), pairs) == 15_002 and len(pairs) == 15_002
    shifted = "<body>" + "".join(f"<p>a {i} <b>bold a {i}</b> and <a href=x>more</a></p>" for i in (*range(4), 9_999, *range(4, 4_990))) + "</body>"
    pairs = []
    dom.match(dom.parse(one), dom.parse(shifted), pairs)
    assert sum(x.tag == "p" and x.whole == y.whole for x, y in pairs) == 4_990
    assert time.process_time() - began < 60


def test_long_lists_have_the_weights_of_short_ones(monkeypatch):
    rnd = random.Random(4)

    def tree(depth):
        kids = "".join(tree(depth - 1) for _ in range(rnd.randint(0, 6))) if depth else ""
        tag = rnd.choice(["div", "span", "section"])
        name = rnd.choice(["", " class=k"])
        return f"<{tag}{name}>{rnd.choice(['', 'x', 'y', str(rnd.random())])}{kids}</{tag}>"

    for _ in range(150):
        a, b = (dom.parse("<main>" + "".join(tree(2) for _ in range(rnd.randint(1, 9))) + "</main>") for _ in range(2))
        ka, kb = a.kids[0].kids, b.kids[0].kids
        weights = []
        for limit in (10**9, 0):
            monkeypatch.setattr(dom, "PAIRS", limit)
            memo = {}
            pairs = dom._aligned(ka, kb, memo)
            assert len({id(x) for x, _ in pairs}) == len(pairs)
            weights.append((dom._score(a.kids[0], b.kids[0], {}), sum(dom._score(x, y, {}) for x, y in pairs)))
        assert weights[0] == weights[1]


def test_pairs_next_to_the_threshold_are_decided_exactly(spark):
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for g in range(40):  # pairs whose cosine is the threshold up to 1e-9: no code decides them
        x, y = rng.normal(size=(2, 48))
        x, y = x / np.linalg.norm(x), y - (y @ x) / (x @ x) * x
        y /= np.linalg.norm(y)
        cos = 0.95 + (g % 5 - 2) * 1e-9
        z = cos * x + math.sqrt(1 - cos * cos) * y
        rows += [(2 * g, x.tolist(), "clash"), (2 * g + 1, z.tolist(), "clash"), (2 * g + 1, z.tolist(), "clash")]
        want[2 * g] = int((x / np.linalg.norm(x)) @ (z / np.linalg.norm(z)) >= 0.95) if g % 5 != 2 else None
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, u string")
    a, b = (vectors._stack(pd.DataFrame(next(vectors._prepare(iter([pd.DataFrame({"id": [r[0] for r in part], "v": [r[1] for r in part]})])))).assign(m=1))
            for part in (rows[::3], rows[1::3]))
    assert len(vectors.tile_links(a, b, False, 0.95)[3]) >= 30  # they reach the last step
    got = vectors.near_vectors(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if want[r["vec_id"] // 2 * 2] is not None:
            assert (r["n_links"], r["component_id"]) == ((1, r["vec_id"] // 2 * 2) if want[r["vec_id"] // 2 * 2] else (0, r["vec_id"]))
