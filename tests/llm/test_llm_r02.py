"""Cases of the second review: each failed before its repair."""

import corpus_pipeline
from tidewatch.llm import decontam, dom, lines, minmax, wrapper


def aligned_texts(a, b):
    pairs = []
    dom.match(dom.parse(a), dom.parse(b), pairs)
    return {(x.text, y.text) for x, y in pairs if x.text or y.text}


def test_children_of_equal_tags_are_aligned():
    ref = "<body><div>top</div><div><h2>one</h2><p>a<p>b</div><div>bottom</div></body>"
    page = "<body><div>notice</div><div>top</div><div><h2>two</h2><p>c<p>d</div><div>bottom</div></body>"
    got = aligned_texts(ref, page)
    assert {("top", "top"), ("one", "two"), ("a", "c"), ("b", "d"), ("bottom", "bottom")} == got
    got = aligned_texts("<div><p>a<p>b<p>always</div>", "<div><p>c<p>d<p>e<p>f<p>always</div>")
    assert ("always", "always") in got
    many = "".join(f"<p>r{i}" for i in range(300))
    other = "".join(f"<p>s{i}" for i in range(200)) + "".join(f"<p>r{i}" for i in range(0, 300, 2))
    assert {(f"r{i}", f"r{i}") for i in range(0, 300, 2)} <= aligned_texts(f"<div>{many}</div>", f"<div>{other}</div>")


def test_kept_rows_do_not_change_the_alignment(monkeypatch):
    a = "".join(f"<p>{i % 7}<b>{i % 5}</b>" for i in range(90))
    b = "".join(f"<p>{i % 11}<b>{i % 3}</b>" for i in range(120))
    want = aligned_texts(f"<div>{a}</div>", f"<div>{b}</div>")
    monkeypatch.setattr(dom, "MEMO", 10)
    monkeypatch.setattr(dom.math, "isqrt", lambda n: n)
    assert aligned_texts(f"<div>{a}</div>", f"<div>{b}</div>") == want


def texts_of(spark, pages):
    rows = [(i, "http://a.example/x", p) for i, p in enumerate(pages)]
    got = wrapper.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [r["text"] for r in sorted(got, key=lambda r: r["page_id"])]


def test_votes_decide_on_pages_with_article(spark):
    page = lambda i: (f"<body><div>Site</div><article><h1>Title {i}</h1><p>Text {i}</p><p>Buy <a href=x>our book</a> now</p>"  # noqa: E731
                      f"<p><b>Note:</b> more {i}</p></article><article><p>Part two of {i}</p></article><div>Made with love</div></body>")
    for n in (12, 4):  # hosts with few pages have a template too
        assert texts_of(spark, [page(i) for i in range(n)]) == [
            f"Title {i}\nText {i}\nNote: more {i}\nPart two of {i}" for i in range(n)]


def test_article_without_slots_is_no_content_root(spark):
    page = lambda i: (f"<body><article><p>Join the club of friends of this site</p></article>"  # noqa: E731
                      f"<div><h2>Title {i}</h2><p>Real text of page {i}</p></div></body>")
    assert texts_of(spark, [page(i) for i in range(10)]) == [f"Title {i}\nReal text of page {i}" for i in range(10)]


def test_page_of_template_blocks_only_keeps_them(spark):
    assert texts_of(spark, ["<body><article><p>One text for all pages</p></article>" + " " * i for i in range(9)]) == ["One text for all pages"] * 9


def test_named_parts_of_an_article_need_evidence(spark):
    article = ("<section id='side-effects'><h2 id='search-and-replace'>Head</h2><p>Effects</p></section><section id='discussion'>"
               "<p>Findings</p></section><p class='foot-note form-of-government'>Note</p><div class='notice'><p>Safety first</p></div><p>End</p>"
               "<div class='share'><a href=x>Mail</a> <a href=y>Post</a></div><div class='newsletter'><p>Join</p><input></div>"
               "<ol class='comments'><li>nice</li></ol>")
    want = "Head\nEffects\nFindings\nNote\nSafety first\nEnd"
    assert texts_of(spark, [f"<body><div class='menu'>Menu</div><article>{article}</article></body>"]) == [want]
    page = lambda i: f"<body><article><p>Text {i}</p><div class='notice'><p>Tell us</p></div><p>End {i}</p></article></body>"
    assert texts_of(spark, [page(i) for i in range(9)]) == [f"Text {i}\nEnd {i}" for i in range(9)]


def test_copies_in_other_case_and_short_items(spark):
    item = "A train leaves Boston at 60 km per hour and meets Ann after 60 minutes of steady travel on the line."
    ask, german, ann = "What is the capital of France?", "Der Hund und die Katze sehen im Garten einen Vogel.", "Ann has 5 red apples left"
    bench = [(0, item), (1, ask), (2, german), (3, ann), (4, "Name the largest moon"), (5, "42"), (6, "12 km")]
    docs = [(8, item.upper(), [0]), (9, item.lower(), [0]), (10, "Question: " + ask, [1]), (11, "So, what is the capital of Spain?", [1]),
            (12, german.lower(), [2]), (13, "x y. Lee has 7 red apples left", [3]), (14, "Please name the LARGEST moon!", [4]),
            (15, "We saw 43 of them in 13 km", []), (16, "The number 42.", [5]),
            (17, "Intro. " + item.replace("60 km", "75 km").replace("60 minutes", "80 minutes"), [])]
    df = spark.createDataFrame([r[:2] for r in docs], "doc_id long, text string")
    got = decontam.flag_contaminated(df, spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert {r["doc_id"]: r["items"] for r in got} == {i: want for i, _, want in docs}


def test_rows_of_one_document_do_not_mix_their_values(spark):
    item = "A train leaves Boston at 60 km per hour and meets Ann after 60 minutes of steady travel on the line."
    df = spark.createDataFrame([(1, item.replace("60", "75")), (1, "one two three 4 five six 7 eight nine ten " * 5)], "doc_id long, text string")
    got = decontam.flag_contaminated(df, spark.createDataFrame([(0, item)], "item_id long, text string")).collect()
    assert [r["items"] for r in got] == [[0], [0]]


def test_copies_do_not_become_site_lines(spark):
    rows = [(i, f"Own line of {i}\nSecond line {i}\nfooter", "en", "s", 0) for i in range(40)]
    rows += [(100 + i, "Copied first line\nCopied second line", "en", "s", 0) for i in range(10)]
    rows += [(200, "footer", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_site_lines(spark, docs, "")
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert all(got[i] == f"Own line of {i}\nSecond line {i}" for i in range(40))
    assert all(got[100 + i] == "Copied first line\nCopied second line" for i in range(10)) and got[200] == "footer"
    kept = {r["doc_id"] for r in corpus_pipeline.keep_one_of_each_group(spark, out, "").collect()}
    assert kept & set(range(100, 110)) == {100}
    few = lines.drop_boilerplate(docs.where("doc_id >= 100"), ratio=0.9, count_copies=False)
    assert few.where("lines_dropped > 0").count() == 0


def test_near_duplicates_at_five_words_against_brute_force(spark):
    """Block edits and scattered edits around five-word similarities of 0.75 to 0.9."""
    texts, n = {}, 0
    for g in range(60):
        base = [f"g{g}w{i}" for i in range(124)]
        cut, edits = 12 + g % 18, 2 + g % 4
        for words in (base, base[:60] + [f"new{g}x{i}" for i in range(cut)] + base[60:],
                      [f"e{g}x{i}" if i % (124 // edits) == 30 else w for i, w in enumerate(base)]):
            texts[n], n = " ".join(words), n + 1
    sets = {i: {tuple(w[k:k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in texts.items())}
    first = {i: next(j for j in range(i // 3 * 3, i + 1) if j == i or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])) for i in texts}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = {r["doc_id"] for r in minmax.near_duplicates(docs, width=5, percent=80).where("kept").collect()}
    assert 0 < sum(first[i] != i for i in texts) < 120
    assert kept == {i for i in texts if first[i] == i}


def test_bands_follow_the_threshold():
    assert minmax.layout(85) == (6, 37) and minmax.layout(80)[0] == 5 and minmax.layout(95)[0] > 6
    assert 37 < minmax.layout(80)[1] <= 46
