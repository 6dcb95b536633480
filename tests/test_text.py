"""Text functions: hand-derived pairs and properties over whole documents."""

from pyspark.sql import functions as F

from tidewatch.functions import text as TX


# input and hand-derived output, one or more pairs per rule
PAIRS = [
    ("salt &amp; sand", "salt and sand"),
    ("salt &amp sand", "salt and sand"),
    ("ask @dune_7 now", "ask _USER_ now"),
    ("from 9:15 a.m. on", "from _TIME_. on"),  # no word boundary after the last dot: it stays
    ("from 9:15PM on", "from _TIME_ on"),
    ("by 7 pm sharp", "by _TIME_ sharp"),
    ("at 06:07:08 it rang", "at _TIME_ it rang"),
    ("at 23:59 it rang", "at _TIME_ it rang"),
    ("map: HTTPS://m.example/a?b=c end", "map: _URL_ end"),
    ("cut off https", "cut off _URL_"),
    ("https stays inside", "https stays inside"),
    ("wet \u2014 *very* wet; 40% more \U0001F30A", "wet very wet 40 more"),
    ("K\u00f6ln d\u2019eau, ok? #yes! (a/b)", "K\u00f6ln d\u2019eau, ok? #yes! (a/b)"),
    ("one\ntwo\t\tthree", "one two three"),
    ("  edges  ", "edges"),
    ("", ""),
]


def test_normalize_pairs(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(PAIRS)], "i int, t string")
    got = {r["i"]: r["n"] for r in df.select("i", TX.normalize_aggressive("t").alias("n")).collect()}
    assert got == {i: b for i, (_, b) in enumerate(PAIRS)}


def test_normalize_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    n = TX.normalize_aggressive("text")
    bad = docs.select(n.alias("n")).filter(F.col("n").rlike(r"\n|\s\s|^\s|\s$|https?:|[;%*&]|@[A-Za-z0-9]"))
    assert bad.count() == 0


def test_hashtags_and_clean(spark):
    df = spark.createDataFrame([("#Flood! hits #Texas, see #a-b- and #" + "x" * 300 + " @Bob @bobby http://u.rl/x",)], "t string")
    r = df.select(TX.hashtags("t").alias("h"), TX.clean_post("t").alias("c")).first()
    assert r["h"] == ["Flood", "Texas", "a-b"]
    # the URL and both names found in the original are removed by plain replace, then trimmed
    assert r["c"] == "#Flood! hits #Texas, see #a-b- and #" + "x" * 300


def test_tokenize(spark):
    df = spark.createDataFrame([("RT @x: The flood is in the city, it's a flood! http://t.co/a", "en"),
                                ("Le flot et la ville", "fr")], "t string, lang string")
    got = [sorted(r["k"]) for r in df.select(TX.tokenize(F.col("t"), F.col("lang")).alias("k")).collect()]
    assert got[0] == ["citi", "flood"]  # "it's" is "it", a stop word
    assert got[1] == ["flot", "vile"]


# Published examples of the English algorithm and hand-derived words of the light rules.
STEMS = {
    "en": "caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing "
          "conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file "
          "happy happi sky sky relational relat conditional condit rational ration valenci valenc digitizer digit conformabli conform "
          "radicalli radic vietnamization vietnam predication predic feudalism feudal decisiveness decis hopefulness hope formaliti formal "
          "sensibiliti sensibl triplicate triplic formative form electrical electr goodness good revival reviv allowance allow inference infer "
          "gyroscopic gyroscop defensible defens replacement replac adjustment adjust adoption adopt communism commun angulariti angular "
          "bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll by None river's river floods flood",
    "es": "casas cas libros libr ciudades ciudad franceses frances luces luz veces vez inundación inundacion árboles arbol gatos gat lluvias lluvi feliz feliz sol sol",
    "fr": "journaux journal chevaux cheval gouvernement gouvern rapidement rapid activement actif agrandissement agrandi finissant fini "
          "modificatrice modifi communicateur comuniqu quatrième quat chanteuse chant chanteur chant heureuse heureu première premier "
          "traditionnelle tradition complète complet politique polit tristesse trist centralisation central information inform villes vile folle fou "
          "l'inondation inond jusqu’aux None maison maison",
    "it": "ragazzi ragazz ragazze ragazz amiche amic giochi gioc pioggia piogg pioggie piogg alluvione alluvion acqua acqua studio stud dell'acqua acqua città città",
}


def test_stems_and_stop_words():
    from tidewatch.functions import stemming as S

    for lang, words in STEMS.items():
        words = words.split()
        assert {w: S.analyze(w, lang) for w in words[::2]} == {w: None if t == "None" else t for w, t in zip(words[::2], words[1::2])}
    stops = {"en": "the with such", "es": "estuviéramos tendrán hubiese fueras habíamos estado tuvisteis nuestras", "fr": "eussions étaient leurs c",
             "it": "avremmo fossero faceste stando starebbe dell saranno facevo"}
    assert all(S.analyze(w, lang) is None for lang, words in stops.items() for w in words.split())
    assert (len(S.STOP_EN), len(S.STOP_ES), len(S.STOP_FR), len(S.STOP_IT)) == (33, 308, 164, 279)
    for lang in S.STEM:  # any word has a stem, and none comes out empty
        for w in ("", "a", "e", "s", "x", "yy", "eed", "ing", "aux", "ièmes", "eses", "日本", "t.co", "été" * 50, "'s", "l'", "0"):
            assert S.analyze(w, lang) is None or bool(S.analyze(w, lang)) == bool(w), (lang, w)


def test_analysis_of_batches(spark):
    rows = [(1, ["cats", "the", "cats"], "en"), (2, ["cats", "the"], "de"), (3, None, "fr"), (4, [], "en"), (5, ["des", "villes", None], "fr"),
            (6, ["cats", "the"], None), (7, ["the"], "en"), (8, ["casas", "the"], "es")]
    from tidewatch.functions.stemming import analyzed

    df = spark.createDataFrame(rows, "i int, w array<string>, lang string")
    got = {r["i"]: r["t"] for r in df.select("i", analyzed(F.col("w"), F.col("lang")).alias("t")).collect()}
    assert got == {1: ["cat", "cat"], 2: ["cats", "the"], 3: None, 4: [], 5: ["vile"], 6: ["cats", "the"], 7: [], 8: ["cas", "the"]}


def test_tokens_of_the_graph_have_no_english_stop_words(spark):
    """The graph's tokens are words of all languages as they are, but for the stop words of English documents."""
    from tidewatch.sources.tables import posts_from_documents

    rows = [(1, "The river and the que houses", "en", "s"), (2, "the agua que corre and", "es", "s"), (3, "The house", None, "s"), (4, None, "en", "s")]
    got = posts_from_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), stemmed=False)
    assert {r["doc_id"]: r["tokens"] and sorted(r["tokens"]) for r in got.collect()} == {
        1: ["houses", "que", "river"], 2: ["agua", "and", "corre", "que", "the"], 3: ["house", "the"], 4: None}
