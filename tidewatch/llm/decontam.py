"""Benchmark decontamination by templates.

A text becomes a sequence of template words: letters lower-cased, punctuation dropped, numbers, units
behind numbers and capitalised names inside a sentence replaced by typed placeholders. Windows of
template words of the documents are hash-joined with those of the benchmark, so a question whose
numbers or names were changed still matches. A document's match with an item counts only if its
slots are consistent: over the alignments (offsets) of the item in the document, each value of the item
always stands for the same value of the document. The alignment with most windows gives the first values,
the others add theirs, best supported and nearest first; an alignment that contradicts them does not count.
An item is found in a document if at least ``share`` of its windows match.

Where a sentence starts and how a copy is capitalised differ from text to text, so a window has three
forms and matches in any: the template, the loose template in which every capitalised word is a name
wherever it stands, and the plain lower-cased words. A template needs two plain words at least; a window
with fewer would match any run of numbers or names and counts by its plain form alone.

DataFrame functions only. Window hashes are made per row, templates only for texts with a digit or a capital;
only rows whose hash occurs in the benchmark reach a shuffle, as long as these hashes are few enough to be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.tables import Scratch

WINDOW, SHARE = 5, 0.8
#: Words that are units when they follow a number.
UNITS = ["mm", "cm", "m", "km", "in", "inch", "inches", "ft", "feet", "yd", "mile", "miles", "mg", "g", "kg", "lb", "lbs", "oz",
         "ml", "l", "liter", "liters", "litre", "litres", "s", "sec", "second", "seconds", "min", "minute", "minutes", "h",
         "hr", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "percent", "dollar",
         "dollars", "euro", "euros", "cent", "cents", "usd", "eur", "kmh", "mph", "hz", "khz", "mhz", "ghz", "kb", "mb",
         "gb", "tb", "v", "w", "kw", "kwh", "j", "kj", "cal", "kcal", "c", "f", "k", "meter", "meters", "metre", "metres"]
_NAME, _FIRST = "\u0001", "\u0002"
#: Forms of a text's words: template, loose template, plain.
FORMS = ("t", "l", "p")
#: Hashes of the benchmark are broadcast to the documents up to this many (16 MB), beyond it joined by a shuffle.
BROADCAST_HASHES = 1_000_000


def marked(text: Column) -> Column:
    """The words of the text between single spaces; a capitalised word carries a mark: one that follows a word inside
    a sentence, or another one. The patterns begin with what is rare, so most places of a text fail at once."""
    t, word = F.coalesce(text, F.lit("")), "\\p{L}\\p{N}\\p{M}" + _NAME + _FIRST
    t = F.when(F.contains(t, F.lit(_NAME)) | F.contains(t, F.lit(_FIRST)), F.translate(t, _NAME + _FIRST, "  ")).otherwise(t)
    t = F.when(t.rlike("[0-9][.,][0-9]"), F.regexp_replace(t, "(?<=[0-9])[.,](?=[0-9])", "")).otherwise(t)
    t = F.regexp_replace(t, "(?=\\p{Lu}\\p{Ll})(?<![\\p{L}\\p{N}\\p{M}])", _FIRST)
    t = F.regexp_replace(t, _FIRST + "(?<=[\\p{L}\\p{N},;:] " + _FIRST + ")", _NAME)
    return F.trim(F.regexp_replace(t, f"[^{word} ][^{word}]*| [^{word}]+", " "))


def _split(words: Column) -> Column:
    """The words of `m` in one of its forms; the test is on `m`, for a form is costly to work out twice."""
    return F.when(F.col("m") == "", F.array().cast("array<string>")).otherwise(F.split(words, " "))


def _plain(m: Column) -> Column:
    return F.lower(F.translate(m, _NAME + _FIRST, ""))


def _template(m: Column, loose: bool, numbers: bool) -> Column:
    """The marked words as a template; if ``loose``, capitalised words that start a sentence are names too."""
    t = _plain(F.regexp_replace(m, (f"[{_NAME}{_FIRST}]" if loose else _NAME) + "[^ ]+", "<name>"))
    if not numbers:
        return t
    t = F.regexp_replace(t, "(?<![^ ])[0-9][^ ]*", "<num>")
    return F.regexp_replace(t, f"(?<=<num> )(?:{'|'.join(UNITS)})(?= |$)", "<unit>")


def _forms(df: DataFrame, i: str, text: str) -> DataFrame:
    """(id, row, kinds, t, l, p) of the rows with an id: the forms of its words; row tells texts of one id apart.

    kinds is 1 for a text whose forms are all plain, 2 if only the loose template differs, else 3; forms that are like
    the plain one are null.
    """
    df = df.where(F.col(i).isNotNull()).select(F.col(i).cast("long").alias("id"), marked(F.col(text).cast("string")).alias("m"))
    kinds = F.when(F.col("m").rlike("[0-9" + _NAME + "]"), 3).when(F.contains("m", F.lit(_FIRST)), 2).otherwise(1)
    m, some, all_ = F.col("m"), F.col("kinds") > 1, F.col("kinds") > 2
    df = df.select("id", F.xxhash64("m").alias("row"), kinds.alias("kinds"), "m")
    return df.select("id", "row", "kinds", F.when(all_, _split(_template(m, False, True))).alias("t"),
                     F.when(all_, _split(_template(m, True, True))).when(some, _split(_template(m, True, False))).alias("l"), _split(_plain(m)).alias("p"))


def _at_each_window(size: int, made) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size("p") - F.lit(size)), made)


def _window_hash(form: str, i: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(F.col(form), i + F.lit(k)) for k in range(size)])


def _windows(df: DataFrame, size: int) -> DataFrame:
    """(id, row, pos, size, hash) of all windows of the rows in each form that the text has."""
    def of(form: str) -> Column:
        return _at_each_window(size, lambda i: _window_hash(form, i, size))

    # no filter on the number of words: it would be pushed down and cut the text into words once more
    forms = F.when(F.size("p") < size, F.array().cast("array<array<bigint>>")).when(F.col("kinds") > 2, F.array(of("p"), of("l"), of("t"))).when(
        F.col("kinds") > 1, F.array(of("p"), of("l"))).otherwise(F.array(of("p")))
    return df.select("id", "row", F.explode(forms).alias("hashes")).select(
        "id", "row", F.posexplode("hashes").alias("pos", "hash")).withColumn("size", F.lit(size))


def _item_windows(items: DataFrame, size: int, window: int) -> DataFrame:
    """(item, item_row, item_pos, size, form, key, hash, slotted) of all windows of the items in each form that counts.

    key names the window: its template, or its plain words where the template does not count.
    """
    rows = items.where(F.size("p") >= window) if size == window else items.where(F.size("p") == size)
    at = _at_each_window(size, lambda i: F.struct(*[_window_hash(f, i, size).alias(f) for f in FORMS]))
    rows = rows.select("id", "row", *FORMS, F.posexplode(at).alias("item_pos", "at"))
    slots = {f: F.size(F.filter(F.slice(f, F.col("item_pos") + 1, size), lambda x: F.startswith(x, F.lit("<")))) for f in FORMS}
    counts = {f: (n == 0) | (n + F.lit(2) <= size) for f, n in slots.items()}
    forms = F.array(*[F.struct(F.lit(f).alias("form"), F.col(f"at.{f}").alias("hash"), (slots[f] > 0).alias("slotted"),
                               counts[f].alias("counts")) for f in FORMS])
    rows = rows.select(F.col("id").alias("item"), F.col("row").alias("item_row"), "item_pos", F.lit(size).alias("size"),
                       F.when(counts["t"], F.col("at.t")).otherwise(F.col("at.p")).alias("key"), F.explode(forms).alias("f"))
    return rows.where("f.counts or f.form = 'p'").select("item", "item_row", "item_pos", "size", "key", "f.form", "f.hash",
                                                        (F.col("f.slotted") & (F.col("f.form") != "p")).alias("slotted"))


def _contradicting(values: DataFrame, one: list[str]) -> DataFrame:
    """The lines (``one``, offset) whose slot values do not fit: two values for one of the item within a line, or another
    value than the line with most windows has, or than the best supported of the other lines (ties: nearest to that
    line, then first). Rows: ``one``, offset, windows (of the line), item_value, value."""
    own = values.repartition(*one).groupBy(*one, "offset", "windows", "item_value").agg(F.min("value").alias("value"), F.max("value").alias("other"))
    line, slot, all_ = Window.partitionBy(*one, "offset"), Window.partitionBy(*one, "item_value"), Window.partitionBy(*one)
    own = own.withColumn("uneven", F.max(F.col("value") != F.col("other")).over(line))
    best = F.max(F.when(~F.col("uneven"), F.struct("windows", (-F.col("offset")).alias("at")))).over(all_)
    own = own.withColumn("anchor", -best["at"])
    own = own.withColumn("first", F.max(F.when(F.col("offset") == F.col("anchor"), F.col("value"))).over(slot))
    own = own.withColumn("against", F.max(F.coalesce(F.col("value") != F.col("first"), F.lit(False))).over(line))
    fits = ~F.col("uneven") & ~F.col("against")
    said = F.min(F.when(fits, F.struct((-F.col("windows")).alias("w"), F.abs(F.col("offset") - F.col("anchor")).alias("far"), "offset", "value"))).over(slot)
    own = own.withColumn("late", fits & F.coalesce(F.col("value") != said["value"], F.lit(False)))
    return own.where("uneven or against or late").select(*one, "offset").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """(id, item_id, windows, share) of every document and item found in it.

    An item of fewer than ``window`` words is one window as long as itself; it matches by its plain
    words, and by a template with two words at least. Null and empty texts have no windows. Rows with a
    null id are not reported. Rows that repeat an id are one document, rows that repeat an item id one
    item (its texts' windows are counted together). Only the named columns are read. An empty table on
    either side gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "decontam")
    items = _forms(benchmark, item_id, item_text).distinct()
    items = scratch.write(items.withColumns({"t": F.coalesce("t", "p"), "l": F.coalesce("l", "p")})).df
    short = sorted(r[0] for r in items.select(F.size("p").alias("n")).where(f"n between 1 and {window - 1}").distinct().collect())
    of_docs = _forms(docs, id_col, text_col)
    b = d = None
    for size in (window, *short):
        bs, ds = _item_windows(items, size, window), _windows(of_docs, size)
        b, d = (bs, ds) if b is None else (b.unionByName(bs), d.unionByName(ds))
    b = scratch.write(b).df
    total = b.groupBy("item").agg(F.count_distinct("key").alias("total"))
    wanted = scratch.write(b.select("size", "hash").distinct()).df
    if wanted.count() <= BROADCAST_HASHES:
        d = d.join(F.broadcast(wanted), ["size", "hash"], "left_semi")
    hits = scratch.write(d.join(b, ["size", "hash"]).select(
        "id", "row", "pos", "item", "item_row", "item_pos", "size", "key", "form", "slotted")).df

    # windows with placeholders: over the alignments, offsets between document and item, their values must map one way;
    # what only the loose template takes for a name binds that template alone
    line = ["item", "item_row", "id", "row", "offset"]
    hits = hits.withColumn("offset", F.col("pos") - F.col("item_pos"))
    part = lambda c, at: F.slice(c, F.col(at) + 1, F.col("size"))
    texts = items.select(F.col("id").alias("item"), F.col("row").alias("item_row"), "t", "l", F.col("p").alias("said"))
    pairs = hits.where("slotted").join(texts, ["item", "item_row"]).select(
        *line, "form", "pos", "size", part("t", "item_pos").alias("t"), part("l", "item_pos").alias("l"), part("said", "item_pos").alias("item_value"))
    pairs = scratch.write(pairs).df
    source = docs.join(pairs.select(F.col("id").alias("_found")).distinct(), F.col(id_col).cast("long") == F.col("_found"), "left_semi")
    values = pairs.join(_forms(source, id_col, text_col).select("id", "row", "p").distinct(), ["id", "row"]).select(
        *line, "form", F.explode(F.arrays_zip("t", "l", "item_value", part("p", "pos").alias("value"))).alias("v"))
    lines = pairs.groupBy(*line).agg(F.count_distinct("pos").alias("windows"))
    bound = F.when(F.startswith(F.col("v.t"), F.lit("<")), F.array(F.lit("t"), F.lit("l"))).when(
        (F.col("form") == "l") & F.startswith(F.col("v.l"), F.lit("<")), F.array(F.lit("l")))
    values = values.select(*line, F.explode(bound).alias("form"), "v.item_value", "v.value").join(lines, line)
    bad = scratch.write(_contradicting(values, [*line[:-1], "form"])).df
    good = hits.where("not slotted").unionByName(hits.where("slotted").join(bad, [*line, "form"], "left_anti"))
    n = good.select("item", "id", "key").distinct().groupBy("item", "id").agg(F.count("*").alias("windows"))
    return n.join(total, "item").where(F.col("windows") >= F.lit(share) * F.col("total")).select(
        F.col("id").alias(id_col), F.col("item").alias(item_id if item_id != id_col else "item_id"), "windows",
        (F.col("windows") / F.col("total")).alias("share"))


def flag_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows (id, contaminated, n_items, items), one per row of ``docs``; items are sorted item ids."""
    found = contaminated(docs, benchmark, id_col, text_col, **options)
    found = found.groupBy(F.col(id_col).alias("_id")).agg(F.sort_array(F.collect_set(found.columns[1])).alias("items"))
    out = docs.select(F.col(id_col).cast("long").alias(id_col)).join(found, F.col(id_col) == F.col("_id"), "left")
    return out.select(id_col, F.col("items").isNotNull().alias("contaminated"),
                      F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
                      F.coalesce("items", F.array().cast("array<long>")).alias("items"))
