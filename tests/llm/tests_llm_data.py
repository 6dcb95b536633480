"""Odd documents: null, empty, blank, copies in another case, a repeated row, no letters, a long text, a null id."""

ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "Alpha beta gamma delta"), (5, "alpha BETA gamma delta"), (6, "one two"), (6, "one two"),
       (7, "12 34 !!"), (8, "word " * 60_000), (None, "Alpha beta gamma delta"), (9, "a" * 200_000)]


def docs_frame(spark):
    from pyspark.sql import functions as F

    names = ["id", "n", "key", "bands", "block", "tokens", "s", "w", "t", "kept", "score", "label", "words"]
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumns({c: F.lit("clash") for c in names})
