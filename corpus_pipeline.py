"""From raw documents to a training mixture: five stages, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import decontam, lines, minmax, mixing, quality
from tidewatch.llm.tables import Scratch
from tidewatch.session import scratch_tables
from tidewatch.sources.tables import table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules, learned from all labels, do not reject.

    Null and empty texts are scored like others. Rows that repeat an id go if one of them is rejected; rows with a
    null id stay. An empty table gives no rows; without labels nothing is rejected.
    """
    scored = quality.score_documents(docs, table(spark, sf_dir, "labels"))
    rejected = scored.where("predicted = 0").select("doc_id")
    return docs.join(rejected, "doc_id", "left_anti").select(docs.columns)


def drop_site_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their source's boilerplate lines; n_chars follows the text.

    Copies are still there at this stage: equal texts of a source count once, and a text of boilerplate
    lines only stays, so that no group of copies loses all its members.
    """
    out = lines.drop_boilerplate(docs, count_copies=False, leave_empty=False)
    return out.withColumn("n_chars", F.when(F.col("lines_dropped") > 0, F.length("text").cast("long")).otherwise(
        F.col("n_chars"))).select(docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8), the one with the smallest id.

    Null, empty and blank texts are near nothing and stay, as do rows with a null id. Rows that repeat an id are one
    document. An empty table gives no rows.
    """
    copies = minmax.near_duplicates(docs, width=5, percent=80).where("not kept").select("doc_id")
    return docs.join(copies, "doc_id", "left_anti").select(docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found.

    Null and empty texts hold none and stay, as do rows with a null id. Rows that repeat an id go if one of them holds an
    item. An empty table gives no rows, an empty benchmark leaves all.
    """
    found = decontam.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id")
    return docs.join(found, "doc_id", "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of the sources: a row per document and pass.

    Null, empty and blank texts are never drawn; a null source is one source named ''; rows that repeat an id are drawn
    each. An empty table gives no rows.
    """
    return mixing.mix(docs)


STAGES = [
    ("quality", keep_quality),
    ("site_lines", drop_site_lines),
    ("near_duplicates", keep_one_of_each_group),
    ("benchmark", drop_benchmark),
    ("mix", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of the documents that all stages keep: rows (doc_id, source, epoch, block, ...), one per pass.

    A null, empty or blank text passes the filters that find nothing in it and drops out of the mixture, which deals
    words; a null lang or source is read as ''. Documents that repeat an id share its fate in every stage: rejected
    together, kept together. Further columns are kept up to the mixture. An empty table gives an empty mixture.
    Intermediate tables go to the shared folder; a stage's input is dropped when its output is written.
    """
    scratch = Scratch(spark, "pipeline")
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        with scratch_tables(spark):  # a stage's intermediate tables go with it
            step = scratch.write(stage(spark, docs, sf_dir), result=True)
        if last is not None:
            last.drop()
        docs, last = step.df, step
    return docs


#: Trees, set similarities and templates have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None
