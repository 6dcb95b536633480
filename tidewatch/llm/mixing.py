"""Mixing sources to target weights.

Temperature mixing: the weight of a source is its token share to the power alpha, normalised. alpha
runs from 1 (natural shares) to 0 (uniform). It is bisected twice on a fixed grid: to the largest
alpha whose weights reach the target entropy, and to the smallest alpha at which no source would be
repeated more than ``max_repeats`` times; the larger of the two is used, so the repetition limit wins.

Weights become whole token budgets. A source's documents are dealt by hash into blocks; every pass
(epoch) over a source permutes its blocks and the documents inside each block anew. Full passes are
taken whole; the last pass takes documents in permuted order as long as the tokens taken before them
are under the budget. Running sums go over blocks and then inside the one block where the budget
ends, so the documents of a source never meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.tables import Scratch

ENTROPY, MAX_REPEATS, BUDGET, BLOCK_DOCS, SEED = 0.95, 4.0, 1.0, 512, "mix"
#: alpha is a multiple of 1 / GRID, bisected SECTION points at a time.
GRID, SECTION = 1 << 20, 32


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def deal(*parts: Column) -> Column:
    """A 32-bit hash that any SQL engine can compute."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def _last_ok(shares: DataFrame, ok: Column, down: bool) -> int:
    """Largest step j of [0, GRID] that is ok, given that ok holds up to some step; 0 if none is.

    Step j stands for alpha = j / GRID, or 1 - j / GRID if ``down``. ``ok`` is a Column over entropy (a
    share of its maximum) and repeats (the largest over all sources, at a budget of all tokens). A round
    evaluates one section of steps in one aggregate over steps x sources.
    """
    lo, hi = 0, GRID + 1
    while hi - lo > 1:
        width = max(1, (hi - lo) // SECTION)
        at = shares.select("*", F.explode(F.sequence(F.lit(lo + width), F.lit(hi - 1), F.lit(width))).alias("j"))
        alpha = (F.lit(GRID) - F.col("j") if down else F.col("j")) / F.lit(GRID)
        at = at.withColumn("p", F.pow("share", alpha)).groupBy("j").agg(
            F.sum("p").alias("z"), F.sum(F.col("p") * F.log("p")).alias("plogp"),
            F.max(F.col("p") / F.col("share")).alias("over"), F.count("*").alias("n"))
        at = at.select("j", F.when(F.col("n") < 2, 1.0).otherwise(
            (F.log("z") - F.col("plogp") / F.col("z")) / F.log("n")).alias("entropy"),
            (F.col("over") / F.col("z")).alias("repeats"))
        best = at.where(ok).agg(F.max("j")).first()[0]
        lo, hi = (lo, lo + width) if best is None else (best, min(hi, best + width))
    return lo


def source_budgets(tokens: DataFrame, entropy: float = ENTROPY, max_repeats: float = MAX_REPEATS,
                   budget: float = BUDGET) -> DataFrame:
    """(source, docs, tokens, share, alpha, weight, quota, passes, rest) from rows (source, tokens).

    ``budget`` is the size of the mixture as a multiple of all tokens. ``quota`` is a source's tokens in
    it, ``passes`` its full passes and ``rest`` the tokens of its last pass. If even natural shares repeat
    sources more than ``max_repeats`` times (a budget beyond it), alpha is 1. Sources without tokens get
    no weight. The bisection reads one number of the driver per round; no source list leaves Spark.
    """
    scratch = Scratch(tokens.sparkSession, "mixing")
    per = tokens.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens")).where("tokens > 0")
    per = scratch.write(per).df
    total = F.lit(per.agg(F.sum("tokens")).first()[0]).cast("long")
    per = scratch.write(per.withColumn("share", F.col("tokens") / total)).df
    shares = per.select("share")
    a_entropy = _last_ok(shares, F.col("entropy") >= entropy, down=False)
    a_repeats = GRID - _last_ok(shares, F.col("repeats") * budget <= max_repeats, down=True)
    alpha = F.lit(max(a_entropy, a_repeats)) / F.lit(GRID)
    powered = per.withColumn("alpha", alpha).withColumn("p", F.pow("share", "alpha"))
    out = powered.withColumn("weight", F.col("p") / F.lit(powered.agg(F.sum("p")).first()[0]).cast("double"))
    out = out.withColumn("quota", F.floor(F.col("weight") * total * F.lit(float(budget))))
    out = out.withColumn("passes", F.expr("quota div tokens"))
    return out.select("source", "docs", "tokens", "share", "alpha", "weight", "quota", "passes",
                      (F.col("quota") - F.col("passes") * F.col("tokens")).alias("rest"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        entropy: float = ENTROPY, max_repeats: float = MAX_REPEATS, budget: float = BUDGET,
        block_docs: int = BLOCK_DOCS, seed: str = SEED) -> DataFrame:
    """The mixture: rows (id, source, epoch, block, block_key, doc_key, n_tokens), a document once per pass.

    Ordering by (epoch, source, block_key, block, doc_key, id) gives the permuted blocks. Tokens are
    words. Null sources are one source named ''; documents without words are never drawn; rows that
    repeat an id are drawn each; ties in a key are ordered by id. Only the three named columns are
    read. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "mixture")
    rows = scratch.write(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
                                     word_count(text_col).alias("tokens")).where("tokens > 0")).df
    plan = scratch.write(source_budgets(rows, entropy, max_repeats, budget)).df
    dealt = rows.join(plan.select("source", "docs", "passes", "rest"), "source").withColumn(
        "block", deal(F.lit(seed), F.col("id")) % F.ceil(F.col("docs") / F.lit(block_docs)))

    full = dealt.where("passes > 0").select("*", F.explode(F.expr("sequence(0L, passes - 1)")).alias("epoch"))

    last = dealt.where("rest > 0").withColumn("epoch", F.col("passes"))
    block_key = deal(F.lit(seed), F.lit("block"), F.col("source"), F.col("epoch"), F.col("block"))
    doc_key = deal(F.lit(seed), F.lit("doc"), F.col("epoch"), F.col("id"))
    blocks = last.groupBy("source", "block", "epoch", "rest").agg(F.sum("tokens").alias("size"))
    over = Window.partitionBy("source").orderBy(block_key, "block").rowsBetween(Window.unboundedPreceding, 0)
    blocks = blocks.withColumn("before", F.sum("size").over(over) - F.col("size")).where("before < rest")
    blocks = scratch.write(blocks.select("source", "block", "before", (F.col("before") + F.col("size") <= F.col("rest")).alias("whole"))).df
    taken = last.join(blocks, ["source", "block"])
    inside = Window.partitionBy("source", "block").orderBy(doc_key, "id").rowsBetween(Window.unboundedPreceding, 0)
    part = taken.where("not whole").withColumn("upto", F.sum("tokens").over(inside) - F.col("tokens")).where("before + upto < rest")
    cols = ["id", "source", "epoch", "block", "tokens"]
    picked = full.select(*cols).unionByName(taken.where("whole").select(*cols)).unionByName(part.select(*cols))
    return picked.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "epoch", "block",
                         block_key.alias("block_key"), doc_key.alias("doc_key"), F.col("tokens").alias("n_tokens"))
