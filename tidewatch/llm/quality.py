"""Quality classification by a sparse rule ensemble.

Statistics of a text are Column expressions. Shallow trees are grown on labelled rows; every path from
a root to a node becomes a conjunctive rule over the statistics; a logistic regression with lasso
penalty weighs the rules and leaves most at zero. The remaining rules are compiled back into one
Column expression, so scoring is a projection without Python or a model on the executors.

Trees and weights are fitted on at most ``train_rows`` labelled rows, chosen by a hash of their id.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.tables import Scratch

TRAIN_ROWS, TREES, DEPTH, LASSO, SEED = 12_000, 24, 3, 0.001, 11
STATS = ["chars", "words", "word_len", "distinct_words", "symbols", "upper", "digits", "marks", "lines", "distinct_lines",
         "line_words", "long_words", "letters"]


def statistics(text: str) -> dict[str, Column]:
    """Statistics of a text column by name; null and blank texts give zeros. ``words`` must be bound by ``with_statistics``."""
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.greatest(F.length(t), F.lit(1)).cast("double")
    w, ln = F.col("_w"), F.col("_l")
    nw, nl = F.greatest(F.size(w), F.lit(1)).cast("double"), F.greatest(F.size(ln), F.lit(1)).cast("double")
    count = lambda p: F.regexp_count(t, F.lit(p)).cast("double")
    solid = F.length(F.array_join(w, "")).cast("double")
    return {
        "chars": F.log1p(F.length(t).cast("double")),
        "words": F.log1p(F.size(w).cast("double")),
        "word_len": solid / nw,
        "distinct_words": F.size(F.array_distinct(w)) / nw,
        "symbols": count("[^\\p{L}\\p{N}\\p{M}\\s.,;:'!?()\"-]") / n,
        "upper": count("\\p{Lu}") / n,
        "digits": count("[0-9]") / n,
        "marks": count("[!?]") / n,
        "lines": F.log1p(F.size(ln).cast("double")),
        "distinct_lines": F.size(F.array_distinct(ln)) / nl,
        "line_words": F.log1p(F.size(w) / nl),
        "long_words": F.regexp_count(t, F.lit("[^\\s]{14,}")).cast("double") / nw,
        "letters": F.regexp_count(t, F.lit("(?<=\\s|^)[a-z\\u00df-\\u00ff]{1,3}(?=\\s|$)")).cast("double") / nw,
    }


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, the statistics), one row per row of ``docs``."""
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t"))
    lines = F.filter(F.split(F.coalesce("_t", F.lit("")), "\n"), lambda x: F.trim(x) != "")
    words = F.filter(F.split(F.coalesce("_t", F.lit("")), "\\s+"), lambda x: x != "")
    src = src.withColumns({"_w": words, "_l": lines})
    return src.select(F.col("_id").alias(id_col), *[c.alias(k) for k, c in statistics("_t").items()])


@dataclass(frozen=True)
class Rules:
    """score = logistic(intercept + sum of weights of the rules that hold); a rule is ((statistic, op, value), ...)."""

    intercept: float
    weighted: tuple[tuple[tuple[tuple[str, str, float], ...], float], ...]

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.weighted:
            total = total + F.when(holds(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def holds(rule) -> Column:
    out = F.lit(True)
    for stat, op, value in rule:
        out = out & (F.col(stat) <= value if op == "<=" else F.col(stat) > value)
    return out


def tree_rules(debug: str, names: list[str]) -> list[tuple]:
    """The conjunction of every root-to-node path of the printed trees."""
    rules: dict[tuple, None] = {}
    path: list[tuple[int, tuple]] = []
    for line in debug.splitlines():
        m = re.match(r"(\s*)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if re.match(r"\s*Tree \d+", line):
            path = []
        elif m:
            depth = len(m[1])
            path = [p for p in path if p[0] < depth] + [(depth, (names[int(m[2])], m[3], float(m[4])))]
            tight: dict[tuple[str, str], float] = {}
            for _, (s, op, v) in path:
                old = tight.get((s, op), v)
                tight[s, op] = min(old, v) if op == "<=" else max(old, v)
            rules[tuple(sorted((s, op, v) for (s, op), v in tight.items()))] = None
    return list(rules)


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality",
        train_rows: int = TRAIN_ROWS) -> Rules:
    """Rules learned from the labelled rows of ``stats``; rows without a label or statistic are left out.

    Without labels the score is 0.5, with labels of one kind that kind. At most ``train_rows`` rows are
    used, those with the smallest hash of the id; their order, and so the fit, does not depend on
    partitioning.
    """
    scratch = Scratch(stats.sparkSession, "quality")
    rows = stats.join(labels.select(id_col, F.col(label_col).cast("double").alias("label")).where("label in (0, 1)"), id_col)
    rows = rows.orderBy(F.xxhash64(id_col), id_col, "label", *STATS).limit(train_rows)
    vector = array_to_vector(F.array(*[F.col(s) for s in STATS])).alias("features")
    table = scratch.write(rows.select("label", *STATS).coalesce(1)).df
    n, ones = table.agg(F.count("*"), F.sum("label")).first()
    if not n or ones in (0, n):
        return Rules(0.0 if not n else 20.0 if ones else -20.0, ())
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="onethird", subsamplingRate=0.5,
                                    minInstancesPerNode=5, seed=SEED).fit(table.select("label", vector))
    rules = tree_rules(forest.toDebugString, STATS)
    held = array_to_vector(F.array(*[holds(r).cast("double") for r in rules])).alias("features")
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, maxIter=60, standardization=False)
    model = lasso.fit(scratch.write(table.select("label", held)).df)
    weights = model.coefficients.toArray().tolist()
    return Rules(float(model.intercept), tuple((r, w) for r, w in zip(rules, weights) if abs(w) > 1e-9))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    label_col: str = "quality", learn_from: Column | None = None, cut: float = 0.3) -> DataFrame:
    """Rows (id, score, predicted), one per row of ``docs``; learned from the labels where ``learn_from`` holds.

    ``learn_from`` is a condition on the label table. Null, empty and blank texts are scored by their
    statistics (zeros). Repeated rows get equal rows; null ids are scored and never learned from; only
    the named columns are read; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "scores")
    stats = scratch.write(with_statistics(docs, id_col, text_col)).df
    rules = fit(stats, labels if learn_from is None else labels.where(learn_from), id_col, label_col)
    scored = stats.select(id_col, rules.score().alias("score"))
    return scored.select(id_col, "score", (F.col("score") >= cut).cast("int").alias("predicted"))
