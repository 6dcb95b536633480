"""Connected components by contraction: point every node at its smallest neighbour, collapse the
pointer forest by pointer doubling, contract the edges onto the roots, repeat until none is left.

Every round at least halves the nodes of each unfinished component; each step is a keyed join or a
partially aggregated minimum, written to the shared folder. Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.tables import Scratch, Table


def _roots(scratch: Scratch, edges: DataFrame) -> Table:
    """(id, comp) after one round: the root of each node's chain of smallest neighbours."""
    both = edges.select(F.col("a").alias("id"), F.col("b").alias("o")).unionByName(
        edges.select(F.col("b").alias("id"), F.col("a").alias("o")))
    cur = scratch.write(both.groupBy("id").agg(F.min("o").alias("o"))
                        .select("id", F.least("id", "o").alias("comp")))
    while True:
        up = cur.df.select(F.col("id").alias("comp"), F.col("comp").alias("up"))
        nxt = scratch.write(cur.df.join(up, "comp").select("id", F.col("up").alias("comp"),
                                                           (F.col("up") != F.col("comp")).alias("moved")))
        cur.drop()
        cur = Table(scratch.spark, nxt.path, nxt.df.select("id", "comp").schema)
        if nxt.df.where("moved").isEmpty():
            return cur


def connected_components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(id, comp) for every node of ``edges`` (a, b): comp is the smallest id reachable.

    Null ends and loops are ignored; repeated edges are harmless; no edges give no rows.
    """
    cur = scratch.write(edges.where("a is not null and b is not null and a != b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    comps: Table | None = None
    while not cur.df.isEmpty():
        step = _roots(scratch, cur.df)
        m = step.df
        left = cur.df.join(m.select(F.col("id").alias("a"), F.col("comp").alias("ca")), "a").join(
            m.select(F.col("id").alias("b"), F.col("comp").alias("cb")), "b")
        nxt = scratch.write(left.where("ca != cb").select(
            F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct())
        cur.drop()
        cur = nxt
        if comps is None:
            comps = step
        else:
            up = m.select(F.col("id").alias("comp"), F.col("comp").alias("up"))
            old = comps
            comps = scratch.write(old.df.join(up, "comp", "left").select(
                "id", F.coalesce("up", "comp").alias("comp")))
            old.drop()
            step.drop()
    if comps is None:
        return cur.df.select(F.col("a").alias("id"), F.col("b").alias("comp"))
    return comps.df
