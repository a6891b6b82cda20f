"""Connected components by alternating large and small stars, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, discard, scratch

MOST_ROUNDS = 60


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """Links each node's neighbours (the larger ones, or the smaller ones and itself) to its least neighbour.

    The least neighbour comes from an aggregation that combines before the shuffle, and is joined back by rows of two
    numbers; where one node has a large share of them, adaptive execution splits that join.
    """
    if large:
        pairs = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "star-least")
    near = pairs.join(least, "u")
    if large:
        out = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """From links (a, b) of long ids: node and root, the least node it is connected to.  Nodes without links are left out.

    Self links and repeated links do no harm; null ends are ignored.  The result is written.
    """
    with scratch() as own:
        pairs = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
        pairs, before = cut(pairs, "star"), None
        for _ in range(MOST_ROUNDS):
            last, pairs = pairs, cut(_star(_star(pairs, True), False), "star")
            discard(last)
            now = tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first())
            if now == before or not now[0]:
                break
            before = now
        else:
            raise RuntimeError("the components did not settle")
        roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
        return own.keep(cut(pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots), "star-roots"))
