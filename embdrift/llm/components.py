"""Connected components of a link table by alternating stars, in DataFrame steps.

Every round connects the larger neighbours of a node to its smallest neighbour (large star), then
the smaller ones (small star); links never get more, and the graph turns into stars around each
component's smallest node in a logarithmic number of rounds. Each round is written to the shared
folder, so a lost executor repeats one round. The table of links of a hub is aggregated before the
join, and the join itself is plain, so the engine can split a hub's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embdrift.llm.common import stored


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: distinct (a, b) with a > b. One large or small star step, again distinct with a > b."""
    if large:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
            links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        least = links.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        mine = links.select(F.col("a").alias("u"), F.col("b").alias("v")).join(least, "u")
        out = mine.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(
            least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a > b").distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node with a link; component is the smallest node reachable.

    ``links``: columns a, b (same orderable type, in any direction, repeats and loops allowed).
    """
    now = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = stored(now, "links")
    for _ in range(max_rounds):
        after = stored(_star(_star(now, True), False), "links")
        # Stars: no node is both a centre and a leaf, and no leaf has two centres.
        loose = (after.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a")
                 .unionAll(after.select("a").join(after.select(F.col("b").alias("a")), "a", "left_semi")).limit(1).count())
        now = after
        if not loose:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    raise RuntimeError("components did not settle; raise max_rounds")
