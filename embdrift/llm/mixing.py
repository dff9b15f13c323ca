"""Mixing sources to target weights: systematic sampling with whole copies.

Each source gets a target number of words (``source_targets``); a document is then expected
``target / source size`` times. Inside a source the expected copies are summed along a fixed order,
one random offset is added, and a document is emitted once for every integer boundary that its
stretch of the running sum crosses. The order goes by size class, so that the boundaries fall
evenly on short and long documents and the words taken come near the target.

Running sums are two-level: totals per (source, size class, bucket) first, then a window inside
each such part, so a source with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from embdrift.llm.common import evaluated, packed, stored, unpacked
from embdrift.llm.sharding import hash_bucket


def n_words(text: Column) -> Column:
    """Number of words; a null text has none. Counts the places where a word begins."""
    spaced = F.concat(F.lit(" "), F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\f\r", "     "))
    return F.regexp_count(spaced, F.lit(" [^ ]")).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, max_repeat: float) -> DataFrame:
    """source, source_size, target from per-source sizes (one row per source).

    Sources by code point (null last) get ``weights`` in turn and share ``share`` times all words;
    a target stops at ``max_repeat`` times its source and the excess is shared again by weight.
    The fixed point is a water level: target = min(max_repeat * size, level * weight), found with
    running sums over the sources ordered by max_repeat * size / weight.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    w = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(max_repeat)))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    w = (w.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
         .withColumn("level", (F.col("total") - (F.sum("most").over(upto) - F.col("most")))
                     / (F.sum("weight").over(everything) - F.sum("weight").over(upto) + F.col("weight"))))
    # The first source whose cap is above the level that is left sets the level for all behind it.
    free = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))
    found = F.first(free, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return w.select("source", "source_size", F.least(
        F.col("most"), F.coalesce(found * F.col("weight"), F.col("most"))).alias("target"))


def repeated(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix(docs, **how)`` takes it, with all their columns.

    Rows are written once with a number; the mix works on numbers and sizes, and one join by number
    brings the copies back, so texts cross a single shuffle.
    """
    rows = _measured(packed(docs, "doc_id", "source", "text")).drop("text")
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "mix-rows")
    taken = _mixed(rows.select("row", "doc_id", "source", "size", "mark"), **how).where("copies > 0").select(
        F.col("row").alias("taken_row"), "copies")
    both = rows.join(taken, F.col("row") == F.col("taken_row"))
    often = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))
    return unpacked(both.withColumn("_k", often), docs)


def _measured(rows: DataFrame) -> DataFrame:
    return evaluated(rows, size=n_words(F.col("text")), mark=F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def mix(docs: DataFrame, **how) -> DataFrame:
    """doc_id, source, size, source_size, target, copies for every row of ``docs`` (doc_id, text, source).

    copies: how often the mix takes the row, at most ceil(max_repeat). The order inside a source is
    (size class, bucket, size, doc_id, digest), all from the row itself, and the offset comes from
    ``seed`` and the source, so reruns agree. Null sources form one source, null ids are rows like
    others, a source without words gets target 0 and no copies. ``how``: weights (3, 1, 2), share 1.5,
    max_repeat 2, seed 1, and buckets 64, which splits every size class of every source.
    """
    rows = _measured(packed(docs.select("doc_id", "source", "text"), "doc_id", "source", "text"))
    # The texts are read once; what follows needs their sizes only.
    rows = stored(rows.select("doc_id", "source", "size", "mark"), "mix-sizes")
    return _mixed(rows, **how)


def _mixed(rows: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_repeat: float = 2,
           buckets: int = 64, seed: int = 1) -> DataFrame:
    """``rows`` (doc_id, source, size, mark and others) with source_size, target and copies."""
    keep = [c for c in rows.columns if c != "mark"]
    # Size class: the length in bits and the three bits after the first, eight classes per doubling.
    rows = rows.withColumn("cls", F.expr(
        "CASE WHEN size > 0 THEN length(bin(size)) * 8 + (size * 8) div shiftleft(1L, length(bin(size)) - 1) ELSE -1 END")) \
        .withColumn("bucket", hash_bucket(buckets, F.col("doc_id"), F.col("mark")))
    # At most sources * size classes * buckets rows, about 160 classes: pre-aggregated before any window.
    parts = rows.groupBy("source", "cls", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    targets = source_targets(parts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, max_repeat)
    run = Window.partitionBy("source").orderBy("cls", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("source").alias("p_source"), F.col("cls").alias("p_cls"), F.col("bucket").alias("p_bucket"),
                         F.coalesce(F.sum("n").over(run), F.lit(0)).alias("rank0"))
    parts = parts.join(targets, parts.p_source.eqNullSafe(targets.source)).drop("source")
    inside = Window.partitionBy("source", "cls", "bucket").orderBy(
        "size", F.col("doc_id").asc_nulls_last(), "mark")
    ranked = rows.withColumn("rank", F.row_number().over(inside))
    ranked = ranked.join(parts, ranked.source.eqNullSafe(parts.p_source) & (ranked.cls == parts.p_cls)
                         & (ranked.bucket == parts.p_bucket))
    offset = hash_bucket(1_000_003, F.lit(seed), F.col("source")) / F.lit(1_000_003.0)
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    at = F.col("rank0") + F.col("rank")
    copies = F.floor(at * expected + offset) - F.floor((at - 1) * expected + offset)
    return ranked.select(*keep, "source_size", "target", copies.cast("bigint").alias("copies"))
