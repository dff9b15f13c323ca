"""Time windows over vectors: tumbling (ST1), sliding (ST2), daily (ST3), densify (ST5)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embdrift.operators.centroid import centroid
from embdrift.session import materialize

_GRID_BLOCK = 4096
WINDOW_LABELS = {40: "FIVE_MIN", 3600: "ONE_HOUR", 86400: "TWENTY_FOUR_HOURS"}


def _label(width_seconds: int) -> str:
    return WINDOW_LABELS.get(width_seconds, f"{width_seconds}s")


def drift_windows(df: DataFrame, width_seconds: int = 40, slide_seconds: int | None = None,
                  ts_col: str = "first_embedded_at", vector_col: str = "vector") -> DataFrame:
    """Window centroids: (window_size, width_seconds, window_start, window_end, centroid, document_count).

    Tumbling windows are aligned to multiples of their own width from the
    epoch and half-open, as the reference's ``align`` step.  For a sliding
    window each row would otherwise be copied width/slide times; we first
    reduce to partial centroids per slide-sized pane (one shuffle, map-side
    combined) and only copy the pane partials, then combine them with a
    count-weighted mean.  Exact up to float summation order.
    """
    label = _label(width_seconds)
    if not slide_seconds or slide_seconds == width_seconds:
        w = F.window(ts_col, f"{width_seconds} seconds")
        out = centroid(df, [w.alias("w")], vector_col)
    else:
        pane = math.gcd(width_seconds, slide_seconds)
        panes = centroid(df, [F.window(ts_col, f"{pane} seconds").start.alias("pane_start")], vector_col)
        w = F.window("pane_start", f"{width_seconds} seconds", f"{slide_seconds} seconds")
        out = centroid(panes.withColumnRenamed("centroid", "_pv"), [w.alias("w")], "_pv",
                       weight_col="document_count", count_col="document_count")
    return out.select(
        F.lit(label).alias("window_size"),
        F.lit(width_seconds).alias("width_seconds"),
        F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"),
        "centroid", "document_count")


def densify_windows(windows: DataFrame, width_seconds: int, slide_seconds: int | None = None) -> DataFrame:
    """ST5: add the empty windows between the first and last one (count 0, NULL centroid).

    The grid comes from one min/max aggregate, exploded in two steps: blocks of
    ``_GRID_BLOCK`` windows, dealt over the tasks, then the windows of each
    block.  No array holds the whole span.  The windows are written once for
    their two readers.
    """
    step = slide_seconds or width_seconds
    windows = materialize(windows)
    us = F.lit(step * 1_000_000).cast("long")
    lo, hi = F.unix_micros(F.min("window_start")), F.unix_micros(F.max("window_start"))
    bounds = windows.agg(lo.alias("lo"), F.floor((hi - lo) / us).cast("long").alias("last")).filter(F.col("lo").isNotNull())
    blocks = bounds.select("lo", "last", F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor(F.col("last") / _GRID_BLOCK).cast("long"))).alias("blk")).repartition("blk")
    first = F.col("blk") * _GRID_BLOCK
    grid = blocks.select("lo", F.explode(F.sequence(first, F.least(first + _GRID_BLOCK - 1, "last"))).alias("k")) \
        .select(F.timestamp_micros(F.col("lo") + F.col("k") * us).alias("window_start"))
    label = _label(width_seconds)
    filled = grid.join(windows.drop("window_size", "width_seconds", "window_end"), "window_start", "left")
    return filled.select(
        F.lit(label).alias("window_size"),
        F.lit(width_seconds).alias("width_seconds"),
        "window_start",
        (F.col("window_start") + F.make_dt_interval(secs=F.lit(width_seconds))).alias("window_end"),
        "centroid",
        F.coalesce("document_count", F.lit(0)).cast("long").alias("document_count"))
