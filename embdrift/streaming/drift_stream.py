"""Structured Streaming: drift windows with a watermark (ST1-ST4), idempotent
window sink (ST6, ST9), alert stream (ST10), raw archive in foreachBatch (S3).

The reference polls tables and scores each window once, at the first poll
after it closes, silently leaving out rows that arrive later.  Here the
watermark makes that explicit: a window is emitted once the watermark passes
its end; rows later than that are dropped and counted (ST4).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from embdrift import config
from embdrift.operators.centroid import centroid
from embdrift.operators.drift import score_windows
from embdrift.operators.windows import _label, drift_windows


def drift_windows_stream(stream: DataFrame, width_seconds: int = config.DRIFT_WINDOW_SECONDS,
                         slide_seconds: int | None = None, watermark: str = "0 seconds",
                         ts_col: str = "first_embedded_at", vector_col: str = "vector") -> DataFrame:
    """ST1/ST2 on a stream: the same centroid aggregate, finalised by the watermark (append mode).

    Sliding windows are two chained stateful aggregates: panes as wide as the
    largest step that divides width and slide, then sums of panes per window,
    by the event time that a finished pane carries.  Rows are counted
    once, in their pane; only pane sums are copied width/slide times.
    """
    s = stream.withWatermark(ts_col, watermark)
    if slide_seconds and slide_seconds != width_seconds:
        pane = math.gcd(width_seconds, slide_seconds)
        panes = centroid(s, [F.window(ts_col, f"{pane} seconds").alias("pane")], vector_col)
        w = F.window(F.window_time("pane"), f"{width_seconds} seconds", f"{slide_seconds} seconds")
        out = centroid(panes.withColumnRenamed("centroid", "_pv"), [w.alias("w")], "_pv",
                       weight_col="document_count", count_col="document_count")
        return out.select(F.lit(_label(width_seconds)).alias("window_size"), F.lit(width_seconds).alias("width_seconds"),
                          F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                          "centroid", "document_count")
    return drift_windows(s, width_seconds, None, ts_col, vector_col)


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether the path is there, in whatever file system it names; other errors are raised."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def idempotent_append(batch: DataFrame, path: str, keys: list[str], day_of: str = "window_start") -> int:
    """ST6: append only rows whose key is not stored yet (a replayed batch adds nothing).

    Returns the number of rows appended.  The table is partitioned by the UTC
    day of ``day_of``, one of the keys; the anti join reads the key columns of
    the days between the batch's first and last, not of the whole table.
    """
    spark = batch.sparkSession
    new = batch.withColumn("day", F.to_date(day_of)).persist()
    days = new.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).first()
    if days.lo is not None and _exists(spark, path):
        stored = spark.read.parquet(path).filter(F.col("day").between(F.lit(days.lo), F.lit(days.hi))).select(*keys)
        rows = new.join(stored, keys, "left_anti").persist()
    else:
        rows = new
    n = rows.count()
    if n:
        rows.write.mode("append").partitionBy("day").parquet(path)
    rows.unpersist()
    new.unpersist()
    return n


def overwrite_batch(batch: DataFrame, path: str, batch_id: int, fmt: str = "parquet") -> None:
    """Rows of one micro-batch in a folder of its own (``batch_id=``): a replay replaces them.
    Readers of ``path`` see batch_id as a partition column."""
    batch.write.mode("overwrite").format(fmt).save(f"{path.rstrip('/')}/batch_id={batch_id}")


def start_drift_stream(stream: DataFrame, baseline: DataFrame, out_path: str, checkpoint: str,
                       width_seconds: int = config.DRIFT_WINDOW_SECONDS, watermark: str = "0 seconds",
                       threshold: float = config.DRIFT_THRESHOLD, available_now: bool = True,
                       ts_col: str = "first_embedded_at"):
    """ST1 + J16 + P10 + ST6 + ST9: score each finalised window against the
    static baseline and store it once per (window_size, window_start).

    The checkpoint records offsets only after ``foreachBatch`` returns, so a
    failed write is retried with the same batch (commit-after-write); the
    idempotent append makes the retry harmless.
    """
    windows = drift_windows_stream(stream, width_seconds, None, watermark, ts_col)

    def write(batch: DataFrame, batch_id: int) -> None:
        scored = score_windows(batch, baseline, threshold).drop("centroid")
        idempotent_append(scored.withColumn("batch_id", F.lit(batch_id)), out_path, ["window_size", "window_start"])

    w = windows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 seconds")
    return w.start()


class LateRows(StreamingQueryListener):
    """ST4: rows dropped as late, summed over every progress event of every query.

    Add it before the query starts: ``spark.streams.addListener(late)``.
    ``dropped`` maps run id -> rows; Spark itself keeps only the recent events.
    """

    def __init__(self) -> None:
        self.dropped: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.dropped.setdefault(str(event.runId), 0)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        late = sum(op.numRowsDroppedByWatermark for op in p.stateOperators)
        self.dropped[str(p.runId)] = self.dropped.get(str(p.runId), 0) + late

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def start_archive_stream(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """S3 in a stream: raw payloads archived per micro-batch, partitioned by source; a replayed
    batch replaces its own folder."""
    from embdrift.sources.io import archive_raw

    def write(batch: DataFrame, batch_id: int) -> None:
        archive_raw(batch, f"{path.rstrip('/')}/batch_id={batch_id}", mode="overwrite")

    w = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()


def start_alert_stream(stream: DataFrame, baseline: DataFrame, jobs: DataFrame, ling: DataFrame,
                       out_path: str, checkpoint: str, width_seconds: int = config.DRIFT_WINDOW_SECONDS,
                       watermark: str = "0 seconds", threshold: float = config.DRIFT_THRESHOLD,
                       available_now: bool = True, policy: config.ThrottlePolicy = config.ThrottlePolicy()):
    """ST10: vectors -> windows -> score -> linguistic score (J6) -> throttle (ST8) -> S4 payloads.

    One ``foreachBatch`` over finalised windows.  Alerts accepted in this stream are training history
    for the next ones, beside the recorded jobs: those of earlier batches are read from the folder
    ``<out_path>_accepted``, those of the batch itself come in order (``throttle_sequence``).  ``now``
    of an alert is the window end.  A replayed batch sees the same history and replaces its own folders.
    """
    from embdrift.operators.ingest import table_exists
    from embdrift.operators.policy import latest_overlapping, throttle_sequence
    from embdrift.sources.io import drift_alert_payloads
    windows = drift_windows_stream(stream, width_seconds, None, watermark)
    history = f"{out_path.rstrip('/')}_accepted"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        scored = score_windows(batch, baseline, threshold).filter("breached").withColumn(
            "window_id", F.unix_seconds("window_start"))
        enriched = latest_overlapping(scored, ling)
        alerts = enriched.select("window_id", F.col("window_end").alias("now"), "document_count",
                                 F.col("drift_score").alias("embedding_drift"), "linguistic_drift")
        known = jobs.select(F.col("job_id").cast("long").alias("job_id"), "trigger", "queued_at")
        if table_exists(spark, history):
            mine = spark.read.parquet(history).filter(F.col("batch_id") != batch_id)
            known = known.unionByName(mine.select(F.col("window_id").alias("job_id"), F.lit("DRIFT_ALERT").alias("trigger"),
                                                  F.col("now").alias("queued_at")))
        decided = throttle_sequence(alerts, known, policy).filter("accepted").persist()
        payload = drift_alert_payloads(decided.withColumnRenamed("embedding_drift", "drift_score"),
                                       threshold=threshold)
        overwrite_batch(payload, out_path, batch_id)
        overwrite_batch(decided.select("window_id", "now"), history, batch_id)
        decided.unpersist()

    w = windows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    r = spark.readStream.format(fmt).schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", str(max_files))
    return r.load(path)
