"""Sources and sinks: document stream (S1), corpus JSONL (S2), raw archive (S3),
alert payloads and sinks (S4, S5), report sink (S6).  Explicit schemas, no inference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from embdrift.functions.text import iso_utc

# Ingest payload: document_id, text, source (non-empty strings), ISO timestamp, optional object.
DOCUMENT_EVENT = T.StructType([
    T.StructField("document_id", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("metadata", T.StringType()),
])

CORPUS_RECORD = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("label_text", T.StringType()),
])


def read_document_stream(spark: SparkSession, fmt: str, path: str | None = None,
                         options: dict[str, str] | None = None) -> DataFrame:
    """Streaming documents.  ``kafka``: value is the JSON event, key the
    idempotency key; ``json``/``parquet``: files with the event schema.

    Output columns: the event fields plus ``key`` (None for files).  Offsets
    are tracked by the query checkpoint, so a restarted query resumes where
    the last committed batch ended (commit-after-write, ST9).
    """
    opts = dict(options or {})
    if fmt == "kafka":
        return decode_messages(spark.readStream.format("kafka").options(**opts).load())
    reader = spark.readStream.format(fmt).schema(DOCUMENT_EVENT).options(**opts)
    df = reader.load(path) if path else reader.load()
    return df.withColumn("key", F.lit(None).cast("string"))


def decode_messages(raw: DataFrame) -> DataFrame:
    """Event columns and ``key`` of messages (key, value: binary or string).  A value that is no JSON
    object gives null fields, which P1 rejects with reasons; ``metadata`` stays JSON text."""
    ev = F.from_json(F.col("value").cast("string"), DOCUMENT_EVENT)
    return raw.select(F.col("key").cast("string").alias("key"), ev.alias("e")).select("key", "e.*")


def read_corpus(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Several JSONL files read as one pool (text, label_text); bad lines are NULL rows."""
    return spark.read.schema(CORPUS_RECORD).option("mode", "PERMISSIVE").json(list(paths)) \
        .withColumn("file", F.input_file_name())


def archive_raw(df: DataFrame, path: str, mode: str = "append") -> None:
    """S3: raw payloads archived before rows are stored, partitioned by source.

    One file per row (the reference's object layout) would be an anti-pattern
    at scale; rows go to partitioned JSON files and keep their ``object_key``.
    A stream gives each batch a folder of its own and ``mode="overwrite"``, so
    that a replay replaces what it wrote.
    """
    df.write.mode(mode).partitionBy("source").json(path)


def drift_alert_payloads(accepted: DataFrame, window_size: str = "FIVE_MIN", threshold: float = 0.08) -> DataFrame:
    """(key, value) rows: key = window size, value = the 7-field JSON alert
    (a missing linguistic score is ``null``, not left out)."""
    value = F.to_json(F.struct(
        F.col("window_id").cast("string").alias("window_id"),
        F.lit(window_size).alias("window_size"),
        F.col("drift_score").alias("drift_score"),
        F.col("linguistic_drift").alias("linguistic_drift_score"),
        F.lit(threshold).alias("threshold"),
        F.col("priority").alias("priority"),
        iso_utc(F.col("now")).alias("timestamp")), {"ignoreNullFields": "false"})
    return accepted.select(F.lit(window_size).alias("key"), value.alias("value"))


def linguistic_alert_payloads(report: DataFrame) -> DataFrame:
    """Breached windows as (key, value): key = window id, value = JSON with the window, drift
    window and job ids (J13, J14; ``null`` where there is none), scores, the time ``now`` of the
    analysis, new entities and emerging terms."""
    def text(c: str):
        return F.col(c).cast("string").alias(c)

    value = F.to_json(F.struct(
        text("window_id"), text("drift_window_id"), text("training_job_id"),
        F.col("composite_score"), F.col("threshold"), iso_utc(F.col("now")).alias("timestamp"),
        F.col("new_entities"), F.col("emerging_terms")), {"ignoreNullFields": "false"})
    return report.filter(F.col("breached")).select(F.col("window_id").cast("string").alias("key"), value.alias("value"))


def write_alerts(df: DataFrame, fmt: str, options: dict[str, str] | None = None, path: str | None = None) -> None:
    """S4/S5 batch sink: Kafka (key/value) or files."""
    w = df.write.format(fmt).options(**(options or {}))
    if fmt == "kafka":
        w.save()
    else:
        w.mode("append").save(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small metrics report as one JSON file (the frame is a few rows per domain)."""
    df.coalesce(1).write.mode("overwrite").json(path)
