"""Ingest on a stream (S1, P1, P2, D1, D2, S3, ST9): validate, deduplicate, archive, store, as one unit.

Two stages keep copies out.  Keyed state with an expiry knows every (source, id) that came
recently.  A Bloom filter of all stored keys, built by an aggregate batch by batch, tells which of
the rest were certainly never stored; only the others are looked up in the table.  Each
micro-batch archives its raw payloads first, then writes its rows, then its filter bits, each into a
folder of its own, so a replayed batch replaces itself and no row is there without its archive.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from embdrift.operators.ingest import _digest, table_exists, validate_documents, with_keys
from embdrift.session import ship_package
from embdrift.sources.io import archive_raw
from embdrift.streaming.drift_stream import overwrite_batch

_STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstWins(StatefulProcessor):
    """Passes the first row of a key on and forgets the key after ``expiry_ms``."""

    def __init__(self, expiry_ms: int):
        self.expiry_ms = expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "first timestamp")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first = min(rows, key=lambda r: (r.occurred_at, r.payload))  # a micro-batch has no order of its own
        if not self.seen.exists():
            self.seen.update((first.occurred_at,))
            self.handle.registerTimer(first.arrived_ms + self.expiry_ms)
            yield Row(source=first.source, document_id=first.document_id, occurred_at=first.occurred_at, payload=first.payload)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.seen.clear()
        return iter([])


def first_arrivals(events: DataFrame, expiry: str = "7 days") -> DataFrame:
    """The first valid event per (source, document_id): source, document_id, occurred_at, payload (the
    event as JSON).  Of the copies in one micro-batch the one of the earliest time counts.  The watermark is the
    time of arrival, so no event is ever late; a key is forgotten ``expiry`` after its first arrival."""
    ship_package(events.sparkSession)
    ms = int(events.sparkSession.sql(f"SELECT unix_millis(timestamp '1970-01-01 00:00:00Z' + INTERVAL {expiry})").first()[0])
    arrived = events.withColumn("arrived", F.current_timestamp()).withWatermark("arrived", "0 seconds")
    rows = arrived.select("arrived", F.unix_millis("arrived").alias("arrived_ms"), "source", "document_id", F.col("timestamp").alias("occurred_at"), F.to_json(
        F.struct("document_id", "text", "source", F.col("timestamp"), "metadata"), {"ignoreNullFields": "false"}).alias("payload"))
    kept = "source string, document_id string, occurred_at timestamp, payload string"
    return rows.groupBy("source", "document_id").transformWithState(FirstWins(ms), kept, "append", "EventTime")


def bit_positions(key: Column, bits: int, hashes: int) -> Column:
    return F.array(*[F.pmod(F.xxhash64(key, F.lit(k)), F.lit(bits)) for k in range(hashes)])


def bloom_bits(keys: DataFrame, bits: int, hashes: int, key: str = "_k") -> DataFrame:
    """The filter of all keys as (word, bits): at most ``bits`` / 64 rows, combined map-side."""
    at = keys.select(F.explode(bit_positions(F.col(key), bits, hashes)).alias("at"))
    return at.groupBy(F.floor(F.col("at") / 64).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))).alias("bits"))


def maybe_stored(key: Column, words: dict[int, int], bits: int, hashes: int) -> Column:
    """False only for keys that are certainly not in the filter ``words``."""
    if not words:
        return F.lit(False)
    table = F.from_json(F.lit(str([words.get(k, 0) for k in range(-(-bits // 64))])), "array<bigint>")
    return F.forall(bit_positions(key, bits, hashes), lambda at: F.getbit(
        F.element_at(table, (F.floor(at / 64) + 1).cast("int")), (at % 64).cast("int")) == 1)


def store_batch(spark: SparkSession, batch: DataFrame, batch_id: int, table: str, archive: str, bloom: str,
                bits: int = 1 << 20, hashes: int = 5, run: str = "r0") -> dict[str, int]:
    """One micro-batch of ``first_arrivals``: rows whose key is not stored yet are archived, then written.

    ``run`` names the query whose batches are numbered so; another query on the same table has another
    name.  Returns how many rows came, were looked up in the table, and were new.  The
    filter's ``bits`` / 64 numbers pass through the driver; with more than some
    ``bits`` / 8 keys it lets most rows through, which costs look-ups, not results.
    """
    rows = batch.withColumn("_k", _digest(["source", "document_id"])).persist()
    earlier = (F.col("run") != run) | (F.col("batch_id") != batch_id)
    words = ({r.word: r.bits for r in spark.read.parquet(bloom).filter(earlier).groupBy("word").agg(F.bit_or("bits").alias("bits")).collect()}
             if table_exists(spark, bloom) else {})
    tagged = rows.withColumn("_maybe", maybe_stored(F.col("_k"), words, bits, hashes)).persist()
    looked_up = tagged.filter("_maybe")
    n = {"rows": rows.count(), "looked_up": looked_up.count()}
    fresh = tagged.filter("NOT _maybe")
    if n["looked_up"]:
        stored = spark.read.parquet(table).filter(earlier).select(_digest(["source", "document_id"]).alias("_k"))
        fresh = fresh.unionByName(looked_up.join(stored, "_k", "left_anti"))
    event = F.from_json("payload", "document_id string, text string, source string, timestamp timestamp, metadata string")
    new = fresh.select("_k", "payload", event.alias("e")).select("_k", "payload", "e.*")
    new = with_keys(new, "document_id", "source", "timestamp").persist()
    n["new"] = new.count()
    archive_raw(new.select("source", "idempotency_key", "object_key", "payload"), f"{archive.rstrip('/')}/run={run}/batch_id={batch_id}", mode="overwrite")
    overwrite_batch(new.drop("_k", "payload"), f"{table.rstrip('/')}/run={run}", batch_id)
    overwrite_batch(bloom_bits(new, bits, hashes), f"{bloom.rstrip('/')}/run={run}", batch_id)
    for df in (new, tagged, rows):
        df.unpersist()
    return n


def start_ingest_stream(events: DataFrame, table: str, archive: str, bloom: str, checkpoint: str, rejected: str | None = None,
                        expiry: str = "7 days", bits: int = 1 << 20, hashes: int = 5, available_now: bool = True, progress=None):
    """Run ingest over a stream of ``DOCUMENT_EVENT`` columns (see ``io.read_document_stream``).

    Offsets are committed after the batch is stored (ST9).  A query is known by its checkpoint: several
    queries, or one begun again from an empty checkpoint, can fill one table.  Invalid events go to
    ``rejected`` with their reasons, in a query of their own.  ``progress(batch_id, counts)``
    is told what ``store_batch`` counted.  Returns the queries started.
    """
    spark = events.sparkSession
    valid, bad = validate_documents(events, "document_id", "text", "source", "timestamp", "metadata")
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STATE_STORE)

    run = "r" + hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]

    def write(batch: DataFrame, batch_id: int) -> None:
        counts = store_batch(spark, batch, batch_id, table, archive, bloom, bits, hashes, run)
        if progress is not None:
            progress(batch_id, counts)

    def started(df: DataFrame, fn, name: str):
        w = df.writeStream.foreachBatch(fn).outputMode("append").option("checkpointLocation", f"{checkpoint.rstrip('/')}/{name}")
        return (w.trigger(availableNow=True) if available_now else w).start()

    try:
        queries = [started(first_arrivals(valid, expiry), write, "rows")]
        if rejected is not None:
            queries.append(started(bad, lambda b, k: overwrite_batch(b, f"{rejected.rstrip('/')}/run={run}", k), "rejected"))
    finally:
        if old is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    return queries
