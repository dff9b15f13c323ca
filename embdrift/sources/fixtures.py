"""Derived views over the driver tables (FIXTURES.md part B).

Each view exists twice: as a Spark DataFrame builder and as DuckDB SQL text
that the oracle queries use as a CTE.  Both derive every row from the given
tables, so the work grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embdrift.functions.vectors import l2_normalize
from embdrift.sources.tables import Tables

# The fixture clock origin TS0 = 2024-01-01 00:00:00 UTC.
TS0_EPOCH = 1704067200
TS0_SQL = "TIMESTAMP '2024-01-01 00:00:00'"


def _ts0_plus_seconds(seconds) -> F.Column:
    return F.timestamp_seconds(F.lit(TS0_EPOCH) + seconds)


# ---------------------------------------------------------------- F1 / F2
def embedding_arrivals(t: Tables) -> DataFrame:
    """one vector per document with the two clocks and a model version."""
    e = t.embeddings
    first = _ts0_plus_seconds(F.col("vec_id") + F.when(F.col("label") >= 5, 4000).otherwise(0))
    return e.select(
        F.col("vec_id").alias("document_id"),
        F.concat(F.lit("lab"), F.col("label").cast("string")).alias("source"),
        F.col("label"),
        F.col("embedding").cast("array<double>").alias("vector"),
        first.alias("first_embedded_at"),
        (first + F.make_dt_interval(hours=F.col("vec_id") % 7)).alias("created_at"),
        F.when(F.col("vec_id") % 3 != 0, F.lit("v1"))
        .when(F.col("vec_id") % 6 == 3, F.lit("v0"))
        .alias("model_version"),
    )


def embedding_arrivals_shifted(t: Tables) -> DataFrame:
    """F1 with a domain shift (+2 on axis 0 or 1), re-normalised."""
    a = embedding_arrivals(t)
    axis = F.when(F.col("label") < 5, 0).otherwise(1)
    shifted = F.transform("vector", lambda x, i: x + F.when(i == axis, 2.0).otherwise(0.0))
    return a.withColumn("vector", l2_normalize(shifted))


F1_SQL = f"""
SELECT vec_id AS document_id, 'lab' || CAST(label AS VARCHAR) AS source, label,
       CAST(embedding AS DOUBLE[]) AS vector,
       {TS0_SQL} + to_seconds(vec_id + CASE WHEN label >= 5 THEN 4000 ELSE 0 END) AS first_embedded_at,
       {TS0_SQL} + to_seconds(vec_id + CASE WHEN label >= 5 THEN 4000 ELSE 0 END)
                 + to_hours(vec_id % 7) AS created_at,
       CASE WHEN vec_id % 3 <> 0 THEN 'v1' WHEN vec_id % 6 = 3 THEN 'v0' END AS model_version
FROM embeddings"""

F2_SQL = """
SELECT document_id, source, label, first_embedded_at, created_at, model_version,
       list_transform(sv, lambda x: x / CASE WHEN nrm = 0 THEN 1.0 ELSE nrm END) AS vector
FROM (
  SELECT *, sqrt(list_sum(list_transform(sv, lambda y: y * y))) AS nrm
  FROM (
    SELECT *, list_transform(vector, lambda x, i:
             x + CASE WHEN i = (CASE WHEN label < 5 THEN 1 ELSE 2 END) THEN 2.0 ELSE 0.0 END) AS sv
    FROM embedding_arrivals))"""


# ---------------------------------------------------------------- F3 / F4
def docs(t: Tables) -> DataFrame:
    """documents with an external id and the two document clocks."""
    d = t.documents
    occurred = _ts0_plus_seconds(F.col("doc_id") * 60)
    return d.select(
        F.col("doc_id").alias("id"),
        F.col("doc_id").cast("string").alias("external_id"),
        "text", "source", "lang",
        occurred.alias("occurred_at"),
        (occurred + F.expr("INTERVAL 30 SECONDS")).alias("ingested_at"),
    )


F3_SQL = f"""
SELECT doc_id AS id, CAST(doc_id AS VARCHAR) AS external_id, text, source, lang,
       {TS0_SQL} + to_seconds(doc_id * 60) AS occurred_at,
       {TS0_SQL} + to_seconds(doc_id * 60 + 30) AS ingested_at
FROM documents"""


def incoming_docs(t: Tables) -> DataFrame:
    """the ingest stream replayed: originals, exact re-sends, re-sends
    with a new timestamp and empty payloads.  ``arrival`` orders them."""
    d = docs(t)
    base = d.select("external_id", "text", "source", "occurred_at",
                    (F.col("id") * 4).alias("arrival"))
    resend = d.filter(F.col("id") % 10 == 0).select(
        "external_id", "text", "source", "occurred_at", (F.col("id") * 4 + 1).alias("arrival"))
    moved = d.filter(F.col("id") % 10 == 1).select(
        "external_id", "text", "source",
        (F.col("occurred_at") + F.expr("INTERVAL 1 SECOND")).alias("occurred_at"),
        (F.col("id") * 4 + 2).alias("arrival"))
    empty = d.filter(F.col("id") % 50 == 2).select(
        "external_id", F.lit("").alias("text"), "source",
        (F.col("occurred_at") + F.expr("INTERVAL 2 SECONDS")).alias("occurred_at"),
        (F.col("id") * 4 + 3).alias("arrival"))
    return base.unionByName(resend).unionByName(moved).unionByName(empty)


F4_SQL = """
SELECT external_id, text, source, occurred_at, id * 4 AS arrival FROM docs
UNION ALL SELECT external_id, text, source, occurred_at, id * 4 + 1 FROM docs WHERE id % 10 = 0
UNION ALL SELECT external_id, text, source, occurred_at + INTERVAL 1 SECOND, id * 4 + 2 FROM docs WHERE id % 10 = 1
UNION ALL SELECT external_id, '', source, occurred_at + INTERVAL 2 SECOND, id * 4 + 3 FROM docs WHERE id % 50 = 2"""


# ---------------------------------------------------------------- F5
def request_metrics(t: Tables) -> DataFrame:
    """serving request log derived from events."""
    e = t.events
    return e.select(
        F.col("event_id").alias("request_id"),
        F.concat(F.lit("v"), (F.col("user_id") % 4).cast("string")).alias("model_version"),
        F.when(F.col("event_type") == "error", 503).otherwise(200).alias("status_code"),
        F.col("value").alias("latency_ms"),
        F.col("ts").alias("observed_at"),
    )


F5_SQL = """
SELECT event_id AS request_id, 'v' || CAST(user_id % 4 AS VARCHAR) AS model_version,
       CASE WHEN event_type = 'error' THEN 503 ELSE 200 END AS status_code,
       value AS latency_ms, ts AS observed_at
FROM events"""


# ---------------------------------------------------------------- F6 / F7
def training_jobs(t: Tables) -> DataFrame:
    """training job history derived from orders."""
    o = t.orders
    return o.select(
        F.col("o_orderkey").alias("job_id"),
        F.col("o_custkey").alias("window_id"),
        F.when(F.col("o_orderpriority").startswith("1"), "DRIFT_ALERT").otherwise("MANUAL").alias("trigger"),
        F.when(F.col("o_orderstatus") == "F", "SUCCEEDED")
        .when(F.col("o_orderstatus") == "O", "QUEUED")
        .when(F.col("o_orderstatus") == "P", "RUNNING").alias("status"),
        (F.col("o_orderdate") + F.make_dt_interval(secs=(F.col("o_orderkey") * 7919) % 86400)).alias("queued_at"),
    )


F6_SQL = """
SELECT o_orderkey AS job_id, o_custkey AS window_id,
       CASE WHEN starts_with(o_orderpriority, '1') THEN 'DRIFT_ALERT' ELSE 'MANUAL' END AS trigger,
       CASE o_orderstatus WHEN 'F' THEN 'SUCCEEDED' WHEN 'O' THEN 'QUEUED' WHEN 'P' THEN 'RUNNING' END AS status,
       o_orderdate + to_seconds((o_orderkey * 7919) % 86400) AS queued_at
FROM orders"""


def alerts(t: Tables) -> DataFrame:
    """breached-window alerts awaiting the throttle (2-HIGH orders)."""
    o = t.orders.filter(F.col("o_orderpriority") == "2-HIGH")
    return o.select(
        F.col("o_orderkey").alias("window_id"),
        (F.col("o_orderdate") + F.expr("INTERVAL 12 HOURS")).alias("now"),
        (F.col("o_custkey") % 300).alias("document_count"),
        ((F.col("o_orderkey") % 20) / 100.0).alias("embedding_drift"),
        F.when(F.col("o_orderkey") % 5 != 0, (F.col("o_custkey") % 100) / 100.0).alias("linguistic_drift"),
    )


F7_SQL = """
SELECT o_orderkey AS window_id, o_orderdate + INTERVAL 12 HOUR AS now,
       o_custkey % 300 AS document_count,
       (o_orderkey % 20) / 100.0 AS embedding_drift,
       CASE WHEN o_orderkey % 5 <> 0 THEN (o_custkey % 100) / 100.0 END AS linguistic_drift
FROM orders WHERE o_orderpriority = '2-HIGH'"""


# ---------------------------------------------------------------- F8
def linguistic_windows(t: Tables) -> DataFrame:
    """F8: one scored text window per day of events, 26 h wide (overlapping)."""
    e = t.events
    day = F.date_trunc("day", "ts")
    g = e.groupBy(day.alias("window_start")).agg(
        F.round(F.avg("value") / F.max("value"), 6).alias("composite_score"),
        F.count("*").alias("document_count"))
    return g.select(
        "window_start",
        (F.col("window_start") + F.expr("INTERVAL 26 HOURS")).alias("window_end"),
        "composite_score", "document_count")


F8_SQL = """
SELECT date_trunc('day', ts) AS window_start,
       date_trunc('day', ts) + INTERVAL 26 HOUR AS window_end,
       round(avg(value) / max(value), 6) AS composite_score,
       count(*) AS document_count
FROM events GROUP BY 1"""


# ---------------------------------------------------------------- F9
def pair_vectors(t: Tables) -> DataFrame:
    """query vector i is a blend of document i and document i+1 (mod n)."""
    e = t.embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    n = e.agg(F.count("*")).scalar()
    shifted = e.select(((F.col("vec_id") + n - 1) % n).alias("vec_id"), F.col("v").alias("v_next"))
    j = e.join(shifted, "vec_id")
    w = F.lit(0.1) + F.lit(0.1) * (F.col("vec_id") % 10)
    blend = F.zip_with("v", "v_next", lambda a, b: a * w + b)
    return j.select(
        F.col("vec_id").alias("item_id"),
        F.concat(F.lit("lab"), F.col("label").cast("string")).alias("source"),
        l2_normalize(blend).alias("query_vector"),
        F.col("v").alias("doc_vector"),
    )


F9_SQL = """
SELECT item_id, source, doc_vector,
       list_transform(qv, lambda x: x / CASE WHEN nrm = 0 THEN 1.0 ELSE nrm END) AS query_vector
FROM (
  SELECT *, sqrt(list_sum(list_transform(qv, lambda y: y * y))) AS nrm
  FROM (
    SELECT a.vec_id AS item_id, 'lab' || CAST(a.label AS VARCHAR) AS source,
           CAST(a.embedding AS DOUBLE[]) AS doc_vector,
           list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])),
                          lambda p: p[1] * (0.1 + 0.1 * (a.vec_id % 10)) + p[2]) AS qv
    FROM embeddings a
    JOIN embeddings b ON b.vec_id = (a.vec_id + 1) % (SELECT count(*) FROM embeddings)))"""


# ---------------------------------------------------------------- F10
def model_events(t: Tables) -> DataFrame:
    """model registry events derived from orders.

    Each customer is one registry, each order one model version.  A version
    is registered (TRAINING) at its order date; a day later it is evaluated:
    status F -> activated (ACTIVE), O -> PASSED, P -> REJECTED.
    """
    o = t.orders
    version = F.concat(F.lit("m"), F.col("o_orderkey").cast("string"))
    trained = o.select(
        F.col("o_custkey").alias("registry"), version.alias("version"),
        F.lit("TRAINING").alias("status"), F.col("o_orderdate").alias("ts"),
        F.lit(0).alias("seq"))
    decided = o.select(
        F.col("o_custkey").alias("registry"), version.alias("version"),
        F.when(F.col("o_orderstatus") == "F", "ACTIVE")
        .when(F.col("o_orderstatus") == "O", "PASSED").otherwise("REJECTED").alias("status"),
        (F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("ts"),
        F.lit(1).alias("seq"))
    return trained.unionByName(decided)


F10_SQL = """
SELECT o_custkey AS registry, 'm' || CAST(o_orderkey AS VARCHAR) AS version, 'TRAINING' AS status,
       o_orderdate AS ts, 0 AS seq FROM orders
UNION ALL
SELECT o_custkey, 'm' || CAST(o_orderkey AS VARCHAR),
       CASE o_orderstatus WHEN 'F' THEN 'ACTIVE' WHEN 'O' THEN 'PASSED' ELSE 'REJECTED' END,
       o_orderdate + INTERVAL 1 DAY, 1 FROM orders"""


FIXTURE_SQL = {
    "embedding_arrivals": F1_SQL,
    "embedding_arrivals_shifted": F2_SQL,
    "docs": F3_SQL,
    "incoming_docs": F4_SQL,
    "request_metrics": F5_SQL,
    "training_jobs": F6_SQL,
    "alerts": F7_SQL,
    "linguistic_windows": F8_SQL,
    "pair_vectors": F9_SQL,
    "model_events": F10_SQL,
}

# Views some fixtures are defined over (CTE order matters).
_DEPENDS = {
    "embedding_arrivals_shifted": ["embedding_arrivals"],
    "incoming_docs": ["docs"],
}


def with_fixtures(sql: str, *names: str) -> str:
    """Prefix ``sql`` with CTEs for the named fixture views (and their inputs).

    ``sql`` may itself start with ``WITH``; its CTEs are appended after ours.
    """
    order: list[str] = []

    def add(n: str) -> None:
        for dep in _DEPENDS.get(n, []):
            add(dep)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    ctes = ",\n".join(f"{n} AS ({FIXTURE_SQL[n]})" for n in order)
    body = sql.strip()
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"
