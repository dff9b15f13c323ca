"""Policy queries: as-of, range count, throttle, rollback, latency, overlap, admission, links."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from embdrift import config
from embdrift.operators import policy as P
from embdrift.plans.catalog import register
from embdrift.sources import fixtures as FX

_DJ = "dj AS (SELECT queued_at, max(job_id) AS job_id FROM training_jobs WHERE trigger = 'DRIFT_ALERT' GROUP BY queued_at)"
_ASOF = f"""WITH {_DJ},
lastj AS (SELECT a.window_id, dj.job_id AS last_job, dj.queued_at AS last_train_time
          FROM alerts a ASOF LEFT JOIN dj ON a.now >= dj.queued_at),
today AS (SELECT a.window_id, count(j.job_id) AS trains_today FROM alerts a
          LEFT JOIN training_jobs j ON j.trigger = 'DRIFT_ALERT' AND j.queued_at >= date_trunc('day', a.now)
                                   AND j.queued_at < a.now
          GROUP BY a.window_id)"""


@register("asof_last_drift_job", operators=("J7",), sql=FX.with_fixtures(
    _ASOF + " SELECT window_id, last_job, last_train_time FROM lastj", "alerts", "training_jobs"))
def asof_last_drift_job(t):
    dj = FX.training_jobs(t).filter(F.col("trigger") == "DRIFT_ALERT")
    r = P.asof_last(FX.alerts(t), dj, "window_id", "now", "queued_at", "job_id", out="last_job", out_ts="last_train_time")
    return r.select("window_id", "last_job", "last_train_time")


@register("trains_since_midnight", operators=("J8",), sql=FX.with_fixtures(
    _ASOF + " SELECT window_id, trains_today FROM today", "alerts", "training_jobs"))
def trains_since_midnight(t):
    dj = FX.training_jobs(t).filter(F.col("trigger") == "DRIFT_ALERT")
    r = P.count_since_midnight(FX.alerts(t), dj, "window_id", "now", "queued_at", out="trains_today")
    return r.select("window_id", F.coalesce("trains_today", F.lit(0)).cast("long").alias("trains_today"))


@register("throttle_alerts", operators=("ST8", "J7", "J8"), sql=FX.with_fixtures(_ASOF + """,
x AS (SELECT a.*, l.last_train_time, d.trains_today, coalesce(a.linguistic_drift, 0.0) AS ling
      FROM alerts a JOIN lastj l USING (window_id) JOIN today d USING (window_id)),
y AS (SELECT window_id, embedding_drift >= 0.08 AS eh, ling >= 0.6 AS lh,
             CASE WHEN document_count < 100 THEN 'insufficient_documents'
                  WHEN NOT (embedding_drift >= 0.08) AND NOT (ling >= 0.6) THEN 'below_drift_thresholds'
                  WHEN last_train_time IS NOT NULL AND last_train_time >= now - INTERVAL 6 HOUR THEN 'cooldown_active'
                  WHEN trains_today >= 3 THEN 'daily_cap_reached'
                  ELSE 'accepted' END AS reason FROM x)
SELECT window_id, reason, reason = 'accepted' AS accepted,
       CASE WHEN reason <> 'accepted' THEN NULL WHEN eh AND lh THEN 'dual_signal_high'
            WHEN eh THEN 'embedding_drift' ELSE 'linguistic_drift' END AS priority FROM y""",
    "alerts", "training_jobs"), bench=True)
def throttle_alerts(t):
    r = P.throttle_alerts(FX.alerts(t), FX.training_jobs(t))
    return r.select("window_id", "reason", "accepted", "priority")


# Every alert delivered again after 3, 5 and 11 hours: each delivery is judged by its own time.
_AGAIN = """WITH again AS (SELECT a.* REPLACE (a.now + h * INTERVAL 1 HOUR AS now), h FROM alerts a, (VALUES (0), (3), (5), (11)) t(h)),"""


@register("throttle_alerts_redelivered", operators=("ST8", "J7", "J8"), sql=FX.with_fixtures(
    _AGAIN + _DJ + """,
x AS (SELECT a.*, dj.queued_at AS last_train_time, coalesce(a.linguistic_drift, 0.0) AS ling,
             (SELECT count(*) FROM training_jobs j WHERE j.trigger = 'DRIFT_ALERT' AND j.queued_at >= date_trunc('day', a.now)
                                                     AND j.queued_at < a.now) AS trains_today
      FROM again a ASOF LEFT JOIN dj ON a.now >= dj.queued_at)
SELECT window_id, h AS delivery, trains_today, last_train_time,
       CASE WHEN document_count < 100 THEN 'insufficient_documents'
            WHEN NOT (embedding_drift >= 0.08) AND NOT (ling >= 0.6) THEN 'below_drift_thresholds'
            WHEN last_train_time IS NOT NULL AND last_train_time >= now - INTERVAL 6 HOUR THEN 'cooldown_active'
            WHEN trains_today >= 3 THEN 'daily_cap_reached' ELSE 'accepted' END AS reason
FROM x""", "alerts", "training_jobs"))
def throttle_alerts_redelivered(t):
    again = FX.alerts(t).withColumn("delivery", F.explode(F.array(*[F.lit(h) for h in (0, 3, 5, 11)])))
    again = again.withColumn("now", F.col("now") + F.make_dt_interval(hours=F.col("delivery")))
    r = P.throttle_alerts(again, FX.training_jobs(t))
    return r.select("window_id", "delivery", "trains_today", "last_train_time", "reason")


@register("throttle_alerts_sequence", operators=("ST8", "ST10"), sql="WITH RECURSIVE " + FX.with_fixtures("""WITH
a AS MATERIALIZED (SELECT a.window_id, a.now, any_value(a.document_count) AS document_count, any_value(a.embedding_drift) >= 0.08 AS eh,
             coalesce(any_value(a.linguistic_drift), 0.0) >= 0.6 AS lh, max(j.queued_at) AS last_train_time,
             count(j.job_id) FILTER (j.queued_at >= date_trunc('day', a.now) AND j.queued_at < a.now) AS trains_today,
             row_number() OVER (ORDER BY a.now, a.window_id) AS k
      FROM alerts a LEFT JOIN training_jobs j ON j.trigger = 'DRIFT_ALERT' AND j.queued_at <= a.now GROUP BY a.window_id, a.now),
seq AS (SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS window_id, CAST(NULL AS TIMESTAMP) AS mine, CAST(NULL AS DATE) AS day, 0 AS own,
               '' AS reason
        UNION ALL
        SELECT a.k, a.window_id, CASE WHEN r.reason = 'accepted' THEN a.now ELSE seq.mine END, CAST(a.now AS DATE),
               CASE WHEN seq.day = CAST(a.now AS DATE) THEN seq.own ELSE 0 END + CASE WHEN r.reason = 'accepted' THEN 1 ELSE 0 END, r.reason
        FROM seq JOIN a ON a.k = seq.k + 1, LATERAL (SELECT
             CASE WHEN a.document_count < 100 THEN 'insufficient_documents'
                  WHEN NOT a.eh AND NOT a.lh THEN 'below_drift_thresholds'
                  WHEN greatest(coalesce(a.last_train_time, seq.mine), coalesce(seq.mine, a.last_train_time)) >= a.now - INTERVAL 6 HOUR
                    THEN 'cooldown_active'
                  WHEN a.trains_today + CASE WHEN seq.day = CAST(a.now AS DATE) THEN seq.own ELSE 0 END >= 3 THEN 'daily_cap_reached'
                  ELSE 'accepted' END AS reason) r)
SELECT window_id, reason, reason = 'accepted' AS accepted FROM seq WHERE k > 0""", "alerts", "training_jobs").removeprefix("WITH "))
def throttle_alerts_sequence(t):
    """Accepted alerts are training history for the ones after them."""
    return P.throttle_sequence(FX.alerts(t), FX.training_jobs(t)).select("window_id", "reason", "accepted")


# Test policy for the sparse request log (FIXTURES F5): 1 day frame, 5 requests, 20 %.
ROLLBACK_TEST = config.RollbackPolicy(error_rate_threshold=0.2, window_seconds=86400, min_requests=5)


def _activations(metrics):
    first = metrics.groupBy("model_version").agg(F.min("observed_at").alias("activated_at"))
    w = Window.orderBy("activated_at", "model_version")  # one row per version: tiny
    return first.select(F.col("model_version").alias("version"), "activated_at",
                        F.lag("model_version").over(w).alias("previous_version"))


@register("rollback_decisions", operators=("ST7", "W5", "A14", "W4"), sql=FX.with_fixtures("""
WITH act AS (SELECT model_version, lag(model_version) OVER (ORDER BY first_seen, model_version) AS previous_version
             FROM (SELECT model_version, min(observed_at) AS first_seen FROM request_metrics GROUP BY 1)),
m AS (SELECT *, count(*) OVER w AS request_count,
             sum(CASE WHEN status_code >= 500 THEN 1 ELSE 0 END) OVER w AS errors
      FROM request_metrics
      WINDOW w AS (PARTITION BY model_version ORDER BY observed_at RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW))
SELECT request_id, model_version, request_count,
       round(CASE WHEN request_count < 5 THEN 0.0 ELSE errors / request_count END, 6) AS error_rate,
       CASE WHEN request_count < 5 THEN 'insufficient_requests'
            WHEN errors / request_count <= 0.2 THEN 'error_rate_ok'
            WHEN previous_version IS NULL OR previous_version = model_version THEN 'no_previous_model'
            ELSE 'error_rate_exceeded' END AS reason
FROM m JOIN act USING (model_version)""", "request_metrics"))
def rollback_decisions(t):
    m = FX.request_metrics(t)
    r = P.rollback_decisions(m, _activations(m), ROLLBACK_TEST)
    return r.select("request_id", "model_version", "request_count", F.round("error_rate", 6).alias("error_rate"), "reason")


@register("latency_report", operators=("A13",), sql=FX.with_fixtures("""
SELECT model_version, count(*) AS requests,
       round(quantile_disc(latency_ms, 0.5), 3) AS p50_ms, round(quantile_disc(latency_ms, 0.95), 3) AS p95_ms,
       round(quantile_disc(latency_ms, 0.99), 3) AS p99_ms, round(avg(latency_ms), 3) AS mean_ms,
       round(min(latency_ms), 3) AS min_ms, round(max(latency_ms), 3) AS max_ms, count(*) < 100 AS p99_is_max
FROM request_metrics GROUP BY model_version""", "request_metrics"))
def latency_report(t):
    from embdrift.operators.reports import latency_report as lr
    return lr(FX.request_metrics(t), ["model_version"], "latency_ms")


def _hour_windows(t):
    e = t.events
    h = F.date_trunc("hour", "ts")
    return e.groupBy(h.alias("window_start")).agg(F.count("*").alias("document_count")).select(
        F.unix_seconds("window_start").alias("window_id"), "window_start",
        (F.col("window_start") + F.expr("INTERVAL 1 HOUR")).alias("window_end"), "document_count")


@register("linguistic_overlap", operators=("J6",), sql=FX.with_fixtures("""
WITH hw AS (SELECT epoch(date_trunc('hour', ts))::BIGINT AS window_id, date_trunc('hour', ts) AS ws,
                   date_trunc('hour', ts) + INTERVAL 1 HOUR AS we FROM events GROUP BY 1, 2, 3)
SELECT hw.window_id,
       (SELECT composite_score FROM linguistic_windows l WHERE l.window_end >= hw.ws AND l.window_start <= hw.we
        ORDER BY l.window_end DESC, l.window_start DESC, l.composite_score DESC LIMIT 1) AS linguistic_drift
FROM hw""", "linguistic_windows"))
def linguistic_overlap(t):
    r = P.latest_overlapping(_hour_windows(t), FX.linguistic_windows(t), bucket_seconds=86400)  # windows of 26 h
    return r.select("window_id", "linguistic_drift")


@register("admit_training", operators=("G5",), sql=FX.with_fixtures("""
WITH act AS (SELECT queued_at, max(job_id) AS job_id FROM training_jobs WHERE status IN ('QUEUED', 'RUNNING') GROUP BY 1),
dj AS (SELECT queued_at, max(job_id) AS job_id FROM training_jobs WHERE trigger = 'DRIFT_ALERT' GROUP BY 1),
x AS (SELECT a.window_id, a.now, act.job_id AS active_job, dj.queued_at AS recent_ts,
             a.window_id IN (SELECT window_id FROM training_jobs WHERE trigger = 'DRIFT_ALERT') AS dup
      FROM alerts a ASOF LEFT JOIN act ON a.now >= act.queued_at ASOF LEFT JOIN dj ON a.now >= dj.queued_at)
SELECT window_id, reason,
       CASE WHEN reason = 'accepted' THEN strftime(now, '%Y.%m.%d') || '-' || substr(sha256(CAST(window_id AS VARCHAR)), 1, 8) END AS model_version
FROM (SELECT *, CASE WHEN dup THEN 'window_has_job' WHEN active_job IS NOT NULL THEN 'training_in_progress'
            WHEN recent_ts IS NOT NULL AND recent_ts >= now - INTERVAL 10 MINUTE THEN 'cooldown_active'
            ELSE 'accepted' END AS reason FROM x)""", "alerts", "training_jobs"))
def admit_training(t):
    """G5; with the fixture's open jobs only the earliest alerts can be accepted."""
    return P.admit_training(FX.alerts(t), FX.training_jobs(t)).select("window_id", "reason", "model_version")


# Drift windows of one hour over the events: breached where their mean value is high.
_BREACH_SQL = """
dwin AS (SELECT date_trunc('hour', ts) AS window_start, avg(value) > 60 AS breached FROM events GROUP BY 1),
br AS (SELECT epoch(window_start)::BIGINT AS drift_window_id, window_start FROM dwin WHERE breached),
sig AS (SELECT epoch(window_start)::BIGINT AS window_id, window_start, window_end, composite_score FROM linguistic_windows),
lb AS (SELECT s.window_id, br.drift_window_id, br.window_start AS drift_window_start
       FROM sig s ASOF LEFT JOIN br ON s.window_end >= br.window_start)"""


def _drift_hours(t):
    h = F.date_trunc("hour", "ts")
    w = t.events.groupBy(h.alias("window_start")).agg((F.avg("value") > 60).alias("breached"))
    return w.withColumn("window_id", F.unix_seconds("window_start"))


def _signals(t):
    return FX.linguistic_windows(t).withColumn("window_id", F.unix_seconds("window_start"))


@register("link_signals", operators=("J14", "J13", "S7"), sql=FX.with_fixtures("WITH " + _BREACH_SQL.strip() + """,
act AS (SELECT queued_at, max(job_id) AS job_id FROM training_jobs WHERE status IN ('QUEUED', 'RUNNING') GROUP BY 1),
l AS (SELECT act.job_id AS training_job_id, s.window_id AS linguistic_window_id, lb.drift_window_id, 1.0 AS signal_weight
      FROM sig s ASOF JOIN act ON s.window_end >= act.queued_at JOIN lb ON lb.window_id = s.window_id),
st AS (SELECT training_job_id, linguistic_window_id FROM l WHERE linguistic_window_id % 172800 = 0
       UNION ALL SELECT -1, window_id FROM sig)
SELECT coalesce(l.training_job_id, st.training_job_id) AS training_job_id,
       coalesce(l.linguistic_window_id, st.linguistic_window_id) AS linguistic_window_id,
       CAST(l.drift_window_id AS VARCHAR) AS drift_window_id, coalesce(l.signal_weight, 0.5) AS signal_weight
FROM l FULL JOIN st ON st.training_job_id = l.training_job_id AND st.linguistic_window_id = l.linguistic_window_id""",
    "linguistic_windows", "training_jobs"))
def link_signals(t):
    """J14 upserted over links stored earlier: some of the same (job, window), some of other jobs."""
    sig, jobs = _signals(t), FX.training_jobs(t)
    first = P.link_signals(sig, jobs).filter(F.col("linguistic_window_id") % 172800 == 0)
    other = sig.select(F.lit(-1).cast("long").alias("training_job_id"), F.col("window_id").alias("linguistic_window_id"))
    stored = first.select("training_job_id", "linguistic_window_id").unionByName(other).select(
        "*", F.lit(None).cast("long").alias("drift_window_id"), F.lit(0.5).alias("signal_weight"))
    out = P.link_signals(sig, jobs, _drift_hours(t), stored)
    return out.withColumn("drift_window_id", F.col("drift_window_id").cast("string"))


@register("attach_latest_breach", operators=("J13",), sql=FX.with_fixtures(
    "WITH " + _BREACH_SQL.strip() + " SELECT window_id, drift_window_id, drift_window_start FROM lb", "linguistic_windows"))
def attach_latest_breach(t):
    return P.attach_latest_breach(_signals(t), _drift_hours(t)).select("window_id", "drift_window_id", "drift_window_start")


@register("linguistic_alert_payloads", operators=("S5", "J13", "J14"), sql=FX.with_fixtures("WITH " + _BREACH_SQL.strip() + """,
act AS (SELECT queued_at, max(job_id) AS job_id FROM training_jobs WHERE status IN ('QUEUED', 'RUNNING') GROUP BY 1),
top AS (SELECT day, arg_max(event_type, (n, event_type)) AS term, max(n) AS n FROM
          (SELECT epoch(date_trunc('day', ts))::BIGINT AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY day)
SELECT CAST(s.window_id AS VARCHAR) AS key,
       '{"window_id":"' || CAST(s.window_id AS VARCHAR) || '","drift_window_id":' ||
       coalesce('"' || CAST(lb.drift_window_id AS VARCHAR) || '"', 'null') || ',"training_job_id":' ||
       coalesce('"' || CAST(act.job_id AS VARCHAR) || '"', 'null') || ',"composite_score":' || CAST(s.composite_score AS VARCHAR) ||
       ',"threshold":0.05,"timestamp":"' || strftime(s.window_end, '%Y-%m-%dT%H:%M:%S') || '+00:00","new_entities":[],' ||
       '"emerging_terms":[{"term":"' || top.term || '","window_count":' || CAST(top.n AS VARCHAR) || '}]}' AS value
FROM sig s ASOF LEFT JOIN act ON s.window_end >= act.queued_at
JOIN lb ON lb.window_id = s.window_id JOIN top ON top.day = s.window_id
WHERE s.composite_score > 0.05""", "linguistic_windows", "training_jobs"))
def linguistic_alert_payloads(t):
    """S5 for breached linguistic windows, with the ids of J13 and J14 where there are any."""
    from embdrift.sources.io import linguistic_alert_payloads as payloads
    sig = _signals(t)
    links = P.link_signals(sig, FX.training_jobs(t), _drift_hours(t))
    jobs = links.select(F.col("linguistic_window_id").alias("window_id"), "training_job_id")
    n = t.events.groupBy(F.unix_seconds(F.date_trunc("day", "ts")).alias("window_id"), "event_type").agg(F.count("*").alias("n"))
    top = n.groupBy("window_id").agg(F.max(F.struct("n", "event_type")).alias("m"))
    term = F.struct(F.col("m.event_type").alias("term"), F.col("m.n").alias("window_count"))
    rep = (P.attach_latest_breach(sig, _drift_hours(t)).join(jobs, "window_id", "left").join(top, "window_id")
           .select("window_id", "drift_window_id", "training_job_id", "composite_score", F.lit(0.05).alias("threshold"),
                   F.col("window_end").alias("now"), (F.col("composite_score") > 0.05).alias("breached"),
                   F.array().cast("array<struct<text:string>>").alias("new_entities"), F.array(term).alias("emerging_terms")))
    return payloads(rep)


@register("drift_alert_payloads", operators=("S4", "ST8", "P2"), sql=FX.with_fixtures(_ASOF + """,
x AS (SELECT a.*, l.last_train_time, d.trains_today, coalesce(a.linguistic_drift, 0.0) AS ling
      FROM alerts a JOIN lastj l USING (window_id) JOIN today d USING (window_id)),
y AS (SELECT *, embedding_drift >= 0.08 AS eh, ling >= 0.6 AS lh,
             CASE WHEN document_count < 100 THEN 'insufficient_documents'
                  WHEN NOT (embedding_drift >= 0.08) AND NOT (ling >= 0.6) THEN 'below_drift_thresholds'
                  WHEN last_train_time IS NOT NULL AND last_train_time >= now - INTERVAL 6 HOUR THEN 'cooldown_active'
                  WHEN trains_today >= 3 THEN 'daily_cap_reached'
                  ELSE 'accepted' END AS reason FROM x)
SELECT 'FIVE_MIN' AS key,
       '{"window_id":"' || CAST(window_id AS VARCHAR) || '","window_size":"FIVE_MIN","drift_score":' ||
       CAST(embedding_drift AS VARCHAR) ||
       ',"linguistic_drift_score":' || coalesce(CAST(linguistic_drift AS VARCHAR), 'null') ||
       ',"threshold":0.08,"priority":"' ||
       CASE WHEN eh AND lh THEN 'dual_signal_high' WHEN eh THEN 'embedding_drift' ELSE 'linguistic_drift' END ||
       '","timestamp":"' || strftime(now, '%Y-%m-%dT%H:%M:%S') || '+00:00"}' AS value
FROM y WHERE reason = 'accepted'""", "alerts", "training_jobs"))
def drift_alert_payloads(t):
    from embdrift.sources.io import drift_alert_payloads as payloads
    r = P.throttle_alerts(FX.alerts(t), FX.training_jobs(t)).filter("accepted")
    return payloads(r.withColumnRenamed("embedding_drift", "drift_score"))
