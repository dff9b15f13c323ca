"""Policy operators: as-of (J7), range count (J8), overlap (J6), throttle (ST8),
rollback (ST7, W5, A14), admission (G5), signal links (J13, J14).

No theta joins: "latest right row at or before each left row" is a union of
both sides ordered by time inside time buckets, plus a carry-over from
earlier buckets taken from a per-bucket summary (one row per bucket).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from embdrift import config
from embdrift.session import materialize, ship_package


def _bucket(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_seconds(ts) / seconds).cast("long")


def asof_last(left: DataFrame, right: DataFrame, left_key: str, left_ts: str, right_ts: str,
              value: str, by: list[str] | None = None, inclusive: bool = True,
              bucket_seconds: int = 3600, out: str = "asof_value", out_ts: str = "asof_ts") -> DataFrame:
    """For each left row, the ``value`` of the latest right row with
    right_ts <= left_ts (``inclusive``) or < left_ts, optionally per ``by`` key.

    Within a bucket a running ``last`` over the time-ordered union answers
    it; rows whose bucket has no earlier right row take the latest right row
    of all earlier buckets from a per-bucket summary (bounded by the number
    of buckets, joined back as a small table).  Left rows travel whole through
    the union, so repeated or null keys keep a value of their own each; a row
    without a time gets no value.  Columns of ``left`` named as ``out`` or
    ``out_ts`` are replaced.
    """
    by = by or []
    kept = [c for c in left.columns if c not in (out, out_ts)]
    whole = F.struct(*[F.col(c) for c in kept])
    kind = left.select(whole.alias("_row")).schema["_row"].dataType
    L = left.select(*by, whole.alias("_row"), F.col(left_ts).alias("_ts"),
                    F.lit(0).alias("_right"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    R = right.filter(F.col(right_ts).isNotNull()).select(
        *by, F.lit(None).cast(kind).alias("_row"), F.col(right_ts).alias("_ts"), F.lit(1).alias("_right"), F.col(value).alias("_v"))
    U = L.unionByName(R).withColumn("_b", _bucket(F.col("_ts"), bucket_seconds))
    tie = F.desc("_right") if inclusive else F.asc("_right")
    # equal right timestamps: the largest value is "last" (a total order)
    w = Window.partitionBy(*by, "_b").orderBy("_ts", tie, F.asc_nulls_first("_v")).rowsBetween(
        Window.unboundedPreceding, 0)
    rv = F.when(F.col("_right") == 1, F.struct(F.col("_ts").alias("t"), F.col("_v").alias("v")))
    scanned = U.withColumn("_in", F.last(rv, ignorenulls=True).over(w)).filter(F.col("_right") == 0)
    per_bucket = right.select(*by, F.col(right_ts).alias("_ts"), F.col(value).alias("_v")).withColumn(
        "_b", _bucket(F.col("_ts"), bucket_seconds)).groupBy(*by, "_b").agg(
        F.max_by(F.struct(F.col("_ts").alias("t"), F.col("_v").alias("v")), F.struct("_ts", "_v")).alias("_m"))
    wb = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    carry = per_bucket.withColumn("_carry", F.last("_m", ignorenulls=True).over(wb)).select(
        *by, (F.col("_b") + 1).alias("_b"), "_carry")
    # carry for bucket b = latest right row in buckets < b; buckets with no right rows in
    # between are filled by the as-of over the carry table itself (small).
    lb = scanned.select(*by, "_b").distinct()
    ub = lb.select(*by, "_b", F.lit(0).alias("_c")).unionByName(
        carry.select(*by, "_b", F.lit(1).alias("_c")), allowMissingColumns=False)
    wc = Window.partitionBy(*by).orderBy("_b", F.desc("_c")).rowsBetween(Window.unboundedPreceding, 0)
    filled = (ub.join(carry, [*by, "_b"], "left")
                .withColumn("_prev", F.last("_carry", ignorenulls=True).over(wc))
                .filter(F.col("_c") == 0).select(*by, "_b", "_prev"))
    res = scanned.join(filled, [*by, "_b"], "left").withColumn("_r", F.coalesce("_in", "_prev"))
    return res.select("_row.*", F.col("_r.v").alias(out), F.col("_r.t").alias(out_ts))


def count_since_midnight(left: DataFrame, right: DataFrame, left_key: str, left_ts: str, right_ts: str,
                         out: str = "since_midnight", bucket_seconds: int = 3600) -> DataFrame:
    """Per left row, right rows with start_of_day(left_ts) <= right_ts < left_ts.

    A running count over the time-ordered union inside each (UTC day, time
    bucket), left rows first on ties (strict <), plus the right rows of the
    day's earlier buckets (a table with one row per day and bucket), so a busy
    day is many tasks.  Left rows travel whole: repeated and null keys are rows
    like others; a row without a time gets null.
    """
    whole = F.struct(*[F.col(c) for c in left.columns if c != out])
    kind = left.select(whole.alias("_row")).schema["_row"].dataType
    L = left.select(whole.alias("_row"), F.col(left_ts).alias("_ts"), F.lit(0).alias("_right"))
    R = right.filter(F.col(right_ts).isNotNull()).select(
        F.lit(None).cast(kind).alias("_row"), F.col(right_ts).alias("_ts"), F.lit(1).alias("_right"))
    U = L.unionByName(R).withColumn("_d", F.to_date("_ts")).withColumn("_b", _bucket(F.col("_ts"), bucket_seconds))
    cells = U.groupBy("_d", "_b").agg(F.sum("_right").alias("_n"))
    before = Window.partitionBy("_d").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = cells.select("_d", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_carry"))
    w = Window.partitionBy("_d", "_b").orderBy("_ts", "_right").rowsBetween(Window.unboundedPreceding, 0)
    c = U.withColumn("_in", F.sum("_right").over(w)).filter(F.col("_right") == 0).join(carry, ["_d", "_b"], "left")
    return c.select("_row.*", (F.col("_in") + F.col("_carry")).cast("long").alias(out))


def throttle_alerts(alerts: DataFrame, jobs: DataFrame, policy: config.ThrottlePolicy = config.ThrottlePolicy()) -> DataFrame:
    """ST8 (batch against recorded history): reason and priority per alert.

    Order: insufficient_documents, below_drift_thresholds, cooldown_active,
    daily_cap_reached, then accepted (dual_signal_high / embedding_drift /
    linguistic_drift).  NULL linguistic drift counts as 0.
    """
    dj = jobs.filter(F.col("trigger") == "DRIFT_ALERT").select("job_id", "queued_at")
    a = asof_last(alerts, dj, "window_id", "now", "queued_at", "job_id", out="last_job", out_ts="last_train_time")
    a = count_since_midnight(a, dj, "window_id", "now", "queued_at", out="trains_today")
    ling = F.coalesce("linguistic_drift", F.lit(0.0))
    emb_hi = F.col("embedding_drift") >= policy.min_embedding_drift
    ling_hi = ling >= policy.min_linguistic_drift
    cool = F.col("last_train_time").isNotNull() & F.lit(policy.cooldown_hours > 0) & (
        F.col("last_train_time") >= F.col("now") - F.make_dt_interval(secs=F.lit(policy.cooldown_hours * 3600.0)))
    reason = (F.when(F.col("document_count") < policy.min_documents, "insufficient_documents")
              .when(~emb_hi & ~ling_hi, "below_drift_thresholds")
              .when(cool, "cooldown_active")
              .when(F.coalesce("trains_today", F.lit(0)) >= policy.max_daily_trains, "daily_cap_reached")
              .otherwise("accepted"))
    priority = (F.when(reason != "accepted", F.lit(None).cast("string"))
                .when(emb_hi & ling_hi, "dual_signal_high").when(emb_hi, "embedding_drift")
                .otherwise("linguistic_drift"))
    return a.select("*", reason.alias("reason"), (reason == "accepted").alias("accepted"), priority.alias("priority"))


def alert_decision(last_us: int | None, today: int, now_us: int, count: int, emb: float, ling: float | None,
                   policy: config.ThrottlePolicy) -> tuple[str, str | None]:
    """ST8 for one alert: (reason, priority), given the last training and the trainings of the day."""
    emb_hi, ling_hi = emb >= policy.min_embedding_drift, (ling or 0.0) >= policy.min_linguistic_drift
    if count < policy.min_documents:
        return "insufficient_documents", None
    if not emb_hi and not ling_hi:
        return "below_drift_thresholds", None
    if last_us is not None and policy.cooldown_hours > 0 and last_us >= now_us - policy.cooldown_hours * 3_600_000_000:
        return "cooldown_active", None
    if today >= policy.max_daily_trains:
        return "daily_cap_reached", None
    return "accepted", "dual_signal_high" if emb_hi and ling_hi else "embedding_drift" if emb_hi else "linguistic_drift"


def throttle_sequence(alerts: DataFrame, jobs: DataFrame, policy: config.ThrottlePolicy = config.ThrottlePolicy(),
                      tenant_col: str | None = None) -> DataFrame:
    """ST8 where an accepted alert is training history for the ones after it, beside the recorded ``jobs``.

    Alerts count in the order (now, window_id).  What the records alone reject is decided by
    ``throttle_alerts`` in parallel; only the others meet in order.  Decisions of one tenant follow
    from each other, so its open alerts (small rows, no texts or vectors) are folded in one task.
    """
    ship_package(alerts.sparkSession)
    judged = throttle_alerts(alerts, jobs, policy)
    open_ = judged.filter("accepted")
    tenant = F.col(tenant_col).cast("string") if tenant_col else F.lit("")
    kept = [c for c in judged.columns if c not in ("reason", "accepted", "priority")]
    rows = open_.select(tenant.alias("_tenant"), F.struct(*kept).alias("_row"), "now", "window_id", "document_count",
                        F.col("embedding_drift").cast("double").alias("_emb"), F.col("linguistic_drift").cast("double").alias("_ling"),
                        F.unix_micros("now").alias("_us"), F.unix_micros("last_train_time").alias("_last"),
                        F.coalesce("trains_today", F.lit(0)).alias("_today"), F.monotonically_increasing_id().alias("_id"))
    rows = materialize(rows)  # the numbers of the rows must not change between the fold and the join

    def fold(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["_us", "window_id", "_id"])
        last, day, own, out = None, None, 0, []
        for r in pdf.itertuples(index=False, name=None):
            ident, us, _, count, emb, ling, recorded, today = r
            if day != us // 86_400_000_000:
                day, own = us // 86_400_000_000, 0
            before = [int(x) for x in (last, recorded) if x is not None and not pd.isna(x)]
            reason, priority = alert_decision(max(before, default=None), int(today) + own, us, count, emb,
                                              None if pd.isna(ling) else ling, policy)
            if reason == "accepted":
                last, own = us, own + 1
            out.append((ident, reason, priority))
        return pd.DataFrame(out, columns=["_id", "reason", "priority"])

    decided = rows.select("_tenant", "_id", "_us", "window_id", "document_count", "_emb", "_ling", "_last", "_today").groupBy("_tenant").applyInPandas(
        lambda pdf: fold(pdf[["_id", "_us", "window_id", "document_count", "_emb", "_ling", "_last", "_today"]]), "_id long, reason string, priority string")
    open_rows = rows.join(decided, "_id").select("_row.*", "reason", (F.col("reason") == "accepted").alias("accepted"), "priority")
    return judged.filter("NOT accepted").select(*open_rows.columns).unionByName(open_rows)


def rollback_decisions(metrics: DataFrame, activations: DataFrame,
                       policy: config.RollbackPolicy = config.RollbackPolicy()) -> DataFrame:
    """ST7 (batch, without clearing): a decision after every request of a version.

    Trailing frame (t − window, t] closed at both ends per version (W5),
    error rate = share of status >= 500 (A14), previous version from W4.
    Reasons in order: no_active_model, insufficient_requests, error_rate_ok,
    no_previous_model, error_rate_exceeded.
    """
    us = policy.window_seconds * 1_000_000
    # Time buckets as wide as the frame: a row's frame lies in its own bucket and the one before,
    # so every row is copied once into the next bucket, as context only.
    b = F.floor(F.unix_micros("observed_at") / us).cast("long")
    rows = metrics.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_b", b + F.col("_copy"))
    rows = rows.filter((F.col("_copy") == 0) | F.col("_b").isNotNull())  # no time: one bucket, one copy
    # Two running sums and their difference: a frame that moves at both ends is added up anew for every row.
    w = Window.partitionBy("model_version", "_b").orderBy(F.unix_micros("observed_at"))
    first = Window.unboundedPreceding

    def within(agg: Column) -> Column:
        left = F.when(F.col("observed_at").isNotNull(), agg.over(w.rangeBetween(first, -us - 1)))
        return agg.over(w.rangeBetween(first, 0)) - F.coalesce(left, F.lit(0))

    failed = F.when(F.col("status_code") >= 500, 1).otherwise(0).cast("long")
    m = rows.select("*", within(F.count("*")).alias("request_count"), within(F.sum(failed)).alias("errors"))
    m = m.filter(F.col("_copy") == 0).drop("_copy", "_b")
    m = m.join(activations.select(F.col("version").alias("model_version"), "previous_version"), "model_version", "left")
    rate = F.col("errors") / F.col("request_count")
    reason = (F.when(F.col("model_version").isNull(), "no_active_model")
              .when(F.col("request_count") < policy.min_requests, "insufficient_requests")
              .when(rate <= policy.error_rate_threshold, "error_rate_ok")
              .when(F.col("previous_version").isNull() | (F.col("previous_version") == F.col("model_version")),
                    "no_previous_model")
              .otherwise("error_rate_exceeded"))
    shown = F.when(F.col("request_count") < policy.min_requests, F.lit(0.0)).otherwise(rate)
    return m.select("*", shown.alias("error_rate"), reason.alias("reason"),
                    (reason == "error_rate_exceeded").alias("should_rollback"))


def latest_overlapping(windows: DataFrame, ling: DataFrame,
                       bucket_seconds: int = config.LINGUISTIC_WINDOW_MINUTES * 60) -> DataFrame:
    """Per window, the composite score of the newest overlapping linguistic window
    (closed ends: lw.end >= ws and lw.start <= we), via a bucketed equi-join.

    Buckets should be about as wide as the wider kind of window: then a window
    touches a few buckets and meets little else than what it overlaps."""
    def explode(df: DataFrame, s: str, e: str) -> DataFrame:
        return df.withColumn("_bk", F.explode(F.sequence(_bucket(F.col(s), bucket_seconds),
                                                         _bucket(F.col(e), bucket_seconds))))
    wl = explode(windows.select("window_id", "window_start", "window_end"), "window_start", "window_end")
    ll = explode(ling.select(F.col("window_start").alias("l_start"), F.col("window_end").alias("l_end"),
                             "composite_score"), "l_start", "l_end")
    j = wl.join(ll, "_bk").filter((F.col("l_end") >= F.col("window_start")) & (F.col("l_start") <= F.col("window_end")))
    best = j.groupBy("window_id").agg(F.max_by("composite_score", F.struct("l_end", "l_start", "composite_score"))
                                      .alias("linguistic_drift"))
    return windows.join(best, "window_id", "left")


def admit_training(alerts: DataFrame, jobs: DataFrame,
                   cooldown_minutes: int = config.RETRAIN_COOLDOWN_MINUTES) -> DataFrame:
    """Reject when the window already has a DRIFT_ALERT job, a job is
    QUEUED/RUNNING, or a DRIFT_ALERT job was queued within the cooldown."""
    dj = jobs.filter(F.col("trigger") == "DRIFT_ALERT")
    has_job = dj.select("window_id").filter("window_id IS NOT NULL").distinct().withColumn("_dup", F.lit(True))
    active = jobs.filter(F.col("status").isin("QUEUED", "RUNNING")).select("job_id", "queued_at")
    a = asof_last(alerts, active, "window_id", "now", "queued_at", "job_id", out="active_job", out_ts="active_ts")
    a = asof_last(a, dj.select("job_id", "queued_at"), "window_id", "now", "queued_at", "job_id",
                  out="recent_job", out_ts="recent_ts")
    a = a.join(has_job, "window_id", "left")
    recent = F.col("recent_ts").isNotNull() & F.lit(cooldown_minutes > 0) & (
        F.col("recent_ts") >= F.col("now") - F.make_dt_interval(mins=F.lit(cooldown_minutes)))
    reason = (F.when(F.col("_dup").isNotNull(), "window_has_job")
              .when(F.col("active_job").isNotNull(), "training_in_progress")
              .when(recent, "cooldown_active").otherwise("accepted"))
    version = F.when(reason == "accepted", F.concat(F.date_format("now", "yyyy.MM.dd"), F.lit("-"),
                                                      F.substring(F.sha2(F.col("window_id").cast("string"), 256), 1, 8)))
    return a.select(*alerts.columns, reason.alias("reason"), version.alias("model_version"))


def link_signals(signals: DataFrame, jobs: DataFrame, drift_windows: DataFrame | None = None,
                 stored: DataFrame | None = None, key: str = "window_id", ts: str = "window_end") -> DataFrame:
    """(training_job_id, linguistic_window_id, drift_window_id, signal_weight 1.0), linking each
    linguistic signal to the newest QUEUED/RUNNING job queued by then and to the latest breached
    drift window (J13; NULL without ``drift_windows``).  ``stored`` links are upserted by
    (job, window): weight and drift window are replaced, other links stay."""
    active = jobs.filter(F.col("status").isin("QUEUED", "RUNNING")).select("job_id", "queued_at")
    a = asof_last(signals, active, key, ts, "queued_at", "job_id", out="training_job_id", out_ts="job_queued_at")
    a = a.filter(F.col("training_job_id").isNotNull())
    if drift_windows is not None:
        a = attach_latest_breach(a, drift_windows, key, ts)
    else:
        a = a.withColumn("drift_window_id", F.lit(None).cast("long"))
    links = a.select("training_job_id", F.col(key).alias("linguistic_window_id"), "drift_window_id",
                     F.lit(1.0).alias("signal_weight"))
    if stored is None:
        return links
    from embdrift.operators.ingest import upsert
    return upsert(stored.select(*links.columns), links, ["training_job_id", "linguistic_window_id"])


def attach_latest_breach(signals: DataFrame, windows: DataFrame, key: str = "window_id",
                         ts: str = "window_end") -> DataFrame:
    """Latest breached drift window (by start) known when each signal is recorded."""
    br = windows.filter(F.col("breached")).select(F.col("window_id").alias("drift_window_id"), "window_start")
    return asof_last(signals, br, key, ts, "window_start", "drift_window_id",
                     out="drift_window_id", out_ts="drift_window_start")
