"""Live stateful policies with ``applyInPandasWithState`` (ST7, ST8).

Batch versions (against recorded history) live in ``operators.policy``; the
live versions differ in one respect: a decision changes the state seen by the
next event (a rollback clears the version's requests; an accepted alert
becomes training history for the next alert).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from embdrift import config
from embdrift.operators.policy import alert_decision

ROLLBACK_OUT = ("model_version string, evaluated_at timestamp, request_count long, error_rate double, "
                "reason string, should_rollback boolean")
ROLLBACK_STATE = "ts array<long>, err array<int>"


def rollback_stream(metrics: DataFrame, previous: dict[str, str | None],
                    policy: config.RollbackPolicy = config.RollbackPolicy(), idle_hours: float = 24,
                    watermark: str = "1 hour") -> DataFrame:
    """ST7 live: per model version a ring of (time, is_error) inside the trailing window.

    One decision per request (event time); on ``error_rate_exceeded`` the
    version's ring is cleared, as the reference clears its bucket after a
    rollback.  ``previous`` maps version -> previous active version (W4).
    All rows of a version in a micro-batch are ordered together before any
    decision.  State is bounded by the requests inside one window per version,
    and goes once the watermark is ``idle_hours`` past its last request.
    """
    window_us = policy.window_seconds * 1_000_000
    idle_ms = int(idle_hours * 3_600_000)

    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version = key[0]
        if state.hasTimedOut:
            state.remove()
            return
        ring = deque(zip(*state.get)) if state.exists else deque()
        errors = sum(e for _, e in ring)
        prev = previous.get(version)
        rows = []
        # Arrow hands a group over in chunks: order holds over all of them only.
        pdf = pd.concat(list(pdfs)).sort_values("observed_at", kind="stable")
        for t, code in zip(pdf["observed_at"], pdf["status_code"]):
            now = int(pd.Timestamp(t).value // 1000)
            bad = 1 if code >= 500 else 0
            ring.append((now, bad))
            errors += bad
            while ring and ring[0][0] < now - window_us:
                errors -= ring.popleft()[1]
            n = len(ring)
            rate = errors / n if n else 0.0
            if n < policy.min_requests:
                reason, rate = "insufficient_requests", 0.0
            elif rate <= policy.error_rate_threshold:
                reason = "error_rate_ok"
            elif not prev or prev == version:
                reason = "no_previous_model"
            else:
                reason = "error_rate_exceeded"
            rows.append((version, t, n, rate, reason, reason == "error_rate_exceeded"))
            if reason == "error_rate_exceeded":
                ring, errors = deque(), 0
        ts, err = [t for t, _ in ring], [e for _, e in ring]
        state.setTimeoutTimestamp(max(now // 1000, state.getCurrentWatermarkMs()) + idle_ms)
        state.update((ts, err))
        yield pd.DataFrame(rows, columns=["model_version", "evaluated_at", "request_count", "error_rate",
                                          "reason", "should_rollback"])

    return metrics.withWatermark("observed_at", watermark).groupBy("model_version").applyInPandasWithState(
        fn, ROLLBACK_OUT, ROLLBACK_STATE, "append", GroupStateTimeout.EventTimeTimeout)


THROTTLE_OUT = "tenant string, window_id long, reason string, accepted boolean, priority string"
THROTTLE_STATE = "last_train long, day long, today long"


def throttle_stream(alerts: DataFrame, policy: config.ThrottlePolicy = config.ThrottlePolicy(),
                    tenant_col: str = "tenant", idle_hours: float | None = None,
                    watermark: str = "1 hour") -> DataFrame:
    """ST8 live: alerts in event-time order per tenant; an accepted alert is
    training history for the next one.  State: last train time, UTC day and
    trains that day (three numbers per tenant), dropped once the watermark is
    ``idle_hours`` (default: two days and the cooldown) past the last alert."""
    idle_ms = int((idle_hours if idle_hours is not None else 48 + policy.cooldown_hours) * 3_600_000)

    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, day, today = state.get if state.exists else (None, None, 0)
        rows = []
        pdf = pd.concat(list(pdfs)).sort_values(["now", "window_id"])
        for r in pdf.itertuples(index=False):
            now_us = int(pd.Timestamp(r.now).value // 1000)
            d = now_us // 86_400_000_000
            if day != d:
                day, today = d, 0
            ling = 0.0 if pd.isna(r.linguistic_drift) else float(r.linguistic_drift)
            reason, prio = alert_decision(last, today, now_us, r.document_count, r.embedding_drift, ling, policy)
            if reason == "accepted":
                last, today = now_us, today + 1
            rows.append((key[0], int(r.window_id), reason, reason == "accepted", prio))
        state.setTimeoutTimestamp(max(now_us // 1000, state.getCurrentWatermarkMs()) + idle_ms)
        state.update((last, day, today))
        yield pd.DataFrame(rows, columns=["tenant", "window_id", "reason", "accepted", "priority"])

    return alerts.withWatermark("now", watermark).groupBy(tenant_col).applyInPandasWithState(
        fn, THROTTLE_OUT, THROTTLE_STATE, "append", GroupStateTimeout.EventTimeTimeout)
