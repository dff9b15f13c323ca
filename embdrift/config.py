"""Policy parameters.  Defaults are fixed values of the reference deployment."""

from __future__ import annotations

from dataclasses import dataclass


# Fixed values (must equal the reference for equal results).
DRIFT_THRESHOLD = 0.08             # deployment threshold for embedding drift
DRIFT_WINDOW_SECONDS = 40          # short tumbling window, labelled FIVE_MIN
LONG_WINDOW_SECONDS = 3600         # sliding hour window, labelled ONE_HOUR
LONG_WINDOW_SLIDE_SECONDS = 60
MIN_DOCUMENTS = 100                # drift_trigger_min_documents
BOOTSTRAP_VECTORS = 100            # first N vectors form the bootstrap baseline
LINGUISTIC_THRESHOLD = 0.65
LINGUISTIC_WINDOW_MINUTES = 2
QUERY_WORDS = 15
MIN_DOCUMENT_WORDS = 40
MIN_EVALUATION_PAIRS = 8
ACTIVATION_MIN_IMPROVEMENT = 0.10
RETRAIN_COOLDOWN_MINUTES = 10
RETENTION_EMBEDDINGS_DAYS = 90
RETENTION_WINDOWS_DAYS = 30
RETENTION_JOBS_DAYS = 365
GAIN_EXACT = 2.0
GAIN_RELATED = 1.0


@dataclass(frozen=True)
class ThrottlePolicy:
    min_documents: int = 100
    min_embedding_drift: float = 0.08
    min_linguistic_drift: float = 0.60
    cooldown_hours: float = 6.0
    max_daily_trains: int = 3


@dataclass(frozen=True)
class RollbackPolicy:
    error_rate_threshold: float = 0.05
    window_seconds: int = 300
    min_requests: int = 100


@dataclass(frozen=True)
class RetentionPolicy:
    embeddings_days: int = RETENTION_EMBEDDINGS_DAYS
    windows_days: int = RETENTION_WINDOWS_DAYS
    jobs_days: int = RETENTION_JOBS_DAYS


@dataclass(frozen=True)
class LinguisticWeights:
    entity: float = 0.35
    topic: float = 0.35
    vocabulary: float = 0.30
