"""Embedding-drift queries: window centroids, baseline, score, breach."""

from __future__ import annotations

from pyspark.sql import functions as F

from embdrift.operators import centroid as C
from embdrift.operators import drift as D
from embdrift.operators import windows as W
from embdrift.plans.catalog import register
from embdrift.sources import fixtures as FX

_R = 6  # decimals kept for float comparison


# Long-form vector helpers for the oracle: one row per (row, dimension).
_EX = """ex AS (SELECT document_id, first_embedded_at, unnest(vector) AS x,
                      generate_subscripts(vector, 1) AS i FROM {src})"""
_BASE = """b_ids AS (SELECT document_id FROM {src} ORDER BY first_embedded_at, document_id LIMIT 100),
base AS (SELECT i, avg(x) AS b FROM ex WHERE document_id IN (SELECT document_id FROM b_ids) GROUP BY i
         HAVING (SELECT count(*) FROM b_ids) >= 100)"""


def _windows_sql(width: int, slide: int | None) -> str:
    """CTE ``wdim(ws, i, c, n)``: per-window, per-dimension means over ``ex``."""
    if not slide or slide == width:
        return f"""wdim AS (SELECT time_bucket(INTERVAL '{width} seconds', first_embedded_at, TIMESTAMP '1970-01-01') AS ws,
                i, avg(x) AS c, count(*) AS n FROM ex GROUP BY 1, 2)"""
    return f"""rw AS (SELECT ex.*, TIMESTAMP '1970-01-01'
                   + to_seconds(CAST(floor(epoch(first_embedded_at) / {slide}) * {slide} - k * {slide} AS BIGINT)) AS ws
            FROM ex, range(0, {width // slide}) t(k)),
wdim AS (SELECT ws, i, avg(x) AS c, count(*) AS n FROM rw GROUP BY 1, 2)"""


def _scored_sql(src: str, width: int, slide: int | None, label: str, threshold: float = 0.08) -> str:
    """CTEs up to ``scored_{label}``: the densified, scored windows of one size."""
    step = slide or width
    return f"""{_windows_sql(width, slide).replace('wdim', f'wdim_{label}').replace('rw AS', f'rw_{label} AS').replace('FROM rw ', f'FROM rw_{label} ')},
wsc_{label} AS (SELECT ws, max(n) AS document_count,
               sum(c * b) / (sqrt(sum(c * c)) * sqrt(sum(b * b))) AS cs
        FROM wdim_{label} JOIN base USING (i) GROUP BY ws),
grid_{label} AS (SELECT unnest(generate_series((SELECT min(ws) FROM wsc_{label}), (SELECT max(ws) FROM wsc_{label}),
                                       INTERVAL '{step} seconds')) AS ws),
scored_{label} AS (
SELECT '{label}' AS window_size, grid_{label}.ws AS window_start,
       grid_{label}.ws + INTERVAL '{width} seconds' AS window_end,
       CAST(coalesce(document_count, 0) AS BIGINT) AS document_count,
       CASE WHEN document_count IS NULL THEN 0.0 WHEN cs IS NOT NULL THEN least(1 - cs, 1.0) END AS drift_score,
       coalesce(CASE WHEN cs IS NOT NULL THEN least(1 - cs, 1.0) END > {threshold}, false) AS breached
FROM grid_{label} LEFT JOIN wsc_{label} USING (ws))"""


def _drift_sql(src: str, width: int, slide: int | None = None, label: str = "FIVE_MIN") -> str:
    return FX.with_fixtures(f"""
WITH {_EX.format(src=src)},
{_BASE.format(src=src)},
{_scored_sql(src, width, slide, label)}
SELECT window_size, window_start, window_end, document_count, round(drift_score, 6) AS drift_score, breached
FROM scored_{label}""", "embedding_arrivals", src)


def _drift(t, src_builder, width=40, slide=None):
    emb = src_builder(t)
    r = D.drift_report(emb, width_seconds=width, slide_seconds=slide)
    return r.select("window_size", "window_start", "window_end", "document_count",
                    F.round("drift_score", _R).alias("drift_score"), "breached")


@register("drift_windows_shifted", sql=_drift_sql("embedding_arrivals_shifted", 40),
          operators=("ST1", "ST5", "A1", "A2", "J16", "P9", "P10", "P11", "P12"), bench=True)
def drift_windows_shifted(t):
    """Flagship: tumbling 40 s drift windows over the shifted arrivals."""
    return _drift(t, FX.embedding_arrivals_shifted)


@register("drift_windows_raw", sql=_drift_sql("embedding_arrivals", 40),
          operators=("ST1", "ST5", "A1", "A2", "P10"))
def drift_windows_raw(t):
    return _drift(t, FX.embedding_arrivals)


@register("drift_windows_sliding", sql=_drift_sql("embedding_arrivals_shifted", 3600, 60, "ONE_HOUR"),
          operators=("ST2", "ST5", "A1", "P10"), bench=True)
def drift_windows_sliding(t):
    """ONE_HOUR windows sliding by one minute (pane pre-aggregation, no 60x row copies)."""
    return _drift(t, FX.embedding_arrivals_shifted, 3600, 60)


@register("drift_windows_daily", sql=_drift_sql("embedding_arrivals_shifted", 86400, None, "TWENTY_FOUR_HOURS"),
          operators=("ST3",))
def drift_windows_daily(t):
    return _drift(t, FX.embedding_arrivals_shifted, 86400)


@register("baseline_selection", operators=("A3",), sql=FX.with_fixtures(f"""
WITH {_EX.format(src="embedding_arrivals_shifted")},
{_windows_sql(3600, 60)},
cnt AS (SELECT ws, max(n) AS document_count FROM wdim GROUP BY ws HAVING max(n) >= 100 ORDER BY ws LIMIT 1)
SELECT ws AS window_start, document_count, CAST(i - 1 AS INTEGER) AS dim, round(c, 6) AS value FROM cnt JOIN wdim USING (ws)""", "embedding_arrivals", "embedding_arrivals_shifted"))
def baseline_selection(t):
    w = W.drift_windows(FX.embedding_arrivals_shifted(t), 3600, 60)
    b = D.select_baseline(w, min_documents=100)
    return b.select(F.to_timestamp(F.substring_index("baseline_id", "@", -1)).alias("window_start"),
                    "document_count", F.posexplode("centroid").alias("dim", "value")).withColumn(
        "value", F.round("value", 6))


@register("source_centroids", operators=("A1",), sql=FX.with_fixtures("""
SELECT source, CAST(i - 1 AS INTEGER) AS dim, round(avg(x), 9) AS value, count(*) AS document_count
FROM (SELECT source, unnest(vector) AS x, generate_subscripts(vector, 1) AS i FROM embedding_arrivals)
GROUP BY source, i""", "embedding_arrivals"))
def source_centroids(t):
    c = C.centroid(FX.embedding_arrivals(t), ["source"])
    return c.select("source", F.posexplode("centroid").alias("dim", "value"), "document_count").select(
        "source", "dim", F.round("value", 9).alias("value"), "document_count")


@register("vector_literals", operators=("P8",), sql=FX.with_fixtures("""
SELECT document_id, lit AS literal, round(list_sum(CAST(lit AS DOUBLE[])), 6) AS roundtrip_sum
FROM (SELECT document_id, '[' || array_to_string(list_transform(vector, lambda x: printf('%.8f', x)), ',') || ']' AS lit
      FROM embedding_arrivals)""", "embedding_arrivals"))
def vector_literals(t):
    from embdrift.functions.vectors import format_vector, parse_vector
    e = FX.embedding_arrivals(t).select("document_id", format_vector("vector").alias("literal"))
    return e.select("document_id", "literal",
                    F.round(F.aggregate(parse_vector("literal"), F.lit(0.0), lambda a, x: a + x), 6).alias("roundtrip_sum"))


@register("align_window_end", operators=("P11",), sql="""
SELECT event_id, TIMESTAMP '1970-01-01' + to_seconds(CAST(floor(epoch(ts) / 40) * 40 AS BIGINT)) AS aligned_40s,
       TIMESTAMP '1970-01-01' + to_seconds(CAST(floor(epoch(ts) / 60) * 60 AS BIGINT)) AS aligned_minute
FROM events""")
def align_window_end(t):
    from embdrift.functions.text import align_floor
    e = t.events
    return e.select("event_id", align_floor("ts", 40).alias("aligned_40s"), align_floor("ts", 60).alias("aligned_minute"))


@register("drift_summary", operators=("T2", "A4"), sql=FX.with_fixtures(f"""
WITH {_EX.format(src="embedding_arrivals_shifted")},
{_BASE.format(src="embedding_arrivals_shifted")},
{_scored_sql("embedding_arrivals_shifted", 40, None, "FIVE_MIN")},
{_scored_sql("embedding_arrivals_shifted", 3600, 60, "ONE_HOUR")},
allw AS (SELECT * FROM scored_FIVE_MIN UNION ALL SELECT * FROM scored_ONE_HOUR),
newest AS (SELECT * FROM allw WHERE document_count > 0 ORDER BY window_start DESC, window_size DESC LIMIT 1)
SELECT (SELECT count(*) FROM documents) AS total_documents, (SELECT count(*) FROM embeddings) AS total_embeddings,
       window_size AS latest_window_size, window_start AS latest_window_start,
       round(drift_score, 6) AS latest_drift_score, coalesce(breached, false) AS latest_breached, 0.08 AS threshold
FROM newest""", "embedding_arrivals", "embedding_arrivals_shifted"))
def drift_summary(t):
    emb = FX.embedding_arrivals_shifted(t)
    short = D.drift_report(emb, 40)
    long = D.drift_report(emb, 3600, 60)
    return D.drift_summary(t.embeddings, t.documents, short.unionByName(long))
