"""Governance: retention (G1), constraint audit (G2), registry fold (G3),
activation effects (G4, W4), artifact audit (P16), listings (T1, T3, T4, A4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from embdrift import config
from embdrift.session import materialize
from embdrift.operators.policy import asof_last


# ------------------------------------------------------------------ G1
def apply_retention(tables: dict[str, tuple[DataFrame, str, int]], now) -> dict[str, DataFrame]:
    """G1: keep rows younger than each table's age limit (``{name: (df, ts_col, days)}``).

    Returns the kept frames; ``retention_counts`` reports deleted/kept per table.
    A date-partitioned table is pruned at the scan (the predicate is on the
    partition column); plain files are filtered.
    """
    now_c = now if isinstance(now, Column) else F.lit(now).cast("timestamp")
    return {name: df.filter(F.col(ts) >= now_c - F.make_dt_interval(days=F.lit(days)))
            for name, (df, ts, days) in tables.items()}


def retention_counts(tables: dict[str, tuple[DataFrame, str, int]], now) -> DataFrame:
    now_c = now if isinstance(now, Column) else F.lit(now).cast("timestamp")
    parts = []
    for name, (df, ts, days) in tables.items():
        keep = F.col(ts) >= now_c - F.make_dt_interval(days=F.lit(days))
        parts.append(df.agg(F.lit(name).alias("table_name"), F.lit(days).alias("max_age_days"),
                            F.sum((~keep).cast("long")).alias("deleted"), F.sum(keep.cast("long")).alias("kept")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def null_out_missing(children: DataFrame, parents: DataFrame, fk: str, pk: str) -> DataFrame:
    """FK SET NULL after a purge: references to deleted parents become NULL."""
    alive = parents.select(F.col(pk).alias("_pk")).distinct().withColumn("_alive", F.lit(True))
    j = children.join(alive, children[fk] == alive["_pk"], "left")
    return j.withColumn(fk, F.when(F.col("_alive"), F.col(fk))).drop("_pk", "_alive")


def cascade(children: DataFrame, parents: DataFrame, fk: str, pk: str) -> DataFrame:
    """FK CASCADE after a purge: rows of deleted parents go (a NULL reference stays)."""
    alive = parents.select(F.col(pk).alias(fk)).distinct()
    return children.filter(F.col(fk).isNull()).unionByName(
        children.filter(F.col(fk).isNotNull()).join(alive, fk, "left_semi").select(*children.columns))


def purge(embeddings: DataFrame, drift_windows: DataFrame, linguistic_windows: DataFrame, jobs: DataFrame,
          signals: DataFrame, now, policy: config.RetentionPolicy = config.RetentionPolicy()) -> dict[str, DataFrame]:
    """G1 with its foreign keys: the five tables after retention.

    embeddings (created_at), drift_windows and linguistic_windows (created_at),
    training_jobs (queued_at) lose rows past their age; a drift window's
    baseline_id and a job's drift_window_id become NULL where their window
    went; signals go with their job or linguistic window and lose the
    reference to a deleted drift window.
    """
    kept = apply_retention({
        "embeddings": (embeddings, "created_at", policy.embeddings_days),
        "drift_windows": (drift_windows, "created_at", policy.windows_days),
        "linguistic_windows": (linguistic_windows, "created_at", policy.windows_days),
        "training_jobs": (jobs, "queued_at", policy.jobs_days)}, now)
    dw, lw, tj = kept["drift_windows"], kept["linguistic_windows"], kept["training_jobs"]
    kept["drift_windows"] = null_out_missing(dw, dw.select(F.col("drift_window_id").alias("_id")), "baseline_id", "_id")
    kept["training_jobs"] = null_out_missing(tj, dw.select(F.col("drift_window_id").alias("_id")), "drift_window_id", "_id")
    s = cascade(signals, tj, "training_job_id", "job_id") if "job_id" in tj.columns else signals
    s = cascade(s, lw, "linguistic_window_id", "linguistic_window_id")
    kept["training_linguistic_signals"] = null_out_missing(
        s, dw.select(F.col("drift_window_id").alias("_id")), "drift_window_id", "_id")
    return kept


def purge_counts(before: dict[str, DataFrame], after: dict[str, DataFrame], refs: dict[str, str]) -> DataFrame:
    """Per table: rows deleted, kept, and references set NULL in the column ``refs`` names."""
    out = None
    for name, df in after.items():
        ref = refs.get(name)
        null = F.count(ref) if ref else F.lit(0)
        b = before[name].agg(F.count("*").alias("n0"), null.alias("r0"))
        # Kept rows are compared with the same rows before the purge.
        a = df.agg(F.count("*").alias("n1"), null.alias("r1"))
        part = b.select(F.lit(name).alias("table_name"), "n0", "r0", a.select("n1").scalar().alias("n1"),
                        a.select("r1").scalar().alias("r1"))
        out = part if out is None else out.unionByName(part)
    return out.select("table_name", (F.col("n0") - F.col("n1")).alias("deleted"), F.col("n1").alias("kept"),
                      F.col("r1").cast("long").alias("references_left"))


# ------------------------------------------------------------------ G2
def audit_rules(df: DataFrame, table: str, rules: dict[str, Column]) -> DataFrame:
    """One pass per table; each rule is a Column that is TRUE for a violation."""
    aggs = [F.sum(F.coalesce(c, F.lit(False)).cast("long")).alias(n) for n, c in rules.items()]
    wide = df.agg(*aggs)
    stack = ", ".join(f"'{n}', `{n}`" for n in rules)
    return wide.select(F.lit(table).alias("table_name"),
                       F.expr(f"stack({len(rules)}, {stack}) AS (rule, violations)"))


def audit_unique(df: DataFrame, table: str, keys: list[str], rule: str) -> DataFrame:
    """G2 uniqueness: rows beyond the first per key (map-side combined counts)."""
    c = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return c.agg(F.lit(table).alias("table_name"), F.lit(rule).alias("rule"),
                 F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("violations"))


def audit_fk(children: DataFrame, parents: DataFrame, fk: str, pk: str, table: str, rule: str) -> DataFrame:
    """G2 FK presence: non-NULL references without a parent (anti join)."""
    orphans = children.filter(F.col(fk).isNotNull()).join(
        parents.select(F.col(pk).alias(fk)), fk, "left_anti")
    return orphans.agg(F.lit(table).alias("table_name"), F.lit(rule).alias("rule"),
                       F.count("*").alias("violations"))


# ------------------------------------------------------------------ G3 / W4 / G4
VALID_FOR_ACTIVATION = ("PASSED", "ACTIVE")


def registry_state(events: DataFrame) -> DataFrame:
    """Current status per version (latest (ts, seq) event); of the versions
    whose latest event is ACTIVE, only the newest activation per registry stays
    ACTIVE, earlier ones read PASSED (the activation demoted them)."""
    cur = events.groupBy("registry", "version").agg(
        F.max_by(F.struct("status", "ts"), F.struct("ts", "seq")).alias("s"))
    cur = cur.select("registry", "version", F.col("s.status").alias("status"), F.col("s.ts").alias("status_ts"))
    act = cur.filter(F.col("status") == "ACTIVE").groupBy("registry").agg(
        F.max_by("version", F.struct("status_ts", "version")).alias("_active"))
    j = cur.join(act, "registry", "left")
    st = F.when((F.col("status") == "ACTIVE") & (F.col("version") != F.col("_active")), "PASSED").otherwise(F.col("status"))
    return j.select("registry", "version", st.alias("status"), "status_ts")


def activation_history(events: DataFrame) -> DataFrame:
    """Previous active version before each activation, only when different."""
    act = events.filter(F.col("status") == "ACTIVE").select("registry", "version", F.col("ts").alias("activated_at"))
    w = Window.partitionBy("registry").orderBy("activated_at", "version")
    prev = F.lag("version").over(w)
    return act.select("*", F.when(prev != F.col("version"), prev).alias("previous_version"))


def activation_events(requests: DataFrame, events: DataFrame) -> DataFrame:
    """Activation requests -> emitted status events.

    A request is valid if the version's status at that time is PASSED or
    ACTIVE; it emits (version, ACTIVE) and (previous active, PASSED), the
    previous active being the latest activation (recorded or requested) before it.
    """
    st = events.select("registry", "version", F.struct("ts", "seq", "status").alias("e"))
    # A request is named by its own values, so that every evaluation of the plan agrees.
    req = requests.select("registry", "version", "ts").distinct().withColumn(
        "_rid", F.to_json(F.struct("registry", "version", "ts")))
    # status of the requested version as of the request
    per_version = asof_last(req.select("_rid", "registry", "version", "ts"),
                            st.select("registry", "version", F.col("e.ts").alias("ets"), F.col("e.status").alias("status")),
                            "_rid", "ts", "ets", "status", by=["registry", "version"], out="status_then")
    valid = per_version.filter(F.col("status_then").isin(*VALID_FOR_ACTIVATION)).select("_rid", "registry", "version", "ts")
    valid = materialize(valid)  # asks and answers below
    acts = events.filter(F.col("status") == "ACTIVE").select("registry", "version", F.col("ts").alias("ats")).unionByName(
        valid.select("registry", "version", F.col("ts").alias("ats")))
    prev = asof_last(valid, acts.withColumnRenamed("version", "prev_version"), "_rid", "ts", "ats", "prev_version",
                     by=["registry"], inclusive=False, out="previous_active")
    # Both events of a request from one pass over its row.
    off = F.when(F.col("previous_active") != F.col("version"), F.struct(F.col("previous_active").alias("version"), F.lit("PASSED").alias("status")))
    both = F.array(F.struct("version", F.lit("ACTIVE").alias("status")), off)
    return (prev.select("registry", "ts", F.explode(both).alias("e")).filter(F.col("e").isNotNull())
                .select("registry", "e.version", "e.status", "ts", F.lit(2).alias("seq")))


def rollback_events(decisions: DataFrame) -> DataFrame:
    """G4, rollback branch: per decision to roll back, the failed version becomes ARCHIVED and the
    previous one ACTIVE, both at the time of the decision.

    ``decisions``: registry, model_version, previous_version, observed_at,
    should_rollback; a previous version that no longer exists (NULL) stops it.
    """
    d = decisions.filter(F.col("should_rollback") & F.col("previous_version").isNotNull())
    pair = F.array(F.struct(F.col("model_version").alias("version"), F.lit("ARCHIVED").alias("status")),
                   F.struct(F.col("previous_version").alias("version"), F.lit("ACTIVE").alias("status")))
    return d.select("registry", F.col("observed_at").alias("ts"), F.explode(pair).alias("e")).select(
        "registry", "e.version", "e.status", "ts", F.lit(3).alias("seq"))


# ------------------------------------------------------------------ P16
MANIFEST = "embedding_dim INT, onnx STRUCT<uri: STRING, sha256: STRING, kind: STRING>"
# Kinds of servable models; a manifest that names none holds a projection.
ARTIFACT_KINDS = ("projection", "encoder")


def object_path(uri: Column, root: str) -> Column:
    """Path of ``scheme://bucket/key`` under the folder that mirrors the buckets."""
    return F.concat(F.lit(root.rstrip("/") + "/"), F.regexp_extract(uri, r"^[a-zA-Z0-9]+://(.+)$", 1))


def audit_artifacts(registry: DataFrame, files: DataFrame, expected_width: int, root: str = "") -> DataFrame:
    """(version, artifact_uri, problems) of every registered artifact.

    ``registry``: (version, artifact_uri, sha256; a NULL digest is not
    checked); ``files``: a ``binaryFile`` frame (path, content) of manifests and
    model files.  An artifact is the JSON manifest at its URI: object present,
    digest equal, a JSON object, embedding_dim equal to ``expected_width``, ONNX
    uri and digest present, kind known, model file present with that digest.
    Paths are compared whole, bucket included.
    """
    def problem(cond: Column, name: str) -> Column:
        return F.when(cond, F.lit(name))

    stored = files.select(F.col("path").alias("_path"), F.sha2("content", 256).alias("_sha"))
    reg = registry.select("version", "artifact_uri", "sha256", object_path(F.col("artifact_uri"), root).alias("_p"))
    m = files.select(F.col("path").alias("_p"), F.sha2("content", 256).alias("actual_sha256"),
                     F.from_json(F.decode("content", "UTF-8"), MANIFEST).alias("m"),
                     F.decode("content", "UTF-8").rlike(r"^\s*\{").alias("is_object"))
    j = reg.join(m, "_p", "left").withColumn("_onnx", object_path(F.col("m.onnx.uri"), root))
    j = j.join(stored, F.col("_onnx") == F.col("_path"), "left")
    there = F.col("actual_sha256").isNotNull()
    whole = there & F.col("is_object")
    named = F.col("m.onnx.uri").isNotNull() & F.col("m.onnx.sha256").isNotNull()
    kind = F.coalesce(F.col("m.onnx.kind"), F.lit("projection"))
    checks = [
        problem(~there, "missing_object"),
        problem(there & (F.col("actual_sha256") != F.col("sha256")), "digest_mismatch"),
        problem(there & ~F.col("is_object"), "manifest_not_an_object"),
        problem(whole & ~F.col("m.embedding_dim").eqNullSafe(F.lit(expected_width)), "width_mismatch"),
        problem(whole & ~named, "onnx_metadata_incomplete"),
        problem(whole & named & ~kind.isin(*ARTIFACT_KINDS), "unknown_kind"),
        problem(whole & named & F.col("_sha").isNull(), "missing_model"),
        problem(whole & named & (F.col("_sha") != F.col("m.onnx.sha256")), "model_digest_mismatch"),
    ]
    return j.select("version", "artifact_uri", F.array_compact(F.array(*checks)).alias("problems"))


# ------------------------------------------------------------------ T1 / T3 / T4 / A4
def latest(df: DataFrame, col: str, n: int, tie: str | None = None) -> DataFrame:
    """Newest ``n`` rows (a top-k: per-partition top-n merged once)."""
    order = [F.desc(col)] + ([F.desc(tie)] if tie else [])
    return df.orderBy(*order).limit(n)


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """T4: point lookup by id (pushed to the scan as a filter)."""
    return df.filter(F.col(key) == F.lit(value))


def linguistic_summary(windows: DataFrame) -> DataFrame:
    """Newest linguistic window and the number of windows."""
    return windows.agg(F.count("*").alias("window_count"),
                       F.max_by(F.struct("window_start", "window_end", "composite_score"),
                                F.struct("window_end", "window_start")).alias("latest")).select(
        "window_count", F.col("latest.window_start").alias("latest_window_start"),
        F.col("latest.window_end").alias("latest_window_end"),
        F.col("latest.composite_score").alias("latest_composite_score"))


# ------------------------------------------------------------------ E9
def audit_decisions(models: DataFrame, jobs: DataFrame, windows: DataFrame, served: DataFrame | None = None,
                    gate: float = config.ACTIVATION_MIN_IMPROVEMENT) -> DataFrame:
    """Decision audit -> violations (entity, id, rule).

    models: (version, status, improvement, baseline_quality, candidate_quality);
    jobs: (job_id, status); windows: (window_id, document_count); served: one
    row (served_version).  Rules, the version ``baseline`` being no candidate:
    promoted <=> improvement > gate (no recorded improvement says nothing);
    recorded metrics that are all zero are "not evaluated"; FAILED jobs are
    flagged; some window must hold documents; traffic is served by the baseline
    when nothing was promoted, else by a version whose improvement is above the gate.
    """
    zero = (F.coalesce("baseline_quality", F.lit(0.0)) == 0) & (F.coalesce("candidate_quality", F.lit(0.0)) == 0) & (
        F.col("baseline_quality").isNotNull() | F.col("candidate_quality").isNotNull())
    is_promoted = F.col("status").isin("PASSED", "ACTIVE")
    candidates = models.filter(F.col("version").cast("string") != "baseline")
    decided = is_promoted | (F.col("status") == "REJECTED")
    m = candidates.select(F.lit("model").alias("entity"), F.col("version").cast("string").alias("id"), F.explode(F.array_compact(F.array(
        F.when(decided & zero, F.lit("decided_not_evaluated")),
        F.when(is_promoted & ~zero & ~(F.col("improvement") > gate), F.lit("promoted_without_gain")),
        F.when((F.col("status") == "REJECTED") & ~zero & (F.col("improvement") > gate), F.lit("rejected_with_gain")),
    ))).alias("rule"))
    j = jobs.filter(F.col("status") == "FAILED").select(F.lit("job").alias("entity"),
                                                        F.col("job_id").cast("string").alias("id"),
                                                        F.lit("failed_job").alias("rule"))
    w = windows.agg(F.max("document_count").alias("n")).filter(F.coalesce("n", F.lit(0)) <= 0).select(
        F.lit("window").alias("entity"), F.lit("all").alias("id"), F.lit("no_window_analysed").alias("rule"))
    out = m.unionByName(j).unionByName(w)
    if served is not None:
        promoted = candidates.filter(is_promoted)
        any_promoted = promoted.agg((F.count("*") > 0).alias("x")).select("x").scalar()
        s = served.select(F.col("served_version").cast("string").alias("id"), any_promoted.alias("_any"))
        good = promoted.filter(F.col("improvement") > gate).select(F.col("version").cast("string").alias("id"),
                                                                   F.lit(True).alias("_good"))
        s = s.join(good, "id", "left")
        rule = (F.when(~F.col("_any") & (F.col("id") != "baseline"), "baseline_not_served")
                .when(F.col("_any") & (F.col("id") == "baseline"), "promoted_not_served")
                .when(F.col("_any") & F.col("_good").isNull(), "served_without_gain"))
        out = out.unionByName(s.select(F.lit("serving").alias("entity"), "id", rule.alias("rule")).filter(
            F.col("rule").isNotNull()))
    return out
