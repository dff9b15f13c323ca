"""Session helpers: UTC clock, checkpoint folder, sane local defaults."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, app: str = "embdrift",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Create (or reuse) a session with the settings every operator assumes.

    On a cluster the master and all memory settings come from spark-submit: a
    master is set only when the caller names one (or ``EMBDRIFT_MASTER`` does),
    driver memory only when ``EMBDRIFT_DRIVER_MEMORY`` does.
    """
    master = master or os.environ.get("EMBDRIFT_MASTER")
    builder = SparkSession.builder
    if master:
        builder = builder.master(master)
    if os.environ.get("EMBDRIFT_DRIVER_MEMORY"):
        builder = builder.config("spark.driver.memory", os.environ["EMBDRIFT_DRIVER_MEMORY"])
    builder = (
        builder.appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_utc(spark: SparkSession) -> None:
    """All clocks are UTC (the reference stores timestamptz in UTC only)."""
    if spark.conf.get("spark.sql.session.timeZone", None) != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only when it is unset and the master is local (tests) do we pick a fresh
    local folder; a cluster without a shared folder is a configuration error.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="embdrift-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``embdrift`` importable on every Python worker (``--py-files`` at runtime).

    Pandas UDFs and ``applyInPandas`` functions are pickled by reference to
    this package; executors import it from the zip Spark distributes.  Done
    once per application.
    """
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="embdrift-pkg-"), "embdrift.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(app)


def materialize(df):
    """Write ``df`` to the shared checkpoint folder and read it back (lineage cut).

    Used where one intermediate feeds several outputs of a large report: the
    consumers plan against a small scan instead of re-planning (and, after a
    lost executor, re-running) the whole tokenising pipeline beneath it.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df):
    """``materialize`` for large tables: written as compressed Parquet, read back by columns and with its size known.

    A checkpoint holds serialised rows, several times as large, and is read whole by every reader; partitions are
    those of the files here, so readers that rely on how the rows lie use ``materialize``.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/written-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
