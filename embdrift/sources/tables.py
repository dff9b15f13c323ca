"""Table loader: explicit columns, NTZ timestamps cast to UTC timestamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from embdrift.session import ensure_utc, ship_package

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


#: Session setting: number of tasks that per-row text work is dealt over (unset: the scan's own).
TEXT_TASKS = "embdrift.text.tasks"


def dealt(df: DataFrame) -> DataFrame:
    """``df`` dealt over the number of tasks that the session setting ``embdrift.text.tasks`` names.

    Tokenising is CPU-bound, and a small file with one row group is one task. The
    setting is the caller's; nothing here looks at the data, and unset means no shuffle.
    """
    tasks = df.sparkSession.conf.get(TEXT_TASKS, None)
    return df.repartition(int(tasks)) if tasks else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one parquet table.

    Parquet timestamps of the test data are TIMESTAMP_NTZ; ``withWatermark``
    and interval arithmetic want zoned timestamps, so they are cast here once
    (the session clock is pinned to UTC, so the wall-clock value is kept).
    Column pruning and filter pushdown still reach the scan: the cast is a
    plain projection above it.
    """
    ensure_utc(spark)
    df = spark.read.parquet(table_path(sf_dir, name))
    casts = [
        F.col(f.name).cast("timestamp").alias(f.name)
        if isinstance(f.dataType, T.TimestampNTZType) else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(*casts)


class Tables:
    """Lazy accessor: ``Tables(spark, sf_dir).documents``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        ship_package(spark)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return read_table(self.spark, self.sf_dir, name)
