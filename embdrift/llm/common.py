"""What several operators share: scratch tables, words, word-wise encoding, labels."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from embdrift.session import checkpoint_dir, ship_package
from embdrift.sources.tables import table_path

#: The white space between words, as a character class body (same in Java, Python and RE2).
SPACE = r"\x20\x09-\x0D"
#: Lower-casing of A-Z in UTF-8 bytes; ``bytes.split()`` then cuts at exactly the SPACE characters.
LOWER_BYTES = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as it is, with the package shipped to the Python workers."""
    ship_package(spark)
    return spark.read.parquet(table_path(sf_dir, name))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage ends here, so that a lost
    executor repeats no earlier stage and all readers see the same rows."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_class(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def marks(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) with label 0 or 1, one row per id: labels that contradict each other drop out
    (no verdict), repeated equal ones count once, null and other values do not count."""
    return (labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
            .groupBy("doc_id").agg(F.min(label).alias("lo"), F.max(label).alias("label"))
            .where("lo = label").drop("lo"))


def bounded_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, per_label: int, max_chars: int,
                   seed: int = 0) -> list[tuple[str, int]]:
    """At most ``per_label`` (text, label) rows of each label among the documents that ``keep`` selects.

    Ids are chosen first, by a hash, from documents of 1 to ``max_chars`` characters; their texts (the
    least text of a repeated id) are fetched by a broadcast of at most 2 * per_label ids, so no text is
    shuffled. The bound holds at every input size: 2 * per_label * max_chars characters reach the
    driver. Sorted, so that a model fitted on it is repeatable.
    """
    short = keep & F.length("text").between(1, max_chars) & F.col("doc_id").isNotNull()
    ids = docs.where(short).select("doc_id").distinct().join(marks(labels, label), "doc_id")
    order = [F.xxhash64(F.col("doc_id"), F.lit(seed)), F.col("doc_id")]
    chosen = [ids.where(F.col("label") == v).orderBy(*order).limit(per_label) for v in (0, 1)]
    rows = docs.where(short).select("doc_id", "text").join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")
    got = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect()
    return [(r.text, r.label) for r in sorted(got, key=lambda r: (r.label, r.doc_id))]


def label_share(docs: DataFrame, labels: DataFrame, label: str, keep: Column) -> float | None:
    """Share of label 1 among all labelled documents that ``keep`` selects (two counts reach the driver)."""
    ids = docs.where(keep & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return ids.join(marks(labels, label), "doc_id").agg(F.avg("label").alias("s")).first().s


def evaluated(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed exactly once per row.

    They pass through a one-element generator, through which the optimizer neither pushes filters
    nor merges projections; else a filter on a column that builds on others would repeat them all.
    """
    return df.select("*", F.inline_outer(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def packed(docs: DataFrame, *needed: str) -> DataFrame:
    """``docs`` with its columns renamed by place (``_in0``, ``_in1``, ..), so that no helper or result
    column of an operator can clash with them, and the ``needed`` ones again by their names. A needed
    column that is missing reads as null text."""
    have = set(docs.columns)
    return docs.select(*[F.col(f"`{c}`").alias(f"_in{k}") for k, c in enumerate(docs.columns)],
                       *[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in needed])


def unpacked(rows: DataFrame, docs: DataFrame, without: tuple[str, ...] = (), also: tuple[str, ...] = ()) -> DataFrame:
    """The columns of ``docs`` in ``packed`` rows under their own names, and further columns."""
    return rows.select(*[F.col(f"_in{k}").alias(c) for k, c in enumerate(docs.columns) if c not in without], *also)
