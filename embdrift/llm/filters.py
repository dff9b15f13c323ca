"""Filter interaction audit by an incremental stream with retractions.

All files of the table are read as available-now micro-batches. Stateless steps mark each row with
the filters it fails by its own text (A to D), look up its labels and combine rows of one text
inside a task. State is kept per text (its SHA-256): the smallest id seen and the rows that have
it. A row with a larger id fails filter E (a copy); when a smaller id arrives later, the rows
counted as originals until then are retracted from the counters of their parts and counted again
with E. Every micro-batch adds its changes, summed per (part, mask, labels), to a counter table
under its own batch number, so a repeated batch replaces itself. The 120 orders are worked out on the
32 counters of a part, never on documents.
"""

from __future__ import annotations

import itertools
import json
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from embdrift.llm.common import scratch
from embdrift.session import ship_package

LETTERS = "ABCDE"
_BIT = {f: 1 << k for k, f in enumerate(LETTERS)}
_CAPITALS = bytes(range(65, 91))
_TEXTS_HELD = 10_000
_SYMBOL = re.compile(rb"[#$%&*|]")
#: State on local disk and in the checkpoint, not in the executors' memory; a partition's local files (some
#: megabytes each, even if it is almost empty) go when its batch is committed.
_STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
          "spark.sql.streaming.stateStore.unloadOnCommit": "true"}


def own_failures(text: str) -> int:
    """Bits of the filters A to D that a text fails."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()  # bytes are cut at exactly \x20 and \x09-\x0D
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    return (_BIT["A"] * (len(words) < 200) | _BIT["B"] * (100 * len(set(words)) < 50 * len(words))
            | _BIT["C"] * (100 * capitals > 2 * len(text)) | _BIT["D"] * bool(_SYMBOL.search(raw)))


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        mask = [own_failures(t.as_py() or "") for t in b.column("text")]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), b.column("text_key"), pa.array(mask, pa.int32())],
                                         ["doc_id", "part", "text_key", "mask"])


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one (text, part, labels) in an Arrow batch become one: n rows, least id, rows with it."""
    keys = ["text_key", "mask", "part", "good", "toxic", "named"]
    for b in batches:
        t = pa.Table.from_batches([b])
        same = t.group_by(keys + ["doc_id"]).aggregate([([], "count_all")])
        whole = same.group_by(keys).aggregate([("count_all", "sum"), ("doc_id", "min")])
        whole = whole.rename_columns(["n" if c == "count_all_sum" else "least" if c == "doc_id_min" else c for c in whole.column_names])
        first = same.rename_columns(["n_least" if c == "count_all" else "least" if c == "doc_id" else c for c in same.column_names])
        out = whole.join(first, keys + ["least"], join_type="left outer").select([*keys, "n", "least", "n_least"])
        yield from out.combine_chunks().to_batches()


class _Originals(StatefulProcessor):
    """Per text: the least id and the rows that have it. Texts are dealt over buckets, one state map each."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "text_key binary", "least bigint, rows array<struct<part:string,good:boolean,toxic:boolean,n:bigint>>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        by_text: dict[bytes, list[Row]] = {}
        changes: Counter = Counter()
        for r in rows:
            if r.named:
                by_text.setdefault(bytes(r.text_key), []).append(r)
            else:
                changes[r.part, r.mask, r.good, r.toxic] += r.n
            if len(by_text) >= _TEXTS_HELD:
                self._fold(by_text, changes)
                by_text.clear()
        self._fold(by_text, changes)
        for (part, mask, good, toxic), n in changes.items():
            if n:
                yield Row(part=part, mask=mask, good=good, toxic=toxic, change=n)

    def _fold(self, by_text: dict[bytes, list[Row]], changes: Counter) -> None:
        """Take new rows of some texts into the state; ``changes`` gets what the counters gain and lose."""
        copy = _BIT["E"]
        for text, rows in by_text.items():
            mask = rows[0].mask  # a function of the text
            state = self.known.getValue((text,))
            before, originals = (None, []) if state is None else (state[0], [tuple(x) for x in state[1]])
            least = min([r.least for r in rows] + ([] if before is None else [before]))
            if before is not None and least < before:
                for part, good, toxic, n in originals:
                    changes[part, mask, good, toxic] -= n
                    changes[part, mask | copy, good, toxic] += n
                originals = []
            had = len(originals)
            for r in rows:
                first = r.n_least if r.least == least else 0
                if first:
                    changes[r.part, mask, r.good, r.toxic] += first
                    originals.append((r.part, r.good, r.toxic, first))
                changes[r.part, mask | copy, r.good, r.toxic] += r.n - first
            if least != before or len(originals) != had:
                self.known.updateValue((text,), (least, originals))


def counters(spark: SparkSession, path: str, labels: DataFrame, batches: int = 4, buckets: int = 256) -> DataFrame:
    """part, mask (bit k: fails filter ``LETTERS[k]``), good, toxic, n: rows of the document table
    at ``path`` (doc_id, text, source; a missing column reads as null).

    Null text counts as empty, null source as the empty part. A row is a copy if its text equals that
    of a row with a smaller id; rows of one id are no copies of each other, and a null id is neither
    smaller nor larger than any. A document is good or toxic if ``labels`` (doc_id, quality, toxic)
    has 1 for it and never 0. Extra columns are not read. An empty table has no counters.
    ``batches``: micro-batches over the files (fewer if there are fewer files); ``buckets``: groups of
    texts in the state, to be raised with the cluster.
    """
    ship_package(spark)
    have = spark.read.parquet(path)
    need = [f for f in have.schema.fields if f.name in ("doc_id", "text", "source")]
    schema = type(have.schema)(need)
    files = have.inputFiles()
    if len(files) == 1 and files[0].rstrip("/").endswith(path.rstrip("/").rsplit("/", 1)[-1]):
        path = f"{path[:-1]}[{path[-1]}]"  # one file, no folder: a stream takes it as a pattern only
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max(1, math.ceil(len(files) / batches)))
              .option("maxFileAge", "36500d").parquet(path))
    given = set(stream.columns)
    text = F.coalesce(F.col("text"), F.lit("")) if "text" in given else F.lit("")
    part = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in given else F.lit("")
    doc_id = F.col("doc_id").cast("bigint") if "doc_id" in given else F.lit(None).cast("bigint")
    rows = stream.select(doc_id.alias("doc_id"), part.alias("part"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("text_key"))
    rows = rows.mapInArrow(_marked, "doc_id bigint, part string, text_key binary, mask int")
    flags = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        (F.min(F.when(F.col("quality").isin(0, 1), F.col("quality"))) == 1).alias("good"),
        (F.min(F.when(F.col("toxic").isin(0, 1), F.col("toxic"))) == 1).alias("toxic"))
    # Texts are behind us: the join moves ids and masks only, or broadcasts labels that the engine finds small.
    rows = rows.join(flags, "doc_id", "left").select(
        "text_key", "mask", "part", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), "doc_id",
        F.col("doc_id").isNotNull().alias("named"))
    change = "part string, mask int, good boolean, toxic boolean, change bigint"
    known = rows.mapInArrow(_combined, "text_key binary, mask int, part string, good boolean, toxic boolean, named boolean, "
                                       "n bigint, least bigint, n_least bigint")
    bucket = F.conv(F.substring(F.hex("text_key"), 1, 8), 16, 10).cast("bigint") % F.lit(buckets)
    changes = known.withColumn("bucket", bucket).groupBy("bucket").transformWithState(_Originals(), change, "append", "none")
    table, done = scratch(spark, "filter-counters"), []

    def add(batch: DataFrame, number: int) -> None:
        summed = batch.groupBy("part", "mask", "good", "toxic").agg(F.sum("change").alias("change"))
        summed.write.mode("overwrite").parquet(f"{table}/batch={number}")
        done.append(number)

    old = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        run = (changes.writeStream.foreachBatch(add).outputMode("append").trigger(availableNow=True)
               .option("checkpointLocation", scratch(spark, "filter-stream")).start())
        run.awaitTermination()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    found = spark.read.schema(change).parquet(*[f"{table}/batch={k}" for k in done]) if done else spark.createDataFrame([], change)
    return found.groupBy("part", "mask", "good", "toxic").agg(F.sum("change").alias("n")).where("n <> 0")


def interactions(counted: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``counted``: part, mask, good, toxic, n. One row per part, order of the five filters and step,
    zeros included: what is kept after the step, removed by its filter, failing it but removed
    earlier, failing it alone, good and toxic documents removed, and what the filter removes summed
    over all orders.
    """
    def per_mask(n) -> list:
        return F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == m, n)), F.lit(0)) for m in range(32)])

    parts = counted.groupBy("part").agg(
        per_mask(F.col("n")).alias("n"), per_mask(F.when(F.col("good"), F.col("n"))).alias("good"),
        per_mask(F.when(F.col("toxic"), F.col("n"))).alias("toxic"))
    steps = []
    for order in itertools.permutations(LETTERS):
        before = 0
        for k, f in enumerate(order):
            steps.append({"filter_order": "".join(order), "step": k + 1, "bit": _BIT[f], "before": before})
            before |= _BIT[f]
    table = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,bit:int,before:int>>")
    rows = parts.select("part", "n", "good", "toxic", F.inline(table))
    masks = F.sequence(F.lit(0), F.lit(31))
    bit, before = F.col("bit"), F.col("before")

    def total(count, where) -> F.Column:
        return F.aggregate(F.filter(masks, where), F.lit(0).cast("bigint"), lambda s, m: s + F.element_at(count, m + 1))

    def first(m):
        return (m.bitwiseAND(bit) != 0) & (m.bitwiseAND(before) == 0)

    shared = F.aggregate(F.filter(masks, lambda m: m.bitwiseAND(bit) != 0), F.lit(0).cast("bigint"),
                         lambda s, m: s + F.element_at(F.col("n"), m + 1) * (F.lit(120) / F.bit_count(m)).cast("bigint"))
    return rows.select(
        "part", "filter_order", "step",
        total(F.col("n"), lambda m: m.bitwiseAND(bit.bitwiseOR(before)) == 0).alias("kept"),
        total(F.col("n"), first).alias("removed"),
        total(F.col("n"), lambda m: (m.bitwiseAND(bit) != 0) & (m.bitwiseAND(before) != 0)).alias("redundant"),
        F.element_at(F.col("n"), bit + 1).alias("unique_fails"),
        total(F.col("good"), first).alias("good_lost"), total(F.col("toxic"), first).alias("toxic_lost"),
        shared.alias("shapley"))


def audit(spark: SparkSession, path: str, labels: DataFrame, batches: int = 4, buckets: int = 256) -> DataFrame:
    """``interactions`` of all documents at ``path``; see ``counters`` for nulls, copies and labels."""
    return interactions(counters(spark, path, labels, batches, buckets))
