"""Token ids of whole texts, and their file format: Parquet list columns.

``encode_flat`` tokenizes each distinct word once: the pre-tokenizer of the vocabulary cuts at white
space and drops it, cuts between letters and punctuation, and takes no notice of ASCII case, so the
ids of a text are those of its words in order, and those of a word are its core's and its closing
punctuation's. Arrow cuts and numbers the words of many texts at once; only words unseen so far reach the
tokenizer, and numpy gathers the ids. (A vocabulary for which that does not hold is encoded text by
text: ``by_word=False``.)

File format of ``write_tokens``: one Parquet data set in ascending document order with the columns
part, seq (int), doc_id (long), n_tokens (int) and tokens (list<int>). Ids are dictionary-encoded
(bit-packed dictionary indices), the metadata columns delta-encoded; row groups and pages have
fixed byte sizes and page indexes, so readers fetch single columns, and single pages of a range of
ids, without touching the rest.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from embdrift.llm.common import scratch

_CACHE_WORDS = 500_000
_CACHE_WORD_CHARS = 64
#: Closing ASCII punctuation (but for the apostrophe, which can open a suffix) behind a letter or digit.
_PARTED = r"^(?P<core>.*[A-Za-z0-9])(?P<tail>[!-&(-/:-@\[-`{-~]+)$"
#: Per Python worker: vocabulary path -> words it has met. Workers are reused over tasks.
_LOADED: dict[str, _Words] = {}


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class _Words:
    """A tokenizer and the ids of the words met so far, in one flat array: ``number`` of a word (part)
    gives its place in ``start`` and ``size``. Emptied when it holds too many; long words are not kept."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks share the cores already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        of = json.loads(self.tokenizer.to_str())
        rules = of["normalizer"] or {}
        self.lowers = any(r["type"] == "Lowercase" for r in rules.get("normalizers", [rules] if rules else []))
        self.added = [t["content"] for t in of["added_tokens"]]
        suffix, known = of["model"].get("end_of_word_suffix"), self.tokenizer.get_vocab()
        self.ends = np.zeros(max(known.values()) + 1, bool)  # ids that close a word
        if suffix:
            self.ends[[i for t, i in known.items() if t.endswith(suffix)]] = True
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {"": 0}
        self.start, self.size, self.ids, self.long = np.zeros(1, np.int64), np.zeros(1, np.int64), np.empty(0, np.uint32), False

    def make_room(self) -> None:
        if len(self.number) > _CACHE_WORDS:
            self.clear()

    def forget_long(self) -> None:
        if self.long:
            self.clear()

    def numbers(self, words: list[str]) -> np.ndarray:
        """Numbers of the (distinct) words; unseen ones are encoded."""
        got = list(map(self.number.get, words))
        new = [w for w, k in zip(words, got) if k is None]
        if new:
            first = len(self.size)
            new, ids, sizes = self._encoded(new)
            self.ids = np.concatenate([self.ids, ids])
            self.size = np.concatenate([self.size, sizes])
            self.start = np.cumsum(self.size) - self.size
            self.number.update(zip(new, range(first, first + len(new))))
            self.long |= any(len(w) > _CACHE_WORD_CHARS for w in new)
            got = [self.number[w] if k is None else k for w, k in zip(words, got)]
        return np.array(got, np.int64)


    def _encoded(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The words (in an order of its own), their ids one after the other and how many each has.

        Words of letters alone go to the tokenizer many to a line: each ends with the one id that
        closes a word. The words of a line whose closing ids do not tell as many go one by one, like the rest.
        """
        letters = np.asarray(pc.match_substring_regex(pa.array(words, pa.string()), r"^\pL+$")) if self.ends.any() else np.zeros(len(words), bool)
        plain = [w for w, k in zip(words, letters) if k]
        rest, ids, sizes = [w for w, k in zip(words, letters) if not k], [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        if plain:
            cut = [plain[k:k + 64] for k in range(0, len(plain), 64)]
            lines, got = [" ".join(c) for c in cut], []
            for k in range(0, len(lines), 400):
                got += [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(lines[k:k + 400], add_special_tokens=False)]
            flat, n = np.concatenate(got), np.fromiter(map(len, got), np.int64, len(got))
            closed = np.concatenate([[0], np.cumsum(self.ends[flat])])
            at = np.concatenate([[0], np.cumsum(n)])
            good = np.diff(closed[at]) == np.fromiter(map(len, cut), np.int64, len(cut))
            flat = flat[np.repeat(good, n)]
            ids.append(flat)
            sizes.append(np.diff(np.flatnonzero(self.ends[flat]), prepend=-1))
            rest += [w for c, k in zip(cut, good) if not k for w in c]
            plain = [w for c, k in zip(cut, good) if k for w in c]
        for k in range(0, len(rest), 20_000):
            part = [e.ids for e in self.tokenizer.encode_batch_fast(rest[k:k + 20_000], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, part), np.int64, len(part)))
            ids.append(np.fromiter(itertools.chain.from_iterable(part), np.uint32))
        return plain + rest, np.concatenate(ids), np.concatenate(sizes)


def _load(path: str) -> _Words:
    if path not in _LOADED:
        _LOADED[path] = _Words(path)
    return _LOADED[path]


def _gather(ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs ids[start:start + size] one after the other."""
    before = np.cumsum(size) - size
    return ids[np.repeat(start - before, size) + np.arange(int(size.sum()))]


def encode_flat(path: str, texts: pa.Array, by_word: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Ids (uint32) of all whole texts one after the other, and where each text begins (one more
    entry than texts); null and empty texts have none."""
    known = _load(path)
    texts = pc.fill_null(texts, "")
    if not by_word:
        each = [e.ids for e in known.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
        return np.fromiter(itertools.chain.from_iterable(each), np.uint32), np.cumsum([0, *map(len, each)])
    cut = pc.ascii_split_whitespace(texts)
    edges = np.asarray(cut.offsets, np.int64)
    flat = cut.flatten().dictionary_encode()
    words, at = flat.dictionary, np.asarray(flat.indices, np.int64)
    # Each distinct word is a core and its closing punctuation, if the core ends in a letter or digit.
    plain = ~functools.reduce(np.logical_or, [np.asarray(pc.match_substring(words, t, ignore_case=True)) for t in known.added],
                              np.zeros(len(words), bool))  # special tokens are found by their exact spelling
    low = pc.ascii_lower(words) if known.lowers else words
    parts = pc.extract_regex(low, _PARTED)
    parted = pa.array(plain & np.asarray(parts.is_valid()))
    core = pc.if_else(parted, parts.field("core"), pc.if_else(pa.array(plain), low, words)).dictionary_encode()
    tail = pc.if_else(parted, parts.field("tail"), "").dictionary_encode()
    known.make_room()
    numbers = [known.numbers(half.dictionary.to_pylist())[np.asarray(half.indices, np.int64)] for half in (core, tail)]
    pieces = np.stack(numbers, axis=1).ravel()
    # Ids of the distinct words in a row, then those of the texts' words.
    size = known.size[pieces]
    ids = _gather(known.ids, known.start[pieces], size)
    size = size.reshape(-1, 2).sum(axis=1)
    start = np.cumsum(size) - size
    known.forget_long()
    total = np.concatenate([[0], np.cumsum(size[at])])
    return _gather(ids, start[at], size[at]), total[edges - edges[0]]


def closed(ids: np.ndarray, edges: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """``encode_flat``'s result with the end id behind each text."""
    return np.insert(ids, edges[1:], np.uint32(end_id)), edges + np.arange(len(edges))


def encode(path: str, texts: Sequence[str | None], by_word: bool = True) -> list[np.ndarray]:
    """Ids (uint32) of each whole text; null and empty texts have none."""
    ids, edges = encode_flat(path, pa.array(texts, pa.string()), by_word)
    return [ids[a:b] for a, b in zip(edges, edges[1:])]


def text_runs(texts: pa.Array, most: int = 8_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes (one row at least), which bound the memory."""
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64)
    total, k = np.cumsum(size), 0
    while k < len(size):
        n = max(k + 1, int(np.searchsorted(total, most + (total[k - 1] if k else 0), side="right")))
        yield k, n
        k = n


def crc(ids: np.ndarray) -> int:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def write_tokens(docs: DataFrame, path: str, vocabulary_path: str, end_id: int = 1, by_word: bool = True,
                 row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10) -> None:
    """Encode every row of ``docs`` (doc_id, text), append ``end_id`` to each, write the format.

    Rows are range-partitioned by (doc_id, hash of the text, input partition), so that even copies of
    one row spread, and the files are in ascending order (null ids first). part numbers the files in that order, seq the
    rows of a file; both are stored, so later readers need no order of file names. An empty table
    gives a data set without rows.
    """
    rows = docs.select("doc_id", "text").withColumns({"h": F.xxhash64("text"), "p": F.spark_partition_id()})
    rows = rows.repartitionByRange("doc_id", "h", "p").sortWithinPartitions("doc_id", "h")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        for b in batches:
            ids, texts = b.column("doc_id"), b.column("text")
            for lo, hi in text_runs(texts):
                flat, edges = closed(*encode_flat(vocabulary_path, texts.slice(lo, hi - lo), by_word), end_id)
                lens, n = np.diff(edges).astype(np.int32), hi - lo
                lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seq, seq + n, dtype=np.int32)),
                     ids.slice(lo, n), pa.array(lens), lists], ["part", "seq", "doc_id", "n_tokens", "tokens"])
                seq += n

    out = rows.mapInArrow(encoded, "part int, seq int, doc_id bigint, n_tokens int, tokens array<int>")
    writer = out.write.option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0")
    writer = writer.option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes)
    writer = writer.option("parquet.enable.dictionary", "true")
    for column in ("part", "seq", "doc_id", "n_tokens"):  # without a dictionary, version 2 pages hold deltas
        writer = writer.option(f"parquet.enable.dictionary#{column}", "false")
    writer.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The data set of ``write_tokens``; select columns and filter doc_id to read little of it."""
    return spark.read.schema("part int, seq int, doc_id bigint, n_tokens int, tokens array<int>").parquet(path)


def token_starts(spark: SparkSession, path: str) -> DataFrame:
    """part, seq, doc_id, n_tokens, start (ids of all rows before), from the metadata columns alone.

    Totals per part first (as many rows as files), then a running sum inside each part.
    """
    meta = read_tokens(spark, path).select("part", "seq", "doc_id", "n_tokens")
    totals = meta.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start0"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return meta.join(totals, "part").select(
        "part", "seq", "doc_id", "n_tokens",
        (F.col("start0") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).cast("bigint").alias("start"))


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """part, seq, ids_crc32 of the stored lists."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("tokens")
            flat = np.asarray(lists.values, dtype=np.int32)
            off = np.asarray(lists.offsets)
            got = [crc(flat[off[k]:off[k + 1]]) for k in range(len(lists))]
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("seq"), pa.array(got, pa.int64())], ["part", "seq", "ids_crc32"])

    return read_tokens(spark, path).select("part", "seq", "tokens").mapInArrow(digests, "part int, seq int, ids_crc32 bigint")


def token_table(docs: DataFrame, vocabulary_path: str, end_id: int = 1) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 for every row of ``docs``, from files written and read back."""
    spark = docs.sparkSession
    path = scratch(spark, "tokens")
    write_tokens(docs, path, vocabulary_path, end_id)
    return token_starts(spark, path).join(token_digests(spark, path), ["part", "seq"]).select(
        "doc_id", "start", F.col("n_tokens").cast("bigint").alias("n_tokens"), "ids_crc32")
