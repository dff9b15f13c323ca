"""Counts of tumbling windows, packed: one row per batch and window instead of one per (window, term).

Tokens are cut in the JVM; an Arrow batch is counted where it is, with numpy, and leaves as compressed
terms and counts (``packed_counts``) or, where documents matter, of postings (``packed_index``).  The
packed rows are shuffled by comparison and merged there, a comparison at a time: no task holds a table
of all its windows' terms, and memory follows the largest window, not the input.  Keyword topics need the
order of a window's words: there the texts are shuffled and cut window by window (``topic_weights``).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embdrift.session import ship_package

#: Tokens counted at once in a Python worker; a longer document is counted alone.
SLICE_TOKENS = 1 << 18
_CODEC = pa.Codec("zstd")
INDEX = "rows array<int>, terms array<string>, df array<int>, docs array<int>, tf array<int>"


def slices(batch: pa.RecordBatch, lens: np.ndarray, size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """``batch`` in runs of rows whose ``lens`` add up to ``size`` at most (single rows may exceed it)."""
    ends, at = np.cumsum(lens), 0
    while at < len(lens):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield batch.slice(at, to - at), lens[at:to]
        at = to


def lengths(lists) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _flat(lists: pa.ListArray) -> pa.Array:
    return lists.flatten()


def _lists(starts: np.ndarray, values) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), values)


def _ints(x: np.ndarray) -> pa.Array:
    return pa.array(x, pa.int32())


def _tokens(batches, column: str):
    """Slices as (record batch, window of each row as a number, the windows, length of each row, code of each
    token, the terms)."""
    for batch in batches:
        for part, lens in slices(batch, lengths(batch.column(column)), SLICE_TOKENS):
            wids, own = np.unique(part.column("wid").to_numpy(zero_copy_only=False), return_inverse=True)
            tokens = _flat(part.column(column)).dictionary_encode()
            yield part, own, wids, lens, tokens.indices.to_numpy(zero_copy_only=False).astype(np.int64), tokens.dictionary


def packed_index(docs: DataFrame, terms: Column) -> DataFrame:
    """``docs`` (wid, doc_id, ..) as rows (wid, ids, rows, terms, df, docs, tf), one per slice and window: its
    different ids with their number of rows; its terms, the number of documents of each, and these documents
    (places in ``ids``) with the term's count."""
    ship_package(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def index(batches):
        for part, own, wids, lens, codes, terms in _tokens(batches, "_terms"):
            ids = part.column("doc_id").dictionary_encode("encode")
            id_codes, n_ids = ids.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(ids.dictionary))
            # A document is (window, id); its place is counted from its window's first one.
            doc, doc_of_row, rows = np.unique(own * n_ids + id_codes, return_inverse=True, return_counts=True)
            starts = np.searchsorted(doc // n_ids, np.arange(len(wids) + 1))
            n_terms, n_docs = max(1, len(terms)), max(1, len(doc))
            key, tf = np.unique((np.repeat(own, lens) * n_terms + codes) * n_docs + np.repeat(doc_of_row, lens), return_counts=True)
            first = np.flatnonzero(np.diff(key // n_docs, prepend=-1))
            term = (key // n_docs)[first]
            term_starts = np.searchsorted(term // n_terms, np.arange(len(wids) + 1))
            posting_starts = np.searchsorted(key // n_docs // n_terms, np.arange(len(wids) + 1))
            place = key % n_docs - np.repeat(starts[:-1], np.diff(posting_starts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(wids, pa.int64()), _lists(starts, ids.dictionary.take(pa.array(doc % n_ids))), _lists(starts, _ints(rows)),
                 _lists(term_starts, terms.take(pa.array(term % n_terms))),
                 _lists(term_starts, _ints(np.diff(np.append(first, len(key))))),
                 _lists(posting_starts, _ints(place)), _lists(posting_starts, _ints(tf))],
                ["wid", "ids", "rows", "terms", "df", "docs", "tf"])

    known = docs.filter(F.col("wid").isNotNull()).select(F.col("wid").cast("long"), "doc_id", terms.alias("_terms"))
    return known.mapInArrow(index, f"wid long, ids array<{kind}>, {INDEX}")


def centroid_distances(index: DataFrame, max_features: int) -> DataFrame:
    """``packed_index`` rows with their ``side`` -> (wid, nb, nw, dot, normb, normw): joint TF-IDF of the
    ``max_features`` most frequent terms, mean row per side."""
    ship_package(index.sparkSession)
    side = index.select("wid", (F.col("side") == "baseline").alias("_base"), "ids", "rows", "terms", "df", "docs", "tf")

    def distance(table: pa.Table) -> pa.Table:
        t = {c: table.column(c).combine_chunks() for c in table.column_names}
        base = t["_base"].to_numpy(zero_copy_only=False).astype(np.int64)
        flat = {c: _flat(t[c]) for c in ("ids", "rows", "terms", "df", "docs", "tf")}
        rows, df, docs, tf = (flat[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("rows", "df", "docs", "tf"))
        n_ids, n_postings = lengths(t["ids"]), lengths(t["docs"])
        ids = flat["ids"].dictionary_encode("encode")
        doc_of = ids.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        n_docs = len(ids.dictionary)
        of_base = np.repeat(base, n_ids)
        copies = [np.bincount(doc_of, weights=rows * of_base, minlength=n_docs), np.bincount(doc_of, weights=rows * (1 - of_base), minlength=n_docs)]
        nb, nw = (int(c.sum()) for c in copies)
        dot = normb = normw = None
        if len(df):
            terms = flat["terms"].dictionary_encode()
            code = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            cf = np.bincount(code, weights=np.add.reduceat(tf, np.append(0, np.cumsum(df)[:-1])))
            least = np.partition(cf, -max_features)[-max_features] if len(cf) > max_features else 0
            likely = np.flatnonzero(cf >= least)
            names = terms.dictionary.take(pa.array(likely)).to_pylist()
            best = sorted(range(len(likely)), key=lambda i: (-cf[likely[i]], names[i]))[:max_features]
            feature = np.full(len(cf), -1)
            feature[likely[best]] = np.arange(len(best))
            of_posting = np.repeat(feature[code], df)
            doc = doc_of[docs + np.repeat(np.cumsum(n_ids) - n_ids, n_postings)]
            hit = of_posting >= 0
            # Rows of one id are one document, whichever batches they came in.
            key, where = np.unique(doc[hit] * len(best) + of_posting[hit], return_inverse=True)
            count, doc, of = np.bincount(where, weights=tf[hit]), key // len(best), key % len(best)
            v = count * (np.log((1 + nb + nw) / (1 + np.bincount(of, minlength=len(best)))) + 1)[of]
            weight = v / np.sqrt(np.bincount(doc, weights=v * v, minlength=n_docs))[doc]
            if ids.dictionary.null_count:  # a row without an id is no side's document
                weight = np.where(ids.dictionary.is_null().to_numpy(zero_copy_only=False)[doc], 0.0, weight)
            mb, mw = (np.bincount(of, weights=weight * c[doc], minlength=len(best)) / max(1, c.sum()) for c in copies)
            dot, normb, normw = float(mb @ mw), float(np.sqrt(mb @ mb)), float(np.sqrt(mw @ mw))
        return pa.table({"wid": pa.array([t["wid"][0].as_py()], pa.int64()), "nb": pa.array([nb], pa.int64()), "nw": pa.array([nw], pa.int64()),
                         **{k: pa.array([x], pa.float64()) for k, x in (("dot", dot), ("normb", normb), ("normw", normw))}})

    return side.groupBy("wid").applyInArrow(distance, "wid long, nb long, nw long, dot double, normb double, normw double")


def _counts_blob(terms: pa.StringArray, n: np.ndarray) -> tuple[bytes, int]:
    """Terms and their counts, compressed, and the size before."""
    if not len(terms):
        return b"", 0
    offsets = np.frombuffer(terms.buffers()[1], np.int32)[terms.offset: terms.offset + len(terms) + 1]
    text = terms.buffers()[2].slice(offsets[0], offsets[-1] - offsets[0]) if offsets[-1] > offsets[0] else b""
    raw = np.diff(offsets).tobytes() + n.astype(np.int32).tobytes() + memoryview(text)
    return _CODEC.compress(raw, asbytes=True), len(raw)


def _counts_of(blob: pa.Buffer, size: int, k: int) -> tuple[pa.StringArray, np.ndarray]:
    raw = _CODEC.decompress(blob, size) if k else pa.py_buffer(b"")
    lens, n = (np.frombuffer(raw, np.int32, k, at * k * 4) for at in (0, 1))
    offsets = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
    return pa.StringArray.from_buffers(k, pa.py_buffer(offsets), raw.slice(8 * k)), n


def packed_counts(docs: DataFrame, terms: Column) -> DataFrame:
    """``docs`` (wid, ..) as rows (wid, k, size, terms), one per slice and window: its k terms and how often each occurs."""
    ship_package(docs.sparkSession)

    def count(batches):
        for _, own, wids, lens, codes, terms in _tokens(batches, "_terms"):
            n_terms = max(1, len(terms))
            key, n = np.unique(np.repeat(own, lens) * n_terms + codes, return_counts=True)
            starts = np.searchsorted(key // n_terms, np.arange(len(wids) + 1))
            named = terms.take(pa.array(key % n_terms))
            blobs, sizes = zip(*[_counts_blob(named.slice(lo, to - lo), n[lo:to]) for lo, to in zip(starts, starts[1:])])
            yield pa.RecordBatch.from_arrays(
                [pa.array(wids, pa.int64()), _ints(np.diff(starts)), pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())],
                ["wid", "k", "size", "terms"])

    known = docs.filter(F.col("wid").isNotNull()).select(F.col("wid").cast("long"), terms.alias("_terms"))
    return known.mapInArrow(count, "wid long, k int, size long, terms binary")


def topic_weights(docs: DataFrame, tokens: Column, stop: Sequence[str], max_features: int) -> DataFrame:
    """``docs`` (wid, doc_id, text) -> (wid, term, weight): column sums of the row-normalised TF-IDF of each window's
    ``max_features`` most frequent words and bigrams, as ``linguistic.tfidf_rows`` defines them.

    The texts come by window, in order, and pass through the task: a window's words are held as codes until its last
    text has been seen.  Stop words are dropped from its vocabulary, not word by word, and only bigrams of two
    frequent words are made (a bigram is no more frequent than either).
    """
    ship_package(docs.sparkSession)
    stops = pa.array(stop, pa.string())

    def weights(pieces: list) -> tuple[list[str], np.ndarray]:
        ids = pa.chunked_array([p[0] for p in pieces]).dictionary_encode("encode").combine_chunks()
        if isinstance(ids, pa.ChunkedArray):
            ids = ids.chunk(0)
        lens = np.concatenate([p[1] for p in pieces])
        tokens = pa.chunked_array([p[2] for p in pieces]).unify_dictionaries()
        words = tokens.chunk(0).dictionary
        code = np.concatenate([c.indices.to_numpy(zero_copy_only=False) for c in tokens.chunks]).astype(np.int64)
        row = np.repeat(np.arange(len(lens)), lens)
        kept = ~pc.is_in(words, value_set=stops).to_numpy(zero_copy_only=False)[code]
        code, row = code[kept], row[kept]
        n_words = max(1, len(words))
        cf = np.bincount(code, minlength=n_words)
        least = max(1, np.partition(cf, -max_features)[-max_features]) if n_words > max_features else 1
        frequent = cf >= least
        pair = np.flatnonzero(frequent[code[:-1]] & frequent[code[1:]] & (row[:-1] == row[1:]))
        pairs, of_pair, n_pair = np.unique(code[pair] * n_words + code[pair + 1], return_inverse=True, return_counts=True)
        single = np.flatnonzero(frequent)
        count = np.concatenate([cf[single], n_pair])
        if not len(count):
            return [], np.zeros(0)
        least = np.partition(count, -max_features)[-max_features] if len(count) > max_features else 0
        likely = np.flatnonzero(count >= least)

        def name(i: int) -> str:
            if i < len(single):
                return words[single[i]].as_py()
            a, b = divmod(int(pairs[i - len(single)]), n_words)
            return f"{words[a].as_py()} {words[b].as_py()}"

        best = heapq.nsmallest(max_features, ((-int(count[i]), name(i), int(i)) for i in likely))
        feature = np.full(len(count), -1)
        feature[[i for _, _, i in best]] = np.arange(len(best))
        of_word = np.full(n_words, -1)
        of_word[single] = feature[: len(single)]
        of = np.concatenate([of_word[code], feature[len(single):][of_pair]])
        doc = ids.indices.to_numpy(zero_copy_only=False).astype(np.int64)[np.concatenate([row, row[pair]])]
        # Rows of one id are one document.
        key, tf = np.unique(doc[of >= 0] * len(best) + of[of >= 0], return_counts=True)
        doc, of = key // len(best), key % len(best)
        v = tf * (np.log((1 + len(lens)) / (1 + np.bincount(of, minlength=len(best)))) + 1)[of]
        weight = v / np.sqrt(np.bincount(doc, weights=v * v))[doc]
        return [term for _, term, _ in best], np.bincount(of, weights=weight, minlength=len(best))

    def run(batches):
        wid, held = None, []

        def rows(done: list) -> pa.RecordBatch:
            n = [len(terms) for _, (terms, _) in done]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.repeat([w for w, _ in done], n), pa.int64()), pa.array([t for _, (terms, _) in done for t in terms], pa.string()),
                 pa.array(np.concatenate([x for _, (_, x) in done]), pa.float64())], ["wid", "term", "weight"])

        for batch in batches:
            done = []
            for part, lens in slices(batch, lengths(batch.column("_tokens")), SLICE_TOKENS):
                wids, ends = part.column("wid").to_numpy(zero_copy_only=False), np.cumsum(lens)
                cuts = np.flatnonzero(np.diff(wids)) + 1
                flat = _flat(part.column("_tokens"))
                for lo, to in zip(np.append(0, cuts), np.append(cuts, len(wids))):
                    if wids[lo] != wid and held:
                        done.append((wid, weights(held)))
                        held = []
                    wid, first = wids[lo], ends[lo - 1] if lo else 0
                    held.append((part.column("doc_id").slice(lo, to - lo), lens[lo:to], flat.slice(first, ends[to - 1] - first).dictionary_encode()))
            if done:
                yield rows(done)
        if held:
            yield rows([(wid, weights(held))])

    known = docs.filter(F.col("wid").isNotNull()).select(F.col("wid").cast("long").alias("wid"), "doc_id", "text")
    by_window = known.repartition("wid").sortWithinPartitions("wid")
    return by_window.select("wid", "doc_id", tokens.alias("_tokens")).mapInArrow(run, "wid long, term string, weight double")


def aligned_counts(counts: DataFrame, key: str) -> DataFrame:
    """``packed_counts`` rows with their ``side`` -> (wid, key, b, w): each term's count in the baseline and in the window."""
    ship_package(counts.sparkSession)

    def align(table: pa.Table) -> pa.Table:
        parts = [_counts_of(blob.as_buffer(), size, k) for blob, size, k in
                 zip(table.column("terms"), table.column("size").to_pylist(), table.column("k").to_pylist())]
        base = np.repeat(table.column("_base").to_numpy(), [len(n) for _, n in parts])
        n = np.concatenate([n for _, n in parts])
        tokens = pa.concat_arrays([t for t, _ in parts]).dictionary_encode()
        code, size = tokens.indices.to_numpy(zero_copy_only=False), len(tokens.dictionary)
        both = {c: pa.array(np.bincount(code[m], weights=n[m], minlength=size).astype(np.int64)) for c, m in (("b", base), ("w", ~base))}
        return pa.table({"wid": pa.repeat(pa.scalar(table.column("wid")[0].as_py(), pa.int64()), size), key: tokens.dictionary, **both})

    side = counts.select("wid", (F.col("side") == "baseline").alias("_base"), "k", "size", "terms")
    return side.groupBy("wid").applyInArrow(align, f"wid long, {key} string, b long, w long")
