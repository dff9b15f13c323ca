"""Entity extractors (U2): a plug-in surface, a corpus gazetteer, and the regex they fall back to.

An extractor has a ``name`` and turns a list of texts into a list of entity key lists
(``LABEL:text``).  It runs in slices of Arrow batches, so that a worker never holds the texts and
answers of a whole batch as Python objects; a slice it fails on gets the built-in
proper-noun runs instead, and every row says which backend made its entities.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embdrift.functions import text as TX
from embdrift.operators.packed import slices
from embdrift.session import ship_package

REGEX = "regex"
WORD = r"[\p{L}\p{N}_]+"
#: A run of capitalised words in a text whose words have a blank on either side each.  Possessive, as nothing
#: is ever given back: a greedy group takes Java's stack for every word of a run, and a long run overflowed it.
CAPITALISED_RUN = r"(?: [A-Z][\p{L}\p{N}_]*+ )++"
#: UTF-8 bytes of the texts that an extractor gets at once; a longer text comes alone.
SLICE_BYTES = 1 << 20
_KEYS = pa.list_(pa.string())


class Extractor(Protocol):
    name: str

    def extract(self, texts: Sequence[str]) -> list[list[str]]: ...


def entities(df: DataFrame, extractor: Extractor | None = None, text_col: str = "text",
             out: str = "entities", backend: str = "backend") -> DataFrame:
    """``df`` with its entity keys (array, repeats included) and the backend that found them:
    the extractor's name, ``regex``, or ``regex (<name> failed)``.  Null texts have none."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    if extractor is None:
        return df.withColumns({out: TX.proper_noun_runs(text), backend: F.lit(REGEX)})
    ship_package(df.sparkSession)
    name = extractor.name

    def answer(texts: pa.Array) -> pa.Array:
        try:
            found = extractor.extract(texts.to_pylist())
            if len(found) != len(texts):
                raise ValueError("an extractor answers every text")
            return pa.StructArray.from_arrays([pa.array(found, _KEYS), pa.array([False] * len(texts))], ["keys", "failed"])
        except Exception:  # whatever a plug-in does, its texts are not lost, and the backend column tells
            return pa.StructArray.from_arrays([pa.array([[]] * len(texts), _KEYS), pa.array([True] * len(texts), pa.bool_())], ["keys", "failed"])

    @F.arrow_udf("keys array<string>, failed boolean")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for part, _ in slices(texts, pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64), SLICE_BYTES):
                yield answer(part)

    # One element through a generator: the extractor runs once a row, whatever reads its columns.
    found = df.select("*", F.explode(F.array(run(text))).alias("_found"))
    return found.withColumns({
        out: F.when(F.col("_found.failed"), TX.proper_noun_runs(text)).otherwise(F.col("_found.keys")),
        backend: F.when(F.col("_found.failed"), f"{REGEX} ({name} failed)").otherwise(name)}).drop("_found")


def spaced_words(text) -> Column:
    """The words of a text with a blank on either side each, so that phrases match at word bounds only."""
    return F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(text, F.lit(WORD), 0), "  "), F.lit(" "))


def learn_gazetteer(docs: DataFrame, min_documents: int = 5, entries: int = 20_000, max_words: int = 5,
                    max_chars: int = 80, text_col: str = "text") -> Gazetteer:
    """Capitalised runs of up to ``max_words`` words that at least ``min_documents`` documents hold,
    the ``entries`` most frequent ones (ties by spelling).

    Counted over all documents, each once per document; ``entries`` * ``max_chars``
    characters at most come to the driver and go to the tasks.
    """
    runs = F.regexp_extract_all(spaced_words(text_col), F.lit(CAPITALISED_RUN), 0)
    keys = F.array_distinct(F.transform(runs, lambda r: F.replace(F.trim(F.lower(r)), F.lit("  "), F.lit(" "))))
    short = F.filter(keys, lambda k: (F.length(k) <= max_chars) & (F.size(F.split(k, " ")) <= max_words))
    gen, ok = TX.explode_tokens(short, "entry")
    counted = docs.select(gen).filter(ok).groupBy("entry").agg(F.count("*").alias("n")).filter(F.col("n") >= min_documents)
    return Gazetteer([r.entry for r in counted.orderBy(F.desc("n"), "entry").limit(entries).collect()])


class Gazetteer:
    """Known phrases, found by an Aho-Corasick automaton in one pass over a text.

    At each word the longest phrase that begins there counts, unless it lies
    within one that began before.
    """

    name = "gazetteer"

    def __init__(self, entries: Sequence[str]):
        self.entries = tuple(entries)

    def __getstate__(self):
        return {"entries": self.entries}

    def _automaton(self):
        if "_built" not in self.__dict__:
            import ahocorasick

            self._built = ahocorasick.Automaton()
            for e in self.entries:
                phrase = " " + e.replace(" ", "  ") + " "
                self._built.add_word(phrase, (len(phrase), "GAZ:" + e))
            self._built.make_automaton()
        return self._built

    def extract(self, texts: Sequence[str]) -> list[list[str]]:
        if not self.entries:
            return [[] for _ in texts]
        automaton, out = self._automaton(), []
        for text in texts:
            words = " " + "  ".join(re.findall(r"\w+", text)).lower() + " "
            longest: dict[int, tuple[int, str]] = {}
            for end, (size, entry) in automaton.iter(words):
                start = end - size + 1
                longest[start] = max(longest.get(start, (0, "")), (end, entry))
            found, reach = [], -1
            for start in sorted(longest):
                end, entry = longest[start]
                if end > reach:
                    found.append(entry)
                    reach = end
            out.append(found)
        return out
