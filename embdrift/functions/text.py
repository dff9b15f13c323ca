"""Text column functions (JVM regex / hash expressions, no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.split() whitespace set, written as a regex class that
# Java and RE2 both accept, so Spark and the DuckDB oracle split identically.
PY_WHITESPACE = (r"[\t\n\x{0b}\x{0c}\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
                 r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
NON_WHITESPACE = "[^" + PY_WHITESPACE[1:]

# Token and proper-noun patterns of the text-drift analyzer.
TOKEN_PATTERN = r"[A-Za-z][A-Za-z0-9_-]{2,}"
ENTITY_PATTERN = r"\b(?:[A-Z][A-Za-z0-9_-]{2,})(?:\s+(?:[A-Z][A-Za-z0-9_-]{2,}))*\b"
ENTITY_STOP = ("the", "and")

# Finds what ENTITY_PATTERN finds, but gives nothing back across words: there a greedy group takes Java's stack for
# every word, and a run of some 1,500 words overflowed it, which ends the executor.  Only the last word can be cut
# (to a word bound), or be no end at all where no bound lies behind its third character.  So a word and
# the space behind it are taken for good where a word that can be the end follows, past words such as "Ab--" that cannot.
_NAME = "[A-Z][A-Za-z0-9_-]{2,}"
ENTITY_RUN = rf"\b(?:{_NAME}+\s++(?=(?:[A-Z][A-Za-z0-9_-]-++\s++)*+{_NAME}\b))*+{_NAME}\b"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_ws(text) -> Column:
    """Python ``str.strip()`` (Unicode whitespace), not Spark's space-only ``trim``."""
    return F.regexp_replace(_c(text), f"^{PY_WHITESPACE}+|{PY_WHITESPACE}+$", "")


def words(text) -> Column:
    """Python ``str.split()``: whitespace runs, no empty words."""
    s = strip_ws(text)
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, f"{PY_WHITESPACE}+"))


def word_count(text) -> Column:
    return F.size(words(text))


def content_hash(text) -> Column:
    """sha256 hex of the UTF-8 text."""
    return F.sha2(_c(text), 256)


def iso_utc(ts) -> Column:
    """Python ``datetime.isoformat()`` of a UTC timestamp: micros only when non-zero."""
    ts = _c(ts)
    micros = F.unix_micros(ts) % 1_000_000
    frac = F.when(micros == 0, F.lit("")).otherwise(F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0")))
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), frac, F.lit("+00:00"))


def idempotency_key(source, external_id, ts) -> Column:
    """sha256 of ``source:document_id:isoformat(timestamp)``."""
    return F.sha2(F.concat_ws(":", _c(source), _c(external_id), iso_utc(ts)), 256)


def object_key(source, key) -> Column:
    """P5: archive object key ``source/key.json``."""
    return F.concat(_c(source), F.lit("/"), _c(key), F.lit(".json"))


def tokens(text) -> Column:
    """Lower-cased vocabulary tokens (array)."""
    return F.transform(F.regexp_extract_all(_c(text), F.lit(TOKEN_PATTERN), 0), lambda x: F.lower(x))


def proper_noun_runs(text) -> Column:
    """Capitalised-word runs as ``PROPER:<lower>`` keys; 'the'/'and' dropped.

    ``(?U)`` makes ``\\b`` and ``\\s`` Unicode-aware as in Python's ``re``.
    """
    runs = F.regexp_extract_all(_c(text), F.lit("(?U)" + ENTITY_RUN), 0)
    keys = F.transform(runs, lambda x: F.lower(F.trim(x)))
    kept = F.filter(keys, lambda x: ~x.isin(*ENTITY_STOP))
    return F.transform(kept, lambda x: F.concat(F.lit("PROPER:"), x))


def split_entity_key(key) -> tuple[Column, Column]:
    """``LABEL:text`` split at the first colon -> (label, text)."""
    k = _c(key)
    pos = F.instr(k, ":")
    return k.substr(F.lit(1), pos - 1), k.substr(pos + 1, F.length(k))


def topic_terms(label) -> Column:
    """Topic label split on '_' with empties dropped."""
    return F.filter(F.split(_c(label), "_"), lambda x: x != "")


def short_label(text, n: int = 80) -> Column:
    """Text label cut to ``n`` characters."""
    return F.substring(_c(text), 1, n)


def align_floor(ts, step_seconds: int) -> Column:
    """Floor epoch seconds to a multiple of ``step_seconds``."""
    s = F.unix_seconds(_c(ts))
    return F.timestamp_seconds(s - F.pmod(s, F.lit(step_seconds)))


def explode_tokens(arr, name: str):
    """Explode a per-document token array into rows, evaluated once per document.

    ``explode`` makes the optimizer infer ``size(arr) > 0`` and push it below
    earlier operators, which evaluates the whole tokenizer twice; the outer
    form plus a NULL filter keeps one evaluation.
    Returns (generator column, filter condition).
    """
    return F.explode_outer(arr).alias(name), F.col(name).isNotNull()
