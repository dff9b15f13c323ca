"""Quality rules: text statistics and a learned decision list, all in Spark expressions.

``text_stats`` computes the statistics of a whole text inside its row. ``learn_rules`` covers the
labelled rows sequentially: a rule grows one threshold condition at a time on two thirds of the
rows, is pruned on the other third, and the rows it covers leave before the next rule is grown.
Every step is one DataFrame aggregate over all labelled rows that are left; only histograms of
fixed size reach the driver. ``verdict`` turns the ordered rules into one conditional expression.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embdrift.llm.common import SPACE, evaluated, packed, stored, unpacked

SYMBOLS = "#*$%&|<>"

#: Statistics on which rules may test: name -> Spark SQL over the columns of ``text_stats``.
FEATURES = {
    "words": "cast(n_words as double)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_words": "n_repeat_words / greatest(n_words, 1)",
    "upper_chars": "n_upper / greatest(word_chars, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "digits": "n_digits / greatest(word_chars, 1)",
}


#: Columns that ``text_stats`` adds; input columns of these names are replaced.
STATS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_digits")


def text_stats(docs: DataFrame) -> DataFrame:
    """``docs`` with the statistics of its text (null text: no words, all zero).

    n_words, word_chars (code points in words), n_symbols (characters of SYMBOLS), n_lines (lines
    with a word), n_dup_lines (of those, equal to an earlier one), n_repeat_words (words inside
    3-word windows that occur twice or more, first included), n_upper, n_marks, n_digits.

    Windows and lines are compared by 64-bit hash inside one text. Repeated windows are found by
    sorting (hash, place) pairs, only where there are repeats, so long texts cost n log n.
    """
    d = packed(docs, "text").withColumn("_body", F.coalesce(F.col("text"), F.lit(""))).drop("text")
    d = evaluated(
        d, _words=F.expr(f"array_remove(split(_body, '[{_esc_class()}]+'), '')"),
        _lines=F.expr(f"transform(filter(split(_body, '\\\\n'), l -> l rlike '[^{_esc_class()}]'), l -> xxhash64(l))"))
    d = evaluated(d, _win=F.expr(
        "CASE WHEN size(_words) >= 3 THEN transform(sequence(1, size(_words) - 2), "
        "i -> xxhash64(_words[i - 1], _words[i], _words[i + 1])) ELSE cast(array() AS array<bigint>) END"))
    d = evaluated(d, _has=F.expr("size(array_distinct(_win)) < size(_win)"))
    # (hash, place) pairs in order: a pair whose neighbour has its hash is a repeated window.
    d = evaluated(d, _pairs=F.expr(
        "CASE WHEN _has THEN sort_array(transform(_win, (h, i) -> struct(h AS h, i AS i))) END"))
    d = evaluated(d, _at=F.expr(
        "CASE WHEN _has THEN sort_array(transform(filter(_pairs, (p, k) -> "
        "(k > 0 AND _pairs[greatest(k - 1, 0)].h = p.h) OR (k + 1 < size(_pairs) AND _pairs[least(k + 1, size(_pairs) - 1)].h = p.h)), "
        "p -> p.i)) END"))
    # Every repeated window covers three words, less where the next one begins sooner.
    repeat = F.expr("CASE WHEN _has THEN aggregate(_at, struct(0L AS n, -3 AS last), "
                    "(s, i) -> struct(s.n + least(3, i - s.last) AS n, i AS last), s -> s.n) ELSE 0L END")

    def only(pattern: str) -> Column:
        return F.regexp_count(F.col("_body"), F.lit(pattern)).cast("bigint")

    d = evaluated(
        d, n_words=F.size("_words").cast("bigint"),
        word_chars=F.length(F.array_join("_words", "")).cast("bigint"),
        n_symbols=only(f"[{SYMBOLS}]"),
        n_lines=F.size("_lines").cast("bigint"),
        n_dup_lines=F.expr("cast(size(_lines) - size(array_distinct(_lines)) as bigint)"),
        n_repeat_words=repeat,
        n_upper=only(r"\p{Lu}"),
        n_marks=only("[!?]"), n_digits=only("[0-9]"))
    return unpacked(d, docs, without=STATS, also=STATS)


def _esc_class() -> str:
    return SPACE.replace("\\", "\\\\")


def base_failed() -> Column:
    """The fixed base rule: too few words, or more than half of them repeated."""
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # feature >= threshold, else feature < threshold
    threshold: float

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>=' if self.above else '<'} {self.threshold!r}D"


@dataclass(frozen=True)
class Rule:
    """All conditions hold: the text is ``bad``."""

    conditions: tuple[Condition, ...]

    def sql(self) -> str:
        return " AND ".join(c.sql() for c in self.conditions)


def verdict(rules: Sequence[Rule]) -> Column:
    """True (keep) unless a rule of the ordered list fires first."""
    if not rules:
        return F.lit(True)
    return F.expr("CASE " + " ".join(f"WHEN {r.sql()} THEN false" for r in rules) + " ELSE true END")


def _histogram(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[tuple[str, int], tuple[int, int]]:
    """(feature, bin) -> (bad, good) counts; a bin is the number of cuts at or below the value.

    The result has at most features * (cuts + 1) rows, whatever the input.
    """
    def bin_of(f: str, cs: list[float]) -> Column:
        return F.size(F.filter(F.array(*[F.lit(c) for c in cs]), lambda c: c <= F.col(f)))

    bins = F.array(*[F.struct(F.lit(f).alias("f"), bin_of(f, cs).alias("b")) for f, cs in cuts.items()])
    got = (rows.select(F.explode(bins).alias("x"), "label").groupBy("x.f", "x.b")
           .agg(F.sum(F.when(F.col("label") == 0, 1).otherwise(0)).alias("bad"),
                F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("good")).collect())
    return {(r.f, r.b): (r.bad, r.good) for r in got}


def _grow(rows: DataFrame, cuts: dict[str, list[float]], max_conditions: int) -> list[Condition]:
    """Conditions added one by one while each raises the information gain of the covered rows."""
    out: list[Condition] = []
    here = rows
    while len(out) < max_conditions:
        hist = _histogram(here, cuts)
        first = next(iter(cuts))
        bad0, good0 = (sum(v[k] for (f, _), v in hist.items() if f == first) for k in (0, 1))
        if not bad0 or not good0:
            break
        best: tuple[float, Condition] | None = None
        for f, cs in cuts.items():
            counts = [hist.get((f, b), (0, 0)) for b in range(len(cs) + 1)]
            for k, cut in enumerate(cs):
                over = [sum(c[j] for c in counts[k + 1:]) for j in (0, 1)]
                for above in (True, False):
                    bad, good = over if above else (bad0 - over[0], good0 - over[1])
                    if not bad:
                        continue
                    gain = bad * (math.log2(bad / (bad + good)) - math.log2(bad0 / (bad0 + good0)))
                    if best is None or gain > best[0] + 1e-9:
                        best = (gain, Condition(f, above, cut))
        if best is None or best[0] <= 0:
            break
        out.append(best[1])
        here = here.where(best[1].sql())
    return out


def _prune(rows: DataFrame, conditions: list[Condition]) -> tuple[list[Condition], int, int]:
    """The prefix of the conditions with the best (bad - good) / covered on the pruning rows."""
    sums = []
    for k in range(1, len(conditions) + 1):
        hit = F.expr(Rule(tuple(conditions[:k])).sql())
        sums += [F.sum(F.when(hit & (F.col("label") == v), 1).otherwise(0)).alias(f"n{k}_{v}") for v in (0, 1)]
    r = rows.agg(*sums).first()
    scored = [((r[f"n{k}_0"] or 0), (r[f"n{k}_1"] or 0), k) for k in range(1, len(conditions) + 1)]
    bad, good, k = max(scored, key=lambda s: ((s[0] - s[1]) / max(1, s[0] + s[1]), s[0], -s[2]))
    return conditions[:k], bad, good


def learn_rules(stats: DataFrame, cuts_per_feature: int = 24, max_rules: int = 8, max_conditions: int = 4,
                min_precision: float = 0.97) -> list[Rule]:
    """An ordered decision list for label 0 (bad) from ``text_stats`` rows with a 0/1 ``label``.

    All rows take part: two thirds by a hash of the id grow rules, the rest prunes them. A rule is
    kept when at least ``min_precision`` of the pruning rows that it covers are bad; learning ends
    with the first that is not (or covers none). Without labels of both kinds there are no rules.
    """
    rows = stats.where(F.col("label").isin(0, 1)).select(
        "doc_id", "label", *STATS, *[F.expr(e).alias(f) for f, e in FEATURES.items()])
    rows = stored(rows, "rule-rows")  # every step reads these few numbers again
    probs = [k / (cuts_per_feature + 1) for k in range(1, cuts_per_feature + 1)]
    # Thresholds: quantiles of each label on its own, so that a rare kind has cuts of its own.
    q = rows.groupBy("label").agg(*[F.percentile_approx(f, probs, 10_000).alias(f) for f in FEATURES]).collect()
    cuts = {f: sorted({float(x) for r in q for x in (r[f] or [])}) for f in FEATURES}
    cuts = {f: c for f, c in cuts.items() if c}
    if len(q) < 2 or not cuts:
        return []
    third = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    grow, prune, rules = rows.where(~third), rows.where(third), []
    while len(rules) < max_rules:
        conditions = _grow(grow, cuts, max_conditions)
        if not conditions:
            break
        conditions, bad, good = _prune(prune, conditions)
        if not bad or bad < min_precision * (bad + good):
            break
        rules.append(Rule(tuple(conditions)))
        covered = F.expr(rules[-1].sql())
        grow, prune = grow.where(~covered), prune.where(~covered)
    return rules


def apply_rules(stats: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``stats`` with base_failed and kept (false if base_failed, else the list's verdict)."""
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & verdict(rules))
