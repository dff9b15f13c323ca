"""Text drift: counts (A5), chi-square (A6), JS distance (A7), topics (A8-A10),
emerging lists (T5-T7), window resolution and reports (L1-L3).

Input everywhere is a *sides* frame ``(wid, side, doc_id, text[, occurred_at])``:
``side`` is ``baseline`` or ``window`` and ``wid`` names the comparison, so one
job scores one window (L2) or every window at once (L3).  Counts stay long
(``wid, side, key, n``) and are map-side combined; per-window totals are
one-row-per-window aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import NGram, StopWordsRemover
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from embdrift import config
from embdrift.functions import stopwords
from embdrift.functions import text as TX
from embdrift.functions.stats import chi2_sf
from embdrift.functions.vectors import clamp01
from embdrift.operators.extractors import REGEX, Extractor, entities
from embdrift.operators.packed import aligned_counts, centroid_distances, packed_counts, packed_index, topic_weights
from embdrift.operators.ranking import global_rank
from embdrift.session import written
from embdrift.sources.tables import dealt

BASELINE, WINDOW = "baseline", "window"
# Fewest documents of either side, and the limits of the report lists and topics.
MIN_BASELINE_DOCUMENTS = 10
MIN_WINDOW_DOCUMENTS = 2
TERM_GAIN, TERM_COUNT, TOPIC_GAIN = 1.5, 2, 0.05
TOPIC_FEATURES, TOPICS, CENTROID_FEATURES = 12, 6, 128
# Fixed value: scikit-style word token of the keyword topic model, Unicode letters/digits.
TOPIC_TOKEN = r"[\p{L}\p{N}_]{2,}"
G = ("wid",)


def non_blank(sides: DataFrame, text_col: str = "text") -> DataFrame:
    """Blank texts are dropped before any profile is built (a non-whitespace
    character anywhere; no full-text strip)."""
    return sides.filter(F.col(text_col).rlike(TX.NON_WHITESPACE))


class Sides:
    """Which documents form the baseline and the window of each comparison ``wid``.

    ``split``: ``docs`` carry (wid, side) already (one resolved window, L1/L2).
    ``prev``: ``docs`` carry their own tumbling window id; each window is
    compared with the window before it (L3).  Text is tokenised once per
    document; only the aggregated rows are copied to the two sides
    (``expand``), so the texts are never duplicated.
    """

    def __init__(self, docs: DataFrame, mode: str = "split", min_baseline: int = 0, min_window: int = 0):
        kept = [c for c in docs.columns if c in ("wid", "side", "doc_id", "text")]
        self.docs = non_blank(dealt(docs.select(*kept)))
        self.mode = mode
        self.local = mode == "prev"  # many groups, none large: a group's texts may meet in one task
        self.keys = ["wid", "side"] if mode == "split" else ["wid"]
        self.valid = None
        if mode == "prev":
            n = self.docs.groupBy("wid").agg(F.count("*").alias("n"))
            per = self.expand_raw(n).groupBy("wid").agg(
                F.sum(F.when(F.col("side") == BASELINE, F.col("n")).otherwise(0)).alias("nb"),
                F.sum(F.when(F.col("side") == WINDOW, F.col("n")).otherwise(0)).alias("nw"))
            self.valid = per.filter((F.col("nb") >= min_baseline) & (F.col("nw") >= min_window)).select("wid")

    def expand_raw(self, df: DataFrame) -> DataFrame:
        if self.mode == "split":
            return df
        # One branch, rows copied by explode (a union would evaluate the input twice).
        c = df.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1))))
        return (c.withColumn("wid", F.col("wid") + F.col("_copy"))
                 .withColumn("side", F.when(F.col("_copy") == 0, F.lit(WINDOW)).otherwise(F.lit(BASELINE)))
                 .drop("_copy"))

    def expand(self, df: DataFrame) -> DataFrame:
        out = self.expand_raw(df)
        return out.join(self.valid, "wid", "left_semi") if self.valid is not None else out

    def doc_sides(self) -> DataFrame:
        """(wid, side, doc_id) membership rows."""
        return self.expand(self.docs.select(*self.keys, "doc_id"))

    def doc_counts(self) -> DataFrame:
        """(wid, side, n_docs)."""
        c = self.docs.groupBy(*self.keys).agg(F.count("*").alias("n_docs"))
        return self.expand(c)


# ------------------------------------------------------------------ A5
def _token_counts(sides: Sides, tokens: Column, name: str, packed: bool) -> DataFrame:
    """(wid, side, ``name``, n), or packed rows (wid, side, terms, n) where ``packed`` and the windows are tumbling.

    Tumbling windows are counted in their Arrow batch and merged one window at a time; the counts of a
    large group are map-side combined and dealt by term.
    """
    if sides.local:
        own = packed_counts(sides.docs, tokens)
        if packed:
            return sides.expand(own)
        merged = aligned_counts(own.withColumn("side", F.lit(WINDOW)), name)
        return sides.expand(merged.select("wid", name, F.col("w").alias("n")))
    gen, ok = TX.explode_tokens(tokens, name)
    t = sides.docs.select(*sides.keys, gen).filter(ok)
    return sides.expand(t.groupBy(*sides.keys, name).agg(F.count("*").alias("n")))


def term_counts(sides: Sides, packed: bool = False) -> DataFrame:
    """A5 vocabulary: (wid, side, term, n) from P17 tokens; ``packed`` for ``align_counts``."""
    return _token_counts(sides, TX.tokens("text"), "term", packed)


def entity_counts(sides: Sides, extractor: Extractor | None = None, packed: bool = False) -> DataFrame:
    """A5 entities: (wid, side, entity, n) from P18 proper-noun runs, ``packed`` for ``align_counts``; with
    an ``extractor`` (U2) from its keys, and (.., backend, n) then: a row per backend that found the entity."""
    if extractor is not None:
        found = entities(sides.docs, extractor)
        gen, ok = TX.explode_tokens(F.col("entities"), "entity")
        t = found.select(*sides.keys, "backend", gen).filter(ok)
        return sides.expand(t.groupBy(*sides.keys, "entity", "backend").agg(F.count("*").alias("n")))
    return _token_counts(sides, TX.proper_noun_runs("text"), "entity", packed)


# ------------------------------------------------------------------ J9
def align_counts(counts: DataFrame, key: str) -> DataFrame:
    """Union of keys per window with 0 for a missing side (one groupBy, no full outer join);
    packed counts are merged a comparison at a time."""
    if "terms" in counts.columns:
        return aligned_counts(counts, key)
    return counts.groupBy("wid", key).agg(
        F.sum(F.when(F.col("side") == BASELINE, F.col("n")).otherwise(0)).alias("b"),
        F.sum(F.when(F.col("side") == WINDOW, F.col("n")).otherwise(0)).alias("w"))


# ------------------------------------------------------------------ A6
def vocab_chi2(aligned: DataFrame, with_pvalue: bool = True) -> DataFrame:
    """2 x V contingency chi-square per window.

    Σ (o-e)²/e = T·(Σ b²/c / B + Σ w²/c / W) − T with c = b + w, so a single
    aggregate pass gives the statistic; no per-term join with the totals.
    p = 1 when V < 2 or a side is empty.
    """
    c = F.col("b") + F.col("w")
    agg = aligned.groupBy("wid").agg(
        F.sum("b").alias("tb"), F.sum("w").alias("tw"), F.count("*").alias("nk"),
        F.sum(F.col("b") * F.col("b") / c).alias("sb"), F.sum(F.col("w") * F.col("w") / c).alias("sw"))
    T = F.col("tb") + F.col("tw")
    ok = (F.col("nk") >= 2) & (F.col("tb") > 0) & (F.col("tw") > 0)
    stat = F.when(ok, T * (F.col("sb") / F.col("tb") + F.col("sw") / F.col("tw")) - T)
    out = agg.select("wid", stat.alias("statistic"),
                     F.greatest(F.lit(1), F.col("nk") - 1).alias("dof"),
                     F.col("nk").alias("vocabulary"))
    if with_pvalue:
        out = out.withColumn("pvalue", F.when(F.col("statistic").isNull(), F.lit(1.0))
                             .otherwise(chi2_sf("statistic", "dof")))
    return out


# ------------------------------------------------------------------ A7
def js_distance(aligned: DataFrame) -> DataFrame:
    """Jensen-Shannon distance (base 2) of the +1e-9 smoothed distributions, clamped."""
    tot = aligned.groupBy("wid").agg(F.sum("b").alias("tb"), F.sum("w").alias("tw"), F.count("*").alias("nk"))
    j = aligned.join(tot, "wid")
    eps = 1e-9
    p = (F.col("b") + eps) / (F.col("tb") + eps * F.col("nk"))
    q = (F.col("w") + eps) / (F.col("tw") + eps * F.col("nk"))
    m = (p + q) / 2
    term = p * F.log(p / m) + q * F.log(q / m)
    js = j.groupBy("wid").agg(F.sum(term).alias("s"))
    return js.select("wid", clamp01(F.sqrt(F.col("s") / F.log(F.lit(2.0)) / 2)).alias("entity_distance"))


# ------------------------------------------------------------------ A9
def _topic_tokens() -> Column:
    return F.regexp_extract_all(F.lower("text"), F.lit(TOPIC_TOKEN), 0)


def _topic_terms(df: DataFrame, stop: Sequence[str], ngrams: bool) -> DataFrame:
    """Lower-cased word tokens, stop words removed, then bigrams of what is left.

    Spark ML's ``StopWordsRemover`` (hash-set lookup) and ``NGram`` run in the
    JVM over the token array; bigrams are formed after stop-word removal.
    """
    toks = df.withColumn("_tok", _topic_tokens())
    kept = StopWordsRemover(inputCol="_tok", outputCol="_kept", stopWords=list(stop),
                            caseSensitive=True).transform(toks)
    if not ngrams:
        return kept.withColumn("_terms", F.col("_kept"))
    bi = NGram(n=2, inputCol="_kept", outputCol="_bi").transform(kept)
    return bi.withColumn("_terms", F.concat("_kept", "_bi"))


def tfidf_rows(sides: Sides, by_side: bool, max_features: int, ngrams: bool,
               stop: Sequence[str] | None = None) -> DataFrame:
    """Row-normalised TF-IDF restricted to the ``max_features`` most frequent
    terms of each group ((wid, side) when ``by_side``, else wid).

    Two passes over the tokens: (1) corpus frequency per (group, term),
    map-side combined, picks the features; (2) per-document counts only for
    tokens of those features (a join with the small feature table), so the
    full (document, term) table is never shuffled.  Large groups
    (``split``) count single words first and bigrams of frequent words only.
    Returns (group..., doc_id, term, weight) for non-zero weights.
    """
    stop = tuple(stop if stop is not None else stopwords.english())
    keys = ["wid", "side"] if by_side else ["wid"]
    own = sides.keys
    docs = sides.docs.select(*own, "doc_id", "text")
    far = by_side and sides.mode == "split"
    terms = _topic_terms(docs, stop, ngrams and not far)
    gen, ok = TX.explode_tokens(F.col("_terms"), "term")
    ex = terms.select(*own, "doc_id", gen).filter(ok)
    cf_own = ex.groupBy(*own, "term").agg(F.count("*").alias("cf"))
    if far:
        tf = _frequent_terms(terms, cf_own, keys, max_features, ngrams)
        cf = tf.groupBy(*keys, "term").agg(F.sum("tf").alias("cf"))
    else:
        cf = sides.expand(cf_own).groupBy(*keys, "term").agg(F.sum("cf").alias("cf"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("cf"), F.asc("term")))
    feats = cf.withColumn("_r", rank).filter(F.col("_r") <= max_features).select(*keys, "term")
    if far:
        dt = tf.join(F.broadcast(feats), [*keys, "term"])  # at most ``max_features`` terms a group
    else:
        # features of comparison wid come from own windows wid (window) and wid-1 (baseline)
        need = feats.select("wid", "term").unionByName(
            feats.select((F.col("wid") - 1).alias("wid"), "term")).distinct()
        dt_own = ex.join(need, ["wid", "term"]).groupBy("wid", "doc_id", "term").agg(F.count("*").alias("tf"))
        dt = sides.expand(dt_own)
        if not by_side:
            dt = dt.drop("side")
        dt = dt.join(feats, [*keys, "term"])
    df_ = dt.groupBy(*keys, "term").agg(F.count("*").alias("df"))
    ndocs = sides.doc_counts().groupBy(*keys).agg(F.sum("n_docs").alias("n_docs"))
    idf = df_.join(ndocs, keys).select(*keys, "term",
                                       (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"))
    x = dt.join(idf, [*keys, "term"]).withColumn("v", F.col("tf") * F.col("idf"))
    nrm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(*keys, "doc_id")))
    return x.select(*keys, "doc_id", "term", (F.col("v") / nrm).alias("weight"))


def _frequent_terms(terms: DataFrame, words: DataFrame, keys: list[str], max_features: int, ngrams: bool) -> DataFrame:
    """(keys..., doc_id, term, tf) of every term that can be among the ``max_features`` most frequent of its group;
    ``words`` are the groups' single words with their frequency ``cf``.

    A bigram is no more frequent than either of its words, so only words as frequent as the word in place
    ``max_features`` (ties included) and bigrams of two such words come into question: the other bigrams, most
    of the corpus' different terms, are never made or counted.  Written once, as features and weights read it.
    """
    place = F.rank().over(Window.partitionBy(*keys).orderBy(F.desc("cf")))
    lists = (words.withColumn("_r", place).filter(F.col("_r") <= max_features)
             .groupBy(*keys).agg(F.collect_list("term").alias("_freq")))
    # A row a group, its words few: the texts stay where they are.
    marked = terms.join(F.broadcast(lists), keys).withColumn(
        "_mark", F.transform("_terms", lambda t: F.when(F.array_contains("_freq", t), t)))
    hits = F.col("_mark")
    if ngrams:
        after = F.slice("_mark", F.lit(2), F.size("_mark"))
        hits = F.concat(hits, F.zip_with("_mark", after, lambda a, b: F.concat(a, F.lit(" "), b)))
    gen, ok = TX.explode_tokens(F.filter(hits, lambda t: t.isNotNull()), "term")
    return written(marked.select(*keys, "doc_id", gen).filter(ok)
                   .groupBy(*keys, "doc_id", "term").agg(F.count("*").alias("tf")))


def keyword_topics(sides: Sides, max_features: int = TOPIC_FEATURES, top: int = TOPICS,
                   stop: Sequence[str] | None = None) -> DataFrame:
    """(wid, side, label, share): best ``top`` TF-IDF column sums, as shares.

    A topic distribution depends only on the documents of one side, so it is
    computed once per own group (a document window in backfill mode) and only
    the <= ``top`` result rows are copied to the comparisons that use it.
    """
    if sides.local:
        stop = tuple(stop if stop is not None else stopwords.english())
        col = topic_weights(sides.docs, _topic_tokens(), stop, max_features).withColumn("side", F.lit(WINDOW))
    else:
        rows = tfidf_rows(sides, True, max_features, True, stop)
        col = rows.groupBy("wid", "side", "term").agg(F.sum("weight").alias("weight"))
    # Equal weights tie whatever the order of their float sums: compared after rounding.
    rank = F.row_number().over(Window.partitionBy("wid", "side").orderBy(F.desc(F.round("weight", 9)), F.asc("term")))
    best = col.withColumn("_r", rank).filter(F.col("_r") <= top)
    total = F.sum("weight").over(Window.partitionBy("wid", "side"))
    out = best.select("wid", "side", F.col("term").alias("label"), (F.col("weight") / total).alias("share"))
    if sides.mode == "prev":
        return sides.expand(out.drop("side"))
    return out


# ------------------------------------------------------------------ A8
def topic_wasserstein(topics: DataFrame) -> DataFrame:
    """1-D Wasserstein over the sorted union of labels at positions 0..n-1.

    = Σ_{i<n-1} |CDF_u(i) − CDF_v(i)|, clamped.  One side without topics -> 1.0.
    """
    al = topics.groupBy("wid", "label").agg(
        F.sum(F.when(F.col("side") == BASELINE, F.col("share")).otherwise(0.0)).alias("u"),
        F.sum(F.when(F.col("side") == WINDOW, F.col("share")).otherwise(0.0)).alias("v"))
    w = Window.partitionBy("wid").orderBy("label")
    whole = Window.partitionBy("wid")
    # Column names differ by more than case: Spark resolves them without it.
    al = (al.withColumn("total_u", F.sum("u").over(whole)).withColumn("total_v", F.sum("v").over(whole))
            .withColumn("cdf_u", F.try_divide(F.sum("u").over(w.rowsBetween(Window.unboundedPreceding, 0)), "total_u"))
            .withColumn("cdf_v", F.try_divide(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)), "total_v"))
            .withColumn("_last", F.row_number().over(w.orderBy(F.desc("label"))) == 1))
    diff = F.when(F.col("_last"), F.lit(0.0)).otherwise(F.abs(F.col("cdf_u") - F.col("cdf_v")))
    agg = al.groupBy("wid").agg(F.sum(diff).alias("d"), F.min("total_u").alias("total_u"), F.min("total_v").alias("total_v"))
    d = F.when((F.col("total_u") <= 0) | (F.col("total_v") <= 0), F.lit(1.0)).otherwise(F.col("d"))
    return agg.select("wid", clamp01(d).alias("topic_distance"))


# ------------------------------------------------------------------ A10
def document_centroid_distance(sides: Sides, max_features: int = CENTROID_FEATURES,
                               stop: Sequence[str] | None = None) -> DataFrame:
    """A10: joint unigram TF-IDF per window, mean row per side, 1 − cosine, clamped.

    Tumbling windows: the texts are cut once, each window's postings are packed and copied to its two
    comparisons, which are scored one at a time (``packed``).
    """
    if sides.local:
        terms = _topic_terms(sides.docs.select("wid", "doc_id", "text"), stop if stop is not None else stopwords.english(), False)
        return _centroid_distance(centroid_distances(sides.expand(packed_index(terms, F.col("_terms"))), max_features))
    rows = tfidf_rows(sides, False, max_features, False, stop)
    nd = sides.doc_counts()
    n_side = nd.groupBy("wid").agg(
        F.sum(F.when(F.col("side") == BASELINE, F.col("n_docs")).otherwise(0)).alias("nb"),
        F.sum(F.when(F.col("side") == WINDOW, F.col("n_docs")).otherwise(0)).alias("nw"))
    r = rows.join(sides.doc_sides(), ["wid", "doc_id"])
    m = r.groupBy("wid", "term").agg(
        F.sum(F.when(F.col("side") == BASELINE, F.col("weight")).otherwise(0.0)).alias("sb"),
        F.sum(F.when(F.col("side") == WINDOW, F.col("weight")).otherwise(0.0)).alias("sw"))
    m = m.join(n_side, "wid").select("wid", F.try_divide("sb", "nb").alias("mb"), F.try_divide("sw", "nw").alias("mw"))
    agg = m.groupBy("wid").agg(F.sum(F.col("mb") * F.col("mw")).alias("dot"),
                               F.sqrt(F.sum(F.col("mb") * F.col("mb"))).alias("normb"),
                               F.sqrt(F.sum(F.col("mw") * F.col("mw"))).alias("normw"))
    return _centroid_distance(n_side.join(agg, "wid", "left"))


def _centroid_distance(out: DataFrame) -> DataFrame:
    sim = F.when((F.col("normb") > 0) & (F.col("normw") > 0),
                 F.col("dot") / (F.col("normb") * F.col("normw"))).otherwise(0.0)
    empty_side = (F.col("nb") == 0) | (F.col("nw") == 0)
    return out.select("wid", F.when(empty_side, F.lit(0.0)).otherwise(clamp01(1 - sim)).alias("centroid_distance"))


# ------------------------------------------------------------------ T5-T7
def emerging_terms(aligned_terms: DataFrame, limit: int = 10) -> DataFrame:
    """T5: window terms gaining rate against the smoothed baseline rate."""
    tot = aligned_terms.groupBy("wid").agg(
        F.greatest(F.lit(1), F.sum("b")).alias("tb"), F.greatest(F.lit(1), F.sum("w")).alias("tw"),
        F.sum((F.col("w") > 0).cast("long")).alias("vw"))
    j = aligned_terms.filter(F.col("w") > 0).join(tot, "wid")
    score = (F.col("w") / F.col("tw")) / ((F.col("b") + 1) / (F.col("tb") + F.col("vw")))
    s = j.withColumn("score", score).filter((F.col("w") >= TERM_COUNT) & (F.col("score") > TERM_GAIN))
    r = F.row_number().over(Window.partitionBy("wid").orderBy(
        F.desc("score"), F.desc("term"), F.desc("b"), F.desc("w")))
    return s.withColumn("rank", r).filter(F.col("rank") <= limit).select(
        "wid", "rank", "term", F.col("b").alias("baseline_count"), F.col("w").alias("window_count"),
        F.round("score", 4).alias("score"))


def new_entities(aligned_entities: DataFrame, limit: int = 10) -> DataFrame:
    """Window entities absent from the baseline, by count (ties: key)."""
    s = aligned_entities.filter((F.col("w") > 0) & (F.col("b") == 0))
    r = F.row_number().over(Window.partitionBy("wid").orderBy(F.desc("w"), F.asc("entity")))
    label, text = TX.split_entity_key(F.col("entity"))
    return s.withColumn("rank", r).filter(F.col("rank") <= limit).select(
        "wid", "rank", text.alias("text"), label.alias("label"), F.col("w").alias("count"))


def emerging_topics(topics: DataFrame, limit: int = 8, min_gain: float = TOPIC_GAIN) -> DataFrame:
    """Window topics whose share gained more than ``min_gain``.

    A side has a label once, so one aggregate brings the two shares together: a self-join would make the topics twice.
    """
    def of(side: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col("share")))

    both = topics.groupBy("wid", "label").agg(of(BASELINE).alias("bs"), of(WINDOW).alias("share"))
    j = both.filter(F.col("share") - F.coalesce("bs", F.lit(0.0)) > min_gain)
    r = F.row_number().over(Window.partitionBy("wid").orderBy(F.desc("share"), F.asc("label")))
    return j.withColumn("rank", r).filter(F.col("rank") <= limit).select(
        "wid", "rank", "label", F.round("share", 6).alias("share"), TX.topic_terms("label").alias("top_terms"))


# ------------------------------------------------------------------ L2 / L3
def linguistic_report(sides: Sides, threshold: float = config.LINGUISTIC_THRESHOLD,
                      weights: config.LinguisticWeights = config.LinguisticWeights(),
                      lists: bool = True, extractor: Extractor | None = None, topic_model=None) -> DataFrame:
    """L2: one report row per window id.

    ``extractor`` (U2) and ``topic_model`` (U3: sides -> topic rows, e.g.
    ``topics.lda_topics``) replace the regex and the keyword topics;
    entity_backend and topic_backend name what was used, joined by + where
    both a plug-in and its fall-back were.

    composite = clamp(0.35·entity + 0.35·topic + 0.30·(1 − p)); breached if
    composite > threshold; scores rounded to 6 digits.  The topic distance
    falls back to A10 when neither side has keyword topics.
    """
    s = sides
    if s.valid is not None:  # every part asks it: the texts are not read for it again
        s = _restrict(s, None)
        s.valid = written(sides.valid)
    # Each of these feeds two or three outputs: written once to the checkpoint folder.
    terms = written(align_counts(term_counts(s, packed=True), "term"))
    counted = written(entity_counts(s, extractor)) if extractor is not None else entity_counts(s, packed=True)
    ents = written(align_counts(counted, "entity"))
    topics = written(keyword_topics(s) if topic_model is None else topic_model(s))

    def backends(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("wid").agg(F.array_join(F.sort_array(F.collect_set("backend")), "+").alias(name))

    wids = written(s.doc_counts().groupBy("wid").agg(
        F.sum(F.when(F.col("side") == WINDOW, F.col("n_docs")).otherwise(0)).cast("long").alias("document_count")))
    ent = js_distance(ents)
    top = topic_wasserstein(topics)
    # A10 only where neither side has keyword topics: restrict the documents first.  Written, because these
    # windows are few: the plan that knows it leaves the texts where they are.
    need = written(wids.select("wid").join(topics.select("wid").distinct(), "wid", "left_anti"))
    fallback = document_centroid_distance(_restrict(s, need))
    chi = vocab_chi2(terms)
    r = (wids.join(ent, "wid", "left").join(top, "wid", "left").join(fallback, "wid", "left")
             .join(chi.select("wid", "pvalue"), "wid", "left"))
    e = F.coalesce("entity_distance", F.lit(0.0))
    t = F.coalesce("topic_distance", "centroid_distance", F.lit(0.0))
    p = F.coalesce("pvalue", F.lit(1.0))
    comp = clamp01(weights.entity * e + weights.topic * t + weights.vocabulary * (1 - p))
    out = r.select("wid", "document_count",
                   F.round(e, 6).alias("entity_kl_divergence"),
                   F.round(t, 6).alias("topic_wasserstein"),
                   F.round(p, 6).alias("vocab_chi2_pvalue"),
                   F.round(comp, 6).alias("composite_score"),
                   F.lit(threshold).alias("threshold"),
                   (comp > threshold).alias("breached"))
    out = (out.withColumn("entity_backend", F.lit(REGEX)) if extractor is None
           else out.join(backends(counted, "entity_backend"), "wid", "left"))
    out = (out.withColumn("topic_backend", F.lit("keyword")) if topic_model is None
           else out.join(backends(topics, "topic_backend"), "wid", "left"))
    if not lists:
        return out

    def packed(df: DataFrame, name: str, fields: list[str]) -> DataFrame:
        # Each list holds at most `limit` rows per window (bounded collect).
        return df.groupBy("wid").agg(F.sort_array(F.collect_list(F.struct("rank", *fields))).alias(name))

    return (out.join(packed(new_entities(ents), "new_entities", ["text", "label", "count"]), "wid", "left")
               .join(packed(emerging_topics(topics), "emerging_topics", ["label", "share", "top_terms"]), "wid", "left")
               .join(packed(emerging_terms(terms), "emerging_terms",
                            ["term", "baseline_count", "window_count", "score"]), "wid", "left"))


def _restrict(s: Sides, wids: DataFrame | None) -> Sides:
    """Sides limited to the comparisons in ``wids`` (documents filtered before tokenising); None: all."""
    r = Sides.__new__(Sides)
    r.docs, r.mode, r.keys, r.valid, r.local = s.docs, s.mode, s.keys, s.valid, s.local
    if wids is None:
        return r
    if s.mode == "split":
        r.docs = s.docs.join(wids, "wid", "left_semi")
    else:
        own = wids.unionByName(wids.select((F.col("wid") - 1).alias("wid"))).distinct()
        r.docs = s.docs.join(own, "wid", "left_semi")
        r.valid = wids if s.valid is None else s.valid.join(wids, "wid", "left_semi")
    return r


def window_sides(docs: DataFrame, width_minutes: int, ts_col: str = "occurred_at", id_col: str = "id",
                 min_baseline: int = MIN_BASELINE_DOCUMENTS, min_window: int = MIN_WINDOW_DOCUMENTS) -> Sides:
    """L3 sides: every tumbling window against the window before it.

    Windows short of the minimum document counts are left out, as the
    reference skips them.
    """
    width = width_minutes * 60
    wid = F.floor(F.unix_seconds(ts_col) / width).cast("long")
    base = docs.select(wid.alias("wid"), F.col(id_col).alias("doc_id"), "text")
    return Sides(base, "prev", min_baseline, min_window)


def linguistic_windows(docs: DataFrame, width_minutes: int = 60, threshold: float = config.LINGUISTIC_THRESHOLD,
                       ts_col: str = "occurred_at", id_col: str = "id") -> DataFrame:
    """L3: the L2 report for every window in one job, with its bounds."""
    width = width_minutes * 60
    rep = linguistic_report(window_sides(docs, width_minutes, ts_col, id_col), threshold)
    return rep.select(F.timestamp_seconds(F.col("wid") * width).alias("window_start"),
                      F.timestamp_seconds((F.col("wid") + 1) * width).alias("window_end"), "*")


def resolve_window(docs: DataFrame, now, duration_minutes: int = config.LINGUISTIC_WINDOW_MINUTES,
                   baseline_limit: int | None = None, window_limit: int | None = None,
                   ts_col: str = "occurred_at", id_col: str = "id",
                   rank_bucket_seconds: int = 3600) -> DataFrame | None:
    """L1: wall-clock window [floor_min(now) − d, floor_min(now)) against everything older.

    Falls back to the newest half by rank (W3) with event-time bounds when the
    wall-clock window is short.  Two counts decide the branch on the driver.
    The reference caps both sides at 1000 newest documents; the caps are
    optional parameters here (None = whole history).
    """
    end = F.date_trunc("minute", now if not isinstance(now, str) else F.lit(now).cast("timestamp"))
    start = end - F.make_dt_interval(mins=F.lit(duration_minutes))
    d = docs.select(F.col(id_col).alias("doc_id"), "text", F.col(ts_col).alias("occurred_at"))

    def newest(df: DataFrame, n: int | None) -> DataFrame:
        return df.orderBy(F.desc("occurred_at"), F.desc("doc_id")).limit(n) if n else df

    base = newest(d.filter(F.col("occurred_at") < start), baseline_limit)
    win = newest(d.filter((F.col("occurred_at") >= start) & (F.col("occurred_at") < end)), window_limit)
    nb, nw = base.count(), win.count()
    if nb >= MIN_BASELINE_DOCUMENTS and nw >= MIN_WINDOW_DOCUMENTS:
        sides = (win.withColumn("side", F.lit(WINDOW)).unionByName(base.withColumn("side", F.lit(BASELINE))))
        return sides.select(F.lit(0).cast("long").alias("wid"), "side", "doc_id", "text", "occurred_at",
                            start.alias("window_start"), end.alias("window_end"))
    total = d.count()
    if total < MIN_BASELINE_DOCUMENTS + MIN_WINDOW_DOCUMENTS:
        return None
    size = min(window_limit or total, total // 2)
    ranked = global_rank(d, [-F.floor(F.unix_seconds("occurred_at") / rank_bucket_seconds)],
                         [F.desc("occurred_at"), F.desc("doc_id")])
    win = ranked.filter(F.col("rank") < size)
    base = ranked.filter(F.col("rank") >= size)
    if baseline_limit:
        base = base.filter(F.col("rank") < size + baseline_limit)
    sides = win.withColumn("side", F.lit(WINDOW)).unionByName(base.withColumn("side", F.lit(BASELINE)))
    bounds = win.agg(F.min("occurred_at").alias("s"), F.max("occurred_at").alias("e"))
    return sides.select(F.lit(0).cast("long").alias("wid"), "side", "doc_id", "text", "occurred_at",
                        bounds.select("s").scalar().alias("window_start"),
                        (bounds.select("e").scalar() + F.expr("INTERVAL 1 SECOND")).alias("window_end"))
