"""Text-drift queries over every 60-minute window against the window before it."""

from __future__ import annotations

from pyspark.sql import functions as F

from embdrift.functions import stopwords
from embdrift.functions import text as TX
from embdrift.operators import linguistic as L
from embdrift.operators.extractors import learn_gazetteer
from embdrift.operators.ranking import global_rank
from embdrift.operators.topics import lda_topics
from embdrift.plans.catalog import register
from embdrift.sources import fixtures as FX

WIDTH_MIN = 60
W = TX.PY_WHITESPACE
STOP_SQL = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in stopwords.english()) + "]"

_SIDES = f"""
base AS (SELECT CAST(floor(epoch(occurred_at) / {WIDTH_MIN * 60}) AS BIGINT) AS wid, id AS doc_id, text FROM docs
         WHERE regexp_replace(text, '^{W}+|{W}+$', '', 'g') <> ''),
sides0 AS (SELECT wid, 'window' AS side, doc_id, text FROM base
           UNION ALL SELECT wid + 1, 'baseline', doc_id, text FROM base),
okw AS (SELECT wid FROM sides0 GROUP BY wid
        HAVING sum(CASE WHEN side = 'baseline' THEN 1 ELSE 0 END) >= 10
           AND sum(CASE WHEN side = 'window' THEN 1 ELSE 0 END) >= 2),
sides AS (SELECT * FROM sides0 WHERE wid IN (SELECT wid FROM okw))"""

_TERMS = """
tc AS (SELECT wid, side, term, count(*) AS n FROM
         (SELECT wid, side, lower(unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_-]{2,}'))) AS term FROM sides)
       GROUP BY ALL),
al AS (SELECT wid, term, CAST(sum(CASE WHEN side = 'baseline' THEN n ELSE 0 END) AS BIGINT) AS b,
              CAST(sum(CASE WHEN side = 'window' THEN n ELSE 0 END) AS BIGINT) AS w FROM tc GROUP BY wid, term)"""

def _tfidf(keys: str, nfeat: int, ngrams: bool, name: str) -> str:
    grams = ("toks || CASE WHEN len(toks) >= 2 THEN list_transform(range(1, len(toks)), "
             "lambda i: toks[i] || ' ' || toks[i + 1]) ELSE [] END") if ngrams else "toks"
    return f"""
{name}_tt AS (SELECT {keys}, doc_id, list_filter(regexp_extract_all(lower(text), '{L.TOPIC_TOKEN}'),
                 lambda x: NOT list_contains({STOP_SQL}, x)) AS toks FROM sides),
{name}_dt AS (SELECT {keys}, doc_id, term, count(*) AS tf FROM
                (SELECT {keys}, doc_id, unnest({grams}) AS term FROM {name}_tt) GROUP BY ALL),
{name}_cf AS (SELECT {keys}, term, sum(tf) AS cf, count(*) AS df FROM {name}_dt GROUP BY ALL),
{name}_ft AS (SELECT * FROM {name}_cf QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY cf DESC, term ASC) <= {nfeat}),
{name}_nd AS (SELECT {keys}, count(*) AS n_docs FROM sides GROUP BY ALL),
{name}_x AS (SELECT d.*, d.tf * (ln((1 + nd.n_docs) / (1 + f.df)) + 1) AS v
             FROM {name}_dt d JOIN {name}_ft f USING ({keys}, term) JOIN {name}_nd nd USING ({keys})),
{name} AS (SELECT {keys}, doc_id, term, v / sqrt(sum(v * v) OVER (PARTITION BY {keys}, doc_id)) AS weight FROM {name}_x)"""


_TOPICS = _tfidf("wid, side", 12, True, "kw") + """,
kcol AS (SELECT wid, side, term, sum(weight) AS weight FROM kw GROUP BY ALL),
kbest AS (SELECT * FROM kcol QUALIFY row_number() OVER (PARTITION BY wid, side ORDER BY round(weight, 9) DESC, term ASC) <= 6),
topics AS (SELECT wid, side, term AS label, weight / sum(weight) OVER (PARTITION BY wid, side) AS share FROM kbest)"""


def _q(body: str, *ctes: str) -> str:
    return FX.with_fixtures("WITH " + ",".join((_SIDES,) + ctes) + "\n" + body, "docs")


def _sides(t):
    return L.window_sides(FX.docs(t), WIDTH_MIN)


@register("term_counts", operators=("A5", "P17"), sql=_q("SELECT wid, side, term, n FROM tc", _TERMS))
def term_counts(t):
    return L.term_counts(_sides(t))


# Entity queries: Python/Java Unicode \b semantics cannot be written in RE2, so no SQL
# oracle; tests compare them with Python `re` on the raw documents instead.
@register("entity_counts", operators=("A5", "P18", "U2"), sql=None)
def entity_counts(t):
    return L.entity_counts(_sides(t))


_GAZETTEER = r"""
gwords AS (SELECT wid AS own, doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS ws FROM base),
gruns AS (SELECT DISTINCT own, doc_id, replace(trim(lower(unnest(regexp_extract_all(' ' || array_to_string(ws, '  ') || ' ',
                 '(?: [A-Z][\p{L}\p{N}_]* )+')))), '  ', ' ') AS entry FROM gwords),
gaz AS (SELECT entry, len(string_split(entry, ' ')) AS n FROM gruns WHERE length(entry) <= 80 AND len(string_split(entry, ' ')) <= 5
        GROUP BY entry HAVING count(*) >= 5 ORDER BY count(*) DESC, entry LIMIT 20000),
gpos AS (SELECT own, doc_id, list_transform(ws, lambda w: lower(w)) AS ws, unnest(range(1, len(ws) + 1)) AS i FROM gwords),
ghit AS (SELECT p.own, p.doc_id, p.i, max(p.i + g.n - 1) AS e, max_by(g.entry, g.n) AS entry
         FROM (SELECT *, unnest(range(1, 6)) AS n FROM gpos) p JOIN gaz g ON g.n = p.n AND g.entry = array_to_string(p.ws[p.i:p.i + p.n - 1], ' ')
         WHERE p.i + p.n - 1 <= len(p.ws) GROUP BY ALL),
gfree AS (SELECT own, 'GAZ:' || entry AS entity FROM (
            SELECT *, max(e) OVER (PARTITION BY own, doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ghit)
          WHERE reach IS NULL OR e > reach),
gcount AS (SELECT own + d.k AS wid, d.side, entity, count(*) AS n FROM gfree, (VALUES (0, 'window'), (1, 'baseline')) d(k, side) GROUP BY ALL)"""


@register("gazetteer_entity_counts", operators=("U2", "A5"), sql=_q(
    "SELECT wid, side, entity, 'gazetteer' AS backend, n FROM gcount WHERE wid IN (SELECT wid FROM okw)", _GAZETTEER))
def gazetteer_entity_counts(t):
    """Entities of a gazetteer learned from the documents' own frequent capitalised runs."""
    sides = _sides(t)
    return L.entity_counts(sides, learn_gazetteer(sides.docs))


@register("lda_topic_shares", operators=("U3",), sql=None)
def lda_topic_shares(t):
    """Topic shares of every window and its baseline by LDA, small windows by keywords."""
    return lda_topics(_sides(t))


@register("aligned_terms", operators=("J9", "X2"), sql=_q("SELECT wid, term, b, w FROM al", _TERMS))
def aligned_terms(t):
    return L.align_counts(L.term_counts(_sides(t), packed=True), "term")


@register("vocab_chi2", operators=("A6",), sql=_q("""
SELECT wid, round(CASE WHEN V >= 2 AND B > 0 AND W > 0 THEN s END, 4) AS statistic,
       CAST(greatest(1, V - 1) AS BIGINT) AS dof, V AS vocabulary
FROM (SELECT wid, sum(b) AS B, sum(w) AS W, count(*) AS V,
             sum(power(b - (bt * (b + w) / tt), 2) / (bt * (b + w) / tt)
               + power(w - (wt * (b + w) / tt), 2) / (wt * (b + w) / tt)) AS s
      FROM (SELECT *, sum(b) OVER (PARTITION BY wid) AS bt, sum(w) OVER (PARTITION BY wid) AS wt,
                   sum(b + w) OVER (PARTITION BY wid) AS tt FROM al)
      GROUP BY wid)""", _TERMS), bench=True)
def vocab_chi2(t):
    r = L.vocab_chi2(L.align_counts(L.term_counts(_sides(t), packed=True), "term"), with_pvalue=False)
    return r.select("wid", F.round("statistic", 4).alias("statistic"), "dof", "vocabulary")


@register("term_js_distance", operators=("A7", "P12", "P13"), sql=_q("""
SELECT wid, round(least(greatest(coalesce(sqrt(s / ln(2) / 2), 0), 0), 1), 6) AS entity_distance
FROM (SELECT wid, sum(p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) AS s
      FROM (SELECT wid, (b + 1e-9) / (sum(b) OVER (PARTITION BY wid) + 1e-9 * count(*) OVER (PARTITION BY wid)) AS p,
                        (w + 1e-9) / (sum(w) OVER (PARTITION BY wid) + 1e-9 * count(*) OVER (PARTITION BY wid)) AS q
            FROM al)
      GROUP BY wid)""", _TERMS))
def term_js_distance(t):
    """A7 over vocabulary terms, whose tokens SQL cuts alike."""
    r = L.js_distance(L.align_counts(L.term_counts(_sides(t), packed=True), "term"))
    return r.select("wid", F.round("entity_distance", 6).alias("entity_distance"))


@register("entity_js_distance", operators=("A7", "P12", "P13"), sql=None)
def entity_js_distance(t):
    r = L.js_distance(L.align_counts(L.entity_counts(_sides(t), packed=True), "entity"))
    return r.select("wid", F.round("entity_distance", 6).alias("entity_distance"))


@register("keyword_topics", operators=("A9", "U3"), sql=_q(
    "SELECT wid, side, label, round(share, 6) AS share FROM topics", _TOPICS), bench=True)
def keyword_topics(t):
    r = L.keyword_topics(_sides(t))
    return r.select("wid", "side", "label", F.round("share", 6).alias("share"))


@register("topic_wasserstein", operators=("A8",), sql=_q("""
SELECT wid, round(least(greatest(CASE WHEN min(total_u) <= 0 OR min(total_v) <= 0 THEN 1.0 ELSE sum(d) END, 0), 1), 6)
         AS topic_distance
FROM (SELECT wid, total_u, total_v,
             CASE WHEN row_number() OVER (PARTITION BY wid ORDER BY label DESC) = 1 THEN 0.0
                  ELSE abs(sum(u) OVER (PARTITION BY wid ORDER BY label ROWS UNBOUNDED PRECEDING) / total_u
                         - sum(v) OVER (PARTITION BY wid ORDER BY label ROWS UNBOUNDED PRECEDING) / total_v) END AS d
      FROM (SELECT *, sum(u) OVER (PARTITION BY wid) AS total_u, sum(v) OVER (PARTITION BY wid) AS total_v
            FROM (SELECT wid, label, sum(CASE WHEN side = 'baseline' THEN share ELSE 0.0 END) AS u,
                         sum(CASE WHEN side = 'window' THEN share ELSE 0.0 END) AS v
                  FROM topics GROUP BY wid, label)))
GROUP BY wid""", _TOPICS))
def topic_wasserstein(t):
    r = L.topic_wasserstein(L.keyword_topics(_sides(t)))
    return r.select("wid", F.round("topic_distance", 6).alias("topic_distance"))


@register("document_centroid_distance", operators=("A10",), sql=_q("""
SELECT wid, round(CASE WHEN nb = 0 OR nw = 0 THEN 0.0
                       ELSE least(greatest(1 - CASE WHEN normb > 0 AND normw > 0 THEN dot / (normb * normw)
                                                    ELSE 0.0 END, 0), 1) END, 6) AS centroid_distance
FROM (SELECT wid, sum(mb * mw) AS dot, sqrt(sum(mb * mb)) AS normb, sqrt(sum(mw * mw)) AS normw, min(nb) AS nb, min(nw) AS nw
      FROM (SELECT u.wid, u.term, sb / nb AS mb, sw / nw AS mw, nb, nw
            FROM (SELECT j.wid, term, sum(CASE WHEN s.side = 'baseline' THEN weight ELSE 0.0 END) AS sb,
                         sum(CASE WHEN s.side = 'window' THEN weight ELSE 0.0 END) AS sw
                  FROM uni j JOIN sides s ON s.wid = j.wid AND s.doc_id = j.doc_id GROUP BY j.wid, term) u
            JOIN (SELECT wid, sum(CASE WHEN side = 'baseline' THEN 1 ELSE 0 END) AS nb,
                         sum(CASE WHEN side = 'window' THEN 1 ELSE 0 END) AS nw FROM sides GROUP BY wid) n
              ON n.wid = u.wid)
      GROUP BY wid)""", _tfidf("wid", 128, False, "uni")))
def document_centroid_distance(t):
    r = L.document_centroid_distance(_sides(t))
    return r.select("wid", F.round("centroid_distance", 6).alias("centroid_distance"))


@register("emerging_terms", operators=("T5",), sql=_q("""
SELECT wid, rank, term, baseline_count, window_count, round(score, 4) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY wid ORDER BY score DESC, term DESC, baseline_count DESC,
                                                   window_count DESC) AS rank
  FROM (SELECT wid, term, b AS baseline_count, w AS window_count,
               (w / greatest(1, sum(w) OVER (PARTITION BY wid)))
               / ((b + 1) / (greatest(1, sum(b) OVER (PARTITION BY wid))
                             + sum(CASE WHEN w > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY wid))) AS score
        FROM al)
  WHERE window_count >= 2 AND score > 1.5)
WHERE rank <= 10""", _TERMS))
def emerging_terms(t):
    return L.emerging_terms(L.align_counts(L.term_counts(_sides(t), packed=True), "term"))


@register("new_terms", operators=("T6", "X3", "P14"), sql=_q("""
SELECT wid, rank, term AS text, 'TERM' AS label, w AS count
FROM (SELECT *, row_number() OVER (PARTITION BY wid ORDER BY w DESC, term ASC) AS rank FROM al WHERE w > 0 AND b = 0)
WHERE rank <= 10""", _TERMS))
def new_terms(t):
    """T6 / X3 over vocabulary terms as ``TERM:`` keys."""
    al = L.align_counts(L.term_counts(_sides(t), packed=True), "term").withColumn("entity", F.concat(F.lit("TERM:"), "term"))
    return L.new_entities(al)


@register("rank_split", operators=("W3", "L1"), sql=FX.with_fixtures("""
SELECT id, rank, CASE WHEN rank < (SELECT count(*) // 2 FROM docs) THEN 'window' ELSE 'baseline' END AS side
FROM (SELECT id, row_number() OVER (ORDER BY occurred_at DESC, id DESC) - 1 AS rank FROM docs)""", "docs"))
def rank_split(t):
    """The newest half by global rank against the rest, the fallback of L1."""
    d = FX.docs(t).select("id", "occurred_at")
    r = global_rank(d, [-F.floor(F.unix_seconds("occurred_at") / 3600)], [F.desc("occurred_at"), F.desc("id")])
    n = d.agg(F.count("*").alias("n")).select("n").scalar()
    return r.select("id", "rank", n.alias("n")).select(
        "id", "rank", F.when(F.col("rank") < F.floor(F.col("n") / 2), L.WINDOW).otherwise(L.BASELINE).alias("side"))


@register("new_entities", operators=("T6", "X3", "P14"), sql=None)
def new_entities(t):
    return L.new_entities(L.align_counts(L.entity_counts(_sides(t), packed=True), "entity"))


@register("emerging_topics", operators=("T7", "P14"), sql=_q("""
SELECT wid, rank, label, round(share, 6) AS share, array_to_string(list_filter(string_split(label, '_'), lambda x: x <> ''), '|') AS top_terms
FROM (SELECT w.wid, w.label, w.share,
             row_number() OVER (PARTITION BY w.wid ORDER BY w.share DESC, w.label ASC) AS rank
      FROM topics w LEFT JOIN topics b ON b.wid = w.wid AND b.label = w.label AND b.side = 'baseline'
      WHERE w.side = 'window' AND w.share - coalesce(b.share, 0.0) > 0.05)
WHERE rank <= 8""", _TOPICS))
def emerging_topics(t):
    r = L.emerging_topics(L.keyword_topics(_sides(t)))
    return r.withColumn("top_terms", F.array_join("top_terms", "|"))


@register("linguistic_backfill", operators=("L2", "L3", "A6", "A7", "A8", "A9", "A10", "T5", "T6", "T7"), sql=None,
          bench=True)
def linguistic_backfill(t):
    """L3: full reports (with chi-square p-values and the three lists) for every window."""
    r = L.linguistic_windows(FX.docs(t), WIDTH_MIN)
    return r.select("window_start", "window_end", "document_count", "entity_kl_divergence", "topic_wasserstein",
                    "vocab_chi2_pvalue", "composite_score", "threshold", "breached",
                    F.to_json("new_entities").alias("new_entities"),
                    F.to_json("emerging_topics").alias("emerging_topics"),
                    F.to_json("emerging_terms").alias("emerging_terms"))


@register("linguistic_report", operators=("L1", "L2", "W3"), sql=None)
def linguistic_report(t):
    """L1 + L2: wall-clock window of the last 120 minutes against all older documents."""
    d = FX.docs(t)
    now = d.agg(F.max("occurred_at") + F.expr("INTERVAL 1 MINUTE")).scalar()
    sides = L.resolve_window(d, now, duration_minutes=120)
    rep = L.linguistic_report(L.Sides(sides, "split"))
    return rep.select(
        sides.select(F.min("window_start")).scalar().alias("window_start"),
        sides.select(F.min("window_end")).scalar().alias("window_end"),
        "document_count", "entity_kl_divergence", "topic_wasserstein", "vocab_chi2_pvalue",
        "composite_score", "breached", F.to_json("new_entities").alias("new_entities"),
        F.to_json("emerging_topics").alias("emerging_topics"), F.to_json("emerging_terms").alias("emerging_terms"))
