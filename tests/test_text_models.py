"""Entity extractor plug-ins (U2) and the topic model."""

import random
import re

from pyspark.sql import functions as F

from embdrift.operators import linguistic as L
from embdrift.operators.extractors import Gazetteer, entities, learn_gazetteer
from embdrift.operators.topics import lda_topics

TEXTS = ["We met Ada Lovelace in New York City.", "new york, NEW YORK CITY; New", None, "", "Ada  Lovelace’s New-York", "the and nothing"]


def plain(entries, text):
    words = re.findall(r"\w+", (text or "").lower())
    out, reach = [], -1
    for i in range(len(words)):
        ends = [i + n for n in range(1, 6) if i + n <= len(words) and " ".join(words[i:i + n]) in entries]
        if ends and ends[-1] > reach:
            out.append("GAZ:" + " ".join(words[i:ends[-1]]))
            reach = ends[-1]
    return out


def test_gazetteer_takes_the_longest_phrase_at_word_bounds(spark):
    entries = ["ada", "ada lovelace", "new york", "new york city", "york city hall", "city", "he"]
    rng = random.Random(2)
    texts = TEXTS + [" ".join(rng.choice(["Ada", "Lovelace", "new", "York", "city", "hall", "he", "other", "x-he"]) for _ in range(30)) for _ in range(50)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    got = {r.id: (r.entities, r.backend) for r in entities(df, Gazetteer(entries)).collect()}
    assert got == {i: (plain(set(entries), t), "gazetteer") for i, t in enumerate(texts)}
    assert {r.backend for r in entities(df, Gazetteer([])).collect()} == {"gazetteer"}


def test_gazetteer_is_learned_from_frequent_runs(spark):
    docs = [(f"Ada Lovelace {i} wrote. Grace Hopper",) for i in range(4)] + [("Grace Hopper spoke, grace hopper",), ("One Two Three Four Five Six",), (None,)] * 3
    df = spark.createDataFrame(docs, "text string")
    assert learn_gazetteer(df, min_documents=4).entries == ("grace hopper", "ada lovelace")
    assert learn_gazetteer(df, min_documents=4, entries=1).entries == ("grace hopper",)
    assert learn_gazetteer(df, min_documents=3, max_words=6).entries[-1] == "one two three four five six"
    assert learn_gazetteer(df.limit(0)).entries == ()


class Crashing:
    name = "fragile"

    def extract(self, texts):
        if any("New" in t for t in texts):
            raise RuntimeError("no model")
        return [["X:y"] for _ in texts]


class Short:
    name = "short"

    def extract(self, texts):
        return []


def test_a_failing_extractor_falls_back_and_says_so(spark):
    df = spark.createDataFrame([(1, "In New York"), (2, "calm")], "id long, text string").repartition(2, "id")
    regex = {r.id: r.entities for r in entities(df).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        got = {r.id: (r.entities, r.backend) for r in entities(df, Crashing()).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    assert got == {1: (regex[1], "regex (fragile failed)"), 2: (["X:y"], "fragile")}
    assert {r.backend for r in entities(df, Short()).collect()} == {"regex (short failed)"}


SUBJECTS = {"sea": "harbour sailor anchor tide vessel reef", "law": "court judge verdict appeal statute jury", "food": "oven butter recipe flour spice dough"}


def planted(spark, per=60):
    rng = random.Random(3)
    rows = []
    for side, share in (("baseline", {"sea": 0.8, "law": 0.2}), ("window", {"law": 0.3, "food": 0.7})):
        for subject, s in share.items():
            for _ in range(int(per * s)):
                rows.append((1, side, len(rows), " ".join(rng.choice(SUBJECTS[subject].split()) for _ in range(40)), subject))
    return spark.createDataFrame(rows, "wid long, side string, doc_id long, text string, subject string")


def test_lda_recovers_planted_topics(spark):
    got = lda_topics(L.Sides(planted(spark).repartition(2)), topics=3, iterations=40).collect()
    assert {r.backend for r in got} == {"lda"}
    share = {}
    for r in got:
        subjects = {s for s, words in SUBJECTS.items() if set(r.label.split("_")) <= set(words.split())}
        assert len(subjects) == 1, r.label  # a topic's terms are of one subject
        share[r.side, subjects.pop()] = share.get((r.side, "?"), 0) + r.share
    want = {("baseline", "sea"): 0.8, ("baseline", "law"): 0.2, ("window", "law"): 0.3, ("window", "food"): 0.7}
    assert set(share) == set(want) and all(abs(share[k] - v) <= 0.05 for k, v in want.items())
    distance = L.topic_wasserstein(spark.createDataFrame(got)).first().topic_distance
    assert distance > 0.3


def test_small_or_unfit_sides_have_keyword_topics(spark):
    docs = planted(spark)
    few = docs.filter("side = 'baseline'").unionByName(docs.filter("side = 'window'").limit(3))
    got = lda_topics(L.Sides(few), topics=2, min_topic_size=5).collect()
    assert {(r.side, r.backend) for r in got} == {("baseline", "lda"), ("window", "keyword")}
    for side in ("baseline", "window"):
        assert abs(sum(r.share for r in got if r.side == side) - 1) < 1e-9
    bare = docs.withColumn("text", F.concat(F.lit("word"), F.col("doc_id")))  # no term is in two documents
    failed = lda_topics(L.Sides(bare), topics=2)
    assert {r.backend for r in failed.collect()} == {"keyword (lda failed)"}
    assert sorted(map(tuple, failed.drop("backend").collect())) == sorted(map(tuple, L.keyword_topics(L.Sides(bare)).collect()))


def test_report_names_its_backends(spark):
    sides = L.Sides(planted(spark))
    plain_report = L.linguistic_report(sides, lists=False).first()
    assert (plain_report.entity_backend, plain_report.topic_backend) == ("regex", "keyword")
    named = L.linguistic_report(sides, lists=False, extractor=Gazetteer(["court"]), topic_model=lambda s: lda_topics(s, topics=3)).first()
    assert (named.entity_backend, named.topic_backend) == ("gazetteer", "lda") and 0 < named.topic_wasserstein <= 1


class Bounded:
    name = "bounded"

    def extract(self, texts):
        assert len(texts) == 1 or sum(len(t.encode()) for t in texts) <= 100  # else the backend column says failed
        return [["X:" + w for w in t.split()] for t in texts]


def test_an_extractor_gets_a_slice_of_the_texts(spark, monkeypatch):
    from embdrift.operators import extractors
    monkeypatch.setattr(extractors, "SLICE_BYTES", 100)
    texts = [None, ""] + ["é" * (i % 30) + f" w{i}" for i in range(90)] + ["long " * 50, "last"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    got = {r.id: (r.entities, r.backend) for r in entities(df, Bounded()).collect()}
    assert got == {i: (["X:" + w for w in (t or "").split()], "bounded") for i, t in enumerate(texts)}


def test_a_long_capitalised_run_is_learned_past(spark):
    run = " ".join(["Word", "B"] * 20_000)  # a greedy group overflows the stack of a task's thread
    docs = spark.createDataFrame([(run + " end. New York",)] * 2 + [("New York é Paris",)], "text string")
    assert learn_gazetteer(docs, min_documents=2, max_words=2).entries == ("new york",)


def test_a_long_run_of_names_is_one_entity(spark):
    """A greedy group overflows the stack of a task's thread, which ends the executor."""
    from embdrift.functions import text as TX
    names = " ".join(["Word", "Other-x"] * 20_000)
    docs = spark.createDataFrame([(names + " end. New York",), ("New Ab-- Carré Abc- Old-",)], "text string")
    got = [r.k for r in docs.select(TX.proper_noun_runs("text").alias("k")).collect()]
    assert got == [["PROPER:" + names.lower(), "PROPER:new york"], ["PROPER:new", "PROPER:abc- old"]]


def test_runs_of_names_equal_the_pattern(spark):
    from embdrift.functions import text as TX
    rng = random.Random(4)
    parts = ["A", "Bc", "b", "-", "--", "é", " ", " ", "\n", "\u2003", "1", "_", ".", "Abc", "Foo-", "Ab-", "The"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(20_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: r.k for r in docs.select("id", TX.proper_noun_runs("text").alias("k")).collect()}
    for i, text in enumerate(texts):
        runs = [m.strip(" ").lower() for m in re.findall(TX.ENTITY_PATTERN, text)]
        assert got[i] == ["PROPER:" + r for r in runs if r not in TX.ENTITY_STOP], text
