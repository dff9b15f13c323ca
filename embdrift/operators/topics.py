"""Topic models (U3): latent Dirichlet allocation over all documents, keyword topics as the fall-back.

A topic distribution is ``(wid, side, label, share, backend)``, as A8 and T7 read it.  One
model is fitted for the whole corpus by Spark ML's online variational method, so topics mean the same
in every window; a document counts for its strongest topic, and a side's shares are those of its documents.
"""

from __future__ import annotations

import logging

from pyspark.ml.clustering import LDA
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embdrift.functions import stopwords
from embdrift.operators import linguistic as L
from embdrift.session import materialize

KEYWORD, LDA_BACKEND = "keyword", "lda"
LABEL_TERMS = 3


def lda_topics(sides: L.Sides, topics: int = 8, min_topic_size: int = 5, vocabulary: int = 8192,
               min_documents: int = 2, iterations: int = 20, seed: int = 17) -> DataFrame:
    """(wid, side, label, share, backend) by LDA with ``topics`` topics.

    Groups of fewer than ``min_topic_size`` documents, groups in which no
    document holds a vocabulary term, and all groups if the model cannot be fitted
    have keyword topics (A9) and say so.  The vocabulary is bounded; its terms
    and the topic matrix (``vocabulary`` x ``topics`` numbers) come to the driver.
    """
    keyword = L.keyword_topics(sides)
    try:
        shares = _fitted(sides, topics, vocabulary, min_documents, iterations, seed)
    except Exception as error:  # a model that cannot be fitted must not cost the report
        logging.getLogger(__name__).warning("topic model failed, using keyword topics: %s", error)
        return keyword.withColumn("backend", F.lit(f"{KEYWORD} ({LDA_BACKEND} failed)"))
    large = sides.doc_counts().groupBy("wid", "side").agg(F.sum("n_docs").alias("n")).filter(F.col("n") >= min_topic_size)
    shares = materialize(shares.join(large.select("wid", "side"), ["wid", "side"], "left_semi"))
    rest = keyword.join(shares.select("wid", "side").distinct(), ["wid", "side"], "left_anti")
    return (shares.withColumn("backend", F.lit(LDA_BACKEND))
                  .unionByName(rest.withColumn("backend", F.lit(KEYWORD))))


def _fitted(sides: L.Sides, topics: int, vocabulary: int, min_documents: int, iterations: int, seed: int) -> DataFrame:
    terms = L._topic_terms(sides.docs, stopwords.english(), False).select(*sides.keys, "doc_id", "_terms")
    terms = materialize(terms)  # the vocabulary, every pass of the fit and the assignment read it
    counter = CountVectorizer(inputCol="_terms", outputCol="_counts", vocabSize=vocabulary, minDF=min_documents).fit(terms)
    rows = counter.transform(terms).filter(F.aggregate(vector_to_array("_counts"), F.lit(0.0), lambda s, x: s + x) > 0)
    rows = materialize(rows.drop("_terms"))
    model = LDA(k=topics, maxIter=iterations, seed=seed, optimizer="online", featuresCol="_counts",
                topicDistributionCol="_topics").fit(rows)
    names = {r.topic: "_".join(counter.vocabulary[i] for i in r.termIndices) for r in model.describeTopics(LABEL_TERMS).collect()}
    label = F.element_at(F.array(*[F.lit(names[k]) for k in range(topics)]), F.col("topic").cast("int"))
    weights = vector_to_array("_topics")
    strongest = model.transform(rows).select(*sides.keys, F.array_position(weights, F.array_max(weights)).alias("topic"))
    counts = strongest.select(*sides.keys, label.alias("label")).groupBy(*sides.keys, "label").agg(F.count("*").alias("n"))
    shares = sides.expand(counts).groupBy("wid", "side", "label").agg(F.sum("n").alias("n"))
    total = shares.groupBy("wid", "side").agg(F.sum("n").alias("total"))
    return shares.join(total, ["wid", "side"]).select("wid", "side", "label", (F.col("n") / F.col("total")).alias("share"))
