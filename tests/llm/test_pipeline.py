"""The pipeline: each stage against its operator's plain version, and the registered contract."""

import importlib.util
import os
import sys

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

from embdrift.llm import packing, rules, simhash, tokens
from embdrift.llm.common import marks, read, stored
from embdrift.llm.queries import ORACLES, QUERIES

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "scripts"))
from check_oracle import digest  # noqa: E402

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_stages_in_order(spark):
    docs = read(spark, SF, "documents")
    # A clashing column and rows with nulls travel through all stages.
    docs = stored(docs.withColumn("n_words", F.lit("mine")).withColumn("score", F.lit(1)).unionByName(
        spark.createDataFrame([(None, None, None, None, None, "n", 2), (9_000_001, "", "en", None, 0, "n", 2)],
                              "doc_id long, text string, lang string, source string, n_chars long, n_words string, score int")), "docs")
    columns = docs.columns
    seen = []
    for name, stage in cp.STAGES:
        out = stored(stage(spark, docs, SF), name)
        if name == "quality_rules":
            stats = rules.text_stats(docs.select("doc_id", "text"))
            want = rules.apply_rules(stats, rules.learn_rules(stats.join(marks(read(spark, SF, "labels"), "quality"), "doc_id")))
            assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in want.where("kept").collect())
        if name == "simhash_near_dedup":
            groups = simhash.near_duplicates(docs).select("component_id").distinct().count()
            assert out.count() == groups
        if name == "mix_sources":
            assert out.count() > docs.count()
            assert not out.join(docs, columns, "left_anti").count()
        if name == "pack_best_fit":
            want = packing.cut_pieces(docs, tokens.vocabulary())
            cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
            assert out.select(cols).exceptAll(want.select(cols)).count() == 0 and out.count() == want.count()
        else:
            assert out.columns == columns and 0 < out.count()
        seen.append(out.count())
        docs = out
    assert seen[0] < 202 and seen[1] <= seen[0] and seen[2] < seen[1]


def test_run_equals_its_stages(spark):
    got = cp.run(spark, SF)
    assert {"sequence_id", "offset", "piece"} <= set(got.columns) and got.count() > 100


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got = digest(QUERIES[name](spark, SF).toPandas())
    want = digest(duck.sql(ORACLES[name]).df())
    assert got[:3] == want[:3]


def test_entry_registers_the_operators():
    spec = importlib.util.spec_from_file_location("entry_for_llm", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    names = set(mod.queries())
    assert "pipeline" in names and set(QUERIES) <= names
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
