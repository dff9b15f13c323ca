"""Every registered query against its DuckDB oracle on the smallest tables."""

import importlib.util
import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))
from check_oracle import digest  # noqa: E402

from embdrift.plans.catalog import registry, runner  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"

REG = registry()
WITH_SQL = sorted(n for n, q in REG.items() if q.sql)
ROWS_ONLY = sorted(n for n, q in REG.items() if not q.sql)


@pytest.mark.parametrize("name", WITH_SQL)
def test_query_matches_oracle(spark, duck, name):
    q = REG[name]
    got = digest(runner(q)(spark, SF_SMALL).toPandas())
    want = digest(duck.sql(q.sql).df())
    assert got[:3] == want[:3], (name, [r for r in got[3] if r not in set(want[3])][:3],
                                 [r for r in want[3] if r not in set(got[3])][:3])


def shares_sum_to_one(pdf):
    return (pdf.groupby(["wid", "side"]).share.sum() - 1).abs().max() < 1e-9 and set(pdf.backend) <= {"lda", "keyword"}


#: What holds of the results that SQL cannot say.
PROPERTIES = {
    "ann_top10": lambda p: (p.groupby("qid")["rank"].max() <= 10).all() and not p.duplicated(["qid", "did"]).any(),
    "ann_recall": lambda p: p.recall_at_k[0] >= 0.9,
    "entity_counts": lambda p: (p.n > 0).all() and p.entity.str.startswith("PROPER:").all() and not p.duplicated(["wid", "side", "entity"]).any(),
    "entity_js_distance": lambda p: p.entity_distance.between(0, 1).all() and p.wid.is_unique,
    "lda_topic_shares": shares_sum_to_one,
    "linguistic_backfill": lambda p: p.composite_score.between(0, 1).all() and (p.breached == (p.composite_score > p.threshold)).all(),
    "linguistic_report": lambda p: len(p) == 1 and p.composite_score.between(0, 1).all() and (p.window_start < p.window_end).all(),
    "new_entities": lambda p: p["rank"].between(1, 10).all() and not p.duplicated(["wid", "rank"]).any() and (p["count"] > 0).all(),
    "project_2d": lambda p: p[["x", "y"]].abs().max().max() <= 1 + 1e-9 and p.x.var() >= p.y.var(),
}


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_query_without_sql_keeps_its_properties(spark, name):
    got = runner(REG[name])(spark, SF_SMALL).toPandas()
    assert len(got) and PROPERTIES[name](got)


def test_entry_contract(spark):
    spec = importlib.util.spec_from_file_location(
        "spark_entry", os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    df = mod.entry(spark)
    assert df.count() > 0
    assert set(mod.oracle_sql()) <= set(mod.queries())
