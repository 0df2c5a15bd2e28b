"""Registered queries against their SQL on the smallest tables.

All of them run with ``python tests/oracle.py``; here a fast share, or every one with
``ALL_QUERIES=1``.
"""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, duck

FOLDER = "/root/testdata/sf0.001"
FAST = (
    "knn_join knn_join_blocks knn_join_ip distance_vote class_prototypes score_blend predict stratify_hash "
    "farthest_point ood_threshold_f1 recall_at_k mrr class_report ece ood_auroc balanced_batches mine_triplets "
    "supcon_loss_weighted random_triplets fit_vocab fit_labels encode encode_unseen tag_documents score_stream "
    "build_prompts parse_responses merge_review taxonomy_blend"
).split()
NAMES = list(entry.queries()) if os.environ.get("ALL_QUERIES") else FAST


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    assert compare(df, df.collect(), con, entry.oracle_sql()[name]) is None


def test_every_answer_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(FAST) <= set(entry.oracle_sql())


def test_plans_stay_free_of_shuffles_and_double_work(spark):
    """Scoring against a broadcast corpus is a projection over a pruned scan."""
    plan = entry.queries()["blend_prediction"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ReadSchema: struct<vec_id:bigint,embedding:array<float>" in plan
    assert entry.queries()["knn_join"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
