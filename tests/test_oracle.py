import pytest

from __spark_entry__ import entry, oracle_sql, queries
from nounspan.catalog import ORACLES, QUERIES
from tools.check import compare, connect


def test_entry(spark):
    rows = entry(spark).collect()
    assert len(rows) == 9 and any(r["total_selected"] == 0 for r in rows)


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
    fitted = {"m1_fit_relevance", "u3_score_passages", "e5_score_unseen"}
    assert set(QUERIES) - set(ORACLES) == fitted


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, name):
    verdict = compare(QUERIES[name](spark, sf), connect(sf), ORACLES[name])
    assert verdict.startswith("ok"), verdict
    assert "types" not in verdict


@pytest.mark.parametrize("name", ["m1_fit_relevance", "u3_score_passages", "e5_score_unseen"])
def test_fitted_scores_are_finite(spark, sf, name):
    column = "mse" if name.startswith("m1") else "score"
    rows = QUERIES[name](spark, sf).collect()
    assert rows and all(r[column] is not None and 0 <= r[column] < 1e6 for r in rows)
