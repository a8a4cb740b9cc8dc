import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tests.oracle_check import compare, duck
from xgspark.plans import catalog, oracle


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) >= 2
    assert df.columns == ["fold", "n", "goals", "log_loss", "roc_auc", "brier"]


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert set(catalog.QUERIES) == set(oracle.ORACLE)      # none of the library's own lacks one


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_oracle_small(spark, name):
    con = duck(SF_SMALL)
    msg, ok = compare(spark, con, name, E.queries()[name], E.oracle_sql()[name], SF_SMALL)
    assert ok, msg


def test_stream_equals_batch(spark):
    a = E.queries()["stream_scores"](spark, SF_SMALL)
    b = E.queries()["score_requests"](spark, SF_SMALL)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
