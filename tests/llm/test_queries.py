import pytest

from planloom.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert len(set(df.columns)) == len(df.columns) and df.count() > 0
