import pytest

from rasterloom.plans import catalog

from .compare import check, connect


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, data, con, name):
    check(spark, con, data, catalog.queries()[name], catalog.oracle_sql()[name])


def test_every_query_has_rows(spark, data):
    for name in set(catalog.queries()) - set(catalog.oracle_sql()):
        assert catalog.queries()[name](spark, data).count() > 0


def test_entry_imports_without_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=60)
