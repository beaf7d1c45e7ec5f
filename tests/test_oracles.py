import oracle
import pytest

from quillmark.plans import evaluation, evidence, extraction, forms, governance, linkage, operations, read_models, records_io, text_rules  # noqa: F401
from quillmark.plans.registry import PLANS, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, name):
    ok, why = oracle.same(PLANS[name](spark, SF), con, SQL[name])
    assert ok, why


def test_every_query_has_sql():
    assert set(PLANS) == set(SQL)


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_entry_imports_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert len(e.queries()) > 150"], cwd=root, check=True)
