"""Every registered query against its SQL twin, on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

import __spark_entry__ as entry  # noqa: E402

SMALL = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SMALL).is_dir(), reason="driver tables are not there")


@pytest.fixture(scope="module")
def con():
    from check_queries import connect

    return connect(SMALL)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    from check_queries import compare

    verdict, _, _ = compare(spark, con, SMALL, name)
    assert verdict in ("ok", "no sql"), verdict


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names_only_queries_do_not_read_texts(spark):
    plan = entry.queries()["link_phase1"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "text:string" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
