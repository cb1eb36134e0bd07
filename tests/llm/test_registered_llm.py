"""Every registered query of the subpackage with SQL gives the SQL's rows on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import compare  # noqa: E402

from lumenarray.llm import queries  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.sql()))
def test_same_rows(spark, name):
    ok, what = compare.compare(spark, name, SMALL)
    assert ok, what


def test_names():
    assert not queries.sql().keys() - queries.queries().keys()
