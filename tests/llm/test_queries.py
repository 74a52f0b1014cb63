"""Every query of the subpackage on the smallest tables, against SQL where there is some."""

import os

import pytest
from test_entry import DATA, check

from corpusloom.llm import catalogue


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, name):
    check(spark, name)
