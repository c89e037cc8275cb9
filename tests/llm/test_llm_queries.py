import os

import pytest

from rankweave.llm import queries as llm
from tests.oracle import FOLDER, agree

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_same_as_sql(spark, name):
    agree(spark, llm.queries()[name], llm.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(llm.queries().keys() - llm.oracle_sql().keys()))
def test_runs(spark, name):
    assert llm.queries()[name](spark, FOLDER).count() > 0
