import os

import pytest

import __spark_entry__ as entry
from rankweave.plans import leaderboards, problems
from tests import oracle
from tests.oracle import FOLDER, agree

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
QUERIES, SQL = leaderboards.QUERIES | problems.QUERIES, leaderboards.SQL | problems.SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    agree(spark, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "rec_id"
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_document_of_more_rows_than_one_text_takes(spark, tmp_path, monkeypatch):
    n = 100_010
    oracle.connection().execute(f"""copy (select id as rec_id, 'n' || id % 1000 as name, id % 7 + 12 as total, 0::bigint as wins, 0::bigint as kos, id % 7 + 12 as losses, 0::bigint as draws,
      '' as nationality, 'u' || id as wikipediaurl, timestamp '2023-01-01' as lastupdated, '' as gender, '' as weightclass, '' as imageurl, null::bigint as secondaryscore, '1990' as birthdate
      from range({n}) t(id)) to '{tmp_path}/fighter_records.parquet'""")
    monkeypatch.setattr(oracle, "FOLDER", str(tmp_path))
    assert agree(spark, QUERIES["boards_document"], SQL["boards_document"]) == n
