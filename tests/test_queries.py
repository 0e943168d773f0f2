"""Every registered query equals its oracle on the smallest data; the flagship query has a stable schema."""

import os

import duckdb
import pytest

import __spark_entry__ as driver
from fixtures import cases, inputs
from tools.compare import compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for file in sorted(os.listdir(SF)):
        con.execute(f"create view {file.split('.')[0]} as select * from '{SF}/{file}'")
    return con


@pytest.mark.parametrize("name", sorted(cases.QUERIES))
def test_query_equals_its_oracle(spark, db, name):
    problem = compare(driver.queries()[name](spark, SF), db.sql(driver.oracle_sql()[name]))
    assert problem is None, problem


def test_the_fixtures_hold_every_word(spark, db):
    want = db.sql("select count(*) from (select unnest(string_split(replace(text, chr(10), ' '), ' ')) as w from documents) where w <> ''").fetchall()[0][0]
    assert inputs.words(spark, SF).count() == want


def test_entry(spark):
    table = driver.entry(spark)
    assert table.columns == ["doc_id", "page_no", "row_no", "width", "text"] and table.limit(1).count() == 1
