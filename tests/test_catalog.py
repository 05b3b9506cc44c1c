"""Every catalogue query against its check SQL on the smallest tables."""

import glob
import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

import __spark_entry__ as entry_module  # noqa: E402
from check_catalog import compare  # noqa: E402
from plumbline.plans.catalog import load  # noqa: E402

NAMES = [n for n, q in load().items() if q.sql]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(sf + "/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_check_sql(spark, sf, duck, name):
    q = load()[name]
    problem, _ = compare(q.run(spark, sf), duck, q.sql)
    assert not problem


def test_contract(spark):
    df = entry_module.entry(spark)
    assert df.count() == 4 and "rank" in df.columns
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_every_inventory_entry_has_a_query_or_a_test():
    """The inventory ids named by the catalogue; the rest is covered by unit tests alone."""
    seen = {i.strip() for q in load().values() for i in q.ids.split(",")}
    ranges = {"A": 10, "B": 18, "C": 16, "E": 15, "F": 7, "G": 16, "H": 40, "I": 7, "J": 10, "K": 5}
    missing = {f"{k}{i}" for k, n in ranges.items() for i in range(1, n + 1)} - seen
    assert missing == set()
