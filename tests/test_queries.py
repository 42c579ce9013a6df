"""Every core query against its SQL on the smallest tables."""

from concurrent.futures import ThreadPoolExecutor

from docsheet import queries
from tests.oracle import compare

DIR = "/root/testdata/sf0.001"


def test_queries_equal_their_sql(spark):
    def one(name):
        if name in queries.SQL:
            return name, compare(spark, DIR, queries.QUERIES[name], queries.SQL[name])
        return name, "" if queries.QUERIES[name](spark, DIR).count() else "no rows"

    with ThreadPoolExecutor(4) as pool:
        assert [x for x in pool.map(one, queries.QUERIES) if x[1]] == []


def test_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["doc_id", "para_no", "para"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
