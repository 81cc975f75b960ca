import duckdb
import pytest

import __spark_entry__ as e

SF = "/root/testdata/sf0.001"


def test_entry_has_rows(spark):
    assert e.entry(spark).count() > 0


def test_every_oracle_belongs_to_a_query():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_pricing_summary_equals_its_sql(spark):
    got = e.queries()["pricing_summary"](spark, SF).toPandas()
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{SF}/lineitem.parquet'")
    want = con.sql(e.oracle_sql()["pricing_summary"]).df()
    keys = ["l_returnflag", "l_linestatus"]
    got, want = (x.sort_values(keys).reset_index(drop=True)[list(want.columns)] for x in (got, want))
    assert got.to_dict("records") == want.to_dict("records")
