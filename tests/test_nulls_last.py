"""Null placement over all orders."""

import __spark_entry__


def test_nulls_last_all(spark):
    sf_dir = "/root/testdata/sf0.001"
    got = [(r.o_orderkey, r.s) for r in __spark_entry__.queries()["sql_nulls_last_all"](spark, sf_dir).collect()]
    orders = [(r.o_orderkey, None if r.o_orderstatus == "F" else r.o_orderstatus) for r in spark.read.parquet(f"{sf_dir}/orders.parquet").collect()]
    assert any(s is None for _, s in got) and got == sorted(orders, key=lambda r: (r[1] is None, r[1] or "", r[0]))
    assert "sql_nulls_last_all" in __spark_entry__.oracle_sql()
