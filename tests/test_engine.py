"""Semantics of filters, projections, aggregation sinks, sources and the cursor."""

import math
import operator

import pytest

import __spark_entry__
from tessera.errors import OperatorError, QueryCancelled, SchemaError
from tessera.functions import DataType, map_backend_type, pack_rows, parse_bool, parse_bytes, parse_time, type_name
from tessera.operators import BoolFilter, Cmp, Filter, FilterProject, Float64Filter, GlobalFloatAgg, GroupByInt64, GroupByString, Int64Filter, Project, RowFilter, StringFilter
from tessera.plans import Cursor, Options, bind, execute
from tessera.sources import JdbcSource, RangeSource, RowsSource, series

I, D, S, B = DataType.INT64, DataType.FLOAT64, DataType.STRING, DataType.BOOL
NAN, INF = float("nan"), float("inf")
OPS = {Cmp.EQ: operator.eq, Cmp.NE: operator.ne, Cmp.GT: operator.gt, Cmp.GE: operator.ge, Cmp.LT: operator.lt, Cmp.LE: operator.le}


@pytest.mark.parametrize("cmp", list(Cmp))
def test_float_filter_is_ieee(spark, cmp):
    values = [NAN, INF, -INF, 0.0, -0.0, 1.5, None]
    df = pack_rows(spark, [("i", I), ("f", D)], list(enumerate(values)))
    for v in (1.0, NAN, INF, 0.0):
        want = [i for i, x in enumerate(values) if x is not None and OPS[cmp](x, v)]
        assert sorted(r.i for r in Float64Filter(1, cmp, v)(df).collect()) == want


@pytest.mark.parametrize("cmp", list(Cmp))
def test_int_filter(spark, cmp):
    df = pack_rows(spark, [("i", I)], [[x] for x in (-1, 0, 1, None, 2)])
    assert sorted(r.i for r in Int64Filter(0, cmp, 1)(df).collect()) == [x for x in (-1, 0, 1, 2) if OPS[cmp](x, 1)]


def test_string_and_bool_filters_drop_null(spark):
    df = pack_rows(spark, [("s", S), ("b", B)], [["a", True], ["b", False], [None, None]])
    assert StringFilter(0, Cmp.NE, "a")(df).count() == 1
    assert BoolFilter(1, False)(df).count() == BoolFilter(1, True)(df).count() == 1


@pytest.mark.parametrize("bad", [StringFilter(0, Cmp.GT, "a"), Int64Filter(0, Cmp.EQ, 1), Int64Filter(9, Cmp.EQ, 1), Filter(1, Cmp.EQ, b"x", DataType.BYTES), Filter(2, Cmp.GT, True, B), Project(), Project(-1), Project(3), GroupByInt64(0, 1), GroupByString(0, 0), GlobalFloatAgg(0)])
def test_refused_when_built(spark, bad):
    df = pack_rows(spark, [("s", S), ("x", DataType.BYTES), ("b", B)], [["a", b"x", True]])
    with pytest.raises(SchemaError):
        bad(df)


def test_projection_repeats_and_equal_names(spark):
    df = spark.range(3).selectExpr("id", "id * 2 as id")
    out = Project(1, 0, 1)(df)
    assert out.columns == ["id", "id", "id"] and [tuple(r) for r in out.collect()] == [(0, 0, 0), (2, 1, 2), (4, 2, 4)]
    assert [tuple(r) for r in FilterProject(Int64Filter(1, Cmp.GE, 2), [0])(df).collect()] == [(1,), (2,)]


def test_aggregates(spark):
    empty = pack_rows(spark, [("f", D)], [])
    assert tuple(GlobalFloatAgg(0)(empty).first()) == (0, 0, 0.0, 0.0)
    df = pack_rows(spark, [("k", I), ("f", D)], [[None, 0.1], [2, None], [-5, 0.3], [5, 0.4], [-4, 1.0], [4, 1.0]])
    out = GroupByInt64(0, 1, 4)(df)
    assert {r.key: (r.rows, r["count"], r["sum"], r["avg"]) for r in GroupByInt64.sorted_rows(out).collect()} == {-1: (1, 1, 0.3, 0.3), 0: (2, 2, 2.0, 1.0), 1: (1, 1, 0.4, 0.4), 2: (1, 0, 0.0, 0.0)}
    assert tuple(GroupByInt64.null_group(out).first()) == (1, 1, 0.1, 0.1) and GroupByInt64.has_null_group(out) and GroupByInt64.size(out) == 5
    twice = GroupByInt64.merge(out, out)
    assert {r.key: r.rows for r in twice.collect()}[0] == 4
    assert {r.key: (r.rows, r["count"], r["sum"]) for r in GroupByInt64(0, -1)(df).collect()}[2] == (1, 0, 0.0)
    assert GlobalFloatAgg.merge(GlobalFloatAgg(0)(empty), GlobalFloatAgg(1)(df)).first().rows == 6


def test_parity_table(spark):
    """20,000 rows with null cycles."""
    df = spark.range(1, 20001).selectExpr("id", "case when id % 7 = 0 then null else (id % 100000) / 100000D end as f", "case when id % 11 = 0 then null else concat('txt_', cast(id % 50 as string)) end as t").repartition(7)
    g = GlobalFloatAgg(1)(df).first()
    assert (g.rows, g["count"]) == (20000, 17143) and math.isclose(g["sum"], 1714.31429, abs_tol=1e-6)
    by = GroupByString(2, 1)(df)
    n = GroupByString.null_group(by).first()
    assert by.count() == 51 and (n.rows, n["count"]) == (1818, 1559) and math.isclose(n["sum"], 155.95591, abs_tol=1e-6)
    assert series(spark, 100000).where("f > 0.5").count() == 49999


def test_ragged_rows_and_types(spark):
    src = RowsSource([("id", I), ("name", S)], [[1], [2, "b"], [3, "c", "x"]])
    assert [tuple(r) for r in execute(spark, src).collect()] == [(1, None), (2, "b"), (3, "c")]
    with pytest.raises(Exception):
        pack_rows(spark, [("id", I)], [["1"]])
    assert map_backend_type("int4") is I and map_backend_type("uuid") is S and map_backend_type("numeric") is DataType.NUMERIC and type_name(99) == "Unknown"


def test_parsing(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("t", "\\xdead")], "b string, x string")
    assert df.select(parse_bool(F.col("b")), parse_bytes(F.col("x"))).first()[:] == (True, bytearray(b"\xde\xad"))
    for c in (parse_bool(F.lit("yes")), parse_time(F.lit("infinity"))):
        with pytest.raises(Exception):
            df.select(c).collect()


def test_arguments():
    assert bind("select '$1', $2 -- $3", [1, 2]) == ("select '$1', :p2 -- $3", {"p2": 2})
    with pytest.raises(ValueError):
        bind("select $1", [])
    assert Options(workers=-1).normalized().workers == 4 and Options().normalized().batch_size == 4096
    j = JdbcSource("jdbc:postgresql://h/d", "select 1", numeric=["n"])
    j.set_chunk_size(-5)
    assert j.options()["query"] == "select 1" and j.options()["fetchsize"] == "1024" and j.options()["customSchema"] == "n STRING"


def test_cursor_order_close_and_errors(spark):
    df = spark.range(0, 1000, 1, 8)
    with Cursor(RowFilter(lambda r: r[0] % 2 == 0)(df), 64) as c:
        assert [r.id for r in c] == list(range(0, 1000, 2))
        assert c.next() is None
    c = Cursor(df, 10)
    assert len(c.next()) == 10
    c.close()
    c.close()
    assert c.next() is None

    def fail(row):
        raise ValueError("predicate broke")

    c = Cursor(RowFilter(fail)(df))
    for _ in range(2):
        with pytest.raises(OperatorError, match="predicate broke"):
            c.next()
    c = Cursor(df, 10)
    c.next()
    c.cancel()
    with pytest.raises(QueryCancelled):
        c.next()


def test_source_order_under_filters(spark):
    out = execute(spark, RangeSource(1, 2500), Options([Int64Filter(0, Cmp.GT, 10), Project(0)]))
    assert [r.g for r in out.toLocalIterator()] == list(range(11, 2501))


def test_pushdown(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_orderkey", "l_quantity")
    plan = FilterProject(Float64Filter(1, Cmp.GT, 25.0), [0])(df)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,25.0)" in plan


def test_streaming(spark, tmp_path):
    from tessera import streaming

    spark.range(100).write.parquet(str(tmp_path / "in"))
    s = streaming.apply(streaming.stream_files(spark, str(tmp_path / "in"), "id long"), [Int64Filter(0, Cmp.GE, 90)])
    streaming.drain(s, str(tmp_path / "out"), str(tmp_path / "check"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 128
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
