"""A live JDBC server (Derby, in memory), the backend's dialect, text decoders, user aggregates, and calls that time out."""

import time

import pytest
from pyspark.sql import functions as F

from tessera.errors import OperatorError, QueryCancelled, SchemaError
from tessera.functions import DataType, engine_type, normalize, pack_rows, parse_float, parse_int, parse_numeric
from tessera.operators import Float64Filter, RowFilter, Cmp, UserAgg
from tessera.plans import Cursor, Options, execute, literals, translate
from tessera.sources import JdbcSource

URL = "jdbc:derby:memory:tessera;create=true"


@pytest.fixture(scope="module")
def server(spark):
    jvm = spark._jvm
    jvm.java.lang.Class.forName("org.apache.derby.jdbc.EmbeddedDriver")
    conn = jvm.java.sql.DriverManager.getConnection(URL)
    s = conn.createStatement()
    s.execute("create table kinds (id int not null, big bigint, f double, n decimal(20, 4), t varchar(20), ok boolean, stamp timestamp, d date)")
    s.execute("insert into kinds values (1, 10000000000, 1.5, 12.3400, 'it''s $1', true, timestamp('2020-01-02 03:04:05'), date('2020-01-02')), (2, null, null, null, null, null, null, null), (3, -3, 0.25, -0.0001, 'c', false, timestamp('2021-01-01 00:00:00'), date('2021-01-01'))")
    s.execute("create table clock (tm time)")
    s.execute("create table many (id int not null)")
    s.execute("insert into many values " + ", ".join(f"({i})" for i in range(1, 501)))
    s.close()
    yield URL
    conn.close()


def test_rows_types_and_arguments(spark, server):
    src = JdbcSource(server, "select id, big, f, n, t, ok, stamp, d from kinds where id >= $1 or t = '$1'", numeric=["N"], args=[1])
    df = normalize(execute(spark, src, Options()))
    kinds = [engine_type(f) for f in df.schema.fields]
    assert kinds == [DataType.INT64, DataType.INT64, DataType.FLOAT64, DataType.STRING, DataType.STRING, DataType.BOOL, DataType.TIME, DataType.TIME]
    rows = {r[0]: r for r in df.collect()}
    assert len(rows) == 3 and rows[1][1] == 10**10 and rows[1][3] == "12.3400" and rows[1][4] == "it's $1" and rows[1][5] is True and rows[1][6].hour == 3
    assert list(rows[2])[1:] == [None] * 7
    one = JdbcSource(server, "select id from kinds where t = $1", args=["it's $1"]).open(spark).collect()
    assert [r[0] for r in one] == [1]
    got = execute(spark, JdbcSource(server, "select id, f from kinds"), Options([Float64Filter(1, Cmp.GT, 0.5)])).collect()
    assert [r[0] for r in got] == [1]
    with pytest.raises(ValueError):
        JdbcSource(server, "select $2", args=[1]).options()


def test_partitions_and_chunks(spark, server):
    src = JdbcSource(server, "select id from many", partition_column="ID", bounds=(1, 501), parts=4)
    src.set_chunk_size(50)
    df = src.open(spark)
    assert df.rdd.getNumPartitions() == 4 and sorted(r[0] for r in df.collect()) == list(range(1, 501)) and src.options()["fetchsize"] == "50"


def test_refused_types_and_server_errors(spark, server):
    with pytest.raises(SchemaError):
        normalize(spark.sql("select interval 1 day as i"))
    with pytest.raises(SchemaError):
        normalize(spark.sql("select interval 1 month as i"))
    with pytest.raises(SchemaError):
        normalize(spark.sql("select time'12:30:00' as t"))
    with pytest.raises(Exception, match="(?i)nowhere"):
        JdbcSource(server, "select * from nowhere").open(spark)
    assert normalize(spark.sql("select array(1, 2) as a, named_struct('x', 1) as s")).first()[:] == ("[1,2]", '{"x":1}')


def test_decoders(spark):
    one = lambda f, x: spark.createDataFrame([(x,)], "x string").select(f(F.col("x"))).first()[0]
    assert one(parse_int, " -42 ") == -42 and one(parse_int, None) is None and one(parse_int, "9223372036854775807") == 2**63 - 1
    assert one(parse_float, "1e3") == 1000.0 and one(parse_float, "NaN") != one(parse_float, "NaN") and one(parse_float, "-Infinity") == float("-inf")
    assert one(parse_numeric, "123456789012345678901234567890.10") == "123456789012345678901234567890.10" and one(parse_numeric, "NaN") == "NaN"
    for f, x in ((parse_int, "1.5"), (parse_int, "9223372036854775808"), (parse_int, ""), (parse_float, "one"), (parse_float, "1_0"), (parse_numeric, "12a")):
        with pytest.raises(Exception, match="not an? "):
            one(f, x)


def test_dialect():
    assert translate("select a::text, '::text' from t where a ~ 'x' and b !~* 'Y' -- ~ 'z'") == "select a::string, '::text' from t where a rlike 'x' and b not rlike '(?i)Y' -- ~ 'z'"
    assert translate("select ~5, a::decimal(3, 1) from t fetch next 3 rows only") == "select ~5, a::decimal(3, 1) from t limit 3"
    assert literals("select $1, '$2', $2", [None, "o'x"]) == "select NULL, '$2', 'o''x'"


def test_user_aggregate(spark):
    agg = UserAgg(lambda: [], lambda s, b: s + b.column(0).to_pylist(), lambda a, b: a + b, lambda s: (len(s), sum(s)), "n long, total long")
    assert [tuple(r) for r in agg(spark.range(0, 1000, 1, 7)).collect()] == [(1000, 499500)]
    assert [tuple(r) for r in agg(spark.range(0)).collect()] == [(0, 0)]


def test_a_call_that_times_out_leaves_the_run_alive(spark):
    def slow(row):
        time.sleep(0.01)
        return True

    c = Cursor(RowFilter(slow)(spark.range(0, 300, 1, 1)), 300)
    with pytest.raises(TimeoutError):
        c.next(timeout=0.05)
    assert len(c.next()) == 300 and c.next() is None and c.next(timeout=1) is None
    c = Cursor(RowFilter(slow)(spark.range(0, 3000, 1, 1)), 3000)
    with pytest.raises(TimeoutError):
        c.next(timeout=0.05)
    c.cancel()
    with pytest.raises(QueryCancelled):
        c.next()
    with pytest.raises(QueryCancelled):  # the end state stays
        c.next(timeout=0.01)


def test_the_first_error_stays(spark):
    def broken(row):
        raise ValueError("first")

    c = Cursor(RowFilter(broken)(spark.range(10)))
    with pytest.raises(OperatorError, match="first"):
        c.next()
    c.cancel()
    c.close()
    with pytest.raises(OperatorError, match="first"):
        c.next()


def test_plans(spark):
    from tessera.operators import GroupByInt64, Project
    from tessera.sources import FileSource

    df = FileSource("/root/testdata/sf0.001/lineitem.parquet").open(spark)
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    at = df.columns.index
    grouped = plan(GroupByInt64(0, 1, 128)(Project(at("l_orderkey"), at("l_quantity"))(df).selectExpr("cast(l_orderkey as bigint) l_orderkey", "l_quantity")))
    assert "partial_sum" in grouped and grouped.count("Exchange") == 1 and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in grouped
