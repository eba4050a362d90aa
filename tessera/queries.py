"""One query for each operator over the driver's tables, with the SQL that DuckDB runs for comparison."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import DataType, normalize
from .operators import BoolFilter, Cmp, Custom, FilterProject, Float64Filter, GlobalFloatAgg, GroupByInt64, GroupByString, Int64Filter, MapBatches, Project, RowFilter, StringFilter, UserAgg, filter_float64_gt_project
from .plans import Options, execute, named_tables, register_tables
from .sources import CustomSource, FileSource, FrameSource, RangeSource, RowsSource, SqlSource

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_LI = "l_orderkey, l_linenumber, l_quantity, l_tax, l_returnflag"
_MEASURES = "cast(count(*) as bigint) as rows, cast(count({v}) as bigint) as count, coalesce(sum({v}), 0.0) as sum, coalesce(avg({v}), 0.0) as avg"


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], oracle: str) -> None:
    QUERIES[name], ORACLES[name] = run, oracle


def _scan(table: str, select: str, *ops, after: Callable[[DataFrame], DataFrame] = lambda df: df):
    """Scan selected expressions of a table and apply operators."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = FileSource(f"{sf_dir}/{table}.parquet").open(spark).selectExpr(*_split(select))
        return after(execute(spark, FrameSource(normalize(df)), Options(ops)))

    return run


def _split(select: str) -> list[str]:
    """Expressions at commas outside parentheses."""
    out, depth = [""], 0
    for ch in select:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append("")
        else:
            out[-1] += ch
    return [x.strip() for x in out]


def _sql(text: str, args=None):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register_tables(spark, sf_dir, named_tables(text))
        return execute(spark, SqlSource(text, args))

    return run


# scans and projections
_add("scan_full", _scan("events", "event_id, value, event_type, ts"), "select event_id, value, event_type, ts from events")
_add("project_reorder", _scan("lineitem", _LI, Project(2, 0)), "select l_quantity, l_orderkey from lineitem")
_add("project_duplicate", _scan("lineitem", _LI, Project(0, 0, 3), after=lambda df: df.toDF("a", "b", "c")), "select l_orderkey as a, l_orderkey as b, l_tax as c from lineitem")
_add("project_computed", _sql("select o_orderkey % 128 as g, concat('user-', cast(o_custkey as string)) as name, o_totalprice / 2 as half from orders"), "select o_orderkey % 128 as g, 'user-' || o_custkey as name, o_totalprice / 2 as half from orders")

# filters
for _name in ("EQ", "NE", "GT", "GE", "LT", "LE"):
    _cmp = Cmp[_name]
    _add(f"filter_i64_{_name.lower()}", _scan("events", "event_id, user_id", Int64Filter(1, _cmp, 75)), f"select event_id, user_id from events where user_id {_cmp} 75")
    _add(f"filter_f64_{_name.lower()}", _scan("lineitem", _LI, Float64Filter(2, _cmp, 25.0), Project(0, 2)), f"select l_orderkey, l_quantity from lineitem where l_quantity {_cmp} 25")
_X = "case when l_linenumber = 1 then double('NaN') else l_quantity end as x"
_XD = "case when l_linenumber = 1 then 'NaN'::double else l_quantity end"
_add("filter_f64_nan", _scan("lineitem", f"l_orderkey, {_X}", Float64Filter(1, Cmp.GT, 25.0)), f"select l_orderkey, {_XD} as x from lineitem where {_XD} > 25 and not isnan({_XD})")
_add("filter_f64_nan_threshold", _scan("lineitem", "l_orderkey, nullif(l_quantity, 3) as x", Float64Filter(1, Cmp.NE, float("nan"))), "select l_orderkey, nullif(l_quantity, 3) as x from lineitem where nullif(l_quantity, 3) is not null")
_add("filter_str_eq", _scan("events", "event_id, event_type", StringFilter(1, Cmp.EQ, "click")), "select event_id, event_type from events where event_type = 'click'")
_add("filter_str_ne", _scan("events", "event_id, event_type", StringFilter(1, Cmp.NE, "click")), "select event_id, event_type from events where event_type <> 'click'")
for _v in ("true", "false"):
    _add(f"filter_bool_{_v}", _scan("lineitem", "l_orderkey, l_returnflag = 'R' as r", BoolFilter(1, _v == "true")), f"select l_orderkey, l_returnflag = 'R' as r from lineitem where (l_returnflag = 'R') = {_v}")
_add("filter_null_dropped", _scan("lineitem", "l_orderkey, nullif(l_linenumber, 3) as n", Int64Filter(1, Cmp.NE, 5)), "select l_orderkey, cast(nullif(l_linenumber, 3) as bigint) as n from lineitem where nullif(l_linenumber, 3) <> 5")
_add("filter_chain", _scan("lineitem", _LI, Float64Filter(2, Cmp.GT, 10.0), Int64Filter(0, Cmp.LT, 5000), Project(0, 2)), "select l_orderkey, l_quantity from lineitem where l_quantity > 10 and l_orderkey < 5000")
_add("filter_project_fused", _scan("lineitem", _LI, FilterProject(Float64Filter(2, Cmp.GT, 25.0), [0, 2])), "select l_orderkey, l_quantity from lineitem where l_quantity > 25")
_add("filter_f64_gt_project", _scan("lineitem", _LI, filter_float64_gt_project(2, 40.0, 2, 4)), "select l_quantity, l_returnflag from lineitem where l_quantity > 40")
_add("filter_row_predicate", _scan("orders", "o_orderkey, o_orderstatus", RowFilter(lambda row: row[0] % 2 == 0 and row[1] == "O")), "select o_orderkey, o_orderstatus from orders where o_orderkey % 2 = 0 and o_orderstatus = 'O'")
_add("custom_operator", _scan("orders", "o_orderkey, o_totalprice", Custom(lambda df: df.withColumn("big", F.col("o_totalprice") > 100000))), "select o_orderkey, o_totalprice, o_totalprice > 100000 as big from orders")


def _doubled(batch: pa.RecordBatch) -> pa.RecordBatch:
    import pyarrow.compute as pc

    return pa.RecordBatch.from_arrays([pc.multiply(batch.column(0), 2)], ["twice"])


_add("custom_batch_operator", _scan("orders", "o_orderkey", MapBatches(_doubled, "twice long")), "select o_orderkey * 2 as twice from orders")

# aggregations
_V = "case when l_linenumber = 3 then null else l_quantity end"
_M, _MV = _MEASURES.format(v="l_quantity"), _MEASURES.format(v="v")
_ZERO = "cast(count(*) as bigint) as rows, cast(0 as bigint) as count, cast(0 as double) as sum, cast(0 as double) as avg"
_add("agg_global", _scan("lineitem", "l_quantity", GlobalFloatAgg(0)), f"select {_M} from lineitem")
_add("agg_global_nulls", _scan("lineitem", f"{_V} as v", GlobalFloatAgg(0)), f"select {_MV} from (select {_V} as v from lineitem)")
_add("agg_global_empty", _scan("lineitem", "l_quantity", Float64Filter(0, Cmp.LT, 0.0), GlobalFloatAgg(0)), f"select {_M} from lineitem where l_quantity < 0")
_add("agg_filtered", _scan("lineitem", "l_quantity, l_orderkey", Int64Filter(1, Cmp.GT, 5000), GlobalFloatAgg(0)), f"select {_M} from lineitem where l_orderkey > 5000")


def _group(name: str, key: str, value: str | None, op, mod: int = 0, source: str = "lineitem", after=lambda df: df, where: str = "", ops: tuple = ()) -> None:
    select = f"{key} as k" + (f", {value} as v" if value else "")
    by = f"k % {mod}" if mod else "k"
    measures = _MV if value else _ZERO
    oracle = f"select {by} as key, {measures} from (select {select} from {source}) {where} group by 1"
    _add(name, _scan(source, select, *ops, op, after=after), oracle)


_group("group_i64_raw", "l_orderkey", "l_quantity", GroupByInt64(0, 1))
_group("group_i64_mod128", "l_orderkey", "l_quantity", GroupByInt64(0, 1, 128), 128)
_group("group_i64_mod100000", "l_orderkey", "l_quantity", GroupByInt64(0, 1, 100000), 100000)
_group("group_i64_negative_keys", "l_orderkey - 30000", "l_quantity", GroupByInt64(0, 1, 64), 64)
_group("group_i64_negative_mod", "l_orderkey - 30000", "l_quantity", GroupByInt64(0, 1, -64), -64)
_group("group_i64_null_keys", "nullif(l_partkey % 10, 3)", "l_quantity", GroupByInt64(0, 1))
_group("group_i64_null_values", "l_partkey % 10", _V, GroupByInt64(0, 1))
_group("group_i64_allnull_group", "l_partkey % 10", "case when l_partkey % 10 = 4 then null else l_quantity end", GroupByInt64(0, 1))
_group("group_i64_count_only", "l_orderkey", None, GroupByInt64(0, -1, 16), 16)
_group("group_i64_sorted", "nullif(l_partkey % 10, 3)", "l_quantity", GroupByInt64(0, 1), after=GroupByInt64.sorted_rows, where="where k is not null")
_group("group_str", "l_returnflag", "l_quantity", GroupByString(0, 1))
_group("group_str_null_keys", "nullif(l_returnflag, 'A')", "l_quantity", GroupByString(0, 1))
_group("group_str_count_only", "event_type", None, GroupByString(0), source="events")
_group("group_str_filtered", "l_returnflag", "l_quantity", GroupByString(0, 1), where="where v > 10", ops=(Float64Filter(1, Cmp.GT, 10.0),))
_add("group_i64_null_group", _scan("lineitem", "nullif(l_partkey % 10, 3) as k, l_quantity as v", GroupByInt64(0, 1), after=GroupByInt64.null_group), f"select {_M} from lineitem where l_partkey % 10 = 3 having count(*) > 0")
_add("group_len", _scan("lineitem", "nullif(l_partkey % 10, 3) as k, l_quantity as v", GroupByInt64(0, 1), after=lambda df: df.agg(F.count(F.lit(1)).alias("n"))), "select count(*) as n from (select distinct nullif(l_partkey % 10, 3) from lineitem)")


def _merge(mods: tuple[int, int]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        parts = [_scan("lineitem", "l_orderkey as k, l_quantity as v", Int64Filter(0, cmp, 30000), GroupByInt64(0, 1, mod))(spark, sf_dir) for cmp, mod in ((Cmp.LT, mods[0]), (Cmp.GE, mods[1]))]
        return GroupByInt64.merge(*parts)

    return run


_add("agg_merge_partials", _merge((128, 128)), f"select l_orderkey % 128 as key, {_M} from lineitem group by 1")
_add("agg_merge_mixed_mod", _merge((16, 32)), f"select case when l_orderkey < 30000 then l_orderkey % 16 else l_orderkey % 32 end as key, {_M} from lineitem group by 1")

# SQL
_PLAIN = {
    "sql_join": "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey",
    "sql_sort": "select l_orderkey, l_linenumber, l_extendedprice from lineitem order by l_extendedprice, l_orderkey, l_linenumber",
    "sql_limit": "select o_orderkey, o_totalprice from orders order by o_orderkey limit 100",
    "sql_group_ordinal": "select l_orderkey % 128 as g, count(*) as n, avg(l_quantity) as a from lineitem group by 1",
    "sql_sub_select": "select count(*) as n from (select l_orderkey from lineitem where l_quantity > 25) t",
    "sql_case": "select o_orderkey, case when o_totalprice > 100000 then 'high' when o_totalprice > 50000 then 'mid' else null end as band from orders",
    "sql_outer_join": "select c_custkey, o_orderkey from customer left join orders on o_custkey = c_custkey and o_totalprice > 400000",
    "sql_semi": "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 400000)",
    "sql_in": "select c_custkey from customer where c_nationkey in (select n_nationkey from nation where n_regionkey = 1)",
    "sql_anti": "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 400000)",
    "sql_window": "select o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as rn, count(*) over (partition by o_custkey order by o_orderkey rows between 2 preceding and current row) as c3 from orders",
    "sql_rollup": "select l_returnflag, l_linestatus, count(*) as n, sum(l_quantity) as q from lineitem group by rollup(l_returnflag, l_linestatus)",
    "sql_cube": "select l_returnflag, l_linestatus, count(*) as n from lineitem group by cube(l_returnflag, l_linestatus)",
    "sql_grouping_sets": "select l_returnflag, l_linestatus, count(*) filter (where l_quantity > 25) as n from lineitem group by grouping sets ((l_returnflag), (l_linestatus), ())",
    "sql_having": "select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 10",
    "sql_distinct": "select distinct o_orderstatus, o_orderpriority from orders",
    "sql_min_max": "select l_returnflag, min(l_quantity) as lo, max(l_quantity) as hi, count(distinct l_suppkey) as suppliers from lineitem group by l_returnflag",
    "sql_union": "select n_nationkey as k from nation union all select r_regionkey as k from region",
    "sql_intersect": "select c_nationkey as k from customer intersect select s_nationkey as k from supplier",
    "sql_except": "select c_custkey as k from customer except select o_custkey as k from orders where o_totalprice > 400000",
    "sql_offset": "select o_orderkey from orders order by o_orderkey limit 20 offset 40",
    "sql_nulls_last": "select o_orderkey, nullif(o_orderstatus, 'F') as s from orders order by s nulls last, o_orderkey limit 500",
    "sql_nulls_last_all": "select o_orderkey, nullif(o_orderstatus, 'F') as s from orders order by s nulls last, o_orderkey",
    "sql_recursive": "with recursive t(n) as (select 1 union all select n + 1 from t where n < 50) select n from t",
    "sql_extract": "select extract(year from o_orderdate) as y, count(*) as n from orders group by 1",
    "sql_ilike": "select p_partkey from part where p_type ilike '%PROMO%'",
    "sql_between": "select l_orderkey, l_linenumber from lineitem where l_quantity between 10 and 20 and not (l_tax > 0.04 or l_discount < 0.02)",
}
for _name, _text in _PLAIN.items():
    _add(_name, _sql(_text), _text)
_add("sql_date_trunc", _sql("select cast(date_trunc('month', o_orderdate) as timestamp_ntz) as m, count(*) as n from orders group by 1"), "select cast(date_trunc('month', o_orderdate) as timestamp) as m, count(*) as n from orders group by 1")
ORACLES["sql_extract"] = "select cast(extract(year from o_orderdate) as integer) as y, count(*) as n from orders group by 1"
_add("sql_lateral", _sql("select n_nationkey, t.k from nation, lateral (select n_regionkey * 10 as k) t"), "select n_nationkey, n_regionkey * 10 as k from nation")
_add("sql_percentile", _sql("select l_returnflag, percentile_cont(0.5) within group (order by l_quantity) as med from lineitem group by l_returnflag"), "select l_returnflag, quantile_cont(l_quantity, 0.5) as med from lineitem group by l_returnflag")
_add("sql_json", _sql("select event_id, get_json_object(props, '$.k') as k from events"), "select event_id, json_extract_string(props, '$.k') as k from events")
_add("sql_params", _sql("select o_orderkey, o_totalprice from orders where o_totalprice > $1 and o_orderstatus = $2 -- not $3", [100000.0, "O"]), "select o_orderkey, o_totalprice from orders where o_totalprice > 100000.0 and o_orderstatus = 'O'")
_add("sql_named_params", _sql("select o_orderkey from orders where o_custkey = :c", {"c": 7}), "select o_orderkey from orders where o_custkey = 7")
_add("sql_concat_cast", _sql("select 'user-' || o_custkey::string as name, (o_orderkey % 100000)::double / 100000.0D as f from orders"), "select 'user-' || o_custkey::varchar as name, (o_orderkey % 100000)::double / 100000.0 as f from orders")
_add("sql_intervals", _sql("select event_id, ts + make_interval(0, 0, 0, 0, 0, 0, user_id) as later from events"), "select event_id, ts + to_seconds(user_id) as later from events")

# the backend's own dialect, beside the plain form that DuckDB runs
_add("sql_string_agg", _sql("select n_regionkey, string_agg(n_name, ',') within group (order by n_name) as names from nation group by n_regionkey"), "select n_regionkey, string_agg(n_name, ',' order by n_name) as names from nation group by n_regionkey")
_add("sql_values", _sql("select * from (values (1, 'a'), (2, null), (3, 'c')) as t(k, s) where k <> 1"), "select * from (values (1, 'a'), (2, null), (3, 'c')) as t(k, s) where k <> 1")
_add("sql_stddev", _sql("select l_returnflag, round(stddev_samp(l_quantity), 6) as sd, round(var_pop(l_quantity), 6) as vp from lineitem group by l_returnflag"), "select l_returnflag, round(stddev_samp(l_quantity), 6) as sd, round(var_pop(l_quantity), 6) as vp from lineitem group by l_returnflag")
_add("sql_approx_distinct", _sql("select abs(approx_count_distinct(l_orderkey, 0.02) / count(distinct l_orderkey) - 1) < 0.1 as near from lineitem"), "select true as near")
_add("sql_numeric_division", _sql("select o_orderkey, cast(cast(o_totalprice as decimal(18, 2)) / 3 as decimal(18, 6))::text as third from orders"), "select o_orderkey, cast(round(cast(cast(o_totalprice as decimal(18, 2)) as decimal(34, 10)) * 1000000 / 3) / 1000000 as decimal(18, 6))::varchar as third from orders")
_add("sql_multi_measures", _sql("select l_returnflag, l_linestatus, sum(l_quantity) as q, avg(l_extendedprice) as p, min(l_discount) as d, count(*) as n from lineitem group by 1, 2"), "select l_returnflag, l_linestatus, sum(l_quantity) as q, avg(l_extendedprice) as p, min(l_discount) as d, count(*) as n from lineitem group by 1, 2")
_add("sql_distinct_on", _sql("select distinct on (o_custkey) o_custkey, o_orderkey, o_totalprice from orders order by o_custkey, o_totalprice desc, o_orderkey"), "select distinct on (o_custkey) o_custkey, o_orderkey, o_totalprice from orders order by o_custkey, o_totalprice desc, o_orderkey")
_add("sql_regex", _sql("select p_partkey from part where p_type ~ '^PROMO' and p_type !~ 'STEEL$' or p_type ~* 'brass'"), "select p_partkey from part where regexp_matches(p_type, '^PROMO') and not regexp_matches(p_type, 'STEEL$') or regexp_matches(p_type, 'brass', 'i')")
_add("sql_fetch_first", _sql("select o_orderkey from orders order by o_orderkey fetch first 7 rows only"), "select o_orderkey from orders order by o_orderkey limit 7")
_add("sql_generate_series", _sql("select g.n, n::text as t, (n / 4.0)::float8 as q from generate_series(1, 40) as g(n) where n % 3 = 0"), "select g.n, n::varchar as t, (n / 4.0)::double as q from (select unnest(generate_series(1, 40))::integer) as g(n) where n % 3 = 0")


def _total(state, batch: pa.RecordBatch):
    import pyarrow.compute as pc

    n, most = state
    top = pc.max(batch.column(0)).as_py()
    return n + batch.num_rows, top if most is None or (top is not None and top > most) else most


def _larger(a, b):
    return a[0] + b[0], max((x for x in (a[1], b[1]) if x is not None), default=None)


_add("agg_user", _scan("lineitem", "l_extendedprice", UserAgg(lambda: (0, None), _total, _larger, lambda state: state, "n long, most double")), "select count(*) as n, max(l_extendedprice) as most from lineitem")

# sources and types
_ROWS = RowsSource([("id", DataType.INT64), ("name", DataType.STRING)], [[1], [2, "b"], [3, "c", "extra"]])
_add("source_rows_ragged", lambda spark, _: execute(spark, _ROWS), "select * from (values (1::bigint, null::varchar), (2, 'b'), (3, 'c')) t(id, name)")
_add("source_range", lambda spark, _: execute(spark, RangeSource(1, 2500)), "select range as g from range(1, 2501)")


def _series(part: int):
    yield pa.RecordBatch.from_arrays([pa.array(range(part * 100, part * 100 + 100), pa.int64())], ["id"])


_add("source_custom", lambda spark, _: execute(spark, CustomSource("tessera_series", "id long", _series, 4)), "select range as id from range(0, 400)")
_add("type_widening", _scan("lineitem", "l_orderkey, l_linenumber"), "select l_orderkey, cast(l_linenumber as bigint) as l_linenumber from lineitem")
_add("type_numeric_text", _scan("orders", "o_orderkey, cast(o_totalprice as decimal(18, 2)) as price"), "select o_orderkey, cast(cast(o_totalprice as decimal(18, 2)) as varchar) as price from orders")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, counts, sums and averages of quantities by order key modulo 128."""
    return QUERIES["group_i64_mod128"](spark, sf_dir)
