"""Named queries over the driver's tables, each through the engine's operators, with equivalent SQL.

A query is a function (spark, tables) with tables by name, or one text that both engines run; in
texts, {name} stands for a table."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import scalar as S
from ..functions import types as Y
from ..functions import variant as V
from ..operators import catalog as C
from ..operators import compare as D
from ..operators import profile as P
from ..operators import ranges as J
from ..operators import tighten as G
from ..operators import union as U
from ..session import put, scratch
from ..sources import readers as R
from ..sources import sinks
from ..sources import text as X
from ..streaming import windows as W
from . import dataset as H

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
_ALL: dict[str, tuple[Callable, str | None]] = {}


class Tables(dict):
    """Tables of one folder, opened when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self[name]


def query(sql: str | None = None):
    def keep(f: Callable[[SparkSession, Tables], DataFrame]):
        _ALL[f.__name__] = (f, sql)
        return f

    return keep


def both(name: str, text: str, spark_text: str | None = None) -> None:
    """The same text for both engines, or one for each where the dialects differ."""

    def run(spark: SparkSession, t: Tables) -> DataFrame:
        used = [n for n in TABLES if "{" + n + "}" in (spark_text or text)]
        return spark.sql(spark_text or text, **{n: t[n] for n in used})

    _ALL[name] = (run, text.format(**{n: n for n in TABLES}))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: (lambda spark, sf_dir, f=f: f(spark, Tables(spark, sf_dir))) for n, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {n: sql for n, (_, sql) in _ALL.items() if sql}


# --- profiles -------------------------------------------------------------------------------------

_NUMBERS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("\nunion all\n".join(
    [f"select '{c}' as \"column\", count(*) - count({c}) as null_count, round(min({c})::double, 6) as low, round(max({c})::double, 6) as high, round(avg({c}::double), 6) as mean, null::double as mean_length from lineitem" for c in _NUMBERS]
    + [f"select '{c}', count(*) - count({c}), null, null, null, round(avg(length({c})), 6) from lineitem" for c in ("l_returnflag", "l_linestatus")]
    + ["select 'l_shipdate', count(*) - count(l_shipdate), null, null, null, null from lineitem"]
))
def profile_lineitem(spark, t):
    """AGG01-AGG05, AGG12: the profile, with what SQL states exactly."""
    p = P.profile(t["lineitem"])
    temporal = F.col("dtype").startswith("timestamp")
    number = lambda c: F.round(F.when(~temporal, F.col(c)).try_cast("double"), 6)
    return p.select("column", "null_count", number("min").alias("low"), number("max").alias("high"), F.round("mean", 6).alias("mean"), F.round("mean_length", 6).alias("mean_length"))


@query("\nunion all\n".join(f"""select '{n}' as "table", "column", (select count(*) from {n}) as rows, (select count(*) from {n}) - filled as null_count
from (unpivot (select count(columns('(.*)')) as '\\1' from {n}) on columns(*) into name "column" value filled)""" for n in TABLES))
def profile_all_tables(spark, t):
    """Full profiles of all tables: AGG01-AGG16; the counts, which SQL states exactly."""
    parts = [P.profile(t[n]).withColumn("table", F.lit(n)) for n in TABLES]
    return reduce(DataFrame.unionByName, parts).select("table", "column", "rows", "null_count")


def _histogram(name: str, table: str, column: str) -> None:
    def run(spark, t):
        df = t[table].select(column)
        found = P.summary(df)
        bars = P.histograms(df, found).get(0) or [found.get("finite0", found["rows"])]
        return spark.createDataFrame([(i + 1, n) for i, n in enumerate(bars) if n], "bucket int, n long")

    x = f"epoch_ms({column})::double" if table == "orders" else f"{column}::double"
    _ALL[name] = (run, f"""with b as (select min({x}) as lo, max({x}) as hi from {table}), v as (select {x} as x, lo, hi from {table}, b where {column} is not null)
select cast(case when x = hi then 10 else floor((x - lo) / (hi - lo) * 10) + 1 end as integer) as bucket, count(*) as n from v group by 1""")  # noqa: E501


_histogram("histogram_lineitem_price", "lineitem", "l_extendedprice")
_histogram("histogram_events_value", "events", "value")
_histogram("histogram_part_size", "part", "p_size")
_histogram("histogram_customer_balance", "customer", "c_acctbal")
_histogram("histogram_orders_date", "orders", "o_orderdate")


@query("select lang as value, count(*) as n from documents group by lang order by n desc, lang limit 5")
def top_values_documents_lang(spark, t):
    """AGG13."""
    df = t["documents"].select("lang")
    return spark.createDataFrame(P.top_values(df, P.summary(df))[0], "value string, n long")


both("top_values_event_type", "select event_type, count(*) as n from {events} where event_type is not null group by event_type order by n desc, event_type limit 5")


@query("select count(distinct o_custkey) as exact, true as close from orders")
def ndv_approx_close(spark, t):
    """AGG05: the profile's estimate is within a tenth of the exact count."""
    near = P.summary(t["orders"].select("o_custkey"))["ndv0"]
    return t["orders"].agg(F.count_distinct("o_custkey").alias("exact")).withColumn("close", F.abs(F.lit(near) - F.col("exact")) < 0.1 * F.col("exact"))


@query("\nunion all\n".join(f"select '{c}' as \"column\", count(*) as rows, count(*) - count({c}) as null_count from events" for c in ("event_id", "ts", "user_id", "event_type", "value", "props")))
def null_counts(spark, t):
    """AGG01, AGG02, by the profile."""
    return P.profile(t["events"]).select("column", "rows", "null_count")
@query("select min(o_totalprice) as lo, max(o_totalprice) as hi, round(avg(o_totalprice), 6) as mean from orders")
def min_max_mean(spark, t):
    """AGG03, AGG04, by the profile."""
    return P.profile(t["orders"].select("o_totalprice")).select(F.col("min").cast("double").alias("lo"), F.col("max").cast("double").alias("hi"), F.round("mean", 6).alias("mean"))
both("distinct_count_exact", "select count(distinct l_partkey) as parts, count(distinct l_suppkey) as suppliers from {lineitem}")
@query("select count(*) filter (toxic = 1) as true_count, count(*) filter (toxic = 0) as false_count, count(*) filter (toxic is null) as null_count from labels")
def bool_counts(spark, t):
    """AGG06, by the profile."""
    return P.profile(t["labels"].select((F.col("toxic") == 1).alias("toxic"))).select("true_count", "false_count", "null_count")
both("string_lengths", "select round(avg(length(text)), 6) as mean_chars, round(avg(strlen(text)), 6) as mean_bytes, max(length(text)) as longest from {documents}", "select round(avg(char_length(text)), 6) as mean_chars, round(avg(octet_length(text)), 6) as mean_bytes, cast(max(char_length(text)) as long) as longest from {documents}")


@query("select min(len(embedding)) as length_min, max(len(embedding)) as length_max, round(avg(len(embedding)), 6) as length_mean from embeddings")
def list_lengths(spark, t):
    """AGG14."""
    return P.profile(t["embeddings"].select("embedding")).select("length_min", "length_max", F.round("length_mean", 6).alias("length_mean"))


@query("select 64::bigint as length_min, 64::bigint as length_max, count(*) filter (embedding is null) as null_count from embeddings")
def list_lengths_fixed(spark, t):
    """AGG15, ARR02: a fixed-size list is told by its metadata."""
    return P.profile(G.tighten(t["embeddings"].select("embedding"))).select("length_min", "length_max", "null_count")


@query("select null::varchar as name, count(*) as null_count, false as has_top from supplier")
def all_null_profile(spark, t):
    """AGG16."""
    df = t["supplier"].select(F.lit(None).cast("string").alias("x"))
    return P.profile(df).select(F.col("min").alias("name"), "null_count", F.col("top_values").isNotNull().alias("has_top"))


@query("select least(1000, count(*)) as n from lineitem")
def sample_rows(spark, t):
    """SMP01: exactly n rows."""
    return P.sampled(t["lineitem"], 1000).agg(F.count("*").alias("n"))


@query("""with m as (select o_orderpriority as p, month(o_orderdate) as m, count(*) as n from orders group by 1, 2), g as (select *, max(n) over (partition by p) as top from m)
select p as priority, string_agg(substr(' ▁▂▃▄▅▆▇█', cast(round_even(n / top * 8, 0) as integer) + 1, 1), '' order by m) as line from g group by p""")
def sparkline_counts(spark, t):
    """VIS01: a sign for each month's count, by its share of the largest."""
    counted = t["orders"].groupBy(F.col("o_orderpriority").alias("priority"), F.month("o_orderdate").alias("m")).agg(F.count("*").alias("n"))
    lists = counted.groupBy("priority").agg(F.sort_array(F.collect_list(F.struct("m", "n")))["n"].alias("counts"))
    return lists.select("priority", S.sparkline(F.col("counts")).alias("line"))


# --- filters and aggregations ---------------------------------------------------------------------

both("filtered_count_by_flag", "select l_returnflag, count(*) as trips, count(*) filter (where l_discount <= 0) as no_discount from {lineitem} where l_extendedprice > 20000 group by l_returnflag")
both("ratio_of_totals", "select count(*) filter (where l_discount = 0) as without_discount, count(*) as n, round(100.0 * count(*) filter (where l_discount = 0) / count(*), 4) as percent from {lineitem}", "select count(*) filter (where l_discount = 0) as without_discount, count(*) as n, round(100.0D * count(*) filter (where l_discount = 0) / count(*), 4) as percent from {lineitem}")
both("group_by_decade", "select cast(year(o_orderdate) // 10 as bigint) * 10 as decade, count(*) as n from {orders} group by 1 order by 1", "select cast(year(o_orderdate) div 10 as bigint) * 10 as decade, count(*) as n from {orders} group by 1 order by 1")
both("share_of_total", "select o_orderstatus, count(*) as n, round(100.0 * count(*) / (select count(*) from {orders}), 4) as percent from {orders} group by o_orderstatus", "select o_orderstatus, count(*) as n, round(100.0D * count(*) / (select count(*) from {orders}), 4) as percent from {orders} group by o_orderstatus")
both("min_by_price", "select p_partkey, coalesce(p_name, 'part ' || p_partkey) as name, p_retailprice from {part} where p_retailprice is not null order by p_retailprice, p_partkey limit 1")
both("top_orders", "select o_orderkey, o_totalprice from {orders} order by o_totalprice desc, o_orderkey limit 20")
both("status_equality_dropna", "select c_mktsegment, count(*) as n from {customer} where c_mktsegment = 'BUILDING' and c_acctbal is not null and c_name is not null group by c_mktsegment")
both("sentinel_filter", "select count(*) as kept from {supplier} where s_acctbal <> -9999 and s_acctbal is not null")
both("deleg_stddev_percentile", "select l_returnflag, round(stddev_samp(l_quantity), 6) as sd, round(quantile_cont(l_quantity, 0.5), 6) as median, sum(l_quantity) as total from {lineitem} group by l_returnflag", "select l_returnflag, round(stddev_samp(l_quantity), 6) as sd, round(percentile(l_quantity, 0.5), 6) as median, sum(l_quantity) as total from {lineitem} group by l_returnflag")
both("deleg_cube", "select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as qty from {lineitem} group by cube (l_returnflag, l_linestatus)")
both("deleg_rollup", "select l_returnflag, l_linestatus, count(*) as n from {lineitem} group by rollup (l_returnflag, l_linestatus)")
both("deleg_grouping_sets", "select o_orderstatus, o_orderpriority, count(*) as n from {orders} group by grouping sets ((o_orderstatus), (o_orderpriority), ())")
both("deleg_list_agg", "select n_regionkey, string_agg(n_name, ',' order by n_name) as names from {nation} group by n_regionkey", "select n_regionkey, listagg(n_name, ',') within group (order by n_name) as names from {nation} group by n_regionkey")


@query("\nunion all\n".join(f"select '{c}' as \"column\", round(corr({c}::double, l_extendedprice), 6) as r from lineitem" for c in ("l_quantity", "l_discount", "l_tax", "l_linenumber")))
def correlation_to_target(spark, t):
    """AGG17: one aggregation for all columns."""
    cols = ("l_quantity", "l_discount", "l_tax", "l_linenumber")
    one = t["lineitem"].agg(*[F.corr(F.col(c).cast("double"), "l_extendedprice").alias(c) for c in cols])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.round(c, 6).alias("r")) for c in cols])).alias("x")).select("x.*").orderBy("r")


@query("select quantile_disc(n, 0.5) as median from (select count(*) as n from lineitem group by l_orderkey)")
def median_group_size(spark, t):
    """AGG33."""
    sizes = t["lineitem"].groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return sizes.agg(F.expr("percentile_disc(0.5) within group (order by n)").cast("long").alias("median"))


# --- joins ----------------------------------------------------------------------------------------


@query("select n_name, coalesce(r_name, 'code ' || n_regionkey) as region from nation left join (select * from region where r_regionkey < 3) r on n_regionkey = r_regionkey")
def lookup_with_default(spark, t):
    """JON01, JON02."""
    dim = t["region"].where("r_regionkey < 3")
    return t["nation"].join(dim, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_name", F.coalesce("r_name", F.concat(F.lit("code "), F.col("n_regionkey").cast("string"))).alias("region"))


_OLD = "select l_orderkey as slug, l_linenumber as cell, l_returnflag as status from lineitem where l_orderkey % 7 <> 0"
_NEW = "select l_orderkey as slug, l_linenumber as cell, case when l_quantity > 45 then 'X' else l_returnflag end as status from lineitem where l_orderkey % 11 <> 0"


def _cells(t):
    old = t["lineitem"].where("l_orderkey % 7 <> 0").selectExpr("l_orderkey as slug", "l_linenumber as cell", "l_returnflag as status")
    new = t["lineitem"].where("l_orderkey % 11 <> 0").selectExpr("l_orderkey as slug", "l_linenumber as cell", "case when l_quantity > 45 then 'X' else l_returnflag end as status")
    once = lambda df: df.groupBy("slug", "cell").agg(F.min("status").alias("status"))
    return once(old), once(new)


_ONCE = f"with o as (select slug, cell, min(status) as status from ({_OLD}) group by slug, cell), n as (select slug, cell, min(status) as status from ({_NEW}) group by slug, cell)"


@query(f"""{_ONCE} select case when o.status is null then 'added' when n.status is null then 'removed' when o.status = n.status then 'unchanged' else 'mutated' end as outcome, count(*) as n
from o full outer join n using (slug, cell) group by 1""")  # noqa: E501
def keyed_diff_counts(spark, t):
    """JON04."""
    old, new = _cells(t)
    return D.keyed_difference(new, old, ["slug", "cell"]).groupBy("outcome").agg(F.count("*").alias("n"))


@query(f"{_ONCE} select count(*) as violations from o full outer join n using (slug, cell) where n.status is null or (o.status is not null and o.status <> n.status) or (o.status is null and n.status = 'X')")
def regression_gate(spark, t):
    """VAL03."""
    old, new = _cells(t)
    return D.violations(D.keyed_difference(new, old, ["slug", "cell"]), "X").agg(F.count("*").alias("violations"))


both("removed_cells", "select count(*) as n from {orders} o where not exists (select 1 from {lineitem} l where l.l_orderkey = o.o_orderkey and l.l_quantity > 49)", "select count(*) as n from {orders} o left anti join (select l_orderkey from {lineitem} where l_quantity > 49) l on l_orderkey = o_orderkey")
both("kept_cells", "select count(*) as n from {customer} c where exists (select 1 from {orders} o where o.o_custkey = c.c_custkey)", "select count(*) as n from {customer} left semi join {orders} on o_custkey = c_custkey")
both("slug_left_join", "select s_suppkey, n_name from {supplier} left join {nation} on s_nationkey = n_nationkey")
both("verdict_matrix", "select c.cell, r.reader, count(e.event_id) as n from (select distinct event_type as cell from {events}) c cross join (select r_name as reader from {region}) r left join {events} e on e.event_type = c.cell and e.user_id % 5 = length(r.reader) % 5 group by 1, 2")
both("deleg_theta_join", "select a.n_name as a, b.n_name as b from {nation} a join {nation} b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey")
both("deleg_right_join", "select r_name, count(s_suppkey) as suppliers from {supplier} join {nation} on s_nationkey = n_nationkey right join {region} on n_regionkey = r_regionkey group by r_name")
both("deleg_full_join", "select count(*) as n, count(c_custkey) as customers, count(s_suppkey) as suppliers from {customer} full join {supplier} on c_nationkey = s_nationkey and c_acctbal = s_acctbal")
both("deleg_cross_join", "select count(*) as n from {region} cross join {nation}")
both("deleg_shuffle_join_agg", "select c_mktsegment, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from {customer} join {orders} on c_custkey = o_custkey join {lineitem} on l_orderkey = o_orderkey group by c_mktsegment")


@query("with m as (select user_id, ts, event_id, last_value(case when event_type = 'purchase' then value end ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding) as last_purchase from events) select user_id, event_id, last_purchase from m")
def deleg_asof_last(spark, t):
    """JON11 by a window."""
    return t["events"].selectExpr("user_id", "event_id", "last(case when event_type = 'purchase' then value end, true) over (partition by user_id order by ts, event_id rows unbounded preceding) as last_purchase")


# --- windows, sorting, sets -----------------------------------------------------------------------

both("deleg_dense_rank", "select o_orderkey, cast(dense_rank() over (partition by o_orderstatus order by o_orderpriority) as integer) as r from {orders}")
both("deleg_running_sum", "select l_orderkey, l_linenumber, round(sum(l_quantity) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity rows unbounded preceding), 4) as running from {lineitem}")
both("deleg_top_k_per_group", "select * from (select o_orderstatus, o_orderkey, cast(row_number() over (partition by o_orderstatus order by o_totalprice desc, o_orderkey) as integer) as r from {orders}) where r <= 3")
both("deleg_session_gap", "with g as (select user_id, ts, event_id, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 1 hour then 0 else 1 end as new from {events}) select user_id, cast(sum(new) as bigint) as sessions from g group by user_id")
both("deleg_intersect", "select c_nationkey as k from {customer} intersect select s_nationkey from {supplier}")
both("deleg_except", "select n_nationkey as k from {nation} except select s_nationkey from {supplier} where s_acctbal > 5000")
both("deleg_union", "select n_regionkey as k from {nation} union select r_regionkey from {region}")


@query("select time_bucket(interval 1 hour, ts) as window_start, event_type, count(*) as n from events group by all")
def tumbling_hour(spark, t):
    """STM00, an extension: the same window serves streams."""
    return W.tumbling(t["events"], "ts", "1 hour", ["event_type"]).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 30 minute then 0 else 1 end as fresh from events), s as (select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as s from g) select user_id, min(ts) as session_start, max(ts) + interval 30 minute as session_end, count(*) as n from s group by user_id, s")
def session_windows(spark, t):
    """STM00, an extension."""
    r = W.sessions(t["events"], "ts", "30 minutes", ["user_id"])
    return r.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n")


@query("select p_partkey, p_name, case when list_contains(string_split(lower(p_name), '-'), 'red') then 0 when lower(p_name) like '%red%' then 1 when lower(p_name || ' ' || p_brand || ' ' || p_type) like '%red%' then 2 else 3 end as rank from part")
def match_rank(spark, t):
    """WIN03, SRT03."""
    return t["part"].select("p_partkey", "p_name", C.match_rank(["Red"], "p_name", ["p_brand", "p_type"]).alias("rank")).orderBy("rank", "p_partkey")


@query("select 'a_' || p_partkey || '.csv' as file, cast(row_number() over (order by p_partkey) as integer) as place from part where p_partkey < 150")
def order_by_number_in_name(spark, t):
    """SRT06: parts of a table by the number in their names."""
    files = [r[0] for r in t["part"].where("p_partkey < 150").selectExpr("concat('a_', p_partkey, '.csv')").collect()]
    return spark.createDataFrame([(f, i) for i, f in enumerate(sorted(files, key=X.number_in_name), 1)], "file string, place int")


@query("with a as (select o_orderkey as k, o_orderstatus as s, null::double as price from orders where o_orderkey % 2 = 0), b as (select o_orderkey as k, null as s, o_totalprice as price from orders where o_orderkey % 2 = 1) select k, s, price, 0 as part from a union all select k, s, price, 1 from b")
def union_by_name_padded(spark, t):
    """SET01, PRJ09, PRJ11, PRJ12."""
    a = t["orders"].where("o_orderkey % 2 = 0").selectExpr("o_orderkey", "o_orderstatus as s")
    b = t["orders"].where("o_orderkey % 2 = 1").selectExpr("o_totalprice as price", "o_orderkey")
    return U.by_name([a, b], {"o_orderkey": "k"}, order_column="part")


@query("select p_partkey as k, p_size as v from part union all select s_suppkey, cast(trunc(s_acctbal) as integer) from supplier")
def union_first_type_wins(spark, t):
    """SET03."""
    a = t["part"].selectExpr("p_partkey as k", "p_size as v")
    b = t["supplier"].selectExpr("s_suppkey as k", "s_acctbal as v")
    return U.by_name([a, b], first_type_wins=True)


@query("select r_regionkey::varchar as k from region union all select n_name from nation")
def union_conflict_as_text(spark, t):
    """SET04: unlike types meet as text."""
    return U.by_name([t["region"].selectExpr("r_regionkey as k"), t["nation"].selectExpr("n_name as k")])


# --- types, names, projections --------------------------------------------------------------------

_PLAN = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query("\nunion all\n".join(f"select '{c}' as \"column\", case when min({c}) < 0 then case when min({c}) >= -128 and max({c}) < 128 then 'int8' when min({c}) >= -32768 and max({c}) < 32768 then 'int16' when min({c}) >= -2147483648 and max({c}) < 2147483648 then 'int32' else 'int64' end when max({c}) < 256 then 'uint8' when max({c}) < 65536 then 'uint16' when max({c}) < 4294967296 then 'uint32' else 'uint64' end as label from lineitem" for c in _PLAN))
def type_plan(spark, t):
    """AGG27, MTH03."""
    return spark.createDataFrame(G.plan(t["lineitem"].select(*_PLAN)), "column string, label string")


@query("select 'text' as \"column\", case when count(text) > 0 then 'string' end as label from documents")
def utf8_plan(spark, t):
    """AGG28, STR07: bytes that are text throughout, and others that are not."""
    df = t["documents"].select(F.col("text").cast("binary").alias("text"), F.unhex(F.lit("ff")).alias("bad"))
    return spark.createDataFrame(G.plan(df), "column string, label string")


@query("select 'embedding' as \"column\", 'fixed_size_list[' || min(len(embedding)) || ']' as label from embeddings having min(len(embedding)) = max(len(embedding))")
def fixed_list_plan(spark, t):
    """ARR02."""
    return spark.createDataFrame(G.plan(t["embeddings"].select("embedding")), "column string, label string")


@query("select sum(l_linenumber)::bigint as lines, count(*) as n, 'smallint' as stored from lineitem")
def tightened_values(spark, t):
    """CST01: narrowed columns hold the same values."""
    df = G.tighten(t["lineitem"].select("l_linenumber"))
    return df.agg(F.sum("l_linenumber").alias("lines"), F.count("*").alias("n")).withColumn("stored", F.lit(df.schema[0].dataType.simpleString()))


@query(r"""with n as (select distinct ' ' || p_type || ' (' || p_brand || ') /' || n_name as name from part join nation on p_partkey = n_nationkey)
select name, coalesce(nullif(trim(regexp_replace(regexp_replace(lower(trim(name)), '\s+', '_', 'g'), '[^a-z0-9_]+', '_', 'g'), '_'), ''), 'col') as normalised,
       trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(name)), '[ /-]', '_', 'g'), '[^a-z0-9_]', '', 'g'), '_+', '_', 'g'), '_') as snake from n""")
def name_normalise(spark, t):
    """PRJ06, PRJ07."""
    made = t["part"].join(t["nation"], F.col("p_partkey") == F.col("n_nationkey")).selectExpr("concat(' ', p_type, ' (', p_brand, ') /', n_name) as name").distinct()
    return spark.createDataFrame([(r.name, N.normalised(r.name), N.snake(r.name)) for r in made.collect()], "name string, normalised string, snake string")


@query("select cast(n_nationkey as integer) as place, n_regionkey || case when row_number() over (partition by n_regionkey order by n_nationkey) = 1 then '' else ' [' || row_number() over (partition by n_regionkey order by n_nationkey) || ']' end as name from nation")
def names_unique(spark, t):
    """PRJ08."""
    rows = t["nation"].orderBy("n_nationkey").select("n_nationkey", F.col("n_regionkey").cast("string")).collect()
    return spark.createDataFrame(list(zip([r[0] for r in rows], N.unique([r[1] for r in rows]), strict=True)), "place int, name string")


@query("select o_totalprice, o_orderkey from orders")
def projection_order(spark, t):
    """PRJ01, PRJ02."""
    return N.project(t["orders"], ["o_totalprice", "o_orderkey"])


@query("select r_regionkey as k, r_name as inner_name from region")
def projection_nested(spark, t):
    """PRJ03: a path keeps its struct."""
    df = t["region"].select("r_regionkey", F.struct("r_name", "r_regionkey").alias("s"))
    return N.project(df, ["r_regionkey", "s.r_name"]).select(F.col("r_regionkey").alias("k"), F.col("s.r_name").alias("inner_name"))


both("select_except", "select * exclude (c_name, c_acctbal) from {customer}", "select * except (c_name, c_acctbal) from {customer}")


@query("select o_orderkey, o_custkey as customer from orders")
def rename_columns(spark, t):
    """PRJ05."""
    return t["orders"].select("o_orderkey", "o_custkey").withColumnsRenamed({"o_custkey": "customer"})


#: DuckDB's names of the tables' types, as labels.
_LABEL = "case column_type when 'BIGINT' then 'int64' when 'INTEGER' then 'int32' when 'DOUBLE' then 'float64' when 'VARCHAR' then 'string' when 'TIMESTAMP' then 'timestamp[us]' when 'FLOAT[]' then 'list<float32>' end"


@query(f"select column_name as name, {_LABEL} as dtype from (describe lineitem)")
def dtype_labels(spark, t):
    """CLS02, CAT02."""
    return spark.createDataFrame([(f.name, Y.label(f.dataType, f.metadata)) for f in t["lineitem"].schema], "name string, dtype string")


@query("select column_name as name, case column_type when 'BIGINT' then 'bigint' when 'INTEGER' then 'int' when 'DOUBLE' then 'double' when 'VARCHAR' then 'string' when 'TIMESTAMP' then 'timestamp_ntz' end as kind from (describe lineitem)")
def ddl_schema(spark, t):
    """SRC31's schemas, through the statement that makes the table."""
    words = {"bigint": "BIGINT NOT NULL", "int": "INTEGER", "double": "DECIMAL(12, 2)", "string": "VARCHAR(44)", "timestamp_ntz": "TIMESTAMP"}
    ddl = "CREATE TABLE t (" + ", ".join(f'"{f.name}" {words[f.dataType.simpleString()]}' for f in t["lineitem"].schema) + ")"
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in Y.from_ddl(ddl)], "name string, kind string")


# --- catalog --------------------------------------------------------------------------------------


@query("select doc_id from documents where lang in ('en', 'fr') and source in ('src1', 'src2', 'src3') and coalesce(not (n_chars > 2000), true)")
def facet_filter_documents(spark, t):
    """FLT05: or within an axis, and across; what is unknown passes a negation."""
    df = t["documents"].withColumn("traits", F.create_map(F.lit("long"), F.when(F.col("n_chars") > 2000, True)))
    f = C.Facets({"lang": frozenset({"en", "fr"}), "source": frozenset({"src1", "src2", "src3"})}, without_traits=frozenset({"long"}))
    return df.where(f.condition(df)).select("doc_id")


@query("select doc_id from documents where lang in ('de', 'es')")
def facet_union_and_preset(spark, t):
    """FLT06, FLT10."""
    f = C.Facets().preset(lang=["de"]) | C.Facets({"lang": frozenset({"es"})})
    return t["documents"].where(f.condition(t["documents"])).select("doc_id")


@query("select doc_id from documents where lower(lang) like '%en%' and (lower(text) like '%ing%' or lower(lang) like '%ing%' or lower(source) like '%ing%')")
def query_language(spark, t):
    """FLT07, FLT09."""
    fields = {"lang": ["lang"], "text": ["text"], "source": ["source"]}
    return t["documents"].where(C.query("language:en ING", fields, {"language": "lang"})).select("doc_id")


both("regex_grep", "select p_partkey from {part} where regexp_matches(p_name, '(?i)re.*d')", "select p_partkey from {part} where p_name rlike '(?i)re.*d'")


@query(f"""with c as ({' union all '.join(f"select '{n}' as t, column_name as c, {_LABEL} as type from (describe {n})" for n in ("lineitem", "orders", "nation"))}),
r as (select *, row_number() over (partition by type order by t || '.' || c) as r from c)
select type, count(*) as items, count(distinct t) as groups, string_agg(t || '.' || c, ',' order by t || '.' || c) filter (r <= 3) as examples from r group by type""")
def type_coverage(spark, t):
    """AGG21, AGG22, SRT04."""
    rows = [(Y.label(f.dataType), f"{n}.{f.name}", n) for n in ("lineitem", "orders", "nation") for f in t[n].schema]
    df = spark.createDataFrame(rows, "type string, item string, grp string")
    return C.examples(df, "type", "item", "grp").withColumn("examples", F.array_join("examples", ","))


@query("select s as status, coalesce(n, 0) as n from (values ('F'), ('O'), ('P'), ('X')) v(s) left join (select o_orderstatus, count(*) as n from orders group by 1) on s = o_orderstatus")
def verdict_counts(spark, t):
    """AGG23: zero where a status has no row."""
    return C.status_counts(t["orders"], ["F", "O", "P", "X"], "o_orderstatus")


@query("select o_orderpriority, count(*) filter (o_orderstatus = 'F') as passed, count(*) as n from orders group by o_orderpriority")
def status_rollup(spark, t):
    """AGG24, AGG25."""
    return C.rollup(t["orders"], "o_orderpriority", "o_orderstatus", "F")


def _text_tag(table: str, c: str) -> str:
    """SQL of the tag of a text column, with exact distinct counts."""
    top = f"(select string_agg(v, ' ') from (select {c} as v from {table} where {c} is not null group by {c} order by count(*) desc, {c} limit 5))"
    marks = " or ".join("contains(top, '" + m.replace("'", "''") + "')" for m in C.MARKS)
    return f"""select '{table}' as "table", case when regexp_matches('{c}', '{"|".join(C.LINKS)}') then 'urls' when regexp_matches('{c}', '{"|".join(C.CODE)}') then 'code-strings'
when regexp_matches('{c}', '{"|".join(C.PLACES)}') then 'coordinates' when ndv <= 256 and regexp_matches(lower(top), 'https?://') then 'urls' when ndv <= 256 and (starts_with(ltrim(top), '{{') or {marks}) then 'code-strings'
when len > 80 then 'prose' when len <= 24 and (ndv <= 32 or ndv <= 256 and ndv <= 0.001 * n) then 'enums' when ndv >= 0.5 * n and len between 4 and 40 then 'identifiers' when len >= 40 then 'prose'
when ndv > 256 then 'identifiers' else 'enums' end as tag from (select count(*) as n, count(distinct {c}) as ndv, avg(length({c})) as len, {top} as top from {table})"""


def _number_tag(table: str, c: str, whole: bool) -> str:
    small = "lo >= 0 and hi <= 1000000" if whole else "false"
    return f"select '{table}', case when regexp_matches('{c}', '{'|'.join(C.AXES)}') then 'coordinates' when regexp_matches('{c}', '{'|'.join(C.MONEY)}') then 'monetary' when {small} then 'counts' else 'measurements' end from (select min({c}) as lo, max({c}) as hi from {table})"


_TAGGED = [
    *[_text_tag(n, c) for n, cs in (("lineitem", ("l_returnflag", "l_linestatus")), ("events", ("event_type", "props")), ("documents", ("text", "lang", "source")), ("pages", ("url", "html"))) for c in cs],
    *[_number_tag("lineitem", c, c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")) for c in _NUMBERS],
    *[_number_tag(n, c, c != "value") for n, cs in (("events", ("event_id", "user_id", "value")), ("documents", ("doc_id", "n_chars")), ("embeddings", ("vec_id", "label")), ("pages", ("page_id",))) for c in cs],
    *[f"select '{n}', '{tag}'" for n, tag in (("lineitem", "timestamps"), ("events", "timestamps"), ("embeddings", "embeddings"))],
]


@query(f"""with c as ({' union all '.join(_TAGGED)}), g as (select "table", tag, count(*) as n from c where tag is not null group by all having tag <> 'enums' or count(*) >= 2)
select * from (select *, cast(row_number() over (partition by "table" order by n desc, list_position({list(C.TAGS)}, tag)) as integer) as place from g) where place <= 3""")
def classify_columns(spark, t):
    """CLS01, AGG31, SRT05."""
    parts = [P.profile(t[n]).withColumn("table", F.lit(n)) for n in ("lineitem", "events", "documents", "embeddings", "pages")]
    return C.table_tags(reduce(DataFrame.unionByName, parts))


@query("""select 'events' as "table", count(distinct event_id) * 2 >= count(*) as high_cardinality from events
union all select 'lineitem', greatest(count(distinct l_returnflag), count(distinct l_linestatus)) * 2 >= count(*) from lineitem""")
def high_cardinality_tables(spark, t):
    """AGG29: whether half of the values of a text are distinct."""
    ids = t["events"].select(F.col("event_id").cast("string").alias("id"))
    parts = [P.profile(df).withColumn("table", F.lit(n)) for n, df in (("events", ids), ("lineitem", t["lineitem"].select("l_returnflag", "l_linestatus")))]
    return C.high_cardinality(reduce(DataFrame.unionByName, parts))


@query("\nunion all\n".join(f"""select '{n}' as "table", unnest(['has_nested', 'has_timestamp', 'has_variant', 'string_heavy', 'wide_row']) as trait,
unnest([count(*) filter (column_type like '%[]') > 0, count(*) filter (column_type like 'TIMESTAMP%') > 0, false, count(*) filter (column_type = 'VARCHAR') * 2 > count(*), count(*) > 50]) as holds from (describe {n})""" for n in TABLES))
def shape_traits(spark, t):
    """AGG30."""
    return spark.createDataFrame([(n, k, v) for n in TABLES for k, v in C.shape_traits(t[n]).items()], "table string, trait string, holds boolean")


@query("select case when n_chars * 5000 < 10485760 then 'xs' when n_chars * 5000 < 104857600 then 's' when n_chars * 5000 < 1073741824 then 'm' else 'l' end as bucket, count(*) as n from documents group by 1")
def size_buckets(spark, t):
    """MTH05."""
    return t["documents"].groupBy(S.size_bucket(F.col("n_chars") * 5000).alias("bucket")).agg(F.count("*").alias("n"))


both("tag_distribution", "select tag, count(*) as n from (select unnest([lang, source]) as tag from {documents}) group by tag", "select tag, count(*) as n from (select explode(array(lang, source)) as tag from {documents}) group by tag")


# --- scalar functions -----------------------------------------------------------------------------

both("json_props_value_counts", "select cast(json_extract(props, '$.k') as integer) as k, count(*) as n from {events} group by 1", "select variant_get(parse_json(props), '$.k', 'int') as k, count(*) as n from {events} group by 1")


@query("select kind, count(*) as n from (select case when event_id % 5 = 0 then 'invalid' when event_id % 5 = 1 then 'array' else 'object' end as kind from events) group by kind")
def json_type_classify(spark, t):
    """JSN02, JSN03."""
    text = F.when(F.col("event_id") % 5 == 0, "{bad").when(F.col("event_id") % 5 == 1, "[1]").otherwise(F.col("props"))
    return t["events"].groupBy(V.json_kind(text).alias("kind")).agg(F.count("*").alias("n"))


@query("select event_type, count(*) filter (event_id % 3 = 0) as sql_nulls, count(*) filter (event_id % 3 = 1) as json_nulls, count(*) filter (event_id % 3 = 2) as objects from events group by event_type")
def json_nulls_distinct(spark, t):
    """JSN04, JSN06: variant columns are found by their type, and both nulls told apart."""
    text = F.when(F.col("event_id") % 3 == 1, "null").when(F.col("event_id") % 3 == 2, F.col("props"))
    df = t["events"].select("event_type", V.parse(text).alias("v"))
    v = F.col(V.variant_columns(df)[0])
    json = F.coalesce(F.is_variant_null(v), F.lit(False))
    return df.groupBy("event_type").agg(F.count_if(v.isNull()).alias("sql_nulls"), F.count_if(json).alias("json_nulls"), F.count_if(v.isNotNull() & ~json).alias("objects"))


both("signed_duration", "select o_orderkey, epoch_us(o_orderdate) - epoch_us(timestamp '1995-06-17 00:00:00') as us from {orders}", "select o_orderkey, timestampdiff(MICROSECOND, timestamp_ntz '1995-06-17 00:00:00', o_orderdate) as us from {orders}")


@query("select lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) as host, count(*) as n from pages group by 1")
def url_host_counts(spark, t):
    """URL01."""
    return t["pages"].groupBy(S.host_of(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


@query("select page_id, case when regexp_matches(url, 'spam') then 'blocked_by_host' else 'allowed' end as decision from pages")
def url_decisions(spark, t):
    """FLT11, URL02."""
    return t["pages"].select("page_id", S.url_decision(F.col("url"), F.col("url").contains("spam")).alias("decision"))


both("content_sha256", "select doc_id, sha256(text) as h from {documents}", "select doc_id, sha2(text, 256) as h from {documents}")
both("trim_lower_replace", "select p_partkey, regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '_', 'g') as name from {part}", "select p_partkey, regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '_') as name from {part}")
both("char_and_byte_length", "select doc_id, length(text) as chars, strlen(text) as bytes from {documents}", "select doc_id, cast(char_length(text) as bigint) as chars, cast(octet_length(text) as bigint) as bytes from {documents}")


@query("select s_suppkey, strftime(to_timestamp(s_suppkey * 86400), '%Y-%m-%dT%H:%M:%S') || '+00:00' as iso from supplier")
def iso_timestamps(spark, t):
    """DAT01, DAT02."""
    return t["supplier"].select("s_suppkey", S.iso_millis(F.col("s_suppkey") * 86_400_000).alias("iso"))


@query("""select p_partkey, 'see https://<redacted-credential>@h' || p_size || '/x?client_secret=<redacted-credential>&ok=' || p_size || '&x-amz-signature=<redacted-credential>&pwd=<redacted-credential>' as url,
'in <redacted-path> or <redacted-path> at http://h:80' || p_size || '/@' || p_size || ' and /homer/' || p_size as path from part""")
def redaction(spark, t):
    """STR09."""
    url = "concat('see https://u', p_partkey, if(p_partkey % 2 = 0, concat(':p/w', p_size), ''), '@h', p_size, '/x?client_secret=s', p_partkey, '&ok=', p_size, '&x-amz-signature=a', p_size, '&pwd=', p_partkey)"
    path = r"concat('in /opt/app/', p_partkey, ' or C:\\Users\\bob\\', p_partkey, ' at http://h:80', p_size, '/@', p_size, ' and /homer/', p_size)"
    raw = t["part"].selectExpr("p_partkey", f"{url} as url", f"{path} as path")
    return raw.select("p_partkey", *[S.redacted(F.col(c)).alias(c) for c in ("url", "path")])


@query("select l_orderkey, l_linenumber, case when l_linenumber % 4 = 2 then null when l_linenumber % 4 = 1 then -cast(l_quantity as integer) else cast(l_quantity as integer) end as n from lineitem")
def optional_ints(spark, t):
    """MTH06: with and without a sign, and unknown."""
    text = F.expr("concat(case l_linenumber % 4 when 0 then '+' when 1 then '-' else '' end, cast(l_quantity as int))")
    return t["lineitem"].select("l_orderkey", "l_linenumber", S.optional_int(F.when(F.col("l_linenumber") % 4 == 2, "?").otherwise(text)).alias("n"))


@query("select count(*) filter (l_quantity = l_quantity::integer) as whole, count(*) as n from lineitem")
def reversible_casts(spark, t):
    """CST02."""
    return t["lineitem"].agg(F.count_if(S.reversible(F.col("l_quantity"), "int", "double")).alias("whole"), F.count("*").alias("n"))


@query("select 21 as bytes, count(*) as n from supplier")
def point_wkb(spark, t):
    """GEO01, GEO02."""
    w = t["supplier"].select(F.octet_length(S.point_wkb(F.col("s_acctbal"), F.col("s_suppkey").cast("double"))).alias("bytes"))
    return w.groupBy("bytes").agg(F.count("*").alias("n"))


# --- comparison and validation --------------------------------------------------------------------


@query("select 0::bigint as differing")
def table_equal_self(spark, t):
    """CMP01, whatever the partitioning."""
    return D.unequal_rows(t["lineitem"], t["lineitem"].repartition(7)).agg(F.count("*").alias("differing"))


@query("select 2 * count(*) as differing from (select distinct * from supplier where s_acctbal > 0)")
def table_equal_changed(spark, t):
    changed = t["supplier"].withColumn("s_acctbal", F.when(F.col("s_acctbal") > 0, -F.col("s_acctbal") - 1e6).otherwise(F.col("s_acctbal")))
    return D.unequal_rows(t["supplier"], changed).agg(F.count("*").alias("differing"))


@query("""select 'signed zero' as what, 2 * count(*) filter (l_discount = 0) as differing from lineitem union all select 'nan', 0 union all select 'width', 0
union all select 'nested', 2 * count(*) filter (l_discount = 0) from lineitem""")
def float_identity(spark, t):
    """CMP01: NaN equals itself, zeros of unlike sign do not, widths do not matter."""
    df = t["lineitem"].select("l_orderkey", "l_linenumber", "l_discount")
    turned = df.withColumn("l_discount", F.when(F.col("l_discount") == 0, F.lit(-0.0)).otherwise(F.col("l_discount")))
    nan = df.withColumn("l_discount", F.when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(F.col("l_discount")))
    wide = df.withColumn("l_linenumber", F.col("l_linenumber").cast("bigint"))
    nest = lambda x: x.withColumn("l_discount", F.array(F.struct(F.col("l_discount").alias("f"))))
    pairs = (("signed zero", df, turned), ("nan", nan, nan.repartition(3)), ("width", df, wide), ("nested", nest(df), nest(turned)))
    return reduce(DataFrame.unionAll, [D.unequal_rows(a, b).agg(F.lit(what).alias("what"), F.coalesce(F.sum("times"), F.lit(0)).alias("differing")) for what, a, b in pairs])


@query("select o_orderkey as k from orders where o_orderstatus = 'P'")
def ordered_difference(spark, t):
    """CMP02, JON05: keys of the rows that differ."""
    a = t["orders"].selectExpr("o_orderkey as k", "o_orderstatus as s")
    b = a.withColumn("s", F.when(F.col("s") == "P", "Q").otherwise(F.col("s")))
    return D.ordered_difference(a, b, "k").select("k")


@query("select c_nationkey as slug, count(*) as n from customer group by 1 having count(*) > 1")
def repeated_keys(spark, t):
    """VAL05."""
    return t["customer"].groupBy(F.col("c_nationkey").alias("slug")).agg(F.count("*").alias("n")).where("n > 1")


# --- sources and sinks ----------------------------------------------------------------------------

_TRIP = "select r_name, count(*) as n, round(sum(n_nationkey), 2) as keys from nation join region on n_regionkey = r_regionkey group by r_name"


def _trip(spark, nation, region):
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count("*").alias("n"), F.round(F.sum("n_nationkey").cast("double"), 2).alias("keys"))


def _round_trip(fmt: str, read: Callable) -> None:
    def run(spark, t):
        p = scratch(spark, fmt)
        t["nation"].write.format(fmt).options(**({"header": True} if fmt == "csv" else {})).save(p)
        return _trip(spark, read(spark, p), t["region"])

    _ALL[f"{fmt}_roundtrip"] = (run, _TRIP.replace("round(sum(n_nationkey), 2)", "round(sum(n_nationkey)::double, 2)"))


_round_trip("csv", lambda s, p: R.csv(s, p))
_round_trip("orc", R.orc)
_round_trip("json", lambda s, p: R.jsonl(s, p, "n_nationkey int, n_name string, n_regionkey int"))
_round_trip("parquet", R.parquet)


@query(_TRIP.replace("round(sum(n_nationkey), 2)", "round(sum(n_nationkey)::double, 2)"))
def arrow_roundtrip(spark, t):
    """SRC02, SNK12."""
    import pyarrow as pa

    sink, table = pa.BufferOutputStream(), t["nation"].toArrow()
    with pa.ipc.new_file(sink, table.schema) as w:
        w.write_table(table)
    p = scratch(spark, "arrow")
    put(spark, p + ".arrow", sink.getvalue().to_pybytes(), forget=True)
    return _trip(spark, R.arrow_ipc(spark, p + ".arrow"), t["region"])


@query("select count(*) as rows, round(sum(s_acctbal), 2) as total from supplier")
def publish_verified(spark, t):
    """SNK01, SNK02, SNK09, SNK10."""
    p = scratch(spark, "published")
    back = sinks.publish(t["supplier"], p, verify=True, **sinks.parquet_options(level=3))
    back = sinks.publish(back.where("true"), p + "-b", verify=True)
    return back.agg(F.count("*").alias("rows"), F.round(F.sum("s_acctbal"), 2).alias("total"))


@query("select 'l_orderkey' as \"column\", count(*) as rows, count(*) - count(l_orderkey) as nulls from lineitem")
def row_group_stats(spark, t):
    """SRC38, AGG26."""
    return R.footer_summary(R.footers(spark, t["lineitem"])).where("column = 'l_orderkey'").select("column", "rows", "nulls")


@query("select * from (values ('new york', 3, 6.0), ('. . .', 3, 15.0)) v(token, n, total)")
def word_vectors(spark, t):
    """SRC19."""
    p = _put(spark, "new york 1.0 2.0 3.0\n. . . 4 5 6\n")
    return X.word_vectors(spark, p, 3).select("token", F.size("vector").alias("n"), F.aggregate("vector", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("select * from (values ('2020-01-01', 12), ('2020-01-03', -5)) v(day, v)")
def daily_fixed_width(spark, t):
    """SRC14, FLT04."""
    cells = "".join(f"{v:5d}   " for v in [12, -9999, -5] + [-9999] * 28)
    p = _put(spark, f"USW00000001202001TMAX{cells}\n")
    return X.daily_fixed_width(spark, p).select(F.col("date").cast("string").alias("day"), F.col("value").alias("v"))


@query("select * from (values (1, 'a<b', 2.5), (2, null, 4.0)) v(Id, Name, Score)")
def xml_rows(spark, t):
    """SRC15."""
    p = _put(spark, '<?xml version="1.0"?>\n<rows>\n<row Id="1" Name="a&lt;b" Score="2.5" />\n<row Id="2" Score="4" />\n</rows>\n')
    return X.xml_rows(spark, p, "Id int, Name string, Score double")


@query("select * from (values ('/a/1', 3::bigint, timestamp '2008-04-01 03:28:50.625462', 'Ann'), ('/a/2', 1, timestamp '2008-04-01 03:28:50', 'Bob')) v(key, revision, last_modified, name)")
def tabs_then_json(spark, t):
    """SRC17, STR02."""
    p = _put(spark, '/type/author\t/a/1\t3\t2008-04-01T03:28:50.625462\t{"name": "Ann"}\n/type/author\t/a/2\t1\t2008-04-01T03:28:50\t{"name": "Bob"}\n')
    return X.tabs_then_json(spark, p).select("key", "revision", "last_modified", F.expr("variant_get(record, '$.name', 'string')").alias("name"))


@query("select * from (values ('A', '1. e4 e5 1-0'), ('B', '1. d4 0-1')) v(white, moves)")
def tagged_games(spark, t):
    """SRC16."""
    p = _put(spark, '[Event "x"]\n[White "A"]\n\n1. e4\ne5 1-0\n\n[Event "y"]\n[White "B"]\n\n1. d4 0-1\n')
    return X.tagged_games(spark, p).select(F.element_at("tags", "White").alias("white"), "moves")


@query("select * from (values (1::bigint, 2.5, 'x'), (3, 4.0, 'y')) v(a, b, c)")
def white_space_text(spark, t):
    """SRC23, CST03."""
    return X.white_space(spark, _put(spark, "  1 2.5 x\n3\t4  y\n"), ["a", "b", "c"])


@query("select * from (values (1.0, 2.0), (3.0, 4.5)) v(a, b)")
def text_after_preamble(spark, t):
    """SRC24."""
    return X.after_preamble(spark, _put(spark, "California\nhousing data 1990\n1 2\n3 4.5\n"), ["a", "b"])


@query("select 3::bigint as n, 6.0 as total")
def wrapped_jsonl(spark, t):
    """SRC29."""
    p = _put(spark, '{"n": 1, "text": "abcd\nefgh"}\n{"n": 2}\n{"n": 3}\n')
    return X.wrapped_jsonl(spark, p, wrap=22).agg(F.count("*").alias("n"), F.sum(F.expr("variant_get(record, '$.n', 'double')")).alias("total"))


@query("select * from (values (1, 'x', 0), (2, 'y', 5)) v(a, b, c)")
def piped_parts(spark, t):
    """SRC31, SET03."""
    p1, p2 = _put(spark, "1|x\n", "_1.csv"), _put(spark, "2|y|5\n", "_2.csv")
    return X.piped_parts(spark, [(p2, "create table t (a integer, b varchar(5), c integer)"), (p1, "create table t (a integer, b varchar(5))")]).fillna(0, ["c"])


@query("select * from (values (1::bigint, 'a'), (0, 'NA x')) v(n, s)")
def csv_null_spellings(spark, t):
    """SRC08: null spellings, quoted line breaks, empty lines."""
    return R.csv(spark, _put(spark, 'n,s\n1,a\n\nN/A,"NA x"\n', ".csv")).fillna(0, ["n"])


@query("select * from (values ('ads.example', 1), ('evil.example', 2)) v(host, k)")
def blocklist_hosts(spark, t):
    """URL02."""
    p = _put(spark, "# hosts\n0.0.0.0 Evil.example\nads.example:80 # x\nlocalhost\n")
    return X.blocklist(spark, p).selectExpr("host", "cast(row_number() over (order by host) as int) as k")


@query("select * from (values ('{\"a\": 1}'), ('{\"b\":  2 }')) v(raw_json)")
def raw_json_lines(spark, t):
    """SRC30."""
    return X.raw_json(spark, _put(spark, '{"a": 1}\r\n\n{"b":  2 }\n'))


@query("select r_regionkey, r_name, n_name from region join nation on r_regionkey = n_nationkey")
def zipped_by_position(spark, t):
    """SRC25, JON06."""
    return X.zipped_by_position([t["region"].orderBy("r_regionkey"), t["nation"].where("n_nationkey < 5").orderBy("n_nationkey").select("n_name")])


# --- the handle, layouts and handlers ---------------------------------------------------------------


@query("select count(*) as rows, sum(s_suppkey) as keys from supplier")
def pinned_replay(spark, t):
    """SRC06, SRC10: two passes over one generation of the files."""
    d = H.open_folder(spark, t.sf_dir, ["supplier"], pinned=True)["supplier"]
    rows = d.frame([]).count()
    return d.frame(["s_suppkey"]).agg(F.sum("s_suppkey").alias("keys")).withColumn("rows", F.lit(rows).cast("long")).select("rows", "keys")


@query("\nunion all\n".join(f"select '{n}' as \"table\", count(*) as rows from {n}" for n in TABLES))
def footer_counts(spark, t):
    """SRC39: numbers of rows from the footers alone."""
    return spark.createDataFrame([(n, R.row_count(spark, t[n])) for n in TABLES], "table string, rows long")


@query("select n_nationkey from nation limit 7")
def first_rows(spark, t):
    """LIM01: by the place in the input."""
    return H.Dataset(spark, "nation", lambda: t["nation"]).head(7).select("n_nationkey")


@query("\nunion all\n".join(f"select '{n}' as slug, column_name as name, {_LABEL} as dtype from (describe {n})" for n in TABLES))
def all_columns(spark, t):
    """CAT01, CAT02: every column of every table, from the listing."""
    return H.all_columns(H.open_folder(spark, t.sf_dir, list(TABLES)))


@query("\nunion all\n".join(f"select '{c}' as \"column\", count(*) - count({c}) as null_count, cast(min({c}) as varchar) as low, cast(max({c}) as varchar) as high from orders" for c in ("o_orderkey", "o_custkey")))
def profile_json(spark, t):
    """SNK11: the published document, read back."""
    p = scratch(spark, "profiles")
    path = H.publish_profile(H.Dataset(spark, "orders", lambda: t["orders"]), p)
    assert path == H.found_profile(spark, "orders", p)
    columns = spark.read.option("multiLine", True).json(path).select(F.explode("columns").alias("c")).select("c.*")
    return columns.where("column in ('o_orderkey', 'o_custkey')").select("column", "null_count", F.col("min").alias("low"), F.col("max").alias("high"))


@query("select count(*) as rows, count(*) >= 1000 as more_than_one_group, true as groups_hold_at_most_500, 2 as columns_with_bounds from lineitem")
def parquet_layout(spark, t):
    """SNK02, SNK03: row groups end at a number of rows, and only the first columns get statistics."""
    p = scratch(spark, "layout")
    back = sinks.EXPORTERS["parquet"](t["lineitem"].coalesce(1), p, most_rows=500, statistics_columns=2)
    stats = R.footers(spark, back)
    groups = stats.groupBy("file", "row_group").agg(F.max("rows").alias("rows"), F.count("low").alias("bounds"))
    return groups.agg(F.sum("rows").alias("rows"), (F.count("*") > 1).alias("more_than_one_group"), (F.max("rows") <= 500).alias("groups_hold_at_most_500"), F.max("bounds").cast("int").alias("columns_with_bounds"))


@query("\nunion all\n".join(f"select '{c}' as \"column\", count(*) as rows, count(*) - count({c}) as nulls, cast(min({c}) as varchar) as low, cast(max({c}) as varchar) as high from lineitem" for c in ("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")))
def footer_bounds(spark, t):
    """AGG26: over many files and row groups."""
    p = scratch(spark, "groups")
    t["lineitem"].repartition(3).write.options(**sinks.parquet_options(group_rows=700)).parquet(p)
    return R.footer_summary(R.footers(spark, R.parquet(spark, p))).where("column in ('l_orderkey', 'l_partkey', 'l_linenumber', 'l_returnflag')").drop("groups", "bytes")


@query("""select event_type, count(*) filter (event_id % 4 = 0) as sql_nulls, count(*) filter (event_id % 4 = 1) as json_nulls, sum(case when event_id % 4 > 1 then cast(json_extract(props, '$.k') as integer) end) as k,
count(*) filter (event_id % 2 = 1) as later from events group by event_type""")
def json_columns(spark, t):
    """SRC32, SET05: shards whose columns differ, JSON text as VARIANT, both nulls told apart."""
    p = scratch(spark, "shards")
    text = F.when(F.col("event_id") % 4 == 1, "null").when(F.col("event_id") % 4 > 1, F.col("props"))
    for odd in (0, 1):
        part = t["events"].where(f"event_id % 2 = {odd}").select("event_type", text.alias("sections"), F.col("props").alias("infoboxes"), *([F.lit(1).alias("later")] if odd else []))
        part.write.parquet(f"{p}/{odd}")
    df = X.json_columns(spark, [f"{p}/0", f"{p}/1"])
    v = F.col("sections")
    return df.groupBy("event_type").agg(F.count_if(v.isNull()).alias("sql_nulls"), F.count_if(F.is_variant_null(v)).alias("json_nulls"), F.sum(F.variant_get(v, "$.k", "int")).alias("k"), F.count("later").alias("later"))


@query("select reader, count(*) as n, count(*) as by_column from nation cross join (values ('csv'), ('pipes'), ('xml'), ('games'), ('json')) v(reader) group by reader")
def good_files_count(spark, t):
    """SRC08, SRC11, SRC15, SRC16, SRC31: readers that refuse bad records count good ones, and by one column."""
    rows = t["nation"].orderBy("n_nationkey").select("n_nationkey", "n_name").collect()
    made = {
        "csv": R.csv(spark, _put(spark, "k,name\n" + "".join(f'{r[0]},"{r[1]}\nx"\n' for r in rows), ".csv"), "k int, name string"),
        "pipes": X.piped_parts(spark, [(_put(spark, "".join(f"{r[0]}|{r[1]}\n" for r in rows), "_1.csv"), "create table t (k integer, name varchar)")]),
        "xml": X.xml_rows(spark, _put(spark, "<rows>\n" + "".join(f'<row k="{r[0]}" name="{r[1]}" />\n' for r in rows) + "</rows>\n", ".xml"), "k int, name string"),
        "games": X.tagged_games(spark, _put(spark, "\n".join(f'[Event "{r[0]}"]\n[White "{r[1]}"]\n\n1. e4 1-0\n' for r in rows))).withColumnRenamed("moves", "name"),
        "json": R.jsonl(spark, _put(spark, "".join(f'{{"k": {r[0]}, "name": "{r[1]}"}}\n' for r in rows), ".json"), "k int, name string"),
    }
    return spark.createDataFrame([(n, df.count(), df.select("name").agg(F.count("name")).first()[0]) for n, df in made.items()], "reader string, n long, by_column long")


@query("select n_nationkey, n_name, n_regionkey from nation")
def duckdb_table(spark, t):
    """SRC13."""
    import os
    import tempfile

    import duckdb

    nation = t["nation"].orderBy("n_nationkey").toArrow()  # noqa: F841  (DuckDB reads it by name)
    with tempfile.TemporaryDirectory() as folder:
        file = os.path.join(folder, "t.db")
        with duckdb.connect(file) as c:
            c.execute("create table nation as select * from nation")
        return R.duckdb_table(spark, file, "nation", batch=10)


@query("select n_nationkey, n_name, n_regionkey from nation")
def nested_zip(spark, t):
    """SRC27, ACQ06: a CSV for each region, some in a zip within the zip, unpacked to the shared folder."""
    import io
    import os
    import tempfile
    import zipfile

    files: dict[int, list[str]] = {}
    for r in t["nation"].orderBy("n_nationkey").collect():
        files.setdefault(r.n_regionkey, ["n_nationkey,n_name,n_regionkey"]).append(f"{r.n_nationkey},{r.n_name},{r.n_regionkey}")
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        for k in (0, 1):
            z.writestr(f"in/{k}.csv", "\n".join(files[k]) + "\n")
    with tempfile.TemporaryDirectory() as folder:
        outer = os.path.join(folder, "all.zip")
        with zipfile.ZipFile(outer, "w") as z:
            z.writestr("inner.zip", inner.getvalue())
            for k in (2, 3, 4):
                z.writestr(f"{k}.csv", "\n".join(files[k]) + "\n")
        return X.nested_zip_csv(spark, outer).select(F.col("n_nationkey").cast("int"), "n_name", F.col("n_regionkey").cast("int"))


@query("select lower(r_name) as region, n_nationkey::varchar as code, n_name as name from nation join region on n_regionkey = r_regionkey")
def json_documents(spark, t):
    """SRC28."""
    p = scratch(spark, "documents")
    for r in t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey")).collect():
        put(spark, f"{p}/{r.r_name.lower()}/{r.n_nationkey}.json", f'{{"name":\n "{r.n_name}"}}'.encode())
    return X.json_documents(spark, p).select("region", "code", F.expr("variant_get(document, '$.name', 'string')").alias("name"))


@query("select case when event_id % 3 = 0 then 'test' else 'train' end as split, count(*) as n, count(*) filter (event_id % 3 = 2) as later from events group by 1")
def splits_from_names(spark, t):
    """SRC33, SET01."""
    p, shards = scratch(spark, "shards"), []
    for i, name in enumerate(("test-00000-of-00001", "train-00000-of-00002", "train-00001-of-00002")):
        part = t["events"].where(f"event_id % 3 = {i}").select("event_id", *([F.lit("x").alias("later")] if i == 2 else []))
        part.coalesce(1).write.parquet(f"{p}/{i}")
        shards.append(_renamed(spark, f"{p}/{i}", f"{name}.parquet"))
    return X.splits_from_names(spark, shards).groupBy("split").agg(F.count("*").alias("n"), F.count("later").alias("later"))


def _renamed(spark: SparkSession, folder: str, name: str) -> str:
    """The one file of a written folder, under another name."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = next(f.getPath() for f in fs.listStatus(path(folder)) if f.getPath().getName().startswith("part-"))
    fs.rename(part, path(f"{folder}/{name}"))
    return f"{folder}/{name}"


@query("select l_orderkey, l_linenumber, epoch_us(l_shipdate) - epoch_us(o_orderdate) as duration_us from lineitem join orders on l_orderkey = o_orderkey where l_orderkey < 100")
def trip_durations(spark, t):
    """SRC34, DAT03, PRJ10."""
    df = t["lineitem"].where("l_orderkey < 100").join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey"))
    return X.with_duration(df, "o_orderdate", "l_shipdate").select("l_orderkey", "l_linenumber", "duration_us")


@query("select sha256(string_agg(r_name, chr(10) order by r_regionkey)) as sha256, cast(sum(strlen(r_name)) + count(*) - 1 as bigint) as bytes from region")
def file_digest(spark, t):
    """BIN02."""
    names = [r.r_name for r in t["region"].orderBy("r_regionkey").collect()]
    return R.file_digests(spark, _put(spark, "\n".join(names))).select("sha256", "bytes")


@query("select p_partkey, case when p_partkey % 2 = 0 then p_name || '\ufffd' || p_size else p_name end as text from part")
def lossy_utf8(spark, t):
    """STR08."""
    raw = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.col("p_name").cast("binary"), F.unhex(F.lit("ff")), F.col("p_size").cast("string").cast("binary"))).otherwise(F.col("p_name").cast("binary"))
    return t["part"].select("p_partkey", S.lossy_text(raw).alias("text"))


@query(f"select column_name as name, 'list<struct<...>>' as kind from (describe lineitem) where {_LABEL} is not null")
def type_text(spark, t):
    """STR11: shapes of structs do not matter."""
    rows = [(f.name, S.type_text(f"list<struct<{f.name}: {Y.label(f.dataType)}, more: struct<a: list<int32>>>>")) for f in t["lineitem"].schema]
    return spark.createDataFrame(rows, "name string, kind string")


@query("select e.event_id, p.value as last_purchase, p.event_id as purchase from events e asof left join (select user_id, ts, max_by(value, event_id) as value, max(event_id) as event_id from events where event_type = 'purchase' group by user_id, ts) p on e.user_id = p.user_id and e.ts >= p.ts")
def asof_join(spark, t):
    """JON11: each event with its user's last purchase at or before it."""
    bought = t["events"].where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max_by("value", "event_id").alias("last_purchase"), F.max("event_id").alias("purchase"))
    return J.asof(t["events"], bought, ["user_id"], "ts", "ts", ["last_purchase", "purchase"]).select("event_id", "last_purchase", "purchase")


@query("""with i as (select o_orderkey as k, o_totalprice as lo, o_totalprice + (o_orderkey % 7) * (o_orderkey % 11) * 10 as hi from orders where o_orderkey % 5 = 0)
select p_partkey, k from part join i on p_retailprice * 100 >= lo and p_retailprice * 100 < hi""")
def interval_join(spark, t):
    """JON11: points in intervals of any length."""
    spans = t["orders"].where("o_orderkey % 5 = 0").selectExpr("o_orderkey as k", "o_totalprice as lo", "o_totalprice + (o_orderkey % 7) * (o_orderkey % 11) * 10 as hi")
    return J.in_intervals(t["part"].selectExpr("p_partkey", "p_retailprice * 100 as at"), spans, "at", "lo", "hi").select("p_partkey", "k")


@query("select min(n) as length_min, max(n) as length_max, round(avg(n), 6) as length_mean from (select count(*) as n from lineitem group by l_orderkey)")
def map_sizes(spark, t):
    """MAP01, by the profile."""
    lists = t["lineitem"].groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("l"))
    return P.profile(lists.select(F.map_from_arrays(F.sequence(F.lit(1), F.size("l")), "l").alias("m"))).select("length_min", "length_max", F.round("length_mean", 6).alias("length_mean"))


@query("select vec_id, 9 + 8 * len(embedding) as bytes from embeddings")
def line_wkb(spark, t):
    """GEO01, GEO02."""
    return t["embeddings"].select("vec_id", F.octet_length(S.line_wkb(F.col("embedding").cast("array<double>"))).cast("long").alias("bytes"))


@query("select count(*) as n, count(*) filter (o_orderkey % 10 = 0) as refused from orders")
def required_variant(spark, t):
    """JSN05, JSN07: a required VARIANT column holds JSON null but no SQL null."""
    df = t["orders"].select("o_orderkey", F.when(F.col("o_orderkey") % 10 != 0, F.parse_json(F.lit("null"))).alias("v"))
    n = V.required(df.withColumn("v", F.coalesce("v", F.parse_json(F.lit("1")))), ["v"]).count()
    bad = df.where("v is null").count()
    try:
        V.required(df, ["v"]).count()
        bad = 0
    except Exception as e:  # noqa: BLE001
        bad = bad if "required column v" in str(e) else -1
    return spark.createDataFrame([(n, bad)], "n long, refused long")


@query("select count(*) as rows, 0::bigint as faults from supplier")
def validated(spark, t):
    """VAL01, VAL02: rows and schema hash as expected, prefix and all."""
    d = H.Dataset(spark, "supplier", lambda: t["supplier"])
    n, h = d.frame().count(), d.schema_hash()
    faults = d.validate(n, h[:12]) + d.validate(n, h)
    wrong = d.validate(n + 1, "0", strict=False)
    return spark.createDataFrame([(n, len(faults) + (len(wrong) != 2))], "rows long, faults long")


def _put(spark: SparkSession, content: str, ending: str = ".txt") -> str:
    """A small text file in the shared folder."""
    return put(spark, scratch(spark, "text") + ending, content.encode(), forget=True)
