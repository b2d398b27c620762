"""The registered queries of the library's own operators over the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import functions as fn
from . import operators as op
from . import plans, sources, streaming
from .schemas import ACTIVITIES_RAW_KM, ACTIVITIES_RAW_MI, PAYLOAD, table_schema
from .storage import new_path

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# -- the driver's tables as the library's -----------------------------------------------------------------------


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: Event types stand for activity types.
_MAP = {"click": "Run", "view": "Ride", "purchase": "Swim"}


def activities(spark: SparkSession, d: str) -> DataFrame:
    """events as activities: kilometres from value, minutes from the payload."""
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("athlete_id"), F.col("event_id").alias("activity_id"), fn.activity_type(F.col("event_type"), same=_MAP).alias("type"), "ts", F.col("value").alias("km"), F.get_json_object("props", "$.k").try_cast("double").alias("minutes"))


ACT = "act as (select user_id as athlete_id, event_id as activity_id, case event_type when 'click' then 'Run' when 'view' then 'Ride' when 'purchase' then 'Swim' else 'Other' end as type, ts, value as km, try_cast(json_extract_string(props, '$.k') as double) as minutes from events)"


def performances(spark: SparkSession, d: str) -> DataFrame:
    """orders as performances."""
    o, c, n = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return j.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("athlete"), F.col("c_name").alias("name"), F.col("o_orderpriority").alias("discipline"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("day"), F.col("o_totalprice").alias("score"), F.col("n_name").alias("nat"))


PERF = "perf as (select o_orderkey as id, o_custkey as athlete, c_name as name, o_orderpriority as discipline, o_orderstatus as status, o_orderdate as day, o_totalprice as score, n_name as nat from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)"
_r = lambda c, n=4: F.round(c, n).alias(c)


# -- sources and sinks ---------------------------------------------------------------------------------------


def _csv(df: DataFrame, label: str, name: str) -> str:
    """Write ``df`` as CSV with a header under file names that end in ``name``; returns the folder."""
    folder = new_path(df.sparkSession, label)
    df.write.options(header=True, escape='"').csv(f"{folder}/{name}")
    return folder


def _named_csv(df, folder, name):
    """One CSV file ``folder/name.csv``."""
    spark, made = df.sparkSession, new_path(df.sparkSession, "csv")
    df.coalesce(1).write.option("header", True).csv(made)
    fs, where, path = sources.file_system(spark, f"{made}/part-*")
    fs.mkdirs(path(folder))
    fs.rename(fs.globStatus(where)[0].getPath(), path(f"{folder}/{name}.csv"))


@query("src1_read_table", "select c_custkey, c_name, c_acctbal, null::varchar as note from customer")
def _(s, d):
    folder = _csv(table(s, d, "customer").select("c_acctbal", F.concat("c_name", F.lit("\nsays \"hi\", twice")).alias("c_name"), "c_custkey"), "src1", "customers")
    out = sources.read_table(s, f"{folder}/customers/*.csv", table_schema("c_custkey bigint, c_name string, c_acctbal double, note string"))
    return out.withColumn("c_name", F.replace("c_name", F.lit("\nsays \"hi\", twice"), F.lit("")))


@query("src2_read_dir", "select n_nationkey, n_name from nation")
def _(s, d):
    folder = _csv(table(s, d, "nation").select("n_name", "n_regionkey", "n_nationkey"), "src2", "nations")
    return sources.read_dir(s, f"{folder}/nations", "*.csv", table_schema("n_nationkey int, n_name string"))


@query("src3_batch_number", "select event_id, event_type, (event_id % 3 + 1)::varchar as batch from events where event_id % 4 <> 3 union all select event_id, event_type, 'Unknown' from events where event_id % 4 = 3")
def _(s, d):
    folder, e = new_path(s, "src3"), table(s, d, "events").select("event_id", "event_type")
    for k in range(3):  # each with its columns in another order, one name without a number
        part = e.filter((F.col("event_id") % 3 == k) & (F.col("event_id") % 4 != 3))
        _named_csv(part if k else part.select("event_type", "event_id"), folder, f"batch_{k + 1}_meta")
    _named_csv(e.filter("event_id % 4 = 3"), folder, "late_meta")
    rows = sources.read_dir(s, folder, "*_meta.csv", table_schema("event_id bigint, event_type string"), "file")
    return sources.with_batch(rows, "file")


@query("src4_by_unit", "select event_id, value * 1.60934 as km from events where event_type = 'view' union all select event_id, value from events where event_type <> 'view'")
def _(s, d):
    e = table(s, d, "events")
    folder = _csv(e.filter("event_type = 'view'").select(F.col("value").alias("Distance (mi)"), F.col("event_id").alias("Activity ID")), "src4", "mi")
    e.filter("event_type != 'view'").select(F.col("event_id").alias("Activity ID"), F.col("value").alias("Distance (km)")).write.option("header", True).csv(f"{folder}/km")
    e.groupBy("event_type").count().write.option("header", True).csv(f"{folder}/other")
    mi, km, _ = sources.read_by_unit(s, f"{folder}/*", ACTIVITIES_RAW_MI, ACTIVITIES_RAW_KM)
    mi = mi.select(F.col("`Activity ID`").alias("event_id"), fn.mi_to_km(F.col("`Distance (mi)`")).alias("km"))
    return op.stack(mi, km.select(F.col("`Activity ID`").alias("event_id"), F.col("`Distance (km)`").alias("km")))


@query("qlt3_header_gate", "select r_regionkey, r_name from region")
def _(s, d):
    folder = _csv(table(s, d, "region").select("r_name", "r_regionkey"), "qlt3", "good")
    table(s, d, "nation").select("n_name").write.option("header", True).csv(f"{folder}/bad")
    return sources.accepted_files(s, f"{folder}/*", "*.csv", table_schema("r_regionkey int, r_name string"))[0]


@query("snk1_overwrite", "select c_custkey from customer where c_acctbal > 0")
def _(s, d):
    root = new_path(s, "snk1")
    sources.write_table(table(s, d, "customer").select("c_custkey", "c_acctbal"), root)
    sources.write_table(sources.load_table(s, root).filter("c_acctbal > 0"), root)
    return sources.load_table(s, root).select("c_custkey")


@query("snk2_append", "select c_custkey as id from customer union all select s_suppkey from supplier")
def _(s, d):
    root = new_path(s, "snk2")
    sources.write_table(table(s, d, "customer").select(F.col("c_custkey").cast("long").alias("id")), root)
    sources.append_table(table(s, d, "supplier").select(F.col("s_suppkey").cast("long").alias("id")), root)
    return sources.load_table(s, root)


@query("snk3_snapshot", "select 'kept' as state, count(*) as n from customer union all select 'now', (select count(*) from customer) + (select count(*) from supplier)")
def _(s, d):
    root = new_path(s, "snk3")
    sources.write_table(table(s, d, "customer").select(F.col("c_custkey").cast("long").alias("id")), root)
    kept = sources.snapshot(s, root)
    sources.append_table(table(s, d, "supplier").select(F.col("s_suppkey").cast("long").alias("id")), root)
    return sources.stack_counts({"kept": sources.load_table(s, root, kept), "now": sources.load_table(s, root)}).withColumnRenamed("name", "state")


@query("snk4_refresh", "select 'athletes' as name, count(*) as n from customer union all select 'results', count(*) from orders")
def _(s, d):
    root = new_path(s, "snk4")
    for _i in range(2):
        sources.publish({"athletes": table(s, d, "customer").select("c_custkey"), "results": table(s, d, "orders").select("o_orderkey")}, root)
    return sources.stack_counts({n: sources.load_table(s, f"{root}/{n}") for n in ("athletes", "results")})


@query("snk5_initial_load", "select 'athletes' as name, count(*) as n from customer union all select 'results', count(*) from orders")
def _(s, d):
    root = new_path(s, "snk5")
    sources.publish({"athletes": table(s, d, "customer").select("c_custkey"), "results": table(s, d, "orders").select("o_orderkey")}, root, "append")
    return sources.stack_counts({n: sources.load_table(s, f"{root}/{n}") for n in ("athletes", "results")})


@query("src5_payload", "select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k from events")
def _(s, d):
    good, _ = sources.parse_payload(table(s, d, "events"), "props", table_schema("k bigint"))
    return good.select("event_id", "payload.k")


@query("src5_payload_rejects", "select event_id from events where event_id % 7 = 0")
def _(s, d):
    e = table(s, d, "events").withColumn("props", F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("{"), "props")).otherwise(F.col("props")))
    return sources.parse_payload(e, "props", table_schema("k bigint"))[1].select("event_id")


_LI = sources.RowSpec({"href_text": 0}, row="nav", cell="li", header_rows=0)


@query("src6_result_rows", "with t as (select c_custkey, '<table><tr><th>h</th></tr><tr><td>1</td><td>' || c_name || '</td><td>x</td><td><b>' || c_mktsegment || '</b></td><td>y</td><td>' || c_nationkey || '</td></tr><tr><td>one</td></tr></table>' as html from customer) select c_custkey, 1 as row_no, regexp_extract(html, '<td>1</td><td>(.*?)</td>', 1) as mark, regexp_extract(html, '<b>(.*?)</b>', 1) as competitor, regexp_extract(html, '<td>y</td><td>(.*?)</td>', 1) as nat, regexp_extract(html, '<b>(.*?)</b>', 1) as location, 'y' as date, regexp_extract(html, '<td>y</td><td>(.*?)</td>', 1) as score from t")
def _(s, d):
    c = table(s, d, "customer")
    html = F.concat(F.lit("<table><tr><th>h</th></tr><tr><td>1</td><td>"), "c_name", F.lit("</td><td>x</td><td><b>"), "c_mktsegment", F.lit("</b></td><td>y</td><td>"), F.col("c_nationkey").cast("string"), F.lit("</td></tr><tr><td>one</td></tr></table>"))
    return sources.extract_rows(c.select("c_custkey", html.alias("html")), sources.TOPLIST)


@query("src6_page_items", r"with t as (select page_id, regexp_extract_all(nav, '(?is)<li\b[^>]*>(.*?)</li\s*>', 1) as c from (select page_id, unnest(regexp_extract_all(html, '(?is)<nav\b[^>]*>(.*?)</nav\s*>', 1)) as nav from pages)) select page_id, trim(regexp_replace(regexp_replace(c[1], '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) as first_item, trim(regexp_replace(regexp_replace(c[-1], '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) as last_item from t where len(c) > 1")
def _(s, d):
    items = sources.RowSpec({"first_item": 0, "last_item": -1}, row="nav", cell="li", header_rows=0)
    return sources.extract_rows(table(s, d, "pages").select("page_id", "html"), items).drop("row_no")


def _result_pages(s, d):
    c = table(s, d, "customer")
    cell = lambda x: F.concat(F.lit("<td>"), x, F.lit("</td>"))
    row = F.concat(F.lit("<tr>"), *[cell(x) for x in (F.col("c_custkey").cast("string"), F.col("c_name"), F.col("c_nationkey").cast("string"), F.col("c_mktsegment"), F.lit("12 Mar 1999"))], F.lit("</tr>"))
    return c.select("c_custkey", F.concat(F.lit("<tr><th>h</th></tr>"), row).alias("html"))


@query("src7_final_rows", "select c_custkey, 1 as row_no, c_custkey::varchar as place, c_nationkey::varchar as nat, c_mktsegment as competitor, '12 Mar 1999' as mark from customer")
def _(s, d):
    return sources.extract_rows(_result_pages(s, d), sources.FINAL)


@query("src8_ranking_rows", "select c_custkey, 1 as row_no, c_custkey::varchar as rank, c_name as athlete, c_nationkey::varchar as nat, c_mktsegment as score, '12 Mar 1999' as event_list from customer")
def _(s, d):
    return sources.extract_rows(_result_pages(s, d), sources.RANKING)


@query("src9_roster_rows", "select c_custkey, 1 as row_no, c_name as athlete, c_mktsegment as nat, '12 Mar 1999' as birthdate from customer")
def _(s, d):
    return sources.extract_rows(_result_pages(s, d), sources.ROSTER)


@query("src10_page_manifest", "select r_name, p as page, 'http://h/' || r_regionkey || '?page=' || p as url from region, range(1, 6) t(p)")
def _(s, d):
    r = table(s, d, "region").select("r_name", F.concat(F.lit("http://h/"), F.col("r_regionkey").cast("string"), F.lit("?page=1")).alias("base"))
    return sources.page_manifest(r, "base", 1, 5).select("r_name", F.col("page").cast("long"), "url")


@query("snk6_load_log", "select (select count(*) from customer) as athletes_count, (select count(*) from orders) as results_count, (select count(*) from events) as activities_count")
def _(s, d):
    return sources.log_load({"athletes": table(s, d, "customer"), "results": table(s, d, "orders"), "activities": table(s, d, "events")}).drop("timestamp")


# -- projections ------------------------------------------------------------------------------------------------


@query("prj5_to_number", "select event_id, coalesce(try_cast(replace(event_type, 'click', '12.5') as double), 0) as n from events")
def _(s, d):
    return table(s, d, "events").select("event_id", fn.to_number(F.replace("event_type", F.lit("click"), F.lit("12.5")), default=0.0).alias("n"))


@query("prj6_conform", "select event_id, value, '' as note, 0::bigint as extra, event_type from events")
def _(s, d):
    return op.conform(table(s, d, "events"), table_schema("event_id bigint, value double, note string, extra bigint, event_type string"))


@query("prj1_contract", "select event_id, 'km' as unit, value as distance from events")
def _(s, d):
    e = op.with_literals(table(s, d, "events"), unit="km").drop("props").withColumnsRenamed({"value": "distance"})
    return op.select_contract(e, table_schema("event_id bigint, unit string, distance double"))


@query("prj7_serial", "select c_custkey, row_number() over (order by c_name, c_custkey) + 100 as serial from customer")
def _(s, d):
    return op.with_serial(table(s, d, "customer").select("c_name", "c_custkey"), ["c_name", "c_custkey"], 100).select("c_custkey", "serial")


@query("prj8_chunks", "select ((rn - 1) // 60)::int as chunk, array_to_string(list(c_custkey order by c_custkey), ',') as ids from (select c_custkey, row_number() over (order by c_custkey) as rn from customer) group by 1")
def _(s, d):
    return op.chunk_ids(table(s, d, "customer"), "c_custkey").select("chunk", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query("prj9_explode_entries", "select conv_id, turn, role, text from conversations")
def _(s, d):
    row = F.struct(F.col("turn").alias("activity_id"), F.col("conv_id").alias("athlete_id"), F.col("role").alias("athlete_name"), F.col("text").alias("name"))
    c = table(s, d, "conversations").groupBy("conv_id").agg(F.collect_list(row).alias("activities"))
    entries = F.array(F.struct(F.struct("activities").alias("rowData")))
    # every other payload has its entries below appContext
    direct, below = F.struct(entries.alias("preFetchedEntries")), F.struct(F.struct(entries.alias("preFetchedEntries")).alias("appContext"))
    raw = c.select("conv_id", F.when(F.col("conv_id") % 2 == 0, F.to_json(direct)).otherwise(F.to_json(below)).alias("json"))
    out = plans.explode_entries(sources.parse_payload(raw, "json", PAYLOAD)[0], ["conv_id"])
    return out.select("conv_id", F.col("activity_id").cast("int").alias("turn"), F.col("athlete_name").alias("role"), F.col("activity_name").alias("text"))


@query("prj11_export_fill", "select c_custkey, coalesce(n, 0)::bigint as n, coalesce(first_status, 'NA') as first_status from customer left join (select o_custkey, count(*) as n, min(o_orderpriority) as first_status from orders where o_orderstatus = 'P' group by 1) on o_custkey = c_custkey")
def _(s, d):
    o = table(s, d, "orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderpriority").alias("first_status"))
    return op.export_fill(op.attach_results(table(s, d, "customer").select("c_custkey"), o, "c_custkey"), {"n": 0, "first_status": "NA"})


# -- filters -----------------------------------------------------------------------------------------------------


@query("flt1_min_score", "select o_orderkey from orders where o_totalprice >= 1100")
def _(s, d):
    return op.min_score(table(s, d, "orders"), "o_totalprice").select("o_orderkey")


@query("flt2_take_while", "select o_orderkey from (select *, min(o_totalprice) over (partition by o_orderpriority order by o_orderdate, o_orderkey rows unbounded preceding) as low from orders) where low >= 5000")
def _(s, d):
    return op.take_while_at_least(table(s, d, "orders"), "o_orderpriority", ["o_orderdate", "o_orderkey"], "o_totalprice", 5000).select("o_orderkey")


@query("flt3_keep_ids", "select event_id from events where user_id in (1, 5, 9)")
def _(s, d):
    return op.keep_ids(table(s, d, "events"), "user_id", [1, 5, 9]).select("event_id")


@query("flt4_in_weeks", "select event_id from events where ts >= timestamp '2024-01-08' and ts < timestamp '2024-01-22'")
def _(s, d):
    return op.in_weeks(table(s, d, "events"), "ts", "2024-01-08", 2).select("event_id")


@query("flt5_before", "select o_orderkey from orders where o_orderdate < timestamp '1998-08-01'")
def _(s, d):
    return op.before(table(s, d, "orders"), "o_orderdate", "1998-08-01").select("o_orderkey")


@query("flt6_outdoor", "select p_partkey from part where p_partkey % 3 <> 0")
def _(s, d):
    p = table(s, d, "part").withColumn("location", F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(" (I)"))).otherwise(F.when(F.col("p_partkey") % 2 == 0, F.col("p_name"))))
    return op.outdoor_only(p).select("p_partkey")


@query("flt7_in_event", "select distinct o_custkey from orders where o_orderpriority = '1-URGENT'")
def _(s, d):
    return op.in_event(op.events_per_athlete(table(s, d, "orders"), "o_custkey", "o_orderpriority"), "1-URGENT").select("o_custkey")


@query("flt8_require", "select event_id from events where try_cast(json_extract_string(props, '$.k') as bigint) > 50")
def _(s, d):
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return op.require(table(s, d, "events").withColumn("k", F.when(k > 50, k)), "k").select("event_id")


@query("flt9_where_state", "select c_custkey from customer where c_nationkey = 7")
def _(s, d):
    return op.where_state(table(s, d, "customer"), "c_nationkey", 7).select("c_custkey")


@query("flt10_find_by_name", "select c_custkey from customer where lower(trim(c_name)) = lower('customer#000000012')")
def _(s, d):
    return op.find_by_name(table(s, d, "customer"), "c_name", " CUSTOMER#000000012 ").select("c_custkey")


@query("flt11_search_names", "select p_name, p_partkey from part where contains(lower(p_name), 'a') order by p_name, p_partkey limit 10")
def _(s, d):
    return op.search_names(table(s, d, "part"), "p_name", "A", ties="p_partkey").select("p_name", "p_partkey")


@query("flt12_match_target", "select c_custkey from customer where c_custkey % 4 = 0")
def _(s, d):
    c = table(s, d, "customer").withColumn("target", F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit(" "), F.upper("c_name"))).otherwise(F.lit("other")))
    return op.match_target(c, "c_name", "target").select("c_custkey")


@query("flt13_unmatched", "select c_custkey from customer where c_custkey not in (select o_custkey from orders)")
def _(s, d):
    o = table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return op.unmatched(op.attach_results(table(s, d, "customer"), o, "c_custkey"), "n").select("c_custkey")


# -- joins -------------------------------------------------------------------------------------------------------


@query("jn1_attach_results", "select c_custkey, n from customer left join (select o_custkey, count(*) as n from orders group by 1) on o_custkey = c_custkey")
def _(s, d):
    o = table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return op.attach_results(table(s, d, "customer").select("c_custkey"), o, "c_custkey")


@query("jn2_entrants", f"with {PERF} select id, nat as nat_perf, c_nationkey::varchar as nat_roster from perf join customer on upper(name) = upper(c_name)")
def _(s, d):
    roster = table(s, d, "customer").select(F.lower("c_name").alias("entrant"), F.col("c_nationkey").cast("string").alias("nat"))
    return op.entrants(performances(s, d), roster, "name", "entrant").select("id", "nat_perf", "nat_roster")


@query("jn3_keep_pairs", "select event_id from events where (user_id, event_type) in (select (user_id, event_type) from events group by user_id, event_type having count(*) > 12)")
def _(s, d):
    e = table(s, d, "events")
    return op.keep_pairs(e, e.groupBy("user_id", "event_type").count().filter("count > 12"), ["user_id", "event_type"]).select("event_id")


@query("jn4_scoreboards", "select coalesce(a.event, b.event) as event, a.n as n_open, b.n as n_filled from (select o_orderpriority as event, count(*) as n from orders where o_orderstatus = 'O' and o_orderpriority < '4' group by 1) a full join (select o_orderpriority as event, count(*) as n from orders where o_orderstatus = 'F' and o_orderpriority > '2' group by 1) b on a.event = b.event")
def _(s, d):
    o = table(s, d, "orders").withColumnRenamed("o_orderpriority", "event")
    side = lambda status, cond, name: o.filter(f"o_orderstatus = '{status}' and {cond}").groupBy("event").agg(F.count(F.lit(1)).alias(name))
    return op.compare_scoreboards(side("O", "event < '4'", "n_open"), side("F", "event > '2'", "n_filled"))


@query("jn5_coordinates", "select c_custkey, n_name, n_regionkey from customer left join nation on n_nationkey = c_nationkey and n_regionkey < 3")
def _(s, d):
    coords = table(s, d, "nation").filter("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")
    return op.with_coordinates(table(s, d, "customer"), coords, "c_nationkey").select("c_custkey", "n_name", "n_regionkey")


@query("jn6_assign_ids", "select c_custkey, coalesce(id, 0)::bigint as assigned_id from customer left join (select 'CUSTOMER#' || lpad(o_custkey::varchar, 9, '0') as k, arg_max(o_orderkey, o_orderkey) as id from orders where o_orderstatus = 'P' group by 1) on upper(c_name) = k")
def _(s, d):
    m = table(s, d, "orders").filter("o_orderstatus = 'P'").select(F.concat(F.lit(" customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("c_name"), F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("seq"))
    return op.assign_ids(table(s, d, "customer"), m, "c_name", "id", "seq")[0].select("c_custkey", "assigned_id")


@query("jn7_first_match", "select o_orderkey, case when o_orderdate >= timestamp '2000-01-01' then 0 else v end as runs from orders left join (select c_custkey, c_nationkey as v from customer where c_acctbal > 0) on c_custkey = o_custkey")
def _(s, d):
    c = table(s, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("runs"), F.lit(1).alias("seq"))
    o = table(s, d, "orders").withColumn("fresh", F.col("o_orderdate") >= F.to_timestamp(F.lit("2000-01-01"))).withColumnRenamed("o_custkey", "k")
    return op.link_first_match(o, c, "k", "seq", ["runs"], "fresh", F.lit(True)).select("o_orderkey", "runs")


@query("jn8_semi", "select event_id from events where user_id in (select c_custkey from customer where c_acctbal > 0)")
def _(s, d):
    return op.semi(table(s, d, "events"), table(s, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("user_id")), ["user_id"]).select("event_id")


@query("jn9_unseen", "select event_id from events where event_id % 3 <> 0")
def _(s, d):
    e = table(s, d, "events")
    return op.unseen(e, e.filter("event_id % 3 = 0").select("event_id"), ["event_id"]).select("event_id")


@query("jn10_update_from", "select c_custkey, coalesce(t, c_acctbal) as c_acctbal from customer left join (select o_custkey, max(o_totalprice) as t from orders where o_orderstatus = 'P' group by 1) on o_custkey = c_custkey")
def _(s, d):
    new = table(s, d, "orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    return op.update_from(table(s, d, "customer").select("c_custkey", "c_acctbal"), new, "c_custkey", ["c_acctbal"])


@query("jn11_rank_lookup", "select o_orderkey, r as found_rank from orders left join (select o_orderkey as k, row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) as r from orders where o_orderstatus = 'F') on k = o_orderkey")
def _(s, d):
    o = table(s, d, "orders")
    ranked = op.with_rank(o.filter("o_orderstatus = 'F'"), ["o_orderpriority"], [F.desc("o_totalprice"), "o_orderkey"])
    return op.rank_lookup(o, ranked, ["o_orderkey"]).select("o_orderkey", F.col("found_rank").cast("long"))


# -- aggregations ------------------------------------------------------------------------------------------------


@query("agg1_totals_by_type", f"with {ACT} select athlete_id, type, round(coalesce(sum(km), 0), 4) as total_km, coalesce(sum(minutes), 0) as total_minutes from act group by 1, 2")
def _(s, d):
    return op.totals_by_type(activities(s, d)).withColumn("total_km", F.round("total_km", 4))


@query("agg2_pivot_types", f"with {ACT} select athlete_id, " + ", ".join(f"coalesce(sum(minutes) filter (type = '{t}'), 0) as \"{t}\"" for t in op.TYPES) + " from act group by 1")
def _(s, d):
    return op.pivot_types(activities(s, d), value="minutes")


_H = "round(coalesce(sum(minutes) filter (type = '{}'), 0) / 60{}, 4)"


@query("agg3_training_metrics", f"with {ACT} select athlete_id, round(coalesce(sum(km) filter (type = 'Run'), 0), 4) as total_run_km, round(coalesce(sum(km) filter (type = 'Run'), 0) / 4, 4) as avg_weekly_run_km, {_H.format('Run', '')} as total_run_hours, {_H.format('Run', ' / 4')} as avg_weekly_run_hours, {_H.format('Ride', '')} as total_ride_hours, {_H.format('Swim', '')} as total_swim_hours, {_H.format('Other', '')} as total_other_hours, round(coalesce(sum(minutes) filter (type = 'Run'), 0) / nullif(coalesce(sum(km) filter (type = 'Run'), 0), 0), 4) as avg_run_pace from act group by 1")
def _(s, d):
    return op.training_metrics(activities(s, d), 4, 4)


@query("agg4_results", f"with {PERF}, firsts as (select athlete, discipline, min(id) as f from perf group by 1, 2), marks as (select athlete, status, min(id) as f from perf group by 1, 2) select p.athlete, arg_min(nat, id) as nat, arg_min(status, id) as gender, any_value(m.l) as marks, any_value(x.l) as disciplines, count(*) as n_events from perf p join (select athlete, string_agg(discipline, '|' order by f) as l from firsts group by 1) x on x.athlete = p.athlete join (select athlete, string_agg(status, '|' order by f) as l from marks group by 1) m on m.athlete = p.athlete group by 1")
def _(s, d):
    return op.summarise_results(performances(s, d), "athlete", "nat", "status", "status", "discipline", "id")


@query("agg5_suspicious_pace", "select l_suppkey, l_returnflag, round(avg(l_quantity), 4) as avg_pace from lineitem group by 1, 2 having avg(l_quantity) >= 24 and avg(l_quantity) < 25")
def _(s, d):
    return op.suspicious_pace(table(s, d, "lineitem"), ["l_suppkey", "l_returnflag"], "l_quantity", 24, 25).withColumn("avg_pace", F.round("avg_pace", 4))


@query("agg6_keys_in_many", "select user_id, count(distinct event_type) as n from events group by 1 having count(distinct event_type) > 1")
def _(s, d):
    return op.keys_in_many(table(s, d, "events"), "user_id", "event_type")


_WEEKS = "w as (select l_suppkey as k, case when l_quantity > 10 then l_quantity else 0 end as km from lineitem)"
_CONS = "select k, count(*) filter (km > 0) * 100.0 / count(*) as consistency_pct, case when count(*) filter (km > 0) = 0 then 'Infinity'::double else stddev_samp(km) filter (km > 0) end as std_dev, case when count(*) filter (km > 0) = 0 then 0 else median(km) filter (km > 0) / avg(km) filter (km > 0) end as median_to_mean, case when count(*) filter (km > 0) = 0 then 0 else max(km) filter (km > 0) / median(km) filter (km > 0) end as max_to_median, count(*) - count(*) filter (km > 0) as no_data from w group by 1"


def _weeks(s, d):
    return table(s, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.when(F.col("l_quantity") > 10, F.col("l_quantity")).otherwise(0.0).alias("km"))


@query("agg7_consistency", f"with {_WEEKS}, c as ({_CONS}) select k, round(consistency_pct, 6) as consistency_pct, round(std_dev, 6) as std_dev, round(median_to_mean, 6) as median_to_mean, round(max_to_median, 6) as max_to_median, no_data from c")
def _(s, d):
    out = op.consistency(_weeks(s, d), "k", "km")
    return out.select("k", *[_r(c, 6) for c in ("consistency_pct", "std_dev", "median_to_mean", "max_to_median")], "no_data")


@query("agg8_value_counts", f"with {PERF} select nat, count(*) as n from perf group by 1")
def _(s, d):
    return op.value_counts(performances(s, d), "nat")


@query("agg9_multi_discipline", "select o_custkey, round(avg(o_totalprice), 4) as mean_score, round(sum(o_totalprice), 4) as sum_score, string_agg(distinct o_orderpriority, ',' order by o_orderpriority) as disciplines, count(*) as n from orders group by 1 having count(*) > 1")
def _(s, d):
    return op.multi_discipline(table(s, d, "orders"), "o_custkey", "o_orderpriority", "o_totalprice").select("o_custkey", _r("mean_score"), _r("sum_score"), F.array_join("disciplines", ",").alias("disciplines"), "n")


@query("agg10_best_discipline", "select o_custkey, arg_max(o_orderpriority, o_totalprice) as best_discipline, max(o_totalprice) as best_score from orders group by 1")
def _(s, d):
    return op.best_discipline(table(s, d, "orders"), "o_custkey", "o_orderpriority", "o_totalprice")


@query("agg11_events_per_athlete", "select o_custkey, string_agg(distinct o_orderpriority, ', ' order by o_orderpriority) as events from orders group by 1")
def _(s, d):
    return op.events_per_athlete(table(s, d, "orders"), "o_custkey", "o_orderpriority").withColumn("events", F.array_join("events", ", "))


@query("agg12_headline", "select count(*) as athletes, count(distinct c_nationkey) as countries from customer")
def _(s, d):
    return op.headline_counts(table(s, d, "customer"), "c_nationkey")


_RANKS = "r as (select *, row_number() over (partition by discipline order by day, id) as place, row_number() over (partition by discipline order by score desc, id) as rank from perf)"


@query("agg13_rank_error", f"with {PERF}, {_RANKS} select discipline, round(avg(pow(rank - place, 2)), 4) as mse, round(sqrt(avg(pow(rank - place, 2))), 4) as rmse, count(*) as n from r group by 1")
def _(s, d):
    p = op.with_rank(op.with_rank(performances(s, d), ["discipline"], ["day", "id"], "place"), ["discipline"], [F.desc("score"), "id"])
    return op.rank_error(p, ["discipline"], "rank", "place").select("discipline", _r("mse"), _r("rmse"), "n")


@query("agg14_activity_summary", f"with {ACT} select type, count(*) as n, round(sum(km), 4) as sum_km, sum(minutes) as sum_minutes from act where athlete_id = 5 group by 1")
def _(s, d):
    return op.activity_summary(activities(s, d).filter("athlete_id = 5"), "type", "km", "minutes").withColumn("sum_km", F.round("sum_km", 4))


@query("agg15_ingest_report", "select user_id, count(*) as new_rows from events where event_id % 3 <> 0 group by 1")
def _(s, d):
    e = table(s, d, "events")
    return op.ingest_report(op.unseen(e, e.filter("event_id % 3 = 0").select("event_id"), ["event_id"]), "user_id")


@query("agg16_by_location", "select n_regionkey, n_nationkey, count(*) as n, array_to_string(list(c_name order by c_name)[:1000], ',') as names from customer join nation on n_nationkey = c_nationkey group by 1, 2")
def _(s, d):
    c = op.with_coordinates(table(s, d, "customer").withColumnRenamed("c_nationkey", "n_nationkey"), table(s, d, "nation"), "n_nationkey")
    return op.athletes_by_location(c, "n_regionkey", "n_nationkey", "c_name").withColumn("names", F.array_join("names", ","))


@query("agg17_match_stats", "select count(*) as total, count(n) as with_id, count(*) - count(n) as without_id from customer left join (select distinct o_custkey as n from orders where o_custkey <> 0) on n = c_custkey")
def _(s, d):
    o = table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_custkey").alias("n")).distinct()
    return op.match_stats(op.attach_results(table(s, d, "customer"), o, "c_custkey"), "n")


@query("agg18_weekly_totals", f"with {ACT} select a.athlete_id, w::int as week, coalesce(round(sum(km), 4), 0) as sum_km, coalesce(sum(minutes), 0) as sum_minutes from (select distinct athlete_id from act) a cross join range(0, 6) t(w) left join act on act.athlete_id = a.athlete_id and datediff('day', date '2024-01-01', ts::date) // 7 = w group by 1, 2")
def _(s, d):
    return op.weekly_totals(activities(s, d), "athlete_id", "ts", ["km", "minutes"], "2024-01-01", 6).withColumn("sum_km", F.round("sum_km", 4))


# -- windows, orders, sets ----------------------------------------------------------------------------------------


@query("win1_latest_per", "select o_orderkey from (select *, row_number() over (partition by o_custkey, o_orderpriority order by o_orderdate desc, o_totalprice desc, o_orderkey) as r from orders) where r = 1")
def _(s, d):
    return op.latest_per(table(s, d, "orders"), ["o_custkey", "o_orderpriority"], "o_orderdate", [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_orderkey")


@query("win1_latest_struct", "select o_custkey, o_orderpriority, arg_max(o_orderkey, (o_orderdate, o_totalprice, o_orderkey)) as o_orderkey from orders group by 1, 2")
def _(s, d):
    return op.latest_struct(table(s, d, "orders"), ["o_custkey", "o_orderpriority"], F.struct("o_orderdate", "o_totalprice", "o_orderkey")).select("o_custkey", "o_orderpriority", "o_orderkey")


@query("win2_first_per", "select min(o_orderkey) as o_orderkey from orders group by o_custkey")
def _(s, d):
    return op.first_per(table(s, d, "orders"), ["o_custkey"], ["o_orderkey"]).select("o_orderkey")


@query("win3_earliest_batch", "select event_id from (select event_id, ts::date as b, min(ts::date) over (partition by user_id) as f from events) where b = f")
def _(s, d):
    return op.earliest_batch(table(s, d, "events").withColumn("batch", F.to_date("ts")), "user_id", "batch").select("event_id")


@query("win4_repeated", "select o_orderkey from orders where (o_custkey, o_orderpriority) in (select (o_custkey, o_orderpriority) from orders group by o_custkey, o_orderpriority having count(*) > 1)")
def _(s, d):
    return op.repeated(table(s, d, "orders"), ["o_custkey", "o_orderpriority"]).select("o_orderkey")


@query("win5_rank", "select o_orderkey, row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) as rank from orders")
def _(s, d):
    return op.with_rank(table(s, d, "orders"), ["o_orderpriority"], [F.desc("o_totalprice"), "o_orderkey"]).select("o_orderkey", F.col("rank").cast("long"))


@query("win6_dedupe_ids", "select event_id, event_type from events")
def _(s, d):
    e = table(s, d, "events").withColumn("pos", F.lit(0))
    return op.dedupe_ids(op.stack(e, e.withColumn("pos", F.lit(1)).withColumn("event_type", F.lit("again"))), "event_id", ["pos"]).select("event_id", "event_type")


@query("ord1_consistency_order", f"with {_WEEKS}, c as ({_CONS}) select k, row_number() over (order by consistency_pct desc, round(std_dev, 6) nulls last, no_data, k) as serial from c")
def _(s, d):
    stats = op.consistency(_weeks(s, d), "k", "km").withColumn("std_dev", F.round("std_dev", 6)).withColumn("down", -F.col("consistency_pct"))
    return op.with_serial(stats.withColumn("up", F.coalesce("std_dev", F.lit(float("inf")))), ["down", "up", "no_data", "k"]).select("k", "serial")


@query("ord2_order_like", "select o_orderkey, serial from orders join (select c_custkey, row_number() over (order by c_acctbal desc, c_custkey) as serial from customer) on c_custkey = o_custkey")
def _(s, d):
    c = op.with_serial(table(s, d, "customer").withColumn("down", -F.col("c_acctbal")), ["down", "c_custkey"]).withColumnRenamed("c_custkey", "o_custkey")
    return op.order_like(table(s, d, "orders"), c, "o_custkey", "o_orderkey").select("o_orderkey", "serial")


@query("ord5_top_n", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10")
def _(s, d):
    return op.top_n(table(s, d, "orders"), 10, F.desc("o_totalprice"), "o_orderkey").select("o_orderkey", "o_totalprice")


@query("ord6_latest_row", "select event_id, ts from events order by ts desc, event_id desc limit 1")
def _(s, d):
    return op.latest_row(table(s, d, "events").withColumn("at", F.struct("ts", "event_id")), "at").select("event_id", "ts")


@query("ord7_newest_first", "select event_id from events where user_id = 7")
def _(s, d):
    return op.newest_first(table(s, d, "events").filter("user_id = 7"), "ts").select("event_id")


@query("set1_stack", "select o_orderkey as id from orders union all select o_orderkey from orders where o_orderstatus = 'F'")
def _(s, d):
    o = table(s, d, "orders").withColumnRenamed("o_orderkey", "id")
    return op.stack(o, o.filter("o_orderstatus = 'F'")).select("id")


@query("set2_stack_missing", "select s_suppkey as id, s_acctbal as bal, null::varchar as seg from supplier union all select c_custkey, null, c_mktsegment from customer")
def _(s, d):
    a = table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("bal"))
    return op.stack(a, table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("seg")), allow_missing=True)


@query("set3_new_ids", "select distinct user_id from events except select s_suppkey from supplier")
def _(s, d):
    return op.new_ids(table(s, d, "events"), table(s, d, "supplier").select(F.col("s_suppkey").alias("user_id")), "user_id")


@query("set4_distinct", "select distinct user_id, event_type from events")
def _(s, d):
    return table(s, d, "events").select("user_id", "event_type").distinct()


# -- functions ---------------------------------------------------------------------------------------------------

_K = "try_cast(json_extract_string(props, '$.k') as bigint)"


def _k(s, d):
    return table(s, d, "events").withColumn("k", F.get_json_object("props", "$.k").try_cast("bigint"))


@query("fn1_duration", f"select event_id, case event_id % 4 when 0 then round(({_K} // 60) * 60 + {_K} % 60, 2) when 1 then round({_K} + 7 / 60.0, 2) when 2 then 0 else round({_K} / 60.0, 2) end as minutes from events")
def _(s, d):
    k = F.col("k")
    text = F.when(F.col("event_id") % 4 == 0, F.format_string("%dh %d m", F.floor(k / 60).cast("long"), k % 60)).when(F.col("event_id") % 4 == 1, F.format_string("%dm 7s", k)).when(F.col("event_id") % 4 == 2, F.format_string("%d bpm", k)).otherwise(F.format_string("%ds", k))
    return _k(s, d).select("event_id", fn.parse_duration_min(text).alias("minutes"))


@query("fn2_quantities", "select p_partkey, case p_partkey % 3 when 0 then p_size * 1.60934 when 1 then 1000 + p_size else 0 end as km, case p_partkey % 3 when 2 then p_size * 0.3048 else 0 end as metres from part")
def _(s, d):
    n = F.col("p_size").cast("string")
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat(n, F.lit(" mi"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("1,0"), F.lpad(n, 2, "0"), F.lit("km"))).otherwise(F.concat(n, F.lit(" ft")))
    return table(s, d, "part").select("p_partkey", fn.to_km(text).alias("km"), fn.to_metres(text).alias("metres"))


@query("fn4_first_number", f"select event_id, {_K}::double as n, round({_K} + 30 / 60.0, 2) as pace from events")
def _(s, d):
    return _k(s, d).select("event_id", fn.first_number(F.col("props")).alias("n"), fn.parse_pace(F.format_string("%d:30 /km", "k")).alias("pace"))


@query("fn6_html_to_text", "select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), ' +', ' ', 'g')) as text from pages")
def _(s, d):
    return table(s, d, "pages").select("page_id", fn.html_to_text(F.col("html")).alias("text"))


@query("fn7_repair_json", f"select event_id, {_K} as k from events")
def _(s, d):
    broken = F.concat(F.lit("{&quot;k&quot;:\n"), F.get_json_object("props", "$.k"), F.lit(",\t}"))
    return table(s, d, "events").select("event_id", F.get_json_object(fn.repair_json(broken), "$.k").cast("bigint").alias("k"))


@query("fn8_names", "select p_partkey, array_to_string(list_transform(string_split(lower(regexp_replace(trim(p_name), '\\s+', ' ', 'g')), ' '), lambda x: upper(x[1]) || x[2:]), ' ') as display, upper(regexp_replace(trim(p_name), '\\s+', ' ', 'g')) as key from part")
def _(s, d):
    name = F.concat(F.lit(" "), F.replace(F.upper("p_name"), F.lit(" "), F.lit("  ")))
    return table(s, d, "part").select("p_partkey", fn.display_name(name).alias("display"), fn.match_key(name).alias("key"))


@query("fn10_flip_name", "select c_custkey, upper(c_mktsegment || ' ' || c_name) as name from customer")
def _(s, d):
    return table(s, d, "customer").select("c_custkey", fn.flip_name(F.concat_ws(", ", "c_name", "c_mktsegment")).alias("name"))


@query("fn12_units", "select event_id, round(value * 1.60934, 6) as km, round(value / 1.60934, 6) as pace_km from events")
def _(s, d):
    return table(s, d, "events").select("event_id", F.round(fn.mi_to_km(F.col("value")), 6).alias("km"), F.round(fn.pace_mi_to_km(F.col("value")), 6).alias("pace_km"))


@query("fn13_pace", f"select event_id, round({_K} / nullif(value, 0), 6) as pace, ({_K} * 60)::bigint as seconds from events")
def _(s, d):
    return _k(s, d).select("event_id", F.round(fn.pace(F.col("k").cast("double"), F.col("value")), 6).alias("pace"), fn.seconds(F.col("k"), legacy=True).alias("seconds"))


@query("fn15_activity_type", f"with {ACT} select activity_id, type, round(minutes * 60 / 3600.0, 6) as hours from act")
def _(s, d):
    return activities(s, d).select("activity_id", "type", F.round(fn.hours(F.lit(None), F.col("minutes") * 60), 6).alias("hours"))


@query("fn17_times", "select event_id, ts, ts::date as day from events")
def _(s, d):
    e = table(s, d, "events")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return e.select("event_id", fn.parse_instant(iso).alias("ts"), fn.parse_day(F.date_format("ts", "d MMM yyyy")).alias("day"))


@query("fn19_decay", "select o_orderkey, datediff('day', o_orderdate::date, date '2024-08-01')::int as days, round(o_totalprice * exp(-0.001 * datediff('day', o_orderdate::date, date '2024-08-01')), 6) as weighted from orders")
def _(s, d):
    days = fn.days_since(F.to_date("o_orderdate"))
    return table(s, d, "orders").select("o_orderkey", days.alias("days"), F.round(fn.decayed(F.col("o_totalprice"), days), 6).alias("weighted"))


@query("fn21_key", "select o_orderkey, o_custkey || '_' || o_orderpriority || '_nan' as key from orders")
def _(s, d):
    return table(s, d, "orders").select("o_orderkey", fn.performance_key(F.col("o_custkey"), F.col("o_orderpriority"), F.lit(None)).alias("key"))


@query("fn22_human_date", "select event_id, case when event_id % 5 = 0 then '-' else strftime(ts, '%B %d, %Y at %I:%M %p') end as text from events")
def _(s, d):
    text = F.when(F.col("event_id") % 5 != 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return table(s, d, "events").select("event_id", fn.human_date(text).alias("text"))


@query("fn23_fixed", "select p_partkey, printf('%.1f', p_size::double) as one, format('{:,}', p_partkey) as thousands from part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", fn.fixed(F.col("p_size").cast("double"), 1).alias("one"), fn.fixed(F.col("p_partkey"), 0, thousands=True).alias("thousands"))


@query("fn24_zip_lists", "select p_partkey, 1 as i, p_brand as a, p_type as b from part")
def _(s, d):
    pairs = fn.zip_lists(F.concat_ws("|", "p_brand", "p_name"), F.col("p_type"))
    return table(s, d, "part").select("p_partkey", F.posexplode(pairs).alias("i", "p")).select("p_partkey", (F.col("i") + 1).alias("i"), "p.a", "p.b")


@query("fn25_not_blank", "select doc_id, coalesce(length(trim(text)) > 0, false) as has_text from documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", fn.not_blank(F.col("text")).alias("has_text"))


@query("fn26_json_rows", "select '{\"event_id\":\"' || event_id || '\",\"event_type\":\"' || event_type || '\"}' as json from events")
def _(s, d):
    return fn.to_json_rows(table(s, d, "events").select("event_id", "event_type", F.lit(float("nan")).alias("v")))


@query("fn27_weeks", "select event_id, 'interval-2024' || lpad(week(ts)::varchar, 2, '0') as label, ts::date as first_day, (event_id % 2 = 0) as empty from events")
def _(s, d):
    day = F.date_format("ts", "d MMM yyyy")
    text = F.concat(F.lit("Activities for "), day, F.lit(" - "), day, F.when(F.col("event_id") % 2 == 0, F.lit(" - No Data")).otherwise(F.lit("")))
    r = fn.week_range(text)
    return table(s, d, "events").select("event_id", fn.week_label(F.lit(2024), F.weekofyear("ts")).alias("label"), r["start"].alias("first_day"), r["empty"].alias("empty"))


@query("fn29_alnum", "select p_partkey, regexp_replace(p_type, '[^A-Za-z0-9]', '', 'g') as label from part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", fn.alnum(F.col("p_type")).alias("label"))


@query("fn30_rank_delta", f"with {PERF}, {_RANKS} select id, (rank - place)::double as delta, coalesce(case when status <> 'F' then rank - place end, 0)::double as zeroed from r")
def _(s, d):
    p = op.with_rank(op.with_rank(performances(s, d), ["discipline"], ["day", "id"], "place"), ["discipline"], [F.desc("score"), "id"])
    some = F.when(F.col("status") != "F", F.col("rank"))
    return p.select("id", fn.rank_delta(F.col("rank"), F.col("place")).alias("delta"), fn.rank_delta(some, F.col("place"), "zero").alias("zeroed"))


# -- quality -----------------------------------------------------------------------------------------------------


@query("qlt1_null_profile", "select 'n' as column_name, count(*) as n_null from customer where c_custkey not in (select o_custkey from orders) having count(*) > 0")
def _(s, d):
    o = table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return op.null_profile(op.attach_results(table(s, d, "customer"), o, "c_custkey"))


@query("qlt4_unmatched_report", "select user_id, count(*) as n from events where user_id not in (select s_suppkey from supplier) group by 1")
def _(s, d):
    return op.unmatched_report(table(s, d, "events"), table(s, d, "supplier").select(F.col("s_suppkey").alias("user_id")), "user_id")


# -- jobs --------------------------------------------------------------------------------------------------------


@query("job1_flatten_payloads", f"select user_id as athlete_id, event_id as activity_id, {_K}::double as distance_km, event_type as type from events")
def _(s, d):
    one = F.concat(F.lit('{"preFetchedEntries":[{"activity":{"id":'), F.col("event_id").cast("string"), F.lit(',"activityName":"<b>x</b>","startDate":"2024-01-05T10:00:00Z","elapsedTime":60,"type":"'), "event_type", F.lit('","athlete":{"athleteId":'), F.col("user_id").cast("string"), F.lit(',"athleteName":" ADA "},"stats":[{"key":"stat_one","value":"'), F.get_json_object("props", "$.k"), F.lit(' km"}]}}]}'))
    raw = table(s, d, "events").select(one.alias("JSON Data"), F.lit("Ada").alias("Name"))
    return plans.flatten_payloads(raw)[0].select("athlete_id", "activity_id", "distance_km", "type")


@query("job2_clean_activities", f"select event_id as \"Activity ID\", row_number() over (order by event_id) as \"Serial\", round({_K} + 30 / 60.0, 2) as \"Time (min)\", value as \"Distance (km)\" from events")
def _(s, d):
    raw = _k(s, d).select(F.col("user_id").alias("Athlete ID"), F.lit("ada  runner").alias("Athlete Name"), F.col("event_id").alias("Activity ID"), F.col("ts").alias("Start Date"), F.col("value").alias("Distance (km)"), F.format_string("%dm 30s", "k").alias("Time"))
    return plans.clean_activities(raw).select("Activity ID", "Serial", "Time (min)", "Distance (km)")


@query("job3_ingest", "select event_id from events where event_id % 2 = 1")
def _(s, d):
    e = table(s, d, "events")
    return plans.ingest_activities(op.stack(e, e), e.filter("event_id % 2 = 0"), "event_id").select("event_id")


@query("job4_training_metrics", f"with {ACT} select athlete_id, round(coalesce(sum(km) filter (type = 'Run'), 0), 4) as total_run_km from act where athlete_id in (1, 2, 3) group by 1")
def _(s, d):
    return op.training_metrics(op.keep_ids(activities(s, d), "athlete_id", [1, 2, 3]), 4, 4).select("athlete_id", "total_run_km")


@query("job5_update_metadata", f"with {ACT} select c_custkey as athlete_id, coalesce(m.km, c_acctbal) as total_run_km, 45 + case when m.athlete_id is null then 0 else 4 end as weeks from customer left join (select athlete_id, round(coalesce(sum(km) filter (type = 'Run'), 0), 2) as km from act where minutes > 95 group by 1) m on m.athlete_id = c_custkey")
def _(s, d):
    old = table(s, d, "customer").select(F.col("c_custkey").alias("athlete_id"), F.col("c_acctbal").alias("total_run_km"), F.lit(45).alias("weeks"))
    return plans.update_metadata(old, op.training_metrics(activities(s, d).filter("minutes > 95"), 49), 45, 49)


@query("job6_unify_units", f"select event_id, case when event_type = 'view' then value * 1.60934 else value end as km, ({_K} * 60) as seconds from events")
def _(s, d):
    e = _k(s, d).withColumn("Time", F.format_string("%dm 0s", "k"))
    mi = e.filter("event_type = 'view'").select("event_id", F.col("value").alias("Distance (mi)"), F.lit(None).cast("double").alias("Pace (min/mi)"), "Time")
    km = e.filter("event_type != 'view'").select("event_id", F.col("value").alias("Distance (km)"), F.lit(None).cast("double").alias("Pace (min/km)"), "Time")
    return plans.unify_units(mi, km).select("event_id", F.col("`Distance (km)`").alias("km"), F.col("`Activity Time (s)`").alias("seconds"))


@query("job7_build_metadata", f"with {ACT} select a.athlete_id as athlete, round(coalesce(sum(km) filter (type = 'Run'), 0), 4) as total_run_km, coalesce(any_value(n), 0)::bigint as n_events from act a left join (select o_custkey, count(*) as n from orders group by 1) on o_custkey = a.athlete_id where ts >= timestamp '2024-01-01' and ts < timestamp '2024-01-15' group by 1")
def _(s, d):
    a = activities(s, d).withColumnRenamed("athlete_id", "athlete")
    results = op.summarise_results(performances(s, d), "athlete", "nat", "status", "status", "discipline", "id")
    return plans.build_metadata(a, results, "2024-01-01", 2).select("athlete", F.round("total_run_km", 4).alias("total_run_km"), "n_events")


@query("job8_weekly_batches", "select event_id from (select event_id, (event_id % 4) as b, min(event_id % 4) over (partition by user_id) as f from events) where b = f")
def _(s, d):
    folder, e = new_path(s, "job8"), table(s, d, "events").select("event_id", F.col("user_id").alias("Name"), "value")
    for k in range(4):  # headers in two orders; batch 10 comes after batch 3
        part = e.filter(F.col("event_id") % 4 == k)
        _named_csv(part if k % 2 else part.select("value", "Name", "event_id"), folder, f"batch_{(1, 2, 3, 10)[k]}_meta")
    _named_csv(table(s, d, "nation").select("n_name"), folder, "batch_0_notes")
    rows, _ = plans.merge_weekly_batches(s, folder, table_schema("event_id bigint, Name bigint, value double"))
    return rows.select("event_id")


@query("job10_update_results", "select o_orderkey from orders where o_orderstatus = 'F' or o_totalprice >= 1100")
def _(s, d):
    o = table(s, d, "orders")
    return plans.update_results(o.filter("o_orderstatus = 'F'"), o, ["o_orderkey"], "o_totalprice", 1100).select("o_orderkey")


@query("job13_form_scores", f"with {PERF}, latest as (select athlete, discipline, arg_max(score, (day, score)) as score, max(day) as day from perf where day < timestamp '1999-06-01' and id % 7 <> 0 group by 1, 2) select l.athlete::varchar as athlete, l.discipline, round(score * exp(-0.001 * datediff('day', day::date, date '1999-06-01')), 4) as weighted_score, events from latest l join (select o_custkey, string_agg(distinct o_orderstatus, ',' order by o_orderstatus) as events from orders group by 1) on o_custkey = l.athlete")
def _(s, d):
    p = performances(s, d).withColumn("athlete", F.col("athlete").cast("string")).withColumn("location", F.when(F.col("id") % 7 == 0, F.lit("Hall (i)")).otherwise(F.col("nat")))
    roster = table(s, d, "orders").select(F.col("o_custkey").cast("string").alias("athlete"), F.col("o_orderstatus").alias("event"))
    return plans.form_scores(p, roster, "1999-06-01").select("athlete", "discipline", _r("weighted_score"), F.array_join("events", ",").alias("events"))


@query("job14_predictions", f"with {PERF}, f as (select discipline as event, athlete, min(place) as place from (select discipline, athlete, row_number() over (partition by discipline order by day, id) as place from perf) group by 1, 2), r as (select discipline as event, athlete, row_number() over (partition by discipline order by s desc, athlete) as rank from (select discipline, athlete, max(score) as s from perf group by 1, 2)) select 'best' as predictor, event, round(avg(pow(rank - place, 2)), 4) as mse, round(sqrt(avg(pow(rank - place, 2))), 4) as rmse, count(*) as n from f join r using (event, athlete) group by 2")
def _(s, d):
    p = performances(s, d).withColumnRenamed("discipline", "event")
    final = op.with_rank(p, ["event"], ["day", "id"], "place").groupBy("event", "athlete").agg(F.min("place").alias("place"))
    best = p.groupBy("event", "athlete").agg(F.max("score").alias("score")).withColumn("predictor", F.lit("best"))
    return plans.evaluate_predictions(final, best).select("predictor", "event", _r("mse"), _r("rmse"), "n")


@query("job15_multi_discipline", "select o_custkey, count(*) as n, arg_max(o_orderpriority, o_totalprice) as best_discipline from orders group by 1 having count(*) > 1")
def _(s, d):
    return plans.multi_discipline_report(table(s, d, "orders"), "o_custkey", "o_orderpriority", "o_totalprice").select("o_custkey", "n", "best_discipline")


@query("job16_country_report", "select n_name, count(*) as n, any_value(n_regionkey) as n_regionkey from customer join nation on n_nationkey = c_nationkey group by 1")
def _(s, d):
    n = table(s, d, "nation")
    return plans.country_report(table(s, d, "customer").join(n, F.col("c_nationkey") == n.n_nationkey), n.select("n_name", "n_regionkey"), "n_name")


@query("job9_consistency_ranking", f"with {_WEEKS}, c as ({_CONS}) select k, round(consistency_pct, 6) as consistency_pct, row_number() over (order by consistency_pct desc, std_dev nulls last, no_data, k) as serial from c")
def _(s, d):
    return plans.consistency_ranking(_weeks(s, d), "k", "km").select("k", _r("consistency_pct", 6), "serial")


@query("job11_link_results", "select o_orderkey, case when o_orderstatus = 'P' then 0 when c_custkey is null then -1 else v end as runs from orders left join (select c_custkey, c_nationkey as v from customer where c_acctbal > 0) on c_custkey = o_custkey")
def _(s, d):
    c = table(s, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("runs"), F.lit(1).alias("seq"))
    o = table(s, d, "orders").withColumnRenamed("o_custkey", "k")
    return plans.link_results_to_athletes(o, [c, c.withColumn("runs", F.lit(-5))], "k", "seq", ["runs"], "o_orderstatus", "P", {"runs": -1}).select("o_orderkey", "runs")


_IDS = "i as (select 'CUSTOMER#' || lpad(o_custkey::varchar, 9, '0') as k, max(o_orderkey) as id from orders where o_totalprice > 350000 group by 1)"


def _assigned(s, d):
    m = table(s, d, "orders").filter("o_totalprice > 350000").select(F.concat(F.lit(" customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("c_name"), F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("seq"))
    return plans.assign_athlete_ids(table(s, d, "customer"), m, "c_name", "id", "seq")


@query("job12_assign_athlete_ids", f"with {_IDS} select c_custkey, coalesce(id, 0)::bigint as assigned_id from customer left join i on upper(c_name) = k")
def _(s, d):
    return _assigned(s, d)[0].select("c_custkey", "assigned_id")


@query("job12_unmatched_names", f"with {_IDS} select upper(c_name) as match_key, count(*) as n from customer where upper(c_name) not in (select k from i) group by 1")
def _(s, d):
    return _assigned(s, d)[1]


@query("job12_match_statistics", f"with {_IDS} select count(*) as total, count(id) as with_id, count(*) - count(id) as without_id from customer left join i on upper(c_name) = k")
def _(s, d):
    return _assigned(s, d)[2]


def _home(s, d):
    c = table(s, d, "customer").select(F.col("c_name").alias("athlete"), F.col("c_nationkey").alias("nat"))
    coords = table(s, d, "nation").filter("n_regionkey < 3").select(F.col("n_nationkey").alias("nat"), F.col("n_regionkey").alias("lat"), F.col("n_name").alias("lng"))
    log = table(s, d, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.max("ts").alias("timestamp"), F.count(F.lit(1)).alias("activities_count"))
    return plans.serve_home(c, coords, log)


@query("job17_home_athletes", "select c_name as athlete, c_nationkey as nat, n_regionkey as lat, n_name as lng from customer left join nation on n_nationkey = c_nationkey and n_regionkey < 3")
def _(s, d):
    return _home(s, d)[0]


@query("job17_home_counts", "select count(*) as athletes, count(distinct c_nationkey) as countries from customer")
def _(s, d):
    return _home(s, d)[1]


@query("job17_home_log", "select strftime(max(ts), '%Y-%m-%d %H:%M:%S') || ' (GMT +8)' as last_updated, (select count(*) from events where ts::date = (select max(ts)::date from events)) as activities_count from events")
def _(s, d):
    return _home(s, d)[2].select("last_updated", "activities_count")


def _page(s, d):
    meta = op.summarise_results(performances(s, d), "name", "nat", "status", "status", "discipline", "id")
    acts = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_name").alias("name"), "o_orderkey", F.col("o_orderdate").alias("day"), (F.col("o_totalprice") / 1000).alias("km"))
    return plans.athlete_page(meta, acts, "name", " customer#000000010", "day")


@query("job18_athlete_profile", f"with {PERF}, mine as (select * from perf where lower(name) = 'customer#000000010'), m as (select status, row_number() over (order by min(id)) as r from mine group by 1), x as (select discipline, row_number() over (order by min(id)) as r from mine group by 1) select x.r::int as i, discipline, status as mark from x join m on x.r = m.r")
def _(s, d):
    return _page(s, d)[0].select(F.posexplode("event_times").alias("i", "e")).select((F.col("i") + 1).alias("i"), "e.discipline", "e.mark")


@query("job18_athlete_activities", "select o_orderkey, strftime(o_orderdate, '%B %d, %Y at %I:%M %p') as start_text, printf('%.2f', o_totalprice / 1000) as km_text from orders join customer on c_custkey = o_custkey where lower(c_name) = 'customer#000000010'")
def _(s, d):
    return _page(s, d)[1].select("o_orderkey", "start_text", "km_text")


@query("job18_serve_athlete", "select o_orderkey from orders join customer on c_custkey = o_custkey where lower(c_name) = 'customer#000000010'")
def _(s, d):
    o = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return plans.serve_athlete(o, "c_name", "Customer#000000010", "o_orderdate").select("o_orderkey")


@query("job19_recollection", "select ((rn - 1) // 20)::int as chunk, count(*) as n from (select row_number() over (order by c_custkey) as rn from customer where c_nationkey = 3) group by 1")
def _(s, d):
    return plans.recollection_plan(table(s, d, "customer"), "c_nationkey", 3, "c_custkey", 20).select("chunk", F.size("ids").cast("long").alias("n"))


@query("str2_weekly", "select user_id, (date '2024-01-01' + (datediff('day', date '2024-01-01', ts::date) // 7 * 7)::int)::timestamp as week_start, round(sum(value), 4) as total, count(*) as n from events group by 1, 2")
def _(s, d):
    root, state = new_path(s, "str2"), new_path(s, "str2-state")
    _in_triggers(s, d, "events", F.desc("ts")).writeStream.foreachBatch(streaming.add_weekly(root, "user_id", "ts", "value", "weeks")).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return streaming.weekly_totals(s, root, "user_id").withColumn("total", F.round("total", 4))


@query("str2_weekly_batch", "select user_id, (date '2024-01-01' + (datediff('day', date '2024-01-01', ts::date) // 7 * 7)::int)::timestamp as week_start, round(sum(value), 4) as total, count(*) as n from events group by 1, 2")
def _(s, d):
    return streaming.weekly(table(s, d, "events"), "user_id", "ts", "value").withColumn("total", F.round("total", 4))


@query("job14_unranked_finalists", "with o as (select o_orderpriority as event, o_custkey as athlete, min(o_orderkey) as place from orders group by 1, 2), r as (select event, athlete, row_number() over (partition by event order by s desc, athlete) as rank from (select o_orderpriority as event, o_custkey as athlete, max(o_totalprice) as s from orders where o_orderstatus = 'F' group by 1, 2)) select 'filled' as predictor, o.event, round(avg(case when rank is null then 0 else pow(rank - place, 2) end), 2) as mse, count(*) as n from o left join r on r.event = o.event and r.athlete = o.athlete group by 2")
def _(s, d):
    o = table(s, d, "orders").withColumnsRenamed({"o_orderpriority": "event", "o_custkey": "athlete"})
    final = o.groupBy("event", "athlete").agg(F.min("o_orderkey").alias("place"))
    ranked = o.filter("o_orderstatus = 'F'").groupBy("event", "athlete").agg(F.max("o_totalprice").alias("score")).withColumn("predictor", F.lit("filled"))
    return plans.evaluate_predictions(final, ranked, "zero").select("predictor", "event", _r("mse", 2), "n")


@query("job14_scoreboard", "with f as (select o_orderpriority as event, o_custkey as athlete, min(o_orderkey) as place from orders group by 1, 2), r as (select status, event, athlete, row_number() over (partition by status, event order by s desc, athlete) as rank from (select o_orderstatus as status, o_orderpriority as event, o_custkey as athlete, max(o_totalprice) as s from orders where o_orderstatus in ('O', 'F') group by 1, 2, 3)), e as (select status, event, sqrt(avg(pow(rank - place, 2))) as rmse from r join f using (event, athlete) group by 1, 2) select event, round(max(rmse) filter (status = 'O'), 2) as rmse_open, round(max(rmse) filter (status = 'F'), 2) as rmse_filled from e group by 1")
def _(s, d):
    o = table(s, d, "orders").select(F.col("o_orderpriority").alias("event"), F.col("o_custkey").alias("athlete"), "o_orderkey", "o_totalprice", F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "filled").alias("predictor"))
    final = o.groupBy("event", "athlete").agg(F.min("o_orderkey").alias("place"))
    scores = o.filter("predictor is not null").groupBy("predictor", "event", "athlete").agg(F.max("o_totalprice").alias("score"))
    board = plans.prediction_scoreboard(plans.evaluate_predictions(final, scores), "open", "filled")
    return board.select("event", _r("rmse_open", 2), _r("rmse_filled", 2))


def _in_triggers(s, d, name, order, n=4):
    """A table as a stream of ``n`` files in the given order, one per trigger."""
    files = new_path(s, name)
    table(s, d, name).repartitionByRange(n, order).write.parquet(files)
    return streaming.event_stream(s, files, s.read.parquet(files).schema, 1)


def _payloads(s, d):
    one = F.concat(F.lit('{"preFetchedEntries":[{"activity":{"id":'), F.col("event_id").cast("string"), F.lit(',"activityName":"x","startDate":"2024-01-05T10:00:00Z","elapsedTime":60,"type":"Run","athlete":{"athleteId":'), F.col("user_id").cast("string"), F.lit(',"athleteName":"'), F.col("user_id").cast("string"), F.lit('"},"stats":[{"key":"stat_one","value":"'), F.get_json_object("props", "$.k"), F.lit(' km"}]}}]}'))
    return table(s, d, "events").select("event_id", one.alias("JSON Data"), F.col("user_id").cast("string").alias("Name"))


@query("job20_weekly_pipeline", f"select user_id as athlete_id, round(sum({_K}), 2)::double as total_run_km, case when count(*) filter (event_type <> 'click') > 0 then 2 else 0 end + case when count(*) filter (event_type = 'click') > 0 then 1 else 0 end as weeks from events group by 1")
def _(s, d):
    raw = _payloads(s, d).join(table(s, d, "events").select("event_id", "event_type"), "event_id")
    store, meta = new_path(s, "job20-acts"), new_path(s, "job20-meta")
    plans.weekly_pipeline(s, raw.filter("event_type != 'click'").drop("event_id", "event_type"), store, meta, 3, 5)
    # all rows again: only those of the clicks are new, and in a third run none is
    for start in (5, 6):
        plans.weekly_pipeline(s, raw.drop("event_id", "event_type"), store, meta, start, start + 1)
    return sources.load_table(s, meta).select("athlete_id", "total_run_km", "weeks")


@query("str1_append_unseen", "select event_id, user_id from events")
def _(s, d):
    root, state = new_path(s, "str1"), new_path(s, "str1-state")
    stream = _in_triggers(s, d, "events", F.desc("ts"))  # the oldest come last
    for i in range(2):  # the second stream finds nothing new
        streaming.once_per_id(stream, "event_id").writeStream.foreachBatch(streaming.append_unseen(root, "event_id", stream=f"run{i}")).option("checkpointLocation", f"{state}{i}").trigger(availableNow=True).start().awaitTermination()
    return sources.load_table(s, root).select("event_id", "user_id")


@query("str3_refresh_metadata", f"with {ACT} select athlete_id, round(coalesce(sum(km) filter (type = 'Run'), 0), 2) as total_run_km from act group by 1")
def _(s, d):
    totals, meta, state, files = (new_path(s, f"str3-{x}") for x in ("sums", "meta", "state", "files"))
    activities(s, d).repartitionByRange(4, F.desc("ts")).write.parquet(files)
    stream = streaming.event_stream(s, files, s.read.parquet(files).schema, 1)
    stream.writeStream.foreachBatch(streaming.refresh_metadata(totals, meta, "athlete_id", 4, "acts")).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return streaming.metadata_rows(s, meta, "athlete_id").select("athlete_id", "total_run_km")


@query("ord3_by_score", "select o_orderkey, o_totalprice from orders")
def _(s, d):
    return op.by_score(table(s, d, "orders"), "o_totalprice", "o_orderkey").select("o_orderkey", "o_totalprice")


@query("ord4_by_name", "select o_orderkey, o_clerk_or_status from (select o_orderkey, o_orderstatus as o_clerk_or_status from orders)")
def _(s, d):
    return op.by_name(table(s, d, "orders"), "o_orderstatus", "o_orderpriority").select("o_orderkey", F.col("o_orderstatus").alias("o_clerk_or_status"))


@query("fn11_upper_name", "select c_custkey, upper(c_name) as name from customer")
def _(s, d):
    return table(s, d, "customer").select("c_custkey", fn.upper_name(F.lower("c_name")).alias("name"))


@query("fn30_mean_policy", f"with {PERF}, {_RANKS} select id, round(coalesce(case when status <> 'F' then rank - place end, avg(case when status <> 'F' then rank - place end) over (partition by athlete)), 4)::double as delta from r")
def _(s, d):
    p = op.with_rank(op.with_rank(performances(s, d), ["discipline"], ["day", "id"], "place"), ["discipline"], [F.desc("score"), "id"])
    some = F.when(F.col("status") != "F", F.col("rank"))
    return p.select("id", F.round(fn.rank_delta(some, F.col("place"), "mean", Window.partitionBy("athlete")), 4).alias("delta"))


@query("agg11_with_events", "select o_orderkey, events from orders join (select o_custkey as k, string_agg(distinct o_orderpriority, ', ' order by o_orderpriority) as events from orders group by 1) on k = o_custkey")
def _(s, d):
    return op.with_events(table(s, d, "orders"), "o_custkey", "o_orderpriority").select("o_orderkey", F.array_join("events", ", ").alias("events"))


@query("job9_weekly_order", f"with {_WEEKS}, c as ({_CONS}), r as (select k, row_number() over (order by consistency_pct desc, std_dev nulls last, no_data, k) as serial from c) select k, km, serial from w join r using (k)")
def _(s, d):
    ranking, rows = plans.consistency_report(_weeks(s, d), "k", "km", "km")
    return rows.select("k", "km", "serial")


@query("job13_form_table", f"with {PERF}, latest as (select athlete, discipline, arg_max(score, (day, score)) as score, max(day) as day from perf where day < timestamp '1999-06-01' group by 1, 2) select l.athlete::varchar as athlete, l.discipline, round(score * exp(-0.001 * datediff('day', day::date, date '1999-06-01')), 4) as weighted_score from latest l where athlete in (select o_custkey from orders)")
def _(s, d):
    p = performances(s, d).select(F.col("athlete").cast("string").alias("athlete"), "discipline", F.lit("x").alias("location"), "day", "score")
    roster = table(s, d, "orders").select(F.col("o_custkey").cast("string").alias("athlete"), F.col("o_orderstatus").alias("event"))
    urgent = F.col("discipline") == "1-URGENT"
    return plans.form_table([p.filter(urgent), p.filter(~urgent)], roster, "1999-06-01").select("athlete", "discipline", _r("weighted_score"))


@query("job14_two_predictors", "with f as (select o_orderpriority as event, o_custkey as athlete, min(o_orderkey) as place from orders group by 1, 2), s as (select event, athlete, row_number() over (partition by event order by s desc, athlete) as a, row_number() over (partition by event order by n desc, athlete) as b from (select o_orderpriority as event, o_custkey as athlete, max(o_totalprice) as s, count(*) as n from orders group by 1, 2)) select event, round(sqrt(avg(pow(a - place, 2))), 2) as rmse_price, round(sqrt(avg(pow(b - place, 2))), 2) as rmse_orders from s join f using (event, athlete) group by 1")
def _(s, d):
    o = table(s, d, "orders").select(F.col("o_orderpriority").alias("event"), F.col("o_custkey").alias("athlete"), "o_orderkey", "o_totalprice").groupBy("event", "athlete")
    made = o.agg(F.min("o_orderkey").alias("place"), F.max("o_totalprice").alias("price"), F.count(F.lit(1)).alias("orders"))
    board = plans.compare_predictors(made.select("event", "athlete", "place"), made.withColumn("score", F.col("price").cast("double")), made.withColumn("score", F.col("orders").cast("double")), ("price", "orders"))
    return board.select("event", _r("rmse_price", 2), _r("rmse_orders", 2))


@query("job15_combined", "select o_custkey, round(avg(o_totalprice), 2) as mean_score, count(*) as n, arg_max(o_orderpriority, (o_totalprice, o_orderpriority)) as best_discipline from orders group by 1 having count(*) > 1")
def _(s, d):
    o = table(s, d, "orders").select("o_custkey", "o_orderpriority", "o_totalprice")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    _, report = plans.combined_disciplines([o.filter(urgent), o.filter(~urgent)], "o_custkey", "o_orderpriority", "o_totalprice")
    return report.select("o_custkey", _r("mean_score", 2), "n", "best_discipline")


@query("job15_repeated_rows", "select o_orderkey from orders where o_custkey in (select o_custkey from orders group by 1 having count(*) > 1)")
def _(s, d):
    o = table(s, d, "orders")
    return plans.combined_disciplines([o], "o_custkey", "o_orderpriority", "o_totalprice")[0].select("o_orderkey")


@query("job16_country_map", "select n_regionkey, count(*) as n, array_to_string(list(c_name order by c_name)[:5], ',') as names from customer join nation on n_nationkey = c_nationkey group by 1")
def _(s, d):
    n = table(s, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey", F.lit(0).alias("lng"))
    _, places = plans.country_map(table(s, d, "customer"), n, "c_nationkey", "n_regionkey", "lng", "c_name", 5)
    return places.select("n_regionkey", "n", F.array_join("names", ",").alias("names"))


@query("agg16_first_names", "select n_regionkey, count(*) as n, array_to_string(list(c_name order by c_name)[:7], ',') as names from customer join nation on n_nationkey = c_nationkey group by 1")
def _(s, d):
    c = op.with_coordinates(table(s, d, "customer").withColumnRenamed("c_nationkey", "n_nationkey"), table(s, d, "nation"), "n_nationkey").withColumn("none", F.lit(None).cast("int"))
    return op.athletes_by_location(c, "n_regionkey", "none", "c_name", 7).select("n_regionkey", "n", F.array_join("names", ",").alias("names"))


@query("agg16_members", "select c_nationkey, c_name, row_number() over (partition by c_nationkey, c_mktsegment order by c_name) as place from customer")
def _(s, d):
    return op.location_members(table(s, d, "customer"), "c_nationkey", "c_mktsegment", "c_name").select("c_nationkey", "c_name", "place")


@query("agg7_long_groups", "select k, round(median_to_mean, 6) as median_to_mean, round(max_to_median, 6) as max_to_median from (select l_linestatus as k, median(l_extendedprice) / avg(l_extendedprice) as median_to_mean, max(l_extendedprice) / median(l_extendedprice) as max_to_median from lineitem where l_extendedprice > 0 group by 1)")
def _(s, d):
    out = op.consistency(table(s, d, "lineitem"), "l_linestatus", "l_extendedprice", longest=1000)
    return out.select(F.col("l_linestatus").alias("k"), _r("median_to_mean", 6), _r("max_to_median", 6))


@query("flt11_indexed", "select p_name, p_partkey from part where contains(lower(p_name), '001') order by p_name, p_partkey limit 10")
def _(s, d):
    root, part = new_path(s, "flt11"), table(s, d, "part")
    sources.add_names(part, root, "p_name", "p_partkey")
    return sources.search_indexed(part, root, "p_name", "p_partkey", "001").select("p_name", "p_partkey")


@query("jn9_indexed", "select event_id from events where event_type not in ('click', 'view')")
def _(s, d):
    root, e = new_path(s, "jn9"), table(s, d, "events")
    for kind in ("click", "view"):
        sources.append_table(e.filter(F.col("event_type") == kind), root)
    return sources.unseen_ids(e.select("event_id"), root, f"{root}-index", "event_id")


@query("job7_from_raw", f"with {ACT}, {PERF}, p as (select athlete, count(*) as n, count(distinct discipline) as k from perf group by 1) select 'Athlete ' || athlete_id as athlete, round(coalesce(sum(km) filter (type = 'Run'), 0), 4) as total_run_km, round(coalesce(sum(coalesce(minutes, 1)) filter (type = 'Run'), 0) / 60, 6) as total_run_hours, coalesce(any_value(n), 0)::bigint as n_events, coalesce(any_value(k), 0)::bigint as n_disciplines from act a left join p on p.athlete = a.athlete_id where ts >= timestamp '2024-01-01' and ts < timestamp '2024-01-15' group by athlete_id")
def _(s, d):
    name = lambda c: F.concat(F.lit(" ATHLETE   "), F.col(c).cast("string"))
    raw = activities(s, d).select(name("athlete_id").alias("Athlete Name"), F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")).alias("Start Date"), F.col("type").alias("Type"), F.col("km").alias("Distance (km)"), (F.col("minutes") * 60).alias("Activity Time (s)"), F.lit("60").alias("Elapsed Time"))
    perf = performances(s, d).select(name("athlete").alias("Competitor"), F.col("nat").alias("Nat"), F.lit("Male").alias("Gender"), F.col("score").cast("string").alias("Mark"), F.col("discipline").alias("Discipline"), "id")
    out, _ = plans.metadata_from_raw(raw, perf, "2024-01-01", 2, "id")
    kinds = F.when(F.col("disciplines") == "", 0).otherwise(F.size(F.split("disciplines", "[|]"))).cast("long")
    return out.select("athlete", F.round("total_run_km", 4).alias("total_run_km"), F.round("total_run_hours", 6).alias("total_run_hours"), "n_events", kinds.alias("n_disciplines"))


@query("agg16_location_counts", "select n_regionkey, n_nationkey, count(*) as n, min(c_name) as first_name, max(c_name) as last_name from customer join nation on n_nationkey = c_nationkey group by 1, 2")
def _(s, d):
    c = op.with_coordinates(table(s, d, "customer").withColumnRenamed("c_nationkey", "n_nationkey"), table(s, d, "nation"), "n_nationkey")
    return op.location_counts(c, "n_regionkey", "n_nationkey", "c_name")


def _dear(s, d):
    o = table(s, d, "orders").filter("o_totalprice > 300000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return op.attach_results(table(s, d, "customer"), o, "c_custkey")


@query("flt13_without_dear_orders", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 300000)")
def _(s, d):
    return op.unmatched(_dear(s, d), "n").select("c_custkey")


@query("qlt1_nulls_of_a_join", "select 'n' as column_name, count(*) as n_null from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 300000) having count(*) > 0")
def _(s, d):
    return op.null_profile(_dear(s, d))


@query("qlt6_nulls_replaced", "select 'n' as column_name, count(*) as n_replaced from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 300000) having count(*) > 0")
def _(s, d):
    return op.nulls_replaced(_dear(s, d), op.export_fill(_dear(s, d), {"n": 0}))


@query("job10_new_results", "select o_orderstatus, count(*) as n from orders where o_orderstatus <> 'F' and o_totalprice >= 1100 group by 1")
def _(s, d):
    root, o = new_path(s, "job10"), table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    sources.write_table(op.with_literals(o.filter("o_orderstatus = 'F'"), Date_Created="30 Oct 24"), root)
    return plans.update_results_table(s, root, op.stack(o, o), ["o_orderkey", "o_orderstatus"], "o_totalprice", 1100, "1 Nov 24", "o_orderstatus")[1]
