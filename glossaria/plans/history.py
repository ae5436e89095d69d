"""Queries over time and versions: as-of lookups, cascades, guards, caps, bursts, tombstones, and JSON properties."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import catalog as cat
from ..operators import joins, reports
from ..sources import locales as src
from ..streaming import state
from . import views as v
from .registry import query


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return v.read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("asof_latest", "select e.event_id, h.value as latest from events e asof left join (select user_id, ts, max(value) as value from events where event_type = 'purchase' group by all) h on e.user_id = h.user_id and e.ts >= h.ts where e.event_type = 'view'")
def asof_latest(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf)
    history = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("latest"))
    return joins.as_of(e.where("event_type = 'view'").select("event_id", "user_id", "ts"), history, "user_id", "ts", "ts", "latest").select("event_id", "latest")


@query("prev_version", "select o_orderkey, lead(o_totalprice) over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as previous from orders")
def prev_version(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return v.read(spark, sf, "orders").select("o_orderkey", F.lead("o_totalprice").over(w).alias("previous"))


@query("history_limit", "select o_custkey, o_orderkey, o_orderdate from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) <= 3")
def history_limit(spark: SparkSession, sf: str) -> DataFrame:
    return cat.top_n(v.read(spark, sf, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 3).select("o_custkey", "o_orderkey", "o_orderdate")


@query("date_window", "select o_orderkey from orders where o_orderdate >= (select max(o_orderdate) from orders) - interval 90 day")
def date_window(spark: SparkSession, sf: str) -> DataFrame:
    o = v.read(spark, sf, "orders")
    last = o.agg((F.max("o_orderdate") - F.expr("interval 90 days")).alias("since"))
    return o.join(F.broadcast(last), F.col("o_orderdate") >= F.col("since")).select("o_orderkey")


@query("recovery_cascade", """with k as (select cast(c_custkey as varchar) as key from customer),
a as (select cast(o_custkey as varchar) as key, max(o_orderpriority) as value from orders where o_orderstatus = 'F' group by 1), b as (select cast(o_custkey as varchar) as key, max(o_orderpriority) as value from orders where o_orderstatus = 'O' group by 1),
c as (select cast(c_custkey as varchar) as key, c_mktsegment as value from customer) select k.key, case when a.value is not null then 0 when b.value is not null then 1 else 2 end as phase, coalesce(a.value, b.value, c.value) as value
from k left join a using (key) left join b using (key) left join c using (key)""")
def recovery_cascade(spark: SparkSession, sf: str) -> DataFrame:
    o, c = v.read(spark, sf, "orders"), v.read(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_mktsegment").alias("value"))
    by = lambda s: o.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").cast("string").alias("key")).agg(F.max("o_orderpriority").alias("value"))
    return joins.cascade(c, [by("F"), by("O"), c])


@query("shrink_guard", """with m as (select max(o_orderdate) - interval 365 day as cut from orders), a as (select o_orderpriority as g, count(*) as old from orders, m where o_orderdate < cut group by 1), b as (select o_orderpriority as g, count(*) as new from orders, m where o_orderdate >= cut group by 1),
f as (select coalesce(a.g, b.g) as o_orderpriority, coalesce(old, 0) as old, coalesce(new, 0) as new from a full join b on a.g = b.g) select o_orderpriority, old, new, new - old as delta, case when old >= 120 then new >= floor(old * 0.9) else old - new <= 10 end as allowed from f""")
def shrink_guard(spark: SparkSession, sf: str) -> DataFrame:
    o = v.read(spark, sf, "orders")
    o = o.join(F.broadcast(o.agg((F.max("o_orderdate") - F.expr("interval 365 days")).alias("cut"))), how="cross")
    return reports.shrink(o.where("o_orderdate < cut"), o.where("o_orderdate >= cut"), "o_orderpriority")


@query("top_decreases", """with a as (select l_suppkey, count(*) filter (l_linenumber <= 3) as old, count(*) filter (l_linenumber > 3) as new from lineitem group by 1) select l_suppkey, new - old as delta from a order by delta, l_suppkey limit 12""")
def top_decreases(spark: SparkSession, sf: str) -> DataFrame:
    li = v.read(spark, sf, "lineitem")
    return reports.shrink(li.where("l_linenumber <= 3"), li.where("l_linenumber > 3"), "l_suppkey").orderBy("delta", "l_suppkey").limit(12).select("l_suppkey", "delta")


@query("argmax_root", "with c as (select l_suppkey, l_shipdate, l_returnflag, count(*) as n from lineitem group by all), n as (select l_suppkey, l_returnflag, count(*) as n from lineitem group by all) select l_suppkey, l_returnflag, n from n qualify row_number() over (partition by l_suppkey order by n desc, l_returnflag) = 1")
def argmax_root(spark: SparkSession, sf: str) -> DataFrame:
    return reports.largest(v.read(spark, sf, "lineitem"), "l_suppkey", "l_returnflag").select("l_suppkey", "l_returnflag", "n")


@query("min_rank_root", "select o_custkey, o_orderstatus from (select distinct o_custkey, o_orderstatus from orders) qualify row_number() over (partition by o_custkey order by case o_orderstatus when 'P' then 1 when 'O' then 2 when 'F' then 3 else 4 end, o_orderstatus) = 1")
def min_rank_root(spark: SparkSession, sf: str) -> DataFrame:
    return reports.preferred(v.read(spark, sf, "orders"), "o_custkey", "o_orderstatus", ["P", "O", "F"])


@query("line_range_merge", "select l_orderkey, l_returnflag, min(l_linenumber) as first_line, max(l_linenumber) as last_line, count(*) as n from lineitem group by all")
def line_range_merge(spark: SparkSession, sf: str) -> DataFrame:
    issues = v.read(spark, sf, "lineitem").withColumnRenamed("l_linenumber", "line")
    return reports.line_ranges(issues, ["l_orderkey", "l_returnflag"])


@query("fifo_cap", "select event_id, user_id from events order by event_id desc limit 1000")
def fifo_cap(spark: SparkSession, sf: str) -> DataFrame:
    return cat.fifo(v.read(spark, sf, "events"), 1000, "event_id").select("event_id", "user_id")


@query("latest_ref", "select event_type, arg_max(event_id, struct_pack(ts := ts, event_id := event_id)) as event_id, max(ts) as ts from events group by 1")
def latest_ref(spark: SparkSession, sf: str) -> DataFrame:
    e = v.read(spark, sf, "events")
    return e.groupBy("event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.max("ts").alias("ts"))


_SESSIONS = """s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts, event_id) as n from (select *, case when lag(ts) over (partition by user_id order by ts, event_id) > ts - interval 6 hour then 0 else 1 end as fresh from events))"""


@query("debounce_sessions", f"with {_SESSIONS} select user_id, cast(min(ts) as timestamp) as start, cast(max(ts) + interval 6 hour as timestamp) as \"end\", count(*) as n from s group by user_id, s.n")
def debounce_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return state.debounce(_events(spark, sf), "user_id", gap="6 hours").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("throttle", """with recursive e as (select distinct user_id, ts from events), f as (select user_id, min(ts) as ts from e group by 1
  union all select f.user_id, (select min(e.ts) from e where e.user_id = f.user_id and e.ts >= f.ts + interval 6 hour) as ts from f where exists (select 1 from e where e.user_id = f.user_id and e.ts >= f.ts + interval 6 hour))
select user_id, cast(ts as timestamp) as ts from f""")
def throttle(spark: SparkSession, sf: str) -> DataFrame:
    """Per user the events that come at least six hours after the last one let through."""
    return state.throttle(_events(spark, sf).select("user_id", "ts"), "user_id", seconds=6 * 3600).select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("tombstone_ttl", "with m as (select max(ts) as now from events), dead as (select user_id from events, m where event_type = 'error' and ts > now - interval 24 hour) select distinct user_id from events where user_id not in (select user_id from dead)")
def tombstone_ttl(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf)
    now = e.agg(F.max("ts")).first()[0]
    dead = state.purge(e.where("event_type = 'error'").select(F.col("user_id").alias("key"), F.col("ts").alias("deleted_at")), F.lit(now))
    keys = e.select(F.col("user_id").alias("key")).distinct()
    return state.alive(keys, dead, F.lit(now), "24 hours").withColumnRenamed("key", "user_id")


@query("dirty_gate", "select event_id from events where user_id not in (select user_id from events where event_type = 'error' and value > 40)")
def dirty_gate(spark: SparkSession, sf: str) -> DataFrame:
    e = v.read(spark, sf, "events")
    return state.not_dirty(e, e.where("event_type = 'error' and value > 40"), "user_id").select("event_id")


@query("index_current", "select event_id as ord, user_id from events qualify ts = max(ts) over (partition by user_id) and event_type <> 'error'")
def index_current(spark: SparkSession, sf: str) -> DataFrame:
    """Rows in force after a log of versions: each file's (user's) latest, deletions left out."""
    log = v.read(spark, sf, "events").select(F.col("user_id").alias("file"), F.col("ts").alias("version"), (F.col("event_type") == "error").alias("deleted"), F.col("event_id").alias("ord"))
    return state.current(log).select("ord", F.col("file").alias("user_id"))


@query("props_flatten", """with p as (select event_id, repeat('{"a' || event_id % 7 || '":', (event_id % 13)::int) || '{"t":"' || event_type || '","n":1,"p":' || props || ',"l":["x"],"o":{"u":"' || user_id || '"}}' || repeat('}', (event_id % 13)::int) as p from events)
select event_id, substr(fullkey, 3) as path, json_extract_string(value, '$') as value from p, json_tree(p) where type = 'VARCHAR' and not contains(fullkey, '[')""")
def props_flatten(spark: SparkSession, sf: str) -> DataFrame:
    """Properties nested up to fourteen levels, each event's to another depth."""
    deep = (F.col("event_id") % 13).cast("int")
    text = F.concat(
        F.repeat(F.concat(F.lit('{"a'), (F.col("event_id") % 7).cast("string"), F.lit('":')), deep), F.lit('{"t":"'), "event_type", F.lit('","n":1,"p":'), "props", F.lit(',"l":["x"],"o":{"u":"'), F.col("user_id").cast("string"), F.lit('"}}'), F.repeat(F.lit("}"), deep)
    )
    return src.flatten(v.read(spark, sf, "events").select("event_id", text.alias("props")), "props", ["event_id"])


@query("props_values", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def props_values(spark: SparkSession, sf: str) -> DataFrame:
    return v.read(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("json_delete_path", f"with {v.VALUES} select key, locale, value from vals where not starts_with(key, 'src1.')")
def json_delete_path(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.values(spark, sf)
    gone = rows.where(F.col("key").startswith("src1.")).select("key").distinct()
    return joins.without(rows, gone).select("key", "locale", "value")


@query("json_merge", "with a as (select distinct user_id as k, 'a' as x from events where event_type = 'view'), b as (select distinct user_id as k, 'b' as x from events where event_type = 'error') select coalesce(b.k, a.k) as k, coalesce(b.x, a.x) as x from a full join b on a.k = b.k")
def json_merge(spark: SparkSession, sf: str) -> DataFrame:
    e = v.read(spark, sf, "events")
    side = lambda t, x: e.where(F.col("event_type") == t).select(F.col("user_id").alias("key")).distinct().withColumns({"value": F.lit(x), "ord": F.lit(0)})
    return joins.merge(side("view", "a"), side("error", "b")).select(F.col("key").alias("k"), F.col("value").alias("x"))


@query("prefix_conflicts", f"with {v.VALUES}, k as (select distinct key from vals union select distinct split_part(key, '.', 1) || '.text' from vals where locale = 'fr') select key from k a where exists (select 1 from k b where starts_with(b.key, a.key || '.'))")
def prefix_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.values(spark, sf)
    short = rows.where("locale = 'fr'").select(F.concat(F.split_part("key", F.lit("."), F.lit(1)), F.lit(".text")).alias("key"))
    return joins.prefix_conflicts(rows.select("key").union(short).distinct())


@query("version_order", "select p_partkey, p_size % 5 as a, p_size % 3 as b from part where (p_size % 5) > 2 or ((p_size % 5) = 2 and (p_size % 3) >= 1)")
def version_order(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.text import version_parts

    rows = v.read(spark, sf, "part").select("p_partkey", (F.col("p_size") % 5).alias("a"), (F.col("p_size") % 3).alias("b"))
    return rows.where(version_parts(F.concat(F.lit("v"), F.col("a").cast("string"), F.lit("."), F.col("b").cast("string"))) >= F.array(F.lit(2), F.lit(1)))


@query("hunk_numbers", "select l_orderkey as file, l_linenumber as pos, cast(sum(case when l_returnflag = 'R' then 1 else 0 end) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice rows unbounded preceding) as bigint) as hunk from lineitem")
def hunk_numbers(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("file"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("pos"), F.when(F.col("l_returnflag") == "R", "@@").otherwise(" ").alias("line"))
    return joins.hunks(rows).select("file", F.col("pos.l_linenumber").alias("pos"), "hunk")


_RANGES = "r as (select distinct l_suppkey as file, l_partkey as start, l_partkey + cast(l_quantity as bigint) as stop from lineitem)"


@query("greedy_intervals", f"""with recursive {_RANGES}, f as (select file, start, min(stop) as stop from r group by all), n as (select f.file, f.start, f.stop, min(g.start) as next from f left join f g on g.file = f.file and g.start >= f.stop group by all),
c as (select n.* from n join (select file, min(start) as start from f group by file) m using (file, start) union all select n.* from c join n on n.file = c.file and n.start = c.next)
select file, start, stop as "end" from c""")
def greedy_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Non-overlapping intervals by file, taken greedily in order."""
    rows = v.read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("file"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("end"))
    return joins.greedy_intervals(rows.distinct())


@query("innermost_intervals", f"""with {_RANGES.replace('l_suppkey', 'l_orderkey')} select file, start, stop as "end" from r where not exists (select 1 from r o where o.file = r.file and (o.start <> r.start or o.stop <> r.stop) and o.start >= r.start and o.stop <= r.stop)""")
def innermost_intervals(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("end")).distinct()
    return joins.innermost(rows)
