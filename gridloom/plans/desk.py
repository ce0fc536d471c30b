"""Queries on reading, editing, permissions, history, imports and texts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numbers, text
from ..operators import editing, hierarchy, history, importer, reading, rollup, rules
from ..sources import crosstab
from ..streaming import edits as stream
from .tables import month, table

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


r2 = lambda c: numbers.rounded(F.col(c), 2).alias(c)


def _orders_by_nation(spark, d, *more):
    orders = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderstatus")
    return orders.join(table(spark, d, "customer", "c_custkey", "c_nationkey"), F.expr("o_custkey = c_custkey")).select("o_orderkey", "c_nationkey", "o_orderdate", "o_totalprice", "o_orderstatus")


_JOINED = "orders join customer on o_custkey = c_custkey"


@query(f"select 'u1' as user_id, cast(count(*) as bigint) as n, round(sum(o_totalprice)*100)/100 as total from {_JOINED} where c_nationkey in (1,3,5) union all select 'u2', cast(count(*) as bigint), round(sum(o_totalprice)*100)/100 from {_JOINED}")
def permission_filter(spark, d):
    rows = [("u1", "geo", k, k != 7, False) for k in (1, 3, 5, 7)]
    granted = spark.createDataFrame(rows, "user_id string, analytic_id string, record_id int, can_view boolean, can_edit boolean")
    cells = _orders_by_nation(spark, d)
    each = [reading.visible(cells, granted, {"c_nationkey": "geo"}, u).agg(F.lit(u).alias("user_id"), F.count("*").alias("n"), F.sum("o_totalprice").alias("total")) for u in ("u1", "u2")]
    return each[0].union(each[1]).select("user_id", "n", r2("total"))


@query("select n_nationkey, n_name from nation where n_nationkey not in (2, 4)")
def accessible_default(spark, d):
    rows = spark.createDataFrame([("u", 2, False), ("u", 3, True), ("v", 5, False), ("u", 4, False)], "user_id string, n_nationkey int, can_view boolean")
    return reading.accessible(table(spark, d, "nation"), rows, "n_nationkey", "u").select("n_nationkey", "n_name")


@query("select o_orderkey, o_totalprice from orders where o_orderkey in (select l_orderkey from lineitem where l_quantity >= 49)")
def partial_lookup(spark, d):
    keys = table(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return reading.lookup(table(spark, d, "orders", "o_orderkey", "o_totalprice"), keys, ["o_orderkey"])


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F')")
def leaf_members(spark, d):
    mine = table(spark, d, "customer").select(F.col("c_custkey").alias("record_id"), F.lit(None).cast("long").alias("parent_id"))
    kids = table(spark, d, "orders").where("o_orderstatus = 'F'").select((-F.col("o_orderkey") - 1).alias("record_id"), F.col("o_custkey").alias("parent_id"))
    return hierarchy.leaves(mine.union(kids)).where("record_id >= 0").select(F.col("record_id").alias("c_custkey"))


@query("select l_orderkey, l_linenumber from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderpriority like '1%')")
def orphan_members(spark, d):
    known = table(spark, d, "orders").where("o_orderpriority like '1%'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem", "l_orderkey", "l_linenumber").join(known, "l_orderkey", "left_anti")


_YEARS = list(range(1995, 2002))


@query(f"select c_nationkey, {', '.join(f'cast(sum(case when year(o_orderdate) = {y} then 1 end) as bigint) as y{y}' for y in _YEARS)}, cast(count(*) as double) as total from {_JOINED} where year(o_orderdate) in ({', '.join(map(str, _YEARS))}) group by 1")
def pivot_crosstab(spark, d):
    rows = _orders_by_nation(spark, d).where(F.year("o_orderdate").isin(_YEARS)).select("c_nationkey", F.concat(F.lit("y"), F.year("o_orderdate").cast("string")).alias("y"), F.lit(1).cast("long").alias("value"))
    wide = reading.crosstab(rows, "c_nationkey", "y", [f"y{y}" for y in _YEARS])
    return reading.with_total(wide, [f"y{y}" for y in _YEARS])


@query(f"select cast(c_nationkey as bigint) as label, round(sum(o_totalprice)*100)/100 as value from {_JOINED} where o_orderstatus = 'O' group by 1")
def query_group_sum(spark, d):
    rows = _orders_by_nation(spark, d).where("o_orderstatus = 'O'").select(F.col("c_nationkey").cast("long").alias("nation"), F.col("o_totalprice").cast("decimal(20,2)").cast("string").alias("value_str"))
    return reading.group_sum(rows, "nation")


@query(f"select cast(c_nationkey as bigint) as label, {', '.join(f'''round(sum(case when o_orderstatus = '{s}' then o_totalprice else 0 end)*100)/100 as {s}''' for s in 'FOP')} from {_JOINED} group by 1")
def chart_series(spark, d):
    rows = _orders_by_nation(spark, d).select(F.col("c_nationkey").cast("long").alias("nation"), "o_orderstatus", F.col("o_totalprice").alias("value"))
    return reading.series(rows, "nation", "o_orderstatus", list("FOP")).select("label", r2("F"), r2("O"), r2("P"))


@query("select s_nationkey, round(sum(s_acctbal)*100)/100 as value from supplier group by 1 having sum(s_acctbal) > 0")
def pie_rows(spark, d):
    return reading.pie(table(spark, d, "supplier").select("s_nationkey", F.col("s_acctbal").alias("value")), "s_nationkey").select("s_nationkey", r2("value"))


@query("""select cast(count(*) as bigint) as cells, cast(count(value) as bigint) as numbers, round(sum(value)*100)/100 as total, round(avg(value)*10000)/10000 as mean, min(value) as least, max(value) as greatest
  from (select case when event_type = 'error' then null else value end as value from events)""")
def selection_stats(spark, d):
    rows = table(spark, d, "events").select(F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("value").cast("string")).alias("value_str"))
    return reading.selection_stats(rows).select("cells", "numbers", r2("total"), numbers.rounded(F.col("mean"), 4).alias("mean"), "least", "greatest")


@query("select s_suppkey, cast(r_regionkey as bigint) as region from supplier, region")
def add_axis_broadcast(spark, d):
    leaves = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("record_id"))
    return editing.add_axis(table(spark, d, "supplier", "s_suppkey"), leaves, "region")


@query("""select l_partkey, value_str from (select *, row_number() over (partition by l_partkey order by z, length(value_str) desc, value_str, l_suppkey) as k from
  (select distinct l_partkey, l_suppkey, cast(cast(l_quantity as int) as varchar) as value_str, case when l_quantity = 0 then 1 else 0 end as z from lineitem)) where k = 1""")
def remove_axis_keep_longest(spark, d):
    cells = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", F.col("l_quantity").cast("int").cast("string").alias("value_str")).distinct()
    return editing.remove_axis(cells, ["l_partkey", "l_suppkey"], "l_suppkey")


@query("""with g as (select n_nationkey as n, q from nation, (values (1),(2),(3),(4)) t(q)), c as (select s_nationkey as n, 1 as q, round(sum(s_acctbal)*100)/100 as v, case when s_nationkey % 2 = 0 then 'manual' else 'formula' end as r from supplier group by 1)
  select g.n as nation, g.q as quarter, case when c.r = 'formula' then c.v else 42.0 end as value, coalesce(c.r, 'manual') as rule from g left join c on g.n = c.n and g.q = c.q""")
def fill_leaf_combos(spark, d):
    cells = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation"), F.lit(1).alias("quarter")).agg(numbers.rounded(F.sum("s_acctbal"), 2).alias("value"))
    cells = cells.withColumn("rule", F.when(F.col("nation") % 2 == 0, "manual").otherwise("formula"))
    members = {"nation": table(spark, d, "nation").select(F.col("n_nationkey").alias("record_id")), "quarter": spark.range(1, 5).select(F.col("id").cast("int").alias("record_id"))}
    return editing.fill(cells, members, F.lit(42.0), ["nation", "quarter"])


def _history(spark, d):
    e = table(spark, d, "events")
    before = F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select("event_id", "user_id", F.col("event_id").alias("seq"), F.col("ts").alias("created_at"), F.col("value").alias("new_value"), before.alias("old_value"))


@query("select event_id, user_id, value as new_value from events order by ts desc, event_id desc limit 50")
def history_topn(spark, d):
    return history.newest(_history(spark, d)).select("event_id", "user_id", "new_value")


@query("select user_id, arg_max(value, ts) as value from events group by 1")
def latest_value(spark, d):
    return history.latest(_history(spark, d), ["user_id"])


@query("""with h as (select user_id, event_id, lag(value) over (partition by user_id order by ts, event_id) as o from events)
  select user_id, (select o from h h2 where h2.user_id = h.user_id and h2.event_id = min(h.event_id)) as value_str from h where event_id >= 400 group by user_id""")
def undo_values(spark, d):
    back, _ = history.undone(_history(spark, d), 400, ["user_id"])
    return back.select("user_id", "value_str")


@query("""select p_partkey, case when k > 1 then p_name || ' #' || k else p_name end as name from (select p_partkey, p_name, row_number() over (partition by p_brand, lower(p_name) order by p_size, p_partkey) as k from part)""")
def dedup_sibling_names(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("record_id"), F.col("p_brand").alias("parent_id"), F.col("p_size").alias("sort_order"), F.col("p_name").alias("name"))
    return hierarchy.numbered_siblings(rows).select(F.col("record_id").alias("p_partkey"), "name")


@query("""select event_id, last_value(case when event_type = 'purchase' then value end ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding) as carried from events""")
def locf_header(spark, d):
    rows = table(spark, d, "events").withColumn("v", F.when(F.col("event_type") == "purchase", F.col("value"))).withColumn("at", F.struct("ts", "event_id"))
    return rows.select("event_id", reading.carried(rows, ["user_id"], "at", "v").alias("carried"))


@query("""select coalesce(c.c_custkey, n.k) as k, case when n.v is not null and (c.c_custkey is null or c.c_custkey % 3 <> 0) then n.v else c.c_acctbal end as value,
  case when n.v is not null and (c.c_custkey is null or c.c_custkey % 3 <> 0) then 'formula' when c.c_custkey % 3 = 0 then 'manual' else 'formula' end as rule
  from customer c full join (select o_custkey + 5 as k, cast(count(*) as double) as v from orders group by 1) n on c.c_custkey = n.k""")
def upsert_guarded(spark, d):
    cells = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("value"), F.when(F.col("c_custkey") % 3 == 0, "manual").otherwise("formula").alias("rule"))
    new = table(spark, d, "orders").groupBy((F.col("o_custkey") + 5).alias("k")).agg(F.count("*").cast("double").alias("value"))
    return editing.upsert(cells, new, ["k"])


@query("""select p_partkey, case when p_partkey % 10 = 0 then null else p_retailprice end as old_value, p_retailprice * (1 + case when p_partkey % 4 = 0 then 0.01 else 1e-9 end) as new_value from part
  where p_partkey % 10 = 0 or p_partkey % 4 = 0""")
def diff_changed_cells(spark, d):
    part = table(spark, d, "part")
    old = part.where("p_partkey % 10 <> 0").select("p_partkey", F.col("p_retailprice").alias("value"))
    new = part.select("p_partkey", (F.col("p_retailprice") * (1 + F.when(F.col("p_partkey") % 4 == 0, 0.01).otherwise(1e-9))).alias("value"))
    return editing.changed_cells(old, new, ["p_partkey"])


@query("""select o_orderstatus, cast(count(*) as bigint) as cells, cast(sum(case when abs(o_totalprice - s) / greatest(abs(s), 1e-9) <= 0.5 then 1 else 0 end) as bigint) as matched
  from orders join (select l_orderkey, round(sum(l_extendedprice)*100)/100 as s from lineitem group by 1) on l_orderkey = o_orderkey group by 1""")
def verify_tolerance(spark, d):
    ours = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("value"))
    theirs = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(numbers.rounded(F.sum("l_extendedprice"), 2).alias("value"))
    got = reading.compared(ours, theirs, ["o_orderkey"], 0.5).join(table(spark, d, "orders", "o_orderkey", "o_orderstatus"), "o_orderkey")
    return got.groupBy("o_orderstatus").agg(F.count("*").alias("cells"), F.count_if("ok").alias("matched"))


@query("""with p as (select n_regionkey as parent_id, s_suppkey % 3 as col, sum(cast(round(s_acctbal*100) as bigint)) as parts from supplier join nation on s_nationkey = n_nationkey group by 1, 2)
  select parent_id, cast(count(*) as bigint) as columns, cast(sum(case when col <> 1 then 1 else 0 end) as bigint) as matched, bool_and(col <> 1) as ok from p where parts <> 0 group by 1""")
def group_sum_verify(spark, d):
    leaf = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("record_id"), (F.col("s_suppkey") % 3).alias("col")).agg(F.sum(F.round(F.col("s_acctbal") * 100)).alias("value"))
    tree = table(spark, d, "nation").select(F.col("n_nationkey").alias("record_id"), F.col("n_regionkey").alias("parent_id"))
    own = leaf.join(tree, "record_id").groupBy(F.col("parent_id").alias("r"), "col").agg(F.sum("value").alias("s")).where("s <> 0")
    own = own.select((F.col("r") + 1000).alias("record_id"), "col", F.when(F.col("col") == 1, F.col("s") * 2).otherwise(F.col("s")).alias("value"))
    got = rollup.group_check(leaf.union(own), tree.withColumn("parent_id", F.col("parent_id") + 1000))
    return got.select((F.col("parent_id") - 1000).alias("parent_id"), "columns", "matched", "ok")


@query("""select r.k as range_id, sum(l_quantity) as total, cast(count(*) as bigint) as n from (select s_suppkey as k, s_suppkey * 7 as lo, s_suppkey * 7 + 2500 as hi from supplier) r join lineitem on l_orderkey between lo and hi group by 1""")
def range_sum(spark, d):
    ranges = table(spark, d, "supplier").select(F.col("s_suppkey").alias("range_id"), F.lit("s").alias("sheet_id"), (F.col("s_suppkey") * 7).alias("low"), (F.col("s_suppkey") * 7 + 2500).alias("high"))
    rows = table(spark, d, "lineitem").select(F.lit("s").alias("sheet_id"), F.col("l_orderkey").alias("row"), F.col("l_quantity").alias("value"))
    return reading.between_rows(ranges, rows)


@query("""select json_extract_string(props, '$.k') as formula, cast(count(*) as bigint) as n_cells, array_to_string(list_sort(list(distinct event_type)), ',') as types, cast(row_number() over (order by count(*) desc, json_extract_string(props, '$.k')) as int) as rank from events group by 1""")
def formula_groups(spark, d):
    cells = table(spark, d, "events").select(text.prop(F.col("props"), "$.k").alias("formula"), F.col("event_type").alias("types"))
    return rules.formula_groups(cells, ["types"]).withColumn("types", F.array_join("types", ","))


@query("select user_id, cast(date_trunc('week', ts) as date) as week, case when count(distinct event_type) = 1 then min(event_type) else '__per_cell__' end as formula from events group by 1, 2")
def formula_of_indicator(spark, d):
    rows = table(spark, d, "events").select("user_id", F.date_trunc("week", "ts").cast("date").alias("week"), F.col("event_type").alias("formula"))
    return rules.formula_of_indicator(rows, ["user_id", "week"])


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, '{\"k\":\"' || json_extract_string(props, '$.k') || '\",\"t\":\"' || event_type || '\"}' as props from events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", text.prop(F.col("props"), "$.k").cast("long").alias("k"), text.with_prop(F.col("props"), "t", F.col("event_type")).alias("props"))


@query("""select p_partkey, p_retailprice as a, case when p_partkey % 5 = 0 then null else p_retailprice end as b, cast(p_size as double) as c from part""")
def parse_numbers(spark, d):
    grouped = F.concat(F.lit(" "), F.floor("p_retailprice").cast("string"), F.lit(" ,"), F.substring(F.format_string("%.2f", F.col("p_retailprice")), -2, 2))
    odd = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.col("p_size").cast("string"), F.lit("d"))).otherwise(F.col("p_retailprice").cast("string"))
    return table(spark, d, "part").select("p_partkey", numbers.parsed_local(grouped).alias("a"), numbers.parsed(odd).alias("b"), numbers.parsed_lenient(F.concat(F.lit("~ "), F.col("p_size").cast("string"), F.lit(" pcs"))).alias("c"))


@query("select l_orderkey, l_linenumber, case when l_tax = 0 then '0' else rtrim(rtrim(printf('%.6f', l_tax * 10), '0'), '.') end as shown from lineitem")
def number_to_text(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", numbers.as_text(F.col("l_tax") * 10).alias("shown"))


@query("""select p_partkey, case when regexp_matches(p_name, '^c.*t$') then 'header' when contains(lower(p_name), 'small') or contains(lower(p_name), 'large') then 'group' when lower(trim(p_name)) like '%widget' then 'total' else 'indicator' end as action from part""")
def text_pattern_rules(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"))
    patterns = [("ends_with", ["WIDGET"], "total", 0.5), ("regex", ["^c.*t$"], "header", 0.9), ("contains_any", ["Small", "large"], "group", 0.7)]
    return importer.classified(rows, patterns).select("p_partkey", "action")


@query("select n_nationkey, case when n_nationkey % 2 = 0 then 'ru' else 'en' end as lang, case when n_nationkey % 2 = 0 then 'zhurnal_prodazh_' || n_nationkey else 'nation_' || n_nationkey end as code from nation")
def transliterated_codes(spark, d):
    name = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit(" Журнал продаж: "), F.col("n_nationkey").cast("string"))).otherwise(F.col("n_name"))
    return table(spark, d, "nation").select("n_nationkey", text.language(name).alias("lang"), text.transliterated(name).alias("code"))


@query("""select doc_id, case when len(regexp_extract_all(text, '[a-zA-Zа-яА-ЯёЁ]')) > 0 and len(regexp_extract_all(text, '[а-яА-ЯёЁ]')) / len(regexp_extract_all(text, '[a-zA-Zа-яА-ЯёЁ]')) >= 0.3 then 'ru' else 'en' end as lang from documents""")
def lang_detect(spark, d):
    return table(spark, d, "documents").select("doc_id", text.language(F.coalesce("text", F.lit(""))).alias("lang"))


@query("select n_nationkey, case when n_nationkey % 3 = 0 then 'Land ' || n_nationkey else n_name end as name from nation")
def name_translation_fallback(spark, d):
    nation = table(spark, d, "nation")
    words = nation.where("n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("entity_id"), F.lit("name").alias("field"), F.lit("de").alias("lang"), F.concat(F.lit("Land "), F.col("n_nationkey").cast("string")).alias("value"))
    return reading.translated(nation.select("n_nationkey", F.col("n_name").alias("name")), words, "n_nationkey", "de").select("n_nationkey", "name")


@query("select date_trunc('day', ts)::timestamp as start, event_type, cast(count(*) as bigint) as n, round(sum(value)*100)/100 as total from events group by 1, 2")
def edit_rate_window(spark, d):
    return stream.rates(table(spark, d, "events"), by=("event_type",)).select("start", "event_type", "n", r2("total"))


@query("select o_custkey, arg_max(o_totalprice, o_orderdate + to_microseconds(o_orderkey)) as value from orders group by 1")
def latest_edits(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", F.col("o_totalprice").alias("value"), (F.col("o_orderdate") + F.expr("make_dt_interval(0, 0, 0, o_orderkey / 1000000D)")).alias("ts"))
    return stream.latest(rows, ["o_custkey"]).select("o_custkey", "value")


@query("select cast(o_orderkey as bigint) as block_id, cast(l_linenumber as int) as col, l_quantity as value from lineitem join orders on l_orderkey = o_orderkey")
def pasted_cells(spark, d):
    items = table(spark, d, "lineitem")
    cells = items.select(F.col("l_orderkey").alias("block_id"), F.lit(0).alias("row"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("value"))
    blocks = crosstab.copied(cells.select("block_id", "row", F.col("n").alias("col"), "value"))
    places = cells.withColumn("col", F.row_number().over(Window.partitionBy("block_id").orderBy("n", "value")) - 1)
    return crosstab.pasted(blocks).join(places.select("block_id", "col", "n"), ["block_id", "col"]).select("block_id", F.col("n").alias("col"), "value")


@query("""with b as (select l_suppkey as sheet_id, l_orderkey * 10 + l_linenumber as pos, l_linenumber % 4 as indent from lineitem)
  select sheet_id, pos, case when indent > 0 then greatest(max(case when indent < 1 then pos end) over w, case when indent > 1 then max(case when indent = 1 then pos end) over w end, case when indent > 2 then max(case when indent = 2 then pos end) over w end) end as parent_pos
  from b window w as (partition by sheet_id order by pos rows between unbounded preceding and 1 preceding)""")
def indent_hierarchy(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("sheet_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), (F.col("l_linenumber") % 4).alias("indent"))
    return hierarchy.parents_by_indent(rows).select("sheet_id", "pos", "parent_pos")


@query("""select o_custkey as sheet_id, cast(count(*) as bigint) as columns, 'M' as level from (select distinct o_custkey, strftime(o_orderdate, '%Y-%m') as k from orders) group by 1""")
def header_periods(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.date_trunc("month", "o_orderdate").alias("m")).distinct()
    names = F.split(F.lit("январь февраль март апрель май июнь июль август сентябрь октябрь ноябрь декабрь"), " ")
    title = F.concat(F.initcap(F.get(names, F.month("m") - 1)), F.lit(" "), F.year("m").cast("string"))
    grid = o.select(F.col("o_custkey").alias("sheet_id"), F.lit(2).alias("row"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("m")).alias("col"), title.alias("value"))
    found = importer.period_columns(grid)
    counts = found.groupBy("sheet_id").agg(F.count_distinct("period_key").alias("columns"))
    return counts.join(importer.period_type(found), "sheet_id")


@query("""select k as total_col, kind from (values ('SUM', 'SUM'), ('AVERAGE', 'AVERAGE'), ('LAST', 'LAST'), ('RATIO', 'RATIO'), ('none', null)) t(k, kind)""")
def consolidation_formulas(spark, d):
    rows = [("SUM", "=B2+C2+D2"), ("AVERAGE", "=AVERAGE(B2:D2)"), ("LAST", "=$D2"), ("RATIO", "= E5/E2"), ("none", "=E5/D2")]
    df = spark.createDataFrame(rows, "total_col string, f string")
    return df.select("total_col", importer.consolidation_of(F.col("f"), F.lit("E")).alias("kind"))
