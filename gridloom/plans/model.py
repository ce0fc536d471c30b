"""Queries on models: structure, rights, rules, history, editing and whole operations, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import formula, numbers, periods, text
from ..operators import calc, editing, hierarchy, history, reading, rollup, rules, workflow
from ..session import materialized, shared_dir
from ..sources import crosstab, snapshot
from .tables import geography, month, sales_model, table

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


_GEO = """geo(node, parent, so, name) as (select 1, null, 0, 'World' union all select 10 + r_regionkey, 1, r_regionkey, r_name from region
    union all select 1000 + n_nationkey, 10 + n_regionkey, n_nationkey, n_name from nation)"""
_UP = f"{_GEO}, up(de, anc, depth) as (select node, node, 0 from geo union all select up.de, geo.parent, depth + 1 from up join geo on up.anc = geo.node where geo.parent is not null)"


@query("select s_suppkey, s_nationkey || '|' || s_suppkey as key, cast(s_nationkey as bigint) as first, s_acctbal as value from supplier")
def sheet_scan(spark, d):
    cells = table(spark, d, "supplier").select("s_suppkey", snapshot.packed(F.array(F.col("s_nationkey").cast("long"), "s_suppkey")).alias("key"), F.col("s_acctbal").alias("value"))
    return cells.select("s_suppkey", "key", snapshot.unpacked(F.col("key"))[0].alias("first"), "value")


@query("select s_suppkey, (case when n_regionkey = 0 then -1 else s_nationkey end) || '|' || (s_suppkey + 1) as key from supplier join nation on s_nationkey = n_nationkey")
def id_translation(spark, d):
    nation = table(spark, d, "nation").where("n_regionkey <> 0").select(F.concat(F.lit("n"), "n_nationkey").alias("uuid"), F.col("n_nationkey").cast("long").alias("record_id"))
    ids = nation.union(table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey"), F.col("s_suppkey") + 1))
    cells = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("n"), "s_nationkey", F.lit("|s"), "s_suppkey").alias("coord_key"))
    return snapshot.with_ids(cells, ids).select("s_suppkey", snapshot.packed(F.col("coord")).alias("key"))


@query("""select 'cells' as part, cast(2 * count(*) as bigint) as n from (select distinct date_trunc('month', o_orderdate), c_nationkey from orders join customer on o_custkey = c_custkey)
  union all select 'rules', 4 union all select 'axes', 3 union all select 'sheets', 1""")
def model_snapshot(spark, d):
    path = f"{shared_dir(spark).rstrip('/')}/snapshot-{spark.sparkContext.applicationId}-{id(d)}"
    snapshot.save(sales_model(spark, d), path)
    found = snapshot.load(spark, path)
    parts = [getattr(found, p).agg(F.lit(p).alias("part"), F.count("*").alias("n")) for p in ("cells", "rules", "axes", "sheets")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("""select cast(n_nationkey as bigint) as record_id, n_name as name, r_name as analytic, 'World' as model, coalesce(n_nationkey in (3, 5), false) as can_view, coalesce(n_nationkey = 5, false) as can_edit from nation join region on n_regionkey = r_regionkey""")
def members_with_rights(spark, d):
    records = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("record_id"), F.col("n_regionkey").alias("analytic_id"), F.col("n_name").alias("name"))
    analytics = table(spark, d, "region").select(F.col("r_regionkey").alias("analytic_id"), F.lit("m").alias("model_id"), F.col("r_name").alias("name"))
    models = spark.createDataFrame([("m", "World")], "model_id string, name string")
    rights = spark.createDataFrame([("u", 3, True, False), ("u", 5, True, True), ("v", 7, True, True)], "user_id string, record_id long, can_view boolean, can_edit boolean")
    return reading.members_with_rights(records, analytics, models, rights, "u")


@query("select s_suppkey from supplier where s_nationkey not in (2, 3)")
def rejected_edits(spark, d):
    rights = spark.createDataFrame([("u", "geo", k, True, k < 4) for k in (2, 3, 4, 5)], "user_id string, analytic_id string, record_id int, can_view boolean, can_edit boolean")
    edits = table(spark, d, "supplier", "s_suppkey", "s_nationkey")
    return reading.rejected(edits, rights, {"s_nationkey": "geo"}, "u", ["s_suppkey"]).select("s_suppkey")


@query("""select k as period_key from (select distinct unnest([strftime(o_orderdate, '%Y-%m'), strftime(o_orderdate, '%Y') || '-Y']) as k from orders) where k in ('1995-03', '1996-04', '1997-Y')""")
def visible_list(spark, d):
    keys = table(spark, d, "orders").select(F.explode(F.array(month("o_orderdate"), periods.key_at(F.col("o_orderdate"), "Y"))).alias("period_key")).distinct()
    listed = text.json_list(F.lit('["1995-03", "1996-04", "1997-Y"]'))
    return reading.shown_members(keys.withColumn("record_id", F.col("period_key")), "Q", listed).select("period_key")


@query("select o_custkey, cast(count(*) as bigint) as n from orders where o_orderstatus = 'F' group by 1")
def pinned_slice(spark, d):
    cube = table(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"))
    return reading.pinned(cube, "o_orderstatus", "F")


@query("select event_id, user_id, 'Customer ' || c_custkey as user_name from events left join (select c_custkey from customer where c_acctbal > 0) on user_id = c_custkey")
def history_users(spark, d):
    users = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"), F.concat(F.lit("Customer "), "c_custkey").alias("name"))
    return history.with_users(table(spark, d, "events", "event_id", "user_id"), users)


@query("""select l_orderkey, l_partkey, l_suppkey, coalesce(c.v, b.v) as value from (select distinct l_orderkey, l_partkey, l_suppkey from lineitem) a
  left join (select l_orderkey as o, l_partkey as p, l_suppkey as s, cast(max(l_quantity) as bigint) as v from lineitem where l_returnflag = 'R' group by 1, 2, 3) c on (o, p, s) = (l_orderkey, l_partkey, l_suppkey)
  left join (select l_orderkey as o2, l_partkey as p2, cast(-min(l_quantity) as bigint) as v from lineitem where l_linestatus = 'F' group by 1, 2) b on (o2, p2) = (l_orderkey, l_partkey) where coalesce(c.v, b.v) is not null""")
def longest_prefix(spark, d):
    items = table(spark, d, "lineitem")
    asked = items.select(F.array("l_orderkey", "l_partkey", "l_suppkey").alias("coord")).distinct()
    full = items.where("l_returnflag = 'R'").groupBy(F.array("l_orderkey", "l_partkey", "l_suppkey").alias("coord")).agg(F.max("l_quantity").cast("long").alias("value"))
    part = items.where("l_linestatus = 'F'").groupBy(F.array("l_orderkey", "l_partkey").alias("coord")).agg((-F.min("l_quantity")).cast("long").alias("value"))
    got = reading.longest_prefix(asked, full.union(part))
    return got.select(*[F.col("coord")[i].alias(c) for i, c in enumerate(("l_orderkey", "l_partkey", "l_suppkey"))], "value")


@query("""select s_suppkey, c_custkey, cast(case when s_nationkey = c_nationkey then 1000 + s_nationkey when a.n_regionkey = b.n_regionkey then 10 + a.n_regionkey else 1 end as bigint) as anc
  from supplier join customer on s_suppkey = c_custkey join nation a on a.n_nationkey = s_nationkey join nation b on b.n_nationkey = c_nationkey""")
def nearest_common(spark, d):
    tree = hierarchy.closure(geography(spark, d))
    both = table(spark, d, "supplier").join(table(spark, d, "customer"), F.expr("s_suppkey = c_custkey")).select("s_suppkey", "c_custkey", (F.col("s_nationkey") + 1000).cast("long").alias("a"), (F.col("c_nationkey") + 1000).cast("long").alias("b"))
    found = hierarchy.nearest_common(tree, both.select("a", "b").distinct())
    return both.join(found, ["a", "b"]).select("s_suppkey", "c_custkey", "anc")


@query("""select o_orderkey, o_totalprice as value, s as expected, round(abs(o_totalprice - s) / greatest(abs(s), 1e-9) * 1000000) / 1000000 as error
  from orders join (select l_orderkey, round(sum(l_extendedprice)*100)/100 as s from lineitem group by 1) on l_orderkey = o_orderkey where abs(o_totalprice - s) / greatest(abs(s), 1e-9) > 0.01
  order by abs(o_totalprice - s) / greatest(abs(s), 1e-9) desc, o_orderkey limit 30""")
def worst_mismatches(spark, d):
    ours = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("value"))
    theirs = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(numbers.rounded(F.sum("l_extendedprice"), 2).alias("value"))
    got = reading.mismatches(reading.compared(ours, theirs, ["o_orderkey"]))
    return got.select("o_orderkey", "value", "expected", numbers.rounded(F.col("error"), 6).alias("error"))


def _rules(spark, d):
    """A rule for each part, its brand being the indicator."""
    p = table(spark, d, "part")
    return p.select(F.concat(F.lit("p"), "p_partkey").alias("rule_id"), F.lit("s").alias("sheet_id"), F.col("p_brand").alias("indicator_id"), F.lit("scoped").alias("kind"), F.lit(None).cast("string").alias("scope"), F.col("p_size").alias("priority"), F.col("p_name").alias("formula"))


@query("select p_partkey, cast(row_number() over (partition by p_brand order by p_size desc, 'p' || p_partkey) as int) as place from part")
def rules_in_order(spark, d):
    return rules.in_order(_rules(spark, d)).select(F.substring("rule_id", 2, 20).cast("long").alias("p_partkey"), "place")


@query("select 'p' || p_partkey as rule_id, p_name as formula from part where p_brand <> (select min(p_brand) from part) union all select 'new', 'SUM([a], [b])'")
def rules_replaced(spark, d):
    old = _rules(spark, d)
    new = old.agg(F.min("indicator_id").alias("indicator_id")).select(F.lit("new").alias("rule_id"), F.lit("s").alias("sheet_id"), "indicator_id", F.lit("leaf").alias("kind"), F.lit(None).cast("string").alias("scope"), F.lit(0).alias("priority"), F.lit("SUM([a], [b])").alias("formula"))
    return rules.replaced(old, new).select("rule_id", "formula")


@query("""select 'p' || p_partkey as rule_id, p_size as priority from part union all select 'n' || b, greatest(20, coalesce(t, 0) + 10) from (select b, max(p_size) as t from (select distinct p_brand as b from part union all select 'none') left join part on p_brand = b group by 1)""")
def promoted_rules(spark, d):
    old = _rules(spark, d)
    brands = old.select("indicator_id").distinct().union(spark.createDataFrame([("none",)], "indicator_id string"))
    cells = brands.select(F.concat(F.lit("n"), "indicator_id").alias("rule_id"), F.lit("s").alias("sheet_id"), "indicator_id", F.lit(None).cast("string").alias("scope"), F.lit(20).alias("priority"), F.lit("1").alias("formula"))
    return rules.promoted(old, cells).select("rule_id", "priority")


@query("select o_orderkey, case when o_orderstatus = 'F' then null else 'f' end as formula, case when o_orderstatus = 'F' then 'formula' else 'cell' end as rule from orders")
def released_cells(spark, d):
    cells = table(spark, d, "orders").select("o_orderkey", F.lit("cell").alias("rule"), F.lit("f").alias("formula"))
    return rules.released(cells, table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey"), ["o_orderkey"])


@query("""with i as (select c_nationkey as sheet, c_mktsegment as name, c_custkey as ind, row_number() over (partition by c_nationkey, c_mktsegment order by c_custkey) as k from customer),
  has as (select * from i where k = 1 and name in ('BUILDING', 'MACHINERY')), src as (select lower(name) as n, arg_min(ind, lpad(cast(sheet as varchar), 3, '0') || '/' || lpad(cast(ind as varchar), 12, '0')) as f from has group by 1)
  select lpad(cast(i.sheet as varchar), 3, '0') as sheet_id, i.ind as indicator_id, 'f' || src.f as formula from i join src on lower(i.name) = src.n left join has on has.sheet = i.sheet and has.ind = i.ind where has.ind is null
  union all select lpad(cast(sheet as varchar), 3, '0'), ind, 'f' || ind from has""")
def spread_rules(spark, d):
    c = table(spark, d, "customer").select(F.lpad(F.col("c_nationkey").cast("string"), 3, "0").alias("sheet_id"), F.col("c_custkey").alias("indicator_id"), F.col("c_mktsegment").alias("name"))
    first = c.withColumn("k", F.row_number().over(Window.partitionBy("sheet_id", "name").orderBy("indicator_id"))).where("k = 1 and name in ('BUILDING', 'MACHINERY')")
    own = first.select(F.concat(F.lit("r"), "indicator_id").alias("rule_id"), "sheet_id", "indicator_id", F.lit("consolidation").alias("kind"), F.lit(None).cast("string").alias("scope"), F.lit(0).alias("priority"), F.concat(F.lit("f"), "indicator_id").alias("formula"))
    return rules.spread(own, c).select("sheet_id", "indicator_id", "formula")


@query("""with g as (select user_id, event_type, count(*) as n, array_to_string(list_sort(list(distinct cast(month(ts) as varchar))), ',') as m from events group by 1, 2),
  r as (select *, row_number() over (partition by user_id order by n desc, event_type) as k from g)
  select user_id as indicator_id, event_type as formula, case when k = 1 then 'leaf' else 'scoped' end as kind, cast(case when k = 1 then 0 else n end as bigint) as priority, case when k > 1 then m end as months from r""")
def derived_rules(spark, d):
    cells = table(spark, d, "events").select("user_id", F.col("event_type").alias("formula"), F.month("ts").alias("month"))
    return rules.derived_rules(cells, "user_id", ["month"]).select("indicator_id", "formula", "kind", "priority", F.col("scope")["month"].alias("months"))


@query("""with f as (select distinct year(o_orderdate)*10000 + quarter(o_orderdate)*100 + month(o_orderdate) as m, c_nationkey + 1000 as g from orders join customer on o_custkey = c_custkey),
  v as (select distinct per, geo from f join nation on g = n_nationkey + 1000, unnest([m, m // 100 * 100, m // 10000 * 10000]) p(per), unnest([g, 10 + n_regionkey, 1]) q(geo)),
  s as (select case when geo < 1000 or per % 100 = 0 then 1 else 0 end as inner_, i from v, (values (100), (101), (102), (103)) t(i))
  select cast(i as bigint) as indicator, case i when 102 then case inner_ when 1 then 'rule:r2' else 'rule:r1' end when 103 then case inner_ when 1 then 'rule:r4' else 'rule:r3' end else case inner_ when 1 then 'default-sum' else 'manual' end end as source, cast(count(*) as bigint) as n from s group by 1, 2""")
def displayed_formulas(spark, d):
    return rules.displayed(sales_model(spark, d)).groupBy(F.col("coord")[1].alias("indicator"), "source").agg(F.count("*").alias("n"))


@query("select distinct l_suppkey from lineitem where l_suppkey not in (select s_suppkey from supplier where s_acctbal > 0)")
def expected_but_missing(spark, d):
    return editing.expected_but_missing(table(spark, d, "lineitem"), table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey")), "l_suppkey")


@query("select c_custkey as k, c_acctbal as v from customer union all select k, v from (select o_custkey + 7 as k, 0.0::double as v from orders group by 1) where k not in (select c_custkey from customer)")
def inserted_missing(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    return editing.insert_missing(rows, table(spark, d, "orders").select((F.col("o_custkey") + 7).alias("k"), F.lit(0.0).alias("v")), ["k"])


@query("select cast(node as bigint) as record_id, name from (with recursive " + _GEO + " select * from geo) where node < 1000 or node >= 1010 union all select cast(1000 + n_nationkey as bigint), upper(n_name) from nation where n_nationkey < 10 union all select 5000, 'Elsewhere'")
def replaced_records(spark, d):
    old = geography(spark, d)
    new = old.where("record_id between 1000 and 1009").withColumn("name", F.upper("name")).union(old.limit(1).select(F.lit(5000).cast("long"), F.lit(1).cast("long"), F.lit(9), F.lit("Elsewhere"), F.lit("geo")))
    return editing.records_replaced(old, new).select("record_id", "name")


@query("select s_suppkey, '{\"s_suppkey\":' || s_suppkey || ',\"rule\":\"' || case when s_acctbal < 0 then 'formula' else 'manual' end || '\"}' as json from supplier")
def cells_json(spark, d):
    cells = table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_acctbal") < 0, "formula").otherwise("manual").alias("rule"), F.lit(None).cast("string").alias("formula"))
    return reading.as_json(cells, ["s_suppkey"])


@query("select r_name as sheet, case when r_regionkey = 1 then '{\"colCount\":2}' end as settings, n_nationkey as record_id, n_name as member from region join nation on n_regionkey = r_regionkey")
def sheet_bundle(spark, d):
    region = table(spark, d, "region")
    sheets, axes = region.select(F.col("r_regionkey").alias("sheet_id"), F.col("r_name").alias("name")), region.select(F.col("r_regionkey").alias("sheet_id"), F.lit(0).alias("axis_idx"), F.col("r_regionkey").alias("analytic_id"), F.lit(True).alias("is_main"))
    records = table(spark, d, "nation").select(F.col("n_regionkey").alias("analytic_id"), F.col("n_nationkey").alias("record_id"), F.lit(None).cast("int").alias("parent_id"), F.col("n_nationkey").alias("sort_order"), F.col("n_name").alias("name"))
    settings = spark.createDataFrame([(1, '{"colCount":2}')], "sheet_id int, json string")
    return reading.sheet_bundle(sheets, axes, records, settings).select("sheet", "settings", "record_id", "member")


@query("select r_name as name, (select string_agg(n_name, ',' order by n_nationkey) from nation where n_regionkey = r_regionkey) as sheets, coalesce((select string_agg(cast(s_suppkey as varchar), ',' order by s_suppkey) from supplier join nation on s_nationkey = n_nationkey where n_regionkey = r_regionkey and s_acctbal < 0), '') as analytics from region")
def model_tree(spark, d):
    models = table(spark, d, "region").select(F.col("r_regionkey").alias("model_id"), F.col("r_name").alias("name"))
    nation = table(spark, d, "nation")
    sheets = nation.select(F.col("n_regionkey").alias("model_id"), F.col("n_nationkey").alias("sort_order"), F.col("n_name").alias("name"))
    dims = table(spark, d, "supplier").where("s_acctbal < 0").join(nation, F.expr("s_nationkey = n_nationkey")).select(F.col("n_regionkey").alias("model_id"), F.col("s_suppkey").alias("sort_order"), F.col("s_suppkey").cast("string").alias("name"))
    return reading.model_tree(models, sheets, dims).select("name", F.array_join("sheets", ",").alias("sheets"), F.array_join("analytics", ",").alias("analytics"))


@query("select c_nationkey, cast(count(*) as bigint) as cells, cast(sum(case when c_acctbal < 0 then 1 else 0 end) as bigint) as formulas from customer group by 1")
def cell_counts(spark, d):
    return reading.counts(table(spark, d, "customer").withColumn("rule", F.when(F.col("c_acctbal") < 0, "formula").otherwise("manual")), ["c_nationkey"])


@query(f"""with recursive {_UP} select cast(anc as bigint) as geo, {', '.join(f'''cast(sum(case when q = '{q}' or q2 = '{q}' then n end) as bigint) as "{q}"''' for q in ('1995-Q1', '1995-Q2', '1995-Y', '1996-Y'))}
  from (select c_nationkey + 1000 as g, strftime(o_orderdate, '%Y') || '-Q' || quarter(o_orderdate) as q, strftime(o_orderdate, '%Y') || '-Y' as q2, count(*) as n from orders join customer on o_custkey = c_custkey group by 1, 2, 3) join up on g = de group by 1""")
def pivot_grid(spark, d):
    orders = table(spark, d, "orders").join(table(spark, d, "customer"), F.expr("o_custkey = c_custkey"))
    facts = orders.groupBy((F.col("c_nationkey") + 1000).cast("long").alias("geo"), periods.key_at(F.col("o_orderdate"), "Q").alias("q")).agg(F.count("*").alias("value"))
    keys = facts.select(F.col("q").alias("desc")).distinct()
    years = keys.select("desc", F.explode(F.array("desc", periods.parent_key(F.col("desc"), ("Q", "Y")))).alias("anc"))
    return reading.grid(facts, "geo", "q", hierarchy.closure(geography(spark, d)).select("desc", "anc"), years, ["1995-Q1", "1995-Q2", "1995-Y", "1996-Y"])


@query("select cast(1000 + n_nationkey as bigint) as geo, cast(count(s_suppkey) as bigint) as n from nation join supplier on s_nationkey = n_nationkey where n_regionkey = 2 group by 1")
def expanded_children(spark, d):
    cells = table(spark, d, "supplier").groupBy((F.col("s_nationkey") + 1000).cast("long").alias("geo")).agg(F.count("*").alias("n"))
    return reading.expanded(cells, geography(spark, d), "geo", 12)


@query("select user_id, event_id, case when event_type = 'click' then first_value(value) over (partition by user_id order by event_id) else value end as value from events")
def filled_range(spark, d):
    cells = table(spark, d, "events").select("user_id", "event_id", "value", F.when(F.col("event_type") == "click", "manual").otherwise("formula").alias("rule"))
    return editing.fill_range(cells, ["user_id"], "event_id").drop("rule")


@query("select l_orderkey, l_linenumber from lineitem where l_returnflag <> 'N' or l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'O')")
def deleted_range(spark, d):
    cells = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "N", "manual").otherwise("formula").alias("rule"))
    return editing.without_range(cells, table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey")), ["l_orderkey"]).drop("rule")


@query("select n_name, cast(row_number() over (order by case n_name when 'NATION_7' then 0 when 'NATION_3' then 1 else 2 end, n_nationkey) - 1 as int) as sort_order from nation")
def reordered_sheets(spark, d):
    return editing.reordered(table(spark, d, "nation").select("n_name", F.col("n_nationkey").alias("sort_order")), ["NATION_7", "NATION_3"], "n_name")


@query("""select r_regionkey as sheet_id, k as axis_idx, coalesce(case when r_regionkey = 2 then k = 3 when r_regionkey = 3 then k = 1 else k = 1 end, false) as is_main from region, (values (0), (1), (2), (3)) t(k)""")
def main_axes(spark, d):
    axes = table(spark, d, "region").select(F.col("r_regionkey").alias("sheet_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("axis_idx"))
    axes = axes.select("sheet_id", "axis_idx", F.concat(F.lit("a"), "axis_idx").alias("analytic_id"), (F.col("axis_idx") == 0).alias("is_period"), F.lit(False).alias("is_main"))
    return editing.with_default_main(editing.main_axis(axes, 2, "a3")).select("sheet_id", "axis_idx", "is_main")


@query("select 'customer' as part, cast(count(*) as bigint) as n from customer where c_nationkey <> 4 union all select 'supplier', cast(count(*) as bigint) from supplier where s_nationkey <> 4 union all select 'region', cast(count(*) as bigint) from region")
def model_deleted(spark, d):
    tables = {"customer": table(spark, d, "customer").withColumnRenamed("c_nationkey", "model_id"), "supplier": table(spark, d, "supplier").withColumnRenamed("s_nationkey", "model_id"), "region": table(spark, d, "region")}
    left = [t.agg(F.lit(k).alias("part"), F.count("*").alias("n")) for k, t in editing.without_model(tables, 4).items()]
    return left[0].union(left[1]).union(left[2])


@query("select o_orderkey, coalesce(o_orderstatus <> 'F' and l_returnflag = 'N', false) as editable from orders join (select l_orderkey, min(l_returnflag) as l_returnflag from lineitem group by 1) on l_orderkey = o_orderkey")
def editable_cells(spark, d):
    flags = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_returnflag").alias("f"))
    rows = table(spark, d, "orders", "o_orderkey", "o_orderstatus").join(flags, "o_orderkey")
    rule = F.when(F.col("f") == "N", F.lit(None).cast("string")).otherwise("formula")
    return rows.select("o_orderkey", reading.editable(F.col("o_orderstatus") == "F", rule, F.lit(True)).alias("editable"))


@query("""select 's' as sheet_id, n_name || ' | ' || r_name || ': ' || cast(v as varchar) as line from (select s_nationkey, cast(count(*) as bigint) as v from supplier group by 1) join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey order by 1, 2 limit 2000""")
def report_text(spark, d):
    counts = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("v")).join(table(spark, d, "nation"), F.expr("s_nationkey = n_nationkey"))
    cells = counts.select(F.lit("s").alias("sheet_id"), F.array((F.col("s_nationkey") + 1000).cast("long"), (F.col("n_regionkey") + 10).cast("long")).alias("coord"), F.col("v").cast("string").alias("value_str"))
    return reading.report_lines(cells, geography(spark, d))


@query(f"with recursive {_UP} select cast(node as bigint) as record_id, repeat('  ', d) || name as shown from geo join (select de, max(depth) as d from up group by 1) on de = node")
def dimension_export(spark, d):
    return crosstab.dimension(geography(spark, d)).select("record_id", "shown")


@query(f"""with recursive {_UP} select repeat('  ', d) || name as name, max(case when s = 'F' then n end) as "finished", max(case when s = 'O' then n end) as "open" from geo join (select de, max(depth) as d from up group by 1) on de = node
  left join (select c_nationkey + 1000 as g, o_orderstatus as s, cast(count(*) as varchar) as n from orders join customer on o_custkey = c_custkey group by 1, 2) on g = node group by node, 1""")
def sheet_crosstab(spark, d):
    orders = table(spark, d, "orders").join(table(spark, d, "customer"), F.expr("o_custkey = c_custkey"))
    cells = orders.groupBy((F.col("c_nationkey") + 1000).cast("long").alias("row_id"), F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).alias("col_id")).agg(F.count("*").cast("string").alias("value_str"))
    return crosstab.exported(cells.where("col_id is not null"), geography(spark, d), [(1, "finished"), (2, "open")])


@query("select cast(1000 + n_nationkey as bigint) as row_id, cast(k as bigint) as col_id, case k when 7 then cast(n_regionkey as varchar) else n_name end as value_str from nation, (values (7), (8)) t(k)")
def crosstab_import(spark, d):
    wide = table(spark, d, "nation").select(F.concat(F.lit("  "), F.lower("n_name")).alias("name"), F.col("n_regionkey").cast("string").alias("Region"), F.col("n_name").alias("Label"))
    return crosstab.imported(wide, geography(spark, d).where("record_id >= 1000"), {"Region": 7, "Label": 8})


@query("""with t as (select p_partkey, substr('A long worksheet name of part ' || p_name, 1, 31) as title from part), n as (select *, row_number() over (partition by lower(title) order by p_partkey) as k from t)
  select p_partkey as sheet_id, case when k = 1 then title else substr(title, 1, 31 - len('~' || k)) || '~' || k end as title from n""")
def sheet_titles(spark, d):
    return crosstab.titles(table(spark, d, "part").select(F.col("p_partkey").alias("sheet_id"), F.concat(F.lit("A long worksheet name of part "), "p_name").alias("name"))).select("sheet_id", "title")


@query("select o_custkey as block_id, string_agg(line, chr(10) order by y) as text from (select o_custkey, year(o_orderdate) as y, string_agg(cast(o_orderkey as varchar), chr(9) order by o_orderkey) as line from orders group by 1, 2) group by 1")
def copied_blocks(spark, d):
    cells = table(spark, d, "orders").select(F.col("o_custkey").alias("block_id"), F.year("o_orderdate").alias("row"), F.col("o_orderkey").alias("col"), F.col("o_orderkey").cast("double").alias("value"))
    return crosstab.copied(cells)


@query("""with k as (select distinct unnest([strftime(o_orderdate, '%Y-%m'), strftime(o_orderdate, '%Y') || '-Q' || quarter(o_orderdate), strftime(o_orderdate, '%Y') || '-H' || ((month(o_orderdate) + 5) // 6), strftime(o_orderdate, '%Y') || '-Y']) as k from orders),
  p as (select k, substr(k, 1, 4) as y, case when k like '%-Y' then 3 when k like '%-H%' then 2 when k like '%-Q%' then 1 else 0 end as r from k),
  m as (select *, case r when 3 then 1 when 2 then (cast(right(k, 1) as int) - 1) * 6 + 1 when 1 then (cast(right(k, 1) as int) - 1) * 3 + 1 else cast(right(k, 2) as int) end as m from p)
  select k as period_key, case r when 3 then y when 2 then right(k, 1) || case right(k, 1) when '1' then '-е полугодие ' else '-е полугодие ' end || y when 1 then right(k, 1) || '-й квартал ' || y
    else ['Январь','Февраль','Март','Апрель','Май','Июнь','Июль','Август','Сентябрь','Октябрь','Ноябрь','Декабрь'][m] || ' ' || y end as name, cast(row_number() over (order by y, m, r desc) as int) as place from m""")
def period_names(spark, d):
    keys = hierarchy.with_period_ancestors(table(spark, d, "orders").select(month("o_orderdate").alias("period_key")).distinct())
    key = F.col("period_key")
    return keys.select("period_key", periods.name(key).alias("name"), F.row_number().over(Window.orderBy(periods.sort_key(key))).alias("place"))


@query("select p_partkey, case when p_size <= 4 then '2003-Q' || p_size when p_size <= 12 then (2019 + p_size) || '-Y' else (2020 + p_size) || '-Y' end as period_key from part")
def header_counters(spark, d):
    size = F.col("p_size")
    title = F.when(size <= 4, F.concat(F.lit("q"), size)).when(size <= 12, F.concat(size, F.lit(" год"))).otherwise(F.concat(F.lit("Y"), size))
    return table(spark, d, "part").select("p_partkey", periods.from_counter(title, 2020, F.when(size <= 4, F.lit(2003))).alias("period_key"))


@query("select user_id, event_id, last_value(case when event_type = 'signup' then year(ts) end ignore nulls) over (partition by user_id order by event_id rows unbounded preceding) as year from events")
def inherited_years(spark, d):
    from ..operators import importer

    head = table(spark, d, "events").select(F.col("user_id").alias("sheet_id"), F.col("event_id").alias("col"), F.when(F.col("event_type") == "signup", F.concat(F.lit("FY "), F.year("ts").cast("string"))).otherwise("x").alias("value"))
    return importer.inherited_years(head).select(F.col("sheet_id").alias("user_id"), F.col("col").alias("event_id"), "year")


@query("select p_partkey, trim(regexp_replace(lower(replace(replace(p_name, ' ', '.,  '), 'l', 'L.')), '[., ]+', ' ', 'g')) as name, coalesce(case when p_size > 25 then cast(p_size as double) end, 0) as number, sha256(p_brand || chr(31) || p_type || chr(31)) as key, replace(replace(printf('%,.2f', p_retailprice), ',', chr(160)), '.', ',') as shown, cast(p_size as varchar) || ',00%' as percent from part")
def part_texts(spark, d):
    p = table(spark, d, "part")
    messy = F.replace(F.replace("p_name", F.lit(" "), F.lit(".,  ")), F.lit("l"), F.lit("L."))
    number = numbers.parsed_or_zero(F.when(F.col("p_size") > 25, F.col("p_size").cast("string")).otherwise("n/a"))
    return p.select("p_partkey", text.normalized(messy).alias("name"), number.alias("number"), text.cache_key(F.col("p_brand"), F.col("p_type"), F.lit(None)).alias("key"), text.shown(F.col("p_retailprice")).alias("shown"), text.shown(F.col("p_size") / 100, percent=True).alias("percent"))


@query("select p_partkey, 'a' || p_size || ',b' as one, '7,8' as two from part")
def scope_maps(spark, d):
    json = F.concat(F.lit('{"geo":"a'), F.col("p_size").cast("string"), F.lit(',b","per":"[\\"7\\",\\"8\\"]"}'))
    return table(spark, d, "part").select("p_partkey", text.scope_map(json).alias("m")).select("p_partkey", F.col("m")["geo"].alias("one"), F.col("m")["per"].alias("two"))


@query("select s_suppkey, case when s_acctbal < 0 then 5 * s_suppkey when s_nationkey > 12 then s_acctbal + 1 else 2 end as value from supplier")
def legacy_formulas(spark, d):
    f = formula.from_legacy("если [s_acctbal] < 0 то 5*[s_suppkey] иначе_если [s_nationkey] > 12 то [s_acctbal] + 1 иначе 2 конец_если")
    return table(spark, d, "supplier").select("s_suppkey", formula.over_columns(f).alias("value"))


@query(f"with recursive {_UP} select cast(de as bigint) as record_id from up where anc in (11, 13)")
def subtree_members(spark, d):
    return hierarchy.subtree(geography(spark, d), F.col("record_id").isin(11, 13)).select("record_id")


@query("select 'r' || n_regionkey as analytic_id, cast(min(n_nationkey) as bigint) as record_id from nation group by 1")
def first_leaves(spark, d):
    n = table(spark, d, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("analytic_id"), F.col("n_nationkey").cast("long").alias("record_id"), F.lit(None).cast("long").alias("parent_id"), F.col("n_nationkey").alias("sort_order"))
    return hierarchy.first_leaves(n)


@query("with k as (select distinct strftime(o_orderdate, '%Y-%m') as k from orders) select k as period_key, lag(k, 2) over (order by k) as back from k")
def shifted_periods(spark, d):
    keys = table(spark, d, "orders").select(month("o_orderdate").alias("record_id")).distinct()
    records = keys.select(F.lit("per").alias("analytic_id"), "record_id", F.lit(None).cast("string").alias("parent_id"), F.col("record_id").alias("sort_order"), F.col("record_id").alias("period_key"))
    chain = materialized(hierarchy.period_chains(records), "chain")
    return keys.join(hierarchy.shifted(chain, -2), "record_id", "left").select(F.col("record_id").alias("period_key"), F.col("to_id").alias("back"))


@query("select depth, parent, name, so from (select 0 as depth, null as parent, p_brand as name, cast(row_number() over (order by p_brand) - 1 as int) as so from (select distinct p_brand from part) union all select 1, p_brand, p_type, cast(row_number() over (partition by p_brand order by p_type) - 1 as int) from (select distinct p_brand, p_type from part))")
def branch_tree(spark, d):
    got = hierarchy.from_levels(table(spark, d, "part"), ["p_brand", "p_type"], "parts")
    up = got.select(F.col("record_id").alias("parent_id"), F.col("name").alias("parent"))
    return got.join(up, "parent_id", "left").select(F.when(F.col("parent_id").isNull(), 0).otherwise(1).alias("depth"), "parent", "name", F.col("sort_order").alias("so"))


def _entries(spark, d):
    return table(spark, d, "events").select("event_id", F.col("event_type").alias("sheet_id"), F.col("ts").alias("created_at"), F.col("event_id").alias("seq"))


@query("select event_id, event_type as sheet_id from (select *, row_number() over (partition by event_type order by ts desc, event_id desc) as k from events) where k <= 10")
def newest_of_each(spark, d):
    return history.newest_of_each(_entries(spark, d), "sheet_id", 10).select("event_id", "sheet_id")


@query("select event_id from events where event_type not in ('error', 'click')")
def cleared_history(spark, d):
    gone = spark.createDataFrame([("error",), ("click",)], "sheet_id string")
    return history.cleared(_entries(spark, d), gone).select("event_id")


@query("select o_orderkey, cast(row_number() over (order by o_orderdate, o_orderkey) + 99 as bigint) as seq from orders")
def numbered_entries(spark, d):
    return history.numbered(table(spark, d, "orders", "o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], "seq", 100).select("o_orderkey", F.col("seq").cast("long").alias("seq"))


_F = "with f as (select year(o_orderdate)*10000 + quarter(o_orderdate)*100 + month(o_orderdate) as m, c_nationkey + 1000 as g, sum(cast(round(o_totalprice*100) as bigint)) as cents from orders join customer on o_custkey = c_custkey group by 1, 2)"
_TOTALS = f"""{_F}, e as (select *, row_number() over (order by m, g) as k from f),
  v as (select per, geo, cast(sum(case when k <= {{edited}} then 777 else cents end) as bigint) as v, max(k <= {{edited}}) as hit from e join nation on g = n_nationkey + 1000, unnest([m, m // 100 * 100, m // 10000 * 10000]) p(per), unnest([g, 10 + n_regionkey, 1]) q(geo) group by 1, 2)"""


@query(_TOTALS.format(edited=0) + " select cast(per as bigint) as per, cast(geo as bigint) as geo, cast(v as varchar) as value_str, case when geo < 1000 or per % 100 = 0 then 'formula' else 'manual' end as rule from v")
def generated_model(spark, d):
    cells, _ = workflow.generate(sales_model(spark, d))
    return cells.where("coord[1] = 100").select(F.col("coord")[0].alias("per"), F.col("coord")[2].alias("geo"), "value_str", "rule")


def _edited(spark, d, n):
    """The model's first cells by period and nation set to 777, their history and the calculation before."""
    model = sales_model(spark, d)
    path = f"{shared_dir(spark).rstrip('/')}/kept-{spark.sparkContext.applicationId}-{abs(hash(d))}"
    before = workflow.calculation(model, path)
    cells = materialized(workflow.written_back(model.cells, before), "cells")
    first = model.cells.where("coord[1] = 100").orderBy(F.col("coord")[0], F.col("coord")[2]).limit(n)
    edits = first.select("sheet_id", "coord", F.lit("777").alias("value_str"), F.lit("u").alias("user_id"), F.lit("2026-01-01 00:00:00").cast("timestamp").alias("ts"))
    return cells, before, materialized(edits, "edits")


@query(_TOTALS.format(edited=3) + " select cast(per as bigint) as per, cast(geo as bigint) as geo, cast(v as varchar) as value_str from v")
def saved_edits(spark, d):
    cells, before, edits = _edited(spark, d, 3)
    done, _, _ = workflow.save(cells, before, edits, 1)
    return done.where("coord[1] = 100").select(F.col("coord")[0].alias("per"), F.col("coord")[2].alias("geo"), "value_str")


@query(_TOTALS.format(edited=0) + " select cast(per as bigint) as per, cast(geo as bigint) as geo, cast(v as varchar) as value_str from v")
def undone_edits(spark, d):
    cells, before, edits = _edited(spark, d, 3)
    done, log, after = workflow.save(cells, before, edits, 1)
    back, left, _ = workflow.undo(done, after, log, 1)
    return back.where("coord[1] = 100").select(F.col("coord")[0].alias("per"), F.col("coord")[2].alias("geo"), "value_str")
