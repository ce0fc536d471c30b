"""Queries on consolidation, periods, formulas and the general calculation, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import formula, numbers, periods
from ..operators import calc, hierarchy, reading, rollup
from .tables import geography, month, period_closure, sales, sales_model, table

QUERIES, SQL = {}, {}


def query(sql: str | None):
    """Registers a query under its function's name."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


r2 = lambda c: numbers.rounded(F.col(c), 2).alias(c)

_GEO = """geo(node, parent, name) as (select 1, null, 'World' union all select 10 + r_regionkey, 1, r_name from region
    union all select 1000 + n_nationkey, 10 + n_regionkey, n_name from nation),
  up(de, anc) as (select node, node from geo union all select up.de, geo.parent from up join geo on up.anc = geo.node where geo.parent is not null)"""
_LEVELS = """(select k as de, unnest([k, substr(k,1,4)||'-Q'||((cast(substr(k,6,2) as int)+2)//3), substr(k,1,4)||'-H'||((cast(substr(k,6,2) as int)+5)//6), substr(k,1,4)||'-Y']) as anc
    from (select distinct strftime(o_orderdate, '%Y-%m') as k from orders))"""
_SALES = """(select 1000 + c_nationkey as geo, strftime(o_orderdate, '%Y-%m') as period, sum(l_extendedprice) as revenue, sum(l_quantity) as quantity
    from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey group by 1, 2)"""


def _rolled(spark, d):
    facts = sales(spark, d)
    tree = hierarchy.closure(geography(spark, d)).select("desc", "anc")
    return rollup.roll_up(facts, {"geo": tree, "period": period_closure(facts.select(F.col("period").alias("period_key")).distinct())}, ["revenue", "quantity"])


@query(f"""with recursive {_GEO} select cast(anc.anc as bigint) as geo, l.anc as period, round(sum(revenue)*100)/100 as revenue, sum(quantity) as quantity,
  case when sum(quantity) = 0 then null else round(sum(revenue)/sum(quantity)*100)/100 end as avg_price
  from {_SALES} f join up anc on anc.de = f.geo join {_LEVELS} l on l.de = f.period group by 1, 2""")
def rollup_geo_period(spark, d):
    got = _rolled(spark, d)
    return got.select("geo", "period", r2("revenue"), "quantity", numbers.rounded(rollup.ratio("revenue", "quantity"), 2).alias("avg_price"))


@query("""select l_returnflag, l_linestatus, round(sum(l_extendedprice)/sum(l_quantity)*10000)/10000 as ratio from lineitem group by grouping sets ((l_returnflag, l_linestatus), (l_returnflag), ())""")
def ratio_consolidation(spark, d):
    got = rollup.cube(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_extendedprice", "l_quantity"]).where("level in (0, 1, 3)")
    return got.select("l_returnflag", "l_linestatus", numbers.rounded(rollup.ratio("l_extendedprice", "l_quantity"), 4).alias("ratio"))


_CHILD = """(select 1000 + n_nationkey as id, 10 + n_regionkey as parent_id, n_nationkey as so, coalesce(v, 0) as v from nation
    left join (select c_nationkey, round(sum(c_acctbal)*100)/100 as v from customer group by 1) on c_nationkey = n_nationkey)"""


def _children(spark, d, how):
    tree = geography(spark, d).where("record_id >= 1000")
    some = table(spark, d, "customer").groupBy((F.col("c_nationkey") + 1000).cast("long").alias("record_id")).agg(numbers.rounded(F.sum("c_acctbal"), 2).alias("value"))
    return rollup.over_children(some, tree, how).select("parent_id", r2("value"))


@query(f"select cast(parent_id as bigint) as parent_id, round(avg(v)*100)/100 as value from {_CHILD} group by 1")
def average_consolidation(spark, d):
    return _children(spark, d, "AVERAGE")


@query(f"select cast(parent_id as bigint) as parent_id, round(arg_max(v, so)*100)/100 as value from {_CHILD} group by 1")
def last_consolidation(spark, d):
    return _children(spark, d, "LAST")


@query("""select r_name, cast(year(o_orderdate) as int) as y, o_orderstatus, cast(grouping(r_name, year(o_orderdate), o_orderstatus) as bigint) as level, cast(count(*) as bigint) as n
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by cube (r_name, year(o_orderdate), o_orderstatus)""")
def cube_default_sum(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.expr("o_custkey = c_custkey")).join(table(spark, d, "nation"), F.expr("c_nationkey = n_nationkey")).join(table(spark, d, "region"), F.expr("n_regionkey = r_regionkey"))
    rows = rows.select("r_name", F.year("o_orderdate").alias("y"), "o_orderstatus", F.lit(1).cast("long").alias("n"))
    return rollup.cube(rows, ["r_name", "y", "o_orderstatus"], ["n"])


_MONTHS = "(select strftime(o_orderdate, '%Y-%m') as period, o_orderstatus as s, round(sum(o_totalprice)*100)/100 as value from orders group by 1, 2)"


def _months(spark, d):
    return table(spark, d, "orders").groupBy(month("o_orderdate").alias("period"), F.col("o_orderstatus").alias("s")).agg(numbers.rounded(F.sum("o_totalprice"), 2).alias("value"))


@query(f"select period, s, round((value - lag(value) over (partition by s order by period))*100)/100 as delta from {_MONTHS}")
def prev_period_delta(spark, d):
    m = _months(spark, d)
    return m.select("period", "s", numbers.rounded(F.col("value") - rollup.shift(m, ["s"], "period", -1), 2).alias("delta"))


@query(f"select period, s, lag(value, 3) over (partition by s order by period) as value from {_MONTHS}")
def back_n(spark, d):
    m = _months(spark, d)
    return m.select("period", "s", rollup.shift(m, ["s"], "period", -3).alias("value"))


@query(f"select period, s, lead(value, 2) over (partition by s order by period) as value from {_MONTHS}")
def forward_n(spark, d):
    m = _months(spark, d)
    return m.select("period", "s", rollup.shift(m, ["s"], "period", 2).alias("value"))


@query("""select s_nationkey, s_suppkey, cast(1000 + sum(cast(round(s_acctbal*100) as bigint)) over (partition by s_nationkey order by s_suppkey) as double) as closing from supplier""")
def running_balance(spark, d):
    change = F.round(F.col("s_acctbal") * 100)
    return table(spark, d, "supplier").select("s_nationkey", "s_suppkey", rollup.running_balance(["s_nationkey"], "s_suppkey", F.lit(1000.0), change).alias("closing"))


@query("""select p.period, cast(n as bigint) as orders, round(price/n*100)/100 as per_order from (select strftime(l_shipdate, '%Y-%m') as period, sum(l_extendedprice) as price from lineitem group by 1) p
  join (select strftime(o_orderdate, '%Y-%m') as period, count(*) as n from orders group by 1) o on p.period = o.period""")
def cross_sheet_ref(spark, d):
    shipped = table(spark, d, "lineitem").groupBy(month("l_shipdate").alias("period")).agg(F.sum("l_extendedprice").alias("price"))
    orders = table(spark, d, "orders").groupBy(month("o_orderdate").alias("period")).agg(F.count("*").alias("orders"))
    return shipped.join(orders, "period").select("period", "orders", numbers.rounded(F.col("price") / F.col("orders"), 2).alias("per_order"))


@query("""with m as (select distinct strftime(l_shipdate, '%Y-%m') as k from lineitem), y as (select strftime(o_orderdate, '%Y')||'-Y' as k, cast(count(*) as bigint) as n from orders group by 1),
  o as (select strftime(o_orderdate, '%Y-%m') as k, cast(count(*) as bigint) as n from orders where day(o_orderdate) = 1 group by 1)
  select m.k as period, coalesce(o.n, y.n) as n, o.n is null as from_year from m left join o on m.k = o.k left join y on substr(m.k,1,4)||'-Y' = y.k""")
def period_translate_fallback(spark, d):
    orders = table(spark, d, "orders")
    months = table(spark, d, "lineitem").select(month("l_shipdate").alias("period")).distinct()
    exact = orders.where("day(o_orderdate) = 1").groupBy(month("o_orderdate").alias("period")).agg(F.count("*").alias("a"))
    year = orders.groupBy(periods.key_at(F.col("o_orderdate"), "Y").alias("year")).agg(F.count("*").alias("b"))
    rows = months.join(exact, "period", "left").withColumn("year", periods.key_at(periods.start(F.col("period")), "Y")).join(year, "year", "left")
    return rows.select("period", F.coalesce("a", "b").alias("n"), F.col("a").isNull().alias("from_year"))


@query("""with r as (select l_orderkey, l_linenumber, l_quantity as q, l_discount as d, case when l_linenumber = 1 then null else l_tax end as t, l_extendedprice as p from lineitem)
  select l_orderkey, l_linenumber, case when q > 25 then round(p) else q end as f_if, least(coalesce(t,0), d) as f_min, greatest(q, 10) as f_max, (d + coalesce(t,0)) / (1 + case when t is null then 0 else 1 end) as f_avg,
  abs(q - 30) as f_abs, floor(q / 7) as f_int, coalesce(case when coalesce(t,0) = 0 then null else q / t end, 0) as f_div, round(p * 10) / 10 as f_round from r""")
def formula_row_expr(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_quantity as q", "l_discount as d", "if(l_linenumber = 1, null, l_tax) as t", "l_extendedprice as p")
    texts = {"f_if": "IF([q] > 25, ROUND([p]), [q])", "f_min": "MIN([t], [d])", "f_max": "MAX([q], 10)", "f_avg": "AVERAGE([d], [t])", "f_abs": "ABS([q] - 30)", "f_int": "INT([q] / 7)", "f_div": "[q] / [t]", "f_round": "ROUND([p], 1)"}
    return rows.select("l_orderkey", "l_linenumber", *[formula.over_columns(t).alias(k) for k, t in texts.items()])



@query("""with rules(rule_id, priority, region, quarter, scope_size, name) as (values ('a',100,2,null,1,'r2'), ('b',100,2,1,2,'r2q1'), ('c',500,3,4,2,'r3q4'), ('d',100,2,null,1,'tie')),
  cells as (select n_nationkey, n_regionkey, q from nation, (values (1),(2),(3),(4)) t(q)),
  m as (select n_nationkey, q, name, row_number() over (partition by n_nationkey, q order by priority desc, scope_size desc, rule_id) as k from cells join rules on n_regionkey = region and coalesce(quarter, q) = q)
  select c.n_nationkey, c.q, coalesce(m.name, 'default-sum') as source from cells c left join m on c.n_nationkey = m.n_nationkey and c.q = m.q and m.k = 1""")
def scoped_rule_precedence(spark, d):
    from ..operators.rules import best_rule

    rules = spark.createDataFrame([("a", 100, 2, None, 1, "r2"), ("b", 100, 2, 1, 2, "r2q1"), ("c", 500, 3, 4, 2, "r3q4"), ("d", 100, 2, None, 1, "tie")], "rule_id string, priority int, region int, quarter int, scope_size int, name string")
    cells = table(spark, d, "nation").select("n_nationkey", "n_regionkey", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("q"))
    fit = cells.join(rules, (F.col("n_regionkey") == F.col("region")) & (F.coalesce("quarter", "q") == F.col("q")))
    best = best_rule(fit, ["n_nationkey", "q"]).select("n_nationkey", "q", "name")
    return cells.join(best, ["n_nationkey", "q"], "left").select("n_nationkey", "q", F.coalesce("name", F.lit("default-sum")).alias("source"))


_CALC = """with f as (select year(o_orderdate)*10000 + quarter(o_orderdate)*100 + month(o_orderdate) as m, c_nationkey + 1000 as g, sum(cast(round(o_totalprice*100) as bigint)) as cents, count(*) as n
    from orders join customer on o_custkey = c_custkey group by 1, 2),
  e as (select m, g, (select min(struct_pack(m := m, g := g)) from f) as first from f),
  v as (select per, geo, cast(sum(cents) as bigint) as cents, cast(sum(n) as bigint) as n, sum(case when f.m = first.m and f.g = first.g then cents end) as edited from f join e using (m, g) join nation on g = n_nationkey + 1000,
    unnest([m, m // 100 * 100, m // 10000 * 10000]) p(per), unnest([g, 10 + n_regionkey, 1]) q(geo) group by 1, 2)"""


@query(f"""{_CALC} select cast(per as bigint) as per, cast(i as bigint) as ind, cast(geo as bigint) as geo, cast(case i when 100 then cents when 101 then n else floor(cents / n) end as double) as value,
  case i when 102 then case when geo < 1000 or per % 100 = 0 then 'rule:r2' else 'rule:r1' end else case when geo < 1000 or per % 100 = 0 then 'default-sum' else 'manual' end end as source
  from v, (values (100), (101), (102)) t(i)""")
def general_calculation(spark, d):
    got = calc.calculate(sales_model(spark, d)).values.where("coord[1] < 103")
    return got.select(*[F.col("coord")[i].alias(n) for i, n in enumerate(("per", "ind", "geo"))], "value", "source")


@query(f"""{_CALC}, k as (select distinct m from f), t as (select m, row_number() over (order by m) as i from k),
  r as (select f.m, g, n, i - row_number() over (partition by g order by i) as run from f join t using (m))
  select cast(m as bigint) as per, cast(g as bigint) as geo, cast(sum(n) over (partition by g, run order by m) as double) as closing from r""")
def time_recursion(spark, d):
    # The previous month's balance, or nothing where a nation has no orders in it.
    got = calc.calculate(sales_model(spark, d)).values.where("coord[1] = 103 and coord[2] >= 1000 and coord[0] % 100 > 0")
    return got.select(F.col("coord")[0].alias("per"), F.col("coord")[2].alias("geo"), F.col("value").alias("closing"))


@query(f"""{_CALC} select cast(case i when 100 then new when 101 then n else floor(new / n) end as double) as value, cast(per as bigint) as per, cast(i as bigint) as ind, cast(geo as bigint) as geo
  from (select per, geo, cents - coalesce(edited, 0) + case when edited is null then 0 else 500 end as new, n from v), (values (100), (101), (102)) t(i)""")
def incremental_update(spark, d):
    model = sales_model(spark, d)
    first = model.cells.where("coord[1] = 100").agg(F.min(F.struct(F.col("coord")[0].alias("m"), F.col("coord")[2].alias("g"))).alias("x")).where("x is not null")
    edits = first.select(F.lit("s").alias("sheet_id"), F.array("x.m", F.lit(100).cast("long"), "x.g").alias("coord"), F.lit(500.0).alias("value"))
    got = calc.update(calc.calculate(model), edits).values.where("coord[1] < 103")
    return got.select(*[F.col("coord")[i].alias(n) for i, n in enumerate(("per", "ind", "geo"))], "value")


@query("""with recursive e(a, b) as (select distinct l_orderkey, l_partkey + 1000000000 from lineitem union all select distinct l_suppkey + 2000000000, l_orderkey from lineitem),
  r(x) as (select s_suppkey + 2000000000 from supplier where s_acctbal < 0 union select b from r join e on e.a = r.x) select cast(x as bigint) as id from r""")
def dirty_reachability(spark, d):
    items = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey")
    e = items.selectExpr("l_orderkey as a", "l_partkey + 1000000000 as b").union(items.selectExpr("l_suppkey + 2000000000", "l_orderkey"))
    edges = e.select(F.lit("s").alias("sheet_id"), F.array("b").alias("coord"), F.lit("s").alias("to_sheet"), F.array("a").alias("to_coord"))
    start = table(spark, d, "supplier").where("s_acctbal < 0").select(F.lit("s").alias("sheet_id"), F.array(F.col("s_suppkey") + 2000000000).alias("coord"))
    return calc.dirty(edges, start).select(F.col("coord")[0].alias("id"))


@query("""with m as (select unnest(generate_series(date '2026-01-01', date '2026-06-30', interval 1 month)) as d)
  select distinct * from (select strftime(d,'%Y-%m') as period_key, strftime(d,'%Y')||'-Q'||quarter(d) as parent_key, 'M' as level, cast(d as date) as start_day, last_day(d) as end_day from m
  union all select strftime(d,'%Y')||'-Q'||quarter(d), strftime(d,'%Y')||'-Y', 'Q', cast(date_trunc('quarter', d) as date), last_day(cast(date_trunc('quarter', d) + interval 2 month as date)) from m
  union all select '2026-Y', null, 'Y', date '2026-01-01', date '2026-06-30')""")
def generated_periods(spark, d):
    return hierarchy.generate_periods(spark, "2026-01-01", "2026-06-30").select("period_key", "parent_key", "level", F.col("start").alias("start_day"), F.col("end").alias("end_day"))


@query(f"""with recursive {_GEO}, w(node, path) as (select node, lpad(cast(node as varchar), 6, '0') from geo where parent is null union all select geo.node, path||'/'||lpad(cast(geo.node as varchar), 6, '0') from w join geo on geo.parent = w.node)
  select cast(w.node as bigint) as record_id, cast(len(string_split(path, '/')) - 1 as int) as depth, cast(row_number() over (order by path) as int) as place from w""")
def tree_preorder(spark, d):
    tree = hierarchy.in_tree_order(geography(spark, d))
    return tree.select("record_id", "depth", F.row_number().over(Window.orderBy("tree_path")).alias("place"))


@query(f"with recursive {_GEO} select cast(node as bigint) as record_id, name from geo where node in (select anc from up join geo g on g.node = up.de where contains(lower(g.name), 'nation_1'))")
def search_with_ancestors(spark, d):
    return hierarchy.with_ancestors(geography(spark, d), F.lower("name").contains("nation_1")).select("record_id", "name")


@query("""select k as period_key, level from (select *, case level when 'M' then 0 when 'Q' then 1 when 'H' then 2 else 3 end as r from (select distinct k, case when k like '%-Y' then 'Y' when k like '%-Q%' then 'Q' when k like '%-H%' then 'H' else 'M' end as level
  from (select unnest([strftime(o_orderdate,'%Y-%m'), strftime(o_orderdate,'%Y')||'-Q'||quarter(o_orderdate), strftime(o_orderdate,'%Y')||'-H'||((month(o_orderdate)+5)//6), strftime(o_orderdate,'%Y')||'-Y']) as k from orders))) where r >= 1""")
def period_level_filter(spark, d):
    keys = hierarchy.with_period_ancestors(table(spark, d, "orders").select(month("o_orderdate").alias("period_key")).distinct())
    return reading.at_least_level(keys, "Q").select("period_key", periods.level(F.col("period_key")).alias("level"))


@query("""with k as (select distinct case when year(o_orderdate) <= 1997 then strftime(o_orderdate,'%Y-%m') else strftime(o_orderdate,'%Y')||'-Q'||quarter(o_orderdate) end as k from orders
  union select distinct strftime(o_orderdate,'%Y')||'-Y' from orders), r as (select k, case when k like '%-Y' then 3 when k like '%-Q%' then 1 else 0 end as r from k)
  select k as period_key, r > min(r) over (partition by substr(k,1,4)) as is_total from r""")
def finest_granularity(spark, d):
    day = F.col("o_orderdate")
    own = F.when(F.year(day) <= 1997, periods.key_at(day, "M")).otherwise(periods.key_at(day, "Q"))
    keys = table(spark, d, "orders").select(F.explode(F.array(own, periods.key_at(day, "Y"))).alias("period_key")).distinct()
    return reading.finest_per_year(keys)
