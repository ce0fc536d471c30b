"""Queries on imported worksheets, each with its SQL. Sheets are made from the driver tables: one for each supplier, customer, nation or user."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import periods, text
from ..operators import calc, importer, imports
from ..session import materialized
from .tables import month, table

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _header(spark, d):
    """A header for each customer: its months and, behind them, its years."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("sheet_id"), F.explode(F.array(month("o_orderdate"), periods.key_at(F.col("o_orderdate"), "Y"))).alias("period_key")).distinct()
    return o.withColumn("col", F.row_number().over(Window.partitionBy("sheet_id").orderBy(periods.rank(F.col("period_key")), "period_key")))


@query("select o_custkey as sheet_id, cast(min(date_trunc('month', o_orderdate)) as date) as start_day, cast(max(last_day(o_orderdate)) as date) as end_day from orders group by 1")
def header_range(spark, d):
    got = imports.period_range(_header(spark, d).where("period_key not like '%-Y'"))
    return got.select("sheet_id", F.col("start").alias("start_day"), F.col("end").alias("end_day"))


@query("""with h as (select distinct o_custkey as sheet_id, unnest([strftime(o_orderdate, '%Y-%m'), strftime(o_orderdate, '%Y') || '-Y']) as k from orders),
  n as (select *, row_number() over (partition by sheet_id order by k like '%-Y', k) as col from h)
  select sheet_id, k as period_key, k like '%-Y' as is_total, cast(case when k not like '%-Y' then row_number() over (partition by sheet_id, k like '%-Y' order by col) - 1 end as int) as leaf_no from n""")
def leaf_columns(spark, d):
    return importer.leaf_columns(_header(spark, d)).select("sheet_id", "period_key", "is_total", "leaf_no")


@query("select o_custkey as sheet_id, 'M' as level from orders group by 1")
def sheet_levels(spark, d):
    return importer.period_type(_header(spark, d))


@query("""select sheet_id, m + 1 as col, cast(1995 + m // 12 as varchar) || '-' || lpad(cast(m % 12 + 1 as varchar), 2, '0') as period_key from (select p_partkey as sheet_id, p_size - 1 as m from part where p_size % 2 = 0 union all select p_partkey, 2 * p_size - 1 from part where p_size % 2 = 1)""")
def month_counters(spark, d):
    n = F.when(F.col("p_size") % 2 == 0, F.col("p_size")).otherwise(2 * F.col("p_size"))
    title = F.when(F.col("p_size") % 2 == 0, F.concat(n, F.lit(" мес"))).otherwise(F.concat(F.lit("Month "), n))
    return importer.month_counters(table(spark, d, "part").select(F.col("p_partkey").alias("sheet_id"), n.alias("col"), title.alias("value")), 1995)


@query("""with g as (select user_id as sheet_id, event_id as row, k as col, case when event_type in ('view', 'click') then case k when 1 then 'Plan' else 'факт' end when event_type = 'purchase' then 'Budget' end as v from events, (values (1), (2)) t(k) where event_type in ('view', 'click') or (event_type = 'purchase' and k = 1)),
  n as (select sheet_id, row, count(*) as n from g group by 1, 2), b as (select sheet_id, arg_min(row, (-n, row)) as row from n group by 1)
  select sheet_id, row, col, case v when 'факт' then 'fact' else 'plan' end as version from g join b using (sheet_id, row)""")
def version_labels(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("sheet_id"), F.col("event_id").alias("row"), "event_type")
    both = F.array(F.struct(F.lit(1).alias("col"), F.lit("Plan").alias("value")), F.struct(F.lit(2).alias("col"), F.lit("факт").alias("value")))
    one = F.array(F.struct(F.lit(1).alias("col"), F.lit("Budget").alias("value")))
    cells = F.when(F.col("event_type").isin("view", "click"), both).when(F.col("event_type") == "purchase", one)
    return importer.version_row(e.select("sheet_id", "row", F.explode(cells).alias("x")).select("sheet_id", "row", "x.*"))


@query("""select o_custkey as sheet_id, y as col, 'year' as kind from (select distinct o_custkey, cast(year(o_orderdate) as int) as y from orders) union all select distinct o_custkey, 9000, 'quarter' from orders union all select distinct o_custkey, 9001, 'year' from orders where o_orderstatus = 'P'""")
def total_columns(spark, d):
    o = table(spark, d, "orders").withColumn("sheet_id", F.col("o_custkey"))
    head = o.select("sheet_id", F.lit(1).alias("row"), F.year("o_orderdate").alias("col"), F.year("o_orderdate").cast("string").alias("value")).distinct()
    more = o.select("sheet_id", F.lit(2).alias("row"), F.lit(9000).alias("col"), F.lit("1-й квартал").alias("value")).distinct()
    last = o.where("o_orderstatus = 'P'").select("sheet_id", F.lit(3).alias("row"), F.lit(9001).alias("col"), F.lit("Итого").alias("value")).distinct()
    low = o.select("sheet_id", F.lit(40).alias("row"), F.lit(9002).alias("col"), F.lit("Total").alias("value")).distinct()
    plain = o.select("sheet_id", F.lit(1).alias("row"), F.lit(5).alias("col"), F.lit("2026").alias("value")).distinct()
    months = plain.select("sheet_id", "col", F.lit("2026-01").alias("period_key"))
    return imports.total_columns(head.union(more).union(last).union(low).union(plain), months)


@query("select sheet_id, row, max(case when k = 1 then f end) as first, max(case when k = 2 then f end) as then_ from (select user_id as sheet_id, month(ts) as row, '=' || event_id as f, row_number() over (partition by user_id, month(ts) order by event_id) as k from events where event_type <> 'view') where k <= 2 group by 1, 2")
def first_formulas(spark, d):
    cells = table(spark, d, "events").select(F.col("user_id").alias("sheet_id"), F.month("ts").cast("long").alias("row"), F.col("event_id").alias("col"), F.when(F.col("event_type") != "view", F.concat(F.lit("="), "event_id")).alias("formula"))
    return importer.first_formulas(cells).withColumnRenamed("then", "then_")


@query("select sheet_id, row, chunk from (select *, row_number() over (partition by sheet_id, row order by chunk) as k from (select user_id as sheet_id, day(ts) as row, event_id as chunk from events)) where k = 1")
def merged_chunks(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("sheet_id"), F.dayofmonth("ts").cast("long").alias("row"), F.col("event_id").alias("chunk"))
    return importer.first_of_each_row(rows)


@query("""with r as (select l_suppkey as sheet_id, l_orderkey as row, row_number() over (partition by l_suppkey order by l_orderkey) - 1 as n from (select distinct l_suppkey, l_orderkey from lineitem))
  select sheet_id, row, unnest(generate_series(greatest(cast(floor((n - 20) / 15) as bigint) + 1, 0), n // 15)) as chunk from r""")
def sheet_chunks(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("sheet_id"), F.col("l_orderkey").alias("row")).distinct()
    return imports.chunked(rows, 20, 5)


@query("""select s.l_suppkey as sheet_id, cast(count(*) as bigint) as cells, cast(sum(case when abs(a - b) / greatest(abs(b), 1e-9) <= 0.01 then 1 else 0 end) as bigint) as matched,
  round(avg(case when abs(a - b) / greatest(abs(b), 1e-9) <= 0.01 then 1.0 else 0.0 end) * 10000) / 10000 as rate from (select l_suppkey, l_orderkey, l_linenumber, max(l_extendedprice) as a, max(case when l_tax > 0.04 then l_extendedprice * 1.02 else l_extendedprice end) as b from lineitem group by 1, 2, 3) s group by 1""")
def import_verified(spark, d):
    keys = [F.col("l_suppkey").alias("sheet_id"), F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("col")]
    items = table(spark, d, "lineitem")
    ours = items.groupBy(*keys).agg(F.max("l_extendedprice").alias("value"))
    theirs = items.groupBy(*keys).agg(F.max(F.when(F.col("l_tax") > 0.04, F.col("l_extendedprice") * 1.02).otherwise(F.col("l_extendedprice"))).alias("value"))
    return importer.verified(ours, theirs)


@query("""select p_partkey, case when p_size % 4 = 1 or p_size % 4 = 2 then 'manual' when p_size % 4 = 3 then 'formula' when p_size > 25 then 'sum_children' else 'manual' end as rule,
  case p_size % 4 when 1 then 'yellow' when 2 then null when 3 then '#808080' else 'orange' end as colour from part""")
def cell_rules(spark, d):
    k = F.col("p_size") % 4
    f = F.when(k == 1, "12").when(k == 2, "=[2]Sheet!B1").when(k == 3, "=B1+C1")
    fill = F.when(k == 1, "FFFFFF00").when(k == 2, "FFFFFFFF").when(k == 3, "808080").otherwise("theme:5")
    return table(spark, d, "part").select("p_partkey", importer.cell_rule(f, fill, F.col("p_size") > 25).alias("rule"), text.colour_name(fill).alias("colour"))


_LABELS = """select c_nationkey as sheet_id, c_custkey as row, case when c_mktsegment = 'BUILDING' then 'Итого ' || c_custkey else 'Line ' || c_custkey end as name, case when c_acctbal < 2000 then 0 when c_acctbal < 6000 then 1 else 2 end as indent, c_mktsegment = 'MACHINERY' as bold, c_acctbal > 1000 as has_data from customer"""


def _labels(spark, d):
    bal, seg, id_ = F.col("c_acctbal"), F.col("c_mktsegment"), F.col("c_custkey").cast("string")
    return table(spark, d, "customer").select(
        F.col("c_nationkey").alias("sheet_id"), F.col("c_custkey").alias("row"), F.when(seg == "BUILDING", F.concat(F.lit("Итого "), id_)).otherwise(F.concat(F.lit("Line "), id_)).alias("name"),
        F.when(bal < 2000, 0).when(bal < 6000, 1).otherwise(2).alias("indent"), (seg == "MACHINERY").alias("bold"), (bal > 1000).alias("has_data"), F.lit(0).alias("outline"),
    )


def _nearest(level: str, levels: int) -> str:
    """SQL for the nearest row above with a smaller level."""
    each = [f"case when {level} > {k} then max(case when {level} = {k} then row end) over w end" for k in range(levels - 1)]
    return f"greatest({', '.join(each)})"


_WINDOW = "window w as (partition by sheet_id order by row rows between unbounded preceding and 1 preceding)"


@query(f"""with l as ({_LABELS}), g as (select *, name like 'Итого%' or (bold and not has_data) as is_group from l), v as (select *, indent * 2 + case when is_group or bold then 0 else 1 end as lv from g)
  select sheet_id, row, is_group, {_nearest('lv', 6)} as parent_row from v {_WINDOW}""")
def grouped_rows(spark, d):
    return imports.grouped_rows(_labels(spark, d)).select("sheet_id", "row", "is_group", "parent_row")


@query(f"""with l as ({_LABELS}), v as (select *, indent + case when bold then 0 else 1 end as lv from l) select sheet_id, row, {_nearest('lv', 4)} as parent_row from v {_WINDOW}""")
def tree_by_fonts(spark, d):
    return imports.by_formatting(_labels(spark, d)).select("sheet_id", "row", "parent_row")


@query(f"""with recursive l as ({_LABELS}), t as (select *, {_nearest('indent', 3)} as p from l {_WINDOW}),
  up(sheet_id, row, a) as (select sheet_id, row, p from t union all select up.sheet_id, up.row, t.p from up join t on t.sheet_id = up.sheet_id and t.row = up.a where not t.has_data)
  select up.sheet_id, up.row, up.a as parent_row from up left join t on t.sheet_id = up.sheet_id and t.row = up.a where up.a is null or t.has_data""")
def without_empty_parents(spark, d):
    from ..operators import hierarchy

    rows = hierarchy.parents_by_indent(_labels(spark, d).withColumn("pos", F.col("row"))).withColumnRenamed("parent_pos", "parent_row")
    return imports.without_empty_parents(materialized(rows, "rows")).select("sheet_id", "row", "parent_row")


@query(f"""with l as ({_LABELS}), x as (select *, first_value(row) over v as fr, first_value(indent) over v as fi from l window v as (partition by sheet_id order by row)),
  y as (select *, min(case when row <> fr then indent end) over (partition by sheet_id) as mi, {_nearest('indent', 3)} as above from x {_WINDOW})
  select sheet_id, row, case when row = fr then null when mi > fi then fr else above end as parent_row from y""")
def repaired_tree(spark, d):
    # Every row claims the sheet's first row as its group; indentation may say otherwise.
    first = F.min("row").over(Window.partitionBy("sheet_id"))
    rows = _labels(spark, d).withColumn("name", F.lit("Line")).withColumn("parent_row", F.when(F.col("row") > first, first))
    return imports.repaired(materialized(rows, "rows")).select("sheet_id", "row", "parent_row")


@query("select p_partkey, case when p_size % 3 = 0 then p_brand || '. ' || p_type || '. ' || p_name else case p_size % 3 when 1 then upper(p_name) || ' #2' else p_type || '. ' || lower(p_name) end end as name from part")
def checked_names(spark, d):
    p, k = table(spark, d, "part"), F.col("p_size") % 3
    name = F.when(k == 0, "made up").when(k == 1, F.concat(F.upper("p_name"), F.lit(" #2"))).otherwise(F.concat("p_type", F.lit(". "), F.lower("p_name")))
    return imports.checked_names(p.select("p_partkey", name.alias("name"), F.col("p_brand").alias("a"), F.col("p_type").alias("b"), F.col("p_name").alias("c"))).select("p_partkey", "name")


@query(f"""with l as ({_LABELS}), k as (select sheet_id, row, bold, case when not bold then row // 10 end as parent_row from l where not (bold and has_data) union all select sheet_id, row, bold, null from l where bold and has_data)
  select sheet_id, row, case when l2.keep then row // 10 when l2.lost then last_value(case when l2.keep then row // 10 end ignore nulls) over (partition by sheet_id order by row rows between unbounded preceding and 1 preceding) end as parent_row
  from (select sheet_id, row, not (bold and has_data) as keep, bold and has_data as lost from l) l2""")
def lost_rows(spark, d):
    labels = _labels(spark, d)
    kept = labels.where("not (bold and has_data)").withColumn("parent_row", F.expr("row div 10"))
    return imports.with_lost_rows(kept, labels).select("sheet_id", "row", "parent_row")


@query("""select s_suppkey as sheet_id, cast(1 + k as int) as row, case k when 0 then 'AVERAGE' when 1 then 'LAST' else '[r' || 1 || ']/[r' || 2 || ']' end as formula from supplier, (values (0), (1), (2)) t(k)""")
def consolidation_rules(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("sheet_id"))
    formulas = F.array(F.lit("=AVERAGE(B1:D1)"), F.lit("=$D2"), F.lit("=E1/E$2"), F.lit("=SUM(B4:D4)"), F.lit("=B5+C5+D5"))
    grid = s.select("sheet_id", F.posexplode(formulas).alias("k", "formula")).select("sheet_id", (F.col("k") + 1).alias("row"), F.lit(5).alias("col"), F.lit("1").alias("value"), "formula")
    totals = s.select("sheet_id", F.lit(5).alias("col"), F.lit("year").alias("kind")).union(s.select("sheet_id", F.lit(3), F.lit("quarter")))
    names = grid.select("sheet_id", "row", F.concat(F.lit("r"), F.col("row").cast("string")).alias("name"))
    return imports.consolidation_rules(grid, totals, names)


@query("""select 'p' || p_partkey as pattern_key, case when p_size > 40 then 'formula' else p_brand end as action, case when p_size > 40 then 1.0 else p_size / 100 end as confidence, case when p_size > 40 then 'user_confirmed' else 'builtin' end as source from part union all select 'new', 'group', 1.0, 'user_confirmed'""")
def pattern_base(spark, d):
    p = table(spark, d, "part")
    cols = ["pattern_key", "pattern_type", "match_rule", "action", "confidence"]
    base = p.select(F.concat(F.lit("p"), "p_partkey"), F.lit("x"), F.lit("{}"), "p_brand", F.col("p_size") / 100, F.lit("builtin")).toDF(*cols, "source")
    confirmed = p.where("p_size > 40").select(F.concat(F.lit("p"), "p_partkey"), F.lit("x"), F.lit("{}"), F.lit("formula"), F.lit(1.0)).toDF(*cols)
    new = spark.createDataFrame([("new", "x", "{}", "group", 1.0)], confirmed.schema)
    return imports.known_patterns(base, confirmed.union(new)).select("pattern_key", "action", "confidence", "source")


@query("""select p_partkey, p_size > 30 and regexp_matches(p_name, '^(?i)S') as by_regex, starts_with(p_name, 's') as by_start, lower(p_type) = lower(p_name) as by_title, p_size > 30 as by_bold, p_size > 40 as deeper from part""")
def match_kinds(spark, d):
    p = table(spark, d, "part")
    name, bold = F.col("p_name"), F.col("p_size") > 30
    return p.select("p_partkey", (bold & text.matches(name, "regex", ["^S"])).alias("by_regex"), text.matches(name, "starts_with_any", ["S"]).alias("by_start"), text.matches(name, "sheet_title", [], sheet=F.col("p_type")).alias("by_title"),
        text.matches(name, "formatting", ["bold"], bold=bold).alias("by_bold"), text.matches(name, "indent_increase", [], deeper=F.col("p_size") > 40).alias("deeper"))


def _sheets(spark, d):
    """A worksheet for each nation: its orders by month and status, a group for each half of the statuses, a ratio row."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.expr("o_custkey = c_custkey")).select(F.concat(F.lit("N"), "c_nationkey").alias("sheet_id"), F.date_trunc("month", "o_orderdate").alias("m"), "o_orderstatus")
    facts = o.groupBy("sheet_id", "m", "o_orderstatus").agg(F.count("*").alias("n"))
    head = facts.select("sheet_id", "m").distinct().withColumn("col", F.row_number().over(Window.partitionBy("sheet_id").orderBy("m")) + 2)
    names = F.split(F.lit("Январь Февраль Март Апрель Май Июнь Июль Август Сентябрь Октябрь Ноябрь Декабрь"), " ")
    none, no = F.lit(None).cast("string"), F.lit(False)
    title = head.select("sheet_id", F.lit(3).alias("row"), "col", F.concat(F.get(names, F.month("m") - 1), F.lit(" "), F.year("m").cast("string")).alias("value"), none.alias("formula"), F.lit(0).alias("indent"), none.alias("fill"), no.alias("bold"))
    lines = [(5, "Итого", 0, True), (6, "Finished", 1, False), (7, "Open", 1, False), (9, "Share", 0, True)]
    labels = spark.createDataFrame(lines, "row int, value string, indent int, bold boolean")
    left = head.select("sheet_id").distinct().crossJoin(F.broadcast(labels)).select("sheet_id", "row", F.lit(1).alias("col"), "value", none.alias("formula"), "indent", none.alias("fill"), "bold")
    wide = head.join(facts.groupBy("sheet_id", "m").agg(F.coalesce(F.sum(F.when(F.col("o_orderstatus") == "F", F.col("n"))), F.lit(0)).alias("f"), F.coalesce(F.sum(F.when(F.col("o_orderstatus") != "F", F.col("n"))), F.lit(0)).alias("o")), ["sheet_id", "m"])
    letter = imports.column_letters(F.col("col"))
    numbers_ = F.array(
        F.struct(F.lit(5).alias("row"), (F.col("f") + F.col("o")).cast("string").alias("value"), none.alias("formula")),
        F.struct(F.lit(6).alias("row"), F.col("f").cast("string").alias("value"), none.alias("formula")),
        F.struct(F.lit(7).alias("row"), F.col("o").cast("string").alias("value"), none.alias("formula")),
        F.struct(F.lit(9).alias("row"), (F.col("f") / (F.col("f") + F.col("o"))).cast("string").alias("value"), F.concat(F.lit("="), letter, F.lit("6/("), letter, F.lit("6+"), letter, F.lit("7)")).alias("formula")),
    )
    cells = wide.select("sheet_id", "col", F.explode(numbers_).alias("x")).select("sheet_id", "x.row", "col", "x.value", "x.formula", F.lit(0).alias("indent"), none.alias("fill"), no.alias("bold"))
    return title.union(left.select(*title.columns)).union(cells.select(*title.columns))


_SHEETS = """with f as (select 'N' || c_nationkey as sheet_id, strftime(o_orderdate, '%Y-%m') as k, count(*) filter (o_orderstatus = 'F') as f, count(*) filter (o_orderstatus <> 'F') as o from orders join customer on o_custkey = c_custkey group by 1, 2)"""


@query(f"{_SHEETS} select sheet_id, cast(4 as bigint) as rows, cast(2 as bigint) as roots, cast(1 as bigint) as groups, cast(count(*) as bigint) as columns from f group by 1")
def workbook_analysis(spark, d):
    header, tree = imports.analysis(materialized(_sheets(spark, d), "grid"))
    return imports.tree_counts(tree).join(header.groupBy("sheet_id").agg(F.count("*").alias("columns")), "sheet_id")


@query(f"""{_SHEETS} select sheet_id, k as period_key, name, case name when 'Итого' then f + o when 'Finished' then f when 'Open' then o else round(f / (f + o) * 1000000) / 1000000 end::double as value, case name when 'Share' then 'formula' when 'Итого' then 'sum_children' else 'manual' end as rule from f, (values ('Итого'), ('Finished'), ('Open'), ('Share')) t(name)""")
def imported_cells(spark, d):
    model = imports.imported_model(materialized(_sheets(spark, d), "grid"))
    at = lambda i, c: model.records.select(F.col("record_id").alias(f"_{c}"), F.col(c))
    cells = model.cells.select("sheet_id", F.col("coord")[0].alias("_period_key"), F.col("coord")[1].alias("_name"), F.col("value_str").cast("double").alias("value"), "rule")
    return cells.join(at(0, "period_key"), "_period_key").join(at(1, "name"), "_name").select("sheet_id", "period_key", "name", "value", "rule")


@query(f"""{_SHEETS} select sheet_id, cast(4 * count(*) as bigint) as cells, cast(4 * count(*) as bigint) as matched from f group by 1""")
def import_to_values(spark, d):
    """Worksheets imported, calculated and held against the values that they showed."""
    grid = materialized(_sheets(spark, d), "grid")
    model = imports.imported_model(grid)
    shown = materialized(imports.shown_values(grid), "shown")
    got = calc.calculate(model).values.select("sheet_id", F.col("coord")[0].alias("row"), F.col("coord")[1].alias("col"), "value")
    return importer.verified(got, shown).select("sheet_id", "cells", "matched")


@query("select count(*) as n from (select distinct n_nationkey from nation where n_nationkey not in (select c_nationkey from customer join orders on o_custkey = c_custkey))")
def sheets_not_imported(spark, d):
    grid = materialized(_sheets(spark, d), "grid")
    every = grid.select("sheet_id").union(table(spark, d, "nation").select(F.concat(F.lit("N"), "n_nationkey")))
    return imports.not_imported(every, imports.imported_model(grid)).agg(F.count("*").alias("n"))
