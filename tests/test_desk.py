import zipfile

import pytest
from gridloom.functions import periods, text
from gridloom.operators import editing, hierarchy, history, importer, reading, rules
from gridloom.sources import crosstab, snapshot, workbook
from gridloom.streaming import edits
from models import PERIODS, RECORDS, axes, model
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def tree(spark):
    rows = [(1, "d", None, 0, "Head", None, None), (2, "d", 1, 1, "B", None, None), (3, "d", 1, 0, "A", None, None), (4, "d", 3, 0, "A1", None, None), (5, "d", 9, 5, "Lost", None, None)]
    return spark.createDataFrame(rows, RECORDS)


def test_hierarchy(tree):
    assert {tuple(r) for r in hierarchy.closure(tree).collect()} >= {(4, 4, 0), (4, 3, 1), (4, 1, 2), (5, 5, 0)}
    order = [r.record_id for r in hierarchy.in_tree_order(tree).orderBy("tree_path").collect()]
    assert order == [1, 3, 4, 2, 5]
    assert {r.record_id for r in hierarchy.leaves(tree).collect()} == {2, 4, 5}
    assert {r.record_id for r in hierarchy.subtree(tree, F.col("name") == "A").collect()} == {3, 4}


def test_cycle_of_parents_is_an_error(spark):
    rows = spark.createDataFrame([(1, "d", 2, 0, "a", None, None), (2, "d", 1, 0, "b", None, None)], RECORDS)
    with pytest.raises(ValueError, match="cycle"):
        hierarchy.closure(rows)


def test_periods(spark):
    got = hierarchy.generate_periods(spark, "2026-01-15", "2026-06-10").collect()
    assert sorted(r.level for r in got) == ["M"] * 6 + ["Q"] * 2 + ["Y"]
    assert {str(r.start) for r in got if r.period_key in ("2026-01", "2026-Q1", "2026-Y")} == {"2026-01-15"}
    half = {r.period_key: r.parent_key for r in hierarchy.generate_periods(spark, "2026-01-01", "2026-12-31", ("M", "Q", "H", "Y")).collect()}
    assert half["2026-Q3"] == "2026-H2" and half["2026-H2"] == "2026-Y" and half["2026-Y"] is None
    heads = ["Январь 2026", "2026-03-05", "05.04.2026", "Q2 2027", "3 кв 2027", "H1 2026", "2026", "2026 год", "2026-q1", "Mai", None]
    df = spark.createDataFrame([(h,) for h in heads], "t string").select(periods.from_header(F.col("t")))
    assert [r[0] for r in df.collect()] == ["2026-01", "2026-03", "2026-04", "2027-Q2", "2027-Q3", "2026-H1", "2026-Y", "2026-Y", "2026-Q1", None, None]
    assert spark.sql("select date'1900-03-01' as d").select(periods.excel_serial(F.col("d"))).first()[0] == 61


def test_add_and_remove_axis(spark):
    cells = spark.createDataFrame([(1, "100"), (2, "0")], "a int, value_str string")
    leaves = spark.createDataFrame([(7,), (8,)], "record_id int")
    wide = editing.add_axis(cells, leaves, "b")
    assert wide.count() == 4
    wide = wide.withColumn("value_str", F.when(F.col("b") == 8, F.concat("value_str", F.lit("5"))).otherwise(F.col("value_str")))
    assert {tuple(r) for r in editing.remove_axis(wide, ["a", "b"], "b").select("a", "value_str").collect()} == {(1, "1005"), (2, "05")}


def test_fill_keeps_formulas(spark):
    cells = spark.createDataFrame([(1, 999.0, "formula"), (2, 5.0, "manual")], "a int, value double, rule string")
    members = {"a": spark.createDataFrame([(1,), (2,), (3,)], "record_id int")}
    got = {r.a: r.value for r in editing.fill(cells, members, F.lit(42.0), ["a"]).collect()}
    assert got == {1: 999, 2: 42, 3: 42}
    rnd = {r.a: r.value for r in editing.fill(cells, members, editing.random_integers(10, 20, 1, "a"), ["a"]).collect()}
    assert rnd[1] == 999 and all(10 <= rnd[k] <= 20 for k in (2, 3))


def test_permissions(spark):
    cells = spark.createDataFrame([(1, 5, 1.0), (2, 5, 2.0), (3, 6, 3.0)], "d int, p int, value double")
    granted = spark.createDataFrame([("u", "dep", 1, True, False), ("u", "dep", 2, True, True), ("w", "dep", 3, False, False)], "user_id string, analytic_id string, record_id int, can_view boolean, can_edit boolean")
    see = lambda u, r="can_view": {x.d for x in reading.visible(cells, granted, {"d": "dep", "p": "per"}, u, r).collect()}
    assert see("u") == {1, 2} and see("u", "can_edit") == {2} and see("v") == {1, 2, 3} and see("w") == set()


def test_history_and_undo(spark):
    cells = spark.createDataFrame([(1, "a", "manual"), (2, "b", "formula")], "k int, value_str string, rule string")
    e = spark.createDataFrame([(1, "a", "u", 1), (2, "x", "u", 1), (2, "y", "u", 2), (3, "n", "u", 3)], "k int, value_str string, user_id string, ts int")
    done, log = history.saved(cells, e, ["k"], 10)
    assert {tuple(r) for r in done.select("k", "value_str", "rule").collect()} == {(1, "a", "manual"), (2, "y", "manual"), (3, "n", "manual")}
    assert {(r.seq, r.k, r.old_value) for r in log.collect()} == {(10, 2, "b"), (11, 3, None)}
    back, left = history.undone(log, 10, ["k"])
    assert {tuple(r) for r in back.collect()} == {(2, "b"), (3, None)} and left.isEmpty()


def test_rules(spark):
    cells = spark.createDataFrame([(1, 5, "x"), (1, 6, "x"), (1, 7, "y"), (2, 5, "z")], "i int, p int, formula string")
    got = {(r.indicator_id, r.kind): (r.formula, r.scope) for r in rules.derived_rules(cells, "i", ["p"]).collect()}
    assert got == {(1, "leaf"): ("x", None), (1, "scoped"): ("y", {"p": "7"}), (2, "leaf"): ("z", None)}
    schema = "rule_id string, sheet_id string, indicator_id int, kind string, scope map<string,string>, priority int, formula string"
    own = spark.createDataFrame([("r", "s", 1, "consolidation", None, 30, "[a]/[b]")], schema)
    cell = spark.createDataFrame([("n", "s", 1, "scoped", {"p": "7"}, 100, "9"), ("m", "s", 1, "scoped", {"p": "8"}, 5, "8")], schema).drop("kind")
    assert {r.rule_id: r.priority for r in rules.promoted(own, cell).collect()} == {"r": 30, "n": 100, "m": 40}
    names = spark.createDataFrame([("s", 1, "Mean"), ("t", 4, "mean"), ("t", 5, "Other")], "sheet_id string, indicator_id int, name string")
    assert {(r.sheet_id, r.indicator_id, r.formula) for r in rules.spread(own, names).collect()} == {("s", 1, "[a]/[b]"), ("t", 4, "[a]/[b]")}


def test_import_pieces(spark):
    t = importer.translated_formula
    names = {2: "partners", 4: "sum", 5: "loans"}
    assert t("=E5/E2", 5, names) == "[loans]/[partners]"
    assert t("=D2*1.5+$C$5", 5, names) == '[partners](периоды="предыдущий")*1.5+[loans](периоды="назад(2)")'
    assert t("=SUM(E2:E5)*10%", 5, names) == "SUM([partners], [sum], [loans])*0.1"
    assert t("='Par 1'!E3+E9", 5, names, {"Par 1": {3: "rate"}}, {(9, 5): 7.0}) == "[Par 1::rate]+7.0"
    labels = spark.createDataFrame([("s", 1, "A", 0), ("s", 2, "x", 1), ("s", 3, "x", 1), ("s", 4, "y", 2), ("s", 5, "B", 0)], "sheet_id string, row int, name string, indent int")
    got = importer.tree_from_rows(labels)
    parent = {r.record_id: r.excel_row for r in got.collect()}
    assert {(r.name, parent.get(r.parent_id)) for r in got.collect()} == {("A", None), ("x", 1), ("x #2", 1), ("y", 3), ("B", None)}
    two = spark.createDataFrame([("s", 1, "G", "a"), ("s", 2, "G", "b"), ("s", 3, "H", "b")], "sheet_id string, row int, l0 string, l1 string")
    assert [(r.indent, r.name) for r in importer.label_levels(two, ["l0", "l1"]).orderBy("row").collect()] == [(0, "G"), (1, "a"), (1, "b"), (0, "H"), (1, "b")]
    cols = spark.createDataFrame([("s", 2, "2026-01"), ("s", 3, "2026-02"), ("s", 4, "2026-Q1"), ("s", 5, "2027-Q1")], "sheet_id string, col int, period_key string")
    assert {(r.col, r.is_total, r.leaf_no) for r in importer.leaf_columns(cols).collect()} == {(2, False, 0), (3, False, 1), (4, True, None), (5, False, 2)}
    one = spark.createDataFrame([("=A1", "FFFFFF00", False), ("7", "theme:7", True), ("=[1]B!A1", None, False), ("=A1", None, True), (None, None, True), (None, None, False)], "f string, c string, k boolean")
    assert [r[0] for r in one.select(importer.cell_rule(F.col("f"), F.col("c"), F.col("k"))).collect()] == ["formula", "manual", "manual", "formula", "sum_children", "manual"]
    assert [r[0] for r in one.select(text.name_candidates(F.array(F.lit("A"), F.lit("B")))).limit(1).collect()] == [["B", "A. B"]]


def test_year_totals(spark):
    rows = [("=B2+C2+D2", "SUM"), ("=SUM(B2:D2)", "SUM"), ("=E5/E2", "RATIO"), ("=SUM(B3:D3)/3", "AVERAGE"), ("=D4", "LAST"), ("=B2*2", None)]
    got = spark.createDataFrame(rows, "f string, k string").select(importer.consolidation_of(F.col("f"), F.lit("E")), "k").collect()
    assert all(a == b for a, b in got)


def test_crosstab_round_trip(spark, tree):
    cells = spark.createDataFrame([(4, 11, "1"), (2, 12, "2.5")], "row_id int, col_id int, value_str string")
    table = crosstab.exported(cells, tree, [(11, "Jan"), (12, "Feb")])
    assert [r.name for r in table.collect()] == ["Head", "  A", "    A1", "  B", "Lost"]
    assert {tuple(r) for r in crosstab.imported(table, tree, {"Jan": 11, "Feb": 12}).collect()} == {(4, 11, "1"), (2, 12, "2.5")}
    names = spark.createDataFrame([("a", "x" * 40), ("b", "x" * 35)], "sheet_id string, name string")
    assert {r.title for r in crosstab.titles(names).collect()} == {"x" * 31, "x" * 29 + "~2"}


def test_workbook_source(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Na</t></si><si><r><t>x</t></r><r><t>y</t></r></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><fonts><font/><font><b/></font></fonts><fills><fill/><fill><patternFill><fgColor rgb="FFFFFF00"/></patternFill></fill></fills><cellXfs><xf/><xf fillId="1" fontId="1"><alignment indent="2"/></xf></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>1</v></c></row><row r="1" outlineLevel="1"><c r="AB1" s="1"><f>A1*2</f><v>4</v></c><c r="C1"/></row></sheetData></worksheet>')
    spark.dataSource.register(workbook.Workbooks)
    want = {("S", 1, 1, "xy", None, 0, None, False, 0), ("S", 1, 28, "4", "=A1*2", 2, "FFFFFF00", True, 1)}
    for df in (spark.read.format("workbook").load(str(tmp_path)), workbook.read_binary(spark, str(tmp_path))):
        assert {tuple(r)[1:] for r in df.collect()} == want


def test_snapshot_and_keys(spark, tmp_path):
    m = model(spark, [("s", "S", None)], axes("s", "per", "ind"), PERIODS, [("s", [2, 10], "1", "manual", None)])
    snapshot.save(m, str(tmp_path / "m"))
    again = snapshot.load(spark, str(tmp_path / "m"))
    assert again.cells.select(snapshot.packed(F.col("coord"))).first()[0] == "2|10" and again.records.count() == 4
    ids = spark.createDataFrame([("p", 2), ("q", 10)], "uuid string, record_id long")
    keyed = snapshot.with_ids(spark.createDataFrame([("p|q",), ("p|z",)], "coord_key string"), ids)
    assert {tuple(r.coord) for r in keyed.collect()} == {(2, 10), (2, -1)}


def test_edit_stream(spark, tmp_path):
    src, log = str(tmp_path / "in"), str(tmp_path / "log")
    for i, part in enumerate(([(1, 1.0, "2026-01-01 00:00:00"), (1, 2.0, "2026-01-01 00:00:05")], [(1, 3.0, "2026-01-01 00:00:01"), (2, 9.0, "2026-01-02 00:00:00")])):
        spark.createDataFrame(part, "k int, value double, ts string").selectExpr("k", "value", "cast(ts as timestamp) as ts").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("k int, value double, ts timestamp").parquet(src)
        edits.to_log(stream, ["k"], log, str(tmp_path / "cp")).awaitTermination()
    # The later batch wins, as a later edit of the log.
    assert {(r.k, r.value) for r in edits.present(spark.read.parquet(log), ["k"]).collect()} == {(1, 3.0), (2, 9.0)}
    assert {(r.k, r.value) for r in edits.present(spark.read.parquet(log), ["k"], by_time=True).collect()} == {(1, 2.0), (2, 9.0)}


def test_longest_prefix_is_not_broadcast(spark):
    # A handful of array columns looks small to Spark however many rows there are; the coordinates must be merged, not sent whole.
    known = spark.createDataFrame([([1, 2], 5), ([1, 2, 3], 7)], "coord array<long>, value long")
    asked = spark.createDataFrame([([1, 2, 3],), ([1, 2, 4],), ([2, 2, 4],)], "coord array<long>")
    got = reading.longest_prefix(asked, known)
    assert {(tuple(r.coord), r.value) for r in got.collect()} == {((1, 2, 3), 7), ((1, 2, 4), 5)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
