import pytest
from gridloom.operators import calc, imports, importer, workflow
from gridloom.sources import workbook
from gridloom.streaming import edits as stream
from models import RECORDS, axes, model
from pyspark.sql import functions as F

IND = [(10, "ind", None, 0, "In", None, None), (11, "ind", None, 1, "Opening", None, None), (12, "ind", None, 2, "Closing", None, None), (13, "ind", None, 3, "None", None, None)]
RULES = [("r1", "s", 11, "leaf", None, 0, '[closing](periods="предыдущий")'), ("r2", "s", 12, "leaf", None, 0, "[opening]*1.01+[in]"), ("r3", "s", 13, "leaf", None, 0, "__empty__")]


def months(n):
    return [(1000 + i, "per", None, i, f"M{i}", f"{2000 + i // 12}-{i % 12 + 1:02d}", None) for i in range(n)]


def balance(spark, n):
    cells = [("s", [1000 + i, 10], str(i % 7), "manual", None) for i in range(n)] + [("s", [1000, 13], "5", "sum_children", None)]
    sheet_axes = [("s", 0, "per", "periods", False, True), ("s", 1, "ind", "ind", True, False)]
    return model(spark, [("s", "S", None)], sheet_axes, months(n) + IND, cells, RULES)


def plain(inputs):
    out, before = [], 0.0
    for x in inputs:
        before = before * 1.01 + x
        out.append(before)
    return out


def closing(values):
    return [r.value for r in values.where("coord[1] = 12").orderBy("coord").collect()]


@pytest.fixture(scope="module")
def done(spark):
    m = balance(spark, 240)
    return m, calc.calculate(m)


def test_long_chain_over_two_cells(done):
    """A balance over 240 months through two indicators that refer to each other takes few rounds, not 480."""
    m, got = done
    assert closing(got.values) == pytest.approx(plain([i % 7 for i in range(240)]))
    empty = got.values.where("coord[1] = 13").collect()
    assert {r.source for r in empty} == {"cell-empty"} and {r.value for r in empty} == {None}


def test_rounds_do_not_grow_with_the_chain(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(calc, "materialized", lambda df, name, by=None, real=calc.materialized: (rounds.append(name), real(df, name, by))[1])
    calc.calculate(balance(spark, 90))
    assert rounds.count("values") <= 8 and rounds.count("chains") <= 12


def test_save_undo_and_stored_state(spark, done, tmp_path):
    m, got = done
    path = str(tmp_path / "kept")
    version = workflow.version_of(m)
    assert workflow.kept(spark, path, version) is None
    workflow.keep(got, path, version)
    assert closing(workflow.calculation(m, path).values) == closing(got.values)
    other = balance(spark, 240)
    assert workflow.version_of(other) == version
    changed = model(spark, [("s", "S", None)], axes("s", "per", "ind"), months(240) + IND, [], RULES)
    assert workflow.version_of(changed) != version
    cells = workflow.written_back(m.cells, got)
    edit = [("s", [1000, 10], "100", "u", "2026-01-01 00:00:00"), ("s", [1001, 10], "1", "u", "2026-01-01 00:00:01")]
    edits = spark.createDataFrame(edit, "sheet_id string, coord array<bigint>, value_str string, user_id string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    after, log, result = workflow.save(cells, got, edits, 5)
    assert [(r.seq, r.old_value, r.new_value) for r in log.collect()] == [(5, "0", "100")]
    want = plain([100] + [i % 7 for i in range(1, 240)])
    assert closing(result.values) == pytest.approx(want)
    assert float(after.where("coord[0] = 1239 and coord[1] = 12").first().value_str) == pytest.approx(want[-1], abs=1e-5)
    back, left, again = workflow.undo(after, result, log, 5)
    assert left.count() == 0 and closing(again.values) == pytest.approx(closing(got.values))
    assert back.where("coord[0] = 1000 and coord[1] = 10").first().value_str == "0"
    # Without a calculation values are saved and formulas wait.
    only, _, none = workflow.save(cells, None, edits, 1)
    assert none is None and only.where("coord[0] = 1000 and coord[1] = 10").first().value_str == "100"


def test_stream_of_edits_recalculates(spark, tmp_path):
    m = balance(spark, 12)
    got = calc.calculate(m)
    store, src = str(tmp_path / "store"), str(tmp_path / "in")
    stream.begin(workflow.written_back(m.cells, got), got, store)
    for k, v in enumerate(("50", "60")):
        rows = [("s", [1000, 10], v, "u", f"2026-01-0{k + 1} 00:00:00")]
        spark.createDataFrame(rows, "sheet_id string, coord array<bigint>, value_str string, user_id string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(src)
        read = spark.readStream.schema("sheet_id string, coord array<bigint>, value_str string, user_id string, ts timestamp").parquet(src)
        stream.to_model(read, store, str(tmp_path / "cp")).awaitTermination()
    log = spark.read.parquet(f"{store}/state-2/history").orderBy("seq").collect()
    assert [(r.seq, r.old_value, r.new_value) for r in log] == [(1, "0", "50"), (2, "50", "60")]
    after = workflow.kept(spark, f"{store}/state-2", "calculation")
    assert closing(after.values) == pytest.approx(plain([60] + list(range(1, 7)) + list(range(0, 5))))


def test_workbook_to_checked_model(spark, tmp_path):
    """From an .xlsx file to a calculated model whose values are those of the file."""
    import zipfile

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    text = lambda at, v, style=0: f'<c r="{at}" t="inlineStr" s="{style}"><is><t>{v}</t></is></c>'
    num = lambda at, v, f="": f'<c r="{at}">{f"<f>{f}</f>" if f else ""}<v>{v}</v></c>'
    cols = "CDE"
    rows = {
        2: "".join(text(f"{c}2", t) for c, t in zip(cols, ("Январь 2026", "Февраль 2026", "Март 2026"))) + text("F2", "2026"),
        3: text("A3", "Выручка", 1),
        4: text("A4", "Партнеры") + text("B4", "шт") + "".join(num(f"{c}4", v) for c, v in zip(cols, (10, 12, 18))) + num("F4", 40, "C4+D4+E4"),
        5: text("A5", "Итого выдачи") + "".join(num(f"{c}5", v) for c, v in zip(cols, (300, 400, 500))) + num("F5", 1200, "SUM(C5:E5)"),
        6: text("A6", "Розница", 2) + "".join(num(f"{c}6", v) for c, v in zip(cols, (100, 150, 200))),
        7: text("A7", "Бизнес", 2) + "".join(num(f"{c}7", v) for c, v in zip(cols, (200, 250, 300))),
        8: text("A8", "Среднее", 1) + "".join(num(f"{c}8", v, f"{c}5/{c}4") for c, v in zip(cols, (30, 400 / 12, 500 / 18))) + num("F8", 30, "F5/F4"),
        9: text("A9", "Остаток", 1) + num("C9", 7, "B9+C4") + num("D9", 19, "C9+D4") + num("E9", 37, "D9+E4") + num("F9", 37, "E9"),
    }
    sheet = "".join(f'<row r="{r}">{x}</row>' for r, x in rows.items())
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="BaaS" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><fonts><font/><font><b/></font></fonts><fills><fill/></fills><cellXfs><xf/><xf fontId="1"/><xf><alignment indent="1"/></xf></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{sheet}</sheetData></worksheet>")
    grid = workbook.read_binary(spark, str(tmp_path)).drop("file").cache()
    header, tree = imports.analysis(grid)
    found = {r.name: (r.parent_row, r.is_group, r.unit) for r in tree.collect()}
    assert found["Розница"][0] == 5 and found["Бизнес"][0] == 5 and found["Партнеры"] == (3, False, "шт") and found["Среднее"][0] is None
    m = imports.imported_model(grid)
    rules = {r.formula for r in m.rules.collect()}
    assert rules == {"[Итого выдачи]/[Партнеры]", "LAST"}
    by_rule = {(r.rule, r.formula) for r in m.cells.collect()}
    assert ("formula", "[Итого выдачи]/[Партнеры]") in by_rule and ("sum_children", None) in by_rule
    assert ("formula", '[Остаток](периоды="предыдущий")+[Партнеры]') in by_rule
    result = calc.calculate(m)
    checked = importer.verified(result.values.select("sheet_id", F.col("coord")[0].alias("row"), F.col("coord")[1].alias("col"), "value"), imports.shown_values(grid)).collect()
    assert [(r.cells, r.matched) for r in checked] == [(18, 18)]
    names, keys = {r.record_id: r.name for r in m.records.collect()}, {r.record_id: r.period_key for r in m.records.collect()}
    year = {names[r.coord[1]]: r.value for r in result.values.collect() if keys[r.coord[0]] == "2026-Y"}
    assert year["Среднее"] == 30 and year["Остаток"] == 37 and year["Итого выдачи"] == 1200
    assert imports.not_imported(grid, m).count() == 0
