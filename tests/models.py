"""Small hand-built models."""

from gridloom.operators.calc import Model

SHEETS = "sheet_id string, name string, excel_code string"
AXES = "sheet_id string, axis_idx int, analytic_id string, name string, is_main boolean, is_period boolean"
RECORDS = "record_id long, analytic_id string, parent_id long, sort_order int, name string, period_key string, excel_row int"
CELLS = "sheet_id string, coord array<bigint>, value_str string, rule string, formula string"
RULES = "rule_id string, sheet_id string, indicator_id long, kind string, scope map<string,string>, priority int, formula string"

#: A quarter with three months, and their ids.
PERIODS = [(1, "per", None, 0, "Q1", "2027-Q1", None)] + [(i + 1, "per", 1, i, f"M{i}", f"2027-0{i}", None) for i in (1, 2, 3)]


def model(spark, sheets, axes, records, cells, rules=()):
    make = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    return Model(make(sheets, SHEETS), make(axes, AXES), make(records, RECORDS), make(cells, CELLS), make(rules, RULES))


def axes(sheet, *names):
    """Axes in order; the second is the main one, ``per`` holds the periods."""
    return [(sheet, i, n, n, i == 1, n == "per") for i, n in enumerate(names)]


def values(df):
    return {(r.sheet_id, tuple(r.coord)): r.value for r in df.collect()}
