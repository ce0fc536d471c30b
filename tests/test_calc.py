import itertools
import random

import pytest
from gridloom.operators import calc
from models import PERIODS, axes, model, values


@pytest.fixture(scope="module")
def slices(spark):
    ind = [(10, "ind", None, 0, "Total", None, None)] + [(10 + i, "ind", 10, i, n, None, None) for i, n in ((1, "A"), (2, "B"), (3, "C"))]
    rest = [(20, "dep", None, 0, "D1", None, None), (21, "dep", None, 1, "D2", None, None), (30, "ver", None, 0, "V1", None, None), (31, "ver", None, 1, "V2", None, None)]
    cells = [("s", [p, i, 20, 30], str(v), "manual", None) for p in (2, 3, 4) for i, v in ((11, 10), (12, 20), (13, 30))]
    return model(spark, [("s", "Sheet", None)], axes("s", "per", "ind", "dep", "ver"), PERIODS + ind + rest, cells)


def test_slice_consolidation(slices):
    got = calc.calculate(slices)
    v = values(got.values)
    assert v["s", (2, 10, 20, 30)] == 60 and v["s", (1, 10, 20, 30)] == 180 and v["s", (1, 11, 20, 30)] == 30
    assert not [k for k in v if k[1][2:] != (20, 30)]
    assert {r.value_str for r in calc.changes(got).collect()} == {"60", "180", "30", "90"}


def test_ratio_of_sums_and_precedence(spark):
    ind = [(10, "pl", None, 0, "Partners", None, None), (11, "pl", None, 1, "Loans", None, None), (12, "pl", None, 2, "Mean", None, None)]
    dep = [(20, "dep", None, 0, "D1", None, None), (21, "dep", 20, 0, "D11", None, None), (22, "dep", 20, 1, "D12", None, None)]
    cells = [("s", [2, 10, 21], "10", "manual", None), ("s", [2, 10, 22], "15", "manual", None), ("s", [2, 11, 21], "300", "manual", None), ("s", [2, 11, 22], "375", "manual", None)]
    cells += [("s", [3, 12, 22], None, "formula", "42")]
    rules = [("r1", "s", 12, "consolidation", None, 0, "[Loans] / [Partners]"), ("r2", "s", 12, "leaf", None, 0, "[loans]/[partners]")]
    rules += [("r3", "s", 12, "scoped", {"per": "3"}, 100, "999"), ("r4", "s", 12, "scoped", {}, 500, "1"), ("r5", "s", 12, "scoped", {"per": "3,4"}, 100, "998")]
    got = calc.calculate(model(spark, [("s", "Sheet", None)], axes("s", "per", "pl", "dep"), PERIODS + ind + dep, cells, rules), dense=True)
    v = values(got.values)
    assert v["s", (2, 12, 20)] == 27 and v["s", (1, 12, 20)] == 27 and v["s", (2, 12, 21)] == 30
    assert v["s", (3, 12, 21)] == 999 and v["s", (3, 12, 22)] == 42 and v["s", (4, 12, 21)] == 998
    source = {(tuple(r.coord)): r.source for r in got.values.collect()}
    assert source[3, 12, 22] == "cell" and source[3, 12, 21] == "rule:r3" and source[2, 12, 20] == "rule:r1"
    assert source[2, 10, 20] == "default-sum" and source[2, 10, 21] == "manual"


def test_across_sheets_and_periods(spark):
    periods = [(i, "per", None, i, f"P{i}", None, None) for i in (1, 2, 3)]
    ind = [(10, "par", None, 0, "Rate", None, None), (20, "ras", None, 0, "Delta", None, None), (21, "ras", None, 1, "Back2", None, None), (22, "ras", None, 2, "Same", None, None)]
    cells = [("p", [i, 10], str(100 * i), "manual", None) for i in (1, 2, 3)]
    rules = [
        ("a", "c", 20, "leaf", None, 0, '[Params::rate] - [Params::rate](периоды="предыдущий")'),
        ("b", "c", 21, "leaf", None, 0, '[PRM::rate](периоды="назад(2)")'),
        ("d", "c", 22, "leaf", None, 0, "[nothing] + [Delta]"),
    ]
    ax = axes("p", "per", "par") + axes("c", "per", "ras")
    ax = [(s, i, a, "Периоды" if a == "per" else n, m, p) for s, i, a, n, m, p in ax]
    got = calc.calculate(model(spark, [("p", "Params", "PRM"), ("c", "Calc", None)], ax, periods + ind, cells, rules), dense=True)
    v = values(got.values)
    assert [v["c", (i, 20)] for i in (1, 2, 3)] == [100, 100, 100]
    assert [v["c", (i, 21)] for i in (1, 2, 3)] == [0, 0, 100]
    assert [v["c", (i, 22)] for i in (1, 2, 3)] == [100, 100, 100]
    assert {r.status for r in got.values.where("coord[1] = 22").collect()} == {"unresolved"}


def test_period_key_falls_back_to_the_year(spark):
    months = [(i, "m", None, i, f"M{i}", f"2027-0{i}", None) for i in (1, 2)]
    years = [(5, "y", None, 0, "2027", "2027-Y", None)]
    ind = [(10, "a", None, 0, "Limit", None, None), (20, "b", None, 0, "Use", None, None)]
    ax = [("l", 0, "y", "years", False, True), ("l", 1, "a", "a", True, False), ("u", 0, "m", "months", False, True), ("u", 1, "b", "b", True, False)]
    cells = [("l", [5, 10], "12", "manual", None)]
    got = calc.calculate(model(spark, [("l", "Limits", None), ("u", "Uses", None)], ax, months + years + ind, cells, [("r", "u", 20, "leaf", None, 0, "[Limits::Limit]/12")]), dense=True)
    v = values(got.values)
    assert v["u", (1, 20)] == v["u", (2, 20)] == 1


def test_chain_recursion_cycles_and_kinds(spark):
    ind = [(10, "i", None, 0, "Close", None, None), (11, "i", None, 1, "In", None, None), (12, "i", None, 2, "X", None, None), (13, "i", None, 3, "Y", None, None)]
    ind += [(14, "i", None, 4, "Group A", None, None), (15, "i", 14, 0, "Item", None, 7), (16, "i", None, 5, "Group B", None, None), (17, "i", 16, 0, "Item", None, 9), (18, "i", None, 6, "Pick", None, None), (19, "i", None, 7, "Row", None, None)]
    cells = [("s", [p, 11], str(p), "manual", None) for p in (2, 3, 4)] + [("s", [2, 15], "5", "manual", None), ("s", [2, 17], "8", "manual", None), ("s", [3, 10], "100", "manual", None)]
    rules = [("a", "s", 10, "leaf", None, 0, '[close](per="предыдущий") + [in]'), ("b", "s", 12, "leaf", None, 0, "[y]+1"), ("c", "s", 13, "leaf", None, 0, "[x]+1")]
    rules += [("d", "s", 18, "leaf", None, 0, "[group b][item]"), ("e", "s", 19, "leaf", None, 0, "[item#row9]"), ("f", "s", 10, "consolidation", None, 0, "LAST"), ("g", "s", 11, "consolidation", None, 0, "AVERAGE")]
    got = calc.calculate(model(spark, [("s", "S", None)], axes("s", "per", "i"), PERIODS + ind, cells, rules))
    v = values(got.values)
    # The manual value in the second month stays and is carried on.
    assert [v["s", (p, 10)] for p in (2, 3, 4)] == [2, 100, 104] and v["s", (1, 10)] == 104 and v["s", (1, 11)] == 3
    assert v["s", (2, 18)] == 8 and v["s", (2, 19)] == 8
    assert {r.status for r in got.values.where("coord[1] in (12, 13) and coord[0] > 1").collect()} == {"cycle"} and v["s", (2, 12)] == 0


def test_update_equals_full_calculation(spark, slices):
    base = calc.calculate(slices)
    edits = spark.createDataFrame([("s", [2, 11, 20, 30], 100.0), ("s", [3, 10, 20, 30], 7.0)], "sheet_id string, coord array<bigint>, value double")
    got = values(calc.update(base, edits).values)
    assert got["s", (2, 10, 20, 30)] == 150 and got["s", (1, 10, 20, 30)] == 150 + 7 + 60 and got["s", (1, 11, 20, 30)] == 120
    assert got["s", (3, 10, 20, 30)] == 7
    assert calc.dirty(base.edges, edits).count() == 2 + 4 - 1


def brute(records, cells, order=("per", "main", "other")):
    """Values of a sheet with two axes and default sums, cell by cell."""
    kids = {}
    for r in records:
        kids.setdefault(r[2], []).append(r[0])
    stored = {tuple(c[1]): float(c[2]) for c in cells}

    def value(at):
        if at in stored:
            return stored[at]
        for k in (0, 1):
            if at[k] in kids:
                return sum(value(tuple(c if i == k else x for i, x in enumerate(at))) for c in kids[at[k]])
        return 0.0

    return value


def test_random_cubes_with_overrides(spark):
    rnd = random.Random(4)
    ind = [(10, "i", None, 0, "T", None, None), (11, "i", 10, 0, "U", None, None), (12, "i", 10, 1, "V", None, None), (13, "i", 11, 0, "W", None, None), (14, "i", 11, 1, "Z", None, None)]
    every = list(itertools.product((1, 2, 3, 4), range(10, 15)))
    cells = [("s", list(at), str(rnd.randrange(9)), "manual", None) for at in every if rnd.random() < 0.5]
    got = calc.calculate(model(spark, [("s", "S", None)], axes("s", "per", "i"), PERIODS + ind, cells))
    value = brute(PERIODS + ind, cells)
    for (_, at), v in values(got.values).items():
        assert v == value(at), at
