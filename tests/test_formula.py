import pytest
from gridloom.functions import formula, numbers
from gridloom.functions.formula import FormulaError, Param, Ref, parse, references
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def one(spark):
    return spark.createDataFrame([(6.0, 3.0, None, 0.0)], "a double, b double, m double, z double")


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("42", 42), ("[a]+[b]*2", 12), ("([a]+[b])*2", 18), ("-[a]-[b]", -9), ("--[a]", 6), ("[a]/[b]", 2), ("[a]/[z]", 0), ("[a]/[m]", 0), ("[m]+1", 1),
        ("[a]>[b]", 1), ("[a]<=[b]", 0), ("[a]=[a]", 1), ("[a]==6", 1), ("[a]!=6", 0), ("[a]<>5", 1), ("1<2<3", 1), ("IF([a]>5, [b], 0)", 3), ("if([m]; 1; 2)", 2),
        ("SUM([a],[m],[b])", 9), ("AVERAGE([a],[m],[b])", 4.5), ("AVERAGE([m])", 0), ("MIN([a],[m])", 0), ("MAX([a],[b],7)", 7), ("ABS(-[a])", 6),
        ("INT(2.9)", 2), ("INT(-2.1)", -3), ("INT(0.1*3*10)", 3), ("ROUND(2.5)", 3), ("ROUND(1.005,2)", 1.0), ("ROUND(-2.5)", -3), ("ROUND(12345,-2)", 12300), (" .5 * 4 ", 2),
    ],
)
def test_values(one, text, expected):
    assert one.select(formula.over_columns(text)).first()[0] == pytest.approx(expected, abs=1e-12)


def test_references():
    r = references(parse('[Sheet 1::Income [net]](Периоды="назад(3)"; Версия=Факт) + [A][b][C#row12] - [x](периоды=x.вперед(2), key=key)'))
    assert r[0] == Ref(("income [net]",), "sheet 1", None, (Param("периоды", shift=-3), Param("версия", member="факт")))
    assert r[1] == Ref(("a", "b", "c"), None, 12)
    assert r[2].params == (Param("периоды", shift=2),)
    assert references(parse("[a]+[a]")) == [Ref(("a",))]
    assert references(parse('[a](периоды="Предыдущий")'))[0].params == (Param("периоды", shift=-1),)


@pytest.mark.parametrize("text", ["", "[a", "1 +", "FOO(1)", "IF(1,2)", "(1", "1 2", "[a](x)", "[]", "a$b", "ABS(1,2)"])
def test_errors(text):
    with pytest.raises(FormulaError):
        parse(text)


def test_numbers(spark):
    rows = [("1e3",), ("5d",), ("",), (None,), ("1 234,5",), ("-12x.5.1",), ("abc",), (" 7 ",)]
    df = spark.createDataFrame(rows, "t string")
    t = F.col("t")
    got = df.select(numbers.parsed(t), numbers.parsed_local(t), numbers.parsed_lenient(t)).collect()
    assert [r[0] for r in got] == [1000, None, None, None, None, None, None, 7]
    assert got[4][1] == 1234.5 and got[5][2] == -12.51 and got[6][2] is None and got[1][2] == 5
    text = spark.createDataFrame([(60.0,), (0.0,), (-1e-9,), (12345678.25,), (0.1234567,), (None,)], "x double").select(numbers.as_text(F.col("x")))
    assert [r[0] for r in text.collect()] == ["60", "0", "0", "12345678.25", "0.123457", None]


def test_large_numbers_to_text(spark):
    whole = [8204944758120, 2792107597620, 2924850821580, 2751520163940, -2751520163940, 2**53]
    df = spark.createDataFrame([(float(x),) for x in whole] + [(4500000000.123457,), (2792107597620.25,)], "x double")
    assert [r[0] for r in df.select(numbers.as_text(F.col("x"))).collect()] == [str(x) for x in whole] + ["4500000000.123457", "2792107597620.25"]


def test_older_dialect():
    old = "если [a].[b] == 1 то 5 иначе_если [c] > 2 то [d]*2 иначе 7 конец_если + 1"
    assert formula.from_legacy(old) == "IF([a][b] == 1, 5, IF([c] > 2, [d]*2, 7)) + 1"
    assert formula.parse(formula.from_legacy(old)) == formula.parse("IF([a][b]=1,5,IF([c]>2,[d]*2,7))+1")
    assert formula.from_legacy("[x] + 1") == "[x] + 1"
    with pytest.raises(formula.FormulaError):
        formula.from_legacy("если [a] то 1")


@pytest.mark.parametrize("text", ["[x]+[y]", "[y]*2-[x]", "([x]-1)*[y]+[x]/4", "SUM([x],[y],3)", "-([x]+[y])", "[y]/0+[x]"])
def test_linear_forms(spark, text):
    node, values = formula.parse(text), {"y": 3.0}
    known = lambda r: F.lit(values[r.chain[-1]])
    a, b = formula.linear_in(node, formula.Ref(("x",)), known)
    for x in (0.0, 2.5, -7.0):
        values["x"] = x
        row = spark.range(1).select((a * x + b).alias("got"), formula.to_column(node, known).alias("want")).first()
        assert row.got == pytest.approx(row.want)


@pytest.mark.parametrize("text", ["[x]*[x]", "ABS([x])", "1/[x]", "IF([x],1,2)", "MAX([x],[y])", "[y]+1"])
def test_not_linear(text):
    assert formula.linear_in(formula.parse(text), formula.Ref(("x",)), lambda r: F.lit(1.0)) is None
