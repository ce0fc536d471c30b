"""Period keys ``YYYY-MM``, ``YYYY-Qn``, ``YYYY-Hn`` and ``YYYY-Y`` as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Levels with their ranks, finest first.
LEVELS = {"M": 0, "Q": 1, "H": 2, "Y": 3}


def level(key: Column) -> Column:
    """M, Q, H or Y; null for what is no period key."""
    return (
        F.when(key.rlike(r"^\d{4}-(0[1-9]|1[0-2])$"), "M")
        .when(key.rlike(r"^\d{4}-Q[1-4]$"), "Q")
        .when(key.rlike(r"^\d{4}-H[12]$"), "H")
        .when(key.rlike(r"^\d{4}-Y$"), "Y")
    )


def rank(key: Column) -> Column:
    k = level(key)
    out = F.when(k == "M", 0)
    for name, r in list(LEVELS.items())[1:]:
        out = out.when(k == name, r)
    return out


def key_at(date: Column, at: str) -> Column:
    """Key of the period of level ``at`` that holds a date."""
    y = F.date_format(date, "yyyy")
    tail = {
        "M": F.date_format(date, "MM"),
        "Q": F.concat(F.lit("Q"), F.quarter(date).cast("string")),
        "H": F.concat(F.lit("H"), F.when(F.month(date) <= 6, "1").otherwise("2")),
        "Y": F.lit("Y"),
    }[at]
    return F.concat(y, F.lit("-"), tail)


def start(key: Column) -> Column:
    """First day of the period; null for what is no key."""
    k, tail = level(key), F.substring(key, 6, 2)
    month = (
        F.when(k == "M", tail.try_cast("int"))
        .when(k == "Q", (F.substring(key, 7, 1).try_cast("int") - 1) * 3 + 1)
        .when(k == "H", (F.substring(key, 7, 1).try_cast("int") - 1) * 6 + 1)
        .when(k == "Y", 1)
    )
    return F.when(k.isNotNull(), F.make_date(F.substring(key, 1, 4).try_cast("int"), month, F.lit(1)))


def end(key: Column) -> Column:
    """Last day of the period."""
    k = level(key)
    months = F.when(k == "M", 0).when(k == "Q", 2).when(k == "H", 5).when(k == "Y", 11)
    return F.last_day(F.add_months(start(key), months))


def parent_key(key: Column, levels: tuple[str, ...] = ("M", "Q", "H", "Y")) -> Column:
    """Key of the next coarser level among ``levels``; null at the top."""
    k, day = level(key), start(key)
    order, out = [x for x in LEVELS if x in levels], None
    for low, high in zip(order, order[1:], strict=False):
        out = F.when(k == low, key_at(day, high)) if out is None else out.when(k == low, key_at(day, high))
    return F.lit(None).cast("string") if out is None else out


def sort_key(key: Column) -> Column:
    """Calendar order; within one start the coarser period comes first."""
    return F.struct(start(key).alias("start"), (-rank(key)).alias("coarse"))


# Names of quarters and halves.
QUARTERS = ("1-й квартал", "2-й квартал", "3-й квартал", "4-й квартал")
HALVES = ("1-е полугодие", "2-е полугодие")


def name(key: Column) -> Column:
    """What a period is called: ``Январь 2026``, ``1-й квартал 2026``, ``1-е полугодие 2026`` or ``2026``; other texts stay."""
    k, year = level(key), F.substring(key, 1, 4)
    pick = lambda names, at: F.get(F.array(*map(F.lit, names)), at.try_cast("int") - 1)
    months = [m.capitalize() for m in MONTHS["ru"].split()]
    word = F.when(k == "M", pick(months, F.substring(key, 6, 2))).when(k == "Q", pick(QUARTERS, F.substring(key, 7, 1))).when(k == "H", pick(HALVES, F.substring(key, 7, 1)))
    return F.when(k == "Y", year).when(k.isNotNull(), F.concat(word, F.lit(" "), year)).otherwise(key)


# Month names in headers.
MONTHS = {
    "ru": "январь февраль март апрель май июнь июль август сентябрь октябрь ноябрь декабрь",
    "en": "january february march april may june july august september october november december",
}


def from_header(text: Column) -> Column:
    """Key named by a header cell: a key, an ISO or dd.mm.yyyy date, ``Январь 2026``, ``Q1 2026``, ``1 кв 2026``, ``H1 2026``, ``2026``, ``2026 год``."""
    t = F.lower(F.trim(text))
    year = F.regexp_extract(t, r"(?:^|\D)((?:19|20)\d\d)(?:\D|$)", 1)
    out = (
        F.when(level(F.upper(t)).isNotNull(), F.upper(t))
        .when(t.rlike(r"^\d{4}-\d\d-\d\d"), F.substring(t, 1, 7))
        .when(t.rlike(r"^\d\d\.\d\d\.\d{4}"), F.concat(F.substring(t, 7, 4), F.lit("-"), F.substring(t, 4, 2)))
    )
    names = {n: f"{i:02d}" for each in MONTHS.values() for i, n in enumerate(each.split(), 1)}
    number = F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.regexp_extract(t, f"({'|'.join(names)})", 1))
    out = out.when((year != "") & number.isNotNull(), F.concat(year, F.lit("-"), number))
    quarter, half = F.regexp_extract(t, r"(?:q([1-4])|([1-4])\s*кв)", 0), F.regexp_extract(t, r"(?:h([12])|([12])\s*п)", 0)
    digit = lambda x: F.regexp_extract(x, r"([1-4])", 1)
    out = out.when((year != "") & (quarter != ""), F.concat(year, F.lit("-Q"), digit(quarter)))
    out = out.when((year != "") & (half != ""), F.concat(year, F.lit("-H"), digit(half)))
    return out.when(t.rlike(r"^(19|20)\d\d(\s*(год|г\.?|year))?$"), F.concat(year, F.lit("-Y")))


def from_counter(text: Column, base_year: int, year: Column | None = None) -> Column:
    """Key of ``N год`` (the N-th year from ``base_year``) and of ``Qn``, ``Hn``, ``Yn``, whose ``year`` stands in another row; without one it is ``base_year`` + n."""
    t = F.upper(F.trim(text))
    n = F.regexp_extract(t, r"(\d+)", 1).try_cast("int")
    own = (F.lit(base_year) + n if year is None else F.coalesce(year, F.lit(base_year) + n)).cast("string")
    return (
        F.when(t.rlike(r"^\d{1,2}\s*ГОД$"), F.concat((F.lit(base_year - 1) + n).cast("string"), F.lit("-Y")))
        .when(t.rlike(r"^Y\d+$"), F.concat(own, F.lit("-Y")))
        .when(t.rlike(r"^(Q[1-4]|H[12])$"), F.concat(own, F.lit("-"), t))
    )


def excel_serial(date: Column) -> Column:
    """Days since 1899-12-30, as spreadsheets count."""
    return F.datediff(date, F.lit("1899-12-30").cast("date"))
