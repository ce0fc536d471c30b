"""Text helpers: matching rules, names, transliteration, language, colours, JSON properties."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of one letter, and letters of several.
_ONE = ("абвгдезийклмнопрстуфыэ", "abvgdeziyklmnoprstufye")
_MORE = {"ё": "yo", "ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ь": "", "ю": "yu", "я": "ya"}


def normalized(name: Column) -> Column:
    """Lower case, points and commas as spaces, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"[.,]", " "), r"\s+", " "))


def transliterated(name: Column) -> Column:
    """A code from a name: Latin letters, digits and single underscores."""
    x = F.translate(F.lower(F.trim(name)), *_ONE)
    x = reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), _MORE.items(), x)
    return F.regexp_replace(F.regexp_replace(x, r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def language(text: Column, least: float = 0.3) -> Column:
    """``ru`` if at least that share of the letters is Cyrillic, else ``en``."""
    count = lambda p: F.regexp_count(text, F.lit(p)).cast("double")
    return F.when(F.coalesce(F.try_divide(count("[а-яА-ЯёЁ]"), count("[a-zA-Zа-яА-ЯёЁ]")), F.lit(0.0)) >= least, "ru").otherwise("en")


def matches(text: Column, kind: str, values: list[str], sheet: Column | None = None, bold: Column | None = None, fill: Column | None = None, deeper: Column | None = None) -> Column:
    """A matching rule of the import knowledge base, by lower-cased, trimmed text; regular expressions take either case.

    ``sheet_title`` holds for the name of the sheet, ``formatting`` for ``bold`` or ``colored_bg`` rows, ``indent_increase`` for rows indented more than the one above.
    """
    t, low = F.lower(F.trim(text)), [v.lower() for v in values]
    any_ = lambda tests: reduce(lambda a, b: a | b, tests, F.lit(False))
    given = lambda c: F.lit(False) if c is None else c
    title = F.lower(F.trim(sheet)) if sheet is not None else F.lit(None).cast("string")
    kinds = {
        "exact_lower": lambda: t.isin(low),
        "regex": lambda: any_([text.rlike(f"(?iu){v}") for v in values]),
        "contains_any": lambda: any_([t.contains(v) for v in low]),
        "ends_with": lambda: any_([t.endswith(v) for v in low]),
        "starts_with_any": lambda: any_([t.startswith(v) for v in low]),
        "sheet_title": lambda: (t == title) | (t == F.replace(title, F.lit(" "), F.lit(""))),
        "formatting": lambda: any_([given(bold) if v == "bold" else given(fill).isNotNull() if v == "colored_bg" and fill is not None else F.lit(False) for v in low]),
        "indent_increase": lambda: given(deeper),
    }
    if kind not in kinds:
        raise ValueError(f"unknown kind of rule: {kind}")
    return F.coalesce(kinds[kind](), F.lit(False))


def name_candidates(names: Column) -> Column:
    """Names under which a chain of ancestors (top first) may be written: each tail alone and joined by ``. ``."""
    n = F.size(names)
    return F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(names, n - k + 1, k), ". "))


# What the theme's colours are called; the others count as none.
THEME = {3: "dark gray", 4: "blue", 5: "orange", 6: "green", 7: "yellow", 8: "teal", 9: "purple"}

# Colours by ranges of red, green and blue and how far blue stays below red; the first that fits counts.
COLOURS = (
    ("yellow", (201, 255), (201, 255), (0, 99), -255),
    ("beige/light yellow", (201, 255), (181, 255), (0, 149), 61),
    ("red/pink", (201, 255), (0, 149), (0, 149), -255),
    ("green", (0, 149), (201, 255), (0, 149), -255),
    ("blue", (0, 149), (0, 149), (201, 255), -255),
    ("orange", (201, 255), (151, 255), (0, 99), -255),
)


def colour_name(fill: Column) -> Column:
    """Name of a cell's fill, ``theme:<n>`` or RRGGBB or AARRGGBB; null for white, black and what is next to white, ``#RRGGBB`` for colours without a name."""
    hex6 = F.upper(F.right(fill, F.lit(6)))
    r, g, b = (F.conv(F.substring(hex6, i, 2), 16, 10).cast("int") for i in (1, 3, 5))
    theme = F.create_map(*[F.lit(x) for kv in THEME.items() for x in kv])
    within = lambda x, low, high: (x >= low) & (x <= high)
    named = F.when(hex6.isin("FFFFFF", "000000") | (F.least(r, g, b) > 240), F.lit(None).cast("string"))
    for name, red, green, blue, below in COLOURS:
        named = named.when(within(r, *red) & within(g, *green) & within(b, *blue) & (r - b >= below), name)
    named = named.otherwise(F.concat(F.lit("#"), hex6))
    return F.when(fill.startswith("theme:"), F.try_element_at(theme, F.substring_index(fill, ":", -1).try_cast("int"))).when(fill.rlike("^([0-9A-Fa-f]{2})?[0-9A-Fa-f]{6}$"), named)


def is_input_fill(fill: Column) -> Column:
    """Whether a fill marks an input: yellow or beige."""
    return F.coalesce(colour_name(fill).isin("yellow", "beige/light yellow"), F.lit(False))


def json_list(json: Column) -> Column:
    """Texts of a JSON list, null where it isn't one."""
    return F.from_json(json, "array<string>")


def scope_map(json: Column) -> Column:
    """A rule's scope from its JSON text; members of an axis are listed by commas or as a JSON list."""
    own = F.from_json(json, "map<string,string>")
    return F.transform_values(own, lambda k, v: F.when(v.startswith("["), F.array_join(json_list(v), ",")).otherwise(v))


def cache_key(*parts: Column) -> Column:
    """SHA-256 of parts that are told apart by a separator no part is expected to hold."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"), 256)


def shown(number: Column, digits: int = 2, percent: bool = False) -> Column:
    """A number as it is shown: digits grouped by no-break spaces, a comma as decimal point, percent values times 100 with their sign."""
    x = F.format_number(number * 100 if percent else number, digits)
    local = F.translate(x, ",.", "\u00a0,")
    return F.concat(local, F.lit("%")) if percent else local


def prop(json: Column, path: str) -> Column:
    return F.get_json_object(json, path)


def with_prop(json: Column, key: str, value: Column) -> Column:
    """A flat JSON object of texts with one property set."""
    own = F.map_filter(F.coalesce(F.from_json(json, "map<string,string>"), F.create_map().cast("map<string,string>")), lambda k, v: k != key)
    return F.to_json(F.map_concat(own, F.create_map(F.lit(key), value.cast("string"))))
