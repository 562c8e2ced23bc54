"""Keyword scanning with character positions, width-insensitive through NFKC."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duewise.functions.rates import col

# Category, keywords.
VIOLATION_WORDS = {
    "威胁恐吓": ["起诉你", "拘留", "坐牢", "警察上门", "法院传票", "强制执行"],
    "冒充司法": ["我是法院", "我是公安", "司法拍卖", "检察院"],
    "骚扰第三方": ["联系你家人", "找你家人", "告诉你同事", "找你单位", "联系你亲属", "找你亲属", "联系你父母", "找你朋友"],
    "诱导新贷": ["借新还旧", "先贷款还款", "再借一笔"],
    "辱骂侮辱": ["骗子", "老赖", "无耻", "不要脸", "废物"],
}


def _make_compat_form():
    """Built inside a function so that it travels to the executors by value."""

    def compat(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import unicodedata

        import pandas as pd

        class Compat(dict):
            """Code point to its NFKC form, filled as characters are met."""

            def __missing__(self, code):
                self[code] = form = unicodedata.normalize("NFKC", chr(code))
                return form

        table = Compat()
        for batch in texts:
            forms, origins = [], []
            for text in batch:
                form = text.translate(table) if isinstance(text, str) else None
                if form is None or form == text:
                    forms.append(None)
                    origins.append(None)
                    continue
                forms.append(form)
                origins.append(
                    None if len(form) == len(text)
                    else [i for i, ch in enumerate(text) for _ in table[ord(ch)]]
                )
            yield pd.DataFrame({"text": forms, "origin": origins})

    # Real types, not the strings that postponed annotations leave: workers cannot resolve those.
    compat.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    form = T.StructType([
        T.StructField("text", T.StringType()), T.StructField("origin", T.ArrayType(T.IntegerType())),
    ])
    return F.pandas_udf(compat, form)


# Character-wise NFKC; null when the text does not change. ``origin`` gives the source position of every
# output character and is null when the form kept one character per character.
compat_form = _make_compat_form()


def needs_compat(text: Column) -> Column:
    """Only text outside ASCII can change, so only that is sent to Python."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), text)


def dictionary_entries(words: dict[str, list[str]]) -> Column:
    """The keyword list as an array of (category, keyword, normalised keyword)."""
    return F.array(*(
        F.struct(
            F.lit(category).alias("category"), F.lit(word).alias("keyword"),
            F.lit(unicodedata.normalize("NFKC", word)).alias("needle"),
        )
        for category, group in words.items() for word in group
    ))


def running_sums(values: Column) -> Column:
    """Sum of each element of an int array and all before it, by doubling: the array is rewritten log2(size) times."""
    turns = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + 1)).cast("int"))

    def turn(sums: Column, k: Column) -> Column:
        back = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(sums, lambda x, i: x + F.coalesce(F.get(sums, i - back), F.lit(0)))

    return F.aggregate(turns, values, turn)


def occurrences(text: Column | str, needle: Column) -> Column:
    """0-based positions of the non-overlapping occurrences of ``needle``, left to right.

    Work grows with the text and with hits times their logarithm, also where a very long text is full of hits.
    """
    t = col(text)
    size = F.length(needle)
    parts = F.split(t, F.concat(F.lit(r"\Q"), needle, F.lit(r"\E")), F.lit(-1))
    steps = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda part: F.length(part) + size)
    return F.transform(running_sums(steps), lambda end: end - size)


def violations(text: Column, origin: Column, entries: Column) -> Column:
    """Sorted array of (position, category, keyword); positions refer to the source text."""
    present = F.filter(entries, lambda e: F.contains(text, e["needle"]))
    found = F.flatten(F.transform(present, lambda e: F.transform(
        occurrences(text, e["needle"]),
        lambda at: F.struct(
            F.coalesce(F.get(origin, at), at).alias("position"), e["category"].alias("category"), e["keyword"].alias("keyword")
        ),
    )))
    return F.array_sort(found)


def risk_level(count: Column | str) -> Column:
    c = col(count)
    return F.when(c == 0, "clean").when(c <= 2, "medium").otherwise("high")


def fixed(value: Column | str, digits: int = 2, signed: bool = False, grouped: bool = False) -> Column:
    """Decimal text, rounded half to even on the exact value; optional plus sign and thousands separators."""
    v = col(value)
    out = F.format_number(v, digits)
    if not grouped:
        out = F.replace(out, F.lit(","), F.lit(""))
    return F.concat(F.when(v >= 0, "+").otherwise(""), out) if signed else out


def money(value: Column | str) -> Column:
    """Thousands separators; two decimals unless the amount is whole."""
    v = F.coalesce(col(value).cast("double"), F.lit(0.0))
    return F.when(v == F.floor(v), fixed(v, 0, grouped=True)).otherwise(fixed(v, 2, grouped=True))


def percent(value: Column | str, signed: bool = False) -> Column:
    return F.coalesce(F.concat(fixed(col(value) * 100, 2, signed), F.lit("%")), F.lit("N/A"))


def magnitude(value: Column | str, signed: bool = False) -> Column:
    """Small numbers as percent, larger ones with thousands separators."""
    v = col(value)
    return F.when(v.isNull(), "N/A").when(F.abs(v) <= 1, percent(v, signed)).otherwise(fixed(v, 2, signed, grouped=True))


def normalize_case_id(value: Column | str) -> Column:
    """``CASE-1`` becomes ``CASE00000001``; anything else is only trimmed."""
    raw = F.trim(col(value))
    digits = F.regexp_extract(raw, r"^CASE-(\d+)$", 1)
    number = F.regexp_replace(digits, r"^0+(?=\d)", "")
    padded = F.when(F.length(number) >= 8, number).otherwise(F.lpad(number, 8, "0"))
    return F.when(digits != "", F.concat(F.lit("CASE"), padded)).otherwise(raw)


def case_id_in(text: Column | str) -> Column:
    """First case id mentioned in a text, in upper case; null when there is none."""
    found = F.upper(F.regexp_extract(col(text), r"(?i)\b(CASE-?\d+)\b", 1))
    return F.when(found != "", found)


QUOTES = ["“([^”]+)”", "\"([^\"]+)\"", "‘([^’]+)’", "'([^']+)'"]  # fixed values, in order of preference


def quoted_in(text: Column | str) -> Column:
    """First quoted passage, looking for each kind of quote in turn; null when there is none."""
    found = [F.regexp_extract(col(text), pattern, 1) for pattern in QUOTES]
    return F.trim(F.coalesce(*(F.when(f != "", f) for f in found)))


def is_metric_code(value: Column | str) -> Column:
    return col(value).rlike(r"^[a-z][a-z0-9_]*$")


def fill_template(template: Column | str, values: dict[str, Column]) -> Column:
    """Replace ``{name}`` placeholders by column values."""
    out = col(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out
