"""Value processing while loading: the steps of a format descriptor as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class StepError(ValueError):
    pass


def apply(c: Column, steps: list[dict], df: DataFrame | None = None) -> Column:
    """Applies steps in turn; the result is one value. Steps that can give several keep the first."""
    values = apply_all(c, steps, df)
    return F.element_at(F.when(F.size(values) > 0, values), 1)


def apply_all(c: Column, steps: list[dict], df: DataFrame | None = None) -> Column:
    """Applies steps in turn to one value; the result is an array of all values. A null value is one missing value."""
    values = F.array(c)
    for s in steps:
        values = _step(values, s, df)
    return values


def _each(values: Column, f) -> Column:
    return F.transform(values, f)


def _flat(values: Column, f) -> Column:
    return F.array_distinct(F.flatten(F.transform(values, f)))


def _step(values: Column, s: dict, df: DataFrame | None) -> Column:
    action = s.get("action")
    if action == "replace":
        find, to, keep = s["find"], s.get("replace", ""), s.get("keep", "replaced")
        to = re.sub(r"\\(\d)", r"$\1", to)
        if keep == "all":
            return _flat(values, lambda v: F.array(v, F.regexp_replace(v, find, to)))
        return _each(values, lambda v: F.regexp_replace(v, find, to))
    if action == "default":
        other = F.col(s["field"]).cast("string") if "field" in s else F.lit(s.get("value", ""))
        return _each(values, lambda v: F.when(v.isNull() | (v == ""), other).otherwise(v))
    if action == "append":
        other = F.col(s["field"]).cast("string") if "field" in s else F.lit(s.get("value", ""))
        sep, prefix = s.get("separator", " "), s.get("prefix", "")
        return _each(values, lambda v: F.when(F.coalesce(other, F.lit("")) == "", v).otherwise(F.concat_ws(sep, v, F.concat(F.lit(prefix), other))))
    if action == "split":
        sep, keep = re.escape(s["separator"]) if s.get("literal", True) and len(s["separator"]) == 1 else s.get("separator", ";"), str(s.get("keep", "1"))
        if keep == "all":
            return _flat(values, lambda v: F.split(v, sep))
        if keep == "both":
            return _flat(values, lambda v: F.concat(F.array(v), F.split(v, sep)))
        return _each(values, lambda v: F.coalesce(F.try_element_at(F.split(v, sep), F.lit(int(keep))), F.when(v.isNotNull(), F.lit(""))))
    if action == "strip":
        chars = s.get("chars", " ")
        return _each(values, lambda v: F.btrim(v, F.lit(chars)))
    if action == "parsePos":  # N(a=b,c=d): a feature's value, or the head with the field _
        name = s.get("field", "_")
        if name == "_":
            return _each(values, lambda v: F.regexp_extract(v, r"^\s*([^(]*?)\s*(?:\(.*)?$", 1))
        return _each(values, lambda v: F.regexp_extract(v, rf"[(,|]\s*{re.escape(name)}\s*=\s*([^,|)]*)", 1))
    if action == "chatFormatAgeToMonths":  # years;months.days
        return _each(values, chat_age_to_months)
    if action == "concatDate":
        y, m, d = (F.col(s[f]).cast("string") for f in ("yearField", "monthField", "dayField"))
        return F.array(concat_date(y, m, d, s.get("autofill", "start")))
    if action == "map":
        return _each(values, lambda v: map_values(v, s["table"]))
    if action == "sort":
        return F.sort_array(values)
    if action == "unique":
        return F.array_distinct(values)
    raise StepError(f"unknown step {action}")


def map_values(c: Column, table: dict[str, str]) -> Column:
    """The table's value, or the value itself where the table has none."""
    if not table:
        return c
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(m, c), c)


def chat_age_to_months(c: Column) -> Column:
    """`2;3.10` is 27 months; half a month of days and more rounds up."""
    year = F.regexp_extract(c, r"^(\d+)", 1)
    month = F.regexp_extract(c, r"^\d+;(\d+)", 1)
    day = F.regexp_extract(c, r"^\d+;\d+\.(\d+)", 1)
    num = lambda x: F.when(x == "", 0).otherwise(F.expr("0") + x.try_cast("int"))
    return F.when(year != "", (num(year) * 12 + num(month) + F.when(num(day) >= 15, 1).otherwise(0)).cast("string"))


def concat_date(year: Column, month: Column, day: Column, autofill: str = "start") -> Column:
    """YYYYMMDD; a missing month or day is the first or, with `end`, the last one. An unknown year is null."""
    y = F.when(year.rlike("^[0-9]{1,4}$"), F.lpad(year, 4, "0"))
    end = autofill == "end"
    m = F.when(month.rlike("^(0?[1-9]|1[0-2])$"), F.lpad(month, 2, "0")).otherwise(F.lit("12" if end else "01"))
    last = F.date_format(F.last_day(F.to_date(F.concat(y, m, F.lit("01")), "yyyyMMdd")), "dd")
    d = F.when(day.rlike("^(0?[1-9]|[12][0-9]|3[01])$"), F.lpad(day, 2, "0")).otherwise(last if end else F.lit("01"))
    return F.concat(y, m, d)


def unknown(c: Column, condition: str, value: str) -> Column:
    """The policy for missing metadata: never, missing, empty or missing_or_empty."""
    tests = {"never": F.lit(False), "missing": c.isNull(), "empty": c == "", "missing_or_empty": c.isNull() | (c == "")}
    if condition not in tests:
        raise StepError(f"unknown condition {condition}")
    return F.when(F.coalesce(tests[condition], F.lit(False)), F.lit(value)).otherwise(c)
