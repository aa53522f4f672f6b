"""Reading typed values out of the many spellings of literals, entirely as Catalyst expressions.

Each reader gives the value as text in its canonical form, or null where the
text cannot be read as the type.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for "not known".
PLACEHOLDERS = ("", "-", "--", "–", "—", "?", "??", "n/a", "na", "n.a.", "none", "null", "nil", "nan", "tba", "tbd", "tbc", "unknown", "not known", "to be confirmed", "to be announced", "see notes", "...", "…")
TRUE, FALSE = ("true", "t", "yes", "y", "1", "1.0"), ("false", "f", "no", "n", "0", "0.0")
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
MONTH = r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"


def literal_text(col: Column) -> Column:
    """The text of a literal: quotes, language tag and data type removed, outer blanks trimmed."""
    t = F.regexp_replace(col, r"^\s+|\s+$", "")
    t = F.regexp_replace(t, r'(?s)^"(.*)"(?:@[A-Za-z][A-Za-z0-9-]*|\^\^\S+)?$', "$1")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def is_placeholder(text: Column) -> Column:
    return F.lower(text).isin(*PLACEHOLDERS)


def _pick(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group)


def read_string(text: Column) -> Column:
    """Underscores as blanks, runs of blanks as one, trimmed; placeholders give null."""
    t = F.trim(F.regexp_replace(F.replace(text, F.lit("_"), F.lit(" ")), r"[\s ]+", " "))
    return F.when(~is_placeholder(t), t)


def read_date(text: Column) -> Column:
    """yyyy-mm-dd from ISO dates and date-times, yyyymmdd, '4 Sep 1926' and 'September 4, 1926'; impossible days give null."""
    t = F.lower(text)
    iso, packed = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?:[t ].*)?$", r"^(\d{4})(\d{2})(\d{2})$"
    day_first, month_first = rf"^(\d{{1,2}})(?:st|nd|rd|th)?\.?\s+{MONTH},?\s+(\d{{4}})$", rf"^{MONTH}\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})$"
    made = lambda y, m, d: F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d, 2, "0"))
    out = (
        F.when(t.rlike(iso), made(_pick(t, iso, 1), _pick(t, iso, 2), _pick(t, iso, 3)))
        .when(t.rlike(packed), made(_pick(t, packed, 1), _pick(t, packed, 2), _pick(t, packed, 3)))
        .when(t.rlike(day_first), made(_pick(t, day_first, 3), _month_number(_pick(t, day_first, 2)), _pick(t, day_first, 1)))
        .when(t.rlike(month_first), made(_pick(t, month_first, 3), _month_number(_pick(t, month_first, 1)), _pick(t, month_first, 2)))
    )
    return F.date_format(F.try_to_date(out, "yyyy-MM-dd"), "yyyy-MM-dd")


def _month_number(short: Column) -> Column:
    return ((F.instr(F.lit(MONTHS), short) + 2) / 3).cast("int")


def read_minutes(text: Column) -> Column:
    """Whole minutes from 139, '139.0', '101 min', '2 h 15 min', 'PT100M' and 'PT1H40M'."""
    t = F.lower(text)
    plain, iso = r"^(\d+)(?:\.0+)?\s*(?:m|min|mins|minute|minutes)?\.?$", r"^pt(?:(\d+)h)?(?:(\d+)m)?(?:\d+s)?$"
    hours = r"^(\d+)\s*(?:h|hr|hrs|hour|hours)\.?\s*(?:(\d+)\s*(?:m|min|mins|minute|minutes)?\.?)?$"
    part = lambda p, k: F.coalesce(_pick(t, p, k).try_cast("bigint"), F.lit(0))
    out = (
        F.when(t.rlike(plain), _pick(t, plain, 1).try_cast("bigint"))
        .when(t.rlike(iso) & (t != "pt"), part(iso, 1) * 60 + part(iso, 2))
        .when(t.rlike(hours), part(hours, 1) * 60 + part(hours, 2))
    )
    return out.try_cast("int").cast("string")


def read_money(text: Column) -> Column:
    """Whole units from plain, grouped, decimal, scientific, '$1,700,000', 'US$ 1.4M' and '0.4 million' amounts."""
    t = F.regexp_replace(F.lower(text), r"[, ]", "")
    form = r"^(?:us|usd)?\s*[$€£]?\s*(?:usd)?\s*(\d+(?:\.\d+)?)(?:e\+?(\d{1,2}))?\s*(k|thousand|m|mn|mio|million|b|bn|billion)?(?:\s*(?:usd|dollars|us\$|\$|€|£))?$"
    unit = _pick(t, form, 3)
    power = F.coalesce(_pick(t, form, 2).try_cast("int"), F.lit(0))
    factor = (
        F.when(unit.isin("k", "thousand"), 3).when(unit.isin("m", "mn", "mio", "million"), 6).when(unit.isin("b", "bn", "billion"), 9).otherwise(0) + power
    )
    scaled = F.round(_pick(t, form, 1).try_cast("decimal(24,6)") * F.rpad(F.lit("1"), factor + 1, F.lit("0")).try_cast("decimal(14,0)"), 0)
    return F.when(t.rlike(form), scaled.try_cast("bigint").cast("string"))


def read_score(text: Column) -> Column:
    """One decimal place from '9.8', '9,8', '9.80', '9.8/10' and '9.8 / 10'."""
    form = r"^(\d{1,2}(?:[.,]\d+)?)\s*(?:/\s*10)?$"
    value = F.replace(_pick(text, form, 1), F.lit(","), F.lit(".")).try_cast("decimal(20,10)")
    return F.when(text.rlike(form), F.round(value, 1).try_cast("decimal(3,1)").cast("string"))


def read_boolean(text: Column) -> Column:
    t = F.lower(text)
    return F.when(t.isin(*TRUE), F.lit("true")).when(t.isin(*FALSE), F.lit("false"))


#: Reader per type name of the attribute list.
READERS = {
    "date": read_date,
    "int": read_minutes,
    "bigint": read_money,
    "decimal(3,1)": read_score,
    "boolean": read_boolean,
    "string": read_string,
}
