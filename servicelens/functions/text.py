"""Display text as column expressions: numbers, months, periods, templates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space that trimming removes (includes the no-break space and the BOM).
SPACE = r"[\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"

# Month abbreviations, January to December.
SHORT_MONTHS = {
    "sq": ["jan", "shk", "mar", "pri", "maj", "qer", "korr", "gush", "sht", "tet", "nën", "dhj"],
    "en": ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"],
}

# Month names, January to December.
LONG_MONTHS = {
    "sq": ["janar", "shkurt", "mars", "prill", "maj", "qershor",
           "korrik", "gusht", "shtator", "tetor", "nëntor", "dhjetor"],
    "en": ["January", "February", "March", "April", "May", "June",
           "July", "August", "September", "October", "November", "December"],
}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _visible(c: Column) -> Column:
    """Whether a text starts with a visible ASCII character: no pattern has to look for white space there."""
    return F.ascii(c).between(33, 126)


def not_blank(c: Column | str) -> Column:
    return _visible(col(c)) | ~col(c).rlike(f"^{SPACE}*$")


def trim_all(c: Column | str) -> Column:
    c = col(c)
    ends = _visible(c) & _visible(F.substring(c, -1, 1))
    return F.when(ends, c).otherwise(F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", ""))


def is_blank(c: Column | str) -> Column:
    return trim_all(c) == ""


def normalize_header(c: Column | str) -> Column:
    return F.lower(trim_all(c))


def normalize_question(c: Column | str) -> Column:
    """Trim, lower, then drop closing punctuation; white space before it stays."""
    return F.regexp_replace(F.lower(trim_all(c)), r"[?!.]+$", "")


def by_locale(locale: Column | str, sq: Column, en: Column) -> Column:
    """`locale` is a literal name or a column; every locale but `sq` reads as English."""
    if isinstance(locale, str):
        return sq if locale == "sq" else en
    return F.when(locale == "sq", sq).otherwise(en)


def format_decimal(c: Column | str, locale: Column | str, digits: int = 0) -> Column:
    """1248.5 with one digit: `1.248,5` in Albanian, `1,248.5` in English.

    Rounds half up. `format_number` alone rounds half to even, so the rounding comes first. The
    sign is put on apart, which keeps `-0.0` for a small negative.
    """
    value = col(c).cast("double")
    body = F.format_number(F.round(F.abs(value), digits), digits)
    text = by_locale(locale, F.translate(body, ",.", ".,"), body)
    return F.when(value.isNotNull(), F.concat(F.when(value < 0, "-").otherwise(""), text))


def signed(c: Column | str, locale: Column | str, digits: int = 1) -> Column:
    value = col(c)
    return F.concat(F.when(value >= 0, "+").otherwise(""), format_decimal(value, locale, digits))


def _month_name(month: Column | str, locale: Column | str, names: Mapping[str, list[str]]) -> Column:
    def pick(key: str) -> Column:
        return F.element_at(F.array(*[F.lit(n) for n in names[key]]), col(month).cast("int"))

    return by_locale(locale, pick("sq"), pick("en"))


def month_label(month: Column | str, locale: Column | str) -> Column:
    return _month_name(month, locale, SHORT_MONTHS)


def month_name(month: Column | str, locale: Column | str) -> Column:
    return _month_name(month, locale, LONG_MONTHS)


def source_date(date: Column | str, locale: Column | str) -> Column:
    """2026-09-18 in Albanian: `18 sht`."""
    return F.concat_ws(" ", F.dayofmonth(col(date)), month_label(F.month(col(date)), locale))


def period_label(period: Column | str, locale: Column | str, n_days: int = 24) -> Column:
    """The first `n_days` of the month that starts at `period`: `1-24 September 2026`."""
    day = col(period)
    return F.concat(
        F.lit(f"1-{n_days} "), month_name(F.month(day), locale), F.lit(" "), F.year(day).cast("string")
    )


def fill(template: Column | str, values: Mapping[str, Column]) -> Column:
    """Replace each `{name}` in the template."""
    text = col(template)
    for name, value in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), value.cast("string"))
    return text


def label_empty(c: Column | str, label: Column | str) -> Column:
    """Show a missing or empty cell as `label`."""
    shown = F.lit(label) if isinstance(label, str) else label
    return F.coalesce(F.nullif(col(c), F.lit("")), shown)


def round_half_up(c: Column | str) -> Column:
    """Nearest whole number, halves towards positive infinity."""
    return F.floor(col(c) + F.lit(0.5)).cast("long")
