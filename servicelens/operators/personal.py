"""Personal data by validated rules: what looks like a number is checked before it counts as one.

Candidates are found by pattern in text columns and then checked: phone numbers by their prefix and length, cards by
Luhn's digit, account numbers by the remainder mod 97, personal numbers by the date in them. A column of numbers is
judged by its header only; keys of any length have neither a prefix nor separators. Where they are text and as long as
a card number, one in ten has Luhn's digit by chance, so a column of bare digits holds cards only if it has far more
of them than that. Whether a column is personal follows from the share of its values that hold something valid.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quality import PII_HEADERS, long_form


class Rule(NamedTuple):
    """What a kind of personal data looks like. `hint` is cheap and holds wherever `pattern` does."""

    hint: Column | str
    pattern: str
    valid: Callable[[Column], Column]


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _numbers(text: Column) -> Column:
    """The characters of a text of digits as numbers."""
    return F.transform(F.split(text, ""), lambda c: c.try_cast("int"))


def luhn(text: Column) -> Column:
    """Whether a number ends with its Luhn digit."""
    figures = F.reverse(F.filter(_numbers(digits(text)), lambda n: n.isNotNull()))
    doubled = F.transform(
        figures, lambda n, i: F.when(i % 2 == 0, n).when(n > 4, 2 * n - 9).otherwise(2 * n)
    )
    return F.aggregate(doubled, F.lit(0), lambda total, n: total + n) % 10 == 0


def mod97(text: Column) -> Column:
    """Whether an account number leaves 1 when divided by 97, its first four characters put last and letters as
    10 to 35.
    """
    bare = F.upper(F.regexp_replace(text, "[^A-Za-z0-9]", ""))
    turned = F.concat(F.substring(bare, 5, 64), F.substring(bare, 1, 4))
    values = F.transform(
        F.filter(F.split(turned, ""), lambda c: c != ""),
        lambda c: F.coalesce(c.try_cast("int"), F.ascii(c) - 55),
    )
    return F.aggregate(values, F.lit(0), lambda rest, v: (rest * F.when(v > 9, 100).otherwise(10) + v) % 97) == 1


def phone_number(text: Column) -> Column:
    """A phone number has 8 digits or more after a plus sign, 10 or more after 00, or 9 to 11 with its trunk 0."""
    n = F.length(digits(text))
    return F.when(text.startswith("+"), n >= 8).when(text.startswith("00"), n >= 10).otherwise(n.between(9, 11))


def personal_number(text: Column) -> Column:
    """A letter, a date as YYMMDD (months of women are 50 higher), three figures, two of them the date's rest, a letter."""
    month, day = (F.substring(text, at, 2).cast("int") for at in (4, 6))
    return ((month % 50).between(1, 12)) & (month < 63) & day.between(1, 31)


# the start of a number that is no part of another one
_ALONE = r"(?<![A-Za-z0-9.+-])(?<![0-9][ /])"

# What candidates look like.
RULES = {
    "email": Rule("@", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", lambda t: F.lit(True)),
    "phone": Rule(
        r"[0-9][0-9 ()./-]{4,}[0-9]",
        r"(?<![A-Za-z0-9.+-])\+[1-9][0-9]{0,2}[ ./-]?\(?[0-9]{2,4}\)?(?:[ ./-]?[0-9]{2,4}){1,3}(?![A-Za-z0-9])"
        rf"|{_ALONE}(?:00[1-9][0-9]{{0,2}}[ ./-]?|\(?0[1-9][0-9]{{0,2}}\)?)(?:[ ./-]?[0-9]{{2,4}}){{2,4}}(?![A-Za-z0-9]| [0-9])",
        phone_number,
    ),
    "id_number": Rule(r"[A-Z][0-9]{8}[A-Z]", r"(?<![A-Za-z0-9])[A-Z][0-9]{8}[A-Z](?![A-Za-z0-9])", personal_number),
    "account": Rule(
        r"[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", mod97
    ),
    "card": Rule(r"[0-9]{4}[ -]?[0-9]{4}", rf"{_ALONE}[1-9][0-9]{{3}}(?:[ -]?[0-9]{{4}}){{2}}[ -]?[0-9]{{1,7}}(?![A-Za-z0-9]| [0-9])", luhn),
}

KINDS = tuple(dict.fromkeys([*PII_HEADERS, *RULES]))

#: In a column of bare digits this share of the values, and so many of them, must be cards for any to count.
BARE_SHARE, BARE_LEAST = 0.5, 10


def found(text: Column, kind: str) -> Column:
    """The valid occurrences of a kind in a text."""
    rule = RULES[kind]
    hinted = text.contains(rule.hint) if rule.hint == "@" else text.rlike(rule.hint)
    candidates = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    return F.when(hinted, F.filter(candidates, rule.valid))


def personal_columns(
    df: DataFrame, min_rate: float = 0.05, columns: Sequence[str] | None = None
) -> DataFrame:
    """(column, kind, given, hits, rate, by_header, flagged): how many values hold valid personal data.

    One pass. Only text is searched; a column of another type is flagged by its header or not at all, and names
    only by the header. A rate is the share of given values; a column without any has rate 0. A text column of nothing
    but bare digits is one of keys, without cards, unless `BARE_SHARE` of its values and `BARE_LEAST` of them are.
    """
    names = list(columns or df.columns)
    types = {f.name: f.dataType for f in df.schema.fields}

    def fields(name: str):
        yield "given", F.count(F.col(name))
        is_text = isinstance(types[name], T.StringType)
        yield "bare", F.count_if(F.ltrim(F.col(name), F.lit("0123456789")) == "") if is_text else F.lit(0).cast("long")
        for kind in RULES:
            if is_text:
                yield kind, F.count_if(F.coalesce(F.size(found(F.col(name), kind)) > 0, F.lit(False)))
            else:
                yield kind, F.coalesce(F.any_value(F.lit(0).cast("long")), F.lit(0).cast("long"))

    wide = long_form(df, {name: list(fields(name)) for name in names})
    rows = []
    for kind in KINDS:
        fits = [n for n in names if kind in PII_HEADERS and re.search(PII_HEADERS[kind], n)]
        header = F.col("column").isin(*fits) if fits else F.lit(False)
        hits = F.col(kind) if kind in RULES else F.lit(0).cast("long")
        if kind == "card":
            few = (hits < BARE_LEAST) | (hits < BARE_SHARE * F.col("given"))
            hits = F.when((F.col("bare") == F.col("given")) & few, F.lit(0).cast("long")).otherwise(hits)
        rate = F.coalesce(F.try_divide(hits.cast("double"), F.col("given").cast("double")), F.lit(0.0))
        rows.append(
            F.struct(
                F.lit(kind).alias("kind"),
                hits.alias("hits"),
                rate.alias("rate"),
                header.alias("by_header"),
                (header | ((hits > 0) & (rate >= min_rate))).alias("flagged"),
            )
        )
    return wide.select("column", "given", F.inline(F.array(*rows)))


def masked(df: DataFrame, columns: Sequence[str], kinds: Sequence[str] = tuple(RULES)) -> DataFrame:
    """The rows with every valid occurrence in some text columns replaced by its kind in brackets."""

    for kind in kinds:  # one step after the other: each text is looked at once for a kind
        spots = {c: F.array_distinct(F.coalesce(found(F.col(c), kind), F.array().cast("array<string>"))) for c in columns}
        label = F.lit(f"[{kind}]")
        df = df.withColumns(
            {c: F.aggregate(spots[c], F.col(c), lambda text, spot: F.replace(text, spot, label)) for c in columns}
        )
    return df
