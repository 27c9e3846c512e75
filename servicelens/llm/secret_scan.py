"""Secret scan of whole texts with DataFrame functions only.

Three kinds are found by pattern: assignments, access key ids and runs of hex digits. A fourth, entropy,
comes from candidate strings: a window slides over each, the counts of its characters are kept up to
date by the one that enters and the one that leaves, and the string is a secret if the Shannon entropy
of some window reaches the threshold of the string's character class. Strings on the allow list, and
those that touch a span found by pattern, add nothing.

Positions come from splitting a text at a pattern: the lengths of the pieces between matches and of the
matches add up to code points.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from servicelens.llm.common import read

# The base patterns and the least length of what they must match.
ASSIGN = (
    r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
LEAST_VALUE = 12

KINDS = ["assign", "access", "hex", "entropy"]
#: Matches whose places are made together.
BLOCK = 256
#: Counts of a window: bits of each, and how many share a number.
COUNT_BITS, FIELDS = 5, 12
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20


class CharacterClass(NamedTuple):
    """Strings made of `alphabet` whose windows reach `threshold` bits per character are secrets."""

    pattern: str
    alphabet: str
    threshold: float


# the first class that a string belongs to judges it
CLASSES = [
    CharacterClass(r"^[0-9A-Fa-f]+$", "0123456789ABCDEFabcdef", 3.0),
    CharacterClass(
        r"^[A-Za-z0-9+/_=-]+$",
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-",
        3.9,
    ),
]

#: Candidates that match one of these are no secrets: words without a digit, numbers, UUIDs, sequences
#: of the alphabet, placeholders, paths of words.
ALLOWED = [
    r"^[^0-9]*$",
    r"^[^A-Za-z]*$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i:abcdefghij|0123456789|example|sample|placeholder|xxxx)",
    r"^/?([A-Za-z]+[0-9]{0,4}[/_=-])+[A-Za-z]*[0-9]{0,4}/?$",
]

#: The same where Java would recurse at every turn of a repeated group: what the group takes it keeps, which gives
#: the same matches, as a word, its digits and the sign after them can be told apart in one way only.
_POSSESSIVE = {
    r"^/?([A-Za-z]+[0-9]{0,4}[/_=-])+[A-Za-z]*[0-9]{0,4}/?$": (
        r"^/?(?:[A-Za-z]++[0-9]{0,4}+[/_=-])++[A-Za-z]*+[0-9]{0,4}+/?$"
    )
}

MASK = "[secret]"


def _matches(text: Column, pattern: str) -> Column:
    """(gap, size, value, gap_bytes) of all matches of a pattern: the characters before each since the last one.

    Matches are ASCII, so that their bytes are as many as their characters.
    """
    between = F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.slice(between, 1, F.size(values)).alias("gap"), values.alias("value"))
    return F.transform(
        pairs,
        lambda p: F.struct(
            F.length(p["gap"]).alias("gap"),
            F.length(p["value"]).alias("size"),
            p["value"].alias("value"),
            F.octet_length(p["gap"]).alias("gap_bytes"),
        ),
    )


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once, however often it occurs."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(items: Column, first: Column, step: Callable, shown: Callable, empty: Column) -> Column:
    """`shown(state, item)` of every item, where `step(state, item)` makes the state that the next one sees.

    Items are taken in blocks of `BLOCK` that begin with the states at their first items, so that an array of
    very many items does not copy ever longer results. `empty` is an empty array of the results' type.
    """
    blocks = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int"))

    def block(b: Column) -> Column:
        return F.slice(items, b * BLOCK + 1, F.lit(BLOCK))

    def after(state: Column, b: Column) -> Column:
        at = F.aggregate(block(b), state["at"], step)
        return F.struct(at.alias("at"), F.concat(state["starts"], F.array(state["at"])).alias("starts"))

    def inside(state: Column, item: Column) -> Column:
        row = F.array(shown(state["at"], item))
        return F.struct(step(state["at"], item).alias("at"), F.concat(state["rows"], row).alias("rows"))

    none = F.slice(F.array(first), 1, 0)
    starts = F.aggregate(
        blocks, F.struct(first.alias("at"), none.alias("starts")), after, lambda state: state["starts"]
    )
    rows = F.transform(
        starts,
        lambda at, b: F.aggregate(
            block(b), F.struct(at.alias("at"), empty.alias("rows")), inside, lambda state: state["rows"]
        ),
    )
    return F.when(F.size(items) > 0, F.flatten(rows)).otherwise(empty)


_SPAN = "struct<start:int,kind:int,end:int,from:int,to:int,value:string>"


def _found(matches: str, kind: int) -> Column:
    """(start, kind, end, from, to, value) of the matches in a column, left to right; from and to count bytes."""

    def step(at: Column, m: Column) -> Column:
        return F.struct(
            (at["start"] + m["gap"] + m["size"]).alias("start"), (at["from"] + m["gap_bytes"] + m["size"]).alias("from")
        )

    def span(at: Column, m: Column) -> Column:
        start, from_ = at["start"] + m["gap"], at["from"] + m["gap_bytes"]
        return F.struct(
            start.alias("start"),
            F.lit(kind).alias("kind"),
            (start + m["size"]).alias("end"),
            from_.alias("from"),
            (from_ + m["size"]).alias("to"),
            m["value"].alias("value"),
        )

    first = F.struct(F.lit(0).alias("start"), F.lit(0).alias("from"))
    return _running(F.col(matches), first, step, span, F.expr(f"cast(array() as array<{_SPAN}>)"))


def _untouched(candidates: Column, others: Column) -> Column:
    """The candidates that overlap no span of `others`.

    Both together are passed over from the left, with the furthest end of the others so far, and from the right,
    with the nearest start, so that many of both take no longer than their number.
    """
    none = F.expr("cast(array() as array<int>)")

    def free(both: Column) -> Column:
        reach = lambda at, s: F.when(s["kind"] < 3, F.greatest(at, s["end"])).otherwise(at)
        following = lambda at, s: F.when(s["kind"] < 3, s["start"]).otherwise(at)
        seen = lambda at, s: at
        ends = _running(both, F.lit(-1), reach, seen, none)
        starts = _let(F.reverse(both), lambda back: _running(back, F.lit((1 << 31) - 1), following, seen, none))
        placed = F.arrays_zip(both.alias("span"), ends.alias("reach"), F.reverse(starts).alias("next"))
        kept = F.filter(
            placed,
            lambda p: (p["span"]["kind"] == 3) & (p["reach"] <= p["span"]["start"]) & (p["next"] >= p["span"]["end"]),
        )
        return F.transform(kept, lambda p: p["span"])

    return F.when((F.size(candidates) == 0) | (F.size(others) == 0), candidates).otherwise(
        _let(F.array_sort(F.concat(candidates, others)), free)
    )


def _weights(window: int) -> list[int]:
    """c log2 c in millionths for c from 0 on, so that sums are whole numbers."""
    return [round(c * math.log2(c) * 1e6) if c else 0 for c in range(window + 1)]


def _limit(threshold: float, window: int) -> int:
    """A window's entropy is log2(window) - sum / window: this sum or less reaches the threshold."""
    return math.floor((math.log2(window) - threshold) * window * 1e6)


def _least_sum(value: Column, alphabet: str, window: int) -> Column:
    """The least sum of c log2 c over all windows of a string, by incremental counts.

    The characters become numbers once. Each is met beside the one that leaves the window as it enters. The counts
    are fields of 5 bits in a few whole numbers, of which a step changes two.
    """
    if window >= 1 << COUNT_BITS:
        raise ValueError(f"windows have fewer than {1 << COUNT_BITS} characters")
    weights = F.array(*[F.lit(w).cast("long") for w in _weights(window)])
    codes = F.transform(
        F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.instr(F.lit(alphabet), c) - 1
    )
    words = -(-len(alphabet) // FIELDS)

    def moves(code: Column) -> Column:
        """Those of all characters: entering and leaving word, shift and unit."""
        shift = lambda c: c % FIELDS * COUNT_BITS
        unit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), shift(c))
        word = lambda c: F.floor(c / FIELDS).cast("int")
        left = F.concat(F.array_repeat(F.lit(-1), window), code)
        pairs = F.zip_with(code, F.slice(left, F.lit(1), F.size(code)), lambda e, x: F.struct(e.alias("e"), x.alias("x")))
        return F.transform(
            pairs,
            lambda p, i: F.struct(
                word(p["e"]).alias("ew"), shift(p["e"]).alias("es"), unit(p["e"]).alias("eu"),
                F.when(p["x"] >= 0, word(p["x"])).otherwise(F.lit(-1)).alias("xw"),
                F.when(p["x"] >= 0, shift(p["x"])).otherwise(F.lit(0)).alias("xs"),
                F.when(p["x"] >= 0, unit(p["x"])).otherwise(F.lit(0).cast("long")).alias("xu"),
                (p["e"] == p["x"]).alias("same"), (i + 1 >= window).alias("full"),
            ),
        )

    def count(counts: Column, word: Column, shift: Column) -> Column:
        field = F.call_function("shiftrightunsigned", F.get(counts, word), shift)
        return field.bitwiseAND(F.lit((1 << COUNT_BITS) - 1)).cast("int")

    def step(state: Column, m: Column) -> Column:
        counts = state["counts"]
        weight = lambda c: F.get(weights, c)
        gain = _let(count(counts, m["ew"], m["es"]), lambda c: weight(c + 1) - weight(c))
        loss = _let(count(counts, m["xw"], m["xs"]), lambda c: weight(c - 1) - weight(c))
        change = gain + F.when(m["xw"] >= 0, loss).otherwise(F.lit(0).cast("long"))
        moved = F.transform(
            counts,
            lambda c, k: c
            + F.when(k == m["ew"], m["eu"]).otherwise(F.lit(0).cast("long"))
            - F.when(k == m["xw"], m["xu"]).otherwise(F.lit(0).cast("long")),
        )
        return _let(
            state["total"] + F.when(m["same"], F.lit(0).cast("long")).otherwise(change),
            lambda total: F.struct(
                moved.alias("counts"),
                total.alias("total"),
                F.when(m["full"], F.least(state["least"], total)).otherwise(state["least"]).alias("least"),
            ),
        )

    start = F.struct(
        F.array_repeat(F.lit(0).cast("long"), words).alias("counts"),
        F.lit(0).cast("long").alias("total"),
        F.lit(1 << 62).cast("long").alias("least"),
    )
    return _let(codes, lambda code: F.aggregate(moves(code), start, step, lambda state: state["least"]))


def _is_secret(value: Column, window: int) -> Column:
    verdict = F.lit(False)
    for kind in reversed(CLASSES):
        dense = _least_sum(value, kind.alphabet, window) <= _limit(kind.threshold, window)
        verdict = F.when(value.rlike(kind.pattern), dense).otherwise(verdict)
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | value.rlike(_POSSESSIVE.get(pattern, pattern))
    return ~allowed & verdict


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    shown = F.transform(
        spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    )
    return F.array_join(shown, ",")


def with_spans(docs: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """`docs` with __base and __spans: arrays of (start, kind, end), by start and kind. Null texts are empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    patterns = {"__assign": ASSIGN, "__access": ACCESS, "__hex": HEX, "__candidates": CANDIDATE}
    matched = docs.select("*", *[_matches(text, p).alias(c) for c, p in patterns.items()])
    found = matched.select(
        *docs.columns,
        F.filter(
            _found("__assign", 0),
            lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= LEAST_VALUE,
        ).alias("__assign"),
        _found("__access", 1).alias("__access"),
        _found("__hex", 2).alias("__hex"),
        _found("__candidates", 3).alias("__candidates"),
    )
    bare = lambda s: F.struct(*[s[c].alias(c) for c in ("start", "kind", "end", "from", "to")])
    base = F.array_sort(F.transform(F.concat("__assign", "__access", "__hex"), bare))
    found = found.select(*docs.columns, "__assign", "__candidates", base.alias("__base"))
    # an access key or a hex run that a candidate touches lies inside it
    dense = F.filter(
        "__candidates",
        lambda c: ~c["value"].rlike(ACCESS) & ~c["value"].rlike(HEX) & _is_secret(c["value"], window),
    )
    found = found.select(
        *docs.columns, "__base", F.transform(dense, bare).alias("__dense"), F.transform("__assign", bare).alias("__assign")
    )
    added = _untouched(F.col("__dense"), F.col("__assign"))
    return found.select(*docs.columns, "__base", F.array_sort(F.concat("__base", added)).alias("__spans"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: `id_col` and spans, an array of (kind, start, end) in code points.

    A null or empty text has no spans. Spans of different kinds may overlap; of one kind they do not.
    Null ids stay, repeated rows come back as often as they are there, an empty table gives an empty
    result; other columns, whatever their names, are not read. No shuffle and no Python.
    """
    names = F.array(*map(F.lit, KINDS))
    named = lambda s: F.struct(F.get(names, s["kind"]).alias("kind"), s["start"], s["end"])
    narrow = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    return with_spans(narrow, "__text").select(
        F.col("__id").alias(id_col), F.transform("__spans", named).alias("spans"), "__base", "__spans"
    )


def mask_secrets(docs: DataFrame, text_col: str = "text", mask: str = MASK) -> DataFrame:
    """`docs` with every span of its text replaced by `mask`; overlapping spans become one.

    Texts without a span, null and empty ones stay as they are; all columns stay.
    """

    def piece(data: Column) -> Callable:
        """What stands between the end of the spans so far and a span, with the mask; nothing if they overlap."""

        def before(reach: Column, span: Column) -> Column:
            gap = F.substring(data, reach + 1, span["from"] - reach).cast("string")
            return F.when(span["from"] >= reach, F.concat(gap, F.lit(mask))).otherwise(F.lit(""))

        return before

    def masked_text(data: Column) -> Column:
        furthest = lambda reach, span: F.greatest(reach, span["to"])
        pieces = _running(
            F.col("__spans"), F.lit(0), furthest, piece(data), F.expr("cast(array() as array<string>)")
        )
        reach = F.aggregate("__spans", F.lit(0), furthest)
        rest = F.substring(data, reach + 1, F.octet_length(data)).cast("string")
        return F.concat(F.array_join(pieces, ""), rest)

    # bytes are cut out where they are; characters would be counted from the start for every span
    data = F.col(text_col).cast("binary")
    masked = F.when(F.size("__spans") > 0, _let(data, masked_text)).otherwise(F.col(text_col))
    return with_spans(docs, text_col).select(
        *[masked.alias(c) if c == text_col else F.col(c) for c in docs.columns]
    )


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(read(spark, sf_dir, "documents"))

    def number(kind: str) -> Column:
        at = KINDS.index(kind)
        return F.size(F.filter("__base", lambda s: s["kind"] == at)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        number("assign"),
        number("access"),
        number("hex"),
        F.sha2(_listed(F.col("__base")), 256).alias("base_sha256"),
        _listed(F.col("__spans")).alias("spans"),
    )


def _oracle() -> str:
    """The scan in SQL: the same patterns, windows counted anew instead of kept up to date."""
    words = "|".join(
        "".join(c if c in "_?" else f"[{c.upper()}{c}]" for c in word)
        for word in ("password", "passwd", "secret", "token", "api_?key")
    )
    assign = rf"(?:{words})[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
    patterns = [assign, ACCESS, HEX, CANDIDATE]
    hits = " UNION ALL ".join(
        f"""SELECT doc_id, {kind} AS kind, gaps, hits FROM (SELECT doc_id,
          string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}') AS hits FROM d) WHERE len(hits) > 0"""
        for kind, p in enumerate(patterns)
    )
    weights = ", ".join(map(str, _weights(WINDOW)))
    judged = " ".join(
        f"WHEN regexp_matches(value, '{c.pattern}') THEN least <= {_limit(c.threshold, WINDOW)}" for c in CLASSES
    )
    allowed = " OR ".join(f"regexp_matches(value, '{p}')" for p in ALLOWED)
    names = ", ".join(f"'{k}'" for k in KINDS)
    listed = f"string_agg([{names}][kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
hits AS ({hits}),
parts AS (
  SELECT doc_id, kind, unnest(hits) AS value, unnest(list_slice(gaps, 1, len(hits))) AS gap,
    generate_subscripts(hits, 1) AS i
  FROM hits
), placed AS (
  SELECT doc_id, kind, value, length(value) AS n, CAST(sum(length(gap) + length(value)) OVER
    (PARTITION BY doc_id, kind ORDER BY i) AS BIGINT) AS e
  FROM parts
), spans AS (
  SELECT doc_id, kind, value, e - n AS s, e FROM placed
  WHERE kind <> 0 OR length(regexp_extract(value, '{assign}', 1)) >= {LEAST_VALUE}
), base AS (SELECT * FROM spans WHERE kind < 3),
free AS (
  SELECT * FROM spans c WHERE kind = 3 AND NOT EXISTS (
    SELECT 1 FROM base b WHERE b.doc_id = c.doc_id AND b.s < c.e AND c.s < b.e)
), windows AS (
  SELECT doc_id, s, e, value, unnest(range(1, length(value) - {WINDOW} + 2)) AS w FROM free
), chars AS (
  SELECT doc_id, s, e, value, w, unnest(string_split(substring(value, w, {WINDOW}), '')) AS c FROM windows
), counted AS (
  SELECT doc_id, s, e, value, w, c, count(*) AS n FROM chars GROUP BY ALL
), sums AS (
  SELECT doc_id, s, e, value, w, sum([{weights}][n + 1]) AS total FROM counted GROUP BY ALL
), least AS (SELECT doc_id, s, e, value, min(total) AS least FROM sums GROUP BY ALL),
added AS (
  SELECT doc_id, 3 AS kind, s, e FROM least
  WHERE NOT ({allowed}) AND CASE {judged} ELSE false END
), listed AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
    count(*) FILTER (kind = 2) AS n_hex, {listed} AS base FROM base GROUP BY doc_id
), shown AS (
  SELECT doc_id, {listed} AS spans
  FROM (SELECT doc_id, kind, s, e FROM base UNION ALL SELECT doc_id, kind, s, e FROM added) GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
  coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN listed USING (doc_id) LEFT JOIN shown USING (doc_id)
"""


OP4_SQL = _oracle()
