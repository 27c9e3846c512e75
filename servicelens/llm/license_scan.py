"""License scan by ordered signature rules.

A text becomes its words, lower case, each between two blanks of its own, so that a rule matches whole words
and neighbours share no blank. An automaton over the rules' keywords tells which rules can match at all; only
those are searched for. Detections are intervals of words. One that lies within an interval of a rule of a
smaller level, or within a longer one of its own level, is suppressed: "GNU General Public License, version 3"
is gpl-3.0 and not the plain name as well.

Base phrases are found on the same words. They are no rules: nothing suppresses them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from servicelens.llm.common import map_arrow, read, sliced
from servicelens.llm.license_rules import CONFIDENCE, NAME, Rule, signature_rules

# The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
BASE_CONFIDENCE = CONFIDENCE[NAME]

#: Longer texts are cut into words part by part.
PART_BYTES = 1 << 20

_LETTERS = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B))
# A-Z become lower case, all other characters up to 0x7F that are no digits or letters become blanks
_WORDS = bytes(
    c if c in _LETTERS or c > 0x7F else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256)
)


class Detection(NamedTuple):
    start: int  # words
    end: int  # exclusive
    rule: int


def spaced(words: str) -> str:
    """A phrase or pattern as it appears in `normalized`."""
    return f" {words.replace(' ', '  ')} "


def normalized(text: bytes) -> str:
    """The words of a text, each between two blanks; bytes beyond ASCII become one character each."""
    text = text.translate(_WORDS)
    parts, start = [], 0
    while start < len(text):
        stop = text.find(b" ", start + PART_BYTES)
        stop = len(text) if stop < 0 else stop
        if words := text[start:stop].split():
            parts.append(b" " + b"  ".join(words) + b" ")
        start = stop
    return b"".join(parts).decode("latin-1")


def _words_before(words: str, places: list[int]) -> Iterator[int]:
    """The number of words before each of the ascending `places`."""
    at = count = 0
    for place in places:
        count += words.count(" ", at, place)
        at = place
        yield count // 2


def phrase_places(words: str, phrase: str) -> list[int]:
    """The first word of every place where the words of a phrase stand one after the other."""
    wanted, places, at = spaced(phrase), [], -1
    while (at := words.find(wanted, at + 1)) >= 0:
        places.append(at)
    return list(_words_before(words, places))


class Scanner:
    def __init__(self, rules: list[Rule]):
        self.rules = rules
        self.patterns: dict[int, re.Pattern] = {}
        self.keywords = ahocorasick.Automaton()
        by_keyword: dict[str, list[int]] = {}
        for i, rule in enumerate(rules):
            by_keyword.setdefault(rule.keyword.replace(" ", "  "), []).append(i)
        for keyword, of in by_keyword.items():
            self.keywords.add_word(keyword, of)
        if rules:
            self.keywords.make_automaton()

    def candidates(self, words: str) -> list[int]:
        """The rules whose keyword is in the text."""
        if not self.rules:
            return []
        found = {id(of): of for _, of in self.keywords.iter(words)}
        return sorted(i for of in found.values() for i in of)

    def pattern(self, rule: int) -> re.Pattern:
        """Compiled when first needed: few texts need more than a few of the rules."""
        if rule not in self.patterns:
            self.patterns[rule] = re.compile(spaced(self.rules[rule].pattern))
        return self.patterns[rule]

    def all_detections(self, words: str) -> list[Detection]:
        found = []
        for i in self.candidates(words):
            spans = [m.span() for m in self.pattern(i).finditer(words)]
            starts = list(_words_before(words, [a for a, _ in spans]))
            sizes = [words.count(" ", a, b) // 2 for a, b in spans]
            found += [Detection(s, s + n, i) for s, n in zip(starts, sizes, strict=True)]
        return found

    def detections(self, words: str) -> list[Detection]:
        """Detections that no other suppresses, by place."""
        by_level: dict[int, list[Detection]] = {}
        for d in self.all_detections(words):
            by_level.setdefault(self.rules[d.rule].level, []).append(d)
        kept: list[Detection] = []
        for level in sorted(by_level):
            kept += _outside(_longest(by_level[level]), kept)
        return sorted(kept)


def _longest(found: list[Detection]) -> list[Detection]:
    """Those within no other one; of equal intervals the one of the first rule stays."""
    kept, reach = [], -1
    for d in sorted(found, key=lambda d: (d.start, -d.end, d.rule)):
        if d.end > reach:
            kept.append(d)
            reach = d.end
    return kept


def _outside(found: list[Detection], kept: list[Detection]) -> list[Detection]:
    """Those of `found` within no interval of `kept`."""
    if not kept:
        return found
    starts, ends = np.array(sorted((d.start, d.end) for d in kept)).T
    reach = np.maximum.accumulate(ends)
    before = np.searchsorted(starts, [d.start for d in found], side="right") - 1
    return [d for d, i in zip(found, before.tolist(), strict=True) if i < 0 or reach[i] < d.end]


@cache
def default_scanner() -> Scanner:
    return Scanner(signature_rules())


DETECTIONS = "array<struct<label:string,start:int,end:int,base:boolean,confidence:double>>"
_KIND = pa.list_(
    pa.struct(
        [("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("confidence", pa.float64())]
    )
)


def detect(text: bytes, scanner: Scanner, base: dict[str, str]) -> tuple[int, list[dict]]:
    """The number of words of a text and its detections, base phrases first."""
    words = normalized(text)
    found = []
    for phrase, label in base.items():
        size = phrase.count(" ") + 1
        found += [(label, s, s + size, True, BASE_CONFIDENCE) for s in phrase_places(words, phrase)]
    found.sort(key=lambda d: d[1:3])
    for start, end, i in scanner.detections(words):
        found.append((scanner.rules[i].label, start, end, False, scanner.rules[i].confidence))
    names = ("label", "start", "end", "base", "confidence")
    return words.count(" ") // 2, [dict(zip(names, d, strict=True)) for d in found]


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rules: list[Rule] | None = None,
    base: dict[str, str] | None = None,
) -> DataFrame:
    """One row per document: `id_col`, n_words long, detections.

    A detection has a label, the words from start to before end, whether it is a base phrase, and a
    confidence. Base phrases are all there, also where they overlap; rules are subject to suppression.
    A null or empty text has no words. Null ids stay, repeated rows come back as often as they are there, an
    empty table gives an empty result; other columns, whatever their names, are not read. No shuffle; a
    task holds the texts of a slice, and of one text twice its size.
    """
    phrases = BASE if base is None else base
    id_type = docs.select(id_col).schema[0].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = default_scanner() if rules is None else Scanner(rules)
        for batch in sliced(batches, "text"):
            found = [detect(t or b"", scanner, phrases) for t in batch.column("text").to_pylist()]
            yield pa.record_batch(
                [
                    batch.column("id"),
                    pa.array([n for n, _ in found], pa.int64()),
                    pa.array([d for _, d in found], _KIND),
                ],
                ["id", "n_words", "detections"],
            )

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return map_arrow(narrow, work, f"id {id_type}, n_words long, detections {DETECTIONS}").withColumnRenamed("id", id_col)


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(read(spark, sf_dir, "documents"))
    base = F.filter("detections", lambda d: d["base"])
    starts = F.transform(base, lambda d: d["start"].cast("long"))
    listed = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda d: d["label"]))), ",")
    confidence = F.array_max(F.transform("detections", lambda d: d["confidence"]))
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        listed(base).alias("base_labels"),
        listed(F.col("detections")).alias("labels"),
        F.coalesce(confidence, F.lit(0.0)).alias("score"),
    )


def _oracle() -> str:
    """The scan in SQL: each rule on every text that has its keyword, intervals compared with each other."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    base = [(label, spaced(p), spaced(p), -1, BASE_CONFIDENCE) for p, label in BASE.items()]
    rules = [(r.label, r.keyword.replace(" ", "  "), spaced(r.pattern), r.level, r.confidence) for r in signature_rules()]
    listed = ", ".join(
        f"({i}, {quoted(label)}, {quoted(keyword)}, {quoted(pattern)}, {level}, CAST({confidence} AS DOUBLE))"
        for i, (label, keyword, pattern, level, confidence) in enumerate(base + rules)
    )
    return f"""
WITH rules(rule, label, keyword, pattern, level, confidence) AS (VALUES {listed}),
words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), d AS (
  SELECT row_number() OVER () AS k, doc_id, len(w) AS n_words,
    CASE WHEN len(w) > 0 THEN ' ' || array_to_string(w, '  ') || ' ' ELSE '' END AS t
  FROM words
), hits AS (
  SELECT k, rule, label, level, confidence, string_split_regex(t, pattern) AS gaps, regexp_extract_all(t, pattern) AS found
  FROM d JOIN rules ON contains(t, keyword)
), parts AS (
  SELECT k, rule, label, level, confidence, unnest(found) AS value, unnest(list_slice(gaps, 1, len(found))) AS gap,
    generate_subscripts(found, 1) AS i
  FROM hits WHERE len(found) > 0
), sized AS (
  SELECT *, (len(value) - len(replace(value, ' ', ''))) // 2 AS n, (len(gap) - len(replace(gap, ' ', ''))) // 2 AS g FROM parts
), spans AS (
  SELECT *, CAST(sum(g + n) OVER (PARTITION BY k, rule ORDER BY i) AS BIGINT) AS e FROM sized
), kept AS (
  SELECT k, label, level, confidence, e - n AS s FROM spans x
  WHERE level = -1 OR NOT EXISTS (
    SELECT 1 FROM spans y WHERE y.k = x.k AND y.level >= 0 AND y.level <= x.level
      AND y.e - y.n <= x.e - x.n AND y.e >= x.e
      AND (y.level < x.level OR y.n > x.n OR y.rule < x.rule))
), shown AS (
  SELECT k, count(*) FILTER (level = -1) AS n_base, min(s) FILTER (level = -1) AS first_word,
    max(s) FILTER (level = -1) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (level = -1) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(confidence) AS score
  FROM kept GROUP BY k
)
SELECT doc_id, n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM d LEFT JOIN shown USING (k)
"""


OP13_SQL = _oracle()
