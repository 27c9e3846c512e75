"""Column mapping by assignment: every header is scored for every field, and a file's best assignment is taken.

A score is made of the header's words, compared with the names a field goes by, and of how the column's values fit
the field. Fields and columns are matched one to one so that the scores add up to the most; a field whose share in
that is too low stays without a column.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trim_all
from ..session import share_package


class Field(NamedTuple):
    """`kind` says what its values look like: `key`, `date`, `choice` (few different ones) or `text`."""

    kind: str
    names: tuple[str, ...]


# What the fields of a request are called in headers, in Albanian and English.
FIELDS: dict[str, Field] = {
    "id": Field("key", ("id", "request id", "request number", "case number", "numri i kerkeses", "number kerkeses")),
    "department": Field("choice", ("department", "department name", "directorate", "drejtoria", "sektori", "office")),
    "status": Field("choice", ("status", "statusi", "status code", "state", "gjendja")),
    "created_at": Field("date", ("created", "created at", "date", "opened on", "data", "data e hapjes", "date opened")),
    "note": Field("text", ("note", "notes", "comment", "description", "shenim", "shenime", "pershkrimi")),
}

# Short forms in headers.
SHORT = {"dept": "department", "dep": "department", "nr": "number", "no": "number", "num": "number", "req": "request", "dt": "date"}

NAME_WEIGHT, VALUE_WEIGHT = 0.7, 0.3
#: Scores below this are no column of the field, whatever else is left.
LEAST_SCORE = 0.55
#: Words less alike than this have nothing in common.
LEAST_ALIKE = 0.6
#: More fields than this would make a file's assignment slow.
MOST_FIELDS = 12


def header_words(header: Column) -> Column:
    """The words of a header: lower case, without accents, short forms written out."""
    parted = F.regexp_replace(header, "([a-z0-9])([A-Z])", "$1 $2")
    plain = F.translate(F.lower(parted), "ëçéèáàíóúüö", "eceeaaiouuo")
    words = F.filter(F.split(plain, "[^a-z0-9]+"), lambda w: w != "")
    short = F.create_map(*[F.lit(x) for pair in SHORT.items() for x in pair])
    return F.transform(words, lambda w: F.coalesce(F.element_at(short, w), w))


def _alike(a: Column, b: Column) -> Column:
    """How alike two words are, from 0 to 1, by what must be changed."""
    share = 1.0 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))
    return F.when(share >= LEAST_ALIKE, share).otherwise(F.lit(0.0))


def name_score(words: Column, names: Sequence[str]) -> Column:
    """The best agreement of a header's words with one of a field's names: of each word of either the most alike
    in the other, averaged.
    """

    def agreement(some: Column, others: Column) -> Column:
        """Of each word the most alike among the others, added up."""
        most = F.transform(
            some, lambda w: F.coalesce(F.array_max(F.transform(others, lambda o: _alike(w, o))), F.lit(0.0))
        )
        return F.aggregate(most, F.lit(0.0), lambda total, x: total + x)

    scores = []
    for name in names:
        wanted = F.array(*[F.lit(w) for w in name.split()])
        both = agreement(wanted, words) + agreement(words, wanted)
        scores.append(both / (F.size(wanted) + F.size(words)))
    return F.greatest(*scores) if len(scores) > 1 else scores[0]


def value_profile(records: DataFrame) -> DataFrame:
    """(file, position, key, date, choice, text): how well the values of each column fit each kind, 0 to 1.

    `records(file, cells)` are data rows. One aggregation over all of them; tasks leave a row per file and column.
    """
    cells = records.select("file", F.posexplode("cells").alias("position", "cell"))
    value = F.nullif(trim_all("cell"), F.lit(""))
    given = cells.select("file", "position", value.alias("v")).where(F.col("v").isNotNull())
    number = F.avg(F.col("v").rlike("^[0-9]+$").cast("double"))
    date = F.avg(F.col("v").rlike(r"^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4})").cast("double"))
    seen = given.groupBy("file", "position").agg(
        number.alias("_number"), date.alias("date"), F.count("*").alias("_n"), F.approx_count_distinct("v").alias("_different")
    )
    share = F.least(F.col("_different") / F.col("_n"), F.lit(1.0))
    words = (1.0 - F.col("_number")) * (1.0 - F.col("date"))
    return seen.select(
        "file",
        "position",
        (F.col("_number") * share).alias("key"),
        "date",
        (words * (1.0 - share)).alias("choice"),
        words.alias("text"),
    )


def score_matrix(headers: DataFrame, values: DataFrame, fields: Mapping[str, Field] = FIELDS) -> DataFrame:
    """(file, position, field, score) of every header and field. A column without values fits nothing."""
    words = headers.select("file", "position", header_words(F.col("header")).alias("words"))
    known = words.join(values, ["file", "position"], "left")
    scored = [
        F.struct(
            F.lit(name).alias("field"),
            F.round(
                NAME_WEIGHT * name_score(F.col("words"), field.names) + VALUE_WEIGHT * F.coalesce(F.col(field.kind), F.lit(0.0)), 9
            ).alias("score"),
        )
        for name, field in fields.items()
    ]
    return known.select("file", "position", F.inline(F.array(*scored)))


def best_assignment(scores: Mapping[tuple[int, str], float], fields: Sequence[str], least: float) -> dict[str, int]:
    """The column of each field that has one: no column twice, scores of at least `least`, the largest sum; of equal
    sums that with columns further left.
    """
    columns = sorted({position for position, _ in scores})
    # by the set of fields that have a column so far: the best sum, and the choices that give it
    best: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
    for position in columns:
        for taken, (total, chosen) in list(best.items()):
            for i, field in enumerate(fields):
                score = scores.get((position, field), 0.0)
                if taken >> i & 1 or score < least:
                    continue
                now = (total + score, (*chosen, (field, position)))
                if (taken | 1 << i) not in best or now[0] > best[taken | 1 << i][0] + 1e-12:
                    best[taken | 1 << i] = now
    return dict(max(best.values(), key=lambda b: round(b[0], 9))[1])


def assign_mapping(
    headers: DataFrame,
    values: DataFrame,
    fields: Mapping[str, Field] = FIELDS,
    least: float = LEAST_SCORE,
) -> DataFrame:
    """(file, field, column_index, score) as `propose_mapping` gives, -1 and 0 for a field without a column.

    A file is one row of its matrix, headers times fields, in the task that solves it.
    """
    names = list(fields)
    if len(names) > MOST_FIELDS:
        raise ValueError(f"at most {MOST_FIELDS} fields are assigned")
    matrix = score_matrix(headers, values, fields)
    rows = matrix.groupBy("file").agg(F.collect_list(F.struct("position", "field", "score")).alias("scores"))
    share_package(headers.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                scores = {(s["position"], s["field"]): s["score"] for s in row["scores"]}
                chosen = best_assignment(scores, names, least)
                out += [(row["file"], n, chosen.get(n, -1), scores[chosen[n], n] if n in chosen else 0.0) for n in names]
            columns = list(zip(*out, strict=True)) or [()] * 4
            kinds = (pa.string(), pa.string(), pa.int32(), pa.float64())
            arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.record_batch(arrays, ["file", "field", "column_index", "score"])

    return rows.mapInArrow(work, "file string, field string, column_index int, score double")
