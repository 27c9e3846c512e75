"""Random small files against a plain reading of the rules."""

import os
import random

import pytest

from servicelens.sources import exports as csv

ALPHABET = ['"', '"', ",", ",", "\n", "\r", "\r\n", " ", "a", "b", "1", '""', "\n", '","', 'x"\n"', '"\n', "é"]


def read_cell(text, i):
    """(value, quoted, next position); raises on a quote where none may be."""
    if text[i : i + 1] == '"':
        value, i = "", i + 1
        while True:
            close = text.find('"', i)
            if close < 0:
                raise ValueError("format")
            value, i = value + text[i:close], close + 1
            if text[i : i + 1] != '"':
                break
            value, i = value + '"', i + 1
        if text[i : i + 1] not in ("", ",", "\r", "\n"):
            raise ValueError("format")
        return value, True, i
    end = min([k for k in (text.find(c, i) for c in ',\r\n"') if k >= 0], default=len(text))
    if text[end : end + 1] == '"':
        raise ValueError("format")
    return text[i:end], False, end


def read_file(text):
    i, records = 0, []
    while i < len(text):
        cells, any_quoted = [], False
        while True:
            value, quoted, i = read_cell(text, i)
            cells.append(value)
            any_quoted |= quoted
            if text[i : i + 1] != ",":
                break
            i += 1
        i += 2 if text[i : i + 2] == "\r\n" else 1
        if len(cells) > 1 or any_quoted or cells[0].strip():
            records.append(cells)
    if len(records) < 2:
        raise ValueError("empty")
    header = [h.strip() for h in records[0]]
    if "" in header or len({h.lower() for h in header}) < len(header):
        raise ValueError("headers")
    if any(len(r) != len(header) for r in records):
        raise ValueError("format")
    return header, records[1:]


def make_text(rng):
    style = rng.random()
    if style < 0.5:
        return "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(0, 14)))

    def cell():
        kind = rng.random()
        if kind < 0.5:
            return rng.choice(["a", "", " ", "1 2", "é"])
        return '"' + rng.choice(["", "x", 'y""z', "l\nm", "l\r\nm", "c,d", '""', " "]) + '"'

    width = rng.randrange(1, 4)
    lines = [",".join(f"h{i}" for i in range(width))]
    for _ in range(rng.randrange(1, 5)):
        lines.append(",".join(cell() for _ in range(width if rng.random() < 0.9 else width + 1)))
    return "".join(line + rng.choice(["\n", "\n", "\r\n", "\r"]) for line in lines)


@pytest.mark.parametrize("block", [None, 7, 40])
def test_random_files(spark, tmp_path, block):
    """Files read whole, and read in blocks of a few bytes."""
    rng = random.Random(int(os.environ.get("RANDOM_SEED", 20)))
    folder = tmp_path / "files"
    folder.mkdir()
    expected = {}
    for n in range(int(os.environ.get("RANDOM_FILES", 200))):
        content = make_text(rng)
        (folder / f"f{n}.csv").write_text(content, encoding="utf-8", newline="")
        try:
            expected[f"f{n}.csv"] = ("ok", *read_file(content))
        except ValueError as problem:
            expected[f"f{n}.csv"] = (str(problem), None, None)
    if block:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        records = csv.land_records(
            spark,
            str(folder),
            str(tmp_path / "landed"),
            csv.FileLimits(),
            split_above=csv.SPLIT_ABOVE if block is None else 0,
        )
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    verdicts = csv.file_verdict(spark, str(folder), records=records)
    rows = {}
    for r in csv.data_records(records, verdicts).orderBy("file", "pos").collect():
        rows.setdefault(r.file.rsplit("/", 1)[1], []).append(r.cells)
    got = {
        r.name: (r.verdict, r.header if r.verdict == "ok" else None, rows.get(r.name))
        for r in verdicts.collect()
    }
    wrong = {
        n: ((folder / n).read_bytes(), got.get(n), expected[n]) for n in expected if got.get(n) != expected[n]
    }
    assert not wrong, f"{len(wrong)} files differ: {list(wrong.items())[:8]}"
    assert len({v for v, _, _ in expected.values()}) == 4
