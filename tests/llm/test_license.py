"""The license scan against plain searches."""

import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from servicelens.llm import license_scan as ls
from servicelens.llm.license_rules import Rule, signature_rules

RULES = signature_rules()


def slow_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def slow_base(words):
    places = []
    for phrase, label in ls.BASE.items():
        wanted = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(wanted)] == wanted]
    return places


def slow_detections(words, rules):
    """Every rule on every text; an interval goes if one of a stronger rule holds it."""
    text = "".join(f" {w} " for w in words)
    found = []
    for number, rule in enumerate(rules):
        for m in re.finditer(" " + rule.pattern.replace(" ", "  ") + " ", text):
            start = text.count(" ", 0, m.start()) // 2
            found.append((start, start + m[0].count(" ") // 2, number))

    def beaten(d):
        return any(
            o[0] <= d[0] and o[1] >= d[1] and rules[o[2]].level <= rules[d[2]].level
            and (rules[o[2]].level < rules[d[2]].level or o[1] - o[0] > d[1] - d[0] or o[2] < d[2])
            for o in found
        )

    return sorted(d for d in found if not beaten(d))


def test_there_are_hundreds_of_rules():
    assert len(RULES) > 300 and len({r.label for r in RULES}) > 100
    assert [r.level for r in RULES] == sorted(r.level for r in RULES)


@settings(max_examples=1500, database=None, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.sampled_from(RULES).flatmap(lambda r: st.tuples(st.just(r.keyword), st.from_regex(r.pattern, fullmatch=True))))
def test_every_match_holds_its_keyword(example):
    keyword, text = example
    assert keyword and keyword in text


CASES = {
    "Licensed under the Apache License, Version 2.0.": {"apache-2.0"},
    "This work is licensed under the GNU General Public License, version 3.": {"gpl-3.0"},
    "Released under the MIT License.": {"mit"},
    "Licensed under CC BY-NC 4.0.": {"cc-by-nc-4.0"},
    "SPDX-License-Identifier: LGPL-2.1-or-later": {"lgpl-2.1"},
    "GPLv3 or GPL v2, your choice": {"gpl-3.0", "gpl-2.0"},
    "the GNU Lesser General Public License": {"lgpl"},
    "https://creativecommons.org/licenses/by-sa/3.0/": {"cc-by-sa-3.0"},
    "https://www.apache.org/licenses/LICENSE-2.0": {"apache-2.0"},
    "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License": {"cc-by-nc-sa-4.0"},
    "BSD 3-Clause License or Mozilla Public License 2.0": {"bsd-3-clause", "mpl-2.0"},
    "Permission is hereby granted, free of charge, to any person obtaining a copy": {"mit"},
    "Der Mann ging mit dem Apache, und die Lizenz war frei.": set(),
    "we have a driving license and a public library": set(),
}


@pytest.mark.parametrize("text", CASES)
def test_known_statements(text):
    scanner = ls.default_scanner()
    words = ls.normalized(text.encode())
    assert {scanner.rules[d.rule].label for d in scanner.detections(words)} == CASES[text]


def random_texts(rng, n):
    pieces = [w for r in RULES for w in re.findall(r"[a-z0-9]+", r.pattern)]
    pieces += ["gnu general public license", "apache license", "cc by", "mit license", "version 2.0", "the", "é", "日本"]
    pieces += list(CASES)
    joints = [" ", " ", " ", ", ", ".\n", "-", "\x00", "\t", "/"]
    return ["".join(rng.choice(pieces) + rng.choice(joints) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_against_every_rule_on_every_text(documents):
    rng = random.Random(11)
    texts = random_texts(rng, 60) + [None, "", " . ", "CC BY CC BY cc-by", "MIT LICENSE", "ümit license", "mit  licenseé"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "apache license")]
    docs = documents(rows).selectExpr("*", "1 AS n_words", "2 AS detections", "'y' AS id")
    found = {}
    for r in ls.scan_licenses(docs).collect():
        found.setdefault(r["doc_id"], []).append(r)
    assert len(found[3]) == 2 and found[3][0] == found[3][1]
    for i, text in [*enumerate(texts), (None, "apache license")]:
        r, words = found[i][0], slow_words(text)
        assert r["n_words"] == len(words)
        base = sorted((d["start"], d["label"]) for d in r["detections"] if d["base"])
        assert base == sorted(slow_base(words))
        ruled = [(d["start"], d["end"], d["label"], d["confidence"]) for d in r["detections"] if not d["base"]]
        assert ruled == [(a, b, RULES[n].label, RULES[n].confidence) for a, b, n in slow_detections(words, RULES)]


def test_suppression_by_level_length_and_order():
    rules = [Rule("a", "x", "x y", 1, 1.0), Rule("b", "x", "x", 0, 1.0), Rule("c", "x", "x y z", 1, 1.0), Rule("d", "x", "x y z", 1, 1.0)]
    rules += [Rule("e", "z", "z", 2, 1.0), Rule("f", "z", "z w", 2, 1.0)]
    scanner = ls.Scanner(rules)
    words = ls.normalized(b"x y z w")
    assert [rules[d.rule].label for d in scanner.detections(words)] == ["b", "c", "f"]
    assert ls.Scanner([]).detections(words) == []


def test_very_long_text(documents, monkeypatch):
    text = "Some words here. Licensed under the Apache License, Version 2.0!\n" * 30_000
    monkeypatch.setattr(ls, "PART_BYTES", 1000)
    short = text[: 65 * 40]
    assert ls.normalized(short.encode()) == "".join(f" {w} " for w in slow_words(short))
    monkeypatch.undo()
    (r,) = ls.scan_licenses(documents([(1, text)])).selectExpr("n_words", "size(detections) n", "detections[59999].start s").collect()
    assert (r["n_words"], r["n"], r["s"]) == (330_000, 60_000, 330_000 - 8)
    assert ls.scan_licenses(documents([])).count() == 0
