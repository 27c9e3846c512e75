"""The stages of the corpus pipeline on a small table with every awkward kind of row."""

import corpus_pipeline
from tests.llm.test_near import slow_components, slow_dedup
from tests.llm.test_near_copies import slow_links

ENGLISH = "the thing is that this and other things were there with them for the reading of the month"
GERMAN = "der junge und das ding sind nicht durch die schule gegangen weil ich auch keine zeit habe"


def rows():
    base = [(i, f"{t} {i}\nline {i} {t[:30]}\nthird {t[5:40]} {i}", lang) for i in range(0, 40, 2) for t, lang in [(ENGLISH, "en")]]
    base += [(i, f"{GERMAN} {i}", "de") for i in range(1, 40, 2)]
    base += [(100, None, "en"), (101, "", None), (102, "12 34", "de"), (103, base[0][1], "en"), (104, base[25][1], None)]
    base += [(105, f"{ENGLISH} 1b password=0123456789abcdefgh end", None), (106, f"{GERMAN} 7 8 9", None)]
    return base


def test_stages_one_by_one(spark, documents):
    docs = documents(rows())
    texts = {i: t for i, t, _ in rows()}

    def run(n, frame):
        found = corpus_pipeline.STAGES[n][1](spark, frame, "")
        assert n == 4 or found.columns == docs.columns
        return found

    kept = {r["doc_id"]: r["text"] for r in run(0, docs).collect()}
    assert kept == {i: t for i, t in texts.items() if i not in (100, 101, 102)}

    wanted = slow_dedup(texts.items())
    found = {r["doc_id"]: r for r in run(1, docs).collect()}
    emptied = {i for i, (t, gone) in wanted.items() if gone and not t.strip()}
    assert {i: r["text"] for i, r in found.items()} == {i: t for i, (t, _) in wanted.items() if i not in emptied}
    assert all(r["n_chars"] == len(r["text"] or "") for r in found.values())

    of = slow_components(slow_links(texts), texts)
    assert 106 in texts and of[106] == 1  # a near copy: all German texts share most of their shingles
    assert {r["doc_id"] for r in run(2, docs).collect()} == set(of.values())

    masked = {r["doc_id"]: r["text"] for r in run(3, docs).collect()}
    assert masked == {**texts, 105: f"{ENGLISH} 1b [secret] end"}

    assert {r["doc_id"] for r in run(4, docs).collect()} == set(texts)


def test_copies_leave_no_fragments(spark, documents):
    texts = ["\n".join(f"text {k} line {i} of {k * i}" for i in range(3 + k)) for k in range(12)]
    rows = [(100 * n + k, t) for n in range(4) for k, t in enumerate(texts)] + [(500, "one line"), (501, "one line")]
    found = corpus_pipeline.drop_repeated_lines(spark, documents(rows), "").collect()
    assert {r["doc_id"]: r["text"] for r in found} == {**dict(enumerate(texts)), 500: "one line", 501: "one line"}


def test_awkward_rows(spark, documents):
    twice = [*rows(), *rows(), (None, ENGLISH, None), (None, ENGLISH, "en"), (None, None, None)]
    docs = documents(twice)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "").cache()
        found = docs.collect()
        assert found, name
        if name == "SimHash near-dedup":
            ids = [r["doc_id"] for r in found if r["doc_id"] is not None]
            assert len(ids) == len(set(ids))
    empty = documents([])
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, "")
        assert empty.count() == 0


def test_run_over_given_tables(spark):
    found = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert found.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert found.count() > 100
