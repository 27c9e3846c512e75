"""The Merkle manifest against a tree built row by row."""

import hashlib
import random

from pyspark.sql import functions as F

from servicelens.llm import merkle
from tests.llm.conftest import DOCS


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def slow_leaf(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], row[1])))


def slow_tree(nodes):
    """The root, and of each node the siblings left and right of its way up."""
    paths, level, of = [[] for _ in nodes], list(nodes), list(range(len(nodes)))
    while len(level) > 1:
        for i, at in enumerate(of):
            first = at - at % 3
            paths[i].append(("".join(level[first:at]), "".join(level[at + 1 : first + 3])))
        level = [sha(*level[i : i + 3]) for i in range(0, len(level), 3)]
        of = [at // 3 for at in of]
    return level[0], paths


def slow_manifest(rows, altered):
    """{(id, leaf): sorted [(subroot, root, proof, folded)]} of rows (doc_id, text, lang, source, n_chars)."""
    groups = {}
    for row in rows:
        groups.setdefault(row[3], []).append(row)
    trees = {}
    for name, members in groups.items():
        members.sort(key=lambda r: (r[0] is not None, r[0] or 0, slow_leaf(r)))
        trees[name] = (members, *slow_tree([slow_leaf(r) for r in members]))
    names = sorted(groups, key=lambda n: (n is not None, (n or "").encode()))
    root, upper = slow_tree([trees[n][1] for n in names])
    found = {}
    for name, above in zip(names, upper, strict=True):
        members, subroot, paths = trees[name]
        for row, path in zip(members, paths, strict=True):
            way = path + above
            folded = slow_leaf(altered(row))
            for left, right in way:
                folded = sha(left, folded, right)
            proof = sha(*(x for pair in way for x in pair))
            found.setdefault((row[0], slow_leaf(row)), []).append((subroot, root, proof, folded))
    return {k: sorted(v) for k, v in found.items()}


def altered(row):
    odd = row[0] is None or row[0] % 2
    return row if odd or row[1] is None else (row[0], row[1].replace("\n", ""), *row[2:])


def fast_manifest(docs):
    text = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    out = merkle.merkle_manifest(docs, altered={"text": text}, where=F.col("doc_id") % 2 == 0).collect()
    found = {}
    for r in out:
        assert r["verified"] == (r["folded"] == r["root"]) and r["path"] is None
        found.setdefault((r["id"], r["digest"].hex()), []).append(
            (r["subroot"].hex(), r["root"].hex(), r["proof"].hex(), r["folded"].hex())
        )
    return {k: sorted(v) for k, v in found.items()}


def check(spark, rows):
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS word", "2L AS pos", "'x' AS tree", "3 AS n", "4 AS before")
    assert fast_manifest(docs.repartition(3)) == slow_manifest(rows, altered)


def test_against_a_tree_built_row_by_row(spark):
    rng = random.Random(2)
    ids = rng.sample(range(-500, 3000), 700) + [1 << 40, (1 << 40) + 3, -(1 << 63), (1 << 63) - 1]
    sources = ["a"] * 8 + ["b", "é", "", "z=", None]
    rows = [(i, f"text\n{i}\n", "en", rng.choice(sources), i % 9) for i in ids]
    check(spark, rows)


def test_awkward_rows(spark):
    rng = random.Random(3)
    # ids of many texts and of none, repeated rows, rows with nulls in every column
    rows = [(7, f"t\n{i}", "en", "a", 1) for i in range(40)] + [(7, "same", "en", "a", 1)] * 25
    rows += [(None, f"t{i % 3}", None, "a", None) for i in range(10)] + [(8, "x", "en", "a", 1), (6, None, None, "a", None)]
    rows += [(None, None, None, None, None)] * 3 + [(1, "", "", "", 0), (1, None, "", "", 0), (3, "long " * 20_000, "en", None, 5)]
    rng.shuffle(rows)
    check(spark, rows)


def test_small_groups(spark):
    # groups of 1 to 10 rows, which are ten groups; and one group of one row
    check(spark, [(i, "t", "en", f"s{n}", 1) for n in range(1, 11) for i in range(n)])
    check(spark, [(5, "t", "en", "a", 1)])


def test_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(merkle, "ROUND", 1)
    monkeypatch.setattr(merkle, "SPAN", 3)
    monkeypatch.setattr(merkle, "PORTION", 4)
    plain = merkle.map_arrow

    def patched(df, task, schema):
        def work(batches):
            merkle.ROUND, merkle.SPAN = 1, 3
            yield from task(batches)

        return plain(df, work, schema)

    monkeypatch.setattr(merkle, "map_arrow", patched)
    try:
        check(spark, [(i * 70, f"t\n{i}", "en", f"s{i % 5 * (i % 7 > 3)}", 1) for i in range(100)] + [(5, "u", "en", "s0", 1)] * 13)
    finally:
        # workers are used again
        def restore(batches):
            merkle.ROUND, merkle.SPAN = 7, 3**7
            yield from batches

        plain(spark.range(64).repartition(64), restore, "id long").count()


def test_paths_lead_to_the_root(spark, documents):
    rows = [(i, f"t{i}") for i in range(50)]
    out = merkle.merkle_manifest(documents(rows), with_path=True).collect()
    assert [r["position"] for r in sorted(out, key=lambda r: r["id"])] == list(range(50))
    for r in out:
        path = list(zip(r["path"][::2], r["path"][1::2], strict=True))
        assert merkle.fold(r["digest"], path) == r["root"] and merkle.proof_digest(path) == r["proof"]
        assert r["verified"]
    assert len({r["root"] for r in out}) == 1


def test_empty_table(documents):
    assert merkle.merkle_manifest(documents([])).count() == 0


def test_directory_counts_rows_before(spark):
    rows = spark.createDataFrame([("a", i * i % 5000, b"x", None) for i in range(400)], "tree string, id long, digest binary, other binary")
    words = merkle.rank_directory(merkle.bitmap_words(rows)).collect()
    ids = sorted(i * i % 5000 for i in range(400))
    for w in words:
        assert w["before"] == sum(i < w["word"] * 64 for i in ids)
        assert w["n"] == sum(i >> 6 == w["word"] for i in ids)
        assert w["bits"].bit_count() if w["bits"] >= 0 else True
