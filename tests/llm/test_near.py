"""Line chunks, fingerprints, components and vector searches against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from servicelens.llm import line_dedup, nearest, simhash, topk
from servicelens.llm.components import components


def slow_dedup(rows):
    """rows: (id, text), ids distinct and not null."""
    seen, result = set(), {}
    for i, text in sorted(rows):
        if text is None:
            result[i] = (None, 0)
            continue
        lines, kept, first, gone = text.split("\n"), [], 0, 0
        for end in line_dedup.chunk_ends(lines):
            chunk = lines[first:end]
            if len(chunk) > 1 and "".join(chunk).strip() and "\n".join(chunk) in seen:
                gone += len(chunk)
            else:
                kept += chunk
            if len(chunk) > 1:
                seen.add("\n".join(chunk))
            first = end
        result[i] = ("\n".join(kept), gone)
    return result


def test_line_dedup_against_brute_force(documents):
    rng = random.Random(4)
    lines = [f"line {i}" for i in range(12)] + ["", " "]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(0, 25)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "\n"), (203, "\n\n\n\n"), (204, rows[3][1]), (205, "é 日\n" * 60)]
    found = line_dedup.dedup_lines(documents(rows)).collect()
    assert {r["doc_id"]: (r["text"], r["removed_lines"]) for r in found} == slow_dedup(rows)
    assert found[0]["key"] == 1 and found[0]["source"] is None


def test_boundaries_do_not_shift():
    rng = random.Random(1)
    lines = [str(rng.random()) for _ in range(300)]
    ends = set(line_dedup.chunk_ends(lines))
    shifted = {e - 2 for e in line_dedup.chunk_ends(["new", "lines", *lines])}
    assert {e for e in ends if e > 3} == {e for e in shifted if e > 3}


def test_texts_decide_where_hashes_clash(documents, monkeypatch):
    rows = [(1, "a\nb\nc\nd"), (2, "e\nf\ng\nh"), (3, "e\nf\ng\nh"), (4, "a\nb\nc\nd")]
    plain = line_dedup._chunks
    monkeypatch.setattr(line_dedup, "_chunks", lambda docs: plain(docs).selectExpr("* except (hash)", "0L AS hash"))
    found = line_dedup.dedup_lines(documents(rows)).collect()
    assert {r["doc_id"]: (r["text"], r["removed_lines"]) for r in found} == slow_dedup(rows)


def test_line_dedup_cases(documents):
    same = "one\ntwo\nthree\nfour\nfive\nsix"
    found = line_dedup.dedup_lines(documents([(None, same), (7, same), (7, same)])).collect()
    # equal rows are one place; a row without an id comes after all others
    assert [r["text"] for r in found if r["doc_id"] == 7] == [same, same]
    assert next(r for r in found if r["doc_id"] is None)["removed_lines"] > 0
    assert line_dedup.dedup_lines(documents([])).count() == 0


def slow_passages(rows):
    """rows: (id, text), ids distinct and not null."""
    places, lines_of = {}, {i: text.split("\n") for i, text in rows if text is not None}
    for i, lines in sorted(lines_of.items()):
        spans = [(k, k + 2) for k in range(len(lines) - 1)]
        spans += [(k, k + 1) for k, line in enumerate(lines) if len(line.split()) > 50]
        for a, b in spans:
            if "".join(lines[a:b]).strip():
                places.setdefault("\n".join(lines[a:b]), []).append((i, a, b))
    gone = {(i, k) for p in places.values() for i, a, b in p[1:] for k in range(a, b)}
    gone -= {(i, k) for p in places.values() if p[1:] for i, a, b in p[:1] for k in range(a, b)}
    kept = {i: "\n".join(x for k, x in enumerate(ls) if (i, k) not in gone) for i, ls in lines_of.items()}
    return {i: (kept.get(i), sum(g[0] == i for g in gone)) for i, _ in rows}


@pytest.mark.parametrize("clash", [False, True])
def test_passages_against_brute_force(documents, monkeypatch, clash):
    if clash:
        plain = line_dedup._windows
        monkeypatch.setattr(line_dedup, "_windows", lambda docs: plain(docs).selectExpr("* except (hash)", "hash % 2 AS hash"))
    rng = random.Random(6)
    lines = [f"line {i}" for i in range(40)] + ["", " ", "word " * 51, "other " * 50]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(0, 25)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "\n"), (203, "\n\n\n\n"), (204, rows[3][1]), (205, "é 日\n" * 60)]
    found = line_dedup.dedup_passages(documents(rows)).collect()
    assert {r["doc_id"]: (r["text"], r["removed_lines"]) for r in found} == slow_passages(rows)
    assert found[0]["key"] == 1 and found[0]["source"] is None
    assert line_dedup.dedup_passages(documents([])).count() == 0


def test_short_passages_in_any_surroundings_go(documents):
    passage = "\n".join(f"passage {k} " + "of many words " * 7 for k in range(3))
    rows = [(i, f"before {i}\n{passage}\nafter {i}") for i in range(40)] + [(50, f"alone {'long ' * 60}"), (51, f"x\nalone {'long ' * 60}")]
    found = {r["doc_id"]: r["text"] for r in line_dedup.dedup_passages(documents(rows)).collect()}
    assert found == {0: rows[0][1], **{i: f"before {i}\nafter {i}" for i in range(1, 40)}, 50: rows[40][1], 51: "x"}


def test_passages_are_found_as_chunks_first(documents, monkeypatch):
    """Chunks that the rolling hash ends are matched, and windows inside their later places are not looked up again."""
    seen, plain = [], line_dedup._places

    def places(candidates, texts):
        seen.append({(r["id"], r["chunk"]) for r in candidates.select("id", "chunk").collect()})
        return plain(candidates, texts)

    monkeypatch.setattr(line_dedup, "_places", places)
    text = "\n".join(f"line {i} of a text" for i in range(60))
    lines, first, inside = text.split("\n"), 0, set()
    chunks = line_dedup.chunk_ends(lines)
    for end in chunks:
        inside |= {2 * i for i in range(first, end - 1)}
        first = end
    rows = [(1, text), (2, text), (3, text + "\nmore")]
    found = {r["doc_id"]: r["text"] for r in line_dedup.dedup_passages(documents(rows)).collect()}
    assert found == {i: t for i, (t, _) in slow_passages(rows).items()}
    assert {c for i, c in seen[0] if i == 1} == {n for n, (a, b) in enumerate(zip([0, *chunks], chunks)) if b - a > 1}
    assert {c for i, c in seen[1] if i == 1} == set(range(0, 118, 2))
    assert {c for i, c in seen[1] if i == 2} == set(range(0, 118, 2)) - inside and inside


def slow_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    parts = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(parts))


@pytest.mark.parametrize("part", [1, 4, 9, 1 << 20])
def test_fingerprints(monkeypatch, part):
    monkeypatch.setattr(simhash, "_SHINGLES", 5)
    monkeypatch.setattr(simhash, "PART_CHARS", part)
    for text in ["", " \t\n", "one", "one Two", "ÉCOLE\x0bÀ b c D e", "a b c " * 9, "x y z w v u t s r q"]:
        assert simhash.fingerprint(text) == slow_fingerprint(text)


def slow_components(links, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(60)] + [(500, 1000 - i) for i in range(40)]
    links = chain + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(70)] + [(5, 5)]
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    wanted = slow_components(links, {x for p in links for x in p if p[0] != p[1]})
    assert {r["node"]: r["component"] for r in found} == wanted
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("block", [3, 2048])
def test_links_connect_all_near_fingerprints(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(block)
    centres = [rng.getrandbits(64) for _ in range(12)]
    values = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 5))) for c in centres for _ in range(25)}
    values |= {0, (1 << 64) - 1, 7, 1 << 63}
    signed = np.array(sorted(values), np.uint64).view(np.int64).tolist()
    links = [
        (a, b) for k, a in enumerate(signed) for b in signed[:k] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3
    ]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = [(r["a"], r["b"]) for r in simhash.near_links(fps).collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 3 and a < b for a, b in found)
    assert slow_components(found, signed) == slow_components(links, signed)


def test_near_duplicate_classes(documents):
    text = "the quick brown fox jumps over the lazy dog and runs away from all of them"
    rows = [(5, text), (3, text), (4, text.upper()), (9, "other words here"), (7, None), (8, ""), (2, " \n"), (None, text), (9, "other words here")]
    found = simhash.near_duplicates(documents(rows)).collect()
    by = {r["doc_id"]: r["component_id"] for r in found}
    assert len(found) == 9 and by == {5: 3, 3: 3, 4: 3, None: 3, 9: 9, 7: 2, 8: 2, 2: 2}
    assert {r["fingerprint"] for r in found if r["doc_id"] in (2, 7, 8)} == {"0" * 16}
    assert simhash.near_duplicates(documents([])).count() == 0


@pytest.fixture
def small_driver(spark):
    """Tables that Spark takes for smaller than 10 MB may be broadcast, but not if they turn out to have 8 MB."""
    spark.conf.set("spark.sql.maxBroadcastTableSize", str(8 << 20))
    yield
    spark.conf.unset("spark.sql.maxBroadcastTableSize")


def test_lookups_do_not_go_through_the_driver(spark, small_driver):
    """A file of 4,000 fingerprints is small; their lookups, some 32 each, are not."""
    pair = "inline(array(struct(xxhash64(id) AS fp), struct(xxhash64(id) ^ 5 AS fp)))"
    fps = simhash.stored(spark.range(2000).selectExpr(pair), "fps")
    found = [(r["a"], r["b"]) for r in simhash.near_links(fps).collect()]
    signed = [r["fp"] for r in fps.collect()]
    pairs = [(min(a, b), max(a, b)) for a, b in zip(signed[::2], signed[1::2])]
    assert slow_components(found, signed) == slow_components(pairs, signed)


def test_entries_do_not_go_through_the_driver(spark, monkeypatch):
    """Two entries a fingerprint, whatever Spark takes the table for."""
    plans, plain = [], simhash.stored

    def stored(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, name)

    monkeypatch.setattr(simhash, "stored", stored)
    links = simhash.near_links(spark.range(100).selectExpr("id AS fp"))
    plans.append(links._jdf.queryExecution().executedPlan().toString())
    assert len(plans) == 2 and not any("Broadcast" in p for p in plans)


def test_rows_do_not_go_through_the_driver(spark, small_driver):
    """Repeated rows make a small file and are many."""
    docs = spark.range(120000).selectExpr("if(id < 100, id, null) AS doc_id", "if(id < 100, concat('text ', id), null) AS text")
    found = simhash.near_duplicates(docs)
    assert found.count() == 120000 and found.where("doc_id IS NULL AND component_id IS NULL").count() == 119900


def vectors(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return frame.selectExpr("*", "0 AS rank", "1 AS id", "2 AS score")


def sample(n, dim=8):
    rng = np.random.default_rng(n)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=dim)]) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(40)]  # ties
    rows += [(1000, None), (1020, []), (1040, [0.0] * dim), (1060, [float("nan")] * dim), (1080, [None] * dim)]
    rows += [(1100, [float("inf")] * dim), (None, rows[0][1]), (1, rows[1][1]), (1120, [1.0, 2.0]), (1140, [3.0, 4.0])]
    return rows


def valid(vec):
    return vec and all(x is not None and np.isfinite(x) for x in vec)


def slow_search(rows, step, k, product, zeros):
    rows = [(i, v) for i, v in rows if i is not None and valid(v) and (zeros or any(v))]
    found = set()
    for q, v in {(i, tuple(v)) for i, v in rows if i % step == 0}:
        scored = [(-product(v, w), i) for i, w in rows if i != q and len(w) == len(v)]
        found |= {(q, n, i, -s) for n, (s, i) in enumerate(sorted(scored)[:k], 1)}
    return found


@pytest.mark.parametrize("small", [False, True])
def test_nearest_against_brute_force(spark, monkeypatch, small):
    if small:
        for name in ("QUERY_ROWS", "CANDIDATE_ROWS", "CHUNK_ROWS"):
            monkeypatch.setattr(f"servicelens.llm.vectors.{name}", 7)
    rows = sample(300)
    found = {tuple(r) for r in nearest.nearest(vectors(spark, rows)).collect()}

    def product(a, b):
        total = 0.0
        for x, y in zip(a, b, strict=True):
            total += x * y
        return total

    assert found == slow_search(rows, 20, 20, product, False)
    assert nearest.nearest(vectors(spark, [])).count() == 0


@pytest.mark.parametrize("small", [False, True])
def test_top_k_against_brute_force(spark, monkeypatch, small):
    if small:
        for name in ("QUERY_ROWS", "CANDIDATE_ROWS", "CHUNK_ROWS"):
            monkeypatch.setattr(f"servicelens.llm.vectors.{name}", 7)
    huge = float(np.float32(1e30))
    rows = sample(300) + [(1200, [huge, -huge, 0.5] + [0.0] * 5), (1201, [2.0, 2.0**60] + [1.0] * 6)]

    def product(a, b):
        whole = sum(int(np.floor(x * 256)) * int(np.floor(y * 256)) for x, y in zip(a, b, strict=True))
        return min((1 << 63) - 1, max(-(1 << 63), whole))

    found = {tuple(r) for r in topk.top_k(vectors(spark, rows)).collect()}
    assert found == slow_search(rows, 50, 5, product, True)
    assert topk.top_k(vectors(spark, [])).count() == 0
