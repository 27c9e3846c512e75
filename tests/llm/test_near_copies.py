"""Near copies against the similarity of all pairs."""

import itertools
import random

import numpy as np
import pytest

from servicelens.llm import near_copies as nc
from tests.llm.test_near import slow_components


def slow_shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def slow_links(texts, least=0.8):
    sets = {i: slow_shingles(t) for i, t in texts.items()}
    return [
        (a, b) for a, b in itertools.combinations(sets, 2)
        if (len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]))
    ]


def corpus(rng, groups, copies, length):
    """Texts and copies of them with a few words changed, left out or put in."""
    words = [f"w{i}" for i in range(3000)]
    texts, number = {}, 0
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.randrange(*length))]
        for copy in range(rng.randrange(1, copies + 1)):
            text = list(base)
            for _ in range(rng.randrange(1 + max(1, len(base) // 50)) if copy else 0):
                at = rng.randrange(len(text))
                text[at : at + rng.randrange(2)] = [rng.choice(words)] * rng.randrange(2)
            texts[number] = " ".join(text)
            number += 1
    return texts


def components_of(docs, **kwargs):
    out = nc.near_copies(docs, **kwargs).collect()
    return sorted((r["doc_id"], r["component_id"]) for r in out)


def test_links_against_all_pairs(documents):
    texts = corpus(random.Random(1), 120, 5, (20, 400))
    found = dict(components_of(documents(list(texts.items()))))
    links = slow_links(texts)
    wanted = slow_components(links, texts)
    assert len(links) > 150
    # nothing is linked that is not alike, and nearly all that is
    assert all(wanted[c] == wanted[i] for i, c in found.items())
    assert sum(found[a] == found[b] for a, b in links) >= 0.95 * len(links)


def test_recall_at_the_limit():
    """Pairs of a similarity of 0.8 to 0.85: how many share a key and are near enough."""
    rng, met, pairs = random.Random(2), 0, 0
    words = [f"w{i}" for i in range(3000)]
    while pairs < 400:
        base = [rng.choice(words) for _ in range(200)]
        other = list(base)
        for at in rng.sample(range(200), 4):
            other[at] = "x"
        a, b = nc.shingles(" ".join(base)), nc.shingles(" ".join(other))
        if not 0.8 <= nc.similarity(a, b) <= 0.85:
            continue
        pairs += 1
        prints = [np.array([nc.fingerprint(x)], np.int64).view(np.uint64) for x in (a, b)]
        near = len(nc.near_pairs(*prints)[0]) == 1
        met += near and bool(set(nc.smallest(a)) & set(nc.smallest(b)))
    assert met >= 0.93 * pairs


def test_segment_tables_find_all_near_fingerprints():
    rng = np.random.default_rng(3)
    left = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 30), replace=False)) for _ in range(300)], np.uint64)
    right = left ^ flips
    rows, columns, apart = nc.near_pairs(left, right)
    exact = np.bitwise_count(left[:, None] ^ right)
    assert sorted(zip(rows, columns, strict=True)) == sorted(zip(*np.nonzero(exact <= nc.DISTANCE), strict=True))
    assert (apart == exact[rows, columns]).all()


@pytest.mark.parametrize("block", [1024, 7])
def test_groups_of_many_copies(documents, monkeypatch, block):
    monkeypatch.setattr(nc, "BLOCK", block)
    rng = random.Random(4)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    texts = {}
    for i in range(60):
        text = list(base)
        text[rng.randrange(120)] = f"changed{i % 40}"
        texts[i] = " ".join(text)
    texts |= {100 + i: " ".join([*base[:60], *(f"v{i}x{k}" for k in range(90))]) for i in range(30)}  # share half
    found = dict(components_of(documents(list(texts.items()))))
    assert found == slow_components(slow_links(texts), texts)
    assert len(set(found.values())) == 31


def test_awkward_rows(documents):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "One  TWO"), (6, "one three"), (None, "one two"), (7, "a b c d e f")]
    rows += [(7, "a b c d e f"), (8, "a b c d e f"), (9, "é b c d e f"), (None, "only without an id"), (10, "long " * 50_000 + "end")]
    found = nc.near_copies(documents(rows).selectExpr("*", "5L AS t0", "6 AS component", "7 AS size")).collect()
    pairs = sorted(((r["doc_id"], r["component_id"]) for r in found), key=repr)
    wanted = [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (None, 4), (7, 7), (7, 7), (8, 7), (9, 9), (None, None), (10, 10)]
    assert pairs == sorted(wanted, key=repr)
    assert nc.near_copies(documents([])).count() == 0
