"""Token counts, piece codes and packing against the libraries and brute force."""

import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from servicelens.llm import byte_bpe, packing, sentencepieces, token_counts

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

ODD = [
    "",
    " ",
    "   ",
    "a<|endoftext|>b  <|endoftext|>",
    "aaaaaaaaaaaaaaa" * 50,
    "can't'll '  x\n\n y\t\t",
    "日本語テキスト😀",
    " x 123abc__!!",
    "ŉ 　a\x00",
    "▁",
    "▁▁a ▁ ▁x",
    "a<s>b</s><unk>",
    "\U00013000 ﻿a​",
]


def texts(n=400):
    rng = random.Random(5)
    letters = "ab  ▁é日\U0001f600\U00013000\n\t\x00<s>the ing '  　.,!12"
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_counts_are_those_of_the_library():
    library = Tokenizer.from_file(BYTES)
    wanted = [len(library.encode(t, add_special_tokens=False).ids) for t in texts()]
    assert token_counts.count_texts(texts(), BYTES) == wanted


def test_ids_are_those_of_the_library():
    library = Tokenizer.from_file(BYTES)
    for text, code in zip(texts(), packing.encode_texts(texts(), BYTES), strict=True):
        assert np.frombuffer(code, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_long_texts_are_split_at_words_only(monkeypatch):
    monkeypatch.setattr(byte_bpe, "PART_CHARS", 7)
    library = Tokenizer.from_file(BYTES)
    long = ["word and  more words. " * 40, "x" * 500, " \n" * 90 + "end"]
    wanted = [len(library.encode(t, add_special_tokens=False).ids) for t in long]
    assert token_counts.count_texts(long, BYTES) == wanted


def test_pair_merging_against_one_pair_at_a_time():
    merges = [("a", "a"), ("aa", "b"), ("b", "c"), ("aa", "aa"), ("aab", "c")]
    ids = {c: i for i, c in enumerate(byte_bpe.byte_symbols())}
    for a, b in merges:
        ids[a + b] = len(ids)
    merger = byte_bpe.RankMerger(merges, ids)

    def slow(word):
        symbols = list(word)
        while True:
            ranks = [merges.index(p) if p in merges else 99 for p in zip(symbols, symbols[1:], strict=False)]
            if not ranks or min(ranks) == 99:
                return [ids[s] for s in symbols]
            i = ranks.index(min(ranks))
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]

    rng = random.Random(1)
    words = ["".join(rng.choice("aabc") for _ in range(rng.randrange(1, 15))) for _ in range(300)]
    found, counts = merger.encode([w.encode() for w in words])
    parts = np.split(found, np.cumsum(counts)[:-1])
    assert [p.tolist() for p in parts] == [slow(w) for w in words]


def test_long_words_are_those_of_the_library(monkeypatch):
    rng = random.Random(9)
    library = Tokenizer.from_file(BYTES)
    parts = ["the", "ing", "tion", "er", "a", "an", "ss", "sss", "aaaa", "ab"]
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(60_000)), "a" * 5001, "ab" * 3000 + "a", "1" * 9000]
    words += ["".join(rng.choice(parts) for _ in range(3000)), "=-" * 3000 + "=" * 4000, "é" * 3000, "日本" * 1500, "short"]
    for word, code in zip(words, packing.encode_texts(words, BYTES), strict=True):
        assert np.frombuffer(code, "<u4").tolist() == library.encode(word, add_special_tokens=False).ids
    monkeypatch.setattr(byte_bpe, "LONG_WORD", 3)
    for text, code in zip(texts(), packing.encode_texts(texts(), BYTES), strict=True):
        assert np.frombuffer(code, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_a_word_of_a_million_letters():
    rng = random.Random(10)
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
    vocabulary = byte_bpe.ByteVocabulary(BYTES)
    looked_up = []
    plain = vocabulary.merger._looked_up
    vocabulary.merger._looked_up = lambda left, right: looked_up.append(left.size) or plain(left, right)
    ids, _ = vocabulary.merger.encode([word.encode()])
    assert ids.tolist() == Tokenizer.from_file(BYTES).encode(word, add_special_tokens=False).ids
    # what is looked up follows the merges: two places each, and every place once
    assert sum(looked_up) <= 2 * (len(word) - ids.size) + len(word)


def test_other_kinds_of_vocabularies_are_refused():
    with pytest.raises(ValueError):
        byte_bpe.ByteVocabulary(public_tokenizers.path("word_bpe_49k.json"))


def test_count_cases(documents):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "hi " * 2000), (3, "hi " * 2000), (4, "é")]
    found = token_counts.token_counts(documents(rows), BYTES).collect()
    assert sorted((str(r[0]), r[1], r[3]) for r in found) == [
        ("1", 0, False),
        ("2", 0, False),
        ("3", 6000, True),
        ("3", 6000, True),
        ("4", 2, False),
        ("None", 3, False),
    ]
    assert token_counts.token_counts(documents([]), BYTES).count() == 0


@pytest.mark.parametrize("part", [1, 5, 1 << 20])
def test_codes_are_those_of_the_library(monkeypatch, part):
    monkeypatch.setattr(sentencepieces, "PART_CHARS", part)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    model = sentencepieces.model(PIECES)[0]
    for text, (ids, decoded, wrong) in zip(texts(), sentencepieces.encode_texts(texts(), PIECES), strict=True):
        wanted = library.encode(text, add_eos=True)
        assert ids == " ".join(map(str, wanted))
        assert decoded == library.decode(wanted) == model.decode(wanted)
        assert not wrong


def test_decoding_any_ids():
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    model = sentencepieces.model(PIECES)[0]
    for ids in ([68, 258, 229, 133, 300], [28705, 28705, 300], [1, 300, 2, 300], [198, 172, 300, 198]):
        assert model.decode(ids) == library.decode(ids)


def test_code_cases(documents):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "x"), (3, "x")]
    found = sentencepieces.sentencepiece_codes(documents(rows), PIECES).collect()
    by = {r["doc_id"]: r for r in found}
    assert len(found) == 5 and by[1]["n_tokens"] == by[2]["n_tokens"] == 1
    assert by[1]["ids_sha256"] == hashlib.sha256(b"2").hexdigest() and by[1]["decoded"] == ""
    assert by[None]["decoded"] == "a b" and by[None]["ids"][-1] == 2
    assert sentencepieces.sentencepiece_codes(documents([]), PIECES).count() == 0


def _sequences(runs):
    held = {}
    for run in runs:
        for k in range(run.count):
            held.setdefault(run.sequence + k, []).append((run.offset, run.length))
    return held


@pytest.mark.parametrize("capacity", [7, 30, 1024])
def test_plans_place_every_piece_once(capacity):
    rng = np.random.default_rng(capacity)
    for _ in range(25):
        sizes = rng.integers(1, capacity + 1, rng.integers(0, 200))
        runs, n, _ = packing.plan(np.bincount(sizes, minlength=capacity + 1), capacity)
        held = _sequences(runs)
        assert sorted(x for s in held.values() for _, x in s) == sorted(sizes.tolist())
        assert set(held) == set(range(n))
        for spans in held.values():
            at = 0
            for offset, length in sorted(spans):
                assert offset == at
                at += length
            assert at <= capacity


def _fewest(sizes, capacity):
    best = len(sizes)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= sizes[i] and rooms[k] not in rooms[:k]:
                place(i + 1, [*rooms[:k], rooms[k] - sizes[i], *rooms[k + 1 :]])
        place(i + 1, [*rooms, capacity - sizes[i]])

    place(0, [])
    return best


def test_reduction_keeps_the_optimum():
    rng = random.Random(2)
    for _ in range(60):
        sizes = sorted((rng.randrange(1, 21) for _ in range(rng.randrange(1, 10))), reverse=True)
        made = packing._Plan(np.bincount(sizes, minlength=21), 20)
        fixed = made.reduce()
        rest = [x for x in range(20, 0, -1) for _ in range(made.left[x])]
        assert fixed + _fewest(rest, 20) == _fewest(sizes, 20)


def test_packed_documents(documents):
    library = Tokenizer.from_file(BYTES)
    rows = [(1, None), (2, ""), (None, "a b"), (3, "word " * 2500), (5, "x")] + [(9, "same text")] * 4
    found = packing.pack_documents(documents(rows), BYTES).collect()
    by = {}
    for r in found:
        by.setdefault(r["sequence_id"], []).append(r)
        assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{r['length']}I", *r["ids"]))
    for held in by.values():
        at = 0
        for r in sorted(held, key=lambda r: r["offset"]):
            assert r["offset"] == at and len(r["ids"]) == r["length"]
            at += r["length"]
        assert at <= 1024
    long = sorted((r for r in found if r["doc_id"] == 3), key=lambda r: r["piece"])
    assert [i for r in long for i in r["ids"]] == [*library.encode("word " * 2500).ids, 2]
    assert [r["length"] for r in long][1:] == [1024] * (len(long) - 1)
    assert sum(r["doc_id"] == 9 for r in found) == 4 and len(by) == len(long)
    assert packing.pack_documents(documents([]), BYTES).count() == 0
