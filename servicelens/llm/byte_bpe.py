"""Byte-level pair merging for `tokenizers` vocabulary files, a batch of words at a time.

`RankMerger` holds the symbols of many words in one flat array beside the number of their word. In
each round the rank of every adjacent pair is looked up, each word's lowest rank is taken, and all
its occurrences in all words merge at once; words without a pair in the table leave the arrays.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import regex

# Fixed value: the split pattern of byte-level vocabularies with `use_regex`.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# The same pattern over characters up to U+00FF of which no number but 0-9 and no rare space is part,
# written out for the faster engine.
_PLAIN_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_PLAIN = SPLIT.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{_PLAIN_LETTERS}0-9]")
_PLAIN = re.compile(_PLAIN.replace(r"\p{L}", f"[{_PLAIN_LETTERS}]").replace(r"\p{N}", "[0-9]"))
_NOT_PLAIN = re.compile("[^\t\n\r -~\u00a1-\u00a9\u00ab-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf-\u00ff]")

#: Texts longer than this are split into words part by part, cut where a word must start.
PART_CHARS = 1 << 20

#: Words of more bytes merge one by one.
LONG_WORD = 2048

_NONE = np.iinfo(np.int64).max
_SLOT_BITS = 19
_SLOTS = 1 << _SLOT_BITS


def byte_symbols() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, others from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def _hashed(pairs: np.ndarray) -> np.ndarray:
    return (pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)


def _slots(pairs: np.ndarray) -> tuple[np.ndarray, int]:
    """A hash table of row numbers with open addressing, and the longest way to a row."""
    slots = np.full(_SLOTS, pairs.size, np.int32)
    rows, slot, probes = np.arange(pairs.size, dtype=np.int32), _hashed(pairs), 0
    while rows.size:
        probes += 1
        free = np.flatnonzero(slots[slot] == pairs.size)
        slots[slot[free]] = rows[free]  # of rows that meet in a slot one stays
        lost = slots[slot] != rows
        rows, slot = rows[lost], (slot[lost] + 1) & (_SLOTS - 1)
    return slots, probes + 1


class RankMerger:
    def __init__(self, merges: list[tuple[str, str]], ids: dict[str, int]):
        self.byte_ids = np.array([ids[c] for c in byte_symbols()], np.int64)
        self.size = max(ids.values()) + 1
        pairs = np.array([ids[a] * self.size + ids[b] for a, b in merges], np.int64)
        self.slots, self.probes = _slots(pairs)
        # the row after the last pair is no pair's
        self.pairs = np.r_[pairs, -1]
        self.merged = np.array([ids[a + b] for a, b in merges], np.int64)

    def _looked_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs."""
        ranks, at = np.full(left.size, _NONE), np.arange(left.size)
        pairs = left * self.size + right
        slot = _hashed(pairs)
        for _ in range(self.probes):
            row = self.slots[slot]
            hit = self.pairs[row] == pairs
            ranks[at[hit]] = row[hit]
            more = ~hit & (row < self.pairs.size - 1)
            at, pairs, slot = at[more], pairs[more], (slot[more] + 1) & (_SLOTS - 1)
        return ranks

    def _pair_ranks(self, symbols: np.ndarray, owners: np.ndarray) -> np.ndarray:
        ranks = np.full(symbols.size, _NONE)
        at = np.flatnonzero(owners[:-1] == owners[1:])
        ranks[at] = self._looked_up(symbols[at], symbols[at + 1])
        return ranks

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and the number of ids of each."""
        long = [i for i, w in enumerate(words) if len(w) > LONG_WORD]
        if not long:
            return self._encode_short(words)
        held = {i: self._encode_long(words[i]) for i in long}
        ids, counts = self._encode_short([w for i, w in enumerate(words) if i not in held])
        starts = np.r_[0, np.cumsum(counts)].tolist()
        parts, sizes, short = [], np.zeros(len(words), np.int64), 0
        for i in range(len(words)):
            if i in held:
                parts.append(held[i])
            else:
                parts.append(ids[starts[short] : starts[short + 1]])
                short += 1
            sizes[i] = parts[-1].size
        return np.concatenate(parts), sizes

    def _encode_long(self, word: bytes) -> np.ndarray:
        """The ids of one word, in rounds that cost what they merge.

        Symbols are linked to their neighbours, and places lie in a bucket by the rank of the pair that begins
        there. A round takes the lowest bucket, merges its pairs at once and looks up the pairs beside them only.
        """
        symbols = self.byte_ids[np.frombuffer(word, np.uint8)].copy()
        n = symbols.size
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        ranks, alive = np.full(n, _NONE), np.ones(n, bool)
        buckets: dict[int, list[np.ndarray]] = {}
        waiting: list[int] = []

        def renew(places: np.ndarray) -> None:
            found = np.full(places.size, _NONE)
            paired = after[places] < n
            found[paired] = self._looked_up(symbols[places[paired]], symbols[after[places[paired]]])
            ranks[places] = found
            kept = found != _NONE
            places, found = places[kept], found[kept]
            order = np.argsort(found, kind="stable")
            places, found = places[order], found[order]
            starts = np.flatnonzero(np.r_[True, found[1:] != found[:-1]]) if found.size else []
            for rank, part in zip(found[starts].tolist(), np.split(places, starts[1:]), strict=True) if found.size else ():
                if rank not in buckets:
                    buckets[rank] = []
                    heapq.heappush(waiting, rank)
                buckets[rank].append(part)

        renew(np.arange(n))
        while waiting:
            rank = heapq.heappop(waiting)
            left = np.unique(np.concatenate(buckets.pop(rank)))
            left = left[ranks[left] == rank]
            if not left.size:
                continue
            # neighbours in a run such as `aaa` overlap: every second one merges, from the left
            fresh = np.r_[True, after[left[:-1]] != left[1:]]
            place = np.arange(left.size)
            run_start = np.maximum.accumulate(np.where(fresh, place, 0))
            spare = left[(place - run_start) % 2 == 1]
            left = left[(place - run_start) % 2 == 0]
            gone = after[left]
            alive[gone] = False
            symbols[left] = self.merged[rank]
            ranks[gone] = _NONE
            following = after[gone]
            after[left] = following
            inner = following < n
            before[following[inner]] = left[inner]
            previous = before[left]
            beside = np.unique(np.concatenate([left, previous[previous >= 0], spare[ranks[spare] == rank]]))
            renew(beside)
        return symbols[alive]

    def _encode_short(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words whose rounds are few."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        owners = np.repeat(np.arange(len(words)), lengths)
        done_symbols, done_owners = [symbols[:0]], [owners[:0]]
        while symbols.size:
            ranks = self._pair_ranks(symbols, owners)
            starts = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]])
            counts = np.diff(np.r_[starts, symbols.size])
            lowest = np.repeat(np.minimum.reduceat(ranks, starts), counts)
            over = lowest == _NONE
            if over.any():
                done_symbols.append(symbols[over])
                done_owners.append(owners[over])
                symbols, owners, ranks, lowest = (x[~over] for x in (symbols, owners, ranks, lowest))
            left = np.flatnonzero(ranks == lowest)
            if not left.size:
                break
            # neighbours in a run such as `aaa` overlap: every second one merges, from the left
            fresh = np.r_[True, np.diff(left) != 1]
            run_start = left[np.maximum.accumulate(np.where(fresh, np.arange(left.size), 0))]
            left = left[(left - run_start) % 2 == 0]
            symbols[left] = self.merged[ranks[left]]
            keep = np.ones(symbols.size, bool)
            keep[left + 1] = False
            symbols, owners = symbols[keep], owners[keep]
        symbols, owners = np.concatenate(done_symbols), np.concatenate(done_owners)
        order = np.argsort(owners, kind="stable")
        return symbols[order], np.bincount(owners, minlength=len(words))


class ByteVocabulary:
    """What a `tokenizers` file with byte-level splitting says; other kinds of files are refused."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        plain = (
            model["type"] == "BPE"
            and not any(model.get(k) for k in ("dropout", "unk_token", "byte_fallback", "ignore_merges"))
            and not any(model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix"))
            and split.get("type") == "ByteLevel"
            and split.get("use_regex", True)
            and not split.get("add_prefix_space")
            and spec["normalizer"] is None
        )
        added = spec["added_tokens"]
        if not plain or any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path} is no plain byte-level pair vocabulary")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merger = RankMerger(merges, model["vocab"])
        self._words = regex.compile(SPLIT)
        self.special_ids = {t["content"]: t["id"] for t in added}
        names = sorted(self.special_ids, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.cut = regex.compile(r"(?<=\S) (?=\p{L})")

    def words(self, part: str) -> list[str]:
        """The words that merge on their own."""
        return (self._words if _NOT_PLAIN.search(part) else _PLAIN).findall(part)

    def parts(self, text: str) -> Iterator[tuple[str, str]]:
        """(part, special string after it). Parts are at most about `PART_CHARS` long where words allow it."""
        start = 0
        for found in self.special.finditer(text) if self.special else ():
            yield from self._short(text[start : found.start()], found.group())
            start = found.end()
        yield from self._short(text[start:], "")

    def _short(self, text: str, special: str) -> Iterator[tuple[str, str]]:
        start = 0
        while len(text) - start > PART_CHARS and (cut := self.cut.search(text, start + PART_CHARS)):
            yield text[start : cut.start()], ""
            start = cut.start()
        yield text[start:], special
