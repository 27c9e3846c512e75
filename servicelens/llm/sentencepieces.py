"""SentencePiece encoding and decoding for merge-type vocabularies.

A word's symbols form a linked list; an agenda holds adjacent pairs that are pieces, ordered by score
and then by place. The best pair merges, its new neighbours enter, until the agenda is empty. No piece
of such a vocabulary continues over the start of a word, so words are independent: every distinct word
of a slice is encoded and decoded once, and compared with the sentencepiece library in the same batch.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from servicelens.llm.common import WordCache, map_arrow, read, sliced, texts_of

# The character that stands for a space, and what the library decodes an unknown id to.
SPACE = "▁"
UNKNOWN = " ⁇ "

#: Words that a Python worker remembers.
WORDS = 800_000

#: Longer texts are worked through part by part.
PART_CHARS = 1 << 20

_WORDS = re.compile(r" *[^ ]+| +")
_WORD_START = re.compile("(?<=[^ ]) ")
_loaded: dict[str, tuple["MergeModel", WordCache, dict[str, str]]] = {}


class MergeModel:
    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            spec.ParseFromString(file.read())
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        normal = spec.normalizer_spec
        if (
            spec.trainer_spec.model_type != sentencepiece_model_pb2.TrainerSpec.BPE
            or not spec.trainer_spec.byte_fallback
            or spec.trainer_spec.treat_whitespace_as_suffix
            or normal.precompiled_charsmap
            or normal.remove_extra_whitespaces
            or not normal.escape_whitespaces
            or not normal.add_dummy_prefix
            or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in spec.pieces)
            or any(SPACE in p.piece.lstrip(SPACE) for p in spec.pieces if p.type == kinds.NORMAL)
        ):
            raise ValueError(f"{path} is no plain merge-type vocabulary with byte fallback")
        self.pieces = [p.piece for p in spec.pieces]
        self.ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == kinds.NORMAL}
        # whole numbers in the order of the scores, best first
        order = sorted({p.score for p in spec.pieces}, reverse=True)
        cost = {score: n for n, score in enumerate(order)}
        self.costs = {p.piece: cost[p.score] for p in spec.pieces if p.type == kinds.NORMAL}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(spec.pieces) if p.type == kinds.BYTE}
        self.byte_values = {i: bytes([b]) for b, i in self.bytes.items()}
        self.silent = {i for i, p in enumerate(spec.pieces) if p.type == kinds.CONTROL}
        self.unknown = next(i for i, p in enumerate(spec.pieces) if p.type == kinds.UNKNOWN)
        self.end = self.library.eos_id()
        self.shown = [p.replace(SPACE, " ") for p in self.pieces]
        self.written = [f" {i}" for i in range(len(self.pieces))]
        self.odd = {*self.byte_values, *self.silent, self.unknown}

    def merge(self, symbols: list[str]) -> list[str]:
        """Merge by the agenda. An entry is one number: the cost of the pair, then its place."""
        cost_of, size = self.costs.get, len(symbols)
        shift = size.bit_length()
        place = (1 << shift) - 1
        pairs = map(str.__add__, symbols, symbols[1:])
        agenda = [cost << shift | i for i, cost in enumerate(map(cost_of, pairs)) if cost is not None]
        if not agenda:
            return symbols
        heapq.heapify(agenda)
        pop, push = heapq.heappop, heapq.heappush
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        while agenda:
            entry = pop(agenda)
            i = entry & place
            j = after[i]
            # an entry is void once one of its symbols has merged
            if j >= size or not (left := symbols[i]):
                continue
            pair = left + symbols[j]
            if cost_of(pair) != entry >> shift:
                continue
            symbols[i], symbols[j] = pair, ""
            k = after[i] = after[j]
            if k < size:
                before[k] = i
                if (cost := cost_of(pair + symbols[k])) is not None:
                    push(agenda, cost << shift | i)
            if (k := before[i]) >= 0 and (cost := cost_of(symbols[k] + pair)) is not None:
                push(agenda, cost << shift | k)
        return [s for s in symbols if s]

    def encode_word(self, word: str) -> list[int]:
        """Ids of a stretch of text that already has its leading spaces, the dummy one included."""
        merged = self.merge(list(word.replace(" ", SPACE)))
        found = list(map(self.ids.get, merged))
        if None in found:
            for at in range(len(merged) - 1, -1, -1):
                if found[at] is None:
                    found[at : at + 1] = [self.bytes[b] for b in merged[at].encode()]
        return found

    def decode(self, ids: list[int]) -> str:
        """Text of ids as `decode_word`, the dummy space of the first piece dropped."""
        shown = [i for i in ids if i not in self.silent]
        text = self.decode_word(shown)
        first = shown and self.pieces[shown[0]].startswith(SPACE)
        return text[1:] if first else text

    def decode_word(self, ids: list[int]) -> str:
        """Text of ids; runs of byte pieces are read as UTF-8, each wrong byte as U+FFFD."""
        if not self.odd.intersection(ids):
            return "".join(map(self.shown.__getitem__, ids))
        text, run = [], b""
        for i in [*ids, None]:
            if i in self.byte_values:
                run += self.byte_values[i]
                continue
            if run:
                text.append(_utf8(run))
                run = b""
            if i is not None and i not in self.silent:
                text.append(UNKNOWN if i == self.unknown else self.shown[i])
        return "".join(text)


def _utf8(run: bytes) -> str:
    try:
        return run.decode()
    except UnicodeDecodeError:
        pass
    text, at = [], 0
    while at < len(run):
        for size in (1, 2, 3, 4):
            try:
                text.append(run[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            text.append("�")
            at += 1
    return "".join(text)


def model(path: str) -> tuple[MergeModel, WordCache, dict[str, str]]:
    """The model, ids by word as text, and words that do not decode to themselves; once for each worker."""
    if path not in _loaded:
        _loaded[path] = MergeModel(path), WordCache(WORDS), {}
    return _loaded[path]


def _learn(new: list[str], path: str) -> int:
    """Encode and decode words not seen before; returns how many the library encodes in another way.

    The library adds the dummy space itself, so it gets a word without its first space.
    """
    merging, cache, changed = model(path)
    written = merging.written.__getitem__
    wrong = 0
    for word, theirs in zip(new, merging.library.encode([w[1:] for w in new], num_threads=1), strict=True):
        ids = merging.encode_word(word) if len(word) > 1 else [merging.ids[SPACE]]
        if len(word) > 1 and ids != theirs:
            wrong, ids = wrong + 1, theirs
        cache[word] = "".join(map(written, ids))
        if (text := merging.decode_word(ids)) != word:
            changed[word] = text
    return wrong


def _parts(text: str) -> Iterator[str]:
    """A text in parts of about `PART_CHARS`, cut where a word begins with its spaces."""
    start = 0
    while len(text) - start > PART_CHARS and (found := _WORD_START.search(text, start + PART_CHARS)):
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def encode_texts(texts: list[str], path: str) -> Iterator[tuple[str, str, int]]:
    """(ids joined by a space with the end id last, decoded text, mismatches found in new words)."""
    merging, cache, changed = model(path)
    ids: list[list[str]] = [[] for _ in texts]
    decoded: list[list[str]] = [[] for _ in texts]
    wrong = [0] * len(texts)

    def add(held: list[tuple[int, list[str]]]) -> None:
        used = set().union(*[words for _, words in held])
        cache.shrink(used)
        if len(changed) > cache.limit:
            for word in changed.keys() - used:
                del changed[word]
                cache.pop(word, None)
        mismatches = _learn(cache.missing(used), path)
        odd = changed.keys() & used
        for i, words in held:
            ids[i].append("".join(map(cache.__getitem__, words)))
            decoded[i].append("".join([changed.get(w, w) for w in words] if odd else words))
            wrong[i] += mismatches
            mismatches = 0

    held: list[tuple[int, list[str]]] = []
    chars = 0
    for i, text in enumerate(texts):
        # the character that stands for a space reads as one; the first space is the dummy one
        for part in _parts(" " + text.replace(SPACE, " ")) if text else ():
            held.append((i, _WORDS.findall(part)))
            chars += len(part)
            if chars >= PART_CHARS:
                add(held)
                held, chars = [], 0
    add(held)
    for code, text, mismatches in zip(ids, decoded, wrong, strict=True):
        yield f"{''.join(code)} {merging.end}"[1:] if code else str(merging.end), "".join(text)[1:], mismatches


def sentencepiece_codes(
    docs: DataFrame,
    model_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = True,
    with_decoded: bool = True,
) -> DataFrame:
    """Encode whole texts with an end id and decode them again.

    Columns: `id_col`, n_tokens (end id included), ids_sha256 (of decimal ids joined by a space),
    decoded_sha256, n_mismatch (words that the library encodes otherwise; its ids are then used), and on
    request ids (array of int) and decoded. A null or empty text is the end id alone and decodes to "".
    Null ids stay, equal rows give equal rows, an empty table an empty result, other columns are not
    read. No shuffle; `model_path` must be there on every executor.
    """

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            rows = list(encode_texts(texts_of(batch, "text"), model_path))
            columns = {
                "id": batch.column("id"),
                "n_tokens": pa.array([ids.count(" ") + 1 for ids, _, _ in rows], pa.int64()),
                "ids_sha256": [hashlib.sha256(ids.encode()).hexdigest() for ids, _, _ in rows],
                "decoded_sha256": [hashlib.sha256(t.encode()).hexdigest() for _, t, _ in rows],
                "n_mismatch": pa.array([wrong for _, _, wrong in rows], pa.int64()),
            }
            if with_ids:
                ids = [[int(i) for i in r[0].split(" ")] for r in rows]
                columns["ids"] = pa.array(ids, pa.list_(pa.int32()))
            if with_decoded:
                columns["decoded"] = pa.array([r[1] for r in rows], pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_mismatch long"
    schema += ", ids array<int>" * with_ids + ", decoded string" * with_decoded
    return map_arrow(narrow, code, schema).withColumnRenamed("id", id_col)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepiece_codes(read(spark, sf_dir, "documents"), path, with_ids=False, with_decoded=False)
