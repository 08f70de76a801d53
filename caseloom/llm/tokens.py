"""Byte-level BPE of whole texts inside tasks: vectorised splitting, and each distinct pre-token encoded once a batch."""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import SparkSession

#: Characters split at once; longer texts are cut where a white-space run begins, which is always a token's start.
BLOCK = 1 << 20
#: Pre-tokens whose ids a task remembers.
REMEMBERED = 1 << 19
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


@lru_cache(None)
def character_classes() -> bytes:
    """The class of each code point, asked of the tokenizer library itself, so that the Unicode versions agree."""
    everything = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    table = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        single = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        table[np.frombuffer(bytes(single.encode_ordinary(everything)).decode().encode("utf-32-le"), np.uint32)] = kind
    return table.tobytes()


@lru_cache(None)
def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file, or of a tokenizer file in JSON without its special tokens."""
    if not path.endswith(".json"):
        with open(path, "rb") as lines:
            return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    special = {t["content"] for t in model["added_tokens"]}
    # The printable stand-ins of bytes in such files: visible Latin-1 characters stand for themselves, the rest follow from 256 on.
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    stand_in = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in visible)}
    return {bytes(stand_in[c] for c in token): rank for token, rank in model["model"]["vocab"].items() if token not in special}


def load_added(path: str) -> dict[str, int]:
    """The added tokens of a tokenizer file and their ids, which stand for themselves wherever a text holds them."""
    with open(path, encoding="utf-8") as file:
        added = json.load(file)["added_tokens"] if path.endswith(".json") else []
    if any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that depend on the text beside them are not supported")
    return {t["content"]: t["id"] for t in added}


@dataclass
class Vocabulary:
    """A vocabulary for tasks: what is shipped is bounded by the vocabulary and by Unicode, not by the data."""

    shared: object

    @property
    def _kept(self) -> dict:
        return self.shared.value

    def encode(self) -> Callable[[bytes], list[int]]:
        """The function that gives a pre-token's ids."""
        kept = self._kept
        if "encoding" not in kept:
            kept["encoding"] = tiktoken.Encoding("own", pat_str=kept["pattern"], mergeable_ranks=kept["ranks"], special_tokens={})
        return kept["encoding"]._core_bpe.encode_single_piece

    def classes(self) -> np.ndarray:
        return np.frombuffer(self._kept["classes"], np.uint8)

    def token_bytes(self) -> tuple[np.ndarray, np.ndarray]:
        """The token-byte table: all tokens' bytes in a row, and where each id's begin."""
        kept = self._kept
        if "bytes" not in kept:
            size = max(kept["ranks"].values()) + 1
            tokens = [b""] * size
            for token, rank in kept["ranks"].items():
                tokens[rank] = token
            kept["bytes"] = np.frombuffer(b"".join(tokens), np.uint8), np.cumsum([0, *map(len, tokens)])
        return kept["bytes"]

    def added(self) -> dict[str, int]:
        return self._kept.get("added", {})


def load_vocabulary(spark: SparkSession, path: str, pattern: str, added: bool = False) -> Vocabulary:
    """The vocabulary in a rank or tokenizer file, with the pattern that splits texts before the merges.

    With `added` the file's added tokens are found in texts; without, they are ordinary text.
    """
    own = load_added(path) if added else {}
    return Vocabulary(spark.sparkContext.broadcast({"ranks": load_ranks(path), "pattern": pattern, "classes": character_classes(), "added": own}))


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs values[start : start + length], one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)]


def split_starts(codes: np.ndarray, classes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which characters begin a pre-token; `first` marks those that begin a text.

    The rules of the pattern  's|'t|'re|'ve|'m|'ll|'d| ?letters| ?numbers| ?others|spaces(?!other)|spaces  as array
    operations: a run of one class is a pre-token, the last space of a run goes to what follows it, and a
    contraction ends after its letters.
    """
    n = len(codes)
    kind = classes[codes]
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    # The last character of a white-space run that something of the same text follows begins a pre-token of its own.
    before = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:])
    start[before] = True
    start[before[codes[before] == 0x20] + 1] = False
    marks = np.flatnonzero((codes == 0x27) & start)
    if len(marks):
        padded = np.concatenate([codes, np.zeros(3, codes.dtype)])
        text_of = np.concatenate([np.cumsum(first), [-1, -1, -1]])
        one, two = padded[marks + 1], padded[marks + 2]
        same1, same2 = text_of[marks + 1] == text_of[marks], text_of[marks + 2] == text_of[marks]
        short = same1 & np.isin(one, np.frombuffer("stmd".encode("utf-32-le"), np.uint32))
        pair = one.astype(np.uint64) << np.uint64(32) | two
        long = same2 & np.isin(pair, [ord(p[0]) << 32 | ord(p[1]) for p in ("re", "ve", "ll")])
        for found, size in ((marks[short], 2), (marks[long & ~short], 3)):
            start[found + 1] = False
            ends = found + size
            ends = ends[ends < n]
            start[ends] = True
    return start


def _cut(text: str) -> Iterator[str]:
    """Blocks of about BLOCK characters that end right before a white-space run (a run never crosses blocks)."""
    at = 0
    while len(text) - at > BLOCK:
        to = at + BLOCK
        while to < len(text) and not (text[to] == " " and not text[to - 1].isspace()):
            to += 1
        yield text[at:to]
        at = to
    yield text[at:]


def pretokens(texts: list[str], classes: np.ndarray) -> tuple[pa.BinaryArray, np.ndarray]:
    """Pre-tokens (bytes) of all texts in a row, and how many each text has."""
    blocks, owner = [], []
    for i, text in enumerate(texts):
        for block in _cut(text):
            if block:
                blocks.append(block)
                owner.append(i)
    if not blocks:
        return pa.array([], pa.binary()), np.zeros(len(texts), np.int64)
    codes = np.frombuffer("".join(blocks).encode("utf-32-le", "surrogatepass"), np.uint32)
    block_at = np.cumsum([0, *map(len, blocks)])[:-1]
    first = np.zeros(len(codes), bool)
    first[block_at] = True
    begin = np.flatnonzero(split_starts(codes, classes, first))
    width = (1 + (codes >= 0x80).astype(np.int8) + (codes >= 0x800) + (codes >= 0x10000))
    byte_at = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
    offsets = np.append(byte_at[begin], byte_at[-1]).astype(np.int32)
    data = "".join(blocks).encode("utf-8", "surrogatepass")
    words = pa.BinaryArray.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])
    of = np.array(owner)[np.searchsorted(block_at, begin, side="right") - 1]
    return words, np.bincount(of, minlength=len(texts))


def slices(column: pa.Array, most: int = 4 * BLOCK) -> Iterator[tuple[int, list[str]]]:
    """Rows of a text column in turns of about `most` characters: the first row's number and the texts; null is empty."""
    at, size, texts = 0, 0, []
    for i, value in enumerate(column):
        text = value.as_py() or ""
        if texts and size + len(text) > most:
            yield at, texts
            at, size, texts = i, 0, []
        texts.append(text)
        size += len(text)
    if texts:
        yield at, texts


def make_encoder(vocabulary: Vocabulary) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """encode(texts) -> ids of all texts in a row, and how many each has.  It remembers ids of pre-tokens seen before."""
    known: dict[bytes, list[int]] = {}

    def ids_of(tokens: list[bytes]) -> list[list[int]]:
        if len(known) >= REMEMBERED:
            known.clear()
        found = list(map(known.get, tokens))
        if None in found:
            single = vocabulary.encode()
            for i, ids in enumerate(found):
                if ids is None:
                    found[i] = known[tokens[i]] = single(tokens[i])
        return found

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words, per_text = pretokens(texts, vocabulary.classes())
        coded = pc.dictionary_encode(words)
        number = np.asarray(coded.indices)
        lists = ids_of(coded.dictionary.to_pylist())
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter(chain.from_iterable(lists), np.uint32, int(lengths.sum()))
        sizes = lengths[number] if len(number) else np.zeros(0, np.int64)
        ids = gather(flat, (np.cumsum(lengths) - lengths)[number] if len(number) else sizes, sizes)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        text_ends = ends[np.cumsum(per_text)]
        return ids, np.diff(text_ends, prepend=0)

    added = vocabulary.added()
    if not added:
        return encode
    marks = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")

    def encode_between(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [marks.split(t) for t in texts]
        ids, sizes = encode([p for ps in parts for p in ps[::2]])
        follows = np.array([i for ps in parts for i in (*(added[t] for t in ps[1::2]), -1)], np.int64)
        wide = sizes + (follows >= 0)
        ends = np.cumsum(wide)
        whole = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
        whole[ends[follows >= 0] - 1] = follows[follows >= 0]
        whole[gather(np.arange(len(whole)), ends - wide, sizes)] = ids
        return whole, np.diff(ends[follows < 0], prepend=0)

    return encode_between
