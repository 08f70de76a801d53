"""Spelling variants by reduced-alphabet generation.

Letters are hashed to a few symbols, which makes the full one-edit neighbourhood of a reduced word small.  The
neighbourhoods are generated once per reduced word and joined with the reduced vocabulary; what meets there is verified
on the words themselves.  All joins are told to sort, as tables of words compress so well that Spark would take them for
small enough to broadcast at any size.  Reduced words are told by a polynomial hash, so a neighbour costs eight bytes at any length.
Words of reduced words that very many words share are not paired with each other but taken to a finer alphabet.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from caseloom.session import cut_lineage

#: Symbols of the reduced alphabet, and words of a reduced word up to which all of them are verified at once.
SYMBOLS, CROWD = 5, 256
#: Odd multiplier of the hash of a reduced word, modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Hashes made at once, and distinct words counted in a task before they are handed on.
BLOCK, COUNTED = 1 << 20, 1 << 18
#: Letters up to which two words are compared by a table of distances.
LONG = 128
#: The letters of a run: A-Z, a-z and U+00C0 to U+00FF.
RUNS = re.compile("[A-Za-zÀ-ÿ]+")


def typed(doc_id: str, run: str, rate: int) -> str:
    """The run, with one letter less where `rate` divides the CRC-32 of `<doc_id>:<run>`."""
    h = zlib.crc32(f"{doc_id}:{run}".encode("utf-8", "surrogatepass"))
    if h % rate:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def count_words(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 5, fewest: int = 3, rate: int = 97,
) -> DataFrame:
    """(word, n): the words of at least `shortest` letters that occur at least `fewest` times in all texts.

    Runs are lower-cased from A to Z; one in about `rate` runs of a text loses a letter (see typed), the same in all its
    places.  Null texts have no words; a null id counts as the text `null`.  Counts are added up in each task first, so
    a word that is everywhere moves as one row a task.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}
        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = (value.as_py() or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
                head = zlib.crc32(f"{doc_id}:".encode("utf-8", "surrogatepass"))
                for word, n in Counter(RUNS.findall(text)).items():
                    if zlib.crc32(word.encode(), head) % rate == 0:
                        word = typed(doc_id, word, rate)
                    if len(word) >= shortest:
                        total[word] = total.get(word, 0) + n
                if len(total) >= COUNTED:
                    yield from counted(total)
                    total = {}
        yield from counted(total)

    def counted(total: dict[str, int]) -> Iterator[pa.RecordBatch]:
        words, counts = list(total), list(total.values())
        for at in range(0, len(words), 1 << 15):
            yield pa.RecordBatch.from_arrays(
                [pa.array(words[at:at + (1 << 15)], pa.string()), pa.array(counts[at:at + (1 << 15)], pa.int64())], ["word", "n"])

    found = rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return found.where(F.col("n") >= fewest)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _finished(sums: np.ndarray, length: int) -> np.ndarray:
    """The hash of a reduced word from its polynomial and its length."""
    z = sums ^ np.uint64(length * 0xD1342543DE82EF95 & (1 << 64) - 1)
    z = (z ^ (z >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (z ^ (z >> np.uint64(32))).view(np.int64)


def reduced(codes: np.ndarray, symbols: int) -> np.ndarray:
    """Symbols, from 1 on, of code points: a letter's symbol is its remainder."""
    return codes % np.uint64(symbols) + np.uint64(1)


def reduced_hashes(codes: np.ndarray, symbols: int) -> np.ndarray:
    """The hash of each word's reduced form; words of one length, as rows of code points."""
    length = codes.shape[1]
    return _finished((reduced(codes, symbols) * _powers(BASE, length)).sum(axis=1, dtype=np.uint64), length)


def neighbour_hashes(codes: np.ndarray, symbols: int) -> np.ndarray:
    """The hashes of the full one-edit neighbourhood of each word's reduced form, itself included, as rows (with repeats).

    One symbol deleted, replaced or inserted at any place; a replacement by the same symbol is the form itself, which
    stands for letters of one symbol.
    """
    rows, length = codes.shape
    own, power = reduced(codes, symbols), _powers(BASE, length + 1)
    terms = own * power[:length]
    before = np.zeros((rows, length + 1), np.uint64)
    np.cumsum(terms, axis=1, out=before[:, 1:])
    whole = before[:, -1:]
    out = [_finished(whole, length), _finished(before[:, :-1] + (whole - before[:, 1:]) * np.uint64(INVERSE), length - 1)]
    shifted = before + (whole - before) * np.uint64(BASE)
    for symbol in range(1, symbols + 1):
        new = np.uint64(symbol)
        out.append(_finished(whole + (new - own) * power[:length], length))
        out.append(_finished(shifted + new * power, length + 1))
    return np.concatenate(out, axis=1)


def _by_length(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, code points) of the words of each length, as rows."""
    texts = words.to_pylist()
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        data = "".join(texts[i] for i in at.tolist()).encode("utf-32-le", "surrogatepass")
        yield at, np.frombuffer(data, np.uint32).reshape(len(at), size).astype(np.uint64)


def with_key(words: DataFrame, symbols: int) -> DataFrame:
    """`words` (word, n) with the hash of the reduced word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.zeros(batch.num_rows, np.int64)
            for at, codes in _by_length(batch.column(0)):
                keys[at] = reduced_hashes(codes, symbols)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys)], ["word", "n", "key"])

    return words.select("word", "n").mapInArrow(run, "word string, n bigint, key bigint")


def neighbourhoods(forms: DataFrame, symbols: int) -> DataFrame:
    """(near_key, key, crowd) for each reduced word (key, crowd, and `word`, any word that has it)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, crowds = np.asarray(batch.column(1)), np.asarray(batch.column(2))
            for at, codes in _by_length(batch.column(0)):
                step = max(1, BLOCK // ((2 * symbols + 1) * (codes.shape[1] + 1)))
                for i in range(0, len(at), step):
                    near = np.sort(neighbour_hashes(codes[i:i + step], symbols), axis=1)
                    new = np.ones(near.shape, bool)
                    new[:, 1:] = near[:, 1:] != near[:, :-1]
                    own = np.repeat(at[i:i + step], new.sum(axis=1))
                    yield from cut([near[new], keys[own], crowds[own]])

    def cut(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(columns[0]), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c[i:i + (1 << 16)]) for c in columns], ["near_key", "key", "crowd"])

    return forms.select("word", "key", "crowd").mapInArrow(run, "near_key bigint, key bigint, crowd int")


def one_edit(a: Column, b: Column) -> Column:
    """Whether two texts differ by exactly one letter inserted, deleted or replaced.

    Long ones are compared behind their first difference, as the usual table of distances grows with the square.
    """
    one, other = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    same = F.zip_with(F.split(one, ""), F.split(other, ""), lambda x, y: x.eqNullSafe(y))
    at, gap = F.array_position(same, False).cast("int"), F.length(other) - F.length(one)
    behind = F.substring(other, at + 1, F.length(other)) == F.substring(one, at + 1 - gap, F.length(other))
    return F.when(F.greatest(F.length(a), F.length(b)) <= LONG, F.levenshtein(a, b, 1) == 1).otherwise((gap <= 1) & (a != b) & behind)


def near_words(words: DataFrame, symbols: int = SYMBOLS, crowd: int = CROWD) -> DataFrame:
    """(word, near, near_n): every ordered pair of words (word, n) that differ by exactly one letter inserted, deleted or replaced.

    Each pair comes once, and no pair is missed.  A reduced word that more than `crowd` words share is a crowd; two
    crowds are not paired word by word, which would grow with the square of a crowd, but their words go to the next
    alphabet, of four times as many symbols, until no crowd is left (at the latest where each letter has a symbol
    of its own).  Words are distinct and not null.
    """
    found, left = [], words
    while True:
        level = cut_lineage(with_key(left, symbols))
        forms = level.groupBy("key").agg(F.min("word").alias("word"), F.count("*").cast("int").alias("crowd"))
        sized = level.join(forms.select("key", "crowd").hint("merge"), "key")
        there = sized.select(F.col("key").alias("near_key"), F.col("word").alias("near"), F.col("n").alias("near_n"), F.col("crowd").alias("near_crowd"))
        met = (
            neighbourhoods(forms, symbols).join(there.hint("merge"), "near_key")
            .where((F.col("crowd") <= crowd) | (F.col("near_crowd") <= crowd)).select("key", "near", "near_n")
        )
        found.append(met.join(level.select("key", "word").hint("merge"), "key").where(one_edit(F.col("word"), F.col("near"))).select("word", "near", "near_n"))
        left = sized.where(F.col("crowd") > crowd).select("word", "n")
        if symbols > 0x10FFFF or left.isEmpty():
            break
        left, symbols = cut_lineage(left), 4 * symbols
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def follow(forms: DataFrame) -> DataFrame:
    """(word, root) for each (word, form): the last word that the forms lead to, by doubling the steps.

    Forms lead from word to word without a circle.  Rounds are about the logarithm of the longest path.
    """
    steps = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        after = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = cut_lineage(steps.join(after.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        moving, steps = not steps.where("moved").isEmpty(), steps.drop("moved")
        if not moving:
            return steps


def spelling_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 5, fewest: int = 3, rate: int = 97, ratio: int = 2,
    symbols: int = SYMBOLS, crowd: int = CROWD,
) -> DataFrame:
    """(word, n, form, root, n_near, form_n) of every word of count_words.

    Near words differ by one letter.  A word's form is its near word with the largest n (ties: the first in code-point
    order) if that n is at least `ratio` (2 or more) times its own; root is where the forms end, or the word itself.
    Words without a near word have n_near 0 and no form.  Without a word there is no row.  Repeated rows count again;
    other columns are not read.
    """
    words = cut_lineage(count_words(docs, id_col, text_col, shortest, fewest, rate))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best")
    near = near_words(words, symbols, crowd).groupBy("word").agg(F.count("*").alias("n_near"), best)
    known = words.join(near.hint("merge"), "word", "left").withColumn("first_n", -F.col("best.less"))
    kept = F.col("first_n") >= ratio * F.col("n")
    known = cut_lineage(known.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(kept, F.col("best.near")).alias("form"), F.when(kept, F.col("first_n")).alias("form_n")))
    roots = follow(known.where("form IS NOT NULL").select("word", "form"))
    return known.join(roots.hint("merge"), "word", "left").select("word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n")
