"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.llm import spelling
from caseloom.llm.spelling import count_words, near_words, neighbour_hashes, reduced_hashes, spelling_groups

DOCS = "doc_id bigint, text string"


def plain_words(rows, shortest=5, fewest=3, rate=97):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            total[run if h % rate else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    return {w: n for w, n in total.items() if len(w) >= shortest and n >= fewest}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_groups(words, ratio=2):
    out = {}
    for word, n in words.items():
        others = sorted((-m, w) for w, m in words.items() if near(word, w))
        form = others[0][1] if others and -others[0][0] >= ratio * n else None
        out[word] = (n, len(others), form, words[form] if form else None)
    rows = []
    for word, (n, n_near, form, form_n) in out.items():
        root = word
        while out[root][2]:
            root = out[root][2]
        rows.append((word, form, root, n, n_near, form_n))
    return sorted(rows)


def texts(n=400, seed=3, letters="abcdeéÿ"):
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(4, 9))) for _ in range(60)]

    def word():
        own = list(rng.choice(base))
        if rng.random() < 0.3:
            at = rng.randrange(len(own))
            own[at:at + 1] = rng.choice(([], [rng.choice(letters)], [own[at], rng.choice(letters)]))
        out = "".join(own)
        return out.upper() if rng.random() < 0.1 else out

    return [(i, rng.choice((" ", ", ", "\n", "9")).join(word() for _ in range(rng.randrange(0, 40)))) for i in range(n)]


@pytest.mark.parametrize("settings", [dict(), dict(symbols=2), dict(symbols=2, crowd=1), dict(symbols=3, crowd=4)])
def test_groups_match_brute_force(spark, settings):
    rows = texts() + [(None, "eabcd eabcd eabcd"), (7, None), (8, ""), (5, texts()[5][1]), (5, texts()[5][1])]
    rows += [(900, "nnnnna " * 3), (901, "nnnnnb " * 6), (902, "nnnnbb " * 12)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"word": F.lit(1), "n": F.lit("x"), "key": F.lit(2)})
    found = spelling_groups(docs, **settings).select("word", "form", "root", "n", "n_near", "form_n").collect()
    expected = plain_groups(plain_words(rows))
    assert sorted(tuple(r) for r in found) == expected
    assert any(r[2] != r[0] and r[2] != r[1] for r in expected)  # some root is two forms away


def test_a_neighbourhood_holds_every_edit():
    word, symbols = "abxay", 3
    codes = np.array([[ord(c) for c in word]], np.uint64)
    reach = set(neighbour_hashes(codes, symbols)[0].tolist())

    def key(text):
        return int(reduced_hashes(np.array([[ord(c) for c in text]], np.uint64), symbols)[0])

    edits = {word[:i] + word[i + 1:] for i in range(5)} | {word[:i] + c + word[i + j:] for i in range(6) for j in (0, 1) for c in "abcdefghijklmnopqrstuvwxyz"}
    assert {key(e) for e in edits if len(e) in (4, 5, 6)} == reach


def test_words_of_one_reduced_form_go_to_finer_alphabets(spark):
    """All words share one reduced form: with crowds of two they are told apart by later alphabets only."""
    letters = [chr(97 + 5 * i) for i in range(5)]
    words = [a + b + c + d + "a" for a in letters for b in letters for c in letters for d in letters]
    table = spark.createDataFrame([(w, i + 3) for i, w in enumerate(words)], "word string, n bigint")
    found = near_words(table, symbols=5, crowd=2).collect()
    assert len(found) == len(words) * 16 == len({(r.word, r.near) for r in found})
    assert all(near(r.word, r.near) for r in found)


def test_very_long_words_and_nothing(spark):
    long = "ab" * 30000
    other = spark.createDataFrame([(long, a) for a in (long, long[1:], long[:700] + long[701:], "b" + long[1:], long[:-2] + "xy", "x" + long[1:-1] + "y", long + "b", long[2:])], "a string, b string")
    assert [r[0] for r in other.select(spelling.one_edit(F.col("a"), F.col("b"))).collect()] == [False, True, True, True, False, False, True, False]
    rows = [(i, f"{long} {long[:-1]} {long[1:]}") for i in range(3)]
    found = {r.word: r for r in spelling_groups(spark.createDataFrame(rows, DOCS), rate=1 << 40).collect()}
    assert {len(w): r.n_near for w, r in found.items()} and {len(w) for w in found} == {60000, 59999}
    assert found[long].n_near == 2 and found[long[:-1]].n_near == 1
    assert spelling_groups(spark.createDataFrame([], DOCS)).count() == 0
    assert spelling_groups(spark.createDataFrame([(1, None), (2, "a b c")], DOCS)).count() == 0


def test_counts_survive_the_flush(spark, monkeypatch):
    monkeypatch.setattr(spelling, "COUNTED", 20)
    rows = texts(120, 8)
    assert {r.word: r.n for r in count_words(spark.createDataFrame(rows, DOCS)).collect()} == plain_words(rows)
