"""Licence scans against every block and every template."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.llm import licenses
from caseloom.llm.licenses import block_matches, block_tokens, needed, scan_licenses

DOCS = "doc_id bigint, text string"
TEMPLATES = (("a", "alpha beta gamma delta epsilon zeta eta theta"), ("b", "beta, beta one TWO three"), ("c", "zeta eta"), ("a", "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"))
PHRASES = (("cc by", "cc-by"), ("one two three", "count"))


def plain_words(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_scan(text, threshold, step):
    words = plain_words(text)
    places = [(i, label) for phrase, label in PHRASES for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()]
    matches = []
    for j in range(-(-len(words) // step)):
        held = set(words[j * step:(j + 2) * step])
        for number, (label, template) in enumerate(TEMPLATES):
            tokens = set(plain_words(template))
            if len(held & tokens) >= needed(len(tokens), threshold):
                matches.append((j * step, number, label, len(held & tokens) / len(tokens)))
    base = sorted({label for _, label in places})
    starts = [i for i, _ in places]
    return (
        len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(sorted({*base, *(m[2] for m in matches)})),
        1.0 if places else max((m[3] for m in matches), default=0.0), sorted(matches))


def texts(n=150, seed=2):
    rng = random.Random(seed)
    words = sorted({w for _, t in TEMPLATES for w in plain_words(t)})
    out = []
    for _ in range(n):
        own = [rng.choice(words) if rng.random() < 0.5 else f"x{rng.randrange(50)}" for _ in range(rng.randrange(0, 60))]
        if rng.random() < 0.3:
            own[rng.randrange(len(own) + 1):0] = rng.choice(TEMPLATES)[1].split()
        if rng.random() < 0.2:
            own += ["CC-BY", "one", "two", "THREE"]
        out.append(rng.choice((" ", ", ", "\n")).join(own))
    return out + [None, "", " . ", "cc by", "é" * 40, "cc", "by"]


@pytest.mark.parametrize(("threshold", "step", "small"), [(0.9, 32, False), (0.8, 4, False), (0.5, 3, True), (0.2, 5, True)])
def test_scan_matches_brute_force(spark, monkeypatch, threshold, step, small):
    if small:
        monkeypatch.setattr(licenses, "SLICE", 300)
        monkeypatch.setattr(licenses, "BROADCAST", 0)
    rows = list(enumerate(texts())) + [(3, texts()[3]), (None, "cc by cc by")]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"row": F.lit(1), "labels": F.lit("x"), "n_words": F.lit(2)}).repartition(3)
    found = scan_licenses(docs, TEMPLATES, PHRASES, threshold, step=step).collect()
    actual = sorted(((r.doc_id if r.doc_id is not None else -1, *tuple(r)[1:8], [tuple(m) for m in r.matches]) for r in found), key=repr)
    assert actual == sorted(((-1 if i is None else i, *plain_scan(t, threshold, step)) for i, t in rows), key=repr)


def test_a_phrase_does_not_reach_into_the_next_text(spark):
    docs = spark.createDataFrame([(1, "cc"), (2, "by"), (3, "cc by")], DOCS).coalesce(1)
    assert {r.doc_id: r.n_base for r in scan_licenses(docs).collect()} == {1: 0, 2: 0, 3: 1}


def test_prefixes_follow_the_frequency(spark):
    """Of blocks that hold only a template's frequent tokens, none is compared as a whole."""
    blocks = spark.createDataFrame([(1, 0, [0, 1]), (2, 0, [2, 3]), (3, 0, [0, 1, 2, 3])], "row bigint, number bigint, tokens array<int>")
    found = block_matches(blocks, np.array([3, 2, 1, 0], np.int32), [[0, 1, 2, 3]], 0.75).collect()
    assert [(r.row, r.template, r.containment) for r in found] == [(3, 0, 1.0)]


def test_blocks_of_words():
    first, block, token = block_tokens(np.array([0, 1, -1, 0, 5, 1]), np.array([4, 0, 2]), 2, 2)
    assert first.tolist() == [0, 2, 2]
    assert list(zip(block.tolist(), token.tolist())) == [(0, 0), (0, 1), (1, 0), (2, 1)]


def test_long_text_and_nothing(spark):
    text = " ".join(["filler"] * 90_000 + ["released under the MIT License"] + ["filler"] * 50_000)
    found = scan_licenses(spark.createDataFrame([(1, text), (2, "clean words only")], DOCS)).orderBy("doc_id").collect()
    assert [(r.n_words, r.labels, r.score) for r in found] == [(140_005, "mit", 1.0), (3, "", 0.0)]
    assert scan_licenses(spark.createDataFrame([], DOCS)).count() == 0
