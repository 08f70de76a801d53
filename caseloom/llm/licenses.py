"""Licence scans as an exact set-similarity join of text blocks with licence templates.

A block is a window of words, a template a short notice; both are sets of tokens in one global order, rare tokens first,
by the number of blocks of all texts that hold a token.  A block meets a template if it holds the share `threshold` of
the template's tokens.  Prefixes find the candidates: such a block shares one of the first tokens of the template, and
does so early enough in its own order; lengths and positions rule out the others before whole sets are compared.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from caseloom.session import cut_lineage

#: Runs of digits, small letters and characters beyond ASCII.
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Phrases that name a licence by themselves, and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Usual notices of public licences: label and text.
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("public-domain", "This is free and unencumbered software released into the public domain"),
)
#: Words from one block to the next; a block has twice as many, so that any passage of STEP words lies in one.
STEP = 32
#: Rows of the prefix index up to which it is broadcast; a larger one is joined by Spark's own choice.
BROADCAST = 50_000
#: Characters read at once.
SLICE = 1 << 22
BLOCKS = "array<array<int>>"
SCHEMA = f"n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels array<string>, numbers array<bigint>, blocks {BLOCKS}, held array<bigint>"


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))


def token_sets(templates: Sequence[tuple[str, str]]) -> list[list[str]]:
    return [sorted(set(words_of(text))) for _, text in templates]


def needed(size: int, threshold: float) -> int:
    """Tokens of a template of `size` tokens that a block has to hold."""
    return max(1, ceil(threshold * size - 1e-9))


def block_tokens(codes: np.ndarray, sizes: np.ndarray, step: int, kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first block of each text, block and code of each distinct token of a block); codes outside 0..kinds-1 are no tokens.

    Block j of a text has its words j * step to (j + 2) * step - 1; a text of n words has one block for each full or
    begun `step` of words.
    """
    counts = -(-sizes // step)
    first = np.cumsum(counts) - counts
    text = np.repeat(np.arange(len(sizes)), sizes)
    at = np.flatnonzero((codes >= 0) & (codes < kinds))
    inner = (at - (np.cumsum(sizes) - sizes)[text[at]]) // step
    block = first[text[at]] + inner
    second = inner > 0
    pairs = np.unique(np.concatenate([block * kinds + codes[at], (block[second] - 1) * kinds + codes[at][second]]))
    return first, pairs // max(1, kinds), pairs % max(1, kinds)


def phrase_starts(codes: np.ndarray, sizes: np.ndarray, phrase: list[int]) -> np.ndarray:
    """Where all words of a phrase stand one after the other within one text."""
    at = np.flatnonzero(codes == phrase[0])
    ends = np.repeat(np.cumsum(sizes), sizes)
    at = at[at + len(phrase) <= ends[at]] if len(at) else at
    for k, code in enumerate(phrase[1:], 1):
        at = at[codes[at + k] == code]
    return at


def scan_blocks(
    docs: DataFrame, sets: list[list[str]], least: int, phrases: Sequence[tuple[str, str]], id_col: str, text_col: str, step: int,
) -> DataFrame:
    """One row per document with its words, phrases and the blocks of at least `least` tokens; one row per task, of row -1,
    with the number of blocks that hold each token (`held`).  Tokens are the numbers of the templates' sorted words."""
    tokens = sorted({w for s in sets for w in s})
    code = {w: i for i, w in enumerate(tokens)}
    kinds = len(tokens)
    for w in (w for phrase, _ in phrases for w in phrase.split()):
        code.setdefault(w, len(code))
    coded = [([code[w] for w in phrase.split()], label) for phrase, label in phrases]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = StructType([*StructType.fromDDL("row bigint"), rows.schema["doc_id"], *StructType.fromDDL(SCHEMA)])
    kinds_of = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int32())), pa.list_(pa.int64())]
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, row, id_type = np.zeros(kinds, np.int64), TaskContext.get().partitionId() << 33, None
        for batch in batches:
            id_type, at, size, lists = batch.column(0).type, 0, 0, []
            for i, value in enumerate(batch.column(1)):
                text = value.as_py() or ""
                if lists and size + len(text) > SLICE:
                    yield made(batch.column(0).slice(at, len(lists)), row + at, lists, held)
                    at, size, lists = i, 0, []
                found = words_of(text)
                lists.append(np.fromiter((code.get(w, -1) for w in found), np.int32, len(found)))
                size += len(text)
            if lists:
                yield made(batch.column(0).slice(at, len(lists)), row + at, lists, held)
            row += batch.num_rows
        if id_type is not None:
            columns = [[0], [0], [None], [None], [[]], [[]], [[]], [held.tolist()]]
            yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.nulls(1, id_type), *map(pa.array, columns, kinds_of)], names)

    def made(ids: pa.Array, row: int, lists: list[np.ndarray], held: np.ndarray) -> pa.RecordBatch:
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        codes = np.concatenate(lists).astype(np.int64)
        begin = np.cumsum(sizes) - sizes
        first, block, token = block_tokens(codes, sizes, step, kinds)
        held += np.bincount(token, minlength=kinds)
        base, low, high, labels = np.zeros(len(lists), np.int64), [None] * len(lists), [None] * len(lists), [[] for _ in lists]
        for phrase, label in coded:
            at = phrase_starts(codes, sizes, phrase)
            for own, place in zip((np.searchsorted(begin + sizes, at, side="right")).tolist(), at.tolist()):
                place -= int(begin[own])
                base[own] += 1
                low[own] = place if low[own] is None else min(low[own], place)
                high[own] = place if high[own] is None else max(high[own], place)
                if label not in labels[own]:
                    labels[own].append(label)
        numbers, blocks = [[] for _ in lists], [[] for _ in lists]
        cut = np.flatnonzero(np.diff(block, prepend=-1))
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(block)]):
            if b - a >= least:
                own = int(np.searchsorted(first, block[a], side="right")) - 1
                numbers[own].append(int(block[a] - first[own]))
                blocks[own].append(token[a:b].tolist())
        columns = [sizes.tolist(), base.tolist(), low, high, labels, numbers, blocks, [None] * len(lists)]
        return pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(lists))), ids, *map(pa.array, columns, kinds_of)], names)

    return rows.mapInArrow(run, schema)


def block_matches(blocks: DataFrame, order: np.ndarray, sets: list[list[int]], threshold: float) -> DataFrame:
    """(row, number, template, containment) of every block (row, number, tokens) that meets a template.

    `order` is each token's place in the global order, `sets` the tokens of the templates.
    """
    spark = blocks.sparkSession
    places = [sorted(int(order[t]) for t in s) for s in sets]
    need = [needed(len(s), threshold) for s in sets]
    rows = [(p[at], i, at, len(p), n, p) for i, (p, n) in enumerate(zip(places, need)) for at in range(len(p) - n + 1)]
    index = spark.createDataFrame(rows, "place int, template int, theirs int, size int, need int, wanted array<int>")
    index = F.broadcast(index) if len(rows) <= BROADCAST else index
    names = ["row", "number", "places"]

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.sort(order[np.asarray(t, np.int64)]).tolist() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.list_(pa.int32()))], names)

    ordered = blocks.select("row", "number", "tokens").mapInArrow(ranked, "row bigint, number bigint, places array<int>")
    prefix = F.slice("places", 1, F.greatest(F.size("places") - min(need) + 1, F.lit(0)))
    met = (
        ordered.select("*", F.posexplode(prefix).alias("at", "place")).join(index, "place")
        .where((F.size("places") >= F.col("need")) & (F.least(F.size("places") - F.col("at"), F.col("size") - F.col("theirs")) >= F.col("need")))
        .withColumn("common", F.array_intersect("places", "wanted"))
    )
    # A pair meets once for each shared prefix token; it is taken where its first common token is.
    met = met.where((F.element_at("common", 1) == F.col("place")) & (F.size("common") >= F.col("need")))
    return met.select("row", "number", "template", (F.size("common") / F.col("size")).alias("containment"))


def scan_licenses(
    docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, threshold: float = 0.9,
    id_col: str = "doc_id", text_col: str = "text", step: int = STEP,
) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches): one row per document.

    `phrases` are found word by word; n_base counts their places, first_word and last_word are the smallest and largest
    start.  `matches` holds every block, by its first word, that contains at least `threshold` of a template's tokens,
    with the template's number and label and the containment.  Labels are distinct, sorted and joined by commas.  score
    is 1 with a phrase, else the largest containment, else 0.  Null and empty texts have no words and no labels;
    repeated rows are scanned each for itself, other columns are not read.  Templates and phrases come from the caller,
    so what tasks get of them does not grow with the documents; texts are not shuffled.
    """
    sets = token_sets(templates)
    if not templates or not all(sets):
        raise ValueError("templates need words")
    tokens = {w: i for i, w in enumerate(sorted({w for s in sets for w in s}))}
    least = min(needed(len(s), threshold) for s in sets)
    found = cut_lineage(scan_blocks(docs, sets, least, phrases, id_col, text_col, step))
    held = found.where("row < 0").select(F.posexplode("held").alias("token", "n")).groupBy("token").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(len(tokens), np.int64)
    for r in held:
        counts[r.token] = r.n
    order = np.empty(len(tokens), np.int32)
    order[np.lexsort((np.arange(len(tokens)), counts))] = np.arange(len(tokens), dtype=np.int32)
    rows = found.where("row >= 0")
    pairs = rows.where(F.size("blocks") > 0).select("row", F.explode(F.arrays_zip("numbers", "blocks")).alias("b")).select("row", "b.numbers", "b.blocks").toDF("row", "number", "tokens")
    label = F.element_at(F.array(*[F.lit(name) for name, _ in templates]), F.col("template") + 1)
    match = F.struct((F.col("number") * step).alias("first_word"), "template", label.alias("label"), "containment")
    matches = block_matches(pairs, order, [[tokens[w] for w in s] for s in sets], threshold).groupBy("row").agg(F.sort_array(F.collect_list(match)).alias("matches"))
    out = rows.join(matches, "row", "left")
    own = F.coalesce("matches", F.array().cast(matches.schema["matches"].dataType))
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return out.withColumn("matches", own).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", joined(F.col("base_labels")).alias("base_labels"),
        joined(F.concat("base_labels", F.col("matches.label"))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.array_max("matches.containment"), F.lit(0.0))).alias("score"), "matches")
