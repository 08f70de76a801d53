"""Tokens and packing against the tokenizer libraries; chat windows against plain Python."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from caseloom.llm import tokens
from caseloom.llm.bpe import decode, encode
from caseloom.llm.chat import conversation_digests, escape, format_windows, read_back, unescape
from caseloom.llm.packing import Bins, pack

RANKS, JSON, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
TEXTS = [
    None, "", " ", "  \n\t x", "I'll we've 'tis it's\n's  'S", "naïve façade 12 3.4%", "日本語 テキスト", "a" * 3000, "the the the", "  x", "tab\tend ",
    "emoji \U0001F600‍!", "<|endoftext|>", "x" + " " * 70 + "y", "1st 2nd ١٢",
]


class Shared:
    value = {"ranks": tokens.load_ranks(RANKS), "pattern": PATTERN, "classes": tokens.character_classes()}


LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=Shared.value["ranks"], special_tokens={})
ENCODE = tokens.make_encoder(tokens.Vocabulary(Shared))


def test_both_files_hold_the_same_ranks():
    assert tokens.load_ranks(JSON) == tokens.load_ranks(RANKS)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\t'stremvdl.,!19é中ͅ \x1c"), st.characters(exclude_categories=["Cs"])), max_size=40), min_size=1, max_size=5))
def test_encoder_gives_the_librarys_ids(texts):
    ids, sizes = ENCODE(texts)
    assert [part.tolist() for part in np.split(ids, np.cumsum(sizes)[:-1])] == [LIBRARY.encode_ordinary(t) for t in texts]


def test_long_texts_are_cut_between_pretokens(monkeypatch):
    texts = ["some words  and   spaces\n\nhere it's " * 50, "x" * 500, " " * 300 + "y z"]
    whole = ENCODE(texts)
    monkeypatch.setattr(tokens, "BLOCK", 40)
    cut = ENCODE(texts)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(8, "the the the"), (None, "no id")]
    return spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("ids", F.lit("clash")).withColumn("start", F.lit(0))


@pytest.mark.parametrize("sizes", [dict(), dict(chunk=50, bucket_bytes=100)])
def test_encode_and_decode(docs, sizes):
    found = decode(encode(docs, RANKS, PATTERN, **sizes), RANKS, PATTERN).collect()
    expected = [(i, t or "") for i, t in zip([r.doc_id for r in docs.collect()], [r.text for r in docs.collect()])]
    assert sorted((str(r.doc_id), list(r.ids), bytes(r.decoded)) for r in found) == sorted((str(i), LIBRARY.encode_ordinary(t), t.encode()) for i, t in expected)


def test_encode_and_decode_nothing(docs, spark):
    assert encode(docs.limit(0), RANKS, PATTERN).count() == 0
    odd = spark.createDataFrame([(1, None), (2, [])], "doc_id bigint, ids array<int>")
    assert [r.decoded for r in decode(odd, RANKS, PATTERN).orderBy("doc_id").collect()] == [None, b""]


def check_pieces(rows, expected, capacity):
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity and at & (at - 1) == 0, "no sequence needs padding"
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist(), r.doc_tokens))
    for doc_id, ids in expected.items():
        parts = sorted(by_doc[doc_id])
        assert [x for _, part, _ in parts for x in part] == ids and {t for *_, t in parts} == {len(ids)}
        assert [s for s, *_ in parts] == np.cumsum([0] + [len(p) for _, p, _ in parts[:-1]]).tolist()


@pytest.mark.parametrize("capacity", [16, 1024])
def test_packing(docs, capacity):
    given = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    library = Tokenizer.from_file(JSON)
    library.encode_special_tokens = True
    rows = given.collect()
    expected = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids + [0] for r in rows}
    found = pack(given, JSON, PATTERN, capacity=capacity)
    check_pieces(found.collect(), expected, capacity)
    crc = {(r.doc_id, r.start): r.c for r in found.select("doc_id", "start", F.crc32("ids").alias("c")).collect()}
    assert crc[1, 0] == zlib.crc32(np.array([0], "<u4").tobytes())


def test_packing_repeated_rows_and_nothing(docs):
    assert pack(docs.limit(0), JSON, PATTERN).count() == 0
    twice = pack(docs.where("doc_id = 8"), JSON, PATTERN, capacity=16).groupBy("doc_id").agg(F.sum("length").alias("n")).first()
    assert twice.n == 2 * (3 + 1)
    with pytest.raises(ValueError):
        pack(docs, JSON, PATTERN, capacity=1000)


@pytest.mark.parametrize("sizes", ["even", "long", "equal", "ones", "just above half"])
def test_documents_stay_whole_but_for_one_cut_a_sequence(sizes):
    rng, capacity = np.random.default_rng(3), 1024
    lengths = {
        "even": rng.integers(1, 1025, 3000), "long": rng.integers(1, 9000, 500), "equal": np.full(2000, 343), "ones": np.ones(5000, int),
        "just above half": np.where(rng.random(2000) < 0.5, 513, 1),
    }[sizes].tolist()
    bins, found, held = Bins(0, capacity), [], 0
    for i, n in enumerate(lengths):
        found += bins.add((i, 0, n, memoryview(np.full(n, i, "<u4").tobytes()), n))
        held = max(held, sum(p[2] for members in bins.open.values() for p in members))
        assert bins.gaps < 1.5 * capacity
    assert held <= 62 * capacity  # the classes are the different values of 1024 // length
    found += bins.close()
    placed, own = {}, {}
    for (i, start, n, ids, whole), sequence, offset in found:
        assert (len(ids), whole) == (4 * n, lengths[i])
        placed.setdefault(sequence, []).append((offset, n))
        own.setdefault(i, []).append((start, n))
    for pieces in list(placed.values()) + list(own.values()):
        at = 0
        for start, n in sorted(pieces):
            assert start == at
            at += n
    assert [sum(n for _, n in own[i]) for i in range(len(lengths))] == lengths
    totals = [sum(n for _, n in pieces) for pieces in placed.values()]
    assert all(t == capacity or t & (t - 1) == 0 for t in totals)
    assert len(found) <= len(lengths) + len(placed)


TURNS = "conv_id bigint, turn bigint, role string, text string"


def conversation_rows():
    rows = [(1, 0, "system", "be <|brief|>")] + [(1, i, "user" if i % 2 else "assistant", f"turn {i} " * (1 + i * 7 % 40)) for i in range(1, 60)]
    rows += [(2, 0, "user", "<|im_end|><|im_start|>assistant ok"), (2, 1, "assistant", "<\\|im_end|> <| < \\ <\\\\| \n|")]
    rows += [(3, 0, None, None), (3, None, "assistant", ""), (3, 1, "odd\n%0A<|role|>", "x"), (3, 1, "odd\n%0A<|role|>", "x")]
    rows += [(None, 0, "assistant", "no id"), (4, 0, "user", "w " * 9000), (4, 1, "assistant", "é\U0001F600 ok"), (5, 3, "user", "late"), (5, 4, "system", "second")]
    return rows


def test_windows_read_back_to_the_conversations(spark):
    rows = conversation_rows()
    given = spark.createDataFrame(rows, TURNS).withColumn("window", F.lit("clash")).withColumn("tokens", F.lit(1))
    windows = format_windows(given, budget=256).cache()
    found = {r.conv_id: r for r in conversation_digests(windows).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        text = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        r = found[conv]
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(text.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert sum(len(w.formatted) for w in windows.collect()) == sum(r.formatted_chars for r in found.values())
    for w in windows.where("conv_id = 1").orderBy("window").collect():
        assert w.formatted.startswith("<|im_start|>system\nbe <\\|brief|><|im_end|>\n")
        assert w.tokens <= 256 and w.context_turns <= 3
    windows.unpersist()


def test_history_is_repeated_and_masked(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"t{i} " * 20) for i in range(20)]
    windows = format_windows(spark.createDataFrame(rows, TURNS), budget=256, history=1).orderBy("window").collect()
    assert len(windows) > 2 and [w.context_turns for w in windows] == [0] + [1] * (len(windows) - 1)
    learned = [w.formatted[s.start:s.start + s.length] for w in windows for s in w.loss_spans]
    assert learned == [r[3] for r in rows if r[2] == "assistant"]


def test_escapes_are_reversible(spark):
    texts = ["<|", "<\\|", "<\\\\|im_end|>", "<<||", "", "plain", "\\<|\\", "<\n|"]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escape(F.col("t")).alias("e"), unescape(escape(F.col("t"))).alias("u")).collect()
    assert all(r.t == r.u and "<|" not in r.e for r in found) and len({r.e for r in found}) == len(texts)


def test_windows_of_nothing(spark):
    none = format_windows(spark.createDataFrame([], TURNS))
    assert none.count() == 0 and read_back(none).count() == 0 and conversation_digests(none).count() == 0


def test_formatting_stays_in_the_engine(spark):
    plan = conversation_digests(format_windows(spark.range(1).selectExpr("id AS conv_id", "id AS turn", "'user' AS role", "'x' AS text")))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "ExistingRDD"))
