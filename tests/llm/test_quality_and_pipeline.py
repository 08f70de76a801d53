"""The classifier on held-out rows, and the pipeline's stages on planted cases."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from caseloom.llm.quality import ByteConvNet, chunk_rows, fit, fold, score_quality, train_quality

SF = "/root/testdata/sf0.01"


def test_chunks_cover_every_byte_and_never_the_next_text():
    texts = [b"", b"a", b"b" * 255, b"c" * 256, b"d" * 1000]
    rows, valid, first = chunk_rows(texts)
    assert np.diff(np.append(first, len(rows))).tolist() == [1, 1, 1, 1, 4]
    assert valid.tolist() == [1, 1, 128, 128, 128, 128, 128, 116]
    for text, at, count in zip(texts, first, np.diff(np.append(first, len(rows)))):
        seen = {int(x) for row, n in zip(rows[at:at + count], valid[at:at + count]) for x in row[:2 * n + 6]} - {0}
        assert seen == set(text)


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(0)
    net = ByteConvNet.new(rng, 3, 4, 5)
    texts, labels, weights = [b"some text", b"x" * 600, b"other words here"], np.array([1.0, 0.0, 1.0]), np.ones(3)

    def loss(**changed):
        copy = ByteConvNet(**{n: changed.get(n, getattr(net, n)).copy() for n in ByteConvNet.NAMES})
        return copy.step(texts, labels, weights, 0.0, 1)

    moved = ByteConvNet(**{n: getattr(net, n).copy() for n in ByteConvNet.NAMES})
    moved.step(texts, labels, weights, 1e-9, 1)
    for name in ByteConvNet.NAMES:
        grad = moved._moments[name][0] * 10
        place = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        up, down = getattr(net, name).copy(), getattr(net, name).copy()
        up[place] += 1e-2
        down[place] -= 1e-2
        assert (loss(**{name: up}) - loss(**{name: down})) / 2e-2 == pytest.approx(grad[place], rel=0.15, abs=1e-4)


def test_a_score_does_not_depend_on_the_texts_beside_it():
    net = fit([b"good words here", b"!!## $$ %%"] * 6, np.array([1, 0] * 6), steps=30)
    texts = [b"", b"good words", b"#" * 700, "é".encode() * 300]
    tables = net.tables()
    assert [net.score([t], tables)[0] for t in texts] == net.score(texts, tables).tolist()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = score_quality(docs, train_quality(docs, labels)).join(labels, "doc_id").where(fold("doc_id") == 1)
    rows = scored.select("predicted", "quality").collect()
    good = [r.predicted for r in rows if r.quality == 1]
    bad = [r.predicted for r in rows if r.quality == 0]
    assert np.mean(good) >= 0.97 and 1 - np.mean(bad) >= 0.8


def test_odd_rows_and_no_labels(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 6), (None, "text " * 900, 7), (1, None, 5)], "doc_id bigint, text string, score int")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    found = score_quality(docs, train_quality(docs, none, steps=2)).collect()
    assert len(found) == 4 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    assert score_quality(docs.limit(0), train_quality(docs, none, steps=2)).count() == 0
    labelled = spark.createDataFrame([(1, None), (1, 1), (2, 0), (None, 1)], "doc_id bigint, quality int")
    assert train_quality(docs, labelled, steps=2) is not None


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def planted():
    rng = random.Random(6)

    def prose(n):
        return " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 9))) for _ in range(n))

    passage, base = prose(60), prose(400)
    words = base.split()
    words[200] = "changed"
    return [
        (1, base), (2, base), (3, " ".join(words)), (4, f"{prose(80)} {passage} {prose(80)}"), (5, f"{prose(90)} {passage} {prose(70)}"),
        (6, prose(200)), (7, ""), (8, None), (9, prose(1)), (10, prose(30000)),
    ]


def documents(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    return docs.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("bigint")})


def test_near_copies_and_repeats_of_planted_cases(spark):
    docs = documents(spark, planted())
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert kept.columns == docs.columns
    # Row 3, with one word of 400 changed, goes if its fingerprint is within two bits of row 1's.
    base = planted()[0][1]
    near = (plain_fingerprint(base) ^ plain_fingerprint(planted()[2][1])).bit_count() <= 2
    assert sorted(r.doc_id for r in kept.collect()) == [1, *([] if near else [3]), 4, 5, 6, 7, 9, 10]
    cut = corpus_pipeline.cut_repeats(spark, kept, SF)
    assert cut.schema == docs.select(cut.columns).schema or cut.columns == docs.columns
    before = {r.doc_id: r for r in kept.collect()}
    for r in cut.collect():
        if r.doc_id in (4, 5):
            assert len(r.text.split()) == len(before[r.doc_id].text.split()) - 60 and r.n_chars == len(r.text)
        elif r.doc_id in (1, 3) and not near:
            assert r.text in (base.split()[200], "changed")  # the passages on both sides of the changed word repeat
        else:
            assert r == before[r.doc_id]


def test_stages_in_order_keep_the_columns(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "repeats", "packing"]
    docs = documents(spark, planted())
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    pieces = corpus_pipeline.pack_sequences(spark, docs, SF)
    assert pieces.groupBy("doc_id").agg((F.sum("length") == F.first("doc_tokens")).alias("whole")).where("NOT whole").count() == 0
    assert pieces.select("doc_id").distinct().count() == docs.count()


def test_columns_named_like_results_stay(spark):
    docs = spark.createDataFrame(
        [(1, "good words here", 7, 8, 9, "r", "k", 1), (2, None, 7, 8, 9, "r", "k", 1)],
        "doc_id bigint, text string, score int, n_words int, n_removed int, removed string, kept_text string, predicted int")
    for stage in (corpus_pipeline.cut_repeats, corpus_pipeline.drop_near_copies, corpus_pipeline.drop_low_quality):
        found = stage(spark, docs, SF)
        assert found.columns == docs.columns
        assert {tuple(r)[2:] for r in found.collect()} <= {(7, 8, 9, "r", "k", 1)}


def test_near_copies_match_brute_force(spark):
    """The smallest id of each component of fingerprints at two bits or fewer stays, and nothing else."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.select("doc_id", "text").collect()]
    prints = sorted({f for _, f in rows})
    root = {f: f for f in prints}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for key, f in rows:
        least[find(f)] = min(key, least.get(find(f), key))
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(least.values())


def test_a_large_group_of_copies_and_a_shared_line(spark):
    """A third of all rows are copies: one stays.  Texts of their own around one long shared passage all stay."""
    rng = random.Random(9)
    prose = lambda n: " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randrange(3, 9))) for _ in range(n))
    copy, line = prose(120), prose(20)
    rows = [(i, copy) for i in range(300)] + [(1000 + i, f"{prose(90)} {line}") for i in range(600)]
    kept = corpus_pipeline.drop_near_copies(spark, documents(spark, rows), SF)
    assert sorted(r.doc_id for r in kept.collect()) == [0, *range(1000, 1600)]


def test_stages_of_nothing(spark):
    none = documents(spark, planted()).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_pipeline_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = corpus_pipeline.run(spark, SF)
    assert 0 < found.select("doc_id").distinct().count() < docs.count()
    assert {"pipeline"} | {f"op{i}" for i in range(1, 11)} <= {name.split("_")[0] for name in contract.queries()}
