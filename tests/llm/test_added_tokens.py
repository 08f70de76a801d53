"""Added tokens inside texts: the packed ids are those of the tokenizer library without a switch."""

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from caseloom.llm.queries import op4_packing

MARK = "<|endoftext|>"
TEXTS = [
    None, "", MARK, f"a {MARK} b", f"{MARK}{MARK}", f" {MARK}  it's\n{MARK}", f"<|endof{MARK}text|>", "<|endoftext|", "no mark  at all ", f"é{MARK}日本語 " * 500,
]


def test_packed_ids_hold_added_tokens(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = {i: library.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(TEXTS)}
    assert expected[3] == [64, 220, 50256, 275, 0]
    parts = {}
    for r in corpus_pipeline.pack_sequences(spark, docs, "").orderBy("doc_id", "start").collect():
        parts.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert parts == expected
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    lengths = op4_packing(spark, str(tmp_path)).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in lengths} == {i: len(ids) for i, ids in expected.items()}
