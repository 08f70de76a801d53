import math
import re
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from caseloom.functions.columns import col
from caseloom.functions.values import (
    NEGATIVE_WORDS, STOP_WORDS, due_priority, negativity, parse_day_first, parse_number, parse_timestamp, priority_bucket,
    status_bucket,
)
from caseloom.operators import tfidf

TEXTS = [
    "The router reboots, the router is broken", "Router firmware upgrade failed again and again", "",
    "Störung am Gerät: Gerät startet nicht", "firmware upgrade for the router", None, "billing question", "Gerät billing firmware",
]


def brute_force(texts, max_terms):
    docs = []
    for text in texts:
        words = [w for w in re.findall(r"\w{2,}", (text or "").lower()) if w not in STOP_WORDS]
        docs.append(Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])]))
    totals, df = Counter(), Counter()
    for d in docs:
        totals.update(d)
        df.update(d.keys())
    terms = sorted(sorted((t for t in totals if df[t] >= 2), key=lambda t: (-totals[t], t))[:max_terms])
    idf = {t: math.log((1 + len(docs)) / (1 + df[t])) + 1 for t in terms}
    rows = []
    for d in docs:
        raw = [(1 + math.log(d[t])) * idf[t] if d[t] else 0.0 for t in terms]
        norm = math.sqrt(sum(x * x for x in raw))
        rows.append([x / norm if norm else 0.0 for x in raw])
    return terms, rows


@pytest.mark.parametrize("max_terms, pair_words", [(30, 1000), (4, 1000), (4, 3), (6, 1000)])
def test_tfidf_equals_brute_force(spark, monkeypatch, max_terms, pair_words):
    """With and without leaving out rare pairs early."""
    monkeypatch.setattr(tfidf, "MAX_PAIR_WORDS", pair_words)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    vocabulary = tfidf.fit_vocabulary(df, F.col("text"), max_terms)
    terms, expected = brute_force(TEXTS, max_terms)
    assert list(vocabulary.terms) == terms
    rows = tfidf.add_tfidf(df, F.col("text"), vocabulary).orderBy("i").collect()
    for row, want in zip(rows, expected):
        assert [row[c] for c in vocabulary.columns] == pytest.approx(want)


def test_empty_vocabulary_adds_nothing(spark):
    df = spark.createDataFrame([("one",), ("two",)], "text string")
    vocabulary = tfidf.fit_vocabulary(df, F.col("text"))
    assert vocabulary.terms == () and tfidf.add_tfidf(df, F.col("text"), vocabulary).columns == ["text"]


def test_negativity(spark):
    texts = ["Error: link DOWN, all bad", "alles gut", "", None, "Défaut error"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(negativity(F.col("t"))).collect()] == pytest.approx([3 / 5, 0, 0, 0, 0.5])
    assert len(NEGATIVE_WORDS) == 23


def test_buckets(spark):
    rows = [(" CLOSED by x", "Critical"), ("unresolved", "high "), ("Escalated", "MEDIUM"), ("pending closed", "x"), ("new", None), (None, "low")]
    df = spark.createDataFrame(rows, "s string, p string").select(status_bucket(F.col("s")), priority_bucket(F.col("p")))
    assert [tuple(r) for r in df.collect()] == [
        ("Closed", "High"), ("Closed", "High"), ("Escalated", "Medium"), ("Closed", "Low"), ("Open", "Low"), ("Open", "Low"),
    ]


def test_dates(spark):
    texts = ["2024-03-05", "2024-03-05 10:11:12", "2024-13-01", "03/05/2024", "03-05-2024 08:00", "31/02/2024", "soon", None, "2024"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(parse_timestamp(F.col("t"))).collect()] == [
        datetime(2024, 3, 5), datetime(2024, 3, 5, 10, 11, 12), None, datetime(2024, 3, 5), datetime(2024, 3, 5, 8), None, None, None, None,
    ]
    assert [r[0] for r in df.select(parse_timestamp(F.col("t"), day_first=True)).collect()][3] == datetime(2024, 5, 3)
    assert [r[0] for r in df.select(parse_day_first(F.col("t"))).collect()] == [None] * 3 + [datetime(2024, 5, 3)] + [None] * 5


def test_due_priority(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-01-12",), ("2024-03-01",), (None,)], "t string")
    as_of = F.lit("2024-01-10").cast("timestamp_ntz")
    assert [r[0] for r in df.select(due_priority(F.col("t").cast("timestamp_ntz"), as_of)).collect()] == ["high", "medium", "low", "low"]


def test_numbers(spark):
    df = spark.createDataFrame([(t,) for t in ("1", " -2.5e3 ", "1d", "abc", "", None, ".5")], "t string")
    assert [r[0] for r in df.select(parse_number(F.col("t"))).collect()] == [1.0, -2500.0, None, None, None, None, 0.5]


def test_dotted_names(spark):
    df = spark.createDataFrame([(1,)], ["a.b`c"])
    assert df.select(col("a.b`c")).first()[0] == 1
