"""Ticket preparation and text features.  Texts are used whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from caseloom.functions.columns import col, normalise_names
from caseloom.functions.values import NEGATIVE_WORDS, STOP_WORDS, WORD_PATTERN, case_text, negativity
from caseloom.operators.encoding import product_flags
from caseloom.operators.tfidf import fit_vocabulary, tfidf_long, top_terms
from caseloom.operators.tickets import (
    add_negativity, add_resolution_hours, add_sla_hours, clean_numbers, feature_drop_list, prepare_tickets,
)
from registry.base import query, read, read_spread, rounded, tickets


def words_sql(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def back(df: DataFrame) -> DataFrame:
    """Column names with underscores, as in the SQL views."""
    return df.toDF(*["descr" if c == "desc" else c.replace(" ", "_") for c in df.columns])


HOURS = "date_diff('microsecond', {a}, {b}) / 3.6e9"


@query("normalised_names", "SELECT o_orderkey AS \"case number\", o_orderstatus AS status FROM orders")
def normalised(spark: SparkSession, sf: str) -> DataFrame:
    orders = read(spark, sf, "orders")
    return normalise_names(orders.select(F.col("o_orderkey").alias(" Case Number "), F.col("o_orderstatus").alias("STATUS")))


@query("sla_hours", f"""
    SELECT case_number, round({HOURS.format(a="date_open", b="solution_target")}, 6) AS target_solution_hours,
      round({HOURS.format(a="date_open", b="call_back_target")}, 6) AS target_callback_hours,
      round(greatest(0.0, {HOURS.format(a="date_open", b="(SELECT max(date_open) FROM {cases} r)")}), 6) AS hours_open
    FROM {{cases}} c""")
def sla_hours(spark: SparkSession, sf: str) -> DataFrame:
    hours = add_sla_hours(tickets(spark, sf))
    return rounded(back(hours).select("case_number", "target_solution_hours", "target_callback_hours", "hours_open"))


@query("resolution_hours", f"""
    SELECT case_number, round({HOURS.format(a="date_open", b="solution_target")}, 6) AS resolution_hours FROM {{cases}} c""")
def resolution(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(back(add_resolution_hours(tickets(spark, sf))).select("case_number", "resolution_hours"))


@query("clean_dirty_numbers", """
    WITH t AS (SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderstatus = 'P' THEN 'n/a' ELSE CAST(o_totalprice AS VARCHAR) END AS DOUBLE) AS v
               FROM orders)
    SELECT o_orderkey, round(coalesce(v, (SELECT median(v) FROM t)), 6) AS resolution_time, 0.0::DOUBLE AS hours_open FROM t""")
def dirty_numbers(spark: SparkSession, sf: str) -> DataFrame:
    orders = read(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("resolution_time"),
        F.lit("none").alias("hours_open"),
    )
    return rounded(clean_numbers(orders))


@query("case_text", "SELECT doc_id, lower(source || ' ' || coalesce(text, '')) AS case_text FROM documents")
def texts_joined(spark: SparkSession, sf: str) -> DataFrame:
    return read_spread(spark, sf).select("doc_id", case_text(["source", "text"]).alias("case_text"))


WORDS = r"regexp_extract_all(lower({t}), '[\p{L}\p{N}_]+')"


@query("negativity_score", f"""
    SELECT event_id, round(CASE WHEN len(w) = 0 THEN 0.0::DOUBLE ELSE len(list_filter(w, lambda x: x IN ({words_sql(NEGATIVE_WORDS)})))::DOUBLE / len(w) END, 6)
      AS text_negativity_score
    FROM (SELECT event_id, {WORDS.replace("{t}", "event_type || ' ' || props")} AS w FROM events) t""")
def negativity_of_events(spark: SparkSession, sf: str) -> DataFrame:
    tickets_like = read(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("subject"), F.col("props").alias("desc")
    )
    return rounded(add_negativity(tickets_like).select("event_id", "text_negativity_score"))


@query("negativity_of_documents", f"""
    SELECT doc_id, round(CASE WHEN len(w) = 0 THEN 0.0::DOUBLE ELSE len(list_filter(w, lambda x: x IN ({words_sql(NEGATIVE_WORDS)})))::DOUBLE / len(w) END, 6)
      AS score, len(w) AS words
    FROM (SELECT doc_id, {WORDS.replace("{t}", "text")} AS w FROM documents) t""")
def negativity_of_documents(spark: SparkSession, sf: str) -> DataFrame:
    words = F.size(F.regexp_extract_all(F.lower("text"), F.lit(WORD_PATTERN), F.lit(1))).cast("bigint")
    return rounded(read_spread(spark, sf).select("doc_id", negativity(F.col("text")).alias("score"), words.alias("words")))


def grams_sql(source: str, key: str, text: str) -> str:
    """`key, term` of every word and word pair of each text."""
    return f"""
      words AS (SELECT {key} AS k, list_filter(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
          lambda x: x NOT IN ({words_sql(STOP_WORDS)})) AS w FROM {source}),
      grams AS (SELECT k, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM words),
      top AS (SELECT term, count(*) AS n, count(DISTINCT k) AS documents,
          ln((1.0 + (SELECT count(*) FROM words)) / (1.0 + count(DISTINCT k))) + 1.0 AS idf
        FROM grams GROUP BY term HAVING count(DISTINCT k) >= 2 ORDER BY n DESC, term LIMIT 30)"""


@query("tfidf_terms", f"WITH {grams_sql('documents', 'doc_id', 'text')} SELECT term, n, documents, round(idf, 6) AS idf FROM top")
def tfidf_terms(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(top_terms(read_spread(spark, sf), F.col("text")))


@query("tfidf_weights", f"""
    WITH {grams_sql('documents', 'doc_id', 'text')},
    raw AS (SELECT k, g.term, (1 + ln(count(*))) * any_value(idf) AS x FROM grams g JOIN top USING (term) GROUP BY k, g.term)
    SELECT k AS doc_id, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY k)), 6) AS weight FROM raw""")
def tfidf_weights_of_documents(spark: SparkSession, sf: str) -> DataFrame:
    documents = read_spread(spark, sf)
    return rounded(tfidf_long(documents, "doc_id", F.col("text"), fit_vocabulary(documents, F.col("text"))))


@query("tfidf_new_text", f"""
    WITH {grams_sql('documents', 'doc_id', 'text')},
    newer AS (SELECT conv_id || '-' || turn AS k, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
        lambda x: x NOT IN ({words_sql(STOP_WORDS)})) AS w FROM conversations),
    found AS (SELECT k, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM newer),
    raw AS (SELECT k, f.term, (1 + ln(count(*))) * any_value(idf) AS x FROM found f JOIN top USING (term) GROUP BY k, f.term)
    SELECT k AS message, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY k)), 6) AS weight FROM raw""")
def tfidf_of_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns weighted with the vocabulary fitted on the documents."""
    vocabulary = fit_vocabulary(read_spread(spark, sf), F.col("text"))
    messages = read_spread(spark, sf, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("message"), "text"
    )
    return rounded(tfidf_long(messages, "message", F.col("text"), vocabulary))


@query("product_flags", """
    SELECT product, count(*) AS cases, sum(flag)::BIGINT AS own_flag, sum(flags)::BIGINT AS all_flags FROM (
      SELECT coalesce(product, 'none') AS product, CASE WHEN product IS NULL THEN 0 ELSE 1 END AS flag,
        CASE WHEN product IS NULL THEN 0 ELSE 1 END AS flags FROM {full_cases} c) t GROUP BY 1""")
def products(spark: SparkSession, sf: str) -> DataFrame:
    """Cases per product, with the sum of the product's own flag and of all flags."""
    flagged = product_flags(tickets(spark, sf, "full_cases").select("product"))
    names = [c for c in flagged.columns if c.startswith("prod_")]
    own = F.coalesce(*[F.when(F.col("product") == c.removeprefix("prod_"), col(c)) for c in names], F.lit(0))
    total = sum((col(c) for c in names), F.lit(0))
    return flagged.groupBy(F.coalesce("product", F.lit("none")).alias("product")).agg(
        F.count("*").alias("cases"), F.sum(own).cast("bigint").alias("own_flag"), F.sum(total).cast("bigint").alias("all_flags")
    )


@query("dropped_ticket_columns", """
    SELECT case_owner, count(*) AS n, count(status_known) AS status_known FROM (
      SELECT case_owner, CAST(NULL AS INT) AS status_known FROM {cases} c) t GROUP BY 1""")
def dropped_columns(spark: SparkSession, sf: str) -> DataFrame:
    """After dropping IDs, dates, texts and status for the resolution task only the owner is left."""
    cases = tickets(spark, sf)
    left = cases.drop(*feature_drop_list(cases, "resolution"))
    if left.columns != ["case owner"]:
        raise ValueError(f"unexpected columns left: {left.columns}")
    return back(left).groupBy("case_owner").agg(F.count("*").alias("n")).withColumn("status_known", F.lit(0).cast("bigint"))


@query("prepared_tickets", f"""
    WITH t AS (SELECT *, {HOURS.format(a="date_open", b="solution_target")} AS rh,
        greatest(0.0, {HOURS.format(a="date_open", b="(SELECT max(date_open) FROM {full_cases} r)")}) AS ho,
        {HOURS.format(a="date_open", b="call_back_target")} AS ch FROM {{full_cases}} c)
    SELECT case_owner, count(*) AS n, count(rh) AS with_target, round(sum(rh), 3) AS resolution_hours,
      round(sum(ho), 3) AS hours_open, round(sum(ch), 3) AS callback_hours, count(product) AS product_flags
    FROM t GROUP BY case_owner""")
def prepared(spark: SparkSession, sf: str) -> DataFrame:
    """The resolution task's features, summed per owner."""
    features, target, recipe = prepare_tickets(tickets(spark, sf, "full_cases"), "resolution")
    flags = sum((col(f"prod_{p}") for p in recipe.products), F.lit(0))
    return features.groupBy(F.col("`case owner`").alias("case_owner")).agg(
        F.count("*").alias("n"), F.count(target).alias("with_target"), F.round(F.sum(target), 3).alias("resolution_hours"),
        F.round(F.sum("hours_open"), 3).alias("hours_open"),
        F.round(F.sum("target_callback_hours"), 3).alias("callback_hours"), F.sum(flags).cast("bigint").alias("product_flags"),
    )
