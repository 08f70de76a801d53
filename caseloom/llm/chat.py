"""Chat formatting in budgeted windows, with DataFrame functions only.

Prefix sums of the turns' tokens cut a conversation into spans of whole turns.  A window is a span behind the system
turn and a limited history; only the texts of a span's own assistant turns are under the loss mask, so each is learned
once.  Control strings in texts are escaped by a backslash behind `<`, which read_back removes again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from caseloom.session import cut_lineage

START, END = "<|im_start|>", "<|im_end|>\n"
#: Turn numbers whose prefix sums are added up in one place before whole blocks are.
BLOCK = 256


def escape(text: Column) -> Column:
    """`<|` becomes `<\\|`, and a `<` with backslashes before `|` gets one more; the result holds no `<|`."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _role_out(role: Column) -> Column:
    """A role on one line without control strings."""
    for plain, coded in (("%", "%25"), ("\n", "%0A"), ("<", "%3C")):
        role = F.replace(role, F.lit(plain), F.lit(coded))
    return role


def _role_in(role: Column) -> Column:
    for plain, coded in (("<", "%3C"), ("\n", "%0A"), ("%", "%25")):
        role = F.replace(role, F.lit(coded), F.lit(plain))
    return role


def about_tokens(piece: Column) -> Column:
    """Tokens of a formatted turn: a quarter of its bytes, rounded up."""
    return F.ceil(F.octet_length(piece) / 4)


def numbered(turns: DataFrame, unit: int, tokens=about_tokens) -> DataFrame:
    """Each turn with its place, the tokens before it and its span.

    Sums run within blocks of turn numbers and over the blocks' totals, so a conversation with most of all rows is
    spread over tasks.  A turn of more than `unit` tokens is a span of its own; the others share one if the tokens
    before them lie in the same `unit`.
    """
    head = F.concat(F.lit(START), _role_out(F.col("role")), F.lit("\n"))
    piece = F.concat(head, escape(F.col("text")), F.lit(END))
    rows = (
        turns.withColumn("piece", piece).withColumn("head", F.length(head).cast("int")).withColumn("tokens", tokens(F.col("piece")))
        .withColumn("big", (F.col("tokens") > unit).cast("int"))
        .withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 60))))
    )
    within = Window.partitionBy("key", "block").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("key", "block").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"), F.sum("big").alias("b"))
    totals = totals.select("key", "block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in "ntb"])
    rows = rows.join(totals, ["key", "block"])
    sums = {"place": ("n0", F.lit(1)), "begin": ("t0", F.col("tokens")), "bigs": ("b0", F.col("big"))}
    rows = rows.select("*", *[(F.col(base) + F.coalesce(F.sum(own).over(within), F.lit(0))).alias(name) for name, (base, own) in sums.items()])
    span = F.shiftleft(2 * F.col("bigs") + F.col("big"), 40) + F.floor(F.col("begin") / unit)
    return rows.withColumn("span", span)


def format_windows(
    conversations: DataFrame, budget: int = 2048, history: int = 2, tokens=about_tokens,
    conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """(conv_id, window, formatted, context_turns, loss_spans, tokens): all conversations as windows, in the order of `window`.

    A span's turns have at most half the budget, unless one turn alone has more; the history, of at most `history`
    turns, a quarter.  The first system turn is repeated in front of later windows.  context_turns counts repeated
    turns; loss_spans are (start, length) in code points of `formatted`.  Turns are in the order of turn, role and
    text; null roles and texts are empty, null turns come first, rows with a null conv_id are one conversation, and a
    repeated row is a turn of its own.  Other columns are not read.
    """
    turns = conversations.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    ).withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")))
    unit = max(1, budget // 4)
    # Written once: five branches read the turns, each otherwise sorting and adding them up anew.
    rows = cut_lineage(numbered(turns, unit, tokens).select("key", "conv_id", "role", "head", "piece", "tokens", "place", "begin", "span"))
    spans = rows.groupBy("key", "span").agg(F.min("place").alias("first"), F.min("begin").alias("from"))
    lead = F.min_by(F.struct("conv_id", "role", "head", "piece", "tokens", "place"), "place").alias("s")
    system = rows.where("role = 'system'").groupBy("key").agg(lead)
    again = (
        spans.join(system, "key").where(F.col("first") > F.col("s.place"))
        .select("key", "span", F.lit(0).alias("kind"), "s.conv_id", "s.role", "s.head", "s.piece", "s.tokens", "s.place")
    )
    wanted = spans.select("key", F.col("span").alias("to"), "from", F.explode(F.transform(F.sequence(F.lit(1), F.lit(max(1, history))), lambda i: F.col("first") - i)).alias("place"))
    retained = system.select("key", F.col("s.place").alias("place"), F.lit(True).alias("retained"))
    earlier = (
        rows.join(wanted.where(F.col("place") >= 0 if history else F.lit(False)), ["key", "place"]).where(F.col("from") - F.col("begin") <= unit)
        .join(retained, ["key", "place"], "left").where("retained IS NULL")
        .select("key", F.col("to").alias("span"), F.lit(1).alias("kind"), "conv_id", "role", "head", "piece", "tokens", "place")
    )
    own = rows.select("key", "span", F.lit(2).alias("kind"), "conv_id", "role", "head", "piece", "tokens", "place")
    part = F.struct("kind", "place", "role", "head", "piece")
    windows = own.union(again).union(earlier).groupBy("key", "span").agg(
        F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list(part)).alias("parts"), F.sum("tokens").alias("tokens"))
    none = F.array().cast("array<struct<start: int, length: int>>")

    def mask(state: Column, x: Column) -> Column:
        text = F.struct((state["at"] + x["head"]).alias("start"), (F.length(x["piece"]) - x["head"] - len(END)).alias("length"))
        learned = (x["kind"] == 2) & (x["role"] == "assistant")
        return F.struct(
            (state["at"] + F.length(x["piece"])).alias("at"),
            F.when(learned, F.array_append(state["spans"], text)).otherwise(state["spans"]).alias("spans"))

    return windows.select(
        "conv_id", F.col("span").alias("window"), F.array_join(F.transform("parts", lambda x: x["piece"]), "").alias("formatted"),
        F.size(F.filter("parts", lambda x: x["kind"] < 2)).alias("context_turns"),
        F.aggregate("parts", F.struct(F.lit(0).alias("at"), none.alias("spans")), mask, lambda state: state["spans"]).alias("loss_spans"),
        "tokens",
    )


def read_back(windows: DataFrame) -> DataFrame:
    """(conv_id, window, turns, loss_texts): a window's own turns (role, text) and the texts under its mask, unescaped."""
    parts = F.split("formatted", r"<\|im_end\|>\n", -1)
    parts = F.slice(parts, F.col("context_turns") + 1, F.greatest(F.size(parts) - 1 - F.col("context_turns"), F.lit(0)))

    def turn(part: Column) -> Column:
        head = F.substring_index(part, "\n", 1)
        return F.struct(
            _role_in(F.substring(head, len(START) + 1, F.length(head))).alias("role"),
            unescape(F.substring(part, F.length(head) + 2, F.length(part))).alias("text"))

    loss = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return windows.select("conv_id", "window", F.transform(parts, turn).alias("turns"), loss.alias("loss_texts"), F.length("formatted").cast("bigint").alias("chars"))


def conversation_digests(windows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of each conversation, from its output.

    A digest of a whole conversation needs its text in one place; the windows themselves do not.
    """
    back = read_back(windows)
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    part = F.struct("window", text.alias("text"), F.array_join("loss_texts", "").alias("loss"))
    whole = back.groupBy("conv_id").agg(
        F.sum(F.size("turns")).alias("n_turns"), F.sort_array(F.collect_list(part)).alias("parts"), F.sum("chars").alias("formatted_chars"))
    loss = F.array_join(F.transform("parts", lambda p: p["loss"]), "")
    return whole.select(
        "conv_id", F.col("n_turns").cast("bigint").alias("n_turns"), F.sha2(F.array_join(F.transform("parts", lambda p: p["text"]), "").cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
