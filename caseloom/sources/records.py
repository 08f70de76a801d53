"""CSV records with line breaks in quoted fields, read by many tasks from one file.

Tasks read the lines of byte ranges.  Whether a range begins inside a quoted field depends on all text before it, so each
range first tells how it ends if it begins outside of a quote and if it begins inside of one: two bits a range.  Those
functions are composed along each file by running sums, which fixes the state at every range's start; then each task
cuts its lines into records.  A record that goes on into later ranges is put together from its pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

#: Ranges that begin inside a quoted field, and files, that are told to all tasks; with more of them a file is read by one task.
TOLD = 200_000
#: What a row of `_cut` holds: a whole record, the beginning of one, or text that goes on from the range before.
WHOLE, BEGIN, MIDDLE, END = 0, 1, 2, 3


def leaves_open(line: str, inside: bool) -> bool:
    """Whether a quoted field is open at the end of a line that begins at a record's start, or `inside` a quoted field.

    A quote opens a field only as its first character, two quotes inside are one quote, and what follows the closing
    quote belongs to the field up to the next comma.
    """
    at = 0
    while True:
        if inside:
            quote = line.find('"', at)
            if quote < 0:
                return True
            if line.startswith('"', quote + 1):
                at = quote + 2
                continue
            inside, at = False, quote + 1
        elif line.startswith('"', at):
            inside, at = True, at + 1
            continue
        comma = line.find(",", at)
        if comma < 0:
            return False
        at = comma + 1


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, begin) of every line: the file and the byte at which its range begins."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"))


def _ranges(batch: pa.RecordBatch) -> Iterator[tuple[str, int, int, int]]:
    """(file, begin, from, to) of the runs of lines of one range."""
    begins, files = np.asarray(batch.column(2)), pc.dictionary_encode(batch.column(1))
    number = np.asarray(files.indices)
    cuts = np.flatnonzero((begins[1:] != begins[:-1]) | (number[1:] != number[:-1])) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        if b > a:
            yield files.dictionary[int(number[a])].as_py(), int(begins[a]), a, b


def _states(lines: DataFrame) -> DataFrame:
    """(file, begin, outside, inside, broken, ends): a range's end state for each start state, whether its lines alone are
    no records, and how its first line ends: 0 by a line feed, 1 by both characters, 2 with a carriage return inside."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, [False, True, False, 0]
        for batch in batches:
            value = batch.column(0)
            quoted = np.asarray(pc.match_substring(value, '"'))
            returns, inner = np.asarray(pc.ends_with(value, "\r")), np.asarray(pc.match_substring_regex(value, r"\r(?s:.)"))
            blank = np.asarray(pc.match_substring_regex(value, r"^[ \t\r]*[ \t][ \t\r]*$"))
            for file, begin, a, b in _ranges(batch):
                if (file, begin) != now:
                    if now:
                        yield told(now, state)
                    now, state = (file, begin), [False, True, False, 2 if inner[a] else int(returns[a])]
                # Lines that Spark's reader of lines would drop or cut otherwise.
                state[2] |= bool(blank[a:b].any() or inner[a:b].any() or returns[a:b].any() != returns[a:b].all() or returns[a] != (state[3] == 1))
                for i in np.flatnonzero(quoted[a:b]).tolist():
                    line = value[a + i].as_py()
                    state[:2] = [leaves_open(line, s) for s in state[:2]]
                    state[2] |= state[0]
        if now:
            yield told(now, state)

    def told(now, state):
        return pa.RecordBatch.from_pylist(
            [{"file": now[0], "begin": now[1], "outside": state[0], "inside": state[1], "broken": state[2], "ends": state[3]}],
            pa.schema([("file", pa.string()), ("begin", pa.int64()), *[(n, pa.bool_()) for n in ("outside", "inside", "broken")], ("ends", pa.int32())]))

    return lines.mapInArrow(run, "file string, begin bigint, outside boolean, inside boolean, broken boolean, ends int")


def _starts(states: DataFrame) -> DataFrame:
    """(file, begin, open): whether a range begins inside a quoted field.

    A range keeps the state, turns it round, or ends the same way from both; the state before a range is that of the last
    range of the third kind, turned round as often as ranges since then do.
    """
    def path(end: int) -> Window:
        return Window.partitionBy("file").orderBy("begin").rowsBetween(Window.unboundedPreceding, end)

    turns, fixed = F.col("outside") & ~F.col("inside"), F.col("outside") == F.col("inside")
    rows = states.withColumn("turned", F.sum(turns.cast("int")).over(path(0)))
    last = F.last(F.when(fixed, F.struct(F.col("outside").cast("int").alias("state"), "turned")), ignorenulls=True).over(path(-1))
    rows = rows.withColumn("last", last).withColumn("before", F.coalesce(F.max("turned").over(path(-1)), F.lit(0)))
    state = F.coalesce(F.col("last.state"), F.lit(0)) + F.col("before") - F.coalesce(F.col("last.turned"), F.lit(0))
    return rows.select("file", "begin", (state % 2 == 1).alias("open"))


def _cut(lines: DataFrame, opened: set[tuple[str, int]]) -> DataFrame:
    """(kind, file, begin, place, text): the records of every range and the pieces of records over several ranges.

    `opened` are the ranges that begin inside a quoted field.
    """
    names = ["kind", "file", "begin", "place", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, inside, own, place = None, [], False, True, 0
        for batch in batches:
            value, out = batch.column(0), []
            quoted = np.asarray(pc.match_substring(value, '"'))
            for file, begin, a, b in _ranges(batch):
                if (file, begin) != now:
                    if now and held:
                        out.append((BEGIN if own else MIDDLE, *now, place, "\n".join(held)))
                    now, held, place = (file, begin), [], 0
                    inside = now in opened
                    own = not inside
                if not inside and not quoted[a:b].any():
                    texts = value.slice(a, b - a)
                    yield from table(out)
                    out = []
                    n = b - a
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, WHOLE, np.int32)), pa.array([file] * n), pa.array(np.full(n, begin)), pa.array(np.arange(place, place + n)), texts], names)
                    place += n
                    continue
                for i in range(a, b):
                    line = value[i].as_py()
                    held.append(line)
                    if inside or quoted[i]:
                        inside = leaves_open(line, inside)
                    if not inside:
                        out.append((WHOLE if own else END, file, begin, place, "\n".join(held)))
                        held, own, place = [], True, place + 1
            yield from table(out)
        if now and held:
            yield from table([(BEGIN if own else MIDDLE, *now, place, "\n".join(held))])

    def table(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if rows:
            types = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return lines.mapInArrow(run, "kind int, file string, begin bigint, place bigint, text string")


def _joined(pieces: DataFrame) -> DataFrame:
    """(file, begin, place, text) of the records over several ranges, named by where they begin."""
    before = Window.partitionBy("file").orderBy("begin", "place").rowsBetween(Window.unboundedPreceding, 0)
    numbered = pieces.withColumn("record", F.count_if(F.col("kind") == BEGIN).over(before))
    parts = F.sort_array(F.collect_list(F.struct("begin", "place", "text")))
    whole = numbered.groupBy("file", "record").agg(parts.alias("parts"))
    return whole.select("file", F.col("parts")[0]["begin"].alias("begin"), F.col("parts")[0]["place"].alias("place"), F.array_join("parts.text", "\n").alias("text"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Delimited text with a header as text columns, the same rows as from Spark's reader of whole files (`multiLine`).

    Where no line leaves a quoted field open, Spark's reader of lines is right and reads ranges by itself.  Otherwise
    records are cut from ranges as described above.  One task reads a whole file only where its lines end with
    carriage returns alone, or where more than TOLD ranges begin inside of quotes.
    """
    def spark_reads(whole: bool) -> DataFrame:
        return spark.read.csv(path, header=True, inferSchema=False, escape='"', multiLine=whole)

    columns = spark_reads(True).columns
    if not columns:
        return spark_reads(True)
    lines = _lines(spark, path)
    states = _states(lines).persist()
    try:
        first = F.col("begin") == 0
        broken, ends = states.agg(F.bool_or("broken"), F.collect_set(F.when(first, F.col("ends")))).first()
        if len(ends) <= 1 and not broken:
            return spark_reads(False)
        opened = _starts(states).where("open").select("file", "begin").limit(TOLD + 1).collect()
        returns = states.where(first & (F.col("ends") == 1)).select("file").limit(TOLD + 1).collect() if len(ends) > 1 else []
    finally:
        states.unpersist()
    if len(opened) > TOLD or len(returns) > TOLD or 2 in ends:
        return spark_reads(True)
    cut = _cut(lines, {(r.file, r.begin) for r in opened})
    header = (F.col("begin") == 0) & (F.col("place") == 0)
    records = cut.where((F.col("kind") == WHOLE) & ~header).select("file", "text")
    if opened:
        records = records.union(_joined(cut.where(F.col("kind") != WHOLE)).where(~header).select("file", "text"))
    # Spark's reader takes the first line end of a file for all of them and turns it into a line feed.
    both = F.lit(1 in ends) if len(ends) == 1 else F.col("file").isin([r.file for r in returns])
    text = F.when(both, F.regexp_replace(F.replace("text", F.lit("\r\n"), F.lit("\n")), r"\r$", "")).otherwise(F.col("text"))
    fields = ", ".join(f"c{i} string" for i in range(len(columns)))
    parsed = records.select(text.alias("text")).where("text <> ''").select(F.from_csv("text", fields, {"escape": '"', "multiLine": "true"}).alias("r"))
    return parsed.select(*[F.col(f"r.c{i}").alias(c) for i, c in enumerate(columns)])
