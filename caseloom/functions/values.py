"""Number, date and text expressions.  All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, functions as F

from caseloom.functions.columns import col

# Texts that mean "missing" in a delimited file.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# The words that count as negative in a case text.
NEGATIVE_WORDS = (
    "bad", "blocked", "broken", "bug", "cannot", "corrupt", "crash", "critical", "denied", "down",
    "error", "failed", "failure", "fault", "freeze", "hanging", "issue", "outage", "severe", "slow",
    "unable", "urgent", "worst",
)

# English function words left out of TF-IDF terms.  Pass another list where one is needed.
STOP_WORDS = tuple(
    """
    about above across after again against all almost alone along already also although always am
    among an and another any anyone anything anywhere are around as at back be became because become
    been before behind being below beside between beyond both but by can cannot could did do does
    done down due during each either else enough even ever every everyone everything few for former
    from further had has have he hence her here hers herself him himself his how however if in
    indeed into is it its itself just last least less many may me meanwhile might mine more moreover
    most mostly much must my myself neither never next no none nor not nothing now
    of off often on once one only onto or other others otherwise our ours ourselves out over
    own per perhaps please rather re same seem several she should since so some somehow someone
    something still such than that the their them then there these they this those though through
    to together too toward under until up upon us very via was we were what when where whether
    which while who whom whose why will with within without would you your yours
    """.split()
)

NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
WORD_PATTERN = r"([\p{L}\p{N}_]+)"
TERM_PATTERN = r"([\p{L}\p{N}_]{2,})"
ISO_PATTERN = r"^\d{4}-\d{1,2}-\d{1,2}([ T].*)?$"
SLASH_PATTERN = r"^(\d{1,2})[/\-](\d{1,2})[/\-](\d{4})"


def parse_number(value: Column) -> Column:
    """Text to double; anything that is not a plain decimal number is NULL."""
    return F.when(value.rlike(NUMBER_PATTERN), F.trim(value).try_cast("double"))


# Written dates read beside ISO ones; {d} stands for the numeric day and month in the wanted order.  Beside each format is
# a pattern that every text of that format matches, so that others are not tried: a failed parse costs far more.
DATE_FORMATS = {
    "yyyy/M/d": r"^[+-]?\d{4,}/", "{d}/yyyy": r"^[+-]?\d+/[+-]?\d+/[+-]?\d{4}", "{d}/yy": r"^[+-]?\d+/[+-]?\d+/\d\d(\D|$)",
    "d-MMM-yyyy": r"^[+-]?\d+-\D", "d MMM yyyy": r"^[+-]?\d+ \D", "MMM d, yyyy": r"^\D[^,]*, ", "MMM d yyyy": r"^\D[^ ]* [+-]?\d+ ",
    "d.M.yyyy": r"^[+-]?\d+\.", "yyyyMMdd": r"^[+-]?\d{8}",
}
TIME_FORMATS = {
    "": r"^[^:]*$", " H:mm": r"^[^:]*:[^:]*\d$", " H:mm:ss": r"^[^:]*:[^:]*:[^:]*\d$", " h:mm a": r"^[^:]*:[^:]*\D$",
    " h:mm:ss a": r"^[^:]*:[^:]*:[^:]*\D$",
}
OFFSET_PATTERN = r"([ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?) ?(Z|[+-]\d{2}:?\d{2})$"


def parse_timestamp(value: Column, day_first: bool = False) -> Column:
    """ISO and written dates (DATE_FORMATS, with or without a time) to TIMESTAMP_NTZ; anything else is NULL.

    A time with an offset is turned to UTC.  Impossible dates are NULL.
    """
    text = F.trim(value.cast("string"))
    order = "$3-$2-$1" if day_first else "$3-$1-$2"
    iso = F.when(text.rlike(SLASH_PATTERN), F.regexp_replace(text, SLASH_PATTERN, order)).otherwise(text)
    offset = F.regexp_extract(iso, OFFSET_PATTERN, 4)
    minutes = F.when(offset.isin("", "Z"), 0).otherwise(
        F.concat(F.substring(offset, 1, 1), F.lit("1")).try_cast("int")
        * (F.substring(offset, 2, 2).try_cast("int") * 60 + F.right(offset, F.lit(2)).try_cast("int")))
    local = F.when(iso.rlike(ISO_PATTERN), F.regexp_replace(iso, OFFSET_PATTERN, "$1").try_cast("timestamp_ntz"))
    shape = "d/M" if day_first else "M/d"

    def read(form: str) -> Column:
        return F.try_to_timestamp(F.initcap(text) if "MMM" in form else F.upper(text), F.lit(form))

    def timed(date: str) -> Column:
        return F.coalesce(*[F.when(text.rlike(p), read(date.format(d=shape) + t)) for t, p in TIME_FORMATS.items()])

    written = F.coalesce(*[F.when(text.rlike(p), timed(date)) for date, p in DATE_FORMATS.items()])
    return F.coalesce(F.timestamp_add("MINUTE", -minutes, local), F.when(local.isNull(), written.cast("timestamp_ntz")))


def parse_day_first(value: Column) -> Column:
    """Strict `dd/mm/yyyy` or `dd-mm-yyyy`; 31/02 is NULL."""
    text = F.trim(value)
    iso = F.regexp_replace(text, SLASH_PATTERN + "$", "$3-$2-$1")
    return F.when(text.rlike(SLASH_PATTERN + "$"), iso.try_cast("timestamp_ntz"))


def hours_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(3.6e9)


def whole_days_between(start: Column, end: Column) -> Column:
    """Days from `start` to `end`, halves rounded towards the later day."""
    seconds = F.timestamp_diff("MICROSECOND", start, end) / F.lit(1e6)
    return F.floor(seconds / 86400.0 + 0.5).cast("bigint")


def due_priority(target: Column, as_of: Column) -> Column:
    """high when overdue, medium within seven days, else (or without target) low."""
    days = whole_days_between(as_of, target)
    return F.when(days < 0, "high").when(days <= 7, "medium").otherwise("low")


def contains_any(text: Column, parts: Sequence[str]) -> Column:
    found = text.contains(parts[0])
    for part in parts[1:]:
        found = found | text.contains(part)
    return found


# Fixed values below: the keywords of the status and priority buckets.
def status_bucket(status: Column) -> Column:
    """Closed, Escalated, Pending or Open by substring; the first rule that fits wins."""
    text = F.lower(F.trim(F.coalesce(status.cast("string"), F.lit(""))))
    return (
        F.when(contains_any(text, ("closed", "resolved", "completed", "finished")), "Closed")
        .when(text.contains("escalat"), "Escalated")
        .when(text.contains("pending"), "Pending")
        .otherwise("Open")
    )


def priority_bucket(priority: Column) -> Column:
    text = F.lower(F.trim(F.coalesce(priority.cast("string"), F.lit(""))))
    return F.when(text.isin("critical", "high"), "High").when(text == "medium", "Medium").otherwise("Low")


def case_text(names: Iterable[str]) -> Column:
    """Lower-case text of the given columns, joined by one space, NULL as empty."""
    parts = [F.coalesce(col(n).cast("string"), F.lit("")) for n in names]
    return F.lower(F.concat_ws(" ", *parts)) if parts else F.lit("")


def negativity(text: Column) -> Column:
    """Share of word tokens that are in the negative list; 0 for a text without words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD_PATTERN), F.lit(1))
    hits = F.size(F.filter(words, lambda w: w.isin(*NEGATIVE_WORDS)))
    return F.coalesce(F.try_divide(hits.cast("double"), F.size(words).cast("double")), F.lit(0.0))


def tokens(text: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Words of two or more characters, lower-case, without stop words, in order."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM_PATTERN), F.lit(1))
    return F.filter(words, lambda w: ~w.isin(*stop_words)) if stop_words else words


def unigrams_and_bigrams(words: Column) -> Column:
    """All words followed by all pairs of neighbours; `words` should be a plain column."""
    size = F.size(words)
    pairs = F.zip_with(
        F.slice(words, 1, F.greatest(size - 1, F.lit(0))),
        F.slice(words, 2, F.greatest(size - 1, F.lit(0))),
        lambda a, b: F.concat_ws(" ", a, b),
    )
    return F.concat(words, pairs)


def sample_skewness(value: Column) -> Column:
    """Bias-corrected skewness; 0 for fewer than three values or a constant column."""
    n = F.count(value).cast("double")
    corrected = F.skewness(value) * F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(n < 3, 0.0).otherwise(F.coalesce(F.nanvl(corrected, F.lit(0.0)), F.lit(0.0)))
