"""Line-first quality rules, in DataFrame functions alone.

Every line is judged by itself (punctuation, navigation, boilerplate, symbols, capitals);
failing lines are taken out, and a document that loses too much of its text that way, or that
fails the base rules on length and repetition, is rejected.

Lines without a word never fail and stay where they are: a text without failing lines is left as it is.

Null texts count as empty; an empty or blank text has no words and fails the base rules.
Repeated rows are judged one by one. Other columns are carried along untouched; columns of
the input that share a name with one of the results are replaced by the result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.llm.shared import WS, WS_CHARS, text_or_empty

# Phrases of site furniture, found in lower-cased lines.
BOILERPLATE = (
    "all rights reserved",
    "terms of use",
    "terms of service",
    "privacy policy",
    "cookie policy",
    "cookie settings",
    "uses cookies",
    "use cookies",
    "accept cookies",
    "accept all cookies",
    "enable javascript",
    "javascript is disabled",
    "javascript is required",
    "subscribe to our newsletter",
    "sign up for our",
    "click here to",
    "back to top",
    "skip to content",
    "skip to main content",
    "follow us on",
    "powered by wordpress",
    "lorem ipsum",
)
TERMINAL = "[.!?…:;。！？][\"'”’»)\\]]*[\\x20\\x09-\\x0D]*$"
#: What TERMINAL allows between the punctuation and the white space at the end.
CLOSERS = "\"'”’»)]"
SEPARATOR = r"(?<![^\x20\x09-\x0D])[|>»·•/\\~-]+(?![^\x20\x09-\x0D])"
SYMBOLIC = r"([#*$%&<>]{2,}[.,]?|!!+)(?![^\x20\x09-\x0D])"
SYMBOLS = "#*$%&|<>"

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A document is rejected when failing lines hold more than this share of its words.
MAX_LOST = 0.5
#: A line without final punctuation fails when it has fewer words and no punctuation inside.
SHORT_LINE = 8


def words_of(text: Column) -> Column:
    trimmed = F.trim(text, F.lit(WS_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WS))


def _repeat_positions(windows: Column, words: Column, bits: Column) -> Column:
    """Sorted positions of the windows whose hash and words equal those of a neighbour in (hash, position) order."""
    low = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1

    def equal(x: Column, y: Column) -> Column:
        i, j = x.bitwiseAND(low).cast("int"), y.bitwiseAND(low).cast("int")
        same = F.call_function("shiftright", x, bits) == F.call_function("shiftright", y, bits)
        return same & (F.get(words, i) == F.get(words, j)) & (F.get(words, i + 1) == F.get(words, j + 1)) & (F.get(words, i + 2) == F.get(words, j + 2))

    found = F.filter(windows, lambda x, k: F.coalesce(equal(x, F.get(windows, k - 1)), F.lit(False)) | F.coalesce(equal(x, F.get(windows, k + 1)), F.lit(False)))
    return F.sort_array(F.transform(found, lambda x: x.bitwiseAND(low)))


def line_fails(line: Column, lowered: Column, end: Column) -> Column:
    """Whether a line that has words fails a rule; patterns run on the lines that can match them."""
    n = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))
    return (
        F.when(line.rlike(r"[|>»·•/\\~-]"), F.regexp_count(line, F.lit(SEPARATOR)) > 0.2 * n).otherwise(False)
        | F.when(line.rlike(r"[#*$%&<>]{2}|!!"), F.regexp_count(line, F.lit(SYMBOLIC)) > 0.3 * n).otherwise(False)
        | _has_any(lowered)
        | F.when(line.rlike(r"\p{Ll}"), False).otherwise(line.rlike(r"\p{Lu}") & (n >= 5))
        | F.when(end.rlike(TERMINAL) | line.rlike("[.,;:!?]"), False).otherwise(n < SHORT_LINE)
    )


def _has_any(lowered: Column) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(lowered, F.lit(p)) for p in BOILERPLATE))


def quality_columns(docs: DataFrame, min_words: int = MIN_WORDS, max_repeat_percent: float = MAX_REPEAT_PERCENT, max_lost: float = MAX_LOST) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_failed_lines, lost_share, clean_text, base_failed and kept.

    word_chars: code points in words. n_dup_lines: lines with a word that equal an earlier line.
    n_repeat_words: words inside three-word windows that occur twice or more in the text.
    clean_text: the text without its failing lines.
    """
    text = F.col("__text")
    rows = docs.withColumn("__text", text_or_empty())
    rows = rows.withColumn("__words", words_of(text)).withColumn("__lines", F.split(text, "\n", -1))
    rows = rows.withColumn("n_words", F.size("__words").cast("long"))
    w = F.col("__words")
    rows = rows.withColumn("__bits", F.length(F.bin(F.col("n_words"))))
    high = F.call_function("shiftleft", F.lit(-1).cast("long"), F.col("__bits"))
    rows = rows.withColumn(
        "__windows",
        F.when(
            F.col("n_words") >= 3,
            F.sort_array(F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(high).bitwiseOR(i))),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    rows = rows.withColumn("__repeats", _repeat_positions(F.col("__windows"), w, F.col("__bits")))
    rows = rows.withColumn(
        "__judged",
        F.transform(
            F.transform(  # a lambda evaluates what it names each time it is named
                "__lines",
                lambda x: F.struct(x.alias("line"), x.rlike(r"[^\x20\x09-\x0D]").alias("says"), F.lower(x).alias("low"), F.substring(F.rtrim(F.rtrim(x, F.lit(WS_CHARS)), F.lit(CLOSERS)), -1, 1).alias("end")),
            ),
            lambda x: F.struct(x["line"].alias("line"), x["says"].alias("says"), F.when(x["says"], line_fails(x["line"], x["low"], x["end"])).otherwise(False).alias("fails")),
        ),
    )
    r = F.col("__repeats")
    lines = F.transform(F.filter("__judged", lambda x: x["says"]), lambda x: x["line"])
    clean = F.array_join(F.transform(F.filter("__judged", lambda x: ~x["fails"]), lambda x: x["line"]), "\n")
    failed = F.array_join(F.transform(F.filter("__judged", lambda x: x["fails"]), lambda x: x["line"]), "\n")
    lost = F.regexp_count(failed, F.lit(r"[^\x20\x09-\x0D]+"))
    rows = rows.withColumns(
        {
            "word_chars": F.length(text).cast("long") - F.length(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "")),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": F.aggregate(
                F.transform(r, lambda x, k: F.when(k == 0, F.lit(3).cast("long")).otherwise(F.least(F.lit(3).cast("long"), x - F.get(r, k - 1)))), F.lit(0).cast("long"), lambda a, x: a + x
            ),
            "n_failed_lines": F.size(F.filter("__judged", lambda x: x["fails"])).cast("long"),
            "lost_share": F.coalesce(lost / F.nullif(F.col("n_words"), F.lit(0)), F.lit(0.0)),
            "clean_text": clean,
        }
    )
    rows = rows.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")))
    rows = rows.withColumn("kept", ~F.col("base_failed") & (F.col("lost_share") <= max_lost))
    return rows.drop("__text", "__words", "__lines", "__windows", "__repeats", "__judged", "__bits")


def quality_filter(docs: DataFrame) -> DataFrame:
    """The documents that pass, without their failing lines, with the columns they came with (n_chars anew)."""
    marked = quality_columns(docs.select(F.struct("*").alias("__row"), text_or_empty().alias("text")))
    row = F.col("__row").withField("text", F.col("clean_text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("clean_text").cast(docs.schema["n_chars"].dataType))
    # A filter would be pushed below the columns it reads and evaluate them again for each word; it can't pass a generator.
    passed = marked.select(F.explode_outer(F.when(F.col("kept"), F.array(row))).alias("__row"))
    return passed.filter(F.col("__row").isNotNull()).select("__row.*")
