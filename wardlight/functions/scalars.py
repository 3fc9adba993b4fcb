"""Scalar functions as Column expressions; nothing here runs Python on rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MASK = (1 << 32) - 1
# Avatar colours.
PALETTE = ("#7c68ff", "#4c8dff", "#4dcc88", "#f4a942", "#ff6b9d", "#4ec9c9", "#a78bfa", "#fb923c")
# Clinical abbreviations in the order of their replacement.
ABBREVIATIONS = {
    "icu": "intensive care unit",
    "ed": "emergency department",
    "nicu": "neonatal intensive care unit",
    "los": "length of stay",
    "bp": "blood pressure",
    "hr": "heart rate",
    "o2": "oxygen saturation",
    "spo2": "oxygen saturation",
    "temp": "temperature",
    "pt": "patient",
    "pts": "patients",
    "dx": "diagnosis",
    "hx": "history",
    "adm": "admission",
    "dc": "discharge",
    "icd": "icd10 diagnosis code",
}


def _codes(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long")))


def _signed(x: Column) -> Column:
    x = x.bitwiseAND(F.lit(_MASK))
    return F.when(x >= 1 << 31, x - (1 << 32)).otherwise(x)


def hash31(text: Column) -> Column:
    """Java-style string hash as a signed 32-bit number (code units below 0x10000)."""
    return _signed(F.aggregate(_codes(text), F.lit(0).cast("long"), lambda h, c: (h * 31 + c).bitwiseAND(F.lit(_MASK))))


def patient_token(identifier: Column) -> Column:
    text = identifier.cast("string")
    return F.when(text.isNull(), "[REDACTED]").otherwise(F.concat(F.lit("PT-"), F.lpad(F.hex(F.abs(hash31(text))), 8, "0")))


def cache_key(*parts: Column) -> Column:
    """Multiply-and-xor hash of the parts joined by bars, in base 36."""
    joined = F.concat_ws("|", *parts)
    h = F.aggregate(_codes(joined), F.lit(5381).cast("long"), lambda a, c: (a * 33).bitwiseAND(F.lit(_MASK)).bitwiseXOR(c))
    return F.lower(F.conv(h.cast("string"), 10, 36))


def avatar_color(name: Column) -> Column:
    h = F.aggregate(_codes(name), F.lit(0).cast("long"), lambda a, c: c + _signed(a * 32) - a)
    return F.element_at(F.array(*map(F.lit, PALETTE)), (F.abs(h) % len(PALETTE) + 1).cast("int"))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def mentions(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit("(?i)@([a-z0-9_]+)"), 1), F.lower)


def mention_prefix(text: Column) -> Column:
    """What is being typed after a final @, or null."""
    return F.when(text.rlike("@[A-Za-z0-9_]*$"), F.regexp_extract(text, "@([A-Za-z0-9_]*)$", 1))


def mention_parts(text: Column) -> Column:
    """The text cut at its mentions, which stay as parts of their own; parts between two mentions may be empty."""
    return F.split(F.regexp_replace(text, "(?i)(@[a-z0-9_]+)", "\u0001$1\u0001"), "\u0001", -1)


def mention_candidate(username: Column, display: Column, typed: Column) -> Column:
    return F.contains(username, typed) | F.contains(F.lower(display), typed)


def clipped(text: Column, most: int = 300) -> Column:
    return F.left(text, F.lit(most))


def expand_abbreviations(text: Column) -> Column:
    out = F.lower(text)
    for short, long in ABBREVIATIONS.items():
        out = F.regexp_replace(out, rf"\b{short}\b", long)
    return out


def one_decimal(y: Column) -> Column:
    """A positive number with one decimal, rounded by its exact binary value, ties up."""
    y = y.cast("double")
    # 20 * y is exactly s + e; both products are exact.
    a, b = y * 16, y * 4
    s = a + b
    e = (a - (s - (s - a))) + (b - (s - a))
    twentieths = F.floor(s) - ((s == F.floor(s)) & (e < 0)).cast("long")
    tenths = F.floor((twentieths + 1) / 2).cast("long")
    # Beyond that, numbers are whole and halves of a long are not exact.
    return F.when(y < 1e14, F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))).otherwise(F.format_string("%.1f", y))


def abbreviate_number(x: Column) -> Column:
    """In millions or thousands with one decimal; below a thousand with grouping and at most three decimals."""
    small = F.call_function("format_number", F.round(x.cast("double"), 3), F.lit("#,##0.###"))
    return F.when(x >= 1e6, F.concat(one_decimal(x / 1e6), F.lit("M"))).when(x >= 1e3, F.concat(one_decimal(x / 1e3), F.lit("K"))).otherwise(small)


def leading_number(text: Column) -> Column:
    """The number a text begins with, else 0."""
    return F.coalesce(F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double"), F.lit(0.0))


def relative_time(then: Column, now: Column) -> Column:
    minutes = F.floor((F.unix_micros(now) - F.unix_micros(then)) / 60_000_000)
    plural = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))
    hours, days = F.floor(minutes / 60), F.floor(minutes / 1440)
    return F.when(minutes < 1, "just now").when(minutes < 60, plural(minutes, "minute")).when(hours < 24, plural(hours, "hour")).otherwise(plural(days, "day"))


def short_age(then: Column, now: Column) -> Column:
    """`5m ago`, `3h ago`, `2d ago`; never fired alerts have no time."""
    minutes = F.floor((F.unix_micros(now) - F.unix_micros(then)) / 60_000_000)
    count = F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m"))).when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("string"), F.lit("h")))
    return F.when(then.isNull(), "Never").otherwise(F.concat(count.otherwise(F.concat(F.floor(minutes / 1440).cast("string"), F.lit("d"))), F.lit(" ago")))


def due_in(then: Column, now: Column) -> Column:
    """`in 5m`, `in 3h`, `in 2d`, or Overdue."""
    minutes = F.floor((F.unix_micros(then) - F.unix_micros(now)) / 60_000_000)
    count = F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m"))).when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("string"), F.lit("h")))
    return F.when(then < now, "Overdue").otherwise(F.concat(F.lit("in "), count.otherwise(F.concat(F.floor(minutes / 1440).cast("string"), F.lit("d")))))


def next_delivery(frequency: Column, hour: Column, minute: Column, now: Column) -> Column:
    """Next run of a Daily, Weekly (Monday) or Monthly (first day) schedule strictly after now."""
    at = lambda day: F.make_timestamp(F.year(day), F.month(day), F.dayofmonth(day), hour, minute, F.lit(0))
    today = F.to_date(now)
    monday = F.when(F.dayofweek(today) == 2, today).otherwise(F.next_day(today, "Mon"))
    first = F.trunc(today, "month")
    pick = lambda day, later: F.when(at(day) > now, at(day)).otherwise(at(later))
    return F.when(frequency == "Daily", pick(today, F.date_add(today, 1))).when(frequency == "Weekly", pick(monday, F.date_add(monday, 7))).otherwise(pick(first, F.add_months(first, 1)))


def query_label(sql: Column) -> Column:
    bare = F.replace(F.trim(sql), F.lit("\n"), F.lit(" "))
    return F.concat(F.substring(bare, 1, 40), F.when(F.length(bare) > 40, "…").otherwise(""))


def initials(name: Column) -> Column:
    return F.upper(F.array_join(F.transform(F.slice(F.split(F.trim(name), r"\s+"), 1, 2), lambda w: F.substring(w, 1, 1)), ""))


def client_ip(forwarded: Column) -> Column:
    return F.trim(F.split(forwarded, ",")[0])


def money(cents: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(cents / 100, 2))


def annual_saving(monthly: Column, annual: Column) -> Column:
    return monthly * 12 - annual


def elapsed(millis: Column) -> Column:
    return F.format_string("00:00:%02d.%02d", F.floor(millis / 1000), F.floor(millis % 1000 / 10))


def valid_email(text: Column) -> Column:
    return text.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$")


def is_national_id(value: Column) -> Column:
    return F.coalesce(F.trim(value.cast("string")).rlike(r"^[1-9][0-9]{10}$"), F.lit(False))
