"""Scrubbing of personal data, from column names and value patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlight.functions.scalars import is_national_id, patient_token
from wardlight.operators.tables import numbered

# Names of columns with personal data, by what replaces them; together they are one set.
IDENTIFIERS = ("patientid", "patient_id", "mrn")
NAMES = ("firstname", "lastname", "patient_first_name", "patient_last_name", "name", "patientfirstname", "patientlastname", "patient_name", "fullname", "full_name")
DATES = ("dob", "dateofbirth", "birthdate", "birth_date")
NATIONAL_IDS = ("nationalid", "national_id", "tc_kimlik", "tckimlik")
OTHERS = ("phone", "email", "address")
PERSONAL = {*IDENTIFIERS, *NAMES, *DATES, *NATIONAL_IDS, *OTHERS, "ssn"}
STRAY = "[NATIONAL ID REDACTED]"


def column_key(name: str) -> str:
    return re.sub(r"[-\s]", "_", name.lower())


def is_personal(name: str) -> bool:
    return column_key(name) in PERSONAL


def _replacement(name: str, value: Column) -> Column:
    key = column_key(name)
    if key in IDENTIFIERS:
        return patient_token(value)
    fixed = "[SSN REDACTED]" if key == "ssn" else STRAY if key in NATIONAL_IDS else "[DATE REDACTED]" if key in DATES else None
    text = F.lit(fixed) if fixed else F.when(is_national_id(value), STRAY).otherwise("[PHI REDACTED]")
    return F.when(value.isNull(), "[REDACTED]").otherwise(text)


def _id_text(df: DataFrame, name: str) -> Column | None:
    """The decimal text in which a cell would show a national id; None where the type can hold none."""
    kind, value = df.schema[name].dataType, F.col(quoted(name))
    if isinstance(kind, T.StringType):
        return value
    if isinstance(kind, T.LongType):
        return value.cast("string")
    if isinstance(kind, T.DecimalType) and kind.precision - kind.scale >= 11 or isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        whole = F.when((value == F.floor(value)) & (F.abs(value) < 1e15), value.cast("decimal(38,0)"))
        return whole.cast("string")
    return None


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def tokens(df: DataFrame, order: list[str], columns: dict[str, bool]) -> DataFrame:
    """(value, token) of the values of columns (name: whether it holds names), by where each is first seen (rows by `order`, columns left to right).

    A value first seen as an identifier has its hash token everywhere; one first seen as a name has the
    letter of its turn among names, starting over after 26. Distinct values alone are ranked.
    """
    cells = [F.struct(F.lit(i).alias("i"), F.lit(is_name).alias("is_name"), F.col(quoted(c)).cast("string").alias("value")) for i, (c, is_name) in enumerate(columns.items())]
    seen = df.select(F.struct(*[F.col(quoted(c)) for c in order]).alias("at"), F.explode(F.array(*cells)).alias("x")).filter("x.value is not null")
    first = seen.groupBy("x.value").agg(F.min(F.struct("at", "x.i", "x.is_name")).alias("first"))
    names = numbered(first.filter("first.is_name"), ["first"], "turn").select("value", F.concat(F.lit("Patient-"), F.char((F.col("turn") % 26 + 65).cast("long"))).alias("token"))
    return names.unionByName(first.filter("not first.is_name").select("value", patient_token(F.col("value")).alias("token")))


def scrub(df: DataFrame, order: list[str]) -> DataFrame:
    """df with personal columns replaced and stray national ids hidden everywhere.

    Identifiers and names share one map of tokens (see `tokens`). Columns of text, long, decimal and
    floating numbers come back as text, since any of their cells may be redacted; other types hold no
    national id and stay.
    """
    key = {c: column_key(c) for c in df.columns}
    mapped = {c: key[c] in NAMES for c in df.columns if key[c] in NAMES or key[c] in IDENTIFIERS}
    out = df.select(F.struct("*").alias("row"))
    cell = lambda c: F.col("row").getField(c)
    if any(mapped.values()):
        token = tokens(df, order, mapped)
        for i, c in enumerate(mapped):
            out = out.join(token.select(F.col("value").alias(f"v{i}"), F.col("token").alias(f"t{i}")), cell(c).cast("string") == F.col(f"v{i}"), "left").drop(f"v{i}")
    new, place = {}, {c: i for i, c in enumerate(mapped)}
    rows = out.select("row.*", *[f"t{i}" for i in range(len(mapped))]) if any(mapped.values()) else df
    tokened = any(mapped.values())
    for c in df.columns:
        value, text = F.col(quoted(c)), _id_text(df, c)
        if c in mapped and tokened:
            new[c] = F.coalesce(F.col(f"t{place[c]}"), F.lit("[REDACTED]"))
        elif is_personal(c):
            new[c] = _replacement(c, value)
        elif text is not None:
            new[c] = F.when(is_national_id(text), STRAY).otherwise(value.cast("string"))
        else:
            new[c] = value
    return rows.select(*[v.alias(c) for c, v in new.items()])


def scrub_report(df: DataFrame) -> DataFrame:
    """One row: columns_scrubbed, rows_processed, values_replaced (every cell of personal columns, and stray ids)."""
    personal = [c for c in df.columns if is_personal(c)]
    texts = [t for c in df.columns if c not in personal and (t := _id_text(df, c)) is not None]
    stray = [F.coalesce(F.sum(is_national_id(t).cast("long")), F.lit(0)) for t in texts]
    return df.agg(F.lit(",".join(personal)).alias("columns_scrubbed"), F.count("*").alias("rows_processed"), sum(stray, F.count("*") * len(personal)).alias("values_replaced"))
