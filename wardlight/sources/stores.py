"""Readers and writers of the product's stores: JSON lines, JSON documents, encoded values, CSV and XLSX."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AUDIT_EVENT = "id string, timestamp string, userId string, userEmail string, action string, resourceType string, detail string, rowsAffected long, ipAddress string, userAgent string, sessionId string, severity string, previousHash string, hash string"


def read_json_lines(spark: SparkSession, path: str, schema: str = AUDIT_EVENT) -> DataFrame:
    """Well-formed lines; blank and malformed ones are skipped, and a missing file has none."""
    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, line) of one file in file order, for the integrity check."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("pos", "line"))


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def decode_value(column: Column, schema: str) -> Column:
    """Base64 of URI-encoded JSON, else plain JSON, else null."""
    decoded = F.from_json(F.try_url_decode(F.call_function("try_to_binary", column, F.lit("base64")).cast("string")), schema)
    return F.coalesce(decoded, F.from_json(column, schema))


def encode_value(column: Column) -> Column:
    return F.base64(F.encode(F.url_encode(F.to_json(column)), "UTF-8"))


def encrypt(column: Column, key: Column) -> Column:
    return F.base64(F.aes_encrypt(column, key, F.lit("GCM")))


def decrypt(column: Column, key: Column) -> Column:
    return F.aes_decrypt(F.unbase64(column), key, F.lit("GCM")).cast("string")


def quoted(column: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(column.cast("string"), F.lit('"'), F.lit('""')), F.lit('"'))


def csv_line(columns: list[str], null_as: str = '""') -> Column:
    return F.concat_ws(",", *[F.coalesce(quoted(F.col(c)), F.lit(null_as)) for c in columns])


def csv_lines(df: DataFrame, null_as: str = '""') -> DataFrame:
    """(line) of each row: every value quoted, nulls as given."""
    return df.select(csv_line(df.columns, null_as).alias("line"))


def csv_text(df: DataFrame, limit: int = 10_000) -> str:
    """A capped result as one CSV text: header, rows, no final line end."""
    return "\n".join([",".join(f'"{c}"' for c in df.columns), *(r.line for r in csv_lines(df.limit(limit)).collect())])


def write_csv(df: DataFrame, path: str) -> None:
    plain = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])
    plain.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


#: The ten columns of an exported audit log.
AUDIT_COLUMNS = ("timestamp", "userId", "userEmail", "action", "resourceType", "detail", "rowsAffected", "ipAddress", "sessionId", "severity")


def audit_csv_text(events: DataFrame, limit: int = 500) -> str:
    """The newest events as CSV: plain header, nulls empty, other values quoted."""
    lines = csv_lines(events.select(*AUDIT_COLUMNS).limit(limit), null_as="").collect()
    return "\n".join([",".join(AUDIT_COLUMNS), *(r.line for r in lines)])


def read_table(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None) -> DataFrame:
    """A Parquet, ORC, CSV (with a header) or JSON table; CSV and JSON need their schema, so that no pass is spent on guessing it."""
    if kind not in ("parquet", "orc", "csv", "json"):
        raise ValueError(f"unknown kind of table: {kind}")
    if kind in ("csv", "json") and not schema:
        raise ValueError(f"{kind} needs a schema")
    reader = spark.read.schema(schema) if schema else spark.read
    return (reader.option("header", True).option("escape", '"') if kind == "csv" else reader).format(kind).load(path)


def seeded(spark: SparkSession, path: str, schema: str, rows: list[tuple]) -> DataFrame:
    """A stored table, or the seed rows where it was never written; an empty table stays empty."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame(rows, schema)
        raise


def billing_line(at: Column, level: Column, event: Column, data: Column | None = None) -> Column:
    """A line of the billing log; data as JSON."""
    stamp = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    parts = [F.lit("["), stamp, F.lit("] ["), level, F.lit("] "), event]
    return F.concat(*parts) if data is None else F.concat(*parts, F.lit(" "), F.to_json(data))


def append_lines(lines: DataFrame, path: str) -> None:
    lines.write.mode("append").text(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Overwrites a Parquet table; df may read the old one. What fails in between leaves the old table at path or at path.old."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    new, old, now = (hadoop.Path(p) for p in (path + ".new", path + ".old", path))
    system = now.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(old):
        if system.exists(now):
            system.delete(old, True)
        elif not system.rename(old, now):
            raise OSError(f"can't restore {path}")
    df.write.mode("overwrite").parquet(path + ".new")
    if system.exists(now) and not system.rename(now, old):
        raise OSError(f"can't move {path} away")
    if not system.rename(new, now):
        system.rename(old, now)
        raise OSError(f"can't replace {path}")
    system.delete(old, True)


def xlsx_bytes(df: DataFrame, limit: int = 10_000, sheet: str = "Results") -> bytes:
    """A capped result as a workbook with one sheet: numbers as numbers, nulls as empty texts."""

    def cell(value) -> str:
        if isinstance(value, bool):
            return f'<c t="b"><v>{int(value)}</v></c>'
        if isinstance(value, int | float):
            return f"<c><v>{value}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape("" if value is None else str(value))}</t></is></c>'

    rows = [df.columns, *(tuple(r) for r in df.limit(limit).collect())]
    data = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in rows)
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    files = {
        "[Content_Types].xml": f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{data}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text)
    return out.getvalue()


def privacy_requests(df: DataFrame) -> DataFrame:
    """Valid requests as stored: a known type, an e-mail address (trimmed, lower case) and a name."""
    from wardlight.functions.scalars import valid_email

    ok = F.col("type").isin("access", "correct", "delete", "export", "object") & valid_email(F.trim("email")) & (F.trim("name") != "")
    return df.filter(ok).withColumns({"email": F.lower(F.trim("email")), "name": F.trim("name")})

