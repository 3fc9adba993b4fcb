"""The classes of a statement's tokens, for highlighting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Highlighted words.
KEYWORDS = (
    "SELECT FROM WHERE JOIN ON AS GROUP BY ORDER HAVING LIMIT OFFSET INSERT INTO VALUES UPDATE SET DELETE INNER LEFT RIGHT FULL OUTER CROSS DISTINCT ALL "
    "AND OR NOT IN LIKE BETWEEN IS NULL TRUE FALSE WITH UNION EXCEPT INTERSECT CASE WHEN THEN ELSE END CREATE DROP ALTER TABLE VIEW INDEX PRIMARY KEY "
    "REFERENCES FOREIGN CONSTRAINT DEFAULT UNIQUE INTERVAL YEAR MONTH DAY HOUR MINUTE SECOND"
).split()
# Highlighted functions.
FUNCTIONS = (
    "TO_CHAR COUNT SUM AVG MIN MAX COALESCE NULLIF CAST DATE_TRUNC DATE_PART EXTRACT NOW CURRENT_DATE CURRENT_TIMESTAMP CONCAT TRIM UPPER LOWER LENGTH SUBSTR SUBSTRING "
    "ROW_NUMBER RANK DENSE_RANK LAG LEAD FIRST_VALUE LAST_VALUE ROUND CEIL FLOOR ABS POWER SQRT MOD"
).split()

#: Comments, quoted names, literals, numbers after a blank or an operator, words, and single characters.
TOKEN = r"""--[^\n]*|/\*(?s:.*?)(?:\*/|$)|"[^"]*"?|'[^']*+(?:(?<=\\)'[^']*+)*+'?|(?<![^\s,(=<>!+\-*/])[0-9][0-9.]*|[a-zA-Z_][a-zA-Z0-9_]*|(?s:.)"""


def sql_tokens(text: Column) -> Column:
    """Array of (kind, value); kinds are cmt, str, num, kw, fn, op and plain."""
    word = lambda names: lambda t: F.upper(t).isin(names)
    kind = lambda t: (
        F.when(t.startswith("--") | t.startswith("/*"), "cmt")
        .when(t.startswith('"') | t.startswith("'"), "str")
        .when(word(KEYWORDS)(t), "kw")
        .when(word(FUNCTIONS)(t), "fn")
        .when(t.rlike("^[>=<!+*/().,;-]$"), "op")
        .otherwise("plain")
    )
    found = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    # A digit stands alone where no number may begin; the token before it tells.
    number = lambda i: F.when(i == 0, True).otherwise(F.get(found, i - 1).rlike(r"(?s)[\s,(=<>!+\-*/]$"))
    return F.transform(found, lambda t, i: F.struct(F.when(t.rlike("^[0-9]") & number(i), "num").otherwise(kind(t)).alias("kind"), t.alias("value")))
