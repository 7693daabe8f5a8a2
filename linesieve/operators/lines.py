"""Documents to lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def line_array(text: Column) -> Column:
    """The lines of a text; a final line end starts no line, and an empty text has none."""
    parts = F.split(text, "\n", -1)
    return F.when(text == "", F.array().cast("array<string>")).when(text.endswith("\n"), F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def explode_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs -> one row per line: the other columns, line_no (from 1) and line. Empty and null texts have no rows."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    at = docs.select(*others, F.posexplode(line_array(F.col(text))).alias("line_pos", "line"))
    return at.select(*others, (F.col("line_pos") + 1).cast("int").alias("line_no"), "line")


def with_offsets(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds byte_offset: where the line starts in its text, in UTF-8 bytes."""
    before = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("byte_offset", F.coalesce(F.sum(F.octet_length("line") + F.lit(1)).over(before), F.lit(0)).cast("long"))


def strip_cr(line: Column) -> Column:
    """One carriage return at the end, for display; matching sees it."""
    return F.regexp_replace(line, r"\r\z", "")


def trim_start(line: Column) -> Column:
    return F.regexp_replace(line, r"^[ \t]+", "")
