"""Reports as tables of lines, and their files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _shown(df: DataFrame, c: str, digits: int) -> Column:
    kind = dict(df.dtypes)[c]
    if kind in ("double", "float"):
        return F.when(F.col(c).isNotNull(), F.format_string(f"%.{digits}f", F.col(c))).otherwise("")
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def markdown(df: DataFrame, order: list[Column], title: str, digits: int = 4) -> DataFrame:
    """(line_no, line): a title and a table of the rows in order. A report is small; its rows are numbered in one place."""
    head = ["# " + title, "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    body = F.concat(F.lit("| "), F.concat_ws(" | ", *[_shown(df, c, digits) for c in df.columns]), F.lit(" |"))
    rows = df.select((F.row_number().over(Window.orderBy(*order)) + len(head)).alias("line_no"), body.alias("line"))
    return df.sparkSession.createDataFrame(list(enumerate(head, 1)), "line_no int, line string").unionByName(rows)


def write(report: DataFrame, path: str, data: DataFrame | None = None) -> None:
    """The lines as one text file under path/markdown, the data as JSON lines under path/json."""
    report.orderBy("line_no").select(F.col("line").alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/markdown")
    if data is not None:
        data.write.mode("overwrite").json(f"{path}/json")
