"""Report sinks. Rows are written in report order as one file when small, as ordered part files
when large; nothing is forced through a single task."""

from __future__ import annotations

from pyspark.sql import DataFrame

from starscan.functions.text import literal
from starscan.operators.report import CSV_HEADINGS, csv_line


def write_csv(results: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Semicolon-separated UTF-8 with headings, CRLF line ends and doubled quotes.

    Lines are written as text: the CSV writer would turn line feeds inside a name into CRLF.
    The headings are the first line of the first part, so the parts in order make one file.
    """
    headings = results.sparkSession.range(1).selectExpr(
        "0 AS ref_ord", "0 AS rank", f"{literal(';'.join(CSV_HEADINGS))} AS value"
    )
    lines = results.selectExpr("ref_ord", "rank", f"{csv_line()} AS value")
    (
        headings.unionByName(lines)
        .orderBy("ref_ord", "rank")
        .select("value")
        .write.mode(mode)
        .option("lineSep", "\r\n")
        .text(path)
    )


def write_json(results: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per row; histograms stay objects, missing values stay null."""
    (
        results.orderBy("ref_ord", "rank")
        .drop("ref_ord", "rank")
        .write.mode(mode)
        .option("ignoreNullFields", False)
        .json(path)
    )
