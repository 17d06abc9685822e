"""Small tables with every odd case that the operators define."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

LONG = " ".join(f"w{i % 97} Word{i % 13}" for i in range(3000))

ODD = [
    (900_001, None),
    (900_002, ""),
    (900_003, "   "),
    (900_004, "a"),
    (900_005, LONG),
    (900_006, LONG),
    (900_006, LONG),
    (None, "no id at all, but Some words in it"),
    (-5, "tab\tand\nbreak \n two  spaces\r\nnbsp x İΣ中文 😀 é don't <|endoftext|> \x00\x1c."),
    (900_007, "x" * 5000),
    (900_008, "\n\nlead and trail \n"),
]


def some_documents(sf_dir: str, n: int = 120) -> list[tuple]:
    sql = f"SELECT doc_id, text FROM read_parquet('{sf_dir}/documents.parquet') ORDER BY doc_id LIMIT {n}"
    return duckdb.connect().execute(sql).fetchall() + ODD


def documents_frame(spark, rows, parts: int = 3):
    """The columns of documents, and some whose names an operator might use itself."""
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return frame.withColumns(
        {
            "lang": F.lit(None).cast("string"),
            "source": F.lit("s"),
            "n_chars": F.length("text").cast("long"),
            **{c: F.lit(7) for c in ("start", "length", "n", "ids", "task", "word", "score", "label", "grade")},
        }
    )
