"""Text files in, reports out."""

from __future__ import annotations

import sys
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of a file that are read, as the console tool reads them; None: all.
MOST_CHARS = 2_000_000


def read_texts(spark: SparkSession, path: str, most_chars: int | None = MOST_CHARS) -> DataFrame:
    """``path, text, warning`` for each file, decoded as UTF-8 with replacement of bad bytes.

    The warning says that a text was cut; it is null where the file was read whole.
    """
    text = F.col("value") if most_chars is None else F.substring("value", 1, most_chars)
    cut = F.lit(False) if most_chars is None else F.length("value") > most_chars
    warning = F.when(cut, F.concat(F.lit("input truncated to "), F.lit(f"{most_chars or 0:,}"), F.lit(" of "), F.format_number(F.length("value"), 0), F.lit(" characters")))
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), text.alias("text"), warning.alias("warning"))


def read_stream(spark: SparkSession, stream: TextIO | None = None, most_chars: int = MOST_CHARS) -> DataFrame:
    """The same for one text from an open stream, standard input unless another is given: path ``-``, at most ``most_chars`` held."""
    text = (stream or sys.stdin).read(most_chars + 1)
    warning = f"input truncated to {most_chars:,} characters" if len(text) > most_chars else None
    return spark.createDataFrame([("-", text[:most_chars], warning)], "path string, text string, warning string")


def write_reports(reports: DataFrame, path: str, column: str = "report") -> None:
    """One report after another in text files, each ended by a form feed line."""
    reports.select(F.concat(F.col(column), F.lit("\n\f")).alias("value")).write.text(path)
