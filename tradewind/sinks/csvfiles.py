"""Spreadsheet-safe CSV output, written in parallel."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.functions.cells import clean_header, csv_header_clean, csv_safe_cells
from tradewind.functions.masking import anonymize

BOM = "﻿"


@dataclass(frozen=True)
class CsvOptions:
    """How CSV datasets are written and read back.

    ``rows_per_file`` bounds the rows of one part file.  ``bytes_per_file`` also
    bounds its size, about, by the mean length of the rows, which takes one more
    pass over them.  ``writes_at_once`` is the number of datasets of one export
    that are written at the same time.
    """

    sep: str = ";"
    quote: str = '"'
    bom: bool = True
    safe: bool = True
    anonymize: bool = False
    compression: str | None = None
    rows_per_file: int = 1_000_000
    bytes_per_file: int | None = None
    writes_at_once: int = 4

    def dialect(self) -> dict[str, object]:
        return {
            "sep": self.sep,
            "quote": self.quote,
            "escape": self.quote,
            "header": True,
            "nullValue": "",
            "ignoreLeadingWhiteSpace": False,
            "ignoreTrailingWhiteSpace": False,
        }


def project_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The declared columns in their order; one that is missing is empty."""
    return df.select(
        [F.col(f"`{c}`") if c in df.columns else F.lit("").alias(c) for c in columns]
    )


def csv_ready(
    df: DataFrame, options: CsvOptions = CsvOptions(), columns: Sequence[str] | None = None
) -> DataFrame:
    """The rows as they will be written, except for the byte order mark."""
    if columns is not None:
        df = project_columns(df, columns)
    if options.anonymize:
        df = anonymize(df)
    if options.safe:
        df = csv_safe_cells(df)
    return csv_header_clean(df)


def _rows_per_file(ready: DataFrame, options: CsvOptions) -> int:
    if options.bytes_per_file is None:
        return options.rows_per_file
    width = sum((F.octet_length(F.col(f"`{c}`").cast("string")) + 1 for c in ready.columns), F.lit(0))
    mean = ready.agg(F.avg(width)).first()[0] or 1
    return max(1, min(options.rows_per_file, int(options.bytes_per_file / mean)))


def write_csv(
    df: DataFrame,
    path: str,
    options: CsvOptions = CsvOptions(),
    columns: Sequence[str] | None = None,
    mode: str = "errorifexists",
) -> None:
    """Write a CSV dataset; every part file has a header.

    The byte order mark is part of the first column's name, so each part file
    starts with it and Spark's reader drops it again.
    """
    ready = csv_ready(df, options, columns)
    if options.bom:
        ready = ready.withColumnRenamed(ready.columns[0], BOM + ready.columns[0])
    # A line that holds one empty cell would be blank, which readers skip.
    empty = options.quote * 2 if len(ready.columns) == 1 else ""
    writer = ready.write.mode(mode).options(**options.dialect(), emptyValue=empty)
    writer = writer.option("maxRecordsPerFile", _rows_per_file(ready, options))
    if options.compression:
        writer = writer.option("compression", options.compression)
    writer.csv(path)


def read_csv(
    spark: SparkSession,
    path: str,
    options: CsvOptions = CsvOptions(),
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """A written dataset as text columns; empty cells are NULL.

    With ``columns`` the files need not be opened to learn their header.
    """
    reader = spark.read.options(**options.dialect(), emptyValue="", multiLine=True)
    if columns is not None:
        reader = reader.schema(", ".join(f"`{clean_header(c)}` string" for c in columns))
    return reader.csv(path)
