"""Readers.  Rows have no order in Spark, so everything that has a position carries it."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from daftar.functions.text import document_lines
from daftar.operators.chunking import marker_split

QA_SCHEMA = "context string, question string, answer string"
OCR_SCHEMA = "source string, pages array<struct<page_number:int,lines:array<struct<content:string>>>>"


def text_documents(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """source, page_content of whole text files; a directory is not read recursively, ``glob`` filters its files."""
    r = spark.read
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("page_content"))


def load_and_split(spark: SparkSession, path: str, separator: str, size: int, overlap: int = 0, glob: str | None = None) -> DataFrame:
    """source, position (from 0 in the file), page_content of the chunks."""
    d = text_documents(spark, path, glob)
    return d.select("source", F.posexplode(marker_split("page_content", separator, size, overlap)).alias("position", "page_content"))


def text_lines(docs: DataFrame, text: str = "page_content") -> DataFrame:
    """source, line_no (from 1), line; a line break at the end opens no further line."""
    body = F.regexp_replace(text, r"\n\z", "")
    return docs.select("source", F.posexplode(F.split(body, "\n", -1)).alias("_p", "line")).select("source", (F.col("_p") + 1).alias("line_no"), "line")


def read_csv(spark: SparkSession, path: str, schema: str | StructType = QA_SCHEMA) -> DataFrame:
    """CSV with header; quoted line breaks, doubled quotes; empty and missing values are null."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"')


def csv_documents(rows: DataFrame, source: str, row: str) -> DataFrame:
    """One document per row, "name: value" lines: source, row, page_content.  ``row`` is the column with the position."""
    names = [c for c in rows.columns if c != row]
    return rows.select(F.lit(source).alias("source"), F.col(row).alias("row"), document_lines(names).alias("page_content"))


def read_split(spark: SparkSession, splits: dict[str, str], name: str) -> DataFrame:
    """One of several named Parquet splits."""
    return spark.read.parquet(splits[name])


class Extractor(Protocol):
    """Bytes of a document to its pages: a list of lists of lines."""

    def __call__(self, content: bytes) -> list[list[str]]: ...


def plain_extractor(content: bytes) -> list[list[str]]:
    """Stand-in without character recognition: pages are divided by form feeds."""
    return [p.splitlines() for p in content.decode("utf-8", "replace").split("\f")]


def read_scans(spark: SparkSession, path: str, extractor: Extractor = plain_extractor) -> DataFrame:
    """source, pages of binary files, through a recognition service or its stand-in."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pages = [[{"page_number": i + 1, "lines": [{"content": x} for x in p]} for i, p in enumerate(extractor(c))] for c in pdf.content]
            yield pd.DataFrame({"source": pdf.path, "pages": pages})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, OCR_SCHEMA)


def page_marked(pages: Column | str) -> Column:
    """"Total pages: n", then for each page an empty line, "Page number: i", an empty line and its lines, of one document."""
    p = F.col(pages) if isinstance(pages, str) else pages
    blocks = F.transform(p, lambda x: F.concat(F.array(F.concat(F.lit("\nPage number: "), x["page_number"].cast("string"), F.lit("\n"))), F.transform(x["lines"], lambda y: y["content"])))
    return F.array_join(F.concat(F.array(F.concat(F.lit("Total pages: "), F.size(p).cast("string"))), F.flatten(blocks)), "\n")


def page_marked_lines(pages: DataFrame, text: str = "page_content") -> DataFrame:
    """The same for texts of any number of pages, as rows: source, page_number, row_no, line_no, line.

    pages: source, page_number, row_no (tells pages of one number apart) and their text.  The order of a source's file
    is (page_number, row_no, line_no); its first line has page_number and row_no null, which sort first.
    """
    body = F.concat(F.array(F.lit(""), F.concat(F.lit("Page number: "), F.col("page_number").cast("string")), F.lit("")), F.split(text, "\n", -1))
    lines = pages.select("source", "page_number", "row_no", F.posexplode(body).alias("line_no", "line"))
    total = pages.groupBy("source").agg(F.count("*").alias("n"))
    head = total.select("source", F.lit(None).cast(pages.schema["page_number"].dataType).alias("page_number"), F.lit(None).cast(pages.schema["row_no"].dataType).alias("row_no"), F.lit(0).alias("line_no"), F.concat(F.lit("Total pages: "), F.col("n").cast("string")).alias("line"))
    return head.union(lines)


def page_lines(scans: DataFrame) -> DataFrame:
    """source, page_number, line_no (from 1), line of scanned documents with their pages (OCR_SCHEMA)."""
    p = scans.select("source", F.explode("pages").alias("p"))
    return p.select("source", F.col("p.page_number").alias("page_number"), F.posexplode("p.lines").alias("_i", "_l")).select("source", "page_number", (F.col("_i") + 1).alias("line_no"), F.col("_l.content").alias("line"))
