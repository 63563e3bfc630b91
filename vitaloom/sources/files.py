"""Files as rows: listing, DOCX text, and plain text.

The only Python here reads one DOCX package per row (a zip of XML, for which Spark has no
expression); Spark lists, distributes and batches the files.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitaloom import constants as C

BINARY_FILE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)
DOCX_TEXT = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("paragraphs", T.ArrayType(T.StringType())),
        T.StructField("tables", T.ArrayType(T.ArrayType(T.ArrayType(T.StringType())))),
        T.StructField("error_type", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)

UNSUPPORTED = "UnsupportedFileType"
CORRUPTED = "CorruptedFile"
TOO_LARGE = "FileTooLarge"
DOCUMENT_TOO_LARGE = "The document's text is too large to read."
MAX_DOCUMENT_BYTES = 256 << 20
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
# Run content that stands for a character of its own.
_MARKS = {"tab": "\t", "ptab": "\t", "cr": "\n", "noBreakHyphen": "-"}


def is_resume_file(path: Column) -> Column:
    """.docx or .pdf in any case, and no lock file of an office program."""
    name = F.regexp_extract(path, r"([^/]*)\z", 1)
    return F.rlike(path, F.lit(r"(?i)\.(docx|pdf)\z")) & ~F.startswith(name, F.lit("~$"))


def scan_files(spark: SparkSession, folder: str) -> DataFrame:
    """Binary-file rows of all résumé files below a folder.

    Sort the result by `path` where order matters. Selecting without `content` reads
    metadata only.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.{[dD][oO][cC][xX],[pP][dD][fF]}")
        .load(folder)
    )
    return files.where(is_resume_file(F.col("path")))


def _paragraph_text(paragraph: ElementTree.Element) -> str:
    out = []
    for child in paragraph:
        if child.tag == f"{_W}r":
            out.append(_run_text(child))
        elif child.tag == f"{_W}hyperlink":
            out.extend(_run_text(run) for run in child.iterfind(f"{_W}r"))
    return "".join(out)


def _run_text(run: ElementTree.Element) -> str:
    out = []
    for node in run:
        kind = node.tag.removeprefix(_W)
        if kind == "t":
            out.append(node.text or "")
        elif kind == "br":
            out.append("\n" if node.get(f"{_W}type", "textWrapping") == "textWrapping" else "")
        else:
            out.append(_MARKS.get(kind, ""))
    return "".join(out)


def _table_rows(table: ElementTree.Element) -> list[list[str]]:
    """Cell texts by row; a merged cell shows in every grid place it covers."""
    rows: list[list[str]] = []
    above: list[str] = []
    for row in table.iterfind(f"{_W}tr"):
        cells: list[str] = []
        for cell in row.iterfind(f"{_W}tc"):
            merge = cell.find(f"{_W}tcPr/{_W}vMerge")
            span = cell.find(f"{_W}tcPr/{_W}gridSpan")
            width = int(span.get(f"{_W}val", "1")) if span is not None else 1
            if merge is not None and merge.get(f"{_W}val", "continue") == "continue":
                text = above[len(cells)] if len(cells) < len(above) else ""
            else:
                text = "\n".join(_paragraph_text(p) for p in cell.iterfind(f"{_W}p")).strip()
            cells.extend([text] * width)
        above = cells
        if any(cells):
            rows.append(cells)
    return rows


def _read_package(path: str, content: bytes) -> dict:
    row = {"path": path, "paragraphs": None, "tables": None, "error_type": None, "error": None}
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as package:
            if "[Content_Types].xml" not in package.namelist():
                return {**row, "error_type": CORRUPTED, "error": C.DOCX_NO_CONTENT_TYPES}
            # An inflated part beyond this is no résumé and could take the worker's memory.
            if package.getinfo("word/document.xml").file_size > MAX_DOCUMENT_BYTES:
                return {**row, "error_type": TOO_LARGE, "error": DOCUMENT_TOO_LARGE}
            body = ElementTree.fromstring(package.read("word/document.xml")).find(f"{_W}body")
        paragraphs = [_paragraph_text(p).strip() for p in body.iterfind(f"{_W}p")]
        tables = [_table_rows(t) for t in body.iterfind(f"{_W}tbl")]
    except zipfile.BadZipFile:
        return {**row, "error_type": CORRUPTED, "error": C.DOCX_CORRUPT}
    except Exception as problem:  # one broken file must not fail the task
        return {**row, "error_type": type(problem).__name__, "error": str(problem)}
    return {
        **row,
        "paragraphs": [p for p in paragraphs if p],
        "tables": [t for t in tables if t],
    }


def read_docx(files: DataFrame) -> DataFrame:
    """(path, paragraphs, tables, error_type, error) of binary-file rows."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.name for f in DOCX_TEXT.fields]
        for batch in batches:
            rows = [_read_package(p, c) for p, c in zip(batch["path"], batch["content"])]
            yield pd.DataFrame(rows, columns=names)

    # Only packages go to Python; other files are refused by their name, unread.
    package = F.rlike("path", F.lit(r"(?i)\.docx\z"))
    read_rows = files.where(package).select("path", "content").mapInPandas(read, DOCX_TEXT)
    kinds = {f.name: f.dataType.simpleString() for f in DOCX_TEXT.fields}
    refused = files.where(~package).select(
        "path",
        F.lit(None).cast(kinds["paragraphs"]).alias("paragraphs"),
        F.lit(None).cast(kinds["tables"]).alias("tables"),
        F.lit(UNSUPPORTED).alias("error_type"),
        F.lit(C.NOT_DOCX).alias("error"),
    )
    return read_rows.unionByName(refused)


def docx_text(files: DataFrame) -> DataFrame:
    """(path, text, error_type, error): all paragraphs, then all table rows."""
    rows = F.flatten(F.col("tables"))
    row_texts = F.transform(
        rows, lambda cells: F.array_join(F.filter(cells, lambda c: c != ""), " | ")
    )
    return read_docx(files).select(
        "path",
        F.when(
            F.col("error_type").isNull(),
            F.array_join(F.concat("paragraphs", row_texts), "\n"),
        ).alias("text"),
        "error_type",
        "error",
    )


def scan_text(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text): one row per already extracted text file."""
    return (
        spark.read.option("recursiveFileLookup", "true")
        .text(folder, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    )
