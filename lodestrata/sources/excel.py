"""Excel workbooks (xlsx) as tables: the files are listed by Spark and parsed in its tasks."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LETTERS = re.compile(r"[A-Z]+")


def _tag(x: ElementTree.Element) -> str:
    return x.tag.rpartition("}")[2]


def _texts(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter() if _tag(t) == "t")


def sheet_rows(content: bytes, sheet: int = 1) -> Iterator[list[str | None]]:
    """Cells of a sheet as texts, by rows; cells that are left out are null."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = [_texts(x) for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in book.namelist() else []
        for row in (x for x in ElementTree.fromstring(book.read(f"xl/worksheets/sheet{sheet}.xml")).iter() if _tag(x) == "row"):
            out: list[str | None] = []
            for cell in (x for x in row if _tag(x) == "c"):
                at = len(out)
                if m := _LETTERS.match(cell.get("r") or ""):
                    at = 0
                    for letter in m[0]:
                        at = at * 26 + ord(letter) - 64
                    at -= 1
                value = next((x.text for x in cell if _tag(x) == "v"), None)
                kind = cell.get("t")
                value = shared[int(value)] if kind == "s" and value is not None else _texts(cell) if kind == "inlineStr" else value
                out += [None] * (at + 1 - len(out))
                out[at] = value
            yield out


def read_excel(spark: SparkSession, paths: str | list[str], columns: list[str], sheet: int = 1) -> DataFrame:
    """The named columns of every workbook as texts, and path; the first row names a sheet's columns, and one that it lacks is null."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows = sheet_rows(content, sheet)
                head = next(rows, [])
                place = [head.index(c) if c in head else len(head) + 10**6 for c in columns]
                yield pd.DataFrame([[path, *(r[i] if i < len(r) else None for i in place)] for r in rows], columns=["path", *columns], dtype=object)

    return files.mapInPandas(run, ", ".join(["path string", *(f"`{c}` string" for c in columns)]))


def merged_vocabulary(df: DataFrame, term: str, group: str) -> DataFrame:
    """The lists as one vocabulary: each term once, stripped, with the least of its groups; blank terms go."""
    named = df.select(F.trim(term).alias(term), F.col(group)).where(F.col(term) != "")
    return named.groupBy(term).agg(F.min(group).alias(group))
