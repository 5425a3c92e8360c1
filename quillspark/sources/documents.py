"""Writing samples from files: plain text, .docx, and lines taken from PDF pages."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.patterns import replaced, trimmed

# The parts of a word-processor file that hold text.
BODY = "word/document.xml"
FOOTNOTE = r"<w:footnote[\s\S]*?</w:footnote>"
PIECE = r"<w:t(?:\s[^>]*)?>([^<]*)</w:t>|<w:tab/>|<w:br/>"


def cleaned(text: Column) -> Column:
    """Unix line ends, no outer white space."""
    return trimmed(F.regexp_replace(text, "\r\n", "\n"))


def title_of(name: Column) -> Column:
    """A readable title from a file's name."""
    base = F.regexp_extract(name, "([^/]*)$", 1)
    return F.trim(F.regexp_replace(F.regexp_replace(F.url_decode(F.regexp_replace(base, r"\+", "%2B")), r"\.[^.]+$", ""), "_+", " "))


def unescaped(xml: Column) -> Column:
    """The five named entities and decimal ones of the Latin-1 range and beyond, the ampersand last."""
    out = xml
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'")):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    parts, codes = F.split(out, "&#[0-9]+;", -1), F.regexp_extract_all(out, F.lit("&#([0-9]+);"), F.lit(1))
    char = lambda c: F.decode(F.unhex(F.lpad(F.hex(c.cast("long")), 8, "0")), "UTF-32")
    out = F.array_join(F.zip_with(parts, codes, lambda p, c: F.concat(p, F.coalesce(char(c), F.lit("")))), "")
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def docx_text(xml: Column) -> Column:
    """The text of a document part: a line per paragraph, no footnotes, at most one blank line in a row."""
    paragraphs = F.split(replaced(xml, FOOTNOTE, ""), "</w:p>")
    whole = lambda p: F.regexp_extract_all(p, F.lit(PIECE), F.lit(0))
    piece = lambda m: F.when(m == "<w:tab/>", "\t").when(m == "<w:br/>", "\n").otherwise(unescaped(F.regexp_extract(m, PIECE, 1)))
    lines = F.transform(paragraphs, lambda p: replaced(F.array_join(F.transform(whole(p), piece), ""), r"\s+$", ""))
    return trimmed(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """path, title and text of whole text files."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return rows.select("path", title_of(F.col("path")).alias("title"), cleaned(F.col("value")).alias("text"))


def read_docx(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """path, title and text of .docx files; and path and problem of those that can't be read, .doc files among them."""

    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for p, raw in zip(batch["path"], batch["content"], strict=True):
                try:
                    if p.lower().endswith(".doc"):
                        raise ValueError("old .doc files can't be read")
                    with zipfile.ZipFile(io.BytesIO(raw)) as z:
                        out.append((p, z.read(BODY).decode(), None))
                except (ValueError, KeyError, zipfile.BadZipFile, NotImplementedError) as e:
                    out.append((p, None, str(e) if isinstance(e, ValueError) else f"not a readable document: {type(e).__name__}"))
            yield pd.DataFrame(out, columns=["path", "xml", "problem"])

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unzip, "path string, xml string, problem string")
    good = rows.where("problem is null").select("path", title_of(F.col("path")).alias("title"), docx_text(F.col("xml")).alias("text"))
    return good, rows.where("problem is not null").select("path", "problem")


def page_lines(items: DataFrame) -> DataFrame:
    """path, page, line and text, from text items on pages (path, page, seq, x, y, width, height, text).

    An item belongs to the first line, in reading order, whose height it is near (two units, or two fifths of its own
    height). The lines of a page depend on the items before, so a page is one group; pages are small."""

    def lines(key, pdf: pd.DataFrame) -> pd.DataFrame:
        rows: list[list] = []
        for it in pdf.sort_values("seq").itertuples():
            if not (it.text or "").strip():
                continue
            near = max(2.0, (it.height or 10.0) * 0.4)
            row = next((r for r in rows if abs(r[0] - it.y) < near), None)
            if row is None:
                row = [it.y, []]
                rows.append(row)
            row[1].append(it)
        out = []
        for k, (_, found) in enumerate(sorted(rows, key=lambda r: -r[0])):
            line, end = "", None
            for it in sorted(found, key=lambda i: i.x):
                if end is not None and it.x - end > 1 and not line.endswith(" ") and not it.text.startswith(" "):
                    line += " "
                line, end = line + it.text, it.x + (it.width or 0.0)
            out.append((*key, k, line.strip()))
        return pd.DataFrame(out, columns=["path", "page", "line", "text"])

    return items.groupBy("path", "page").applyInPandas(lines, "path string, page int, line int, text string")


def rejoined(lines: DataFrame) -> DataFrame:
    """path and text: lines of a file (path, page, line, text) joined to paragraphs. A line goes on with the one before
    unless that ends with a closing mark or is empty."""
    order = Window.partitionBy("path").orderBy("page", "line")
    before = F.lag("text").over(order)
    new = before.isNull() | (before == "") | before.rlike('[.!?:"”)]\\z')
    rows = lines.withColumn("_new", new.cast("int")).withColumn("_para", F.sum("_new").over(order))
    part = F.struct("page", "line", "text")
    paras = rows.groupBy("path", "_para").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["text"]), " ").alias("text"))
    return paras.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_para", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
