"""Files to documents: format detection, text, DOCX and PDF extraction, one row of errors a bad file."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructType

from quillspark.functions import text as T
from quillspark.functions.udfs import decoded
from quillspark.plans.engine import EngineConfig, page_count

SUFFIXES = r"(?i)\.(pdf|docx|txt|md)$"
#: The same for the listing of files, so that others are not opened.
_GLOB = "*.{[pP][dD][fF],[dD][oO][cC][xX],[tT][xX][tT],[mM][dD]}"
EXTRACTED = """path string, text string, source_format string, page_count int,
    pages array<struct<index:int,char_count:int,line_count:int,short_line_ratio:double,has_extractable_text:boolean>>,
    warnings array<string>, has_tables boolean, table_count int, has_images boolean, image_count int,
    has_multi_column_hint boolean, has_text_in_headers_footers boolean, is_encrypted boolean"""
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content, length of all files with a known suffix, subfolders included. A filter on length keeps larger files closed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", _GLOB).load(path)
    return files.select("path", "content", "length")


def stream_files(spark: SparkSession, path: str, files_a_batch: int = 1_000) -> DataFrame:
    """`read_files` as a stream: the checkpoint of its query knows the files read, so that later runs take new ones only."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("pathGlobFilter", _GLOB).option("maxFilesPerTrigger", files_a_batch)
    return files.load(path).select("path", "content", "length")


def looks_like_text(content: Column) -> Column:
    """No zero byte in the first 2048, and more than nine tenths of all bytes printable."""
    head = F.decode(F.substring(content, 1, 2048), "ISO-8859-1")
    whole = F.decode(content, "ISO-8859-1")
    good = F.regexp_count(whole, F.lit(r"[\t\n\r\x20-\x7E\x80-\xFF]"))
    return ~F.contains(head, F.lit("\0")) & (good > F.length(whole) * 0.9)


def detect_format(content: Column, path: Column) -> Column:
    """pdf, docx, txt, or null for what cannot be read."""
    hexed = F.hex(F.substring(content, 1, 8))
    word = F.contains(F.decode(F.substring(content, 1, 8192), "ISO-8859-1"), F.lit("word/document.xml")) | F.contains(F.decode(content, "ISO-8859-1"), F.lit("word/"))
    none = F.lit(None).cast("string")
    return (
        F.when(hexed.startswith("255044462D"), "pdf").when(hexed.startswith("504B0304"), F.when(word, "docx"))
        .when(hexed.startswith("D0CF11E0A1B11AE1"), none).when(hexed.startswith("7B5C727466"), none)
        .when(F.lower(path).rlike(r"\.(txt|md)$") | looks_like_text(content), "txt"))


def repair_pdf_text(text: Column) -> Column:
    """Ligatures, quotes, dashes, bullets and hard spaces as plain characters; no white space at line ends."""
    for raw, plain in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), *((b, "- ") for b in "•●▪")):
        text = F.replace(text, F.lit(raw), F.lit(plain))
    text = F.translate(text, "‘’“”–— ", "''\"\"-- ")
    return F.regexp_replace(text, r"(?m)[ \t]+$", "")


def page_stats(pages: DataFrame) -> DataFrame:
    """index, char_count, line_count, short_line_ratio, has_extractable_text of pages (path, index, text)."""
    rows = T.filled_lines(F.col("text"))
    short = F.coalesce(F.try_divide(F.size(F.filter(rows, lambda x: F.length(T.strip(x)) <= 35)).cast("double"), F.size(rows).cast("double")), F.lit(0.0))
    return pages.select("path", "index", F.length("text").alias("char_count"), F.size(rows).alias("line_count"), short.alias("short_line_ratio"),
                        (F.length(T.strip(F.col("text"))) >= 200).alias("has_extractable_text"))


def documents_from_pages(pages: DataFrame) -> DataFrame:
    """PDF pages (path, index, text), whatever library read them, to documents."""
    fixed = pages.withColumn("text", repair_pdf_text(F.col("text")))
    stats = page_stats(fixed).groupBy("path").agg(
        F.array_sort(F.collect_list(F.struct("index", "char_count", "line_count", "short_line_ratio", "has_extractable_text"))).alias("pages"),
        (F.avg(F.when(F.col("has_extractable_text"), F.col("short_line_ratio"))) >= 0.55).alias("hint"), F.count_if(~F.col("has_extractable_text")).alias("dead"))
    text = fixed.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("index", "text"))), lambda p: p["text"]).alias("t"))
    no = F.lit(False)
    return text.join(stats, "path").select(
        "path", T.strip(F.array_join("t", "\n")).alias("text"), F.lit("pdf").alias("source_format"), F.size("pages").alias("page_count"), "pages",
        F.when(F.col("dead") > 0, F.array(F.concat(F.col("dead").cast("string"), F.lit(" page(s) without text")))).otherwise(F.array().cast("array<string>")).alias("warnings"),
        no.alias("has_tables"), F.lit(0).alias("table_count"), no.alias("has_images"), F.lit(0).alias("image_count"),
        F.coalesce("hint", no).alias("has_multi_column_hint"), no.alias("has_text_in_headers_footers"), no.alias("is_encrypted"))


def docx_blocks(content: bytes) -> dict:
    """Text in block order, tables flattened, header and footer text last, with counts."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        edges = [n for n in z.namelist() if n.startswith(("word/header", "word/footer"))]
        edge_text = [t for n in sorted(edges) for p in ElementTree.fromstring(z.read(n)).iter(f"{_W}p") if (t := _text(p).strip())]
    out, tables = [], 0
    for block in body if body is not None else ():
        if block.tag == f"{_W}p":
            t = _text(block).strip()
            style = block.find(f"{_W}pPr/{_W}pStyle")
            listed = block.find(f"{_W}pPr/{_W}numPr") is not None or (style is not None and "list" in style.get(f"{_W}val", "").lower())
            out.append("- " + t if t and listed and t[0] not in "-*" else t)
        elif block.tag == f"{_W}tbl":
            tables += 1
            for row in block.iter(f"{_W}tr"):
                cells = [" ".join(_text(p) for p in c.iter(f"{_W}p")).strip() for c in row.iter(f"{_W}tc")]
                kept = [c for k, c in enumerate(cells) if c and (not k or c != cells[k - 1])]
                if kept:
                    out.append(" | ".join(kept))
    images = sum(1 for _ in body.iter("{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}inline")) if body is not None else 0
    return {"text": "\n".join([*out, *edge_text]).strip(), "tables": tables, "images": images, "edges": bool(edge_text)}


def _text(p: ElementTree.Element) -> str:
    return "".join(e.text or "" if e.tag == f"{_W}t" else "\t" if e.tag == f"{_W}tab" else "\n" if e.tag == f"{_W}br" else "" for e in p.iter())


@F.pandas_udf(StructType().add("text", StringType()).add("tables", IntegerType()).add("images", IntegerType()).add("edges", BooleanType()).add("error", StringType()))
def parsed_content(content: pd.Series, kind: pd.Series) -> pd.DataFrame:
    """Text and layout counts of text and DOCX files, or what went wrong."""
    rows = []
    for data, k in zip(content, kind):
        try:
            if k == "docx":
                b = docx_blocks(bytes(data))
                rows.append((b["text"], b["tables"], b["images"], b["edges"], None))
            else:
                rows.append((decoded(data) if k == "txt" else None, 0, 0, False, None))
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
            rows.append((None, 0, 0, False, f"{type(e).__name__}: {e}"[:200]))
    return pd.DataFrame(rows, columns=["text", "tables", "images", "edges", "error"])


def extract_all(files: DataFrame, config: EngineConfig = EngineConfig(), pdf_pages: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row a file: code and message of an error, or the columns of EXTRACTED. Each file is parsed once; also for streams (without `pdf_pages`).

    Codes: file_too_large, unsupported_format, extraction_failed, empty_document. `pdf_pages` turns files (path, content) into pages (path, index, text).
    """
    no, none = F.lit(False), F.array().cast("array<string>")
    rows = files.withColumn("big", F.col("length") > config.max_bytes).withColumn("format", F.when(~F.col("big"), detect_format(F.col("content"), F.col("path"))))
    rows = rows.withColumn("p", parsed_content(F.when(F.col("format").isin("txt", "docx"), F.col("content")), "format")).withColumn("text", T.strip(F.col("p.text")))
    one_page = F.array(F.struct(F.lit(0).alias("index"), F.length("text").alias("char_count"), F.size(T.filled_lines(F.col("text"))).alias("line_count"),
                                F.lit(0.0).alias("short_line_ratio"), (F.length("text") > 0).alias("has_extractable_text")))
    read = rows.select(
        "path", "length", "big", "format", F.col("p.error").alias("error"), "text", F.col("format").alias("source_format"), page_count(F.col("text")).alias("page_count"), one_page.alias("pages"),
        F.when(F.col("format") == "txt", F.array(F.lit("plain text has no layout"))).when(F.col("p.edges"), F.array(F.lit("text in header or footer"))).otherwise(none).alias("warnings"),
        (F.col("p.tables") > 0).alias("has_tables"), F.col("p.tables").alias("table_count"), (F.col("p.images") > 0).alias("has_images"), F.col("p.images").alias("image_count"),
        no.alias("has_multi_column_hint"), F.col("p.edges").alias("has_text_in_headers_footers"), no.alias("is_encrypted"))
    if pdf_pages is not None:
        of_pdf = F.coalesce(F.col("format") == "pdf", no)
        paged = documents_from_pages(pdf_pages(rows.filter(of_pdf).select("path", "content")))
        lost = read.filter(of_pdf).select("path", "length", "big", "format").join(paged, "path", "left").withColumn("error", F.when(F.col("text").isNull(), F.lit("no page could be read")))
        read = read.filter(~of_pdf).unionByName(lost)
    code = (F.when(F.col("big"), "file_too_large").when(F.col("format").isNull(), "unsupported_format").when(F.col("error").isNotNull() | F.col("text").isNull(), "extraction_failed")
            .when(F.col("text") == "", "empty_document"))
    message = (F.when(F.col("big"), F.concat(F.col("length").cast("string"), F.lit(f" bytes, {config.max_bytes} allowed"))).when(F.col("format").isNull(), "not a PDF, DOCX or text file")
               .when(F.col("error").isNotNull(), F.col("error")).when(F.col("text").isNull(), "no PDF reader given").when(F.col("text") == "", "no text"))
    cut = F.length("text") > config.max_chars
    done = read.withColumn("code", code).withColumn("message", message).withColumn("warnings", F.when(cut, F.array_append("warnings", F.lit("truncated"))).otherwise(F.col("warnings")))
    return done.withColumn("text", F.substring("text", 1, config.max_chars)).drop("length", "big", "format", "error")


def extract(files: DataFrame, pdf_pages: Callable[[DataFrame], DataFrame] | None = None, config: EngineConfig = EngineConfig()) -> tuple[DataFrame, DataFrame]:
    """(documents, errors) of `extract_all`, for callers that read one of them, or keep the whole themselves."""
    return split_errors(extract_all(files, config, pdf_pages))


def split_errors(extracted: DataFrame) -> tuple[DataFrame, DataFrame]:
    return extracted.filter("code IS NULL").drop("code", "message"), extracted.filter("code IS NOT NULL").select("path", "code", "message")
