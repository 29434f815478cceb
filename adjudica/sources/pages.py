"""PDF pages and pictures. Text layers are read by ``pdf``; the engines for anything else (rendering, OCR) are adapters
that a deployment brings, and what follows from their output is native. Without an adapter a file gives the documented
empty row."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from adjudica.functions import numeric as Q, text as X
from adjudica.sources.files import TYPES, ending, map_files
from adjudica.sources.pdf import has_text, read_pdf

BLOCK = "struct<x0:double,y0:double,x1:double,y1:double,text:string,no:int>"
WORD = "struct<text:string,left:int,top:int,width:int,height:int,conf:double>"
PAGE_ROWS = f"page_no int, layer string, blocks array<{BLOCK}>, notes string"
IMAGE_ROWS = "page_no int, image_path string, width int, height int, success boolean, notes string"
WORD_ROWS = f"words array<{WORD}>, engine string"


def open_pdf(files: DataFrame, adapter: Callable[[bytes], list[dict]] | None = None) -> DataFrame:
    """One row per page, by the adapter or else by ``pdf.read_pdf``; a file that can't be read is one row that says so."""
    return map_files(files, adapter or read_pdf, PAGE_ROWS)


def text_layer(files: DataFrame) -> DataFrame:
    """Adds ``has_text``: whether one of a PDF's first two pages has any text; null for other files."""
    @F.arrow_udf("boolean")
    def probe(contents: pa.Array) -> pa.Array:
        return pa.array([has_text(c.as_py()) for c in contents], pa.bool_())

    is_pdf = ending(F.col("path")).isin(*TYPES["pdf"])
    return files.withColumn("has_text", F.when(is_pdf, probe(F.when(is_pdf, F.col("content")))))


def pdf_texts(files: DataFrame) -> DataFrame:
    """path, raw_text and num_pages of the PDFs among routed files."""
    return document_text(assess_pages(open_pdf(files.filter("type = 'pdf'"))))


def page_images(files: DataFrame, adapter: Callable[[bytes], list[dict]] | None = None) -> DataFrame:
    failed = {"page_no": 0, "image_path": "", "width": 0, "height": 0, "success": False, "notes": "no PDF engine"}
    return map_files(files, adapter or (lambda raw: [failed]), IMAGE_ROWS)


def read_words(images: DataFrame, adapter: Callable[[bytes], list[dict]] | None = None) -> DataFrame:
    """The words of a picture, by an OCR adapter; else no words and engine none."""
    return map_files(images, adapter or (lambda raw: [{"words": [], "engine": "none"}]), WORD_ROWS)


def ocr_result(words: DataFrame) -> DataFrame:
    """text, lines with boxes, confidence from words."""
    kept = F.filter("words", lambda w: X.strip(F.coalesce(w["text"], F.lit(""))) != "")
    lines = F.transform("_kept", lambda w: F.struct(X.strip(w["text"]).alias("text"), F.array(w["left"], w["top"], w["width"], w["height"]).alias("bbox"), F.coalesce(w["conf"], F.lit(0.0)).alias("conf")))
    return words.withColumn("_kept", kept).withColumns({"text": Q.words_text(F.col("_kept")), "lines": lines, "confidence": Q.mean_confidence(F.col("_kept"))}).drop("_kept", "words")


def best_variant(variants: DataFrame, by: str = "path") -> DataFrame:
    """Of several enhancements' results the one with the highest confidence; of equals the longest text, then the last
    by code point. A result without confidence counts least."""
    rank = F.struct(F.coalesce("confidence", F.lit(-1.0)), F.length(F.coalesce("text", F.lit(""))), F.coalesce("text", F.lit("")), F.coalesce("engine", F.lit("")))
    return variants.groupBy(by).agg(F.max_by(F.struct("text", "confidence", "engine"), rank).alias("best")).select(by, "best.*")


def assess_pages(pages: DataFrame, ocr_text_col: str | None = None) -> DataFrame:
    """text, scanned, table_detected, sha256 and confidence of each page from its blocks."""
    blocks = F.transform(F.filter(Q.ordered_blocks(F.col("blocks")), lambda b: X.strip(b["text"]) != ""), lambda b: b["text"])
    layer = F.array_join(blocks, "\n")
    text = F.when(X.strip(layer) != "", layer).otherwise(F.coalesce(F.col(ocr_text_col), F.lit("")) if ocr_text_col else F.lit(""))
    made = pages.withColumns({"text": text, "scanned": Q.is_scanned(F.col("layer"), F.col("blocks")), "table_detected": Q.has_table(F.col("blocks"))})
    return made.withColumn("sha256", F.sha2("text", 256)).withColumn("confidence", Q.page_confidence(F.col("text"), F.col("scanned"), F.col("table_detected")))


def document_text(pages: DataFrame) -> DataFrame:
    """Pages joined in order by line ends, then stripped; with the number of pages."""
    held = F.sort_array(F.collect_list(F.struct("page_no", "text")))
    joined = X.strip(F.array_join(F.transform("held", lambda p: p["text"]), "\n"))
    return pages.groupBy("path").agg(held.alias("held")).select("path", joined.alias("raw_text"), F.size("held").alias("num_pages"))
