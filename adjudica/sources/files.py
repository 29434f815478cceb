"""Files in: routing by type, text decoding, html."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from adjudica.functions import text as X

# File types by ending, their processors, and how pictures begin.
TYPES = {"pdf": ("pdf",), "image": ("png", "jpg", "jpeg"), "text": ("txt",), "email": ("eml", "msg")}
PROCESSORS = {"image": "image_ocr", "text": "text_file", "email": "email_ingest", "unknown": "unknown"}
PICTURE = "^(89504E470D0A1A0A|FFD8FF)"


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, original_name, size, modified, content, sha256 and a claim_id that follows from the content."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return describe((reader.option("pathGlobFilter", glob) if glob else reader).load(path))


def describe(files: DataFrame) -> DataFrame:
    named = files.withColumn("original_name", X.safe_name(F.col("path"))).withColumn("sha256", F.sha2("content", 256))
    claim = F.concat(F.lit("claim_"), F.substring("sha256", 1, 8))
    return named.select("path", "original_name", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content", "sha256", claim.alias("claim_id"))


def ending(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def route(df: DataFrame, path_col: str = "path", content_col: str = "content", has_text_col: str | None = None) -> DataFrame:
    """Adds type, processor and route_notes. A picture must begin like one. ``has_text_col``: whether a PDF has a
    text layer, from a PDF adapter; without it PDFs count as scanned."""
    end = ending(F.col(path_col))
    picture = F.hex(F.substring(F.col(content_col), 1, 8)).rlike(PICTURE)
    kind = F.when(end.isin(*TYPES["pdf"]), "pdf").when(end.isin(*TYPES["image"]) & F.coalesce(picture, F.lit(False)), "image").when(end.isin(*TYPES["text"]), "text").when(end.isin(*TYPES["email"]), "email").otherwise("unknown")
    pdf = F.when(F.col(has_text_col), "pdf_text").otherwise("pdf_scanned") if has_text_col else F.lit("pdf_scanned")
    by_type = F.create_map(*[F.lit(x) for pair in PROCESSORS.items() for x in pair])
    notes = F.when(end.isin(*TYPES["image"]) & (F.col("type") == "unknown"), "invalid_image").when(F.col("type") == "unknown", "unsupported_extension").otherwise("")
    return df.withColumn("type", kind).withColumn("processor", F.when(F.col("type") == "pdf", pdf).otherwise(by_type[F.col("type")])).withColumn("route_notes", notes)


def decode_full(content: Column) -> Column:
    """struct<success, text, lines, encoding, size, notes>: UTF-8, else Latin-1; line ends as \\n; stripped."""
    utf8 = F.try_validate_utf8(content.cast("string"))
    text = X.strip(F.regexp_replace(F.coalesce(utf8, F.decode(content, "ISO-8859-1")), "\r\n?", "\n"))
    lines = F.filter(F.transform(F.split(text, "\n"), X.strip), lambda x: x != "")
    made = F.struct(F.lit(True).alias("success"), text.alias("text"), lines.alias("lines"), F.when(utf8.isNotNull(), "utf-8").otherwise("latin-1").alias("encoding"), F.length(content).cast("long").alias("size"), F.lit("").alias("notes"))
    none = F.struct(F.lit(False).alias("success"), F.lit("").alias("text"), F.array().cast("array<string>").alias("lines"), F.lit(None).cast("string").alias("encoding"), F.lit(0).cast("long").alias("size"), F.lit("File not found").alias("notes"))
    return F.when(content.isNull(), none).otherwise(made)


def decode_plain(content: Column) -> Column:
    """UTF-8 without what cannot be read and without byte order marks; not stripped."""
    return F.translate(F.make_valid_utf8(content.cast("string")), "\ufffd\ufeff", "")


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []

    def handle_data(self, data: str) -> None:
        self.parts.append(data)


def html_text(html: str | None) -> str:
    """All text nodes, joined by line ends; '' if there is none."""
    parser = _Text()
    try:
        parser.feed(html or "")
        parser.close()
    except (AssertionError, ValueError):
        return ""
    return "\n".join(parser.parts)


def html_to_text(html: Column) -> Column:
    @F.arrow_udf("string")
    def made(pages: pa.Array) -> pa.Array:
        return pa.array([html_text(p.as_py()) for p in pages], pa.string())

    return made(html)


def map_files(df: DataFrame, read, schema: str, content_col: str = "content") -> DataFrame:
    """``read``: bytes to a list of rows (dicts); for containers that only a Python library opens."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame[content_col], strict=True):
                rows = read(content)
                if rows:
                    yield pd.DataFrame([{"path": path, **r} for r in rows])

    return df.select("path", content_col).mapInPandas(run, f"path string, {schema}")
