"""The whole claim plan: one chain of narrow stages from text to decision, without a shuffle."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from adjudica import settings as S
from adjudica.functions import normalize as N, text as X
from adjudica.operators.decide import decide
from adjudica.operators.extract import extract_fields, several
from adjudica.operators.infer import infer, summarize
from adjudica.operators.validate import normalize_fields, validate
from adjudica.sources.files import decode_plain


def process_text(df: DataFrame, as_of: date, text_col: str = "raw_text", nfkc: X.NFKC = X.nfkc, answers_col: str | None = None, summary_col: str | None = None, settings: S.Settings = S.DEFAULTS, warn_several: bool = False, months: bool = False, extracted: tuple[str, ...] = S.EXTRACTED, inferred: tuple[str, ...] = S.FIELDS) -> DataFrame:
    """Adds extracted, raw_lines, extract_notes, normalized, validation, inferred, summary, decision and hitl_required.
    ``warn_several``: texts with more than one value for an id, number or address get a warning. ``months``: dates with
    slashes and month names are read before digits are repaired. ``extracted`` (with the ten normalized fields) and ``inferred``: the
    fields of these structs, where not all are read."""
    out = extract_fields(df, text_col, extracted)
    raw = {n: F.col("extracted")[n]["value"] for n in S.FIELDS}
    out = out.withColumn("normalized", N.all_fields(raw, as_of, nfkc, months))
    if warn_several:
        out = out.withColumn("several", several(F.col(text_col)))
    out = validate(out, as_of, settings=settings, several_col="several" if warn_several else None)
    out = infer(out, as_of, text_col, answers_col=answers_col, names=inferred)
    out = summarize(out, text_col, answer_col=summary_col)
    out = decide(out)
    return out.withColumn("hitl_required", F.col("decision.requires_human"))


def process_files(files: DataFrame, as_of: date, pages_text: DataFrame | None = None, mails: DataFrame | None = None) -> DataFrame:
    """From routed files: text files are decoded, PDFs and pictures take their adapter's text, mails their body."""
    text = F.when(F.col("type").isin("text", "unknown"), decode_plain(F.col("content")))
    out = files
    for name, df, column in (("_pages", pages_text, "raw_text"), ("_mails", mails, "body")):
        if df is not None:
            out = out.join(df.select("path", F.col(column).alias(name)), "path", "left")
            text = F.coalesce(text, F.col(name))
    return process_text(out.withColumn("raw_text", F.coalesce(text, F.lit(""))).drop("_pages", "_mails"), as_of)


def process_columns(df: DataFrame, as_of: date, nfkc: X.NFKC = X.nfkc) -> DataFrame:
    """From string columns of the ten fields' names: normalized, validation and decision."""
    return decide(validate(normalize_fields(df, as_of, nfkc), as_of))
