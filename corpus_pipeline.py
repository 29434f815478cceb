"""From raw documents to packed sequences: toxic texts go, one text of each near-duplicate group stays, sources are
mixed to their targets, and what is left is packed. Each stage reads what the one before it wrote.

All stages take null texts as empty ones, and null ids and sources as values of their own. Documents may have further
columns of any name; all stages but the last return every column as it was. An empty table gives no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from adjudica.llm import jaccard, mixing, packing, toxicity
from adjudica.llm.common import materialize, table


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored one half or more by a network fitted to the labelled documents go. Each row is judged by its own
    text alone, so repeated rows go or stay together, and an empty text stays unless all labels are toxic."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id stays of each group linked by a Jaccard similarity of 0.8 or more over shingles
    of five words. All empty and null texts are one group; a row without id stays only where its whole group has none;
    of rows with that same id and group one stays."""
    return jaccard.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target says. Equal rows get equally many copies; documents of a source
    without words are not taken."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document: where it stands in which sequence. Repeated rows are packed each; an empty text
    is a piece of its end id alone. Only the id and the text are read."""
    return packing.pack(docs)


STAGES = [("toxicity", clean), ("simhash", deduplicate), ("mixing", mix), ("packing", pack)]

# The network, the fingerprints and the tokenizer are not SQL's to express; tests hold the stages against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
