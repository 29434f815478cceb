"""Tables under one folder: what the stages write, and how a claim is read back.

A stage table grows by batches, one subfolder each (``batch=1``, ``batch=2``, ...), which Spark's commit makes whole or
not at all. What is read is the latest row of each claim: the one of the last batch that has it, and of several rows in
that batch the one with the largest hash of its content. So a later batch never touches claims that it doesn't hold, a
changed decision replaces the one before, and a job that runs again after a failure only adds a batch. Two writers that
pick the same batch number don't overwrite each other: the second one fails. ``compact`` writes the latest rows as one
batch and removes those before it. Every batch has a row in the manifest.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

STAGES = ("raw", "extracted", "fields", "decision")
APPENDED = ("review_tasks", "review_feedback", "audit_events", "archived", "deleted", "finals", "manifest")


@dataclass(frozen=True)
class ClaimStore:
    """Stage tables hold the latest row of each claim, the others only grow."""

    spark: SparkSession
    base: str
    key: str = "claim_id"

    def path(self, name: str) -> str:
        return f"{self.base.rstrip('/')}/{name}"

    def _folder(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def batches(self, name: str) -> list[int]:
        """The numbers of a table's whole batches: those whose commit has left its mark."""
        path, store = self._folder(name)
        if not store.exists(path):
            return []
        found = [f.getPath() for f in store.listStatus(path) if f.isDirectory() and f.getPath().getName().startswith("batch=")]
        mark = lambda p: self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")
        return sorted(int(p.getName().split("=")[1]) for p in found if store.exists(mark(p)))

    def _taken(self, name: str) -> int:
        path, store = self._folder(name)
        names = [f.getPath().getName() for f in store.listStatus(path)] if store.exists(path) else []
        return max([int(n.split("=")[1]) for n in names if n.startswith("batch=")], default=0)

    def save(self, name: str, df: DataFrame) -> int:
        """Adds a batch of a stage table; its number."""
        number = self._taken(name) + 1
        folder = f"{self.path(name)}/batch={number}"
        df.write.mode("errorifexists").parquet(folder)
        self.append("manifest", self.spark.read.parquet(folder).agg(F.lit(name).alias("name"), F.lit(number).cast("long").alias("batch"), F.count("*").alias("n_rows")))
        return number

    def append(self, name: str, df: DataFrame) -> None:
        if name not in APPENDED:
            raise ValueError(f"not an append-only table: {name}")
        df.write.mode("append").parquet(self.path(name))

    def load(self, name: str) -> DataFrame:
        """An append-only table whole, a stage table by its latest rows."""
        if name in APPENDED:
            return self.spark.read.parquet(self.path(name))
        numbers = self.batches(name)
        reader = self.spark.read.option("basePath", self.path(name)).option("mergeSchema", "true")
        every = reader.parquet(*[f"{self.path(name)}/batch={n}" for n in numbers])
        rest = [c for c in every.columns if c not in (self.key, "batch")]
        rank = F.struct("batch", F.xxhash64(F.to_json(F.struct(*rest))))
        last = every.groupBy(self.key).agg(F.max_by(F.struct(*rest), rank).alias("last"))
        return last.select(self.key, *[F.col("last")[c].alias(c) for c in rest])

    def compact(self, name: str) -> int:
        """The latest rows as one batch; those before it go once it is whole."""
        before = self.batches(name)
        number = self.save(name, self.load(name))
        path, store = self._folder(name)
        for n in before:
            store.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path, f"batch={n}"), True)
        return number

    def save_raw(self, files: DataFrame, at: Column) -> None:
        kept = files.select("claim_id", "original_name", F.col("path").alias("saved_path"), "size", "sha256", "content", at.alias("ts"))
        self.save("raw", kept)

    def save_stages(self, result: DataFrame, at: Column) -> None:
        self.save("extracted", result.select("claim_id", at.alias("timestamp"), F.col("raw_text").alias("extracted_text")))
        self.save("fields", result.select("claim_id", at.alias("timestamp"), "extracted", "normalized", "validation", "inferred"))
        self.save("decision", result.select("claim_id", at.alias("timestamp"), F.col("decision").alias("details"), F.col("decision.decision").alias("decision")))

    def claims(self) -> DataFrame:
        return load_claims(*[self.load(s) for s in STAGES])


def load_claims(raw: DataFrame, extracted: DataFrame, fields: DataFrame, decision: DataFrame, key: str = "claim_id") -> DataFrame:
    """One struct per stage for each raw claim; null where a stage has none."""
    out = raw.select(key, F.struct(*[c for c in raw.columns if c != key]).alias("raw"))
    for name, df in (("extracted", extracted), ("fields", fields), ("decision", decision)):
        out = out.join(df.select(key, F.struct(*[c for c in df.columns if c != key]).alias(name)), key, "left")
    return out


def export_json(df: DataFrame, out: str = "json", skip: tuple[str, ...] = ()) -> DataFrame:
    """Each row as JSON text, null fields left out."""
    return df.select(F.to_json(F.struct(*[c for c in df.columns if c not in skip])).alias(out))


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, one per file, with a schema of the caller's and the file that each came from."""
    return spark.read.schema(schema).option("multiLine", "true").json(path).withColumn("source_file", F.col("_metadata.file_path"))
