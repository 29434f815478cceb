"""Mixing sources to target weights.

1. Words are counted per document, once, into a narrow table (id, source, digest of the text, size); all that follows
   but the last step reads that one.
2. Words are summed per source. The targets share out all words by weight; no source gives more than ``most`` times its
   own words, and what it cannot give is shared among the others by weight, until none is above. With level x, a
   source's target is min(weight * x, most * size). x rises from sum to sum: sources full at the level so far have their
   caps, the others share the rest, until no more become full. Weights follow the sources' order by code point, which
   is counted over ranges of sources, so no task holds them all.
3. The repetition rate is target / size. A document is taken floor(rate) times, and once more if the hash of its id and
   text, read as a fraction, is below the rate's fraction. Each source has 16 such draws to choose from and uses the one
   whose words come closest to its target (the first of equals).

Per source only sums move (partial sums before the shuffle). The targets, one row per source, are written first, so
that their size is known when the join back is planned: texts stay where they are while it is small, and a hot source
is split by adaptive execution where it is not. A null text has size 0; a null source is a source of its own, the last;
a null id draws like the text of a zero character. Sources without words have target 0 and are not taken. Equal rows
(same id and text) get the same number of copies. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from adjudica.llm.common import materialize, scratch

WORD = r"[^\x20\x09-\x0D]+"
MOST, DRAWS = 3, 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cycle_weights(by_code_point: Column) -> Column:
    """1, 2, 3, repeating, for the sources numbered from 1."""
    return ((by_code_point - 1) % 3 + 1).cast("double")


def numbered(sums: DataFrame) -> DataFrame:
    """The sources with ``nth``, their place by code point from 1, null last."""
    spark = sums.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = sums.withColumn("missing", F.col("source").isNull()).repartitionByRange(ranges, "missing", "source").withColumn("range", F.spark_partition_id())
    placed = materialize(placed, "source-sizes")
    counts = {r.range: r.n for r in placed.groupBy("range").agg(F.count("*").alias("n")).collect()}  # one row a range
    before, total = [], 0
    for at in sorted(counts):
        before.append((at, total))
        total += counts[at]
    bases = spark.createDataFrame(before, "range int, before long")
    own = F.row_number().over(Window.partitionBy("range").orderBy("missing", "source"))
    return placed.withColumn("own", own).join(bases, "range").select("source", "source_size", (F.col("before") + F.col("own")).alias("nth"))


def source_targets(sums: DataFrame, most: int = MOST, weights=cycle_weights) -> DataFrame:
    """(source, source_size, target) of each source, from (source, source_size)."""
    weighted = numbered(sums).withColumn("weight", weights(F.col("nth"))).withColumn("cap", (F.col("source_size") * most).cast("double"))
    weighted = materialize(weighted, "weights")
    level, full = -1.0, None
    while True:
        is_full = F.col("cap") <= F.col("weight") * level
        row = weighted.agg(F.sum("source_size"), F.sum(F.when(is_full, F.col("cap"))), F.sum(F.when(~is_full, F.col("weight"))), F.count_if(is_full)).first()
        if row[2] is None or row[3] == full:  # no source is open, or no more became full
            break
        level, full = (float(row[0]) - (row[1] or 0.0)) / row[2], row[3]
    level = float("inf") if row[2] is None else level
    return weighted.select("source", "source_size", F.least(F.col("weight") * F.lit(level), F.col("cap")).alias("target"))


def draw(of: Column, nth: int) -> Column:
    """In [0, 1), the same in every run and in DuckDB: 32 bits of one of four MD5 sums."""
    text = F.concat(of, F.lit(f"\x1f{nth // 4}"))
    return F.conv(F.substring(F.md5(text), nth % 4 * 8 + 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def identity(row_id: Column, digest: Column) -> Column:
    return F.concat(F.coalesce(row_id.cast("string"), F.lit("\x00")), F.lit("\x1f"), digest)


def copies(rate: Column, fraction: Column) -> Column:
    whole = F.floor(rate)
    return (whole + F.when(fraction < rate - whole, 1).otherwise(0)).cast("long")


def rate_of() -> Column:
    return F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))


def sized(df: DataFrame, id_col: str, text_col: str, source_col: str) -> list[Column]:
    return [F.col(source_col).alias("source"), identity(F.col(id_col), F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("name"), word_count(F.col(text_col)).alias("size")]


def with_targets(rows: DataFrame, targets: DataFrame) -> DataFrame:
    return rows.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).drop(F.col("t.source"))


def plan(narrow: DataFrame, most: int = MOST) -> DataFrame:
    """One row per source: source, source_size, target, chosen (which draw it uses), from rows of (source, name, size)."""
    sums = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialize(source_targets(sums, most), "targets")
    met = with_targets(narrow, targets)
    taken = [F.sum(F.col("size") * copies(rate_of(), draw(F.col("name"), k))).alias(f"t{k}") for k in range(DRAWS)]
    tried = met.groupBy("source", "source_size", "target").agg(*taken)
    off = F.array(*[F.struct(F.abs(F.col(f"t{k}") - F.col("target")).alias("off"), F.lit(k).alias("k")) for k in range(DRAWS)])
    return materialize(tried.select("source", "source_size", "target", F.array_min(off)["k"].alias("chosen")), "plan")


def drawn(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """``rows`` of (source, name, size, ...) with source_size, target and copies."""
    fraction = F.lit(0.0)
    for k in range(DRAWS):
        fraction = F.when(F.col("chosen") == k, draw(F.col("name"), k)).otherwise(fraction)
    return with_targets(rows, planned).withColumn("copies", copies(rate_of(), fraction))


def shares(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target and copies of every document; texts are read once."""
    narrow = materialize(df.select(F.col(id_col).alias("doc_id"), *sized(df, id_col, text_col, source_col)), "sizes")
    return drawn(narrow, plan(narrow, most)).select("doc_id", "source", "size", "source_size", "target", "copies")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = MOST) -> DataFrame:
    """Each document as often as its copies say, with its own columns, whatever their names."""
    with scratch(df.sparkSession) as keep:
        planned = keep(plan(materialize(df.select(*sized(df, id_col, text_col, source_col)), "sizes"), most))
    rows = df.select(F.struct("*").alias("row"), *sized(df, id_col, text_col, source_col))
    taken = drawn(rows, planned).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
