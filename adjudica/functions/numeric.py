"""Page and word measures over arrays of structs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from adjudica.functions import text as X


def share_of_one(mean: Column) -> Column:
    """A percentage if above one; to three places."""
    return F.round(F.when(mean > 1.0, F.least(F.lit(1.0), mean / 100)).otherwise(mean), 3)


def mean_confidence(words: Column) -> Column:
    total = F.aggregate(words, F.lit(0.0), lambda a, w: a + F.coalesce(w["conf"], F.lit(0.0)))
    return share_of_one(F.when(F.size(words) > 0, total / F.size(words)).otherwise(F.lit(0.0)))


def words_text(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: X.strip(w["text"])), " ")


def ordered_blocks(blocks: Column) -> Column:
    """By line, then column."""
    return F.transform(F.array_sort(F.transform(blocks, lambda b: F.struct(b["y0"].alias("y"), b["x0"].alias("x"), b.alias("b")))), lambda s: s["b"])


def has_table(blocks: Column) -> Column:
    """Six blocks or more, and two columns or more that three blocks or more begin at. Among the sorted edges, the last
    of such a column equals the one two places before it and not the one after it."""
    def wide(edges: Column) -> Column:
        def last(e: Column, i: Column) -> Column:
            return (F.get(edges, i - 2) == e) & ~F.coalesce(F.get(edges, i + 1) == e, F.lit(False)) & (i >= 2)

        return F.size(F.filter(edges, last)) >= 2

    edges = F.array_sort(F.transform(blocks, lambda b: F.bround(b["x0"], 0)))
    return F.coalesce((F.size(blocks) >= 6) & X.let(edges, wide), F.lit(False))


def is_scanned(text: Column, blocks: Column) -> Column:
    return (X.strip(F.coalesce(text, F.lit(""))) == "") & ~F.exists(F.coalesce(blocks, F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double,text:string,no:int>>")), lambda b: F.length(X.strip(b["text"])) > 5)


def page_confidence(text: Column, scanned: Column, table: Column) -> Column:
    return confidence_of_length(F.length(X.strip(text)), scanned, table)


def confidence_of_length(n: Column, scanned: Column, table: Column) -> Column:
    base = F.when(n > 2000, 0.95).when(n > 800, 0.85).when(n > 300, 0.70).when(n > 100, 0.50).otherwise(0.35)
    less = base - F.when(scanned, 0.12).otherwise(0.0) - F.when(table, 0.08).otherwise(0.0)
    return F.when(n == 0, F.lit(0.1)).otherwise(F.round(F.greatest(F.lit(0.10), F.least(F.lit(0.99), less)), 2))


def capped_mean(total: Column, n: Column) -> Column:
    """A mean of percentages as a share of one, from its sum."""
    return share_of_one(total / n)


def best_by_confidence(variants: Column) -> Column:
    """The variant with the highest confidence; the first of equals."""
    ranked = F.transform(variants, lambda v, i: F.struct(v["confidence"].alias("c"), (-i).alias("i"), v.alias("v")))
    return F.array_max(ranked)["v"]
