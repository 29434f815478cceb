"""SimHash near-duplicates: every pair of fingerprints at most ``bits`` apart, by vantage-point trees.

1. A document's fingerprint has a bit set if more than half of its shingles' XXH64 have it. Equal fingerprints form
   one class, which is all that goes on: a text with any number of copies costs one row.
2. If two fingerprints differ in at most 4 bits, then in one of three blocks of 21, 21 and 22 bits they differ in at
   most one (``bits // 3``). Within a block, Hamming distance is a metric too, and a small radius prunes far
   better than radius 4 over 64 bits does. So each block has a vantage-point tree of its own.
3. The top of each tree, fitted on a bounded sample, deals the fingerprints to shards: by the triangle inequality a
   pair that a node separates has its inner one within the radius of the border, so inner border points also go to
   the outer child, and every pair meets in at least one shard. Each shard goes on with a tree of its own points and
   compares whole fingerprints at the leaves. Its result is a spanning star per group, never all pairs. A shard that
   the top leaves too dense is dealt to parts, which meet two by two.
4. Groups grow together by large-star and small-star steps until nothing changes.

Null and empty texts have the fingerprint zero and link like any other. Equal rows are kept each. A null doc_id is
never the smallest of a component, unless all are null. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from adjudica.llm.common import give_back, leave_out, materialize, scratch

WORDS, BITS, SEED = 4, 4, 42
SAMPLE = 16_384  # fingerprints that the tops of the trees are fitted on
SHARD = 2_048  # fingerprints a shard, before border points
DENSE = 8  # times SHARD: a shard with more, border points included, is divided further
LEAF = 192
CHUNK = 1 << 15
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    from xxhash import xxh64_intdigest

    found = (text or "").encode().translate(LOWER).split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(found) - words + 1)
    starts, ends = starts[:n], ends[min(words, len(found)) - 1 :]
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        some = zip(starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist(), strict=True)
        hashes = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in some], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, words: int = WORDS, seed: int = SEED) -> Column:
    @F.arrow_udf("long")
    def made(texts: pa.Array) -> pa.Array:
        values = np.fromiter((fingerprint(t.as_py(), words, seed) for t in texts), np.uint64, len(texts))
        give_back()
        return pa.array(values.view(np.int64))

    return made(text)


def blocks(bits: int) -> list[tuple[int, int]]:
    """(mask, radius): three blocks of the 64 bits, in one of which a linked pair differs in ``bits // 3`` at most."""
    edges = [0, 21, 42, 64]
    return [(sum(1 << i for i in range(a, b)), bits // 3) for a, b in zip(edges, edges[1:], strict=False)]


def distances(points: np.ndarray, vantage, mask: int) -> np.ndarray:
    return np.bitwise_count((points ^ vantage) & np.uint64(mask))


class Top:
    """The first levels of one block's tree: node i has the children 2i+1 (at most ``border`` away) and 2i+2."""

    def __init__(self, sample: np.ndarray, depth: int, mask: int, radius: int, seed: int):
        self.depth, self.mask, self.radius = depth, mask, radius
        self.vantage, self.border = np.zeros(2**depth - 1, np.uint64), np.zeros(2**depth - 1, np.uint8)
        rng, held = np.random.default_rng(seed), {0: sample}
        middle = (mask.bit_count() - 1) // 2
        for node in range(2**depth - 1):
            own = held.pop(node)
            self.vantage[node] = own[rng.integers(len(own))] if len(own) else rng.integers(1 << 63, dtype=np.uint64)
            away = distances(own, self.vantage[node], mask)
            self.border[node] = max(0, int(np.median(away)) if len(own) >= 32 else middle)
            held[2 * node + 1], held[2 * node + 2] = own[away <= self.border[node]], own[away > self.border[node]]

    def shards(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of a point, its shard) for all shards that it belongs to."""
        index, node = np.arange(len(points)), np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            away = distances(points[index], self.vantage[node], self.mask).astype(np.int64)
            border = self.border[node].astype(np.int64)
            inner, outer = away <= border, away > border - self.radius
            index = np.concatenate([index[inner], index[outer]])
            node = np.concatenate([2 * node[inner] + 1, 2 * node[outer] + 2])
        return index, node - (2**self.depth - 1)


def dealer(tops: list[Top]):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column("fp").to_numpy().view(np.uint64)
            for block, top in enumerate(tops):
                index, shard = top.shards(points)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(index), block, np.int32)), pa.array(shard), pa.array(points[index].view(np.int64))], ["block", "shard", "fp"])

    return deal


def roots(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The smallest index that each of n points is linked to, links being (a, b)."""
    label = np.arange(n) if label is None else label
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if (label == before).all():
            break
    while (label[label] != label).any():
        label = label[label]
    return label


def group(points: np.ndarray, mask: int, radius: int, bits: int) -> np.ndarray:
    """For each of the distinct points the index of its group's root, for links that this metric finds."""
    label = np.arange(len(points))
    full = (1 << 64) - 1
    left = [(np.arange(len(points)), mask, radius)]
    rng = np.random.default_rng(len(points))
    while left:
        index, mask, radius = left.pop()
        if len(index) > LEAF:
            own = points[index]
            tries = [distances(own, own[rng.integers(len(own))], mask).astype(np.int64) for _ in range(3)]
            split = min(((away, int(m)) for away in tries for m in (np.median(away), np.median(away) - 1)), key=lambda s: max((s[0] <= s[1]).sum(), (s[0] > s[1] - radius).sum()))
            inner, outer = split[0] <= split[1], split[0] > split[1] - radius
            if max(inner.sum(), outer.sum()) < 0.9 * len(index):
                left += [(index[inner], mask, radius), (index[outer], mask, radius)]
                continue
            if mask != full:  # too dense in this block: the whole fingerprint still tells these apart
                left.append((index, full, bits))
                continue
        own = points[index]
        for at in range(0, len(own), 256):
            near = np.bitwise_count(own[at : at + 256, None] ^ own[None, at:]) <= bits
            a, b = np.nonzero(near)
            apart = a < b
            label = roots(len(points), index[at + a[apart]], index[at + b[apart]], label)
    return label


def shard_links(bits: int):
    parts = blocks(bits)

    def links(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        points = np.unique(rows["fp"].to_numpy())
        label = group(points.view(np.uint64), *parts[int(key[0])], bits)
        linked = np.flatnonzero(label != np.arange(len(points)))
        return pd.DataFrame({"a": points[label[linked]], "b": points[linked]})

    return links


def components(links: DataFrame) -> DataFrame:
    """(b, a): each linked node and the smallest node that it reaches, for nodes other than that smallest one."""
    def tidy(df: DataFrame) -> DataFrame:
        return df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    with scratch(links.sparkSession) as keep:
        return keep(settled(materialize(tidy(links), "links"), tidy, state))


def settled(edges: DataFrame, tidy, state) -> DataFrame:
    before, now = None, state(edges)
    while now != before:
        both = edges.union(edges.select(F.col("b"), F.col("a"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        grown = tidy(large.union(least.select(F.col("m").alias("a"), F.col("u").alias("b"))))
        smallest = grown.groupBy("b").agg(F.min("a").alias("m"))
        small = grown.join(smallest, "b").select(F.col("m").alias("x"), F.col("a").alias("y"), "b")
        edges = materialize(tidy(small.select(F.col("x").alias("a"), F.col("y").alias("b")).union(small.select(F.col("x").alias("a"), "b"))), "links")
        before, now = now, state(edges)
    return edges


def tree_links(points: DataFrame, bits: int = BITS, sample: int = SAMPLE, shard: int = SHARD, dense: int = DENSE) -> DataFrame:
    """Links (a, b) that connect all fingerprints within ``bits`` of each other, from distinct ``fp``: stars, never all pairs."""
    n = points.count()
    some = np.array([r.fp for r in points.orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()], np.int64).view(np.uint64)
    depth = max(0, int(np.ceil(np.log2(max(1, n / shard)))))
    tops = [Top(some, depth, mask, radius, seed) for seed, (mask, radius) in enumerate(blocks(bits))]
    dealt = materialize(points.mapInArrow(dealer(tops), "block int, shard long, fp long"), "dealt-points")
    # a shard that the top didn't divide is dealt to parts by hash, and every part meets every other in a task of its own
    sizes = dealt.groupBy("block", "shard").agg(F.ceil(F.count("*") / (dense * shard)).alias("parts"))
    own = dealt.join(sizes, ["block", "shard"]).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    own = own.select("block", "shard", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "fp")
    return own.groupBy("block", "shard", "i", "j").applyInPandas(shard_links(bits), "a long, b long")


def classes(fps: DataFrame, bits: int = BITS, sample: int = SAMPLE, shard: int = SHARD, dense: int = DENSE) -> DataFrame:
    """(fp, root, component_id) of every class of equal fingerprints, from (doc_id, fp) per document."""
    own = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    links = tree_links(own.select("fp"), bits, sample, shard, dense)
    found = components(links).select(F.col("b").alias("fp"), F.col("a").alias("root"))
    found = found.union(found.select(F.col("root").alias("fp"), "root").distinct())
    linked = materialize(found.join(own, "fp"), "linked")
    smallest = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.select("fp", "root").join(smallest, "root").select("fp", "root", "component_id")
    rest = own.join(named, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    return materialize(rest, "components")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    return materialize(df.select(F.col(id_col).cast("long").alias("doc_id"), fingerprint_column(F.col(text_col), words).alias("fp")), "fingerprints")


def link(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, bits: int = BITS) -> DataFrame:
    """One row per document: doc_id, fp, root (its component's smallest fingerprint as a signed number), component_id."""
    fps = fingerprints(df, id_col, text_col, words)
    return fps.join(classes(fps, bits), "fp").select("doc_id", "fp", "root", "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, bits: int = BITS) -> DataFrame:
    """The document with the smallest id of every component, with all its columns; among rows with equal ids one."""
    fps = fingerprints(df, id_col, text_col, words)
    known = classes(fps, bits)
    repeated = fps.groupBy("doc_id").count().filter("count > 1 or doc_id is null").limit(1).count()
    if not repeated:
        return leave_out(df, id_col, materialize(fps.join(known, "fp").filter("doc_id <> component_id").select("doc_id"), "removed"))
    rows = df.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), fingerprint_column(F.col(text_col), words).alias("fp"))
    firsts = rows.join(known, "fp").filter(F.col("id").eqNullSafe(F.col("component_id")))
    one = firsts.withColumn("nth", F.row_number().over(Window.partitionBy("root").orderBy(F.xxhash64("row")))).filter("nth = 1")
    return one.select("row.*")
