"""Exact top-k by inner product: ball trees and branch and bound.

1. The top of a ball tree, fitted on a bounded sample, deals all vectors to cells; a cell that holds more than a shard
   should is split by hash, so that a vector with any number of copies loads no single task. Each shard becomes a ball
   tree over its distinct vectors.
2. Queries form blocks. What a block first meets is only the shards' root balls. A node's bound is
   query . centre + |query| * radius: of each 4,096 shards a block searches about the square root of them that lie
   best, and then, with the kth scores that this gives, all others whose root ball may still reach one. Only those pairs
   of shard and block copy a tree.
3. Within a tree, nodes below the query's kth score are pruned with all below them, and leaves are read from the highest
   bound down, each raising the kth score.

Components are floor(scale * x) with x as double and scores are whole numbers: exact in float64 while no sum can pass
2**53, in int64 while none can pass 2**63, in Python's integers beyond. A result whose score is no long (2**63 - 1 or
more in size) raises OverflowError, as does a component that is no double once scaled. Ties go to the smaller id, null
ids last (beside null ids the id 2**63 - 1 raises). Every row is a candidate of its own, repeated ids and equal rows
included; a query is a row too, and only its own row is no candidate for it. Equal vectors share a point that keeps its
k + 1 smallest ids, which is all that can appear. Vectors that are null or hold a null or non-finite component take no
part; a shorter vector counts as ending in zeros. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import io
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from adjudica.llm.common import materialize

K, SCALE, SHARD, BLOCK, LEAF = 20, 64, 4096, 2048, 128
SAMPLE, ROOTS = 4096, 4096  # vectors that the top is fitted on; root balls that a block meets at once
NO_ID, MOST = np.iinfo(np.int64).max, 2**63 - 1


def freeze(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez_compressed(out, **arrays)
    return out.getvalue()


def thaw(raw: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(raw)) as held:
        return dict(held)


def quantised(vectors: pd.Series, dim: int, scale: int) -> np.ndarray:
    """Whole numbers as doubles, which hold them exactly."""
    out = np.zeros((len(vectors), dim))
    for at, vector in enumerate(vectors):
        out[at, : len(vector)] = vector
    with np.errstate(over="ignore"):
        out = np.floor(scale * out)
    if not np.isfinite(out).all():
        raise OverflowError("a component is no double once scaled")
    return out


def numbers(ids: pd.Series) -> np.ndarray:
    """Ids with null ones as the largest number."""
    missing = ids.isna().to_numpy()
    out = np.array([NO_ID if m else int(i) for i, m in zip(ids, missing, strict=True)], np.int64)
    if missing.any() and (out[~missing] == NO_ID).any():
        raise OverflowError("null ids stand beside the largest id")
    return out


def axis_of(own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The middle of some points, how far each is from it, and the direction between two far ones."""
    with np.errstate(over="ignore", invalid="ignore"):
        middle = own.mean(axis=0)
        away = np.nan_to_num(np.sqrt(((own - middle) ** 2).sum(axis=1)), nan=np.inf)
        far = own[away.argmax()]
        return middle, away, far - own[np.nan_to_num(((own - far) ** 2).sum(axis=1), nan=np.inf).argmax()]


class Top:
    """The first levels of a ball tree: node i sends points up to ``cut`` along its axis to 2i+1, others to 2i+2."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.axis, self.cut = np.zeros((2**depth - 1, sample.shape[1])), np.zeros(2**depth - 1)
        held = {0: sample}
        for node in range(2**depth - 1):
            own = held.pop(node)
            if len(own):
                axis = axis_of(own)[2]
                self.axis[node] = np.nan_to_num(axis / max(1.0, np.abs(axis).max()))
                self.cut[node] = np.median(self.along(own, node))
            inner = self.along(own, node) <= self.cut[node]
            held[2 * node + 1], held[2 * node + 2] = own[inner], own[~inner]

    def along(self, points: np.ndarray, node) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            return np.nan_to_num((points * self.axis[node]).sum(axis=-1))

    def cells(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (self.along(points, node) > self.cut[node])
        return node - (2**self.depth - 1)


def build(ids: np.ndarray, points: np.ndarray, keep: int, leaf: int = LEAF) -> dict[str, np.ndarray]:
    """The tree: distinct points in leaf order, the ids of each, and the nodes (children follow their parents)."""
    distinct, which = np.unique(points.astype(np.float64), axis=0, return_inverse=True)
    order, start, end, parent, centre, radius, is_leaf = np.arange(len(distinct)), [], [], [], [], [], []
    left = [(0, len(distinct), -1)]
    while left:
        a, b, above = left.pop()
        own = distinct[order[a:b]]
        middle, away, axis = axis_of(own)
        start.append(a), end.append(b), parent.append(above), centre.append(np.nan_to_num(middle)), radius.append(away.max())
        is_leaf.append(b - a <= leaf)
        if b - a > leaf:
            with np.errstate(over="ignore", invalid="ignore"):
                order[a:b] = order[a:b][np.argsort(own @ axis, kind="stable")]
            cut = (a + b) // 2
            left += [(a, cut, len(start) - 1), (cut, b, len(start) - 1)]
    by_class = np.lexsort((ids, which.ravel()))
    counts = np.bincount(which.ravel(), minlength=len(distinct))
    nth = np.arange(len(ids)) - np.repeat(np.cumsum(counts) - counts, counts)
    held = np.split(ids[by_class][nth < keep], np.cumsum(np.minimum(counts, keep))[:-1])
    most = np.abs(distinct).max(initial=0)
    return {
        "points": distinct[order].astype(np.int16) if most < 2**15 else distinct[order], "ids": np.concatenate([held[i] for i in order]), "counts": np.minimum(counts, keep)[order],
        "start": np.array(start), "end": np.array(end), "parent": np.array(parent), "centre": np.array(centre), "radius": np.array(radius), "leaf": np.array(is_leaf),
    }


def products(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """All inner products of whole numbers held as doubles; those that are no long become +-MOST."""
    dim = max(1, points.shape[1])
    asked, held = np.abs(queries).max(axis=1, initial=0), np.abs(points).max(axis=1, initial=0)
    with np.errstate(over="ignore"):
        if asked.max(initial=0) * held.max(initial=0) * dim < 2**53:
            return (queries @ points.T).astype(np.int64)
        wide = np.outer(asked, held) * dim >= 2**62
    out = np.zeros(wide.shape, np.int64)
    rows, columns = wide.any(axis=1), wide.any(axis=0)
    out[np.ix_(~rows, ~columns)] = queries[~rows].astype(np.int64) @ points[~columns].T.astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)
    clip = lambda x: np.array([max(-MOST, min(MOST, v)) for v in x.ravel()], np.int64).reshape(x.shape)
    if rows.any():
        out[rows] = clip(whole(queries[rows]) @ whole(points).T)
    if columns.any() and not rows.all():
        out[np.ix_(~rows, columns)] = clip(whole(queries[~rows]) @ whole(points[columns]).T)
    return out


def bounds(queries: np.ndarray, centre: np.ndarray, radius: np.ndarray, most: float) -> np.ndarray:
    """What no inner product of a query with a point of each ball exceeds, ``most`` being the largest component."""
    with np.errstate(over="ignore", invalid="ignore"):
        limit = np.abs(queries).max(initial=0) * most * queries.shape[1]
        bound = queries @ centre.T + np.sqrt((queries**2).sum(axis=1))[:, None] * radius
        bound += 1e-9 * (np.abs(bound) + limit) + 1e-6  # rounding never prunes
        return np.where(np.isnan(bound) | (np.abs(bound) > 1e300) | (limit > 1e300), np.inf, bound)


def best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (query, id, score) rows the k best of each query: highest score, then smallest id."""
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    first = np.concatenate([[True], query[1:] != query[:-1]]) if len(query) else np.zeros(0, bool)
    nth = np.arange(len(query)) - np.maximum.accumulate(np.where(first, np.arange(len(query)), 0))
    return query[nth < k], ids[nth < k], scores[nth < k]


def kth(query: np.ndarray, scores: np.ndarray, n: int, k: int, floor: np.ndarray) -> np.ndarray:
    """Each query's kth score where it has k, else what it had."""
    counts = np.bincount(query, minlength=n)
    out = floor.copy()
    np.minimum.at(low := np.full(n, np.iinfo(np.int64).max), query, scores)
    out[counts >= k] = np.maximum(out, low)[counts >= k]
    return out


def search(tree: dict[str, np.ndarray], queries: np.ndarray, floor: np.ndarray, k: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], int]:
    """The k best of the tree for each query, of those that reach the query's floor; and how many leaves were read."""
    points, parent, leaf = tree["points"].astype(np.float64), tree["parent"], tree["leaf"]
    own = queries.astype(np.float64)
    bound = bounds(own, tree["centre"], tree["radius"], np.abs(points).max(initial=0))
    alive = np.ones(bound.shape, bool)
    for node in range(len(parent)):
        alive[:, node] = bound[:, node] >= floor
        if parent[node] >= 0:
            alive[:, node] &= alive[:, parent[node]]
    leaves = np.flatnonzero(leaf)
    bound = np.where(alive[:, leaves], bound[:, leaves], -np.inf)
    order = np.argsort(-bound, axis=1, kind="stable")
    ends = np.concatenate([[0], np.cumsum(tree["counts"])])
    found, read = (np.zeros(0, np.int64),) * 3, 0
    for step in range(len(leaves)):
        here = order[:, step]
        open_ = np.flatnonzero(alive[np.arange(len(own)), leaves[here]] & (bound[np.arange(len(own)), here] >= floor))
        if not len(open_):
            break
        made = [found]
        for at in np.unique(here[open_]):
            rows = open_[here[open_] == at]
            a, b = tree["start"][leaves[at]], tree["end"][leaves[at]]
            scores = products(own[rows], points[a:b])
            q, p = np.nonzero(scores >= floor[rows, None])
            times = tree["counts"][a + p]
            which = np.repeat(ends[a + p] - np.cumsum(times) + times, times) + np.arange(times.sum())
            made.append((np.repeat(rows[q], times), tree["ids"][which], np.repeat(scores[q, p], times)))
            read += len(rows)
        found = best(*(np.concatenate(x) for x in zip(*made, strict=True)), k)
        floor = kth(found[0], found[2], len(own), k, floor)
    return found, read


def top_k(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = K, scale: int = SCALE, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every`` the k best others."""
    spark = df.sparkSession
    valid = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).filter(F.col("vector").isNotNull()).filter(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    valid = valid.withColumn("deal", F.xxhash64("id", "vector"))
    n, asked, dim = valid.agg(F.count("*"), F.count_if(F.col("id") % every == 0), F.max(F.size("vector"))).first()
    if not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim, blocks, keep = max(1, dim), math.ceil(asked / block), k + 1
    some = valid.orderBy("deal", "id").limit(SAMPLE).select("vector").toPandas()["vector"]
    top = Top(quantised(some, dim, scale), max(0, math.ceil(math.log2(n / shard))))

    def to_cells(frames):
        for frame in frames:
            yield frame.assign(cell=top.cells(quantised(frame["vector"], dim, scale)))

    celled = valid.mapInPandas(to_cells, "id long, vector array<double>, deal long, cell long")
    sizes = materialize(celled.groupBy("cell").agg(F.ceil(F.count("*") / shard).alias("parts")), "cells")
    dealt = celled.join(sizes, "cell").withColumn("part", F.pmod("deal", "parts"))

    def index(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tree = build(numbers(rows["id"]), quantised(rows["vector"], dim, scale), keep)
        root = freeze(centre=tree["centre"][0], radius=tree["radius"][0], most=np.abs(tree["points"].astype(np.float64)).max(initial=0))
        return pd.DataFrame({"shard": [f"{key[0]}-{key[1]}"], "tree": [freeze(**tree)], "root": [root]})

    def gather(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [key[0]], "asked": [freeze(ids=rows["id"].to_numpy(np.int64), points=quantised(rows["vector"], dim, scale))]})

    trees = materialize(dealt.groupBy("cell", "part").applyInPandas(index, "shard string, tree binary, root binary"), "trees")
    chosen = valid.filter(F.col("id") % every == 0).withColumn("block", F.pmod(F.xxhash64("deal", F.lit(1)), F.lit(blocks)).cast("int"))
    asked_blocks = materialize(chosen.groupBy("block").applyInPandas(gather, "block int, asked binary"), "query-blocks")
    groups = math.ceil(trees.count() / ROOTS)

    def together(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("shard")
        held = [thaw(x) for x in rows["root"]]
        balls = freeze(shard=rows["shard"].to_numpy(str), **{c: np.array([h[c] for h in held]) for c in ("centre", "radius", "most")})
        return pd.DataFrame({"roots": [key[0]], "balls": [balls]})

    rooted = trees.select("shard", "root", F.pmod(F.xxhash64("shard"), F.lit(groups)).cast("int").alias("roots"))
    balls = materialize(rooted.groupBy("roots").applyInPandas(together, "roots int, balls binary"), "roots")

    def known(found, size: int) -> np.ndarray:
        floor = np.full(size, np.iinfo(np.int64).min)
        if found is None:
            return floor
        held = thaw(found)
        return kth(held["query"], held["score"], size, keep, floor)

    def chooser(first: bool):
        def choose(frames):
            for frame in frames:
                for row in frame.itertuples(index=False):
                    held, points = thaw(row.balls), thaw(row.asked)["points"]
                    bound = bounds(points, held["centre"], held["radius"], held["most"].max(initial=0))
                    leads = np.bincount(bound.argmax(axis=1), minlength=bound.shape[1])
                    early = np.zeros(bound.shape[1], bool)
                    early[np.lexsort((-bound.max(axis=0), -leads))[: 1 + math.isqrt(bound.shape[1])]] = True
                    used = early if first else ~early & (bound >= known(row.found, len(points))[:, None]).any(axis=0)
                    yield pd.DataFrame({"block": np.full(used.sum(), row.block, np.int32), "shard": held["shard"][used].astype(object)})

        return choose

    def meet(frames):
        for frame in frames:
            for row in frame.itertuples(index=False):
                points = thaw(row.asked)["points"]
                (query, ids, scores), _ = search(thaw(row.tree), points, known(row.found, len(points)), keep)
                yield pd.DataFrame({"block": [row.block], "found": [freeze(query=query, id=ids, score=scores)]})

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        held = [thaw(x) for x in rows["found"]]
        query, ids, scores = best(*(np.concatenate([h[c] for h in held]) for c in ("query", "id", "score")), keep)
        return pd.DataFrame({"block": [key[0]], "found": [freeze(query=query, id=ids, score=scores)]})

    found = None
    for first in (True, False):
        seen = asked_blocks.withColumn("found", F.lit(None).cast("binary")) if found is None else asked_blocks.join(found, "block", "left")
        met = seen.withColumn("roots", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).join(balls, "roots")
        pairs = materialize(met.select("block", "asked", "found", "balls").mapInPandas(chooser(first), "block int, shard string"), "pairs")
        rows = pairs.join(trees.select("shard", "tree"), "shard").join(seen, "block").select("block", "tree", "asked", "found")
        made = rows.mapInPandas(meet, "block int, found binary")
        made = made if found is None else made.unionByName(found)
        found = materialize(made.groupBy("block").applyInPandas(merge, "block int, found binary"), "found")

    def rows_of(frames):
        for frame in frames:
            for row in frame.itertuples(index=False):
                asked, held = thaw(row.asked), thaw(row.found)
                query, ids, scores = held["query"], held["id"], held["score"]
                itself = np.concatenate([products(p[None], p[None])[0] for p in asked["points"]])
                own = np.flatnonzero((asked["ids"][query] == ids) & (itself[query] == scores))
                others = np.ones(len(query), bool)
                others[own[np.unique(query[own], return_index=True)[1]]] = False  # one row of that id and score: equal rows are alike
                query, ids, scores = best(query[others], ids[others], scores[others], k)
                if (np.abs(scores) >= MOST).any():
                    raise OverflowError("a score is no long")
                counts = np.bincount(query, minlength=len(asked["ids"]))
                rank = np.arange(len(query)) - np.repeat(np.cumsum(counts) - counts, counts) + 1
                yield pd.DataFrame({"query_id": asked["ids"][query], "rank": rank.astype(np.int32), "vec_id": pd.Series(ids, dtype="Int64").mask(ids == NO_ID) if row.nulls else ids, "score": scores})

    with_nulls = valid.filter("id is null").limit(1).count() > 0
    final = asked_blocks.join(found, "block").select("asked", "found", F.lit(with_nulls).alias("nulls"))
    return final.mapInPandas(rows_of, "query_id long, rank int, vec_id long, score long")
