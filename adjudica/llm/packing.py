"""Packing by minimum bin slack: fixed windows of ids with as little padding as a subset-sum search finds.

A document's ids are cut into full windows and one remainder. How many pieces there are of each length is all that
the search needs (at most ``window`` numbers), so it runs on the driver at any size of corpus: again and again a
bitset dynamic programme finds the multiset of remaining lengths that fills a window closest to its capacity,
always with the largest remaining length in it, and the multiset is used as often as its lengths last. Pieces then
find their window from their rank among the pieces of their length. Ranks are counted in buckets that pieces are dealt
to by turns, as many as their number asks for, so that a length, an id or a text that a third of all pieces share is
spread over many tasks.

Null or empty texts are documents of the end id alone. Equal rows are packed each; a null doc_id is an id like any
other. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from adjudica.llm import units
from adjudica.llm.common import give_back, materialize

WINDOW = 2048
END = 1
BUCKETS, BUCKET_PIECES = 512, 1_000_000  # at least so many buckets, and more where they would hold more pieces
PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, deal long"


def cutter(path: str, window: int, end: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            for at, n in units.slices(batch.column(1)):
                ids, offsets = units.encoder(path).encode(batch.column(1).slice(at, n))
                ids = np.insert(ids, offsets[1:], end).astype("<u4")
                begins = offsets + np.arange(n + 1)
                sizes = np.diff(begins)
                counts = -(-sizes // window)
                doc = np.repeat(np.arange(n), counts)
                start = (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)) * window
                length = np.minimum(window, sizes[doc] - start)
                first = begins[doc] + start
                crc = [zlib.crc32(ids[a : a + m]) for a, m in zip(first.tolist(), length.tolist(), strict=True)]
                names = batch.column(0).slice(at, n).take(pa.array(doc))
                deal = pa.array(seen + np.arange(len(start)) + TaskContext.get().partitionId() * 7919)
                seen += len(start)
                yield pa.RecordBatch.from_arrays([names, pa.array(start), pa.array(length, pa.int32()), pa.array(crc, pa.int64()), pa.array(sizes[doc]), deal], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "deal"])
            give_back()

    return cut


def closest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths, no more of each than ``counts`` has, whose sum comes closest to ``capacity`` from
    below, and how many of each. Bit s of a step's bitset says that the lengths so far can sum to s."""
    full, reach, steps = (1 << capacity + 1) - 1, 1, []
    for length in sorted((x for x in counts if x <= capacity and counts[x]), reverse=True):
        left, times = min(counts[length], capacity // length), 1
        while left:
            times = min(times, left)
            steps.append((length, times, reach))
            reach |= reach << length * times & full
            left, times = left - times, times * 2
        if reach >> capacity:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, times, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + times
            total -= length * times
    return chosen


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[dict[int, int], int]]:
    """(lengths of a window, number of such windows); each use exhausts a length, so there are at most ``window``."""
    left, out = {k: n for k, n in counts.items() if n}, []
    while left:
        largest = max(left)
        left[largest] -= 1
        chosen = closest(left, window - largest)
        left[largest] += 1
        chosen[largest] = chosen.get(largest, 0) + 1
        times = min(left[k] // n for k, n in chosen.items())
        out.append((chosen, times))
        left = {k: m for k, n in left.items() if (m := n - times * chosen.get(k, 0))}
    return out


def places(windows: list[tuple[dict[int, int], int]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length, in order of rank: (first rank, first sequence, pieces a window, offset of the first)."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for chosen, times in windows:
        offset = 0
        for length in sorted(chosen, reverse=True):
            out.setdefault(length, []).append((used.get(length, 0), sequence, chosen[length], offset))
            used[length] = used.get(length, 0) + chosen[length] * times
            offset += chosen[length] * length
        sequence += times
    return out


def placer(found: dict[int, list[tuple[int, int, int, int]]]):
    tables = {k: np.array(v, np.int64) for k, v in found.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if not len(rows):
                    continue
                size = int(length[rows[0]])
                t = tables[size]
                t = t[np.searchsorted(t[:, 0], rank[rows], side="right") - 1]
                window, slot = np.divmod(rank[rows] - t[:, 0], t[:, 2])
                sequence[rows], offset[rows] = t[:, 1] + window, t[:, 3] + slot * size
            keep = [batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            keep[2] = keep[2].cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return place


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, window: int = WINDOW, end: int = END) -> DataFrame:
    """One row per piece: where it stands in its document and in its sequence."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cut = docs.mapInArrow(cutter(path or units.vocabulary_path(), window, end), PIECES)
    pieces = materialize(cut, "pieces")
    buckets = max(BUCKETS, pieces.count() // BUCKET_PIECES)
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("deal"), F.lit(buckets)).cast("int"))
    tally = materialize(pieces.groupBy("length", "bucket").agg(F.count("*").alias("n")), "piece-counts")  # window x buckets rows at most
    counts = {r.length: r.n for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # window rows at most
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = tally.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32", "deal")
    ranked = pieces.withColumn("nth", F.row_number().over(own)).join(bases, ["length", "bucket"])
    rows = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("nth") - 1).alias("rank"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return rows.mapInArrow(placer(places(plan(counts, window))), schema)
