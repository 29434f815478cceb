"""Token-ID output: tokenized documents in ascending id order as wavelet-matrix files in the shared folder.

Documents are dealt to ranges of ids, as many as the size of their texts asks for. The borders are quantiles of the ids
alone, so no text is read for them; each text is encoded where it is, and only its ids are shuffled, 16 bits each where
all of a batch's fit. A range is sorted by Spark, and its task writes files of about ``shard_tokens`` ids under
deterministic names: written under a name of the attempt's own, then renamed, so a task that runs again after a lost
executor leaves the same files. Only the borders and the token count of each range (``MOST_RANGES`` of each at most) are
on the driver, the counts to place ranges after one another.

Null ids come first; rows with equal ids are kept each, in the order of a hash of their place in the input, by which
any number of them spreads evenly over the ranges that their id fills. A null or empty text has the end id alone. An
empty table gives no files and no rows. Other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from adjudica.llm import units
from adjudica.llm.common import fresh_folder, materialize
from adjudica.llm.wavelet import WaveletMatrix, build

END = 2
NO_ID = -(2**63)  # where a null id stands among the borders; the ids begin after it
SHARD_TOKENS = 1 << 20
RANGE_BYTES, MOST_RANGES = 1 << 24, 20_000
MANIFEST = "part int, shard int, n_docs long, n_tokens long, n_bytes long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def put_file(folder: str, name: str, content: bytes) -> None:
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    own = f"{root}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(own) as out:
        out.write(content)
    store.move(own, f"{root}/{name}")


def ranges_of(names: pa.Array, tie: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """The range of each id, null first. An id that fills several ranges has its rows dealt to them in order of tie."""
    known = np.where(names.is_null().to_numpy(zero_copy_only=False), NO_ID, np.maximum(pc.fill_null(names, NO_ID).to_numpy(zero_copy_only=False), NO_ID + 1))
    low, high = np.searchsorted(borders, known, side="left"), np.searchsorted(borders, known, side="right")
    share = (tie.astype(np.float64) + 2.0**63) / 2.0**64  # rises with the tie
    return np.minimum(high, low + np.floor(share * (high - low + 1)).astype(np.int64)).astype(np.int32)


def encoding(path: str, end: int, borders: np.ndarray):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in units.slices(batch.column(1)):
                own = batch.slice(at, n)
                ids, offsets = units.encoder(path).encode(own.column(1))
                ids = np.insert(ids, offsets[1:], end)
                ids = ids.astype("<u2" if ids.max(initial=0) < 1 << 16 else "<u4")
                ends = offsets + np.arange(n + 1)
                held = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends * ids.itemsize), pa.py_buffer(ids)])
                part = ranges_of(own.column(0), own.column(2).to_numpy(), borders)
                yield pa.RecordBatch.from_arrays([pa.array(part), own.column(0), own.column(2), pa.array(np.diff(ends)), held.cast(pa.binary())], ["part", "doc_id", "tie", "n", "ids"])

    return encode


def writer(folder: str, shard_tokens: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, before, made = 0, 0, 0, []
        held, docs, sizes, total = [], [], [], 0

        def close() -> None:
            nonlocal held, docs, sizes, total, shard, before
            content = build(np.concatenate(held), docs, np.cumsum(sizes), before)
            put_file(folder, f"part-{part:06d}-{shard:06d}.wvm", content)
            made.append((part, shard, len(docs), total, len(content)))
            held, docs, sizes, total, shard, before = [], [], [], 0, shard + 1, before + total

        for batch in batches:
            part = part if docs or made or not batch.num_rows else batch.column(0)[0].as_py()
            names, counts = batch.column(1).to_pylist(), batch.column(2).to_numpy()
            each = [np.frombuffer(raw.as_buffer(), "<u2" if raw.as_buffer().size == 2 * n else "<u4") for raw, n in zip(batch.column(3), counts.tolist(), strict=True)]
            first, n, ends = 0, len(names), np.append(np.cumsum(counts), 0)
            while first < n:
                begin = ends[first - 1]
                last = max(first + 1, int(np.searchsorted(ends[:n], begin + shard_tokens - total, side="right")))
                held += [x.astype(np.uint32) for x in each[first:last]]
                docs += names[first:last]
                sizes += counts[first:last].tolist()
                total += int(ends[last - 1] - begin)
                first = last
                if total >= shard_tokens or first < n:
                    close()
        if docs:
            close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.int32(), pa.int32(), *[pa.int64()] * 3), strict=True)], ["part", "shard", "n_docs", "n_tokens", "n_bytes"])

    return write


def write_token_files(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end: int = END, shard_tokens: int = SHARD_TOKENS, range_bytes: int = RANGE_BYTES) -> tuple[str, DataFrame]:
    """The folder of the files, and their manifest: one row per file."""
    spark = df.sparkSession
    folder = fresh_folder(spark, "token-files")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(hadoop)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = int(min(MOST_RANGES, 1 + size // range_bytes))
    steps = [k / ranges for k in range(1, ranges)]
    place = F.when(F.col("doc_id").isNull(), F.lit(NO_ID)).otherwise(F.greatest("doc_id", F.lit(NO_ID + 1)))
    borders = docs.agg(F.percentile_approx(place, steps, 10 * ranges)).first()[0] if steps else None
    borders = np.array(borders or [], np.int64)
    tied = docs.withColumn("tie", F.xxhash64(F.monotonically_increasing_id()))
    encoded = tied.mapInArrow(encoding(path or units.vocabulary_path(), end, borders), "part int, doc_id long, tie long, n long, ids binary")
    dealt = encoded.repartitionById(ranges, "part").sortWithinPartitions("part", "doc_id", "tie").select("part", "doc_id", "n", "ids")
    made = dealt.mapInArrow(writer(folder, shard_tokens), MANIFEST)
    return folder, materialize(made, "token-manifest")


def read_token_files(folder: str, manifest: DataFrame) -> DataFrame:
    """Per document, from the files alone: its id, the ids of all documents before it, its own ids and their crc32."""
    spark = manifest.sparkSession
    sums = {r.part: r.n for r in manifest.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}  # one row a range
    base, total = {}, 0
    for part in sorted(sums):
        base[part], total = total, total + sums[part]
    if not sums:
        return spark.createDataFrame([], READ)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wvm").load(folder)
    named = files.select(F.regexp_extract("path", r"part-(\d+)-\d+\.wvm$", 1).cast("int").alias("part"), "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                matrix = WaveletMatrix(content.as_py())
                ids, ends = matrix.decode().astype("<u4"), matrix.ends
                begins = np.concatenate([[0], ends[:-1]])
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(matrix.doc_ids, pa.int64()), pa.array(begins + matrix.before + base[part]), pa.array(ends - begins), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return named.mapInArrow(read, READ)


def token_files(df: DataFrame, **options) -> DataFrame:
    folder, manifest = write_token_files(df, **options)
    return read_token_files(folder, manifest)
