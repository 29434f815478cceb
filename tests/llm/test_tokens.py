import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from adjudica.llm import packing, token_files, units
from adjudica.llm.wavelet import WaveletMatrix, build

ENCODER = units.UnitEncoder(units.vocabulary_path(), most=50)
ODD = ["", None, "it's I'll 'sun ''s don't ...'s 12.5%", "a<|endoftext|>b", "x\x1cy z w", "é Å İ ß ΣΣ", "\n\n  a \t", "漢字 かな 한국어 и Й", "long " * 5000]
SCHEMA = "doc_id long, text string, length string, part string"


def whole(text):
    return ENCODER.tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40), st.text(alphabet="ab'st.,1 \nÉéß", max_size=60)), min_size=1, max_size=8))
def test_units_encode_like_the_whole_text(texts):
    ids, offsets = ENCODER.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [whole(t) for t in texts]


def test_forgetting_keeps_results():
    small = units.UnitEncoder(units.vocabulary_path(), most=10)
    for i in range(20):
        texts = [f"common words again w{i}x thing{i} {j}" for j in range(5)]
        ids, offsets = small.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [whole(t) for t in texts]


def rows_for(n=300):
    base = [(i, f"Document {i % 17} says: " + "words and more, " * (i % 40)) for i in range(n)]
    return [(i, t, "x", None) for i, t in base] + [(1000 + i, t, None, None) for i, t in enumerate(ODD)] + [(None, "no id", None, None), (5, "again the id", None, None), (5, "again the id", None, None)]


def test_packing_against_whole_ids(spark):
    rows = rows_for()
    got = packing.pack(spark.createDataFrame(rows, SCHEMA), window=256).collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc_id in {r[0] for r in rows}:
        texts = [t for d, t, *_ in rows if d == doc_id]
        want = sorted((start, len(c), zlib.crc32(c), len(ids)) for t in texts for ids in [np.array([*whole(t), 1], "<u4")] for start in range(0, len(ids), 256) for c in [ids[start : start + 256]])
        assert sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in by_doc[doc_id]) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 256
    total = sum(r.length for r in got)
    assert len(sequences) <= -(-total // 256) + 2


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 9), max_size=12), st.integers(1, 60))
def test_closest_is_the_best_multiset(counts, capacity):
    sums = {0}
    for length, n in counts.items():
        sums = {s + length * k for s in sums for k in range(n + 1) if s + length * k <= capacity}
    chosen = packing.closest(counts, capacity)
    assert sum(k * n for k, n in chosen.items()) == max(sums)
    assert all(n <= counts[k] for k, n in chosen.items())


def test_plan_uses_each_piece_once():
    counts = {k: (k * 7919) % 13 for k in range(1, 2049)}
    windows = packing.plan(counts)
    used = {}
    for chosen, times in windows:
        assert sum(k * n for k, n in chosen.items()) <= 2048
        for k, n in chosen.items():
            used[k] = used.get(k, 0) + n * times
    assert used == {k: n for k, n in counts.items() if n}
    total, made = sum(k * n for k, n in counts.items()), sum(t for _, t in windows)
    assert made <= 1.002 * total / 2048 + 2


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=200), st.sampled_from([8, 64, 1 << 16]))
def test_wavelet_matrix_against_lists(values, block_bits):
    ids = np.array(values, np.uint32)
    matrix = WaveletMatrix(build(ids, [1, None], np.array([len(ids) // 2, len(ids)]), 7, block_bits))
    assert matrix.decode().tolist() == values and matrix.doc_ids == [1, None] and matrix.before == 7
    assert [matrix.access(i) for i in range(len(values))] == values
    for token in {*values[:5], 0, 299, 70000}:
        where = [i for i, v in enumerate(values) if v == token]
        assert list(matrix.locate(token)) == where and matrix.count(token) == len(where)
        assert matrix.select(token, len(where)) == -1
        assert matrix.rank(token, len(values) // 2) == sum(i < len(values) // 2 for i in where)
        assert matrix.count(token, 3, 50) == sum(3 <= i < 50 for i in where)


def test_damage_is_seen():
    file = bytearray(build(np.arange(50, dtype=np.uint32), [0], np.array([50])))
    file[-1] ^= 1
    with pytest.raises(ValueError):
        WaveletMatrix(bytes(file))


def test_token_files_round_trip(spark):
    rows = rows_for()
    got = token_files.token_files(spark.createDataFrame(rows, SCHEMA), shard_tokens=3000).collect()
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d))
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    want = sorted((d, len(t) + 1, zlib.crc32(np.array([*t, 2], "<u4"))) for d, t in ((r[0] or -1, whole(r[1])) for r in rows))
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in got) == want


def test_many_ranges_and_an_id_that_fills_several(spark):
    """A third of all rows have one id and text; ids at the ends of what a long holds; null ids first."""
    rows = [(i * 3 - 300, f"text number {i}", "x", "y") for i in range(200)] + [(7, "the same text each time", "x", "y")] * 110
    rows += [(None, "no id", "x", "y")] * 150 + [(2**63 - 1, "last", "x", "y"), (-(2**63), "first", "x", "y"), (7, "other", "x", "y")]
    df = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string").repartition(5)
    folder, manifest = token_files.write_token_files(df, range_bytes=300, shard_tokens=50)
    parts = {r.part: r.n_docs for r in manifest.groupBy("part").agg({"n_docs": "sum"}).toDF("part", "n_docs").collect()}
    assert len(parts) > 10 and max(parts.values()) < 80
    got = sorted(token_files.read_token_files(folder, manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d))
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
    want = sorted((str(d), zlib.crc32(np.array([*whole(t), 2], "<u4"))) for d, t, *_ in rows)
    assert sorted((str(r.doc_id), r.ids_crc32) for r in got) == want


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert packing.pack(empty).collect() == [] and token_files.token_files(empty).collect() == []
