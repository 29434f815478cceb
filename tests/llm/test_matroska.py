import hashlib
import struct
import zlib

import pytest
from hypothesis import given, settings, strategies as st

from adjudica.llm import matroska as M


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=20_000), st.integers(1, 40))
def test_round_trip(raw, times):
    payload = raw * times
    payload += bytes(-len(payload) % 64)
    media = M.parse(file := M.mux(payload))
    assert b"".join(file[o : o + n] for _, _, o, n, *_ in media.packets) == payload
    assert [p[1] for p in media.packets] == [i * 128_000_000 for i in range(len(media.packets))]
    assert [c[2] for c in media.cues] == media.clusters and len(media.clusters) == -(-len(payload) // M.CLUSTER)


def test_all_lacings_and_unknown_sizes():
    frames = [b"a" * 300, b"bb", b"c" * 255, b"d" * 9]
    xiph = b"".join(bytes([255] * (len(f) // 255) + [len(f) % 255]) for f in frames[:-1])
    head = M.vint(1) + struct.pack(">h", 5)
    blocks = [
        M.element(M.SIMPLE_BLOCK, head, b"\x82", bytes([3]), xiph, *frames),
        M.lace(frames, 7),
        M.lace([b"x" * 10] * 3, 9),
        M.lace([b"alone"], 11),
        M.element(M.BLOCK_GROUP, M.element(M.BLOCK, head, b"\x00", b"group"), M.unsigned(M.BLOCK_DURATION, 4), M.element(M.REFERENCE, b"\xff")),
        M.element(0xEC, bytes(30)),
    ]
    open_cluster = M.id_bytes(M.CLUSTER_ID) + b"\x01" + b"\xff" * 7 + M.unsigned(M.TIMESTAMP, 1000) + b"".join(blocks)
    file = M.HEAD + M.id_bytes(M.SEGMENT) + b"\xff" + M.ABOUT + open_cluster + M.element(M.CLUSTER_ID, M.unsigned(M.TIMESTAMP, 2000), M.lace([b"last"], -3))
    media = M.parse(file)
    found = [file[o : o + n] for _, _, o, n, *_ in media.packets]
    assert found == [*frames, *frames, *[b"x" * 10] * 3, b"alone", b"group", b"last"]
    assert len(media.clusters) == 2 and media.blocks == 6 and media.laced == 3
    assert [p[1] // 1_000_000 for p in media.packets][-3:] == [1011, 1005, 1997]
    assert [p[4] for p in media.packets][-2:] == [False, True]
    assert [p[6] for p in media.packets][:4] == [0, 1, 2, 3]


@pytest.mark.parametrize("cut", [3, 60, 150, 1000, -1])
def test_damaged_files(cut):
    with pytest.raises(ValueError):
        M.parse(M.mux(bytes(4096))[:cut])
    with pytest.raises(ValueError):
        M.parse(b"RIFF" + bytes(100))


def test_sizes_of_any_length():
    for n in (0, 1, 126, 127, 128, 16382, 16383, 2097150, 2097151):
        value, after, unknown = M.read_vint(M.vint(n), 0, 8)
        assert (value, after, unknown) == (n, len(M.vint(n)), False)


def test_operator(spark):
    texts = ["", None, "x", "é" * 32, "z" * 64, "y" * 65, "long text " * 30_000, "same", "same"]
    rows = [(i, t, "clash", i) for i, t in enumerate(texts)] + [(None, "no id", None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, media string, n_bytes int")
    got = {r.doc_id: r for r in M.read_media(M.store_media(df)).collect()}
    assert len(got) == len(rows)
    for doc_id, text, *_ in rows:
        raw = (text or "").encode()
        payload = raw + bytes((-len(raw) % 64) if raw else 64)
        r = got[doc_id]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        file = M.mux(payload)
        assert (r.media_bytes, r.media_sha256) == (len(file), hashlib.sha256(file).hexdigest())
    assert got[7][3:] == got[8][3:] and got[0][2:] == got[1][2:]
    packets = M.packet_table(M.store_media(df)).groupBy("doc_id").sum("size").collect()
    assert {r[0]: r[1] for r in packets} == {k: r.payload_bytes for k, r in got.items()}
    empty = spark.createDataFrame([], df.schema)
    assert M.read_media(M.store_media(empty)).collect() == []
