import hashlib
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import matroska as M


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=5000))
def test_round_trip(raw):
    payload = M.pad(raw)
    assert len(payload) > 0 and len(payload) % 64 == 0
    parsed = M.demux(M.mux(payload))
    assert M.payload_of(M.mux(payload), parsed) == payload
    assert [p[1] for p in parsed.packets] == [i * 8 for i in range(len(payload) // 64)]


def test_long_payload_has_clusters_and_exact_cues():
    payload = bytes(range(256)) * 4096
    data = M.mux(payload)
    parsed = M.demux(data)
    assert len(parsed.clusters) == 4 and len(parsed.cues) == 4 and M.payload_of(data, parsed) == payload
    assert [c[0] for c in parsed.cues] == [c[0] for c in parsed.clusters] and [c[2] for c in parsed.cues] == [c[1] for c in parsed.clusters]
    assert parsed.tracks[1][:4] == (2, "A_PCM/INT/LIT", 8000.0, 8) and parsed.doctype == "matroska"


def _file(*blocks, cluster_size=True):
    body = M.uint(M.TIMESTAMP, 100) + b"".join(blocks)
    head = M.CLUSTER.to_bytes(4, "big")
    cluster = head + (M.vint(len(body)) if cluster_size else b"\x01" + b"\xff" * 7) + body
    return M._HEADER + M.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + M._TRACKS + M.element(0xEC, b"void") + cluster


def test_xiph_and_ebml_lacing_groups_and_unknown_sizes():
    frames = [b"a" * 300, b"b" * 5, b"c" * 700, b"d" * 2]
    xiph = b"\x81" + struct.pack(">hB", 3, 0x02) + bytes([3, 255, 45, 5, 255, 255, 190]) + b"".join(frames)
    signed = lambda d: M.vint(d + 8191, 2)
    ebml = b"\x81" + struct.pack(">hB", -4, 0x06) + bytes([3]) + M.vint(300) + signed(-295) + signed(695) + b"".join(frames)
    data = _file(M.element(M.SIMPLE, xiph), M.element(M.GROUP, M.element(M.BLOCK, ebml)), cluster_size=False)
    packets = M.demux(data).packets
    assert [data[o : o + n] for _, _, o, n, _ in packets] == frames * 2
    assert packets[0][1] == 103 and packets[4][1] == 96


@pytest.mark.parametrize("cut", [1, 5, 40, 200])
def test_broken_files_raise(cut):
    data = M.mux(M.pad(b"x" * 1000))
    with pytest.raises(ValueError):
        M.demux(data[:-cut])


def test_query_shape(spark):
    rows = [(1, "héllo"), (2, None), (3, "x" * 64), (None, "y" * 70000), (1, "héllo")]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, feature string")
    got = M.media_digests(M.to_media(docs)).collect()
    assert len(got) == 5
    for r in got:
        raw = next((t or "").encode() for i, t in rows if i == r.doc_id)
        payload = M.pad(raw)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(M.mux(payload)), hashlib.sha256(M.mux(payload)).hexdigest())
    table = M.packet_table(M.to_media(docs))
    assert table.filter("doc_id = 3").select("timestamp", "size").collect() == [(0, 64)]
    assert M.media_digests(M.to_media(docs.limit(0))).count() == 0
