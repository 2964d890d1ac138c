import hashlib
import random
import zlib

import pytest

from tessera.llm import matroska as mk


def block(lacing, frames, ticks=0, track=1, key=True):
    flags = (0x80 if key else 0) | lacing << 1
    head = bytes([0x80 | track]) + ticks.to_bytes(2, "big", signed=True) + bytes([flags])
    if lacing == 0:
        return head + frames[0]
    head += bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if lacing == 1:
        for s in sizes[:-1]:
            head += b"\xff" * (s // 255) + bytes([s % 255])
    if lacing == 3:
        head += mk.size_field(sizes[0])
        for a, b in zip(sizes[:-1], sizes[1:-1], strict=False):
            d = b - a
            width = 1
            while not -((1 << (7 * width - 1)) - 1) <= d <= (1 << (7 * width - 1)) - 1:
                width += 1
            head += ((d + (1 << (7 * width - 1)) - 1) | 1 << (7 * width)).to_bytes(width, "big")
    return head + b"".join(frames)


@pytest.mark.parametrize("lacing", [0, 1, 2, 3])
@pytest.mark.parametrize("simple", [True, False])
@pytest.mark.parametrize("unknown", [True, False])
def test_lacings(lacing, simple, unknown):
    rng = random.Random(lacing)
    sizes = [7] if lacing == 0 else [40] * 5 if lacing == 2 else [300, 2, 255, 0, 9000, 254, 256]
    frames = [rng.randbytes(s) for s in sizes]
    b = block(lacing, frames, ticks=-2, key=False)
    b = mk.element(mk.SIMPLE_BLOCK, b) if simple else mk.element(mk.BLOCK_GROUP, mk.element(mk.BLOCK, b) + mk.uint(mk.BLOCK_DURATION, 3))
    body = mk.uint(mk.TIMESTAMP, 1000) + mk.element(0xEC, b"void") + b
    cluster = mk.element_id(mk.CLUSTER) + b"\x01" + b"\xff" * 7 + body if unknown else mk.element(mk.CLUSTER, body)
    info = mk.element(mk.INFO, mk.uint(mk.TIMESTAMP_SCALE, 1_000_000))
    segment = info + cluster * 2
    data = mk.element(mk.EBML, mk.element(mk.DOC_TYPE, b"webm")) + (mk.element_id(mk.SEGMENT) + b"\xff" + segment if unknown else mk.element(mk.SEGMENT, segment))
    m = mk.parse(data)
    assert m.error is None and m.clusters == 2 and m.doc_type == "webm"
    assert [data[p[2] : p[2] + p[3]] for p in m.packets] == frames * 2
    assert m.packets[0][:2] == (1, 998_000_000) and m.packets[0][4] is not simple and m.packets[0][5] == lacing


def test_round_trip_and_cues():
    for n in (1, 575, 576, 577, 576 * 64, 576 * 65, 576 * 64 * 16 + 5, 576 * 64 * 40):
        payload = random.Random(n).randbytes(n)
        data = mk.write(payload)
        m = mk.parse(data)
        assert m.error is None and mk.read_back(data, m) == payload
        assert m.tracks[0]["codec"] == "A_PCM/INT/LIT" and m.tracks[0]["bits"] == 8
        assert len(m.cues) == m.clusters and all(data[c[2] : c[2] + 4] == mk.element_id(mk.CLUSTER) for c in m.cues)
        assert [p[1] // m.scale for p in m.packets] == list(range(len(m.packets)))


def test_broken_files_do_not_crash():
    data = mk.write(random.Random(1).randbytes(576 * 70))
    whole = mk.parse(data).packets
    rng = random.Random(2)
    for cut in [0, 1, 5, 40, *range(60, len(data), 997)]:
        m = mk.parse(data[:cut])
        assert m.packets == whole[: len(m.packets)]
    for _ in range(300):
        broken = bytearray(data[: rng.randint(1, 400)])
        for _ in range(4):
            broken[rng.randrange(len(broken))] = rng.randrange(256)
        mk.parse(bytes(broken))
    assert mk.parse(None).packets == [] and mk.parse(b"").error is None


def test_deep_nesting_and_cyclic_sizes():
    for id_ in (mk.SEGMENT, mk.CLUSTER, mk.BLOCK_GROUP, mk.TRACKS, mk.CUES):
        data = b""
        for _ in range(5000):
            data = mk.element(id_, data)
        assert mk.parse(data).packets == []
        assert mk.parse((mk.element_id(id_) + b"\x01" + b"\xff" * 7) * 5000).packets == []
    inner = mk.write(b"x" * 576)
    assert len(mk.parse(mk.element(mk.SEGMENT, inner) + inner).packets) == 1  # a segment within a segment is skipped


def test_cues_lead_to_clusters():
    payload = random.Random(4).randbytes(576 * mk.LACE * mk.BLOCKS * 3 + 100)
    data = mk.write(payload)
    m = mk.parse(data)
    for ns in (0, m.cues[1][0] - 1, m.cues[1][0], m.cues[2][0] + 5, 10**15):
        k = max(i for i, c in enumerate(m.cues) if c[0] <= ns)
        # a cluster's packets but for their cluster number
        assert [p[:6] for p in mk.seek(data, m, ns)] == [p[:6] for p in m.packets if p[6] == k]
    assert mk.seek(data, m, -1) == m.packets and mk.seek(data, m, 0, track=7) == m.packets


def test_rows(spark):
    rows = [(1, "abc"), (1, "abc"), (2, None), (3, ""), (None, "é" * 288), (5, "x" * 2_000_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS media", "2 AS feature")
    out = mk.store_texts(docs).collect()
    for r, (d, t) in zip(sorted(out, key=lambda r: str(r.doc_id)), sorted(rows, key=lambda x: str(x[0])), strict=True):
        raw = (t or "").encode()
        p = raw + b"\xff" * (576 - len(raw) % 576 if len(raw) % 576 or not raw else 0)
        assert (r.doc_id, r.n_bytes, r.payload_bytes) == (d, len(raw), len(p))
        assert r.payload_sha256 == hashlib.sha256(p).hexdigest() and r.tail_crc32 == zlib.crc32(p[-32:])
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest()
    a, b = [r for r in out if r.doc_id == 1]
    assert a == b
    table = mk.parse_media(spark.createDataFrame([r for r in out if r.doc_id == 1], out[0].__fields__ and mk.T.StructType([*mk.STORED.fields, mk.T.StructField("media", mk.T.BinaryType())])))
    assert [(len(r.packets), len(r.cues)) for r in table.collect()] == [(1, 1), (1, 1)]
    assert mk.store_texts(docs.limit(0)).count() == 0
    nulls = mk.parse_media(spark.createDataFrame([(1, None), (2, bytearray(b""))], "doc_id long, media binary")).collect()
    assert [(r.packets, r.error) for r in nulls] == [([], None)] * 2
