"""Matroska media columns: write and parse EBML elements, clusters, lacing and cues.

`parse` reads the variable-length EBML elements of a file held in a binary column and gives a packet
table: track, timestamp, byte range, key flag, lacing. It reads SimpleBlocks and BlockGroups, all four
lacings (none, Xiph, fixed-size, EBML), elements of unknown size, cues and codec settings; elements it
does not know are skipped by their size. `write` stores bytes as one track of 8-bit mono PCM, a frame
of 576 samples a packet, laced by fixed size, in clusters with cues.

Defined results: null and empty input to `parse_media` give no packets and no error; a file that ends
within an element, or whose sizes lead out of their parent, gives the packets before that place and the
error's text in `error`; elements at a level they don't belong to are skipped, so nesting is never deep; repeated rows are parsed once for each row.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.kernel import small_batches

# Element ids of the format.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
DOC_TYPE, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x4282, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, AUDIO = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1
SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: The element that each element with children stands in; 0 is the file. Elsewhere it is skipped like an unknown one.
PARENT = {EBML: 0, SEGMENT: 0, INFO: SEGMENT, TRACKS: SEGMENT, CLUSTER: SEGMENT, CUES: SEGMENT}
TOP_LEVEL = {INFO, TRACKS, CLUSTER, CUES, SEGMENT, EBML, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}
UNKNOWN = -1

#: Samples of a frame, frames of a laced block, blocks of a cluster; samples a second.
FRAME, LACE, BLOCKS, RATE = 576, 64, 16, 48_000


def element_id(n: int) -> bytes:
    return n.to_bytes((n.bit_length() + 7) // 8, "big")


def size_field(n: int) -> bytes:
    width = 1
    while n >= (1 << (7 * width)) - 1:
        width += 1
    return (n | 1 << (7 * width)).to_bytes(width, "big")


def element(id_: int, data: bytes) -> bytes:
    return element_id(id_) + size_field(len(data)) + data


def uint(id_: int, n: int) -> bytes:
    return element(id_, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def write(payload: bytes, frame: int = FRAME) -> bytes:
    """A Matroska file whose packets, in order, are the payload's runs of `frame` bytes."""
    import struct

    frames = -(-len(payload) // frame)
    head = element(EBML, uint(0x4286, 1) + uint(0x42F7, 1) + uint(0x42F2, 4) + uint(0x42F3, 8) + element(DOC_TYPE, b"matroska") + uint(0x4287, 4) + uint(0x4285, 2))
    scale = 1_000_000_000 * frame // RATE  # a tick is a frame
    info = element(INFO, uint(TIMESTAMP_SCALE, scale) + element(DURATION, struct.pack(">d", float(frames))) + element(MUXING_APP, b"tessera") + element(WRITING_APP, b"tessera"))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", float(RATE))) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    body, cues = [info, tracks], []
    at = len(info) + len(tracks)
    for first in range(0, frames, LACE * BLOCKS):
        parts = [uint(TIMESTAMP, first)]
        for b in range(first, min(first + LACE * BLOCKS, frames), LACE):
            data = payload[b * frame : (b + LACE) * frame]
            n = -(-len(data) // frame)
            even = len(data) == n * frame
            # fixed-size lacing if all frames are alike; a short last frame stands in a block of its own
            whole = data if even else data[: (n - 1) * frame]
            if whole:
                k = len(whole) // frame
                lacing = b"" if k == 1 else bytes([k - 1])
                parts.append(element(SIMPLE_BLOCK, b"\x81" + (b - first).to_bytes(2, "big") + (b"\x80" if k == 1 else b"\x84") + lacing + whole))
            if not even:
                parts.append(element(SIMPLE_BLOCK, b"\x81" + (b - first + n - 1).to_bytes(2, "big") + b"\x80" + data[(n - 1) * frame :]))
        cluster = element(CLUSTER, b"".join(parts))
        cues.append(element(CUE_POINT, uint(CUE_TIME, first) + element(CUE_TRACK_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER_POSITION, at))))
        body.append(cluster)
        at += len(cluster)
    if cues:
        body.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(body))


@dataclass
class Media:
    doc_type: str = ""
    scale: int = 1_000_000
    duration: float = 0.0
    tracks: list[dict] = field(default_factory=list)
    packets: list[tuple] = field(default_factory=list)  # track, ns, offset, size, key, lacing, cluster
    cues: list[tuple] = field(default_factory=list)  # ns, track, file offset of the cluster
    clusters: int = 0
    error: str | None = None


class Bad(ValueError):
    pass


def _vint(data: bytes, at: int, end: int, keep: bool = False) -> tuple[int, int]:
    if at >= end:
        raise Bad(f"element header beyond its parent at {at}")
    first = data[at]
    width = 9 - first.bit_length()
    if width > 8 or at + width > end:
        raise Bad(f"bad variable-length number at {at}")
    n = int.from_bytes(data[at : at + width], "big")
    if keep:
        return n, at + width
    n &= (1 << (7 * width)) - 1
    return (UNKNOWN if n == (1 << (7 * width)) - 1 else n), at + width


def _elements(data: bytes, at: int, end: int, level: int = 0) -> Iterator[tuple[int, int, int, int]]:
    """(id, start, data start, data end) of the children in data[at:end]."""
    while at < end:
        id_, body = _vint(data, at, end, keep=True)
        size, body = _vint(data, body, end)
        if size == UNKNOWN:
            stop = end
            if id_ == CLUSTER:  # ends at the next element of the segment's level
                k = body
                while k < end:
                    child, after = _vint(data, k, end, keep=True)
                    if child in TOP_LEVEL:
                        break
                    n, after = _vint(data, after, end)
                    k = end if n == UNKNOWN else after + n
                stop = min(k, end)
        else:
            stop = body + size
        if stop > end:
            yield id_, at, body, -stop  # a sign that it is cut short
            return
        yield id_, at, body, stop
        at = stop


def _number(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def _float(data: bytes, a: int, b: int) -> float:
    import struct

    return struct.unpack(">f" if b - a == 4 else ">d", data[a:b])[0] if b - a in (4, 8) else 0.0


def laced_sizes(data: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """Frame sizes of a block body and where the first frame begins. lacing: 0 none, 1 Xiph, 2 fixed, 3 EBML."""
    if lacing == 0:
        return [end - at], at
    if at >= end:
        raise Bad(f"lacing header beyond its block at {at}")
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == 2:
        if (end - at) % n:
            raise Bad(f"frames of a fixed-size lace differ at {at}")
        return [(end - at) // n] * n, at
    for k in range(n - 1):
        if lacing == 1:
            size = 0
            while True:
                if at >= end:
                    raise Bad(f"lacing header beyond its block at {at}")
                b, at = data[at], at + 1
                size += b
                if b < 255:
                    break
        elif k == 0:
            size, at = _vint(data, at, end)
        else:
            start = at
            n_, at = _vint(data, at, end)
            width = at - start
            size = sizes[-1] + (n_ if n_ != UNKNOWN else (1 << (7 * width)) - 1) - ((1 << (7 * width - 1)) - 1)
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise Bad(f"laced frames are larger than their block at {at}")
    return sizes, at


def _block(data: bytes, a: int, b: int, base: int, out: Media, simple: bool, key: bool) -> None:
    track, at = _vint(data, a, b)
    if at + 3 > b:
        raise Bad(f"block header beyond its element at {a}")
    ticks = base + int.from_bytes(data[at : at + 2], "big", signed=True)
    flags = data[at + 2]
    lacing = (0, 1, 2, 3)[(flags >> 1) & 3]
    sizes, at = laced_sizes(data, at + 3, b, lacing)
    key = bool(flags & 0x80) if simple else key
    step = 1 if len(sizes) > 1 else 0
    for k, size in enumerate(sizes):
        out.packets.append((track, (ticks + k * step) * out.scale, at, size, key, lacing, out.clusters - 1))
        at += size


def _walk(data: bytes, at: int, end: int, out: Media, state: dict, parent: int = 0) -> None:
    for id_, start, a, b in _elements(data, at, end):
        cut = b < 0
        b = min(-b, end) if cut else b
        if PARENT.get(id_) == parent and id_ in PARENT:  # at most three levels deep
            if id_ == SEGMENT:
                state["segment"] = a
            elif id_ == CLUSTER:
                out.clusters += 1
                state["time"] = 0
            _walk(data, a, b, out, state, id_)
        elif cut or id_ in PARENT:
            pass
        elif id_ == DOC_TYPE:
            out.doc_type = data[a:b].decode("ascii", "replace")
        elif id_ == TIMESTAMP_SCALE:
            out.scale = _number(data, a, b)
        elif id_ == DURATION:
            out.duration = _float(data, a, b)
        elif id_ == TIMESTAMP:
            state["time"] = _number(data, a, b)
        elif id_ == SIMPLE_BLOCK:
            _block(data, a, b, state.get("time", 0), out, True, False)
        elif id_ == BLOCK_GROUP:
            children = list(_elements(data, a, b))
            key = all(c[0] != REFERENCE_BLOCK for c in children)
            for c, _, ca, cb in children:
                if c == BLOCK and cb > 0:
                    _block(data, ca, cb, state.get("time", 0), out, False, key)
        elif id_ == TRACK_ENTRY:
            track = {"number": 0, "type": 0, "codec": "", "rate": 0.0, "channels": 1, "bits": 0}
            for c, _, ca, cb in _elements(data, a, b):
                if c == TRACK_NUMBER:
                    track["number"] = _number(data, ca, cb)
                elif c == TRACK_TYPE:
                    track["type"] = _number(data, ca, cb)
                elif c == CODEC_ID:
                    track["codec"] = data[ca:cb].decode("ascii", "replace")
                elif c == AUDIO:
                    for d, _, da, db in _elements(data, ca, cb):
                        if d == SAMPLING_FREQUENCY:
                            track["rate"] = _float(data, da, db)
                        elif d == CHANNELS:
                            track["channels"] = _number(data, da, db)
                        elif d == BIT_DEPTH:
                            track["bits"] = _number(data, da, db)
            out.tracks.append(track)
        elif id_ == CUE_POINT:
            when = 0
            for c, _, ca, cb in _elements(data, a, b):
                if c == CUE_TIME:
                    when = _number(data, ca, cb)
                elif c == CUE_TRACK_POSITIONS:
                    p = {d: _number(data, da, db) for d, _, da, db in _elements(data, ca, cb)}
                    out.cues.append((when * out.scale, p.get(CUE_TRACK, 0), p.get(CUE_CLUSTER_POSITION, 0) + state.get("segment", 0)))
        if cut:
            raise Bad(f"element at {start} is cut short")


def parse(data: bytes | None) -> Media:
    out = Media()
    if data:
        try:
            _walk(data, 0, len(data), out, {})
        except Bad as e:
            out.error = str(e)
    return out


def seek(data: bytes, media: Media, ns: int, track: int | None = None) -> list[tuple]:
    """The packets of the last cluster that the cues (of the track) place at or before the time: only that cluster is
    read. Without such a cue, or where it leads to no cluster, the packets of the first cluster on."""
    before = [c for c in media.cues if c[0] <= ns and (track is None or c[1] == track)]
    at = max(before)[2] if before else -1
    part = Media(scale=media.scale)
    try:
        if 0 <= at < len(data) and int.from_bytes(data[at : at + 4], "big") == CLUSTER:
            _, _, a, b = next(_elements(data, at, len(data)))
            part.clusters = 1
            _walk(data, a, abs(b), part, {}, CLUSTER)
        else:
            return media.packets
    except Bad:
        pass
    return part.packets


def read_back(data: bytes, media: Media) -> bytes:
    """All packets' bytes in order."""
    return b"".join([data[p[2] : p[2] + p[3]] for p in media.packets])


def feature(media: Media) -> str:
    """A short description of a parsed file, from its packet table and headers only."""
    sizes = [p[3] for p in media.packets]
    digest = hashlib.sha256()
    for p in media.packets:
        digest.update(b"%d,%d,%d,%d;" % (p[0], p[1], p[2], p[3]))
    t = media.tracks[0] if media.tracks else {"codec": "", "rate": 0.0, "bits": 0}
    return (
        f"{media.doc_type} {t['codec']} {t['rate']:.0f}Hz {t['bits']}bit tracks={len(media.tracks)} clusters={media.clusters} cues={len(media.cues)} "
        f"packets={len(sizes)} bytes={sum(sizes)} last={media.packets[-1][1] if sizes else -1} table={digest.hexdigest()[:16]}"
    )


PACKET = "track long, timestamp_ns long, byte_start long, byte_size long, key boolean, lacing int, cluster int"


def parse_media(rows: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """id, error, the packet table (an array of structs, in file order) and the cues of each file."""
    schema = T.StructType.fromDDL(f"doc_id long, error string, cues array<struct<timestamp_ns:long,track:long,byte_start:long>>, packets array<struct<{PACKET.replace(' long', ':long').replace(' boolean', ':boolean').replace(' int', ':int')}>>")
    names = [p.split()[0] for p in PACKET.split(", ")]
    kinds = [pa.int64()] * 4 + [pa.bool_(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, rows=64):
            found = [parse(m) for m in batch.column(1).to_pylist()]
            packets = pa.array([[dict(zip(names, p, strict=True)) for p in m.packets] for m in found], pa.list_(pa.struct(list(zip(names, kinds, strict=True)))))
            places = pa.struct([(c, pa.int64()) for c in ("timestamp_ns", "track", "byte_start")])
            cues = pa.array([[dict(zip(places.names, c, strict=True)) for c in m.cues] for m in found], pa.list_(places))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.error for m in found], pa.string()), cues, packets], ["doc_id", "error", "cues", "packets"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col)).mapInArrow(run, schema)


def padded(text: str | None, frame: int = FRAME) -> tuple[bytes, int]:
    """The text's UTF-8 bytes with bytes 255 up to a positive multiple of the frame, and their number before."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b"\xff" * (-len(data) % frame or (frame if not data else 0)), len(data)


STORED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()),
        T.StructField("media_bytes", T.LongType()),
        T.StructField("media_sha256", T.StringType()),
        T.StructField("feature", T.StringType()),
        T.StructField("n_packets", T.LongType()),
    ]
)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = True) -> DataFrame:
    """Each text stored as a Matroska file, read back by the parser, with digests of both and the file."""
    schema = T.StructType([*STORED.fields, T.StructField("media", T.BinaryType())]) if with_media else STORED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, rows=128):
            rows: dict[str, list] = {f.name: [] for f in schema}
            for text in batch.column(1).to_pylist():
                payload, n = padded(text)
                data = write(payload)
                media = parse(data)
                back = read_back(data, media)
                if media.error or back != payload:
                    raise ValueError(f"a stored text was not read back whole: {media.error}")
                rows["n_bytes"].append(n)
                rows["payload_bytes"].append(len(back))
                rows["payload_sha256"].append(hashlib.sha256(back).hexdigest())
                rows["tail_crc32"].append(zlib.crc32(back[-32:]))
                rows["media_bytes"].append(len(data))
                rows["media_sha256"].append(hashlib.sha256(data).hexdigest())
                rows["feature"].append(feature(media))
                rows["n_packets"].append(len(media.packets))
                if with_media:
                    rows["media"].append(data)
            rows["doc_id"] = batch.column(0)
            yield pa.RecordBatch.from_pydict(rows)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def op7_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_media=False)
