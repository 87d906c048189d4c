"""Media columns: a Matroska reader and writer on bytes, and a packet table of media columns.

The reader walks EBML elements (variable-length ids and sizes, unknown sizes included), and yields one packet for
each frame of each SimpleBlock or BlockGroup, whatever its lacing (none, Xiph, EBML, fixed size), with track,
timestamp, key flag and the frame's byte range in the file. The writer stores 8-bit PCM samples in clusters of laced
blocks with an index (Cues). Everything follows the public Matroska and EBML specifications (RFC 8794, RFC 9559).
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import as_text, documents, map_rows, texts_of

# Fixed values of the format: element ids.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, MUXING_APP, WRITING_APP, DURATION = 0x2AD7B1, 0x4D80, 0x5741, 0x4489
DEFAULT_DURATION = 0x23E383
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID, AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {EBML, SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS}
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3
# Elements at the top of a segment; one of them ends a cluster of unknown size.
LEVEL_ONE = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}


class MediaError(ValueError):
    """The bytes are no well-formed Matroska file."""


def read_id(data: bytes, at: int) -> tuple[int, int]:
    """The element id at a place, its length marker kept, and the place after it."""
    if at >= len(data) or not data[at]:
        raise MediaError(f"no element id at byte {at}")
    size = 9 - data[at].bit_length()
    if size > 4 or at + size > len(data):
        raise MediaError(f"bad element id at byte {at}")
    return int.from_bytes(data[at : at + size], "big"), at + size


def read_vint(data: bytes, at: int) -> tuple[int | None, int, int]:
    """A variable-length integer without its marker (None: all ones, which means unknown), its length, the place after."""
    if at >= len(data) or not data[at]:
        raise MediaError(f"no size at byte {at}")
    size = 9 - data[at].bit_length()
    if at + size > len(data):
        raise MediaError(f"cut size at byte {at}")
    value = int.from_bytes(data[at : at + size], "big") & ((1 << 7 * size) - 1)
    return (None if value == (1 << 7 * size) - 1 else value), size, at + size


def vint(value: int, size: int = 0) -> bytes:
    size = size or next(n for n in range(1, 9) if value < (1 << 7 * n) - 1)
    return (value | 1 << 7 * size).to_bytes(size, "big")


def element(ident: int, body: bytes | list[bytes], size: int = 0) -> bytes:
    body = b"".join(body) if isinstance(body, list) else body
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body), size) + body


def uint(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def float64(ident: int, value: float) -> bytes:
    return element(ident, np.array(value, ">f8").tobytes())


@dataclass
class Packet:
    track: int
    timestamp: int
    key: bool
    lacing: int
    cluster: int
    offset: int
    size: int


@dataclass
class Media:
    doc_type: str = ""
    scale: int = 1_000_000
    tracks: list[dict] = field(default_factory=list)
    packets: list[Packet] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)


def laced(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """The byte ranges (offset, size) of a block's frames; ``at`` is the place after the block's header."""
    if lacing == NO_LACING:
        return [(at, end - at)]
    if at >= end:
        raise MediaError("a laced block without a frame count")
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == FIXED:
        if (end - at) % n:
            raise MediaError("fixed lacing with uneven frames")
        sizes = [(end - at) // n] * (n - 1)
    elif lacing == XIPH:
        for _ in range(n - 1):
            size = 0
            while at < end:
                byte, at = data[at], at + 1
                size += byte
                if byte < 255:
                    break
            sizes.append(size)
    else:
        for i in range(n - 1):
            value, width, at = read_vint(data, at)
            value = (1 << 7 * width) - 1 if value is None else value
            sizes.append(value if i == 0 else sizes[-1] + value - ((1 << 7 * width - 1) - 1))
    last = end - at - sum(sizes)
    if last < 0 or min(sizes, default=0) < 0:
        raise MediaError("laced frames are longer than their block")
    frames = []
    for size in [*sizes, last]:
        frames.append((at, size))
        at += size
    return frames


def lace(frames: list[bytes], lacing: int) -> bytes:
    """The body of a block after its header."""
    if lacing == NO_LACING:
        return frames[0]
    head = [bytes([len(frames) - 1])]
    sizes = [len(f) for f in frames]
    if lacing == XIPH:
        head += [b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1]]
    elif lacing == EBML_LACING:
        for i, s in enumerate(sizes[:-1]):
            step = s if i == 0 else s - sizes[i - 1]
            width = next(n for n in range(1, 9) if (step < (1 << 7 * n) - 1 if i == 0 else abs(step) < (1 << 7 * n - 1) - 1))
            head.append(vint(step if i == 0 else step + (1 << 7 * width - 1) - 1, width))
    return b"".join(head + frames)


def parse(data: bytes) -> Media:
    """Tracks, packets and index of a file. Raises MediaError where the bytes are cut or ill-formed."""
    media = Media()
    state = {"cluster": -1, "time": 0, "segment": 0, "cue": 0}

    def block(at: int, end: int, key: bool | None) -> None:
        track, _, at = read_vint(data, at)
        if at + 3 > end or track is None:
            raise MediaError("a cut block header")
        when, flags = int.from_bytes(data[at : at + 2], "big", signed=True), data[at + 2]
        lacing = flags >> 1 & 3
        step = next((t.get("duration", 0) for t in media.tracks if t.get("number") == track), 0)  # of a frame, in nanoseconds
        for i, (offset, size) in enumerate(laced(data, at + 3, end, lacing)):
            media.packets.append(Packet(track, state["time"] + when + i * step // media.scale, bool(flags & 0x80) if key is None else key, lacing, state["cluster"], offset, size))

    def walk(at: int, end: int, parent: int) -> int:
        while at < end:
            begin = at
            ident, at = read_id(data, at)
            if parent == CLUSTER and ident in LEVEL_ONE:  # a cluster of unknown size ends here
                return begin
            size, _, at = read_vint(data, at)
            if size is None and ident not in (SEGMENT, CLUSTER):
                raise MediaError(f"unknown size of element {ident:x}")
            stop = end if size is None else at + size
            if stop > end:
                raise MediaError(f"element {ident:x} at byte {begin} is cut")
            if ident in MASTERS:
                if ident == SEGMENT:
                    state["segment"] = at
                elif ident == CLUSTER:
                    media.clusters.append(begin - state["segment"])
                    state["cluster"] += 1
                elif ident == TRACK_ENTRY:
                    media.tracks.append({})
                if ident == BLOCK_GROUP:
                    group(at, stop)
                    at = stop
                else:
                    at = walk(at, stop, ident)
                continue
            body = data[at:stop]
            number = int.from_bytes(body, "big")
            if ident == SIMPLE_BLOCK:
                block(at, stop, None)
            elif ident == TIMESTAMP:
                state["time"] = number
            elif ident == DOC_TYPE:
                media.doc_type = body.rstrip(b"\0").decode("ascii", "replace")
            elif ident == TIMESTAMP_SCALE:
                media.scale = number
            elif ident in (TRACK_NUMBER, TRACK_TYPE, CHANNELS, BIT_DEPTH, DEFAULT_DURATION) and media.tracks:
                media.tracks[-1][{TRACK_NUMBER: "number", TRACK_TYPE: "type", CHANNELS: "channels", BIT_DEPTH: "bits", DEFAULT_DURATION: "duration"}[ident]] = number
            elif ident == CODEC_ID and media.tracks:
                media.tracks[-1]["codec"] = body.decode("ascii", "replace")
            elif ident == SAMPLING and media.tracks:
                media.tracks[-1]["rate"] = float(np.frombuffer(body, f">f{len(body)}")[0]) if len(body) in (4, 8) else 0.0
            elif ident == CUE_TIME:
                state["cue"] = number
            elif ident == CUE_TRACK:
                state["cue_track"] = number
            elif ident == CUE_CLUSTER_POSITION:
                media.cues.append((state["cue"], state.get("cue_track", 0), number))
            at = stop
        return at

    def group(at: int, end: int) -> None:
        found, key = None, True
        while at < end:
            ident, at = read_id(data, at)
            size, _, at = read_vint(data, at)
            if size is None or at + size > end:
                raise MediaError("a cut block group")
            if ident == BLOCK:
                found = (at, at + size)
            elif ident == REFERENCE_BLOCK:
                key = False
            at += size
        if found:
            block(*found, key)

    walk(0, len(data), 0)
    if media.doc_type not in ("matroska", "webm"):
        raise MediaError(f"not a Matroska file: {media.doc_type!r}")
    return media


RATE, FRAME, LACED, BLOCKS = 8000, 2048, 8, 16


def store_samples(payload: bytes, lacing: int = EBML_LACING) -> bytes:
    """A Matroska file with one mono track of unsigned 8-bit samples at 8 kHz that holds ``payload`` losslessly.

    Frames have 2,048 samples (the last may have fewer), blocks up to 8 laced frames, clusters up to 16 blocks, each
    cluster one cue. Times are in milliseconds, as frames of 256 ms fall on whole ones.
    """
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    head = element(EBML, [uint(EBML_VERSION, 1), uint(EBML_READ_VERSION, 1), uint(EBML_MAX_ID, 4), uint(EBML_MAX_SIZE, 8), element(DOC_TYPE, b"matroska"), uint(DOC_VERSION, 4), uint(DOC_READ_VERSION, 2)])
    info = element(INFO, [uint(TIMESTAMP_SCALE, 1_000_000), element(MUXING_APP, b"corvane"), element(WRITING_APP, b"corvane"), float64(DURATION, len(payload) * 1000 / RATE)])
    audio = element(AUDIO, [float64(SAMPLING, RATE), uint(CHANNELS, 1), uint(BIT_DEPTH, 8)])
    tracks = element(TRACKS, element(TRACK_ENTRY, [uint(TRACK_NUMBER, 1), uint(TRACK_UID, 1), uint(TRACK_TYPE, 2), uint(FLAG_LACING, 1), uint(DEFAULT_DURATION, FRAME * 1_000_000_000 // RATE), element(CODEC_ID, b"A_PCM/INT/LIT"), audio]))
    body, cues, place = [info, tracks], [], len(info) + len(tracks)
    for c in range(0, len(frames), LACED * BLOCKS):
        base = c * FRAME * 1000 // RATE
        blocks = [uint(TIMESTAMP, base)]
        each = 1 if lacing == NO_LACING else LACED
        for b in range(c, min(c + LACED * BLOCKS, len(frames)), each):
            own = frames[b : b + each]
            kind = lacing if len(own) > 1 else NO_LACING
            kind = EBML_LACING if kind == FIXED and len(own[-1]) != len(own[0]) else kind
            blocks.append(element(SIMPLE_BLOCK, b"\x81" + (b * FRAME * 1000 // RATE - base).to_bytes(2, "big") + bytes([0x80 | kind << 1]) + lace(own, kind)))
        cluster = element(CLUSTER, blocks)
        cues.append(element(CUE_POINT, [uint(CUE_TIME, base), element(CUE_TRACK_POSITIONS, [uint(CUE_TRACK, 1), uint(CUE_CLUSTER_POSITION, place)])]))
        body.append(cluster)
        place += len(cluster)
    return head + element(SEGMENT, [*body, element(CUES, cues)], 8)


def payload_of(text: str) -> tuple[bytes, int]:
    """The text's UTF-8 bytes, padded with zeros to a positive multiple of 64, and their number before."""
    raw = text.encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % 64 if raw else 64), len(raw)


def read_samples(data: bytes, track: int = 1) -> tuple[bytes, Media]:
    media = parse(data)
    return b"".join([data[p.offset : p.offset + p.size] for p in media.packets if p.track == track]), media


def feature_of(samples: bytes, media: Media) -> str:
    """Counts of the container and plain statistics of the samples, all whole numbers."""
    counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    whole = {x for x in media.clusters}
    good = sum(c in whole for _, _, c in media.cues)
    return (f"packets={len(media.packets)};clusters={len(media.clusters)};cues={good};laced={sum(p.lacing != 0 for p in media.packets)};"
            f"last_ms={media.packets[-1].timestamp};sum={int(counts @ np.arange(256))};peak={int(counts.nonzero()[0][-1])};kinds={int((counts > 0).sum())}")


PACKETS = "media_id long, packet int, track int, timestamp_ms long, key boolean, lacing int, cluster int, byte_offset long, byte_size long, error string"


def packets(media: DataFrame, id_col: str = "media_id", data_col: str = "data") -> DataFrame:
    """The packet table of a binary column: a row for each frame, in file order.

    Null data gives no rows. Bytes that are no whole Matroska file give one row with ``error`` and nulls. Equal ids
    and repeated rows are each parsed; further columns are not read.
    """
    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for ident, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if data is None:
                    continue
                try:
                    found = parse(data)
                except MediaError as e:
                    rows.append((ident, *[None] * 8, str(e)))
                    continue
                rows += [(ident, i, p.track, p.timestamp * found.scale // 1_000_000, p.key, p.lacing, p.cluster, p.offset, p.size, None) for i, p in enumerate(found.packets)]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 10, kinds, strict=True)], [x.split()[0] for x in PACKETS.split(", ")])

        return step

    return map_rows(media.select(id_col, data_col), make, PACKETS)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text stored as a Matroska file and read back; null text is empty, which is 64 zero bytes."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for text in texts_of(batch.column(1)):
                payload, n = payload_of(text)
                data = store_samples(payload)
                back, media = read_samples(data)
                rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature_of(back, media)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)]], [x.split()[0] for x in DIGEST.split(", ")])

        return step

    return map_rows(as_text(docs, text_col, id_col), make, DIGEST)


def media_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """media_id and data, the Matroska bytes of each text."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([store_samples(payload_of(t)[0]) for t in texts_of(batch.column(1))], pa.binary())], ["media_id", "data"])

        return step

    return map_rows(as_text(docs, text_col, id_col), make, "media_id long, data binary")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: every document's stored form, read back."""
    return media_digests(documents(spark, sf_dir))
