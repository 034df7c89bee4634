"""Media columns: ISO base media files as binary values.

store() wraps payloads as 8-bit samples of a one-track file; describe() walks
the nested boxes of any such file, decodes its sample tables and gives codec,
duration and keyframe byte ranges. It touches only the boxes' headers and
tables: payload bytes are located, never decoded. Row-local, so neither shuffles.

Defined cases: a null text is empty; a payload is never empty (64 zero bytes at
least); equal texts give equal bytes; bytes that are no such file, or whose
tables contradict each other or the file's end, give codec null and the reason
in `error`; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, text_or_empty
from .encoding import small_batches

FRAME = 64  # bytes of a sample: a line of 8-bit grey values
RATE = 25  # samples a second
KEYFRAME_EVERY = 32
CHUNK = 256  # samples of a chunk
# Fixed values of ISO/IEC 14496-12: boxes that hold boxes, by the bytes before their children.
CONTAINERS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"edts": 0, b"dinf": 0, b"udta": 0}
_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def full_box(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def write_media(payload: bytes) -> bytes:
    """A file whose samples, in order, are the payload; its length is a positive multiple of FRAME."""
    frames = len(payload) // FRAME
    brand = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", FRAME, 1, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 40, -1))
    keys = np.arange(1, frames + 1, KEYFRAME_EVERY, dtype=">u4")
    whole, rest = divmod(frames, CHUNK)
    runs = [(1, CHUNK, 1)] * (whole > 0) + [(whole + 1, rest, 1)] * (rest > 0)

    def tables(first: int) -> bytes:
        offsets = np.arange(whole + (rest > 0), dtype=np.int64) * CHUNK * FRAME + first
        return box(
            b"moov",
            full_box(b"mvhd", struct.pack(">IIIIIH", 0, 0, RATE, frames, 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2)),
            box(
                b"trak",
                full_box(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, frames), bytes(16), _MATRIX, struct.pack(">II", FRAME << 16, 1 << 16), flags=3),
                box(
                    b"mdia",
                    full_box(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, frames, 0x55C4, 0)),
                    full_box(b"hdlr", bytes(4), b"vide", bytes(12), b"text\0"),
                    box(
                        b"minf",
                        full_box(b"vmhd", bytes(8), flags=1),
                        box(b"dinf", full_box(b"dref", struct.pack(">I", 1), full_box(b"url ", flags=1))),
                        box(
                            b"stbl",
                            full_box(b"stsd", struct.pack(">I", 1), entry),
                            full_box(b"stts", struct.pack(">III", 1, frames, 1)),
                            full_box(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
                            full_box(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
                            full_box(b"stsz", struct.pack(">II", FRAME, frames)),
                            full_box(b"stco", struct.pack(">I", len(offsets)), offsets.astype(">u4").tobytes()),
                        ),
                    ),
                ),
            ),
        )

    head = len(brand) + len(tables(0)) + 8
    return brand + tables(head) + struct.pack(">I4s", 8 + len(payload), b"mdat") + payload


@dataclass
class Media:
    codec: str
    handler: str
    timescale: int
    duration: int
    width: int
    height: int
    offsets: np.ndarray = field(repr=False)  # of each sample
    sizes: np.ndarray = field(repr=False)
    keys: np.ndarray = field(repr=False)  # indexes of sync samples

    def keyframe_ranges(self) -> list[tuple[int, int]]:
        return list(zip(self.offsets[self.keys].tolist(), self.sizes[self.keys].tolist()))

    def runs(self) -> list[tuple[int, int]]:
        """Byte ranges (begin, end) of the samples in decoding order, contiguous ones merged."""
        if not len(self.offsets):
            return []
        ends = self.offsets + self.sizes
        first = np.flatnonzero(np.r_[True, self.offsets[1:] != ends[:-1]])
        return list(zip(self.offsets[first].tolist(), ends[np.r_[first[1:] - 1, len(ends) - 1]].tolist()))


#: Boxes within boxes that are followed; files nest seven.
DEPTH = 32


def walk(data: memoryview, begin: int, end: int):
    """(path, begin, end) of the bodies of all boxes, depth first; 64-bit sizes and open-ended boxes included."""
    open_ = [(begin, end, ())]  # what is left of each box that is being read
    while open_:
        begin, end, path = open_.pop()
        if begin >= end:
            continue
        if end - begin < 8:
            raise ValueError("truncated box header")
        size, kind = struct.unpack_from(">I4s", data, begin)
        head = 8
        if size == 1:
            if end - begin < 16:
                raise ValueError("truncated box header")
            size, head = struct.unpack_from(">Q", data, begin + 8)[0], 16
        elif size == 0:
            size = end - begin
        if size < head or begin + size > end:
            raise ValueError("box exceeds its parent")
        open_.append((begin + size, end, path))
        yield (*path, kind), begin + head, begin + size
        if kind in CONTAINERS:
            if len(path) == DEPTH:
                raise ValueError("boxes are nested too deep")
            open_.append((begin + head + CONTAINERS[kind], begin + size, (*path, kind)))


def _fields(data: memoryview, span: tuple[int, int], at: int, form: str) -> tuple:
    """Fields of a box at a place in its body."""
    if at < 0 or span[0] + at + struct.calcsize(form) > span[1]:
        raise ValueError("truncated box")
    return struct.unpack_from(form, data, span[0] + at)


def _table(data: memoryview, span: tuple[int, int], columns: int, skip: int = 4, kind: str = ">u4") -> np.ndarray:
    (count,) = _fields(data, span, skip, ">I")
    width = np.dtype(kind).itemsize * columns
    if span[0] + skip + 4 + count * width > span[1]:
        raise ValueError("table exceeds its box")
    values = np.frombuffer(data, kind, count * columns, span[0] + skip + 4)
    if kind == ">u8" and len(values) and values.max() > len(data):
        raise ValueError("samples exceed the file")
    return values.astype(np.int64).reshape(count, columns)


def _track(data: memoryview, boxes: dict[bytes, tuple[int, int]]) -> Media:
    header = boxes[b"mdhd"]
    (version,) = _fields(data, header, 0, ">B")
    timescale, duration = _fields(data, header, 20, ">IQ") if version == 1 else _fields(data, header, 12, ">II")
    handler = _fields(data, boxes[b"hdlr"], 8, "4s")[0].decode("latin-1")
    codec = _fields(data, boxes[b"stsd"], 12, "4s")[0].decode("latin-1")
    width, height = _fields(data, boxes[b"stsd"], 40, ">HH") if handler == "vide" else (0, 0)
    fixed, count = _fields(data, boxes[b"stsz"], 4, ">II")
    if fixed:
        if count * fixed > len(data):
            raise ValueError("samples exceed the file")
        sizes = np.full(count, fixed, np.int64)
    else:
        sizes = _table(data, boxes[b"stsz"], 1, 8)[:, 0]
    chunks = (_table(data, boxes[b"co64"], 1, kind=">u8") if b"co64" in boxes else _table(data, boxes[b"stco"], 1))[:, 0]
    runs = _table(data, boxes[b"stsc"], 3)
    if len(runs) and (runs[0, 0] != 1 or (np.diff(runs[:, 0]) <= 0).any() or runs[-1, 0] > len(chunks)):
        raise ValueError("sample tables contradict each other")
    held = np.repeat(runs[:, 1], np.diff(np.r_[runs[:, 0], len(chunks) + 1]).clip(0)) if len(runs) else np.empty(0, np.int64)
    if len(held) != len(chunks) or held.sum() != count:
        raise ValueError("sample tables contradict each other")
    before = np.cumsum(sizes) - sizes
    first = np.cumsum(held) - held
    offsets = before + np.repeat(chunks - before[first] if count else chunks[:0], held)
    if count and (offsets + sizes).max() > len(data):
        raise ValueError("samples exceed the file")
    keys = _table(data, boxes[b"stss"], 1)[:, 0] - 1 if b"stss" in boxes else np.arange(count)
    if len(keys) and (keys.min() < 0 or keys.max() >= count):
        raise ValueError("sync samples exceed the table")
    return Media(codec, handler, timescale, duration, width, height, offsets, sizes, keys)


def read_media(data: bytes) -> Media:
    """The first track of a file; ValueError says why there is none."""
    view = memoryview(data)
    boxes: dict[bytes, tuple[int, int]] = {}
    tracks = 0
    for path, begin, end in walk(view, 0, len(view)):
        tracks += path[-1] == b"trak"
        if b"trak" in path and tracks == 1:
            boxes.setdefault(path[-1], (begin, end))
    if not tracks:
        raise ValueError("no track")
    try:
        return _track(view, boxes)
    except KeyError as e:
        raise ValueError(f"no box {e.args[0].decode('latin-1')}") from None


def payload_of(text: str | None) -> tuple[bytes, int]:
    data = (text or "").encode()
    return data + bytes(-len(data) % FRAME or (0 if data else FRAME)), len(data)


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media of each text."""

    def build(batches):
        for batch in batches:
            for part, texts in small_batches(batch, most_bytes=8_000_000):
                pairs = [payload_of(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([n for _, n in pairs], pa.int64()), pa.array([write_media(p) for p, _ in pairs], pa.binary())],
                    ["doc_id", "n_bytes", "media"],
                )

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(build, "doc_id long, n_bytes long, media binary")


DESCRIPTION = (
    "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    "codec string, duration_s double, keyframes array<struct<offset:long,size:long>>, error string"
)
_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("offset", pa.int64()), ("size", pa.int64())])), pa.string()]


def describe_file(data: bytes | None) -> tuple:
    data = data or b""
    try:
        media = read_media(data)
    except ValueError as e:
        return (0, hashlib.sha256().hexdigest(), 0, len(data), hashlib.sha256(data).hexdigest(), "invalid", None, None, [], str(e))
    view, digest, size = memoryview(data), hashlib.sha256(), 0
    for a, b in media.runs():
        digest.update(view[a:b])
        size += b - a
    tail = b"" if not len(media.sizes) else view[int(media.offsets[-1]) : int(media.offsets[-1] + media.sizes[-1])][-FRAME:]
    ranges = media.keyframe_ranges()
    seconds = media.duration / media.timescale if media.timescale else 0.0
    spans = zlib.crc32(np.array(ranges, "<i8").tobytes())
    feature = f"{media.codec.strip()}:{media.handler}:{media.width}x{media.height}:{media.duration}/{media.timescale}:{len(media.sizes)}:{len(ranges)}:{spans:08x}"
    return (size, digest.hexdigest(), zlib.crc32(tail), len(data), hashlib.sha256(data).hexdigest(), feature, media.codec, seconds, [{"offset": a, "size": b} for a, b in ranges], None)


def describe(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes and what each media value holds."""
    names = [c.split()[0] for c in DESCRIPTION.split(", ")]

    def read(batches):
        for batch in batches:
            columns = list(zip(*(describe_file(v.as_py()) for v in batch.column("media")))) or [[]] * len(names)
            arrays = [pa.array(c, t) for c, t in zip(columns, _TYPES)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *arrays], ["doc_id", "n_bytes", *names])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(read, f"doc_id long, n_bytes long, {DESCRIPTION}")


def op5_iso_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = materialize(store(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media")
    columns = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return describe(stored).select(*columns, "codec", "duration_s", F.size("keyframes").cast("long").alias("n_keyframes"))
