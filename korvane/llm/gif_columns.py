"""Media columns: GIF files decoded to timed frames with colour histograms, and a lossless GIF form of bytes.

A GIF is read block by block: its LZW code streams give palette indices, interlaced rows go to their places, frames
are drawn on the canvas by their palette, transparent index and the disposal of the frame before. Bytes are stored as
8-bit samples of a grey palette, one frame of 96 columns for every 96 rows at most.

Nulls and ties: a null text is empty and gives one frame of padding; damaged or null media give no frame; equal texts
give equal values; rows that repeat are treated each; empty tables stay empty.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

WIDTH, HEIGHT = 96, 96
#: Payloads are padded by bytes 255 to a multiple of this; a row of samples divides it.
UNIT, PAD = 576, b"\xff"
DELAY = 4  # hundredths of a second
BINS = 16
MAX_CODES = 4096
DISPOSE_NONE, DISPOSE_BACKGROUND, DISPOSE_PREVIOUS = 1, 2, 3


class Damaged(ValueError):
    """The bytes are not a whole GIF."""


# --- LZW --------------------------------------------------------------------------------------------------------------


def _widths(n: int, bits: int) -> np.ndarray:
    """Width of each of n codes that follow a clear code, whose tables start at ``bits`` + 1 bits."""
    known = np.arange(n) + (1 << bits) + 2  # entries when the k-th code has been written
    return np.minimum(12, np.maximum(bits + 1, np.ceil(np.log2(np.maximum(known, 1))).astype(int)))


_WIDTHS = {bits: _widths(MAX_CODES, bits) for bits in range(2, 9)}


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    """A GIF's code stream: variable width, least bit first, a clear code at the start and when the table is full."""
    clear, end = 1 << bits, (1 << bits) + 1
    runs, codes, table, entry = [], [], {}, end + 1
    prefix = -1
    for b in data:
        if prefix < 0:
            prefix = b
            continue
        key = prefix << 8 | b
        code = table.get(key)
        if code is not None:
            prefix = code
            continue
        codes.append(prefix)
        if entry < MAX_CODES:
            table[key] = entry
            entry += 1
        else:
            codes.append(clear)
            runs.append(codes)
            codes, table, entry = [], {}, end + 1
        prefix = b
    if prefix >= 0:
        codes.append(prefix)
    codes.append(end)
    runs.append(codes)
    values, widths = [np.array([clear])], [np.array([bits + 1])]
    for run in runs:
        values.append(np.array(run))
        widths.append(_WIDTHS[bits][: len(run)])
    values, widths = np.concatenate(values), np.concatenate(widths)
    places = np.arange(12)
    return np.packbits(((values[:, None] >> places) & 1).astype(np.uint8)[places < widths[:, None]], bitorder="little").tobytes()


def lzw_decode(data: bytes, bits: int, size: int) -> bytes:
    """At most ``size`` indices of a code stream."""
    clear, end = 1 << bits, (1 << bits) + 1
    first = [bytes([i]) for i in range(clear)] + [b"", b""]
    table, width, before, out, n = list(first), bits + 1, b"", [], 0
    buffer = held = 0
    mask = (1 << width) - 1
    for byte in data:
        buffer |= byte << held
        held += 8
        while held >= width:
            code = buffer & mask
            buffer >>= width
            held -= width
            if code == clear:
                table, width, before = list(first), bits + 1, b""
                mask = (1 << width) - 1
                continue
            if code == end:
                return b"".join(out)[:size]
            known = len(table)
            if code < known:
                now = table[code]
                if before and known < MAX_CODES:
                    table.append(before + now[:1])
                    known += 1
            elif code == known and before:
                now = before + before[:1]
                table.append(now)
                known += 1
            else:
                raise Damaged("a code without an entry")
            out.append(now)
            n += len(now)
            before = now
            if known > mask and width < 12:
                width += 1
                mask = (1 << width) - 1
    if n < size:
        raise Damaged("the code stream ends early")
    return b"".join(out)[:size]


# --- files ------------------------------------------------------------------------------------------------------------


def _sub_blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def _u16(*values: int) -> bytes:
    return b"".join(v.to_bytes(2, "little") for v in values)


GREY = bytes(c for i in range(256) for c in (i, i, i))


def store_bytes(payload: bytes) -> bytes:
    """A GIF whose frames' indices, one after another, are ``payload`` (a positive multiple of WIDTH)."""
    rows = len(payload) // WIDTH
    out = [b"GIF89a", _u16(WIDTH, min(rows, HEIGHT)), bytes([0xF7, 0, 0]), GREY]
    for top in range(0, rows, HEIGHT):
        part = payload[top * WIDTH : (top + HEIGHT) * WIDTH]
        out += [b"!\xf9\x04", bytes([DISPOSE_NONE << 2]), _u16(DELAY), b"\0\0", b",", _u16(0, 0, WIDTH, len(part) // WIDTH), b"\0", b"\x08", _sub_blocks(lzw_encode(part))]
    return b"".join([*out, b";"])


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    delay: int  # hundredths of a second
    disposal: int
    transparent: int  # -1: none
    palette: np.ndarray  # (256, 3)
    indices: np.ndarray  # (height, width)


def read_gif(data: bytes) -> tuple[int, int, list[Frame]]:
    """Width and height of the canvas, and the frames as they are stored."""
    try:
        return _read_gif(data)
    except IndexError as error:
        raise Damaged("the file ends early") from error


def _read_gif(data: bytes) -> tuple[int, int, list[Frame]]:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise Damaged("no signature")
    number = lambda p: data[p] | data[p + 1] << 8

    def palette(flags: int, at: int) -> tuple[np.ndarray | None, int]:
        if not flags & 0x80:
            return None, at
        n = 3 << (flags & 7) + 1
        if at + n > len(data):
            raise Damaged("a palette is cut off")
        colours = np.zeros((256, 3), np.uint8)
        colours[: n // 3] = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3)
        return colours, at + n

    def blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while size := data[at]:
            parts.append(data[at + 1 : at + 1 + size])
            at += size + 1
        return b"".join(parts), at + 1

    width, height = number(6), number(8)
    shared, at = palette(data[10], 13)
    frames, control = [], (0, 0, -1)
    while data[at] != 0x3B:
        if data[at] == 0x21:
            body, after = blocks(at + 2)
            if data[at + 1] == 0xF9 and len(body) >= 4:
                control = (body[0] >> 2 & 7, body[1] | body[2] << 8, body[3] if body[0] & 1 else -1)
            at = after
        elif data[at] == 0x2C:
            left, top, w, h = (number(at + k) for k in (1, 3, 5, 7))
            flags = data[at + 9]
            own, at = palette(flags, at + 10)
            bits = data[at]
            if not 2 <= bits <= 8:
                raise Damaged("the codes' width")
            body, at = blocks(at + 1)
            raw = np.frombuffer(lzw_decode(body, bits, w * h), np.uint8)
            if len(raw) < w * h:
                raise Damaged("a frame lacks samples")
            indices = raw.reshape(h, w)
            if flags & 0x40:  # interlaced: rows of four passes
                order = np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
                indices = indices[np.argsort(order)]
            colours = own if own is not None else shared
            if colours is None:
                raise Damaged("no palette")
            disposal, delay, transparent = control
            frames.append(Frame(left, top, w, h, delay, disposal, transparent, colours, indices))
            control = (0, 0, -1)
        else:
            raise Damaged("an unknown block")
    return width, height, frames


def drawn(width: int, height: int, frames: list[Frame]) -> Iterator[np.ndarray]:
    """The canvas (height, width) of RGBA in 32 bits, red lowest, as it is shown for each frame."""
    canvas = np.zeros((height, width), "<u4")
    for f in frames:
        before = canvas.copy() if f.disposal == DISPOSE_PREVIOUS else None
        area = canvas[f.top : f.top + f.height, f.left : f.left + f.width]
        indices = f.indices[: area.shape[0], : area.shape[1]]
        colours = np.full((256, 4), 255, np.uint8)
        colours[:, :3] = f.palette
        new = colours.view("<u4")[:, 0][indices]
        area[:] = new if f.transparent < 0 else np.where(indices != f.transparent, new, area)
        yield canvas.copy()
        if f.disposal == DISPOSE_BACKGROUND:
            area[:] = 0
        elif before is not None:
            canvas = before


def histogram(canvas: np.ndarray, channel: int = 0) -> np.ndarray:
    """Counts of BINS levels of a channel (0: red) over the pixels that are drawn."""
    pixels = canvas.ravel()
    pixels = pixels[pixels >= 1 << 24]
    return np.bincount(pixels >> np.uint32(8 * channel + 4) & np.uint32(BINS - 1), minlength=BINS)


def samples(frames: list[Frame]) -> bytes:
    """What ``store_bytes`` was given: the indices of all frames."""
    return b"".join(f.indices.tobytes() for f in frames)


# --- Spark ------------------------------------------------------------------------------------------------------------

_FRAME_DDL = (
    "frame long, starts_ms long, delay_ms long, disposal int, transparent int, left long, top long, width long, height long, "
    "pixels binary, red array<long>, green array<long>, blue array<long>"
)
_LONGS = pa.list_(pa.int64())
_FRAME_FIELDS = [
    ("frame", pa.int64()), ("starts_ms", pa.int64()), ("delay_ms", pa.int64()), ("disposal", pa.int32()), ("transparent", pa.int32()),
    ("left", pa.int64()), ("top", pa.int64()), ("width", pa.int64()), ("height", pa.int64()), ("pixels", pa.binary()),
    ("red", _LONGS), ("green", _LONGS), ("blue", _LONGS),
]


def frames(media: DataFrame, media_col: str = "media", id_col: str = "doc_id") -> DataFrame:
    """A row for each frame of each GIF: when it shows, its rules, the RGBA canvas, and its histograms."""
    schema = pa.schema([("doc_id", pa.int64()), *_FRAME_FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    width, height, found = read_gif(data or b"")
                except Damaged:
                    continue
                at = 0
                for i, (f, canvas) in enumerate(zip(found, drawn(width, height, found), strict=True)):
                    row = (doc_id, i, at, f.delay * 10, f.disposal, f.transparent, f.left, f.top, f.width, f.height, canvas.tobytes(), *(histogram(canvas, c).tolist() for c in range(3)))
                    at += f.delay * 10
                    yield pa.RecordBatch.from_arrays([pa.array([v], x.type) for v, x in zip(row, schema, strict=True)], schema=schema)

    rows = small_batches(media).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{media_col}`").alias("media"))
    return rows.mapInArrow(run, f"doc_id long, {_FRAME_DDL}")


def padded(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data + PAD * (UNIT * max(1, -(-len(data) // UNIT)) - len(data))


def store_texts(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, media): every text as a GIF."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, known = batch.column(1).to_pylist(), {}
            for text in texts:  # equal texts of a batch are encoded once
                if text not in known:
                    n, payload = padded(text)
                    known[text] = n, store_bytes(payload)
            pairs = [known[text] for text in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in pairs], pa.int64()), pa.array([m for _, m in pairs], pa.binary())], schema=schema)

    rows = small_batches(docs).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def _read_back(data: bytes) -> tuple:
    """Length, SHA-256 and tail of the payload of a GIF, and its feature; all None if it is damaged."""
    try:
        width, height, found = read_gif(data)
        payload = samples(found)
        levels = sum((histogram(c) for c in drawn(width, height, found)), np.zeros(BINS, np.int64))
    except Damaged:
        return (None,) * 4
    feature = f"{len(found)};{sum(f.delay for f in found) * 10};{','.join(map(str, levels.tolist()))}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), feature


def media_digests(media: DataFrame) -> DataFrame:
    """From the stored GIFs of ``store_texts`` alone: digests of what is read back, and the frames' features.

    ``feature`` lists frames, duration in ms, and the summed grey histogram of all frames as they are shown. Null media
    have no values; of damaged media there are the digests of what is stored, and nothing of what can't be read back.
    """
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
              ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stored, known = batch.column(2).to_pylist(), {None: (None,) * 6}
            for data in stored:
                if data not in known:
                    *payload, feature = _read_back(data)
                    known[data] = (*payload, len(data), hashlib.sha256(data).hexdigest(), feature)
            rows = [known[data] for data in stored]
            made = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, f.type) for c, f in zip(made, list(schema)[2:], strict=True)]], schema=schema)

    return media.mapInArrow(
        run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )
