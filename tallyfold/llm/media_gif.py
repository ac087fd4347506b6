"""Media columns, GIF: texts (or any bytes) stored as animated colour GIFs, and any GIF read back:
LZW code streams decoded, palettes applied, disposal and transparency followed, timed frames kept with
colour-histogram columns.

A payload of n x 576 bytes becomes interlaced frames 24 pixels wide and up to 384 high (16 blocks of 24 x 24, the last
frame as high as what is left). A sample is a byte of the payload; the palette gives it a colour of three bits of red, three of
green and two of blue. Byte 255, which no UTF-8 text has, is transparent, so padding isn't drawn, and each frame
is cleared before the next one. The samples of the stored form are the payload itself.

Cases: null and empty texts give one frame of 255; equal texts give equal files; repeated rows give repeated
rows; a broken stream raises GifError in `read_gif`, and `frame_rows` gives its row an error text and no frames;
other columns pass through, and a column that has one of the output names is replaced.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

SIDE = 24
BLOCK = SIDE * SIDE
#: Rows of a frame at most.
ROWS = 16 * SIDE
DELAY = 4  # hundredths of a second a frame
PAD = 255
_SINGLE = [bytes([i]) for i in range(256)]
_PALETTE = bytes(v for i in range(256) for v in ((i >> 5) * 255 // 7, (i >> 2 & 7) * 255 // 7, (i & 3) * 255 // 3))
#: Ranges of red, green and blue each that colours are counted by.
BINS = 4


#: Pixels of a screen or frame at most, so that a few bytes can't ask for more memory than a worker has; bytes of frames that are handed over at once.
MOST_PIXELS, LOT_BYTES = 1 << 24, 16 << 20


class GifError(ValueError):
    pass


@lru_cache(12)
def _stretch(depth: int) -> np.ndarray:
    """Bits of the codes between two clear codes, and of the second one: a code is as wide as the entry made before it needs."""
    entries = np.arange(4096 - (1 << depth))
    width = np.ceil(np.log2((1 << depth) + 2 + entries)).astype(np.int64)  # bits of the entry that the code before made
    return np.clip(width, depth + 1, 12)


def _widths(n: int, depth: int) -> np.ndarray:
    """Bits of each of n codes of a stream: a clear code, then stretches that fill the table and end with a clear code."""
    return np.concatenate([[depth + 1], np.resize(_stretch(depth), n - 1)])


def lzw_encode(data: bytes, depth: int = 8) -> bytes:
    """GIF's variable-width LZW: a clear code first, an end code last, a clear code whenever 4096 codes are used up."""
    clear, end = 1 << depth, (1 << depth) + 1
    codes = [clear]
    add = codes.append
    table: dict[int, int] = {}
    get = table.get
    free = end + 1
    if data:
        held = data[0]
        for byte in data[1:]:
            key = held << 8 | byte
            seen = get(key)
            if seen is not None:
                held = seen
                continue
            add(held)
            held = byte
            if free < 4096:
                table[key] = free
                free += 1
            else:
                add(clear)
                table.clear()
                free = end + 1
        add(held)
    add(end)
    return _packed(np.array(codes, np.int64), _widths(len(codes), depth))


def _packed(codes: np.ndarray, widths: np.ndarray) -> bytes:
    """Codes as bits, least significant first."""
    bits = np.unpackbits(codes.astype("<u2").view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
    return np.packbits(bits[np.arange(16) < widths[:, None]], bitorder="little").tobytes()


def lzw_decode(stream: bytes, depth: int, most: int) -> bytes:
    """The samples of a code stream, at most `most` of them."""
    clear, end = 1 << depth, (1 << depth) + 1
    bits = np.unpackbits(np.frombuffer(stream, np.uint8), bitorder="little")
    total = len(bits)
    out: list[bytes] = []
    size = at = 0
    width = depth + 1
    table: list[bytes] = []
    last = b""
    # Codes of one width come in runs of known length: a run is read as a whole, up to a clear or end code.
    while at + width <= total and size < most:
        free = len(table)
        run = (1 << width) - free + (not last) if table else 1
        if width == 12 and free >= 4096:
            run = 4096
        run = max(1, min(run, (total - at) // width))
        codes = _split(bits[at : at + run * width], width)
        marks = np.flatnonzero((codes == clear) | (codes == end))
        mark = None
        if len(marks):
            mark, codes = int(codes[marks[0]]), codes[: marks[0]]
        if len(codes) and not table:
            raise GifError("no clear code at the start")
        before = len(out)
        codes = codes.tolist()
        if codes and not last:
            if codes[0] >= len(table):
                raise GifError("a code that is not in the table yet")
            last = table[codes[0]]
            out.append(last)
            rest = codes[1:]
        else:
            rest = codes
        free = len(table)
        if free >= 4096:
            out.extend(map(table.__getitem__, rest))
            last = out[-1] if out else last
        else:
            # Each code makes an entry: what came before, and its own first sample.
            learn, say = table.append, out.append
            for code in rest:
                if code < free:
                    piece = table[code]
                elif code == free:
                    piece = last + last[:1]
                else:
                    raise GifError("a code that is not in the table yet")
                if free < 4096:
                    learn(last + piece[:1])
                    free += 1
                say(piece)
                last = piece
        size += sum(map(len, out[before:]))
        at += width * (len(codes) + (mark is not None))
        if mark == end and table:
            break
        if mark == clear:
            table = [*_SINGLE[:clear], b"", b""]
            last = b""
            width = depth + 1
        elif mark is not None:
            raise GifError("no clear code at the start")
        elif len(table) == 1 << width and width < 12:
            width += 1
    return b"".join(out)[:most]


def _split(bits: np.ndarray, width: int) -> np.ndarray:
    return bits.reshape(-1, width) @ (1 << np.arange(width))


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(x := data[i : i + 255])]) + x for i in range(0, len(data), 255)) + b"\0"


def write_gif(payload: bytes, palette: bytes = _PALETTE, disposal: int = 2, transparent: int | None = PAD, interlaced: bool = True) -> bytes:
    """The payload, a multiple of 576 samples, as an animated GIF."""
    height = min(ROWS, len(payload) // SIDE)
    parts = [b"GIF89a", struct.pack("<HHBBB", SIDE, height, 0xF7, PAD, 0), palette, b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0"]
    for i in range(0, len(payload), ROWS * SIDE):
        piece = payload[i : i + ROWS * SIDE]
        rows = len(piece) // SIDE
        if interlaced:
            piece = np.frombuffer(piece, np.uint8).reshape(rows, SIDE)[_rows(rows, True)].tobytes()
        parts += [b"\x21\xf9\x04", struct.pack("<BHB", disposal << 2 | (transparent is not None), DELAY, transparent or 0), b"\0"]
        parts += [b"\x2c", struct.pack("<HHHHB", 0, 0, SIDE, rows, 0x40 * interlaced), b"\x08", _blocks(lzw_encode(piece))]
    return b"".join([*parts, b"\x3b"])


@dataclass
class Frame:
    delay: int  #: hundredths of a second
    disposal: int
    samples: np.ndarray  #: palette indices of the frame's own rectangle, rows from the top
    canvas: np.ndarray  #: RGB of the whole screen while the frame shows, uint8 (height, width, 3)


def _rows(height: int, interlaced: bool) -> list[int]:
    return [*range(0, height, 8), *range(4, height, 8), *range(2, height, 4), *range(1, height, 2)] if interlaced else list(range(height))


def read_gif(data: bytes) -> Iterator[Frame]:
    """Frames in order, drawn as a viewer would: transparent samples leave what is below, then disposal 2 clears the frame's rectangle and 3 puts back what was there."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise GifError("no GIF header")
    width, height, flags, background, _ = struct.unpack("<HHBBB", data[6:13])
    if width * height > MOST_PIXELS:
        raise GifError(f"a screen of {width} x {height}")
    at = 13
    common = None

    def colours_of(flags: int) -> np.ndarray:
        nonlocal at
        n = 3 << (flags & 7) + 1
        if at + n > len(data):
            raise GifError("the data ends inside a palette")
        at += n
        return np.frombuffer(data[at - n : at], np.uint8).reshape(-1, 3)

    if flags & 0x80:
        common = colours_of(flags)
    canvas = np.zeros((height, width, 3), np.uint8)
    delay, disposal, clear = 0, 0, None

    def gathered() -> bytes:
        nonlocal at
        parts = []
        while True:
            if at >= len(data):
                raise GifError("the data ends inside a block")
            n = data[at]
            if not n:
                at += 1
                return b"".join(parts)
            parts.append(data[at + 1 : at + 1 + n])
            at += 1 + n

    while at < len(data) and data[at] != 0x3B:
        kind = data[at]
        at += 1
        if kind == 0x21:
            label = data[at]
            at += 1
            body = gathered()
            if label == 0xF9 and len(body) >= 4:
                delay, disposal = int.from_bytes(body[1:3], "little"), body[0] >> 2 & 7
                clear = body[3] if body[0] & 1 else None
        elif kind == 0x2C:
            x, y, w, h, local = struct.unpack("<HHHHB", data[at : at + 9])
            at += 9
            if w * h > MOST_PIXELS:
                raise GifError(f"a frame of {w} x {h}")
            palette = colours_of(local) if local & 0x80 else common
            if palette is None:
                raise GifError("no palette")
            depth = data[at]
            at += 1
            samples = np.frombuffer(lzw_decode(gathered(), depth, w * h), np.uint8)
            if len(samples) < w * h:
                raise GifError("too few samples")
            order = _rows(h, bool(local & 0x40))
            own = np.empty((h, w), np.uint8)
            own[order] = samples.reshape(h, w)
            before = canvas.copy() if disposal == 3 else None
            area = canvas[y : y + h, x : x + w]
            colours = palette[np.minimum(own, len(palette) - 1)][: area.shape[0], : area.shape[1]]
            if clear is None:
                area[:] = colours
            else:
                np.copyto(area, colours, where=(own[: area.shape[0], : area.shape[1]] != clear)[..., None])
            yield Frame(delay, disposal, own, canvas.copy())
            if disposal == 2:
                area[:] = common[background] if common is not None and background < len(common) and clear is None else 0
            elif disposal == 3:
                canvas = before
            delay, disposal, clear = 0, 0, None
        else:
            raise GifError(f"unknown block {kind:#x}")
    if at >= len(data):
        raise GifError("the data ends without a trailer")


def histogram(canvas: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Pixels of the canvas by its red, green and blue cut into `bins` equal ranges each."""
    cut = (np.arange(256) * bins >> 8).astype(np.int32)
    return np.bincount(((cut * bins * bins)[canvas[..., 0]] + (cut * bins)[canvas[..., 1]] + cut[canvas[..., 2]]).ravel(), minlength=bins**3)


def timed_frames(gif: bytes, bins: int = BINS) -> Iterator[tuple[int, Frame, np.ndarray]]:
    """Of each frame when it begins to show, in hundredths of a second, the frame, and the histogram of the screen while it shows."""
    start = 0
    for frame in read_gif(gif):
        yield start, frame, histogram(frame.canvas, bins)
        start += frame.delay


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Unpadded length, and the UTF-8 bytes padded with 255 to a positive multiple of 576."""
    raw = (text or "").encode()
    whole = max(1, -(-len(raw) // BLOCK)) * BLOCK
    return len(raw), raw + bytes([PAD]) * (whole - len(raw))


def _measured(raw_len: int, gif: bytes) -> tuple:
    sha, last, size, frames, shown = hashlib.sha256(), b"", 0, 0, 0
    colours = np.zeros(BINS**3, np.int64)
    for start, frame, counts in timed_frames(gif):
        piece = frame.samples.tobytes()
        sha.update(piece)
        last = (last + piece)[-32:]
        size += len(piece)
        frames += 1
        shown = start + frame.delay
        colours += counts
    return (raw_len, size, sha.hexdigest(), zlib.crc32(last), len(gif), hashlib.sha256(gif).hexdigest(), frames, shown, colours.tolist())


_OUT = [
    ("n_bytes", T.LongType(), pa.int64()), ("payload_bytes", T.LongType(), pa.int64()), ("payload_sha256", T.StringType(), pa.string()), ("tail_crc32", T.LongType(), pa.int64()),
    ("media_bytes", T.LongType(), pa.int64()), ("media_sha256", T.StringType(), pa.string()), ("n_frames", T.LongType(), pa.int64()), ("duration_cs", T.LongType(), pa.int64()), ("colours", T.ArrayType(T.LongType()), pa.list_(pa.int64())),
]


def gif_columns(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """doc_id with the figures of each text's stored GIF, read back from its bytes: sizes, hashes, frames, shown time and the summed colour histogram of 64 bins; with keep_media the GIF itself as `media`. One pass, no shuffle."""
    docs = docs.select("doc_id", "text")
    out = [*_OUT, *([("media", T.BinaryType(), pa.binary())] if keep_media else [])]
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(n, t) for n, t, _ in out]])
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                n, payload = payload_of(text)
                gif = write_gif(payload)
                rows.append((*_measured(n, gif), gif))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array([r[i] for r in rows], t) for i, (_, _, t) in enumerate(out)]], ["doc_id", *[n for n, _, _ in out]])

    return docs.mapInArrow(run, schema)


def fault(gif: bytes) -> str | None:
    """What keeps a GIF from being read whole, if anything does."""
    frames = 0
    try:
        for _ in read_gif(gif):
            frames += 1
    except (GifError, IndexError, ValueError, struct.error) as e:
        return str(e) or type(e).__name__
    return None if frames else "no frames"


def frame_rows(media: DataFrame, column: str = "media", bins: int = BINS) -> DataFrame:
    """One row per frame of each GIF: the other columns of `media`, frame, delay_cs, disposal, start_cs, histogram (bins**3 counts), pixels (RGB); a GIF that can't be read whole (cut, broken, without frames, a screen or frame of more than MOST_PIXELS) gives one row with its error. Each is read twice, so that frames can be handed over in lots of bounded bytes."""
    kept = [f for f in media.schema.fields if f.name not in {column, "frame", "delay_cs", "disposal", "start_cs", "histogram", "pixels", "error"}]
    extra = T.StructType.fromDDL("frame int, delay_cs int, disposal int, start_cs long, histogram array<long>, pixels binary, error string")
    media = media.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{column}`"))
    small_batches(media.sparkSession, 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.string()]

        def lot(own: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
            index = pa.array([0] * len(rows), pa.int64())
            return pa.RecordBatch.from_arrays([*[c.take(index) for c in own.columns], *[pa.array([r[j] for r in rows], t) for j, t in enumerate(types)]], [*own.schema.names, *extra.names])

        for batch in batches:
            for i, gif in enumerate(batch.column(column).to_pylist()):
                own = batch.slice(i, 1).select([f.name for f in kept])
                if error := fault(gif or b""):
                    yield lot(own, [(None, None, None, None, None, None, error)])
                    continue
                rows, size = [], 0
                for k, (start, f, counts) in enumerate(timed_frames(gif, bins)):
                    rows.append((k, f.delay, f.disposal, start, counts.tolist(), f.canvas.tobytes(), None))
                    size += f.canvas.nbytes
                    if size > LOT_BYTES:
                        yield lot(own, rows)
                        rows, size = [], 0
                if rows:
                    yield lot(own, rows)

    return media.mapInArrow(run, T.StructType([*kept, *extra.fields]))


def digests(columns: DataFrame) -> DataFrame:
    """The figures with `feature`, the colour histogram, frames and shown time as one text, for comparing rows."""
    feature = F.concat(F.lit("f"), F.col("n_frames"), F.lit(" d"), F.col("duration_cs"), F.lit(" c"), F.array_join("colours", ","))
    return columns.withColumn("feature", feature).drop("n_frames", "duration_cs", "colours")
