"""TIFF files in binary columns: writing grey 8-bit pages, and reading pages of strips or tiles.

The reader walks the chain of image directories of either byte order, decodes uncompressed, PackBits,
LZW and deflate data, undoes the horizontal predictor, and yields one row for each page.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import small_batches

# Fixed values of the TIFF 6.0 format.
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_BYTES = 284, 317, 322, 323, 324, 325
FIELD_TYPES = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}
CLEAR, END = 256, 257

ROW_BYTES = 64
PAGE_ROWS = 1 << 16
STRIP_ROWS = 1 << 12


class Page(NamedTuple):
    width: int
    height: int
    samples: np.ndarray  # height x (width * samples for a pixel), 8 bits each
    compression: int
    predictor: int


# --- compression -------------------------------------------------------------------------------------------------


def packbits(raw: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(raw)
    while i < n:
        j = i + 1
        while j < n and j - i < 128 and raw[j] == raw[i]:
            j += 1
        if j - i > 1:
            out += bytes([257 - (j - i), raw[i]])
            i = j
            continue
        while j < n and j - i < 128 and not (j + 1 < n and raw[j] == raw[j + 1]):
            j += 1
        out += bytes([j - i - 1]) + raw[i:j]
        i = j
    return bytes(out)


def unpackbits(raw: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(raw)
    while i < n:
        head = raw[i]
        if head < 128:
            out += raw[i + 1 : i + 2 + head]
            i += head + 2
        elif head > 128:
            out += raw[i + 1 : i + 2] * (257 - head)
            i += 2
        else:
            i += 1
    return bytes(out)


def lzw(raw: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first; a code grows one entry early, as the format has it."""
    bits = size = 0
    out = bytearray()

    def put(code: int, width: int) -> None:
        nonlocal bits, size
        bits, size = bits << width | code, size + width
        while size >= 8:
            size -= 8
            out.append(bits >> size & 255)
        bits &= (1 << size) - 1

    put(CLEAR, 9)
    table, free, prefix = {}, 258, -1
    for byte in raw:
        if prefix < 0:
            prefix = byte
        elif (known := table.get((prefix, byte))) is not None:
            prefix = known
        else:
            put(prefix, _width(free))
            table[prefix, byte] = free
            free += 1
            prefix = byte
            if free == 4094:
                put(CLEAR, 12)
                table, free = {}, 258
    if prefix >= 0:
        put(prefix, _width(free))
        free += 1
    put(END, _width(free))
    if size:
        put(0, 8 - size)
    return bytes(out)


def _width(free: int) -> int:
    return 9 if free < 511 else 10 if free < 1023 else 11 if free < 2047 else 12


def unlzw(raw: bytes) -> bytes:
    out, at, total = [], 0, 8 * len(raw)
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    table, last, width = base.copy(), b"", 9
    while at + width <= total:
        code = int.from_bytes(raw[at >> 3 : (at >> 3) + 4].ljust(4, b"\0"), "big") >> 32 - width - (at & 7) & (1 << width) - 1
        at += width
        if code == END:
            break
        if code == CLEAR:
            table, last, width = base.copy(), b"", 9
            continue
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last:
            entry = last + last[:1]
        else:
            raise ValueError("an LZW code has no entry")
        out.append(entry)
        if last:
            table.append(last + entry[:1])
        last = entry
        width = _width(len(table) + 1)
    return b"".join(out)


_PACK = {NONE: bytes, LZW: lzw, DEFLATE: lambda raw: zlib.compress(raw, 1), PACKBITS: packbits}
_UNPACK = {NONE: bytes, LZW: unlzw, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress, PACKBITS: unpackbits}


# --- files -------------------------------------------------------------------------------------------------------


def write(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, strip_rows: int = STRIP_ROWS, tile: tuple[int, int] | None = None, order: str = "<") -> bytes:
    """A file of grey 8-bit pages.  tile: (width, height) of tiles, which take the place of strips; order: < or >."""
    out = bytearray(struct.pack(f"{order}2sHI", b"II" if order == "<" else b"MM", 42, 0))
    link = 4
    for page in pages:
        height, width = page.shape
        if tile:
            wide, high = tile
            padded = np.zeros((-(-height // high) * high, -(-width // wide) * wide), np.uint8)
            padded[:height, :width] = page
            blocks = [padded[y : y + high, x : x + wide] for y in range(0, padded.shape[0], high) for x in range(0, padded.shape[1], wide)]
        else:
            blocks = [page[y : y + strip_rows] for y in range(0, height, strip_rows)]
        offsets, sizes = [], []
        for block in blocks:
            if predictor == 2:
                block = np.concatenate([block[:, :1], block[:, 1:] - block[:, :-1]], axis=1)
            raw = _PACK[compression](block.tobytes())
            offsets.append(len(out))
            sizes.append(len(raw))
            out += raw
        fields = {WIDTH: (4, [width]), LENGTH: (4, [height]), BITS: (3, [8]), COMPRESSION: (3, [compression]), PHOTOMETRIC: (3, [1]), SAMPLES: (3, [1]), PREDICTOR: (3, [predictor])}
        if tile:
            fields |= {TILE_WIDTH: (4, [tile[0]]), TILE_LENGTH: (4, [tile[1]]), TILE_OFFSETS: (4, offsets), TILE_BYTES: (4, sizes)}
        else:
            fields |= {ROWS_PER_STRIP: (4, [strip_rows]), STRIP_OFFSETS: (4, offsets), STRIP_BYTES: (4, sizes)}
        entries = b""
        for tag, (kind, values) in sorted(fields.items()):
            body = struct.pack(f"{order}{len(values)}{FIELD_TYPES[kind]}", *values)
            if len(body) > 4:
                out += b"\0" * (len(out) % 2)
                body, at = struct.pack(f"{order}I", len(out)), body
                out += at
            entries += struct.pack(f"{order}HHI", tag, kind, len(values)) + body.ljust(4, b"\0")
        out += b"\0" * (len(out) % 2)
        struct.pack_into(f"{order}I", out, link, len(out))
        out += struct.pack(f"{order}H", len(fields)) + entries
        link = len(out)
        out += b"\0" * 4
    return bytes(out)


#: Samples of a page at most: what a task can hold.  A larger one is a fault of the file.
MOST_SAMPLES = 1 << 30


def _directory(raw: bytes, at: int, order: str) -> tuple[dict[int, list[int]], int]:
    (count,) = struct.unpack_from(f"{order}H", raw, at)
    fields = {}
    for i in range(count):
        tag, kind, n = struct.unpack_from(f"{order}HHI", raw, at + 2 + 12 * i)
        if kind in FIELD_TYPES:
            form = f"{order}{n}{FIELD_TYPES[kind]}"
            place = at + 10 + 12 * i
            if struct.calcsize(form) > 4:
                (place,) = struct.unpack_from(f"{order}I", raw, place)
            fields[tag] = list(struct.unpack_from(form, raw, place))
    return fields, struct.unpack_from(f"{order}I", raw, at + 2 + 12 * count)[0]


def read(raw: bytes) -> Iterator[Page]:
    """The pages of a file, in the order of its directories.  ValueError at what is faulty, or if it is no such file."""
    try:
        yield from _read(raw)
    except (struct.error, zlib.error, IndexError, TypeError, KeyError, OverflowError, MemoryError) as e:
        raise ValueError(f"a faulty file: {e}") from e


def _read(raw: bytes) -> Iterator[Page]:
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or len(raw) < 8 or struct.unpack_from(f"{order}H", raw, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack_from(f"{order}I", raw, 4)
    seen = set()
    while at:
        if at in seen:
            raise ValueError("the chain of directories returns to itself")
        seen.add(at)
        fields, at = _directory(raw, at, order)
        yield _page(raw, fields)


def _page(raw: bytes, fields: dict[int, list[int]]) -> Page:
    one = lambda tag, default=None: fields.get(tag, [default])[0]
    width, height, compression, predictor, samples = one(WIDTH), one(LENGTH), one(COMPRESSION, NONE), one(PREDICTOR, 1), one(SAMPLES, 1)
    if set(fields.get(BITS, [1])) != {8} or compression not in _UNPACK or predictor not in (1, 2) or one(PLANAR, 1) != 1:
        raise ValueError("pages must have interleaved 8-bit samples and a known compression and predictor")
    tiled = TILE_OFFSETS in fields
    wide = one(TILE_WIDTH) if tiled else width
    high = one(TILE_LENGTH) if tiled else min(one(ROWS_PER_STRIP, height), height) or 1
    across = -(-width // wide) if wide else 0
    if width * height * samples > MOST_SAMPLES or width < 0 or height < 0:
        raise ValueError("a page is too large")
    image = np.zeros((height, width * samples), np.uint8)
    for i, (offset, size) in enumerate(zip(fields.get(TILE_OFFSETS if tiled else STRIP_OFFSETS, []), fields.get(TILE_BYTES if tiled else STRIP_BYTES, []), strict=True)):
        y, x = i // across * high, i % across * wide
        rows = high if tiled else min(high, height - y)
        block = np.frombuffer(_UNPACK[compression](raw[offset : offset + size]), np.uint8, count=rows * wide * samples).reshape(rows, wide, samples)
        if predictor == 2:
            block = block.cumsum(axis=1, dtype=np.uint8)
        part = block.reshape(rows, wide * samples)[: height - y, : (width - x) * samples]
        image[y : y + part.shape[0], x * samples : x * samples + part.shape[1]] = part
    return Page(width, height, image, compression, predictor)


# --- columns -----------------------------------------------------------------------------------------------------

_PAGES = "id long, page int, width int, height int, compression int, predictor int, samples binary, error string"
_PAGES_ARROW = pa.schema([("id", pa.int64()), ("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("compression", pa.int32()), ("predictor", pa.int32()), ("samples", pa.binary()), ("error", pa.string())])
_STORED = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_STORED_ARROW = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def text_file(text: str | None) -> tuple[int, bytes]:
    """UTF-8 bytes of a text, and the file that holds them, padded by zeros to rows of ROW_BYTES (one row at least)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    grid = np.frombuffer(raw.ljust(max(1, -(-len(raw) // ROW_BYTES)) * ROW_BYTES, b"\0"), np.uint8).reshape(-1, ROW_BYTES)
    return len(raw), write([grid[y : y + PAGE_ROWS] for y in range(0, len(grid), PAGE_ROWS)])


def feature(pages: list[Page]) -> str:
    """Pages, rows, mean, standard deviation and the share of each eighth of the grey scale."""
    counts = sum((np.bincount(p.samples.ravel(), minlength=256) for p in pages), np.zeros(256, np.int64))
    total = max(1, int(counts.sum()))
    mean = float(counts @ np.arange(256)) / total
    spread = (float(counts @ (np.arange(256) - mean) ** 2) / total) ** 0.5
    shares = ",".join(f"{x / total:.4f}" for x in counts.reshape(8, 32).sum(axis=1))
    return f"pages={len(pages)};rows={sum(p.height for p in pages)};mean={mean:.4f};sd={spread:.4f};shares={shares}"


def _read_column(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if not raw.is_valid:
                continue
            rows = []
            try:
                for p in read(raw.as_py()):
                    rows.append([key, len(rows), p.width, p.height, p.compression, p.predictor, p.samples.tobytes(), None])
            except ValueError as e:
                rows.append([key, len(rows), None, None, None, None, None, str(e)])
            if rows:
                yield pa.record_batch([pa.array(list(x), t.type) for x, t in zip(zip(*rows, strict=True), _PAGES_ARROW, strict=True)], schema=_PAGES_ARROW)


def pages(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row for each page of the files in a binary column: its place, size, and 8-bit samples, row by row.

    A null file has no pages.  Where a file is faulty, or none at all, there is a row with the fault in `error`
    and nulls in place of the page; pages before it stand, and pages after it aren't reached.
    """
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).cast("binary").alias("media")).mapInArrow(_read_column, _PAGES)


def _write_column(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            made = [text_file(text.as_py()) for text in part.column(1)]
            yield pa.record_batch([part.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array([m for _, m in made], pa.binary())], names=["id", "n_bytes", "media"])


def text_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text as a file of grey pages; a null text is empty, and is one row of zeros."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_write_column, "id long, n_bytes long, media binary")


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    for batch in _write_column(batches):
        rows = []
        for key, n, media in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = list(read(media))
            payload = b"".join(p.samples.tobytes() for p in found)
            rows.append([key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(found)])
        yield pa.record_batch([pa.array(list(x), t.type) for x, t in zip(zip(*rows, strict=True), _STORED_ARROW, strict=True)], schema=_STORED_ARROW)


def described_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text as `text_files` does, reads the file's pages back, and returns their digests and feature.

    One row for each row of docs, in one pass and without a shuffle; equal texts give equal values; a null
    text is empty, a null id stays null, extra columns are ignored, an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_described, _STORED)
