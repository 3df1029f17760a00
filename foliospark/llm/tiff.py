"""TIFF as a media column: write and read multi-page images, one row per page.

The reader walks the image directories, decodes PackBits, LZW and deflate strips and tiles of samples of 1, 8 or 16 bits, and undoes
horizontal differencing. The writer makes all of these, so that payloads can be stored and checked without loss.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.common import map_columns, read_table

# Fixed values of the format: compression and predictor codes, and the byte sizes of field types
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
NO_PREDICTOR, HORIZONTAL = 1, 2
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
CLEAR, END = 256, 257

#: Bytes that a stored payload is a multiple of; it has rows of a quarter of these, so that there is one for each coding; rows of a page at most.
UNIT = 576
ROW = UNIT // 4
PAGE_ROWS = 256
#: Bytes that a page may have when it is read, by default; a larger one is an error, as is one that its strips or tiles can't hold.
#: Reading takes about four times as many.
MOST_BYTES = 1 << 27
#: The fields that are read: size, sample bits, coding, fill order, starts and sizes of strips and tiles, samples, planes, predictor.
READ = frozenset((256, 257, 258, 259, 266, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325))
#: Bytes that one stored byte can stand for at most, by the coding's own rules.
GROWTH = {NONE: 1, LZW: 4096, DEFLATE: 1032, OLD_DEFLATE: 1032, PACKBITS: 64}


class TiffError(ValueError):
    """The bytes aren't an image file that this reader understands."""


@dataclass(frozen=True)
class Page:
    """pixels: rows from the top, samples of a pixel side by side: a byte each, 0 or 1 for samples of 1 bit; two, the low one
    first, for samples of 16 bits."""

    width: int
    height: int
    samples: int
    compression: int
    predictor: int
    tiled: bool
    pixels: bytes
    bits: int = 8


_RUN = re.compile(rb"(.)\1{2,127}", re.DOTALL)


def pack_bits(data: bytes, row: int = 0) -> bytes:
    """Runs and literals; none goes beyond the end of a row of so many bytes."""
    if row and len(data) > row:
        return b"".join(pack_bits(data[at : at + row]) for at in range(0, len(data), row))
    out = bytearray()

    def literal(start: int, stop: int) -> None:
        for at in range(start, stop, 128):
            piece = data[at : min(at + 128, stop)]
            out.append(len(piece) - 1)
            out.extend(piece)

    done = 0
    for run in _RUN.finditer(data):
        literal(done, run.start())
        done = run.end()
        out.append(257 - (done - run.start()))
        out.append(data[run.start()])
    literal(done, len(data))
    return bytes(out)


def unpack_bits(data: bytes, size: int) -> bytes:
    out, at, n = bytearray(), 0, len(data)
    while len(out) < size and at < n:
        count = data[at]
        if count < 128:
            out += data[at + 1 : at + 2 + count]
            at += 2 + count
        elif count > 128:
            out += data[at + 1 : at + 2] * (257 - count)
            at += 2
        else:
            at += 1
    return bytes(out)


def _width(known: np.ndarray) -> np.ndarray:
    """Bits of a code that is written or read when so many codes stand behind the last clearing: one longer a code early."""
    return 9 + (known >= 254).astype(np.int64) + (known >= 766) + (known >= 1790)


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first, one bit longer a code early, as the format wants them."""
    codes = [CLEAR]
    write = codes.append
    table: dict[int, int] = {}
    free = 258
    if data:
        prefix = data[0]
        for byte in memoryview(data)[1:]:
            key = prefix << 8 | byte
            if key in table:
                prefix = table[key]
                continue
            write(prefix)
            table[key] = free
            free += 1
            prefix = byte
            if free == 4095:  # the last code of 12 bits is never given out
                write(CLEAR)
                table, free = {}, 258
        write(prefix)
    write(END)
    wide = np.array(codes)
    place = np.arange(len(wide))
    cleared = np.maximum.accumulate(np.where(wide == CLEAR, place, 0))
    cleared[1:] = cleared[:-1].copy()  # a clearing code itself belongs to what it ends
    places = _width(np.maximum(0, place - cleared - 1))[:, None]
    column = np.arange(12)
    bits = (wide[:, None] >> np.maximum(places - 1 - column, 0)) & 1
    return np.packbits(bits[column < places].astype(np.uint8)).tobytes()


#: Where the codes after a clearing begin, in bits; a file that never clears again goes on with codes of 12.
_AT = np.concatenate([[0], np.cumsum(_width(np.arange(4096)))])
_SINGLE = [bytes([i]) for i in range(256)] + [b"", b""]


def lzw_decode(data: bytes, size: int) -> bytes:
    padded = np.frombuffer(data + bytes(4), np.uint8).astype(np.int64)
    whole, start, made, out = 8 * len(data), 0, 0, []
    while made < size:
        # all codes up to the next clearing, as if there were none before the table is full
        at = start + _AT[:-1]
        wide = np.diff(_AT)
        there = int(np.count_nonzero(at + wide <= whole))
        at, wide = at[:there], wide[:there]
        byte = at >> 3
        codes = ((padded[byte] << 16 | padded[byte + 1] << 8 | padded[byte + 2]) >> (24 - (at & 7) - wide)) & ((1 << wide) - 1)
        special = np.flatnonzero((codes == CLEAR) | (codes == END))
        ended = int(special[0]) if len(special) else there
        own = codes[:ended].tolist()
        if own and own[0] > 255:
            raise TiffError("bad LZW code")
        table, known, parts = list(_SINGLE), 258, []
        learn, write = table.append, parts.append
        if own:
            previous = table[own[0]]
            write(previous)
        for code in own[1:]:
            if code < known:
                entry = table[code]
            elif code == known:
                entry = previous + previous[:1]
            else:
                if made + sum(map(len, parts)) < size:
                    raise TiffError("bad LZW code")
                break
            learn(previous + entry[:1])
            known += 1
            write(entry)
            previous = entry
        out.append(b"".join(parts))
        made += len(out[-1])
        if not len(special) or codes[ended] == END:
            break
        start += int(_AT[ended + 1])
    return b"".join(out)


def _squeeze(data: bytes, compression: int, row: int) -> bytes:
    if compression == LZW:
        return lzw_encode(data)
    if compression == PACKBITS:
        return pack_bits(data, row)
    return zlib.compress(data, 6) if compression in (DEFLATE, OLD_DEFLATE) else data


def _restore(data: bytes, compression: int, size: int) -> bytes:
    if compression == LZW:
        out = lzw_decode(data, size)
    elif compression == PACKBITS:
        out = unpack_bits(data, size)
    elif compression in (DEFLATE, OLD_DEFLATE):
        try:
            out = zlib.decompressobj().decompress(data, size)
        except zlib.error as error:
            raise TiffError(str(error)) from error
    else:
        out = data
    if len(out) < size:
        raise TiffError("a strip or tile is too short")
    return out[:size]


@dataclass(frozen=True)
class Layout:
    """How a page is stored: strips of `rows` rows, or tiles of `rows` x `columns` where columns is set."""

    compression: int = DEFLATE
    predictor: int = NO_PREDICTOR
    rows: int = 16
    columns: int = 0


def write_tiff(pages: list[tuple[np.ndarray, Layout]]) -> bytes:
    """A little-endian file of pages: arrays of shape (height, width) or (height, width, samples), of uint8, uint16 or, for samples
    of 1 bit, bool."""
    out = bytearray(struct.pack("<2sHI", b"II", 42, 8))
    link = 4
    for image, layout in pages:
        image = image if image.ndim == 3 else image[:, :, None]
        height, width, samples = image.shape
        bits = 1 if image.dtype == bool else 8 * image.dtype.itemsize
        if bits == 1 and layout.predictor == HORIZONTAL:
            raise ValueError("samples of 1 bit have no predictor")
        columns = layout.columns or width
        blocks = []
        for y in range(0, height, layout.rows):
            for x in range(0, width, columns):
                block = image[y : y + layout.rows, x : x + columns]
                if layout.columns and block.shape[:2] != (layout.rows, columns):  # tiles are whole, strips end with the image
                    part, block = block, np.zeros((layout.rows, columns, samples), image.dtype)
                    block[: part.shape[0], : part.shape[1]] = part
                if layout.predictor == HORIZONTAL:
                    block = block.copy()
                    block[:, 1:] -= block[:, :-1].copy()
                lines = block.reshape(len(block), -1)
                stored = np.packbits(lines, axis=1) if bits == 1 else lines.astype(f"<u{bits // 8}")
                blocks.append(_squeeze(stored.tobytes(), layout.compression, stored.strides[0]))
        starts = []
        for block in blocks:
            starts.append(len(out))
            out += block
        out += b"\0" * (len(out) % 2)

        def array(values: list[int]) -> int:
            if len(values) == 1:
                return values[0]
            at = len(out)
            out.extend(struct.pack(f"<{len(values)}I", *values))
            return at

        n = len(blocks)
        at_starts, at_sizes = array(starts), array([len(b) for b in blocks])
        fields = {256: (4, 1, width), 257: (4, 1, height), 258: (3, 1, bits), 259: (3, 1, layout.compression), 262: (3, 1, 1 if samples < 3 else 2), 277: (3, 1, samples), 284: (3, 1, 1), 317: (3, 1, layout.predictor)}
        if samples > 2:
            at = len(out)
            out.extend(struct.pack(f"<{samples}H", *[bits] * samples))
            fields[258] = (3, samples, at)
        elif samples == 2:
            fields[258] = (3, 2, bits | bits << 16)
        if layout.columns:
            fields |= {322: (4, 1, columns), 323: (4, 1, layout.rows), 324: (4, n, at_starts), 325: (4, n, at_sizes)}
        else:
            fields |= {273: (4, n, at_starts), 278: (4, 1, layout.rows), 279: (4, n, at_sizes)}
        out += b"\0" * (len(out) % 2)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields))
        for tag, (kind, count, value) in sorted(fields.items()):
            out += struct.pack("<HHI", tag, kind, count) + (struct.pack("<HH", value & 0xFFFF, value >> 16) if kind == 3 and count <= 2 else struct.pack("<I", value))
        link = len(out)
        out += struct.pack("<I", 0)
    return bytes(out)


def read_pages(data: bytes, most_bytes: int = MOST_BYTES) -> Iterator[Page]:
    """The pages of a file in the order of its directories. Raises TiffError for what isn't readable, and for a page of more than
    most_bytes. Of a field that a directory has twice, the first counts; those that aren't needed aren't read."""
    if len(data) < 8 or data[:2] not in (b"II", b"MM"):
        raise TiffError("no TIFF header")
    order = "<" if data[:2] == b"II" else ">"

    def take(form: str, at: int) -> tuple:
        try:
            return struct.unpack_from(order + form, data, at)
        except struct.error as error:
            raise TiffError("it ends too early") from error

    if take("H", 2)[0] != 42:
        raise TiffError("no TIFF header")
    at, seen = take("I", 4)[0], set()
    while at:
        if at in seen:
            raise TiffError("its directories run in a circle")
        seen.add(at)
        count = take("H", at)[0]
        fields: dict[int, list[int]] = {}
        for entry in range(at + 2, at + 2 + 12 * count, 12):
            tag, kind, n = take("HHI", entry)
            size = TYPE_SIZE.get(kind, 0) * n
            if size > len(data) + 4:
                raise TiffError("it ends too early")
            if tag in READ and tag not in fields and kind in (1, 3, 4) and size:
                place = entry + 8 if size <= 4 else take("I", entry + 8)[0]
                fields[tag] = list(take(f"{n}{' B HI'[kind]}", place))
        yield _page(data, fields, order, most_bytes)
        at = take("I", at + 2 + 12 * count)[0]


def _page(data: bytes, fields: dict[int, list[int]], order: str, most_bytes: int) -> Page:
    one = lambda tag, default: fields.get(tag, [default])[0]
    width, height, samples = one(256, 0), one(257, 0), one(277, 1)
    compression, predictor, tiled = one(259, NONE), one(317, NO_PREDICTOR), 324 in fields
    if not samples:
        raise TiffError("no samples")
    if not width or not height:
        raise TiffError("a page without a size")
    bits = one(258, 1)
    if bits not in (1, 8, 16) or set(fields.get(258, [1])) != {bits}:
        raise TiffError("only samples of 1, 8 or 16 bits are read")
    if predictor not in (NO_PREDICTOR, HORIZONTAL) or bits == 1 and predictor == HORIZONTAL:
        raise TiffError(f"predictor {predictor}")
    if one(266, 1) != 1:
        raise TiffError("bits in reverse order aren't read")
    if one(284, 1) != 1 and samples > 1:
        raise TiffError("samples in separate planes aren't read")
    if compression not in GROWTH:
        raise TiffError(f"compression {compression}")
    columns, rows = (one(322, 0), one(323, 0)) if tiled else (width, min(one(278, height), height))
    if not columns or not rows:
        raise TiffError("tiles or strips without a size")
    starts, sizes = (fields.get(t, []) for t in ((324, 325) if tiled else (273, 279)))
    across = -(-width // columns)
    blocks = across * -(-height // rows)
    if len(starts) < blocks or len(sizes) < blocks:
        raise TiffError("strips or tiles are missing")
    held = sum(max(0, min(size, len(data) - start)) for start, size in zip(starts[:blocks], sizes[:blocks]))
    line = -(-columns * samples * bits // 8)
    if max(-(-width * samples * bits // 8) * height, line * rows) > held * GROWTH[compression]:
        raise TiffError("its strips or tiles can't hold a page of this size")
    wide = max(1, bits // 8)
    if max(width * height, columns * rows) * samples * wide > most_bytes:
        raise TiffError(f"a page of more than {most_bytes} bytes")
    image = np.zeros((height, width, samples), f"<u{wide}")
    for k in range(blocks):
        y, x = k // across * rows, k % across * columns
        tall = rows if tiled else min(rows, height - y)
        raw = _restore(data[starts[k] : starts[k] + sizes[k]], compression, tall * line)
        if bits == 1:
            block = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(tall, line), axis=1, count=columns * samples)
        else:
            block = np.frombuffer(raw, f"{order}u{wide}")
        block = block.reshape(tall, columns, samples)
        if predictor == HORIZONTAL:
            block = np.cumsum(block, axis=1, dtype=image.dtype)
        piece = image[y : y + tall, x : x + columns]
        piece[:] = block[: piece.shape[0], : piece.shape[1]]
    return Page(width, height, samples, compression, predictor, tiled, image.tobytes(), bits)


PAGE_FIELDS = "page int, width int, height int, samples int, bits int, compression int, predictor int, tiled boolean, pixels binary, error string"


def page_rows(files: DataFrame, content: str = "content", key: str = "doc_id", most_bytes: int = MOST_BYTES) -> DataFrame:
    """One row per page: key (as a column of that name), page (from 0), size, coding, pixels (see Page) and error.

    A key named like one of the others comes back with `_key` added. A file that can't be read gives the pages before the fault,
    and then a row whose error says what was wrong and whose other fields are null; so do null and empty content, a page of more
    than most_bytes, and one that its task has no memory for. Repeated rows are read again each; other columns aren't kept.
    """
    added = T._parse_datatype_string(PAGE_FIELDS).fields
    named = f"{key}_key" if key in {f.name for f in added} else key
    schema = T.StructType([T.StructField(named, files.schema[key].dataType), *added])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1)):
                n = 0
                try:
                    for n, p in enumerate(read_pages(data.as_py() or b"", most_bytes), 1):
                        yield row(name, [n - 1, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, p.tiled, p.pixels, None])
                except TiffError as error:
                    yield row(name, [n, *[None] * 8, str(error)])
                except MemoryError:
                    yield row(name, [n, *[None] * 8, "there is no memory for the page"])

    def row(name, values):
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip([name.as_py(), *values], arrow)], schema=arrow)

    return files.select(F.col(f"`{key}`").alias("k"), F.col(f"`{content}`").alias("c")).mapInArrow(run, schema)


def pad(text: str) -> bytes:
    """UTF-8 with bytes 255 up to a positive multiple of UNIT."""
    raw = text.encode()
    return raw + b"\xff" * (-len(raw) % UNIT if raw else UNIT)


#: The codings that pages of a stored payload take in turn.
CODINGS = (Layout(LZW, rows=64), Layout(DEFLATE, HORIZONTAL, rows=64, columns=48), Layout(PACKBITS, rows=64), Layout(DEFLATE, rows=128))


def store(payload: bytes) -> bytes:
    """The file of a payload: pages of about the same number of rows, each in the next coding, as many of each coding."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    rows = len(image)
    n = len(CODINGS) * -(-rows // (len(CODINGS) * PAGE_ROWS))
    return write_tiff([(image[rows * k // n : rows * (k + 1) // n], CODINGS[k % len(CODINGS)]) for k in range(n)])


def feature(pages: list[Page]) -> str:
    """Pages, mean, spread and entropy of the samples, and the shares of four brightness ranges."""
    counts = np.zeros(256, np.int64)
    for page in pages:
        counts += np.bincount(np.frombuffer(page.pixels, np.uint8), minlength=256)
    n, level = max(1, counts.sum()), np.arange(256)
    mean = (counts * level).sum() / n
    p = counts[counts > 0] / n
    ranges = ",".join(f"{x:.4f}" for x in counts.reshape(4, 64).sum(1) / n)
    return f"pages={len(pages)};mean={mean:.4f};sd={np.sqrt((counts * (level - mean) ** 2).sum() / n):.4f};entropy={-(p * np.log2(p)).sum():.4f};ranges={ranges}"


FIELDS = [T.StructField("n_bytes", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType()), T.StructField("pages", T.IntegerType())]


def stored_digests(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Stores every whole text as a TIFF file, reads the file back, and adds digests of what was read.

    A null text counts as empty: one row of 576 bytes 255. Repeated rows stay and get equal values; input columns named
    like an added one are replaced. An empty table gives an empty table.
    """

    def work(texts):
        out = []
        for t in texts:
            raw = pad(t or "")
            media = store(raw)
            pages = list(read_pages(media))
            back = b"".join(p.pixels for p in pages)
            out.append((len((t or "").encode()), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(pages), len(pages)))
        return list(zip(*out)) if out else [[] for _ in FIELDS]

    return map_columns(docs, [text], FIELDS, work, keep)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and digests of every document's stored form."""
    return stored_digests(read_table(spark, sf_dir, "documents", "doc_id", "text"), keep=["doc_id"])
