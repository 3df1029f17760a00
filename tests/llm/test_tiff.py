import hashlib
import os
import random
import struct
import time
import zlib

import numpy as np
import pytest

from foliospark.llm import tiff as T

rng = random.Random(6)
SAMPLES = [b"", b"a", os.urandom(700), bytes(rng.choice(b"ab") for _ in range(9000)), b"z" * 5000, bytes(range(256)) * 40, os.urandom(60_000)]


@pytest.mark.parametrize("data", SAMPLES, ids=range(len(SAMPLES)))
def test_codings_come_back(data):
    assert T.lzw_decode(T.lzw_encode(data), len(data)) == data
    assert T.unpack_bits(T.pack_bits(data), len(data)) == data


def decoded_by_the_book(data):
    """LZW as the format's text has it: bits from the high end, and wider codes as soon as entries 510, 1022 and 2046 exist."""
    bits = "".join(f"{b:08b}" for b in data)
    at, width, table, out, old = 0, 9, {}, b"", None
    while True:
        code, at = int(bits[at : at + width], 2), at + width
        if code == 257:
            return out
        if code == 256:
            table, width, old = {i: bytes([i]) for i in range(256)} | {256: b"", 257: b""}, 9, None
            continue
        if old is not None:
            table[len(table)] = table[old] + (table[code] if code in table else table[old])[:1]
            width = 9 + (len(table) > 510) + (len(table) > 1022) + (len(table) > 2046)
        assert len(table) <= 4096
        out += table[code]
        old = code


def encoded_by_the_book(data):
    table, bits, omega, width = {bytes([i]): i for i in range(256)} | {-1: 256, -2: 257}, f"{256:09b}", b"", 9
    for i in range(len(data)):
        k = data[i : i + 1]
        if omega + k in table:
            omega += k
            continue
        bits += f"{table[omega]:0{width}b}"
        table[omega + k] = len(table)
        omega = k
        last = len(table) - 1
        width = 9 + (last >= 511) + (last >= 1023) + (last >= 2047)
        if last == 4094:
            bits += f"{256:012b}"
            table, width = {bytes([i]): i for i in range(256)} | {-1: 256, -2: 257}, 9
    if omega:
        bits += f"{table[omega]:0{width}b}"
        width = 9 + (len(table) >= 511) + (len(table) >= 1023) + (len(table) >= 2047)
    bits += f"{257:0{width}b}"
    return bytes(int((bits + "0" * 7)[i : i + 8], 2) for i in range(0, len(bits), 8))


def test_lzw_by_the_book():
    # the example of a published format that has the same codes
    assert T.lzw_encode(bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])) == bytes.fromhex("800B6050220C0C8501")
    noise = np.random.default_rng(4).integers(0, 256, 9000, np.uint8).tobytes()
    # lengths at which the tables reach the borders of 9, 10, 11 and 12 bits, and the one that clears them
    for n in [*range(250, 260), *range(762, 772), *range(1786, 1796), *range(3832, 3844), 9000]:
        data = noise[:n]
        assert T.lzw_encode(data) == encoded_by_the_book(data), n
        assert decoded_by_the_book(T.lzw_encode(data)) == T.lzw_decode(encoded_by_the_book(data), n) == data
    for data in SAMPLES[:6]:
        assert T.lzw_encode(data) == encoded_by_the_book(data) and decoded_by_the_book(T.lzw_encode(data)) == data


def test_known_codes():
    assert T.unpack_bits(bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA"), 24) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")


@pytest.mark.parametrize("compression", [T.NONE, T.LZW, T.DEFLATE, T.OLD_DEFLATE, T.PACKBITS])
@pytest.mark.parametrize("predictor", [T.NO_PREDICTOR, T.HORIZONTAL])
@pytest.mark.parametrize("columns", [0, 32])
@pytest.mark.parametrize("samples", [1, 2, 3])
def test_pages_come_back(compression, predictor, columns, samples):
    image = np.random.default_rng(samples).integers(0, 256, (37, 50, samples), np.uint8)
    image[5:20] = 9
    (page,) = T.read_pages(T.write_tiff([(image, T.Layout(compression, predictor, 16, columns))]))
    assert (page.width, page.height, page.samples, page.tiled) == (50, 37, samples, bool(columns)) and page.pixels == image.tobytes()


def test_big_endian_and_foreign_fields():
    body = b"abcdef"
    entries = [(256, 3, 1, struct.pack(">HH", 3, 0)), (257, 3, 1, struct.pack(">HH", 2, 0)), (258, 3, 1, struct.pack(">HH", 8, 0)), (259, 3, 1, struct.pack(">HH", 1, 0)), (273, 4, 1, struct.pack(">I", 8)), (279, 4, 1, struct.pack(">I", 6)), (305, 2, 4, b"abc\0")]
    data = struct.pack(">2sHI", b"MM", 42, 14) + body + struct.pack(">H", len(entries)) + b"".join(struct.pack(">HHI", t, k, n) + v for t, k, n, v in entries) + struct.pack(">I", 0)
    (page,) = T.read_pages(data)
    assert page.pixels == body and (page.width, page.height) == (3, 2)


@pytest.mark.parametrize("data", [b"", b"GIF89a", b"II*\0\xff\xff\xff\xff", T.store(T.pad("x" * 5000))[:-40], T.store(T.pad("".join(map(str, range(20_000)))))[:3000]])
def test_broken_files_say_so(data):
    with pytest.raises(T.TiffError):
        list(T.read_pages(data))


def test_directories_in_a_circle():
    data = bytearray(T.write_tiff([(np.zeros((2, 2), np.uint8), T.Layout())]))
    data[-4:] = data[4:8]
    with pytest.raises(T.TiffError, match="circle"):
        list(T.read_pages(bytes(data)))


@pytest.mark.parametrize("text", ["", "a", "x" * 576, "y" * 577, "Grüße\n" * 900, "".join(map(chr, range(32, 20_000)))])
def test_payloads_are_kept_in_all_codings(text):
    payload = T.pad(text)
    assert len(payload) % 576 == 0 and payload and payload.rstrip(b"\xff") == text.encode().rstrip(b"\xff")
    pages = list(T.read_pages(T.store(payload)))
    assert b"".join(p.pixels for p in pages) == payload and all(p.height <= T.PAGE_ROWS for p in pages)
    used = {(p.compression, p.predictor, p.tiled) for p in pages}
    assert len(used) == 4 and {c for c, _, _ in used} == {T.LZW, T.DEFLATE, T.PACKBITS} and len(pages) % 4 == 0


def test_every_document_meets_every_coding(spark):
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect():
        used = {(p.compression, p.predictor, p.tiled) for p in T.read_pages(T.store(T.pad(r.text or "")))}
        assert len(used) == 4


@pytest.mark.parametrize("compression", [T.NONE, T.LZW, T.DEFLATE, T.PACKBITS])
@pytest.mark.parametrize("columns", [0, 32])
@pytest.mark.parametrize("samples", [1, 3])
def test_samples_of_one_and_of_sixteen_bits(compression, columns, samples):
    noise = np.random.default_rng(samples)
    bits, deep = noise.integers(0, 2, (37, 50, samples)).astype(bool), noise.integers(0, 1 << 16, (37, 50, samples), np.uint16)
    pages = list(T.read_pages(T.write_tiff([(bits, T.Layout(compression, rows=16, columns=columns)), (deep, T.Layout(compression, T.HORIZONTAL, 16, columns)), (deep, T.Layout(compression, rows=16, columns=columns))])))
    assert [p.bits for p in pages] == [1, 16, 16]
    assert pages[0].pixels == bits.astype(np.uint8).tobytes() and pages[1].pixels == pages[2].pixels == deep.astype("<u2").tobytes()


def test_deep_samples_high_byte_first():
    entries = [(256, 3), (257, 2), (258, 16), (259, 1), (273, 8), (279, 12)]
    body = b"".join(struct.pack(">H", v) for v in (1, 2, 300, 4, 5, 65535))
    data = struct.pack(">2sHI", b"MM", 42, 20) + body + struct.pack(">H", len(entries)) + b"".join(struct.pack(">HHII", t, 4, 1, v) for t, v in entries) + bytes(4)
    (page,) = T.read_pages(data)
    assert np.frombuffer(page.pixels, "<u2").tolist() == [1, 2, 300, 4, 5, 65535]


def test_packed_rows_end_with_their_row():
    rows = [bytes(20), b"ab" * 10, bytes(20), bytes(20)]
    assert T.pack_bits(b"".join(rows), 20) == b"".join(T.pack_bits(r) for r in rows)
    assert T.unpack_bits(T.pack_bits(b"".join(rows), 20), 80) == b"".join(rows)


def limited(work):
    """work() in a process that may use two gigabytes more than it has: what it returns."""
    import multiprocessing

    def run(out):
        import resource

        with open("/proc/self/statm") as file:
            now = int(file.read().split()[0]) * resource.getpagesize()
        resource.setrlimit(resource.RLIMIT_AS, (now + (2 << 30),) * 2)
        out.send(work())

    here, there = multiprocessing.get_context("fork").Pipe(False)
    process = multiprocessing.get_context("fork").Process(target=run, args=(there,))
    process.start()
    assert here.poll(60)
    said = here.recv()
    process.join()
    return said


def said_of(data, most=T.MOST_BYTES):
    try:
        return [p.width for p in T.read_pages(data, most)]
    except T.TiffError as error:
        return str(error)
    except MemoryError:
        return "memory"


def test_a_page_that_is_too_large_is_an_error():
    white = zlib.compressobj(9)
    body = b"".join(white.compress(bytes(1 << 20)) for _ in range(1024)) + white.flush()  # 32,768 x 32,768 zeros in a megabyte
    entries = [(256, 1 << 15), (257, 1 << 15), (258, 8), (259, 8), (273, 8), (278, 1 << 15), (279, len(body))]
    data = struct.pack("<2sHI", b"II", 42, 8 + len(body)) + body + struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in entries) + bytes(4)
    assert limited(lambda: said_of(data)) == f"a page of more than {T.MOST_BYTES} bytes"
    assert limited(lambda: said_of(data, 1 << 31)) == "memory"
    small = T.write_tiff([(np.zeros((10, 10), np.uint8), T.Layout())])
    assert said_of(small, 100) == [10] and said_of(small, 99) == "a page of more than 99 bytes"


def test_many_entries_on_one_array():
    array = struct.pack("<100000I", *[8] * 100_000)
    entries = b"".join(struct.pack("<HHII", t, 4, 100_000, 8) for t in [273] * 1000 + [40_000] * 1000) + b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in [(256, 3), (257, 2), (258, 8), (259, 1), (279, 6)])
    data = struct.pack("<2sHI", b"II", 42, 8 + len(array)) + array + struct.pack("<H", len(entries) // 12) + entries + bytes(4)
    began = time.monotonic()
    assert limited(lambda: said_of(data)) == [3] and time.monotonic() - began < 10


def header(**changed):
    """A file of one page, 3 x 2, with some fields' values changed (None: left out)."""
    fields = {256: 3, 257: 2, 258: 8, 259: 1, 273: 8, 277: 1, 278: 2, 279: 6} | {int(k[1:]): v for k, v in changed.items()}
    entries = b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in sorted(fields.items()) if v is not None)
    return struct.pack("<2sHI", b"II", 42, 14) + b"abcdef" + struct.pack("<H", len(entries) // 12) + entries + bytes(4)


HOSTILE = [
    dict(t256=1 << 31, t257=1 << 31), dict(t256=1 << 31, t257=1 << 31, t259=8), dict(t257=1 << 20, t278=1 << 20, t259=5), dict(t277=0), dict(t277=60_000), dict(t278=0), dict(t256=0), dict(t273=None), dict(t279=None), dict(t279=0), dict(t273=1 << 30), dict(t259=9),
    dict(t273=None, t279=None, t324=8, t325=6), dict(t273=None, t279=None, t322=3, t324=8, t325=6), dict(t273=None, t279=None, t322=1 << 31, t323=1 << 31, t324=8, t325=6), dict(t322=0, t323=2, t324=8, t325=6),
]


def test_hostile_headers_give_rows_with_an_error(spark):
    (page,) = T.read_pages(header())
    assert page.pixels == b"abcdef"
    files = spark.createDataFrame([(i, bytearray(header(**h))) for i, h in enumerate(HOSTILE)], "page int, content binary")
    rows = T.page_rows(files, key="page").collect()
    assert sorted(r.page_key for r in rows) == list(range(len(HOSTILE))) and all(r.error and r.pixels is None for r in rows)


def read_by_the_book(data):
    """The samples of a file of store(), read without its reader."""
    at, out = struct.unpack_from("<I", data, 4)[0], b""
    while at:
        n = struct.unpack_from("<H", data, at)[0]
        raw = {t: (k, c, at + 10 + 12 * i) for i in range(n) for t, k, c in [struct.unpack_from("<HHI", data, at + 2 + 12 * i)]}
        fields = {}
        for t, (k, c, place) in raw.items():
            size = {3: 2, 4: 4}[k]
            place = place if c * size <= 4 else struct.unpack_from("<I", data, place)[0]
            fields[t] = struct.unpack_from(f"<{c}{'H' if k == 3 else 'I'}", data, place)
        width, height = fields[256][0], fields[257][0]
        starts, sizes = (fields[324], fields[325]) if 324 in fields else (fields[273], fields[279])
        columns, rows = (fields[322][0], fields[323][0]) if 324 in fields else (width, fields[278][0])
        page = [bytearray(width) for _ in range(height)]
        for b, (start, size) in enumerate(zip(starts, sizes)):
            x, y = b % -(-width // columns) * columns, b // -(-width // columns) * rows
            block = data[start : start + size]
            if fields[259][0] == 8:
                block = zlib.decompress(block)
            elif fields[259][0] == 5:
                block = decoded_by_the_book(block)
            else:
                plain, i = b"", 0
                while i < len(block):
                    c = block[i]
                    plain, i = (plain + block[i + 1 : i + c + 2], i + c + 2) if c < 128 else (plain + block[i + 1 : i + 2] * (257 - c), i + 2)
                block = plain
            for j in range(min(rows, height - y)):
                line = bytearray(block[j * columns : (j + 1) * columns])
                if fields[317][0] == 2:
                    for i in range(1, columns):
                        line[i] = (line[i] + line[i - 1]) % 256
                page[y + j][x : x + columns] = line
        out += b"".join(page)
        at = struct.unpack_from("<I", data, at + 2 + 12 * n)[0]
    return out


def test_query_against_another_reader(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = T.query(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r.doc_id].encode()
        payload = raw + b"\xff" * (576 - len(raw) % 576 if len(raw) % 576 or not raw else 0)
        media = T.store(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest()) and read_by_the_book(media) == payload
        share = np.bincount(np.frombuffer(payload, np.uint8), minlength=256) / len(payload)
        mean = (share * np.arange(256)).sum()
        some = share[share > 0]
        found = dict(x.split("=") for x in r.feature.split(";"))
        assert int(found["pages"]) == r.pages and abs(float(found["mean"]) - mean) < 1e-3 and abs(float(found["entropy"]) + (some * np.log2(some)).sum()) < 1e-3


def test_rows(spark):
    docs = spark.createDataFrame([(1, "abc", 7), (2, None, 7), (3, "", 7), (1, "abc", 7)], "doc_id long, text string, pages int")
    rows = sorted(T.stored_digests(docs).collect(), key=lambda r: r.doc_id)
    assert len(rows) == 4 and rows[0] == rows[1] and rows[2].media_sha256 == rows[3].media_sha256
    payload = b"abc" + b"\xff" * 573
    assert (rows[0].n_bytes, rows[0].payload_bytes, rows[0].payload_sha256, rows[0].tail_crc32) == (3, 576, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert rows[2].n_bytes == 0 and rows[2].payload_bytes == 576
    assert T.stored_digests(docs.limit(0)).collect() == []


def test_one_row_a_page(spark):
    two = T.write_tiff([(np.full((2, 3), 5, np.uint8), T.Layout()), (np.full((4, 4), 6, np.uint8), T.Layout(T.LZW))])
    cut = two[: len(two) - 60]
    files = spark.createDataFrame([(1, bytearray(two)), (2, bytearray(b"no")), (3, None), (4, bytearray(cut))], "doc_id long, content binary")
    rows = T.page_rows(files).collect()
    assert [(r.doc_id, r.page, r.width, bytes(r.pixels)) for r in rows if r.error is None and r.doc_id == 1] == [(1, 0, 3, b"\x05" * 6), (1, 1, 4, b"\x06" * 16)]
    assert {r.doc_id for r in rows if r.error} == {2, 3, 4} and all(r.pixels is None for r in rows if r.error)
