"""TIFF columns: one row per page of every file, and a writer that stores byte payloads as pages.

The reader walks the image directories of either byte order, undoes PackBits, LZW or deflate on strips and tiles and
the horizontal predictor, and emits the 8-bit samples of each page in rows. It works on one Arrow batch at a time and
never shuffles pixels.

Defined results: a null file, or one whose directories can't be walked to their end, gives one row whose page is null
and whose ``error`` says why, and a row for each page before the damage; a bad page gives its own row without pixels and with an ``error``, and the other pages are read.
Strips or tiles that don't cover the page, sizes of 0, bit depths other than 8, separate planes and unknown compressions
are errors; palettes are given as their indexes. Repeated rows are read alike; an empty table gives no rows; columns of
the input that carry an output column's name are replaced. Pages are read one at a time, so a file of many pages is
never held at once.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from surety.llm.common import map_batches

#: Numbers of the format's tags, compressions and field types.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES = 322, 323, 324, 325
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
KINDS = {1: "B", 3: "H", 4: "I"}
#: No page may claim more samples than this.
MOST_SAMPLES = 1 << 30
PAGE_SCHEMA = T.StructType([T.StructField("page", T.IntegerType()), T.StructField("pages", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("samples", T.IntegerType()), T.StructField("pixels", T.BinaryType()), T.StructField("error", T.StringType())])
RUN = re.compile(rb"(.)\1{2,}", re.S)


def unpack_bits(data: bytes, size: int) -> bytes:
    out, at, have = [], 0, 0
    while have < size and at < len(data):
        n = data[at]
        if n < 128:
            out.append(data[at + 1 : at + 2 + n])
            at += n + 2
        elif n > 128:
            out.append(data[at + 1 : at + 2] * (257 - n))
            at += 2
        else:
            at += 1
            continue
        have += len(out[-1])
    return b"".join(out)


def pack_bits(rows: np.ndarray) -> bytes:
    """Each row is packed on its own."""
    out = []
    for row in rows:
        data, at = row.tobytes(), 0
        for run in [*RUN.finditer(data), None]:
            stop = run.start() if run else len(data)
            for k in range(at, stop, 128):
                part = data[k : min(k + 128, stop)]
                out.append(bytes([len(part) - 1]) + part)
            if run:
                for k in range(run.start(), run.end(), 128):
                    n = min(128, run.end() - k)
                    out.append(bytes([257 - n if n > 1 else 0]) + run[1])
                at = run.end()
    return b"".join(out)


def unpack_lzw(data: bytes, size: int) -> bytes:
    start = [bytes([i]) for i in range(256)] + [b"", b""]
    table, width, last, out, have = list(start), 9, None, [], 0
    held = bits = 0
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 256:
            table, width, last = list(start), 9, None
            continue
        if code == 257:
            break
        if last is None:
            word = table[code]
        else:
            if code > len(table):
                raise ValueError(f"code {code} is beyond the table's next entry")
            word = table[code] if code < len(table) else last + last[:1]
            table.append(last + word[:1])
            if len(table) + 1 >> width and width < 12:
                width += 1
        out.append(word)
        have += len(word)
        last = word
        if have >= size:
            break
    return b"".join(out)


def pack_lzw(data: bytes) -> bytes:
    codes, table, after = [(256, 9)], {}, 258
    width, w = 9, -1
    for byte in data:
        if w < 0:
            w = byte
            continue
        key = (w << 8) | byte
        found = table.get(key)
        if found is not None:
            w = found
            continue
        codes.append((w, width))
        table[key] = after
        if after == (1 << width) - 1 and width < 12:
            width += 1
        elif after == 4094:
            codes.append((256, 12))
            table, after, width = {}, 257, 9
        after += 1
        w = byte
    if w >= 0:
        codes.append((w, width))
        if after == (1 << width) - 1 and width < 12:
            width += 1
    codes.append((257, width))
    out, held, bits = bytearray(), 0, 0
    for code, n in codes:
        held, bits = (held << n) | code, bits + n
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1
    if bits:
        out.append((held << (8 - bits)) & 255)
    return bytes(out)


def directories(data: bytes):
    """The directories of a file as {tag: values}."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("no TIFF header")
    (at,), seen = struct.unpack_from(order + "I", data, 4), set()
    while at:
        if at in seen:
            raise ValueError("directories form a loop")
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        tags = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if kind not in KINDS:
                continue
            where, fmt = at + 10 + 12 * k, order + str(count) + KINDS[kind]
            if struct.calcsize(fmt) > 4:
                (where,) = struct.unpack_from(order + "I", data, where)
            tags[tag] = struct.unpack_from(fmt, data, where)
        yield tags
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def read_page(data: bytes, tags: dict) -> tuple[int, int, int, bytes]:
    """(width, height, samples, pixels) of one directory."""
    one = lambda tag, default=None: tags[tag][0] if tag in tags or default is None else default
    wide, high, samples, kind = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), one(COMPRESSION, PLAIN)
    if set(tags.get(BITS, (8,))) != {8} or one(PLANAR, 1) != 1:
        raise ValueError("only interleaved 8-bit samples are read")
    if not 0 < wide * high * samples <= MOST_SAMPLES:
        raise ValueError("impossible size")
    tiled = TILES in tags
    across, down = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (wide, min(one(STRIP_ROWS, high), high))
    places, sizes = (tags[TILES], tags[TILE_BYTES]) if tiled else (tags[STRIPS], tags[STRIP_BYTES])
    if across < 1 or down < 1 or across * down * samples > MOST_SAMPLES:
        raise ValueError("impossible strips or tiles")
    columns = -(-wide // across)
    if len(places) != columns * -(-high // down) or len(sizes) != len(places):
        raise ValueError("strips or tiles are missing")
    image = np.zeros((high, wide, samples), np.uint8)
    for k, (at, size) in enumerate(zip(places, sizes, strict=True)):
        top, left = k // columns * down, k % columns * across
        rows = down if tiled else min(down, high - top)
        raw, want = data[at : at + size], rows * across * samples
        if kind in (DEFLATE, OLD_DEFLATE):
            raw = zlib.decompressobj().decompress(raw, want)
        elif kind == LZW:
            raw = unpack_lzw(raw, want)
        elif kind == PACKBITS:
            raw = unpack_bits(raw, want)
        elif kind != PLAIN:
            raise ValueError(f"compression {kind} isn't read")
        if len(raw) < want:
            raise ValueError("a strip or tile is cut short")
        block = np.frombuffer(raw, np.uint8, want).reshape(rows, across, samples)
        if one(PREDICTOR, 1) == 2:
            block = np.cumsum(block, axis=1, dtype=np.uint8)
        image[top : top + rows, left : left + across] = block[: high - top, : wide - left]
    return wide, high, samples, image.tobytes()


#: What malformed bytes can raise on the way.
BAD = (ArithmeticError, LookupError, MemoryError, TypeError, ValueError, struct.error, zlib.error)


def _why(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"[:200]


def read(data: bytes | None):
    """The rows of PAGE_SCHEMA for one file, one page at a time."""
    found, why = [], "null" if data is None else None
    try:
        for tags in () if data is None else directories(data):
            found.append(tags)
    except BAD as e:
        # the pages before the damage are read all the same
        why = _why(e)
    if why or not found:
        yield None, len(found), None, None, None, None, why or "no pages"
    for i, tags in enumerate(found):
        try:
            row = (i, len(found), *read_page(data, tags), None)
        except BAD as e:
            row = (i, len(found), None, None, None, None, _why(e))
        yield row


def tiff_pages(df: DataFrame, media="media") -> DataFrame:
    """One row per page with the other columns of df and those of PAGE_SCHEMA."""
    names = [f.name for f in PAGE_SCHEMA]
    keep = [c for c in df.columns if c != media and c not in names]
    schema = T.StructType([df.schema[c] for c in keep] + PAGE_SCHEMA.fields)

    def batchful(batch, at, rows):
        made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(),) * 5 + (pa.binary(), pa.string()), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(at)) for c in keep] + made, names=[*keep, *names])

    def run(batches):
        for batch in batches:
            at, rows, held = [], [], 0
            for i, data in enumerate(batch.column(media)):
                for row in read(data.as_py()):
                    at.append(i)
                    rows.append(row)
                    held += len(row[5] or b"")
                    if held > 1 << 23:
                        yield batchful(batch, at, rows)
                        at, rows, held = [], [], 0
            if rows:
                yield batchful(batch, at, rows)

    return map_batches(df.select(*keep, media), run, schema)


#: Layout of stored payloads: samples a row, rows a page, rows a strip, side of a tile.
ROW, PAGE_ROWS, STRIP, TILE = 64, 1024, 256, 64


def payload_of(text: str | None) -> bytes:
    """UTF-8 with zeros up to a positive multiple of ROW bytes."""
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % ROW or (0 if raw else ROW))


def write(payload: bytes) -> bytes:
    """payload as a TIFF file. Its digest picks byte order, compression, predictor and strips or tiles."""
    pick = hashlib.sha256(payload).digest()
    order = "<>"[pick[0] % 2]
    kind = {0: LZW, 1: PACKBITS, 2: PACKBITS, 3: PLAIN}.get(pick[1] % 16, DEFLATE)
    predictor = 1 + pick[2] % 2 if kind in (LZW, DEFLATE) else 1
    tiled = pick[3] % 2
    image = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    out = bytearray({"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, 0))
    link = 4
    for top in range(0, len(image), PAGE_ROWS):
        page = image[top : top + PAGE_ROWS]
        places, sizes, step = [], [], TILE if tiled else STRIP
        for y in range(0, len(page), step):
            block = page[y : y + step]
            if tiled and len(block) < TILE:
                block = np.concatenate([block, np.zeros((TILE - len(block), ROW), np.uint8)])
            if predictor == 2:
                block = np.concatenate([block[:, :1], block[:, 1:] - block[:, :-1]], axis=1)
            raw = block.tobytes() if kind == PLAIN else pack_bits(block) if kind == PACKBITS else pack_lzw(block.tobytes()) if kind == LZW else zlib.compress(block.tobytes(), 1)
            places.append(len(out))
            sizes.append(len(raw))
            out += raw
        tags = {WIDTH: [ROW], HEIGHT: [len(page)], BITS: [8], COMPRESSION: [kind], PHOTOMETRIC: [1], SAMPLES: [1], PREDICTOR: [predictor]}
        tags |= {TILE_WIDTH: [ROW], TILE_HEIGHT: [TILE], TILES: places, TILE_BYTES: sizes} if tiled else {STRIPS: places, STRIP_ROWS: [STRIP], STRIP_BYTES: sizes}
        fields = []
        for tag in sorted(tags):
            values = tags[tag]
            body = struct.pack(f"{order}{len(values)}I", *values)
            if len(values) > 1:
                where = len(out)
                out += body
                body = struct.pack(order + "I", where)
            fields.append(struct.pack(order + "HHI", tag, 4, len(values)) + body)
        out += bytes(len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(fields)) + b"".join(fields)
        link = len(out)
        out += bytes(4)
    return bytes(out)


def store(df: DataFrame, text="text", keep=("doc_id",), media="media") -> DataFrame:
    """The kept columns, n_bytes (of the text) and the stored payload."""
    keep = [c for c in keep if c not in ("n_bytes", media)]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("n_bytes", T.LongType()), T.StructField(media, T.BinaryType())])

    def run(batches):
        for batch in batches:
            at = 0
            while at < len(batch):
                start, sizes, files, held = at, [], [], 0
                while at < len(batch) and held < 1 << 23:
                    t = batch.column(text)[at].as_py()
                    sizes.append(len((t or "").encode()))
                    files.append(write(payload_of(t)))
                    held += len(files[-1])
                    at += 1
                part = batch.slice(start, at - start)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], names=[*keep, "n_bytes", media])

    return map_batches(df.select(*dict.fromkeys([*keep, text])), run, schema)


def digest_pages(pages: DataFrame, keep: list[str]) -> DataFrame:
    """Folds the page rows of each file, which follow each other, into one row: digests and a feature of the payload.

    A file with an unreadable page has the digests of its other pages and the feature "error".
    """
    schema = T.StructType([pages.schema[c] for c in keep] + [T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()), T.StructField("feature", T.StringType())])

    def run(batches):
        parts, failed = [], False
        for batch in batches:
            at, rows = [], []
            number, of, pixels = (batch.column(c).to_pylist() for c in ("page", "pages", "pixels"))
            for i, (k, n, data) in enumerate(zip(number, of, pixels, strict=True)):
                parts.append(data or b"")
                failed |= data is None
                if n == 0 or k == n - 1:
                    body = b"".join(parts)
                    rows.append((len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:]), "error" if failed else feature(body, n)))
                    at.append(i)
                    parts, failed = [], False
            if rows:
                made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(at)) for c in keep] + made, names=[*keep, "payload_bytes", "payload_sha256", "tail_crc32", "feature"])

    return map_batches(pages.select(*keep, "page", "pages", "pixels"), run, schema)


def feature(body: bytes, pages: int) -> str:
    """Pages, mean and contrast of the samples (in 1/1000) and the busiest of 16 grey levels."""
    a = np.frombuffer(body, np.uint8).astype(np.int64)
    if not len(a):
        return "pages=0"
    mean = int(a.sum()) * 1000 // len(a)
    edges = int(np.abs(np.diff(a)).sum()) * 1000 // len(a)
    return f"pages={pages};mean={mean};contrast={edges};mode={int(np.bincount(a >> 4, minlength=16).argmax())}"
