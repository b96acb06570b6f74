"""TIFF media columns: walks image directories, decodes PackBits, LZW or deflate strips and tiles, undoes predictors.

``pages`` gives one row a page. The writer makes the files that the tests and op7 read: 8-bit grey, any of the codecs,
strips or tiles, with or without horizontal differencing. Read are both byte orders, 1, 4, 8, 16 and 32 bits, whole
numbers and floats, samples in chunky or planar order, both fill orders, and horizontal and floating-point differencing.
Not read: BigTIFF, samples of different widths, fax and JPEG compression. Such files, and broken ones, give a row with
the error.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Tags and codes of the TIFF 6.0 specification.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_AT, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_BYTES, SAMPLE_FORMAT, FILL_ORDER = 322, 323, 324, 325, 339, 266
RAW, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
_TYPES = {1: "B", 3: "H", 4: "I"}
#: Bytes of a page's samples beyond which it isn't decoded.
LARGEST_PAGE = 1 << 30
_mirrored = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
CLEAR, END = 256, 257


class BadTiff(ValueError):
    """The bytes aren't a TIFF file that this reader knows."""


def packbits_decode(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out[:size])


def packbits_encode(data: bytes) -> bytes:
    """Runs of three and more equal bytes as repeats, the rest literal."""
    a = np.frombuffer(data, dtype=np.uint8)
    edges = np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1, [len(a)]]) if len(a) else np.zeros(1, np.int64)
    out, literal = bytearray(), 0

    def flush(upto: int) -> None:
        nonlocal literal
        while literal < upto:
            n = min(128, upto - literal)
            out.append(n - 1)
            out.extend(data[literal : literal + n])
            literal += n

    for k in np.flatnonzero(np.diff(edges) >= 3):
        start, end = int(edges[k]), int(edges[k + 1])
        flush(start)
        while end - start >= 2:
            n = min(128, end - start)
            out.append(257 - n)
            out.append(data[start])
            start += n
        literal = start
    flush(len(data))
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, most significant first, that widen one code early."""
    table = [bytes([i]) for i in range(256)] + [b"", b""]
    out, width, previous, bits, held = bytearray(), 9, None, 0, 0
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == END or len(out) >= size:
            break
        if code == CLEAR:
            del table[258:]
            width, previous = 9, None
            continue
        if previous is None:
            entry = table[code]
        else:
            if code < len(table):
                entry = table[code]
            elif code == len(table):
                entry = previous + previous[:1]
            else:
                raise BadTiff("LZW code out of order")
            table.append(previous + entry[:1])
            if len(table) >= (1 << width) - 1 and width < 12:
                width += 1
        out += entry
        previous = entry
    return bytes(out[:size])


def lzw_encode(data: bytes) -> bytes:
    out, held, bits = bytearray(), 0, 0
    table: dict[bytes, int] = {bytes([i]): i for i in range(256)}
    following, width, prefix = 258, 9, b""

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 0xFF)
        held &= (1 << bits) - 1

    put(CLEAR)
    for i in range(len(data)):
        longer = prefix + data[i : i + 1]
        if longer in table:
            prefix = longer
            continue
        put(table[prefix])
        table[longer] = following
        following += 1
        if following == 4094:
            put(CLEAR)
            table = {bytes([i]): i for i in range(256)}
            following, width = 258, 9
        elif following >= 1 << width:
            width += 1
        prefix = data[i : i + 1]
    if prefix:
        put(table[prefix])
        following += 1
        if following >= 1 << width and width < 12:
            width += 1
    put(END)
    if bits:
        out.append(held << (8 - bits) & 0xFF)
    return bytes(out)


def _pack(data: bytes, codec: int) -> bytes:
    return {RAW: bytes, LZW: lzw_encode, DEFLATE: lambda d: zlib.compress(d, 1), PACKBITS: packbits_encode}[codec](data)


def _unpack(data: bytes, codec: int, size: int) -> bytes:
    if codec == RAW:
        out = data[:size]
    elif codec == LZW:
        out = lzw_decode(data, size)
    elif codec in (DEFLATE, OLD_DEFLATE):
        out = zlib.decompressobj().decompress(data, size)
    elif codec == PACKBITS:
        out = packbits_decode(data, size)
    else:
        raise BadTiff(f"compression {codec}")
    if len(out) < size:
        raise BadTiff("a strip or tile is short")
    return out


def write(pages: list[tuple[np.ndarray, int, int, tuple[int, int] | None, int]]) -> bytes:
    """A little-endian file of pages (8-bit rows x columns, codec, predictor, tile (height, width) or None, rows a strip)."""
    parts, links, at = [b"II*\0\0\0\0\0"], [], 8
    for image, codec, predictor, tile, rows in pages:
        height, width = image.shape
        if tile:
            th, tw = tile
            padded = np.zeros((-(-height // th) * th, -(-width // tw) * tw), dtype=np.uint8)
            padded[:height, :width] = image
            blocks = [padded[y : y + th, x : x + tw] for y in range(0, padded.shape[0], th) for x in range(0, padded.shape[1], tw)]
        else:
            blocks = [image[y : y + rows] for y in range(0, height, rows)]
        if predictor == 2:
            blocks = [np.concatenate([b[:, :1], np.diff(b, axis=1)], axis=1) for b in blocks]
        packed = [_pack(np.ascontiguousarray(b).tobytes(), codec) for b in blocks]
        where = []
        for p in packed:
            where.append(at)
            parts.append(p)
            at += len(p)
        entries = [(WIDTH, [width]), (HEIGHT, [height]), (BITS, [8]), (COMPRESSION, [codec]), (PHOTOMETRIC, [1]), (SAMPLES, [1]), (PREDICTOR, [predictor])]
        sizes = [len(p) for p in packed]
        entries += [(TILE_WIDTH, [tw]), (TILE_HEIGHT, [th]), (TILE_AT, where), (TILE_BYTES, sizes)] if tile else [(STRIP_AT, where), (STRIP_ROWS, [rows]), (STRIP_BYTES, sizes)]
        body, extra = b"", b""
        if at % 2:
            parts.append(b"\0")
            at += 1
        after = at + 2 + 12 * len(entries) + 4
        for tag, values in sorted(entries):
            if len(values) == 1:
                body += struct.pack("<HHII", tag, 4, 1, values[0])
            else:
                body += struct.pack("<HHII", tag, 4, len(values), after + len(extra))
                extra += struct.pack(f"<{len(values)}I", *values)
        links.append((len(parts), at))
        parts.append(struct.pack("<H", len(entries)) + body)
        parts += [b"", extra]  # the link to the next directory, set below
        at = after + len(extra)
    for (k, _), (_, following) in zip(links, links[1:] + [(0, 0)]):
        parts[k + 1] = struct.pack("<I", following)
    parts[0] = struct.pack("<2sHI", b"II", 42, links[0][1] if links else 0)
    return b"".join(parts)


def _directories(data: bytes) -> Iterator[tuple[dict[int, tuple], str]]:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise BadTiff("no TIFF header")
    at, seen = struct.unpack(order + "I", data[4:8])[0], set()
    while at:
        if at in seen or at + 2 > len(data):
            raise BadTiff("directories run in a circle or out of the file")
        seen.add(at)
        n = struct.unpack_from(order + "H", data, at)[0]
        tags = {}
        try:
            for k in range(n):
                tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
                if kind not in _TYPES:
                    continue
                code = f"{order}{count}{_TYPES[kind]}"
                size = struct.calcsize(code)
                place = at + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * k)[0]
                tags[tag] = struct.unpack_from(code, data, place)
            yield tags, order
            at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]
        except struct.error as e:
            raise BadTiff(str(e)) from None


def _samples(raw: bytes, rows: int, row_samples: int, bits: int, kind: np.dtype) -> np.ndarray:
    """The samples of a block by row; rows of under 8 bits a sample begin at a whole byte."""
    if bits >= 8:
        return np.frombuffer(raw, dtype=kind).reshape(rows, row_samples)
    data = np.unpackbits(np.frombuffer(raw, dtype=np.uint8).reshape(rows, -1), axis=1)[:, : row_samples * bits].reshape(rows, row_samples, bits)
    return (data * (1 << np.arange(bits - 1, -1, -1))).sum(axis=2).astype(np.uint8)


def _undone(raw: bytes, rows: int, width: int, samples: int, bits: int, predictor: int, kind: np.dtype) -> np.ndarray:
    """A block's samples (row, column, sample) in the machine's byte order, differencing undone."""
    if predictor == 3:  # bytes of a row's numbers, all first bytes first, each as its difference from the one a pixel before
        size = bits // 8
        data = np.cumsum(np.frombuffer(raw, dtype=np.uint8).reshape(rows, -1, samples), axis=1, dtype=np.uint8)
        data = data.reshape(rows, size, width * samples).transpose(0, 2, 1)
        return np.ascontiguousarray(data).view(f">f{size}").astype(f"f{size}").reshape(rows, width, samples)
    block = _samples(raw, rows, width * samples, bits, kind).astype(kind.newbyteorder("=")).reshape(rows, width, samples)
    return np.cumsum(block, axis=1, dtype=block.dtype) if predictor == 2 else block


def read(data: bytes) -> Iterator[dict]:
    """A dict a page: width, height, samples, bits, codec, predictor, tiled, and pixels as bytes in rows, samples of a pixel together."""
    for tags, order in _directories(data):

        def tag(name: int, default: int) -> int:
            return tags.get(name, (default,))[0]

        width, height, samples, codec, predictor = tag(WIDTH, 0), tag(HEIGHT, 0), tag(SAMPLES, 1), tag(COMPRESSION, RAW), tag(PREDICTOR, 1)
        every = set(tags.get(BITS, (1,)))
        bits, form, planar = min(every), tag(SAMPLE_FORMAT, 1), tag(PLANAR, 1)
        if not (width and height and samples) or len(every) > 1:
            raise BadTiff(f"size {width} x {height}, {samples} samples of {sorted(every)} bits")
        known = bits in (1, 4, 8, 16, 32) and planar in (1, 2) and form in (1, 2, 3) and (predictor == 1 or predictor == 2 and bits >= 8 and form != 3 or predictor == 3 and form == 3)
        if not known or form == 3 and bits not in (16, 32):
            raise BadTiff(f"bits {bits}, predictor {predictor}, planar {planar}, sample format {form}")
        if width * height * samples * max(bits, 8) // 8 > LARGEST_PAGE:
            raise BadTiff(f"{width} x {height} pixels of {samples} samples are more than is decoded")
        kind = np.dtype(f"{order}{'uif'[form - 1]}{max(bits, 8) // 8}")
        tiled = TILE_AT in tags
        bh, bw = (tag(TILE_HEIGHT, 0), tag(TILE_WIDTH, 0)) if tiled else (min(tag(STRIP_ROWS, height) or height, height), width)
        if not (bh and bw) or bh * bw * samples * max(bits, 8) // 8 > LARGEST_PAGE:
            raise BadTiff(f"strips or tiles of {bw} x {bh}")
        across, down = -(-width // bw), -(-height // bh)
        planes, deep = (samples, 1) if planar == 2 else (1, samples)
        where, sizes = tags.get(TILE_AT if tiled else STRIP_AT, ()), tags.get(TILE_BYTES if tiled else STRIP_BYTES, ())
        if len(where) != across * down * planes or len(sizes) != len(where):
            raise BadTiff(f"{len(where)} strips or tiles and {len(sizes)} sizes, {across * down * planes} are needed")
        image = np.zeros((height, width, samples), dtype=kind.newbyteorder("="))
        for k, (at, size) in enumerate(zip(where, sizes)):
            plane, k = divmod(k, across * down)
            y, x = k // across * bh, k % across * bw
            rows = bh if tiled else min(bh, height - y)
            packed = data[at : at + size]
            if tag(FILL_ORDER, 1) == 2:
                packed = packed.translate(_mirrored)
            raw = _unpack(packed, codec, rows * -(-bw * deep * bits // 8))
            block = _undone(raw, rows, bw, deep, bits, predictor, kind)
            part = image[y : y + bh, x : x + bw, plane : plane + deep]
            part[:] = block[: part.shape[0], : part.shape[1]]
        yield {"width": width, "height": height, "samples": samples, "bits": bits, "codec": codec, "predictor": predictor, "tiled": tiled, "pixels": image.tobytes()}


#: Stored payloads: rows of 576 samples, in pages whose form goes around these, from one that the payload's checksum picks.
ROW = 576
PAGE_ROWS = 256
FORMS = ((DEFLATE, 2, None, 64), (DEFLATE, 1, (16, 144), 0), (PACKBITS, 1, None, 64), (LZW, 2, None, 64))


def store(payload: bytes) -> bytes:
    """A file that holds the payload, whose size is a positive multiple of 576, losslessly as 8-bit samples."""
    image = np.frombuffer(payload, dtype=np.uint8).reshape(-1, ROW)
    first = zlib.crc32(payload)  # short payloads too take each form
    return write([(image[y : y + PAGE_ROWS], *FORMS[(first + k) % len(FORMS)]) for k, y in enumerate(range(0, len(image), PAGE_ROWS))])


def padded(text: bytes) -> bytes:
    return text + b"\xff" * (max(1, -(-len(text) // ROW)) * ROW - len(text))


PAGES = "id long, page int, width int, height int, samples int, bits int, codec int, predictor int, tiled boolean, pixels binary, error string"


def page_rows(ids: list, media: list[bytes | None]) -> Iterator[dict]:
    """A row a page; for bytes that can't be read one row with page -1 and the error; none for null."""
    for i, data in zip(ids, media):
        if data is None:
            continue
        page = 0
        try:
            for p in read(data):
                yield {"id": i, "page": page, **p, "error": None}
                page += 1
        except (ValueError, ArithmeticError, LookupError, struct.error, zlib.error, MemoryError) as e:  # whatever bytes may hold
            yield {"id": i, "page": -1, **dict.fromkeys(("width", "height", "samples", "bits", "codec", "predictor", "tiled", "pixels")), "error": f"{type(e).__name__}: {e}"[:200]}


def _schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in PAGES.split(", "))])


def pages(media: DataFrame, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """One row a page of each file: PAGES. Null files give no rows, broken ones a row with the error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _schema()
        for batch in batches:
            for i in range(batch.num_rows):  # a file at a time: pages can be large
                rows = list(page_rows([batch.column(0)[i].as_py()], [batch.column(1)[i].as_py()]))
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return media.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).cast("binary").alias("media")).mapInArrow(run, PAGES)


def features(rows: list[dict]) -> str:
    """Pages, forms, mean and spread of the samples and the entropy of their histogram, over one file's pages."""
    count = np.zeros(256, dtype=np.int64)
    for r in rows:
        count += np.bincount(np.frombuffer(r["pixels"], dtype=np.uint8), minlength=256)
    n, v = int(count.sum()), np.arange(256)
    mean = float((count * v).sum() / n)
    spread = float(np.sqrt(max(0.0, (count * v * v).sum() / n - mean * mean)))
    p = count[count > 0] / n
    return f"pages={len(rows)};codecs={'+'.join(str(r['codec']) for r in rows[:4])};mean={mean:.4f};std={spread:.4f};entropy={float(-(p * np.log2(p)).sum()):.4f}"
