"""TIFF media columns: one row per page.

``pages`` walks the image directories of TIFF files held in a binary column, decodes
PackBits, LZW or deflate strips and tiles, undoes horizontal differencing and emits the
samples of each page. ``store`` writes bytes as TIFF pages.

Pages of 1, 8 or 16 bits a sample are read, chunky or plane by plane, predictors 1 and 2;
a page of more than ``MAX_SAMPLES`` samples isn't, and gets an error row like a broken one.

Null or empty media give no page row with samples but one row with page 0 and an error,
as does a file that isn't TIFF; a broken page gets a row with null samples and its error,
and the walk goes on where its directory still names the next. Directory loops end the
walk with an error row. Repeated rows are read each for itself, ties can't arise, no rows
give no rows, and files and texts may be as long as a value can be. A column that has the
name of a result (``PAGE``, or ``n_bytes`` and the medium in ``store``) is replaced by it.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerlake.llm.store import bounded_batches, without

# Fixed values of the TIFF 6.0 format: tags, field types, compressions.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS = 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 284, 317, 322, 323, 324, 325
FIELD = {1: "B", 3: "H", 4: "I"}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773

PAGE = T.StructType(
    [
        T.StructField("page", T.IntegerType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("samples", T.IntegerType()),
        T.StructField("bits", T.IntegerType()),
        T.StructField("compression", T.IntegerType()),
        T.StructField("predictor", T.IntegerType()),
        T.StructField("tiled", T.BooleanType()),
        T.StructField("data", T.BinaryType()),
        T.StructField("error", T.StringType()),
    ]
)
#: Samples of a page at most: a page is one value, which can't hold much more, and files
#: may claim more than they hold.
MAX_SAMPLES = 1 << 28


def unpack_bits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def pack_bits(row: bytes) -> bytes:
    out, at = bytearray(), 0

    def literal(to: int) -> None:
        for a in range(at, to, 128):
            piece = row[a : min(to, a + 128)]
            out.append(len(piece) - 1)
            out.extend(piece)

    for m in re.finditer(rb"(.)\1{2,127}", row, re.DOTALL):
        literal(m.start())
        out += bytes([257 - (m.end() - m.start()), m[0][0]])
        at = m.end()
    literal(len(row))
    return bytes(out)


#: Of the codes after a reset the width of each, and the bit at which it begins. The table
#: has 258 entries before the first code and grows by one with each but the first.
LZW_RUN = 4096
LZW_WIDTH = np.minimum(9 + np.searchsorted([512, 1024, 2048], 258 + np.arange(LZW_RUN), "right"), 12)
LZW_BEGIN = np.concatenate([[0], np.cumsum(LZW_WIDTH)])
LZW_START = [bytes([i]) for i in range(256)] + [b"", b""]


def lzw_codes(bits: np.ndarray, at: int, first: int, n: int) -> np.ndarray:
    """Up to ``n`` codes from bit ``at``, of which the first is number ``first`` after a
    reset; ``bits`` has 12 zeros more than there is data."""
    k = np.minimum(np.arange(first, first + n), LZW_RUN - 1)
    width = LZW_WIDTH[k]
    begin = at + np.concatenate([[0], np.cumsum(width)])
    there = int(np.searchsorted(begin[1:], len(bits) - 12, "right"))
    begin, width = begin[:there], width[:there]
    twelve = np.zeros(there, np.int64)
    for i in range(12):
        twelve = twelve << 1 | bits[begin + i]
    return twelve >> (12 - width)


def lzw_decode(data: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, high bit first, one code early in width. Codes are cut out
    of the bits together, as their widths are known up to the next reset."""
    bits = np.concatenate([np.unpackbits(np.frombuffer(data, np.uint8)), np.zeros(12, np.uint8)])
    table, out, last, at, first, made = list(LZW_START), [], b"", 0, 0, 0
    while made < size:
        codes = lzw_codes(bits, at, first, 64 if first == 0 else 1024)
        if not len(codes):
            break
        ends = np.flatnonzero((codes == 256) | (codes == 257))
        n = int(ends[0]) if len(ends) else len(codes)
        for code in codes[:n].tolist():
            if not last:
                entry = table[code]
            else:
                if code > len(table):
                    raise ValueError("LZW code beyond the table")
                entry = table[code] if code < len(table) else last + last[:1]
                table.append(last + entry[:1])
            out.append(entry)
            made += len(entry)
            last = entry
        if len(ends) and codes[n] == 257:
            break
        taken = n + bool(len(ends))
        at += int(LZW_WIDTH[np.minimum(np.arange(first, first + taken), LZW_RUN - 1)].sum())
        first += taken
        if len(ends):
            table, last, first = list(LZW_START), b"", 0
    return b"".join(out)[:size]


def lzw_encode(data: bytes) -> bytes:
    """The table is kept as (code before, byte) -> code; it is reset when 4,094 codes are
    in use."""
    codes, runs, begin = [256], [], 0
    table: dict[int, int] = {}
    following, held = 258, -1
    for b in data:
        if held < 0:
            held = b
            continue
        key = held << 8 | b
        if (code := table.get(key)) is not None:
            held = code
            continue
        codes.append(held)
        table[key] = following
        following += 1
        held = b
        if following == 4094:
            codes.append(256)
            runs.append(len(codes) - 1 - begin)
            begin, following = len(codes) - 1, 258
            table.clear()
    if held >= 0:
        codes.append(held)
    codes.append(257)
    runs.append(len(codes) - 1 - begin)
    # The code that resets is the last of its run; the first of all stands alone.
    width = np.concatenate([LZW_WIDTH[:1], *(LZW_WIDTH[:n] for n in runs)])
    sixteen = (np.array(codes, np.int64) << (16 - width)).astype(">u2")
    bits = np.unpackbits(sixteen.view(np.uint8)).reshape(-1, 16)
    return np.packbits(bits[np.arange(16)[None, :] < width[:, None]]).tobytes()


def compress(data: bytes, how: int, row: int) -> bytes:
    if how == LZW:
        return lzw_encode(data)
    if how == DEFLATE:
        return zlib.compress(data, 6)
    if how == PACKBITS:
        return b"".join(pack_bits(data[a : a + row]) for a in range(0, len(data), row))
    return data


def decompress(data: bytes, how: int, size: int) -> bytes:
    if how == LZW:
        return lzw_decode(data, size)
    if how in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size)
    if how == PACKBITS:
        return unpack_bits(data, size)
    if how == NONE:
        return data[:size]
    raise ValueError(f"compression {how}")


def difference(a: np.ndarray) -> np.ndarray:
    out = a.copy()
    out[:, 1:] -= a[:, :-1]
    return out


def write(payload: bytes, width: int, plan, page_rows: int) -> bytes:
    """``payload`` (a multiple of ``width``) as grey 8-bit pages of ``page_rows`` rows.
    ``plan(page)`` gives (compression, predictor, tile side or 0, rows a strip)."""
    grid = np.frombuffer(payload, np.uint8).reshape(-1, width)
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for k, a in enumerate(range(0, len(grid), page_rows)):
        page = grid[a : a + page_rows]
        how, predictor, side, strip = plan(k)
        if side:
            high, wide = -(-len(page) // side) * side, -(-width // side) * side
            full = np.zeros((high, wide), np.uint8)
            full[: len(page), :width] = page
            parts = [full[y : y + side, x : x + side] for y in range(0, high, side) for x in range(0, wide, side)]
        else:
            parts = [page[y : y + strip] for y in range(0, len(page), strip)]
        places = []
        for part in parts:
            data = compress((difference(part) if predictor == 2 else np.ascontiguousarray(part)).tobytes(), how, part.shape[1])
            places.append((len(out), len(data)))
            out += data + b"\0" * (len(data) % 2)
        tags = [(WIDTH, [width]), (LENGTH, [len(page)]), (BITS, [8]), (COMPRESSION, [how]), (PHOTOMETRIC, [1]), (SAMPLES, [1]), (PREDICTOR, [predictor])]
        if side:
            tags += [(TILE_WIDTH, [side]), (TILE_LENGTH, [side]), (TILE_OFFSETS, [p for p, _ in places]), (TILE_COUNTS, [n for _, n in places])]
        else:
            tags += [(ROWS_PER_STRIP, [strip]), (STRIP_OFFSETS, [p for p, _ in places]), (STRIP_COUNTS, [n for _, n in places])]
        entries = b""
        for tag, values in sorted(tags):
            body = struct.pack(f"<{len(values)}I", *values)
            if len(body) > 4:
                at = struct.pack("<I", len(out))
                out += body
            else:
                at = body
            entries += struct.pack("<HHI", tag, 4, len(values)) + at
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(tags)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def directories(data: bytes) -> Iterator[tuple[dict[int, tuple[int, ...]], str]]:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack(order + "I", data[4:8])[0], set()
    while at:
        if at in seen:
            raise ValueError("directories in a loop")
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        tags = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            if (f := FIELD.get(kind)) and count <= len(data):
                size = struct.calcsize(f) * count
                where = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * i)[0]
                if where + size <= len(data):
                    tags[tag] = struct.unpack_from(f"{order}{count}{f}", data, where)
        yield tags, order
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def samples_of(data: bytes, tags: dict[int, tuple[int, ...]], order: str) -> dict:
    one = lambda tag, other=None: tags[tag][0] if tags.get(tag) else other
    width, height, samples, bits = one(WIDTH), one(LENGTH), one(SAMPLES, 1), one(BITS, 1)
    how, predictor, tiled = one(COMPRESSION, 1), one(PREDICTOR, 1), TILE_OFFSETS in tags
    named = {"width": width, "height": height, "samples": samples, "bits": bits, "compression": how, "predictor": predictor}
    out = {n: x if x is not None and x < 1 << 31 else None for n, x in named.items()} | {"tiled": tiled, "data": None}
    try:
        if not width or not height or not samples:
            raise ValueError("no size")
        planes = samples if one(PLANAR, 1) == 2 else 1
        if bits not in (1, 8, 16) or predictor not in (1, 2) or (bits == 1 and predictor == 2) or one(PLANAR, 1) not in (1, 2) or width * height * samples > MAX_SAMPLES:
            raise ValueError(f"{bits} bits, predictor {predictor}, planar {one(PLANAR, 1)}, {width} x {height} samples are not read")
        kind = np.dtype(np.uint8) if bits < 16 else np.dtype(order + "u2")
        if tiled:
            wide, high, offsets, counts = one(TILE_WIDTH), one(TILE_LENGTH), tags[TILE_OFFSETS], tags.get(TILE_COUNTS)
        else:
            wide, high, offsets, counts = width, min(one(ROWS_PER_STRIP, height), height), tags.get(STRIP_OFFSETS), tags.get(STRIP_COUNTS)
        if not wide or not high or not offsets or not counts:
            raise ValueError("no parts")
        across, down, each = -(-width // wide), -(-height // high), samples // planes
        if len(offsets) != across * down * planes or len(counts) != len(offsets):
            raise ValueError(f"{len(offsets)} parts of {across * down * planes}")
        grid = np.zeros((height, width, samples), kind)
        for k, (at, n) in enumerate(zip(offsets, counts, strict=True)):
            plane, place = divmod(k, across * down)
            y, x = place // across * high, place % across * wide
            rows = high if tiled else min(high, height - y)
            line = -(-wide * each // 8) if bits == 1 else wide * each * kind.itemsize
            raw = decompress(data[at : at + n], how, rows * line)
            if len(raw) != rows * line:
                raise ValueError(f"part {k} has {len(raw)} bytes of {rows * line}")
            if bits == 1:
                part = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(rows, line), axis=1)[:, : wide * each].reshape(rows, wide, each)
            else:
                part = np.frombuffer(raw, kind).reshape(rows, wide, each)
            if predictor == 2:
                part = np.cumsum(part, 1, dtype=kind.newbyteorder("="))
            h, w = min(rows, height - y), min(wide, width - x)
            grid[y : y + h, x : x + w, plane * each : plane * each + each] = part[:h, :w]
    except Exception as e:  # whatever a broken file leads to is that page's error
        return out | {"error": f"{type(e).__name__}: {e}"[:200]}
    return out | {"data": grid.astype(kind.newbyteorder("<")).tobytes(), "error": None}


def read(data: bytes | None) -> Iterator[dict]:
    k = 0
    try:
        for tags, order in directories(data or b""):
            yield {"page": k} | samples_of(data, tags, order)
            k += 1
    except (ValueError, IndexError, struct.error) as e:
        yield {x.name: None for x in PAGE.fields} | {"page": k, "error": f"{e}"[:200]}


def pages(df: DataFrame, media: str = "media", batch_bytes: int = 4 << 20) -> DataFrame:
    """A row for each page of the TIFF in ``media``, in order: the other columns of ``df``
    and those of ``PAGE``. Samples are bytes (0 or 1 if of one bit), or 16-bit words low
    byte first."""
    df = without(df, [f.name for f in PAGE.fields], [media])
    rest = [c for c in df.columns if c != media]
    schema = T.StructType([f for f in df.schema.fields if f.name != media] + PAGE.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32()] * 7 + [pa.bool_(), pa.binary(), pa.string()]
        names = [f.name for f in PAGE.fields]

        def made(batch: pa.RecordBatch, at: list[int], got: list[dict]) -> pa.RecordBatch:
            left = batch.select(rest).take(pa.array(at, pa.int64())).columns if rest else []
            return pa.RecordBatch.from_arrays([*left, *(pa.array([g[n] for g in got], kind) for n, kind in zip(names, kinds, strict=True))], [*rest, *names])

        for batch in batches:
            at, got, size = [], [], 0
            for i, data in enumerate(batch.column(media)):
                for page in read(data.as_py()):
                    at.append(i)
                    got.append(page)
                    size += len(page["data"] or b"")
                    if size > batch_bytes:
                        yield made(batch, at, got)
                        at, got, size = [], [], 0
            if got:
                yield made(batch, at, got)

    return df.mapInArrow(run, schema)


#: Of the stored form that ``store`` makes: bytes a row, rows a page.
STORE_WIDTH, STORE_ROWS = 192, 64


def store_plan(seed: int) -> Callable[[int], tuple[int, int, int, int]]:
    """Compressions, predictors, tiles and strips in turn, page by page, from a start that
    the content decides; whatever size a page has, each form gets its share."""
    forms = [(DEFLATE, 1, 64, 0), (LZW, 1, 0, STORE_ROWS), (PACKBITS, 1, 0, 16), (DEFLATE, 2, 0, 16), (LZW, 2, 0, 32), (PACKBITS, 1, 64, 0)]
    return lambda page: forms[(seed + page) % len(forms)]


def payload_of(text: str | None) -> tuple[bytes, int]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b" " * (-len(data) % STORE_WIDTH or STORE_WIDTH * (not data)), len(data)


def store(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """``docs`` with ``text`` replaced by ``n_bytes`` and ``media``, a TIFF of the text's
    UTF-8 padded by spaces to a positive multiple of ``STORE_WIDTH``; null is empty."""
    bounded_batches(docs.sparkSession)
    docs = without(docs, ["n_bytes", media], [text])
    schema = T.StructType([f for f in docs.schema.fields if f.name != text] + [T.StructField("n_bytes", T.LongType()), T.StructField(media, T.BinaryType())])
    rest = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [payload_of(t) for t in batch.column(text).to_pylist()]
            files = [write(p, STORE_WIDTH, store_plan(zlib.crc32(p)), STORE_ROWS) for p, _ in made]
            yield batch.select(rest).append_column("n_bytes", pa.array([n for _, n in made], pa.int64())).append_column(media, pa.array(files, pa.binary()))

    return docs.mapInArrow(run, schema)
