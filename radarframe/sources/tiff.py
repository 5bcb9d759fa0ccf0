"""GeoTIFF: files of one band or several, interleaved or one after the other, written from and read as pixel tables.

Either byte order, and offsets of four bytes or eight (BigTIFF); tiles or strips; plain, deflated or LZW, with horizontal or
floating-point differences. A window unpacks the blocks it meets only. Kinds: whole numbers of 8 to 32 bits, reals of 32 and 64, complex64 (and, read only, complex
pairs of int16). Other compressions and kinds raise an error.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tags of the file format, and the sizes of its field types. Fixed values.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, FORMAT = 284, 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, GEO_KEYS, NODATA = 33550, 33922, 34735, 42113
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 8: 2, 9: 4, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
CODES = {3: "H", 4: "I", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
#: Where the directory keeps the file's byte order, beside the tags.
ORDER = -1
COMPRESSIONS = {"none": 1, "lzw": 5, "deflate": 8}
#: Sample format and bits by numpy kind; 5 is a complex of int16.
KINDS = {(1, 8): "u1", (2, 8): "i1", (1, 16): "<u2", (2, 16): "<i2", (1, 32): "<u4", (2, 32): "<i4", (3, 32): "<f4", (3, 64): "<f8", (6, 64): "<c8", (5, 32): "<i2"}


def lzw_packed(raw: bytes) -> bytes:
    """Codes of 9 to 12 bits, the highest bit first, with a table that is emptied when it is full."""
    table = {bytes([k]): k for k in range(256)}
    out, bits, held = bytearray(), 0, 0
    wide, after = 9, 258

    def put(code: int) -> None:
        nonlocal bits, held
        held = held << wide | code
        bits += wide
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    put(256)
    word = b""
    for k in range(len(raw)):
        longer = word + raw[k : k + 1]
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = after
        after += 1
        if after > (1 << wide) - 1:
            wide += 1
        if after == 4094:  # the table is full
            put(256)
            table = {bytes([j]): j for j in range(256)}
            wide, after = 9, 258
        word = raw[k : k + 1]
    if word:
        put(table[word])
        after += 1
        if after > (1 << wide) - 1 and wide < 12:
            wide += 1
    put(257)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def lzw_unpacked(data: bytes) -> bytes:
    table: list[bytes] = []
    out: list[bytes] = []
    wide, at, held, bits, before = 9, 0, 0, 0, None
    while True:
        while bits < wide:
            if at >= len(data):
                return b"".join(out)
            held, bits, at = held << 8 | data[at], bits + 8, at + 1
        bits -= wide
        code = held >> bits & ((1 << wide) - 1)
        held &= (1 << bits) - 1
        if code == 257:
            return b"".join(out)
        if code == 256:
            table, wide, before = [bytes([k]) for k in range(256)] + [b"", b""], 9, None
            continue
        word = table[code] if code < len(table) else before + before[:1]
        out.append(word)
        if before is not None:
            table.append(before + word[:1])
        before = word
        # a code wider one entry early, as the format has it
        wide = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9


def _differenced(block: np.ndarray, predictor: int) -> bytes:
    """A block (rows, columns, bands) as bytes, each value less its neighbour's."""
    if predictor == 2:
        done = block.copy()
        done[:, 1:] -= block[:, :-1]
        return done.tobytes()
    if predictor == 3:
        n = block.shape[2]
        planes = block.astype(block.dtype.newbyteorder(">")).view(np.uint8).reshape(len(block), -1, block.itemsize).swapaxes(1, 2).reshape(len(block), -1)
        done = planes.copy()
        done[:, n:] -= planes[:, :-n]
        return done.tobytes()
    return block.tobytes()


def _summed(raw: bytes, kind: np.dtype, rows: int, cols: int, bands: int, predictor: int) -> np.ndarray:
    """What :func:`_differenced` made bytes of."""
    if predictor == 2:
        whole = np.frombuffer(raw, kind, rows * cols * bands).reshape(rows, cols, bands)
        return np.cumsum(whole, axis=1, dtype=kind.newbyteorder("="))
    if predictor == 3:
        planes = np.frombuffer(raw, np.uint8, rows * cols * bands * kind.itemsize).reshape(rows, -1, bands)
        planes = np.cumsum(planes, axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, cols * bands)
        return np.ascontiguousarray(planes.swapaxes(1, 2)).view(kind.newbyteorder(">")).reshape(rows, cols, bands)
    return np.frombuffer(raw, kind, rows * cols * bands).reshape(rows, cols, bands)


def encoded(
    image: np.ndarray, tile: int | None = 256, origin: tuple[float, float] | None = None, resolution: float = 1.0, epsg: int | None = None, nodata: str | None = "nan", compression: str = "deflate",
    predictor: int = 1, planar: bool = False, order: str = "<", big: bool = False, rows_per_strip: int = 64,
) -> bytes:
    """A file of an image (rows, columns) or (rows, columns, bands), in tiles, or with ``tile=None`` in strips. ``origin`` is the upper left corner in the frame ``epsg``.
    ``planar`` puts the bands one after the other; ``predictor`` 2 is for whole numbers, 3 for reals; ``big`` makes a BigTIFF."""
    kind = np.dtype(image.dtype).newbyteorder("<")
    fmt, bits = next((k for k, v in KINDS.items() if np.dtype(v) == kind and k[0] != 5), (0, 0))
    if not fmt or predictor == 2 and fmt > 2 or predictor == 3 and fmt != 3:
        raise ValueError(f"no such kind of pixel: {image.dtype} with predictor {predictor}")
    whole = image if image.ndim == 3 else image[:, :, None]
    whole = whole.astype(kind.newbyteorder(order))
    h, w, n = whole.shape
    high, wide = (tile, tile) if tile else (min(rows_per_strip, h), w)
    pack = {"none": bytes, "lzw": lzw_packed, "deflate": lambda b: zlib.compress(b, 6)}[compression]
    blocks = []
    for part in [whole[:, :, k : k + 1] for k in range(n)] if planar else [whole]:
        for r in range(0, h, high):
            for c in range(0, w, wide):
                some = part[r : r + high, c : c + wide]
                block = np.zeros((high if tile else len(some), wide, part.shape[2]), whole.dtype)
                block[: some.shape[0], : some.shape[1]] = some
                blocks.append(pack(_differenced(block, predictor)))
    start = 16 if big else 8
    offsets = np.cumsum([start, *(len(b) for b in blocks)])
    place = 16 if big else 4
    tags = [(WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [bits] * n), (COMPRESSION, 3, [COMPRESSIONS[compression]]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [n]), (PLANAR, 3, [2 if planar else 1]), (PREDICTOR, 3, [predictor]), (FORMAT, 3, [fmt] * n)]
    where = (TILES, TILE_BYTES) if tile else (STRIPS, STRIP_BYTES)
    tags += [(TILE_WIDTH, 3, [tile]), (TILE_HEIGHT, 3, [tile])] if tile else [(ROWS_PER_STRIP, 4, [high])]
    tags += [(where[0], place, offsets[:-1].tolist()), (where[1], place, [len(b) for b in blocks])]
    if origin is not None:
        tags += [(PIXEL_SCALE, 12, [resolution, resolution, 0.0]), (TIE_POINT, 12, [0.0, 0.0, 0.0, origin[0], origin[1], 0.0])]
        if epsg is not None:
            geographic = epsg == 4326
            tags += [(GEO_KEYS, 3, [1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, 2048 if geographic else 3072, 0, 1, epsg])]
    if nodata is not None and fmt in (3, 6):
        tags += [(NODATA, 2, nodata)]
    tags.sort()
    directory = int(offsets[-1] + offsets[-1] % 2)
    room, entry, count = (8, 20, "Q") if big else (4, 12, "H")
    extra_at = directory + struct.calcsize(order + count) + entry * len(tags) + room
    head, extra = struct.pack(order + count, len(tags)), b""
    for tag, kind_no, values in tags:
        raw = values.encode() + b"\0" if kind_no == 2 else struct.pack(f"{order}{len(values)}{CODES[kind_no]}", *values)
        head += struct.pack(order + ("HHQ" if big else "HHI"), tag, kind_no, len(raw) // SIZES[kind_no])
        if len(raw) <= room:
            head += raw.ljust(room, b"\0")
        else:
            head += struct.pack(order + ("Q" if big else "I"), extra_at + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
    mark = b"II" if order == "<" else b"MM"
    opening = struct.pack(order + "2sHHHQ", mark, 43, 8, 0, directory) if big else struct.pack(order + "2sHI", mark, 42, directory)
    return opening + b"".join(blocks).ljust(directory - start, b"\0") + head + bytes(room) + extra


def tags_of(data: bytes) -> dict[int, list | str]:
    """The first directory's fields, and under ``ORDER`` the byte order."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    number = struct.unpack_from(f"{order}H", data, 2)[0] if order else 0
    if number not in (42, 43):
        raise ValueError("not a TIFF")
    big = number == 43
    (at,) = struct.unpack_from(order + ("Q" if big else "I"), data, 8 if big else 4)
    (n,) = struct.unpack_from(order + ("Q" if big else "H"), data, at)
    at += 8 if big else 2
    entry, room, form = (20, 8, "HHQ") if big else (12, 4, "HHI")
    found: dict[int, list | str] = {ORDER: order}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + form, data, at + entry * k)
        place = at + entry * k + struct.calcsize(order + form)
        if SIZES.get(kind, 1) * count > room:
            (place,) = struct.unpack_from(order + ("Q" if big else "I"), data, place)
        if kind == 2:
            found[tag] = data[place : place + count].split(b"\0")[0].decode("latin-1")
        elif kind in CODES:
            found[tag] = list(struct.unpack_from(f"{order}{count}{CODES[kind]}", data, place))
    return found


def window(data: bytes, col: int = 0, row: int = 0, w: int | None = None, h: int | None = None, band: int | None = None) -> np.ndarray:
    """A rectangle of the image, clipped to it; only the blocks that it meets are unpacked. Of several bands all, as a third axis, or the one named."""
    t = tags_of(data)
    width, height, n = t[WIDTH][0], t[HEIGHT][0], t.get(SAMPLES, [1])[0]
    kinds = set(zip(t.get(FORMAT, [1] * n), t[BITS], strict=False))
    method, predictor = t.get(COMPRESSION, [1])[0], t.get(PREDICTOR, [1])[0]
    if len(kinds) != 1 or not kinds <= set(KINDS):
        raise ValueError("bands of one known kind are wanted")
    ((fmt, bits),) = kinds
    if method not in (1, 5, 8, 32946) or predictor not in (1, 2, 3):
        raise ValueError(f"no such compression: {method} with predictor {predictor}")
    unpack = {1: bytes, 5: lzw_unpacked}.get(method, zlib.decompress)
    planar = t.get(PLANAR, [1])[0] == 2 and n > 1
    r1, c1 = min(height, row + (height - row if h is None else h)), min(width, col + (width - col if w is None else w))
    r0, c0 = max(row, 0), max(col, 0)
    tiled = TILES in t
    bw, bh = (t[TILE_WIDTH][0], t[TILE_HEIGHT][0]) if tiled else (width, t.get(ROWS_PER_STRIP, [height])[0])
    offsets, sizes = (t[TILES], t[TILE_BYTES]) if tiled else (t[STRIPS], t[STRIP_BYTES])
    across, down = -(-width // bw), -(-height // bh)
    kind = np.dtype(KINDS[fmt, bits]).newbyteorder(t[ORDER])
    wanted = list(range(n)) if band is None else [band]
    out = np.zeros((max(r1 - r0, 0), max(c1 - c0, 0), len(wanted)), np.complex64 if fmt == 5 else kind.newbyteorder("="))
    parts = 2 if fmt == 5 else 1
    for i in range(r0 // bh, (r1 - 1) // bh + 1) if out.size else ():
        high = bh if tiled else min(bh, height - i * bh)
        for j in range(c0 // bw, (c1 - 1) // bw + 1):
            a, b = max(r0, i * bh), max(c0, j * bw)
            e, f = min(r1, i * bh + high), min(c1, (j + 1) * bw)
            for p in wanted if planar else [0]:
                k = p * across * down * planar + i * across + j
                block = _summed(unpack(data[offsets[k] : offsets[k] + sizes[k]]), kind, high, bw, parts * (1 if planar else n), predictor)
                if fmt == 5:
                    block = block[:, :, 0::2].astype("f4") + 1j * block[:, :, 1::2].astype("f4")
                inside = block[a - i * bh : e - i * bh, b - j * bw : f - j * bw]
                out[a - r0 : e - r0, b - c0 : f - c0, slice(None) if not planar else wanted.index(p)] = inside[:, :, wanted] if not planar else inside[:, :, 0]
    return out if n > 1 and band is None else out[:, :, 0]


def files(df: DataFrame, value: str | tuple[str, str], size: int = 2048, kind: str = "float32", origin: tuple[float, float] | None = None, resolution: float = 1.0, epsg: int | None = None) -> DataFrame:
    """Pixels (row, col, value, or real and imaginary parts) as (tile_row, tile_col, content): a file for each ``size`` x ``size`` pixels of the raster.

    A task holds one such square. Pixels without a value or a row are NaN in kinds that have it, else 0; of pixels given twice one stays.
    """
    parts = [value] if isinstance(value, str) else list(value)

    def write(key, pdf):
        r, c = pdf["row"].to_numpy() - key[0] * size, pdf["col"].to_numpy() - key[1] * size
        floating = kind in ("float32", "complex64")
        image = np.full((int(r.max()) + 1, int(c.max()) + 1), np.nan if floating else 0, kind)
        z = [np.nan_to_num(pdf[p].to_numpy(float), nan=np.nan if floating else 0.0) for p in parts]
        image[r, c] = (z[0] + 1j * z[1] if len(z) == 2 else z[0]).astype(kind)
        at = None if origin is None else (origin[0] + key[1] * size * resolution, origin[1] - key[0] * size * resolution)
        return pd.DataFrame({"tile_row": [key[0]], "tile_col": [key[1]], "content": [encoded(image, origin=at, resolution=resolution, epsg=epsg)]})

    cells = df.select("row", "col", *parts).withColumns({"tile_row": F.floor(F.col("row") / size), "tile_col": F.floor(F.col("col") / size)})
    return cells.groupBy("tile_row", "tile_col").applyInPandas(write, "tile_row long, tile_col long, content binary")


def save(contents: DataFrame, folder: str) -> None:
    """Writes ``files`` into a folder that all executors see, as <tile_row>_<tile_col>.tif; a repeated task overwrites its own file with the same bytes."""

    def put(rows) -> None:
        from pyarrow import fs

        where, path = fs.FileSystem.from_uri(folder)
        where.create_dir(path, recursive=True)
        for r in rows:
            name = f"{path}/{r.tile_row}_{r.tile_col}.tif"
            with where.open_output_stream(f"{name}.part") as out:
                out.write(r.content)
            where.move(f"{name}.part", name)

    contents.foreachPartition(put)


def pixels(contents: DataFrame, keep: list[str], magnitude: bool = True, rectangle: tuple[int, int, int, int] | None = None, band: int = 0) -> DataFrame:
    """Files (keep..., content) as pixels (keep..., row, col, value) of a band, by default the magnitude of complex ones, else re and im; ``rectangle`` is col, row, w, h.

    Rows are taken some hundred at a time, so that a task unpacks a part of a file at once.
    """
    lines = 512
    fields = ["value double"] if magnitude else ["re double", "im double"]
    kept = [f"{k} {contents.schema[k].dataType.simpleString()}" for k in keep]
    col, row, w, h = rectangle or (0, 0, None, None)

    def run(batches):
        for pdf in batches:
            for one in pdf.to_dict("records"):
                bottom = tags_of(one["content"])[HEIGHT][0]
                bottom = bottom if h is None else min(bottom, row + h)
                for r0 in range(max(row, 0), bottom, lines):
                    z = window(one["content"], col, r0, w, min(lines, bottom - r0), band)
                    r, c = np.mgrid[r0 : r0 + z.shape[0], max(col, 0) : max(col, 0) + z.shape[1]].reshape(2, -1)
                    v = {"value": np.abs(z.astype("c16") if np.iscomplexobj(z) else z.astype(float)).ravel() if np.iscomplexobj(z) else z.astype(float).ravel()} if magnitude else {"re": z.real.astype(float).ravel(), "im": z.imag.astype(float).ravel()}
                    yield pd.DataFrame({**{k: one[k] for k in keep}, "row": r, "col": c, **v})

    return contents.select(*keep, "content").mapInPandas(run, ", ".join([*kept, "row long", "col long", *fields]))


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """Pixels (path, row, col, value) of the files under ``path``."""
    return pixels(spark.read.format("binaryFile").load(path), ["path"], **options)
