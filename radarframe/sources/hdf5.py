"""HDF5 files: a data source over the chunks of a dataset, tables of small datasets and attributes, and files written from pixels.

The data source reads a file's structure where it is planned and makes partitions of chunks, about ``PART_BYTES`` each, leaving out those
beyond the window, so a task reads the bytes of its own chunks only, whatever the file's size. Files are opened
through pyarrow's file systems. Read are superblocks 0 to 3, both kinds of object headers, symbol tables and compact links; contiguous,
compact and chunked layouts (version 1 trees, single and implicit chunks), deflate, shuffle and checksums; whole numbers, reals, fixed and variable
strings, enumerations, and pairs of reals (r, i) as complex samples. What else a file may hold raises an error that names it.
Written are version 0 files with chunked, deflated and shuffled datasets. Numbers and names in here are the format's own: fixed values.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SIGNATURE = b"\x89HDF\r\n\x1a\n"
NOWHERE = (1 << 64) - 1
#: Bytes of stored chunks that a task reads, about; values of a dataset or attribute that count as small.
PART_BYTES, SMALL = 8_000_000, 100_000
ENDINGS = (".h5", ".hdf5", ".he5", ".nc")
COMPLEX = np.dtype([("r", "<f4"), ("i", "<f4")])


@dataclass
class Dataset:
    """A dataset's form: what its elements are, where its chunks lie, and its attributes."""

    shape: tuple[int, ...]
    kind: np.dtype | str
    layout: tuple
    filters: list[tuple[int, list[int]]] = field(default_factory=list)
    attributes: dict = field(default_factory=dict)


class File:
    """Structure of a file that is open for reading at any place."""

    def __init__(self, source):
        self.source, self.held = source, {}
        start = next((k for k in (0, 512, 1024, 2048) if self.at(k, 8) == SIGNATURE), None)
        if start is None:
            raise ValueError("not an HDF5 file")
        version = self.at(start + 8, 1)[0]
        offsets = self.at(start + (13 if version < 2 else 9), 2)
        if tuple(offsets) != (8, 8):
            raise ValueError("only offsets and lengths of eight bytes are read")
        if version < 2:
            at = start + (24 if version == 0 else 28)
            self.base = self.number(at)
            self.root = self.number(at + 32 + 8)
        else:
            self.base, self.root = self.number(start + 12), self.number(start + 36)

    def at(self, place: int, size: int) -> bytes:
        """Bytes, by way of pages that are kept: structures are small and near each other."""
        page = 1 << 16
        out = []
        for k in range(place // page, (place + size - 1) // page + 1 if size else 0):
            if k not in self.held:
                self.source.seek(k * page)
                self.held[k] = self.source.read(page)
            a, b = max(place - k * page, 0), min(place + size - k * page, page)
            out.append(self.held[k][a:b])
        return b"".join(out)

    def stored(self, place: int, size: int) -> bytes:
        """Bytes of a chunk, not kept."""
        self.source.seek(self.base + place)
        return self.source.read(size)

    def number(self, place: int, size: int = 8) -> int:
        return int.from_bytes(self.at(place, size), "little")

    def messages(self, address: int) -> list[tuple[int, bytes]]:
        """(type, content) of an object's header."""
        at = self.base + address
        found, blocks = [], []
        if self.at(at, 4) == b"OHDR":
            flags = self.at(at + 5, 1)[0]
            here = at + 6 + 16 * (flags >> 5 & 1) + 4 * (flags >> 4 & 1)
            width = 1 << (flags & 3)
            blocks.append((here + width, self.number(here, width)))
            head = 4 + 2 * (flags >> 2 & 1)
            while blocks:
                here, size = blocks.pop(0)
                end = here + size
                while here + head <= end:
                    kind, n = self.at(here, 1)[0], self.number(here + 1, 2)
                    data = self.at(here + head, n)
                    here += head + n
                    if kind == 0x10:
                        blocks.append((self.base + int.from_bytes(data[:8], "little") + 4, int.from_bytes(data[8:16], "little") - 8))
                    elif kind:
                        found.append((kind, data))
            return found
        if self.at(at, 1) != b"\x01":
            raise ValueError("an object header of an unknown version")
        blocks.append((at + 16, self.number(at + 8, 4)))
        while blocks:
            here, size = blocks.pop(0)
            end = here + size
            while here + 8 <= end:
                kind, n = struct.unpack("<HH", self.at(here, 4))
                data = self.at(here + 8, n)
                here += 8 + n
                if kind == 0x10:
                    blocks.append((self.base + int.from_bytes(data[:8], "little"), int.from_bytes(data[8:16], "little")))
                elif kind:
                    found.append((kind, data))
        return found

    def children(self, address: int) -> dict[str, int]:
        """Names and places of what a group holds; nothing of a dataset."""
        found: dict[str, int] = {}
        for kind, m in self.messages(address):
            if kind == 0x11:
                tree, heap = struct.unpack("<QQ", m[:16])
                names = self.base + self.number(self.base + heap + 24)
                todo = [tree]
                while todo:
                    node = self.base + todo.pop()
                    if self.at(node, 4) == b"TREE":
                        todo += [self.number(node + 24 + 8 + 16 * k) for k in range(self.number(node + 6, 2))]
                        continue
                    for k in range(self.number(node + 6, 2)):
                        entry = node + 8 + 40 * k
                        name = self.at(names + self.number(entry), 1024).split(b"\0", 1)[0]
                        found[name.decode()] = self.number(entry + 8)
            elif kind == 0x02:
                if int.from_bytes(m[2 + 8 * (m[1] & 1) :][:8], "little") != NOWHERE:
                    raise ValueError("groups with dense links aren't read")
            elif kind == 0x06:
                flags, at = m[1], 2
                link = m[at] if flags & 8 else 0
                at += (flags >> 3 & 1) + 8 * (flags >> 2 & 1) + (flags >> 4 & 1)
                width = 1 << (flags & 3)
                n = int.from_bytes(m[at : at + width], "little")
                name = m[at + width : at + width + n].decode()
                if link == 0:
                    found[name] = int.from_bytes(m[at + width + n :][:8], "little")
        return found

    def find(self, path: str) -> int:
        here = self.root
        for name in path.strip("/").split("/"):
            inside = self.children(here)
            if name not in inside:
                raise KeyError(path)
            here = inside[name]
        return here

    def walk(self) -> Iterator[tuple[str, Dataset]]:
        """Path and form of every dataset, by depth."""
        todo = [("", self.root)]
        while todo:
            path, address = todo.pop()
            kinds = {k for k, _ in self.messages(address)}
            if 0x08 in kinds:
                yield path, self.dataset(address)
            else:
                todo += [(f"{path}/{n}".lstrip("/"), a) for n, a in sorted(self.children(address).items(), reverse=True)]

    def dataset(self, address: int) -> Dataset:
        shape, kind, layout, filters, attributes = (), None, None, [], {}
        for k, m in self.messages(address):
            if k == 0x01:
                shape = _shape(m)
            elif k == 0x03:
                kind = _kind(m)[0]
            elif k == 0x08:
                layout = _layout(m)
            elif k == 0x0B:
                filters = _filters(m)
            elif k == 0x0C:
                name, value = self._attribute(m)
                attributes[name] = value
        if kind is None or layout is None:
            raise ValueError("not a dataset")
        return Dataset(shape, kind, layout, filters, attributes)

    def _attribute(self, m: bytes):
        version, n, kind_size, shape_size = m[0], *struct.unpack("<HHH", m[2:8])
        at = 8 + (version == 3)
        whole = (lambda x: -(-x // 8) * 8) if version == 1 else (lambda x: x)
        name = m[at : at + n].split(b"\0", 1)[0].decode()
        at += whole(n)
        kind, _ = _kind(m[at : at + kind_size])
        at += whole(kind_size)
        shape = _shape(m[at : at + shape_size])
        return name, self.values(m[at + whole(shape_size) :], kind, shape)

    def values(self, raw: bytes, kind: np.dtype | str, shape: tuple[int, ...]) -> np.ndarray:
        n = int(np.prod(shape, dtype=np.int64))
        if kind == "text":
            out = [self._heaped(*struct.unpack("<IQI", raw[16 * k : 16 * k + 16])) for k in range(n)]
            return np.array(out, object).reshape(shape)
        return np.frombuffer(raw, kind, n).reshape(shape)

    def _heaped(self, size: int, heap: int, index: int) -> bytes:
        if not size:
            return b""
        at, end = self.base + heap + 16, self.base + heap + self.number(self.base + heap + 8)
        while at < end:
            k, n = self.number(at, 2), self.number(at + 8)
            if k == index:
                return self.at(at + 16, size)
            if not k:
                break
            at += 16 + -(-n // 8) * 8
        raise ValueError("a string that isn't in its heap")

    def chunks(self, d: Dataset, row: int = 0, end: int | None = None) -> Iterator[tuple[tuple[int, ...], int, int, int]]:
        """(first element, place, stored bytes, filter mask) of the chunks that are there and meet rows ``row`` to ``end``; branches of the tree beyond are not read."""
        end = d.shape[0] if end is None else min(end, d.shape[0])
        kind, *rest = d.layout
        size = 16 if d.kind == "text" else d.kind.itemsize
        if kind == "contiguous":
            place, _ = rest
            across = int(np.prod(d.shape[1:], dtype=np.int64)) * size
            step = max(1, PART_BYTES // max(1, across))
            if place != NOWHERE:
                for r in range(row, end, step):
                    yield (r, *(0 for _ in d.shape[1:])), place + r * across, min(step, end - r) * across, 0
        elif kind == "tree":
            tree, sides = rest
            todo = [tree] if tree != NOWHERE else []
            width = 8 + 8 * (len(sides) + 1)
            while todo:
                node = self.base + todo.pop()
                level, used = self.at(node + 5, 1)[0], self.number(node + 6, 2)
                keys = [self.at(node + 24 + k * (width + 8), width) for k in range(used + 1)]
                first = [struct.unpack(f"<{len(sides)}Q", k[8 : 8 + 8 * len(sides)]) for k in keys]
                for k in range(used):
                    child = self.number(node + 24 + k * (width + 8) + width)
                    if first[k][0] >= end:
                        break
                    if level:
                        if first[k + 1][0] + sides[0] > row:
                            todo.append(child)
                    elif first[k][0] + sides[0] > row:
                        n, mask = struct.unpack("<II", keys[k][:8])
                        yield first[k], child, n, mask
        elif kind == "single":
            place, n, mask = rest[0], rest[2] or int(np.prod(rest[1], dtype=np.int64)) * size, rest[3]
            if place != NOWHERE:
                yield tuple(0 for _ in d.shape), place, n, mask
        elif kind == "implicit":
            place, sides = rest
            whole = int(np.prod(sides, dtype=np.int64)) * size
            counts = [-(-a // b) for a, b in zip(d.shape, sides, strict=True)]
            for k, index in enumerate(np.ndindex(*counts)):
                if index[0] * sides[0] < end and (index[0] + 1) * sides[0] > row:
                    yield tuple(i * s for i, s in zip(index, sides, strict=True)), place + k * whole, whole, 0

    def read(self, d: Dataset) -> np.ndarray:
        """All values of a small dataset."""
        if d.layout[0] == "compact":
            return self.values(d.layout[1], d.kind, d.shape)
        if d.layout[0] == "contiguous" or not d.shape:
            n = int(np.prod(d.shape, dtype=np.int64)) * (16 if d.kind == "text" else d.kind.itemsize)
            return self.values(self.stored(d.layout[1], n) if d.layout[1] != NOWHERE else bytes(n), d.kind, d.shape)
        kind = np.dtype("V16") if d.kind == "text" else d.kind
        out = np.zeros(d.shape, kind)
        for first, place, n, mask in self.chunks(d):
            block = unpacked(self.stored(place, n), d.filters, mask, kind, chunk_shape(d))
            part = tuple(slice(a, min(a + b, s)) for a, b, s in zip(first, block.shape, d.shape, strict=True))
            out[part] = block[tuple(slice(0, p.stop - p.start) for p in part)]
        return self.values(out.tobytes(), d.kind, d.shape) if d.kind == "text" else out


def chunk_shape(d: Dataset) -> tuple[int, ...]:
    return d.layout[2] if d.layout[0] != "contiguous" else (-1, *d.shape[1:])


def unpacked(raw: bytes, filters: list[tuple[int, list[int]]], mask: int, kind: np.dtype, shape: tuple[int, ...]) -> np.ndarray:
    """A chunk's elements: its filters undone, the last first."""
    for k in reversed(range(len(filters))):
        number, values = filters[k]
        if mask >> k & 1:
            continue
        if number == 1:
            raw = zlib.decompress(raw)
        elif number == 2:
            wide = values[0] if values else kind.itemsize
            n = len(raw) // wide
            raw = np.frombuffer(raw, np.uint8, n * wide).reshape(wide, n).T.tobytes() + raw[n * wide :]
        elif number == 3:
            raw = raw[:-4]
        else:
            raise ValueError(f"filter {number} isn't read")
    return np.frombuffer(raw, kind).reshape(shape)


def _shape(m: bytes) -> tuple[int, ...]:
    if m[0] == 2 and m[3] == 2:
        return (0,)
    at = 8 if m[0] == 1 else 4
    return struct.unpack(f"<{m[1]}Q", m[at : at + 8 * m[1]])


def _kind(m: bytes) -> tuple[np.dtype | str, int]:
    """Type of elements, and bytes that tell it."""
    version, group, bits, size = m[0] >> 4, m[0] & 15, m[1], int.from_bytes(m[4:8], "little")
    order = ">" if bits & 1 else "<"
    if group == 0:
        return np.dtype(f"{order}{'i' if bits & 8 else 'u'}{size}"), 12
    if group == 1:
        return np.dtype(f"{order}f{size}"), 20
    if group == 3:
        return np.dtype(f"S{size}"), 8
    if group == 6:
        at, names, kinds, places = 8, [], [], []
        for _ in range(int.from_bytes(m[1:3], "little")):
            end = m.index(b"\0", at)
            names.append(m[at:end].decode())
            at = at + -(-(end + 1 - at) // 8) * 8 if version < 3 else end + 1
            wide = 4 if version < 3 else (max(1, size).bit_length() + 7) // 8
            places.append(int.from_bytes(m[at : at + wide], "little"))
            at += 32 if version == 1 else wide
            one, n = _kind(m[at:])
            kinds.append(one)
            at += n
        return np.dtype({"names": names, "formats": kinds, "offsets": places, "itemsize": size}), at
    if group == 8:
        one, n = _kind(m[8:])
        return one, len(m) if n else 8
    if group == 9:
        return "text", 8 + _kind(m[8:])[1]
    raise ValueError(f"elements of class {group} aren't read")


def _layout(m: bytes) -> tuple:
    version, group = m[0], m[1]
    if version == 3:
        if group == 0:
            return "compact", m[4 : 4 + int.from_bytes(m[2:4], "little")]
        if group == 1:
            return ("contiguous", *struct.unpack("<QQ", m[2:18]))
        n = m[2]
        return "tree", int.from_bytes(m[3:11], "little"), struct.unpack(f"<{n}I", m[11 : 11 + 4 * n])[:-1]
    if version == 4:
        if group == 0:
            return "compact", m[4 : 4 + int.from_bytes(m[2:4], "little")]
        if group == 1:
            return ("contiguous", *struct.unpack("<QQ", m[2:18]))
        flags, n, wide = m[2], m[3], m[4]
        sides = tuple(int.from_bytes(m[5 + wide * k : 5 + wide * (k + 1)], "little") for k in range(n))[:-1]
        at = 5 + wide * n
        if m[at] == 1:
            size, mask = struct.unpack("<QI", m[at + 1 : at + 13]) if flags & 2 else (0, 0)
            return "single", int.from_bytes(m[at + 1 + 12 * (flags >> 1 & 1) :][:8], "little"), sides, size, mask
        if m[at] == 2:
            return "implicit", int.from_bytes(m[at + 1 : at + 9], "little"), sides
        raise ValueError("only single and implicit chunks of version 4 layouts are read")
    raise ValueError(f"layout version {version} isn't read")


def _filters(m: bytes) -> list[tuple[int, list[int]]]:
    version, found = m[0], []
    at = 8 if version == 1 else 2
    for _ in range(m[1]):
        number = int.from_bytes(m[at : at + 2], "little")
        named = version == 1 or number >= 256
        n = int.from_bytes(m[at + 2 : at + 4], "little") if named else 0
        at += 4 if named else 2
        count = int.from_bytes(m[at + 2 : at + 4], "little")
        at += 4 + (-(-n // 8) * 8 if version == 1 else n)
        found.append((number, list(struct.unpack(f"<{count}I", m[at : at + 4 * count]))))
        at += 4 * (count + (count % 2 if version == 1 else 0))
    return found


# writing


def encoded(datasets: dict[str, np.ndarray], chunk: tuple[int, int] = (256, 256), attributes: dict[str, dict] | None = None, level: int = 4) -> bytes:
    """A file of datasets by path. Those of two dimensions or more are chunked, shuffled and deflated, the others contiguous; complex ones are pairs (r, i).
    Texts are fixed strings. ``attributes`` are texts or numbers by path."""
    out = bytearray(96)

    def put(data: bytes) -> int:
        out.extend(bytes(-len(out) % 8))
        out.extend(data)
        return len(out) - len(data)

    def message(kind: int, data: bytes) -> bytes:
        data += bytes(-len(data) % 8)
        return struct.pack("<HHB3x", kind, len(data), 0) + data

    def header(messages: list[bytes]) -> int:
        body = b"".join(messages)
        return put(struct.pack("<BxHII4x", 1, len(messages), 1, len(body)) + body)

    def kind_of(a: np.dtype) -> bytes:
        if a.names:
            members = b"".join(n.encode() + bytes(8 - len(n)) + struct.pack("<IB3xII4I", a.fields[n][1], 0, 0, 0, 0, 0, 0, 0) + kind_of(a.fields[n][0]) for n in a.names)
            return struct.pack("<BHxI", 0x16, len(a.names), a.itemsize) + members
        if a.kind == "S":
            return struct.pack("<B3xI", 0x13, a.itemsize)
        if a.kind == "f":
            sign, exponent, mantissa, bias = {2: (15, 5, 10, 15), 4: (31, 8, 23, 127), 8: (63, 11, 52, 1023)}[a.itemsize]
            return struct.pack("<BBBBIHHBBBBI", 0x11, 0x20, sign, 0, a.itemsize, 0, 8 * a.itemsize, mantissa, exponent, 0, mantissa, bias)
        return struct.pack("<BB2xIHH", 0x10, 8 if a.kind == "i" else 0, a.itemsize, 0, 8 * a.itemsize)

    def plain(values) -> np.ndarray:
        a = np.asarray(values)
        if a.dtype.kind == "U":
            a = np.char.encode(a, "utf-8")
        if a.dtype.kind == "c":
            half = f"<f{a.dtype.itemsize // 2}"
            a = np.ascontiguousarray(a).view(np.dtype([("r", half), ("i", half)])).reshape(a.shape)
        return a if a.dtype.names or a.dtype.kind == "S" else a.astype(a.dtype.newbyteorder("<"))

    def shape_of(shape) -> bytes:
        return struct.pack(f"<BBB5x{len(shape)}Q", 1, len(shape), 0, *shape)

    def attribute(name: str, value) -> bytes:
        a, n = plain(value), name.encode() + b"\0"
        parts = [n, kind_of(a.dtype), shape_of(a.shape)]
        return message(0x0C, struct.pack("<BxHHH", 1, *map(len, parts)) + b"".join(p + bytes(-len(p) % 8) for p in parts) + a.tobytes())

    def tree(entries: list[tuple[bytes, int]], last: bytes, kind: int, most: int) -> int:
        depth = 0
        while True:
            room = 24 + (most + 1) * len(last) + 8 * most
            parts = [entries[k : k + most] for k in range(0, len(entries), most)] or [[]]
            up, places = [], [len(out) + -len(out) % 8 + k * (room + -room % 8) for k in range(len(parts))]
            for k, part in enumerate(parts):
                after = parts[k + 1][0][0] if k + 1 < len(parts) else last
                node = b"TREE" + struct.pack("<BBHQQ", kind, depth, len(part), places[k - 1] if k else NOWHERE, places[k + 1] if k + 1 < len(parts) else NOWHERE)
                node += b"".join(key + struct.pack("<Q", child) for key, child in part) + after
                up.append((part[0][0] if part else last, put(node + bytes(room - len(node)))))
            if len(up) == 1:
                return up[0][1]
            entries, depth = up, depth + 1

    def stored(path: str, values) -> int:
        a = plain(values)
        messages = [message(0x01, shape_of(a.shape)), message(0x03, kind_of(a.dtype))]
        if a.ndim >= 2 and a.size:
            sides = tuple(min(c, s) for c, s in zip((*chunk, *a.shape[2:])[: a.ndim], a.shape, strict=True))
            entries = []
            for index in np.ndindex(*(-(-s // c) for s, c in zip(a.shape, sides, strict=True))):
                first = [i * c for i, c in zip(index, sides, strict=True)]
                block = np.zeros(sides, a.dtype)
                part = a[tuple(slice(f, f + c) for f, c in zip(first, sides, strict=True))]
                block[tuple(slice(0, n) for n in part.shape)] = part
                raw = np.frombuffer(block.tobytes(), np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes()
                raw = zlib.compress(raw, level)
                entries.append((struct.pack(f"<II{a.ndim + 1}Q", len(raw), 0, *first, 0), put(raw)))
            beyond = struct.pack(f"<II{a.ndim + 1}Q", 0, 0, *(-(-s // c) * c for s, c in zip(a.shape, sides, strict=True)), 0)
            where = tree(entries, beyond, 1, 64)
            messages.append(message(0x0B, struct.pack("<BB6x", 1, 2) + struct.pack("<HHHHI4x", 2, 0, 0, 1, a.dtype.itemsize) + struct.pack("<HHHHI4x", 1, 0, 0, 1, level)))
            messages.append(message(0x08, struct.pack(f"<BBBQ{a.ndim + 1}I", 3, 2, a.ndim + 1, where, *sides, a.dtype.itemsize)))
        else:
            messages.append(message(0x08, struct.pack("<BBQQ", 3, 1, put(a.tobytes()) if a.size else NOWHERE, a.nbytes)))
        return header([*messages, *(attribute(k, v) for k, v in (attributes or {}).get(path, {}).items())])

    def group(path: str, inside: dict) -> tuple[int, int, int]:
        places = {n: stored(f"{path}/{n}".lstrip("/"), x) if not isinstance(x, dict) else group(f"{path}/{n}".lstrip("/"), x) for n, x in inside.items()}
        names, at = bytearray(8), {}
        for n in sorted(places):
            at[n] = len(names)
            names += n.encode() + b"\0"
            names += bytes(-len(names) % 8)
        data = put(bytes(names))
        heap = put(b"HEAP" + struct.pack("<B3xQQQ", 0, len(names), 1, data))
        entries, order = [], sorted(places)
        for k in range(0, len(order), 8):
            part = order[k : k + 8]
            node = b"SNOD" + struct.pack("<BxH", 1, len(part))
            for n in part:
                x = places[n]
                node += struct.pack("<QQII", at[n], x[0], 1, 0) + struct.pack("<QQ", *x[1:]) if isinstance(x, tuple) else struct.pack("<QQII16x", at[n], x, 0, 0)
            entries.append((struct.pack("<Q", at[part[-1]]), put(node + bytes(328 - len(node)))))
        # a key precedes its child: the greatest name of the child before
        keyed = [(struct.pack("<Q", 0) if k == 0 else entries[k - 1][0], place) for k, (_, place) in enumerate(entries)]
        where = tree(keyed, entries[-1][0] if entries else struct.pack("<Q", 0), 0, 32)
        return header([message(0x11, struct.pack("<QQ", where, heap)), *(attribute(k, v) for k, v in (attributes or {}).get(path, {}).items())]), where, heap

    nested: dict = {}
    for path, values in datasets.items():
        *above, name = path.strip("/").split("/")
        here = nested
        for n in above:
            here = here.setdefault(n, {})
        here[name] = values
    root, where, heap = group("", nested)
    out[:96] = SIGNATURE + struct.pack("<8BHHI", 0, 0, 0, 0, 0, 8, 8, 0, 4, 16, 0) + struct.pack("<QQQQ", 0, NOWHERE, len(out), NOWHERE) + struct.pack("<QQIIQQ", 0, root, 1, 0, where, heap)
    return bytes(out)


def files(df: DataFrame, dataset: str, value: str | tuple[str, str], by: list[str], chunk: tuple[int, int] = (256, 256)) -> DataFrame:
    """(by..., content): pixels (by..., row, col, value, or real and imaginary parts), a file for each ``by``, whose pixels a task holds. Pixels that are lacking are NaN."""
    parts = [value] if isinstance(value, str) else list(value)
    kinds = dict(df.dtypes)

    def write(table):
        import pyarrow as pa

        r, c, *v = (table.column(k).to_numpy() for k in ("row", "col", *parts))
        image = np.full((int(r.max()) + 1, int(c.max()) + 1), np.nan, "f4" if len(v) == 1 else "c8")
        image[r.astype(int), c.astype(int)] = v[0] if len(v) == 1 else v[0] + 1j * v[1]
        return pa.table({**{k: table.column(k).slice(0, 1) for k in by}, "content": pa.array([encoded({dataset: image}, chunk)], pa.binary())})

    return df.select(*by, "row", "col", *parts).groupBy(*by).applyInArrow(write, ", ".join([*(f"{k} {kinds[k]}" for k in by), "content binary"]))


def save(contents: DataFrame, folder: str) -> None:
    """Writes (name, content) rows into a folder that all executors see; a repeated task overwrites its own file with the same bytes."""

    def put(rows) -> None:
        from pyarrow import fs

        where, path = fs.FileSystem.from_uri(folder)
        where.create_dir(path, recursive=True)
        for r in rows:
            with where.open_output_stream(f"{path}/{r.name}.part") as out:
                out.write(r.content)
            where.move(f"{path}/{r.name}.part", f"{path}/{r.name}.h5")

    contents.select("name", "content").foreachPartition(put)


# the data source


def _listed(path: str) -> list[str]:
    from pyarrow import fs

    where, at = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    start = path[: len(path) - len(at)] if path.endswith(at) else "file://"
    info = where.get_file_info(at)
    if info.type == fs.FileType.File:
        return [start + at]
    return sorted(start + x.path for x in where.get_file_info(fs.FileSelector(at, recursive=True)) if x.type == fs.FileType.File and x.path.endswith(ENDINGS))


def opened(path: str) -> File:
    from pyarrow import fs

    where, at = fs.FileSystem.from_uri(path)
    return File(where.open_input_file(at))


@dataclass
class Chunks(InputPartition):
    """Chunks that a task reads from one file: all that is needed to unpack them."""

    path: str
    kind: np.dtype
    filters: list
    sides: tuple
    shape: tuple
    chunks: list

    def __post_init__(self):
        super().__init__(None)


class _PixelReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.options, self.names = options, schema.fieldNames()
        given = options.get("window")
        self.window = [int(x) for x in given.split(",")] if given else None

    def partitions(self):
        parts = []
        for path in _listed(self.options["path"]):
            f = opened(path)
            d = f.dataset(f.find(self.options["dataset"]))
            if len(d.shape) != 2 or isinstance(d.kind, str):
                raise ValueError(f"{self.options['dataset']} of {path} isn't a raster")
            col, row, w, h = self.window or (0, 0, d.shape[1], d.shape[0])
            held, size = [], 0
            if d.layout[0] == "compact":
                raise ValueError("compact rasters are read as tables")
            for c in sorted(f.chunks(d, max(row, 0), row + h)):
                if c[0][1] >= col + w or c[0][1] + (chunk_shape(d)[1]) <= col:
                    continue
                held.append(c)
                size += c[2]
                if size >= PART_BYTES:
                    parts.append(Chunks(path, d.kind, d.filters, chunk_shape(d), d.shape, held))
                    held, size = [], 0
            if held:
                parts.append(Chunks(path, d.kind, d.filters, chunk_shape(d), d.shape, held))
        return parts or [Chunks("", np.dtype("f4"), [], (), (), [])]

    def read(self, part):
        import pyarrow as pa

        if not part.chunks:
            return
        f = opened(part.path)
        col, row, w, h = self.window or (0, 0, part.shape[1], part.shape[0])
        for first, place, n, mask in part.chunks:
            block = unpacked(f.stored(place, n), part.filters, mask, part.kind, part.sides)
            a, b = max(row, first[0]), max(col, first[1])
            e, g = min(row + h, first[0] + block.shape[0], part.shape[0]), min(col + w, first[1] + block.shape[1], part.shape[1])
            if e <= a or g <= b:
                continue
            block = block[a - first[0] : e - first[0], b - first[1] : g - first[1]]
            i, j = np.mgrid[a:e, b:g].reshape(2, -1)
            fields = [block[k] for k in block.dtype.names] if block.dtype.names else [block]
            values = [pa.array(x.ravel().astype(np.float64)) for x in fields]
            yield pa.RecordBatch.from_arrays([pa.array([part.path] * len(i), pa.string()), pa.array(i), pa.array(j), *values], names=self.names)


class _TableReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        return [InputPartition(p) for p in _listed(self.options["path"])] or [InputPartition(None)]

    def read(self, part):
        if part.value is None:
            return
        f = opened(part.value)

        def listed(v):
            text = v.dtype == object or v.dtype.kind == "S"
            clean = [x.split(b"\0", 1)[0].decode("utf-8", "replace") for x in v.ravel().tolist()] if text else None
            return (None if text else [float(x) for x in v.ravel().tolist()]) if not v.dtype.names else None, clean

        for name, d in f.walk():
            small = int(np.prod(d.shape, dtype=np.int64)) <= SMALL
            numbers, texts = listed(f.read(d)) if small else (None, None)
            said = {k: (t if t is not None else [] if n is None else list(map(repr, n))) for k, v in d.attributes.items() for n, t in [listed(v)]}
            yield part.value, name, numbers, texts, (said.get("units") or [None])[0], {k: ",".join(v) for k, v in said.items()}, list(d.shape)


class Hdf5Source(DataSource):
    """Format ``hdf5``: with option ``dataset``, its pixels (path, row, col, value, or re and im) of the file or files under the path, within ``window`` (col, row,
    w, h) if given; else a row a dataset (path, name, numbers, texts, units, attributes, shape), whose values are null if there are many."""

    @classmethod
    def name(cls) -> str:
        return "hdf5"

    def schema(self) -> str:
        if "dataset" not in self.options:
            return "path string, name string, numbers array<double>, texts array<string>, units string, attributes map<string, string>, shape array<long>"
        found = _listed(self.options["path"])
        kind = None
        if found:
            f = opened(found[0])
            kind = f.dataset(f.find(self.options["dataset"])).kind
        return "path string, row long, col long, " + ("re double, im double" if kind is not None and not isinstance(kind, str) and kind.names else "value double")

    def reader(self, schema) -> DataSourceReader:
        return _PixelReader(dict(self.options), schema) if "dataset" in self.options else _TableReader(dict(self.options))


def pixels(spark: SparkSession, path: str, dataset: str, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Pixels of a raster dataset, see :class:`Hdf5Source`. Chunks that were never written give no rows."""
    spark.dataSource.register(Hdf5Source)
    reader = spark.read.format("hdf5").option("dataset", dataset)
    return (reader.option("window", ",".join(map(str, window))) if window else reader).load(path)


def datasets(spark: SparkSession, path: str) -> DataFrame:
    """A row a dataset of the files under a path, as ``hdf5meta.nisar`` takes them."""
    spark.dataSource.register(Hdf5Source)
    return spark.read.format("hdf5").load(path)
