"""HDF5: structures made byte by byte, round trips of own files, and windows that read their chunks only."""

import io
import struct
import zlib

import numpy as np
import pytest

from radarframe.sources import hdf5, hdf5meta

RNG = np.random.default_rng(7)
IMAGE = (RNG.normal(size=(150, 90)) + 1j * RNG.normal(size=(150, 90))).astype("c8")


def test_datasets_come_back(tmp_path):
    held = {"a/b/c": IMAGE, "a/v": np.arange(700).reshape(35, 20).astype("i2"), "a/one": np.float64(2.5), "t": np.array(["ab", "c"]), "z": np.zeros((0,), "f4"), "cube": RNG.normal(size=(5, 6, 7))}
    held |= {f"many/d{k}": np.array([k], "u4") for k in range(60)}
    f = hdf5.File(io.BytesIO(hdf5.encoded(held, (32, 16), {"a/v": {"units": "m", "scale": 0.5}})))
    found = dict(f.walk())
    assert set(found) == set(held)
    for path, want in held.items():
        got = f.read(f.dataset(f.find(path)))
        want = np.asarray(want)
        got = got["r"] + 1j * got["i"] if got.dtype.names else got
        assert got.shape == want.shape and (got == (np.char.encode(want) if want.dtype.kind == "U" else want)).all()
    assert found["a/v"].attributes["units"] == b"m" and found["a/v"].attributes["scale"] == 0.5
    with pytest.raises(KeyError):
        f.find("a/nothing")


def test_many_chunks_need_a_tree_of_two_levels():
    f = hdf5.File(io.BytesIO(hdf5.encoded({"v": np.arange(90 * 40, dtype="f4").reshape(90, 40)}, (5, 4))))
    d = f.dataset(f.find("v"))
    assert len(list(f.chunks(d))) == 18 * 10 and (f.read(d).ravel() == np.arange(3600)).all()
    assert sorted({c[0][0] for c in f.chunks(d, 12, 21)}) == [10, 15, 20]


def test_a_window_reads_its_chunks_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(hdf5, "PART_BYTES", 4000)
    (tmp_path / "x.h5").write_bytes(hdf5.encoded({"s/img": IMAGE}, (32, 32)))
    (tmp_path / "other.txt").write_text("no")
    reader = hdf5._PixelReader({"path": f"file://{tmp_path}", "dataset": "s/img", "window": "30,70,40,20"}, hdf5.pixels(spark, f"file://{tmp_path}", "s/img").schema)
    parts = reader.partitions()
    assert sorted(c[0] for p in parts for c in p.chunks) == [(64, 0), (64, 32), (64, 64)] and len(parts) == 3
    got = hdf5.pixels(spark, f"file://{tmp_path}", "s/img", (30, 70, 40, 20)).toPandas()
    assert len(got) == 800 and (got["row"].min(), got["row"].max(), got["col"].min(), got["col"].max()) == (70, 89, 30, 69)
    assert (got["re"].to_numpy() == IMAGE.real[got["row"], got["col"]]).all() and (got["im"].to_numpy() == IMAGE.imag[got["row"], got["col"]]).all()
    beyond = hdf5.pixels(spark, f"file://{tmp_path}", "s/img", (80, 140, 40, 40)).count()
    assert beyond == 10 * 10 and hdf5.pixels(spark, f"file://{tmp_path}", "s/img", (500, 0, 5, 5)).count() == 0
    assert hdf5.pixels(spark, f"file://{tmp_path}/x.h5", "s/img").count() == IMAGE.size


def test_version_two_headers_links_and_layouts():
    """A file of newer structures put together by hand: superblock 2, OHDR, link messages, a single filtered chunk, implicit chunks, contiguous, compact, variable strings."""
    out = bytearray(48)

    def put(data):
        out.extend(bytes(-len(out) % 8))
        out.extend(data)
        return len(out) - len(data)

    def header(messages):
        body = b"".join(struct.pack("<BHB", k, len(m), 0) + m for k, m in messages)
        return put(b"OHDR" + struct.pack("<BBI", 2, 2, len(body)) + body + bytes(4))

    real = struct.pack("<BBBBIHHBBBBI", 0x11, 0x20, 31, 0, 4, 0, 32, 23, 8, 0, 23, 127)
    shape = lambda *s: struct.pack(f"<BBBB{len(s)}Q", 2, len(s), 0, 1, *s)
    link = lambda n, a: (6, struct.pack("<BBB", 1, 0, len(n)) + n.encode() + struct.pack("<Q", a))
    v = np.arange(12, dtype="<f4").reshape(3, 4)
    raw = zlib.compress(np.frombuffer(v.tobytes(), np.uint8).reshape(-1, 4).T.tobytes())
    single = struct.pack("<BBBBB3IB", 4, 2, 2, 3, 4, 3, 4, 4, 1) + struct.pack("<QIQ", len(raw), 0, put(raw))
    pipeline = struct.pack("<BB", 2, 2) + struct.pack("<HHHI", 2, 0, 1, 4) + struct.pack("<HHHI", 1, 0, 1, 4)
    a = header([(1, shape(3, 4)), (3, real), (0x0B, pipeline), (8, single)])
    blocks = put(b"".join(np.pad(v, ((0, 1), (0, 0)))[i : i + 2, j : j + 2].tobytes() for i in (0, 2) for j in (0, 2)))
    b = header([(1, shape(3, 4)), (3, real), (8, struct.pack("<BBBBB3IBQ", 4, 2, 0, 3, 4, 2, 2, 4, 2, blocks))])
    c = header([(1, shape(3, 4)), (3, real), (8, struct.pack("<BBQQ", 4, 1, put(v.tobytes()), 48))])
    d = header([(1, shape(2)), (3, real), (8, struct.pack("<BBH", 4, 0, 8) + v[0, :2].tobytes())])
    heap = put(b"GCOL" + struct.pack("<B3xQ", 1, 64) + struct.pack("<HHIQ", 1, 1, 0, 5) + b"hello\0\0\0" + struct.pack("<HHIQ", 0, 0, 0, 0) + bytes(8))
    text = struct.pack("<BBBBI", 0x19, 1, 0, 0, 16) + struct.pack("<B3xI", 0x13, 1)
    said = (0x0C, struct.pack("<BBHHHB", 3, 0, 6, len(text), len(shape(1)), 0) + b"units\0" + text + shape(1) + struct.pack("<IQI", 5, heap, 1))
    e = header([(1, shape(1)), (3, text), (8, struct.pack("<BBQQ", 4, 1, put(struct.pack("<IQI", 5, heap, 1)), 16)), said])
    group = header([(2, struct.pack("<BBQQ", 0, 0, hdf5.NOWHERE, hdf5.NOWHERE)), link("a", a), link("b", b)])
    root = header([link("g", group), link("c", c), link("d", d), link("e", e)])
    out[:48] = hdf5.SIGNATURE + struct.pack("<BBBBQQQQI", 2, 8, 8, 0, 0, hdf5.NOWHERE, len(out), root, 0)
    f = hdf5.File(io.BytesIO(bytes(out)))
    got = {p: f.read(x) for p, x in f.walk()}
    assert all((got[p] == v).all() for p in ("g/a", "g/b", "c")) and (got["d"] == v[0, :2]).all() and got["e"].tolist() == [b"hello"]
    assert f.dataset(f.find("e")).attributes["units"].tolist() == [b"hello"]


def test_what_isnt_read_says_so():
    with pytest.raises(ValueError, match="not an HDF5"):
        hdf5.File(io.BytesIO(b"x" * 4000))
    with pytest.raises(ValueError, match="filter 32000"):
        hdf5.unpacked(b"", [(32000, [])], 0, np.dtype("f4"), (0,))
    with pytest.raises(ValueError, match="class 7"):
        hdf5._kind(struct.pack("<B3xI", 0x17, 8))


def test_products_are_read_from_files(spark, tmp_path):
    """A NISAR product's datasets, written to a file, give the row that tables of them give."""
    from test_hdf5meta import _nisar

    values, units = {}, {}
    for _, name, numbers, texts, unit in _nisar("p"):
        values[name] = np.array(texts) if texts is not None else np.array(numbers, float)
        if unit:
            units[name] = {"units": unit}
    (tmp_path / "p.h5").write_bytes(hdf5.encoded(values, attributes=units))
    schema = "path string, name string, numbers array<double>, texts array<string>, units string"
    want = hdf5meta.nisar(spark.createDataFrame(_nisar("p"), schema)).drop("path").first()
    assert hdf5meta.nisar(hdf5.datasets(spark, f"file://{tmp_path}").drop("attributes", "shape")).drop("path").first() == want


def test_files_from_pixels(spark, tmp_path):
    from pyspark.sql import functions as F

    df = spark.range(3000).select((F.col("id") % 2).alias("k"), F.floor(F.col("id") / 100).alias("row"), F.floor(F.col("id") % 100 / 2).alias("col"), F.col("id").cast("double").alias("v"))
    hdf5.save(hdf5.files(df, "data/v", "v", ["k"], (8, 8)).select(F.concat(F.lit("f"), F.col("k")).alias("name"), "content"), f"file://{tmp_path}/out")
    got = hdf5.pixels(spark, f"file://{tmp_path}/out", "data/v")
    assert got.count() == 3000 and got.agg(F.sum("value")).first()[0] == 2999 * 1500
    tables = hdf5.datasets(spark, f"file://{tmp_path}/out").collect()
    assert [(r.name, r.shape, len(r.numbers)) for r in tables] == [("data/v", [30, 50], 1500)] * 2
