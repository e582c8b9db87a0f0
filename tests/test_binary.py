"""Map data and transport files, written here byte by byte."""

import datetime as dt
import struct
import zlib

import numpy as np
import pytest

from tablewright.sources import osm, readers, text, xport


def varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while True:
        out.append(n & 127 | (128 if n >> 7 else 0))
        n >>= 7
        if not n:
            return bytes(out)


def zig(n: int) -> int:
    return n << 1 if n >= 0 else (-n << 1) - 1


def field(number: int, value) -> bytes:
    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def run(values, delta=True) -> bytes:
    values = list(values)
    return b"".join(varint(zig(b - a)) for a, b in zip([0, *values], values, strict=False)) if delta else b"".join(map(varint, values))


def blob(kind: bytes, data: bytes, plain: bool = False) -> bytes:
    body = field(1, data) if plain else field(2, len(data)) + field(3, zlib.compress(data))
    head = field(1, kind) + field(3, len(body))
    return struct.pack(">I", len(head)) + head + body


STRINGS = [b"", b"name", "Zürich".encode(), b"highway", b"path", b"outer"]
TABLE = field(1, b"".join(field(1, s) for s in STRINGS))


def map_file(path, needs=(b"OsmSchema-V0.6", b"DenseNodes")):
    at = {1: (470_000_000, 80_000_000), 2: (470_000_010, 80_000_000), 3: (-470_000_010, -80_000_020), 7: (10, 20)}
    dense = field(1, run([1, 2, 3])) + field(5, field(1, run([4, 5, 6], False)) + field(2, run([1_400_000_000, 1_400_000_001, 1_400_000_001])))
    dense += field(8, run([at[i][0] for i in (1, 2, 3)])) + field(9, run([at[i][1] for i in (1, 2, 3)])) + field(10, run([1, 2, 0, 0, 1, 2, 3, 4, 0], False))
    node = field(1, zig(7)) + field(2, run([1], False)) + field(3, run([2], False)) + field(4, field(1, 9)) + field(8, zig(10)) + field(9, zig(20))
    first = TABLE + field(2, field(2, dense)) + field(2, field(1, node))
    way = lambda i, refs: field(1, i) + field(2, run([3], False)) + field(3, run([4], False)) + field(4, field(1, 2) + field(2, 1_400_000_000)) + field(8, run(refs))
    relation = field(1, 50) + field(8, run([5, 0], False)) + field(9, run([10, 7])) + field(10, run([1, 0], False))
    second = TABLE + field(2, field(3, way(10, [1, 2, 2, 3])) + field(3, way(11, [1, 99])) + field(3, way(12, [2, 2]))) + field(2, field(4, relation))
    path.write_bytes(blob(b"OSMHeader", b"".join(field(4, n) for n in needs)) + blob(b"OSMData", first) + blob(b"OSMData", second, plain=True))
    return str(path)


def test_map_data(spark, tmp_path):
    p = map_file(tmp_path / "x.osm.pbf")
    assert len(osm.blocks(p)) == 2
    nodes = {r.id: r for r in osm.osm(spark, p, "nodes").collect()}
    assert sorted(nodes) == [1, 2, 3, 7] and (nodes[1].lat, nodes[1].lon, nodes[1].version) == (47.0, 8.0, 4) and nodes[3].lat < 0 and nodes[7].version == 9
    assert nodes[1].timestamp == "2014-05-13T16:53:20+00:00" and nodes[7].timestamp is None
    assert [tuple(t) for t in nodes[1].tags] == [("name", "Zürich")] and nodes[2].tags == [] and [tuple(t) for t in nodes[3].tags] == [("name", "Zürich"), ("highway", "path")]
    assert bytes(nodes[1].geometry) == struct.pack("<BIdd", 1, 1, 8.0, 47.0)
    df = osm.osm(spark, p, "ways")
    ways = {r.id: r for r in df.collect()}
    assert ways[10].refs == [1, 2, 2, 3] and ways[11].geometry is None and ways[12].geometry is None and "geo" in df.schema["geometry"].metadata
    points = [x for i in (1, 2, 3) for x in (nodes[i].lon, nodes[i].lat)]
    assert bytes(ways[10].geometry) == struct.pack("<BII6d", 1, 2, 3, *points)
    relation = text.HANDLERS["map_elements"](spark, p, "relations").first()
    assert relation.id == 50 and [tuple(m) for m in relation.members] == [(10, "outer", "w"), (7, "", "n")]
    with pytest.raises(readers.BadRecord, match="needs Magic"):
        osm.osm(spark, map_file(tmp_path / "y.osm.pbf", (b"Magic",)), "nodes")
    with pytest.raises(ValueError, match="one of"):
        osm.osm(spark, p, "areas")


def test_packed_numbers():
    values = [0, 1, 127, 128, 300, 2**40, 2**63 - 1]
    assert osm.packed(b"".join(map(varint, values))).tolist() == values
    assert osm.signed(osm.packed(run([5, -7, 2**40, -(2**40)]))).tolist() == [5, -12, 2**40 + 7, -(2**41)]


def ibm(x: float) -> bytes:
    if x == 0:
        return bytes(8)
    sign, x, exponent = (128 if x < 0 else 0), abs(x), 64
    while x >= 1:
        x, exponent = x / 16, exponent + 1
    while x < 1 / 16:
        x, exponent = x * 16, exponent - 1
    return bytes([sign | exponent]) + int(x * 2**56).to_bytes(7, "big")


def transport(path, rows, label=b"Weight"):
    pad = lambda b, n=80: b.ljust(n)
    head = lambda kind, tail=b"000000000000000000000000000000": pad(b"HEADER RECORD*******" + kind + b"!!!!!!!" + tail)
    columns = [(1, 8, b"W", label, b""), (2, 5, b"NAME", b"", b""), (1, 8, b"DAY", b"", b"DATE"), (1, 4, b"SHORT", b"", b"")]
    names, at = b"", 0
    for kind, size, name, text_label, form in columns:
        names += struct.pack(">hhhh", kind, 0, size, 0) + pad(name, 8) + pad(text_label, 40) + pad(form, 8) + bytes(6) + b"  " + pad(b"", 8) + bytes(4) + struct.pack(">i", at) + bytes(52)
        at += size
    count = f"{len(columns):04d}".encode()
    out = head(b"LIBRARY HEADER RECORD") + pad(b"SAS") + pad(b"x") + head(b"MEMBER  HEADER RECORD", b"000000000000000001600000000140  ") + head(b"DSCRPTR HEADER RECORD") + pad(b"SAS") + pad(b"x")
    out += pad(b"HEADER RECORD*******NAMESTR HEADER RECORD!!!!!!!000000" + count + b"00000000000000000000") + pad(names, -(-len(names) // 80) * 80) + head(b"OBS     HEADER RECORD")
    data = b"".join(rows)
    path.write_bytes(out + pad(data, -(-len(data) // 80) * 80))
    return str(path)


def test_transport_file(spark, tmp_path):
    day = (dt.date(2020, 2, 29) - dt.date(1960, 1, 1)).days
    row = lambda w, name, d, s: w + name.ljust(5) + d + s
    rows = [row(ibm(1.5), b"a", ibm(day), ibm(-2)[:4]), row(b"." + bytes(7), "é".encode(), b"A" + bytes(7), ibm(0)[:4]), row(ibm(-0.1), b"", ibm(0), ibm(1024)[:4])] * 3
    df = text.HANDLERS["transport_file"](spark, transport(tmp_path / "a.xpt", rows))
    got = df.collect()
    assert df.dtypes == [("W", "double"), ("NAME", "string"), ("DAY", "date"), ("SHORT", "double")] and df.schema["W"].metadata == {"sas_label": "Weight"}
    assert len(got) == 9 and tuple(got[0]) == (1.5, "a", dt.date(2020, 2, 29), -2.0) and tuple(got[1]) == (None, "é", None, 0.0)
    assert abs(got[2].W + 0.1) < 1e-15 and got[2].NAME == "" and got[2].DAY == dt.date(1960, 1, 1) and got[2].SHORT == 1024.0
    latin = xport.xport(spark, transport(tmp_path / "b.xpt", [row(ibm(1), b"\xb4", ibm(0), ibm(0)[:4]), row(ibm(2), "é".encode(), ibm(0), ibm(0)[:4])]))
    assert [r.NAME for r in latin.collect()] == ["\xb4", "Ã©"]
    (tmp_path / "c.xpt").write_bytes(b"x" * 800)
    with pytest.raises(readers.BadRecord, match="no transport file"):
        xport.xport(spark, str(tmp_path / "c.xpt"))


def test_ibm_numbers():
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(size=200) * 10.0 ** rng.integers(-20, 20, 200), [0.0, 1.0, -1.0, 16.0]])
    raw = np.frombuffer(b"".join(ibm(float(v)) for v in values), np.uint8).reshape(-1, 8)
    got, missing = xport.ibm_doubles(raw)
    assert not missing.any() and np.allclose(got, values, rtol=1e-15)
