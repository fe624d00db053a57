"""Files packed by hand and written by the library, read, indexed, cut, merged and laid out."""

import http.server
import io
import json
import math
import os
import struct
import threading
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fathom import errors as E
from fathom.sources import mdf4
from fathom.sources.blocks import Channel, Conversion, Group, Walk, recording
from fathom.sources.decode import BAD_TEXT, column, floats, payload_sizes, physical, portions, raw_numbers, string
from fathom.sources.files import cut_file, cut_file_utc, cut_files, merge_files
from fathom.sources.index import Index, catalog, data_blocks, find_channel, list_groups, masters, to_ns
from fathom.sources.layout import Layout
from fathom.sources.mdf4 import Reader
from fathom.sources.ranges import BytesRanges, CachedRanges, FileRanges, HttpRanges, MmapRanges
from fathom.sources.writer import FileWriter, channel_for, layout, records, slices, write_groups


class Packer:
    """Writes blocks one by one, from the published format, apart from the library's writer."""

    def __init__(self):
        self.b = bytearray(struct.pack("<8s8s8s4xH34x", b"MDF     ", b"4.10    ", b"test    ", 410))

    def put(self, name, links, body):
        self.b += bytes(-len(self.b) % 8)
        at = len(self.b)
        self.b += struct.pack("<4s4xQQ", name, 24 + 8 * len(links) + len(body), len(links)) + struct.pack(f"<{len(links)}Q", *links) + body
        return at

    def link(self, block, i, to):
        struct.pack_into("<Q", self.b, block + 24 + 8 * i, to)

    def text(self, s):
        return self.put(b"##TX", (), s.encode() + b"\0")

    def channel(self, after, name, dtype, byte, bits, bit=0, kind=0, sync=0, cc=0, data=0, flags=0, pos=0):
        return self.put(b"##CN", (after, 0, self.text(name) if name else 0, 0, cc, data, 0, 0), struct.pack("<BBBBIIIIBBH6d", kind, sync, dtype, bit, byte, bits, flags, pos, 0, 0, 0, *[0.0] * 6))

    def conversion(self, kind, values, refs=()):
        return self.put(b"##CC", (0, 0, 0, 0, *refs), struct.pack(f"<BBHHHdd{len(values)}d", kind, 0, 0, len(refs), len(values), 0, 0, *values))

    def header(self, start=0):
        return self.put(b"##HD", (0,) * 6, struct.pack("<QhhBBBBdd", start, 0, 0, 0, 0, 0, 0, 0, 0))

    def group(self, cn, cycles, data_bytes, inv=0, number=0, after=0):
        return self.put(b"##CG", (after, cn, 0, 0, 0, 0), struct.pack("<QQHH4xII", number, cycles, 0, 0, data_bytes, inv))


def one_group(build, rows: bytes, cycles, size, inv=0, start=0):
    p = Packer()
    head = p.header(start)
    cn = build(p)
    cg = p.group(cn, cycles, size, inv)
    dt = p.put(b"##DT", (), rows)
    p.link(head, 0, p.put(b"##DG", (0, cg, dt, 0), bytes(8)))
    return bytes(p.b)


def saved(tmp_path, raw, name="x.mf4"):
    path = str(tmp_path / name)
    with open(path, "wb") as f:
        f.write(raw)
    return path


def test_unsigned_signed_extremes(spark, tmp_path):
    def build(p):
        at, nxt = 30, 0
        for name, dtype, bits in reversed([("u8", 0, 8), ("u16", 1, 16), ("u32", 0, 32), ("u64", 0, 64), ("i32", 2, 32), ("i64", 3, 64), ("n3", 2, 3)]):
            at = {"u8": 0, "u16": 1, "u32": 3, "u64": 7, "i32": 15, "i64": 19, "n3": 27}[name]
            nxt = p.channel(nxt, name, dtype, at, bits, bit=2 if name == "n3" else 0)
        return nxt

    low = struct.pack("<B", 0) + struct.pack(">H", 0) + struct.pack("<IQi", 0, 0, -(2**31)) + struct.pack(">q", -(2**63)) + bytes([0b10000])
    high = struct.pack("<B", 255) + struct.pack(">H", 65535) + struct.pack("<IQi", 2**32 - 1, 2**64 - 1, 2**31 - 1) + struct.pack(">q", 2**63 - 1) + bytes([0b01100])
    df = mdf4.read(spark, saved(tmp_path, one_group(build, low + high, 2, 28)))
    assert df.schema["u64"].dataType.simpleString() == "decimal(20,0)"
    assert [tuple(r)[1:] for r in df.orderBy("_record").collect()] == [
        (0, 0, 0, Decimal(0), -(2**31), -(2**63), -4),
        (255, 65535, 2**32 - 1, Decimal(2**64 - 1), 2**31 - 1, 2**63 - 1, 3),
    ]
    assert df.select(F.col("u64").cast("double")).orderBy("u64").collect()[1][0] == 1.8446744073709552e19


def test_strings_and_widths():
    assert string(b"ab\0\0", 7) == "ab" and string(b"\xe9", 6) == "é" and string(b"\xff", 7) == BAD_TEXT[7]
    assert string(b"a", 8) is None and string(b"a", 8, True) == BAD_TEXT[8] and string(b"\xd8\x00\x00\x41", 9) == BAD_TEXT[9]
    rows = np.frombuffer(bytes(range(16)), np.uint8).reshape(2, 8)
    g = Group(None, None, 2, 8, 0, 0, 0, {})
    assert column(Channel("s", data_type=7, byte_offset=4, bits=64), rows, g, None).null_count == 2  # beyond the record
    assert raw_numbers(Channel("x", data_type=0, byte_offset=0, bit_offset=4, bits=64), rows, 0) is None
    assert raw_numbers(Channel("x", data_type=4, byte_offset=0, bits=16), rows, 0) is None
    assert np.isnan(floats(Channel("s", data_type=10, byte_offset=0, bits=64), rows, g)).all()


@pytest.mark.parametrize(
    "flags,inv,pos,want",
    [(1, b"\0\0", 0, True), (0, b"\xff\xff", 0, False), (2, b"\1\0", 0, True), (2, b"\x20\0", 5, True), (2, b"\0\x02", 9, True), (2, b"\0\x02", 8, False), (2, b"\0\0", 40, False), (3, b"\0\0", 3, True)],
)
def test_validity(flags, inv, pos, want):
    from fathom.sources.decode import invalid

    bad = invalid(Channel("x", bits=8, flags=flags, invalid_bit=pos), np.frombuffer(b"\7" + inv, np.uint8).reshape(1, 3), Group(None, None, 1, 1, 2, 0, 0, {}))
    assert (bad is not None and bool(bad[0])) == want


def test_conversions_follow_the_rules():
    x = np.array([0.0, 1.0, 2.5, 10.0, -1.0, math.nan, math.inf])

    def of(kind, values=(), refs=(), v=x):
        out = physical(Conversion(kind, list(values), list(refs)), v)
        return out if isinstance(out, list) else [None if a != a else a for a in out.tolist()]

    assert of(1, [1, 2], v=np.array([5])) == [11.0] and of(1, [1], v=np.array([5])) == [5.0]
    assert of(2, [0, 1, 1, 0, 1, 0]) == [0.0, 2.0, 3.5 / 2.5, 1.1, 0.0, None, math.inf]
    assert of(3, refs=["1/X"])[:2] == [math.inf, 1.0] and of(3, refs=["ln(X)"])[0] == -math.inf and of(3, refs=["frob(X)"])[1] == 1.0
    assert of(3, refs=["X^2 - 3*X + pi % 2"])[1] == pytest.approx(-2 + math.pi % 2)
    assert of(4, [0, 10, 2, 20])[:6] == [10.0, 15.0, 20.0, 20.0, 10.0, None]
    assert of(5, [0, 10, 2, 20])[:6] == [10.0, 10.0, 20.0, 20.0, 10.0, None]
    assert of(6, [0, 2.5, 7, 2.5, 10, 8, -1]) == [7.0, 7.0, 8.0, -1.0, -1.0, -1.0, -1.0]
    assert of(6, [0, 2, 7, 2, 10, 8, -1], v=np.array([2, 10, 11])) == [7.0, 8.0, -1.0]
    nested = Conversion(1, [0.0, 10.0])
    assert of(7, [0, 1], ["zero", nested, "other"]) == ["zero", "10.0", "other", "other", "other", "other", "other"]
    assert of(7, [0], ["zero", None])[:2] == ["zero", None]
    assert of(8, [0, 2.5, 2.5, 10], ["low", "mid", "rest"]) == ["low", "low", "mid", "rest", "rest", "rest", "rest"]
    assert of(8, [0, 1, 2], ["first", "b"])[:2] == ["first", "first"]
    assert of(9, [1, 2, 9], ["a", "b"], ["a", "b", "c", None]) == [1, 2, 9, None]
    assert of(9, [1], ["a"], ["x"]) == [None]
    assert of(10, [], ["a", "A", "b", None, "rest"], ["a", "b", "c"]) == ["A", "b", "rest"] and of(10, [], ["a", "A", None], ["c"]) == ["c"]
    bits = lambda n: struct.unpack("<d", struct.pack("<Q", n))[0]
    gear = Conversion(7, [0.0, 1.0], ["off", "on", None], name="gear")
    assert of(11, [bits(1), bits(6)], [gear, Conversion(7, [2.0, 4.0], ["two", "four", None])], np.array([1, 2, 5])) == ["gear = on", "gear = off|two", "gear = on|four"]


def test_conversion_chains():
    p = Packer()
    a = p.conversion(7, [1.0], (0,))
    b = p.conversion(7, [1.0], (a,))
    p.link(a, 4, b)
    with pytest.raises(E.ChainCycle):
        Walk(BytesRanges(bytes(p.b))).conversion(a)
    last = p.conversion(1, [0.0, 1.0])
    for _ in range(25):
        last = p.conversion(8, [0.0, 1.0], (last,))
    with pytest.raises(E.ChainTooDeep):
        Walk(BytesRanges(bytes(p.b))).conversion(last)


def test_conversions_and_master_in_the_reader(spark, tmp_path):
    def build(p):
        texts = [p.text(s) for s in ("OK", "WARN", "ERROR", "UNKNOWN")]
        status = p.channel(0, "Status", 0, 8, 32, cc=p.conversion(7, [0, 1, 2], texts))
        formula = p.channel(status, "Sq", 0, 8, 32, cc=p.conversion(3, [], (p.text("X^2"),)))
        return p.channel(formula, "Time", 4, 0, 64, kind=2, sync=1, cc=p.conversion(1, [100.0, 2.0]))

    raw = one_group(build, b"".join(struct.pack("<dI", 0.5 * i, k) for i, k in enumerate((0, 1, 2, 99))), 4, 12)
    path = saved(tmp_path, raw)
    rows = mdf4.read(spark, path).orderBy("_record").collect()
    assert [(r.Time, r.Sq, r.Status) for r in rows] == [(100.0, 0.0, "OK"), (101.0, 1.0, "WARN"), (102.0, 4.0, "ERROR"), (103.0, 9801.0, "UNKNOWN")]
    assert [r.Status for r in mdf4.read(spark, path, raw="true").orderBy("_record").collect()] == [0, 1, 2, 99]
    index = Index.build(raw)
    s = index["Status"]
    assert s.timestamps.tolist() == [100.0, 101.0, 102.0, 103.0] and len(s) == 4 and s.has_timestamps and not index["Time"].has_timestamps
    assert index.floats("Time", raw=True).tolist() == [0.0, 0.5, 1.0, 1.5] and np.isnan(index.floats("Status")).all()


def test_mixed_records_are_routed(spark, tmp_path):
    p = Packer()
    head = p.header()
    two = p.group(p.channel(0, "b", 0, 0, 16), 2, 2, number=2)
    one = p.group(p.channel(0, "a", 0, 0, 8), 3, 1, number=1, after=two)
    first, second = p.put(b"##DT", (), bytes([1, 10, 2, 7])), p.put(b"##DT", (), bytes([0, 1, 11, 2, 8, 0, 1, 12]))
    dl = p.put(b"##DL", (0, first, second), struct.pack("<B3xIQQ", 0, 2, 0, 4))
    p.link(head, 0, p.put(b"##DG", (0, one, dl, 0), bytes([1]) + bytes(7)))
    path = saved(tmp_path, bytes(p.b))
    assert [r.a for r in mdf4.read(spark, path).orderBy("_record").collect()] == [10, 11, 12]
    assert [r.b for r in mdf4.read(spark, path, group=1).orderBy("_record").collect()] == [7, 8]
    cut_file(path, path + ".cut", 0, 1)
    assert Index.build(path + ".cut").values("b").to_pylist() == [7, 8]


def table(n, at=0):
    i = np.arange(at, at + n)
    return pa.table({"Time": pa.array(i * 0.1), "Val": pa.array(i, pa.uint32()), "Msg": pa.array([f"m{k}" * (k % 3) for k in i]), "Raw": pa.array([bytes([k % 256]) * k for k in i], pa.binary())})


OPTIONS = {"master": "Time", "Val": {"linear": [10, 2], "unit": "kPa", "comment": "c", "source": {"name": "ecu", "path": "p", "comment": "q"}}}


def test_variable_length(spark, tmp_path):
    path = str(tmp_path / "v.mf4")
    big = pa.table({"Time": pa.array([0.0, 1.0, 2.0]), "Image": pa.array([b"a" * (1 << 20), b"b" * (5 << 20), b"c" * (256 << 10)], pa.binary())})
    write_groups(path, [("g", table(10), OPTIONS), ("big", big, {"master": "Time"})])
    want = table(10).to_pylist()
    rows = mdf4.read(spark, path).orderBy("_record").collect()
    assert [(r.Msg, bytes(r.Raw)) for r in rows] == [(w["Msg"], w["Raw"]) for w in want] and [r.Val for r in rows] == [10.0 + 2 * i for i in range(10)]
    index = Index.build(path)
    assert [len(x) for x in index.values("Image").to_pylist()] == [1 << 20, 5 << 20, 256 << 10]
    assert len(index.groups[1].channels[1].payload) == 3
    with pytest.raises(E.MdfError):
        index.byte_ranges("Image")
    cut_file(path, path + ".cut", 0.3, 1.0)
    cut = Index.build(path + ".cut")
    assert cut.values("Msg").to_pylist() == [w["Msg"] for w in want[3:]] and cut.values("Raw").to_pylist() == [w["Raw"] for w in want[3:]]
    assert [x[:1] for x in cut.values("Image").to_pylist()] == [b"b"]


def test_cut_keeps_metadata(tmp_path):
    path = str(tmp_path / "c.mf4")
    start = 1_700_000_000 * 10**9
    write_groups(path, [("g", table(10).select(["Time", "Val"]), OPTIONS), ("plain", pa.table({"x": pa.array([1, 2], pa.int16())}), {})], start_ns=start)
    cut_file(path, path + ".cut", 0.3, 0.5)
    index = Index.build(path + ".cut")
    c = index.groups[0].channels[1]
    assert index.values("Val").to_pylist() == [16.0, 18.0, 20.0] and (c.unit, c.comment, c.source.name, c.source.path) == ("kPa", "c", "ecu", "p")
    assert index.values("x").to_pylist() == [1, 2] and index.start_ns == start and index.groups[0].name == "g"
    cut_file_utc(path, path + ".utc", start / 1e9 + 0.2, start / 1e9 + 0.5)
    assert Index.build(path + ".utc").values("Val", raw=True).to_pylist() == [2, 3, 4, 5]
    write_groups(path, [("g", table(3).select(["Time"]), OPTIONS)])
    with pytest.raises(E.NoStartTime):
        cut_file_utc(path, path + ".utc", 0, 1)


def test_cut_stops_at_the_first_past_and_keeps_nan(tmp_path):
    path = str(tmp_path / "n.mf4")
    t = [0.0, 2.0, math.nan, 1.0, 5.0, 1.0]
    write_groups(path, [(None, pa.table({"Time": t, "i": pa.array(range(6), pa.uint8())}), {"master": "Time"})])
    cut_file(path, path + ".cut", 1.0, 3.0)
    assert Index.build(path + ".cut").values("i").to_pylist() == [1, 2, 3]


def test_cut_keeps_invalid_samples(spark, tmp_path):
    path = str(tmp_path / "i.mf4")
    write_groups(path, [(None, pa.table({"Time": pa.array([0.1 * i for i in range(10)]), "Val": pa.array([None if i in (2, 4) else i for i in range(10)], pa.uint32())}), {"master": "Time"})])
    cut_file(path, path + ".cut", 0.1, 0.5)
    assert Index.build(path + ".cut").values("Val").to_pylist() == [1, None, 3, None, 5]
    assert [r.Val for r in mdf4.read(spark, path + ".cut").orderBy("_record").collect()] == [1, None, 3, None, 5]


def test_merge(tmp_path):
    a, b, c = (str(tmp_path / f"{x}.mf4") for x in "abc")
    write_groups(a, [("g", table(3), OPTIONS)])
    write_groups(b, [("h", table(3, at=3), OPTIONS), ("other", pa.table({"B": pa.array([1], pa.uint32())}), {})])
    merge_files([a, b], c)
    index = Index.build(c)
    assert len(index.groups) == 2 and index.groups[0].name == "g"
    assert index.values("Msg").to_pylist() == table(6)["Msg"].to_pylist() and index.values("Raw").to_pylist() == table(6)["Raw"].to_pylist()
    assert index.values("Val", raw=True).to_pylist() == list(range(6)) and index.values("B").to_pylist() == [1]
    cut_file(c, c + ".cut", 0.2, 0.4)  # the time master stays one
    assert Index.build(c + ".cut").values("Val", raw=True).to_pylist() == [2, 3, 4]


def test_index_round_trip_and_lookups(tmp_path):
    path = str(tmp_path / "x.mf4")
    temperature = lambda v: pa.table({"Temperature": pa.array([v], pa.float32())})
    write_groups(path, [("one", temperature(25.0), {}), ("two", temperature(30.0), {}), (None, table(4), OPTIONS)])
    index = Index.build(path)
    index.save(path + ".json")
    again = Index.load(path + ".json")
    assert again.tree == index.tree and again.values("Temperature", "two").to_pylist() == [30.0] and again["Temperature"].values.to_pylist() == [25.0]
    assert again.find_all("Temperature") == [(0, 0), (1, 0)] and again.groups_with("Val") == [] and again.groups_with("Temperature") == ["one", "two"]
    assert again.group("two") == 1 and len(again.signals()) == 6 and again.channel_names(2) == ["Time", "Val", "Msg", "Raw"]
    for source in (path, FileRanges(path), MmapRanges(path), CachedRanges(FileRanges(path))):
        assert Index(index.tree, source).floats("Val").tolist() == [10.0, 12.0, 14.0, 16.0]
    with pytest.raises(E.NoSource):
        Index.from_json(Index.build(open(path, "rb").read()).to_json()).values("Val")
    with pytest.raises(E.NotFound):
        index.find("Nothing")
    assert index["Val", None].unit == "kPa" and index["Val"].series(10**18).index[1].value == 10**18 + 10**8


def test_byte_ranges(tmp_path):
    path = str(tmp_path / "b.mf4")
    write_groups(path, [("g", pa.table({"Ch1": pa.array([100 * i for i in range(5)], pa.uint32()), "Ch2": pa.array([10 * i for i in range(5)], pa.uint16())}), {})])
    index = Index.build(path)
    (at, n), = index.byte_ranges("Ch2", None, 1, 3)
    g = index.groups[0]
    assert (at, n) == (g.fragments[0][0] + g.record_size + 4, 2 * g.record_size + 2)
    raw = open(path, "rb").read()
    assert struct.unpack("<H", raw[at : at + 2])[0] == 10
    with pytest.raises(E.BeyondEnd):
        index.byte_ranges("Ch1", None, 3, 3)


def test_split_blocks_and_spark_round_trip(spark, tmp_path):
    path = str(tmp_path / "folder")
    df = spark.range(0, 300_000, numPartitions=3).select((F.col("id") * 0.001).alias("time"), F.when(F.col("id") % 7 != 0, F.col("id") * 2).alias("speed"), F.col("id").cast("float").alias("f"), F.expr("id * 1.0").cast("decimal(20,0)").alias("u"), F.concat(F.lit("s"), F.col("id") % 3).alias("s"))
    mdf4.write(df, path, master="time", group_name="g")
    assert len(os.listdir(path)) == 3 and not any(x.startswith(".") for x in os.listdir(path))
    back = mdf4.read(spark, path, records_per_partition=50_000)
    sums = [F.count("speed"), F.sum("speed"), F.round(F.sum("time"), 3), F.sum("u"), F.max("s")]
    assert back.count() == 300_000 and back.rdd.getNumPartitions() > 3 and back.agg(*sums).first() == df.agg(*sums).first()
    window = mdf4.read(spark, path, channels=["u"], first_record=150_000, records=3)
    assert [(r._record, int(r.u)) for r in window.collect()] == [(150_000 + i, 150_000 + i) for i in range(3)]
    with pytest.raises(Exception, match="records"):
        mdf4.read(spark, path, first_record=299_999, records=2).collect()
    one = str(tmp_path / "one.mf4")
    mdf4.write(df.coalesce(1), one, master="time")
    assert len(recording(one).groups[0].fragments) > 1 and mdf4.read(spark, one).count() == 300_000
    with pytest.raises(Exception, match="coalesce"):
        mdf4.write(df, str(tmp_path / "two.mf4"))
    assert not any(x.startswith(".part") for x in os.listdir(tmp_path))
    mdf4.write(df.limit(5), path, mode="overwrite")
    assert mdf4.read(spark, path).count() == 5


def test_catalog(spark, tmp_path):
    for k in range(2):
        write_groups(str(tmp_path / f"{k}.mf4"), [("a", table(3), OPTIONS), ("b", pa.table({"Val": pa.array([1.5])}), {})])
    c = catalog(spark, str(tmp_path))
    assert c.count() == 10 and list_groups(c).count() == 4 and masters(c).count() == 2
    assert {(r.group, r.channel) for r in find_channel(c, "Val").collect()} == {(0, 1)} and {r.group for r in find_channel(c, "Val", "b").collect()} == {1}
    row = c.where("channel_name = 'Val' AND group = 0").first()
    assert (row.unit, row.comment, row.source_name, row.records, json.loads(row.conversion)["values"]) == ("kPa", "c", "ecu", 3, [10.0, 2.0])
    assert data_blocks(spark, str(tmp_path)).agg(F.sum("records")).first()[0] == 8
    done = cut_files(spark, str(tmp_path), str(tmp_path / "out"), 0.1, 0.2).collect()
    assert [r.records for r in done] == [3, 3]


def test_layout(spark, tmp_path):
    path = str(tmp_path / "l.mf4")
    write_groups(path, [("a", table(3), OPTIONS), ("b", pa.table({"x": pa.array([1.5])}), {})])
    out = Layout(path)
    covered = sum(b.size for b in out.blocks) + sum(n for _, n in out.gaps())
    assert covered == out.size == os.path.getsize(path) and all(n < 8 for _, n in out.gaps())
    assert out.histogram()["##DG"] == 2 and out.histogram()["##CN"] == 5 and out.histogram()["##SD"] == 2
    assert [b.offset for b in out.blocks] == sorted(b.offset for b in out.blocks) and json.loads(out.to_json())["size"] == out.size
    assert out.tree().splitlines()[0].startswith("##ID @0") and "cn_first: ##CN" in out.tree() and "'kPa'" in out.table()
    blocks, links, _ = out.frames(spark)
    assert blocks.count() == len(out.blocks) and links.join(blocks, links["target"] == blocks["offset"], "left_anti").count() == 0
    out.save(path + ".txt", "tree")
    assert open(path + ".txt").read() == out.tree()
    raw = bytearray(open(path, "rb").read()) + bytes(100)
    assert Layout(bytes(raw)).gaps()[-1][1] >= 100


class Ranged(http.server.SimpleHTTPRequestHandler):
    data, asked = b"", 0

    def do_GET(self):
        type(self).asked += 1
        a, b = map(int, self.headers["Range"].removeprefix("bytes=").split("-"))
        part = self.data[a : b + 1]
        self.send_response(206)
        self.send_header("Content-Range", f"bytes {a}-{a + len(part) - 1}/{len(self.data)}")
        self.send_header("Content-Length", str(len(part)))
        self.end_headers()
        self.wfile.write(part)

    def log_message(self, *_):
        pass


def test_http_and_cache(spark, tmp_path):
    path = str(tmp_path / "h.mf4")
    names = [f"ch_{i}" for i in range(9)]
    write_groups(path, [(f"g{g}", pa.table({"t": pa.array(np.arange(200) * 0.1)} | {n: pa.array(np.arange(200) + g, pa.uint32()) for n in names}), {"master": "t"}) for g in range(10)])
    Ranged.data, Ranged.asked = open(path, "rb").read(), 0
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Ranged)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}/h.mf4"
        reader = CachedRanges(HttpRanges(url))
        index = Index.build(reader)
        for g in range(5):
            assert index.values("ch_3", f"g{g}").to_pylist() == [i + g for i in range(200)]
        assert Ranged.asked <= 10
        assert Index.build(url)["ch_1", "g2"].values.to_pylist()[0] == 2
        assert mdf4.read(spark, url, group="g4", channels=["ch_0"]).agg(F.sum("ch_0")).first()[0] == sum(range(200)) + 800
    finally:
        server.shutdown()
    cache = CachedRanges(BytesRanges(bytes(i % 251 for i in range(3 << 20))))
    assert all(cache.read(24 * k, 24) == bytes(i % 251 for i in range(24 * k, 24 * k + 24)) for k in range(200)) and cache.misses == 1
    cache.prefetch(1 << 20, 2 << 20)
    assert cache.misses == 3 and cache.read((1 << 20) - 5, 10) == bytes(i % 251 for i in range((1 << 20) - 5, (1 << 20) + 5)) and cache.misses == 3
    with pytest.raises(E.ShortRead):
        cache.read(3 << 20, 1)


def test_not_a_recording(tmp_path):
    with pytest.raises(E.NotMdf):
        recording(b"no" * 64)
    with pytest.raises(E.OldVersion):
        recording(struct.pack("<8s8s8s4xH34x", b"MDF     ", b"3.30    ", b"", 330) + bytes(200))
    raw = one_group(lambda p: p.channel(0, "x", 0, 0, 8), b"1", 1, 1).replace(b"##DT", b"##DZ")
    with pytest.raises(E.CompressedData):
        recording(raw)


def test_writer_refuses():
    for bad in (pa.field("x", pa.list_(pa.int8())), pa.field("x", pa.timestamp("us"))):
        with pytest.raises(E.CannotWrite):
            channel_for(bad, {})
    w, g = FileWriter(io.BytesIO()), layout([channel_for(pa.field("x", pa.int32()), {"unsigned": True})])
    w.begin(g)
    with pytest.raises(E.CannotWrite):
        records(g, pa.record_batch({"x": pa.array([-1], pa.int32())}))


def test_times():
    assert to_ns("1970-01-01T00:00:01Z") == to_ns("1970-01-01T00:00:01") == to_ns(1) == to_ns(1.0) == 10**9 and to_ns("1970-01-01T01:00:00+01:00") == 0
    with pytest.raises(E.MdfError):
        to_ns(math.nan)


def test_stream(spark, tmp_path):
    from fathom.streaming.recordings import Mdf4Stream

    folder = tmp_path / "in"
    folder.mkdir()
    write_groups(str(folder / "a.mf4"), [("g", table(3), OPTIONS)])
    spark.dataSource.register(Mdf4Stream)
    df = spark.readStream.format("mdf4_stream").load(str(folder))

    def run():
        q = df.select("Time", "Val").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(60)
        return spark.read.parquet(str(tmp_path / "out")).count()

    assert run() == 3
    write_groups(str(folder / "b.mf4"), [("g", table(4, at=3), OPTIONS)])
    assert run() == 7


def test_a_missing_payload(spark, tmp_path):
    def build(p):
        sd = p.put(b"##SD", (), struct.pack("<I", 2) + b"ok")
        return p.channel(0, "Msg", 7, 0, 64, kind=1, data=sd)

    path = saved(tmp_path, one_group(build, struct.pack("<QQ", 0, 99), 2, 8))
    assert [r.Msg for r in mdf4.read(spark, path).orderBy("_record").collect()] == ["ok", None]
    with pytest.raises(E.WrongBlock):
        cut_file(path, path + ".cut", 0, 1)


def test_binary_sends_no_contents_to_the_driver(spark, tmp_path):
    from fathom.sources.binary import read_binary

    folder = tmp_path / "in [1]"
    folder.mkdir()
    for k in range(6):
        t = pa.table({"key": pa.array([k]), "raw": pa.array([bytes([k]) * (6 << 20)], pa.binary())})
        write_groups(str(folder / f"{k}.mf4"), [("g", t, {})])

    def sent():
        jvm, store = spark.sparkContext._jvm, spark.sparkContext._jsc.sc().statusStore()
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(i).resultSize() for i in range(stages.size()))

    before = sent()
    df = read_binary(spark, str(tmp_path / "in*"))
    rows = df.selectExpr("key", "_record", "length(raw) n", "hex(substr(raw, 1, 1)) h", "_file").orderBy("key").collect()
    assert [(r.key, r._record, r.n, r.h) for r in rows] == [(k, 0, 6 << 20, f"{k:02X}") for k in range(6)] and rows[3]._file.endswith("in [1]/3.mf4")
    assert sent() - before < 1 << 20
    (tmp_path / "bad").mkdir()
    saved(tmp_path / "bad", b"no" * 64)
    with pytest.raises(E.NotMdf):
        read_binary(spark, str(tmp_path / "bad"))
    with pytest.raises(E.NotFound):
        read_binary(spark, str(tmp_path / "in*"), group="none")


def test_payloads_are_held_in_portions(tmp_path):
    texts = [chr(97 + k % 26) * (k % 5 << 18) for k in range(80)]  # 40 MB
    t = pa.table({"key": pa.array(range(80), pa.decimal128(20, 0)), "text": pa.array([None if k == 7 else x for k, x in enumerate(texts)])})
    parts = list(slices(t.to_batches()[0]))
    assert pa.Table.from_batches(parts) == t and len(parts) > 4 and max(sum(len(x) for x in p["text"].to_pylist() if x) for p in parts) <= 8 << 20
    path = str(tmp_path / "x.mf4")
    with open(path, "wb") as f:
        w, g = FileWriter(f), layout([channel_for(x, {}) for x in t.schema])
        w.begin(g)
        for p in parts:
            w.append(*records(g, p))
        w.finish()
        w.close()
    g = recording(path).groups[0]
    reader = Reader([(path, g)], mdf4.columns(g), False, 1000)
    read = list(reader.read(reader.partitions()[0]))
    assert max(b.nbytes for b in read) < 9 << 20 and pa.Table.from_batches(read).drop(["_record"]).to_pylist() == t.to_pylist()
    assert pa.Table.from_batches(read)["_record"].to_pylist() == list(range(80))
    keys = Reader([(path, g)], mdf4.columns(g, ["key"]), False, 1000)
    assert [b.num_rows for b in keys.read(keys.partitions()[0])] == [80]  # no payload is wanted


def test_payload_sizes_from_slots():
    raw = b"".join(struct.pack("<I", n) + bytes(n) for n in (3, 0, 9))
    c, source = Channel("x", kind=1, data_type=10, bits=64, payload=[(0, 10), (10, len(raw) - 10)]), BytesRanges(raw)
    for slots, want in (([0, 7, 11], [7, 4, 13]), ([11, 0, 7, 11], [13, 7, 4, 13]), ([0], [7]), ([11, 99, 1 << 63], [13, 0, 0]), ([0, 11], [11, 13]), ([], [])):
        rows = np.array(slots, "<u8").view(np.uint8).reshape(-1, 8)
        assert payload_sizes(c, rows, 0, source).tolist() == want
    assert list(portions(np.array([3, 3, 9, 1, 1, 0, 5]), 6)) == [(0, 2), (2, 3), (3, 6), (6, 7)] and not list(portions(np.zeros(0, int)))


def test_names_of_the_package():
    import fathom

    assert all(getattr(fathom, name) for name in fathom.__all__) and fathom.Index is Index
    with pytest.raises(AttributeError):
        fathom.nothing
