"""Blocks of MDF 4.1 files: the tree of groups and channels, where data lies, and how blocks are written."""

from __future__ import annotations

import struct
from dataclasses import asdict, dataclass, field

from fathom.errors import ChainCycle, ChainTooDeep, CompressedData, NotMdf, OldVersion, WrongBlock
from fathom.sources.ranges import open_ranges

DEPTH = 20
DATA = (b"##DT", b"##DV", b"##SD", b"##RD")


@dataclass
class Conversion:
    kind: int
    values: list[float] = field(default_factory=list)
    refs: list = field(default_factory=list)  # texts, nested conversions or None
    name: str | None = None
    unit: str | None = None


@dataclass
class Source:
    name: str | None = None
    path: str | None = None
    comment: str | None = None


@dataclass
class Channel:
    name: str | None
    kind: int = 0
    sync: int = 0
    data_type: int = 0
    bit_offset: int = 0
    byte_offset: int = 0
    bits: int = 0
    flags: int = 0
    invalid_bit: int = 0
    unit: str | None = None
    comment: str | None = None
    source: Source | None = None
    conversion: Conversion | None = None
    payload: list | None = None  # (offset, bytes) of a variable-length channel's fragments

    @property
    def master(self) -> bool:
        return self.kind == 2

    @property
    def time(self) -> bool:
        return self.kind == 2 and self.sync == 1

    @property
    def variable(self) -> bool:
        return self.kind == 1 and self.payload is not None

    @property
    def width(self) -> int:
        return self.bits // 8 if self.data_type >= 6 and not self.variable else max(1, -(-(self.bit_offset + self.bits) // 8))


@dataclass
class Group:
    name: str | None
    comment: str | None
    records: int
    data_bytes: int
    invalid_bytes: int
    id_bytes: int
    record_id: int
    siblings: dict  # record sizes by record id where groups share their data
    source: Source | None = None
    channels: list[Channel] = field(default_factory=list)
    fragments: list = field(default_factory=list)  # (offset, bytes)

    @property
    def record_size(self) -> int:
        return self.id_bytes + self.data_bytes + self.invalid_bytes

    @property
    def mixed(self) -> bool:
        return len(self.siblings) > 1

    def master(self) -> Channel | None:
        return next((c for c in self.channels if c.master), None)


@dataclass
class Recording:
    start_ns: int
    tz_min: int
    dst_min: int
    comment: str | None
    groups: list[Group]
    size: int


class Walk:
    """Reads blocks through a reader of ranges."""

    def __init__(self, reader):
        self.reader = reader
        self.texts: dict[int, str | None] = {}

    def head(self, at: int) -> tuple[bytes, int, int]:
        return struct.unpack("<4s4xQQ", self.reader.read(at, 24))

    def block(self, at: int, kind: bytes | None = None) -> tuple[bytes, tuple[int, ...], bytes]:
        name, size, n = self.head(at)
        if kind and name != kind:
            raise WrongBlock(f"{name!r} at {at}, not {kind!r}")
        body = self.reader.read(at + 24, size - 24)
        return name, struct.unpack_from(f"<{n}Q", body), body[8 * n :]

    def text(self, at: int) -> str | None:
        if at and at not in self.texts:
            name, _, body = self.block(at)
            self.texts[at] = body.decode("utf-8", "replace").strip("\0") if name in (b"##TX", b"##MD") else None
        return self.texts.get(at)

    def source(self, at: int) -> Source | None:
        if not at:
            return None
        _, links, _ = self.block(at, b"##SI")
        return Source(*map(self.text, links[:3]))

    def conversion(self, at: int, above: tuple[int, ...] = ()) -> Conversion | None:
        if not at:
            return None
        if at in above:
            raise ChainCycle(f"the conversion at {at} refers to itself")
        if len(above) >= DEPTH:
            raise ChainTooDeep(f"conversions nest deeper than {DEPTH} at {at}")
        name, links, body = self.block(at)
        if name != b"##CC":
            return None
        n = struct.unpack_from("<H", body, 6)[0]
        refs = [None if not r else self.conversion(r, (*above, at)) if self.head(r)[0] == b"##CC" else self.text(r) for r in links[4:]]
        return Conversion(body[0], list(struct.unpack_from(f"<{n}d", body, 24)), refs, self.text(links[0]), self.text(links[1]))

    def fragments(self, at: int) -> list[tuple[int, int]]:
        """(offset, bytes) of a data block or of a list of them."""
        out, seen = [], set()
        while at and at not in seen:
            seen.add(at)
            name, size, n = self.head(at)
            if name in DATA:
                return [*out, (at + 24, size - 24)]
            if name != b"##DL":
                raise CompressedData(f"can't read data in {name!r} blocks") if name in (b"##DZ", b"##HL") else WrongBlock(f"{name!r} at {at} holds no data")
            links = struct.unpack(f"<{n}Q", self.reader.read(at + 24, 8 * n))
            for link in links[1:]:
                if link:
                    out += self.fragments(link)
            at = links[0]
        return out

    def channels(self, at: int) -> list[Channel]:
        out = []
        while at:
            _, c, b = self.block(at, b"##CN")
            kind, sync, dtype, bit = b[:4]
            byte, bits, flags, pos = struct.unpack_from("<IIII", b, 4)
            payload = self.fragments(c[5]) if kind == 1 and c[5] and self.head(c[5])[0] in (b"##SD", b"##DL") else [] if kind == 1 and c[5] else None
            out.append(Channel(self.text(c[2]), kind, sync, dtype, bit, byte, bits, flags, pos, self.text(c[6]), self.text(c[7]), self.source(c[3]), self.conversion(c[4]), payload))
            at = c[0]
        return out

    def recording(self) -> Recording:
        first = self.reader.read(0, 64) if self.reader.size >= 64 else b""
        if first[:8] != b"MDF     ":
            raise NotMdf("not an MDF file")
        if struct.unpack_from("<H", first, 28)[0] < 410:
            raise OldVersion(f"version {first[8:16].decode('latin-1').strip()} is before 4.10")
        _, links, body = self.block(64, b"##HD")
        start, tz, dst = struct.unpack_from("<Qhh", body)
        dg, groups = links[0], []
        while dg:
            _, (after, cg, data, _), body_ = self.block(dg, b"##DG")
            own = []
            while cg:
                _, g, b = self.block(cg, b"##CG")
                number, cycles, _, _, n, inv = struct.unpack_from("<QQHH4xII", b)
                own.append(Group(self.text(g[2]), self.text(g[5]), cycles, n, inv, body_[0], number, {}, self.source(g[3]), self.channels(g[1])))
                cg = g[0]
            where = self.fragments(data) if data else []
            sizes = {str(g.record_id): g.record_size for g in own}
            for g in own:
                g.fragments, g.siblings = where, sizes
            groups += own
            dg = after
        return Recording(start, tz, dst, self.text(links[5]), groups, self.reader.size)


def recording(source) -> Recording:
    """The metadata of a file, address, bytes or reader; no sample is read."""
    reader = open_ranges(source)
    try:
        return Walk(reader).recording()
    finally:
        if reader is not source:
            reader.close()


def to_plain(r: Recording) -> dict:
    return asdict(r)


def from_plain(d: dict) -> Recording:
    def conversion(c):
        return None if c is None else Conversion(c["kind"], c["values"], [conversion(x) if isinstance(x, dict) else x for x in c["refs"]], c["name"], c["unit"])

    def source(x):
        return None if x is None else Source(**x)

    def channel(c):
        pairs = None if c["payload"] is None else [tuple(p) for p in c["payload"]]
        return Channel(**(c | {"source": source(c["source"]), "conversion": conversion(c["conversion"]), "payload": pairs}))

    def group(g):
        return Group(**(g | {"source": source(g["source"]), "channels": [channel(c) for c in g["channels"]], "fragments": [tuple(p) for p in g["fragments"]]}))

    return Recording(**(d | {"groups": [group(g) for g in d["groups"]]}))
