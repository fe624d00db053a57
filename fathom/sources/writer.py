"""Writes MDF 4.1 files in one pass: records go out as they come, links and counts are patched at the end of a group."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from fathom.errors import CannotWrite
from fathom.sources.blocks import Channel, Conversion, Group, Source
from fathom.sources.decode import portions

SPLIT = 4 << 20


def number_channel(name: str, data_type: int, bits: int, **more) -> Channel:
    return Channel(name, data_type=data_type, bits=bits, **more)


def channel_for(f: pa.Field, meta: dict) -> Channel:
    """The channel that a column is written as; ``meta``: unit, comment, unsigned, source, linear, texts, default."""
    t = f.type
    if pa.types.is_boolean(t):
        c = number_channel(f.name, 0, 8)
    elif pa.types.is_unsigned_integer(t) or pa.types.is_signed_integer(t) and meta.get("unsigned"):
        c = number_channel(f.name, 0, t.bit_width)
    elif pa.types.is_signed_integer(t):
        c = number_channel(f.name, 2, t.bit_width)
    elif pa.types.is_float32(t) or pa.types.is_float64(t):
        c = number_channel(f.name, 4, t.bit_width)
    elif pa.types.is_decimal(t) and t.precision <= 20 and t.scale == 0:
        c = number_channel(f.name, 0, 64)
    elif pa.types.is_string(t) or pa.types.is_large_string(t):
        c = Channel(f.name, kind=1, data_type=7, bits=64, payload=[])
    elif pa.types.is_binary(t) or pa.types.is_large_binary(t):
        c = Channel(f.name, kind=1, data_type=10, bits=64, payload=[])
    else:
        raise CannotWrite(f"{f.name}: {t}")
    c.unit, c.comment = meta.get("unit") or None, meta.get("comment") or None
    if meta.get("source"):
        c.source = Source(**meta["source"])
    if meta.get("linear"):
        c.conversion = Conversion(1, list(map(float, meta["linear"])))
    elif meta.get("texts"):
        codes = {float(k): v for k, v in meta["texts"].items()}
        c.conversion = Conversion(7, list(codes), [*codes.values(), meta.get("default")])
    elif meta.get("conversion"):
        c.conversion = Conversion(**meta["conversion"])
    return c


def layout(channels: list[Channel], name: str | None = None, comment: str | None = None, source: Source | None = None) -> Group:
    """A group of channels one after the other, each with an invalidation bit."""
    at = 0
    for i, c in enumerate(channels):
        c.byte_offset, c.bit_offset, c.flags, c.invalid_bit = at, 0, c.flags | 2, i
        at += c.width
    return Group(name, comment, 0, at, (len(channels) + 7) // 8, 0, 0, {}, source, channels)


def slices(batch: pa.RecordBatch):
    """Parts of a batch whose texts and bytes can be held at once."""
    sizes = np.zeros(batch.num_rows, np.int64)
    for col in batch.columns:
        if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) or pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type):
            sizes += pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False)
    for a, b in portions(sizes):
        yield batch.slice(a, b - a)


def records(g: Group, batch: pa.RecordBatch) -> tuple[np.ndarray, dict[int, list[bytes]]]:
    """Records of a group from columns in the order of its channels, and the payloads of variable-length ones by channel."""
    rows, more = np.zeros((batch.num_rows, g.record_size), np.uint8), {}
    for i, (c, col) in enumerate(zip(g.channels, batch.columns)):
        if col.null_count:
            bad = np.asarray(col.is_null())
            rows[:, g.data_bytes + (c.invalid_bit >> 3)] |= bad.astype(np.uint8) << (c.invalid_bit & 7)
        if c.variable:
            if pa.types.is_string(col.type) or pa.types.is_large_string(col.type):
                col = col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary())
            more[i] = [b"" if x is None else x for x in col.to_pylist()]
            continue
        if pa.types.is_decimal(col.type):
            whole = col.cast(pa.decimal128(38, 0))
            wide = np.frombuffer(whole.buffers()[1], "<u8")[2 * whole.offset : 2 * (whole.offset + len(col))].reshape(-1, 2)
            v = wide[:, 0].copy()
            valid = np.asarray(col.is_valid())
            if (wide[valid, 1] != 0).any():
                raise CannotWrite(f"{c.name} holds a value beyond 64 unsigned bits")
            v[~valid] = 0
        else:
            v = col.fill_null(False if pa.types.is_boolean(col.type) else 0).to_numpy(zero_copy_only=False)
            if c.data_type == 0 and v.dtype.kind == "i" and (v < 0).any():
                raise CannotWrite(f"{c.name} is unsigned and holds a value below zero")
        kind = "f" if c.data_type == 4 else "i" if c.data_type == 2 else "u"
        raw = np.ascontiguousarray(v.astype(f"<{kind}{c.bits // 8}"))
        rows[:, c.byte_offset : c.byte_offset + c.width] = raw.view(np.uint8).reshape(len(rows), c.width)
    return rows, more


@dataclass
class _Stream:
    """One chain of fragments being written."""

    kind: bytes
    held: bytearray = field(default_factory=bytearray)
    blocks: list[int] = field(default_factory=list)
    offsets: list[int] = field(default_factory=list)
    length: int = 0


class FileWriter:
    """``begin`` a group, ``append`` records to it, ``finish`` it; then the next one, and ``close``."""

    def __init__(self, file, start_ns: int = 0, tz_min: int = 0, dst_min: int = 0, comment: str | None = None, split: int = SPLIT):
        self.f, self.split, self.last, self.at, self.known = file, split, None, 0, {}
        self._raw(struct.pack("<8s8s8s4xH34x", b"MDF     ", b"4.10    ", b"fathom  ", 410))
        flags = 2 if tz_min or dst_min else 0
        self.head = self._block(b"##HD", [0] * 6, struct.pack("<QhhBBBBdd", start_ns, tz_min, dst_min, flags, 0, 0, 0, 0.0, 0.0))
        if comment:
            self._patch(self.head + 24 + 40, self._text(comment))
        self.link = self.head + 24  # where the next group's address goes

    def _raw(self, raw: bytes) -> None:
        self.f.write(raw)
        self.at += len(raw)

    def _block(self, name: bytes, links, body: bytes) -> int:
        self._raw(b"\0" * (-self.at % 8))
        at = self.at
        self._raw(struct.pack("<4s4xQQ", name, 24 + 8 * len(links) + len(body), len(links)) + struct.pack(f"<{len(links)}Q", *links))
        self._raw(body)
        return at

    def _patch(self, at: int, value: int) -> None:
        self.f.seek(at)
        self.f.write(struct.pack("<Q", value))
        self.f.seek(self.at)

    def _once(self, key, make) -> int:
        """Equal texts, sources and conversions are written once."""
        if key not in self.known:
            self.known[key] = make()
        return self.known[key]

    def _text(self, s: str | None) -> int:
        if s is None or s == "":
            return 0
        kind = b"##MD" if s.lstrip().startswith("<") else b"##TX"
        raw = s.encode()
        return self._once((kind, s), lambda: self._block(kind, (), raw + b"\0" * (8 - len(raw) % 8)))

    def _source(self, s: Source | None) -> int:
        if s is None:
            return 0
        return self._once(("si", s.name, s.path, s.comment), lambda: self._block(b"##SI", [self._text(s.name), self._text(s.path), self._text(s.comment)], bytes(8)))

    def _conversion(self, c: Conversion | None) -> int:
        if c is None:
            return 0

        def make():
            refs = [self._conversion(r) if isinstance(r, Conversion) else self._text(r) for r in c.refs]
            return self._block(b"##CC", [self._text(c.name), self._text(c.unit), 0, 0, *refs], struct.pack(f"<BBHHHdd{len(c.values)}d", c.kind, 0, 0, len(c.refs), len(c.values), 0.0, 0.0, *c.values))

        return self._once(("cc", repr(c)), make)

    def begin(self, g: Group) -> None:
        self.group, self.count = g, 0
        self.data, self.payloads = _Stream(b"##DT"), {i: _Stream(b"##SD") for i, c in enumerate(g.channels) if c.variable}
        after, self.slots = 0, {}
        for i in range(len(g.channels) - 1, -1, -1):
            c = g.channels[i]
            links = [after, 0, self._text(c.name), self._source(c.source), self._conversion(c.conversion), 0, self._text(c.unit), self._text(c.comment)]
            body = struct.pack("<BBBBIIIIBBH6d", c.kind, c.sync, c.data_type, c.bit_offset, c.byte_offset, c.bits, c.flags, c.invalid_bit, 0, 0, 0, *([0.0] * 6))
            after = self._block(b"##CN", links, body)
            self.slots[i] = after + 24 + 40
        self.cg = self._block(b"##CG", [0, after, self._text(g.name), self._source(g.source), 0, self._text(g.comment)], struct.pack("<QQHH4xII", 0, 0, 0, 0, g.data_bytes, g.invalid_bytes))

    def _fragment(self, s: _Stream, body) -> None:
        s.blocks.append(self._block(s.kind, (), body))
        s.offsets.append(s.length)
        s.length += len(body)

    def _flush(self, s: _Stream) -> None:
        self._fragment(s, s.held)
        s.held = bytearray()

    def append(self, rows: np.ndarray, payloads: dict[int, list[bytes]] | None = None) -> None:
        """Records (n, size) without record ids; the slots of variable-length channels are set here."""
        for i, values in (payloads or {}).items():
            s, c, slots = self.payloads[i], self.group.channels[i], np.zeros(len(rows), "<u8")
            for k, raw in enumerate(values):
                raw = raw or b""
                if s.held and len(s.held) + 4 + len(raw) > self.split:
                    self._flush(s)
                slots[k] = s.length + len(s.held)
                s.held += struct.pack("<I", len(raw)) + raw
            width = c.width
            rows[:, c.byte_offset : c.byte_offset + width] = slots.view(np.uint8).reshape(-1, 8)[:, :width]
        self.count += len(rows)
        s, at, raw = self.data, 0, memoryview(np.ascontiguousarray(rows).reshape(-1))
        whole = max(1, self.split // max(1, self.group.record_size)) * self.group.record_size
        while whole and len(s.held) + len(raw) - at > whole:
            to = at + whole - len(s.held)
            if s.held:
                s.held += raw[at:to]
                self._flush(s)
            else:
                self._fragment(s, raw[at:to])
            at = to
        s.held += raw[at:]

    def _chain(self, s: _Stream) -> int:
        if s.held or not s.blocks:
            self._flush(s)
        if len(s.blocks) == 1:
            return s.blocks[0]
        return self._block(b"##DL", [0, *s.blocks], struct.pack("<B3xI", 0, len(s.blocks)) + struct.pack(f"<{len(s.offsets)}Q", *s.offsets))

    def finish(self) -> int:
        """Ends the group; returns how many records it has."""
        for i, s in self.payloads.items():
            self._patch(self.slots[i], self._chain(s))
        dg = self._block(b"##DG", [0, self.cg, self._chain(self.data), 0], bytes(8))
        self._patch(self.cg + 24 + 48 + 8, self.count)
        self._patch(self.link, dg)
        self.link = dg + 24
        return self.count

    def close(self) -> None:
        self.f.flush()


def write_groups(path: str, groups: list[tuple[str | None, pa.Table, dict]], **header) -> None:
    """A small file of several groups: (name, table, options by column; option ``master`` names the time column)."""
    with open(path, "wb") as f:
        w = FileWriter(f, **header)
        for name, t, options in groups:
            channels = [channel_for(x, options.get(x.name, {})) for x in t.schema]
            for c in channels:
                if c.name == options.get("master"):
                    c.kind, c.sync = 2, 1
            g = layout(channels, name, options.get("comment"))
            w.begin(g)
            for b in t.to_batches():
                w.append(*records(g, b))
            w.finish()
        w.close()
