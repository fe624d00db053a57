"""Records to values: bits, strings, payloads, validity and conversions, a column at a time."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from fathom.functions.formula import evaluate
from fathom.sources.blocks import Channel, Conversion, Group

# What a string that can't be decoded reads as.
BAD_TEXT = {7: "<Invalid UTF8>", 8: "<Invalid UTF16LE>", 9: "<Invalid UTF16BE>"}
_CODEC = {6: "latin-1", 7: "utf-8", 8: "utf-16-le", 9: "utf-16-be"}
EPS = 2.220446049250313e-16
PORTION = 8 << 20  # bytes that are decoded or encoded at once: as values of Python they take several times as much


def decimals(v: np.ndarray, bad: np.ndarray | None = None) -> pa.Array:
    """uint64 values as decimal(20, 0)."""
    wide = np.zeros((len(v), 2), "<u8")
    wide[:, 0] = v
    valid = None if bad is None else pa.py_buffer(np.packbits(~bad, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.decimal128(20, 0), len(v), [valid, pa.py_buffer(wide.tobytes())])


def string(raw: bytes, data_type: int, payload: bool = False) -> str | None:
    """A text without the zeros at its end; of an odd number of bytes in UTF-16 a field is none and a payload a bad text."""
    if data_type >= 8 and len(raw) % 2:
        return BAD_TEXT[data_type] if payload else None
    try:
        return raw.decode(_CODEC[data_type]).rstrip("\0")
    except UnicodeDecodeError:
        return BAD_TEXT[data_type]


def raw_numbers(c: Channel, rows: np.ndarray, id_bytes: int) -> np.ndarray | None:
    """uint64, int64 or float64 values of a number channel in records (n, size); None where it can't be decoded."""
    at, size = id_bytes + c.byte_offset, c.width
    if size > 8 or not c.bits or c.bits > 64 or at + size > rows.shape[1] or c.data_type > 5:
        return None
    if c.data_type in (4, 5) and c.bits not in (32, 64):
        return None
    field = rows[:, at : at + size]
    if not c.bit_offset and c.bits in (8, 16, 32, 64):  # whole numbers of the machine
        order, letter = ">" if c.data_type in (1, 3, 5) else "<", "f" if c.data_type in (4, 5) else "i" if c.data_type in (2, 3) else "u"
        wide = {"f": np.float64, "i": np.int64, "u": np.uint64}[letter]
        return np.ascontiguousarray(field).view(f"{order}{letter}{size}").reshape(-1).astype(wide)
    part = np.zeros((len(rows), 8), np.uint8)
    part[:, :size] = field[:, ::-1] if c.data_type in (1, 3, 5) else field
    v = part.view("<u8").reshape(-1) >> np.uint64(c.bit_offset)
    if c.bits < 64:
        v &= np.uint64((1 << c.bits) - 1)
    if c.data_type in (4, 5):
        return v.astype("<u4").view("<f4").astype(np.float64)  # of 64 bits only whole ones fit
    if c.data_type in (2, 3):
        shift = np.int64(64 - c.bits)
        return v.view(np.int64) << shift >> shift
    return v


def raw_bytes(c: Channel, rows: np.ndarray, id_bytes: int) -> list[bytes] | None:
    at = id_bytes + c.byte_offset
    if at + c.width > rows.shape[1] or c.bits % 8 and not c.bits // 8:
        return None
    flat, n, size = np.ascontiguousarray(rows[:, at : at + c.width]).tobytes(), len(rows), c.width
    return [flat[i * size : (i + 1) * size] for i in range(n)]


def _slots(c: Channel, rows: np.ndarray, id_bytes: int) -> np.ndarray | None:
    return raw_numbers(Channel(None, 0, 0, 0, c.bit_offset, c.byte_offset, c.bits), rows, id_bytes)


def _stream(c: Channel, reader):
    """How many bytes the payloads of a channel are in all, and a reader of (offset, length) over their fragments."""
    sizes = np.array([s for _, s in c.payload], np.int64)
    ends = np.cumsum(sizes)

    def span(at: int, length: int) -> bytes:
        out, k = [], int(np.searchsorted(ends, at, "right"))
        while length > 0 and k < len(ends):
            inside = at - int(ends[k] - sizes[k])
            part = min(length, int(sizes[k]) - inside)
            out.append(reader.read(c.payload[k][0] + inside, part))
            at, length, k = at + part, length - part, k + 1
        return b"".join(out)

    return int(ends[-1]) if len(ends) else 0, span


def payload_sizes(c: Channel, rows: np.ndarray, id_bytes: int, reader) -> np.ndarray:
    """From each record's payload to the next one in the stream: as many bytes as it has, or more where others lie between."""
    offsets = _slots(c, rows, id_bytes)
    if offsets is None or not len(rows):
        return np.zeros(len(rows), np.int64)
    whole, span = _stream(c, reader)
    places, which = np.unique(np.minimum(offsets, np.uint64(whole)).astype(np.int64), return_inverse=True)
    sizes, last = np.diff(places, append=places[-1]), int(places[-1])
    if last + 4 <= whole:
        sizes[-1] = min(4 + struct.unpack("<I", span(last, 4))[0], whole - last)
    return sizes[which]


def portions(sizes: np.ndarray, most: int = PORTION):
    """(from, to) of neighbours of at most ``most`` in all; one that is larger stands alone."""
    ends, a = np.cumsum(sizes), 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, most + (int(ends[a - 1]) if a else 0), "right")))
        yield a, b
        a = b


def payloads(c: Channel, rows: np.ndarray, id_bytes: int, reader, most: int = 64 << 20) -> list[bytes | None]:
    """The payloads that the slots of a variable-length channel point to, by ranges of at most ``most`` bytes where they lie together."""
    offsets = _slots(c, rows, id_bytes)
    if offsets is None or not len(rows):
        return [None] * len(rows)
    whole, span = _stream(c, reader)
    out: list[bytes | None] = []
    held, begin = b"", 0
    for at in offsets.tolist():
        if at + 4 > whole:
            out.append(None)
            continue
        if not begin <= at <= begin + len(held) - 4:
            begin, held = at, span(at, min(1 << 20, whole - at))
        n = struct.unpack_from("<I", held, at - begin)[0]
        if at + 4 + n > begin + len(held):
            begin, held = at, span(at, min(max(4 + n, 1 << 20), whole - at, max(most, 4 + n)))
        raw = held[at - begin + 4 : at - begin + 4 + n]
        out.append(raw if len(raw) == n else None)
    return out


def invalid(c: Channel, rows: np.ndarray, g: Group) -> np.ndarray | None:
    """Where the values are invalid; None if nowhere."""
    if c.flags & 1:
        return np.ones(len(rows), bool)
    at = g.id_bytes + g.data_bytes + (c.invalid_bit >> 3)
    if not c.flags & 2 or at >= rows.shape[1]:
        return None
    bits = rows[:, at] & np.uint8(1 << (c.invalid_bit & 7))
    return bits.astype(bool) if bits.any() else None


def result_kind(c: Channel, conversion: Conversion | None) -> str:
    """What a channel's values are: u64, i64, f64, text, bytes or none."""
    if c.data_type in (6, 7, 8, 9):
        raw = "text"
    elif c.data_type in (10, 11, 12) or c.variable:
        raw = "bytes"
    elif c.data_type in (4, 5):
        raw = "f64"
    elif c.data_type in (0, 1):
        raw = "u64" if c.bits > 63 else "i64"
    else:
        raw = "i64" if c.data_type in (2, 3) else "none"
    if conversion is None or raw == "none":
        return raw
    k, number = conversion.kind, raw in ("u64", "i64", "f64")
    if number and (k in (1, 2, 4, 5, 6) or k == 3 and conversion.refs and isinstance(conversion.refs[0], str)):
        return "f64"
    if number and k in (7, 8, 11):
        return "text"
    if raw == "text" and k == 9:
        return "f64"
    return raw


def _choose(x: np.ndarray, conversion: Conversion, whole: bool) -> np.ndarray:
    """Which ref each value takes."""
    p = conversion.values
    if conversion.kind == 8 and (len(p) < 2 or len(p) % 2):
        return np.zeros(len(x), np.int64)
    n = len(p) if conversion.kind == 7 else len(p) // 2
    index = np.full(len(x), n)
    for i in range(n - 1, -1, -1):
        if conversion.kind == 7:
            index[x == p[i]] = i
        else:
            index[(x >= p[2 * i]) & ((x <= p[2 * i + 1]) if whole else (x < p[2 * i + 1]))] = i
    return index


def _texts(v: np.ndarray, index: np.ndarray, refs: list) -> list[str | None]:
    out: np.ndarray = np.full(len(v), None, object)
    for i in np.unique(index).tolist():
        ref, at = refs[i] if i < len(refs) else None, np.flatnonzero(index == i)
        if isinstance(ref, Conversion):
            part = physical(ref, v[at])
            out[at] = [None if x is None else x if isinstance(x, str) else repr(x) if isinstance(x, float) else str(x) for x in (part if isinstance(part, list) else part.tolist())]
        else:
            out[at] = ref
    return out.tolist()


def physical(conversion: Conversion | None, v):
    """Values (an array of numbers or a list) after a conversion; what it can't convert stays as it is."""
    if conversion is None:
        return v
    k, p, refs = conversion.kind, conversion.values, conversion.refs
    if isinstance(v, list):
        if k == 9:
            keys, rest = {}, p[len(refs)] if len(p) > len(refs) else None
            for key, value in zip(refs, p):
                keys.setdefault(key, value)
            return [x if not isinstance(x, str) else keys.get(x, rest) for x in v]
        if k == 10:
            n, pairs = max(len(refs) - 1, 0) // 2, {}
            for i in range(n):
                pairs.setdefault(refs[2 * i], refs[2 * i + 1])
            rest = refs[2 * n] if len(refs) > 2 * n else None
            return [x if not isinstance(x, str) else (pairs[x] if pairs[x] is not None else x) if x in pairs else x if rest is None else rest for x in v]
        return v
    whole = v.dtype.kind in "iu"
    if k == 11:
        return [_bits(conversion, x) for x in v.tolist()] if whole else v
    if k in (7, 8):
        return _texts(v, _choose(v.astype(np.float64), conversion, whole), refs)
    if k not in (1, 2, 3, 4, 5, 6) or k == 3 and not (refs and isinstance(refs[0], str)):
        return v
    x = v.astype(np.float64)
    with np.errstate(all="ignore"):
        if k == 1:
            return p[0] + p[1] * x if len(p) >= 2 else x
        if k == 2 and len(p) >= 6:
            below = p[3] * x * x + p[4] * x + p[5]
            ok = np.abs(below) > EPS
            return np.where(ok, (p[0] * x * x + p[1] * x + p[2]) / np.where(ok, below, 1), x)
        if k == 3:
            return evaluate(refs[0], x)
        if k in (4, 5) and len(p) >= 4 and len(p) % 2 == 0:
            keys, y = np.array(p[0::2]), np.array(p[1::2])
            if k == 4:
                return np.where(np.isnan(x), x, np.interp(x, keys, y))
            hi = np.clip(np.searchsorted(keys, x), 1, len(keys) - 1)
            near = np.where(keys[hi] - x < x - keys[hi - 1], y[hi], y[hi - 1])
            return np.where(np.isnan(x), x, np.where(x <= keys[0], y[0], np.where(x >= keys[-1], y[-1], near)))
        if k == 6 and len(p) >= 4 and len(p) % 3 == 1:
            out = np.full(len(x), p[-1])
            for a, b, y in zip(p[-4::-3], p[-3::-3], p[-2::-3]):  # the first that holds the value is written last
                out[(x >= a) & ((x <= b) if whole else (x < b))] = y
            return out
    return x


def _bits(conversion: Conversion, x: int) -> str:
    """The texts of a value's masked bits, joined; masks are the bit patterns of the conversion's numbers."""
    out = []
    for mask, ref in zip(conversion.values, conversion.refs):
        bits = struct.unpack("<Q", struct.pack("<d", mask))[0]
        if isinstance(ref, Conversion):
            part = physical(ref, np.array([x & bits], np.uint64 if x >= 0 else np.int64))
            if isinstance(part, list) and isinstance(part[0], str):
                out.append(f"{ref.name} = {part[0]}" if ref.name else part[0])
    return "|".join(out)


_TYPES = {"u64": pa.decimal128(20, 0), "i64": pa.int64(), "f64": pa.float64(), "text": pa.string(), "bytes": pa.binary(), "none": pa.binary()}


def column(c: Channel, rows: np.ndarray, g: Group, reader, raw: bool = False) -> pa.Array:
    """A channel's values in records (n, record size), null where invalid or not decodable."""
    conversion = None if raw else c.conversion
    kind, n, bad = result_kind(c, conversion), len(rows), invalid(c, rows, g)
    if c.variable:
        v = payloads(c, rows, g.id_bytes, reader)
        if c.data_type in _CODEC:
            v = [None if x is None else string(x, c.data_type, True) for x in v]
    elif c.data_type in _CODEC:
        v = raw_bytes(c, rows, g.id_bytes)
        v = v and [string(x, c.data_type) for x in v]
    elif c.data_type in (10, 11, 12):
        v = raw_bytes(c, rows, g.id_bytes)
    else:
        v = raw_numbers(c, rows, g.id_bytes)
    if v is None or kind == "none":
        return pa.nulls(n, _TYPES[kind])
    v = physical(conversion, v)
    if isinstance(v, list):
        out = pa.array(v, _TYPES[kind])
        return out if bad is None else pc.if_else(pa.array(bad), pa.nulls(n, out.type), out)
    if kind == "u64":
        return decimals(v.astype(np.uint64, copy=False), bad)
    return pa.array(v.astype(np.int64) if kind == "i64" else v.astype(np.float64), _TYPES[kind], mask=bad)


def floats(c: Channel, rows: np.ndarray, g: Group, raw: bool = False) -> np.ndarray:
    """A channel's values as floats; NaN where they are no numbers, invalid or not decodable."""
    v = raw_numbers(c, rows, g.id_bytes) if not c.variable else None
    v = None if v is None else physical(None if raw else c.conversion, v)
    if v is None or isinstance(v, list):
        return np.full(len(rows), np.nan)
    out, bad = v.astype(np.float64), invalid(c, rows, g)
    return out if bad is None else np.where(bad, np.nan, out)
