"""A recording's metadata as an index that saves to JSON, partial reads through it, and its catalog as DataFrames."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from datetime import datetime, timezone

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.errors import BeyondEnd, MdfError, NoSource, NoStartTime, NotFound
from fathom.sources.blocks import Channel, Conversion, Group, Recording, from_plain, recording, to_plain
from fathom.sources.decode import column, floats
from fathom.sources.mdf4 import batches, files, names, read, routed, whole_spans
from fathom.sources.ranges import open_ranges

CATALOG = (
    "path string, group bigint, group_name string, group_comment string, records bigint, record_bytes bigint, channel bigint, channel_name string, unit string, comment string, "
    "source_name string, source_path string, source_comment string, channel_type int, data_type int, bits bigint, is_master boolean, conversion string, start_ns bigint"
)


@dataclass
class Signal:
    """A channel's values and, if its group has a master that isn't the channel itself, their times in seconds."""

    name: str | None
    unit: str | None
    timestamps: np.ndarray
    values: pa.Array

    def __len__(self) -> int:
        return len(self.values)

    @property
    def has_timestamps(self) -> bool:
        return len(self.timestamps) > 0

    def floats(self) -> np.ndarray:
        """Values as floats, NaN where null or not a number."""
        if pa.types.is_string(self.values.type) or pa.types.is_binary(self.values.type):
            return np.full(len(self), np.nan)
        return np.array([math.nan if x is None else float(x) for x in self.values.to_pylist()])

    def series(self, start_ns: int | None = None) -> pd.Series:
        """By absolute time if there is a start, else by seconds, else by number."""
        if not self.has_timestamps:
            at = pd.RangeIndex(len(self))
        elif start_ns:
            at = pd.to_datetime(start_ns, unit="ns") + pd.to_timedelta(self.timestamps, unit="s")
        else:
            at = pd.Index(self.timestamps)
        return pd.Series(self.values.to_pylist(), index=at, name=self.name)


class Index:
    """Metadata of a recording. Samples are read by ranges from its source: a path, an address, bytes or a reader of one's own."""

    def __init__(self, tree: Recording, source=None):
        self.tree, self.source = tree, source

    @classmethod
    def build(cls, source) -> Index:
        return cls(recording(source), source)

    # saving: the source is saved only where it is a name
    def to_json(self) -> str:
        return json.dumps({"source": self.source if isinstance(self.source, str) else None, "recording": to_plain(self.tree)})

    @classmethod
    def from_json(cls, text: str, source=None) -> Index:
        plain = json.loads(text)
        return cls(from_plain(plain["recording"]), source if source is not None else plain["source"])

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            f.write(self.to_json())

    @classmethod
    def load(cls, path: str, source=None) -> Index:
        with open(path, encoding="utf-8") as f:
            return cls.from_json(f.read(), source)

    # lookups: the first match in the order of the file
    @property
    def groups(self) -> list[Group]:
        return self.tree.groups

    @property
    def start_ns(self) -> int | None:
        return self.tree.start_ns or None

    def group(self, name: str) -> int:
        for i, g in enumerate(self.groups):
            if g.name == name:
                return i
        raise NotFound(f"no group {name!r}")

    def find(self, name: str, group: str | int | None = None) -> tuple[int, int]:
        """Place of the first channel of a name; with a group's name, in any group of that name."""
        if at := self.find_all(name, group):
            return at[0]
        raise NotFound(f"no channel {name!r}" + (f" in {group!r}" if group is not None else ""))

    def find_all(self, name: str, group: str | int | None = None) -> list[tuple[int, int]]:
        return [(i, j) for i, g in enumerate(self.groups) for j, c in enumerate(g.channels) if c.name == name and (group is None or group in (i, g.name))]

    def groups_with(self, name: str) -> list[str]:
        return [g.name for g in self.groups if g.name is not None and any(c.name == name for c in g.channels)]

    def channel_names(self, group: int | None = None) -> list[str]:
        return [c.name for i, g in enumerate(self.groups) if group in (None, i) for c in g.channels if c.name is not None]

    def signals(self) -> list[tuple[str | None, str | None, str | None]]:
        """(source path, group, channel) of every channel, unnamed ones too."""
        path = self.source if isinstance(self.source, str) else None
        return [(path, g.name, c.name) for g in self.groups for c in g.channels]

    def _reader(self):
        if self.source is None:
            raise NoSource("the index was loaded without a file or address")
        return open_ranges(self.source)

    def _parts(self, g: Group, reader):
        return routed(reader, g) if g.mixed else batches(reader, g, whole_spans(g))

    def _arrays(self, i: int, wanted: list[Channel], raw: bool = False) -> list[pa.Array]:
        g, reader = self.groups[i], self._reader()
        try:
            parts = [[column(c, rows, g, reader, raw) for c in wanted] for rows in self._parts(g, reader)]
            empty = column_types(wanted, g, raw) if not parts else []
        finally:
            if reader is not self.source:
                reader.close()
        return [pa.concat_arrays(list(x)) for x in zip(*parts)] if parts else empty

    def values(self, name: str, group: str | int | None = None, raw: bool = False) -> pa.Array:
        """A channel's values, converted unless ``raw``, null where invalid."""
        i, j = self.find(name, group)
        return self._arrays(i, [self.groups[i].channels[j]], raw)[0]

    def floats(self, name: str, group: str | int | None = None, raw: bool = False) -> np.ndarray:
        i, j = self.find(name, group)
        g, reader = self.groups[i], self._reader()
        try:
            parts = [floats(g.channels[j], rows, g, raw) for rows in self._parts(g, reader)]
        finally:
            if reader is not self.source:
                reader.close()
        return np.concatenate(parts) if parts else np.zeros(0)

    def table(self, group: str | int = 0, channels: list[str] | None = None, raw: bool = False) -> pa.Table:
        """A group, or some of its channels, in this process: columns named as those of the data source."""
        i = group if isinstance(group, int) else self.group(group)
        g = self.groups[i]
        wanted = [(n, c) for n, c in zip(names(g), g.channels) if channels is None or n in channels]
        return pa.table(dict(zip([n for n, _ in wanted], self._arrays(i, [c for _, c in wanted], raw))))

    def signal(self, name: str, group: str | int | None = None) -> Signal:
        i, j = self.find(name, group)
        c, master = self.groups[i].channels[j], self.groups[i].master()
        if master is None or master is c:
            return Signal(c.name, c.unit, np.zeros(0), self._arrays(i, [c])[0])
        values, times = self._arrays(i, [c, master])
        return Signal(c.name, c.unit, times.cast(pa.float64()).to_numpy(zero_copy_only=False), values)

    def __getitem__(self, key) -> Signal:
        return self.signal(*key) if isinstance(key, tuple) else self.signal(key)

    def frame(self, spark: SparkSession, group: int | str = 0, **options) -> DataFrame:
        if not isinstance(self.source, str):
            raise NoSource("a DataFrame needs a path or an address")
        return read(spark, self.source, group, **options)

    def byte_ranges(self, name: str, group: str | int | None = None, start: int = 0, count: int | None = None) -> list[tuple[int, int]]:
        """(offset, length), one for each fragment, of the bytes that hold some records of a channel."""
        i, j = self.find(name, group)
        return byte_ranges(self.groups[i], self.groups[i].channels[j], start, count)


def column_types(wanted: list[Channel], g: Group, raw: bool) -> list[pa.Array]:
    none = np.zeros((0, max(1, g.record_size)), np.uint8)
    return [column(c, none, g, None, raw) for c in wanted]


def record_count(g: Group) -> int:
    return g.records if g.mixed else sum(n for _, n in whole_spans(g))


def byte_ranges(g: Group, c: Channel, start: int = 0, count: int | None = None) -> list[tuple[int, int]]:
    if c.variable:
        raise MdfError("a variable-length channel has no ranges by record")
    if g.mixed:
        raise MdfError("records of several groups lie mixed")
    n = record_count(g)
    count = n - start if count is None else count
    if start < 0 or count < 0 or start + count > n:
        raise BeyondEnd(f"records {start} to {start + count} of {n}")
    out, seen = [], 0
    for at, k in whole_spans(g):
        a, b = max(start, seen), min(start + count, seen + k)
        if a < b:
            out.append((at + (a - seen) * g.record_size + g.id_bytes + c.byte_offset, (b - a - 1) * g.record_size + c.width))
        seen += k
    return out


def conversion_info(c: Conversion | None) -> str | None:
    return None if c is None else json.dumps({"type": c.kind, "values": c.values, "refs": [json.loads(conversion_info(r)) if isinstance(r, Conversion) else r for r in c.refs], "name": c.name, "unit": c.unit})


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """A row for each channel of each recording that ``path`` names; every file is walked by a task."""
    found = files(path)

    def walk(frames):
        for f in frames:
            rows = []
            for p in f["path"]:
                tree = recording(p)
                for i, g in enumerate(tree.groups):
                    first = g.master()
                    for j, c in enumerate(g.channels):
                        s = c.source
                        rows.append((p, i, g.name, g.comment, record_count(g), g.record_size, j, c.name, c.unit, c.comment, s and s.name, s and s.path, s and s.comment, c.kind, c.data_type, c.bits, c is first, conversion_info(c.conversion), tree.start_ns or None))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in CATALOG.split(", ")]).astype({"start_ns": "Int64"})

    return spark.createDataFrame([(p,) for p in found], "path string").repartition(max(1, len(found)), "path").mapInPandas(walk, CATALOG)


def list_groups(c: DataFrame) -> DataFrame:
    return c.groupBy("path", "group").agg(F.first("group_name").alias("group_name"), F.first("records").alias("records"), F.count("*").alias("channels"))


def find_channel(c: DataFrame, name: str, group: str | None = None) -> DataFrame:
    """The first channel of a name in each recording."""
    hits = c.where((F.col("channel_name") == name) & (F.lit(True) if group is None else F.col("group_name") == group))
    return hits.groupBy("path").agg(F.min(F.struct("group", "channel")).alias("at")).select("path", "at.group", "at.channel")


def masters(c: DataFrame) -> DataFrame:
    return c.where("is_master").select("path", "group", "channel", "channel_name")


def data_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(path, group, fragment, offset, bytes, records, first_record) of the data of each group."""
    rows = []
    for p in files(path):
        for i, g in enumerate(recording(p).groups):
            first = 0
            for k, ((at, size), (_, n)) in enumerate(zip(g.fragments, whole_spans(g))):
                rows.append((p, i, k, at, size, n, first))
                first += n
    return spark.createDataFrame(rows, "path string, group bigint, fragment bigint, offset bigint, bytes bigint, records bigint, first_record bigint")


def to_ns(when) -> int:
    """A datetime (without a zone: UTC), an ISO text or finite seconds since the epoch, as nanoseconds."""
    if isinstance(when, bool):
        raise TypeError("not a time")
    if isinstance(when, (int, float, np.integer, np.floating)):
        if not math.isfinite(when):
            raise MdfError("a time must be finite")
        return int(when) * 10**9 if isinstance(when, (int, np.integer)) else round(float(when) * 1e9)
    if isinstance(when, str):
        when = datetime.fromisoformat(when)
    if not isinstance(when, datetime):
        raise TypeError(f"not a time: {when!r}")
    if when.tzinfo is None:
        when = when.replace(tzinfo=timezone.utc)
    past = when - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (past.days * 86400 + past.seconds) * 10**9 + past.microseconds * 1000


def relative(tree: Recording, ns: int) -> float:
    """Seconds since the recording's start."""
    if not tree.start_ns:
        raise NoStartTime("the recording has no start time")
    return (ns - tree.start_ns) / 1e9


__all__ = ["Index", "Signal", "catalog", "data_blocks", "find_channel", "list_groups", "masters"]
