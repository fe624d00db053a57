"""ASAM MDF 4.1 recordings as a Spark data source: one table per channel group.

``spark.read.format("mdf4").load(path)``, where ``path`` is a file, a folder, a
pattern, or several of them parted by commas, on storage all executors mount, or
an http address. Options: ``group`` (number or name, default 0), ``channels``
(names parted by commas: only these are decoded), ``raw`` (no conversions),
``index`` (a saved index instead of a walk), ``first_record`` and ``records`` (a
window: only its bytes are read; beyond the last record it is an error),
``records_per_partition``. ``_record`` counts the records of all files, in the
order of their names. Filters are not taken from Spark: Spark 4.1 keeps what a
Python source was given for one query in all later ones of the same DataFrame.

Writing makes a folder with a file a task; commit only renames. With one task and
a path that ends in .mf4 it makes that file. Options: ``master``, ``group_name``,
``group_comment``, ``start_time_ns``, ``tz_min``, ``dst_min``. Column metadata:
unit, comment, unsigned, source, linear, texts and default, conversion.
"""

from __future__ import annotations

import glob
import json
import os
import shutil
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import BinaryType, DataType, DecimalType, DoubleType, LongType, StringType, StructField, StructType

from fathom.errors import BeyondEnd, CannotWrite, NotFound, WrongBlock
from fathom.sources.blocks import Channel, Group, from_plain, recording
from fathom.sources.decode import PORTION, column, payload_sizes, portions, result_kind
from fathom.sources.ranges import local, open_ranges
from fathom.sources.writer import FileWriter, channel_for, layout, records, slices

PART_RECORDS = 1 << 20
BATCH = 65536
_SPARK = {"u64": DecimalType(20, 0), "i64": LongType(), "f64": DoubleType(), "text": StringType(), "bytes": BinaryType(), "none": BinaryType()}


def files(path: str) -> list[str]:
    """The recordings that a path names, in the order of their names."""
    out = []
    for p in path.split(","):
        p = p.strip()
        if p.startswith(("http://", "https://")):
            out.append(p)
            continue
        p = local(p)
        if os.path.isdir(p):
            out += sorted(os.path.join(d, x) for d, _, names in os.walk(p) for x in names if x.lower().endswith((".mf4", ".mdf")) and not x.startswith((".", "_")))
        else:
            out += sorted(glob.glob(p)) if glob.has_magic(p) else [p]
    return out


def spark_type(c: Channel, raw: bool = False) -> DataType:
    return _SPARK[result_kind(c, None if raw else c.conversion)]


def names(g: Group) -> list[str]:
    """Column names: unnamed channels by number, repeated names with a count."""
    seen: dict[str, int] = {}
    out = []
    for i, c in enumerate(g.channels):
        name = c.name or f"channel_{i}"
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return out


def columns(g: Group, only: list[str] | None = None, raw: bool = False) -> StructType:
    out = [StructField("_record", LongType(), False)]
    for name, c in zip(names(g), g.channels):
        if only is None or name in only:
            source = [c.source.name, c.source.path, c.source.comment] if c.source else None
            out.append(StructField(name, spark_type(c, raw), True, {k: v for k, v in (("unit", c.unit), ("comment", c.comment), ("source", source and json.dumps(source))) if v}))
    return StructType(out)


def pick(groups: list[Group], which: str) -> Group:
    """A group by number, or the first of a name."""
    if which.isdigit() and int(which) < len(groups):
        return groups[int(which)]
    for g in groups:
        if g.name == which:
            return g
    raise NotFound(f"no group {which!r}")


def layout_key(g: Group) -> tuple:
    """What two groups must share to be one table."""
    return g.id_bytes, *((c.name, c.data_type, c.bit_offset, c.byte_offset, c.bits, c.kind, c.variable) for c in g.channels)


def rows_of(raw: bytes, g: Group) -> np.ndarray:
    n = len(raw) // max(1, g.record_size)
    return np.frombuffer(raw, np.uint8, n * g.record_size).reshape(n, g.record_size)


def at_once(g: Group) -> int:
    """How many records are decoded at once."""
    return max(1, min(BATCH, PORTION // max(1, g.record_size)))


def routed(reader, g: Group):
    """The records (n, size) of a group whose data holds records of several groups, found by their ids."""
    kept, rest, most = [], b"", at_once(g)
    for at, size in g.fragments:
        raw, i = rest + reader.read(at, size), 0
        while i + g.id_bytes <= len(raw):
            number = int.from_bytes(raw[i : i + g.id_bytes], "little")
            if (width := g.siblings.get(str(number))) is None:
                raise WrongBlock(f"no group has the record id {number}")
            if i + width > len(raw):
                break
            if number == g.record_id:
                kept.append(raw[i : i + width])
                if len(kept) == most:
                    yield rows_of(b"".join(kept), g)
                    kept = []
            i += width
        rest = raw[i:]
    if kept:
        yield rows_of(b"".join(kept), g)


def batches(reader, g: Group, spans):
    """Records (n, size) of ranges (offset, records) of a group."""
    most = at_once(g)
    for at, n in spans:
        for a in range(0, n, most):
            yield rows_of(reader.read(at + a * g.record_size, min(most, n - a) * g.record_size), g)


def fitting(parts, reader, g: Group, wanted: list[Channel | None]):
    """Records in parts whose payloads in the wanted channels can be held at once."""
    variable = [c for c in wanted if c is not None and c.variable]
    for rows in parts:
        if not variable:
            yield rows
            continue
        for a, b in portions(sum(payload_sizes(c, rows, g.id_bytes, reader) for c in variable)):
            yield rows[a:b]


def whole_spans(g: Group) -> list[tuple[int, int]]:
    """(offset, records) of each fragment; a partial record at its end is none."""
    return [(at, size // g.record_size) for at, size in g.fragments if g.record_size]


@dataclass
class Range(InputPartition):
    path: str
    group: Group
    first: int
    spans: list | None  # None: all records, by their ids


class Reader(DataSourceReader):
    def __init__(self, found: list[tuple[str, Group]], schema: StructType, raw: bool, per_part: int, low: int = 0, count: int | None = None):
        self.found, self.fields, self.raw, self.per_part, self.low, self.count = found, schema, raw, per_part, low, count

    def partitions(self):
        out, first = [], 0
        high = 1 << 62 if self.count is None else self.low + self.count
        for path, g in self.found:
            if g.mixed:
                if self.low or self.count is not None:
                    raise WrongBlock("records of several groups lie mixed: a window of them can't be read")
                out.append(Range(path, g, first, None))
                first += g.records
                continue
            for at, n in whole_spans(g):
                a, b = max(0, self.low - first), min(n, high - first)
                for x in range(a, b, self.per_part):
                    out.append(Range(path, g, first + x, [(at + x * g.record_size, min(self.per_part, b - x))]))
                first += n
        if self.count is not None and high > first:
            raise BeyondEnd(f"records {self.low} to {high} of {first}")
        return out or [Range("", self.found[0][1], 0, [])]

    def read(self, partition):
        g, done = partition.group, partition.first
        if partition.spans == []:
            return
        by_name = dict(zip(names(g), g.channels))
        wanted = [by_name.get(f.name) for f in self.fields if f.name != "_record"]
        fields = pa.schema([(f.name, pa.int64() if f.name == "_record" else _arrow(f.dataType)) for f in self.fields])
        reader = open_ranges(partition.path)
        try:
            for rows in fitting(routed(reader, g) if partition.spans is None else batches(reader, g, partition.spans), reader, g, wanted):
                values = iter(wanted)
                cols = [pa.array(np.arange(done, done + len(rows))) if f.name == "_record" else _cast(next(values), rows, g, reader, self.raw, f.type) for f in fields]
                done += len(rows)
                yield pa.RecordBatch.from_arrays(cols, schema=fields)
        finally:
            reader.close()


def _cast(c: Channel | None, rows, g, reader, raw: bool, kind: pa.DataType) -> pa.Array:
    if c is None:
        return pa.nulls(len(rows), kind)
    out = column(c, rows, g, reader, raw)
    return out if out.type == kind else out.cast(kind)


def _arrow(t: DataType) -> pa.DataType:
    return {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "decimal(20,0)": pa.decimal128(20, 0)}[t.simpleString()]


@dataclass
class Written(WriterCommitMessage):
    path: str
    records: int


class Writer(DataSourceArrowWriter):
    """A task writes a whole file under a hidden name; commit renames."""

    def __init__(self, path: str, schema: StructType, options: dict, overwrite: bool):
        self.path, self.options, self.overwrite = local(path), options, overwrite
        self.fields = [f for f in schema.fields if f.name != "_record"]
        self.one = self.path.lower().endswith(".mf4")
        self.folder = os.path.dirname(self.path) if self.one else self.path
        from pyspark.sql.pandas.types import to_arrow_type

        for f in self.fields:
            channel_for(pa.field(f.name, to_arrow_type(f.dataType)), f.metadata or {})

    def write(self, batches):
        os.makedirs(self.folder or ".", exist_ok=True)
        path, w, o = os.path.join(self.folder, f".part-{uuid.uuid4().hex}.mf4"), None, self.options
        from pyspark import TaskContext

        with open(path, "wb") as f:
            n = 0
            for b in batches:
                b = b.select([x.name for x in self.fields])
                if w is None:
                    channels = [channel_for(x, s.metadata or {}) for x, s in zip(b.schema, self.fields)]
                    for c in channels:
                        if c.name == o.get("master"):
                            c.kind, c.sync = 2, 1
                    g = layout(channels, o.get("group_name"), o.get("group_comment"))
                    w = FileWriter(f, int(o.get("start_time_ns", 0)), int(o.get("tz_min", 0)), int(o.get("dst_min", 0)))
                    w.begin(g)
                for part in slices(b):
                    w.append(*records(g, part))
                n += b.num_rows
            if w is not None:
                w.finish()
                w.close()
        if w is None:
            os.remove(path)
            return Written("", 0)
        final = os.path.join(self.folder, f".part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.mf4")
        os.rename(path, final)
        return Written(final, n)

    def abort(self, messages):
        for m in messages:
            if m and m.path and os.path.exists(m.path):
                os.remove(m.path)

    def commit(self, messages):
        parts = [m for m in messages if m and m.path]
        if self.one:
            if len(parts) > 1:
                self.abort(parts)
                raise CannotWrite(f"{len(parts)} tasks hold records: coalesce(1) for one file, or name a folder")
            if parts:
                os.replace(parts[0].path, self.path)
            return
        if self.overwrite and os.path.isdir(self.path):
            for x in os.listdir(self.path):
                if x.endswith(".mf4") and not x.startswith("."):
                    os.remove(os.path.join(self.path, x))
        for m in parts:
            os.rename(m.path, os.path.join(self.folder, os.path.basename(m.path)[1:]))


class Mdf4(DataSource):
    @classmethod
    def name(cls):
        return "mdf4"

    def flag(self, name: str) -> bool:
        return str(self.options.get(name, "false")).lower() == "true"

    def found(self) -> list[tuple[str, Group]]:
        """The group of each file; all have the layout of the first."""
        which, out = str(self.options.get("group", 0)), []
        if "index" in self.options:
            with open(local(self.options["index"]), encoding="utf-8") as f:
                plain = json.load(f)
            return [(self.options.get("path") or plain["source"], pick(from_plain(plain["recording"]).groups, which))]
        for path in files(self.options["path"]):
            g = pick(recording(path).groups, which)
            if out and layout_key(g) != layout_key(out[0][1]):
                raise WrongBlock(f"{path} has other channels than {out[0][0]}")
            out.append((path, g))
        if not out:
            raise NotFound(f"no recording at {self.options['path']}")
        return out

    def schema(self):
        only = self.options.get("channels")
        return columns(self.found()[0][1], only and [x.strip() for x in only.split(",")], self.flag("raw"))

    def reader(self, schema):
        o = self.options
        count = int(o["records"]) if "records" in o else None
        return Reader(self.found(), schema, self.flag("raw"), int(o.get("records_per_partition", PART_RECORDS)), int(o.get("first_record", 0)), count)

    def writer(self, schema, overwrite):
        return Writer(self.options["path"], schema, dict(self.options), overwrite)


def read(spark: SparkSession, path: str, group: int | str = 0, channels: list[str] | None = None, **options) -> DataFrame:
    """A group, or some of its channels, as a DataFrame."""
    spark.dataSource.register(Mdf4)
    r = spark.read.format("mdf4").option("group", group)
    for k, v in (options | ({"channels": ",".join(channels)} if channels else {})).items():
        r = r.option(k, v)
    return r.load(path)


def write(df: DataFrame, path: str, mode: str = "append", **options) -> None:
    df.sparkSession.dataSource.register(Mdf4)
    w = df.write.format("mdf4").mode(mode)
    for k, v in options.items():
        w = w.option(k, v)
    w.save(path)


def remove(path: str) -> None:
    shutil.rmtree(local(path), ignore_errors=True)
