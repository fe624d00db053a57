"""Recordings on storage that only Spark's readers open, through its binaryFile source."""

from __future__ import annotations

import pickle
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from fathom.errors import MdfError, NotFound
from fathom.sources.blocks import Group, recording
from fathom.sources.decode import column
from fathom.sources.mdf4 import _arrow, batches, columns, fitting, names, pick, routed, whole_spans
from fathom.sources.ranges import BytesRanges


def _layout(spark: SparkSession, path: str, group: str) -> Group:
    """A group of one file without its places in the file. A task walks the file: the driver gets no contents."""

    def walk(frames):
        for frame in frames:
            for content in frame.column(0):
                try:
                    out = pick(recording(BytesRanges(content.as_buffer())).groups, group)
                    out.fragments = []
                    for c in out.channels:
                        c.payload = None if c.payload is None else []
                except MdfError as e:
                    out = e
                yield pa.RecordBatch.from_pydict({"plain": [pickle.dumps(out)]})

    one = spark.read.format("binaryFile").load(re.sub(r"([\\\[\]{}*?])", r"\\\1", path))
    out = pickle.loads(one.select("content").mapInArrow(walk, "plain binary").collect()[0]["plain"])
    if isinstance(out, MdfError):
        raise out
    return out


def read_binary(spark: SparkSession, path: str, group: int | str = 0, channels: list[str] | None = None, raw: bool = False) -> DataFrame:
    """A group of every file that ``path`` names, with the file in ``_file``; ``_record`` counts within a file.

    A task holds one file at a time, so files are to fit a task's memory. The first
    file gives the schema; a channel that another file lacks is null there.
    """
    found = spark.read.format("binaryFile").load(path).select("path", "content")
    first = found.agg(F.min("path")).first()[0]  # of paths alone no content is read
    if first is None:
        raise NotFound(f"no recording at {path}")
    g = _layout(spark, first, str(group))
    schema = StructType([StructField("_file", StringType(), False), *columns(g, channels, raw)])
    fields = pa.schema([(f.name, pa.string() if f.name == "_file" else _arrow(f.dataType)) for f in schema])

    def decode(frames):
        for frame in frames:
            for file, content in zip(frame.column(0), frame.column(1)):
                reader = BytesRanges(content.as_buffer())
                own = pick(recording(reader).groups, str(group))
                by_name, done = dict(zip(names(own), own.channels)), 0
                wanted = [by_name.get(f.name) for f in list(fields)[2:]]
                for rows in fitting(routed(reader, own) if own.mixed else batches(reader, own, whole_spans(own)), reader, own, wanted):
                    cols = [pa.array([file.as_py()] * len(rows)), pa.array(range(done, done + len(rows)), pa.int64())]
                    for f, c in zip(list(fields)[2:], wanted):
                        v = pa.nulls(len(rows), f.type) if c is None else column(c, rows, own, reader, raw)
                        cols.append(v if v.type == f.type else v.cast(f.type))
                    done += len(rows)
                    yield pa.RecordBatch.from_arrays(cols, schema=fields)

    return found.mapInArrow(decode, schema)
