"""New recordings of a folder as micro-batches: files are taken in the order of their names, each once."""

from __future__ import annotations

from pyspark.sql.datasource import DataSourceStreamReader
from pyspark.sql.types import StructType

from fathom.errors import WrongBlock
from fathom.sources.blocks import recording
from fathom.sources.mdf4 import PART_RECORDS, Mdf4, Range, Reader, files, layout_key, pick, whole_spans


class FolderReader(DataSourceStreamReader):
    """The offset is the name of the last file taken, so recordings are to be named in the order they come."""

    def __init__(self, path: str, which: str, schema: StructType, raw: bool):
        self.path, self.which, self.fields, self.raw = path, which, schema, raw
        self.first = pick(recording(files(path)[0]).groups, which)

    def initialOffset(self) -> dict:
        return {"last": ""}

    def latestOffset(self) -> dict:
        return {"last": max(files(self.path), default="")}

    def partitions(self, start: dict, end: dict):
        out = []
        for path in files(self.path):
            if start["last"] < path <= end["last"]:
                g, at = pick(recording(path).groups, self.which), 0
                if layout_key(g) != layout_key(self.first):
                    raise WrongBlock(f"{path} has other channels than the first recording")
                if g.mixed:
                    out.append(Range(path, g, 0, None))
                    continue
                for offset, n in whole_spans(g):
                    for a in range(0, n, PART_RECORDS):
                        out.append(Range(path, g, at + a, [(offset + a * g.record_size, min(PART_RECORDS, n - a))]))
                    at += n
        return out

    def read(self, partition):
        return Reader([(partition.path, partition.group)], self.fields, self.raw, PART_RECORDS).read(partition)


class Mdf4Stream(Mdf4):
    """``spark.readStream.format("mdf4_stream").load(folder)``; ``_record`` counts within a file."""

    @classmethod
    def name(cls):
        return "mdf4_stream"

    def found(self):
        path = files(self.options["path"])[0]
        return [(path, pick(recording(path).groups, str(self.options.get("group", 0))))]

    def streamReader(self, schema):
        return FolderReader(self.options["path"], str(self.options.get("group", 0)), schema, self.flag("raw"))



