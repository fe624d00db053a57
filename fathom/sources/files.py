"""Cutting and merging recordings: records are copied as they are, so conversions are never applied twice."""

from __future__ import annotations

import copy
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from fathom.errors import WrongBlock
from fathom.sources.blocks import Group, Recording, recording
from fathom.sources.decode import EPS, payloads, physical, raw_numbers
from fathom.sources.index import relative, to_ns
from fathom.sources.mdf4 import batches, files, fitting, layout_key, routed, whole_spans
from fathom.sources.ranges import local, open_ranges
from fathom.sources.writer import FileWriter


def _bare(g: Group) -> Group:
    """The group as it is written: without record ids, one group a data block."""
    out = copy.copy(g)
    out.id_bytes, out.record_id, out.siblings = 0, 0, {}
    return out


def _parts(reader, g: Group) -> Iterator[tuple[np.ndarray, dict[int, list[bytes]]]]:
    """Records without their ids, and the payloads that belong to them."""
    for rows in fitting(routed(reader, g) if g.mixed else batches(reader, g, whole_spans(g)), reader, g, g.channels):
        more = {i: payloads(c, rows, g.id_bytes, reader) for i, c in enumerate(g.channels) if c.variable}
        for i, values in more.items():
            if None in values:
                raise WrongBlock(f"{g.channels[i].name}: a record's payload lies beyond its data")
        yield np.array(rows[:, g.id_bytes :]), more


def _some(rows, more, keep: np.ndarray):
    at = np.flatnonzero(keep)
    return rows[at], {i: [v[k] for k in at.tolist()] for i, v in more.items()}


def _copy(w: FileWriter, reader, g: Group, start: float = 0.0, end: float = 0.0, cut: bool = False) -> None:
    time = next((c for c in g.channels if c.time), None) if cut else None
    for rows, more in _parts(reader, g):
        if time is not None:
            raw = raw_numbers(time, rows, 0)
            t = None if raw is None else physical(time.conversion, raw)
            if t is None or isinstance(t, list):  # no numbers: no record has a time
                continue
            t = t.astype(np.float64)
            past = np.flatnonzero(t - end > EPS)  # a NaN is neither past nor before
            n = int(past[0]) if len(past) else len(t)
            w.append(*_some(rows[:n], more, ~(t[:n] < start)))
            if len(past):
                return
        else:
            w.append(rows, more)


def _writer(out, tree: Recording) -> FileWriter:
    return FileWriter(out, tree.start_ns, tree.tz_min, tree.dst_min, tree.comment)


def cut_file(source, target: str, start: float, end: float) -> None:
    """The records of every group with start <= t <= end, up to the first past the end; groups without a time master as they are."""
    tree, reader = recording(source), open_ranges(source)
    try:
        with open(target, "wb") as f:
            w = _writer(f, tree)
            for g in tree.groups:
                w.begin(_bare(g))
                _copy(w, reader, g, start, end, cut=True)
                w.finish()
            w.close()
    finally:
        if reader is not source:
            reader.close()


def cut_file_utc(source, target: str, start, end) -> None:
    """The same between two absolute times: datetimes, ISO texts or seconds since the epoch."""
    tree = recording(source)
    cut_file(source, target, relative(tree, to_ns(start)), relative(tree, to_ns(end)))


def cut_files(spark: SparkSession, path: str, folder: str, start: float, end: float) -> DataFrame:
    """Every recording that ``path`` names, cut by a task of its own into ``folder``; (path, target, records)."""
    folder = local(folder)

    def run(frames):
        for f in frames:
            rows = []
            for p in f["path"]:
                os.makedirs(folder, exist_ok=True)
                target = os.path.join(folder, os.path.basename(p))
                cut_file(p, target, start, end)
                rows.append((p, target, sum(g.records for g in recording(target).groups)))
            yield pd.DataFrame(rows, columns=["path", "target", "records"])

    found = files(path)
    df = spark.createDataFrame([(p,) for p in found], "path string").repartition(max(1, len(found)), "path")
    return df.mapInPandas(run, "path string, target string, records bigint")


def merge_files(sources: list, target: str) -> None:
    """Groups of equal layout appended to the first such group, in the order of the sources; others stay groups of their own."""
    trees = [recording(s) for s in sources]
    plan: list[list[tuple[int, Group]]] = []
    for k, tree in enumerate(trees):
        for g in tree.groups:
            same = next((p for p in plan if layout_key(p[0][1]) == layout_key(g) and p[0][0] != k), None)
            if same is not None:
                same.append((k, g))
            else:
                plan.append([(k, g)])
    readers = [open_ranges(s) for s in sources]
    try:
        with open(target, "wb") as f:
            w = _writer(f, trees[0])
            for parts in plan:
                own = _bare(parts[0][1])
                w.begin(own)
                for k, g in parts:
                    for rows, more in _parts(readers[k], g):
                        if g.invalid_bytes != own.invalid_bytes:  # not part of the layout: valid where the first has no bits
                            wide = np.zeros((len(rows), own.record_size), np.uint8)
                            wide[:, : min(rows.shape[1], own.record_size)] = rows[:, : own.record_size]
                            rows = wide
                        w.append(rows, more)
                w.finish()
            w.close()
    finally:
        for s, r in zip(sources, readers):
            if r is not s:
                r.close()
