"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once, so that their Python finds it wherever it starts."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        top = Path(__file__).parent.parent
        path = Path(tempfile.mkdtemp()) / "fathom_package.zip"  # on the driver; Spark serves it
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(top.rglob("*.py")):
                z.write(f, f.relative_to(top.parent))
        sc.addPyFile(str(path))
        _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that ``spark.checkpoint.dir`` names; without one only a local session may go on."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or "/tmp/checkpoints/fathom")
    return df.checkpoint()


def unused(df: DataFrame, name: str) -> str:
    """``name``, or it with underscores where ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key() -> Column:
    """128 bits that name a row by id and text; rows repeated whole share a key, null ids are allowed."""
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    return F.unhex(F.md5(F.concat(doc, F.lit("\x01"), F.coalesce(F.col("text"), F.lit("\x02null")))))


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[[dict], list[tuple]]]) -> DataFrame:
    """Arrow-batched flat map.

    ``make`` runs once in each task and returns a function from the columns of a
    batch (name to list) to the columns of its output, in the order of ``schema``.
    """
    ship(df.sparkSession)
    names = [f.name for f in _fields(schema)]
    types = [_ARROW[f.dataType.simpleString()] for f in _fields(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                out = step({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                if out is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)

    return df.mapInArrow(run, schema)


_ARROW = {
    "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(),
    "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64()),
}


def _fields(schema: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema).fields


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _beside(rows: DataFrame, low: DataFrame) -> DataFrame:
    """``rows`` with the least neighbour (m) of their node a.

    The key is cast, so both sides have exchanges of their own and Spark can split
    a node with very many edges over tasks.
    """
    low = low.select(F.col("a").cast("decimal(20,0)").alias("_a"), "m")
    return rows.join(low, F.col("a").cast("decimal(20,0)") == F.col("_a")).drop("_a")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b: long) as (node, root), root the smallest node.

    Alternates large-star and small-star until the edges no longer change. Every
    round is two aggregations with map-side combine and is checkpointed; nothing
    but the edges' count and checksum reaches the driver. Nodes without an edge
    have no row.
    """
    e = cut(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = _beside(both, low).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        pairs = _beside(large, low)
        small = pairs.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        e = cut(small.distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return e.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
        seen = now
