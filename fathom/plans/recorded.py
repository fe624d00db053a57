"""Queries that go through recordings: the given tables written as files, read, cut, merged and listed."""

from __future__ import annotations

import atexit
import os
import shutil
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.sources import mdf4
from fathom.sources.binary import read_binary
from fathom.sources.blocks import Channel, Group
from fathom.sources.files import cut_files, merge_files
from fathom.sources.index import catalog, find_channel, list_groups, masters
from fathom.sources.layout import Layout
from fathom.sources.ranges import local
from fathom.sources.writer import FileWriter, write_groups

QUERIES: dict = {}
SQL: dict[str, str] = {}
START = 1704067200 * 10**9
T = "(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def scratch(spark: SparkSession) -> str:
    """A folder of the query's own, where the cluster's tasks share files."""
    base = local(spark.conf.get("spark.checkpoint.dir", None) or "/tmp/checkpoints/fathom")
    path = os.path.join(base, f"recordings-{uuid.uuid4().hex}")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def t(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def recorded(df: DataFrame, **options) -> str:
    path = scratch(df.sparkSession)
    mdf4.write(df, path, **options)
    return path


def events(s, d) -> DataFrame:
    t0 = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) / 1e6")
    return t(s, d, "events").select(t0.alias("t"), "event_id", "value", "event_type", "props")


@query("writer_roundtrip_events", f"SELECT {T} AS t, event_id, value, event_type FROM events")
def writer_roundtrip_events(s, d):
    return mdf4.read(s, recorded(events(s, d), master="t"), channels=["t", "event_id", "value", "event_type"]).drop("_record")


@query("writer_roundtrip_numbers", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 2 THEN l_quantity END AS quantity, CASE WHEN l_linenumber = 3 THEN 18446744073709551615 ELSE l_partkey END::DECIMAL(20, 0)::VARCHAR AS u FROM lineitem")
def writer_roundtrip_numbers(s, d):
    u = F.expr("CASE WHEN l_linenumber = 3 THEN cast('18446744073709551615' AS decimal(20, 0)) ELSE cast(l_partkey AS decimal(20, 0)) END")
    df = t(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") != 2, F.col("l_quantity")).alias("quantity"), u.alias("u"))
    return mdf4.read(s, recorded(df)).select("l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"), "quantity", F.col("u").cast("string").alias("u"))


@query("vlsd_roundtrip", "SELECT doc_id, text FROM documents")
def vlsd_roundtrip(s, d):
    return mdf4.read(s, recorded(t(s, d, "documents").select("doc_id", "text"))).select("doc_id", "text")


@query("vlsd_bytes", "SELECT page_id, octet_length(encode(html)) AS n, md5(html) AS sum FROM pages")
def vlsd_bytes(s, d):
    df = t(s, d, "pages").select("page_id", F.encode("html", "UTF-8").alias("html"))
    return mdf4.read(s, recorded(df)).select("page_id", F.octet_length("html").cast("bigint").alias("n"), F.md5("html").alias("sum"))


@query("recorded_linear", "SELECT event_id, 10.0::DOUBLE + 0.5::DOUBLE * user_id AS phys FROM events")
def recorded_linear(s, d):
    df = t(s, d, "events").select("event_id", F.col("user_id").alias("phys").alias("phys", metadata={"linear": [10.0, 0.5], "unit": "kPa"}))
    return mdf4.read(s, recorded(df)).select("event_id", "phys")


@query("recorded_value_text", "SELECT o_orderkey, CASE o_shippriority_ WHEN 0 THEN 'none' WHEN 1 THEN 'low' ELSE 'more' END AS state FROM (SELECT o_orderkey, o_orderkey % 4 AS o_shippriority_ FROM orders)")
def recorded_value_text(s, d):
    df = t(s, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 4).alias("state", metadata={"texts": {"0": "none", "1": "low"}, "default": "more"}))
    return mdf4.read(s, recorded(df)).select("o_orderkey", "state")


@query("recorded_raw", "SELECT o_orderkey, o_orderkey % 4 AS state FROM orders")
def recorded_raw(s, d):
    df = t(s, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 4).alias("state", metadata={"texts": {"0": "none", "1": "low"}, "default": "more"}))
    return mdf4.read(s, recorded(df), raw="true").select("o_orderkey", "state")


@query("recorded_formula", "SELECT l_orderkey, l_linenumber, round(l_quantity * l_quantity / 4 - 1, 6) AS phys FROM lineitem")
def recorded_formula(s, d):
    meta = {"conversion": {"kind": 3, "refs": ["X^2 / 4 - 1"]}}
    df = t(s, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), F.col("l_quantity").alias("phys", metadata=meta))
    return mdf4.read(s, recorded(df)).select("l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"), F.round("phys", 6).alias("phys"))


@query("recorded_window", "SELECT event_id, value FROM events ORDER BY event_id LIMIT 100 OFFSET 100")
def recorded_window(s, d):
    """Records 100 to 199 of the one recording, of which only their bytes are read."""
    path = scratch(s)
    os.makedirs(path)
    df = t(s, d, "events").select("event_id", "value").orderBy("event_id").coalesce(1)
    mdf4.write(df, f"{path}/one.mf4")
    return mdf4.read(s, f"{path}/one.mf4", first_record=100, records=100).select("event_id", "value")


@query("cut_recordings", f"SELECT event_id, value, props FROM events WHERE {T} BETWEEN 86400 AND 172800")
def cut_recordings(s, d):
    """Each file of a folder cut by a task; samples are copied as they are, payloads with them."""
    source, target = recorded(events(s, d).repartitionByRange(4, "event_id").sortWithinPartitions("event_id"), master="t", start_time_ns=START), scratch(s)
    cut_files(s, source, target, 86400.0, 172800.0).collect()  # a row a file
    return mdf4.read(s, target, channels=["event_id", "value", "props"]).drop("_record")


@query("merge_recordings", "SELECT c_custkey AS key, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def merge_recordings(s, d):
    path = scratch(s)
    os.makedirs(path)
    mdf4.write(t(s, d, "customer").selectExpr("c_custkey key", "c_name name").coalesce(1), f"{path}/a.mf4")
    mdf4.write(t(s, d, "supplier").selectExpr("s_suppkey key", "s_name name").coalesce(1), f"{path}/b.mf4")
    merge_files([f"{path}/a.mf4", f"{path}/b.mf4"], f"{path}/c.mf4")
    return mdf4.read(s, f"{path}/c.mf4").drop("_record")


@query("recorded_binary", "SELECT event_id, value, event_type FROM events")
def recorded_binary(s, d):
    """Through Spark's own file reader, as on storage that Python can't open."""
    return read_binary(s, recorded(events(s, d)), channels=["event_id", "value", "event_type"]).drop("_file", "_record")


@query("signal_of_recording", f"SELECT {T} AS t, value FROM events")
def signal_of_recording(s, d):
    """A channel beside the master of its group: the same records, so no join."""
    df = mdf4.read(s, recorded(events(s, d), master="t"), channels=["t", "value"])
    return df.select("t", "value")


@query("recorded_bits", "SELECT o_orderkey, (o_orderkey >> 3) & 31 AS u, xor((o_orderkey >> 2) & 15, 8) - 8 AS v FROM orders")
def recorded_bits(s, d):
    """Fields of bits, big-endian bytes and signs, from records made by hand."""
    path = scratch(s)
    os.makedirs(path)

    def pack(frames):
        for f in frames:
            keys = f["o_orderkey"].to_numpy("<i8")
            rows = np.concatenate([keys.view(np.uint8).reshape(-1, 8), keys.astype(">i8").view(np.uint8).reshape(-1, 8)], axis=1)
            channels = [Channel("o_orderkey", data_type=3, byte_offset=8, bits=64), Channel("u", data_type=0, bit_offset=3, bits=5), Channel("v", data_type=2, bit_offset=2, bits=4)]
            name = f"{path}/{uuid.uuid4().hex}.mf4"
            with open(name, "wb") as out:
                w = FileWriter(out)
                w.begin(Group("bits", None, 0, 16, 0, 0, 0, {}, None, channels))
                w.append(rows)
                w.finish()
                w.close()
            yield pd.DataFrame({"name": [name], "n": [len(keys)]})

    t(s, d, "orders").select("o_orderkey").mapInPandas(pack, "name string, n bigint").collect()  # a row a file
    return mdf4.read(s, path).select("o_orderkey", "u", "v")


def two_groups(s, d) -> str:
    """One recording with the nations and the regions as groups."""
    path = scratch(s)
    os.makedirs(path)
    n, r = (t(s, d, x).toArrow() for x in ("nation", "region"))  # 25 and 5 rows
    nation = pa.table({"time": pa.array([float(i) for i in range(n.num_rows)]), "key": n["n_nationkey"], "name": n["n_name"].cast(pa.string())})
    region = pa.table({"key": r["r_regionkey"], "label": r["r_name"].cast(pa.string())})
    write_groups(f"{path}/two.mf4", [("nation", nation, {"master": "time", "key": {"unit": "1", "comment": "nation key"}}), ("region", region, {})], start_ns=START)
    return f"{path}/two.mf4"


_CHANNELS = "(VALUES (0, 'nation', 0, 'time'), (0, 'nation', 1, 'key'), (0, 'nation', 2, 'name'), (1, 'region', 0, 'key'), (1, 'region', 1, 'label')) c(g, group_name, ch, channel_name)"
query("catalog_signal_list", f'SELECT CAST(g AS BIGINT) AS "group", group_name, CAST(ch AS BIGINT) AS channel, channel_name FROM {_CHANNELS}')(lambda s, d: catalog(s, two_groups(s, d)).select("group", "group_name", "channel", "channel_name"))
query("catalog_find_channel", 'SELECT 0::BIGINT AS "group", 1::BIGINT AS channel UNION ALL SELECT 1, 0')(
    lambda s, d: (lambda c: find_channel(c, "key").select("group", "channel").union(find_channel(c, "key", "region").select("group", "channel")))(catalog(s, two_groups(s, d)))
)
query("catalog_groups", 'SELECT 0::BIGINT AS "group", \'nation\' AS group_name, (SELECT count(*) FROM nation) AS records, 3::BIGINT AS channels UNION ALL SELECT 1, \'region\', (SELECT count(*) FROM region), 2')(
    lambda s, d: list_groups(catalog(s, two_groups(s, d))).select("group", "group_name", "records", "channels")
)
query("catalog_masters", "SELECT 0::BIGINT AS \"group\", 'time' AS channel_name")(lambda s, d: masters(catalog(s, two_groups(s, d))).select("group", "channel_name"))
query("catalog_channel_info", f"SELECT 'key' AS channel_name, '1' AS unit, 'nation key' AS comment, {START}::BIGINT AS start_ns")(
    lambda s, d: catalog(s, two_groups(s, d)).where("group = 0 AND channel_name = 'key'").select("channel_name", "unit", "comment", "start_ns")
)
query("layout_histogram", "SELECT * FROM (VALUES ('##CG', 2::BIGINT), ('##CN', 5), ('##DG', 2), ('##DT', 2), ('##HD', 1), ('##ID', 1), ('##SD', 2), ('##TX', 8)) b(kind, n)")(
    lambda s, d: Layout(two_groups(s, d)).frames(s)[0].groupBy("kind").agg(F.count("*").alias("n"))
)
