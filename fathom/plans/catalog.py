"""Queries over the given tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions import conversions as C
from fathom.operators import signals as S
from fathom.plans import recorded

KNOTS = [(5, 10.0), (15, 40.0), (25, 20.0), (35, 80.0), (45, 100.0)]


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def timed(s, d):
    return t(s, d, "events").withColumn("t", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) / 1e6"))


def line(s, d, *more):
    return t(s, d, "lineitem").select("l_orderkey", "l_linenumber", *more)


T = "(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6"
_Q: dict = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        _Q[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


q = query
q("scan_values", "SELECT event_id, value FROM events")(lambda s, d: t(s, d, "events").select("event_id", "value"))
q("scan_f64", "SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS DOUBLE) AS x FROM lineitem")(lambda s, d: line(s, d, F.col("l_linenumber").cast("double").alias("x")))
q("validity_bits", "SELECT l_orderkey, l_linenumber, CASE WHEN (l_linenumber & 2) = 0 THEN l_quantity END AS quantity FROM lineitem")(
    lambda s, d: line(s, d, F.when(C.valid(F.lit(2), F.col("l_linenumber"), 1), F.col("l_quantity")).alias("quantity"))
)
q("signal_axis", f"SELECT event_id, {T} AS t, value FROM events")(lambda s, d: timed(s, d).select("event_id", "t", "value"))
q("signal_datetime_index", f"SELECT event_id, {T} AS t, ts AS at, value FROM events")(
    lambda s, d: S.with_time(timed(s, d).drop("ts"), "t", 1704067200 * 10**9).select("event_id", "t", F.col("ts").cast("timestamp_ntz").alias("at"), "value")
)
q("cut_time", f"SELECT event_id, value FROM events WHERE {T} BETWEEN 86400 AND 172800")(lambda s, d: S.cut_time(timed(s, d), "t", 86400.0, 172800.0, "event_id", assume_sorted=True).select("event_id", "value"))
q("cut_utc", f"SELECT event_id, value FROM events WHERE {T} BETWEEN 3600 AND 90000")(
    lambda s, d: S.cut_utc(timed(s, d), "t", 1704067200 * 10**9, (1704067200 + 3600) * 10**9, (1704067200 + 90000) * 10**9, order="event_id").select("event_id", "value")
)
q("cut_prefix_stop", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 3 AND l_orderkey * 8 + l_linenumber < (SELECT coalesce(min(l_orderkey * 8 + l_linenumber), 9000000000000000000) FROM lineitem WHERE l_quantity > 49)")(
    lambda s, d: S.cut_time(line(s, d, "l_quantity").withColumn("_record", F.expr("l_orderkey * 8 + l_linenumber")), "l_quantity", 3.0, 49.0).select("l_orderkey", "l_linenumber", "l_quantity")
)
q("record_window", "SELECT event_id, value FROM events WHERE event_id >= 100 AND event_id < 200")(lambda s, d: S.record_window(t(s, d, "events"), 100, 100, "event_id").select("event_id", "value"))


def conv(name, source, keys, col, make, sql):
    q(name, f"SELECT {keys}, {sql} AS phys FROM {source}")(lambda s, d: t(s, d, source).select(*keys.split(", "), make(F.col(col)).alias("phys")))


L = ("lineitem", "l_orderkey, l_linenumber")
P = ("part", "p_partkey")
conv("conv_identity", *L, "l_quantity", C.identity, "l_quantity")
conv("conv_linear", *L, "l_quantity", lambda x: C.linear(x, (2.0, 0.5)), "2.0::DOUBLE + 0.5::DOUBLE * l_quantity")
conv("conv_rational", *L, "l_quantity", lambda x: F.round(C.rational(x, (0, 2, 1, 0, 1, -5)), 6), "round(CASE WHEN abs(l_quantity - 5) > 1e-15 THEN (2 * l_quantity + 1) / (l_quantity - 5) ELSE l_quantity END, 6)")
conv("conv_algebraic", *L, "l_quantity", lambda x: F.round(C.algebraic(x, "X^2 / 4 - 3*X + 1"), 6), "round(l_quantity * l_quantity / 4 - 3 * l_quantity + 1, 6)")
_CLAMP = "WHEN l_quantity <= 5 THEN 10.0::DOUBLE WHEN l_quantity >= 45 THEN 100.0::DOUBLE"
_SEG = list(zip(KNOTS, KNOTS[1:]))
conv("conv_table_interp", *L, "l_quantity", lambda x: F.round(C.table(x, KNOTS), 6), f"round(CASE {_CLAMP} " + " ".join(f"WHEN l_quantity <= {b} THEN {va}::DOUBLE + ({vb - va})::DOUBLE * ((l_quantity - {a}) / {b - a})" for (a, va), (b, vb) in _SEG) + " END, 6)")
conv("conv_table_nearest", *L, "l_quantity", lambda x: C.table(x, KNOTS, False), f"CASE {_CLAMP} " + " ".join(f"WHEN l_quantity <= {b} THEN CASE WHEN {b} - l_quantity < l_quantity - {a} THEN {vb}::DOUBLE ELSE {va}::DOUBLE END" for (a, va), (b, vb) in _SEG) + " END")
conv("conv_range_value", *P, "p_size", lambda x: C.range_value(x, [(1, 10, 1.5), (10, 30, 2.5)], -1, True), "CASE WHEN p_size BETWEEN 1 AND 10 THEN 1.5::DOUBLE WHEN p_size BETWEEN 10 AND 30 THEN 2.5::DOUBLE ELSE -1.0::DOUBLE END")
conv("conv_range_text", *L, "l_quantity", lambda x: C.range_text(x, [(1, 10, "low"), (10, 30, "mid")], "high", False), "CASE WHEN l_quantity >= 1 AND l_quantity < 10 THEN 'low' WHEN l_quantity >= 10 AND l_quantity < 30 THEN 'mid' ELSE 'high' END")
conv("conv_value_text", *L, "l_linenumber", lambda x: C.value_text(x, [(1, "first"), (2, "second")], "later"), "CASE l_linenumber WHEN 1 THEN 'first' WHEN 2 THEN 'second' ELSE 'later' END")
conv("conv_text_value", "events", "event_id", "event_type", lambda x: C.text_value(x, [("click", 1), ("view", 2)], 9), "CASE event_type WHEN 'click' THEN 1.0::DOUBLE WHEN 'view' THEN 2.0::DOUBLE ELSE 9.0::DOUBLE END")
conv("conv_text_text", "orders", "o_orderkey", "o_orderpriority", lambda x: C.text_text(x, [("1-URGENT", "now"), ("2-HIGH", None)], "wait"), "CASE o_orderpriority WHEN '1-URGENT' THEN 'now' WHEN '2-HIGH' THEN '2-HIGH' ELSE 'wait' END")
conv("conv_bitfield_text", "events", "event_id", "user_id", lambda x: C.bitfield_text(x, [(1, "odd", [(0, "no"), (1, "yes")]), (6, None, [(2, "two"), (4, "four")])]), "concat_ws('|', CASE user_id & 1 WHEN 0 THEN 'odd = no' ELSE 'odd = yes' END, CASE user_id & 6 WHEN 2 THEN 'two' WHEN 4 THEN 'four' END)")
conv("conv_chain", *L, "l_linenumber", lambda x: C.value_text(x, [(1, "one")], C.linear(x, (0.0, 10.0)).cast("int").cast("string")), "CASE WHEN l_linenumber = 1 THEN 'one' ELSE CAST(CAST(10 * l_linenumber AS INTEGER) AS VARCHAR) END")
conv("bit_extract_u", "orders", "o_orderkey", "o_orderkey", lambda x: C.bits_unsigned(x, 3, 5), "(o_orderkey >> 3) & 31")
conv("bit_extract_s", "orders", "o_orderkey", "o_orderkey", lambda x: C.bits_signed(x, 2, 4), "xor((o_orderkey >> 2) & 15, 8) - 8")
q("string_decode", "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN '<Invalid UTF8>' ELSE n_name END AS a, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS b, n_name AS c FROM nation")(
    lambda s, d: t(s, d, "nation").select(
        "n_nationkey",
        C.text_decode(F.when(F.col("n_nationkey") % 3 == 0, F.expr("X'ff41'")).otherwise(F.encode(F.concat("n_name", F.lit("\0\0")), "UTF-8")), "UTF-8").alias("a"),
        C.text_decode(F.when(F.col("n_nationkey") % 2 == 0, F.encode(F.concat("n_name", F.lit("\0")), "UTF-16LE")).otherwise(F.expr("X'414243'")), "UTF-16LE").alias("b"),
        C.text_decode(F.encode("n_name", "ISO-8859-1"), "ISO-8859-1").alias("c"),
    )
)
q("merge_layouts", "SELECT c_custkey AS key, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")(
    lambda s, d: S.merge_layouts([t(s, d, "customer").selectExpr("c_custkey key", "c_name name"), t(s, d, "supplier").selectExpr("s_suppkey key", "s_name name"), t(s, d, "nation").selectExpr("n_name")])[0]
)
q("gap_detection", "SELECT * FROM (SELECT l_orderkey, l_linenumber, max(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap_start, l_linenumber AS gap_end FROM lineitem) WHERE gap_end > gap_start")(
    lambda s, d: S.gaps(line(s, d), ["l_orderkey"], F.col("l_linenumber"), F.col("l_linenumber"))
)
q("block_histogram", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")(lambda s, d: t(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n")))
q("record_count", "SELECT count(*) AS n FROM lineitem")(lambda s, d: t(s, d, "lineitem").agg(F.count("*").alias("n")))
# blocks: the lines of each order are one block of 32-byte records, by number; the field at byte 8 is 4 bytes wide
_BLOCKS = "SELECT l_returnflag, l_orderkey, count(*) AS n, 1000 * l_orderkey AS o FROM lineitem GROUP BY ALL"
_RANGES = f"SELECT l_returnflag, l_orderkey, o + (greatest(10, b) - b) * 32 + 8 AS range_offset, (least(110, b + n) - greatest(10, b) - 1) * 32 + 4 AS range_length FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY l_returnflag ORDER BY l_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM ({_BLOCKS})) WHERE greatest(10, b) < least(110, b + n)"


def ranges(s, d):
    blocks = t(s, d, "lineitem").groupBy("l_returnflag", "l_orderkey").agg(F.count("*").alias("n"))
    out = S.byte_ranges(blocks, ["l_returnflag"], "l_orderkey", F.col("n"), F.col("l_orderkey") * 1000, 32, 8, 4, 10, 100)
    return out.select("l_returnflag", "l_orderkey", "range_offset", "range_length")


q("byte_ranges", f"SELECT l_returnflag, l_orderkey, CAST(range_offset AS BIGINT) AS range_offset, CAST(range_length AS BIGINT) AS range_length FROM ({_RANGES})")(ranges)
q("byte_summary", f"SELECT l_returnflag, CAST(sum(range_length) AS BIGINT) AS bytes, count(*) AS ranges FROM ({_RANGES}) GROUP BY l_returnflag")(
    lambda s, d: ranges(s, d).groupBy("l_returnflag").agg(F.sum("range_length").alias("bytes"), F.count("*").alias("ranges"))
)
q("block_sort", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey")(lambda s, d: t(s, d, "orders").select("o_orderkey", "o_orderdate").orderBy("o_orderdate", "o_orderkey"))
q("gap_head_tail", "SELECT l_orderkey, CAST(gap_start AS INTEGER) AS gap_start, CAST(gap_end AS INTEGER) AS gap_end FROM (SELECT l_orderkey, coalesce(max(l_linenumber + 1) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gap_start, l_linenumber AS gap_end FROM lineitem UNION ALL SELECT l_orderkey, max(l_linenumber) + 1, 9 FROM lineitem GROUP BY 1) WHERE gap_end > gap_start")(
    lambda s, d: S.gaps(line(s, d), ["l_orderkey"], F.col("l_linenumber"), F.col("l_linenumber") + 1, F.lit(0), F.lit(9))
)
q("json_index_roundtrip", "SELECT n_nationkey, n_name, n_regionkey FROM nation")(
    lambda s, d: (lambda n: n.select(F.from_json(F.to_json(F.struct(*n.columns)), n.schema).alias("r")).select("r.n_nationkey", "r.n_name", "r.n_regionkey"))(t(s, d, "nation"))
)
q("resample_empty_bins", "SELECT b.bin, round(e.mean, 6) AS mean FROM (SELECT unnest(generate_series(date_trunc('minute', min(ts)), date_trunc('minute', max(ts)), INTERVAL 1 MINUTE)) AS bin FROM events) b LEFT JOIN (SELECT date_trunc('minute', ts) AS bin, avg(value) AS mean FROM events GROUP BY 1) e USING (bin)")(
    lambda s, d: S.resample_mean(t(s, d, "events"), "ts", "value", "minute", empty=True).select(F.col("bin").cast("timestamp_ntz").alias("bin"), F.round("mean", 6).alias("mean"))
)
q("resample_mean", "SELECT date_trunc('hour', ts) AS bin, round(avg(value), 6) AS mean FROM events GROUP BY 1")(
    lambda s, d: S.resample_mean(t(s, d, "events"), "ts", "value", "hour").select(F.col("bin").cast("timestamp_ntz").alias("bin"), F.round("mean", 6).alias("mean"))
)
q("rolling_mean", "SELECT event_id, round(CASE WHEN count(value) OVER w = 5 THEN avg(value) OVER w END, 6) AS mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")(
    lambda s, d: (lambda e: e.select("event_id", F.round(S.rolling_mean(e, "value", 5, "event_id", ["user_id"]), 6).alias("mean")))(t(s, d, "events"))
)
q("time_slice", "SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-05'")(
    lambda s, d: t(s, d, "events").where("ts BETWEEN TIMESTAMP_NTZ'2024-01-03 00:00:00' AND TIMESTAMP_NTZ'2024-01-05 00:00:00'").select("event_id")
)
q("describe_stats", "SELECT count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS low, max(value) AS high FROM events")(
    lambda s, d: t(s, d, "events").agg(F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("std"), F.min("value").alias("low"), F.max("value").alias("high"))
)
q("corr_channels", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem")(lambda s, d: t(s, d, "lineitem").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r")))
q("filter_above_mean", "SELECT event_id FROM events WHERE value > (SELECT avg(value) FROM events)")(
    lambda s, d: (lambda e: e.crossJoin(F.broadcast(e.agg(F.avg("value").alias("m")))).where("value > m").select("event_id"))(t(s, d, "events"))
)
q("nearest_time", f"SELECT arg_min(event_id, abs({T} - 100000.0)) AS event_id FROM events")(lambda s, d: timed(s, d).agg(F.min_by("event_id", F.abs(F.col("t") - 100000.0)).alias("event_id")))

# IEEE values: NaN, infinities, zero and ties beside ordinary numbers
_X = "CASE l_linenumber WHEN 1 THEN 'nan'::DOUBLE WHEN 2 THEN 'inf'::DOUBLE WHEN 3 THEN 0.0::DOUBLE WHEN 4 THEN 10.0::DOUBLE WHEN 5 THEN '-inf'::DOUBLE ELSE l_quantity END"


def ieee(name, make, sql, text=False):
    """The value as a number, and what it is where it is none."""
    said = "CASE WHEN isnan(y) THEN 'nan' WHEN isinf(y) THEN CASE WHEN y > 0 THEN 'inf' ELSE '-inf' END ELSE '' END AS kind, CASE WHEN isnan(y) OR isinf(y) THEN 0.0::DOUBLE ELSE round(y, 6) END AS value"

    def run(s, d):
        x = F.expr("CASE l_linenumber WHEN 1 THEN double('NaN') WHEN 2 THEN double('Infinity') WHEN 3 THEN 0.0D WHEN 4 THEN 10.0D WHEN 5 THEN double('-Infinity') ELSE l_quantity END")
        y = F.col("y")
        rows = line(s, d, x.alias("x"), "l_quantity").select("l_orderkey", "l_linenumber", make(F.col("x")).alias("y"))
        if text:
            return rows
        none = F.isnan(y) | (F.abs(y) == float("inf"))
        return rows.select("l_orderkey", "l_linenumber", F.when(F.isnan(y), "nan").when(y == float("inf"), "inf").when(y == float("-inf"), "-inf").otherwise("").alias("kind"), F.when(none, F.lit(0.0)).otherwise(F.round(y, 6)).alias("value"))

    q(name, f"SELECT l_orderkey, l_linenumber, {'y' if text else said} FROM (SELECT l_orderkey, l_linenumber, {sql} AS y FROM (SELECT *, {_X} AS x FROM lineitem))")(run)


ieee("ieee_rational", lambda x: C.rational(x, (0, 0, 7, 0, 1, -10)), "CASE WHEN isnan(x) THEN x WHEN abs(x - 10) > 1e-15 AND NOT isinf(x) THEN 7 / (x - 10) WHEN isinf(x) THEN x ELSE x END")
ieee("ieee_divide", lambda x: C.algebraic(x, "5 / X"), "CASE WHEN isnan(x) THEN x WHEN x = 0 THEN 'inf'::DOUBLE WHEN isinf(x) THEN 0 ELSE 5 / x END")
ieee("ieee_logarithm", lambda x: C.algebraic(x, "ln(X - 10)"), "CASE WHEN isnan(x) THEN x WHEN x = 'inf'::DOUBLE THEN x WHEN x = 10 THEN '-inf'::DOUBLE WHEN x < 10 THEN 'nan'::DOUBLE ELSE ln(x - 10) END")
_K2 = [(0, 1.0), (10, 3.0), (20, 9.0)]
ieee("ieee_table_interp", lambda x: C.table(x, _K2), "CASE WHEN isnan(x) THEN x WHEN x <= 0 THEN 1.0 WHEN x >= 20 THEN 9.0 WHEN x <= 10 THEN 1 + 2 * x / 10 ELSE 3 + 6 * (x - 10) / 10 END")
ieee("ieee_table_nearest", lambda x: C.table(x, _K2, False), "CASE WHEN isnan(x) THEN x WHEN x <= 5 THEN 1.0 WHEN x <= 15 THEN 3.0 ELSE 9.0 END")
ieee("ieee_range_value", lambda x: C.range_value(x, [(0, 10, 1.0), (10, 1e300, 2.0)], -1.0, False), "CASE WHEN isnan(x) OR isinf(x) THEN -1.0 WHEN x >= 0 AND x < 10 THEN 1.0 ELSE 2.0 END")
ieee("ieee_value_text", lambda x: C.value_text(x, [(float("nan"), "never"), (0.0, "zero"), (10.0, C.linear(x, (0.5, 0.0)).cast("string"))], "other"), "CASE WHEN x = 0 THEN 'zero' WHEN x = 10 THEN '0.5' ELSE 'other' END", text=True)
q("bits_of_64", "SELECT o_orderkey, o_orderkey AS u, o_orderkey AS v FROM orders")(lambda s, d: t(s, d, "orders").select("o_orderkey", C.bits_unsigned(F.col("o_orderkey"), 0, 64).alias("u"), C.bits_signed(F.col("o_orderkey"), 0, 64).alias("v")))


@query("align_series", "SELECT coalesce(a.o_orderkey, b.k) AS k, a.o_totalprice AS price, b.q FROM orders a FULL JOIN (SELECT l_orderkey AS k, sum(l_quantity) AS q FROM lineitem GROUP BY 1) b ON a.o_orderkey = b.k")
def align_series(s, d):
    b = t(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_quantity").alias("q"))
    a = t(s, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"))
    return a.join(b, "k", "full").select("k", "price", "q")


QUERIES, SQL = _Q | recorded.QUERIES, _SQL | recorded.SQL
