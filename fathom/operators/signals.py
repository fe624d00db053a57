"""Time cuts, record windows, layout merging, gaps and summaries of signals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.errors import BeyondEnd, NoStartTime

EPS = 2.220446049250313e-16


def cut_time(df: DataFrame, time: str, start: float, end: float, order: str = "_record", assume_sorted: bool = False) -> DataFrame:
    """Records with start <= t <= end, up to the first record past the end in record order.

    A NaN time is neither past the end nor before the start, so it stays; a null
    time goes. ``assume_sorted`` is the plan for monotone times without NaN: one
    pushed-down range filter.
    """
    t = F.col(time)
    if assume_sorted:
        return df.where((t >= start) & (t - F.lit(end) <= EPS))
    stop = df.where((t - F.lit(end) > EPS) & ~F.isnan(t)).agg(F.min(order).alias("_stop"))
    held = df.crossJoin(F.broadcast(stop))  # one row
    return held.where((F.col("_stop").isNull() | (F.col(order) < F.col("_stop"))) & (F.isnan(t) | ~(t < start))).drop("_stop")


def cut_utc(df: DataFrame, time: str, anchor_ns: int, start_ns: int, end_ns: int, **more) -> DataFrame:
    if anchor_ns == 0:
        raise NoStartTime("the recording has no start time")
    return cut_time(df, time, (start_ns - anchor_ns) / 1e9, (end_ns - anchor_ns) / 1e9, **more)


def record_window(df: DataFrame, start: int, count: int, order: str = "_record", total: int | None = None) -> DataFrame:
    """Records [start, start + count) by their dense record number: a range filter, no sort. With ``total``, beyond it is an error."""
    if total is not None and (start < 0 or count < 0 or start + count > total):
        raise BeyondEnd(f"records {start} to {start + count} of {total}")
    return df.where((F.col(order) >= start) & (F.col(order) < start + count))


def with_time(df: DataFrame, time: str, start_ns: int | None) -> DataFrame:
    """``ts_ns`` (exact) and ``ts`` (to the microsecond) from seconds since the start; without a start both are null."""
    ns = F.lit(start_ns).cast("bigint") + F.round(F.col(time) * 1e9).cast("bigint")
    return df.withColumn("ts_ns", ns).withColumn("ts", F.timestamp_micros(F.expr("ts_ns div 1000")))


def merge_layouts(groups: Sequence[DataFrame], order: str | None = None) -> list[DataFrame]:
    """Groups of equal layout (names, types, nesting in order) appended to the first of them.

    With ``order``, the records of each result are numbered on: first all of the
    first group, then those of the next.
    """
    out: list[list[DataFrame]] = []
    for g in groups:
        for have in out:
            if have[0].dtypes == g.dtypes:
                have.append(g)
                break
        else:
            out.append([g])
    done = []
    for parts in out:
        if order:
            parts = [p.withColumn(order, F.struct(F.lit(i).alias("part"), F.col(order).alias("record"))) for i, p in enumerate(parts)]
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionAll(p)
        done.append(whole)
    return done


def gaps(blocks: DataFrame, by: Sequence[str], start: Column, end: Column, first: Column | None = None, last: Column | None = None) -> DataFrame:
    """Ranges between the furthest end so far and the next start; with ``first`` and ``last`` also before the first block and after the last one."""
    w = Window.partitionBy(*by).orderBy(start, end)
    cursor = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = blocks.select("*", (F.coalesce(cursor, first) if first is not None else cursor).alias("gap_start"), start.alias("gap_end"))
    rows = rows.where(F.col("gap_end") > F.col("gap_start"))
    if last is None:
        return rows
    tail = blocks.groupBy(*by).agg(F.max(end).alias("gap_start"), F.max(last).alias("gap_end")).where("gap_end > gap_start")
    return rows.select(*by, "gap_start", "gap_end").union(tail.select(*by, "gap_start", "gap_end"))


def byte_ranges(blocks: DataFrame, by: Sequence[str], order: str, count: Column, offset: Column, size: int, at: int, width: int, start: int, n: int) -> DataFrame:
    """Of each block that holds some of the records [start, start + n): range_offset and range_length of a field's bytes.

    ``count`` and ``offset``: a block's records and where they begin; records are
    ``size`` bytes, the field lies ``at`` into them and is ``width`` bytes wide.
    """
    before = F.coalesce(F.sum(count).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint")
    rows = blocks.withColumn("_before", before)
    low = F.greatest(F.lit(start).cast("bigint"), F.col("_before"))
    high = F.least(F.lit(start + n).cast("bigint"), F.col("_before") + count)
    rows = rows.withColumn("_low", low).withColumn("_high", high).where("_low < _high")
    out = rows.withColumn("range_offset", offset + (F.col("_low") - F.col("_before")) * size + at).withColumn("range_length", (F.col("_high") - F.col("_low") - 1) * size + width)
    return out.drop("_before", "_low", "_high")


def resample_mean(df: DataFrame, ts: str, value: str, unit: str, empty: bool = False) -> DataFrame:
    """Mean by time bin; with ``empty``, bins without a row are there too, with a null mean."""
    binned = df.groupBy(F.date_trunc(unit, ts).alias("bin")).agg(F.avg(value).alias("mean"))
    if not empty:
        return binned
    ends = binned.agg(F.min("bin").alias("a"), F.max("bin").alias("b"))
    spine = ends.where("a IS NOT NULL").select(F.explode(F.sequence("a", "b", F.expr(f"INTERVAL 1 {unit}"))).alias("bin"))
    return spine.join(binned, "bin", "left")


def rolling_mean(df: DataFrame, value: str, n: int, order: str, by: Sequence[str]) -> Column:
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(1 - n, 0)
    return F.when(F.count(value).over(w) == n, F.avg(value).over(w))
