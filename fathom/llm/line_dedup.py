"""Line dedup by overlapping windows of three lines."""

from __future__ import annotations

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from fathom.llm.common import cut, map_rows, row_key, table, unused

WINDOW = 3
BLANK = " \t\n\v\f\r"


def filled(text: str) -> tuple[list[str], list[int]]:
    """The lines of a text and the indexes of those with a word."""
    lines = text.split("\n")
    return lines, [i for i, line in enumerate(lines) if line.strip(BLANK)]


def without(text: str | None, gone) -> tuple[str | None, int, int]:
    """A text without some of its lines with a word, its lines before, and the lines removed."""
    if not text:
        return text, 0, 0
    lines, at = filled(text)
    drop = set() if gone is None else {at[p] for p in gone}
    return "\n".join(x for i, x in enumerate(lines) if i not in drop) if drop else text, len(lines), len(drop)


def line_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with every later occurrence of three consecutive lines removed.

    Lines are \\n-split and compared without outer blanks; lines without a word are
    passed over and stay. The first occurrence by (doc_id, null last; row; line)
    stays. An occurrence that overlaps the first in its own text loses only what
    the first does not cover. Rows repeated whole count as one. Null texts and
    texts of fewer than three lines stay as they are. All columns stay; n_lines and
    n_removed are added (columns of these names are replaced).
    """
    key, gone, new = (unused(docs, x) for x in ("_key", "_gone", "_new"))
    keyed = cut(docs.withColumn(key, row_key()))

    def make():
        def step(cols):
            out = [[], [], [], []]
            for row, doc_id, text in zip(cols["row"], cols["doc_id"], cols["text"]):
                if not text:
                    continue
                lines, at = filled(text)
                kept = [lines[i].strip(BLANK) for i in at]
                for p in range(len(kept) - WINDOW + 1):
                    out[0].append(row)
                    out[1].append(doc_id)
                    out[2].append(p)
                    out[3].append(xxhash.xxh3_128_digest("\n".join(kept[p : p + WINDOW]).encode("utf-8", "surrogatepass")))
            return out

        return step

    windows = map_rows(keyed.select(F.col(key).alias("row"), "doc_id", "text"), "row binary, doc_id bigint, p int, h binary", make)
    place = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("row").alias("k"), F.col("p").alias("p"))
    windows = cut(windows.select("h", place.alias("place")))
    repeated = windows.groupBy("h").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first != last")
    later = windows.join(repeated.select("h", "first"), "h").where("place != first")
    begin = F.when((F.col("place.k") == F.col("first.k")), F.greatest(F.col("place.p"), F.col("first.p") + WINDOW)).otherwise(F.col("place.p"))
    spans = later.select(F.col("place.k").alias(key), begin.alias("a"), (F.col("place.p") + WINDOW).alias("b")).where("a < b")
    cuts = spans.groupBy(key).agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    cuts = cuts.select(key, F.expr("array_distinct(flatten(transform(spans, s -> sequence(s.a, s.b - 1))))").alias(gone))
    both = keyed.drop("n_lines", "n_removed").join(cuts, key, "left")

    @pandas_udf("text string, n_lines bigint, n_removed bigint")
    def removed(text: pd.Series, gone: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([without(t, g) for t, g in zip(text, gone)], columns=["text", "n_lines", "n_removed"])

    done = both.withColumn(new, removed("text", gone))
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return done.select(*[F.col(f"{new}.text").alias("text") if c == "text" else F.col(f"`{c}`") for c in names], F.col(f"{new}.n_lines"), F.col(f"{new}.n_removed"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents without later copies of three lines in a row."""
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")
