"""SimHash near-duplicates by deletion-variant signatures."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm.common import components, cut, map_rows, row_key, table, unused

BLOCK = 2048
_UPPER = {i: i + 32 for i in range(65, 91)}


def fingerprint(text: str | None) -> int:
    words = (text or "").translate(_UPPER).encode("utf-8", "surrogatepass").split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(words, words[1:], words[2:])) if len(words) >= 3 else [b" ".join(words)]
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        bits = np.unpackbits(h[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big", signed=True)


def signatures(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the 2 x 32 one-wildcard variants of the halves of ``fps`` (uint64), and the fingerprint of each key.

    Three differing bits leave one half with at most one, so two linked
    fingerprints share a variant of that half. Key: half, wildcard, masked bits.
    """
    keys = []
    for half in range(2):
        part = (fps >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        for j in range(32):
            keys.append((part & ~np.uint64(1 << j)) | np.uint64((half * 32 + j) << 32))
    return np.concatenate(keys), np.tile(fps, 64)


def _links(fps: np.ndarray, wildcard: int, half: int, limit: int):
    """Links among the distinct fingerprints of one bucket, block by block.

    Equal halves meet in all 32 variants and are compared only in the first; the
    others compare the two sides of the wildcard. A fingerprint once linked to an
    earlier one of a complete block needs no further link to that block's class.
    """
    bit = (fps >> np.uint64(half * 32 + wildcard)) & np.uint64(1)
    sides = [(fps[bit == 0], fps[bit == 1], False)]
    if wildcard == 0:
        sides += [(fps[bit == 0],) * 2 + (True,), (fps[bit == 1],) * 2 + (True,)]
    for x, y, same in sides:
        for a in range(0, len(x), BLOCK):
            for b in range(a if same else 0, len(y), BLOCK):
                p, q = x[a : a + BLOCK], y[b : b + BLOCK]
                near = np.bitwise_count(p[:, None] ^ q[None, :]) <= limit
                i, j = np.nonzero(near)
                if same and a == b:
                    i, j = i[i < j], j[i < j]
                if len(i):
                    yield from _forest(p[i], q[j])


def _forest(a: np.ndarray, b: np.ndarray):
    """A spanning forest of the links: as many rows as joined classes need, never all pairs."""
    up: dict[int, int] = {}

    def root(v):
        while (u := up.get(v, v)) != v:
            up[v] = up.get(u, u)
            v = up[v]
        return v

    for s, t in zip(a.tolist(), b.tolist()):
        if (x := root(s)) != (y := root(t)):
            up[max(x, y)] = min(x, y)
            yield s, t


def fingerprint_links(fps: DataFrame, limit: int = 3) -> DataFrame:
    """Links (a, b) that join every two distinct values of ``fp`` with at most ``limit`` (3) differing bits.

    A bucket of over BLOCK fingerprints is not compared where it lies: they differ
    in three bits at most, so one byte of the other half is equal, and they go on
    to four smaller buckets each, by the place and value of such a byte.
    """

    def vary(batches):
        for batch in batches:
            v = batch.column(0).to_numpy().astype(np.int64).view(np.uint64)
            for at in range(0, len(v), 2000):
                k, f = signatures(v[at : at + 2000])
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(f.view(np.int64))], ["k", "fp"])

    def put(deferred, a, b):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), deferred)), pa.array(np.ascontiguousarray(a).view(np.int64)), pa.array(np.ascontiguousarray(b).view(np.int64))], ["deferred", "a", "b"])

    def solve(key, group):
        v = np.array(list(_links(group.view(np.uint64), (key >> 32) & 31, (key >> 37) & 1, limit)), np.uint64).reshape(-1, 2)
        if len(v):
            yield put(False, v[:, 0], v[:, 1])

    def match(most):
        def run(batches):
            """Groups of sorted rows, one at a time; what is over ``most`` goes on as it comes."""
            key, held, large = None, [], False
            for batch in batches:
                k, f = (batch.column(i).to_numpy() for i in range(2))
                starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else []
                for a, b in zip(starts, [*starts[1:], len(k)]):
                    if k[a] != key:
                        if sum(map(len, held)) > 1:
                            yield from solve(key, np.concatenate(held))
                        key, held, large = int(k[a]), [], False
                    held.append(f[a:b])
                    if large or sum(map(len, held)) > most:
                        large = True
                        for x in held:
                            yield put(True, np.full(len(x), key), x)
                        held = []
            if sum(map(len, held)) > 1:
                yield from solve(key, np.concatenate(held))

        return run

    schema = "deferred boolean, a bigint, b bigint"
    keyed = fps.select("fp").mapInArrow(vary, "k bigint, fp bigint")
    met = cut(keyed.repartition("k").sortWithinPartitions("k").mapInArrow(match(BLOCK), schema))
    half = F.when(F.shiftright("a", 37) == 0, F.shiftrightunsigned("b", 32)).otherwise(F.col("b"))
    # half, wildcard, the byte's place and value, and of the masked bits a hash that keeps them apart
    again = met.where("deferred").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(3))))
    part = F.expr("shiftright(_half, i * 8) & 255")
    again = again.withColumn("_half", half).select(F.xxhash64("a", "i", part).alias("s"), "a", F.col("b").alias("fp"))

    def match_again(batches):
        key, held = None, []
        for batch in batches:
            s, a, f = (batch.column(i).to_numpy() for i in range(3))
            starts = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (a[1:] != a[:-1])]) if len(s) else []
            for x, y in zip(starts, [*starts[1:], len(s)]):
                if (s[x], a[x]) != key:
                    if sum(map(len, held)) > 1:
                        yield from solve(int(key[1]), np.concatenate(held))
                    key, held = (s[x], a[x]), []
                held.append(f[x:y])
        if sum(map(len, held)) > 1:
            yield from solve(int(key[1]), np.concatenate(held))

    second = again.repartition("s").sortWithinPartitions("s", "a").mapInArrow(match_again, schema)
    return met.where("not deferred").union(second).select("a", "b")


def simhash_components(docs: DataFrame) -> DataFrame:
    """Fingerprint and near-duplicate class of every row of ``docs`` (doc_id, text; other columns are ignored).

    Null, empty and wordless texts have fingerprint zero and link as any other.
    Equal fingerprints collapse before the search, so copies are never paired.
    Null ids stay rows and count as no smallest id; repeated rows stay.
    """

    return classes(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def classes(docs: DataFrame) -> DataFrame:
    """(row, doc_id, fp, root, component_id) of every row: root names the class also where all ids are null."""

    def make():
        return lambda cols: [cols["row"], cols["doc_id"], list(map(fingerprint, cols["text"]))]

    fps = cut(map_rows(docs.select(row_key().alias("row"), "doc_id", "text"), "row binary, doc_id bigint, fp bigint", make))
    least = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(fingerprint_links(least))
    rooted = least.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    return fps.join(named.select("fp", "root", "component_id"), "fp")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each near-duplicate class: the smallest id, null last; among equal ids, by text."""
    name = unused(docs, "_row")
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row")
    first = classes(docs.select("doc_id", "text")).groupBy("root").agg(F.min(place).alias("p")).select(F.col("p.row").alias(name))
    return docs.withColumn(name, row_key()).join(first, name, "left_semi").dropDuplicates([name]).drop(name)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    return simhash_components(table(spark, sf_dir, "documents"))
