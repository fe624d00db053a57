"""Best-fit packing by a grouping genetic algorithm on islands."""

from __future__ import annotations

import os
import random
import re
import zlib
from bisect import bisect_left, insort
from functools import lru_cache
from itertools import islice
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm.common import cut, map_rows, row_key, table

SHARD = 1000
ISLANDS, POPULATION, EPOCHS, GENERATIONS = 3, 3, 3, 6
CACHE = 400_000


class Ids:
    """Token ids of whole texts as little-endian bytes, remembered by word.

    The vocabulary's pre-tokenizer drops white space and never joins across it, so
    a text's ids are those of its words; it also parts Latin letters from the ASCII
    marks after them. The library encodes what is new, all such parts of a batch in
    one call: each is one pre-token, and only its last id is that of a word end.
    These parts come in lower case, composed, and in the letters that stand for
    bytes, so for them the library leaves its normalizer and patterns out. A part
    is a word itself, so it is remembered as one. When there are too many words,
    those that came in two calls or more since the last time stay.
    """

    _PLAIN = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])*)([!-&(-/:-@\[-`{-~]*)")

    _MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c != 39)

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer, self.known, self.again = Tokenizer.from_file(path), {b"": b""}, set()
        self.parted = Tokenizer.from_file(path)
        self.parted.normalizer, self.parted.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: letters.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}  # beyond ASCII the parts have no others
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")

    def encode(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        if len(self.known) > CACHE:
            self.known, self.again = {b"": b""} | {w: self.known[w] for w in islice(self.again, CACHE // 2)}, set()
        split = pc.ascii_split_whitespace(pa.array([t.encode("utf-8", "surrogatepass") for t in texts], pa.large_binary()).view(pa.large_string()))
        coded = split.values.dictionary_encode()
        words, known = coded.dictionary.view(pa.large_binary()).to_pylist(), self.known
        new = {w for w in words if w not in known}
        self.again.update(w for w in words if w not in new)
        self._learn(new)
        flat = pa.array(list(map(known.__getitem__, words)), pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(flat.buffers()[1], "<i8", len(flat) + 1)[split.offsets.to_numpy()].tolist()
        raw = memoryview(flat.buffers()[2] or b"")
        return [raw[a:b].tobytes() for a, b in zip(ends, ends[1:])]

    def _learn(self, words: set[bytes]) -> None:
        known = self.known
        bare = [w for w in words if w.isalpha()]  # of bytes: ASCII letters
        lower = b" ".join(bare).lower().split()
        plain, cores, marks, other = [], [], [], []
        for w in words.difference(bare):
            a = w.rstrip(self._MARKS)
            if a.isalpha():
                plain.append(w)
                cores.append(a)
                marks.append(w[len(a) :])
            elif m := self._PLAIN.fullmatch(w):
                a, b = m.groups()
                plain.append(w)
                cores.append(a)
                marks.append(b)
            else:
                other.append(w)
        cores = b"\n".join(cores).decode().lower().encode().split(b"\n")
        new = list({*lower, *cores, *marks}.difference(known))
        if new:
            new.sort(key=bytes.isascii)  # so that few calls hold other letters, which are slow to replace
            some = [b" ".join(new[k : k + 100]).decode() for k in range(0, len(new), 100)]
            some = [x if x.isascii() else x.translate(self.letters) for x in some]
            ids = np.concatenate([np.array(e.ids, "<u4") for e in self.parted.encode_batch_fast(some, add_special_tokens=False)])
            raw, ends = ids.tobytes(), ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            known.update(zip(new, [raw[a:b] for a, b in zip([0, *ends], ends)], strict=True))
        known.update(zip(bare, map(known.__getitem__, lower), strict=True))
        known.update(zip(plain, map(add, map(known.__getitem__, cores), map(known.__getitem__, marks))))
        for at in range(0, len(other), 2000):
            some = other[at : at + 2000]
            for w, e in zip(some, self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in some], add_special_tokens=False)):
                known[w] = np.array(e.ids, "<u4").tobytes()


@lru_cache(maxsize=1)
def ids_of(path: str) -> Ids:
    """One for all tasks of a Python worker, so that the next task finds the words known."""
    return Ids(path)


def pieces(docs: DataFrame, path: str, size: int = 4096, end: int = 1) -> DataFrame:
    """(row, doc_id, piece, start, length, ids_crc32) of every row of ``docs``; null texts are empty."""

    def make():
        ids = ids_of(path)
        stop = np.array([end], "<u4").tobytes()

        def step(cols):
            out = []
            for key, doc_id, raw in zip(cols["_key"], cols["doc_id"], ids.encode([t or "" for t in cols["text"]])):
                raw += stop
                for i, at in enumerate(range(0, len(raw), 4 * size)):
                    part = raw[at : at + 4 * size]
                    out.append((key, doc_id, i, at // 4, len(part) // 4, zlib.crc32(part)))
            return list(map(list, zip(*out))) or None

        return step

    return map_rows(docs.select(row_key().alias("_key"), "doc_id", "text"), "row binary, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint", make)


Packing = tuple[list[list[int]], list[int]]  # the documents of each bin, and how full it is


def best_fit(order, sizes, room: int, packing: Packing) -> Packing:
    """Put each of ``order`` in the fullest bin that holds it, else in a new one."""
    bins, fills = packing
    free = sorted((room - f, k) for k, f in enumerate(fills))
    for i in order:
        size = sizes[i]
        at = bisect_left(free, (size, -1))
        if at < len(free):
            left, k = free.pop(at)
            bins[k].append(i)
        else:
            left, k = room, len(bins)
            bins.append([i])
            fills.append(0)
        fills[k] += size
        insort(free, (left - size, k))
    return packing


def fitness(packing: Packing) -> tuple[int, int]:
    """Fewer bins first; among equal numbers, fuller full ones and emptier empty ones."""
    return -len(packing[0]), sum(f * f for f in packing[1])


def crossover(one: Packing, other: Packing, sizes, room: int, rng: random.Random) -> Packing:
    """``one`` with some well-filled bins of ``other``: bins that share a document go, what they held else is best-fitted."""
    full = [k for k, f in enumerate(other[1]) if f >= 0.98 * room] or range(len(other[0]))
    taken = rng.sample(full, rng.randint(1, max(1, len(full) // 2)))
    inside = {i for k in taken for i in other[0][k]}
    bins, fills, loose = [other[0][k][:] for k in taken], [other[1][k] for k in taken], []
    for b, f in zip(*one):
        if inside.isdisjoint(b):
            bins.append(b[:])
            fills.append(f)
        else:
            loose += [i for i in b if i not in inside]
    loose.sort(key=lambda i: -sizes[i])
    return best_fit(loose, sizes, room, (bins, fills))


def first_people(sizes, room: int, island: int, rng: random.Random, number: int = POPULATION) -> list[Packing]:
    """Best fit in decreasing order, blurred; the first of island 0 is not blurred."""
    out = []
    for k in range(number):
        blur = 0.2 if k or island else 0.0
        order = sorted(range(len(sizes)), key=lambda i: -sizes[i] * rng.uniform(1 - blur, 1 + blur))
        out.append(best_fit(order, sizes, room, ([], [])))
    return out


def settled(packing: Packing, room: int) -> bool:
    """Whether no packing can do better: the least number of bins, and all but one well filled."""
    return len(packing[0]) <= -(-sum(packing[1]) // room) and sum(f < 0.97 * room for f in packing[1]) <= 1


def epoch(people: list[Packing], sizes, room: int, rng: random.Random, generations: int = GENERATIONS) -> list[Packing]:
    """``people`` after one generation or more, the fittest first, until the fittest is settled: a child takes the place of the least fit if it is fitter."""
    people = sorted(people, key=fitness, reverse=True)
    for k in range(generations if len(people) > 1 and len(sizes) > 1 else 0):
        if k and settled(people[0], room):
            break
        one, other = rng.sample(people, 2)
        child = crossover(one, other, sizes, room, rng)
        if fitness(child) > fitness(people[-1]):
            people = sorted([*people[:-1], child], key=fitness, reverse=True)
    return people


def immigrate(people: list[Packing], elite: Packing) -> list[Packing]:
    """The elite of the island before takes the place of the least fit."""
    return [*people[:-1], elite] if people else [elite]


def seeded(shard: int, island: int, number: int) -> random.Random:
    return random.Random(shard * 1009 + island * 31 + number)


def evolve(sizes: list[int], room: int, seed: int = 0, islands: int = ISLANDS, epochs: int = EPOCHS) -> list[list[int]]:
    """The island model in one process: what pack() deals over tasks. Returns the documents of each bin."""
    isles = [epoch(first_people(sizes, room, i, seeded(seed, i, 0)), sizes, room, seeded(seed, i, 1)) for i in range(islands)]
    for n in range(2, epochs + 1):
        isles = [epoch(immigrate(isles[i], isles[i - 1][0]), sizes, room, seeded(seed, i, n)) for i in range(islands)]
    return max((people[0] for people in isles), key=fitness)[0]


def _written(packing: Packing, n: int) -> bytes:
    out = np.zeros(n, "<i4")
    for k, b in enumerate(packing[0]):
        out[b] = k
    return out.tobytes()


def _read(raw: bytes, sizes: list[int]) -> Packing:
    of = np.frombuffer(raw, "<i4").tolist()
    bins: list[list[int]] = [[] for _ in range(max(of, default=-1) + 1)]
    fills = [0] * len(bins)
    for i, k in enumerate(of):
        bins[k].append(i)
        fills[k] += sizes[i]
    return bins, fills


_STATE = "shard bigint, island int, sizes binary, people array<binary>, bins int, squares bigint"


def _islands(keyed: DataFrame, room: int) -> DataFrame:
    """(shard, packing): the island model of each shard, one group a shard and island, elites passed on by a shuffle after each epoch."""

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = pdf.sort_values(["length", "row", "piece", "twin"], ascending=[False, True, True, True])["length"]
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "sizes": [sizes.to_numpy("<i4").tobytes()]})

    def stage(n: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            own = pdf[pdf["sizes"].notna()].iloc[0]
            raw, shard, island = own["sizes"], int(own["shard"]), int(own["island"])
            sizes = np.frombuffer(raw, "<i4").tolist()
            if n == 1:
                people = first_people(sizes, room, island, seeded(shard, island, 0))
            else:
                people = [_read(x, sizes) for x in own["people"]]
                for x in pdf.loc[pdf["sizes"].isna(), "people"]:
                    people = immigrate(people, _read(x[0], sizes))
            people = epoch(people, sizes, room, seeded(shard, island, n))
            written = [_written(x, len(sizes)) for x in people]
            bins, squares = fitness(people[0])
            rows = [(shard, island, raw, written, bins, squares)]
            if n < EPOCHS:
                rows.append((shard, (island + 1) % ISLANDS, None, written[:1], bins, squares))
            return pd.DataFrame(rows, columns=["shard", "island", "sizes", "people", "bins", "squares"])

        return run

    isles = keyed.groupBy("shard").applyInPandas(gather, "shard bigint, sizes binary")
    isles = isles.select("shard", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "sizes", F.lit(None).cast("array<binary>").alias("people"))
    for n in range(1, EPOCHS + 1):
        isles = isles.groupBy("shard", "island").applyInPandas(stage(n), _STATE)
    return isles.groupBy("shard").agg(F.max_by(F.col("people")[0], F.struct("bins", "squares", -F.col("island"))).alias("packing"))


def _round(parts: DataFrame, room: int, number: int, last: bool) -> DataFrame:
    """Pack the rows of ``parts`` in shards of about SHARD; unless last, bins under 0.97 full are left open (sequence_id null)."""
    shards = max(1, -(-parts.count() // SHARD))
    # zones of the hash, not groups of the data: no key can make a shard large
    keyed = parts.withColumn("shard", F.pmod(F.xxhash64("row", "piece", F.lit(number), F.col("twin")), F.lit(shards)))

    def place(pdf: pd.DataFrame, best: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "row", "piece", "twin"], ascending=[False, True, True, True]).reset_index(drop=True)
        sizes, shard = pdf["length"].tolist(), int(pdf["shard"].iloc[0])
        seq, off = np.full(len(pdf), -1, np.int64), np.zeros(len(pdf), np.int64)
        for k, (b, fill) in enumerate(zip(*_read(best["packing"].iloc[0], sizes))):
            at = 0
            if last or fill >= 0.97 * room:
                for i in b:
                    seq[i], off[i] = (number << 60) | (shard << 20) | k, at
                    at += sizes[i]
        return pdf.drop(columns="shard").assign(sequence_id=seq, offset=off)

    fields = "row binary, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, twin bigint, sequence_id bigint, offset bigint"
    return keyed.groupBy("shard").cogroup(_islands(keyed, room).groupBy("shard")).applyInPandas(place, fields)


def pack(docs: DataFrame, path: str, size: int = 4096, end: int = 1) -> DataFrame:
    """A place for every piece of every row of ``docs`` (doc_id, text; other columns are ignored).

    Shards of about 1000 pieces are each solved by an island model: ISLANDS groups
    a shard evolve apart, and after each epoch the elite of each goes to the next
    by a shuffle. Pieces of bins under 0.97 full go to new shards for a second
    round, and once more to a third. Null and empty texts are one token. Repeated
    rows are each placed; ties go by row, piece and place. No rows give no rows.
    """
    fixed = cut(pieces(docs, path, size, end).withColumn("twin", F.monotonically_increasing_id()))
    one = cut(_round(fixed, size, 1, False))
    two = cut(_round(one.where("sequence_id < 0").drop("sequence_id", "offset"), size, 2, False))
    three = _round(two.where("sequence_id < 0").drop("sequence_id", "offset"), size, 3, True)
    return one.where("sequence_id >= 0").union(two.where("sequence_id >= 0")).union(three).drop("row", "twin")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
