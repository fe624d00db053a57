"""Benchmark decontamination by typed templates: placeholders, a hash join of template windows, slot consistency."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm.common import cut, map_rows, row_key, signed, table, unused

WINDOW, LEAST_WORDS, LEAST_SHARE, LITERALS = 8, 13, 0.6, 4
FILTER_BITS = 10, 26  # the least and the most of the log of the filter's size
UNITS = frozenset("km m cm mm mi mile miles ft feet inch inches kg g mg lb lbs oz ton tons l ml s sec seconds min minutes h hour hours day days week weeks month months year years kmh mph usd eur dollars euros cents percent degrees".split())
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(%|[a-z]{0,3})$")
_EDGE = " .,;:!?\"'()[]{}*#$%&|<>`~_-"
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))


def template(word: str) -> tuple[str, str, bool]:
    """A word's template at the start of a sentence and within one, and whether it ends one."""
    bare = word.strip(_EDGE)
    low = bare.lower()
    ends = not word[-1:].isalnum() and word.rstrip("\"')]}")[-1:] in (".", "!", "?", ":")
    if not low[:1].isalpha() and _NUMBER.match(low):
        return "<num>", "<num>", ends
    if low in UNITS:
        return "<unit>", "<unit>", ends
    title = low != bare and len(bare) > 1 and bare[0].isupper() and bare[1:] == low[1:]
    return low, "<name>" if title else low, ends


class Templates:
    """Template hashes of texts; remembers a bounded number of words."""

    def __init__(self, most: int = 200_000):
        self.most, self.index = most, {}
        self.arrays = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.int8)

    def _add(self, words: list[bytes]) -> None:
        start, within, ends, slots = [], [], [], []
        for word in words:
            a, b, end = template(word.decode("utf-8", "surrogatepass"))
            h = xxhash.xxh64_intdigest(a.encode("utf-8", "surrogatepass"), 7)
            start.append(h)
            within.append(h if b is a else xxhash.xxh64_intdigest(b, 7))
            ends.append(end)
            slots.append((a[:1] == "<") + 2 * (b[:1] == "<"))
        n = len(self.index)
        self.index.update(zip(words, range(n, n + len(words))))
        self.arrays = tuple(np.concatenate([x, np.array(v, x.dtype)]) for x, v in zip(self.arrays, (start, within, ends, slots)))

    def places(self, words: list[bytes]) -> np.ndarray:
        """Where the arrays hold each word."""
        if len(self.index) > self.most:
            self.__init__(self.most)
        if new := set(words).difference(self.index):
            self._add(list(new))
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def hashes(self, at: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash of each word's template, whether that is a placeholder, and what makes a title-case word at the start of a sentence a name (else 0).

        ``at``: the words of texts one after the other; ``begin``: where texts begin.
        """
        start, within, ends, slot = self.arrays
        if not len(at):
            return np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.uint64)
        first = np.r_[True, ends[at[:-1]]]
        first[begin[begin < len(at)]] = True
        maybe = np.where(first & (slot[at] == 2), within[at] - start[at], np.uint64(0))
        return np.where(first, start[at], within[at]), np.where(first, slot[at] & 1, slot[at] >> 1).astype(bool), maybe


@lru_cache(maxsize=1)
def shared_templates() -> Templates:
    """One for all tasks of a Python worker: what it remembers doesn't depend on the items."""
    return Templates()


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base & (1 << 64) - 1))
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive values: the sum of value * step ** (n - 1 - place), from differences of one running sum."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    total = np.r_[np.uint64(0), np.cumsum(h * powers(int(_BACK), len(h)), dtype=np.uint64)]
    out = total[n:] - total[:-n]
    return out * (powers(int(_STEP), len(out)) * np.uint64(pow(int(_STEP), n - 1, 1 << 64)))


def all_windows(h: np.ndarray, maybe: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first word, words made names) of every n consecutive values, each word of ``maybe`` both as it is and as a name."""
    w = windows(h, n)
    m, power = np.flatnonzero(maybe), 1
    more, at, names = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for j in range(n - 1, -1, -1) if len(m) else ():
        i = m[(m >= j) & (m - j < len(w))] - j
        k = np.flatnonzero(maybe[at + j])
        put = w[i] + maybe[i + j] * np.uint64(power), more[k] + maybe[at[k] + j] * np.uint64(power)
        more, at, names = np.concatenate([more, *put]), np.concatenate([at, i, at[k]]), np.concatenate([names, np.ones(len(i), np.int64), names[k] + 1])
        power = power * int(_STEP) & (1 << 64) - 1
    return np.concatenate([w, more]), np.concatenate([np.arange(len(w)), at]), np.concatenate([np.zeros(len(w), np.int64), names])


def bare(word: bytes) -> str:
    return word.decode("utf-8", "surrogatepass").strip(_EDGE).lower()


def text_windows(batch: list[bytes], n: int, templates: Templates, found=None):
    """(hash, text, first word there, words made names) of all windows of n words within one text, those that ``found`` lets through; and the texts' words."""
    split = [t.split() for t in batch]
    at = templates.places([w for words in split for w in words])
    ends = np.cumsum([len(w) for w in split], dtype=np.int64)
    begin = np.r_[0, ends[:-1]] if len(ends) else ends
    h, slots, maybe = templates.hashes(at, begin)
    w, first, names = all_windows(h, maybe, n)
    keep = np.ones(len(w), bool) if found is None else found(w)
    w, first, names = w[keep], first[keep], names[keep]
    text = np.searchsorted(ends, first, "right")
    within = first + n <= ends[text] if len(first) else np.zeros(0, bool)
    w, first, names, text = w[within], first[within], names[within], text[within]
    return w, text, first - begin[text], names, split, slots, maybe, begin


def item_windows(items: list[bytes], templates: Templates):
    """(item, n, hash, place, words, marks) of each distinct window of an item with enough literal words; marks: 1 a slot, 2 maybe a name."""
    out = []
    for k, item in enumerate(items):
        n = min(WINDOW, len(item.split()))
        if not n:
            continue
        w, _, place, names, (words,), slots, maybe, _ = text_windows([item], n, templates)
        literal = np.convolve(~slots, np.ones(n, int), "valid")
        marks = (slots + 2 * (maybe != 0)).astype(np.uint8)
        for i in np.flatnonzero(literal[place] - names >= min(LITERALS, n)).tolist():
            p = int(place[i])
            out.append((k, n, signed(int(w[i])), p, b" ".join(words[p : p + n]), marks[p : p + n].tobytes()))
    return out


def leak(own: int, hits: list[tuple[int, int, bytes, bytes, bytes]]) -> tuple[int, float, int] | None:
    """(covered words, share, first word in the text) of an item of ``own`` words, from hits (place in the item, place in the text, its words, the text's words, marks)."""
    lines: dict[int, dict[int, tuple[bytes, bytes, int]]] = {}
    for p, i, a, b, marks in hits:
        line = lines.setdefault(i - p, {})
        for k, pair in enumerate(zip(a.split(), b.split(), marks)):
            line[p + k] = pair
    covered: set[int] = set()
    first = None
    for shift, line in lines.items():
        if consistent(line):
            covered |= line.keys()
            first = min(x for x in (first, min(line) + shift) if x is not None)
    n = len(covered)
    return (n, n / own, first) if n and (n >= min(LEAST_WORDS, own) or n >= LEAST_SHARE * own) else None


def consistent(line: dict[int, tuple[bytes, bytes, int]]) -> bool:
    """Equal slot values of the item are equal in the text too (one odd slot in five is borne), unequal ones may coincide; a changed title-case word at the start of a sentence is a slot."""
    there: dict[str, str] = {}
    odd = total = 0
    for p in sorted(line):
        own, other, mark = line[p]
        if mark:
            a, b = bare(own), bare(other)
            if mark & 2 and a == b and a not in there:
                continue
            total += 1
            odd += there.setdefault(a, b) != b
    return 5 * odd <= total


class Filter:
    """Which window hashes may be an item's: a table of bits of bounded size, then one more probe into it."""

    def __init__(self, bits: bytes):
        self.table = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").astype(bool)
        self.mask = np.uint64(len(self.table) - 1)

    def __call__(self, w: np.ndarray) -> np.ndarray:
        keep = self.table[w & self.mask]
        at = np.flatnonzero(keep)
        keep[at] = self.table[(w[at] >> np.uint64(32)) & self.mask]
        return keep


def _bits(own: DataFrame) -> bytes:
    """The filter of the items' windows. Its bits are gathered by words of 32, so the driver gets at most 2 ** 26 bits."""
    log = min(max(FILTER_BITS[0], (64 * own.count()).bit_length()), FILTER_BITS[1])
    both = own.select(F.explode(F.array("h", F.shiftrightunsigned("h", 32))).alias("x")).select(F.col("x").bitwiseAND((1 << log) - 1).alias("x"))
    words = both.groupBy(F.shiftright("x", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(x & 31 as int))")).alias("bits")).toPandas()
    out = np.zeros(1 << (log - 5), "<u4")
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).astype(np.uint32)
    return out.tobytes()


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """The leaks: (key, item_id, n_covered, share, first_word) of each row of ``docs`` and item of ``benchmark`` it holds.

    A title-case word is a name within a sentence, and both a name and itself at
    the start of one. A window of 8 template words (an item of fewer: all of it) with at least 4
    literal words is a hit; the hits of an item cover 13 of its words or 0.6 of
    them, with consistent slots, in a leak. Windows of both sides meet in a hash
    join; a filter of bounded size keeps back what can't be an item's. Null and
    empty texts and items match nothing; rows repeated whole each get theirs, as
    do repeated items. Other columns are ignored.
    """
    kind = docs.schema[key].dataType.simpleString()

    def items():
        templates = shared_templates()

        def step(cols):
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in cols["text"]]
            rows = [(cols["item"][k], cols["item_id"][k], len(texts[k].split()), *rest) for k, *rest in item_windows(texts, templates)]
            return list(map(list, zip(*rows))) or None

        return step

    numbered = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("bigint").alias("item_id"), "text")
    own = cut(map_rows(numbered, "item bigint, item_id bigint, own int, n int, h bigint, p int, words binary, marks binary", items))
    lengths = sorted(r["n"] for r in own.select("n").distinct().collect())
    shared = docs.sparkSession.sparkContext.broadcast(_bits(own))

    def make():
        templates, found = shared_templates(), Filter(shared.value)

        def step(cols):
            texts, rows = [(t or "").encode("utf-8", "surrogatepass") for t in cols["text"]], []
            for n in lengths:
                w, text, first, _, split, *_ = text_windows(texts, n, templates, found)
                for h, k, i in zip(w.view(np.int64).tolist(), text.tolist(), first.tolist()):
                    rows.append((cols["row"][k], cols[key][k], n, h, i, b" ".join(split[k][i : i + n])))
            return list(map(list, zip(*rows))) or None

        return step

    hits = map_rows(docs.select(F.monotonically_increasing_id().alias("row"), key, "text"), f"row bigint, `{key}` {kind}, n int, h bigint, i bigint, there binary", make)
    met = hits.join(own, ["n", "h"]).groupBy("row", key, "item", "item_id", "own").agg(F.collect_list(F.struct("p", "i", "words", "there", "marks")).alias("hits"))

    def judge():
        def step(cols):
            rows = []
            for k, item, own, hits in zip(cols[key], cols["item_id"], cols["own"], cols["hits"]):
                if (x := leak(own, [tuple(h.values()) for h in hits])) is not None:
                    rows.append((k, item, *x))
            return list(map(list, zip(*rows))) or None

        return step

    return map_rows(met.select(key, "item_id", "own", "hits"), f"`{key}` {kind}, item_id bigint, n_covered bigint, share double, first_word bigint", judge)


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item of ``benchmark``, all columns as they are."""
    name = unused(docs, "_row")
    keyed = docs.withColumn(name, row_key())
    found = decontaminate(keyed.select(name, "text"), benchmark, key=name).select(name).distinct()
    return keyed.join(found, name, "left_anti").drop(name)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which document holds which item of the benchmark."""
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
