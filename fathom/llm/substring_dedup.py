"""Substring dedup by compact windows over min-hashes of five-word shingles; texts that share a two-hash signature are verified."""

from __future__ import annotations

from bisect import bisect_right
from functools import cached_property
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm.common import components, cut, map_rows, ship, signed, table

WORDS, HASHES, SIMILAR = 5, 2, 0.8
SHORTEST = 50
NARROW, MATCHES = 6, 1 << 20
FLUSH = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_BYTE = np.array([0 if c in b" \t\n\r\v\f" else xxhash.xxh64_intdigest(bytes([c]).lower(), 1) for c in range(256)], np.uint64)
_PLACE = np.zeros(0, np.uint64)
_ENTRY = np.dtype([("key", "<u8"), ("id", "<i8"), ("p", "<i4")])
_LINK = np.dtype([("id", "<i8"), ("rep", "<i8"), ("lo", "<i4"), ("hi", "<i4"), ("n", "<i4")])


def words_of(raw: bytes) -> np.ndarray:
    """64-bit hashes of the words, A-Z as a-z: sums of a number for each byte, zero for white space, times one for its place."""
    global _PLACE
    x = np.frombuffer(raw, np.uint8)
    there = np.zeros(len(x) + 1, bool)
    np.not_equal(_BYTE[x], 0, out=there[1:])
    start = np.flatnonzero(there[1:] > there[:-1])
    out = np.zeros(len(start), np.uint64)
    for at in range(0, len(start), 1 << 16):  # a bounded number of words at a time
        some = start[at : at + (1 << 16)]
        some, part = some - some[0], x[some[0] : start[at + (1 << 16)] if at + (1 << 16) < len(start) else len(x)]
        size = np.full(len(some), len(part))
        np.subtract(some[1:], some[:-1], out=size[:-1])
        size[-1] -= some[-1]
        place = np.arange(len(part)) - np.repeat(some, size)
        if (longest_word := int(place.max()) + 1) > len(_PLACE):
            _PLACE = mixed(np.arange(1, 2 * longest_word + 1, dtype=np.uint64) * _STEP) | np.uint64(1)
        out[at : at + len(some)] = np.add.reduceat(_BYTE[part] * _PLACE[place], some)
    return mixed(out)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(29)) * _MIX
    return x ^ x >> np.uint64(32)


class Shingles:
    """64-bit hashes of a text's five-word shingles; remembers those of a bounded number of texts."""

    def __init__(self, most: int = 400_000):
        self.most = most
        self.texts, self.held = {}, 0

    def kept(self, text: str) -> Runs:
        """The same for texts met in many pairs: kept up to a bounded number of shingles."""
        if (h := self.texts.get(text)) is None:
            h = Runs(self.of(text))
            if self.held > self.most:
                self.texts.clear()
                self.held = 0
            self.held += len(h.values) + 1
            self.texts[text] = h
        return h

    def of(self, text: str | bytes | None) -> np.ndarray:
        raw = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
        h = words_of(raw)
        n = len(h) - WORDS + 1
        out = np.zeros(max(n, 0), np.uint64)
        for j in range(WORDS if n > 0 else 0):
            out = out * _STEP + h[j : n + j]
        return out


def ranked(h: np.ndarray, f: int) -> np.ndarray:
    """The values of hash function ``f``."""
    x = (h ^ np.uint64((f + 1) * 0x632BE59BD9B4E019 & (1 << 64) - 1)) * _MIX
    x ^= x >> np.uint64(29)
    return x * _STEP


def run_length(least: int) -> int:
    """Shingles in a row that two passages of ``least`` shingles or more share at least, if they are SIMILAR.

    A changed word changes WORDS shingles, so m changes leave n - WORDS m of n
    shingles in at most m + 1 runs, and (n - WORDS m) / (n + WORDS m) >= 0.8 means
    n >= 45 m: the longest run has 40 m / (m + 1) >= 20 shingles, or all of them if m = 0.
    """
    return max(1, min(least, 4 * WORDS, (least - WORDS) // 2))


def sliding_minima(v: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values.

    The nodes of the Cartesian tree of ``v`` that span ``width`` values or more are
    the distinct places of these minima: equal neighbours here are the subsequences
    of one compact window.
    """
    out, have = v, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def signatures(h: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, first place) of each group of ``width``-long subsequences that share their minima under all HASHES functions.

    ``h`` holds texts one after the other, ``ends`` where each ends; no subsequence
    crosses an end. The compact windows of one function are intervals of starts;
    their breaks merged are the interval join with those of the next function.
    """
    if len(h) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    minima = [sliding_minima(ranked(h, f), width) for f in range(HASHES)]
    new = np.ones(len(minima[0]), bool)
    new[1:] = np.logical_or.reduce([m[1:] != m[:-1] for m in minima])
    begin = ends[:-1][ends[:-1] < len(new)]
    new[begin] = True
    for back in range(1, width):  # starts too near to a text's end
        at = ends - back
        new[at[(at >= 0) & (at < len(new))]] = False
    at = np.flatnonzero(new)
    key = np.zeros(len(at), np.uint64)
    for m in minima:
        key = (key ^ m[at]) * _MIX
        key ^= key >> np.uint64(31)
    return key, at


def link(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from every entry of a key to the key's first and to the one before it, smallest ids first; and the entries of keys of over three texts, where these are not all pairs."""
    rows = rows[np.lexsort((rows["p"], rows["id"], rows["key"]))]
    rows = rows[np.r_[True, (rows["p"][1:] != rows["p"][:-1]) | (rows["id"][1:] != rows["id"][:-1]) | (rows["key"][1:] != rows["key"][:-1])]]  # copies came by several tasks
    new = np.r_[True, rows["key"][1:] != rows["key"][:-1]]
    first = rows[np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))]
    rest = np.flatnonzero(~new)
    out = np.zeros(2 * len(rest), _LINK)
    out["id"] = np.tile(rows["id"][rest], 2)
    out["rep"] = np.concatenate([first["id"][rest], rows["id"][rest - 1]])
    out["lo"] = out["hi"] = np.tile(rows["p"][rest], 2)
    out["n"] = 1
    start = np.flatnonzero(new)
    texts = np.add.reduceat(np.r_[True, rows["id"][1:] != rows["id"][:-1]] | new, start, dtype=np.int64)
    many = np.repeat(texts > 3, np.diff(np.r_[start, len(rows)]))
    return merged(out[out["id"] != out["rep"]]), rows[many]


def merged(links: np.ndarray) -> np.ndarray:
    """One link for each two texts, over all places."""
    if not len(links):
        return links
    links = links[np.lexsort((links["rep"], links["id"]))]
    start = np.flatnonzero(np.r_[True, (links["id"][1:] != links["id"][:-1]) | (links["rep"][1:] != links["rep"][:-1])])
    out = links[start].copy()
    out["lo"], out["hi"] = np.minimum.reduceat(links["lo"], start), np.maximum.reduceat(links["hi"], start)
    out["n"] = np.add.reduceat(links["n"], start)
    return out


def text_links(texts: DataFrame, least: int) -> DataFrame:
    """(key, id, rep, lo, hi, n): of texts that share signatures the first and last place of ``id`` where they do, and how often (key is null).

    Entries go by key, in packed rows. Links lead to a key's first text and the one
    before. The entries of a key of over three texts follow, with their key and
    place (lo), for ``untried``.
    """
    width, spark = run_length(least), texts.sparkSession
    ship(spark)
    bits = max(6, (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))).bit_length())
    shift = np.uint64(64 - bits)

    def packed(batches):
        shingles, held, size, seen = Shingles(), [], 0, set()

        def flush(held):
            entries = np.concatenate(held)
            entries = entries[np.argsort(entries["key"] >> shift, kind="stable")]
            group = (entries["key"] >> shift).astype(np.int64)
            start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            stop = np.r_[start[1:], len(group)]
            for at in range(0, len(start), 4096):
                some = list(zip(start[at : at + 4096].tolist(), stop[at : at + 4096].tolist()))
                yield pa.RecordBatch.from_arrays([pa.array(group[start[at : at + 4096]], pa.int64()), pa.array([entries[a:b].tobytes() for a, b in some], pa.binary())], ["bucket", "entries"])

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                ids, hs = [], []
                for i, t in zip(batch.column(0).slice(at, 1000).to_pylist(), batch.column(1).slice(at, 1000).to_pylist()):
                    if i in seen:  # a copy
                        continue
                    seen.add(i)
                    h = shingles.of(t)
                    if len(h) >= least:
                        ids.append(i)
                        hs.append(h)
                if len(seen) > FLUSH:
                    seen.clear()
                if not hs:
                    continue
                ends = np.cumsum([len(h) for h in hs])
                key, place = signatures(np.concatenate(hs), ends, width)
                text = np.searchsorted(ends, place, "right")
                rows = np.zeros(len(key), _ENTRY)
                rows["key"], rows["id"], rows["p"] = key, np.array(ids, np.int64)[text], place - np.r_[0, ends[:-1]][text]
                held.append(rows)
                size += len(rows)
                if size >= FLUSH:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    def met(batches):
        now, held = None, []

        def solve():
            links, many = link(np.concatenate(held))
            for at in range(0, len(links), 100_000):
                part = links[at : at + 100_000]
                yield put(pa.nulls(len(part), pa.int64()), part["id"], part["rep"], part["lo"], part["hi"], part["n"])
            for at in range(0, len(many), 100_000):
                part = many[at : at + 100_000]
                yield put(pa.array(part["key"].copy().view(np.int64)), part["id"], part["id"], part["p"], part["p"], np.ones(len(part)))

        def put(key, *columns):
            return pa.RecordBatch.from_arrays([key, *(pa.array(c.astype(np.int64)) for c in columns)], ["key", "id", "rep", "lo", "hi", "n"])

        for batch in batches:
            for bucket, entries in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if bucket != now:
                    if held:
                        yield from solve()
                    now, held = bucket, []
                held.append(np.frombuffer(entries, _ENTRY))
        if held:
            yield from solve()

    parts = texts.select("id", "text").mapInArrow(packed, "bucket bigint, entries binary")
    return parts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(met, "key bigint, id bigint, rep bigint, lo bigint, hi bigint, n bigint")


def distinct(x: np.ndarray) -> np.ndarray:
    """The different values in order; sorting is many times faster than the library's hashing."""
    x = np.sort(x)
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


def alike(contexts: list[np.ndarray], repeats: np.ndarray, least: int) -> np.ndarray:
    """(i, j): whether context i may hold a passage of j; False only where it ``repeats`` shingles and none of its windows of SIMILAR * ``least`` has that share of its different shingles in j.

    A window that has the shingles of a longer one, or of a shorter one of the same
    start, needs no trial. Where still too many are left, all is possible.
    """
    need, size = int(np.ceil(SIMILAR * least)), np.array([len(c) for c in contexts])
    edge = np.append(0, np.cumsum(size))
    value = np.unique(np.concatenate(contexts), return_inverse=True)[1]
    held = distinct(value * np.int64(len(contexts)) + np.repeat(np.arange(len(contexts)), size))
    holders, begin = held % len(contexts), np.searchsorted(held // len(contexts), np.arange(len(value) + 1))
    out = np.ones((len(contexts), len(contexts)), bool)
    for i in np.flatnonzero(repeats):
        c, n = value[edge[i] : edge[i + 1]], size[i]
        if n < need:
            out[i] = False
            continue
        order = np.argsort(c, kind="stable")
        same = c[order[1:]] == c[order[:-1]]
        before, after = np.full(n, -1), np.full(n + 1, n)  # the place of the same shingle, after[s] that of place s - 1
        before[order[1:][same]], after[order[:-1][same] + 1] = order[:-1][same], order[1:][same]
        after[0] = n
        at, to = np.arange(n - need + 1)[:, None], np.arange(n)
        new = (before < at) & (to >= at)
        s, e = np.nonzero((to >= at + need - 1) & (new | (to == at + need - 1)) & (after[: n - need + 1, None] > to))
        if len(s) > 8 * n:
            continue
        windows = (new[s] & (to <= e[:, None])).astype(np.float32)
        times = begin[c + 1] - begin[c]
        there = np.zeros((n, len(contexts)), np.float32)
        there[np.repeat(to, times), holders[np.arange(int(times.sum())) + np.repeat(begin[c] - np.cumsum(times) + times, times)]] = 1
        out[i] = (windows @ there >= np.float32(SIMILAR) * windows.sum(1)[:, None] - np.float32(0.1)).any(0)  # shares are multiples of 0.2, so 0.1 is for rounding
    return out


def crossing(ids: list[int], labels: list[int], contexts: list[np.ndarray], least: int):
    """Pairs (i, j), j < i, of entries of one key, by ascending id: as many verified ones as join all labels that any two verified ones join.

    Equal contexts are joined at once. Two others must share SIMILAR * ``least``
    places that span ``least``; so a shingle that only one label has is of no use,
    nor is an entry that keeps too few, and a pair must share one of the shingles
    outside the most frequent ones that alone would be too few. What ``alike`` and
    ``hopeful`` leave of these is verified, two contexts that failed not again.
    """
    need = int(np.ceil(SIMILAR * least))
    up: dict[int, int] = {}

    def root(v):
        while (u := up.get(v, v)) != v:
            up[v] = up.get(u, u)
            v = up[v]
        return v

    first: dict[bytes, int] = {}
    own, equal = [], []
    for k, c in enumerate(contexts):
        j = first.setdefault(c.tobytes(), k)
        if ids[j] == ids[k]:
            own.append(k)
            equal.append(j)
        elif (x := root(labels[k])) != (y := root(labels[j])):
            up[x] = y
            yield k, j
    size = [len(contexts[k]) for k in own]
    member, place = np.repeat(np.arange(len(own)), size), np.concatenate([np.arange(n) for n in size])
    value = np.unique(np.concatenate([contexts[k] for k in own]), return_inverse=True)[1]
    plain = np.bincount(distinct(member * np.int64(len(value)) + value) // max(len(value), 1), minlength=len(own)) == size  # no shingle twice
    joined, label = -1, np.zeros(0, np.int64)

    def classes():
        nonlocal joined, label
        if joined != len(up):  # a join adds one
            joined, label = len(up), np.unique([root(labels[k]) for k in own], return_inverse=True)[1]
        return label

    before = -1
    while len(value) != before and len(value):
        before = len(value)
        both = distinct(value * np.int64(len(own)) + classes()[member]) // len(own)  # (value, label)
        keep = np.bincount(both, minlength=int(value.max()) + 1)[value] > 1
        member, place, value = member[keep], place[keep], value[keep]
        if not len(value):
            return
        lo, hi = np.full(len(own), 1 << 40), np.full(len(own), -1)
        np.minimum.at(lo, member, place)
        np.maximum.at(hi, member, place)
        keep = ((np.bincount(member, minlength=len(own)) >= need) & (hi - lo + 1 >= least))[member]
        member, place, value = member[keep], place[keep], value[keep]
    if not len(value):
        return
    value = np.unique(value, return_inverse=True)[1]
    text = np.unique([ids[k] for k in own], return_inverse=True)[1]
    edge = np.searchsorted(member, np.arange(len(own) + 1))
    runs: dict[int, Runs] = {}
    failed: set[tuple[int, int]] = set()
    left = np.flatnonzero(edge[1:] > edge[:-1])
    some, which = np.unique([equal[i] for i in left], return_inverse=True)
    may, same = None, np.zeros(len(own), np.int64)
    if not plain[left].all() and 3 < len(some) <= 1 << 13:
        same[left] = which
        repeats = np.zeros(len(some), bool)
        repeats[which] = ~plain[left]
        may = alike([contexts[k] for k in some], repeats, least)
        may &= may.T
    for i, j, sure in hopeful(member, place, value, plain, classes, text, least, may, same):
        k, o = own[i], own[j]
        if (x := root(labels[k])) == (y := root(labels[o])) or (pair := (equal[i], equal[j])) in failed:
            continue
        if not sure:
            a, b = slice(edge[i], edge[i + 1]), slice(edge[j], edge[j + 1])
            shared = place[a][np.isin(value[a], value[b])]
            if len(shared) < need or int(shared.max()) - int(shared.min()) + 1 < least:
                continue
        for m in pair:
            if m not in runs:
                runs[m] = Runs(contexts[m])
        if passages(runs[pair[0]], runs[pair[1]], least):
            up[x] = y
            yield k, o
        else:
            failed.add(pair)


def hopeful(member: np.ndarray, place: np.ndarray, value: np.ndarray, plain: np.ndarray, classes, text: np.ndarray, least: int, may: np.ndarray | None, same: np.ndarray):
    """(i, j, sure), j < i: all pairs of members of two labels and texts in which ``passages`` can find something, ascending.

    ``member`` ascends, then ``place``; of values, those that can be shared. ``text``
    is that of each member, ``classes()`` gives their labels as joined so far. Where
    both are ``plain`` (no shingle stands twice, shared or not) and the shared ones
    stand in one order, a pair is sure: two shared places of i at ``least`` - 1 apart
    or more hold k shared ones of n and m, and k >= SIMILAR * (n + m - k). ``may``
    tells it of the contexts that members are the ``same`` as, if it is known.
    """
    need, n, most = int(np.ceil(SIMILAR * least)), len(text), int(value.max()) + 1
    edge, wide = np.searchsorted(member, np.arange(n + 1)), int(place.max()) + 1
    held = distinct(value * np.int64(n) + member)
    holders, held = held % n, held // n
    begin = np.searchsorted(held, np.arange(most + 1))
    often = np.diff(begin)
    # the places of each member, those of the most frequent values first, until they are as many and as wide as a passage
    order = np.lexsort((value, -often[value], member))
    rank = np.arange(len(order)) - edge[member]
    low, high = np.full((n, wide), wide, np.int32), np.full((n, wide), -1, np.int32)
    low[member, rank] = high[member, rank] = place[order]
    low, high = np.minimum.accumulate(low, 1), np.maximum.accumulate(high, 1)
    rare = order[(rank >= need - 1) & (high - low + 1 >= least)[member, rank]]
    rare = rare[np.unique(member[rare] * np.int64(most) + value[rare], return_index=True)[1]]  # a value of a member once
    upto = np.r_[0, np.cumsum(often[value[rare]])]
    of = np.searchsorted(member[rare], np.arange(n + 1))
    narrow = place.astype(np.int32)
    there = np.bincount(member[rare], minlength=n) > 0, np.diff(edge) > 0
    at = 0
    while at < n:  # members by bounded numbers of pairs
        to = min(at + max(1, 4 * MATCHES // max(most, n)), n)
        label = classes()
        if 8 * (upto[of[to]] - upto[of[at]]) < (to - at) * n:
            some = rare[of[at] : of[to]]
            times = often[value[some]]
            i = np.repeat(member[some], times)
            j = holders[np.arange(len(i)) + np.repeat(begin[value[some]] - np.cumsum(times) + times, times)]
            keep = (j < i) & (label[i] != label[j]) & (text[i] != text[j])
            pairs = distinct(i[keep] * np.int64(n) + j[keep])
        else:  # such values are so frequent that all pairs are fewer
            pairs = np.flatnonzero((label[at:to, None] != label) & (text[at:to, None] != text) & np.tri(to - at, n, at - 1, bool)) + at * n
            pairs = pairs[there[0][pairs // n] & there[1][pairs % n]]
        if may is not None:
            pairs = pairs[may[same[pairs // n], same[pairs % n]]]
        where = np.full((to - at) * most, -1, np.int32)
        part = slice(edge[at], edge[to])
        where[(member[part] - at) * most + value[part]] = place[part]
        step = max(1, MATCHES // wide // 4)
        while len(pairs):
            i, j = pairs[:step] // n, pairs[:step] % n
            times = edge[j + 1] - edge[j]
            k = np.arange(int(times.sum())) + np.repeat(edge[j] - np.cumsum(times) + times, times)
            p = where[np.repeat((i - at) * most, times) + value[k]]
            hit = np.flatnonzero(p >= 0)
            seg, p, q = np.repeat(np.arange(len(i)), times)[hit], p[hit], narrow[k[hit]]
            count = np.bincount(seg, minlength=len(i))
            back = np.r_[False, (seg[1:] == seg[:-1]) & (p[1:] <= p[:-1])]
            sure = plain[i] & plain[j] & (np.bincount(seg, back, len(i)) == 0)
            nth = (np.arange(len(seg)) - np.repeat(np.cumsum(count) - count, count)).astype(np.float32)
            score = np.float32(1 + SIMILAR) * nth - np.float32(SIMILAR) * (p + q).astype(np.float32)  # all are multiples of 0.2, so 0.1 is for rounding
            lowest = np.full((len(i), wide), np.inf, np.float32)
            spot = seg * wide + p
            lowest.ravel()[spot] = score
            lowest = np.minimum.accumulate(lowest, 1).ravel()
            good = (p >= least - 1) & (score + np.float32(1 - SIMILAR + 0.1) >= lowest[np.maximum(spot - least + 1, 0)])
            fine = ~sure | (np.bincount(seg, good, len(i)) > 0)
            yield from zip(i[fine].tolist(), j[fine].tolist(), sure[fine].tolist())
            pairs, old, label = pairs[step:], label, classes()
            if label is not old:
                pairs = pairs[label[pairs // n] != label[pairs % n]]
        at = to


def untried(entries: DataFrame, found: DataFrame, roots: DataFrame, texts: DataFrame, least: int) -> DataFrame:
    """(id, rep, lo, hi, n): more pairs of texts that share a signature, where ``found`` neither joins them nor covers the place.

    An entry is labelled with the class of its text, or if its place is in no
    passage with a label of its own. Entries of a key with several labels are
    compared by the shingles around them (``crossing``).
    """
    width = run_length(least)
    ways = found.select("id", "start_word", "end_word").union(found.select("rep", "rep_start_word", "rep_end_word"))
    ways = ways.distinct().groupBy("id").agg(F.collect_list("start_word").alias("starts"), F.collect_list("end_word").alias("ends"))
    by_id = entries.groupBy("id").agg(F.collect_list("key").alias("keys"), F.collect_list("lo").alias("places"))
    by_id = by_id.join(ways, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")

    def label():
        def step(cols):
            out = [[], [], [], []]
            for i, keys, places, starts, ends, root in zip(*(cols[k] for k in ("id", "keys", "places", "starts", "ends", "root"))):
                p = np.array(places, np.int64)
                covered = np.zeros(len(p), bool)
                for a, b in zip(starts or (), ends or ()):
                    covered |= (a <= p) & (p + width + WORDS - 1 <= b)
                for key, at, c in zip(keys, places, covered.tolist()):
                    out[0].append(key)
                    out[1].append(i)
                    out[2].append(at)
                    out[3].append(root if c else signed(xxhash.xxh64_intdigest(f"{i} {at}", 3)))
            return out

        return step

    labelled = cut(map_rows(by_id, "key bigint, id bigint, p bigint, label bigint", label))
    open_keys = labelled.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.min("id").alias("c"), F.max("id").alias("d")).where("a != b and c != d").select("key")
    left = labelled.join(open_keys, "key", "left_semi").groupBy("id").agg(*(F.collect_list(c).alias(c + "s") for c in ("key", "p", "label")))

    def context():
        shingles = Shingles()

        def step(cols):
            out = [[], [], [], [], []]
            for i, text, keys, places, labels in zip(*(cols[k] for k in ("id", "text", "keys", "ps", "labels"))):
                h = shingles.of(text)
                for key, at, name in zip(keys, places, labels):
                    for c, x in zip(out, (key, i, at, name, h[max(0, at - least) : at + 2 * width + least].tobytes())):
                        c.append(x)
            return out

        return step

    contexts = map_rows(left.join(texts.select("id", "text"), "id"), "key bigint, id bigint, p bigint, label bigint, context binary", context)

    def met(batches):
        now, held = None, []

        def solve():
            ids, places, labels, raw = (list(x) for x in zip(*held))
            pairs = [(ids[i], ids[j], places[i]) for i, j in crossing(ids, labels, [np.frombuffer(x, np.uint64) for x in raw], least)] if len(held) > 1 else []
            if pairs:
                i, j, p = (pa.array(x, pa.int64()) for x in zip(*pairs))
                yield pa.RecordBatch.from_arrays([i, j, p], ["id", "rep", "p"])

        for batch in batches:
            for key, *row in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if key != now:
                    if held:
                        yield from solve()
                    now, held = key, []
                held.append(row)
        if held:
            yield from solve()

    pairs = contexts.repartition("key").sortWithinPartitions("key", "id", "p").mapInArrow(met, "id bigint, rep bigint, p bigint")
    return pairs.groupBy("id", "rep").agg(F.min("p").alias("lo"), F.max("p").alias("hi"), F.count("*").alias("n"))


class Runs:
    """Shingles of a text, equal ones in a row as one: values, where each begins and ends, and the places by value."""

    def __init__(self, shingles: np.ndarray):
        new = np.ones(len(shingles), bool)
        np.not_equal(shingles[1:], shingles[:-1], out=new[1:])
        self.begin = np.flatnonzero(new)
        self.values = shingles if len(self.begin) == len(shingles) else shingles[self.begin]
        self.end = np.append(self.begin[1:], len(shingles))[: len(self.begin)]

    @cached_property
    def order(self) -> np.ndarray:
        return np.argsort(self.values, kind="stable")

    @cached_property
    def sorted(self) -> np.ndarray:
        return self.values[self.order]

    @cached_property
    def distinct(self) -> bool:
        return not (self.sorted[1:] == self.sorted[:-1]).any()


def diagonal_runs(one: Runs, other: Runs, least: int) -> np.ndarray:
    """(shift, start, end) of all maximal runs a[start:end] == b[start + shift : end + shift], every place of a value counted; none if fewer than SIMILAR * ``least`` shingles of ``one`` are in ``other``."""
    a, b, order = one.values, other.values, other.order
    none = np.zeros((0, 3), np.int64)
    if len(one.values) == 0 or len(other.values) == 0:
        return none
    lo = np.searchsorted(other.sorted, a)
    there = np.flatnonzero(other.sorted[np.minimum(lo, len(b) - 1)] == a)
    if (one.end[there] - one.begin[there]).sum() < SIMILAR * least:
        return none
    wide, opens, closes, at = len(a) + 1, [], [], 0
    lo = lo[there]
    n = np.ones(len(there), np.int64) if other.distinct else np.searchsorted(other.sorted, a[there], "right") - lo
    total = np.cumsum(n)
    while at < len(there):  # a bounded number of matches at a time
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + MATCHES, "right")))
        if other.distinct:
            i, j = there[at:to], order[lo[at:to]]
        else:
            part = n[at:to]
            i = np.repeat(there[at:to], part)
            j = order[np.arange(len(i)) + np.repeat(lo[at:to] - np.cumsum(part) + part, part)]
        spot = np.sort((j - i) * wide + i)  # the places of a diagonal are neighbours
        new = np.flatnonzero(spot[1:] - spot[:-1] != 1)
        opens += [spot[:1], spot[new + 1]]
        closes += [spot[new] + 1, spot[-1:] + 1]
        at = to
    begin, end = np.concatenate(opens), np.concatenate(closes)
    if len(opens) > 2:
        begin, end = np.sort(begin), np.sort(end)
        apart = begin[1:] != end[:-1]
        begin, end = begin[np.append(True, apart)], end[np.append(apart, True)]
    shift = begin // wide
    return np.stack([shift, begin - shift * wide, end - shift * wide], 1)


def longest(gain: list[int], loss: list[int]) -> list[tuple[int, int]]:
    """The maximal [i, j] with gain[i] + ... + gain[j] >= loss[i + 1] + ... + loss[j]."""
    after, sums = 0, []
    for g, x in zip(gain, loss):
        sums.append(after := after + g - x)
    best = sums[:]  # the best sum up to here or later
    for k in range(len(best) - 2, -1, -1):
        best[k] = max(best[k], best[k + 1])
    out, j = [], -1
    for i in range(len(gain)):
        start = sums[i] - gain[i]  # a run that starts at i does not pay loss[i]
        before = j
        while j + 1 < len(best) and best[j + 1] >= start:
            j += 1
        if j > before:
            out.append((i, j))
    return out


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    one, two = set(x.tolist()), set(y.tolist())
    same = len(one & two)
    return same / (len(one) + len(two) - same)


def bands(runs: np.ndarray, size: np.ndarray, width: int, enough: float):
    """(begin, end) of the runs, by shift, of every two neighbouring bands of diagonals that hold ``enough`` equal shingles."""
    band = runs[:, 0] // width
    start = np.append(0, np.flatnonzero(band[1:] != band[:-1]) + 1)
    there, total, edge = band[start].tolist(), np.add.reduceat(size, start).tolist(), [*start.tolist(), len(runs)]
    last, near = len(there) - 1, False
    for k, x in enumerate(total):
        after, near = near, k < last and there[k + 1] == there[k] + 1  # without a next band, it was taken with the one before
        if (near or not after) and x + (total[k + 1] if near else 0) >= enough:
            yield edge[k], edge[k + 1 + near]


def pieces(runs: list[list[int]]) -> list[list[int]]:
    """(shift, start, end) by place, where each place has the shift of the longest run that holds it."""
    out = sorted(runs, key=lambda x: x[1])
    if all(x[2] <= y[1] for x, y in pairwise(out)):
        return out
    lo, hi = out[0][1], max(x[2] for x in out)
    none = 1 << 40
    shift = np.full(hi - lo, none)
    for d, s, e in sorted(runs, key=lambda x: (x[2] - x[1], x[0], x[1])):
        shift[s - lo : e - lo] = d
    edge = [0, *(np.flatnonzero(shift[1:] != shift[:-1]) + 1).tolist(), hi - lo]
    return [[d, lo + s, lo + e] for s, e in pairwise(edge) if (d := int(shift[s])) != none]


def filled(parts: list[list[int]], size: int, least: int) -> list[tuple[int, int]]:
    """First and last shared place, numbered over ``parts``, of each stretch of windows that hold SIMILAR * ``least`` of them."""
    lo = max(0, parts[0][1] - least)
    total = np.zeros(max(0, min(size, parts[-1][2] + least) - lo) + 1, np.int64)
    for _, s, e in parts:
        total[s - lo + 1 : e - lo + 1] = 1
    np.cumsum(total, out=total)
    good = np.flatnonzero(total[least:] - total[:-least] >= SIMILAR * least)
    if not len(good):
        return []
    gap = np.flatnonzero(good[1:] - good[:-1] > 1)
    return list(zip(total[good[np.append(0, gap + 1)]].tolist(), (total[good[np.append(gap, -1)] + least] - 1).tolist()))


def needed(spans: list[tuple[int, int]]) -> list[int]:
    """The fewest of ``spans`` (begin, end) that cover all that they cover, by place."""
    out, end, best = [], -1, None
    for k in sorted(range(len(spans)), key=lambda k: (spans[k][0], -spans[k][1])):
        if best is not None and spans[k][0] > end:
            if spans[best][1] > end:
                out.append(best)
                end = spans[best][1]
            best = None
        if spans[k][0] > end:
            out.append(k)
            end, best = spans[k][1], None
        elif spans[k][1] > end and (best is None or spans[k][1] > spans[best][1]):
            best = k
    return out if best is None else [*out, best]


def passages(one: Runs, other: Runs, least: int) -> list[tuple[int, int, int, int, float]]:
    """Verified passages two texts share: (start, end, start there, end there, Jaccard similarity), in shingles, ends exclusive.

    The runs of equal shingles are taken by bands of near diagonals, narrow ones
    (edited copies) and wide ones (moved sentences). With k of n and m shingles
    shared, a similarity of 0.8 is k >= 4 (n - k) + 4 (m - k): the maximal stretches
    of a band that hold it, and its stretches of well filled windows, are verified
    by their sets of shingles; one that fails is cut at its widest gap and tried again.
    Of those found, as many are given as cover the places of both texts that all cover.
    All of this goes by runs: a maximal stretch begins and ends with one, and a gap
    lies between two.
    """
    runs = diagonal_runs(one, other, least)
    found: dict[tuple[int, int, int, int], float] = {}
    taken: set[tuple[int, int]] = set()
    tried: set[tuple[int, int, int, int]] = set()
    a, b, enough = one.values, other.values, SIMILAR * least
    size = one.end[runs[:, 2] - 1] - one.begin[runs[:, 1]]
    for width in (NARROW, least) if len(runs) else ():
        for name in bands(runs, size, width, enough):
            if name in taken:
                continue
            taken.add(name)
            parts = pieces(runs[name[0] : name[1]].tolist())
            gain = [e - s for _, s, e in parts]
            loss = [0, *(4 * (s - e) + 4 * max(abs(s + d - e - c + 1) - 1, 0) for (c, _, e), (d, s, _) in pairwise(parts))]
            first = list(accumulate(gain, initial=0))  # the shared places are numbered from 0
            todo = [(first[k], first[m + 1] - 1) for k, m in longest(gain, loss)]
            if len(parts) > 1:
                todo += filled(parts, len(a), least)
            while todo:
                s, e = todo.pop()
                k, m = bisect_right(first, s) - 1, bisect_right(first, e) - 1
                d, begin, _ = parts[k]
                begin += s - first[k]
                end = parts[m][1] + e - first[m] + 1
                lo, hi = begin + d, end + parts[m][0]
                if k < m:
                    lo = min(lo, min(d + s for d, s, _ in parts[k + 1 : m + 1]))
                    hi = max(hi, max(d + e for d, _, e in parts[k:m]))
                x = begin, end, lo, hi
                if x in tried:
                    continue
                tried.add(x)
                long = one.end.item(end - 1) - one.begin.item(begin)
                if long < least or min(long, other.end.item(hi - 1) - other.begin.item(lo)) < enough:
                    continue
                similar = 1.0 if end - begin == e + 1 - s == hi - lo and not any(loss[k + 1 : m + 1]) else jaccard(a[begin:end], b[lo:hi])
                if similar >= SIMILAR:
                    found[x] = similar
                else:
                    cut_at = max(range(k + 1, m + 1), key=loss.__getitem__)
                    cut_at = first[cut_at] if loss[cut_at] else s + 1
                    todo += [(s, cut_at - 1), (cut_at, e)]
    if not found:
        return []
    spans = sorted(found)
    keep = range(1) if len(spans) == 1 else sorted({*needed([x[:2] for x in spans]), *needed([x[2:] for x in spans])})
    return [(one.begin.item(p), one.end.item(q - 1), other.begin.item(r), other.end.item(t - 1), found[p, q, r, t]) for p, q, r, t in (spans[k] for k in keep)]


def substring_dedup(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """Passages of at least ``shortest`` words that (nearly, 0.8 of five-word shingles) stand in another text too.

    One row for each text, partner and passage: doc_id, start_word, end_word
    (exclusive), rep_doc_id, rep_start_word, rep_end_word, similarity, class_id.
    Equal texts count once, under their smallest id; each other id of such a text
    has one row that covers it and names that id. Texts that share passages have
    one class_id, the smallest id of all that are joined so, also where a passage
    links two of them only through a third. Null, empty and short texts have no
    passages; null ids stay null; other columns are ignored; repeats within one
    text alone are not reported. Texts are told apart by 64 bits of a hash.
    """
    least = shortest - WORDS + 1
    margin = 3 * least
    long = docs.select("doc_id", "text").where(F.length("text") >= 2 * shortest - 1).withColumn("id", F.xxhash64("text"))
    links = cut(text_links(long, least))
    pairs = cut(links.where("key is null").groupBy("id", "rep").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")))
    texts = long.groupBy("id").agg(F.first("text").alias("text"), F.min("doc_id").alias("doc_id"))

    def segment():
        def step(cols):
            parts, starts = [], []
            for t, lo, hi in zip(cols["text"], cols["lo"], cols["hi"]):
                words = t.encode("utf-8", "surrogatepass").split()
                a = max(0, lo - margin)
                parts.append(b" ".join(words[a : hi + margin + 5 * WORDS]))
                starts.append(a)
            return [cols["id"], cols["rep"], cols["doc_id"], parts, starts]

        return step

    def make():
        shingles = Shingles()

        def step(cols):
            out = []
            for i, r, doc, rep, part, start, u in zip(*(cols[k] for k in ("id", "rep", "doc_id", "rep_doc_id", "part", "start", "rep_text"))):
                for s, e, p, q, j in sorted(passages(Runs(shingles.of(part)), shingles.kept(u), least)):
                    out.append((i, r, doc, start + s, start + e + WORDS - 1, rep, p, q + WORDS - 1, j))
            return list(map(list, zip(*out))) or None

        return step

    schema = "id bigint, rep bigint, doc_id bigint, start_word bigint, end_word bigint, rep_doc_id bigint, rep_start_word bigint, rep_end_word bigint, similarity double"

    def verified(pairs):
        parts = map_rows(pairs.join(texts, "id"), "id bigint, rep bigint, doc_id bigint, part binary, start bigint", segment)
        both = parts.join(texts.select(F.col("id").alias("rep"), F.col("text").alias("rep_text"), F.col("doc_id").alias("rep_doc_id")), "rep")
        return cut(map_rows(both, schema, make))

    found = verified(pairs)
    roots = cut(components(found.select(F.col("id").alias("a"), F.col("rep").alias("b"))))
    entries = links.where("key is not null").select("key", "id", "lo")
    if not entries.isEmpty():
        more = cut(untried(entries, found, roots, texts, least).join(pairs.select("id", "rep"), ["id", "rep"], "left_anti"))
        if not more.isEmpty():
            more = verified(more)
            found = found.union(more)
            named = more.select(F.col("id").alias("node"), "rep").join(roots, "node", "left").select("rep", F.coalesce("root", "node").alias("a"))
            named = named.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("a", F.coalesce("root", "rep").alias("b"))
            joined = components(named).select(F.col("node").alias("root"), F.col("root").alias("up"))
            all_nodes = roots.union(joined.select("root", "root")).distinct()
            roots = all_nodes.join(joined, "root", "left").select("node", F.coalesce("up", "root").alias("root")).distinct()
    words = F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")).cast("bigint")  # counted before the exchange, which then carries no text
    copies = long.select("id", "doc_id", words.alias("words")).groupBy("id").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.max("words").alias("words"))
    copies = copies.where((F.col("n") > 1) & (F.col("words") >= shortest)).select(F.col("id").cast("decimal(20,0)").alias("copied"), "least", "words")
    # the key is cast, so both sides have exchanges of their own and Spark can split a text with very many copies over tasks
    same = long.select("id", "doc_id").join(copies, F.col("id").cast("decimal(20,0)") == F.col("copied")).where("doc_id != least").drop("copied").distinct()
    zero = F.lit(0).cast("bigint")
    same = same.select("id", F.col("id").alias("rep"), "doc_id", zero.alias("start_word"), F.col("words").alias("end_word"), F.col("least").alias("rep_doc_id"), zero.alias("rep_start_word"), F.col("words").alias("rep_end_word"), F.lit(1.0).alias("similarity"))
    rows = found.unionByName(same)
    named = rows.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    names = named.groupBy("root").agg(F.least(F.min("doc_id"), F.min("rep_doc_id")).alias("class_id"))
    return named.join(names, "root").drop("id", "rep", "root")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that documents share."""
    return substring_dedup(table(spark, sf_dir, "documents"))
