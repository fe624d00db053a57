"""Toxicity of text restored by a noisy-channel decoder."""

from __future__ import annotations

import math
import re
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm.common import cut, map_rows, table

# What an obfuscated character may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c"}
SEPARATORS = set("-_.*~'`^#%&,:;/\\")
EDGE = " .,;:!?\"'()[]{}*#$%&|<>`~_-+"
MOST_LABELLED = 6000
CACHE = 400_000
LETTERS = 96
OTHER = "\uffff"
_SUSPECT = re.compile(f"[{re.escape(''.join([*LEET, *sorted(SEPARATORS)]))}]|(.)\\1")
_PAUSES = ".,;:?\"' "
_SPACED = re.compile(r"(?<!\S)(?:\S\s+){2,}\S(?!\S)")


class CharModel:
    """Interpolated character trigrams; letters that the counts don't hold are one class."""

    def __init__(self, counts: dict[str, int]):
        self.n = counts
        self.letters = max(2, sum(len(k) == 1 for k in counts))
        self.total = max(1, sum(v for k, v in counts.items() if len(k) == 1))
        self.memo: dict[str, float] = {}

    def log(self, context: str, c: str) -> float:
        key = context + c
        if (v := self.memo.get(key)) is None:
            get = self.n.get
            classes = "".join(OTHER if x.isalpha() and x not in self.n else x for x in key)
            context, c = classes[:-1], classes[-1]
            p = (get(c, 0) + 0.5) / (self.total + self.letters)
            for order in (1, 2):
                ctx = context[-order:]
                if len(ctx) == order and (seen := get(ctx, 0)):
                    p = (get(ctx + c, 0) + 8 * p) / (seen + 8)
            if len(self.memo) >= CACHE:
                self.memo.clear()
            v = self.memo[key] = math.log(p)
        return v

    def word(self, text: str) -> float:
        s = f"\n{text}\n"
        return sum(self.log(s[max(0, i - 2) : i], s[i]) for i in range(1, len(s)))


_RUN = re.compile(rf"([{re.escape(''.join(sorted({*LEET, *SEPARATORS, *EDGE})))}])\1*|(.)\2+", re.S)


def lattice(token: str) -> list[str | list[tuple[str, float]]]:
    """The parts of ``token``: plain text, or what a run of one character may stand for with its channel log-probability."""
    out: list[str | list[tuple[str, float]]] = []
    left, right, at = len(token) - len(token.lstrip(EDGE)), len(token.rstrip(EDGE)), 0
    for run in _RUN.finditer(token):
        if run.start() > at:
            out.append(token[at : run.start()])
        at = run.end()
        c, n = run[0][0], at - run.start()
        options = [(c * n, -0.4 if n > 2 else -0.05)] if n <= 2 else []
        reps = (1, 2) if n > 1 else (1,)
        if c.isalpha() and n > 1:
            options += [(c * r, -1.0) for r in reps if r != n]
        for a in LEET.get(c, ""):
            options += [(a * r, -1.2) for r in reps]
        if c == " ":  # between single characters: nothing or a word's end
            options = [("", -0.7), ("\n", -0.7)]
        elif c in SEPARATORS or at <= left or run.start() >= right:  # marks around a word may be leet or nothing
            options.append(("", -0.7))
        out.append(options or [(c, -0.05), (c * 2, -0.5)])
    if at < len(token):
        out.append(token[at:])
    return out


def viterbi(token: str, model: CharModel) -> str:
    """The likeliest plain form of ``token`` under channel and character model; state: the last two characters.

    Paths are chains (before, put), so a token of any length is decoded whole. Where
    one state is left, plain text adds the same to all that follows and isn't scored.
    """
    best: dict[str, tuple[float, tuple | None]] = {"\n": (0.0, None)}

    def advance(options):
        step: dict[str, tuple[float, tuple | None]] = {}
        for state, (score, path) in best.items():
            for put, cost in options:
                s, ctx = score + cost, state
                for c in put:
                    s += model.log(ctx, c)
                    ctx = (ctx + c)[-2:]
                if (old := step.get(ctx)) is None or s > old[0]:
                    step[ctx] = (s, (path, put) if put else path)
        return step

    for part in lattice(token):
        if isinstance(part, list):
            best = advance(part)
            continue
        i = 0
        while len(best) > 1 and i < len(part):
            best = advance([(part[i], 0.0)])
            i += 1
        if i < len(part):
            (state, (score, path)), *_ = best.items()
            best = {(state + part[i:])[-2:]: (score, (path, part[i:]))}
    state = max((score + model.log(state, "\n"), state) for state, (score, _) in best.items())[1] if len(best) > 1 else next(iter(best))
    out, path = [], best[state][1]
    while path:
        out.append(path[1])
        path = path[0]
    return "".join(reversed(out))


class Restorer:
    """Restores texts word by word; remembers a bounded number of decoded words."""

    def __init__(self, counts: dict[str, int]):
        self.model, self.known = CharModel(counts), {}

    def word(self, raw: str) -> str:
        if (v := self.known.get(raw)) is None:
            low = raw.lower()
            v, core = low.strip(EDGE), low.strip(_PAUSES)
            if (" " in core or _SUSPECT.search(core)) and any(c.isalpha() for c in core):
                v = viterbi(core, self.model)
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[raw] = v
        return v

    def raw_words(self, text: str | None) -> list[str]:
        """Words as they stand; single characters parted by white space stay together, parted by one space each."""
        text, out, at = text or "", [], 0
        for m in _SPACED.finditer(text):
            if any(c.isalpha() for c in m[0]):
                out += text[at : m.start()].split()
                out.append(" ".join(m[0].split()))
                at = m.end()
        out += text[at:].split()
        return out

    def words(self, text: str | None) -> list[str]:
        return [w for raw in set(self.raw_words(text)) for w in self.word(raw).split("\n") if w]

    def joins(self, pieces: list[str], i: int, whole, heads) -> str | None:
        """The word of ``whole`` that pieces from the i-th on make together, if it is likelier than they are apart."""
        text, parts = "", []
        for piece in pieces[i:]:
            piece = piece.lower()
            bare = piece.strip(EDGE)
            text += bare
            parts.append(bare)
            if len(parts) > 1 and text in whole:
                return text if self.model.word(text) > sum(map(self.model.word, parts)) - 0.7 * len(parts) else None
            if text not in heads or bare != piece:  # marks end a word
                return None
        return None


def features(word: str) -> tuple[str, str, str]:
    """A word and its beginnings of 5 and 7 characters."""
    return word, "^" + word[:5], "^" + word[:7]


class Scorer(dict):
    """Raw word -> those of its features that carry weight; a bounded number is remembered."""

    def __init__(self, counts: dict[str, int], weights: dict[str, float], bias: float):
        self.restorer, self.weights, self.bias = Restorer(counts), weights, bias
        self.whole = {f for f, w in weights.items() if w > 0 and f[0] != "^"}
        self.heads = {f[:k] for f in self.whole for k in range(2, len(f) - 1)} - self.whole

    def __missing__(self, raw: str) -> tuple[str, ...]:
        out = []
        for w in self.restorer.word(raw).split("\n"):
            if w:
                out += [f for f in features(w) if f in self.weights]
        if len(self) >= CACHE:
            self.clear()
        v = self[raw] = tuple(out)
        return v

    def score(self, text: str | None) -> float:
        raw = self.restorer.raw_words(text)
        found = set().union(*map(self.__getitem__, set(raw)))
        for i in [i for i, w in enumerate(raw) if w in self.heads]:
            if word := self.restorer.joins(raw, i, self.whole, self.heads):
                found.update(f for f in features(word) if f in self.weights)
        s = math.fsum(self.weights[f] for f in found) + self.bias
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, s))))


_LETTER = np.array([chr(i).isalpha() for i in range(1 << 16)])


def gram_counts(texts: list[str]) -> dict[str, int]:
    """Counts of 1-, 2- and 3-grams of all letters of ``texts`` in lower case; what stands between runs of letters is one newline."""
    raw = np.frombuffer("\n".join(["", *texts, ""]).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    far = np.flatnonzero(raw >= 1 << 16)
    letter = _LETTER[np.minimum(raw, (1 << 16) - 1)]
    letter[far] = [chr(c).isalpha() for c in raw[far].tolist()]
    codes = np.where(letter, raw, 10)
    codes = codes[np.r_[True, letter[1:] | letter[:-1]]]  # one newline between runs
    place = np.zeros(0x110000, np.int32)
    place[codes] = 1
    there = np.flatnonzero(place)
    place[there] = np.arange(len(there))
    at = place[codes].astype(np.int64)
    end, n, out = int(np.searchsorted(there, 10)), len(there), {}
    for k in (1, 2, 3):
        if len(at) < k:
            break
        key = np.zeros(len(at) - k + 1, np.int64)
        for j in range(k):
            key = key * n + at[j : len(at) - k + 1 + j]
        if k == 3:  # no word end within
            key = key[at[1:-1] != end]
        times = np.bincount(key, minlength=0) if n**k < 1 << 22 else None
        some, times = (np.flatnonzero(times), times[times > 0]) if times is not None else np.unique(key, return_counts=True)
        for g, v in zip(some.tolist(), times.tolist()):
            s = ""
            for _ in range(k):
                s = chr(there[g % n]) + s
                g //= n
            out[s] = out.get(s, 0) + v
    out.pop("\n\n", None)
    return out


def character_counts(docs: DataFrame, letters: int = LETTERS) -> dict[str, int]:
    """Counts of 1-, 2- and 3-grams of the letters of all of ``docs``, word ends as newlines.

    Every letter of every text counts. The ``letters`` most frequent ones stand for
    themselves and all others for one class, so at most (letters + 2) ** 3 counts
    reach the driver, whatever the texts hold.
    """

    def make():
        def step(cols):
            n = gram_counts([t or "" for t in cols["text"]])
            return [list(n), list(n.values())]

        return step

    grams = cut(map_rows(docs.select("text"), "w string, n bigint", make).groupBy("w").agg(F.sum("n").alias("n")))
    own = [r["w"] for r in grams.where("char_length(w) = 1 and w != '\n'").orderBy(F.desc("n"), "w").limit(letters).collect()]
    mark = re.escape("".join(own)).replace("/", "\\/")
    few = grams.select(F.regexp_replace("w", f"[^{mark}\n]", OTHER).alias("w"), "n").groupBy("w").agg(F.sum("n").alias("n"))
    return {r["w"]: r["n"] for r in few.collect()}


def fit(rows: list[np.ndarray], ys: list[int], names: list[str]) -> tuple[dict[str, float], float]:
    """Sparse logistic regression on the features (distinct indexes of each row) with the surest log-odds."""
    size = len(names)
    pos, neg = np.zeros(size), np.zeros(size)
    for f, y in zip(rows, ys):
        (pos if y else neg)[f] += 1
    n1, n0 = max(1, sum(ys)), max(1, len(ys) - sum(ys))
    p1, p0 = (pos + 0.5) / (n1 + 1), (neg + 0.5) / (n0 + 1)
    sure = (p1 - p0) / np.sqrt(p1 * (1 - p1) / n1 + p0 * (1 - p0) / n0)
    chosen = np.flatnonzero((sure > 3) & (pos > 4 * neg * n1 / n0) & (pos >= 3))
    w, b = np.zeros(size), -2.0
    w[chosen] = np.log(p1[chosen] / p0[chosen]) * 0.5
    good = np.zeros(size, bool)
    good[chosen] = True
    data = [(f[good[f]], y) for f, y in zip(rows, ys)]
    rng = np.random.default_rng(5)
    rate = 0.1
    for _ in range(12):
        for k in rng.permutation(len(data)):
            f, y = data[k]
            g = 1 / (1 + math.exp(-max(-30, min(30, w[f].sum() + b)))) - y
            w[f] -= rate * (g + 1e-4 * w[f])
            b -= 0.2 * rate * g
        rate *= 0.8
    return {names[k]: float(w[k]) for k in chosen.tolist()}, float(b)


_held: dict[str, object] = {}


def held(key: str, make):
    """One object for all tasks of a Python worker, so that the next task finds the words known."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def toxicity(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> DataFrame:
    """Score of every row of ``docs`` (doc_id, text; other columns are ignored).

    The character model counts all texts. The scorer is fitted on the labelled
    rows whose crc32(doc_id) mod 5 is not 0, at most ``most_labelled`` of them in
    the order of a hash of the id. Null and empty texts score as a text without
    words; texts and words of any length are decoded whole. Null ids are never
    learned from and not held out. Words cut in pieces are joined where they make
    a word of weight that is likelier than its pieces.
    """
    counts = character_counts(docs)
    sc = docs.sparkSession.sparkContext
    shared, key = sc.broadcast(counts), uuid.uuid4().hex
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))
    some = labels.where(F.col("toxic").isNotNull() & (fold != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    labelled = docs.select("doc_id", "text").join(some, "doc_id")
    sample = cut(labelled.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(most_labelled)).repartition(64)

    def learn():
        r = held(key, lambda: Restorer(shared.value))
        return lambda cols: [[sorted(set(r.words(t))) for t in cols["text"]], cols["toxic"]]

    def solve(frames):  # one task: the sample is bounded
        index: dict[str, int] = {}
        of, rows, ys = {}, [], []
        for f in frames:
            for words, y in zip(f["f"], f["y"]):
                for w in words:
                    if w not in of:
                        of[w] = [index.setdefault(x, len(index)) for x in features(w)]
                rows.append(np.unique(np.array([x for w in words for x in of[w]], np.int32)))
                ys.append(int(y))
        if rows:
            w, b = fit(rows, ys, list(index))
            yield pd.DataFrame({"name": [*w, ""], "w": [*w.values(), b]})

    rows = map_rows(sample.select("text", F.col("toxic").cast("int").alias("toxic")), "f array<string>, y int", learn)
    # the words of a bounded sample that carry weight
    fitted = {r["name"]: r["w"] for r in rows.repartition(1).sortWithinPartitions("y", "f").mapInPandas(solve, "name string, w double").collect()}
    bias = fitted.pop("", 0.0)
    model = sc.broadcast((fitted, bias))

    def make():
        scorer = held(key + "s", lambda: Scorer(shared.value, *model.value))

        def step(cols):
            s = list(map(scorer.score, cols["text"]))
            return [cols["doc_id"], cols["held_out"], s, [int(x >= 0.5) for x in s]]

        return step

    return map_rows(docs.select("doc_id", "text", F.coalesce(fold == 0, F.lit(False)).alias("held_out")), "doc_id bigint, held_out boolean, score double, predicted int", make)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score of every document, learned from the labels outside the held-out fifth."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
