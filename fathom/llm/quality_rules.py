"""Quality rules: divergence of character classes and common words from language references."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.llm.common import cut, map_rows, table

CLASSES = 8
TOP_WORDS = 24
LANGUAGES = 64
SYMBOLS = re.compile(r"[#*$%&|<>]")
_DIVIDE = [
    re.compile(p) for p in (r"[a-z]", r"[A-Z]", r"[0-9]", r"[ \t-\r]", r"[.,;:'\"?\-()]", r"[#*$%&|<>!@^_~=+\[\]{}\\/`]", r"[^\x00-\x7F]")
]
_KIND = np.full(128, 7)
for _i, _p in enumerate(_DIVIDE[:6]):
    for _c in range(128):
        if _p.match(chr(_c)):
            _KIND[_c] = _i


def char_classes(text: str) -> np.ndarray:
    """Counts of lower, upper, digit, space, punctuation, symbol, non-ASCII and other characters."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    out = np.bincount(_KIND[raw[raw < 128]], minlength=CLASSES)
    out[6] = len(text) - int(out.sum())
    return out


def plain(word: bytes) -> bytes:
    return word.lower().strip(b".,;:!?\"'()")


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance, base 2: 0 for equal, 1 for disjoint distributions."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(d / 2, 0)))


def base_rules(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line in seen:
            dup += bool(line.strip(" \t\n\v\f\r"))
        else:
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        times, end = Counter(windows), 0
        for i, w in enumerate(windows):
            if times[w] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return n, chars, len(SYMBOLS.findall(text)), dup, repeated


def language_references(docs: DataFrame, lang_col: str = "lang", most: int | None = None) -> dict[str, tuple[np.ndarray, list[bytes], np.ndarray]]:
    """Per language: character-class counts, its TOP_WORDS most frequent words and their counts with the rest last.

    Counted over all of ``docs`` in one pass with partial counts per batch; only
    the classes and the leading words of each language reach the driver. Every
    language forms a reference, or with ``most`` those with the most words (ties:
    the first by name); null languages form none.
    """

    def make():
        def step(cols):
            count: Counter = Counter()
            for text, lang in zip(cols["text"], cols["lang"]):
                if text is None or lang is None:
                    continue
                for i, v in enumerate(char_classes(text)):
                    count[lang, b"", i] += int(v)
                words = Counter(map(plain, text.encode("utf-8", "surrogatepass").split()))
                for w, v in words.items():
                    count[lang, w, -1] += v
                    count[lang, b"", -2] += v
            return list(map(list, zip(*((a, b, c, v) for (a, b, c), v in count.items())))) or [[], [], [], []]

        return step

    parts = map_rows(docs.select("text", F.col(lang_col).alias("lang")), "lang string, word binary, slot int, n bigint", make)
    total = cut(parts.groupBy("lang", "slot", "word").agg(F.sum("n").alias("n")))

    if most is not None:
        known = [r["lang"] for r in total.where("slot = -2").orderBy(F.desc("n"), "lang").limit(most).collect()]
        total = total.where(F.col("lang").isin(known)) if known else total.limit(0)

    def leaders(frames):  # each task's own top k of each language, so the window below sorts a few rows a task
        best = None
        for f in frames:
            best = f if best is None else pd.concat([best, f])
            best = best.sort_values(["n", "word"], ascending=False).groupby("lang").head(TOP_WORDS)
        if best is not None:
            yield best

    few = total.where("slot = -1 and word != X''").select("lang", "word", "n").mapInPandas(leaders, "lang string, word binary, n bigint")
    order = Window.partitionBy("lang").orderBy(F.desc("n"), F.desc("word"))
    words = few.withColumn("r", F.row_number().over(order)).where(F.col("r") <= TOP_WORDS).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("r", "word", "n"))).alias("top"))
    rest = {(r["lang"], r["slot"]): r["n"] for r in total.where("slot != -1").collect()}
    out = {}
    for r in words.collect():
        n, lang = np.array([t["n"] for t in r["top"]], float), r["lang"]
        chars = np.array([rest.get((lang, i), 0) for i in range(CLASSES)], float)
        out[lang] = chars, [bytes(t["word"]) for t in r["top"]], np.append(n, max(rest[lang, -2] - n.sum(), 0))
    return out


class Judge:
    """Base counts and verdict of a text."""

    def __init__(self, references, max_char, max_word, min_chars, min_words):
        self.refs = [(c, {w: i for i, w in enumerate(ws)}, n) for c, ws, n in references.values()]
        self.limits = max_char, max_word, min_chars, min_words

    def __call__(self, text: str | None) -> tuple:
        max_char, max_word, min_chars, min_words = self.limits
        text = text or ""
        n, chars, symbols, dup, repeat = base_rules(text)
        char_d = word_d = None
        if self.refs and len(text) >= min_chars:
            mine = char_classes(text).astype(float)
            char_d = min(js_distance(mine, c) for c, _, _ in self.refs)
        if self.refs and n >= min_words:
            count = Counter(map(plain, text.encode("utf-8", "surrogatepass").split()))
            ds = []
            for _, at, ref in self.refs:
                mine = np.zeros(len(ref))
                for w, i in at.items():
                    mine[i] = count.get(w, 0)
                mine[-1] = n - mine.sum()
                ds.append(js_distance(mine, ref))
            word_d = min(ds)
        failed = n < 50 or 100 * repeat > 50 * n
        kept = not failed and (char_d is None or char_d <= max_char) and (word_d is None or word_d <= max_word)
        return n, chars, symbols, dup, repeat, failed, kept, char_d, word_d


def kept_only(docs: DataFrame, references: dict, max_char: float = 0.22, max_word: float = 0.36, min_chars: int = 200, min_words: int = 50) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they are."""
    judges: list[Judge] = []

    @F.pandas_udf("boolean")
    def kept(text: pd.Series) -> pd.Series:
        if not judges:
            judges.append(Judge(references, max_char, max_word, min_chars, min_words))
        return text.map(lambda t: bool(judges[0](t)[6]))

    return docs.where(kept("text"))


def quality_rules(docs: DataFrame, references: dict, *, max_char: float = 0.22, max_word: float = 0.36, min_chars: int = 200, min_words: int = 50) -> DataFrame:
    """Base counts and the divergence verdict of every row of ``docs`` (doc_id, text; other columns are ignored).

    A text is compared with every language and the nearest counts, so no language
    column is needed. Texts shorter than ``min_chars`` / ``min_words`` are not
    judged by the respective distance (it is null). Null and empty texts have no
    words and fail the base rule. Repeated rows each get their row.
    """

    def make():
        judge = Judge(references, max_char, max_word, min_chars, min_words)
        return lambda cols: [cols["doc_id"], *map(list, zip(*map(judge, cols["text"])))] if cols["doc_id"] else None

    return map_rows(
        docs.select("doc_id", "text"),
        "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, char_distance double, word_distance double",
        make,
    )


def op1_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules over all documents, against as many languages as its SQL takes; distances to six digits."""
    docs = table(spark, sf_dir, "documents")
    rows = quality_rules(docs, language_references(docs, most=LANGUAGES))
    return rows.withColumns({c: F.round(c, 6) for c in ("char_distance", "word_distance")})
