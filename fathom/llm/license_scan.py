"""Fuzzy search for short license notices: exact pigeonhole seeds, then bounded-error matching."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from fathom.llm.common import map_rows, table

BASE = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
NOTICES = {
    "mit": ["under the mit license", "permission is hereby granted free of charge"],
    "apache-2": ["licensed under the apache license", "apache license version 2"],
    "gpl": ["gnu general public license"],
    "lgpl": ["gnu lesser general public license"],
    "agpl": ["gnu affero general public license"],
    "mpl-2": ["mozilla public license"],
    "bsd": ["redistribution and use in source and binary forms"],
    "cc-by-nc": ["creative commons attribution noncommercial"],
    "cc-by-sa": ["creative commons attribution sharealike"],
    "proprietary": ["all rights reserved"],
}
_WORD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def edits_allowed(phrase: str) -> int:
    return max(1, len(phrase) // 12)


def seeds(phrase: bytes, k: int) -> list[tuple[int, bytes]]:
    """``phrase`` in k + 1 parts: k edits leave one of them untouched."""
    n = len(phrase)
    cuts = [n * i // (k + 1) for i in range(k + 2)]
    return [(a, phrase[a:b]) for a, b in zip(cuts, cuts[1:])]


class Scanner:
    def __init__(self, base: dict[str, str], notices: dict[str, list[str]]):
        self.base = [(label, f" {p} ".encode()) for label, p in base.items()]
        self.fuzzy = []
        for label, phrases in notices.items():
            for p in phrases:
                k, raw = edits_allowed(p), p.encode()
                self.fuzzy.append((label, len(raw), k, seeds(raw, k), regex.compile(rb"(?:" + regex.escape(raw) + rb"){e<=%d}" % k, regex.BESTMATCH)))

    def scan(self, text: str | None):
        words = (text or "").encode("utf-8", "surrogatepass").translate(_WORD).split()
        flat = b" " + b" ".join(words) + b" "
        places, found = [], set()
        spaces: list[int] = []

        def word(at: int) -> int:
            """The spaces before a place."""
            if not spaces:
                spaces.extend(np.flatnonzero(np.frombuffer(flat, np.uint8) == 32).tolist())
            return bisect_left(spaces, at)

        for label, phrase in self.base:
            at = flat.find(phrase)
            while at >= 0:
                places.append(word(at))
                found.add(label)
                at = flat.find(phrase, at + 1)
        spans = {}
        for label, n, k, parts, pattern in self.fuzzy:
            done = -1
            for start in sorted(self._starts(flat, parts)):
                lo, hi = max(0, start - k), start + n + k
                if hi <= done:
                    continue
                m = pattern.search(flat, max(lo, 0), min(hi, len(flat)))
                if m is None:
                    continue
                done = max(done, m.end())
                first = word(m.start() + (flat[m.start() : m.start() + 1] == b" ")) - 1
                last = word(m.end() - (flat[m.end() - 1 : m.end()] == b" ")) - 1
                edits = sum(m.fuzzy_counts)
                old = spans.get((label, first, last))
                spans[label, first, last] = min(edits / (k + 1), old if old is not None else 1.0)
        labels = found | {s[0] for s in spans}
        score = 1.0 if found else max((1.0 - e for e in spans.values()), default=0.0)
        return (
            len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(found)), ",".join(sorted(labels)), score,
            [f"{label}:{a}-{b}:{1 - e:.2f}" for (label, a, b), e in sorted(spans.items())],
        )

    @staticmethod
    def _starts(flat: bytes, parts):
        out = set()
        for offset, seed in parts:
            at = flat.find(seed)
            while at >= 0:
                out.add(at - offset)
                at = flat.find(seed, at + 1)
        return out


def license_scan(docs: DataFrame, base: dict[str, str] = BASE, notices: dict[str, list[str]] = NOTICES) -> DataFrame:
    """Exact base phrases and fuzzy notices of every row of ``docs`` (doc_id, text; other columns are ignored).

    ``spans``: label:first-last word:closeness of each fuzzy match. Null and empty
    texts have no words, empty labels and score 0; a row for each row, repeated
    ones and null ids too. Of equally near matches at one place the first counts.
    """

    def make():
        scanner = Scanner(base, notices)
        return lambda cols: [cols["doc_id"], *map(list, zip(*map(scanner.scan, cols["text"])))] if cols["doc_id"] else None

    return map_rows(
        docs.select("doc_id", "text"),
        "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<string>",
        make,
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses named in every document."""
    return license_scan(table(spark, sf_dir, "documents"))
