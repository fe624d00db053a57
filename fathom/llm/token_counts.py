"""Token counts by heap-and-linked-list byte-pair merging; no identifiers are emitted."""

from __future__ import annotations

import heapq
import json

import regex
from pyspark.sql import DataFrame, SparkSession

from fathom.llm.common import map_rows, table

# The vocabulary's published pre-tokenizer pattern, and Unicode White_Space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = r"\t-\r \x85\xa0  -     　"
CACHE = 400_000


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(keep) else chr(next(spare)) for b in range(256)]


class Counter:
    """Counts tokens of texts; holds a bounded memory of pieces already merged."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        merges = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
        self.symbols = byte_symbols()
        self.rank = {(a, b): (i, a + b) for i, (a, b) in enumerate(merges)}
        specials = [t["content"] for t in data["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.marks = specials
        own = PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[^{SPACE}\p{{L}}\p{{N}}]").replace(r"(?!\S)", rf"(?![^{SPACE}])").replace(r"|\s+", rf"|[{SPACE}]+")
        self.split = regex.compile(own)
        self.odd = regex.compile(rf"[{SPACE}] ")
        self.pieces: dict[str, int] = {}
        self.chunks: dict[str, int] = {}

    def merged(self, piece: str) -> int:
        """Initial symbols minus merges, popping the lowest-ranked, leftmost adjacent pair until none is left."""
        part = [self.symbols[b] for b in piece.encode("utf-8")]
        n = count = len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, heap = self.rank, []
        for i in range(n - 1):
            if (r := rank.get((part[i], part[i + 1]))) is not None:
                heap.append((r[0], i, part[i], part[i + 1]))
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if part[i] is not None else n
            if j >= n or part[i] != a or part[j] != b:
                continue
            part[i], part[j] = a + b, None
            after[i] = k = after[j]
            count -= 1
            if k < n:
                before[k] = i
                if (r2 := rank.get((part[i], part[k]))) is not None:
                    heapq.heappush(heap, (r2[0], i, part[i], part[k]))
            if (h := before[i]) >= 0 and (r2 := rank.get((part[h], part[i]))) is not None:
                heapq.heappush(heap, (r2[0], h, part[h], part[i]))
        return count

    def chunk(self, text: str) -> int:
        total = 0
        for piece in self.split.findall(text):
            if (n := self.pieces.get(piece)) is None:
                n = self.merged(piece)
                if len(piece) <= 64:
                    if len(self.pieces) >= CACHE:
                        self.pieces.clear()
                    self.pieces[piece] = n
            total += n
        return total

    def plain(self, text: str) -> int:
        if self.odd.search(text):  # a run of spaces is split by what follows it: take the text whole
            return self.chunk(text)
        first, *rest = text.split(" ")
        total, known = self.chunk(first), self.chunks
        for word in rest:
            if (n := known.get(word)) is None:
                n = self.chunk(" " + word)
                if len(word) <= 64:
                    if len(known) >= CACHE:
                        known.clear()
                    known[word] = n
            total += n
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or not any(m in text for m in self.marks):
            return self.plain(text)
        parts = self.special.split(text)
        return sum(map(self.plain, parts)) + len(parts) - 1


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """UTF-8 bytes and tokens of every row of ``docs`` (doc_id, text; other columns are ignored).

    ``path``: a byte-level BPE .json present on every executor. Null and empty
    texts have 0 bytes and tokens; a piece of any length is merged whole. Of equal
    ranks the leftmost pair goes first. Repeated rows and null ids each get their row.
    """

    def make():
        counter = Counter(path)

        def step(cols):
            texts = [t or "" for t in cols["text"]]
            counts = list(map(counter.count, texts))
            return [cols["doc_id"], [len(t.encode("utf-8", "surrogatepass")) for t in texts], counts, [c > limit for c in counts]]

        return step

    return map_rows(docs.select("doc_id", "text"), "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean", make)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
