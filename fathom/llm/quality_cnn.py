"""Quality classifier: a byte-level convolutional network in numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm.common import cut, map_rows, table

EMBED, WIDTH, STRIDE, FILTERS = 6, 10, 2, 24
CHUNK, STEP = 512, 256
MOST_LABELLED = 1500
EPOCHS = 5


def chunks(text: str | None) -> np.ndarray:
    """The whole text's bytes in overlapping chunks of CHUNK bytes, STEP apart, padded with zeros."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, -(-max(0, len(raw) - CHUNK) // STEP) + 1)
    flat = np.zeros((n - 1) * STEP + CHUNK, np.uint8)
    flat[: len(raw)] = raw
    return np.lib.stride_tricks.sliding_window_view(flat, CHUNK)[::STEP]


class Network:
    """embedding -> filters -> ReLU -> max over all places, and max over chunks of a chunk's mean -> logistic."""

    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        self.p = {
            "e": r.normal(0, 0.5, (256, EMBED)), "w": r.normal(0, 1 / np.sqrt(EMBED * WIDTH), (EMBED * WIDTH, FILTERS)), "c": np.zeros(FILTERS),
            "v": r.normal(0, 0.3, 2 * FILTERS), "b": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.p["e"][0] = 0

    def forward(self, x: np.ndarray):
        """Bytes at each place, whether it is text, its embedding, and the responses, of chunks (n, CHUNK)."""
        p = self.p
        at = np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=1)[:, ::STRIDE]  # n, places, width
        live = at[:, :, 0] != 0
        live[:, 0] = True
        col = p["e"][at].reshape(*at.shape[:2], -1)
        z = col @ p["w"] + p["c"]
        np.maximum(z, 0, out=z)
        if not live.all():
            z *= live[:, :, None]
        return at, live, col, z

    def pooled(self, x: np.ndarray):
        """The largest response of each filter, its bytes, the largest mean of a chunk, and that chunk."""
        every, best, seen = np.arange(FILTERS), np.full(FILTERS, -1, np.float32), np.zeros((FILTERS, WIDTH), np.uint8)
        mean, where = best.copy(), np.zeros(FILTERS, np.int64)
        for i in range(0, len(x), 64):
            at, live, _, z = self.forward(x[i : i + 64])
            flat = z.reshape(-1, FILTERS)
            arg = flat.argmax(0)
            more = flat[arg, every] > best
            best[more], seen[more] = flat[arg, every][more], at.reshape(-1, WIDTH)[arg[more]]
            m = z.sum(1) / live.sum(1, keepdims=True, dtype=np.float32)
            arg = m.argmax(0)
            more = m[arg, every] > mean
            mean[more], where[more] = m[arg, every][more], i + arg[more]
        return best, seen, mean, where

    def logit(self, best: np.ndarray, mean: np.ndarray) -> float:
        return float(np.clip(best @ self.p["v"][:FILTERS] + mean @ self.p["v"][FILTERS:] + self.p["b"][0], -30, 30))

    def score(self, text: str | None) -> float:
        best, _, mean, _ = self.pooled(chunks(text))
        return float(1 / (1 + np.exp(-self.logit(best, mean))))

    def gradients(self, texts: list[str | None], ys: list[int]) -> dict[str, np.ndarray]:
        p = self.p
        g = {k: np.zeros_like(v) for k, v in p.items()}
        for text, y in zip(texts, ys):
            x = chunks(text)
            best, seen, mean, where = self.pooled(x)
            s = 1 / (1 + np.exp(-self.logit(best, mean))) - y
            g["v"] += s * np.concatenate([best, mean])
            g["b"] += s
            dz = s * p["v"][:FILTERS] * (best > 0)  # only the places that won take part
            g["c"] += dz
            g["w"] += p["e"][seen].reshape(FILTERS, -1).T * dz
            np.add.at(g["e"], seen.reshape(-1), (p["w"].T * dz[:, None]).reshape(-1, EMBED))
            rows, back = np.unique(where, return_inverse=True)  # and the chunks that won
            at, live, col, z = self.forward(x[rows])
            d = np.zeros((len(rows), FILTERS), np.float32)
            d[back, np.arange(FILTERS)] = s * p["v"][FILTERS:]
            flat = ((d / live.sum(1, keepdims=True))[:, None, :] * (z > 0)).reshape(-1, FILTERS).astype(np.float32)
            g["c"] += flat.sum(0)
            g["w"] += col.reshape(-1, EMBED * WIDTH).T @ flat
            de = (flat @ p["w"].T).reshape(-1, EMBED)
            for k in range(EMBED):
                g["e"][:, k] += np.bincount(at.reshape(-1), de[:, k], 256).astype(np.float32)
        g["e"][0] = 0
        return {k: v / len(ys) for k, v in g.items()}

    def fit(self, texts, ys, epochs: int = EPOCHS, batch: int = 16, rate: float = 0.01) -> Network:
        r = np.random.default_rng(3)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        t = 0
        for epoch in range(epochs):
            order = r.permutation(len(ys))
            for i in range(0, len(order), batch):
                pick = order[i : i + batch]
                t += 1
                for k, g in self.gradients([texts[j] for j in pick], [ys[j] for j in pick]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.999 * s[k] + 0.001 * g * g
                    self.p[k] -= (rate * 0.85**epoch) * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
        return self


def quality_cnn(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> DataFrame:
    """Score of every row of ``docs`` (doc_id, text; other columns are ignored).

    The network is fitted on whole texts of labelled rows whose crc32(doc_id) mod 3
    is not 1: at most ``most_labelled``, in the order of a hash of the id. Null and
    empty texts score as one empty chunk, very long ones chunk by chunk in bounded
    memory. Repeated rows each get their score. Null ids are never learned from and
    not held out; an empty table of labels leaves the network as it began.
    """
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3))
    some = labels.where(F.col("quality").isNotNull() & (fold != 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    rows = cut(docs.select("text", "doc_id").join(some, "doc_id")).orderBy("doc_id", "text").limit(most_labelled)

    def fit(frames):  # one task, on one core: the sample is bounded
        pdf = pd.concat([f for f in frames if len(f)] or [pd.DataFrame({"text": [], "quality": []})])
        net = Network()
        if len(pdf):
            net.fit(pdf["text"].tolist(), pdf["quality"].astype(int).tolist())
        yield pd.DataFrame({"name": list(net.p), "raw": [v.tobytes() for v in net.p.values()]})

    fitted = {r["name"]: r["raw"] for r in rows.select("text", "quality").coalesce(1).mapInPandas(fit, "name string, raw binary").collect()}
    net = Network()
    if fitted:
        net.p = {k: np.frombuffer(fitted[k], np.float32).reshape(v.shape) for k, v in net.p.items()}
    shared = docs.sparkSession.sparkContext.broadcast(net.p)

    def make():
        own = Network()
        own.p = shared.value

        def step(cols):
            s = list(map(own.score, cols["text"]))
            return [cols["doc_id"], cols["held_out"], s, [int(x >= 0.5) for x in s]]

        return step

    return map_rows(docs.select("doc_id", "text", F.coalesce(fold == 1, F.lit(False)).alias("held_out")), "doc_id bigint, held_out boolean, score double, predicted int", make)


def op3_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score of every document, learned from the labels outside the held-out third."""
    return quality_cnn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
