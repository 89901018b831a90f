"""Quality classifier: a byte-level convolutional network in numpy.

A document's UTF-8 bytes are cut into overlapping chunks that cover all of it. Learned filters of WIDTH bytes
slide over each chunk; each filter's highest response in a chunk is kept. The mean, the maximum and the minimum of these
over the chunks, and the length, go through one small layer into one probability.

Learning is bounded by documented parameters: about `per_label` labelled documents of each label (those of the
smallest hashes of the id), of these whole texts up to `most_bytes` a label in the same order, cut by the executors
before anything reaches the driver, a fixed number of passes from a fixed seed (twice as many over few rows). Scoring reads every byte.

Cases: null and empty texts are one chunk of padding and get a score like others; documents without a label, id or
quality 0/1 take no part in learning; an id with several labels takes part once for each; without both labels
every score is the share of label 1 (0.5 without any). Of an id's repeated rows the shortest text is learnt from. Repeated rows score alike, and an empty table stays empty.
Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, stored

WIDTH = 6
CHUNK, OVERLAP = 160, 32
FILTERS, HIDDEN = 32, 16
#: Documents of a step.
BATCH = 48
#: Chunks that are read at once.
AT_ONCE = 256


def chunks_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The chunks of all texts as rows of bytes (0 is padding), and each text's first row, with the end appended."""
    step = CHUNK - OVERLAP
    counts = [max(1, -(-(len(t) - OVERLAP) // step)) for t in texts]
    firsts = np.r_[0, np.cumsum(counts)]
    room = [(c - 1) * step + CHUNK + WIDTH - 1 for c in counts]
    flat = np.zeros(sum(room), dtype=np.uint8)
    starts, at = [], 0
    for t, c, r in zip(texts, counts, room):
        flat[at : at + len(t)] = np.frombuffer(t, dtype=np.uint8)
        starts.append(at + step * np.arange(c))
        at += r
    return np.lib.stride_tricks.sliding_window_view(flat, CHUNK + WIDTH - 1)[np.concatenate(starts)], firsts


class Network:
    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        inputs = 3 * FILTERS + 1
        self.p = {
            "w": r.normal(0, 0.35, (WIDTH, 256, FILTERS)).astype(np.float32),
            "a": r.normal(0, inputs**-0.5, (inputs, HIDDEN)).astype(np.float32),
            "a0": np.zeros(HIDDEN, np.float32),
            "v": r.normal(0, HIDDEN**-0.5, HIDDEN).astype(np.float32),
            "v0": np.zeros(1, np.float32),
        }
        self.p["w"][:, 0] = 0
        self.pairs: list[np.ndarray] | None = None

    def responses(self, x: np.ndarray) -> np.ndarray:
        """(chunks, positions, filters): sums over tables of adjacent byte pairs."""
        if self.pairs is None:
            w = self.p["w"]
            self.pairs = [(w[j][:, None] + w[j + 1][None, :]).reshape(65536, FILTERS) for j in range(0, WIDTH, 2)]
        pair = x[:, :-1].astype(np.intp) * 256 + x[:, 1:]
        out = np.take(self.pairs[0], pair[:, :CHUNK], axis=0)
        for j in range(1, WIDTH // 2):
            out += np.take(self.pairs[j], pair[:, 2 * j : CHUNK + 2 * j], axis=0)
        return out

    def pooled(self, x: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        tops, ats = [], []
        for i in range(0, len(x), AT_ONCE):
            r = self.responses(x[i : i + AT_ONCE])
            if where:
                ats.append(r.argmax(axis=1))
            tops.append(r.max(axis=1))
        return np.maximum(np.concatenate(tops), 0), np.concatenate(ats) if where else None

    def features(self, pooled: np.ndarray, firsts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        n = np.diff(firsts)[:, None]
        return np.concatenate([np.add.reduceat(pooled, firsts[:-1], axis=0) / n, np.maximum.reduceat(pooled, firsts[:-1], axis=0), np.minimum.reduceat(pooled, firsts[:-1], axis=0), np.log1p(sizes)[:, None] / 12], axis=1).astype(np.float32)

    def logits(self, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.maximum(f @ self.p["a"] + self.p["a0"], 0)
        return h @ self.p["v"] + self.p["v0"], h

    def score(self, texts: list[bytes]) -> np.ndarray:
        out, part, held = [], [], 0
        for i, t in enumerate(texts):
            part.append(t)
            held += len(t) + CHUNK
            if held >= 1 << 20 or i == len(texts) - 1:
                x, firsts = chunks_of(part)
                z, _ = self.logits(self.features(self.pooled(x)[0], firsts, np.array([len(t) for t in part])))
                out.append(1 / (1 + np.exp(-z.astype(float))))
                part, held = [], 0
        return np.concatenate(out) if out else np.empty(0)

    def gradients(self, texts: list[bytes], y: np.ndarray) -> dict[str, np.ndarray]:
        x, firsts = chunks_of(texts)
        pooled, at = self.pooled(x, where=True)
        f = self.features(pooled, firsts, np.array([len(t) for t in texts]))
        z, h = self.logits(f)
        dz = ((1 / (1 + np.exp(-z)) - y) / len(y)).astype(np.float32)
        dh = dz[:, None] * self.p["v"] * (h > 0)
        df = dh @ self.p["a"].T
        n = np.diff(firsts)
        owner = np.repeat(np.arange(len(n)), n)
        dp = df[owner, :FILTERS] / n[owner, None]
        dp += df[owner, FILTERS : 2 * FILTERS] * (pooled >= f[owner, FILTERS : 2 * FILTERS])
        dp += df[owner, 2 * FILTERS : 3 * FILTERS] * (pooled <= f[owner, 2 * FILTERS : 3 * FILTERS])
        dp *= pooled > 0
        rows, filters = np.nonzero(dp)
        dw = np.zeros_like(self.p["w"])
        for j in range(WIDTH):
            byte = x[rows, at[rows, filters] + j].astype(np.intp)
            dw[j] = np.bincount(byte * FILTERS + filters, weights=dp[rows, filters], minlength=256 * FILTERS).reshape(256, FILTERS)
        dw[:, 0] = 0
        return {"w": dw, "a": f.T @ dh, "a0": dh.sum(0), "v": h.T @ dz, "v0": dz.sum(keepdims=True)}

    def train(self, texts: list[bytes], labels: np.ndarray, passes: int = 12, batch: int = BATCH, rate: float = 0.01, seed: int = 5) -> Network:
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        steps, total = 0, passes * -(-len(texts) // batch)
        for _ in range(passes):
            order = r.permutation(len(texts))
            for i in range(0, len(order), batch):
                own = order[i : i + batch]
                g = self.gradients([texts[j] for j in own], labels[own])
                steps += 1
                now = rate * (1 - steps / (total + 1))
                for k, v in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * v
                    s[k] = 0.99 * s[k] + 0.01 * v * v
                    self.p[k] -= (now * (m[k] / (1 - 0.9**steps)) / (np.sqrt(s[k] / (1 - 0.99**steps)) + 1e-7)).astype(np.float32)
                self.p["w"][:, 0] = 0
                self.pairs = None
        return self


def as_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_label: int = 2000, passes: int = 8, least_steps: int = 640, most_bytes: int = 24 << 20) -> Network | float:
    """A network learnt from labelled documents; a constant where not both labels are there."""
    marked = labels.select(col(id_col).alias("_id"), col(label_col).alias("y")).where("_id is not null and y in (0, 1)").distinct()
    sizes = {r.y: r.n for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return float(next(iter(sizes), 0.5))
    below = F.when(F.col("y") == 1, 2**20 * min(1.0, per_label / sizes[1])).otherwise(2**20 * min(1.0, per_label / sizes[0]))
    chosen = marked.where(F.pmod(F.xxhash64("_id", F.lit(3)), F.lit(2**20)) < below)
    texts = docs.select(col(id_col).alias("_id"), F.coalesce(col(text_col), F.lit("")).alias("_t")).join(F.broadcast(chosen), "_id")
    single = texts.groupBy("_id", "y").agg(F.min(F.struct(F.octet_length("_t").alias("n"), "_t")).alias("m"))
    order = Window.partitionBy("y").orderBy(F.xxhash64("_id", F.lit(3)), "_id").rowsBetween(Window.unboundedPreceding, 0)
    upto = stored(single.select("_id", "y", "m.*"), "sample").withColumn("_upto", F.sum("n").over(order))
    got = sorted((r["_id"], int(r.y), as_bytes(r["_t"])) for r in upto.where(F.col("_upto") <= most_bytes).toLocalIterator())
    y = np.array([r[1] for r in got], dtype=np.float32)
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.5
    # the rarer label counts as much as the other one
    few = int(y.mean() < 0.5)
    extra = [r for r in got if r[1] == few] * max(0, round(max(y.mean(), 1 - y.mean()) / min(y.mean(), 1 - y.mean())) - 1)
    got += extra
    # small samples are read up to twice as often, since a pass over them has few steps
    passes = min(2 * passes, max(passes, -(-least_steps // -(-len(got) // BATCH))))
    return Network().train([r[2] for r in got], np.array([r[1] for r in got], dtype=np.float32), passes)


def score_column(model: Network | float, text: Column, spark) -> Column:
    if isinstance(model, float):
        return F.lit(model)
    shared = spark.sparkContext.broadcast(model.p)
    held: list[Network] = []

    @F.pandas_udf(T.DoubleType())
    def scored(texts: pd.Series) -> pd.Series:
        if not held:
            net = Network()
            net.p = shared.value
            held.append(net)
        return pd.Series(held[0].score([as_bytes(t) for t in texts]))

    return scored(text)
