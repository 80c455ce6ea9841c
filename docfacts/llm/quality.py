"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of 64 words, over its whole text. A passage is described by its share of character
classes, word shapes, repetition and variety, and the share of its words in each of `WORD_BUCKETS` buckets of a hash; an encoder maps that to a representation, h = tanh(W x + b). Gated attention,
a = softmax(w . (tanh(V h) * sigmoid(U h))), weighs the passages, and the weighted representation is scored by a logistic
unit. Encoder, attention and scorer are learned together from document labels alone, by Adam.

The model is fitted on at most `most_documents` labelled documents (those with the smallest hash of their id), of which
the features of all passages reach the driver. Scoring uses all passages of
all documents, in one pass without shuffle. Labels, lang, source and doc_id are never inputs.

Nulls: a null text is empty; a text without words is one passage of zeros, and is scored. Null or unmatched labels teach
nothing; without labelled documents every score is 0.5. Repeated rows are scored each. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docfacts.llm.common import documents, fold_of, read_table

PASSAGE_WORDS = 64
MOST_WORDS = 150_000  # that a worker remembers
#: Bytes of each class; all other bytes are one more.
CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", bytes(range(128, 256)), b".,;:", b"!?", b"#$%&*@^~", b"|<>[]{}\\/=+_", b"\"'()-"]
WORD_FEATURES = len(CLASSES) + 4
WORD_BUCKETS = 32
FEATURES = WORD_FEATURES + 4 + WORD_BUCKETS
MARKS = b"".join(CLASSES[4:])
CLASS_OF = np.full(256, len(CLASSES), np.int64)
for _i, _c in enumerate(CLASSES):
    CLASS_OF[list(_c)] = _i


class WordFeatures(dict):
    """Index of each word; features of new words are computed together."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []
        self.table = np.zeros((0, WORD_FEATURES), np.float32)
        self.bucket = np.zeros(0, np.int64)

    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self)
        self.new.append(word)
        return i

    def update_table(self) -> np.ndarray:
        """Per word: bytes of each class, length, and whether it is all upper-case, ends in two marks, has no letter."""
        if self.new:
            lengths = np.array([len(w) for w in self.new])
            word = np.repeat(np.arange(len(self.new)), lengths)
            kind = CLASS_OF[np.frombuffer(b"".join(self.new), np.uint8)]
            counts = np.bincount(word * (len(CLASSES) + 1) + kind, minlength=len(self.new) * (len(CLASSES) + 1)).reshape(len(self.new), -1)
            letters = counts[:, 0] + counts[:, 1] + counts[:, 3]
            ends = np.array([w[-2:-1] == w[-1:] and not w[-1:].isalnum() for w in self.new])
            own = np.column_stack([counts[:, : len(CLASSES)], lengths, (counts[:, 1] > 1) & (counts[:, 0] == 0), ends, letters == 0])
            self.table = np.concatenate([self.table, own.astype(np.float32)])
            buckets = [xxhash.xxh32_intdigest(w.lower().strip(MARKS)) % WORD_BUCKETS for w in self.new]
            self.bucket = np.concatenate([self.bucket, np.array(buckets, np.int64)])
            self.new.clear()
        return self.table


def passages(texts: list[str], words: WordFeatures) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, number of passages of each text)."""
    split = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    lengths = np.array([len(s) for s in split])
    index = np.fromiter((i for s in split for i in map(words.__getitem__, s)), np.int64, int(lengths.sum()))
    table = words.update_table()
    bags = np.maximum(-(-lengths // PASSAGE_WORDS), 1)
    first_bag = np.cumsum(bags) - bags
    offset = np.arange(len(index)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    bag = np.repeat(first_bag, lengths) + offset // PASSAGE_WORDS
    total = int(bags.sum())
    out = np.zeros((total, FEATURES))
    if len(index):
        starts = np.concatenate([[0], np.nonzero(np.diff(bag))[0] + 1])
        present, n = bag[starts], np.diff([*starts, len(index)])
        sums = np.add.reduceat(table[index], starts, axis=0)
        size = np.maximum(sums[:, len(CLASSES)], 1)
        repeated = np.concatenate([[False], (index[1:] == index[:-1]) & (bag[1:] == bag[:-1])])
        distinct = np.bincount(np.unique(bag * (len(table) + 1) + index) // (len(table) + 1), minlength=total)[present]
        out[present, : len(CLASSES)] = sums[:, : len(CLASSES)] / size[:, None]
        out[present, len(CLASSES)] = size / n / 10
        out[present, len(CLASSES) + 1 : WORD_FEATURES] = sums[:, len(CLASSES) + 1 :] / n[:, None]
        out[present, WORD_FEATURES] = np.add.reduceat(repeated.astype(float), starts) / n
        out[present, WORD_FEATURES + 1] = distinct / n
        out[present, WORD_FEATURES + 2] = np.log1p(n) / np.log1p(PASSAGE_WORDS)
        out[present, WORD_FEATURES + 3] = 1
        spread = np.bincount(bag * WORD_BUCKETS + words.bucket[index], minlength=total * WORD_BUCKETS).reshape(total, WORD_BUCKETS)
        out[present, WORD_FEATURES + 4 :] = spread[present] / n[:, None]
    return out, bags


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class AttentionModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, bags: np.ndarray) -> dict[str, np.ndarray]:
        p, starts = self.weights, np.cumsum(bags) - bags
        of = np.repeat(np.arange(len(bags)), bags)
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
        e = (t * g) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, starts)[of])
        a = e / np.add.reduceat(e, starts)[of]
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "of": of, "starts": starts, "y": sigmoid(z @ p["c"] + p["d"])}

    def score(self, x: np.ndarray, bags: np.ndarray) -> np.ndarray:
        return self.forward((x - self.mean) / self.scale, bags)["y"]

    def gradients(self, x: np.ndarray, bags: np.ndarray, y: np.ndarray, decay: float) -> dict[str, np.ndarray]:
        p, f = self.weights, self.forward(x, bags)
        err = (f["y"] - y) / len(y)
        dz = np.outer(err, p["c"])[f["of"]]
        da = (dz * f["h"]).sum(1)
        de = f["a"] * (da - np.add.reduceat(f["a"] * da, f["starts"])[f["of"]])
        dt, dg = np.outer(de, p["w"]) * f["g"] * (1 - f["t"] ** 2), np.outer(de, p["w"]) * f["t"] * f["g"] * (1 - f["g"])
        dh = (f["a"][:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
        g = {"W": x.T @ dh, "b": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ err, "d": np.array(err.sum())}
        return {k: v + decay * p[k] for k, v in g.items()}


def train(x: np.ndarray, bags: np.ndarray, y: np.ndarray, width: int = 12, gate: int = 8, steps: int = 300, rate: float = 0.02, decay: float = 1e-4, seed: int = 1) -> AttentionModel:
    rng = np.random.default_rng(seed)
    shape = {"W": (x.shape[1], width), "b": (width,), "V": (width, gate), "U": (width, gate), "w": (gate,), "c": (width,), "d": ()}
    model = AttentionModel(x.mean(0), x.std(0) + 1e-3, {k: rng.normal(0, 0.3, s) if s else np.array(0.0) for k, s in shape.items()})
    model.weights["b"] *= 0
    x = (x - model.mean) / model.scale
    m = {k: np.zeros(s) for k, s in shape.items()}
    v = {k: np.zeros(s) for k, s in shape.items()}
    for step in range(1, steps + 1):
        for k, g in model.gradients(x, bags, y, decay).items():
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            model.weights[k] = model.weights[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def passage_batches(batches: Iterator[pa.RecordBatch], use: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = WordFeatures()
    for whole in batches:
        for lo in range(0, whole.num_rows, 500):  # bounds the arrays
            b = whole.slice(lo, 500)
            if len(words) > MOST_WORDS:
                words = WordFeatures()
            yield use(b, *passages([t or "" for t in b.column("text").to_pylist()], words))


def fit(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most_documents: int = 4000) -> AttentionModel | None:
    """learn: which doc_ids may teach."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).where(F.col("y").isin(0.0, 1.0) & learn)
    chosen = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_documents)
    rows = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text")

    def use(b: pa.RecordBatch, x: np.ndarray, bags: np.ndarray) -> pa.RecordBatch:
        parts = np.split(x, np.cumsum(bags)[:-1])
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array([p.astype("<f4").tobytes() for p in parts], pa.binary())], ["doc_id", "y", "x"])

    got = rows.mapInArrow(lambda batches: passage_batches(batches, use), "doc_id long, y double, x binary").toPandas().sort_values(["doc_id", "x"])
    if got.empty:
        return None
    parts = [np.frombuffer(x, "<f4").reshape(-1, FEATURES).astype(float) for x in got["x"]]
    return train(np.concatenate(parts), np.array([len(p) for p in parts]), got["y"].to_numpy())


def score_quality(docs: DataFrame, model: AttentionModel | None, *keep: str) -> DataFrame:
    """`keep` columns and score of every row of docs (which has a text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = list(keep)

    def use(b: pa.RecordBatch, x: np.ndarray, bags: np.ndarray) -> pa.RecordBatch:
        score = shared.value.score(x, bags) if shared.value else np.full(len(bags), 0.5)
        return pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(score)], [*kept, "score"])

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*kept).dtypes)
    return docs.select(*{*kept, "text"}).mapInArrow(lambda batches: passage_batches(batches, use), f"{schema}, score double")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(read_table(spark, sf_dir, "documents"))
    model = fit(docs, read_table(spark, sf_dir, "labels"), "quality", fold_of(F.col("doc_id"), 5) != 0)
    scored = score_quality(docs, model, "doc_id")
    return scored.select("doc_id", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
