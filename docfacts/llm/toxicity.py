"""Toxicity by maximum-scoring segments.

Tokens are the letters of each lower-cased word. Scores are log-odds between
toxic and other labelled documents with an informative Dirichlet prior, the prior being half a count and the token's frequency in both.
A word with a clear difference (|z| >= 3) has its own; another has that of its longest beginning (four letters or more) with a clear difference, as
insults are inflected; the rest get the log-odds of all of them together. A linear-time scan finds all
maximal-scoring segments of a text. Segment scores follow an extreme-value law in clean text: lambda solves
sum p0 exp(lambda s) = 1 and K is fitted to the clean training documents. A document's statistic is the most significant sum of
its r best segments (Karlin-Altschul sum statistics), for every r up to which the sum of the normalised scores is positive, where the law holds;
an isotonic fit over the training documents turns it into a score.

Copies would make any of their words look toxic, so a labelled document weighs 1 / k, k being how many documents of its label share its shingles:
of its four smallest shingle hashes, the second least shared counts, so that one common line doesn't make documents copies. Every labelled document
teaches. Counts, K and the isotonic fit use the labelled documents of the training folds, at most `most_documents` of them (those
with the smallest hash of their id), so that the labels are broadcast and no text is shuffled; what reaches the driver are the
tokens of these documents with a clear difference, and 64 bins. Scoring is one pass without shuffle. Labels, lang, source and doc_id are never inputs.

Nulls: a null text is empty and has no segment. Null or unmatched labels teach nothing; with one
class or none the score is the toxic share (0 without labels). Repeated rows are scored each. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docfacts.llm.common import checkpoint, documents, fold_of, read_table
from docfacts.llm.decontamination import with_shingles

NOT_LETTERS = regex.compile(r"[^\p{L}]+")
WORD = re.compile(r"\S+")  # cuts where str.split() does
LEAST_BEGINNING = 4
SKETCH = 4  # smallest shingle hashes that tell copies
MOST_WORDS = 500_000  # that a worker remembers


class Tokens(dict):
    """Of each word: itself and its beginnings, longest first, or the index of the first of these in a table where one is given (0 without one)."""

    def __init__(self, table: dict[str, int] | None = None):
        super().__init__()
        self.table = table

    def __missing__(self, word: str):
        if len(self) >= MOST_WORDS:
            self.clear()
        token = NOT_LETTERS.sub("", word)
        all_ = [token[:n] for n in (len(token), *range(len(token) - 1, LEAST_BEGINNING - 1, -1))] if token else []
        out = self[word] = all_ if self.table is None else next((i for t in all_ if (i := self.table.get(t))), 0)
        return out


def token_counts(labelled: DataFrame) -> DataFrame:
    """token, y0, y1: weighted and damped counts, weight * log(1 + n) of each document's n, of clean and toxic documents; words count for their beginnings, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, sums = Tokens(), defaultdict(lambda: [0.0, 0.0])
        for b in batches:
            for text, y, weight in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), b.column("weight").to_pylist(), strict=True):
                n: dict[str, int] = defaultdict(int)
                for word, k in Counter(text.lower().split()).items():
                    for t in tokens[word]:
                        n[t] += k
                for t, k in n.items():
                    sums[t][y] += weight * math.log1p(k)
                if len(sums) > MOST_WORDS:
                    yield emit(sums)
        yield emit(sums)

    def emit(sums: dict[str, list[float]]) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v[0] for v in sums.values()], pa.float64()), pa.array([v[1] for v in sums.values()], pa.float64())], ["token", "y0", "y1"])
        sums.clear()
        return out

    rows = labelled.mapInArrow(run, "token string, y0 double, y1 double")
    return rows.groupBy("token").agg(F.sum("y0").alias("y0"), F.sum("y1").alias("y1"))


def words_by_score(labelled: DataFrame, table: dict[str, int]) -> np.ndarray:
    """(2, tokens + 1): weighted words of clean and of toxic documents that have each token's score; those of none at 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, sums = Tokens(table), np.zeros((2, len(table) + 1))
        for b in batches:
            for text, y, weight in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), b.column("weight").to_pylist(), strict=True):
                for word, k in Counter(text.lower().split()).items():
                    sums[y, tokens[word]] += weight * k
        y, i = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(y), pa.array(i), pa.array(sums[y, i])], ["y", "i", "n"])

    out = np.zeros((2, len(table) + 1))
    for r in labelled.mapInArrow(run, "y long, i long, n double").groupBy("y", "i").agg(F.sum("n").alias("n")).collect():
        out[r["y"], r["i"]] = r["n"]
    return out


@dataclass
class Segments:
    """Token scores and the extreme-value law; `bins` maps a statistic to a score."""

    table: dict[str, int]
    scores: np.ndarray
    rate: float
    k: float = 0.1
    at: list[float] = field(default_factory=lambda: [0.0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def statistic(self, best: np.ndarray, n: int) -> float:
        """-log of the chance that the r best segments of clean text of n tokens sum as high, for the best r; without segments, as of one of score 0."""
        best = best if len(best) else np.zeros(1)
        r = np.arange(1, len(best) + 1)
        total = np.cumsum(self.rate * np.sort(best)[::-1] - math.log(self.k * max(n, 1)))
        log_factorial = np.cumsum(np.log(r))
        rarity = total - (r - 1) * np.log(np.maximum(total, 1)) + log_factorial + np.concatenate([[0], log_factorial[:-1]]) - r * math.log(2)
        return float(np.max(rarity[(total > 0) | (r == 1)]))

    def score(self, statistic: np.ndarray) -> np.ndarray:
        return np.interp(statistic, self.at, self.value)


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """(start, end, score) of all maximal scoring segments, in linear time (each candidate is merged or passed once)."""
    above = np.concatenate([[0.0], np.cumsum(scores)])
    held: list[tuple[int, int, float, float]] = []  # start, end, sum before it, sum after it
    links: list[int] = []  # for each candidate, the nearest one to its left with a smaller sum before it
    for i in np.nonzero(scores > 0)[0].tolist():
        start, end, left, right = i, i + 1, float(above[i]), float(above[i + 1])
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= left:
                j = links[j]
            if j < 0 or held[j][3] >= right:
                held.append((start, end, left, right))
                links.append(j)
                break
            start, left = held[j][0], held[j][2]
            del held[j:], links[j:]
    return [(s, e, r - le) for s, e, le, r in held]


def token_scores(labelled: DataFrame, prior: float, least_z: float) -> Segments | None:
    counts = checkpoint(token_counts(labelled))
    total = counts.agg(F.sum("y0").alias("y0"), F.sum("y1").alias("y1"), F.count("*").alias("tokens")).first()
    n0, n1 = total["y0"] or 0.0, total["y1"] or 0.0
    if not n0 or not n1:
        return None
    mass = prior + 0.5 * total["tokens"]
    alpha = 0.5 + prior * (F.col("y0") + F.col("y1")) / (n0 + n1)
    odds = lambda y, n: F.log(F.col(y) + F.col("alpha")) - F.log(n + mass - F.col(y) - F.col("alpha"))
    rated = counts.withColumn("alpha", alpha).withColumn("odds", odds("y1", n1) - odds("y0", n0))
    clear = F.abs("odds") / F.sqrt(1 / (F.col("y1") + F.col("alpha")) + 1 / (F.col("y0") + F.col("alpha"))) >= least_z
    listed = rated.where(clear).select("token", "odds").toPandas().sort_values("token")  # of a bounded set of documents
    table = {t: i + 1 for i, t in enumerate(listed["token"])}
    words = words_by_score(labelled, table) + 0.5
    p0, p1 = words[0] / words[0].sum(), words[1] / words[1].sum()
    scores = np.concatenate([[min(math.log(p1[0] / p0[0]), -0.01)], listed["odds"].to_numpy()])
    low, high = 1e-3, 8.0
    for _ in range(80):  # the positive root of sum p0 exp(rate * s) = 1
        mid = (low + high) / 2
        low, high = (mid, high) if float(p0 @ np.exp(np.minimum(mid * scores, 700))) < 1 else (low, mid)
    return Segments(table, scores, low)


def segment_batches(batches: Iterator[pa.RecordBatch], model: Segments) -> Iterator[tuple[pa.RecordBatch, list[list[tuple[int, int, float]]], list[int]]]:
    """Each batch with all segments (in words) and the number of words of each of its texts."""
    tokens = Tokens(model.table)
    for b in batches:
        segments, lengths = [], []
        for text in b.column("text").to_pylist():
            words = text.lower().split()
            index = np.fromiter(map(tokens.__getitem__, words), np.int64, len(words))
            segments.append(maximal_segments(model.scores[index]))
            lengths.append(len(words))
        yield b, segments, lengths


def weighed(labelled: DataFrame) -> DataFrame:
    """doc_id, weight of the labelled documents with words: 1 / how many of the same label share the second least shared of its smallest shingles."""
    smallest = F.slice(F.array_sort(F.array_distinct("shingles")), 1, SKETCH)
    marks = checkpoint(with_shingles(labelled, "doc_id", "y").select("doc_id", "y", F.explode(smallest).alias("h")).distinct())
    shared = marks.join(marks.groupBy("y", "h").agg(F.count("*").alias("n")), ["y", "h"])
    counts = shared.groupBy("doc_id").agg(F.array_sort(F.collect_list("n")).alias("n"))
    return counts.select("doc_id", (1 / F.coalesce(F.get("n", F.lit(1)), F.get("n", F.lit(0)))).alias("weight"))


def fit(docs: DataFrame, labels: DataFrame, label: str, learn: Column, prior: float = 100.0, least_z: float = 3.0, bins: int = 64, most_documents: int = 100_000) -> Segments | float:
    """learn: which doc_ids may teach; at most `most_documents` do, those with the smallest hash. A plain number is the score of all documents."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & learn)
    known = checkpoint(known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_documents))
    labelled = docs.join(F.broadcast(known), "doc_id").select("doc_id", "text", "y")
    weights = checkpoint(weighed(labelled))
    labelled = labelled.join(F.broadcast(weights), "doc_id", "left").select("text", F.col("y").cast("int"), F.coalesce("weight", F.lit(1.0)).alias("weight"))  # as bounded as `known`
    model = token_scores(labelled, prior, least_z)
    if model is None:
        return float(known.agg(F.coalesce(F.avg("y"), F.lit(0.0))).first()[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, segments, n in segment_batches(batches, model):
            best = pa.array([[s for _, _, s in found] for found in segments], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("y"), b.column("weight"), best, pa.array(n, pa.int64())], ["y", "weight", "best", "n"])

    found = checkpoint(labelled.mapInArrow(run, "y int, weight double, best array<double>, n long"))
    clean = found.where("y = 0 and size(best) > 0")
    gumbel = clean.agg(F.sum(F.col("weight") * (F.array_max("best") * model.rate - F.log("n"))) / F.sum("weight")).first()[0]
    model.k = math.exp((gumbel if gumbel is not None else 0.0) - 0.5772156649)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [model.statistic(np.array(best), n) for best, n in zip(b.column("best").to_pylist(), b.column("n").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("y"), b.column("weight"), pa.array(x, pa.float64())], ["y", "weight", "x"])

    measured = found.mapInArrow(measure, "y int, weight double, x double")
    edges = sorted(set(measured.agg(F.percentile_approx("x", [i / bins for i in range(1, bins)], 10000)).first()[0]))
    bucket = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < F.col("x")))
    sums = [F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("y")).alias("y"), F.avg("x").alias("x")]
    table = measured.groupBy(bucket.alias("bin")).agg(*sums).orderBy("bin").collect()
    model.at, model.value = isotonic([r["x"] for r in table], [r["n"] for r in table], [r["y"] for r in table])
    return model


def isotonic(x: list[float], n: list[float], y: list[float]) -> tuple[list[float], list[float]]:
    """Pool-adjacent-violators over bins, each with one document's weight of the mean; pools keep a slight slope."""
    mean = sum(y) / sum(n)
    pools: list[list] = []  # weight, sum, bins' x
    for a, k, s in zip(x, n, y, strict=True):
        pools.append([k + 1.0, s + mean, [a]])
        while len(pools) > 1 and pools[-2][1] / pools[-2][0] >= pools[-1][1] / pools[-1][0]:
            w, s, at = pools.pop()
            pools[-1] = [pools[-1][0] + w, pools[-1][1] + s, pools[-1][2] + at]
    at = [a for p in pools for a in p[2]]
    value = [p[1] / p[0] + 1e-6 * i / max(1, len(p[2])) for p in pools for i in range(len(p[2]))]
    return at, np.clip(np.maximum.accumulate(value), 0, 1).tolist()


def score_toxicity(docs: DataFrame, model: Segments | float) -> DataFrame:
    """doc_id, score, passages: array of (start, end, score), in characters, of all segments that are significant alone (expected less than once in 20 such texts)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        if isinstance(m, float):
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.full(b.num_rows, m)), pa.array([[]] * b.num_rows, span)], ["doc_id", "score", "passages"])
            return
        for b, segments, lengths in segment_batches(batches, m):
            x, passages = [], []
            for i, (found, n) in enumerate(zip(segments, lengths, strict=True)):
                x.append(m.statistic(np.array([s for _, _, s in found]), n))
                toxic = [f for f in found if m.rate * f[2] > math.log(20 * m.k * max(n, 1))]
                words = list(WORD.finditer(b.column("text")[i].as_py())) if toxic else []
                passages.append([{"start": words[lo].start(), "end": words[hi - 1].end(), "score": s} for lo, hi, s in toxic])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(m.score(np.array(x)), pa.float64()), pa.array(passages, span)], ["doc_id", "score", "passages"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, passages array<struct<start:long,end:long,score:double>>")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(read_table(spark, sf_dir, "documents"))
    model = fit(docs, read_table(spark, sf_dir, "labels"), "toxic", fold_of(F.col("doc_id"), 4) != 2)
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", (fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("passages").cast("long").alias("n_passages"))
