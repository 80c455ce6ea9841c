"""Periodic runs: stretches of words that repeat with a period, by a harmonic grid and prefix hashes.

A run is a stretch of words with smallest period q (words q apart are equal) of max(`least`, 3 * q) words or more that can't
be extended. For each period p, grid points lie max(p, GRID) words apart, so about n * log(n) pairs (p, i) cover a text
of n words. Words equal to those p later fill at least two grid steps of a run, so the run's first grid point i has GRID such
words ahead: only pairs whose GRID-word hashes agree go on. For all of them at once, the longest common extension of i
and i + p to the right and to the left is found by binary search over prefix hashes. Pairs of one stretch are merged, the
smallest period stays (by the periodicity lemma multiples of a period give the same stretch, and only they do), and every run's
words are compared one by one. Were two hashes ever to agree on different words, that comparison would fail and the chunk is done
again with other hashes, so results are exact.

Texts are taken together in chunks of `CHUNK` words, and pairs in chunks of `PAIRS`, so memory is bounded whatever the lengths, but for
a few arrays of the longest text's words. No shuffle.

Nulls: a null text is empty; without words there are no runs and the collapsed text is empty. A null doc_id stays null. Every row gives a row,
repeated or not. Words keep their case. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docfacts.llm.common import SPACE, documents, let, mix64, read_table

LEAST, REPEATS, GRID = 24, 3, 8
CHUNK, PAIRS = 400_000, 1_000_000
PRIMES = (2**31 - 1, 2**31 - 19)
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


class PrefixHashes:
    """Hashes of any stretch of a word sequence, modulo two primes: sums of word values times powers of a base."""

    def __init__(self, words: np.ndarray, seed: int):
        random = mix64(words.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (2 * seed + 1) % 2**64))
        self.parts = []
        for k, prime in enumerate(PRIMES):
            base = 1_000_003 + int(mix64(np.array([7919 * seed + k], np.uint64))[0] % np.uint64(prime - 2_000_000))
            powers = np.ones(1, np.int64)
            while len(powers) <= len(words):
                powers = np.concatenate([powers, powers * (pow(base, len(powers), prime)) % prime])
            powers = powers[: len(words) + 1]
            values = ((random >> np.uint64(32 * k)) & np.uint64(0x3FFFFFFF)).astype(np.int64)
            self.parts.append((prime, powers, np.concatenate([[0], np.cumsum(values * powers[:-1] % prime)]) % prime))

    def equal(self, i: np.ndarray, length: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Whether words [i, i + length) equal those p later."""
        same = np.ones(len(i), bool)
        for prime, powers, sums in self.parts:
            here, there = sums[i + length] - sums[i], sums[i + p + length] - sums[i + p]
            same &= (here % prime * powers[p] - there) % prime == 0
        return same


def extension(most: np.ndarray, holds: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """For each element the largest length up to `most` for which holds(lengths) is true, by binary search over all at once."""
    low, high = np.zeros_like(most), most.copy()
    while (low < high).any():
        middle = (low + high + 1) // 2
        good = holds(middle)
        low, high = np.where(good, middle, low), np.where(good, high, middle - 1)
    return low


def grid_pairs(bounds: np.ndarray, grams: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, period, position) of the grid points whose GRID words ahead equal those a period later; bounds: where each text begins and, last, where all end."""
    n = np.diff(bounds)
    periods = np.where(n >= least, n // REPEATS, 0)
    text = np.repeat(np.arange(len(n)), periods)
    period = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    step = np.maximum(period, GRID)
    room = n[text] - period - GRID
    ends = np.cumsum(np.where(room >= 0, room // step + 1, 0))
    for lo in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
        pair = np.arange(lo, min(lo + PAIRS, int(ends[-1])))
        row = np.searchsorted(ends, pair, "right")
        before = np.where(row > 0, ends[row - 1], 0)
        at = bounds[text[row]] + (pair - before) * step[row]
        hit = grams[at] == grams[at + period[row]]
        yield text[row[hit]], period[row[hit]], at[hit]


def runs_of(words: np.ndarray, bounds: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (text, start, length, period) sorted in this order; words are numbers, equal for equal words; start counts from the text's first word."""
    random = mix64(words.astype(np.uint64) + np.uint64(0x51A7))
    grams, powers = np.zeros(len(words), np.uint64), np.uint64(0x9E3779B97F4A7C15)
    if len(words) >= GRID:
        h = np.zeros(len(words) - GRID + 1, np.uint64)
        for k in range(GRID):
            h = mix64(h * powers + random[k : len(words) - GRID + 1 + k])
        grams[: len(h)] = h
    seed = 0
    while True:
        hashes, parts = PrefixHashes(words, seed), [np.empty((0, 4), np.int64)]
        for text, period, at in grid_pairs(bounds, grams, least):
            if not len(at):
                continue
            text, period, at = chain_heads(text, period, at, hashes)
            ahead = extension(bounds[text + 1] - at - period, lambda k: hashes.equal(at, k, period))  # noqa: B023
            behind = extension(at - bounds[text], lambda k: hashes.equal(at - k, k, period))  # noqa: B023
            start, length = at - behind, behind + ahead + period
            long = length >= np.maximum(least, REPEATS * period)
            parts.append(np.unique(np.stack([text[long], start[long], length[long], period[long]], axis=1), axis=0))
        found = np.unique(np.concatenate(parts), axis=0)
        if len(found):
            found = found[np.concatenate([[True], (found[1:, :3] != found[:-1, :3]).any(axis=1)])]  # the smallest period of each stretch
        if verified(words, found):
            found[:, 1] -= bounds[found[:, 0]]
            return found
        seed += 1


def chain_heads(text: np.ndarray, period: np.ndarray, at: np.ndarray, hashes: PrefixHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs but for those that the grid point before them reaches: they lie in its stretch."""
    step = np.diff(at)
    follows = (text[1:] == text[:-1]) & (period[1:] == period[:-1]) & (step == np.maximum(period[1:], GRID))
    head = np.ones(len(at), bool)
    head[1:][follows] = ~hashes.equal(at[:-1][follows], step[follows], period[1:][follows])
    return text[head], period[head], at[head]


def verified(words: np.ndarray, found: np.ndarray) -> bool:
    """Whether each run's words equal those a period later, compared one by one."""
    return all((words[s : s + n - p] == words[s + p : s + n]).all() for _, s, n, p in found.tolist())


def collapsed_words(words: list[bytes], runs: list[list[int]]) -> bytes:
    """The words without those that a run repeats (all after its first period), joined by one space."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    keep = np.cumsum(change[:-1]) == 0
    return b" ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k)


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and collapsed (text without the repeats) of every row."""

    def chunk(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        flat = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode()
        found = runs_of(np.asarray(flat.indices, np.int64), bounds, least)
        cuts = np.searchsorted(found[:, 0], np.arange(len(texts) + 1))
        runs = [found[a:b, 1:].tolist() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        rows = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in rs] for rs in runs]
        collapsed = [collapsed_words(t, r).decode() for t, r in zip(texts, runs, strict=True)]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(np.diff(bounds)), pa.array(rows, pa.list_(RUN)), pa.array(collapsed, pa.string())],
            ["doc_id", "n_words", "runs", "collapsed"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, size = [], [], 0
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                words = t.as_py().encode().split()  # cuts at exactly space and tab to carriage return
                if ids and size + len(words) > CHUNK:
                    yield chunk(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(words)
                size += len(words)
            if ids:
                yield chunk(ids, texts)

    return documents(docs).mapInArrow(run, SCHEMA)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where texts with crc32(doc_id) % 10 = 0 repeat a stretch of theirs to the end (see the query's contract); rows without doc_id stay."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeat(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n).cast("int")
        return let(F.struct(a.alias("a"), (F.floor((n - a) / (3 + g % 8)) + 1).cast("int").alias("p"), words.alias("w")), lambda x: F.array_join(F.transform(x["w"], lambda w, i: F.when(i < x["a"], w).otherwise(F.get(x["w"], x["a"] + (i - x["a"]) % x["p"]))), " "))

    words = F.filter(F.split("text", SPACE), lambda w: w != "")
    text = F.when(h % 10 == 0, let(words, lambda w: F.when(F.size(w) > 0, repeat(w)).otherwise(F.lit("")))).otherwise(F.col("text"))
    return documents(docs).select("doc_id", text.alias("text"))


def most_repeated(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; the first of equals; null without runs."""
    return F.aggregate(F.slice(runs, 2, F.greatest(F.size(runs), F.lit(1))), F.get(runs, F.lit(0)), lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_runs, the most repeated run, and digests of all runs and of the collapsed text, of every document."""
    out = periodic_runs(planted(read_table(spark, sf_dir, "documents"))).withColumn("best", most_repeated(F.col("runs")))
    listing = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(listing, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
