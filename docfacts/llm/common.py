"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE_WORDS = 5
#: Separator class of words, as Java and RE2 write it: space and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(df: DataFrame, *extra: str) -> DataFrame:
    """doc_id and text alone (and what `extra` names), whatever else the table holds; a null text counts as empty."""
    cols = [F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")]
    return df.select(*cols, *[F.col(c) for c in extra])


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's text modulo `folds`; a null id is taken as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds).cast("long"))


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder that the cluster names; one of our own only on a single machine where none is named."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="docfacts-"))
    return df.checkpoint()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once a row, also inside further lambdas (where a column would be inlined)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """A-Z only; other letters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_array(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), SPACE), lambda w: w != "")


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 over uint64 arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Remembers 64-bit hashes of words; forgets them all at `most` entries, so that a worker's memory is bounded."""

    def __init__(self, most: int = 1_000_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def words_of(text: str) -> list[bytes]:
    """Lower-cased (A-Z) words as UTF-8; bytes.split() cuts at exactly space and tab to carriage return."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def word_hashes(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def shingle_sequence(w: np.ndarray, size: int = SHINGLE_WORDS) -> np.ndarray:
    """64-bit hashes of the `size`-word shingles in order, repeats included, from hashes of words; fewer words make one shingle, no words none."""
    n = len(w)
    if n == 0:
        return w
    width = min(size, n)
    h = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + w[i : n - width + 1 + i])
    return h


def shingle_hashes(words: list[bytes], hashes: WordHashes, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    return np.unique(shingle_sequence(word_hashes(words, hashes), size))
