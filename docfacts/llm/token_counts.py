"""Token counts by heap-and-linked-list byte-pair merging.

A word starts as a linked list of symbols. A heap holds the ranks of adjacent pairs; the lowest is popped, its two
symbols become one, and the pairs with the new neighbours are pushed. When no pair is left, the word's count is its
initial symbols minus the merges; no token identifiers are made. Words recur, so a worker remembers their counts.

Texts are cut into words by the file's pattern. Characters that this process's Unicode tables don't know, or that it normalises or classes otherwise than the
library (tried out on each new character), are rare; a text with one is normalised and cut by the library's own functions.

Nulls: a null text is empty and has no tokens. A null doc_id stays null. Repeated rows are counted each. Extra columns
are ignored. Texts are processed whole.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import cache

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docfacts.llm.common import documents, read_table

#: Words that a worker remembers before it starts anew.
MEMORY_WORDS = 1_000_000


def byte_alphabet() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte: printable Latin-1 stays, the rest follow from 256 on."""
    kept = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    moved = (b for b in range(256) if b not in set(kept))
    return [chr(c) for _, c in sorted([(b, b) for b in kept] + [(b, 256 + i) for i, b in enumerate(moved)])]


class BytePairCounter:
    """Counts the tokens of texts under a word-level BPE file of the tokenizers library.

    It reads the file's split pattern, merges, end-of-word suffix and special strings. Only the normalisers that such
    files name (NFC, white space, lower case) are known; a file with other parts is refused.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {(a, b): (rank, a + b) for rank, (a, b) in enumerate(merges)}
        self.vocabulary = model["vocab"]
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed" or not split["invert"]:
            raise ValueError("not a lower-casing word-level BPE file")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]))
        self.alphabet = byte_alphabet()
        self.known: dict[str, int] = {}
        self.library = Tokenizer.from_file(path)
        self.byte_of = {c: b for b, c in enumerate(self.alphabet)}
        self.plain, self.odd = {chr(c) for c in [9, 10, 13, *range(32, 127)]}, set()

    def normalise(self, text: str) -> str:
        return regex.sub(r"\s+", " ", unicodedata.normalize("NFC", text)).lower()

    def cut(self, text: str) -> list[str]:
        """Words as the library's normaliser and splitter give them."""
        parts = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.byte_of.__getitem__, w)).decode("utf-8", "replace") for w, _ in parts]

    def is_plain(self, text: str) -> bool:
        """Whether all characters are cut here as by the library."""
        for c in set(text) - self.plain:
            if c not in self.odd:
                probes = [c, f"a{c}", f"{c}a", f"1{c}1", f"!{c}!", f" {c} ", f"e{c}\u0301", f"A{c}\u0323B"]
                same = unicodedata.category(c) not in ("Cn", "Co", "Cs") and all(self.pattern.findall(self.normalise(p)) == self.cut(p) for p in probes)
                (self.plain if same else self.odd).add(c)
            if c in self.odd:
                return False
        return True

    def word(self, word: str) -> int:
        """Tokens of one word: symbols minus merges; symbols that the vocabulary lacks are dropped by the library, too."""
        symbols = [self.alphabet[b] for b in word.encode("utf-8")]
        symbols[-1] += self.suffix
        symbols = [s for s in symbols if s in self.vocabulary]
        n = len(symbols)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(*r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := self.ranks.get((symbols[i], symbols[i + 1])))]
        heapq.heapify(heap)
        merges, alive = 0, [True] * n
        while heap:
            _, merged, i, a, b = heapq.heappop(heap)
            j = right[i] if alive[i] else -1
            if j < 0 or symbols[i] != a or symbols[j] != b:
                continue  # an earlier merge took one of the two
            symbols[i], alive[j] = merged, False
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
                if r := self.ranks.get((merged, symbols[k])):
                    heapq.heappush(heap, (*r, i, merged, symbols[k]))
            if (h := left[i]) >= 0 and (r := self.ranks.get((symbols[h], merged))):
                heapq.heappush(heap, (*r, h, symbols[h], merged))
            merges += 1
        return n - merges

    def count(self, text: str) -> int:
        known, total = self.known, 0
        parts = self.special.split(text) if "<|" in text else [text]
        total += len(parts) - 1  # a special string inside the text is one token
        for part in parts:
            for w in self.pattern.findall(self.normalise(part)) if self.is_plain(part) else self.cut(part):
                n = known.get(w)
                if n is None:
                    if len(known) >= MEMORY_WORDS:
                        known.clear()
                    n = known[w] = self.word(w)
                total += n
        return total


@cache
def counter_of(path: str) -> BytePairCounter:
    return BytePairCounter(path)


def count_tokens(docs: DataFrame, tokenizer: str | None = None, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens) of every row. No shuffle: one pass over the scan."""
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path)
        for b in batches:
            n_tokens = pa.array([counter.count(t) for t in b.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), n_tokens], ["doc_id", "n_bytes", "n_tokens"])

    rows = documents(docs).select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"))
    counted = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"))
