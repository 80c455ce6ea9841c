"""Cost-balanced packing of tokenised documents into sequences.

Cost of a piece of n tokens: linear * n + quadratic * n * n (attention within the document). Documents are taken in
descending length; each goes to the lowest-cost sequence with remaining capacity and, where that is too small, is cut
and goes on in the next. Sequence capacities add up to the tokens exactly: full sequences, and powers of two for the
rest, so that no sequence is padded.

Each task packs its own documents in chunks of a fixed number of tokens. There is no shuffle, memory is bounded by the
chunk, and a lost task packs the same rows again. sequence_id is the task's partition in the high bits and a counter in
the low ones.

Nulls: a null text is empty and holds the closing id alone; a null doc_id stays null. Repeated rows are packed each.
Extra columns are ignored. A document longer than a chunk makes a chunk of its own. An empty table gives no piece.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docfacts.llm.common import documents, read_table

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: Characters that every Unicode version puts in the same class; texts with others go to the library whole.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\u024f]*")


class Encoder:
    """Ids of byte-level BPE: tiktoken over the same vocabulary for plain texts, the tokenizers library for all others."""

    def __init__(self, path: str, ranks: str):
        self.library = Tokenizer.from_file(path)
        with open(ranks, "rb") as f:
            merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.plain = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})

    def encode(self, text: str) -> bytes:
        """Little-endian uint32 ids, as the library gives them."""
        if "<|" not in text and PLAIN.fullmatch(text):
            return self.plain.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@cache
def encoder_of(path: str, ranks: str) -> Encoder:
    return Encoder(path, ranks)


def capacities(tokens: int, size: int) -> list[int]:
    """Full sequences, then the binary digits of the rest: they add up to `tokens`."""
    rest = tokens % size
    return [size] * (tokens // size) + [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]


def pack(lengths: list[int], size: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of the pieces of documents with these lengths."""
    rooms = capacities(sum(lengths), size)
    used, open_ = [0] * len(rooms), [(0.0, s) for s in range(len(rooms))]  # a heap already
    out = []
    for d in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        start = 0
        while start < lengths[d]:
            cost, s = open_[0]
            n = min(lengths[d] - start, rooms[s] - used[s])
            out.append((d, start, n, s, used[s]))
            used[s] += n
            start += n
            if used[s] < rooms[s]:
                heapq.heapreplace(open_, (cost + linear * n + quadratic * n * n, s))
            else:
                heapq.heappop(open_)
    return out


def pack_documents(
    docs: DataFrame, tokenizer: str | None = None, ranks: str | None = None, size: int = 1024, end_id: int = 0, linear: float = 1.0, quadratic: float = 1 / 1024, chunk_tokens: int = 4_000_000
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (its tokens as little-endian uint32), doc_tokens, sequence_id, offset."""
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, first = encoder_of(path, ranks), TaskContext.get().partitionId() << 33
        ids: list[bytes] = []
        doc_ids: list[int | None] = []
        held = 0

        def emit() -> pa.RecordBatch:
            nonlocal first, held
            pieces = pack([len(x) // 4 for x in ids], size, linear, quadratic)
            d, start, length, sequence, offset = (list(c) for c in zip(*pieces, strict=True))
            parts = [ids[i][4 * s : 4 * (s + n)] for i, s, n in zip(d, start, length, strict=True)]
            columns = [[doc_ids[i] for i in d], start, length, parts, [len(ids[i]) // 4 for i in d], [first + s for s in sequence], offset]
            first += max(sequence) + 1
            held = 0
            ids.clear()
            doc_ids.clear()
            names, kinds = zip(*(c.split() for c in SCHEMA.split(", ")), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == "binary" else pa.int64()) for c, k in zip(columns, kinds, strict=True)], list(names))

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids.append(encoder.encode(text) + end)
                doc_ids.append(doc_id)
                held += len(ids[-1]) // 4
                if held >= chunk_tokens:
                    yield emit()
        if ids:
            yield emit()

    return documents(docs).mapInArrow(run, SCHEMA)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces with a checksum in the place of their ids."""
    pieces = pack_documents(read_table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
