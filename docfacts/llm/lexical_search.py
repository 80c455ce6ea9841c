"""Ranked lexical search over shards of dual-sorted wavelet trees.

The index has a row per shard of up to `SHARD_DOCS` documents. A shard's postings stand term by term, each term's by falling impact (what
the term's occurrences in a document add to its score for weight 1). Over this one sequence of document numbers lies a wavelet tree: a node is a
range of documents, and holds their postings in the order of the sequence. So the tree is sorted both ways: any document range can be
walked to, and the first posting of a term within a node is the term's greatest impact in that range.

A search keeps, for each item and shard, the nodes that are open with an upper bound of their documents' scores: the sum over the item's terms of weight
times that greatest impact. The best `BATCH` nodes are opened at a time, in NumPy; a node of one document has its score as its bound. The search ends
when no open node's bound reaches the k-th best score, so the top k are exact, ties included. Impacts of inner nodes are rounded up to
multiples of IMPACT_STEP to take two bytes; those of documents are exact.

Documents are never shuffled: two narrow passes count (documents, terms) and build shards within the input's partitions. Document frequencies of the items' terms
are summed from the shards. Items go to the shards in blocks of at most `BLOCK_TERMS` terms, so what a task is sent is bounded; of each item a
shard returns its k best, which a window with a limit before the shuffle merges.

Terms: runs of ASCII letters, ASCII digits and all characters from U+0080 on; only A-Z are lower-cased.

Nulls: a null text has no term; documents without a term are in no shard and don't count. Documents without doc_id count, are never returned. Rows that repeat a
doc_id are documents of their own, and each may be returned. Items without terms (null, empty) or with a null item_id give no rows; rows that repeat an
item_id are one item with the terms of all. Extra columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docfacts.llm.common import checkpoint, documents, read_table

SHARD_DOCS, SHARD_POSTINGS = 4096, 2_000_000
BLOCK_TERMS = 500_000
BATCH = 128
IMPACT_STEP = 32
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
INDEX = "shard long, doc_ids binary, terms binary, starts binary, impacts binary, levels array<binary>, n_postings long"


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(TABLE).split()


def length_norm(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of the contract: a document's length against the mean, in hundredths, a quarter of the weight."""
    return 100 - 25 + (25 * n * n_docs) // n_terms


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[bytes]]]:
    for b in batches:
        for i, t in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
            terms = terms_of(t.as_py())
            if terms:
                yield i, terms


def corpus_sizes(docs: DataFrame) -> tuple[int, int]:
    """N and L: documents with a term, and all their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_docs = n_terms = 0
        for _, terms in text_batches(batches):
            n_docs, n_terms = n_docs + 1, n_terms + len(terms)
        yield pa.RecordBatch.from_pydict({"n": [n_docs], "l": [n_terms]})

    sums = documents(docs).mapInArrow(run, "n long, l long").agg(F.sum("n"), F.sum("l")).first()
    return int(sums[0] or 0), int(sums[1] or 0)


def build_shard(number: int, ids: list[int | None], counts: list[Counter], lengths: list[int], n_docs: int, n_terms: int) -> dict:
    """One row of the index. Null doc_ids stay as the smallest long."""
    words = pa.array([w for c in counts for w in c], pa.binary()).dictionary_encode()
    names = words.dictionary.to_pylist()
    order = sorted(range(len(names)), key=names.__getitem__)
    rank = np.empty(len(names), np.int64)
    rank[order] = np.arange(len(names))
    term = rank[np.asarray(words.indices, np.int64)]
    doc = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
    tf = np.fromiter((n for c in counts for n in c.values()), np.int64, len(term))
    value = impact(tf, length_norm(np.array(lengths, np.int64), n_docs, n_terms)[doc])
    dual = np.lexsort((doc, -value, term))
    sequence, value = doc[dual], value[dual]
    starts = np.searchsorted(term[dual], np.arange(len(names) + 1))
    levels, height = [], max(1, int(len(counts) - 1).bit_length())
    for bit in range(height - 1, -1, -1):
        ones = (sequence >> bit & 1).astype(bool)
        levels.append(np.packbits(ones).tobytes())
        sequence = np.concatenate([sequence[~ones], sequence[ones]])
    known = np.array([np.iinfo(np.int64).min if i is None else i for i in ids], np.int64)
    return {
        "shard": number, "doc_ids": known.tobytes(), "terms": b" ".join(names[i] for i in order), "starts": starts.astype(np.int64).tobytes(),
        "impacts": value.astype(np.int32).tobytes(), "levels": levels, "n_postings": len(value),
    }


def lexical_index(docs: DataFrame, sizes: tuple[int, int] | None = None, shard_docs: int = SHARD_DOCS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """The index: a row per shard, made of consecutive documents of a partition; `sizes` are N and L, counted if not given."""
    n_docs, n_terms = sizes or corpus_sizes(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        schema = pa.schema([("shard", pa.int64()), *[(c, pa.binary()) for c in ("doc_ids", "terms", "starts", "impacts")], ("levels", pa.list_(pa.binary())), ("n_postings", pa.int64())])
        ids, counts, lengths, size = [], [], [], 0
        for i, terms in text_batches(batches):
            c = Counter(terms)
            if ids and (len(ids) >= shard_docs or size + len(c) > shard_postings):
                yield pa.RecordBatch.from_pylist([build_shard(number, ids, counts, lengths, n_docs, n_terms)], schema)
                number, ids, counts, lengths, size = number + 1, [], [], [], 0
            ids.append(i)
            counts.append(c)
            lengths.append(len(terms))
            size += len(c)
        if ids:
            yield pa.RecordBatch.from_pylist([build_shard(number, ids, counts, lengths, n_docs, n_terms)], schema)

    return documents(docs).mapInArrow(run, INDEX)


class Shard:
    """A row of the index, opened: terms' places and, by level, ranks of the one bits and rounded-up impacts."""

    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["doc_ids"], np.int64)
        self.place = {t: i for i, t in enumerate(row["terms"].split(b" "))}
        self.starts = np.frombuffer(row["starts"], np.int64)
        value = np.frombuffer(row["impacts"], np.int32)
        self.ones, self.zeros, self.bounds = [], [], []
        for packed in row["levels"]:
            self.bounds.append((-(-value // IMPACT_STEP)).astype(np.uint16))
            bits = np.unpackbits(np.frombuffer(packed, np.uint8), count=len(value))
            self.ones.append(np.concatenate([[0], np.cumsum(bits, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(len(value) - int(self.ones[-1][-1]))
            bits = bits.astype(bool)
            value = np.concatenate([value[~bits], value[bits]])
        self.leaves = value  # by document, exact
        self.height = len(row["levels"])

    def bound(self, level: int, low: np.ndarray, high: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Of nodes at a level, given by their terms' intervals: the sum of weighted greatest impacts."""
        holds = low < high
        at = np.where(holds, low, 0)
        best = self.leaves[at].astype(np.int64) if level == self.height else self.bounds[level][at].astype(np.int64) * IMPACT_STEP
        return (np.where(holds, best, 0) * weights).sum(axis=1)

    def opened(self, level: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of both children of each node."""
        ones, zeros = self.ones[level], self.zeros[level]
        a, b = ones[low], ones[high]
        return np.concatenate([low - a, zeros + a]), np.concatenate([high - b, zeros + b])

    def top(self, terms: list[tuple[bytes, int]], k: int, batch: int = BATCH) -> list[tuple[int, int]]:
        """(score, doc_id) of the k best documents: highest score, then lowest doc_id. terms: (term, weight times its repeats)."""
        known = [(self.place[t], w) for t, w in terms if t in self.place and w > 0]
        if not known:
            return []
        places, weights = np.array([p for p, _ in known]), np.array([w for _, w in known], np.int64)
        low, high = self.starts[places][None, :], self.starts[places + 1][None, :]
        # open nodes, by level: bound, number (first bits of its documents), intervals
        nodes: list[list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in range(self.height)]
        nodes[0].append((self.bound(0, low, high, weights), np.zeros(1, np.int64), low, high))
        best: list[tuple[int, int]] = []  # a heap of (score, -doc_id)
        while True:
            least = best[0][0] if len(best) == k else 1
            heads = [(int(part[0].max()), level, i) for level, parts in enumerate(nodes) for i, part in enumerate(parts)]
            heads = [h for h in heads if h[0] >= least]
            if not heads:
                return sorted(((s, -d) for s, d in best), key=lambda x: (-x[0], x[1]))
            _, level, i = max(heads)
            bounds, number, low, high = nodes[level].pop(i)
            live = np.nonzero(bounds >= least)[0]
            if len(live) > batch:
                order = live[np.argpartition(-bounds[live], batch)]
                live, rest = order[:batch], order[batch:]
                nodes[level].append((bounds[rest], number[rest], low[rest], high[rest]))
            low, high = self.opened(level, low[live], high[live])
            number = np.concatenate([2 * number[live], 2 * number[live] + 1])
            bounds = self.bound(level + 1, low, high, weights)
            good = bounds >= least
            if level + 1 < self.height:
                if good.any():
                    nodes[level + 1].append((bounds[good], number[good], low[good], high[good]))
                continue
            for score, d in zip(bounds[good].tolist(), self.ids[number[good]].tolist(), strict=True):
                if d == np.iinfo(np.int64).min:
                    continue
                if len(best) < k:
                    heapq.heappush(best, (score, -d))
                else:
                    heapq.heappushpop(best, (score, -d))


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term, times of every term of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, t, n) for i, text in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist(), strict=True) for t, n in Counter(terms_of(text)).items()]
            ids, terms, times = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms, pa.binary()), pa.array(times, pa.int64())], ["item_id", "term", "times"])

    texts = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("item_id is not null")
    return texts.mapInArrow(run, "item_id long, term binary, times long").groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def frequencies(index: DataFrame, wanted: list[bytes]) -> dict[bytes, int]:
    """In how many documents each of the wanted terms stands: the lengths of its lists, summed over shards. At most BLOCK_TERMS terms, or those of one item, are wanted at once."""
    asked = sorted(set(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(asked), np.int64)
        for b in batches:
            for terms, starts in zip(b.column("terms").to_pylist(), b.column("starts").to_pylist(), strict=True):
                place, at = {t: i for i, t in enumerate(terms.split(b" "))}, np.frombuffer(starts, np.int64)
                for j, t in enumerate(asked):
                    i = place.get(t)
                    if i is not None:
                        total[j] += at[i + 1] - at[i]
        held = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["j", "df"])

    rows = index.select("terms", "starts").mapInArrow(run, "j long, df long").groupBy("j").agg(F.sum("df").alias("df")).collect()
    return {asked[r["j"]]: r["df"] for r in rows}


def ranked_search(index: DataFrame, items: DataFrame, n_docs: int, k: int = 20, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents of each item."""
    spark = index.sparkSession
    terms = checkpoint(item_terms(items))
    blocks = max(1, -(-terms.count() // block_terms))
    found: DataFrame | None = None
    for block in range(blocks):
        rows = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        df = frequencies(index, [bytes(r["term"]) for r in rows])
        queries: dict[int, list[tuple[bytes, int]]] = {}
        for r in rows:
            term = bytes(r["term"])
            if term in df:
                queries.setdefault(r["item_id"], []).append((term, weight(n_docs, df[term]) * r["times"]))
        sent = spark.sparkContext.broadcast(queries)
        part = index.mapInArrow(searcher(sent, k), "item_id long, score long, doc_id long")
        found = part if found is None else found.unionByName(part)
    best = Window.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def searcher(sent: Broadcast, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The task that opens its shards one by one and answers all items of a block on each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                shard = Shard({c: b.column(c)[i].as_py() for c in ("doc_ids", "terms", "starts", "impacts", "levels")})
                rows = [(item, score, doc) for item, terms in sent.value.items() for score, doc in shard.top(terms, k)]
                del shard
                ids, scores, docs = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(scores, pa.int64()), pa.array(docs, pa.int64())], ["item_id", "score", "doc_id"])

    return run


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item, from an index of all documents."""
    docs = read_table(spark, sf_dir, "documents")
    sizes = corpus_sizes(docs)
    index = checkpoint(lexical_index(docs, sizes))
    return ranked_search(index, read_table(spark, sf_dir, "benchmark"), sizes[0])


ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), postings AS (
  SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL
), docs AS (
  SELECT doc_id, sum(tf)::BIGINT AS n FROM postings GROUP BY doc_id
), corpus AS (
  SELECT count(*) AS nd, sum(n)::BIGINT AS l FROM docs
), freq AS (
  SELECT term, count(*) AS df FROM postings GROUP BY term
), asked AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY ALL
), scored AS (
  SELECT item_id, doc_id, sum(times * floor(1000 * ln((2.0::DOUBLE * nd + 2) / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * nd) // l))))::BIGINT AS score
  FROM asked JOIN freq USING (term) JOIN postings USING (term) JOIN docs USING (doc_id), corpus
  GROUP BY item_id, doc_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
