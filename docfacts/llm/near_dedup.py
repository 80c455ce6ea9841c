"""Near-duplicate detection with SuperMinHash signatures.

SuperMinHash gives each element a random permutation of the signature's components: its value at the i-th component of its
permutation is i plus a uniform number, and a component keeps its smallest value. Elements are taken layer by layer (all
elements' i-th components before any i + 1st), so a document's signature is final as soon as every component has a value
of the layers done: most documents stop after one or two of them.

1. Rows of equal word sequences form a class, numbered by the smallest of its rows.
2. Signatures are cut into bands. Classes that share a band are linked to the smallest of the bucket (a star, never
   all pairs), and the stars' connected components are the candidate groups.
3. Each candidate group is verified on full shingle sets, as similar_groups says: small groups in one piece, large ones by hubs first and then by what they
   leave apart. A group that hangs together like a chain, so that its buckets have fewer pairs than the whole, is verified bucket by
   bucket instead: its cost is that of its buckets.
4. Connected components of the verified links, and of classes that share a doc_id, give component_id.

With 26 bands of 6 components, a pair at the threshold of 0.85 shares no band with probability (1 - 0.85**6)**26 = 5e-6, and
a group then still holds it together by its other members.

Links and labels stay in Spark; connected components run by alternating large and small stars, each round checkpointed.

Nulls: a null text is empty; empty texts and those without words have no shingles, link with nothing and are kept. Rows with a null
doc_id are compared like others, get the smallest doc_id that they are linked to (null without one) and are always kept. All rows of an id
are one document: links of any of its texts are the document's, and all its rows get the same component. Texts of one to four words are
one shingle. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfacts.llm.common import WordHashes, checkpoint, documents, mix64, read_table, shingle_hashes, words_of
from docfacts.llm.similar_groups import connected_components, labelled_rows, link_groups, links_sql, text_fetcher

BANDS, ROWS = 26, 6
SEEDS = [np.uint64((0x9E3779B97F4A7C15 * (i + 1)) & (2**64 - 1)) for i in range(256)]  # of the layers


def super_minhash(sets: list[np.ndarray], size: int = BANDS * ROWS) -> np.ndarray:
    """Signatures (len(sets), size) of uint64: layer in the high half, a uniform number in the low one."""
    lengths = np.array([len(s) for s in sets], np.int64)
    elements = np.concatenate([*sets, np.empty(0, np.uint64)])
    doc = np.repeat(np.arange(len(sets)), lengths)
    signature = np.full(len(sets) * size, np.iinfo(np.uint64).max, np.uint64)
    order: np.ndarray | None = None  # the elements' permutations, as far as they are drawn
    for layer in range(size):
        if not len(elements):
            break
        random = mix64(elements ^ SEEDS[layer])
        swap = layer + ((random >> np.uint64(32)) * np.uint64(size - layer) >> np.uint64(32)).astype(np.int64)
        if order is None:
            component = swap
        else:
            row = np.arange(len(elements))
            component = order[row, swap].astype(np.int64)
            order[row, swap] = order[:, layer]
            order[:, layer] = component
        np.minimum.at(signature, doc * size + component, (np.uint64(layer) << np.uint64(32)) | (random & np.uint64(0xFFFFFFFF)))
        open_ = (signature.reshape(-1, size).max(axis=1) == np.iinfo(np.uint64).max)[doc]
        if order is None:
            first = component[open_]
            order = np.broadcast_to(np.arange(size, dtype=np.uint8), (len(first), size)).copy()
            row = np.arange(len(first))
            order[row, first], order[row, 0] = 0, first
        else:
            order = order[open_]
        elements, doc = elements[open_], doc[open_]
    return signature.reshape(-1, size)


def band_hashes(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(signatures), bands)).copy()
    cut = signatures.reshape(len(signatures), bands, rows)
    for r in range(rows):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + cut[:, :, r])
    return h


def signed(docs: DataFrame, n_bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """row (a number of its own), doc_id, mark (hash of the text), size (bytes), digest of the word sequence, n_shingles, bands of each row; no bands without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, row = WordHashes(300_000), TaskContext.get().partitionId() << 33
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):  # bounds the arrays
                b = whole.slice(lo, 256)
                part = [words_of(t) for t in b.column("text").to_pylist()]
                sets = [shingle_hashes(t, hashes) for t in part]
                bands = band_hashes(super_minhash(sets, n_bands * rows), n_bands, rows).view(np.int64)
                lengths = [len(s) for s in sets]
                digests = [xxhash.xxh3_128_digest(b" ".join(t)) for t in part]
                offsets = np.cumsum([0, *[n_bands if n else 0 for n in lengths]]).astype(np.int32)
                kept = bands[np.array(lengths, np.int64) > 0].ravel()
                own = [pa.array(np.arange(row, row + len(part))), *[b.column(c) for c in ("doc_id", "mark", "size")]]
                row += len(part)
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(digests, pa.binary()), pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(kept))],
                    ["row", "doc_id", "mark", "size", "digest", "n_shingles", "bands"],
                )

    marked = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"), F.octet_length("text").cast("long").alias("size"))
    return marked.mapInArrow(run, "row long, doc_id long, mark long, size long, digest binary, n_shingles long, bands array<long>")


def candidate_groups(classes: DataFrame, block: int, block_bytes: int) -> DataFrame:
    """cid, grp (chained, g), blocks: the groups in which each class is verified, and the blocks that each group is dealt to.

    g is a component of the bands' stars or, for a chained one, each of its buckets.
    """
    bands = classes.select("cid", "size", F.explode("bands").alias("band"))
    buckets = bands.groupBy("band").agg(F.min("cid").alias("hub"), F.count("*").alias("m"), F.sum("size").alias("bytes")).where("m > 1")
    groups = connected_components(bands.join(buckets.select("band", "hub"), "band").select(F.col("cid").alias("a"), F.col("hub").alias("b")))
    labels = checkpoint(groups.unionByName(groups.select(F.col("component").alias("id"), "component").distinct()))
    whole = classes.select("cid", "size").join(labels, F.col("cid") == F.col("id")).groupBy("component").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    large = checkpoint(whole.where(F.col("n") > block))
    blocks = F.ceil(F.greatest(F.col("n") / block, F.col("bytes") / block_bytes, F.lit(1)))
    chained = buckets.join(labels, F.col("hub") == F.col("id")).groupBy("component").agg(F.sum(F.col("m").cast("double") * F.col("m")).alias("pairs")).join(large, "component")
    chained = checkpoint(chained.where(F.col("pairs") < F.col("n").cast("double") * F.col("n")).select("component"))
    apart = labels.join(whole, "component").join(chained, "component", "left_anti")
    grouped = apart.select(F.col("id").alias("cid"), F.struct(F.lit(False).alias("chained"), F.col("component").alias("g")).alias("grp"), blocks.alias("blocks"))
    if chained.isEmpty():
        return grouped
    links = bands.join(buckets, "band").join(labels, F.col("cid") == F.col("id")).join(chained, "component", "left_semi")
    return grouped.unionByName(links.withColumn("n", F.col("m")).select("cid", F.struct(F.lit(True).alias("chained"), F.col("band").alias("g")).alias("grp"), blocks.alias("blocks")))


def near_duplicates(docs: DataFrame, percent: int = 85, n_bands: int = BANDS, band_rows: int = ROWS, block: int = 1500, block_bytes: int = 32_000_000, broadcast_rows: int = 1_000_000) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; n_bands * band_rows is 256 at most."""
    rows = documents(docs)
    marks = checkpoint(signed(rows, n_bands, band_rows))
    classes = marks.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("low"), F.min(F.struct("row", "doc_id", "mark", "size")).alias("rep"), F.first("bands").alias("bands"))
    classes = checkpoint(classes.select("digest", "low", F.col("rep.row").alias("cid"), F.col("rep.doc_id").alias("id"), "rep.mark", "rep.size", "bands"))
    grouped = checkpoint(candidate_groups(classes, block, block_bytes).join(classes.select("cid", "id", "mark", "size"), "cid"))
    links = link_groups(grouped, text_fetcher(rows, broadcast_rows), percent, block, block_bytes)
    out = labelled_rows(marks, classes, links)
    return out.select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


ORACLE_SQL = f"SELECT *, doc_id = component_id AS kept FROM ({links_sql(85)})"
