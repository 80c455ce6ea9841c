"""Exact links within candidate groups of any size, and the components that they make; shared by the similarity joins.

A group of up to `block` documents is linked in one task, and many small groups share a task. A larger group takes two rounds. In the first, its
members are dealt to blocks once, and a few members (hubs) are copied into every block, so that what belongs to a dense group hangs together through
them after one pass. In the second, only members outside the group's largest component are compared with all others: a group of n texts of which r
stay apart costs r * n comparisons, not n * n, and each text is sent once for every `block` of the r.

Within a task documents are taken one by one, hubs first, and compared only with those that aren't connected with them yet. A pair is compared
if it passes the prefix filter under several token orders (see `PREFIX_ORDERS`): of sets with a similarity of t or more, the n - ceil(t * n) + 1 first
tokens of both have `shared_least` in common, whatever the order. Then the whole sets are counted. So no link between components is lost, and links
within a component aren't spelled out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docfacts.llm.common import WordHashes, checkpoint, mix64, shingle_hashes, words_of

HUBS = 16
SMALL_GRAPH = 1_000_000  # edges; 16 MB
#: Token orders within a task: rarest in the task first, and two hash orders.
PREFIX_ORDERS = ("rare", 0xA5A5_1234, 0x5EED_0DD5)


def root_in(parent: dict[int, int], x: int) -> int:
    while (up := parent.setdefault(x, x)) != x:
        parent[x] = x = parent.setdefault(up, up)
    return x


def forests(edges: DataFrame, tasks: int) -> DataFrame:
    """Edges that connect what `edges` connect, without those that close a circle within one of so many tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}
        for batch in batches:
            kept = []
            for i, (a, b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)):
                a, b = root_in(parent, a), root_in(parent, b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    kept.append(i)
            yield batch.take(pa.array(kept, pa.int64()))

    return edges.coalesce(tasks).mapInArrow(run, "a long, b long")


def small_components(edges: DataFrame) -> DataFrame:
    """connected_components of a bounded number of edges, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}
        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                a, b = root_in(parent, a), root_in(parent, b)
                parent[max(a, b)] = min(a, b)
        ids = [x for x in parent if root_in(parent, x) != x]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([root_in(parent, x) for x in ids], pa.int64())], ["id", "component"])

    return edges.coalesce(1).mapInArrow(run, "id long, component long")


def connected_components(edges: DataFrame, small: int = SMALL_GRAPH) -> DataFrame:
    """(id, component): component is the smallest id reachable; edges (a, b) of longs. Up to `small` edges are done in one task.

    More are first thinned to forests, in tasks of about `small` edges, as long as that takes half of them; what is still too many takes alternating stars.

    Minima are checkpointed before they are joined back, so that a join reads both sides by shuffles of its own and a hub with a
    large part of all edges can be split at run time.
    """
    edges = checkpoint(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    left, before = edges.count(), None
    while left > small and (before is None or 2 * left <= before):
        edges = checkpoint(forests(edges, -(-left // max(small, 1))))
        left, before = edges.count(), left
    if left <= small:
        return checkpoint(small_components(edges))
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = checkpoint(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
        large = both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = checkpoint(large.where("a <> b").distinct())
        low = checkpoint(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        edges = checkpoint(small.where("a <> b").distinct())
        state = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if state == seen:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
        seen = state


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def shared_least(n: np.ndarray, other: int, percent: int) -> np.ndarray:
    """How many prefix tokens two similar sets of these sizes have in common at least: their overlap, less what the longer rest holds."""
    overlap = -(-percent * (n + other) // (100 + percent))
    return np.maximum(overlap - -(-percent * np.maximum(n, other) // 100) + 1, 1)


def first_tokens(tokens: np.ndarray, rank: np.ndarray, percent: int) -> np.ndarray:
    """The prefix of a set under the order that `rank` gives."""
    k = prefix_length(len(tokens), percent)
    return tokens if k >= len(tokens) else tokens[np.argpartition(rank, k - 1)[:k]]


class PrefixIndex:
    """The prefixes of sets under one order, by token."""

    def __init__(self, sets: list[np.ndarray], order: str | int, percent: int):
        if order == "rare":
            flat = np.concatenate(sets)
            _, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
            rare = np.minimum(counts, 0xFFFF).astype(np.uint64)[inverse] << np.uint64(48)
            ranks = np.split(rare | (mix64(flat) >> np.uint64(16)), np.cumsum([len(s) for s in sets])[:-1])
        else:
            ranks = [mix64(s ^ np.uint64(order)) for s in sets]
        self.prefixes = [first_tokens(s, r, percent) for s, r in zip(sets, ranks, strict=True)]
        flat, owner = np.concatenate(self.prefixes), np.repeat(np.arange(len(sets)), [len(p) for p in self.prefixes])
        by_token = np.argsort(flat, kind="stable")
        self.tokens, self.owner = flat[by_token], owner[by_token]

    def shared(self, i: int) -> np.ndarray:
        """How many prefix tokens each set has in common with set i."""
        count, prefix = np.zeros(len(self.prefixes), np.int64), self.prefixes[i]
        begin, end = np.searchsorted(self.tokens, prefix, "left"), np.searchsorted(self.tokens, prefix, "right")
        for b, e in zip(begin.tolist(), end.tolist(), strict=True):
            if e - b > 1:
                count[self.owner[b:e]] += 1
        return count


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def joining_links(sets: list[np.ndarray], labels: np.ndarray, left: np.ndarray | None, right: np.ndarray | None, percent: int) -> Iterator[tuple[int, int]]:
    """Links (i, j) between sets of different labels that, with the labels, connect all that is similar: of all pairs, or of left (mask) with right."""
    size, label = np.array([len(s) for s in sets]), labels.copy()
    orders: list[PrefixIndex] = []
    places = np.arange(len(sets))
    for i in places if left is None else np.nonzero(left)[0]:
        other = (label != label[i]) & (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i])) & (places > i if right is None else right)
        if not other.any():
            continue
        orders = orders or [PrefixIndex(sets, o, percent) for o in PREFIX_ORDERS]
        least = shared_least(size, size[i], percent)
        for order in orders:
            other &= order.shared(i) >= least
            if not other.any():
                break
        for j in np.nonzero(other)[0].tolist():
            if label[j] == label[i]:
                continue
            shared = common(sets[i], sets[j])
            if 100 * shared >= percent * (size[i] + size[j] - shared):
                label[label == label[j]] = label[i]
                yield int(i), j


def linker(percent: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def link(rows: pd.DataFrame) -> pd.DataFrame:
        hashes, found = WordHashes(), []
        for _, group in rows.groupby(["chained", "g"], sort=False):
            group = group.sort_values(["hub", "cid"], ascending=[False, True])
            if len(group) < 2:
                continue
            ids, side = group["cid"].tolist(), group["side"].to_numpy()
            sets = [shingle_hashes(words_of(t), hashes) for t in group["text"]]
            masks = (None, None) if (side < 0).all() else (side == 0, side == 1)
            found += [(ids[i], ids[j]) for i, j in joining_links(sets, group["label"].to_numpy(), *masks, percent)]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return link


def link_groups(grouped: DataFrame, fetch: Callable[[DataFrame], DataFrame], percent: int, block: int, block_bytes: int, hubs: int = HUBS) -> DataFrame:
    """Links (a, b) that connect what is similar within each group. grouped: grp (chained, g), blocks, cid, id, mark, size; fetch(rows) adds their texts."""
    n, n_bytes, most = grouped.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("blocks"), F.lit(1))).first()
    parts = 1 + 2 * int(max(n // block, n_bytes // block_bytes))
    base = grouped.withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")).withColumn("hub", F.lit(False))
    if most > 1:
        first = Window.partitionBy("grp").orderBy(F.xxhash64("cid"), "cid")
        chosen = base.where("blocks > 1").select("grp", "cid").withColumn("k", F.row_number().over(first)).where(F.col("k") <= hubs).select("grp", "cid", F.lit(True).alias("is_hub"))
        base = checkpoint(base.join(chosen, ["grp", "cid"], "left").withColumn("hub", F.coalesce("is_hub", F.lit(False))).drop("is_hub"))
    place = F.explode(F.when(F.col("hub"), F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).otherwise(F.array("own")))
    shared = F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.pmod(F.xxhash64("grp"), F.lit(parts).cast("long")).alias("c"))

    def linked(dealt: DataFrame) -> DataFrame:
        rows = fetch(dealt.select("key", "grp", "cid", "label", "side", "hub", "id", "mark")).select("key", "grp.chained", "grp.g", "cid", "label", "side", "hub", "text")
        return rows.groupBy("key").applyInPandas(linker(percent), "a long, b long")

    key = F.when(F.col("blocks") == 1, shared).otherwise(F.struct(F.lit(-1).alias("i"), F.col("place").alias("j"), F.xxhash64("grp").alias("c")))
    links = linked(base.withColumn("place", place).select("*", key.alias("key"), F.col("cid").alias("label"), F.lit(-1).alias("side")))
    if most <= 1:
        return links
    links = checkpoint(links)
    labels = connected_components(links)
    labelled = base.where("blocks > 1").join(labels.withColumnRenamed("id", "of"), F.col("cid") == F.col("of"), "left")
    labelled = checkpoint(labelled.select("grp", "blocks", "cid", "id", "mark", "size", "own", F.coalesce("component", "cid").alias("label")))
    counts = labelled.groupBy("grp", "label").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    main = counts.groupBy("grp").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("all"), F.sum("bytes").alias("all_bytes"), F.max("n").alias("n"), F.max_by("bytes", F.struct("n", "label")).alias("bytes"))
    rest_blocks = F.ceil(F.greatest((F.col("all") - F.col("n")) / block, (F.col("all_bytes") - F.col("bytes")) / block_bytes)).cast("int")
    main = checkpoint(main.where(F.col("all") > F.col("n")).select("grp", "main", F.greatest(rest_blocks, F.lit(1)).alias("rest_blocks")))
    open_ = labelled.join(main, "grp")
    all_ = open_.withColumns({"i": F.explode(F.sequence(F.lit(0), F.col("rest_blocks") - 1)), "j": F.col("own"), "side": F.lit(1)})
    rest = open_.where("label <> main").withColumns({"i": F.pmod(F.xxhash64("cid", F.lit(7)), F.col("rest_blocks")).cast("int"), "j": F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)), "side": F.lit(0)})
    dealt = all_.unionByName(rest).select("*", F.struct("i", "j", F.xxhash64("grp").alias("c")).alias("key"), F.lit(False).alias("hub"))
    return links.unionByName(linked(dealt))


def text_fetcher(rows: DataFrame, broadcast_rows: int) -> Callable[[DataFrame], DataFrame]:
    """Adds each wanted row's text, looked up by (id, mark); rows: doc_id, text. Repeated rows of the table give one."""

    def fetch(wanted: DataFrame) -> DataFrame:
        sized = F.broadcast(wanted) if wanted.count() <= broadcast_rows else wanted
        found = rows.withColumn("own_mark", F.xxhash64("text")).join(sized, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("own_mark") == F.col("mark")))
        return found.select(*wanted.columns, "text").repartition("key").dropDuplicates(["key", "grp", "cid", "side"])  # where they are linked: texts are moved once

    return fetch


def sized_groups(members: DataFrame, block: int, block_bytes: int) -> DataFrame:
    """Adds blocks (that a group is dealt to) to grp, cid, size, ..."""
    whole = checkpoint(members.groupBy("grp").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("size") / block_bytes, F.lit(1))).alias("blocks")))
    return members.join(F.broadcast(whole) if whole.count() <= SMALL_GRAPH else whole, "grp")


def labelled_rows(marks: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row. marks: doc_id, digest, n_shingles; classes: digest, cid, low (its smallest doc_id); links (a, b) of cids.

    All texts of a doc_id count as its own: their classes are linked.
    """
    named = marks.where("n_shingles > 0 and doc_id is not null").select("doc_id", "digest").distinct()
    several = named.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("digest").alias("least")).where("n > 1").select("doc_id", "least")
    numbers = classes.select("digest", "cid")
    same_id = named.join(checkpoint(several), "doc_id").join(numbers, "digest").join(numbers.toDF("least", "b"), "least").select(F.col("cid").alias("a"), "b")

    linked = connected_components(links.unionByName(same_id))
    groups = checkpoint(classes.select("digest", "cid", "low").join(linked, F.col("cid") == F.col("id"), "left").select("digest", "low", F.coalesce("component", "cid").alias("g")))
    lowest = groups.groupBy("g").agg(F.min("low").alias("component_id"))
    out = marks.select("doc_id", "digest", "n_shingles").join(groups.join(lowest, "g").select("digest", "component_id"), "digest", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def links_sql(percent: int) -> str:
    """DuckDB form of the components of links of `percent` or more: doc_id, n_shingles, component_id."""
    return rf"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS s FROM words
), tokens AS MATERIALIZED (
  SELECT doc_id, len(s) AS n, hash(unnest(s)) AS t FROM sets
), links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id <> b.doc_id
  GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))
), reached(doc_id, low) AS (
  SELECT doc_id, doc_id FROM sets UNION SELECT l.b, r.low FROM reached r JOIN links l ON l.a = r.doc_id WHERE r.low < l.b
)
SELECT s.doc_id, len(s.s) AS n_shingles, min(r.low) AS component_id FROM sets s JOIN reached r USING (doc_id) GROUP BY s.doc_id, s.s
"""
