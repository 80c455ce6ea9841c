"""Full-text search: all-terms prefix match within a page row, BM25 ranks, snippets; by a scan of the rows, or through stored postings.

Postings are partitioned by a word's first two characters, so that a query reads the words that may match and no text. All ranks
are those of the scan.
"""

from __future__ import annotations

import math
import re
import unicodedata

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from docfacts.functions.text import let, words_column

K1, B = 1.2, 0.75
PREFIX = 2  # characters of a word by which postings are partitioned


def query_terms(text: str) -> list[str]:
    """Folded runs of letters and digits of more than one character."""
    plain = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))
    return [t for t in re.split("[^a-z0-9]+", plain) if len(t) > 1]


def spread(pages: DataFrame) -> DataFrame:
    """Pages dealt to tasks by document before their texts are folded: a file is read by as many tasks as it has row groups, often one. What is counted by document afterwards isn't moved."""
    return pages.repartition("doc_id")


def page_rows(pages: DataFrame) -> DataFrame:
    """doc_id, page, terms: one row per page."""
    return pages.select("doc_id", "page", words_column(F.col("text")).alias("terms"))


def matches(rows: DataFrame, terms: list[str]) -> DataFrame:
    """Page rows that hold a word with each of the terms as prefix, with frequencies tf_0, tf_1, ..."""
    def frequency(term: str) -> Column:
        return F.size(F.filter("terms", lambda w: w.startswith(term)))

    rows = rows.withColumns({f"tf_{i}": frequency(t) for i, t in enumerate(terms)})
    hit = F.lit(bool(terms))
    for i in range(len(terms)):
        hit = hit & (F.col(f"tf_{i}") > 0)
    return rows.withColumn("hit", hit)


def bm25(n_terms: int, stats: Row, n_words: Column) -> Column:
    """Rank of a row with frequencies tf_0, tf_1, ...; stats: n_rows, avg_len, df_0, df_1, ..."""
    score = F.lit(0.0)
    for i in range(n_terms):
        idf = math.log(1 + (stats["n_rows"] - stats[f"df_{i}"] + 0.5) / (stats[f"df_{i}"] + 0.5))
        tf = F.col(f"tf_{i}")
        score = score + F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n_words / F.lit(max(stats["avg_len"], 1e-9))))
    return score


def search(rows: DataFrame, terms: list[str], limit: int | None = 50) -> DataFrame:
    """doc_id, rank: the best page's BM25 of each document that matches, best first. An empty query matches nothing.

    Two passes over the postings: corpus statistics (one row), then the ranked hits; only hits are shuffled.
    """
    marked = matches(rows, terms)
    stats = marked.agg(F.count("*").alias("n_rows"), F.coalesce(F.avg(F.size("terms")), F.lit(1.0)).alias("avg_len"), *[F.count_if(F.col(f"tf_{i}") > 0).alias(f"df_{i}") for i in range(len(terms))]).first()
    ranked = marked.where("hit")
    score = bm25(len(terms), stats, F.size("terms"))
    best = ranked.groupBy("doc_id").agg(F.max(score).alias("rank"))
    return best.orderBy(F.col("rank").desc(), "doc_id").limit(limit) if limit else best


def narrowest(words: Column, terms: list[str]) -> Column:
    """struct<start, length>: the shortest run of words with a word for each of the terms, the earliest of several; null without. One pass over the words that match, with each term's last place."""
    places = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("i"), F.array(*[w.startswith(t) for t in terms]).alias("of"))), lambda x: F.array_contains(x["of"], True))
    start = F.struct(F.array(*[F.lit(-1)] * len(terms)).alias("last"), F.lit(-1).alias("start"), F.lit(2**31 - 1).alias("length"))

    def step(acc: Column, x: Column) -> Column:
        def after(last: Column) -> Column:
            first = F.array_min(last)
            shorter = (first >= 0) & (x["i"] - first + 1 < acc["length"])
            return F.struct(last.alias("last"), F.when(shorter, first).otherwise(acc["start"]).alias("start"), F.when(shorter, x["i"] - first + 1).otherwise(acc["length"]).alias("length"))

        return let(F.zip_with(acc["last"], x["of"], lambda p, here: F.when(here, x["i"]).otherwise(p)), after)

    return let(F.aggregate(places, start, step), lambda best: F.when(best["start"] >= 0, F.struct(best["start"].alias("start"), best["length"].alias("length"))))


def snippets(rows: DataFrame, terms: list[str], width: int = 12) -> DataFrame:
    """doc_id, page, snippet: `width` words around the shortest run that has all terms (its first words, where it is longer), all matches in brackets.

    As much is shown before the run as after it, less at a text's ends. A page row without all terms has none; an empty query matches nothing.
    """
    hits = matches(rows, terms).where("hit")
    if not terms:
        return hits.select("doc_id", "page", F.lit("").alias("snippet"))
    run = F.col("run")
    room = F.greatest(F.lit(width) - run["length"], F.lit(0))
    start = F.greatest(F.least(run["start"] - F.floor(room / 2), F.greatest(F.size("terms") - width, run["start"] - room)), F.lit(0)).cast("int")
    matched = lambda w: F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.call_function("startswith", w, t))
    marked = F.transform(F.slice("terms", start + 1, F.lit(width)), lambda w: F.when(matched(w), F.concat(F.lit("["), w, F.lit("]"))).otherwise(w))
    return hits.withColumn("run", F.explode(F.array(narrowest(F.col("terms"), terms)))).select("doc_id", "page", F.array_join(marked, " ").alias("snippet"))


def indexed(pages: DataFrame, files: DataFrame) -> DataFrame:
    """doc_id, page, terms of every page, and of the file's name as page 0. pages: doc_id, page, text; files: doc_id, name."""
    return page_rows(pages.select("doc_id", "page", "text").unionByName(files.select("doc_id", F.lit(0).alias("page"), F.col("name").alias("text"))))


def reindexed(index: DataFrame, rows: DataFrame) -> DataFrame:
    """The index with all rows of the documents in `rows` replaced by these."""
    return index.join(rows.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(rows)


def postings(rows: DataFrame) -> DataFrame:
    """prefix, term, doc_id, page, tf, n_words: a row per word and page row. Words of one character aren't searched for and have none."""
    # outer, so that no filter on its size folds the text once more; what has no words is dropped with the short ones
    words = rows.select("doc_id", "page", F.size("terms").alias("n_words"), F.explode_outer("terms").alias("term")).where(F.length("term") > 1)
    counted = words.groupBy("term", "doc_id", "page", "n_words").agg(F.count("*").cast("int").alias("tf"))
    return counted.select(F.substring("term", 1, PREFIX).alias("prefix"), "term", "doc_id", "page", "tf", "n_words")


def lengths(rows: DataFrame) -> DataFrame:
    """n_rows and avg_len, in one row."""
    return rows.agg(F.count("*").alias("n_rows"), F.coalesce(F.avg(F.size("terms")), F.lit(1.0)).alias("avg_len"))


def write_index(rows: DataFrame, path: str, files_a_prefix: int = 8) -> None:
    """Postings and lengths as Parquet. A frequent prefix is dealt over `files_a_prefix` files, each sorted by word, so that a scan skips row groups."""
    dealt = postings(rows).repartition("prefix", F.pmod(F.xxhash64("doc_id"), F.lit(files_a_prefix)))
    dealt.sortWithinPartitions("prefix", "term").write.mode("overwrite").partitionBy("prefix").parquet(f"{path}/postings")
    lengths(rows).write.mode("overwrite").parquet(f"{path}/lengths")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The postings and lengths of `write_index`; a prefix stays text even where all are digits."""
    schema = "term string, doc_id long, page int, tf int, n_words int, prefix string"
    return spark.read.schema(schema).parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths")


def search_postings(index: DataFrame, sizes: DataFrame, terms: list[str], limit: int | None = 50) -> DataFrame:
    """What `search` returns, from postings and lengths: only the words that begin with a term are read and shuffled."""
    if not terms:
        return index.select("doc_id", F.lit(0.0).alias("rank")).where(F.lit(False))
    wanted = [(F.col("prefix") == t[:PREFIX]) & F.col("term").startswith(t) for t in terms]
    either = wanted[0]
    for w in wanted[1:]:
        either = either | w
    tf = [F.sum(F.when(w, F.col("tf")).otherwise(0)).alias(f"tf_{i}") for i, w in enumerate(wanted)]
    found = index.where(F.col("prefix").isin(sorted({t[:PREFIX] for t in terms})) & either).groupBy("doc_id", "page", "n_words").agg(*tf)
    own = [F.count_if(F.col(f"tf_{i}") > 0).alias(f"df_{i}") for i in range(len(terms))]
    stats = Row(**sizes.first().asDict(), **found.agg(*own).first().asDict())
    hit = F.lit(True)
    for i in range(len(terms)):
        hit = hit & (F.col(f"tf_{i}") > 0)
    best = found.where(hit).groupBy("doc_id").agg(F.max(bm25(len(terms), stats, F.col("n_words"))).alias("rank"))
    return best.orderBy(F.col("rank").desc(), "doc_id").limit(limit) if limit else best
