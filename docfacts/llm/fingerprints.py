"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

Every five-word shingle is hashed once; the top bits choose one of 128 bins, a bin keeps its smallest hash. An empty bin
copies the nonempty bin that comes first in its own pseudo-random order of bins, which all documents share (optimal
densification: each nonempty bin is copied with the same chance, independently for every empty bin). The fingerprint is
the low 8 bits of every bin, packed as hex. Two fingerprints agree in a share p of bins; with chance agreement c = 1/256,
likeness = (p - c) / (1 - c), at least 0.

Main path: DataFrame functions alone. The hashes of a text and one sentinel a bin are sorted in place; the first of each
bin is its minimum. `edited` pairs each document with its successor by doc_id: rows are split into ranges of ids whose
bounds are quantiles of doc_id; the first row of a range is also sent to the range before, so one shuffle suffices.
There are as many ranges of `range_rows` rows as needed, `most_ranges` at most; ranges of more rows, and rows of one doc_id, which stay in one
range, are sorted on disk where needed.

Nulls: a null text is empty; rows with a null doc_id come first. Ties of doc_id are ordered by text. One to four words make
one shingle; a text without words has an empty fingerprint, which is like another empty one (1) and unlike all else (0).
Extra columns are ignored. An empty table gives no rows; the successor of a single document is itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docfacts.llm.common import SPACE, documents, let, read_table
from docfacts.llm.decontamination import shingles_of

BINS, BIN_BITS, LOW_BITS = 128, 7, 8


def bin_of(h: Column) -> Column:
    """The top bits, so that bins follow each other in signed order, too."""
    return F.shiftright(h, 64 - BIN_BITS) + BINS // 2


def bin_minima(text: Column) -> Column:
    """For each bin in order, its smallest hash, or null."""
    words = F.filter(F.split(F.lower(text), SPACE), lambda w: w != "")
    hashes = let(F.transform(words, lambda w: F.xxhash64(w)), shingles_of)
    width = 1 << (64 - BIN_BITS)
    last = F.array(*[F.lit((i - BINS // 2) * width + width - 1).cast("long") for i in range(BINS)])  # the sentinel: a bin's largest value
    firsts = let(F.sort_array(F.concat(hashes, last)), lambda a: F.filter(a, lambda x, i: (i == 0) | (bin_of(F.get(a, i - 1)) != bin_of(x))))
    empty = F.lit(width - 1).cast("long")
    return F.transform(firsts, lambda x: F.when(x.bitwiseAND(empty) != empty, x))


def low_bits(minima: Column) -> Column:
    """Low-order bits of each bin after densification; no values for a text without shingles."""

    def densified(bins: Column) -> Column:
        filled = F.filter(F.transform(bins, lambda x, j: F.struct(j.alias("j"), x.alias("x"))), lambda b: b["x"].isNotNull())

        def fill(full: Column) -> Column:
            def first(i: Column) -> Column:
                order = F.transform(full, lambda b: F.struct(F.xxhash64(i, b["j"]).alias("order"), b["x"].alias("x")))
                return F.array_min(order)["x"]

            values = F.transform(bins, lambda x, i: F.coalesce(x, first(i)).bitwiseAND(F.lit((1 << LOW_BITS) - 1).cast("long")))
            return F.when(F.size(full) > 0, values).otherwise(F.array().cast("array<bigint>"))

        return let(filled, fill)

    return let(minima, densified)


def low_bits_of(text: Column) -> Column:
    return low_bits(bin_minima(text))


def packed(bits: Column) -> Column:
    return F.array_join(F.transform(bits, lambda v: F.lower(F.lpad(F.hex(v), LOW_BITS // 4, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Bias-corrected share of equal bins; 1 for two empty fingerprints."""
    chance = 1 / (1 << LOW_BITS)
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda n, x: n + x)
    corrected = F.greatest((equal / BINS - chance) / (1 - chance), F.lit(0.0))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.when(F.size(a) == F.size(b), 1.0).otherwise(0.0)).otherwise(corrected)


def with_next(rows: DataFrame, carried: list[str], range_rows: int = 4096, most_ranges: int = 16384) -> DataFrame:
    """Adds next, a struct of `carried` of the row that follows by (doc_id, text); the first row follows the last."""
    n = rows.count()
    ranges = max(1, min(most_ranges, -(-n // range_rows)))
    bounds = rows.agg(F.min("doc_id"), F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)] or [0.5], 10 * ranges)).first() if n else (None, None)
    bounds = sorted({bounds[0], *(bounds[1] or [])} - {None}) if ranges > 1 else sorted({bounds[0]} - {None})
    last = max(0, len(bounds) - 1)
    literal = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<bigint>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, last.bit_length())))])
    at = F.aggregate(steps, F.lit(0), lambda acc, s: F.when(F.get(literal, acc + s) <= F.col("doc_id"), acc + s).otherwise(acc))
    home = rows.withColumn("_range", F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(at))
    first = F.when(F.get(literal, F.col("_range")) == F.col("doc_id"), F.when(F.col("_range") > 0, F.col("_range") - 1))
    wraps = F.col("doc_id").isNull() | ((F.col("_range") == 0) & (F.col("doc_id") == F.get(literal, F.lit(0))))
    copies = F.array_compact(F.array(F.struct(F.col("_range").alias("range"), F.lit(0).alias("copy")), F.when(first.isNotNull(), F.struct(first.alias("range"), F.lit(1).alias("copy"))), F.when(wraps, F.struct(F.lit(last).alias("range"), F.lit(2).alias("copy")))))
    sent = home.withColumn("_to", F.explode(copies)).select(*rows.columns, "_to.range", "_to.copy")
    order = Window.partitionBy("range").orderBy("copy", F.col("doc_id").asc_nulls_first(), "text")
    return sent.withColumn("next", F.lead(F.struct(*carried)).over(order)).where("copy = 0").drop("range", "copy")


def edited_text() -> Column:
    """The last floor(n / 2) code points of text replaced by the first as many of next.text."""
    half = F.floor(F.col("n_chars") / 2).cast("int")
    return F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next.text"), F.lit(1), half))


def fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    rows = documents(docs).withColumn("n_chars", F.length("text").cast("long")).withColumn("bits", low_bits_of(F.col("text")))
    paired = with_next(rows, ["text", "bits"]).withColumn("edited", edited_text())
    out = paired.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "bits", low_bits_of(F.col("edited")).alias("edited_bits"), F.col("next.bits").alias("next_bits"))
    return out.select("doc_id", "n_chars", "edited_sha256", packed(F.col("bits")).alias("fingerprint"), packed(F.col("edited_bits")).alias("edited_fingerprint"), likeness(F.col("bits"), F.col("edited_bits")).alias("near_edited"), likeness(F.col("bits"), F.col("next_bits")).alias("near_next"))


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_pairs(read_table(spark, sf_dir, "documents"))
