"""Secret scan: three fixed patterns, and two character Markov models compared by log-likelihood ratio.

The models are first-order: transition probabilities between the characters of [A-Za-z0-9+/_=.-] in random strings and in
ordinary identifiers, smoothed by the characters' own frequencies (add-one). They are learned from labelled samples (value, is_secret); by default these
come from all documents: what the fixed patterns match are secrets, other words of
eight or more letters, digits and marks are identifiers. A candidate is a maximal run of such characters, of `min_length` or more, in what is
left when pattern spans are blanked out, kind by kind; it is a secret if its mean log-likelihood ratio per character exceeds `threshold`.

Main path: DataFrame functions alone, two passes. The first counts equal samples by a shuffle, then their transitions, which have
at most 2 * 68 * 68 rows whatever the input; the second shuffles nothing. Regular expressions yield matches and the pieces between; positions are running sums
of their lengths, taken in chunks, so that a text with very many matches takes time of about its length.

Nulls: a null text is empty, a null doc_id stays null. Repeated rows are scanned each. Extra columns are ignored. Positions
count code points, ends are exclusive. Without samples both models are uniform and nothing is added.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docfacts.llm.common import documents, let, read_table

#: The patterns of the kinds, in the order in which ties are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # AKIA[A-Z0-9]+ of 18 or more characters: the run is maximal either way
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-"
SYMBOLS = len(ALPHABET)
SMOOTHING = 20  # weight of a character's own frequency in its transition probabilities
RUN = r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{%d,}+"
SPAN = "array<struct<start:int,end:int,kind:int>>"
CHUNK = 400  # of running sums
LEAST_VALUE = 12  # characters of an assigned value


def folded_sums(x: Column, base: Column) -> Column:
    """base plus the running sums of an array; a fold copies what it has at every step."""
    start = F.struct(base.alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"] + n)).alias("out"))
    return F.aggregate(x, start, step, lambda acc: acc["out"])


def running_sums(x: Column) -> Column:
    """Running sums of an array of ints: folds within chunks of CHUNK, then of the chunks' sums."""

    def chunked(x: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / CHUNK).cast("int")), lambda i: F.slice(x, i * CHUNK + 1, F.lit(CHUNK)))

        def placed(parts: Column) -> Column:
            ends = folded_sums(F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, b: a + b)), F.lit(0))
            return let(ends, lambda e: F.flatten(F.transform(parts, lambda p, i: folded_sums(p, F.when(i == 0, 0).otherwise(F.get(e, i - 1))))))

        return let(chunks, placed)

    return let(x, lambda x: F.when(F.size(x) <= CHUNK, folded_sums(x, F.lit(0))).otherwise(chunked(x)))


def spans_of(text: Column, pattern: str, kind: int) -> Column:
    """(start, end, kind) of all matches: they alternate with the pieces that split() leaves."""

    def positions(matches: Column) -> Column:
        pieces = F.zip_with(F.split(text, pattern, -1), matches, lambda piece, m: F.struct(F.length(piece).alias("gap"), F.length(m).alias("n")))
        whole = F.filter(pieces, lambda x: x["n"].isNotNull())  # what follows the last match isn't needed
        ends = let(whole, lambda w: F.zip_with(running_sums(F.transform(w, lambda x: x["gap"] + x["n"])), w, lambda end, x: F.struct((end - x["n"]).alias("start"), end.alias("end"), F.lit(kind).alias("kind"))))
        return F.when(F.size(matches) > 0, ends).otherwise(F.array().cast(SPAN))

    return let(F.regexp_extract_all(text, F.lit(pattern), 0), positions)


def blanked(text: Column, pattern: str, least_value: int = 0) -> Column:
    """The text with all matches as spaces, one for each character; with `least_value` only those whose second group is as long."""
    matches = F.regexp_extract_all(text, F.lit(pattern), 0)
    found = F.zip_with(matches, F.regexp_extract_all(text, F.lit(pattern), 2), lambda m, v: F.when(F.length(v) >= least_value, F.repeat(F.lit(" "), F.length(m))).otherwise(m)) if least_value else F.transform(matches, lambda m: F.repeat(F.lit(" "), F.length(m)))
    return F.array_join(F.zip_with(F.split(text, pattern, -1), found, lambda piece, m: F.concat(piece, F.coalesce(m, F.lit("")))), "")


def pattern_spans(text: Column) -> Column:
    """All spans of the fixed patterns by start, then kind."""
    none = F.array().cast(SPAN)
    values = F.regexp_extract_all(text, F.lit(ASSIGN), 2)
    assign = F.filter(F.zip_with(spans_of(text, ASSIGN, 0), values, lambda s, v: F.when(F.length(v) >= LEAST_VALUE, s)), lambda s: s.isNotNull())
    assign = F.when((F.instr(text, ":") > 0) | (F.instr(text, "=") > 0), assign).otherwise(none)
    access = F.when(F.instr(text, "AKIA") > 0, spans_of(text, ACCESS, 1)).otherwise(none)
    return F.array_sort(F.concat(assign, access, spans_of(text, HEX, 2)))


def slots(value: Column) -> Column:
    """Index of the transition at each character but the last, 1-based into a table of SYMBOLS * SYMBOLS."""
    codes = F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    return let(codes, lambda a: F.transform(F.sequence(F.lit(0), F.greatest(F.size(a) - 2, F.lit(0))), lambda i: F.get(a, i) * SYMBOLS + F.coalesce(F.get(a, i + 1), F.lit(-1)) + 1))


def labelled_samples(docs: DataFrame) -> DataFrame:
    """(value, is_secret) of all documents."""
    secrets = F.concat(F.regexp_extract_all("text", F.lit(ACCESS), 0), F.regexp_extract_all("text", F.lit(HEX), 0), F.filter(F.regexp_extract_all("text", F.lit(ASSIGN), 2), lambda v: F.length(v) >= LEAST_VALUE))
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    ordinary = F.regexp_extract_all(plain, F.lit(RUN % 8), 0)
    labelled = lambda a, label: F.transform(a, lambda v: F.struct(v.alias("value"), F.lit(label).alias("is_secret")))
    return docs.select(F.explode(F.concat(labelled(secrets, True), labelled(ordinary, False))).alias("x")).select("x.value", "x.is_secret")


def ratio_table(samples: DataFrame) -> list[float]:
    """log P(b|a) among secrets minus that among identifiers, for all transitions a, b; at most 2 * SYMBOLS**2 rows reach the driver."""
    values = samples.where("length(value) > 1").groupBy("is_secret", "value").count()
    pairs = values.select("is_secret", "count", F.explode(slots(F.col("value"))).alias("slot"))
    n = {(r["is_secret"], r["slot"]): r["n"] for r in pairs.groupBy("is_secret", "slot").agg(F.sum("count").alias("n")).collect()}

    def logs(label: bool) -> list[float]:
        rows = [[n.get((label, a * SYMBOLS + b + 1), 0) for b in range(SYMBOLS)] for a in range(SYMBOLS)]
        follows = [1 + sum(row[b] for row in rows) for b in range(SYMBOLS)]
        share = [x / sum(follows) for x in follows]
        return [math.log((row[b] + SMOOTHING * share[b]) / (sum(row) + SMOOTHING)) for row in rows for b in range(SYMBOLS)]

    return [round(r - i, 6) for r, i in zip(logs(True), logs(False), strict=True)]


def find_secrets(docs: DataFrame, samples: DataFrame | None = None, min_length: int = 20, threshold: float = 0.5) -> DataFrame:
    """doc_id, base (spans of the patterns) and added (those of the models alone), each by start, then kind."""
    rows = documents(docs)
    table = F.array(*[F.lit(x) for x in ratio_table(samples if samples is not None else labelled_samples(rows))])

    def score(value: Column) -> Column:
        return F.aggregate(slots(value), F.lit(0.0), lambda acc, slot: acc + F.get(table, slot - 1)) / (F.length(value) - 1)

    def likely(text: Column) -> Column:
        runs = F.zip_with(spans_of(text, RUN % min_length, 3), F.regexp_extract_all(text, F.lit(RUN % min_length), 0), lambda s, v: F.struct(s.alias("s"), v.alias("v")))
        return F.transform(F.filter(runs, lambda r: score(r["v"]) > threshold), lambda r: r["s"])

    rest = let(let(blanked(F.col("text"), ASSIGN, LEAST_VALUE), lambda t: blanked(t, ACCESS)), lambda t: blanked(t, HEX))

    def both(base: Column) -> Column:
        added = F.when(F.size(base) == 0, likely(F.col("text"))).otherwise(let(rest, likely))
        return F.struct(base.alias("base"), added.alias("added"))

    return rows.select("doc_id", let(pattern_spans(F.col("text")), both).alias("s")).select("doc_id", "s.base", "s.added")


def written(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(read_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    all_spans = F.array_sort(F.concat("base", "added"))
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(all_spans).alias("spans"))
