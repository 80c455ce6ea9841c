"""Where a value stands: boxes, unique places, nearest occurrences, and the labels before it that a rule may learn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docfacts.functions.text import collapse, fold, is_cleanup, let, word_bounded

LEAST_SEPARATION, LABEL_WORDS, LEAST_LETTERS = 1.0, 3, 3


def union_box(boxes: Column) -> Column:
    """The box around an array of boxes struct<x, y, w, h>."""
    x, y = F.array_min(F.transform(boxes, lambda b: b["x"])), F.array_min(F.transform(boxes, lambda b: b["y"]))
    right, bottom = F.array_max(F.transform(boxes, lambda b: b["x"] + b["w"])), F.array_max(F.transform(boxes, lambda b: b["y"] + b["h"]))
    return F.struct(x.alias("x"), y.alias("y"), (right - x).alias("w"), (bottom - y).alias("h"))


def overlaps(a: Column, b: Column) -> Column:
    """Horizontal overlap, and vertical overlap of half the smaller height or more. A box that is null or lacks a number overlaps nothing."""
    across = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    down = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    whole = F.lit(True)  # least and greatest pass over nulls
    for box in (a, b):
        for side in "xywh":
            whole = whole & box[side].isNotNull()
    return whole & (across > 0) & (down >= F.least(a["h"], b["h"]) / 2)


def lines_under(picks: DataFrame, lines: DataFrame) -> DataFrame:
    """pick, line: the lines that a drawn box touches. picks: pick, doc_id, page, box; lines: doc_id, page, line, box."""
    there = lines.select("doc_id", "page", "line", F.col("box").alias("line_box"))
    return picks.join(there, ["doc_id", "page"]).where(overlaps(F.col("box"), F.col("line_box"))).select("pick", "line")


def first_line(text: Column) -> Column:
    """The first line that isn't blank, trimmed; null without one. Evidence read over two lines is found again by it."""
    return F.get(F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != ""), F.lit(0))


def text_range(text: Column, evidence: Column) -> Column:
    """struct<start, end>: where the evidence's first line first stands in a text, in the same letters or else in any case, whatever white space parts its words; null if nowhere or without words."""

    def pattern(line: Column) -> Column:
        quoted = F.transform(F.split(line, r"\s+"), lambda w: F.regexp_replace(w, r"([\\.\[\]{}()*+?^$|\-])", r"\\$1"))
        return F.array_join(quoted, r"\s+")

    def found(m: Column) -> Column:
        at = F.position(m, text)
        return F.when(at > 0, F.struct((at - 1).alias("start"), (at - 1 + F.length(m)).alias("end")))

    return let(pattern(first_line(evidence)), lambda p: let(F.coalesce(F.regexp_substr(text, p), F.regexp_substr(text, F.concat(F.lit("(?iu)"), p))), found))


def matched_spans(spans: Column, evidence: Column) -> Column:
    """struct<first, last>: which of a page's fragments hold the evidence's first line, white space left out on both sides; in the same letters or else in any case.

    spans: array of text in reading order. Null if it stands nowhere, without words, or where a fragment is null. A place in the joined
    text is led back to its fragment by a running sum of lengths, linear in the fragments.
    """

    def owner(compact: Column, place: Column) -> Column:
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda acc, x: let(acc["end"] + F.length(x), lambda end: F.struct(end.alias("end"), (acc["n"] + (end < place).cast("int")).alias("n")))
        return F.aggregate(compact, start, step, lambda acc: acc["n"])

    def of(compact: Column) -> Column:
        def in_joined(joined: Column) -> Column:
            def there(needle: Column) -> Column:
                exact, any_case = F.position(needle, joined), F.position(F.lower(needle), F.lower(joined))
                at = F.when(exact > 0, exact).when(any_case > 0, any_case)
                return let(at, lambda p: F.when(p.isNotNull(), F.struct(owner(compact, p).alias("first"), owner(compact, p + F.length(needle) - 1).alias("last"))))

            return let(F.regexp_replace(first_line(evidence), r"\s+", ""), there)

        return let(F.array_join(compact, ""), in_joined)

    return F.when(~F.exists(spans, lambda x: x.isNull()), let(F.transform(spans, lambda x: F.regexp_replace(x, r"\s+", "")), of))


def recorded_picks(edits: DataFrame) -> DataFrame:
    """Selections that stand as evidence of a reviewer's value, with text_corrected: those that read the value, and recognised ones that the value only cleans up.

    edits: text (selected), value, method (OCR or another) and what else there is. Blank values and empty selections leave none.
    """
    read = collapse(F.col("text"))
    corrected = read != F.col("value")
    kept = ~corrected | ((F.col("method") == "OCR") & is_cleanup(read, F.col("value")))
    return edits.where("trim(value) <> ''").where(kept & (read != "")).withColumn("text_corrected", corrected)


def occurrences_of(text: Column, value: Column) -> Column:
    """0-based places of value in text, overlapping ones too."""
    return F.filter(F.sequence(F.lit(0), F.greatest(F.length(text) - F.length(value), F.lit(0))), lambda i: F.substring(text, i + 1, F.length(value)) == value)


def unique_place(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, key, page, line: where a value (any of `variants`, word-bounded, three characters or more) stands exactly once in its document.

    lines: doc_id, page, line, text; wanted: doc_id, key, variants.
    """
    pairs = lines.join(wanted, "doc_id").withColumn("variant", F.explode("variants")).where(F.length("variant") >= 3)
    hits = pairs.where(F.contains(F.col("text"), F.col("variant")) & word_bounded(F.col("text"), F.col("variant")))
    places = hits.groupBy("doc_id", "key", "page", "line").agg(F.count("*").alias("n"))
    only = places.groupBy("doc_id", "key").agg(F.sum("n").alias("n"), F.first("page").alias("page"), F.first("line").alias("line"))
    return only.where("n = 1").drop("n")


def locate(candidates: DataFrame) -> DataFrame:
    """The occurrence that a selection means: the only one, the only one on its lines, or the nearest by `distance` with a clear lead.

    candidates: pick, line, start, on_line, distance. Returns pick, line, start, how (UNIQUE, LINES, NEAREST).
    """
    w = Window.partitionBy("pick")
    near = Window.partitionBy("pick").orderBy(F.col("on_line").desc(), "distance", "line", "start")
    ranked = candidates.withColumn("n", F.count("*").over(w)).withColumn("n_lines", F.sum(F.col("on_line").cast("int")).over(w)).withColumn("rn", F.row_number().over(near)).withColumn("next", F.lead("distance").over(near))
    how = F.when(F.col("n") == 1, "UNIQUE").when((F.col("n_lines") == 1) & F.col("on_line"), "LINES").when(F.col("on_line") & (F.col("next") - F.col("distance") >= LEAST_SEPARATION), "NEAREST")
    return ranked.where("rn = 1").withColumn("how", how).where("how is not null").select("pick", "line", "start", "how")


def candidate_labels(before: Column) -> Column:
    """Folded labels of one to three words that end right before a value: words back to a digit, an @ or the end of another label; shortest first."""
    tail = F.regexp_replace(F.trim(before), r"[\s:=.\-–—]+$", "")
    words = F.split(F.regexp_extract(tail, r"([^:=;|]*)$", 1), r"\s+")

    def of(w: Column) -> Column:
        last = F.reverse(F.slice(F.reverse(w), 1, LABEL_WORDS))
        stop = F.aggregate(F.transform(last, lambda x, i: F.when(x.rlike(r"[0-9@]"), i + 1).otherwise(0)), F.lit(0), lambda m, i: F.greatest(m, i))
        kept = F.slice(last, stop + 1, F.lit(LABEL_WORDS))
        tails = F.transform(F.sequence(F.lit(1), F.greatest(F.size(kept), F.lit(1))), lambda n: fold(F.array_join(F.slice(kept, F.greatest(F.size(kept) - n + 1, F.lit(1)), n), " ")))
        return F.array_distinct(F.filter(tails, lambda t: F.length(F.regexp_replace(t, "[^a-z]", "")) >= LEAST_LETTERS))

    return let(words, of)


def derive_anchor(labels: DataFrame, of: tuple[str, ...] = ("pick",)) -> DataFrame:
    """pick (or what else tells selections apart, `of`), label and, where labels have one, relation: the shortest label that reads exactly once on its page, at the selection.

    labels: pick, label, relation (a pick's own), reads (how many values it reads on the page), at_selection.
    """
    ok = labels.where("reads = 1 and at_selection")
    kept = [c for c in ("label", "relation") if c in labels.columns]
    return ok.groupBy(*of).agg(F.min_by(F.struct(*kept), F.struct(F.length("label"), *kept)).alias("a")).select(*of, "a.*")


def made_of(label: Column, entity_words: Column) -> Column:
    """Whether a label consists only of words of the document's own values: no rule for a whole type may rest on it."""
    return F.size(F.array_except(F.split(label, " "), entity_words)) == 0
