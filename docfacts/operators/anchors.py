"""Labels learned from selections: the single-label probe, the anchor that a selection supports, and reading documents again with learned anchors.

Labels differ by document, so a document's lines are brought together with the labels asked of it, an equi-join by document (or page), and read where
they meet: what is moved is lines, not their runs of words, and no catalogue is in memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfacts.functions.text import fold_column
from docfacts.operators.extraction import BARE, COLUMNS, TRAILING_TAX_ID, cited_line, label_span, once, read_by_kind
from docfacts.operators.picks import candidate_labels, derive_anchor

SAME_LINE, NEXT_LINE = "same-line", "next-line"
MOST_ANCHORS = 200_000  # up to so many learned anchors are broadcast
LEAST_PICKS = 2  # selections that a template's anchor needs


def kinds_of(wanted: DataFrame) -> list[tuple]:
    """The kinds of values that are asked for: those of the field catalogue."""
    return sorted({tuple(r) for r in wanted.select("type", F.col("format").cast("string"), F.col("scale").cast("string")).distinct().collect()}, key=str)


def places(rows: DataFrame) -> DataFrame:
    """Adds g = (first, n): a row per place where `label` stands in `folded` between word boundaries. Lines without the label are passed over before any is cut into words."""
    bounded = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
    held = rows.where((F.col("label") != "") & F.contains(bounded(F.col("folded")), bounded(F.col("label"))))
    begun = held.select("*", F.size(F.split("label", " ")).alias("_n"), F.split("folded", " ").alias("_words")).select("*", F.posexplode("_words").alias("_first", "_head"))
    there = F.array_join(F.slice("_words", F.col("_first") + 1, F.col("_n")), " ") == F.col("label")
    whole = begun.where((F.col("_head") == F.substring_index("label", " ", 1)) & there)
    return whole.withColumn("g", F.struct(F.col("_first").alias("first"), F.col("_n").alias("n"))).drop("_words", "_first", "_head", "_n")


def read_places(found: DataFrame, kinds: list[tuple]) -> DataFrame:
    """Rows of `places` whose label reads a value, with label_end, value_line and value. found: line, text, folded, next_text, label, relation (null: either), type, format, scale, g, ..."""
    found = once(found, "span", label_span(F.col("text"), F.col("folded"), F.col("label"), F.col("g")))
    found = found.withColumn("before", F.rtrim(F.substring("text", F.lit(1), F.col("span.start")))).withColumn("rest", F.substring(F.col("text"), F.col("span.end") + 1, F.length("text")))
    opens = (F.col("before") == "") | F.col("before").rlike("[-–—|;•(]$") | ((F.trim("rest") == "") & F.col("before").rlike(TRAILING_TAX_ID))
    found = once(found.where((F.col("type") != "string") | opens), "cited", cited_line(F.col("text"), F.col("folded"), F.col("g.first"), F.col("g.n"))).where("not cited")
    here = F.when(~F.col("relation").eqNullSafe(F.lit(NEXT_LINE)) & ~((F.col("type") == "money") & F.col("rest").rlike(COLUMNS)), read_by_kind(F.col("rest"), kinds, False))
    ends = F.col("here").isNull() & ~F.col("relation").eqNullSafe(F.lit(SAME_LINE)) & F.col("rest").rlike(BARE + "$") & F.col("next_text").isNotNull()
    found = once(once(found, "here", here), "below", F.when(ends, read_by_kind(F.col("next_text"), kinds, True)))
    read = found.withColumn("value", F.coalesce("here", "below")).where("value is not null")
    return read.withColumn("label_end", F.col("span.end")).withColumn("value_line", F.col("line") + F.col("here").isNull().cast("int"))


def label_reads(rows: DataFrame, wanted: DataFrame, by: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """Every value that a label reads on its page (or, with `by` = doc_id alone, in its document): wanted's columns, page, line, label_end, value_line, value.

    rows: lines as `extraction.lines` gives them; wanted: `by`, label (folded), relation (null: either), type, format, scale, and what else it
    carries. The rules are the extraction's: word boundaries, the type's reader, no cited labels, text only where the label opens a segment; but no
    twins and no other labels, since a label is probed by itself. Lines meet the labels that their page (or document) is asked for: no run of words is moved.
    """
    wanted = wanted.withColumn("format", F.col("format").cast("string")).withColumn("scale", F.col("scale").cast("string"))
    extra = [c for c in wanted.columns if c not in ("doc_id", "page", "line")]
    asked = wanted.groupBy(*by).agg(F.collect_list(F.struct(*extra)).alias("_asked"))
    own = rows.select("doc_id", "page", "line", "text", "next_text").hint("merge").join(asked, list(by))
    lines = own.select("doc_id", "page", "line", "text", "next_text", "_asked", F.explode(F.array(fold_column(F.col("text")))).alias("folded"))
    found = lines.select("doc_id", "page", "line", "text", "next_text", "folded", F.explode("_asked").alias("_a")).select("*", "_a.*").drop("_a")
    return read_places(places(found), kinds_of(wanted)).select("doc_id", "page", "line", *extra, "label_end", "value_line", "value")


def with_pages(rows: DataFrame, picks: DataFrame) -> DataFrame:
    """Picks with _lines, their page's lines (line, text, folded) in order: lines and picks are moved once, by page, and all that follows of a page stays there."""
    own = [c for c in picks.columns if c not in ("doc_id", "page")]
    chosen = picks.groupBy("doc_id", "page").agg(F.collect_list(F.struct(*own)).alias("_picks"))
    # lines drawn from compressed tables are estimated far too small: unhinted, they would be broadcast through the driver
    met = rows.select("doc_id", "page", "line", "text").hint("merge").join(chosen, ["doc_id", "page"])
    line = F.struct("line", "text", fold_column(F.col("text")).alias("folded"))
    whole = met.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(line)).alias("_lines"), F.first("_picks").alias("_picks"))
    return whole.select("doc_id", "page", "_lines", F.explode("_picks").alias("_p")).select("doc_id", "page", "_lines", "_p.*")


def text_at(line: Column) -> Column:
    """The text of a line of `_lines`; null without it."""
    return F.get(F.filter("_lines", lambda x: x["line"] == line), F.lit(0))["text"]


def labelled(paged: DataFrame) -> DataFrame:
    """Adds relation and label to picks of `with_pages`: labels that end right before each selection, or on the line above where no letter stands before it on its own line."""
    at = once(paged, "_text", text_at(F.col("line"))).where((F.col("column") >= 0) & (F.col("column") <= F.length("_text")))
    before = F.substring("_text", F.lit(1), F.col("column"))
    same = before.rlike(r"\p{L}")
    asked = once(at, "_source", F.when(same, before).otherwise(text_at(F.col("line") - 1))).where("_source is not null")
    asked = once(asked.withColumn("relation", F.when(same, SAME_LINE).otherwise(NEXT_LINE)), "_labels", candidate_labels(F.col("_source")))
    return asked.withColumn("label", F.explode("_labels")).drop("_text", "_source", "_labels")


def candidates(rows: DataFrame, picks: DataFrame) -> DataFrame:
    """The picks' columns, relation, label: see `labelled`.

    picks: pick, doc_id, page, line, column (0-based, where the selection begins), type, format, scale.
    """
    return labelled(with_pages(rows, picks)).select(*picks.columns, "relation", "label")


def derive_anchors(rows: DataFrame, picks: DataFrame, *more: str) -> DataFrame:
    """pick, label, relation and the picks' columns `more`: of each selection the shortest label before it that reads exactly once on its page, and there the selection. Selections without such a label have no row.

    A pick's number is its own. A page's labels are read and counted where its lines are.
    """
    picks = picks.withColumn("format", F.col("format").cast("string")).withColumn("scale", F.col("scale").cast("string"))
    needed = dict.fromkeys(("pick", "doc_id", "page", "line", "column", "type", "format", "scale", *more))
    asked = labelled(with_pages(rows, picks.select(*needed))).withColumnsRenamed({"line": "own_line", "column": "own_column"})
    lines = asked.withColumn("_l", F.explode("_lines")).select("*", "_l.*").drop("_l")
    found = places(lines).withColumn("next_text", text_at(F.col("line") + 1)).drop("_lines")
    fits = (F.col("value_line") == F.col("own_line")) & ((F.col("relation") == NEXT_LINE) | (F.col("label_end") <= F.col("own_column")))
    of = ("doc_id", "page", "pick", *more)
    counted = read_places(found, kinds_of(picks)).groupBy(*of, "relation", "label").agg(F.count("*").alias("reads"), F.bool_and(fits).alias("at_selection"))
    return derive_anchor(counted, of).select("pick", "label", "relation", *more)


def learned_anchors(anchors: DataFrame, least: int = LEAST_PICKS) -> DataFrame:
    """template, field_id, label, relation, n: of each template's field the anchor that most selections support, `least` or more; the shortest of equals.

    anchors: template, field_id, label, relation, a row per selection.
    """
    counted = anchors.groupBy("template", "field_id", "label", "relation").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    best = F.min_by(F.struct("label", "relation", "n"), F.struct(-F.col("n"), F.length("label"), "label", "relation"))
    return counted.groupBy("template", "field_id").agg(best.alias("a")).select("template", "field_id", "a.label", "a.relation", "a.n")


def read_again(rows: DataFrame, documents: DataFrame, learned: DataFrame, kinds: DataFrame) -> DataFrame:
    """doc_id, field_id, label, value: what the anchors of each document's template read in it, the first read of a field.

    documents: doc_id, template; kinds: field_id, type, format, scale. Lines that carry their document's template aren't moved before they are read.
    """
    learned = learned.localCheckpoint()
    wanted = learned.select("template", "field_id", "label", "relation").join(F.broadcast(kinds.select("field_id", "type", F.col("format").cast("string").alias("format"), F.col("scale").cast("string").alias("scale"))), "field_id")
    if learned.count() <= MOST_ANCHORS:
        own = rows if "template" in rows.columns else rows.hint("merge").join(documents, "doc_id")
        asked = wanted.groupBy("template").agg(F.collect_list(F.struct("field_id", "label", "relation", "type", "format", "scale")).alias("_asked"))
        met = own.select("doc_id", "page", "line", "text", "folded", "next_text", "template").join(F.broadcast(asked), "template")
        found = met.withColumn("folded", F.explode(F.array("folded"))).withColumn("_a", F.explode("_asked")).select("doc_id", "page", "line", "text", "folded", "next_text", "_a.*")
        reads = read_places(places(found), kinds_of(kinds))
    else:
        reads = label_reads(rows, documents.join(wanted, "template").drop("template"), ("doc_id",))
    return reads.groupBy("doc_id", "field_id", "label").agg(F.min_by("value", F.struct("page", "value_line", "label_end")).alias("value"))


def column_of(text: Column, written: Column) -> Column:
    """0-based place of a written value in a line; -1 if it isn't there."""
    return F.call_function("instr", text, written) - 1
