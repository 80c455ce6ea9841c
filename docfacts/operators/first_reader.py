"""The first reader: values of fields by keywords in the line that holds them, without a document's type or sections.

A line's words meet the keywords' first words in an equi-join (the catalogue is broadcast, its size is checked); only where
the rest of the keyword follows is anything read. Lines are never compared with all keywords, and no line's text is
shuffled unless a value was read from it. Lines are gone through once: each gives its values by keyword and by shape and, as a
row without a field, its page, from which the document's first page is known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docfacts.functions import values
from docfacts.functions.text import fold, fold_column, let
from docfacts.operators.extraction import ANY_MARKER, MOST_HEADS, cited, once, two_places

#: Confidences with a keyword and by the shape alone, what a recognised page costs, longest labelled value.
WITH_KEYWORD, BY_SHAPE, RECOGNISED, LONGEST = 0.85, 0.70, 0.10, 200
MOST_KEYWORDS = 100_000
#: What a field holds, and so how it is read; TEXT is what stands after the keyword's colon.
DATE, MONEY, TAX_CODE, NUMBER, PROTOCOL, TEXT = "date", "money", "tax_code", "number", "protocol", "text"
READERS = {DATE: values.find_date, MONEY: lambda x: values.found_money(x)["value"], TAX_CODE: lambda x: values.find_tax_code(x, False), NUMBER: values.find_number, PROTOCOL: values.find_protocol}
#: What a line must hold for a reader to find anything, cheaply told.
SHAPES = {DATE: r"\d[/.-]\d{1,2}[/.-]\d", MONEY: r"\d", TAX_CODE: r"[A-Za-z]{6}\d{2}", NUMBER: r"(?i)n(?:umero|r|\.)", PROTOCOL: "(?i)prot"}
FIELD_SCHEMA = "field_id string, kind string, by_shape boolean, keywords array<string>"


#: The commonest forms of a line with a value: read at once, with the results of the readers above.
PLAIN = {
    DATE: r"^[A-Za-z ]+: \d{2}/\d{2}/[1-9]\d{3}\z", MONEY: r"^[A-Za-z ]+: (?:EUR )?\d{1,3}(?:\.\d{3})*,\d{2}\z", TAX_CODE: r"^[A-Za-z ]+: \d{11}\z", NUMBER: r"^[A-MOQ-Za-moq-z][A-Za-z]* n\. \d{1,31}\z",
    TEXT: r"^[A-Za-z ]+: [^:\s](?:[^:]{0,198}[^:\s])?\z",
}


def plain_value(kind: str, text: Column) -> Column:
    """The value of a line in the kind's plain form."""
    if kind == DATE:
        return F.concat_ws("-", F.substring(text, -4, 4), F.substring(text, -7, 2), F.substring(text, -10, 2)).try_cast("date").cast("string")
    if kind == MONEY:
        return F.translate(F.substring_index(text, ":", -1), ", EUR.", ".").try_cast("decimal(30,2)").cast("string")
    return F.substring(text, -11, 11) if kind == TAX_CODE else F.substring_index(text, " " if kind == NUMBER else ": ", -1)


def labelled(text: Column, keyword: Column) -> Column:
    """What follows the colon after the keyword, up to the line's end; null without, or if it is longer than `LONGEST`."""
    within = lambda x: F.concat(F.lit(" "), x, F.lit(" "))

    def of(parts: Column) -> Column:
        holds = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p, i: F.when(F.contains(within(fold(p)), within(keyword)), i))
        at = F.array_min(holds)
        rest = F.regexp_replace(F.array_join(F.slice(parts, at + 2, F.size(parts)), ":"), r"^\s+|\s+$", "")
        return let(rest, lambda r: F.when(F.length(r).between(1, LONGEST), r))

    label = F.regexp_replace(F.lower(F.substring_index(text, ":", 1)), " +", " ")
    plain = F.when(F.contains(within(F.trim(label)), within(keyword)), plain_value(TEXT, text))
    return F.when(text.rlike(PLAIN[TEXT]), plain).otherwise(let(F.split(text, ":", -1), of))


def found(kind: str, text: Column) -> Column:
    """What the kind's reader finds anywhere in the text."""
    read = READERS[kind](text)
    return F.when(text.rlike(PLAIN[kind]), plain_value(kind, text)).otherwise(read) if kind in PLAIN and kind != TAX_CODE else read


def value_of(kind: Column, text: Column, keyword: Column) -> Column:
    out = F.when(kind == TEXT, labelled(text, keyword))
    out = out.when((kind == TAX_CODE) & text.rlike(PLAIN[TAX_CODE]), plain_value(TAX_CODE, text)).when(kind == TAX_CODE, values.find_tax_code(text, True))
    for name in READERS:
        if name != TAX_CODE:
            out = out.when(kind == name, found(name, text))
    return out


def keywords_of(fields: DataFrame) -> DataFrame:
    """field_id, kind, keyword (folded), first (its first word), n (words), ord."""
    own = fields.select("field_id", "kind", F.posexplode("keywords").alias("ord", "keyword")).withColumn("keyword", fold(F.col("keyword"))).where("keyword <> ''")
    return own.withColumn("words", F.split("keyword", " ")).select("field_id", "kind", "keyword", "ord", F.get("words", F.lit(0)).alias("first"), F.size("words").alias("n"))


def met(rows: DataFrame, fields: DataFrame) -> DataFrame:
    """A row per line with at = 0, and one per keyword that stands in it, at the word `at` (from 1). rows: as `prefill`, with folded."""
    keys = keywords_of(fields)
    if keys.count() > MOST_KEYWORDS:
        raise ValueError(f"a catalogue of more than {MOST_KEYWORDS} keywords isn't broadcast")
    heads = [r["first"] for r in keys.select("first").distinct().collect()]
    words = rows.withColumn("words", F.concat(F.array(F.lit("")), F.split("folded", " ")))
    begun = words.select("*", F.posexplode_outer("words").alias("at", "first"))  # never empty; outer, so that no filter on its size splits the line once more
    if len(heads) <= MOST_HEADS:
        begun = begun.where((F.col("at") == 0) | F.col("first").isin(heads))
    at, n = F.col("at"), F.col("n")
    return begun.join(F.broadcast(keys), "first", "left").where((at == 0) | (F.array_join(F.slice("words", at + 1, n), " ") == F.col("keyword"))).drop("words", "first")


def candidates(rows: DataFrame, fields: DataFrame) -> DataFrame:
    """doc_id, page, field_id, b: all values by keyword outside citations and by shape, in the order in which a field prefers them; and each line without field and value."""
    alone = fields.where("by_shape").select(F.col("kind").alias("by"), F.col("field_id").alias("own"))
    kinds = sorted(r["by"] for r in alone.select("by").distinct().collect() if r["by"] in READERS)  # at most as many as there are readers
    text, keyed = F.col("text"), F.col("at") > 0
    one = lambda by, value: F.struct(by.cast("string").alias("by"), value.cast("string").alias("value"))
    likely = text.rlike(r"\d") & ~F.col("marked") & F.col("doc_id").isNotNull() & F.col("page").isNotNull()
    shaped = F.array(*[one(F.lit(k), F.when(text.rlike(SHAPES[k]), found(k, text))) for k in kinds], one(F.lit(None), F.lit(None)))
    own = F.when(~F.col("marked") | ~cited(F.col("folded"), F.col("at") - 1, F.col("n")), value_of(F.col("kind"), text, F.col("keyword")))
    read = F.when(keyed, F.array(one(F.lit(None), own))).when(likely, shaped).otherwise(F.array(one(F.lit(None), F.lit(None))))
    out = met(rows, fields).select("*", read.alias("read")).select("*", F.explode_outer("read").alias("r")).select("*", "r.*").drop("r", "read", "kind", "folded", "marked")
    out = out.where(F.col("value").isNotNull() | (~keyed & F.col("by").isNull())).join(F.broadcast(alone), "by", "left")
    penalty = F.when(F.col("text_source") == "OCR", RECOGNISED).otherwise(0.0)
    confidence = two_places(F.when(keyed, WITH_KEYWORD).otherwise(BY_SHAPE) - penalty)
    place = F.struct(F.when(keyed, 0).otherwise(1).alias("how"), F.coalesce(-F.length("keyword"), F.lit(0)).alias("shorter"), F.coalesce("ord", F.lit(0)).alias("ord"), "page", "line", "text", "value", confidence.alias("confidence"))
    return out.select("doc_id", "page", F.coalesce("field_id", "own").alias("field_id"), F.when(F.col("value").isNotNull(), place).alias("b"))


def prefill(lines: DataFrame, fields: DataFrame) -> DataFrame:
    """doc_id, field_id, value, confidence, page, line, text: each field's value by its longest keyword that reads one anywhere in the document, first line first; else, where the field allows it, by shape on the first page.

    lines: doc_id, page, line, text, text_source; fields: `FIELD_SCHEMA`. Keywords of one length go in the catalogue's order. Null texts
    and documents or fields without a value have no row; repeated lines and an empty catalogue are no trouble. Other columns are ignored.
    """
    rows = lines.select("doc_id", "page", "line", "text", "text_source").where("text is not null")
    rows = once(once(rows, "folded", fold_column(F.col("text"))), "marked", F.col("folded").rlike(ANY_MARKER))
    # by shape, the first of a field's values is the one that counts, so that it stands on the document's first page or none does
    best = candidates(rows, fields).groupBy("doc_id", "field_id").agg(F.min("b").alias("b"), F.min("page").alias("page"))
    best = best.withColumn("first_page", F.min("page").over(Window.partitionBy("doc_id"))).where("b is not null and (b.how = 0 or b.page = first_page)")
    return best.select("doc_id", "field_id", "b.value", "b.confidence", "b.page", "b.line", "b.text")
